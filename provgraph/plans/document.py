"""The build of whole records: suppliers as documents' rows, with names that match in order, places that are unclear, fields
of every role, and edges that the gate lets in or not."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import prose as T
from ..operators import records as R
from ..operators.resolve import closure
from ..operators.state import checkpoint
from . import world as W
from .world import SQL, read


def _s(x):
    return F.col(x).cast("string")


def _name(k):
    return F.concat(F.lit("Supplier#"), F.lpad(k.cast("string"), 9, "0"))


def _records(spark, sf_dir):
    k = F.col("s_suppkey")
    home = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name"), "n_regionkey").select(F.col("n_nationkey").alias("s_nationkey"), "r_name")
    unit = F.when(k % 3 == 0, _name(k)).when(k % 3 == 1, F.concat(_name(k - 1), F.lit("  spare"))).otherwise(F.concat(F.lit("Odd "), (k % 7).cast("string")))
    kind = F.concat(F.when(k % 10 == 9, "loose ").otherwise("gauge "), (k % 2).cast("string"))
    fields = {"unit": unit, "kind": kind, "ghost": F.when(k % 9 == 0, "boo"), "ref2": F.concat(F.lit("NATION_"), ((k + 1) % 30).cast("string")), "size": (k % 5).cast("string"), "memo": F.lit("words"), "page": F.lit("1"), "junk": F.lit("x"), "other": F.lit("y")}
    return read(spark, sf_dir, "supplier").join(home, "s_nationkey").select(
        F.concat(F.lit("D"), (k % 5).cast("string")).alias("doc"), k.alias("piece"), F.concat(F.lit("L"), _s("s_suppkey")).alias("locator"), F.when(k % 10 == 9, "customer").otherwise(F.concat(F.lit("NATION_"), _s("s_nationkey"))).alias("ref"),
        F.when(k % 4 == 3, "ASIA").otherwise(F.col("r_name")).alias("grp"), F.when(k % 4 < 2, "supplier").alias("axis"), F.create_map(F.lit("site"), (k % 2).cast("string")).alias("context"),
        F.create_map(*(x for name, value in fields.items() for x in (F.lit(name), value))).alias("fields"),
    )


SCHEMA = [
    ("unit", "entity", "Unit", None, None, None, None), ("kind", "entity", "Property", "process", None, None, None), ("ghost", "entity", "Ghost", None, None, None, None), ("ref2", "anchor", "Process", None, None, None, None),
    ("size", "attribute", None, None, "unit", "extent", True), ("memo", "content", None, None, "kind", None, None), ("page", "meta", None, None, None, None, None), ("junk", "remark", None, None, None, None, None),
]
DECLARED = [("unit", "part_of", "@process_ref"), ("unit", "has_property", "kind"), ("kind", "owns", "unit"), ("ref2", "precedes", "@process_ref")]


def _built(spark, sf_dir, threshold=R.MATCH):
    k = F.regexp_extract("id", "([0-9]+)$", 1).cast("bigint")
    nodes = checkpoint(W.nodes(spark, sf_dir).where((F.col("category") != "Unit") | (k % 6 == 0)).withColumn("merged_into", F.lit(None).cast("string")))
    dictionary = nodes.select(F.col("canonical").alias("surface"), F.col("id").alias("node_id"), "category", "layer", "polarity").union(nodes.where("tier = 'detail'").select("polarity", "id", "category", "layer", "polarity"))
    records = checkpoint(_records(spark, sf_dir))
    chunks = records.select(F.explode(F.array(*(F.struct(F.concat(F.lit(f"{f}-"), "locator").alias("chunk_id"), "doc", F.lit(f).alias("field"), "locator") for f in ("memo", "other")))).alias("c")).select("c.*")
    schema = spark.createDataFrame(SCHEMA, "field string, role string, category string, target_layer string, attach_to string, attr string, contextual boolean")
    declared, patterns = spark.createDataFrame(DECLARED, "src_field string, rel string, dst_field string"), spark.createDataFrame(W.PATTERNS, "src_cat string, rel string, dst_cat string, symmetric boolean")
    layer = R.Layer("process", {"Process": "process", "Unit": "process", "Property": "process", "Failure": "quality"}, W.AXIS, ["Unit"], ["Property"], threshold)
    return R.build(records, schema, declared, dictionary, nodes, closure(nodes), chunks, patterns, layer)


def build_document(spark, sf_dir):
    """All outputs in one: (what, a, b, c, n)."""
    out = _built(spark, sf_dir)
    name = out["nodes"].select(F.col("id").alias("node_id"), F.concat_ws("/", "canonical", "polarity").alias("name"))
    named = lambda df, c: df.withColumnRenamed(c, "node_id").join(name, "node_id", "left").withColumn(c, F.coalesce("name", "node_id")).drop("node_id", "name")
    none = F.lit(None).cast("string")
    parts = [
        named(out["resolved"].where("field in ('unit', 'kind', 'ref2')").withColumnRenamed("node_id", "node"), "node").select(F.lit("resolved").alias("what"), F.col("field").alias("a"), _s("piece").alias("b"), F.col("node").alias("c")),
        out["nodes"].select(F.lit("node"), "canonical", "polarity", "category"),
        named(out["values"], "node").select(F.lit("value"), "node", F.concat_ws("=", "attr", "value"), F.concat_ws("@", F.col("context")["site"], "locator")),
        named(out["describes"].withColumnRenamed("node_id", "node"), "node").select(F.lit("describes"), "chunk_id", "node", none),
        named(named(out["edges"], "src"), "dst").select(F.lit("edge"), F.concat_ws("|", "src", "rel", "dst"), F.array_join(F.array_sort("docs"), ","), none),
        out["rejected"].select(F.lit("rejected"), "verdict", _s("n"), none),
        named(out["queue"].withColumnRenamed("key", "node"), "node").select(F.lit("queue"), "kind", "doc", "node"),
        out["defects"].select(F.lit("defect"), "doc", "field", "role"),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.union(part)
    return rows.groupBy("what", "a", "b", "c").agg(F.count("*").alias("n"))


def uncertain_matches(spark, sf_dir):
    """With a threshold above what a name that holds another scores, such names are nodes of their own, and in the queue."""
    return _built(spark, sf_dir, 0.97)["queue"].where("kind in ('auto_node', 'uncertain_match')").groupBy("kind").agg(F.count("*").alias("n"), F.min("doc").alias("least"))


def _prose(spark, sf_dir):
    """Parts as chunks of seven documents: what types show which names, some the wrong way round or with an end that nothing has, and
    attachments, some to nothing or to what only the dictionary has."""
    k, text = F.col("p_partkey"), F.when
    said = text(k % 4 == 0, F.concat(F.lit("the "), "p_type", F.lit(" shows "), "p_name")).when(k % 4 == 1, F.concat("p_name", F.lit(" near  "), "p_type")).when(k % 4 == 2, F.concat(F.lit("the "), "p_type", F.lit(" shows nothing"))).otherwise(F.col("p_name"))
    part = read(spark, sf_dir, "part").select(F.concat(F.lit("D"), (k % 7).cast("string")).alias("doc"), k.alias("piece"), "p_name", "p_type", said.alias("text"))
    chunks = part.select("doc", "piece", F.concat(F.lit("K"), _s("piece")).alias("chunk_id"), "text", F.when(F.col("piece") % 3 == 0, "NATION_1").when(F.col("piece") % 3 == 1, "customer").alias("ref"), F.lit("AMERICA").alias("grp"), F.lit(None).cast("string").alias("axis"))
    nodes = checkpoint(W.nodes(spark, sf_dir).withColumn("merged_into", F.lit(None).cast("string")))
    dictionary = nodes.select(F.col("canonical").alias("surface"), F.col("id").alias("node_id"), "category", "layer", "polarity").union(nodes.where("tier = 'detail'").select("polarity", "id", "category", "layer", "polarity"))
    vocabulary = part.select(F.col("p_name").alias("surface"), F.lit("Property").alias("category")).union(part.select("p_type", F.lit("Unit"))).distinct()
    hinted = part.where("piece % 11 = 0").select("doc", "piece")
    entities, relations = T.candidates(chunks, vocabulary, [("has_property", r"^the (\S+) shows (.+)$"), ("has_property", r"^(.+) near +(\S+)$")], hinted)
    hints = part.where("piece % 11 = 0").select("doc", "piece", F.struct(F.lit(0).alias("rank"), F.col("p_type").alias("s")).alias("n"), F.col("p_type").alias("surface"), F.lit("Unit").alias("category"))
    attach = part.where("piece % 5 < 3").select("doc", "piece", F.col("p_name").alias("surface"), F.when(F.col("piece") % 5 == 0, F.col("p_type")).when(F.col("piece") % 5 == 1, "Nowhere").otherwise("NATION_3").alias("attach_to"))
    pairs, patterns = spark.createDataFrame([("Unit", "Property", "has_property")], "src_cat string, dst_cat string, rel string"), spark.createDataFrame(W.PATTERNS, "src_cat string, rel string, dst_cat string, symmetric boolean")
    layer = R.Layer("process", {"Process": "process", "Unit": "process", "Property": "process"})
    return T.build(checkpoint(chunks), checkpoint(entities.union(hints)), relations, attach, dictionary, nodes, closure(nodes), pairs, patterns, layer)


def build_prose_document(spark, sf_dir):
    """All outputs in one: (what, a, b, c, n)."""
    out = _prose(spark, sf_dir)
    name = out["nodes"].select(F.col("id").alias("node_id"), F.col("canonical").alias("name"))
    named = lambda df, c: df.withColumnRenamed(c, "node_id").join(name, "node_id", "left").withColumn(c, F.coalesce("name", "node_id")).drop("node_id", "name")
    none = F.lit(None).cast("string")
    parts = [
        out["nodes"].select(F.lit("node").alias("what"), F.col("canonical").alias("a"), F.col("polarity").alias("b"), F.col("category").alias("c")),
        named(out["describes"].withColumnRenamed("node_id", "node"), "node").select(F.lit("describes"), "chunk_id", "node", none),
        named(named(out["edges"], "src"), "dst").select(F.lit("edge"), F.concat_ws("|", "src", "rel", "dst"), F.array_join(F.array_sort("docs"), ","), none),
        out["rejected"].select(F.lit("rejected"), "verdict", _s("n"), none),
        out["queue"].withColumn("key", F.when(F.col("kind").isin("orphan_anchor", "orphan_attach", "coord_mismatch"), F.col("key"))).select(F.lit("queue"), "kind", "doc", "key"),
        out["defects"].select(F.lit("defect"), "what", _s("piece"), "surface"),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.union(part)
    return rows.groupBy("what", "a", "b", "c").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (build_document, uncertain_matches, build_prose_document)}

#: A supplier's unit in closed form: with the axis value it is the known supplier that it names or whose spare it is; without, a
#: supplier and its spare (the next row) are one node, named by the row of the earlier document.
_R = SQL + """, rec AS (SELECT s_suppkey AS k, 'D' || s_suppkey % 5 AS doc, s_nationkey AS nk, s_suppkey % 4 < 2 AS ax, s_suppkey % 10 <> 9 AS ok, 'Supplier#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS own, 'Supplier#' || lpad(CAST(s_suppkey - 1 AS VARCHAR), 9, '0') AS prev,
  s_suppkey < (SELECT max(s_suppkey) FROM supplier) AS more, (SELECT n_regionkey FROM nation WHERE n_nationkey = s_nationkey) AS region FROM supplier),
said AS (SELECT *, CASE WHEN ax THEN 'supplier ' ELSE '' END || CASE k % 3 WHEN 0 THEN own WHEN 1 THEN prev || ' spare' ELSE 'Odd ' || k % 7 END AS canon, CASE WHEN ax THEN 'supplier' ELSE 'none' END AS pol,
  CASE WHEN ok THEN 'NATION_' || nk || CASE WHEN ax THEN '::supplier' ELSE '' END || '::gauge ' ELSE 'loose ' END || k % 2 AS kcanon, CASE WHEN ok AND ax THEN 'supplier' ELSE 'unbound' END AS kpol, CASE WHEN ok THEN 'N' || nk || CASE WHEN ax THEN ':supplier' ELSE '' END END AS ref, CASE WHEN (k + 1) % 30 < 25 THEN 'N' || (k + 1) % 30 END AS ref2 FROM rec),
made AS (SELECT *, CASE WHEN ax AND k % 6 = 0 THEN 'S' || k WHEN ax AND k % 3 = 1 AND (k - 1) % 6 = 0 THEN 'S' || (k - 1) WHEN NOT ax AND k % 3 = 0 AND k % 4 = 2 AND more AND k % 5 = 4 THEN own || ' spare/none' WHEN NOT ax AND k % 3 = 1 AND k % 4 = 3 AND (k - 1) % 5 <> 4 THEN prev || '/none' ELSE canon || '/' || pol END AS unit, kcanon || '/' || kpol AS kind FROM said),
new AS (SELECT unit AS node, min(doc) AS doc, 'Unit' AS category FROM made WHERE unit LIKE '%/%' GROUP BY 1 UNION ALL SELECT kind, min(doc), 'Property' FROM made GROUP BY 1),
edge AS (SELECT unit AS src, 'part_of' AS rel, ref AS dst, doc FROM made UNION ALL SELECT unit, 'has_property', kind, doc FROM made UNION ALL SELECT ref2, 'precedes', ref, doc FROM made),
outs AS (SELECT 'resolved' AS what, 'unit' AS a, CAST(k AS VARCHAR) AS b, unit AS c FROM made UNION ALL SELECT 'resolved', 'kind', CAST(k AS VARCHAR), kind FROM made UNION ALL SELECT 'resolved', 'ref2', CAST(k AS VARCHAR), ref2 FROM made WHERE ref2 IS NOT NULL
  UNION ALL SELECT 'node', split_part(node, '/', 1), split_part(node, '/', 2), category FROM new
  UNION ALL SELECT 'value', unit, 'extent=' || k % 5, k % 2 || '@L' || k FROM made
  UNION ALL SELECT 'describes', 'memo-L' || k, kind, NULL FROM made
  UNION ALL SELECT 'edge', src || '|' || rel || '|' || dst, string_agg(doc, ',' ORDER BY doc), NULL FROM (SELECT DISTINCT * FROM edge WHERE src IS NOT NULL AND dst IS NOT NULL) GROUP BY src, rel, dst
  UNION ALL SELECT 'rejected', 'unresolved_endpoint', CAST(count(*) AS VARCHAR), NULL FROM edge WHERE src IS NULL OR dst IS NULL HAVING count(*) > 0 UNION ALL SELECT 'rejected', 'undeclared_relation', CAST(count(*) AS VARCHAR), NULL FROM made
  UNION ALL SELECT 'queue', 'auto_node', doc, node FROM new UNION ALL SELECT DISTINCT 'queue', 'orphan_anchor', doc, 'customer' FROM made WHERE NOT ok UNION ALL SELECT DISTINCT 'queue', 'orphan_anchor', doc, 'NATION_' || (k + 1) % 30 FROM made WHERE ref2 IS NULL
  UNION ALL SELECT DISTINCT 'queue', 'invalid_category', doc, 'Ghost:boo' FROM made WHERE k % 9 = 0 UNION ALL SELECT 'queue', 'coord_mismatch', doc, ref || '@' || k FROM made WHERE ok AND k % 4 = 3 AND region <> 2
  UNION ALL SELECT DISTINCT 'defect', doc, 'junk', 'remark' FROM made)
"""
_P = SQL + """, part_ AS (SELECT 'D' || p_partkey % 7 AS doc, p_partkey AS k, p_name, p_type, CASE p_partkey % 4 WHEN 0 THEN 'the ' || p_type || ' shows ' || p_name WHEN 1 THEN p_name || ' near ' || p_type WHEN 2 THEN 'the ' || p_type || ' shows nothing' ELSE p_name END AS text FROM part),
vocab AS (SELECT DISTINCT p_name AS s, 'P:' || p_name AS node, 'Property' AS category FROM part UNION SELECT DISTINCT p_type, p_type, 'Unit' FROM part),
ent AS (SELECT DISTINCT doc, k, s, node FROM part_ JOIN vocab ON contains(text, s) WHERE k % 11 <> 0 UNION SELECT doc, k, p_type, p_type FROM part_ WHERE k % 11 = 0),
firsts AS (SELECT s, min((doc, k)) AS seq FROM ent GROUP BY 1),
tie AS (SELECT doc, k, p_name, p_type, CASE k % 5 WHEN 0 THEN p_type WHEN 1 THEN 'Nowhere' ELSE 'NATION_3' END AS dest, EXISTS (SELECT 1 FROM ent e WHERE e.doc = p.doc AND e.k <= p.k AND e.s = p.p_name) AS child, k % 5 = 2 OR (k % 5 = 0 AND (EXISTS (SELECT 1 FROM ent e WHERE e.doc = p.doc AND e.k <= p.k AND e.s = p.p_type) OR EXISTS (SELECT 1 FROM firsts f WHERE f.s = p.p_type AND f.seq <= (p.doc, p.k)))) AS target FROM part_ p WHERE k % 5 < 3),
rel AS (SELECT doc, k, p_name, p_type, k % 4 AS kind FROM part_ WHERE k % 4 < 3 AND k % 11 <> 0),
done AS (SELECT p_type AS src, p_name AS dst, doc FROM rel WHERE kind = 0 UNION SELECT p_type, p_name, doc FROM tie WHERE child AND target AND k % 5 = 0),
outs AS (SELECT DISTINCT 'node' AS what, s AS a, 'unbound' AS b, 'Unit' AS c FROM ent WHERE node NOT LIKE 'P:%' UNION ALL SELECT DISTINCT 'describes', 'K' || k, node, NULL FROM ent
  UNION ALL SELECT 'edge', src || '|has_property|P:' || dst, string_agg(doc, ',' ORDER BY doc), NULL FROM done GROUP BY src, dst
  UNION ALL SELECT DISTINCT 'queue', 'orphan_anchor', doc, 'customer' FROM part_ WHERE k % 3 = 1 UNION ALL SELECT 'queue', 'coord_mismatch', doc, 'N1@' || k FROM part_ WHERE k % 3 = 0 AND NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = 1 AND n_regionkey = 1)
  UNION ALL SELECT 'queue', 'auto_node', seq[1], NULL FROM firsts JOIN vocab USING (s) WHERE category = 'Unit' UNION ALL SELECT DISTINCT 'queue', 'orphan_attach', doc, dest FROM tie WHERE child AND NOT target
  UNION ALL SELECT 'queue', 'direction_conflict', doc, NULL FROM (SELECT DISTINCT doc, p_name, p_type FROM rel WHERE kind = 1)
  UNION ALL SELECT 'defect', 'relation', CAST(k AS VARCHAR), p_type || '|has_property|nothing' FROM rel WHERE kind = 2 UNION ALL SELECT 'defect', 'attach', CAST(k AS VARCHAR), p_name || '|' || dest FROM tie WHERE NOT child)
"""
ORACLE_SQL = {
    "build_prose_document": _P + "SELECT what, a, b, c, count(*) AS n FROM outs GROUP BY 1, 2, 3, 4",
    "build_document": _R + "SELECT what, a, b, c, count(*) AS n FROM outs GROUP BY 1, 2, 3, 4",
    "uncertain_matches": _R + """, apart AS (SELECT canon AS name, pol, min(doc) AS doc, bool_or((ax AND (k % 6 = 0 OR (k % 3 = 1 AND (k - 1) % 6 = 0))) OR (NOT ax AND k % 3 = 0 AND k % 4 = 2 AND more AND k % 5 = 4) OR (NOT ax AND k % 3 = 1 AND k % 4 = 3 AND (k - 1) % 5 <> 4)) AS like_ FROM made GROUP BY 1, 2 UNION ALL SELECT kcanon, kpol, min(doc), false FROM made GROUP BY 1, 2)
 SELECT CASE WHEN like_ THEN 'uncertain_match' ELSE 'auto_node' END AS kind, count(*) AS n, min(doc) AS least FROM apart GROUP BY 1""",
}
