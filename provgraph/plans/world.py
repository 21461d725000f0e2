"""The driver's tables as a world: regions, nations and their axis instances as skeleton, suppliers as units,
part names as properties, order priorities as failures of a second layer. Natural keys are the ids.

`SQL` has the same frames as common table expressions for the oracle.
"""

from __future__ import annotations

from pyspark.sql import functions as F

AXIS = ["customer", "supplier"]
RULES = [("part_of", "in", True), ("part_of", "out", False), ("has_property", "both", False)]
#: intent, marker, answer path, in the order in which intents are tried
INTENTS = [("flow", "flow of", "graph_fact"), ("order", "after", "graph_fact"), ("general", "weather", "general_knowledge"), ("value", "how many", "graph_fact"), ("reverse", "who has", "graph_fact"), ("structure", "part of", "graph_fact"), ("describe", "describe", "chunk")]
PATTERNS = [("Process", "part_of", "Process", False), ("Unit", "part_of", "Process", False), ("Process", "precedes", "Process", False), ("Process", "mirrors", "Process", True), ("Unit", "has_property", "Property", False), ("Failure", "occurs_in", "Process", False)]


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _key(letter, column, more=""):
    return F.concat(F.lit(letter), F.col(column).cast("string"), F.lit(more))


def nodes(spark, sf_dir):
    region, nation = read(spark, sf_dir, "region"), read(spark, sf_dir, "nation")
    none = F.lit(None).cast("string")

    def rows(df, id_, canonical, category, layer, tier, polarity, parent, status):
        return df.select(id_.alias("id"), canonical.alias("canonical"), *(F.lit(v).alias(n) for n, v in (("category", category), ("layer", layer), ("tier", tier), ("polarity", polarity))), parent.alias("parent"), F.lit(status).alias("status"))

    out = rows(region, _key("R", "r_regionkey"), F.col("r_name"), "Process", "process", "main", "none", none, "seed")
    out = out.union(rows(nation, _key("N", "n_nationkey"), F.col("n_name"), "Process", "process", "sub", "none", _key("R", "n_regionkey"), "seed"))
    for axis in AXIS:
        out = out.union(rows(nation, _key("N", "n_nationkey", f":{axis}"), F.concat(F.col("n_name"), F.lit(f"::{axis}")), "Process", "process", "detail", axis, _key("N", "n_nationkey"), "seed"))
    out = out.union(rows(read(spark, sf_dir, "supplier"), _key("S", "s_suppkey"), F.col("s_name"), "Unit", "process", "unit", "supplier", _key("N", "s_nationkey", ":supplier"), "auto"))
    out = out.union(rows(read(spark, sf_dir, "part").select("p_name").distinct(), _key("P:", "p_name"), F.col("p_name"), "Property", "process", "unit", "unbound", none, "auto"))
    return out.union(rows(read(spark, sf_dir, "orders").select("o_orderpriority").distinct(), _key("F:", "o_orderpriority"), F.col("o_orderpriority"), "Failure", "quality", "unit", "unbound", none, "auto"))


def part_of(spark, sf_dir):
    return nodes(spark, sf_dir).where("parent is not null").select(F.col("id").alias("src"), F.lit("part_of").alias("rel"), F.col("parent").alias("dst"))


def precedes(spark, sf_dir):
    from pyspark.sql import Window

    after = F.lead(_key("N", "n_nationkey")).over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    return read(spark, sf_dir, "nation").select(_key("N", "n_nationkey").alias("src"), F.lit("precedes").alias("rel"), after.alias("dst")).where("dst is not null")


def mirror_edges(spark, sf_dir):
    both = F.explode(F.array(F.lit(True), F.lit(False)))
    rows = read(spark, sf_dir, "nation").select("n_nationkey", both.alias("way"))
    return rows.select(F.when(F.col("way"), _key("N", "n_nationkey", ":customer")).otherwise(_key("N", "n_nationkey", ":supplier")).alias("src"), F.lit("mirrors").alias("rel"), F.when(F.col("way"), _key("N", "n_nationkey", ":supplier")).otherwise(_key("N", "n_nationkey", ":customer")).alias("dst"))


def _lines(spark, sf_dir):
    names = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").join(names, "l_partkey")


def has_property(spark, sf_dir):
    """(src, rel, dst, doc): order lines as evidence that a supplier has a property."""
    return _lines(spark, sf_dir).select(_key("S", "l_suppkey").alias("src"), F.lit("has_property").alias("rel"), _key("P:", "p_name").alias("dst"), F.col("l_orderkey").alias("doc")).distinct()


def occurs_in(spark, sf_dir):
    """(src, rel, dst, doc): orders as evidence that a failure occurs in a nation, an edge between layers."""
    home = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return read(spark, sf_dir, "orders").join(home, "o_custkey").select(_key("F:", "o_orderpriority").alias("src"), F.lit("occurs_in").alias("rel"), _key("N", "c_nationkey").alias("dst"), F.col("o_orderkey").alias("doc"))


def edges(spark, sf_dir):
    out = part_of(spark, sf_dir).union(precedes(spark, sf_dir)).union(mirror_edges(spark, sf_dir))
    return out.union(has_property(spark, sf_dir).select("src", "rel", "dst").distinct()).union(occurs_in(spark, sf_dir).select("src", "rel", "dst").distinct())


def dictionary(spark, sf_dir):
    """(surface, node_id, category, layer): canonical names, and the axis values as ambiguous aliases."""
    own = nodes(spark, sf_dir)
    alias = own.where("tier = 'detail'").select(F.col("polarity").alias("surface"), F.col("id").alias("node_id"), "category", "layer")
    return own.select(F.col("canonical").alias("surface"), F.col("id").alias("node_id"), "category", "layer").union(alias)


def questions(spark, sf_dir):
    """(qid, q): questions of every intent, some about nothing that is known."""
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    forms = [(0, "what comes after {}?"), (100, "describe {} please"), (200, "which units are part of {}::supplier?"), (300, "{} and the rest"), (400, "what comes after {}::customer?")]
    rows = None
    for base, form in forms:
        one = nation.select((F.col("n_nationkey") + base).cast("bigint").alias("qid"), F.replace(F.lit(form), F.lit("{}"), F.col("n_name")).alias("q"))
        rows = one if rows is None else rows.union(one)
    rows = rows.union(region.select((F.col("r_regionkey") + 500).cast("bigint"), F.concat(F.lit("show the flow of "), "r_name")))
    rows = rows.union(region.select((F.col("r_regionkey") + 600).cast("bigint"), F.concat(F.lit("how is the weather in "), "r_name")))
    rows = rows.union(region.select((F.col("r_regionkey") + 700).cast("bigint"), F.concat(F.lit("how many moons has planet "), F.col("r_regionkey").cast("string"))))
    names = read(spark, sf_dir, "part").select("p_name").distinct()
    return rows.union(names.select((1000 + F.conv(F.substring(F.md5("p_name"), 1, 7), 16, 10).cast("bigint")).alias("qid"), F.concat(F.lit("who has "), "p_name", F.lit(" now"))))


def chunks(spark, sf_dir):
    """(chunk_id, node): orders describe the nation they come from."""
    return occurs_in(spark, sf_dir).select(F.concat(F.lit("O"), F.lpad(F.col("doc").cast("string"), 10, "0")).alias("chunk_id"), F.col("dst").alias("node"))


SQL = """
WITH RECURSIVE nodes AS (
  SELECT 'R' || r_regionkey AS id, r_name AS canonical, 'Process' AS category, 'process' AS layer, 'main' AS tier, 'none' AS polarity, NULL AS parent, 'seed' AS status FROM region
  UNION ALL SELECT 'N' || n_nationkey, n_name, 'Process', 'process', 'sub', 'none', 'R' || n_regionkey, 'seed' FROM nation
  UNION ALL SELECT 'N' || n_nationkey || ':' || a, n_name || '::' || a, 'Process', 'process', 'detail', a, 'N' || n_nationkey, 'seed' FROM nation, (VALUES ('customer'), ('supplier')) t(a)
  UNION ALL SELECT 'S' || s_suppkey, s_name, 'Unit', 'process', 'unit', 'supplier', 'N' || s_nationkey || ':supplier', 'auto' FROM supplier
  UNION ALL SELECT DISTINCT 'P:' || p_name, p_name, 'Property', 'process', 'unit', 'unbound', NULL, 'auto' FROM part
  UNION ALL SELECT DISTINCT 'F:' || o_orderpriority, o_orderpriority, 'Failure', 'quality', 'unit', 'unbound', NULL, 'auto' FROM orders
), part_of AS (SELECT id AS src, 'part_of' AS rel, parent AS dst FROM nodes WHERE parent IS NOT NULL),
precedes AS (SELECT * FROM (SELECT 'N' || n_nationkey AS src, 'precedes' AS rel, 'N' || lead(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS dst FROM nation) WHERE dst IS NOT NULL),
mirror_edges AS (SELECT 'N' || n_nationkey || ':' || a AS src, 'mirrors' AS rel, 'N' || n_nationkey || ':' || b AS dst FROM nation, (VALUES ('customer', 'supplier'), ('supplier', 'customer')) t(a, b)),
has_property AS (SELECT DISTINCT 'S' || l_suppkey AS src, 'has_property' AS rel, 'P:' || p_name AS dst, l_orderkey AS doc FROM lineitem JOIN part ON l_partkey = p_partkey),
occurs_in AS (SELECT 'F:' || o_orderpriority AS src, 'occurs_in' AS rel, 'N' || c_nationkey AS dst, o_orderkey AS doc FROM orders JOIN customer ON o_custkey = c_custkey),
edges AS (SELECT * FROM part_of UNION ALL SELECT * FROM precedes UNION ALL SELECT * FROM mirror_edges UNION ALL SELECT DISTINCT src, rel, dst FROM has_property UNION ALL SELECT DISTINCT src, rel, dst FROM occurs_in),
dictionary AS (SELECT canonical AS surface, id AS node_id, category, layer FROM nodes UNION ALL SELECT polarity, id, category, layer FROM nodes WHERE tier = 'detail'),
questions AS (
  SELECT CAST(n_nationkey + b AS BIGINT) AS qid, replace(f, '{}', n_name) AS q FROM nation, (VALUES (0, 'what comes after {}?'), (100, 'describe {} please'), (200, 'which units are part of {}::supplier?'), (300, '{} and the rest'), (400, 'what comes after {}::customer?')) t(b, f)
  UNION ALL SELECT CAST(r_regionkey + b AS BIGINT), f || CASE WHEN b < 700 THEN r_name ELSE CAST(r_regionkey AS VARCHAR) END FROM region, (VALUES (500, 'show the flow of '), (600, 'how is the weather in '), (700, 'how many moons has planet ')) t(b, f)
  UNION ALL SELECT 1000 + CAST('0x' || substr(md5(p_name), 1, 7) AS BIGINT), 'who has ' || p_name || ' now' FROM (SELECT DISTINCT p_name FROM part)
), chunks AS (SELECT 'O' || lpad(CAST(doc AS VARCHAR), 10, '0') AS chunk_id, dst AS node FROM occurs_in),
matched AS (SELECT DISTINCT qid, surface FROM questions JOIN dictionary ON contains(q, surface)),
linked AS (SELECT DISTINCT m.qid, m.surface, d.node_id, d.layer FROM matched m JOIN dictionary d USING (surface)
  WHERE NOT EXISTS (SELECT 1 FROM matched o WHERE o.qid = m.qid AND o.surface <> m.surface AND contains(o.surface, m.surface))),
down AS (SELECT DISTINCT qid, node_id AS node, 0 AS level FROM linked UNION ALL SELECT d.qid, p.src, d.level + 1 FROM down d JOIN part_of p ON p.dst = d.node),
walk AS (SELECT qid, node, level FROM down UNION ALL SELECT qid, p.dst, 1 FROM linked l JOIN part_of p ON p.src = l.node_id
  UNION ALL SELECT qid, h.dst, level + 1 FROM down JOIN (SELECT DISTINCT src, dst FROM has_property) h ON h.src = node UNION ALL SELECT qid, h.src, level + 1 FROM down JOIN (SELECT DISTINCT src, dst FROM has_property) h ON h.dst = node),
expanded AS (SELECT qid, node, CAST(min(level) AS INTEGER) AS level FROM walk GROUP BY 1, 2),
intents AS (SELECT qid, coalesce(min_by(intent, ord), 'none') AS intent FROM questions LEFT JOIN (VALUES (0, 'flow', 'flow of'), (1, 'order', 'after'), (2, 'general', 'weather'), (3, 'value', 'how many'), (4, 'reverse', 'who has'), (5, 'structure', 'part of'), (6, 'describe', 'describe')) i(ord, intent, marker) ON contains(q, marker) GROUP BY qid),
collected AS (SELECT qid, chunk_id, min(least(level, 1)) AS tier FROM expanded JOIN chunks USING (node) GROUP BY 1, 2),
top_chunks AS (SELECT qid, chunk_id, CAST(tier + 1 AS INTEGER) AS tier, CAST(row_number() OVER (PARTITION BY qid ORDER BY tier, chunk_id) AS INTEGER) AS rank, count(*) OVER (PARTITION BY qid) AS found FROM collected)
"""
