"""Queries on the skeleton, resolution, gate and graph of the world."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import resolve as R
from ..operators import skeleton as S
from ..operators.terms import contained
from . import world as W
from .world import SQL, read


def skeleton_nodes(spark, sf_dir):
    return W.nodes(spark, sf_dir).where("status = 'seed'").select("id", "canonical", "tier", "polarity", "parent")


def skeleton_part_of(spark, sf_dir):
    return W.part_of(spark, sf_dir)


def skeleton_precedes(spark, sf_dir):
    return W.precedes(spark, sf_dir)


def skeleton_mirrors(spark, sf_dir):
    own = W.nodes(spark, sf_dir).where("tier = 'detail'")
    return G.mirrors(own, "parent", "tier", "polarity", W.AXIS)


def skeleton_aliases_unique(spark, sf_dir):
    """Last segments of names that one seed only has."""
    own = W.nodes(spark, sf_dir).where("status = 'seed'").select("id", F.element_at(F.split("canonical", "::"), -1).alias("alias"))
    return own.groupBy("alias").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1").select("alias", "id")


def skeleton_closed_list(spark, sf_dir):
    own = W.nodes(spark, sf_dir).where("status = 'seed'")
    return own.join(own.select(F.col("id").alias("parent"), F.col("canonical").alias("parent_name")), "parent", "left").select("id", "canonical", "tier", "parent_name")


def skeleton_stale(spark, sf_dir):
    """Seeds of nations that no customer lives in."""
    live = read(spark, sf_dir, "customer").where("c_nationkey % 3 <> 0").select(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("id")).distinct()
    return W.nodes(spark, sf_dir).where("tier = 'sub'").join(live, "id", "left_anti").select("id", "canonical")


def flow_lines(spark, sf_dir):
    own = W.nodes(spark, sf_dir).where("tier = 'sub'").select("canonical", "parent", F.lit(None).cast("string").alias("axis"), F.substring("id", 2, 9).cast("int").alias("place"), F.lit(True).alias("ordered"))
    return S.flow_lines(own)


def ancestor_closure(spark, sf_dir):
    return R.closure(W.nodes(spark, sf_dir)).select("node", "ancestor", F.col("depth").cast("int").alias("depth"))


def main_ancestor(spark, sf_dir):
    own = W.nodes(spark, sf_dir)
    return R.closure(own).join(own.where("tier = 'main'").select(F.col("id").alias("ancestor"), F.col("canonical").alias("process_group")), "ancestor").select("node", "process_group")


def _pieces(spark, sf_dir):
    """Supplier rows with coordinates that are partly off: unknown nations, an ambiguous word, other regions and axis values."""
    k = F.col("s_suppkey")
    ref = F.when(k % 10 == 9, "customer").otherwise(F.concat(F.when(k % 11 == 0, " NATION_").otherwise("NATION_"), (F.col("s_nationkey") + F.when(k % 7 == 0, 20).otherwise(0)).cast("string"), F.when(k % 13 == 0, "\t").otherwise("")))
    axis = F.when(k % 4 == 0, "customer").when(k % 4 == 1, "supplier").when(k % 4 == 2, "other")
    return read(spark, sf_dir, "supplier").select(k.alias("piece"), ref.alias("ref"), axis.alias("axis"), F.concat(F.lit("R"), (k % 5).cast("string")).alias("grp"), F.col("s_name").alias("surface"))


def anchor_resolve(spark, sf_dir):
    return R.anchors(_pieces(spark, sf_dir), W.dictionary(spark, sf_dir), "piece", "ref", "Process")


def orphan_anchor(spark, sf_dir):
    return anchor_resolve(spark, sf_dir).where("outcome = 'orphan_anchor'").groupBy("surface").agg(F.count("*").alias("pieces"))


def descend_instance(spark, sf_dir):
    found = anchor_resolve(spark, sf_dir).where("node_id is not null").select("piece", "node_id").join(_pieces(spark, sf_dir).select("piece", "axis"), "piece")
    return R.descend(found, W.nodes(spark, sf_dir), "axis").select("piece", "node_id", "axis", "target")


def coord_mismatch(spark, sf_dir):
    found = anchor_resolve(spark, sf_dir).select("piece", "node_id").join(_pieces(spark, sf_dir).select("piece", "grp"), "piece")
    return R.off_group(found, R.closure(W.nodes(spark, sf_dir)), "node_id", "grp").select("piece", "node_id", "grp")


def axis_mismatch(spark, sf_dir):
    """Suppliers' rows at the supplier instance of their nation, with an axis value of their own."""
    home = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("piece"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string"), F.lit(":supplier")).alias("node"))
    rows = _pieces(spark, sf_dir).where("axis in ('customer', 'supplier')").join(home, "piece")
    return G.axis_mismatch(rows, W.nodes(spark, sf_dir), "piece", "node", "axis").select("piece", "bound", "axis")


def bind_names(spark, sf_dir):
    """Axis binding, polarity and scope of a name in one row."""
    rows = _pieces(spark, sf_dir)
    known = F.when(F.col("axis").isin(W.AXIS), F.col("axis"))
    anchor = F.when(F.col("piece") % 3 == 0, "supplier")
    return rows.select("piece", R.bind_axis(F.col("surface"), known, F.lit(True)).alias("bound"), R.polarity(anchor, known, F.col("piece") % 2 == 0).alias("polarity"), R.scope(F.when(F.col("piece") % 5 > 0, F.col("ref")), F.col("surface")).alias("scoped"))


def _found(spark, sf_dir):
    name = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("old "), "p_name")).otherwise(F.element_at(F.split("p_name", " "), 2))
    return read(spark, sf_dir, "part").select("p_partkey", name.alias("surface"))


def entity_match(spark, sf_dir):
    known = W.nodes(spark, sf_dir).where("category = 'Property'").select(F.col("id").alias("node_id"), "canonical")
    return R.entity_matches(_found(spark, sf_dir), known, "p_partkey")


def entity_exact_match(spark, sf_dir):
    known = W.dictionary(spark, sf_dir).where("category = 'Property'").select("surface", "node_id")
    return _found(spark, sf_dir).join(known, "surface").select("p_partkey", "node_id")


def _values(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("node"), F.col("l_returnflag").alias("context"), F.col("l_quantity").cast("bigint").alias("value"), "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")


_ORDER = ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"]


def attr_groups(spark, sf_dir):
    return R.attributes(_values(spark, sf_dir), ["node", "context"], "value", _ORDER)


def spec_conflict(spark, sf_dir):
    return R.conflicts(_values(spark, sf_dir), ["node", "context"], "value", _ORDER)


def unknown_missing_fields(spark, sf_dir):
    rows = read(spark, sf_dir, "events").withColumn("f", F.from_json("props", "map<string,string>"))
    rows = rows.withColumn("f", F.when(F.col("event_id") % 3 == 0, F.map_concat("f", F.create_map(F.lit("extra"), F.lit("1")))).otherwise(F.col("f")))
    return R.field_defects(rows, "event_id", "f", ["k", "src"], ["note"])


def context_override(spark, sf_dir):
    outer = F.create_map(F.lit("model"), F.col("event_type"), F.lit("site"), F.lit("a"))
    inner = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("model"), F.lit("own")))
    return read(spark, sf_dir, "events").select("event_id", R.override(outer, inner).alias("c")).select("event_id", F.col("c")["model"].alias("model"), F.col("c")["site"].alias("site"))


def edge_upsert(spark, sf_dir):
    new = W.occurs_in(spark, sf_dir)
    return G.upsert(new.where("doc % 2 = 0"), new.where("doc % 2 = 1"), new.where("dst = 'N7'"))


def edge_tombstone_skip(spark, sf_dir):
    new = W.occurs_in(spark, sf_dir)
    return G.upsert(new.limit(0), new, new.where("dst like 'N1%'")).select(*G.EDGE)


def gate_verdicts(spark, sf_dir):
    cats = W.nodes(spark, sf_dir).select("id", "category")
    rows = W.edges(spark, sf_dir).join(cats.select(F.col("id").alias("src"), F.col("category").alias("a")), "src").join(cats.select(F.col("id").alias("dst"), F.col("category").alias("b")), "dst")
    turn = F.length("src") % 2 == 0
    rows = rows.select("src", "dst", F.when(turn, F.col("b")).otherwise(F.col("a")).alias("src_cat"), F.when(F.col("src") == "S3", "owns").otherwise(F.col("rel")).alias("rel"), F.when(F.col("dst") == "N4", F.lit(None)).when(turn, F.col("a")).otherwise(F.col("b")).alias("dst_cat"), F.when(F.col("rel") == "precedes", "extract").otherwise("schema").alias("path"))
    patterns = spark.createDataFrame(W.PATTERNS, "src_cat string, rel string, dst_cat string, symmetric boolean")
    return G.gate(rows, patterns).select("src", "dst", "rel", "verdict")


def gate_reject_counts(spark, sf_dir):
    return gate_verdicts(spark, sf_dir).where("verdict <> 'commit'").groupBy("verdict").agg(F.count("*").alias("n"))


def _members(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("scope"), F.col("c_mktsegment").alias("name"), F.lit("customer").alias("axis")).distinct()
    seg = F.element_at(F.array(*map(F.lit, ["BUILDING", "MACHINERY", "HOUSEHOLD"])), (F.col("s_suppkey") % 3 + 1).cast("int"))
    return c.union(read(spark, sf_dir, "supplier").select("s_nationkey", seg, F.lit("supplier")).distinct())


def mirror_pairs(spark, sf_dir):
    return G.mirrors(_members(spark, sf_dir), "scope", "name", "axis", W.AXIS).where("outcome = 'mirror'").select("scope", "name")


def mirror_asymmetry(spark, sf_dir):
    return G.mirrors(_members(spark, sf_dir), "scope", "name", "axis", W.AXIS).where("outcome <> 'mirror'").select("scope", "name", "seen")


def withdraw_doc(spark, sf_dir):
    evidence = W.occurs_in(spark, sf_dir)
    return G.withdraw(evidence, evidence.where("doc % 10 = 0")).groupBy(*G.EDGE).agg(F.count("*").alias("evidence"))


def evidence_lost(spark, sf_dir):
    evidence = W.has_property(spark, sf_dir)
    left = G.withdraw(evidence, evidence.where("doc % 4 <> 0"))
    return G.without_evidence(evidence.select(*G.EDGE).distinct(), left, G.EDGE)


def reingest_idempotent(spark, sf_dir):
    new = W.occurs_in(spark, sf_dir)
    return G.upsert(new, new, new.where("false"))


def describes_links(spark, sf_dir):
    return W.chunks(spark, sf_dir).groupBy("node").agg(F.count("*").alias("chunks"))


def extract_vocab_mentions(spark, sf_dir):
    vocab = W.nodes(spark, sf_dir).where("category = 'Property'").select(F.col("canonical").alias("term"))
    texts = read(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_brand", "p_name", "p_type").alias("text"))
    return contained(texts, "p_partkey", "text", vocab, "term")


def extract_relations(spark, sf_dir):
    """The first pattern that matches gives one relation: (line, src, rel, dst)."""
    line = F.when(F.col("o_orderkey") % 3 == 0, F.concat("o_orderpriority", F.lit(" affects order "), F.col("o_custkey").cast("string"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("due to "), "o_orderstatus", F.lit(", "), "o_orderpriority", F.lit(" occurs"))).otherwise("nothing")
    rows = read(spark, sf_dir, "orders").select("o_orderkey", line.alias("t"))
    a, b = r"^(\S+) affects order (\d+)$", r"^due to (\S+), (\S+) occurs$"
    hit = F.when(F.col("t").rlike(a), F.struct(F.regexp_extract("t", a, 1).alias("src"), F.lit("affects").alias("rel"), F.regexp_extract("t", a, 2).alias("dst"))).when(F.col("t").rlike(b), F.struct(F.regexp_extract("t", b, 1).alias("src"), F.lit("causes").alias("rel"), F.regexp_extract("t", b, 2).alias("dst")))
    return rows.select("o_orderkey", hit.alias("h")).where("h is not null").select("o_orderkey", "h.src", "h.rel", "h.dst")


QUERIES = {f.__name__: f for f in (skeleton_nodes, skeleton_part_of, skeleton_precedes, skeleton_mirrors, skeleton_aliases_unique, skeleton_closed_list, skeleton_stale, flow_lines, ancestor_closure, main_ancestor, anchor_resolve, orphan_anchor, descend_instance, coord_mismatch, axis_mismatch, bind_names, entity_match, entity_exact_match, attr_groups, spec_conflict, unknown_missing_fields, context_override, edge_upsert, edge_tombstone_skip, gate_verdicts, gate_reject_counts, mirror_pairs, mirror_asymmetry, withdraw_doc, evidence_lost, reingest_idempotent, describes_links, extract_vocab_mentions, extract_relations)}

_PIECES = "SELECT s_suppkey AS piece, CASE WHEN s_suppkey % 10 = 9 THEN 'customer' ELSE CASE WHEN s_suppkey % 11 = 0 THEN ' ' ELSE '' END || 'NATION_' || (s_nationkey + CASE WHEN s_suppkey % 7 = 0 THEN 20 ELSE 0 END) || CASE WHEN s_suppkey % 13 = 0 THEN chr(9) ELSE '' END END AS ref, CASE s_suppkey % 4 WHEN 0 THEN 'customer' WHEN 1 THEN 'supplier' WHEN 2 THEN 'other' END AS axis, 'R' || s_suppkey % 5 AS grp, s_name AS surface FROM supplier"
_ANCHOR = f"SELECT piece, ref AS surface, count(DISTINCT node_id) AS hits, CASE WHEN count(DISTINCT node_id) = 1 THEN min(node_id) END AS node_id, CASE WHEN count(DISTINCT node_id) = 1 THEN 'resolved' ELSE 'orphan_anchor' END AS outcome FROM ({_PIECES}) LEFT JOIN dictionary d ON d.surface = trim(ref, ' ' || chr(9)) AND category = 'Process' GROUP BY piece, ref"
_UP = "up(node, ancestor, depth) AS (SELECT id, id, 0 FROM nodes UNION ALL SELECT node, n.parent, depth + 1 FROM up JOIN nodes n ON n.id = up.ancestor WHERE n.parent IS NOT NULL)"
_FOUND = "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN 'old ' || p_name ELSE split_part(p_name, ' ', 2) END AS surface FROM part"
_VALUES = "SELECT l_partkey AS node, l_returnflag AS context, CAST(l_quantity AS BIGINT) AS value, row_number() OVER (PARTITION BY l_partkey, l_returnflag ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity) AS n FROM lineitem"
_GATE = """, ends AS (SELECT e.src, e.dst, e.rel, a.category AS a, b.category AS b, length(e.src) % 2 = 0 AS turn FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst),
rows_ AS (SELECT src, dst, CASE WHEN turn THEN b ELSE a END AS sc, CASE WHEN src = 'S3' THEN 'owns' ELSE rel END AS rel, CASE WHEN dst = 'N4' THEN NULL WHEN turn THEN a ELSE b END AS dc, CASE WHEN rel = 'precedes' THEN 'extract' ELSE 'schema' END AS path FROM ends),
patterns(sc, rel, dc, sym) AS (VALUES ('Process', 'part_of', 'Process', false), ('Unit', 'part_of', 'Process', false), ('Process', 'precedes', 'Process', false), ('Process', 'mirrors', 'Process', true), ('Unit', 'has_property', 'Property', false), ('Failure', 'occurs_in', 'Process', false)),
judged AS (SELECT src, dst, r.rel, CASE WHEN r.sc IS NULL OR r.dc IS NULL THEN 'unresolved_endpoint' WHEN r.rel NOT IN (SELECT rel FROM patterns) THEN 'undeclared_relation'
 WHEN f.sym IS NOT NULL THEN CASE WHEN path = 'extract' AND r.sc = r.dc AND NOT f.sym THEN 'direction_unverifiable' ELSE 'commit' END WHEN b.sym IS NOT NULL THEN 'direction_conflict' ELSE 'invalid_pattern' END AS verdict
 FROM rows_ r LEFT JOIN patterns f ON f.sc = r.sc AND f.rel = r.rel AND f.dc = r.dc LEFT JOIN patterns b ON b.sc = r.dc AND b.rel = r.rel AND b.dc = r.sc AND NOT b.sym)"""
_MEMBERS = "SELECT DISTINCT c_nationkey AS scope, c_mktsegment AS name, 'customer' AS axis FROM customer UNION SELECT DISTINCT s_nationkey, ['BUILDING', 'MACHINERY', 'HOUSEHOLD'][s_suppkey % 3 + 1], 'supplier' FROM supplier"
_MIRROR = f"SELECT scope, name, array_to_string(list_sort(list(DISTINCT axis)), ',') AS seen, count(DISTINCT axis) AS n FROM ({_MEMBERS}) GROUP BY 1, 2"

ORACLE_SQL = {
    "skeleton_nodes": SQL + "SELECT id, canonical, tier, polarity, parent FROM nodes WHERE status = 'seed'",
    "skeleton_part_of": SQL + "SELECT * FROM part_of",
    "skeleton_precedes": SQL + "SELECT * FROM precedes",
    "skeleton_mirrors": SQL + "SELECT parent, tier, 'customer,supplier' AS seen, 'mirror' AS outcome FROM nodes WHERE tier = 'detail' GROUP BY ALL",
    "skeleton_aliases_unique": SQL + "SELECT alias, min(id) AS id FROM (SELECT id, string_split(canonical, '::')[-1] AS alias FROM nodes WHERE status = 'seed') GROUP BY 1 HAVING count(*) = 1",
    "skeleton_closed_list": SQL + "SELECT n.id, n.canonical, n.tier, p.canonical AS parent_name FROM nodes n LEFT JOIN nodes p ON p.id = n.parent WHERE n.status = 'seed'",
    "skeleton_stale": SQL + "SELECT id, canonical FROM nodes WHERE tier = 'sub' AND id NOT IN (SELECT 'N' || c_nationkey FROM customer WHERE c_nationkey % 3 <> 0)",
    "flow_lines": "SELECT 'R' || n_regionkey AS parent, string_agg(n_name, ' → ' ORDER BY n_nationkey) AS line FROM nation GROUP BY 1",
    "ancestor_closure": SQL + f", {_UP} SELECT node, ancestor, CAST(depth AS INTEGER) AS depth FROM up",
    "main_ancestor": SQL + f", {_UP} SELECT node, n.canonical AS process_group FROM up JOIN nodes n ON n.id = ancestor WHERE n.tier = 'main'",
    "anchor_resolve": SQL + _ANCHOR,
    "orphan_anchor": SQL + f"SELECT surface, count(*) AS pieces FROM ({_ANCHOR}) WHERE outcome = 'orphan_anchor' GROUP BY 1",
    "descend_instance": SQL + f"SELECT a.piece, a.node_id, p.axis, coalesce(i.id, a.node_id) AS target FROM ({_ANCHOR}) a JOIN ({_PIECES}) p USING (piece) LEFT JOIN nodes i ON i.parent = a.node_id AND i.tier = 'detail' AND i.polarity = p.axis WHERE a.node_id IS NOT NULL",
    "coord_mismatch": SQL + f", {_UP} SELECT a.piece, a.node_id, p.grp FROM ({_ANCHOR}) a JOIN ({_PIECES}) p USING (piece) WHERE a.node_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM up WHERE node = a.node_id AND ancestor = p.grp)",
    "axis_mismatch": f"SELECT piece, 'supplier' AS bound, axis FROM ({_PIECES}) WHERE axis = 'customer'",
    "bind_names": f"SELECT piece, CASE WHEN axis IN ('customer', 'supplier') THEN axis || ' ' || surface ELSE surface END AS bound, CASE WHEN piece % 3 = 0 THEN 'supplier' WHEN piece % 2 <> 0 THEN 'unbound' WHEN axis IN ('customer', 'supplier') THEN axis ELSE 'none' END AS polarity, CASE WHEN piece % 5 > 0 THEN ref || '::' || surface ELSE surface END AS scoped FROM ({_PIECES})",
    "entity_match": SQL + f"SELECT p_partkey, node_id, CAST(score AS DOUBLE) AS score FROM (SELECT p_partkey, id AS node_id, score, row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, id) AS r FROM (SELECT p_partkey, n.id, CASE WHEN replace(surface, ' ', '') = replace(canonical, ' ', '') THEN 1.0 ELSE 0.95 END AS score FROM ({_FOUND}) JOIN nodes n ON category = 'Property' AND (contains(replace(surface, ' ', ''), replace(canonical, ' ', '')) OR contains(replace(canonical, ' ', ''), replace(surface, ' ', ''))))) WHERE r = 1",
    "entity_exact_match": SQL + f"SELECT p_partkey, node_id FROM ({_FOUND}) JOIN dictionary d USING (surface) WHERE category = 'Property'",
    "attr_groups": f"SELECT node, context, max(CASE WHEN n = 1 THEN value END) AS kept, count(DISTINCT value) AS n_values FROM ({_VALUES}) GROUP BY 1, 2",
    "spec_conflict": f"WITH v AS ({_VALUES}) SELECT DISTINCT v.node, v.context, f.value AS kept, v.value AS other FROM v JOIN v f ON f.node = v.node AND f.context = v.context AND f.n = 1 WHERE v.value <> f.value",
    "unknown_missing_fields": "SELECT event_id, 'unknown_field' AS kind, 'extra' AS field FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id, 'missing_field', 'src' FROM events",
    "context_override": "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'own' ELSE event_type END AS model, 'a' AS site FROM events",
    "edge_upsert": SQL + "SELECT src, rel, dst, count(DISTINCT doc) AS evidence FROM occurs_in WHERE doc % 2 = 0 OR (dst <> 'N7') GROUP BY 1, 2, 3",
    "edge_tombstone_skip": SQL + "SELECT DISTINCT src, rel, dst FROM occurs_in WHERE NOT starts_with(dst, 'N1')",
    "gate_verdicts": SQL + _GATE + " SELECT src, dst, rel, verdict FROM judged",
    "gate_reject_counts": SQL + _GATE + " SELECT verdict, count(*) AS n FROM judged WHERE verdict <> 'commit' GROUP BY 1",
    "mirror_pairs": f"SELECT scope, name FROM ({_MIRROR}) WHERE n = 2",
    "mirror_asymmetry": f"SELECT scope, name, seen FROM ({_MIRROR}) WHERE n < 2",
    "withdraw_doc": SQL + "SELECT src, rel, dst, count(*) AS evidence FROM occurs_in WHERE doc % 10 <> 0 GROUP BY 1, 2, 3",
    "evidence_lost": SQL + "SELECT src, rel, dst FROM has_property GROUP BY 1, 2, 3 HAVING count(*) FILTER (WHERE doc % 4 = 0) = 0",
    "reingest_idempotent": SQL + "SELECT src, rel, dst, count(DISTINCT doc) AS evidence FROM occurs_in GROUP BY 1, 2, 3",
    "describes_links": SQL + "SELECT node, count(*) AS chunks FROM chunks GROUP BY 1",
    "extract_vocab_mentions": SQL + "SELECT p_partkey, canonical AS term FROM part JOIN nodes ON category = 'Property' AND contains(concat_ws(' ', p_brand, p_name, p_type), canonical)",
    "extract_relations": "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_orderpriority ELSE o_orderstatus END AS src, CASE o_orderkey % 3 WHEN 0 THEN 'affects' ELSE 'causes' END AS rel, CASE o_orderkey % 3 WHEN 0 THEN CAST(o_custkey AS VARCHAR) ELSE o_orderpriority END AS dst FROM orders WHERE (o_orderkey % 3 = 0 AND NOT contains(o_orderpriority, ' ')) OR (o_orderkey % 3 = 1 AND NOT contains(o_orderpriority, ' '))",
}
