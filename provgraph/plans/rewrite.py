"""Queries on the skeleton from a tree and on changes by people."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changes as C
from ..operators import skeleton as S
from . import world as W
from .world import SQL, read

AXIS = ["left", "right"]


def _tree_rows(spark, sf_dir):
    """Regions, their nations and the nations' shelves as a tree in the notation of operators/skeleton.py: even nations split by axis,
    some of one axis value only, some without a place in the order, one region without order, and rows that break the rules."""
    k, n = F.col("s_suppkey"), F.col("n_nationkey")
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    no, none = F.lit(False), F.lit(None).cast("string")
    region, nation, supplier = (read(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    rows = region.select(key("R", "r_regionkey").alias("node"), none.alias("parent"), F.col("r_regionkey").cast("long").alias("place"), F.col("r_name").alias("item"), no.alias("unordered"))
    rows = rows.union(region.where("r_regionkey = 2").select(key("F", "r_regionkey"), key("R", "r_regionkey"), F.lit(-1).cast("long"), F.lit("@noflow"), no))
    rows = rows.union(nation.select(key("N", "n_nationkey"), key("R", "n_regionkey"), n.cast("long"), F.concat("n_name", F.when(n % 2 == 0, "@split").otherwise("")), n % 7 == 3))
    rows = rows.union(nation.where(n % 4 == 1).select(key("V", "n_nationkey"), key("N", "n_nationkey"), F.lit(-1).cast("long"), F.lit("::left"), no))
    rows = rows.union(supplier.where(k % 3 == 0).select(key("S", "s_suppkey"), key("N", "s_nationkey"), k, F.concat(F.lit(" Shelf "), k.cast("string")), no))
    odd = F.when(k % 15 == 1, "Box@up").when(k % 15 == 4, "::far").when(k % 15 == 7, "left").when(k % 15 == 10, "Twin")
    rows = rows.union(supplier.where(odd.isNotNull()).select(key("S", "s_suppkey"), F.lit("N0"), k, odd, no))
    return rows.union(supplier.where(k % 15 == 1).select(key("B", "s_suppkey"), key("S", "s_suppkey"), k, F.lit("below"), no))


def _tree(spark, sf_dir):
    return S.tree_of(_tree_rows(spark, sf_dir), AXIS)[0]


def skeleton_tree(spark, sf_dir):
    return _tree(spark, sf_dir).select("canonical", "tier", "parent", "axis", "ordered")


def skeleton_tree_defects(spark, sf_dir):
    return S.tree_of(_tree_rows(spark, sf_dir), AXIS)[1]


def skeleton_order(spark, sf_dir):
    return S.precedes(_tree(spark, sf_dir))


def skeleton_mirror_edges(spark, sf_dir):
    return S.seed_mirrors(_tree(spark, sf_dir), AXIS)


def skeleton_flow(spark, sf_dir):
    return S.flow_lines(_tree(spark, sf_dir))


def skeleton_alias(spark, sf_dir):
    n = F.col("n_nationkey")
    extra = read(spark, sf_dir, "nation").select(F.when(n % 5 == 0, "odd").otherwise(F.concat(F.lit("land "), n.cast("string"))).alias("alias"), F.col("n_name").alias("canonical"))
    known, unclear = S.aliases(_tree(spark, sf_dir), extra)
    return known.union(unclear.select("alias", F.lit("?")))


def skeleton_flat(spark, sf_dir):
    return S.flat(read(spark, sf_dir, "nation"), "n_name").select("canonical", "tier", "parent")


def _known(spark, sf_dir):
    return read(spark, sf_dir, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("canonical"), F.lit("Process").alias("category"), F.lit("main").alias("tier"), F.when(F.col("n_nationkey") < 12, "seed").otherwise("auto").alias("status"))


def _planted(spark, sf_dir):
    names = read(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select("n_name").union(read(spark, sf_dir, "region").select("r_name"))
    return S.flat(names, "n_name")


def skeleton_plant(spark, sf_dir):
    """Planted twice, which is as once."""
    names = _planted(spark, sf_dir)
    return S.plant(S.plant(_known(spark, sf_dir), names, "Process"), names, "Process")


def skeleton_left(spark, sf_dir):
    return S.stale(_known(spark, sf_dir), _planted(spark, sf_dir)).select("id", "canonical")


def category_owner(spark, sf_dir):
    return S.category_owner(W.nodes(spark, sf_dir).select("category", "layer").union(read(spark, sf_dir, "region").select(F.lit("Property"), "r_name")))


def _nodes(spark, sf_dir):
    return W.nodes(spark, sf_dir).withColumn("merged_into", F.when(F.col("id") == "S3", "S1"))


def _values(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem")
    return line.select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("node"), F.lit("qty").alias("attr"), F.col("l_returnflag").alias("context"), F.col("l_quantity").cast("bigint").alias("value"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("seq"), F.col("l_orderkey").alias("doc"))


def _pairs(spark, sf_dir):
    """Suppliers merged into the one before; a nation into another, one into itself, and a chain of two."""
    k = F.col("s_suppkey")
    own = read(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.concat(F.lit("S"), k.cast("string")).alias("absorbed"), F.concat(F.lit("S"), (k - 1).cast("string")).alias("survivor"))
    return own.union(spark.createDataFrame([("N1", "N2"), ("S1", "S1"), ("S7", "S2"), ("S9", "Z")], "absorbed string, survivor string"))


def _merged(spark, sf_dir):
    edges = W.has_property(spark, sf_dir)
    return C.merge(_pairs(spark, sf_dir), _nodes(spark, sf_dir), W.dictionary(spark, sf_dir), _values(spark, sf_dir), edges)


def merge_refused(spark, sf_dir):
    return _merged(spark, sf_dir)["refused"]


def merge_nodes(spark, sf_dir):
    return _merged(spark, sf_dir)["nodes"].where("merged_into is not null").select("id", "status", "merged_into")


def merge_dictionary(spark, sf_dir):
    return _merged(spark, sf_dir)["dictionary"].where("category = 'Unit'").select("surface", "node_id")


def merge_values(spark, sf_dir):
    return _merged(spark, sf_dir)["values"].select("node", "context", "kept", "n_values")


def merge_edges_docs(spark, sf_dir):
    return _merged(spark, sf_dir)["edges"].groupBy("src", "rel").agg(F.count("*").alias("n"), F.countDistinct("dst").alias("properties"))


def _split(spark, sf_dir, whole):
    items = {"edge": W.has_property(spark, sf_dir).where("src = 'S2'").select(F.col("dst").alias("item")), "doc": W.has_property(spark, sf_dir).where("src = 'S2'").select(F.col("doc").alias("item"))}
    plan = items["edge"].distinct().select(F.lit("edge").alias("frame"), "item", F.when(F.length("item") % 2 == 0, "S2a").otherwise("S2b").alias("target"))
    docs = items["doc"].distinct().select(F.lit("doc").alias("frame"), F.col("item").cast("string").alias("item"), F.when(F.col("item") % 2 == 0, "S2a").otherwise("S2b").alias("target"))
    return C.split("S2", plan.union(docs) if whole else plan, _nodes(spark, sf_dir), items)


def split_nodes(spark, sf_dir):
    return _split(spark, sf_dir, True)["nodes"].where("id like 'S2%' and length(id) < 4").select("id", "status", "merged_into", "category")


def split_assigned(spark, sf_dir):
    return _split(spark, sf_dir, True)["assigned"].groupBy("frame", "target").agg(F.count("*").alias("n"))


def split_refused(spark, sf_dir):
    return _split(spark, sf_dir, False)["residual"].groupBy("frame").agg(F.count("*").alias("n"))


def _split_graph(spark, sf_dir):
    """Every third supplier split in two: edges by the length of what they lead to, evidence by its number; of every ninth one edge goes
    to both, and of every fifteenth one is left out."""
    k = F.col("s_suppkey")
    own = read(spark, sf_dir, "supplier").where(k % 3 == 0).select(k, F.concat(F.lit("S"), k.cast("string")).alias("node"))
    halves = F.explode(F.array(F.lit("a"), F.lit("b")))
    targets = own.select("node", halves.alias("h")).select("node", F.concat("node", "h").alias("target"), F.concat(F.lit("half "), "h", F.lit(" of "), "node").alias("canonical"), F.when(F.col("h") == "a", 1).otherwise(2).alias("ord"))
    edges = W.has_property(spark, sf_dir).withColumn("status", F.lit("auto"))
    mine = edges.join(own.withColumnRenamed("node", "src"), "src").select("s_suppkey", F.col("src").alias("node"), "rel", "dst", "doc")
    item, half = F.concat_ws("|", "node", "rel", "dst"), F.when(F.length("dst") % 2 == 0, "a").otherwise("b")
    by_edge = mine.select("s_suppkey", "node", "dst", item.alias("item"), F.concat("node", half).alias("target")).distinct()
    left_out, both = F.col("dst").contains("red"), F.col("dst").contains("blue")
    one = by_edge.where(~((k % 15 == 0) & left_out)).select("node", F.lit("edge").alias("frame"), "item", "target")
    two = by_edge.where((k % 9 == 0) & both).select("node", F.lit("edge"), "item", F.concat("node", F.when(F.endswith("target", F.lit("a")), "b").otherwise("a")))
    docs = mine.select("node", F.lit("evidence"), F.col("doc").cast("string"), F.concat("node", F.when(F.col("doc") % 2 == 0, "a").otherwise("b"))).distinct()
    surfaces = W.dictionary(spark, sf_dir)
    extra = own.select(F.concat(F.lit("alias of "), "node").alias("surface"), F.col("node").alias("node_id"), F.lit("Unit").alias("category"), F.lit("process").alias("layer"))
    alias = own.select("node", F.lit("alias"), F.concat(F.lit("alias of "), "node"), F.concat("node", F.lit("b")))
    plan = one.union(two).union(docs).union(alias)
    values = own.select("node", (k * 2).alias("v"))
    evidence = mine.select("node", "doc").distinct()
    return C.split_graph(plan, targets, _nodes(spark, sf_dir).withColumn("merged_into", F.lit(None).cast("string")), surfaces.union(extra), edges, values, evidence)


def split_edges(spark, sf_dir):
    return _split_graph(spark, sf_dir)["edges"].groupBy("src", "status").agg(F.count("*").alias("n"), F.countDistinct("dst").alias("ends"), F.sum("doc").alias("docs"))


def split_outputs(spark, sf_dir):
    """Nodes that came or went, what was left out, and where values, evidence and surfaces are now."""
    out = _split_graph(spark, sf_dir)
    rows = out["nodes"].where("category = 'Unit'").select(F.lit("node").alias("what"), F.col("id").alias("a"), F.col("status").alias("b"), F.col("merged_into").alias("c"))
    rows = rows.union(out["residual"].select(F.lit("residual"), "node", "frame", "item")).union(out["values"].select(F.lit("value"), "node", F.col("v").cast("string"), F.lit(None).cast("string")))
    rows = rows.union(out["evidence"].groupBy("node").agg(F.count("*").alias("n"), F.sum("doc").alias("s")).select(F.lit("evidence"), "node", F.col("n").cast("string"), F.col("s").cast("string")))
    return rows.union(out["dictionary"].where("category = 'Unit'").select(F.lit("surface"), "node_id", "surface", F.lit(None).cast("string")))


def live_nodes(spark, sf_dir):
    return C.live(_nodes(spark, sf_dir)).groupBy("category").agg(F.count("*").alias("n"))


def scope_children(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    return C.scope_children(nodes, nodes.where("tier = 'sub'"), ["Process"])


def rename_aliases(spark, sf_dir):
    nodes = W.nodes(spark, sf_dir).where("status = 'seed'")
    names = read(spark, sf_dir, "nation").where("n_nationkey % 4 = 0").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("id"), F.concat(F.lit("LAND_"), F.col("n_nationkey").cast("string")).alias("new"))
    return C.old_names(nodes, C.rename(nodes, names)[0])


def change_preview(spark, sf_dir):
    return C.preview(W.nodes(spark, sf_dir).where("tier in ('sub', 'detail')"), W.edges(spark, sf_dir), W.nodes(spark, sf_dir))


def delete_edges(spark, sf_dir):
    edges = W.edges(spark, sf_dir).withColumn("status", F.lit("auto"))
    return C.delete_edges(edges, edges.where("dst like '%3'")).groupBy("rel", "status").agg(F.count("*").alias("n"))


def change_log(spark, sf_dir):
    return C.log_rows(W.nodes(spark, sf_dir).where("tier = 'main'"), "obsolete", "someone", "old").drop("at")


QUERIES = {f.__name__: f for f in (skeleton_tree, skeleton_tree_defects, skeleton_order, skeleton_mirror_edges, skeleton_flow, skeleton_alias, skeleton_flat, skeleton_plant, skeleton_left, category_owner, merge_refused, merge_nodes, merge_dictionary, merge_values, merge_edges_docs, split_nodes, split_assigned, split_refused, split_edges, split_outputs, live_nodes, scope_children, rename_aliases, change_preview, delete_edges, change_log)}

_REFUSED = "SELECT * FROM (VALUES ('N1', 'N2', 'two_seeds'), ('S1', 'S1', 'itself'), ('S7', 'S2', 'chain'), ('S9', 'Z', 'missing'), ('S0', 'S-1', 'missing'), ('S4', 'S3', 'chain'), ('S8', 'S7', 'chain'), ('S2', 'S1', 'chain'), ('S10', 'S9', 'chain')) t(absorbed, survivor, reason) WHERE absorbed IN ('N1', 'S1', 'S7', 'S9') OR CAST(substr(absorbed, 2) AS INTEGER) <= (SELECT max(s_suppkey) FROM supplier)"
_TO = f", refused AS ({_REFUSED}), redirect AS (SELECT 'S' || s_suppkey AS id, 'S' || (s_suppkey - 1) AS target FROM supplier WHERE s_suppkey % 2 = 0 AND 'S' || s_suppkey NOT IN (SELECT absorbed FROM refused)) "
_TREE = """WITH shelf AS (SELECT n_name AS parent, s_suppkey AS k FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 3 = 0), twins AS (SELECT count(*) AS n FROM supplier WHERE s_suppkey % 15 = 10),
tree AS (SELECT r_name AS canonical, 'main' AS tier, NULL AS parent, NULL AS axis, CAST(r_regionkey AS BIGINT) AS place, true AS ordered FROM region
  UNION ALL SELECT n_name, 'sub', r_name, NULL, n_nationkey, n_regionkey <> 2 AND n_nationkey % 7 <> 3 FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT n_name || '::' || a, 'sub', n_name, a, n_nationkey, false FROM nation, (VALUES ('left'), ('right')) t(a) WHERE n_nationkey % 2 = 0
  UNION ALL SELECT n_name || '::left', 'detail', n_name, 'left', -1, false FROM nation WHERE n_nationkey % 4 = 1
  UNION ALL SELECT parent || '::Shelf ' || k, 'detail', parent, NULL, k, true FROM shelf UNION ALL SELECT 'NATION_0::Twin', 'detail', 'NATION_0', NULL, s_suppkey, true FROM supplier, twins WHERE s_suppkey % 15 = 10 AND n = 1),
short AS (SELECT *, string_split(canonical, '::')[-1] AS last FROM tree) """


_SPLIT = """, item AS (SELECT DISTINCT CAST(substr(src, 2) AS BIGINT) AS k, src, dst FROM has_property WHERE CAST(substr(src, 2) AS BIGINT) % 3 = 0),
residual AS (SELECT src, src || '|has_property|' || dst AS item FROM item WHERE k % 15 = 0 AND contains(dst, 'red')), done AS (SELECT 'S' || s_suppkey AS node, s_suppkey AS k FROM supplier WHERE s_suppkey % 3 = 0 AND 'S' || s_suppkey NOT IN (SELECT src FROM residual)),
halves AS (SELECT node, k, node || h AS target, h FROM done, (VALUES ('a'), ('b')) t(h)),
dealt AS (SELECT h.target AS src, dst, doc FROM has_property p JOIN halves h ON h.node = p.src WHERE (length(dst) % 2 = 0) = (h.h = 'a') OR (h.k % 9 = 0 AND contains(dst, 'blue'))) """
_V = "SELECT 'S' || l_suppkey AS node, l_returnflag AS context, CAST(l_quantity AS BIGINT) AS value, l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem"
ORACLE_SQL = {
    "skeleton_tree": _TREE + "SELECT canonical, tier, parent, axis, ordered FROM tree",
    "skeleton_tree_defects": _TREE + "SELECT 'S' || s_suppkey AS node, CASE s_suppkey % 15 WHEN 1 THEN 'marker' WHEN 4 THEN 'axis_value' WHEN 7 THEN 'no_name' ELSE 'same_name' END AS reason FROM supplier, twins WHERE s_suppkey % 15 IN (1, 4, 7) OR (s_suppkey % 15 = 10 AND n > 1)",
    "skeleton_order": _TREE + "SELECT * FROM (SELECT canonical AS src, 'precedes' AS rel, lead(canonical) OVER (PARTITION BY parent ORDER BY place) AS dst FROM tree WHERE ordered AND axis IS NULL) WHERE dst IS NOT NULL",
    "skeleton_mirror_edges": "SELECT n_name || '::' || a AS src, 'mirrors' AS rel, n_name || '::' || b AS dst FROM nation, (VALUES ('left', 'right'), ('right', 'left')) t(a, b) WHERE n_nationkey % 2 = 0",
    "skeleton_flow": _TREE + "SELECT parent, string_agg(last, ' → ' ORDER BY place) AS line FROM short WHERE ordered AND axis IS NULL GROUP BY parent",
    "skeleton_alias": _TREE + "SELECT last AS alias, min(canonical) AS canonical FROM short WHERE axis IS NULL GROUP BY last HAVING count(*) = 1 AND min(canonical) <> last UNION SELECT axis || ' ' || parent, canonical FROM tree WHERE axis IS NOT NULL UNION SELECT 'land ' || n_nationkey, n_name FROM nation WHERE n_nationkey % 5 <> 0 UNION SELECT 'odd', '?'",
    "skeleton_flat": "SELECT n_name AS canonical, 'main' AS tier, CAST(NULL AS VARCHAR) AS parent FROM nation",
    "skeleton_plant": "SELECT 'N' || n_nationkey AS id, n_name AS canonical, 'Process' AS category, 'main' AS tier, CASE WHEN n_nationkey % 2 = 0 OR n_nationkey < 12 THEN 'seed' ELSE 'auto' END AS status FROM nation UNION ALL SELECT 'seed:' || substr(sha256('Process' || chr(0) || r_name), 1, 16), r_name, 'Process', 'main', 'seed' FROM region",
    "skeleton_left": "SELECT 'N' || n_nationkey AS id, n_name AS canonical FROM nation WHERE n_nationkey < 12 AND n_nationkey % 2 = 1",
    "category_owner": SQL + "SELECT category, min(layer) AS owner FROM (SELECT category, layer FROM nodes UNION ALL SELECT 'Property', r_name FROM region) GROUP BY 1",
    "merge_refused": _REFUSED,
    "merge_nodes": SQL + _TO + "SELECT id, 'merged_into' AS status, target AS merged_into FROM redirect UNION ALL SELECT 'S3', 'auto', 'S1'",
    "merge_dictionary": SQL + _TO + "SELECT surface, coalesce(target, node_id) AS node_id FROM dictionary LEFT JOIN redirect ON id = node_id WHERE category = 'Unit'",
    "merge_values": SQL + _TO + f"SELECT node, context, arg_min(value, (l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS kept, count(DISTINCT value) AS n_values FROM (SELECT coalesce(target, node) AS node, v.* EXCLUDE (node) FROM ({_V}) v LEFT JOIN redirect ON id = node) GROUP BY 1, 2",
    "merge_edges_docs": SQL + _TO + "SELECT src, 'has_property' AS rel, count(*) AS n, count(DISTINCT dst) AS properties FROM (SELECT DISTINCT coalesce(target, src) AS src, dst, doc FROM has_property LEFT JOIN redirect ON id = src) GROUP BY 1",
    "split_nodes": "SELECT * FROM (VALUES ('S2', 'merged_into', 'S2a', 'Unit'), ('S2a', 'auto', NULL, 'Unit'), ('S2b', 'auto', NULL, 'Unit')) t(id, status, merged_into, category) UNION ALL SELECT 'S' || s_suppkey, 'auto', NULL, 'Unit' FROM supplier WHERE s_suppkey BETWEEN 20 AND 29",
    "split_assigned": SQL + "SELECT 'edge' AS frame, CASE WHEN length(dst) % 2 = 0 THEN 'S2a' ELSE 'S2b' END AS target, count(*) AS n FROM (SELECT DISTINCT dst FROM has_property WHERE src = 'S2') GROUP BY 2 UNION ALL SELECT 'doc', CASE WHEN doc % 2 = 0 THEN 'S2a' ELSE 'S2b' END, count(*) FROM (SELECT DISTINCT doc FROM has_property WHERE src = 'S2') GROUP BY 2",
    "split_refused": SQL + "SELECT 'doc' AS frame, count(DISTINCT doc) AS n FROM has_property WHERE src = 'S2'",
    "split_edges": SQL + _SPLIT + "SELECT src, CASE WHEN src IN (SELECT node FROM done) THEN 'deleted_by_user' ELSE 'auto' END AS status, count(*) AS n, count(DISTINCT dst) AS ends, CAST(sum(doc) AS BIGINT) AS docs FROM has_property GROUP BY 1 UNION ALL SELECT src, 'auto', count(*), count(DISTINCT dst), CAST(sum(doc) AS BIGINT) FROM dealt GROUP BY 1",
    "split_outputs": SQL + _SPLIT + """SELECT 'node' AS what, id AS a, CASE WHEN id IN (SELECT node FROM done) THEN 'merged_into' ELSE status END AS b, CASE WHEN id IN (SELECT node FROM done) THEN id || 'a' END AS c FROM nodes WHERE category = 'Unit' UNION ALL SELECT 'node', target, 'auto', NULL FROM halves
 UNION ALL SELECT 'residual', src, 'edge', item FROM residual UNION ALL SELECT 'value', coalesce(target, 'S' || s_suppkey), CAST(s_suppkey * 2 AS VARCHAR), NULL FROM supplier LEFT JOIN halves ON node = 'S' || s_suppkey WHERE s_suppkey % 3 = 0
 UNION ALL SELECT 'evidence', coalesce(target, src), CAST(count(*) AS VARCHAR), CAST(sum(doc) AS VARCHAR) FROM (SELECT DISTINCT src, doc FROM has_property WHERE CAST(substr(src, 2) AS BIGINT) % 3 = 0) LEFT JOIN halves ON node = src AND (doc % 2 = 0) = (h = 'a') GROUP BY 2
 UNION ALL SELECT 'surface', node_id, surface, NULL FROM dictionary WHERE category = 'Unit' AND node_id NOT IN (SELECT node FROM done) UNION ALL SELECT 'surface', 'S' || s_suppkey, 'alias of S' || s_suppkey, NULL FROM supplier WHERE s_suppkey % 3 = 0 AND 'S' || s_suppkey NOT IN (SELECT node FROM done)
 UNION ALL SELECT 'surface', target, 'half ' || h || ' of ' || node, NULL FROM halves UNION ALL SELECT 'surface', node || 'b', 'alias of ' || node, NULL FROM done""",
    "live_nodes": SQL + "SELECT category, count(*) AS n FROM nodes WHERE id <> 'S3' GROUP BY 1",
    "scope_children": "SELECT 'N' || n_nationkey AS parent_id, 'N' || n_nationkey || ':' || a AS id FROM nation, (VALUES ('customer'), ('supplier')) t(a)",
    "rename_aliases": "SELECT n_name AS surface, 'N' || n_nationkey AS node_id, 'Process' AS category, 'process' AS layer FROM nation WHERE n_nationkey % 4 = 0 UNION ALL SELECT n_name || '::' || a, 'N' || n_nationkey || ':' || a, 'Process', 'process' FROM nation, (VALUES ('customer'), ('supplier')) t(a) WHERE n_nationkey % 4 = 0",
    "change_preview": SQL + "SELECT n.id, count(other) AS edges, count(DISTINCT other) AS neighbours, coalesce((SELECT count(*) FROM nodes c WHERE c.parent = n.id), 0) AS children FROM nodes n LEFT JOIN (SELECT src AS id, dst AS other FROM edges UNION ALL SELECT dst, src FROM edges) e USING (id) WHERE tier IN ('sub', 'detail') GROUP BY n.id",
    "delete_edges": SQL + "SELECT rel, CASE WHEN dst LIKE '%3' THEN 'deleted_by_user' ELSE 'auto' END AS status, count(*) AS n FROM edges GROUP BY 1, 2",
    "change_log": "SELECT 'obsolete' AS op, 'someone' AS actor, 'R' || r_regionkey AS target, 'old' AS reason FROM region",
}
