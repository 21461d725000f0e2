"""Queries on gauges, mirrors, lost evidence and exports of what is live."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import export as E
from ..operators import gauges as M
from ..operators import graph as G
from ..operators import parse as P
from . import world as W
from .world import SQL, read


def _s(x):
    return F.col(x).cast("string")


def _evidence(spark, sf_dir):
    """Orders as evidence for suppliers, in the order of their keys."""
    rows = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("S"), _s("l_suppkey")).alias("item"), F.col("l_orderkey").alias("doc"), F.col("l_orderkey").alias("ordinal"), F.concat_ws("!", _s("l_orderkey"), _s("l_linenumber")).alias("locator"))
    seeds = read(spark, sf_dir, "nation").select(F.concat(F.lit("N"), _s("n_nationkey")), F.lit(1).cast("long"), F.lit(1).cast("long"), F.lit("seed"))
    return rows.union(seeds)


def plateau_nodes(spark, sf_dir):
    return M.plateau(_evidence(spark, sf_dir), W.nodes(spark, sf_dir))


def hold_rate_places(spark, sf_dir):
    queue = read(spark, sf_dir, "orders").where("o_orderpriority in ('1-URGENT', '2-HIGH')")
    chunks = read(spark, sf_dir, "orders").select(F.concat(F.lit("K"), _s("o_orderkey")).alias("chunk_id"))
    return M.hold_rate(queue, _evidence(spark, sf_dir), chunks)


def queue_kinds(spark, sf_dir):
    kind = F.when(F.col("event_id") % 3 == 0, "spec_conflict").when(F.col("event_type") == "error", "odd").otherwise("auto_node")
    return M.queue_view(read(spark, sf_dir, "events").select(kind.alias("kind")))


def cross_layer_sentences(spark, sf_dir):
    return M.cross_sentences(W.edges(spark, sf_dir), W.nodes(spark, sf_dir), {"occurs_in": "{src} occurs in {dst}", "part_of": "{src} is part of {dst}"})


def document_trace(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem")
    docs = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"))
    chunks = line.select(F.col("l_orderkey").alias("doc"), F.concat_ws("-", _s("l_orderkey"), _s("l_linenumber")).alias("chunk_id"))
    describes = chunks.where("doc % 2 = 0")
    queue = docs.where("doc % 5 = 0")
    return M.doc_trace(docs, chunks, describes, _evidence(spark, sf_dir).where("locator <> 'seed'"), queue)


def _machines(spark, sf_dir):
    """Instances of nations as scopes; below them customers and suppliers by the last digit of their key, some on one side only."""
    nodes = W.nodes(spark, sf_dir).where("tier = 'detail'").select("id", "canonical", "category", "parent", "polarity", "status")
    for name, axis in (("customer", "customer"), ("supplier", "supplier")):
        key = {"customer": "c_custkey", "supplier": "s_suppkey"}[name]
        nation = {"customer": "c_nationkey", "supplier": "s_nationkey"}[name]
        own = read(spark, sf_dir, name).select(F.concat(F.lit(axis[0].upper()), _s(key)).alias("id"), F.concat(F.lit("x::"), F.lit(f"{axis} unit "), (F.col(key) % 10).cast("string")).alias("canonical"), F.lit("Unit").alias("category"), F.concat(F.lit("N"), _s(nation), F.lit(f":{axis}")).alias("parent"), F.lit(axis).alias("polarity"), F.lit("auto").alias("status"))
        nodes = nodes.union(own)
    return nodes


def mirror_link_edges(spark, sf_dir):
    return G.mirror_links(_machines(spark, sf_dir), W.AXIS)[0]


def mirror_link_gaps(spark, sf_dir):
    return G.mirror_links(_machines(spark, sf_dir), W.AXIS)[1]


def lost_evidence(spark, sf_dir):
    nodes = W.nodes(spark, sf_dir).where("category = 'Unit'")
    edges = W.edges(spark, sf_dir).where("rel = 'has_property'").withColumn("status", F.lit("auto"))
    evidence = _evidence(spark, sf_dir).where("doc % 2 = 0").select("item").union(edges.where("length(dst) % 2 = 0").select(F.concat_ws("|", "src", "rel", "dst")))
    return G.lost(nodes, edges, evidence)


def flow_of_concepts(spark, sf_dir):
    return G.flow_chain(W.edges(spark, sf_dir), W.nodes(spark, sf_dir), "precedes")


def axis_conflicts(spark, sf_dir):
    k = F.col("s_suppkey")
    pieces = read(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("N"), _s("s_nationkey"), F.lit(":supplier")).alias("node_id"), F.when(k % 3 == 0, "customer").when(k % 3 == 1, "supplier").alias("axis"))
    return G.axis_mismatch(pieces, W.nodes(spark, sf_dir), "s_suppkey", "node_id", "axis")


def slide_chunks(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").withColumn("slide", F.floor(F.col("turn") / 4).cast("int"))
    return P.slide_chunks(turns, "conv_id", "slide", "turn", "text").groupBy("conv_id", "split_path").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def flatten_fields(spark, sf_dir):
    nested = F.create_map(F.lit("size"), F.create_map(F.lit("mm"), _s("p_size"), F.lit("type"), F.col("p_type")), F.lit("context"), F.create_map(F.lit("brand"), F.col("p_brand")))
    return P.flatten(read(spark, sf_dir, "part").select("p_partkey", nested.alias("nested")), "p_partkey", "nested")


def content_fields(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select(F.concat(F.lit("r"), _s("p_partkey")).alias("record_id"), F.concat(F.lit("S!R"), _s("p_partkey")).alias("locator"), "p_name", F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).alias("p_type"))
    return P.content_chunks(rows, ["p_name", "p_type"])


def export_live(spark, sf_dir):
    nodes = W.nodes(spark, sf_dir).withColumn("merged_into", F.when(F.col("id").isin("S3", "N4"), "S1"))
    edges = W.edges(spark, sf_dir).withColumn("status", F.when(F.col("dst") == "N7", "deleted_by_user").otherwise("auto"))
    alive, kept = E.live_graph(nodes, edges)
    return kept.groupBy("rel").agg(F.count("*").alias("n")).union(alive.groupBy("category").agg(F.count("*")))


def export_attributes(spark, sf_dir):
    values = read(spark, sf_dir, "part").where("p_partkey < 50").select(F.concat(F.lit("P"), _s("p_partkey")).alias("node"), F.lit("size").alias("attr"), F.create_map(F.lit("brand"), F.col("p_brand")).alias("context"), F.col("p_size").alias("value"))
    return E.cypher_attributes(values)


QUERIES = {f.__name__: f for f in (plateau_nodes, hold_rate_places, queue_kinds, cross_layer_sentences, document_trace, mirror_link_edges, mirror_link_gaps, lost_evidence, flow_of_concepts, axis_conflicts, slide_chunks, flatten_fields, content_fields, export_live, export_attributes)}

_UNITS = """, unit AS (SELECT 'C' || c_custkey AS id, 'N' || c_nationkey AS scope, 'unit ' || c_custkey % 10 AS name, 'customer' AS polarity FROM customer UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, 'unit ' || s_suppkey % 10, 'supplier' FROM supplier),
 side AS (SELECT scope, name, polarity, min(id) AS id FROM unit GROUP BY 1, 2, 3) """
ORACLE_SQL = {
    "plateau_nodes": """WITH e AS (SELECT DISTINCT 'S' || l_suppkey AS item, l_orderkey AS doc, false AS seed FROM lineitem UNION SELECT 'N' || n_nationkey, 1, true FROM nation), f AS (SELECT *, min(doc) OVER (PARTITION BY item) = doc AND NOT seed AS new FROM e)
 SELECT doc, count(*) AS mentioned, count(*) FILTER (WHERE new) AS new, round(count(*) FILTER (WHERE new) / count(*), 3) AS rate FROM f GROUP BY 1""",
    "hold_rate_places": "SELECT q AS queue, p AS pieces, round(q / p, 3) AS rate FROM (SELECT (SELECT count(*) FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) AS q, (SELECT count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem) + (SELECT count(*) FROM orders) AS p)",
    "queue_kinds": "SELECT kind, count(n) AS n, bool_or(known) AS known FROM (SELECT unnest([" + ", ".join(f"'{k}'" for k in M.KINDS) + "]) AS kind, NULL AS n, true AS known UNION ALL SELECT CASE WHEN event_id % 3 = 0 THEN 'spec_conflict' WHEN event_type = 'error' THEN 'odd' ELSE 'auto_node' END, 1, event_id % 3 = 0 OR event_type <> 'error' FROM events) GROUP BY 1",
    "cross_layer_sentences": SQL + "SELECT DISTINCT 'quality' AS src_layer, 'occurs_in' AS rel, 'process' AS dst_layer, substr(src, 3) || ' occurs in ' || n.canonical AS sentence FROM occurs_in JOIN nodes n ON n.id = dst",
    "document_trace": """SELECT o_orderkey AS doc, count(DISTINCT l_linenumber) AS chunks, CASE WHEN o_orderkey % 2 = 0 THEN count(DISTINCT l_linenumber) ELSE 0 END AS linked, count(DISTINCT l_suppkey) AS items, CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS held FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""",
    "mirror_link_edges": SQL + _UNITS + "SELECT a.id AS src, 'mirrors' AS rel, b.id AS dst FROM side a JOIN side b ON a.scope = b.scope AND a.name = b.name AND a.polarity <> b.polarity",
    "mirror_link_gaps": SQL + _UNITS + "SELECT scope, name, min(polarity) AS seen FROM side GROUP BY 1, 2 HAVING count(*) = 1",
    "lost_evidence": SQL + "SELECT 'evidence_lost' AS kind, 'S' || s_suppkey AS key FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_orderkey % 2 = 0) UNION ALL SELECT DISTINCT 'evidence_lost', src || '|has_property|' || dst FROM has_property WHERE length(dst) % 2 = 1",
    "flow_of_concepts": SQL + "SELECT src, dst FROM precedes",
    "axis_conflicts": "SELECT s_suppkey, 'N' || s_nationkey || ':supplier' AS node_id, 'customer' AS axis, 'supplier' AS bound FROM supplier WHERE s_suppkey % 3 = 0",
    "slide_chunks": """WITH t AS (SELECT conv_id, turn // 4 AS slide, trim(text) AS x FROM conversations WHERE trim(text) <> ''), r AS (SELECT *, sum(length(x)) OVER (PARTITION BY conv_id, slide) AS chars, count(*) OVER (PARTITION BY conv_id, slide) AS shapes FROM t),
 p AS (SELECT *, CASE WHEN chars <= 600 AND shapes <= 5 THEN 'slide' WHEN shapes > 1 THEN 'shape' ELSE 'hierarchy_unresolved' END AS split_path FROM r)
 SELECT conv_id, split_path, CASE WHEN split_path = 'slide' THEN count(DISTINCT slide) ELSE count(*) END AS n, CAST(CASE WHEN split_path = 'slide' THEN sum(length(x)) + count(*) - count(DISTINCT slide) ELSE sum(length(x)) END AS BIGINT) AS chars FROM p GROUP BY 1, 2""",
    "flatten_fields": "SELECT p_partkey, 'size.mm' AS field, CAST(p_size AS VARCHAR) AS value FROM part UNION ALL SELECT p_partkey, 'size.type', p_type FROM part UNION ALL SELECT p_partkey, 'context', '{\"brand\":\"' || p_brand || '\"}' FROM part",
    "content_fields": "SELECT 'r' || p_partkey || '-p_name' AS chunk_id, 'S!R' || p_partkey AS section, 'p_name' AS field, p_name AS text FROM part UNION ALL SELECT 'r' || p_partkey || '-p_type', 'S!R' || p_partkey, 'p_type', p_type FROM part WHERE p_partkey % 2 = 0",
    "export_live": SQL + "SELECT rel, count(*) AS n FROM edges WHERE dst NOT IN ('N7', 'S3', 'N4') AND src NOT IN ('S3', 'N4') GROUP BY 1 UNION ALL SELECT category, count(*) FROM nodes WHERE id NOT IN ('S3', 'N4') GROUP BY 1",
    "export_attributes": "SELECT 'MATCH (a:Node {id: ''P' || p_partkey || '''}) SET a.attrs = ''[{\"attr\":\"size\",\"context\":\"{\\\\\"brand\\\\\":\\\\\"' || p_brand || '\\\\\"}\",\"value\":\"' || p_size || '\"}]''' AS line FROM part WHERE p_partkey < 50",
}
