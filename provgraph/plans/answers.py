"""Queries on questions and answers, changes, gauges, exports and views of the world."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import answer as A
from ..operators import changes as C
from ..operators import export as E
from ..operators import graph as G
from ..operators import gauges as U
from ..operators.state import checkpoint
from . import world as W
from .world import SQL, read

TEMPLATES = {"part_of": "{src} is part of {dst}", "precedes": "{dst} comes after {src}", "has_property": "{src} has {dst}"}


def link_questions(spark, sf_dir):
    return A.link(W.questions(spark, sf_dir), W.dictionary(spark, sf_dir))


def intent(spark, sf_dir):
    return W.questions(spark, sf_dir).select("qid", A.intent(F.col("q"), W.INTENTS).alias("intent"))


def _walked(spark, sf_dir):
    return G.expand(link_questions(spark, sf_dir).select("qid", F.col("node_id").alias("node")), W.edges(spark, sf_dir), W.RULES)


def expand_bfs(spark, sf_dir):
    return _walked(spark, sf_dir)


def facts_edges(spark, sf_dir):
    return A.facts(_walked(spark, sf_dir), W.edges(spark, sf_dir), W.nodes(spark, sf_dir), TEMPLATES)


def facts_attrs(spark, sf_dir):
    """Attribute lines of suppliers by context: the least quantity of each return flag, cut to whole numbers."""
    rows = read(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.floor(F.min("l_quantity")).alias("v"))
    return rows.select(F.col("l_suppkey").alias("node"), F.concat(F.lit("[flag="), "l_returnflag", F.lit("] quantity is at least "), F.col("v").cast("string")).alias("fact"))


def bridge_one_hop(spark, sf_dir):
    return A.bridge(_walked(spark, sf_dir), W.occurs_in(spark, sf_dir))


def cross_facts(spark, sf_dir):
    hops = bridge_one_hop(spark, sf_dir)
    name = lambda c: W.nodes(spark, sf_dir).select(F.col("id").alias(c), F.col("canonical").alias(f"{c}_name"))
    return hops.join(name("node"), "node").join(name("via"), "via").select("qid", F.concat("node_name", F.lit(" occurs in "), "via_name").alias("fact"))


def collect_chunks_top8(spark, sf_dir):
    return A.collect_chunks(_walked(spark, sf_dir), W.chunks(spark, sf_dir))


def next_of(spark, sf_dir):
    return G.next_of(W.nodes(spark, sf_dir).where("status = 'seed'"), W.precedes(spark, sf_dir)).select("id", "next", "how")


def next_of_nodes(spark, sf_dir):
    """As next_of, of all nodes, with the node that the answer holds for."""
    return G.next_of(W.nodes(spark, sf_dir), W.precedes(spark, sf_dir))


def flow_chain(spark, sf_dir):
    return G.flow_chain(W.precedes(spark, sf_dir), W.nodes(spark, sf_dir), "precedes")


def answers(spark, sf_dir):
    """One row a question: path, intent, how many nodes it names, facts and chunks it has, and its best chunk."""
    q = W.questions(spark, sf_dir)
    linked = checkpoint(link_questions(spark, sf_dir))
    nodes, edges = checkpoint(W.nodes(spark, sf_dir).select("id", "canonical")), checkpoint(W.edges(spark, sf_dir))
    walked = checkpoint(G.expand(linked.select("qid", F.col("node_id").alias("node")), edges, W.RULES))
    facts = A.facts(walked, edges, nodes, TEMPLATES).groupBy("qid").agg(F.count("*").alias("n_facts"))
    chunks = A.collect_chunks(walked, W.chunks(spark, sf_dir)).groupBy("qid").agg(F.count("*").alias("n_chunks"), F.min(F.when(F.col("rank") == 1, F.col("chunk_id"))).alias("best_chunk"), F.max("found").alias("found"))
    out = q.join(linked.groupBy("qid").agg(F.countDistinct("node_id").alias("n_nodes")), "qid", "left").join(facts, "qid", "left").join(chunks, "qid", "left")
    n = {c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("n_nodes", "n_facts", "n_chunks", "found")}
    name = A.intent(F.col("q"), W.INTENTS)
    return out.select("qid", name.alias("intent"), A.path(n["n_nodes"] > 0, name, n["n_facts"] > 0, n["n_chunks"] > 0, W.INTENTS).alias("path"), *(v.alias(c) for c, v in n.items()), "best_chunk")


def answer_path_counts(spark, sf_dir):
    return answers(spark, sf_dir).groupBy("path").agg(F.count("*").alias("n"))


def gauges(spark, sf_dir):
    """Linking recall, miss and truncation rate of the questions."""
    rows = answers(spark, sf_dir)
    rate = lambda a, b: F.round(F.count_if(a) / F.count_if(b), 3)
    known = F.col("qid").between(700, 799)
    return rows.agg(rate((F.col("n_nodes") > 0) & ~known, ~known).alias("recall"), rate(F.col("n_nodes") == 0, F.lit(True)).alias("miss_rate"), rate(F.col("found") > 8, F.lit(True)).alias("truncation_rate"))


def gauge_plateau(spark, sf_dir):
    """Of each order's supplier-part edges the share that no earlier order has."""
    seen = W.has_property(spark, sf_dir).groupBy("src", "dst").agg(F.min("doc").alias("first"))
    rows = W.has_property(spark, sf_dir).join(seen, ["src", "dst"])
    return rows.groupBy("doc").agg(F.round(F.count_if(F.col("doc") == F.col("first")) / F.count("*"), 3).alias("rate"))


def gauge_hold_rate(spark, sf_dir):
    """Queue rows (orders without a low or unspecified priority) over all pieces, by status."""
    held = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return read(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.round(F.count_if(held) / F.count("*"), 3).alias("hold_rate"))


def gauge_hubs(spark, sf_dir):
    return G.hubs(W.edges(spark, sf_dir), W.nodes(spark, sf_dir))


def graph_view(spark, sf_dir):
    return W.nodes(spark, sf_dir).groupBy("layer", F.col("category").alias("what")).agg(F.count("*").alias("n")).union(W.edges(spark, sf_dir).groupBy(F.lit("edge").alias("layer"), "rel").agg(F.count("*")))


def queue_view(spark, sf_dir):
    """Counts of every kind, none left out, and kinds outside the list."""
    kind = F.when(F.col("event_type") == "error", "parse_failure").when(F.col("event_type") == "view", "auto_node").otherwise(F.concat(F.lit("alien_"), "event_type"))
    return U.queue_view(read(spark, sf_dir, "events").select(kind.alias("kind"))).select("kind", "n")


def _moved(spark, sf_dir):
    """Parts merged into the next one, in chains of up to four."""
    return read(spark, sf_dir, "part").where("p_partkey % 5 <> 4").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") + 1).alias("into"))


def transit_redirect(spark, sf_dir):
    return G.redirects(_moved(spark, sf_dir))


def _renamed(spark, sf_dir):
    """Nations renamed: to a name of their own; to one that another has, two of them to one name, or to a tombstone's name."""
    dead = W.nodes(spark, sf_dir).where("tier = 'main'").select(F.concat(F.lit("T"), "id").alias("id"), F.concat(F.lit("OLD_"), F.substring("id", 2, 9)).alias("canonical"), "category", F.col("id").alias("merged_into"), F.lit(None).cast("string").alias("mirror_scope"))
    scope = F.when(F.col("tier") == "detail", F.split("canonical", "::")[0])
    own = W.nodes(spark, sf_dir).select("id", "canonical", "category", F.lit(None).cast("string").alias("merged_into"), scope.alias("mirror_scope")).union(dead)
    k = F.col("n_nationkey")
    new = F.when(k % 5 == 0, F.concat(F.lit("LAND_"), k.cast("string"))).when(k % 5 == 1, "NATION_0").when(k % 5 == 2, F.concat(F.lit("BOTH_"), (k / 10).cast("int").cast("string"))).when(k == 3, "OLD_3")
    return C.rename(own, read(spark, sf_dir, "nation").select(F.concat(F.lit("N"), k.cast("string")).alias("id"), new.alias("new")).where("new is not null"))


def op_rename(spark, sf_dir):
    return _renamed(spark, sf_dir)[0].select("id", "canonical", "mirror_scope")


def rename_refused(spark, sf_dir):
    return _renamed(spark, sf_dir)[1]


def op_survivor(spark, sf_dir):
    """Pairs of nodes, of some of which people chose one, or a node that is neither."""
    own = W.nodes(spark, sf_dir)
    pairs = own.select(F.col("id").alias("a"), F.concat(F.lit("N"), (F.length("id") + F.length("canonical")).cast("string")).alias("b")).where("a <> b")
    n = F.length("a") % 4
    return C.survivors(pairs.withColumn("override", F.when(n == 0, F.col("a")).when(n == 1, F.col("b")).when(n == 2, "Z")), own)


def op_merge(spark, sf_dir):
    k = F.col("n_nationkey")
    into = read(spark, sf_dir, "nation").where(k % 2 == 1).select(F.concat(F.lit("N"), k.cast("string")).alias("id"), F.concat(F.lit("N"), (k - 1).cast("string")).alias("target"))
    return C.merge_edges(W.occurs_in(spark, sf_dir), into)


def op_split_residual(spark, sf_dir):
    items = W.occurs_in(spark, sf_dir).where("dst = 'N3'")
    return C.split_residual(items, items.where("src <> 'F:5-LOW'"), G.EDGE)


def _gone(spark, sf_dir):
    """Of each nine units two replaced by the next one already. The third by the first, which would close a circle, as would
    the next three; then one by one that is there, one by none, and one by what is not there."""
    k, near = F.col("s_suppkey"), lambda n: F.concat(F.lit("S"), (F.col("s_suppkey") + n).cast("string"))
    units = read(spark, sf_dir, "supplier")
    units = units.where(k < units.count() // 9 * 9)
    known = units.select(near(0).alias("id"), F.when(k % 9 <= 1, "obsolete").otherwise("auto").alias("status"), F.when((k % 9 <= 1), near(1)).alias("replaced_by"))
    to = F.when(k % 9 == 2, near(-2)).when((k % 9 == 3) | (k % 9 == 4), near(1)).when(k % 9 == 5, near(-2)).when(k % 9 == 6, near(-6)).when(k % 9 == 8, "Z")
    return known, units.where("s_suppkey % 9 >= 2").select(near(0).alias("id"), to.alias("replaced_by"))


def op_obsolete(spark, sf_dir):
    return C.obsolete(*_gone(spark, sf_dir)).select("id", "status", "replaced_by")


def obsolete_refused(spark, sf_dir):
    return C.obsolete_refusals(*_gone(spark, sf_dir))


def _looped(spark, sf_dir):
    """Orders in rows of a hundred, each merged into the next; of every third row the last ninety are a circle."""
    k, place = F.col("o_orderkey"), F.col("o_orderkey") % 100
    into = F.when(place < 99, k + 1).when(F.floor(k / 100) % 3 == 0, k - 89)
    return read(spark, sf_dir, "orders").select(k.alias("id"), into.alias("into"))


def chain_ends(spark, sf_dir):
    return G.redirects(_looped(spark, sf_dir))


def chain_circles(spark, sf_dir):
    return G.chain_defects(_looped(spark, sf_dir))


def merge_candidates(spark, sf_dir):
    freq = W.has_property(spark, sf_dir).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("freq"))
    nodes = W.nodes(spark, sf_dir).withColumn("canonical", F.reverse("canonical"))
    return C.merge_candidates(nodes, freq, ["category"])


def export_cypher(spark, sf_dir):
    return E.cypher_nodes(W.nodes(spark, sf_dir)).union(E.cypher_edges(W.edges(spark, sf_dir)))


def export_mermaid(spark, sf_dir):
    return E.mermaid(W.precedes(spark, sf_dir), W.nodes(spark, sf_dir))


def export_csv_rows(spark, sf_dir):
    docs = W.has_property(spark, sf_dir).groupBy("src", "rel", "dst").agg(F.array_sort(F.collect_set(F.col("doc").cast("string"))).alias("docs"))
    return E.csv_rows(docs, ["docs"])


def tree_view(spark, sf_dir):
    from ..operators.resolve import closure

    own = W.nodes(spark, sf_dir).where("status = 'seed'")
    depth = closure(own).groupBy(F.col("node").alias("id")).agg(F.max("depth").cast("int").alias("depth"))
    nxt = W.precedes(spark, sf_dir).select(F.col("src").alias("id"), F.col("dst").alias("next"))
    return own.join(depth, "id").join(nxt, "id", "left").select("id", F.concat(F.repeat(F.lit("  "), F.col("depth")), "canonical").alias("line"), "depth", "tier", "next")


def doc_trace(spark, sf_dir):
    """What each order gave: edges and nodes by evidence."""
    return W.has_property(spark, sf_dir).groupBy("doc").agg(F.count("*").alias("edges"), F.countDistinct("src").alias("units"), F.countDistinct("dst").alias("properties"))


QUERIES = {f.__name__: f for f in (link_questions, intent, expand_bfs, facts_edges, facts_attrs, bridge_one_hop, cross_facts, collect_chunks_top8, next_of, next_of_nodes, flow_chain, answers, answer_path_counts, gauges, gauge_plateau, gauge_hold_rate, gauge_hubs, graph_view, queue_view, transit_redirect, chain_ends, chain_circles, op_rename, rename_refused, op_survivor, op_merge, op_split_residual, op_obsolete, obsolete_refused, merge_candidates, export_cypher, export_mermaid, export_csv_rows, tree_view, doc_trace)}

_FACTS = "SELECT a.qid, e.rel, CASE e.rel WHEN 'part_of' THEN s.canonical || ' is part of ' || d.canonical WHEN 'precedes' THEN d.canonical || ' comes after ' || s.canonical ELSE s.canonical || ' has ' || d.canonical END AS fact FROM edges e JOIN expanded a ON a.node = e.src JOIN expanded b ON b.node = e.dst AND b.qid = a.qid JOIN nodes s ON s.id = e.src JOIN nodes d ON d.id = e.dst WHERE e.rel IN ('part_of', 'precedes', 'has_property')"
_BRIDGE = "SELECT w.qid, x.b AS node, x.a AS via FROM expanded w JOIN (SELECT DISTINCT src AS a, dst AS b FROM occurs_in UNION ALL SELECT DISTINCT dst, src FROM occurs_in) x ON x.a = w.node WHERE NOT EXISTS (SELECT 1 FROM expanded o WHERE o.qid = w.qid AND o.node = x.b)"
_ANSWERS = f"""SELECT q.qid, i.intent, CASE WHEN l.n IS NULL THEN 'general_knowledge' WHEN intent IN ('flow', 'order', 'value', 'reverse', 'structure') THEN 'graph_fact' WHEN intent = 'general' THEN 'general_knowledge' WHEN intent = 'describe' THEN 'chunk'
 WHEN f.n IS NOT NULL AND c.n IS NOT NULL THEN 'both' WHEN c.n IS NOT NULL THEN 'chunk' WHEN f.n IS NOT NULL THEN 'graph_fact' ELSE 'general_knowledge' END AS path,
 coalesce(l.n, 0) AS n_nodes, coalesce(f.n, 0) AS n_facts, coalesce(c.n, 0) AS n_chunks, coalesce(c.found, 0) AS found, best_chunk
 FROM questions q JOIN intents i USING (qid) LEFT JOIN (SELECT qid, count(DISTINCT node_id) AS n FROM linked GROUP BY 1) l USING (qid) LEFT JOIN (SELECT qid, count(*) AS n FROM ({_FACTS}) GROUP BY 1) f USING (qid)
 LEFT JOIN (SELECT qid, count(*) AS n, max(found) AS found, min(CASE WHEN rank = 1 THEN chunk_id END) AS best_chunk FROM top_chunks WHERE rank <= 8 GROUP BY 1) c USING (qid)"""

ORACLE_SQL = {
    "link_questions": SQL + "SELECT * FROM linked",
    "intent": SQL + "SELECT * FROM intents",
    "expand_bfs": SQL + "SELECT * FROM expanded",
    "facts_edges": SQL + _FACTS,
    "facts_attrs": "SELECT l_suppkey AS node, '[flag=' || l_returnflag || '] quantity is at least ' || CAST(CAST(floor(min(l_quantity)) AS BIGINT) AS VARCHAR) AS fact FROM lineitem GROUP BY l_suppkey, l_returnflag",
    "bridge_one_hop": SQL + _BRIDGE,
    "cross_facts": SQL + f"SELECT qid, n.canonical || ' occurs in ' || v.canonical AS fact FROM ({_BRIDGE}) b JOIN nodes n ON n.id = b.node JOIN nodes v ON v.id = b.via",
    "collect_chunks_top8": SQL + "SELECT * FROM top_chunks WHERE rank <= 8",
    "next_of": SQL + "SELECT n.id, coalesce(o.dst, i.id, u.dst) AS next, CASE WHEN o.dst IS NOT NULL THEN 'self' WHEN i.id IS NOT NULL THEN 'derived_instance' WHEN u.dst IS NOT NULL THEN 'derived_merge' ELSE 'none' END AS how FROM nodes n LEFT JOIN precedes o ON o.src = n.id LEFT JOIN precedes u ON u.src = n.parent LEFT JOIN nodes i ON i.tier = 'detail' AND i.parent = u.dst AND i.polarity = n.polarity WHERE n.status = 'seed'",
    "next_of_nodes": SQL + "SELECT n.id, coalesce(i.id, c.dst) AS next, CASE WHEN c.dst IS NULL THEN 'none' WHEN c.at = n.id THEN 'self' WHEN i.id IS NOT NULL THEN 'derived_instance' ELSE 'derived_merge' END AS how, c.at FROM nodes n LEFT JOIN (SELECT m.id, coalesce(o.dst, u.dst, v.dst) AS dst, coalesce(o.src, u.src, v.src) AS at FROM nodes m LEFT JOIN nodes p ON p.id = m.parent LEFT JOIN precedes o ON o.src = m.id LEFT JOIN precedes u ON u.src = m.parent LEFT JOIN precedes v ON v.src = p.parent) c ON c.id = n.id LEFT JOIN nodes i ON i.tier = 'detail' AND i.parent = c.dst AND i.polarity = n.polarity",
    "flow_chain": SQL + "SELECT src, dst FROM precedes JOIN nodes ON id = src WHERE polarity = 'none'",
    "answers": SQL + _ANSWERS,
    "answer_path_counts": SQL + f"SELECT path, count(*) AS n FROM ({_ANSWERS}) GROUP BY 1",
    "gauges": SQL + f"SELECT round(count(*) FILTER (WHERE n_nodes > 0 AND qid NOT BETWEEN 700 AND 799) / count(*) FILTER (WHERE qid NOT BETWEEN 700 AND 799), 3) AS recall, round(count(*) FILTER (WHERE n_nodes = 0) / count(*), 3) AS miss_rate, round(count(*) FILTER (WHERE found > 8) / count(*), 3) AS truncation_rate FROM ({_ANSWERS})",
    "gauge_plateau": SQL + "SELECT doc, round(count(*) FILTER (WHERE doc = first) / count(*), 3) AS rate FROM (SELECT *, min(doc) OVER (PARTITION BY src, dst) AS first FROM has_property) GROUP BY 1",
    "gauge_hold_rate": "SELECT o_orderstatus, round(count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) / count(*), 3) AS hold_rate FROM orders GROUP BY 1",
    "gauge_hubs": SQL + "SELECT layer, id, degree, CAST(r AS INTEGER) AS rank FROM (SELECT layer, n.id, degree, row_number() OVER (PARTITION BY layer ORDER BY degree DESC, n.id DESC) AS r FROM (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1) d JOIN nodes n ON n.id = d.id) WHERE r <= 3",
    "graph_view": SQL + "SELECT layer, category AS what, count(*) AS n FROM nodes GROUP BY 1, 2 UNION ALL SELECT 'edge', rel, count(*) FROM edges GROUP BY 2",
    "queue_view": "SELECT coalesce(k.kind, f.kind) AS kind, coalesce(n, 0) AS n FROM (VALUES " + ", ".join(f"('{k}')" for k in U.KINDS) + ") k(kind) FULL JOIN (SELECT CASE event_type WHEN 'error' THEN 'parse_failure' WHEN 'view' THEN 'auto_node' ELSE 'alien_' || event_type END AS kind, count(*) AS n FROM events GROUP BY 1) f ON k.kind = f.kind",
    "transit_redirect": "SELECT p_partkey AS id, p_partkey - p_partkey % 5 + 4 AS target FROM part WHERE p_partkey % 5 <> 4",
    "chain_ends": "SELECT o_orderkey AS id, CASE WHEN o_orderkey // 100 % 3 > 0 THEN o_orderkey // 100 * 100 + 99 ELSE greatest(o_orderkey, o_orderkey // 100 * 100 + 10) END AS target FROM orders WHERE o_orderkey % 100 < 99 OR o_orderkey // 100 % 3 = 0",
    "chain_circles": "SELECT DISTINCT 'chain_circle' AS kind, CAST(o_orderkey // 100 * 100 + 10 AS VARCHAR) AS key, 90 AS length, 100 AS ids FROM orders WHERE o_orderkey // 100 % 3 = 0",
    "op_rename": SQL + """, r AS (SELECT n_nationkey AS k, CASE WHEN k % 5 = 0 THEN 'LAND_' || k WHEN k = 22 THEN 'BOTH_2' WHEN k = 3 THEN 'OLD_3' ELSE n_name END AS new FROM nation)
 SELECT id, CASE tier WHEN 'sub' THEN new WHEN 'detail' THEN new || '::' || polarity ELSE canonical END AS canonical, CASE WHEN tier = 'detail' THEN new END AS mirror_scope FROM nodes LEFT JOIN r ON id = 'N' || k OR (tier = 'detail' AND parent = 'N' || k) UNION ALL SELECT 'TR' || r_regionkey, 'OLD_' || r_regionkey, NULL FROM region""",
    "rename_refused": "SELECT 'N' || n_nationkey AS id, CASE WHEN n_nationkey % 5 = 1 THEN 'NATION_0' ELSE 'BOTH_' || n_nationkey // 10 END AS new FROM nation WHERE n_nationkey % 5 = 1 OR n_nationkey IN (2, 7, 12, 17)",
    "op_survivor": SQL + ", p AS (SELECT id AS a, status AS sa, 'N' || (length(id) + length(canonical)) AS b FROM nodes) SELECT a, b, CASE length(a) % 4 WHEN 0 THEN a WHEN 1 THEN b WHEN 2 THEN NULL ELSE CASE WHEN sa = 'seed' AND n.status = 'auto' THEN a WHEN sa = 'auto' AND n.status = 'seed' THEN b ELSE least(a, b) END END AS survivor FROM p JOIN nodes n ON n.id = b WHERE a <> b",
    "op_merge": SQL + "SELECT src, rel, 'N' || (CAST(substr(dst, 2) AS INTEGER) // 2 * 2) AS dst, count(DISTINCT doc) AS evidence FROM occurs_in GROUP BY ALL",
    "op_split_residual": SQL + "SELECT DISTINCT src, rel, dst FROM occurs_in WHERE dst = 'N3' AND src = 'F:5-LOW'",
    "op_obsolete": "SELECT 'S' || s_suppkey AS id, CASE WHEN s_suppkey % 9 IN (0, 1, 6, 7) THEN 'obsolete' ELSE 'auto' END AS status, CASE WHEN s_suppkey % 9 <= 1 THEN 'S' || (s_suppkey + 1) WHEN s_suppkey % 9 = 6 THEN 'S' || (s_suppkey - 6) END AS replaced_by FROM supplier WHERE s_suppkey < (SELECT count(*) // 9 * 9 FROM supplier)",
    "obsolete_refused": "SELECT 'S' || s_suppkey AS id, CASE s_suppkey % 9 WHEN 8 THEN 'Z' WHEN 2 THEN 'S' || (s_suppkey - 2) WHEN 5 THEN 'S' || (s_suppkey - 2) ELSE 'S' || (s_suppkey + 1) END AS replaced_by, CASE s_suppkey % 9 WHEN 8 THEN 'missing_target' ELSE 'circle' END AS reason FROM supplier WHERE s_suppkey % 9 IN (2, 3, 4, 5, 8) AND s_suppkey < (SELECT count(*) // 9 * 9 FROM supplier)",
    "merge_candidates": SQL + "SELECT category, id, freq, CAST(row_number() OVER (PARTITION BY category ORDER BY freq DESC, CASE status WHEN 'seed' THEN 3 WHEN 'auto' THEN 1 ELSE 0 END DESC, reverse(canonical), id) AS INTEGER) AS place FROM (SELECT n.*, coalesce(h.n, 0) AS freq FROM nodes n LEFT JOIN (SELECT dst, count(*) AS n FROM has_property GROUP BY 1) h ON h.dst = n.id)",
    "export_cypher": SQL + "SELECT 'CREATE (:' || category || ':Node {id: ''' || id || ''', canonical: ''' || canonical || '''' || CASE WHEN polarity <> 'none' THEN ', polarity: ''' || polarity || '''' ELSE '' END || '})' AS line FROM nodes UNION ALL SELECT 'MATCH (a:Node {id: ''' || src || '''}), (b:Node {id: ''' || dst || '''}) CREATE (a)-[:' || rel || ']->(b)' FROM edges",
    "export_mermaid": SQL + "SELECT '  ' || src || '[' || s.canonical || '] --> ' || dst || '[' || d.canonical || ']' AS line FROM precedes JOIN nodes s ON s.id = src JOIN nodes d ON d.id = dst",
    "export_csv_rows": SQL + "SELECT src, rel, dst, string_agg(CAST(doc AS VARCHAR), ' | ' ORDER BY CAST(doc AS VARCHAR)) AS docs FROM has_property GROUP BY 1, 2, 3",
    "tree_view": SQL + "SELECT id, repeat('  ', d) || canonical AS line, CAST(d AS INTEGER) AS depth, tier, dst AS next FROM (SELECT *, CASE tier WHEN 'main' THEN 0 WHEN 'sub' THEN 1 ELSE 2 END AS d FROM nodes WHERE status = 'seed') LEFT JOIN precedes ON src = id",
    "doc_trace": SQL + "SELECT doc, count(*) AS edges, count(DISTINCT src) AS units, count(DISTINCT dst) AS properties FROM has_property GROUP BY 1",
}
