"""Whole answers over the world's two layers, some of whose nodes were merged, replaced or made obsolete."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import router as R
from ..operators.state import checkpoint
from . import world as W
from .world import SQL, read

#: id, merged into, replaced by
MOVED = [("N23", "N22", None), ("N22", "N21", None), ("N24", None, "N20"), ("N20", None, "N15"), ("N19", None, None)]
RULES = [("process", *r) for r in W.RULES] + [("quality", "escalates", "out", True)]
CROSS = [("quality", "occurs_in", "both")]
INTENTS = [("process", i, name, marker) for i, (name, marker, _) in enumerate(W.INTENTS)] + [("quality", 0, "order", "next to"), ("quality", 1, "describe", "describe"), ("quality", 2, "general", "joke")]
TEMPLATES = [
    ("process", "part_of", "{src} is part of {dst}"), ("process", "precedes", "{dst} comes after {src}"), ("process", "precedes:derived", "{dst} comes after {src} by {scope}"), ("process", "has_property", "{src} has {dst}"),
    ("process", "node:obsolete", "{node} is gone"), ("quality", "occurs_in", "{src} occurs in {dst}"), ("quality", "escalates", "{src} escalates to {dst}"),
]


def _failures(spark, sf_dir):
    return read(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.lit(1)).select(F.col("o_orderpriority").alias("p"), F.substring("o_orderpriority", 1, 1).cast("bigint").alias("n"))


def _questions(spark, sf_dir):
    own, to = _failures(spark, sf_dir), lambda base: (F.col("n") + base).cast("bigint").alias("qid")
    nation = F.concat(F.lit("NATION_"), (F.col("n") * 4 + 3).cast("string"))
    forms = {800: F.concat(F.lit("describe "), "p", F.lit(" please")), 820: F.concat(F.lit("what is next to "), "p"), 840: F.concat("p", F.lit(" in "), nation), 860: F.concat("p", F.lit(" after "), nation), 880: F.concat(F.lit("a joke on "), "p")}
    out = W.questions(spark, sf_dir)
    for base, q in forms.items():
        out = out.union(own.select(to(base), q.alias("q")))
    return out


def _world(spark, sf_dir):
    moved = spark.createDataFrame(MOVED, "id string, merged_into string, replaced_by string").withColumn("now", F.when(F.col("merged_into").isNotNull(), "merged_into").otherwise("obsolete"))
    nodes = W.nodes(spark, sf_dir).join(moved, "id", "left").withColumn("status", F.coalesce("now", "status")).drop("now")
    cross = F.col("rel") == "occurs_in"
    edges = W.edges(spark, sf_dir).withColumn("layer", F.when(cross, "quality").otherwise("process"))
    own = _failures(spark, sf_dir)
    up = own.select(F.concat(F.lit("F:"), "p").alias("src"), F.lit("escalates").alias("rel"), (F.col("n") - 1).alias("m")).join(own.select(F.concat(F.lit("F:"), "p").alias("dst"), F.col("n").alias("m")), "m").select("src", "rel", "dst", F.lit("quality").alias("layer"))
    return nodes, edges.union(up)


def _routed(spark, sf_dir):
    nodes, edges = (checkpoint(x) for x in _world(spark, sf_dir))
    tables = (
        (RULES, "layer string, rel string, direction string, recursive boolean"), (CROSS, "layer string, rel string, direction string"), (INTENTS, "layer string, ord int, intent string, marker string"),
        (TEMPLATES, "layer string, key string, template string"), ([("process", "precedes")], "layer string, sibling string"),
    )
    layers = R.Layers(*(spark.createDataFrame(rows, schema) for rows, schema in tables))
    return R.route(_questions(spark, sf_dir), W.dictionary(spark, sf_dir), nodes, edges, W.chunks(spark, sf_dir), layers)


def answers_routed(spark, sf_dir):
    """One row a question, with the notes of what has moved and what the flow, order, bridge and edge channels and the chunks gave."""
    return _routed(spark, sf_dir)["answers"]


def answers_routed_facts(spark, sf_dir):
    return _routed(spark, sf_dir)["facts"].groupBy("qid", "channel", "layer").agg(F.count("*").alias("n"), F.min("fact").alias("first"), F.max("fact").alias("last"))


def answers_routed_transit(spark, sf_dir):
    return _routed(spark, sf_dir)["transit"]


QUERIES = {f.__name__: f for f in (answers_routed, answers_routed_facts, answers_routed_transit)}

#: The base's questions, walks and chunks are of linked nodes as they are named; here all is done again on what they have become.
_S = SQL + """, failures AS (SELECT DISTINCT o_orderpriority AS p, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS n FROM orders),
asked AS (SELECT * FROM questions UNION ALL SELECT n + 800, 'describe ' || p || ' please' FROM failures UNION ALL SELECT n + 820, 'what is next to ' || p FROM failures UNION ALL SELECT n + 840, p || ' in NATION_' || (n * 4 + 3) FROM failures
  UNION ALL SELECT n + 860, p || ' after NATION_' || (n * 4 + 3) FROM failures UNION ALL SELECT n + 880, 'a joke on ' || p FROM failures),
found AS (SELECT DISTINCT qid, surface FROM asked JOIN dictionary ON contains(q, surface)),
named AS (SELECT DISTINCT m.qid, m.surface, d.node_id, d.layer FROM found m JOIN dictionary d USING (surface) WHERE NOT EXISTS (SELECT 1 FROM found o WHERE o.qid = m.qid AND o.surface <> m.surface AND contains(o.surface, m.surface))),
moved AS (SELECT * FROM (VALUES ('N23', 'N21', 'merged'), ('N22', 'N21', 'merged'), ('N24', 'N15', 'replaced'), ('N20', 'N15', 'replaced'), ('N19', 'N19', 'obsolete')) t(node_id, target, kind)),
hits AS (SELECT n.qid, n.surface, n.layer, n.node_id, coalesce(target, node_id) AS target, kind, CASE kind WHEN 'replaced' THEN '(replaced: ' || c.canonical || ')' WHEN 'obsolete' THEN c.canonical || ' is gone' END AS note, coalesce(kind <> 'obsolete', true) AS visible, surface = c.canonical AS named
  FROM named n LEFT JOIN moved USING (node_id) JOIN nodes c ON c.id = n.node_id),
marks AS (SELECT * FROM (VALUES """ + ", ".join(f"('{a}', {b}, '{c}', '{d}')" for a, b, c, d in INTENTS) + """) t(layer, ord, intent, marker)),
intended AS (SELECT qid, min_by(intent, (layer, ord)) AS intent FROM (SELECT DISTINCT qid, layer FROM hits WHERE visible) JOIN asked USING (qid) JOIN marks USING (layer) WHERE contains(q, marker) GROUP BY 1),
seen AS (SELECT DISTINCT h.qid, h.layer, h.target AS node, intent FROM hits h LEFT JOIN intended USING (qid) WHERE visible AND coalesce(intent, '') <> 'general'),
plain AS (SELECT qid, layer, node FROM seen WHERE coalesce(intent, '') NOT IN ('flow', 'order')),
have AS (SELECT DISTINCT src, dst FROM has_property), occ AS (SELECT DISTINCT src, dst FROM occurs_in),
below AS (SELECT qid, node FROM plain WHERE layer = 'process' UNION SELECT b.qid, p.src FROM below b JOIN part_of p ON p.dst = b.node),
worse AS (SELECT qid, node FROM plain WHERE layer = 'quality' UNION SELECT w.qid, 'F:' || b.p FROM worse w JOIN failures a ON w.node = 'F:' || a.p JOIN failures b ON b.n = a.n - 1),
walked AS (SELECT qid, 'process' AS layer, node FROM below UNION SELECT qid, 'process', p.dst FROM plain JOIN part_of p ON p.src = node WHERE layer = 'process' UNION SELECT qid, 'process', h.dst FROM below JOIN have h ON h.src = node
  UNION SELECT qid, 'process', h.src FROM below JOIN have h ON h.dst = node UNION SELECT qid, 'quality', node FROM worse UNION SELECT qid, layer, node FROM seen WHERE intent IN ('flow', 'order')),
crossing AS (SELECT DISTINCT qid, src, dst, src AS node FROM walked JOIN occ ON dst = node WHERE layer = 'process' UNION SELECT qid, src, dst, dst FROM walked w JOIN occ ON src = node WHERE layer = 'process' AND NOT EXISTS (SELECT 1 FROM walked o WHERE o.qid = w.qid AND o.layer = 'process' AND o.node = dst)),
reached AS (SELECT * FROM walked UNION SELECT qid, 'quality', node FROM crossing),
said AS (SELECT 'process' AS layer, src, dst, s.canonical || ' is part of ' || d.canonical AS fact FROM part_of JOIN nodes s ON s.id = src JOIN nodes d ON d.id = dst
  UNION ALL SELECT 'process', src, dst, d.canonical || ' comes after ' || s.canonical FROM precedes JOIN nodes s ON s.id = src JOIN nodes d ON d.id = dst
  UNION ALL SELECT 'process', src, dst, s.canonical || ' has ' || d.canonical FROM have JOIN nodes s ON s.id = src JOIN nodes d ON d.id = dst
  UNION ALL SELECT 'quality', src, dst, s.canonical || ' occurs in ' || d.canonical FROM occ JOIN nodes s ON s.id = src JOIN nodes d ON d.id = dst
  UNION ALL SELECT 'quality', 'F:' || a.p, 'F:' || b.p, a.p || ' escalates to ' || b.p FROM failures a JOIN failures b ON b.n = a.n - 1),
after AS (SELECT n.id, n.canonical AS own, coalesce(o.src, u.src, v.src) AS up, CASE WHEN o.src IS NULL AND i.id IS NOT NULL THEN i.canonical ELSE c.canonical END AS next FROM nodes n LEFT JOIN nodes p ON p.id = n.parent LEFT JOIN precedes o ON o.src = n.id LEFT JOIN precedes u ON u.src = n.parent LEFT JOIN precedes v ON v.src = p.parent
  LEFT JOIN nodes c ON c.id = coalesce(o.dst, u.dst, v.dst) LEFT JOIN nodes i ON i.parent = c.id AND i.polarity = n.polarity AND i.tier = 'detail'),
facts AS (SELECT a.qid, 'edge' AS channel, s.layer, fact FROM said s JOIN reached a ON a.node = s.src AND a.layer = s.layer JOIN reached b ON b.node = s.dst AND b.layer = s.layer AND b.qid = a.qid
  UNION ALL SELECT qid, 'cross', 'quality', s.canonical || ' occurs in ' || d.canonical FROM crossing JOIN nodes s ON s.id = src JOIN nodes d ON d.id = dst
  UNION ALL SELECT f.qid, 'flow', 'process', fact FROM (SELECT DISTINCT qid FROM seen WHERE intent = 'flow' AND layer = 'process') f, said JOIN nodes s ON s.id = src WHERE fact = (SELECT canonical FROM nodes d WHERE d.id = said.dst) || ' comes after ' || s.canonical AND s.polarity = 'none'
  UNION ALL SELECT qid, 'order', 'process', CASE WHEN up IS NULL THEN 'no order for ' || own WHEN up = id THEN next || ' comes after ' || own ELSE next || ' comes after ' || own || ' by ' || (SELECT canonical FROM nodes x WHERE x.id = up) END FROM seen JOIN after ON id = node WHERE intent = 'order' AND layer = 'process'
  UNION ALL SELECT qid, 'order', 'quality', 'no order for ' || canonical FROM seen JOIN nodes ON id = node WHERE intent = 'order' AND seen.layer = 'quality'),
tiers AS (SELECT qid, chunk_id, min(CASE WHEN EXISTS (SELECT 1 FROM seen s WHERE s.qid = r.qid AND s.node = r.node) THEN 1 ELSE 2 END) AS tier FROM (SELECT DISTINCT qid, node FROM reached) r JOIN chunks USING (node) GROUP BY 1, 2),
best AS (SELECT qid, least(count(*), 8) AS n_chunks, count(*) AS all_, min_by(chunk_id, (tier, chunk_id)) AS best_chunk FROM tiers GROUP BY 1),
sum_ AS (SELECT q.qid, intent, v.qid IS NOT NULL AS hit, coalesce(n_linked, 0) AS n_linked, notes, coalesce(f.n, 0) AS n_facts, coalesce(n_chunks, 0) AS n_chunks, coalesce(all_, 0) - coalesce(n_chunks, 0) AS truncated, best_chunk
  FROM asked q LEFT JOIN intended USING (qid) LEFT JOIN (SELECT DISTINCT qid FROM hits WHERE visible) v USING (qid) LEFT JOIN (SELECT qid, count(DISTINCT target) AS n_linked FROM hits WHERE visible OR named GROUP BY 1) l USING (qid)
  LEFT JOIN (SELECT qid, string_agg(note, ' · ' ORDER BY note) AS notes FROM (SELECT DISTINCT qid, note FROM hits WHERE note IS NOT NULL) GROUP BY 1) t USING (qid) LEFT JOIN (SELECT qid, count(*) AS n FROM facts GROUP BY 1) f USING (qid) LEFT JOIN best USING (qid)),
paths AS (SELECT *, CASE WHEN NOT hit OR intent = 'general' THEN 'general_knowledge' WHEN intent = 'describe' THEN 'chunk' WHEN intent IS NOT NULL THEN 'graph_fact' WHEN n_facts > 0 AND n_chunks > 0 THEN 'both' WHEN n_facts > 0 THEN 'graph_fact' WHEN n_chunks > 0 THEN 'chunk' ELSE 'general_knowledge' END AS path FROM sum_)
"""
ORACLE_SQL = {
    "answers_routed": _S + "SELECT qid, intent, path, CASE WHEN NOT hit THEN coalesce(notes, 'no evidence') WHEN intent = 'general' THEN 'outside the graph' WHEN path = 'general_knowledge' THEN 'no evidence' END AS note, n_linked, n_facts, n_chunks, truncated, best_chunk FROM paths",
    "answers_routed_facts": _S + "SELECT qid, channel, layer, count(*) AS n, min(fact) AS first, max(fact) AS last FROM facts GROUP BY 1, 2, 3",
    "answers_routed_transit": _S + "SELECT qid, node_id, target, kind, note FROM hits WHERE kind IS NOT NULL",
}
