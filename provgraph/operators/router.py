"""The whole answer of many questions at once: links, transit, intent, walks by the rules of each layer, flow and order, the
bridge between layers, facts, chunks and the path.

What a layer declares are tables: `rules` (layer, rel, direction, recursive), `cross` (layer, rel, direction), `intents` (layer,
ord, intent, marker), `templates` (layer, key, template; keys are relations, `<relation>:derived`, `<relation>:none`,
`node:replaced` and `node:obsolete`), `skeleton` (layer, sibling). They are joined with the frontier, so one walk
serves all layers. Nodes are (id, canonical, layer, parent, polarity, status, replaced_by, merged_into), edges (src, rel, dst,
layer) without deleted ones.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm
from .answer import collect_chunks, link, misses, transit_notes
from .graph import next_of, redirects, walk
from .state import checkpoint

#: Fixed: where the answer of an intent lies.
PATHS = {"flow": "graph_fact", "order": "graph_fact", "value": "graph_fact", "reverse": "graph_fact", "structure": "graph_fact", "describe": "chunk"}
GENERAL, FLOW, ORDER = "general", "flow", "order"


@dataclass
class Layers:
    rules: DataFrame
    cross: DataFrame
    intents: DataFrame
    templates: DataFrame
    skeleton: DataFrame


def fill(template, **values):
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return template


def hops(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """(layer, node, to, on): the steps that the rules of each layer allow; `on` says whether a walk goes on from there."""
    both = edges.join(rules, ["layer", "rel"])
    out = both.where("direction in ('out', 'both')").select("layer", F.col("src").alias("node"), F.col("dst").alias("to"), F.col("recursive").alias("on"))
    return out.union(both.where("direction in ('in', 'both')").select("layer", "dst", "src", "recursive"))


def transited(linked: DataFrame, nodes: DataFrame, templates: DataFrame) -> DataFrame:
    """linked (qid, surface, node_id, layer) with target, kind (merged, replaced, obsolete or null), note, and whether it is visible."""
    merged = redirects(nodes.select("id", F.col("merged_into").alias("into")))
    ids = linked.select("qid", "node_id").distinct()
    moved = transit_notes(ids, nodes, merged).withColumnRenamed("note", "kind")
    said = templates.where("key in ('node:replaced', 'node:obsolete')").select("layer", F.split("key", ":")[1].alias("kind"), "template")
    name = lambda c, to: nodes.select(F.col("id").alias(c), F.col("canonical").alias(to))
    rows = linked.join(moved, ["qid", "node_id"]).join(said, ["layer", "kind"], "left").join(name("node_id", "old"), "node_id", "left").join(name("target", "new"), "target", "left")
    default = F.when(F.col("kind") == "replaced", "(replaced: {old})").when(F.col("kind") == "obsolete", "{old} is obsolete")
    note = fill(F.coalesce("template", default), old=F.col("old"), node=F.col("old"), new=F.col("new"))
    return rows.select("qid", "surface", "layer", "node_id", F.coalesce("target", "node_id").alias("target"), "kind", note.alias("note"), (~F.col("kind").eqNullSafe("obsolete")).alias("visible"), (norm("surface") == norm("old")).alias("named"))


def first_intent(questions: DataFrame, hits: DataFrame, intents: DataFrame) -> DataFrame:
    """(qid, intent): of the layers that a question hits, in the order of their names, the first intent in order of declaration."""
    asked = hits.select("qid", "layer").distinct().join(questions.select("qid", norm("q").alias("q")), "qid")
    found = asked.join(intents, "layer").where(F.contains("q", "marker"))
    return found.groupBy("qid").agg(F.min(F.struct("layer", "ord", "intent")).alias("i")).select("qid", F.col("i.intent").alias("intent"))


def edge_facts(reached: DataFrame, edges: DataFrame, nodes: DataFrame, templates: DataFrame) -> DataFrame:
    """(qid, layer, fact): edges of a layer with both ends among the nodes (qid, layer, node) that were reached in it."""
    said = edges.join(templates.select("layer", F.col("key").alias("rel"), "template"), ["layer", "rel"])
    own = reached.select("qid", "layer", "node").distinct()
    both = said.join(own.withColumnRenamed("node", "src"), ["layer", "src"]).join(own.withColumnRenamed("node", "dst"), ["qid", "layer", "dst"])
    return _named(both, nodes).select("qid", "layer", fill(F.col("template"), src=F.col("src_name"), dst=F.col("dst_name")).alias("fact"))


def _named(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    for end in ("src", "dst"):
        rows = rows.join(nodes.select(F.col("id").alias(end), F.col("canonical").alias(f"{end}_name")), end)
    return rows


def bridged(reached: DataFrame, edges: DataFrame, cross: DataFrame) -> DataFrame:
    """(qid, layer, node, src, rel, dst): one hop over edges of other layers whose relation these layers declare as cross, with the
    edge: from its dst to its src, or, if its dst was not reached, from its src to its dst; `layer` is the edge's."""
    over = edges.join(cross, ["layer", "rel"]).select("layer", "src", "rel", "dst", "direction")
    own = reached.select("qid", F.col("layer").alias("home"), "node").distinct()
    back = own.join(over.where("direction in ('out', 'both')").withColumn("node", F.col("dst")), "node").where("home <> layer").select("qid", "home", "layer", F.col("src").alias("node"), "src", "rel", "dst")
    on = own.join(over.where("direction in ('in', 'both')").withColumn("node", F.col("src")), "node").where("home <> layer")
    on = on.join(own.withColumnRenamed("node", "dst"), ["qid", "home", "dst"], "left_anti").select("qid", "home", "layer", F.col("dst").alias("node"), "src", "rel", "dst")
    return back.union(on).distinct()


def order_lines(asked: DataFrame, nodes: DataFrame, edges: DataFrame, layers: Layers) -> DataFrame:
    """(qid, layer, fact): what comes after each asked node (qid, layer, node) in its layer's order."""
    siblings = edges.join(layers.skeleton.select("layer", F.col("sibling").alias("rel")), ["layer", "rel"]).select("src", "dst")
    after = next_of(nodes, siblings, asked.select(F.col("node").alias("id")).distinct()).select(F.col("id").alias("node"), "next", "how", "at")
    name = lambda c: nodes.select(F.col("id").alias(c), F.col("canonical").alias(f"{c}_name"))
    rows = asked.join(after, "node").join(layers.skeleton, "layer", "left").withColumn("how", F.when(F.col("sibling").isNull(), "none").otherwise(F.col("how")))
    kind = F.when(F.col("how") == "self", "").when(F.col("how") == "none", ":none").otherwise(":derived")
    rows = rows.withColumn("key", F.concat("sibling", kind)).join(layers.templates, ["layer", "key"], "left")
    for c in ("node", "next", "at"):
        rows = rows.join(name(c), c, "left")
    default = F.when(F.col("how") == "self", "{src} → {dst}").when(F.col("how") == "none", "no order for {src}").otherwise("(by {scope}) {src} → {dst}")
    return rows.select("qid", "layer", fill(F.coalesce("template", default), src=F.col("node_name"), dst=F.col("next_name"), scope=F.col("at_name")).alias("fact"))


def flow_lines(asked: DataFrame, nodes: DataFrame, edges: DataFrame, layers: Layers) -> DataFrame:
    """(qid, layer, fact): for each (qid, layer) the whole order between concepts of the layer."""
    concepts = nodes.where("coalesce(polarity, 'none') = 'none'").select(F.col("id").alias("src"))
    rows = edges.join(layers.skeleton.select("layer", F.col("sibling").alias("rel")), ["layer", "rel"]).join(concepts, "src", "left_semi").join(layers.templates.withColumnRenamed("key", "rel"), ["layer", "rel"], "left")
    said = _named(rows, nodes).select("layer", fill(F.coalesce("template", F.lit("{src} → {dst}")), src=F.col("src_name"), dst=F.col("dst_name")).alias("fact"))
    return asked.join(said, "layer").select("qid", "layer", "fact")


def route(questions: DataFrame, dictionary: DataFrame, nodes: DataFrame, edges: DataFrame, describes: DataFrame, layers: Layers) -> dict[str, DataFrame]:
    """Answers to questions (qid, q): `answers` (qid, intent, path, note, n_linked, n_facts, n_chunks, truncated), a row for each; `facts`
    (qid, channel, layer, fact), channels flow, order, cross and edge; `chunks`; `transit` (qid, node_id, target, kind, note); `misses`."""
    hits = checkpoint(transited(link(questions, dictionary), nodes, layers.templates))
    seen = hits.where("visible").select("qid", "layer", F.col("target").alias("node")).distinct()
    intents = checkpoint(first_intent(questions, seen, layers.intents))
    seen = checkpoint(seen.join(intents, "qid", "left").where(~F.col("intent").eqNullSafe(GENERAL)))
    special = F.coalesce(F.col("intent").isin(FLOW, ORDER), F.lit(False))
    direct = seen.select("qid", "layer", "node")
    walked = checkpoint(walk(seen.where(~special).select("qid", "layer", "node"), hops(edges, layers.rules)).union(seen.where(special).select("qid", "layer", "node", F.lit(0))))
    crossing = checkpoint(bridged(walked, edges, layers.cross))
    reached = checkpoint(walked.select("qid", "layer", "node").union(crossing.select("qid", "layer", "node")).distinct())
    over = _named(crossing.join(layers.templates.withColumnRenamed("key", "rel"), ["layer", "rel"]), nodes)
    channels = {
        "flow": flow_lines(seen.where(F.col("intent") == FLOW).select("qid", "layer").distinct(), nodes, edges, layers),
        "order": order_lines(seen.where(F.col("intent") == ORDER).select("qid", "layer", "node"), nodes, edges, layers),
        "cross": over.select("qid", "layer", fill(F.col("template"), src=F.col("src_name"), dst=F.col("dst_name")).alias("fact")),
        "edge": edge_facts(reached, edges, nodes, layers.templates),
    }
    facts = None
    for channel, rows in channels.items():
        rows = rows.select("qid", F.lit(channel).alias("channel"), "layer", "fact")
        facts = rows if facts is None else facts.union(rows)
    facts = checkpoint(facts)
    levels = reached.select("qid", "node", F.lit(1).alias("level")).union(direct.select("qid", "node", F.lit(0)))
    chunks = checkpoint(collect_chunks(levels, describes))
    count = lambda df, to: df.groupBy("qid").agg(F.count("*").alias(to))
    notes = hits.where("note is not null").groupBy("qid").agg(F.array_join(F.array_sort(F.collect_set("note")), " · ").alias("notes"))
    linked = hits.where("visible or named").groupBy("qid").agg(F.countDistinct("target").alias("n_linked"))
    alive = hits.where("visible").select("qid").distinct().withColumn("hit", F.lit(True))
    found = chunks.groupBy("qid").agg(F.count("*").alias("n_chunks"), F.max("found").alias("found"), F.min(F.when(F.col("rank") == 1, F.col("chunk_id"))).alias("best_chunk"))
    out = questions.select("qid").join(intents, "qid", "left")
    for more in (linked, alive, notes, count(facts, "n_facts"), found):
        out = out.join(more, "qid", "left")
    n = {c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("n_linked", "n_facts", "n_chunks", "found")}
    by_intent = F.lit(None).cast("string")
    for intent, path in PATHS.items():
        by_intent = F.when(F.col("intent") == intent, path).otherwise(by_intent)
    by_find = F.when((n["n_facts"] > 0) & (n["n_chunks"] > 0), "both").when(n["n_facts"] > 0, "graph_fact").when(n["n_chunks"] > 0, "chunk").otherwise("general_knowledge")
    general = F.col("hit").isNull() | F.col("intent").eqNullSafe(GENERAL)
    path = F.when(general, "general_knowledge").otherwise(F.coalesce(by_intent, by_find))
    note = F.when(F.col("hit").isNull(), F.coalesce("notes", F.lit("no evidence"))).when(F.col("intent") == GENERAL, "outside the graph").when(path == "general_knowledge", "no evidence")
    answers = out.select("qid", "intent", path.alias("path"), note.alias("note"), n["n_linked"].alias("n_linked"), n["n_facts"].alias("n_facts"), n["n_chunks"].alias("n_chunks"), F.greatest(n["found"] - n["n_chunks"], F.lit(0)).alias("truncated"), "best_chunk")
    return {"answers": answers, "facts": facts, "chunks": chunks, "transit": hits.where("kind is not null").select("qid", "node_id", "target", "kind", "note"), "misses": misses(questions, hits)}
