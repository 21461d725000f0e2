"""Questions to answers: links, intents, facts, chunks and the path of each answer, many questions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm
from .graph import redirects
from .state import checkpoint
from .terms import contained

COLLECT = 8


def link(questions: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(qid, surface, node_id, layer): the longest surfaces in a question, those that lie in a longer one left out; both sides
    in their normal form."""
    questions, dictionary = questions.withColumn("q", norm("q")), dictionary.withColumn("surface", norm("surface")).where("surface <> ''")
    found = contained(questions, "qid", "q", dictionary, "surface")
    longer = found.groupBy("qid").agg(F.collect_set("surface").alias("all"))
    inside = F.exists("all", lambda o: (o != F.col("surface")) & F.contains(o, F.col("surface")))
    kept = found.join(longer, "qid").where(~inside).select("qid", "surface")
    return kept.join(dictionary.select("surface", "node_id", "layer").distinct(), "surface").select("qid", "surface", "node_id", "layer").distinct()


def intent(q: Column, intents: list[tuple[str, str, str]]) -> Column:
    """The first intent, in order of declaration, whose marker the question holds."""
    out = F.lit("none")
    for name, marker, _ in reversed(intents):
        out = F.when(F.contains(q, F.lit(marker)), name).otherwise(out)
    return out


def path(linked: Column, name: Column, facts: Column, chunks: Column, intents: list[tuple[str, str, str]]) -> Column:
    """general_knowledge without a link; else what the intent says; without an intent what was found."""
    found = F.when(facts & chunks, "both").when(chunks, "chunk").when(facts, "graph_fact").otherwise("general_knowledge")
    for i, _, p in reversed(intents):
        found = F.when(name == i, p).otherwise(found)
    return F.when(~linked, "general_knowledge").otherwise(found)


def facts(walked: DataFrame, edges: DataFrame, nodes: DataFrame, templates: dict[str, str]) -> DataFrame:
    """(qid, rel, fact): edges of a template with both ends reached, as sentences."""
    name = lambda c: nodes.select(F.col("id").alias(c), F.col("canonical").alias(f"{c}_name"))
    some = edges.where(F.col("rel").isin(*templates))
    both = some.join(walked.select("qid", F.col("node").alias("src")), "src").join(walked.select("qid", F.col("node").alias("dst")), ["qid", "dst"])
    both = both.join(name("src"), "src").join(name("dst"), "dst")
    said = F.lit(None).cast("string")
    for rel, template in templates.items():
        said = F.when(F.col("rel") == rel, F.replace(F.replace(F.lit(template), F.lit("{src}"), F.col("src_name")), F.lit("{dst}"), F.col("dst_name"))).otherwise(said)
    return both.select("qid", "rel", said.alias("fact"))


def bridge(walked: DataFrame, cross: DataFrame) -> DataFrame:
    """(qid, node, via): one hop over edges between layers, either way; via is the node that the hop began at."""
    ends = cross.select("src", "dst").distinct()
    both = ends.select(F.col("src").alias("via"), F.col("dst").alias("to")).union(ends.select(F.col("dst").alias("via"), F.col("src").alias("to")))
    hops = walked.select("qid", F.col("node").alias("via")).join(both, "via").select("qid", F.col("to").alias("node"), "via")
    return hops.join(walked.select("qid", "node"), ["qid", "node"], "left_anti")


def collect_chunks(walked: DataFrame, describes: DataFrame, limit: int = COLLECT) -> DataFrame:
    """(qid, chunk_id, tier, rank, found): direct evidence before that of expanded nodes; the best `limit`, and how many there
    were. Of a node's chunks only the first `limit` can be among the best, so no more of them meet the walks; chunks of one
    node are counted by node, and only those of several are listed to be counted once."""
    pairs = describes.select("node", "chunk_id").distinct()
    several = pairs.groupBy("chunk_id").agg(F.count("*").alias("n")).where("n > 1").select("chunk_id")
    of_many = pairs.join(several, "chunk_id", "left_semi")
    first = pairs.withColumn("turn", F.row_number().over(Window.partitionBy("node").orderBy("chunk_id"))).where(F.col("turn") <= limit)
    walked = checkpoint(walked.groupBy("qid", "node").agg(F.min(F.least("level", F.lit(1)) + 1).cast("int").alias("tier")))
    best = walked.join(first.select("node", "chunk_id"), "node").groupBy("qid", "chunk_id").agg(F.min("tier").alias("tier"))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("tier", "chunk_id"))).where(F.col("rank") <= limit)
    own = pairs.groupBy("node").agg(F.count("*").alias("n")).join(of_many.groupBy("node").agg(F.count("*").alias("shared")), "node", "left")
    alone = walked.join(own, "node").groupBy("qid").agg(F.sum(F.col("n") - F.coalesce("shared", F.lit(0))).alias("alone"))
    shared = walked.join(of_many, "node").groupBy("qid").agg(F.countDistinct("chunk_id").alias("together"))
    out = best.join(alone, "qid").join(shared, "qid", "left")
    return out.select("qid", "chunk_id", "tier", "rank", (F.col("alone") + F.coalesce("together", F.lit(0))).alias("found"))


def attribute_facts(walked: DataFrame, values: DataFrame, nodes: DataFrame, template: str) -> DataFrame:
    """(qid, node, attr, context_key, fact): the values (node, attr, context map, value) of nodes that a question reached, a line
    for each context, which stands before it as [k=v, ...] in the order of keys. Null values are left out."""
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries("context")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")
    own = values.where("value is not null").withColumn("context_key", F.coalesce(pairs, F.lit("")))
    own = own.join(walked.select("qid", "node").distinct(), "node").join(nodes.select(F.col("id").alias("node"), "canonical"), "node")
    said = F.replace(F.replace(F.replace(F.lit(template), F.lit("{node}"), F.col("canonical")), F.lit("{attr}"), F.col("attr")), F.lit("{value}"), F.col("value").cast("string"))
    prefix = F.when(F.col("context_key") != "", F.concat(F.lit("["), "context_key", F.lit("] "))).otherwise("")
    return own.select("qid", "node", "attr", "context_key", F.concat(prefix, said).alias("fact"))


def order_facts(asked: DataFrame, following: DataFrame, nodes: DataFrame, own: str, derived: str, none: str) -> DataFrame:
    """(qid, node, how, fact): what comes after each asked node (qid, node) by `following` (id, next, how, at): a line of its own
    order, of one derived from an ancestor ({scope}), or that there is none. Templates have {src}, {dst} and {scope}."""
    name = lambda c: nodes.select(F.col("id").alias(c), F.col("canonical").alias(f"{c}_name"))
    rows = asked.join(following.select(F.col("id").alias("node"), "next", "how", "at"), "node").join(name("node"), "node").join(name("next"), "next", "left").join(name("at"), "at", "left")
    template = F.when(F.col("how") == "self", own).when(F.col("how") == "none", none).otherwise(derived)
    for mark, column in (("{src}", "node_name"), ("{dst}", "next_name"), ("{scope}", "at_name")):
        template = F.replace(template, F.lit(mark), F.coalesce(column, F.lit("")))
    return rows.select("qid", "node", "how", template.alias("fact"))


def transit_notes(linked: DataFrame, nodes: DataFrame, merged: DataFrame) -> DataFrame:
    """(qid, node_id, target, note): linked nodes (qid, node_id) as they are now: a merged one, by `merged` (id, target), is its
    survivor, noted as merged; an obsolete one with a replacement is what the chain of replacements ends at, noted as
    replaced; an obsolete one without is hidden (no target), noted as obsolete. Nodes are (id, status, replaced_by)."""
    last = redirects(nodes.select("id", F.col("replaced_by").alias("into"))).select(F.col("id").alias("node_id"), F.col("target").alias("last"))
    rows = linked.join(merged.select(F.col("id").alias("node_id"), F.col("target").alias("survivor")), "node_id", "left").join(nodes.select(F.col("id").alias("node_id"), "status"), "node_id", "left").join(last, "node_id", "left")
    gone = F.col("status") == "obsolete"
    note = F.when(F.col("survivor").isNotNull(), "merged").when(gone & F.col("last").isNotNull(), "replaced").when(gone, "obsolete")
    target = F.when(F.col("survivor").isNotNull(), F.col("survivor")).when(gone, F.col("last")).otherwise(F.col("node_id"))
    return rows.select("qid", "node_id", target.alias("target"), note.alias("note"))


def misses(questions: DataFrame, linked: DataFrame) -> DataFrame:
    """Rows for the log of questions that link to nothing."""
    return questions.join(linked.select("qid").distinct(), "qid", "left_anti").select("qid", "q", F.lit("miss").alias("kind"))
