"""Numbers about the state of the graph, its queue and its answers.

Frames: `evidence` (item, doc, ordinal), where ordinal orders documents by first intake; `nodes` (id, status, ...).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed: every kind of queue row, in the order in which they are shown.
KINDS = (
    "auto_node", "uncertain_match", "orphan_anchor", "coord_mismatch", "invalid_category", "spec_conflict", "mirror_asymmetry", "evidence_lost", "unknown_field", "missing_field",
    "orphan_attach", "parse_failure", "duplicate_doc_hold", "direction_conflict", "direction_unverifiable", "orphan_chunk_link", "attach_conflict", "structural_proposal", "adapter_mismatch", "hierarchy_unresolved",
)


def rate(part: Column, whole: Column) -> Column:
    """Rows of `part` over rows of `whole`, three digits; null without any."""
    return F.round(F.count_if(part) / F.nullif(F.count_if(whole), F.lit(0)), 3)


def answer_gauges(answers: DataFrame, linkable: Column, linked: Column, truncated: Column) -> DataFrame:
    """(recall, miss_rate, truncation_rate) of answered questions; recall is over those that could be linked."""
    return answers.agg(rate(linked & linkable, linkable).alias("recall"), rate(~linked, F.lit(True)).alias("miss_rate"), rate(truncated, F.lit(True)).alias("truncation_rate"))


def plateau(evidence: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc, mentioned, new, rate): the live nodes that a document is evidence for, and those of them, no seeds, that no
    document of lesser ordinal is evidence for."""
    live = nodes.where("status <> 'merged_into'").select(F.col("id").alias("item"), (F.col("status") == "seed").alias("seed"))
    rows = evidence.select("item", "doc", "ordinal").distinct().join(live, "item")
    first = rows.groupBy("item").agg(F.min("ordinal").alias("first"))
    new = (F.col("ordinal") == F.col("first")) & ~F.col("seed")
    return rows.join(first, "item").groupBy("doc").agg(F.count("*").alias("mentioned"), F.count_if(new).alias("new"), rate(new, F.lit(True)).alias("rate"))


def hold_rate(queue: DataFrame, evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """(queue, pieces, rate): queue rows over the distinct places that nodes, edges and chunks come from."""
    places = evidence.where("locator <> 'seed'").select("locator").union(chunks.select(F.col("chunk_id").alias("locator"))).distinct()
    both = queue.select(F.lit(1).alias("q"), F.lit(0).alias("p")).union(places.select(F.lit(0), F.lit(1)))
    both = both.agg(F.coalesce(F.sum("q"), F.lit(0)).alias("queue"), F.coalesce(F.sum("p"), F.lit(0)).alias("pieces"))
    return both.select("queue", "pieces", F.round(F.col("queue") / F.nullif(F.col("pieces"), F.lit(0)), 3).alias("rate"))


def queue_view(queue: DataFrame) -> DataFrame:
    """(kind, n, known): the rows of every kind of KINDS, also of those without any, and of kinds that are none of these."""
    known = queue.sparkSession.createDataFrame([(k,) for k in KINDS], "kind string").withColumn("known", F.lit(True))
    both = queue.groupBy("kind").agg(F.count("*").alias("n")).join(known, "kind", "full_outer")
    return both.select("kind", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), F.coalesce("known", F.lit(False)).alias("known"))


def cross_sentences(edges: DataFrame, nodes: DataFrame, templates: dict[str, str]) -> DataFrame:
    """(src_layer, rel, dst_layer, sentence) for edges between layers whose relation has a template with {src} and {dst}."""
    name = lambda c: nodes.select(F.col("id").alias(c), F.col("canonical").alias(f"{c}_name"), F.col("layer").alias(f"{c}_layer"))
    rows = edges.where(F.col("rel").isin(*templates)).select("src", "rel", "dst").distinct().join(name("src"), "src").join(name("dst"), "dst").where("src_layer <> dst_layer")
    said = F.lit(None).cast("string")
    for rel, template in templates.items():
        said = F.when(F.col("rel") == rel, F.replace(F.replace(F.lit(template), F.lit("{src}"), F.col("src_name")), F.lit("{dst}"), F.col("dst_name"))).otherwise(said)
    return rows.select("src_layer", "rel", "dst_layer", said.alias("sentence"))


def doc_trace(docs: DataFrame, chunks: DataFrame, describes: DataFrame, evidence: DataFrame, queue: DataFrame) -> DataFrame:
    """(doc, chunks, linked, items, held): what a document has left: its chunks, those that describe something, the nodes and
    edges it is evidence for, and its queue rows."""
    linked = chunks.join(describes.select("chunk_id").distinct(), "chunk_id", "left_semi").groupBy("doc").agg(F.countDistinct("chunk_id").alias("linked"))
    out = docs.select("doc").distinct().join(chunks.groupBy("doc").agg(F.countDistinct("chunk_id").alias("chunks")), "doc", "left").join(linked, "doc", "left")
    out = out.join(evidence.groupBy("doc").agg(F.countDistinct("item").alias("items")), "doc", "left").join(queue.groupBy("doc").agg(F.count("*").alias("held")), "doc", "left")
    return out.select("doc", *(F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("chunks", "linked", "items", "held")))
