"""The whole build of prose, many documents at once: candidates of chunks by hints, rules and the vocabulary, entities in order,
what chunks describe, relations and attachments.

Chunks are (doc, piece, chunk_id, text, ref, grp, axis), piece their order in the document. A surface in a relation stands for what the
document mentioned by it last, in this chunk or before; an attachment's target, failing that, for what the dictionary has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm
from .build import route
from .graph import gate
from .intake import extract
from .records import NAME, PROCESS_REF, RECORD, Layer, entity_names, places, resolve_in_order
from .resolve import anchors
from .state import checkpoint
from .terms import contained


def candidates(chunks: DataFrame, vocabulary: DataFrame, patterns: list[tuple[str, str]], hinted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities (doc, piece, n, surface, category) and relations (doc, piece, src, rel, dst) of chunks that have no hints (doc, piece): the first
    pattern (rel, expression) that a text matches, whose ends are entities where the vocabulary (surface, category) has them, and
    every surface of the vocabulary in the text, in its order after these."""
    own = chunks.join(hinted.select(*RECORD).distinct(), RECORD, "left_anti")
    lines = own.select("doc", F.col("piece").alias("locator"), "text")
    found = extract(lines, lines.select("doc", "locator", *(F.lit(None).cast("string").alias(c) for c in ("src", "rel", "dst"))).limit(0), patterns).where("how = 'rule'")
    relations = checkpoint(found.select("doc", F.col("locator").alias("piece"), norm("src").alias("src"), "rel", norm("dst").alias("dst")))
    words = vocabulary.select(norm("surface").alias("surface"), "category").where("surface <> ''").groupBy("surface").agg(F.min("category").alias("category"))
    texts = own.select(F.struct(*RECORD).alias("rid"), norm("text").alias("text"))
    held = contained(texts, "rid", "text", words, "surface").select("rid.*", "surface").join(words, "surface")
    ends = relations.select(*RECORD, "src", "dst")
    rank = F.when(F.col("surface") == F.col("src"), 0).when(F.col("surface") == F.col("dst"), 1).otherwise(2)
    return held.join(ends, RECORD, "left").select(*RECORD, F.struct(rank.alias("rank"), F.col("surface").alias("s")).alias("n"), "surface", "category"), relations


def _last(asked: DataFrame, mentioned: DataFrame, surface: str, out: str) -> DataFrame:
    """asked (doc, piece, ...) with the node that its document mentioned by the surface last, not after the piece. Both are rows of
    one table, sorted within a document and a surface, so what goes out is a row an asked one, however often it is mentioned."""
    none, rest = F.lit(None), [c for c in asked.columns if c not in RECORD]
    own = mentioned.where("norm is not null").select(*RECORD, F.col("norm").alias("own_norm"), "n", F.struct("node_id").alias("at"))
    ask = asked.select(*RECORD, norm(surface).alias("own_norm"), none.cast(own.schema["n"].dataType).alias("n"), none.cast(own.schema["at"].dataType).alias("at"), F.struct(*rest).alias("ask"))
    rows = own.withColumn("ask", none.cast(ask.schema["ask"].dataType)).union(ask)
    order = Window.partitionBy("doc", "own_norm").orderBy("piece", F.col("ask").isNotNull(), "n", "at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("at", F.last("at", ignorenulls=True).over(order)).where("ask is not null").select(*RECORD, "ask.*", F.col("at.node_id").alias(out))


def build(chunks: DataFrame, entities: DataFrame, relations: DataFrame, attach: DataFrame, dictionary: DataFrame, nodes: DataFrame, ancestors: DataFrame, pairs: DataFrame, patterns: DataFrame, layer: Layer) -> dict[str, DataFrame]:
    """All that entities (doc, piece, n, surface, category), relations (doc, piece, src, rel, dst) and attachments (doc, piece, surface, attach_to) give:
    `nodes`, `resolved`, `describes` (chunk_id, node_id), `edges`, `rejected`, `queue` (kind, doc, key) and `defects` (doc, piece, what, surface).
    pairs (src_cat, dst_cat, rel) say which relation an attachment is."""
    where = chunks.select(F.struct(*RECORD).alias("rid"), F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(c).alias("value")) for f, c in ((PROCESS_REF, "ref"), ("@process_group", "grp"))))).alias("f"))
    found = checkpoint(anchors(where.select(F.struct("rid", "f.field").alias("key"), "f.value"), dictionary, "key", "value", "Process"))
    at = found.where("node_id is not null").select("key.rid.*", "key.field", "node_id")
    queue = found.where("outcome = 'orphan_anchor' and key.field <> '@process_group'").select(F.lit("orphan_anchor").alias("kind"), F.col("key.rid.doc").alias("doc"), F.col("surface").alias("key")).distinct()
    place, wrong = places(at, chunks, nodes, ancestors)
    rows = entities.join(chunks.select(*RECORD, "axis"), RECORD).withColumns({"value": F.col("surface"), "target_layer": F.lit(None).cast("string"), "seq": F.struct(*RECORD, "n")}).drop("surface")
    resolved, new, more = resolve_in_order(entity_names(rows, place, layer).select(*RECORD, "n", "surface", "canonical", *NAME[1:], "seq"), dictionary, nodes, layer)
    resolved = checkpoint(resolved.withColumn("norm", norm("surface")))
    describes = resolved.join(chunks.select(*RECORD, "chunk_id"), RECORD).select("chunk_id", "node_id").distinct()
    asked = _last(_last(relations.select(*RECORD, "src", "rel", "dst").distinct(), resolved, "src", "src_id"), resolved, "dst", "dst_id")
    asked = checkpoint(asked)
    whole = F.col("src_id").isNotNull() & F.col("dst_id").isNotNull()
    defects = asked.where(~whole).select(*RECORD, F.lit("relation").alias("what"), F.concat_ws("|", "src", "rel", "dst").alias("surface"))
    category = nodes.select("id", "category").union(new.select("id", "category"))
    of = lambda c: category.select(F.col("id").alias(c), F.col("category").alias(f"{c}_cat"))
    edges = asked.where(whole).select(F.col("src_id").alias("src"), "rel", F.col("dst_id").alias("dst"), "doc")
    # A target that the document has not mentioned: the least of the dictionary, or the first that was made of the surface before.
    ties = _last(_last(attach.select(*RECORD, "surface", "attach_to").distinct(), resolved, "surface", "child"), resolved, "attach_to", "target")
    known = dictionary.groupBy(norm("surface").alias("to_norm")).agg(F.min("node_id").alias("known"))
    made = resolved.groupBy(F.col("norm").alias("to_norm")).agg(F.min(F.struct("doc", "piece", "n", "node_id")).alias("first"))
    ties = ties.withColumn("to_norm", norm("attach_to")).join(known, "to_norm", "left").join(made, "to_norm", "left")
    earlier = F.when(F.struct(F.col("first.doc"), F.col("first.piece")) <= F.struct("doc", "piece"), F.col("first.node_id"))
    ties = checkpoint(ties.withColumn("target", F.coalesce("target", "known", earlier)))
    defects = defects.union(ties.where("child is null").select(*RECORD, F.lit("attach"), F.concat_ws("|", "surface", "attach_to")))
    queue = queue.union(wrong).union(more).union(ties.where("child is not null and target is null").select(F.lit("orphan_attach"), "doc", "attach_to").distinct())
    tied = ties.where("child is not null and target is not null").join(of("target"), "target").join(of("child"), "child")
    tied = tied.join(pairs.select(F.col("src_cat").alias("target_cat"), F.col("dst_cat").alias("child_cat"), "rel"), ["target_cat", "child_cat"]).select(F.col("target").alias("src"), "rel", F.col("child").alias("dst"), "doc")
    judged = edges.union(tied).join(of("src"), "src", "left").join(of("dst"), "dst", "left").withColumn("path", F.lit("extract"))
    committed, doubt, rejected = route(checkpoint(gate(judged, patterns)))
    return {"nodes": new, "resolved": resolved.select(*RECORD, "surface", "node_id"), "describes": describes, "edges": committed, "rejected": rejected, "queue": queue.union(doubt), "defects": defects}
