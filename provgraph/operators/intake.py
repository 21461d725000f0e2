"""Documents into the graph's tables: locators, re-ingest, the queue, field checks, ids and checkpointed extraction.

Frames: `queue` (kind, doc, key, detail); `evidence` (item, doc, locator), where an item is a node, an edge or a value;
`chunks` (chunk_id, doc, locator). What a document leaves behind is found by its id as a column, never by a prefix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed: queue kinds that stay when their document is taken in again, and those that are computed anew as a whole.
STANDING = ("auto_node", "uncertain_match")
HEALING = ("mirror_asymmetry", "evidence_lost")
#: Fixed: the digits of an identifier, after those of conv().
ULID = r"^[0-7][0-9A-HJKMNP-TV-Z]{25}$"
CONV, CROCKFORD = "ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHJKMNPQRSTVWXYZ"


def doc_locators(envelopes: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc, locator): where a document's evidence may lie, by its new envelope or its old chunks."""
    return envelopes.select("doc", "locator").union(chunks.select("doc", "locator")).where("locator is not null").distinct()


def withdraw(docs: DataFrame, queue: DataFrame, chunks: DataFrame, evidence: DataFrame, values: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """queue, chunks, evidence and values without what the documents (doc) left: queue rows but for STANDING kinds, chunks,
    evidence, and values (item) that have lost their last evidence. Nodes and edges stay."""
    gone = docs.select("doc").distinct()
    without = lambda df: df.join(gone, "doc", "left_anti").select(*df.columns)
    kept, standing = without(evidence), F.col("kind").isin(*STANDING)
    left = values.join(kept.select("item").distinct(), "item", "left_semi").select(*values.columns)
    return queue.where(standing).union(without(queue.where(~standing))), without(chunks), kept, left


def upsert_docs(known: DataFrame, new: DataFrame) -> DataFrame:
    """Documents (doc, doc_hash, first_ingested_at, ingested_at): new ones replace known ones but for the time of first intake."""
    old = known.select("doc", F.col("doc_hash").alias("old_hash"), F.col("first_ingested_at").alias("first"), F.col("ingested_at").alias("old_at"))
    both = new.select("doc", "doc_hash", "ingested_at").join(old, "doc", "full_outer")
    return both.select("doc", F.coalesce("doc_hash", "old_hash").alias("doc_hash"), F.coalesce("first", "ingested_at").alias("first_ingested_at"), F.coalesce("ingested_at", "old_at").alias("ingested_at"))


def enqueue(queue: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("kind", "doc", "key")) -> DataFrame:
    """The queue and the new rows; a row whose key is there already is not added, and of several new ones the least detail counts."""
    fresh = new.groupBy(*keys).agg(F.min("detail").alias("detail"))
    same = [F.col(f"n.{k}").eqNullSafe(F.col(f"q.{k}")) for k in keys]
    return queue.select(*keys, "detail").union(fresh.alias("n").join(queue.alias("q"), same, "left_anti").select(*keys, "detail"))


def self_heal(queue: DataFrame, fresh: DataFrame, kinds: tuple[str, ...] = HEALING) -> DataFrame:
    """The queue with the rows of some kinds replaced by those that hold now."""
    return enqueue(queue.where(~F.col("kind").isin(*kinds)), fresh)


def shape_defects(pieces: DataFrame, key: str, fields: str, scalar: list[str], context: str) -> DataFrame:
    """(key, kind, field) of pieces whose `fields` are JSON: missing_field for a field of `scalar` that holds an object or an
    array, and for a context that is no object."""
    value = lambda f: F.trim(F.get_json_object(fields, f"$.{f}"))
    nested = [F.when(value(f).rlike(r"^[\[{]"), F.lit(f)) for f in scalar]
    whole = F.when(value(context).isNotNull() & ~value(context).startswith("{"), F.lit(context))
    return pieces.select(key, F.explode(F.array_compact(F.array(*nested, whole))).alias("field")).select(key, F.lit("missing_field").alias("kind"), "field")


def ulid(millis: Column, seed: Column) -> Column:
    """An identifier of 26 characters that sorts by time: 48 bits of milliseconds, 80 of the seed's hash."""
    digits = lambda hex_, n: F.translate(F.lpad(F.conv(hex_, 16, 32), n, "0"), CONV, CROCKFORD)
    hash_ = F.sha2(seed.cast("string"), 256)
    return F.concat(digits(F.hex(millis.cast("bigint")), 10), digits(F.substring(hash_, 1, 10), 8), digits(F.substring(hash_, 11, 10), 8))


def is_ulid(x: Column) -> Column:
    return x.rlike(ULID)


def pending(lines: DataFrame, done: DataFrame, hashes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is still to be extracted of lines (doc, locator), and the checkpoints (doc, locator, doc_hash) that hold: those of
    documents whose content is as it was."""
    valid = done.join(hashes.select("doc", "doc_hash"), ["doc", "doc_hash"], "left_semi")
    return lines.join(valid.select("doc", "locator").distinct(), ["doc", "locator"], "left_anti"), valid


def extract(lines: DataFrame, hints: DataFrame, patterns: list[tuple[str, str]], text: str = "text") -> DataFrame:
    """lines (doc, locator, text) with src, rel, dst and how: of a hint (doc, locator, src, rel, dst) if there is one, else of
    the first pattern (rel, expression with two groups) that the text matches."""
    src = rel = dst = F.lit(None).cast("string")
    for name, pattern in reversed(patterns):
        hit = F.col(text).rlike(pattern)
        src, dst = (F.when(hit, F.trim(F.regexp_extract(text, pattern, i))).otherwise(x) for i, x in ((1, src), (2, dst)))
        rel = F.when(hit, F.lit(name)).otherwise(rel)
    given = hints.select("doc", "locator", *(F.col(c).alias(f"hint_{c}") for c in ("src", "rel", "dst")))
    both = lines.join(given, ["doc", "locator"], "left")
    hinted = F.col("hint_rel").isNotNull()
    how = F.when(hinted, "hint").when(rel.isNotNull(), "rule").otherwise("none")
    ends = [F.when(hinted, F.col(f"hint_{c}")).otherwise(x).alias(c) for c, x in (("src", src), ("rel", rel), ("dst", dst))]
    return both.select(*lines.columns, *ends, how.alias("how"))
