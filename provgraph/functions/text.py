"""Normal form, content ids and occurrence numbers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed: the white space that the normal form collapses.
SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
UNIT, NUL = "\x1f", "\x00"


def norm(x: Column | str) -> Column:
    """White space collapsed to one space and cut off at both ends; null stays null."""
    x = F.col(x) if isinstance(x, str) else x
    return F.trim(F.regexp_replace(x, SPACE, " "))


def content_id(doc: Column | str, *parts: Column) -> Column:
    """doc and twelve digits of the SHA-256 of the parts, NUL between them."""
    return F.concat_ws(":", F.col(doc).cast("string") if isinstance(doc, str) else doc, F.substring(F.sha2(F.concat_ws(NUL, *parts), 256), 1, 12))


def occurrence(df: DataFrame, doc: str, key: list[Column], order: list[str], out: str = "occ") -> DataFrame:
    """How many pieces of the same document with the same key come before, in `out`."""
    return df.withColumn(out, (F.row_number().over(Window.partitionBy(doc, *key).orderBy(*order)) - 1).cast("bigint"))


def chunk_ids(df: DataFrame, doc: str, text: str, section: Column, order: list[str]) -> DataFrame:
    """df with occ and chunk_id: what identifies a chunk is its content, not its place."""
    parts = [F.coalesce(norm(text), F.lit("")), F.coalesce(norm(section), F.lit(""))]
    return occurrence(df, doc, parts, order).withColumn("chunk_id", content_id(doc, *parts, F.col("occ").cast("string")))


def record_ids(df: DataFrame, doc: str, fields: list[str], order: list[str], strict: bool = False) -> DataFrame:
    """df with occ and record_id over fields in declared order. Joined values are normalised once more, so where one
    field ends does not count; with `strict` it does."""
    joined = F.concat_ws(UNIT, *(F.coalesce(norm(F.col(f).cast("string")), F.lit("")) for f in fields))
    key = joined if strict else norm(joined)
    return occurrence(df, doc, [key], order).withColumn("record_id", content_id(doc, key, F.col("occ").cast("string")))


def doc_hashes(pieces: DataFrame, doc: str, kind: Column, revision: Column, fields: list[str], order: str) -> DataFrame:
    """(doc, doc_hash): the pieces' contents in order; ids, paths and times do not count."""
    each = F.concat(F.concat_ws(UNIT, *(F.concat(F.lit(f"{f}="), F.coalesce(norm(F.col(f).cast("string")), F.lit(""))) for f in sorted(fields))), F.lit(NUL))
    own = pieces.groupBy(doc).agg(F.min(norm(kind)).alias("k"), F.min(norm(revision)).alias("r"), F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), each.alias("e")))).alias("p"))
    body = F.concat_ws(UNIT, F.col("k"), F.col("r"), F.array_join(F.transform("p", lambda x: x["e"]), UNIT))
    return own.select(doc, F.sha2(body, 256).alias("doc_hash"))


def duplicate_holds(hashes: DataFrame, doc: str) -> DataFrame:
    """Documents whose content an earlier document id has: (doc, doc_hash, first_doc)."""
    first = F.min(doc).over(Window.partitionBy("doc_hash"))
    return hashes.withColumn("first_doc", first).where(F.col(doc) != F.col("first_doc")).select(doc, "doc_hash", "first_doc")


def collisions(ids: DataFrame, column: str) -> DataFrame:
    """Ids that more than one row has, and in how many rows and documents."""
    return ids.groupBy(column).agg(F.count("*").alias("n")).where("n > 1")
