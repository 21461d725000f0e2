"""Contract documents as they come, with fields of any type: what breaks the contract, and which documents go in.

A document is read as a VARIANT, so that a field of the wrong type is seen as such and not lost to a schema. One
defect rejects the whole document: nothing of it goes in, and the queue says why.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.parse import DITTO

#: Fixed: what an envelope must have, the kinds of payload and the bodies that go with them, and ids that only intake gives.
ENVELOPE = ("doc_id", "doc_type", "source_path", "revision", "parsed_at", "parser_version", "adapter_version", "payload_kind")
BODIES = {"table": "records", "prose": "chunks"}
IDS = ("chunk_id", "record_id", "doc_hash")


def _kind(v):
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _text(doc, path):
    """The value as a string; null where it is absent, null, or holds others."""
    v = F.try_variant_get(doc, path, "variant")
    return F.when(~_kind(v).isin("OBJECT", "ARRAY"), F.try_variant_get(doc, path, "string"))


def _pieces(doc, body):
    return F.coalesce(F.try_variant_get(doc, f"$.{body}", "array<variant>"), F.expr("cast(array() as array<variant>)"))


def documents(raw: DataFrame, column: str = "value") -> DataFrame:
    """raw with doc (a VARIANT; null for what is no JSON object), doc_id, payload_kind and the pieces of its kind's body."""
    doc = F.try_parse_json(column)
    rows = raw.withColumn("doc", F.when(_kind(doc) == "OBJECT", doc))
    kind = _text(F.col("doc"), "$.payload_kind")
    return rows.withColumns({"doc_id": _text(F.col("doc"), "$.doc_id"), "payload_kind": kind, "pieces": F.when(kind == "table", _pieces(F.col("doc"), "records")).when(kind == "prose", _pieces(F.col("doc"), "chunks"))})


def defects(docs: DataFrame, key: str) -> DataFrame:
    """(key, defect, place) of documents(), places from 1 for defects of pieces: unreadable, payload_kind, body_of_other_kind, body_empty,
    missing:<key>, context_type, locator_missing, id_given, ditto_left, text_missing, locator_repeated."""
    doc, kind = F.col("doc"), F.col("payload_kind")
    other = F.when(kind == "table", F.size(_pieces(doc, "chunks"))).when(kind == "prose", F.size(_pieces(doc, "records")))
    context = _kind(F.try_variant_get(doc, "$.context", "variant"))
    whole = [
        F.when(~F.coalesce(kind.isin(*BODIES), F.lit(False)), "payload_kind"), F.when(other > 0, "body_of_other_kind"), F.when(F.size("pieces") == 0, "body_empty"),
        *(F.when(F.coalesce(_text(doc, f"$.{k}"), F.lit("")) == "", f"missing:{k}") for k in ENVELOPE), F.when(~context.isin("OBJECT", "VOID"), "context_type"),
    ]
    said = F.when(doc.isNull(), F.array(F.lit("unreadable"))).otherwise(F.array_compact(F.array(*whole)))
    of_docs = docs.select(key, F.explode(said).alias("defect"), F.lit(0).alias("place"))
    pieces = docs.select(key, "payload_kind", F.posexplode("pieces").alias("at", "piece"))
    locator = F.trim(F.coalesce(_text(F.col("piece"), "$.source_locator"), F.lit("")))
    fields = F.map_entries(F.try_variant_get("piece", "$", "map<string,variant>"))
    ditto = F.exists(fields, lambda e: (_kind(e["value"]) == "STRING") & F.trim(F.try_variant_get(e["value"], "$", "string")).isin(*DITTO))
    given = F.exists(fields, lambda e: e["key"].isin(*IDS))
    empty = (F.col("payload_kind") == "prose") & (F.coalesce(_text(F.col("piece"), "$.text"), F.lit("")) == "") & (F.coalesce(_text(F.col("piece"), "$.image_ref"), F.lit("")) == "")
    own = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), n) for c, n in ((locator == "", "locator_missing"), (given, "id_given"), (ditto, "ditto_left"), (empty, "text_missing")))))
    of_pieces = pieces.select(key, F.explode(own).alias("defect"), (F.col("at") + 1).alias("place"))
    repeated = pieces.select(key, locator.alias("locator")).where("locator <> ''").groupBy(key, "locator").agg(F.count("*").alias("n")).where("n > 1").select(key, F.lit("locator_repeated").alias("defect"), F.lit(0).alias("place")).distinct()
    return of_docs.union(of_pieces).union(repeated)


def accept(docs: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The documents without a defect, and a queue row (kind, doc, key, detail) for each other, with its defects in order."""
    found = defects(docs, key).groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("defect")), ",").alias("detail"))
    queue = docs.join(found, key).select(F.lit("parse_failure").alias("kind"), F.col("doc_id").alias("doc"), F.col(key).cast("string").alias("key"), "detail")
    return docs.join(found.select(key), key, "left_anti"), queue
