"""Records and prose into nodes and edges, many documents at once.

A schema is rows (field, role, category, rel): what a field of a record is. Roles are ROLES. Mentions are rows
(doc, piece, pos, field, surface, category, layer, polarity); a dictionary is (surface, node_id, category, layer, polarity).
Equal new surfaces make one node, whichever of their documents comes first, so order does not matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm

#: Fixed: what a field can be.
ROLES = ("anchor", "entity", "attribute", "content", "meta")
NAME = ("norm", "category", "layer", "polarity")


def by_role(records: DataFrame, schema: DataFrame, keys: tuple[str, ...] = ("doc", "piece")) -> tuple[DataFrame, DataFrame]:
    """Records (keys, fields map) as (keys, field, value, role, category, rel) for each field with a value, and the fields
    whose role is none (field, role), each once."""
    valid = schema.where(F.col("role").isin(*ROLES))
    rows = records.select(*keys, F.explode("fields").alias("field", "value")).where(F.trim(F.coalesce("value", F.lit(""))) != "")
    return rows.join(valid, "field"), schema.where(~F.coalesce(F.col("role").isin(*ROLES), F.lit(False))).select("field", "role").distinct()


def resolve(mentions: DataFrame, dictionary: DataFrame, categories: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(mentions with node_id, new nodes, queue rows). A mention is the node whose surface of the same category, layer and
    polarity has its normal form (the least of several); else equal mentions are one new node, auto_node in the queue. A
    mention of an unknown category is invalid_category and no node."""
    named = mentions.withColumn("norm", norm("surface")).where("norm <> ''")
    known = dictionary.withColumn("norm", norm("surface")).groupBy(*NAME).agg(F.min("node_id").alias("old"))
    ours = F.coalesce(F.col("category").isin(*categories), F.lit(False))
    made = F.concat(F.lit("auto:"), F.substring(F.sha2(F.concat_ws("\x00", *NAME), 256), 1, 16))
    found = named.where(ours).join(known, list(NAME), "left").withColumn("node_id", F.coalesce("old", made))
    fresh = found.where("old is null")
    nodes = fresh.groupBy("node_id").agg(F.min("norm").alias("canonical"), *(F.min(c).alias(c) for c in NAME[1:])).withColumn("status", F.lit("auto"))
    queue = fresh.groupBy("node_id").agg(F.min("doc").alias("doc")).select(F.lit("auto_node").alias("kind"), "doc", F.col("node_id").alias("key"))
    invalid = named.where(~ours).select(F.lit("invalid_category").alias("kind"), "doc", F.concat_ws(":", F.coalesce("category", F.lit("")), "norm").alias("key")).distinct()
    return found.drop("old", "norm"), nodes, queue.union(invalid)


def register_surfaces(dictionary: DataFrame, resolved: DataFrame) -> DataFrame:
    """The dictionary and every surface that was resolved; what is there stays, nothing twice."""
    columns = ["surface", "node_id", "category", "layer", "polarity"]
    return dictionary.select(*columns).union(resolved.select(norm("surface").alias("surface"), *columns[1:])).dropDuplicates(columns)


def record_edges(resolved: DataFrame, declared: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """(src, rel, dst, doc): the edges that a schema declares (src_field, rel, dst_field) between the fields of one record.
    `refs` (doc, piece, node_id) are what the field @process_ref of a record stands for, on either side."""
    ends = resolved.select("doc", "piece", "field", "node_id")
    if refs is not None:
        ends = ends.union(refs.select("doc", "piece", F.lit("@process_ref"), "node_id"))
    src = ends.select("doc", "piece", F.col("field").alias("src_field"), F.col("node_id").alias("src"))
    dst = ends.select("doc", "piece", F.col("field").alias("dst_field"), F.col("node_id").alias("dst"))
    return src.join(declared, "src_field").join(dst, ["doc", "piece", "dst_field"]).where("src <> dst").select("src", "rel", "dst", "doc").distinct()


def attachments(resolved: DataFrame, schema: DataFrame) -> DataFrame:
    """(doc, piece, src, rel, dst): entities whose field is attached to another field (schema: field, attach_to, rel) of the record."""
    child = resolved.join(schema.where("attach_to is not null").select("field", "attach_to", "rel"), "field")
    target = resolved.select("doc", "piece", F.col("field").alias("attach_to"), F.col("node_id").alias("dst"))
    return child.select("doc", "piece", F.col("node_id").alias("src"), "rel", "attach_to").join(target, ["doc", "piece", "attach_to"]).select("doc", "piece", "src", "rel", "dst").distinct()


def describes(resolved: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk_id, node_id): a chunk (doc, locator, chunk_id) describes what its place mentions."""
    return resolved.select("doc", "locator", "node_id").join(chunks.select("doc", "locator", "chunk_id"), ["doc", "locator"]).select("chunk_id", "node_id").distinct()


def prose_edges(relations: DataFrame, resolved: DataFrame, dictionary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Relations (doc, pos, src_surface, rel, dst_surface) between nodes, and those with an end that is not resolved.
    A surface stands for what the document last mentioned by it; if nothing, for the least node of the dictionary."""
    buffer = resolved.groupBy("doc", norm("surface").alias("norm")).agg(F.max_by("node_id", F.struct("pos", "node_id")).alias("own"))
    first = dictionary.groupBy(norm("surface").alias("norm")).agg(F.min("node_id").alias("any"))
    rows = relations
    for end in ("src", "dst"):
        rows = rows.withColumn("norm", norm(f"{end}_surface")).join(buffer, ["doc", "norm"], "left").join(first, "norm", "left")
        rows = rows.withColumn(end, F.coalesce("own", "any")).drop("norm", "own", "any")
    whole = F.col("src").isNotNull() & F.col("dst").isNotNull()
    return rows.where(whole & (F.col("src") != F.col("dst"))).select("src", "rel", "dst", "doc").distinct(), rows.where(~whole).select("doc", "pos", "src_surface", "rel", "dst_surface")


def pair_relation(pairs: DataFrame, categories: DataFrame) -> DataFrame:
    """(src, rel, dst, doc) for pairs (src, src_cat, dst, dst_cat, doc) by the relation that is declared for two categories."""
    return pairs.join(categories, ["src_cat", "dst_cat"]).select("src", "rel", "dst", "doc").distinct()


def route(judged: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges with a verdict (src, rel, dst, doc, verdict) as: committed, with status auto; queue rows for directions that are
    in doubt; counts of what was rejected, by verdict."""
    committed = judged.where("verdict = 'commit'").groupBy("src", "rel", "dst").agg(F.collect_set("doc").alias("docs")).withColumn("status", F.lit("auto"))
    doubt = judged.where("verdict in ('direction_conflict', 'direction_unverifiable')")
    queue = doubt.select(F.col("verdict").alias("kind"), "doc", F.concat_ws("|", "src", "rel", "dst").alias("key")).distinct()
    rejected = judged.where("verdict not in ('commit', 'direction_conflict', 'direction_unverifiable')").groupBy("verdict").agg(F.count("*").alias("n"))
    return committed, queue, rejected
