"""Looking at what is there: nodes, chunks, schemas, the tree, and counts for review."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .terms import contained

#: Fixed: chunks that are shown of a document, aliases that are shown of a node.
CHUNKS, ALIASES = 20, 3


def node_detail(wanted: DataFrame, nodes: DataFrame, dictionary: DataFrame, edges: DataFrame) -> DataFrame:
    """(wanted, id, canonical, category, status, how, out_edges, in_edges) for names (wanted): nodes of that canonical name, else
    of that alias, else, as candidates, those whose name holds it."""
    name = nodes.select("id", "canonical", "category", "status")
    exact = wanted.join(name, F.col("wanted") == F.col("canonical")).withColumn("how", F.lit("canonical"))
    alias = wanted.join(dictionary.select(F.col("surface").alias("wanted"), F.col("node_id").alias("id")).distinct(), "wanted").join(name, "id").select("wanted", "id", "canonical", "category", "status", F.lit("alias").alias("how"))
    found = exact.unionByName(alias.join(exact.select("wanted").distinct(), "wanted", "left_anti"))
    rest = wanted.join(found.select("wanted").distinct(), "wanted", "left_anti")
    holding = contained(name.select("id", "canonical"), "id", "canonical", rest, "wanted")
    found = found.unionByName(holding.join(name, "id").withColumn("how", F.lit("candidate")))
    counts = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_edges")).join(edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_edges")), "id", "full_outer")
    zero = F.lit(0).cast("bigint")
    return found.join(counts, "id", "left").select("wanted", "id", "canonical", "category", "status", "how", F.coalesce("out_edges", zero).alias("out_edges"), F.coalesce("in_edges", zero).alias("in_edges"))


def chunk_detail(chunks: DataFrame, describes: DataFrame, nodes: DataFrame, limit: int = CHUNKS) -> DataFrame:
    """(doc, chunk_id, linked): a document's first chunks by id, with the names of what they describe, in order."""
    turn = F.row_number().over(Window.partitionBy("doc").orderBy("chunk_id"))
    first = chunks.select("doc", "chunk_id").withColumn("turn", turn).where(F.col("turn") <= limit).drop("turn")
    names = describes.join(nodes.select(F.col("id").alias("node"), "canonical"), "node")
    return first.join(names, "chunk_id", "left").groupBy("doc", "chunk_id").agg(F.array_join(F.array_sort(F.collect_set("canonical")), " | ").alias("linked"))


def tree(nodes: DataFrame, ancestors: DataFrame, precedes: DataFrame, aliases: DataFrame) -> DataFrame:
    """(path, id, depth, tier, axis, aliases, next): seeds in the order of their path of names, with what stands beside them."""
    seeds = nodes.where("status = 'seed'")
    names = ancestors.join(seeds.select(F.col("id").alias("ancestor"), "canonical"), "ancestor").groupBy(F.col("node").alias("id"))
    path = names.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("d"), "canonical"))), lambda x: x["canonical"]), "/").alias("path"), F.max("depth").cast("int").alias("depth"))
    known = aliases.groupBy("id").agg(F.array_join(F.slice(F.array_sort(F.collect_set("alias")), 1, ALIASES), ", ").alias("aliases"))
    after = precedes.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("next"))
    return seeds.join(path, "id").join(known, "id", "left").join(after, "id", "left").select("path", "id", "depth", "tier", F.col("polarity").alias("axis"), F.coalesce("aliases", F.lit("")).alias("aliases"), "next").orderBy("path", "id")


def schema_roles(schemas: DataFrame) -> DataFrame:
    """(doc_type, place, field, role, target): the fields of schemas (doc_type, fields: array of field, role, category, target_layer)."""
    rows = schemas.select("doc_type", F.posexplode("fields").alias("place", "f"))
    return rows.select("doc_type", "place", "f.field", "f.role", F.concat_ws("/", "f.category", "f.target_layer").alias("target"))


def unmappable(headers: DataFrame, roles: DataFrame) -> DataFrame:
    """(doc_type, col, label): header labels (doc_type, col, label) whose column no field uses, or that a schema says is none."""
    return headers.join(roles.where("role <> 'unmappable'").select("doc_type", "col").distinct(), ["doc_type", "col"], "left_anti").select("doc_type", "col", "label")


def review_stats(pieces: DataFrame, doc: str, section: str, text: str) -> DataFrame:
    """(doc, pieces, blank, deepest): a document's pieces, those without text, and how deep its sections go."""
    blank = F.trim(F.coalesce(F.col(text), F.lit(""))) == ""
    depth = F.when(F.coalesce(F.col(section), F.lit("")) == "", 0).otherwise(F.size(F.split(F.col(section), " > ")))
    return pieces.groupBy(doc).agg(F.count("*").alias("pieces"), F.count_if(blank).alias("blank"), F.max(depth).alias("deepest"))


def anomalies(samples: DataFrame, failures: DataFrame, unmapped: DataFrame) -> DataFrame:
    """(doc_type, samples, failures, warnings, questions): of each type of samples (doc_type, doc) what a review must show: failures (doc, reason), each
    of them; a warning where there is one sample only, which proves no pattern; and a question for each column that no role
    was found for (doc_type, field)."""
    own = samples.select("doc_type", "doc").distinct()
    out = own.groupBy("doc_type").agg(F.count("*").alias("samples"))
    failed = failures.join(own, "doc").groupBy("doc_type").agg(F.count("*").alias("failures"))
    asked = unmapped.select("doc_type", "field").distinct().groupBy("doc_type").agg(F.count("*").alias("questions"))
    out = out.join(failed, "doc_type", "left").join(asked, "doc_type", "left")
    zero = F.lit(0).cast("bigint")
    return out.select("doc_type", "samples", F.coalesce("failures", zero).alias("failures"), (F.col("samples") < 2).cast("bigint").alias("warnings"), F.coalesce("questions", zero).alias("questions"))


def over_threshold(slides: DataFrame, doc: str, chars: int, shapes: int) -> DataFrame:
    """(doc, slides, over): a deck's slides (chars, shapes), and how many are over one of the limits."""
    over = (F.col("chars") > chars) | (F.col("shapes") > shapes)
    return slides.groupBy(doc).agg(F.count("*").alias("slides"), F.count_if(over).alias("over"))


def platform_counts(nodes: DataFrame, docs: DataFrame, ops: DataFrame) -> DataFrame:
    """(what, name, n): nodes by status, documents by type, changes by kind."""
    rows = nodes.groupBy(F.lit("node").alias("what"), F.col("status").alias("name")).agg(F.count("*").alias("n"))
    return rows.union(docs.groupBy(F.lit("document"), "doc_type").agg(F.count("*"))).union(ops.groupBy(F.lit("change"), "op").agg(F.count("*")))


def contract_sample(docs: DataFrame, doc_type: str = "doc_type") -> DataFrame:
    """(doc_type, n, sample): of each type how many documents there are, and the least one's id as an example."""
    return docs.groupBy(doc_type).agg(F.count("*").alias("n"), F.min("doc_id").alias("sample"))
