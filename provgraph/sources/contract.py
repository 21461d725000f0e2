"""Contract documents in and out as JSON, and the state of the engine: snapshots with versions and append-only logs.

A contract document is an envelope with its pieces. State lies on storage that the cluster shares; a snapshot is
written to a folder of its own and becomes current when a row of its log says so, so readers never see half of one.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PIECE = "kind string, locator string, section string, text string, fields map<string,string>, context map<string,string>, image_refs array<string>"
CONTRACT = f"doc_id string, doc_type string, revision string, path string, context map<string,string>, pieces array<struct<{PIECE.replace(' string', ':string').replace(' map', ':map').replace(' array', ':array')}>>"


def read_contracts(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Contract documents of a folder of JSON files, an object or an array of objects a file (or, not `multi_line`, an object a
    line, which a large file is split by); fields that are not there are null."""
    return spark.read.schema(CONTRACT).option("multiLine", multi_line).json(path)


def write_contracts(docs: DataFrame, path: str) -> str:
    """One JSON object a line."""
    docs.write.mode("errorifexists").json(path)
    return path


def pieces(docs: DataFrame) -> DataFrame:
    """(doc_id, doc_type, revision, pos, and a piece's fields; the context of a piece over that of its document)."""
    from ..operators.resolve import override

    rows = docs.select("doc_id", "doc_type", "revision", F.col("context").alias("outer"), F.posexplode("pieces").alias("pos", "piece"))
    return rows.select("doc_id", "doc_type", "revision", "pos", *(F.col(f"piece.{c}").alias(c) for c in ("kind", "locator", "section", "text", "fields", "image_refs")), override(F.col("outer"), F.col("piece.context")).alias("context"))


def head(cells: DataFrame, place: str, n: int = 12) -> DataFrame:
    """The rows (slides) whose place is n at most, of every document."""
    return cells.where(F.col(place) <= n)


def write_snapshot(df: DataFrame, root: str, name: str) -> int:
    """df as the next version of `name` under root."""
    spark = df.sparkSession
    version = (_log(spark, root, name).agg(F.max("version")).first()[0] or 0) + 1
    path = f"{root}/{name}/{version}-{uuid.uuid4()}"
    df.write.parquet(path)
    spark.createDataFrame([(version, path)], "version long, path string").coalesce(1).write.mode("append").parquet(f"{root}/{name}.log")
    return version


def _log(spark: SparkSession, root: str, name: str) -> DataFrame:
    return read_or(spark, f"{root}/{name}.log", spark.createDataFrame([], "version long, path string"))


def read_or(spark: SparkSession, path: str, default: DataFrame) -> DataFrame:
    """The Parquet folder, or `default` where there is none."""
    try:
        return spark.read.schema(default.schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return default


def read_snapshot(default: DataFrame, root: str, name: str) -> DataFrame:
    """The current version of `name`, or `default` before the first."""
    current = _log(default.sparkSession, root, name).agg(F.max_by("path", F.struct("version", "path"))).first()[0]  # the same of two writers' for all readers
    return default if current is None else default.sparkSession.read.parquet(current)


def append_log(rows: DataFrame, path: str) -> None:
    """Rows added to a log of lines (misses, defects, changes); nothing that is there changes."""
    rows.write.mode("append").parquet(path)


def open_layer(nodes: DataFrame, edges: DataFrame, layer: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes and live edges of a layer, and the keys of its deleted edges, which no later intake brings back."""
    own = edges.where(F.col("layer") == layer)
    return nodes.where(F.col("layer") == layer), own.where("status <> 'deleted_by_user'"), own.where("status = 'deleted_by_user'").select("src", "rel", "dst").distinct()


def catalogue(builtin: DataFrame, registered: DataFrame, key: str = "doc_type") -> DataFrame:
    """Document types, a registered one in place of a built-in one of the same name; those without a name are none."""
    both = builtin.withColumn("origin", F.lit("builtin")).unionByName(registered.withColumn("origin", F.lit("registered")), allowMissingColumns=True)
    first: Column = F.row_number().over(Window.partitionBy(key).orderBy(F.col("origin") != "registered", *(c for c in builtin.columns if c != key)))
    return both.where(F.col(key).isNotNull()).withColumn("turn", first).where("turn = 1").drop("turn")
