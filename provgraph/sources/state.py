"""State that grows by batches: rows of documents in buckets by the document's hash, of which a batch rewrites only those
it touches.

A batch is first merged and written beside the state as a whole, then noted, then put in place bucket by bucket
(dynamic partition overwrite); if that is cut short the same batch, run again, starts from what it wrote. A document
is replaced by a batch whose revision is as new or newer; an older one changes nothing, so late and repeated files do
no harm. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .contract import read_or

BUCKETS = 64


def revision_key(revision: Column | str) -> Column:
    """A string that sorts as revisions do: runs of digits by their number, the rest as text; without a revision first."""
    runs = F.regexp_extract_all(F.coalesce(F.col(revision) if isinstance(revision, str) else revision, F.lit("")), F.lit(r"(\d+|\D+)"), 1)
    number = lambda x: F.regexp_replace(x, r"^0+(?=\d)", "")
    return F.array_join(F.transform(runs, lambda x: F.when(x.rlike(r"^\d"), F.concat(F.lpad(F.length(number(x)).cast("string"), 4, "0"), number(x))).otherwise(x)), "")


class State:
    """A table of rows with the columns doc and revision, and those of `columns` (a schema string), under root."""

    def __init__(self, root: str, name: str, columns: str, buckets: int = BUCKETS):
        self.path, self.columns, self.buckets = f"{root}/{name}", columns, buckets

    def _stored(self, spark, part: str = "") -> DataFrame:
        return read_or(spark, self.path + part, spark.createDataFrame([], f"doc string, revision string, held boolean, {self.columns}, bucket int"))

    def read(self, spark) -> DataFrame:
        """The rows as they are."""
        return self._stored(spark).where("held").drop("held", "bucket")

    def revisions(self, spark) -> DataFrame:
        """(doc, revision) of every document that was taken in, those without rows too."""
        return self._stored(spark).groupBy("doc").agg(F.max_by("revision", revision_key("revision")).alias("revision"))

    def merge(self, docs: DataFrame, rows: DataFrame, batch: str, standing: Column | None = None) -> None:
        """docs (doc, revision) with their rows (doc, columns) take the place of what the documents had; of several revisions
        of a document in one batch the newest counts. Rows where `standing` holds stay besides."""
        spark = docs.sparkSession
        done = read_or(spark, f"{self.path}.batches", spark.createDataFrame([], "batch string"))
        if done.where(F.col("batch") == batch).isEmpty():
            self._prepare(docs, rows, standing)
            spark.createDataFrame([(batch,)], "batch string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}.batches")
        self._stored(spark, ".next").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)

    def _prepare(self, docs: DataFrame, rows: DataFrame, standing: Column | None) -> None:
        spark = docs.sparkSession
        bucket = F.pmod(F.xxhash64("doc"), F.lit(self.buckets)).cast("int")
        newest = docs.where("doc is not null").select("doc", "revision").groupBy("doc").agg(F.max_by("revision", revision_key("revision")).alias("revision")).withColumn("bucket", bucket)
        touched = [r[0] for r in newest.select("bucket").distinct().collect()]  # `buckets` numbers at most
        known = self._stored(spark).where(F.col("bucket").isin(touched))
        had = known.groupBy("doc").agg(F.max(revision_key("revision")).alias("had"))
        taken = newest.join(had, "doc", "left").where(F.col("had").isNull() | (F.col("had") <= revision_key("revision"))).select("doc", "revision", "bucket")
        left = known.join(taken.select("doc"), "doc", "left_anti")
        if standing is not None:
            left = left.unionByName(known.where(F.col("held") & standing).join(taken.select("doc"), "doc", "left_semi"))
        names = [f.name for f in known.schema if f.name not in ("doc", "revision", "held", "bucket")]
        # A document without rows keeps one that is not held, so that its revision is known.
        new = taken.join(rows.select("doc", F.struct(*names).alias("row")), "doc", "left").select("doc", "revision", F.col("row").isNotNull().alias("held"), *(F.col(f"row.{c}").alias(c) for c in names), "bucket")
        left.select(*known.columns).unionByName(new).repartition("bucket").write.mode("overwrite").parquet(f"{self.path}.next")
