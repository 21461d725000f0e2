"""Contract documents as they arrive: a folder of JSON files is read to its end, batch by batch, and each batch replaces
the pieces of its documents in the state, of which it rewrites only the buckets that it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.contract import CONTRACT, pieces
from ..sources.state import BUCKETS, State, revision_key

PIECES = "doc_type string, pos int, kind string, locator string, section string, text string, fields map<string,string>, image_refs array<string>, context map<string,string>"


def latest(docs: DataFrame) -> DataFrame:
    """Of a document that comes several times in a batch the greatest revision, numbers by their value."""
    turn = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc(revision_key("revision")), F.xxhash64("path", "doc_type")))
    return docs.withColumn("turn", turn).where("turn = 1").drop("turn")


def state(root: str, buckets: int = BUCKETS) -> State:
    return State(root, "pieces", PIECES, buckets)


def replace_pieces(batch: DataFrame, root: str, number: str, buckets: int = BUCKETS) -> None:
    """The pieces of the batch's documents in place of what they had, if their revision is not older. A batch that is run
    again, under its number, gives the same state."""
    docs = latest(batch)
    state(root, buckets).merge(docs.select(F.col("doc_id").alias("doc"), "revision"), pieces(docs).withColumnRenamed("doc_id", "doc"), number)


def intake(spark: SparkSession, folder: str, root: str, files_a_batch: int = 100, buckets: int = BUCKETS) -> DataFrame:
    """All files of the folder that have not been read yet, and the pieces as they are after them."""
    stream = spark.readStream.schema(CONTRACT).option("maxFilesPerTrigger", files_a_batch).json(folder)
    query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{root}/intake").foreachBatch(lambda batch, i: replace_pieces(batch, root, str(i), buckets)).start()
    query.awaitTermination()
    return state(root, buckets).read(spark).withColumnRenamed("doc", "doc_id")
