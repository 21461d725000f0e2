"""The corpus pipeline: documents in, packed training sequences out.

Each stage works on all rows that its predecessor kept and returns the columns of documents; the last one
returns the packed pieces. Rows with a null doc_id pass the deduplicating stages unchanged. Rows that repeat a
doc_id are one document where documents are compared, and each goes on with its own text; a null text is empty.
An empty table gives an empty one at every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provgraph.llm import jaccard, lines, packing, pii, toxicity
from provgraph.llm.common import shared_dir, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Two documents are near duplicates if they share this many of 100 shingles of five words.
WORDS, SIMILAR = 5, 80


def _documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not call toxic; rows that repeat a key are scored each by its own text."""
    chain = toxicity.chain_of(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), chain).where("not toxicity.is_toxic").select(*COLUMNS)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document has; rows that repeat a key do not count as earlier for each other."""
    return _documents(lines.dedup_lines(docs, carry=("lang", "source")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of least doc_id, with all rows of that key. Texts without words are no
    duplicates."""
    groups = jaccard.similar(docs, k=WORDS, p=SIMILAR, q=100)
    gone = groups.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data, and terms that disclose it, replaced or removed; equal texts get equal results."""
    return _documents(pii.sanitise(docs.select(*COLUMNS)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents and their places in sequences of at most 4096 tokens; each row has pieces of its own."""
    return packing.packed_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_shared_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("PII", hide_personal_data),
    ("best-fit packing", pack_sequences),
]
ORACLE_SQL = None  # a trained classifier is no SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4()}"
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
