"""Cutting lineage in the cluster's shared folder."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Without one a local session gets a temporary folder, a cluster an error."""
    given = spark.conf.get("spark.checkpoint.dir", "")
    if not given:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        given = tempfile.mkdtemp(prefix="provgraph-")
        spark.conf.set("spark.checkpoint.dir", given)
    return given


def checkpoint(df: DataFrame) -> DataFrame:
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As checkpoint, but written as Parquet, for frames that are joined with themselves round by round. A checkpoint keeps the planner's guess
    at its size, which for a join is the product of both sides: its digits double each round, until the driver has no room
    for the number. A file has its own size."""
    path = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Frames that are built inside have their shuffles removed when a query on them ends; each is to be run once or checkpointed."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def free(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name
