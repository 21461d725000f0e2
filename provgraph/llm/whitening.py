"""Embedding whitening by a tiled covariance of the distinct vectors.

Components c of the vectors become whole numbers x = floor(64 c) + 1000000. The fit list has each distinct vector x once; its
sums S are exact. The covariance is summed tile by tile over the fit list (`tiles`), of rows centred before they are
multiplied, assembled and eigendecomposed on the driver: a matrix of the vectors' length, whatever the number of rows.
Rows are whitened where they lie. The whitened vectors' own covariance over the fit list is measured in the same way.

Defined results: rows with a null vector, one without components, or one with a null or non-finite component are left
out; a null id stays; rows that repeat an id or a vector get a result each, and a vector counts once in the fit list;
two lengths of vectors, or a component of 2^53 or more, raise an error; a component along which the fit list does not
vary (one distinct vector, or fewer than dimensions) has a null `whitened` and no part in `identity_error`; `explained`
is null where nothing varies; an empty table gives an empty one. Only the id and the vector are read, so other columns,
of any name, do not clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, checkpoint, table
from .tiles import matrix, products

SCALE, SHIFT = 64, 1_000_000
OUT = "component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"


def finite(vector) -> F.Column:
    """Whether a vector is there with components that are all finite."""
    return F.coalesce(F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))


def whole(df: DataFrame, key: str, vector: str, scale: int, shift: int = 0, **more: F.Column) -> DataFrame:
    """(id, more, x): the rows with finite vectors of a component or more, components as floor(scale * c) + shift."""
    v = F.col(vector).cast("array<double>")
    big = F.exists("v", lambda c: F.abs(c) >= float(2**53))
    x = F.when(big, F.raise_error(F.lit("a component of 2^53 or more"))).otherwise(F.transform("v", lambda c: F.floor(c * scale) + F.lit(shift).cast("bigint")))
    return df.select(F.col(key).alias("id"), *(c.alias(k) for k, c in more.items()), v.alias("v")).where(finite(F.col("v")) & (F.size("v") > 0)).select("id", *more, x.cast("array<bigint>").alias("x"))


def width_of(rows: DataFrame, column: str = "x") -> int | None:
    """The vectors' length; None without rows."""
    low, high = rows.agg(F.min(F.size(column)), F.max(F.size(column))).first()
    if low != high:
        raise ValueError("vectors of different lengths")
    return low


def _sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """Rows of the fit list and its exact sum in each dimension."""

    def add(batches):
        n, total = 0, [0] * width
        for batch in batches:
            for i in range(0, batch.num_rows, 512):  # 512 numbers below 2^60 could pass 2^63, so they are added in halves
                x = matrix(batch.column(0).slice(i, 512))
                high, low = (x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist()
                total = [t + (h << 32) + v for t, h, v in zip(total, high, low, strict=True)]
                n += len(x)
        if n:
            yield batch_of(n=[n] * width, at=pa.array(range(width), pa.int32()), s=pa.array(list(map(str, total)), pa.string()))

    parts = fit.select("x").mapInArrow(add, "n bigint, at int, s string")
    found = {r["at"]: (r["n"], int(r["s"])) for r in parts.groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}
    return found[0][0], [found[i][1] for i in range(width)]


class Centre:
    """The fit list's mean S / n, exactly."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.whole, self.rest = np.array([s // n for s in sums]), np.array([s % n for s in sums])

    def off(self, x: np.ndarray) -> np.ndarray:
        """x - S / n."""
        return (x - self.whole) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> pa.Array:
        """The exact sum of (n x - S)^2 of each row; null where 38 digits do not hold it."""
        d = x - self.whole
        most = (int(np.abs(d).max(initial=0)) + 1) * self.n
        if most * most * x.shape[1] < 2**63:
            d = d * self.n - self.rest
            return pa.array((d * d).sum(axis=1)).cast(pa.decimal128(38, 0))
        n, rest = self.n, self.rest.tolist()
        exact = [sum((n * v - r) ** 2 for v, r in zip(row, rest, strict=True)) for row in d.tolist()]
        return pa.array([str(e) if e < 10**38 else None for e in exact], pa.string()).cast(pa.decimal128(38, 0))


def _directions(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a covariance the shares of the trace of its `most` first eigenvalues, and their directions over sqrt(eigenvalue);
    NaN without variance."""
    values, vectors = np.linalg.eigh((v + v.T) / 2)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    flat = values <= len(v) * np.finfo(float).eps * max(values.max(initial=0), 0)
    trace = float(np.trace(v))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.maximum(values, 0) / trace if trace > 0 else np.full(len(values), np.nan), np.where(flat, np.nan, vectors / np.sqrt(values))


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 16, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row for each row with a finite vector and each
    of the first components, as the module says."""
    rows = whole(df, key, vector, scale, shift)
    kind = rows.schema["id"].dataType.simpleString()
    fit = checkpoint(rows.select("x").distinct())
    width = width_of(fit)
    if width is None:
        return rows.select(F.col("id").alias(key), *(F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in OUT.split(", "))).where("false")
    n, sums = _sums(fit, width)
    centre = Centre(n, sums)
    share, turn = _directions(products(fit, "x", width, centre.off, width) / n, components)
    varied = ~np.isnan(turn[0])
    error = None
    if varied.any():
        kept = turn[:, varied]
        error = float(np.abs(products(fit, "x", width, lambda x: centre.off(x) @ kept, kept.shape[1]) / n - np.eye(kept.shape[1])).max())
    k = len(share)

    def out(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                x = matrix(part.column(1))
                again = pa.array(np.repeat(np.arange(len(x)), k))
                yield batch_of(
                    id=part.column(0).take(again), component=pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), n=np.full(len(x) * k, n), deviation=centre.deviations(x).take(again),
                    whitened=pa.array((centre.off(x) @ turn).ravel(), from_pandas=True), explained=pa.array(np.tile(share, len(x)), from_pandas=True), identity_error=pa.array([error] * (len(x) * k), pa.float64()),
                )

    return rows.mapInArrow(out, f"id {kind}, {OUT}").withColumnRenamed("id", key)


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    found = whiten(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
