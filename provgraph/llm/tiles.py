"""Sums of outer products of all rows, tile by tile.

Rows are packed to blocks of rows; each block is cut into column blocks of TILE dimensions. A tile's key is a pair of
column numbers. Column blocks are dealt by (row block, tile key), so that a task holds two of them at a time, whatever
the number of dimensions; products are summed as they come within a task and then by tile. Only the assembled matrix,
whose size is that of the vectors and not of the table, reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of

#: Dimensions of a column block, and bytes of a row block's values, about.
TILE, BLOCK_BYTES = 32, 1 << 20


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length, without nulls, as rows."""
    return np.asarray(column.flatten()).reshape(len(column), -1)


def packed(rows: Iterator[np.ndarray], width: int, limit: int = BLOCK_BYTES) -> Iterator[np.ndarray]:
    """Matrices joined or cut to blocks of about `limit` bytes; the last may be smaller."""
    most = max(1, limit // (8 * max(1, width)))
    held, n = [], 0
    for part in rows:
        while len(part):
            now = part[: most - n]
            held.append(now)
            n, part = n + len(now), part[len(now) :]
            if n == most:
                yield np.concatenate(held)
                held, n = [], 0
    if held:
        yield np.concatenate(held)


def products(df: DataFrame, column: str, width: int, prepare: Callable[[np.ndarray], np.ndarray], wide: int) -> np.ndarray:
    """The sum over df's rows of y y^T, where y = prepare(rows) has `wide` columns and `column` lists of `width` numbers."""
    tiles = -(-wide // TILE)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for number, block in enumerate(packed((matrix(b.column(0)) for b in batches if b.num_rows), width)):
            y = np.asarray(prepare(block), np.float64)
            for t in range(tiles):
                own = np.ascontiguousarray(y[:, t * TILE : (t + 1) * TILE])
                yield batch_of(block=[task + number], tile=pa.array([t], pa.int32()), wide=pa.array([own.shape[1]], pa.int32()), data=pa.array([own.tobytes()], pa.binary()))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, left = None, None, None

        def out():
            return batch_of(i=pa.array([key[0]], pa.int32()), j=pa.array([key[1]], pa.int32()), part=pa.array([total.ravel()], pa.list_(pa.float64())))

        for batch in batches:
            for i, j, block, side, w, data in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
                own = np.frombuffer(data).reshape(-1, w)
                if (i, j) != key:
                    if total is not None:
                        yield out()
                    key, total, left = (i, j), None, None
                if side == 0 and i != j:
                    left = (block, own)
                    continue
                assert i == j or left[0] == block
                now = (own if i == j else left[1]).T @ own
                total = now if total is None else total + now
        if total is not None:
            yield out()

    blocks = df.select(column).mapInArrow(cut, "block bigint, tile int, wide int, data binary")
    # A column block is the left one of the tiles of its row of tiles and the right one of those of its column.
    last = F.lit(tiles - 1)
    left = F.transform(F.sequence(F.col("tile"), last), lambda j: F.struct(F.col("tile").alias("i"), j.alias("j"), F.lit(0).alias("side")))
    right = F.transform(F.sequence(F.lit(0), F.col("tile")), lambda i: F.struct(i.alias("i"), F.col("tile").alias("j"), F.lit(1).alias("side")))
    both = F.concat(F.filter(left, lambda x: x["i"] != x["j"]), right)
    dealt = blocks.select("block", "wide", "data", F.explode(both).alias("key")).select("key.i", "key.j", "block", "key.side", "wide", "data")
    dealt = dealt.repartition("block", "i", "j").sortWithinPartitions("i", "j", "block", "side")

    def add(t: pa.Table) -> pa.Table:
        total = np.asarray(t["part"].combine_chunks().flatten()).reshape(t.num_rows, -1).sum(axis=0)
        return pa.table({"i": t["i"][:1], "j": t["j"][:1], "part": pa.array([total], pa.list_(pa.float64()))})

    shape = "i int, j int, part array<double>"
    parts = dealt.mapInArrow(multiply, shape).groupBy("i", "j").applyInArrow(add, shape)  # a row a task and tile goes in
    out = np.zeros((wide, wide))
    for i, j, cells in parts.toLocalIterator():
        own = np.array(cells).reshape(min(TILE, wide - i * TILE), -1)
        out[i * TILE : i * TILE + own.shape[0], j * TILE : j * TILE + own.shape[1]] = own
        out[j * TILE : j * TILE + own.shape[1], i * TILE : i * TILE + own.shape[0]] = own.T
    return out
