"""What the training-data operators share: tables, checkpoints, and word arithmetic on Arrow buffers.

Words are runs of bytes other than 0x20 and 0x09-0x0D. All hashes are plain arithmetic modulo 2^64
on numpy arrays, the same on every machine and in every run.
"""

from __future__ import annotations

import contextlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
#: Text bytes that one numpy step looks at; a longer text is a step of its own.
STEP_BYTES = 4 << 20

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the folder of spark.checkpoint.dir; a temporary folder only where that is unset."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


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


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Without one a local session gets a temporary folder, a cluster an error."""
    given = spark.conf.get("spark.checkpoint.dir", "")
    if not given:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        given = tempfile.mkdtemp(prefix="provgraph-")
        spark.conf.set("spark.checkpoint.dir", given)
    return given


def free(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def texts(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The column as strings without nulls: a null counts as the empty text."""
    column = batch.column(batch.schema.get_field_index(name))
    return column.fill_null("") if column.null_count else column


def steps(batch: pa.RecordBatch, name: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts are about `limit` bytes together."""
    if not batch.num_rows:
        return
    sizes = np.cumsum(np.diff(offsets_of(texts(batch, name))))
    begin = 0
    while begin < batch.num_rows:
        base = sizes[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(sizes, base + limit, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def whole_groups(batches: Iterator[pa.RecordBatch], *keys: str, rows: int = 8192) -> Iterator[pa.Table]:
    """Batches sorted by `keys` as tables of whole groups, of about `rows` rows or one group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            part = batch.slice(i, rows)
            values = [part[k].to_numpy() for k in keys]
            other = np.flatnonzero(np.any([v != v[-1] for v in values], axis=0))
            last = int(other[-1]) + 1 if len(other) else 0
            if held and any(held[-1][k][-1].as_py() != v[0] for k, v in zip(keys, values, strict=True)):
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            if last:
                yield pa.Table.from_batches([*held, part.slice(0, last)]).combine_chunks()
                held = []
            held.append(part.slice(last))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def offsets_of(array: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else np.int32
    raw = np.frombuffer(array.buffers()[1], kind) if array.buffers()[1] else np.zeros(1, kind)
    return raw[array.offset : array.offset + len(array) + 1].astype(np.int64) if len(array) else np.zeros(1, np.int64)


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z as a-z."""
    return _LOWER[raw]


def is_space(raw: np.ndarray) -> np.ndarray:
    return _IS_SPACE[raw]


def bytes_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes in one row, and where each text begins (with the end as last)."""
    at = offsets_of(array)
    data = array.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


class Words:
    """The words of some texts: begin, end (in bytes), doc (index of the text), first (of each text's words).
    `apart` says of each byte whether it lies between words."""

    def __init__(self, array: pa.Array, lower: bool = False, apart: np.ndarray = _IS_SPACE):
        self.raw, self.at = bytes_of(array)
        if lower:
            self.raw = _LOWER[self.raw]
        n = len(self.raw)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = ~apart[self.raw]
        cut = np.zeros(n + 1, bool)
        cut[self.at] = True
        self.begin = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
        self.end = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
        self.first = np.searchsorted(self.begin, self.at)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.at) - 1), self.count)

    def __len__(self) -> int:
        return len(self.begin)

    def hashes(self, seed: int) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return hash_ranges(self.raw, self.begin, self.end, seed)

    def grams(self, hashes: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """A hash of each k consecutive words that lie in one text, and the first word's place in the row."""
        n = len(self) - k + 1
        if n <= 0:
            return np.zeros(0, U64), np.zeros(0, np.int64)
        p, total = powers(odd(seed + 11), k), np.zeros(n, U64)
        for j in range(k):
            total += hashes[j : j + n] * p[j]
        place = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        return mix(total[place]), place


def hash_ranges(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, seed: int, block: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of the bytes of each range, about `block` bytes at a time. No range may be empty."""
    out, size = np.zeros(len(begin), U64), end - begin
    if not len(begin):
        return out
    letters, total = mix(np.arange(256, dtype=U64) + U64(257 * (seed + 1))), np.cumsum(size)
    p, at = powers(odd(seed), int(size.max())), 0
    while at < len(begin):
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + block, "right")))
        start = total[at:to] - size[at:to] - base
        rank = np.arange(int(total[to - 1] - base)) - np.repeat(start, size[at:to])
        values = letters[raw[rank + np.repeat(begin[at:to], size[at:to])]] * p[rank]
        out[at:to] = np.add.reduceat(values, start)
        at = to
    return mix(out + size.astype(U64))


def odd(seed: int) -> int:
    return int(mix(np.array([seed + 0x51ED27], U64))[0]) | 1


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which each input bit moves every output bit (splitmix64's constants)."""
    x = x.astype(U64, copy=True)
    x += U64(0x9E3779B97F4A7C15)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def batch_of(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x) for x in columns.values()], names=list(columns))
