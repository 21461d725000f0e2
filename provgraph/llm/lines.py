"""Line dedup: a line that many documents share stays in the first of them only.

Distinct lines are known by 128-bit hashes. A sharded minimal perfect hash gives each distinct line a
place in its shard's arrays (fingerprint, number of documents, first document). Blocks of documents then
ask each shard for their own distinct lines at once, without their occurrences, and get back which are
shared and the first document of each. Occurrences are judged within their block: no row per line is joined,
and a line that a third of all documents hold costs a shard one entry a block, however often it occurs.

Defined results: a null or empty text is one empty line; lines shorter than `min_chars` code points after
stripping stay; rows with a null key stay whole and make no other line go; rows that repeat a key are one
document (each such row loses the same lines if the texts are equal, and each is judged by its own text if
not); an empty table gives an empty one. Only the key and the text are read, so other columns, of any name,
do not clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, batch_of, bytes_of, checkpoint, hash_ranges, is_space, lowered, mix, signed, steps, table, texts

#: Distinct lines of a shard, about, and lines that blocks ask it for.
SHARD_LINES, SHARD_ASKED = 250_000, 1_000_000
LEVELS = 48


def line_keys(array: pa.Array, min_chars: int):
    """Of each text: number of lines; of each line of `min_chars` stripped code points or more: text, line, two hashes."""
    raw, at = bytes_of(array)
    breaks = np.flatnonzero(raw == 0x0A)
    owner = np.searchsorted(at, breaks, "right") - 1
    count = np.bincount(owner, minlength=len(at) - 1) + 1
    begin = np.sort(np.concatenate([at[:-1], breaks + 1]), kind="stable")
    first = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(count)), count)
    end = np.append(begin[1:] - 1, at[-1])
    end[first[1:] - 1] = at[1:]
    solid = np.flatnonzero(~is_space(raw))
    left, right = np.searchsorted(solid, begin), np.searchsorted(solid, end)
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    some = np.flatnonzero(right > left)
    begin, end = solid[left[some]], solid[right[some] - 1] + 1
    long = chars[end] - chars[begin] >= min_chars
    some, begin, end = some[long], begin[long], end[long]
    small = lowered(raw)
    return count, doc[some], some - first[doc[some]], hash_ranges(small, begin, end, 1), hash_ranges(small, begin, end, 2)


class PerfectHash:
    """A minimal perfect hash: on each level the keys that meet no other in a bit array twice as long are placed."""

    def __init__(self, sizes: list[int], words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.rank = np.concatenate([[0], np.cumsum(np.bitwise_count(words))]).astype(np.int64)

    @classmethod
    def build(cls, one: np.ndarray, two: np.ndarray) -> PerfectHash:
        sizes, parts = [], []
        while len(one):
            if len(sizes) == LEVELS:
                raise ValueError("two lines have one key")
            size = -(-max(64, 2 * len(one)) // 64) * 64
            spot = cls._spot(one, two, len(sizes), size)
            met = np.bincount(spot, minlength=size)
            parts.append(np.packbits(met == 1, bitorder="little").view(U64))
            sizes.append(size)
            left = met[spot] > 1
            one, two = one[left], two[left]
        return cls(sizes, np.concatenate(parts) if parts else np.zeros(0, U64))

    @staticmethod
    def _spot(one, two, level, size):
        return (mix(one ^ mix(two + U64(level + 1))) % U64(size)).astype(np.int64)

    def places(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Each key's place; a key that was not built in has any place or -1."""
        out, left, base = np.full(len(one), -1, np.int64), np.arange(len(one)), 0
        for level, size in enumerate(self.sizes):
            spot = base + self._spot(one[left], two[left], level, size)
            word, bit = spot >> 6, (spot & 63).astype(U64)
            hit = (self.words[word] >> bit & U64(1)).astype(bool)
            word, bit = word[hit], bit[hit]
            out[left[hit]] = self.rank[word] + np.bitwise_count(self.words[word] & ((U64(1) << bit) - U64(1)))
            left, base = left[~hit], base + size
            if not len(left):
                break
        return out


def _fingerprint(one, two):
    return (mix(two ^ mix(one)) >> U64(32)).astype(np.uint32)


def _blocks(docs: DataFrame, min_chars: int) -> DataFrame:
    """A row per block of documents: its long lines (document, text's hash, line number, hashes), packed."""

    def run(batches):
        n, task = 0, TaskContext.get().partitionId()
        for batch in batches:
            for part in steps(batch):
                part = part.filter(part.column(0).is_valid()) if part.column(0).null_count else part
                _, doc, line, one, two = line_keys(texts(part), min_chars)
                if not len(doc):
                    continue
                ids, kind = part.column(0).to_numpy()[doc], part.column(1).to_numpy()[doc]
                packed = [x.tobytes() for x in (ids, kind, line.astype(np.int32), one, two)]
                yield batch_of(block=[f"{task}-{n}"], **{k: pa.array([v], pa.binary()) for k, v in zip(("ids", "kinds", "lines", "one", "two"), packed, strict=True)})
                n += 1

    return docs.mapInArrow(run, "block string, ids binary, kinds binary, lines binary, one binary, two binary")


def _read(row: dict):
    return [np.frombuffer(row[k], t) for k, t in (("ids", np.int64), ("kinds", np.int64), ("lines", np.int32), ("one", U64), ("two", U64))]


def _unique(one, two):
    """Places of one of each pair of hashes in order, and each pair's number in that order."""
    order = np.lexsort((two, one))
    new = np.ones(len(order), bool)
    new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which


def _distinct(blocks: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, _, _, one, two = _read(row)
                spots, which = _unique(one, two)
                low, high = np.full(len(spots), np.iinfo(np.int64).max), np.full(len(spots), np.iinfo(np.int64).min)
                np.minimum.at(low, which, ids)
                np.maximum.at(high, which, ids)
                pairs = np.unique(np.stack([which, ids]), axis=1)[0]
                yield batch_of(one=signed(one[spots]), two=signed(two[spots]), low=low, high=high, n=np.bincount(pairs, minlength=len(spots)))

    rows = blocks.mapInArrow(run, "one bigint, two bigint, low bigint, high bigint, n bigint")
    return rows.groupBy("one", "two").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"), F.count("*").alias("asked"))


def _asked(blocks: DataFrame, shards: int) -> DataFrame:
    """(shard, block, number, one, two): a block's distinct lines by shard, each once; `number` is its place in _unique's order."""

    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                *_, one, two = _read(row)
                spots, _ = _unique(one, two)
                one, two = one[spots], two[spots]
                of = signed(one) % shards
                for shard in np.unique(of):
                    mine = np.flatnonzero(of == shard)
                    packed = [mine.astype(np.int32), one[mine], two[mine]]
                    yield batch_of(shard=pa.array([shard], pa.int32()), block=[row["block"]], **{k: pa.array([v.tobytes()], pa.binary()) for k, v in zip(("number", "one", "two"), packed, strict=True)})

    return blocks.mapInArrow(ask, "shard int, block string, number binary, one binary, two binary")


def _answers(blocks: DataFrame, distinct: DataFrame, shards: int, min_docs: int) -> DataFrame:
    """(id, kind, line): what goes. Shards tell blocks which of their distinct lines are shared, and the first document
    of each; the occurrences stay with their block, so a task's rows do not grow with how often a line occurs."""

    def index(t: pa.Table) -> pa.Table:
        one, two = (t[k].to_numpy().view(U64) for k in ("one", "two"))
        ph = PerfectHash.build(one, two)
        at = ph.places(one, two)
        arrays = [np.empty(len(one), k) for k in (np.uint32, np.int64, np.int64, np.int64)]
        for a, v in zip(arrays, (_fingerprint(one, two), *(t[k].to_numpy() for k in ("n", "low", "high"))), strict=True):
            a[at] = v
        names = ("prints", "counts", "low", "high")
        return pa.table({"shard": t["shard"][:1], "sizes": pa.array([ph.sizes], pa.list_(pa.int64())), "words": pa.array([ph.words.tobytes()], pa.binary()), **{k: pa.array([a.tobytes()], pa.binary()) for k, a in zip(names, arrays, strict=True)}})

    built = (
        distinct.withColumn("shard", F.pmod("one", F.lit(shards)).cast("int"))
        .groupBy("shard")
        .applyInArrow(index, "shard int, sizes array<bigint>, words binary, prints binary, counts binary, low binary, high binary")
    )

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            (arrays,) = left.to_pylist()
            ph = PerfectHash(arrays["sizes"], np.frombuffer(arrays["words"], U64))
            prints, counts, low, high = (np.frombuffer(arrays[k], t) for k, t in (("prints", np.uint32), ("counts", np.int64), ("low", np.int64), ("high", np.int64)))
            for batch in right.to_batches(max_chunksize=64):
                for row in batch.to_pylist():
                    number, one, two = (np.frombuffer(row[k], t) for k, t in (("number", np.int32), ("one", U64), ("two", U64)))
                    at = ph.places(one, two)
                    shared = (prints[at] == _fingerprint(one, two)) & (counts[at] >= min_docs) & (low[at] != high[at])
                    if shared.any():
                        out.append((row["block"], number[shared].tobytes(), low[at][shared].tobytes()))
        block, number, first = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"block": pa.array(block, pa.string()), "number": pa.array(number, pa.binary()), "first": pa.array(first, pa.binary())})

    shared = built.groupBy("shard").cogroup(_asked(blocks, shards).groupBy("shard")).applyInArrow(answer, "block string, number binary, first binary")

    def number(batches):
        for batch in batches:
            for row in batch.to_pylist():
                which = _unique(*_read(row)[3:])[1].astype(np.int32)
                yield batch_of(**{k: [row[k]] for k in ("block", "ids", "kinds", "lines")}, which=pa.array([which.tobytes()], pa.binary()))

    held = blocks.mapInArrow(number, "block string, ids binary, kinds binary, lines binary, which binary")

    def resolve(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            (row,) = left.to_pylist()
            ids, kinds, lines, which = (np.frombuffer(row[k], t) for k, t in (("ids", np.int64), ("kinds", np.int64), ("lines", np.int32), ("which", np.int32)))
            shared, first = np.zeros(int(which.max()) + 1, bool), np.zeros(int(which.max()) + 1, np.int64)
            for said in right.to_pylist():
                own = np.frombuffer(said["number"], np.int32)
                shared[own], first[own] = True, np.frombuffer(said["first"], np.int64)
            goes = shared[which] & (ids != first[which])
            out.append(pa.table({"id": ids[goes], "kind": kinds[goes], "line": lines[goes]}))
        empty = pa.table({"id": pa.array([], pa.int64()), "kind": pa.array([], pa.int64()), "line": pa.array([], pa.int32())})
        return pa.concat_tables([empty, *out])

    return held.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(resolve, "id bigint, kind bigint, line int")


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 10, min_docs: int = 2, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, n_lines, n_dropped, text): the lines of each document that no earlier document has, joined again.
    `carry` names further columns of df that stay with their rows; names of this operator's own are refused."""
    if {c.lower() for c in carry} & {key.lower(), "n_lines", "n_dropped", "text"}:
        raise ValueError("a carried column has the name of a result's column")
    docs = df.select(F.col(key).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.struct(F.lit(0).alias("_"), *carry).alias("rest"))
    every = docs.select("id", F.xxhash64("text").alias("kind"), "text", "rest")
    docs = every.select("id", "kind", "text")
    blocks = checkpoint(_blocks(docs, min_chars))
    distinct = checkpoint(_distinct(blocks))
    lines, asked = distinct.agg(F.count("*"), F.coalesce(F.sum("asked"), F.lit(0))).first()
    shards = max(1, math.ceil(lines / SHARD_LINES), math.ceil(asked / SHARD_ASKED))
    gone = _answers(blocks, distinct, shards, min_docs).groupBy("id", "kind").agg(F.collect_set("line").alias("gone"))

    def keep(batches):
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                rows = []
                for text_, gone_ in zip(part.column(1), part.column(2), strict=True):
                    lines_ = text_.as_py().split("\n")
                    out = set(gone_.as_py() or ())
                    rows.append((len(lines_), len(out), "\n".join(x for i, x in enumerate(lines_) if i not in out) if out else text_.as_py()))
                n, dropped, kept = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string()), part.column(3)], names=["id", "n_lines", "n_dropped", "kept", "rest"])

    rest = every.schema["rest"].dataType.simpleString()
    out = every.join(gone, ["id", "kind"], "left").select("id", "text", "gone", "rest").mapInArrow(keep, f"id bigint, n_lines bigint, n_dropped bigint, kept string, rest {rest}")
    return out.select(F.col("id").alias(key), "n_lines", "n_dropped", F.col("kept").alias("text"), *(F.col("rest")[c].alias(c) for c in carry))


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


STRIP = "[\\x20\\x09-\\x0D]"
#: DuckDB lower-cases all letters with lower(); only A-Z count here.
OP8_SQL = f"""
WITH lines AS (
  SELECT doc_id, pos, lines[pos] AS line,
         translate(regexp_replace(regexp_replace(lines[pos], '^{STRIP}+', ''), '{STRIP}+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, lines, unnest(generate_series(1, len(lines))) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))
), shared AS (
  SELECT k, min(doc_id) AS first_doc FROM lines WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), judged AS (
  SELECT l.*, (s.k IS NOT NULL AND l.doc_id <> s.first_doc) AS gone FROM lines l LEFT JOIN shared s ON l.k = s.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
