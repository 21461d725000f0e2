"""Hard negatives by exact search over rotated vectors, most of which are discarded on their leading components.

Components become whole numbers floor(256 c). The rotation is the orthogonal basis of principal components of all
rows (their second moments, summed tile by tile). A partial product over the leading components bounds an inner
product: what is left lies within the product of the residual norms, plus slack for rounding, which covers the
rotation's own measured departure from orthogonality. Pairs that the bounds put out of reach, be it under the least
score so far that still counts or over the largest allowed, are discarded, stage by stage; survivors are verified with
products of whole numbers, so no result depends on rounding.

A stated set of anchors is searched against all rows in blocks: anchors in blocks of ANCHORS, rows in packed blocks
that stream past an anchor block's running best in a number of groups. A task holds one anchor block and one row block,
and each group sends its best of each anchor once.

Defined results: rows with a null id or label, a null vector, or one without components or with a null or non-finite
component take no part; rows that repeat id, label and vector are one; of rows that repeat an id with another label or
vector each is an anchor and a candidate of its own, but none is a positive or negative of an anchor of its id; two
lengths of vectors, or numbers whose inner products could pass 2^63, raise an error; an anchor without positives, or a
positive without negatives in the band, gives no rows; ties go to the smaller id; an empty table gives an empty one. Only
id, label and vector are read, so other columns, of any name, do not clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_of, checkpoint, table
from .tiles import matrix, products
from .whitening import whole, width_of

SCALE = 256
#: Anchors and rows of a block; pairs that are looked at, and pairs that are verified, at a time.
ANCHORS, ROWS, PAIRS, VERIFIED = 8192, 1024, 1 << 19, 1 << 15
#: Shares of the components after which pairs are discarded.
STAGES = (0.25, 0.5)
NONE = np.iinfo(np.int64).min


class Rotation:
    """An orthogonal basis, and how far sums in it may be off."""

    def __init__(self, moments: np.ndarray):
        _, vectors = np.linalg.eigh(moments)
        self.turn = vectors[:, ::-1].copy()
        d = len(moments)
        self.cuts = sorted({max(1, int(d * s)) for s in STAGES})
        self.slack = float(np.linalg.norm(self.turn.T @ self.turn - np.eye(d))) + 16 * d * np.finfo(float).eps

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rotated rows, their norms, and the norms of what lies behind each cut."""
        y = x.astype(np.float64) @ self.turn
        rest = [np.sqrt((y[:, c:] ** 2).sum(axis=1)) for c in self.cuts]
        return y, np.sqrt((y**2).sum(axis=1)), np.stack(rest)


class Rows:
    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, rotation: Rotation):
        self.ids, self.labels, self.x = ids, labels, x
        self.y, self.norm, self.rest = rotation.of(x)

    @classmethod
    def read(cls, row: dict, width: int, rotation: Rotation) -> Rows:
        ids, labels = (np.frombuffer(row[k], np.int64) for k in ("ids", "labels"))
        return cls(ids, labels, np.frombuffer(row["x"], np.int64).reshape(len(ids), width), rotation)


def survivors(a: Rows, b: Rows, rotation: Rotation, low: np.ndarray, high: np.ndarray, fits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, score) of the pairs in `fits` whose score may lie from low to high (a number each row of a)."""
    slack = rotation.slack
    near = (slack * a.norm)[:, None] * b.norm
    first = rotation.cuts[0]
    part = a.y[:, :first] @ b.y[:, :first].T
    off = a.rest[0][:, None] * b.rest[0] * (1 + slack) + near
    i, j = np.nonzero(fits & (part + off >= low[:, None]) & (part - off <= high[:, None]))
    part, near = part[i, j], near[i, j]
    for stage, (begin, end) in enumerate(zip(rotation.cuts, rotation.cuts[1:]), 1):
        for at in range(0, len(i), VERIFIED):
            s = slice(at, at + VERIFIED)
            part[s] += np.einsum("ij,ij->i", a.y[i[s], begin:end], b.y[j[s], begin:end])
        off = a.rest[stage][i] * b.rest[stage][j] * (1 + slack) + near
        kept = (part + off >= low[i]) & (part - off <= high[i])
        i, j, part, near = i[kept], j[kept], part[kept], near[kept]
    score = np.zeros(len(i), np.int64)
    for at in range(0, len(i), VERIFIED):
        s = slice(at, at + VERIFIED)
        score[s] = np.einsum("ij,ij->i", a.x[i[s]], b.x[j[s]])
    kept = (score >= low[i]) & (score <= high[i])
    return i[kept], j[kept], score[kept]


class Best:
    """The `most` first (score falling, id rising) rows of each of n lists so far."""

    def __init__(self, n: int, most: int):
        self.most = most
        self.score, self.ids = np.full((n, most), NONE), np.zeros((n, most), np.int64)

    def least(self) -> np.ndarray:
        """The score that a further row of each list needs: the last one's, as a tie may have the smaller id."""
        return self.score[:, -1]

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        lists = np.unique(at)
        if not len(lists):
            return
        old = np.repeat(lists, self.most)
        at, score, ids = np.concatenate([old, at]), np.concatenate([self.score[lists].ravel(), score]), np.concatenate([self.ids[lists].ravel(), ids])
        order = np.lexsort((ids, -np.maximum(score, NONE + 1), at))
        at, score, ids = at[order], score[order], ids[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        kept = rank < self.most
        self.score[at[kept], rank[kept]], self.ids[at[kept], rank[kept]] = score[kept], ids[kept]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, rank = np.nonzero(self.score > NONE)
        return at, self.ids[at, rank], self.score[at, rank]


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """(block, n, ids, labels, x): rows dealt by their hash to blocks of about `size` rows, numbered from 0, in the shared folder."""
    blocks = max(1, -(-rows.count() // size))

    def pack(t: pa.Table) -> pa.Table:
        ids, labels = (t[c].to_numpy().astype(np.int64) for c in ("id", "label"))
        arrays = {"ids": ids, "labels": labels, "x": matrix(t["x"].combine_chunks())}
        return pa.table({"block": t["block"][:1], "n": pa.array([len(ids)], pa.int64()), **{k: pa.array([v.tobytes()], pa.binary()) for k, v in arrays.items()}})

    dealt = rows.select(F.pmod(F.xxhash64("id", "label", "x"), F.lit(blocks)).cast("int").alias("block"), "id", "label", "x")
    return checkpoint(dealt.groupBy("block").applyInArrow(pack, "block int, n bigint, ids binary, labels binary, x binary"))


def _scan(anchors: DataFrame, rows: DataFrame, blocks: int, groups: int, width: int, rotation: Rotation, most: int, wanted) -> DataFrame:
    """(block, at, id, score): of each list of each of the `blocks` anchor blocks the best of each group of row blocks.
    wanted(said) makes of an anchor block's row the lists: anchor of each, low, high, whether the label is the same."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None

        def out():
            at, ids, score = own[2].rows()
            for s in range(0, len(at), 1 << 16):
                e = slice(s, s + (1 << 16))
                yield batch_of(block=pa.array([own[3]] * len(at[e]), pa.int32()), at=pa.array(at[e], pa.int32()), id=ids[e], score=score[e])

        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                if row["anchors"] is not None:
                    if own is not None:
                        yield from out()
                    lists = wanted(row["anchors"])
                    own = (Rows.read(row["anchors"], width, rotation), lists, Best(len(lists[0]), most), row["block"])
                elif own is not None and own[3] == row["block"]:
                    _meet(own[0], Rows.read(row["rows"], width, rotation), rotation, own[1], own[2])
        if own is not None:
            yield from out()

    def side(df, *key):
        return df.select(*key, F.struct(*df.columns).alias("own"))

    each, every = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (groups, blocks))
    a, b = side(anchors, "block", each.alias("part")), side(rows, every.alias("block"), F.pmod("block", F.lit(groups)).alias("part"))
    kinds = [F.lit(None).cast(x.schema["own"].dataType.simpleString()) for x in (a, b)]
    both = a.select("block", "part", F.col("own").alias("anchors"), kinds[1].alias("rows")).union(b.select("block", "part", kinds[0], "own"))
    dealt = both.repartition("block", "part").sortWithinPartitions("block", "part", F.col("anchors").isNull())
    return dealt.mapInArrow(search, "block int, at int, id bigint, score bigint")


def _meet(a: Rows, b: Rows, rotation: Rotation, lists, best: Best) -> None:
    """Adds the rows of b to the lists of the anchors of a."""
    anchor, low, high, same = lists
    each = max(1, PAIRS // len(b.ids))
    for begin in range(0, len(a.ids), each):
        end = min(len(a.ids), begin + each)
        first, last = np.searchsorted(anchor, [begin, end])
        if first == last:
            continue
        own = anchor[first:last] - begin
        floor, ceiling = np.full(end - begin, np.iinfo(np.int64).max), np.full(end - begin, NONE)
        np.minimum.at(floor, own, np.maximum(low[first:last], best.least()[first:last]))
        np.maximum.at(ceiling, own, high[first:last])
        some = _slice(a, begin, end)
        fits = (some.labels[:, None] == b.labels) == same
        fits &= some.ids[:, None] != b.ids
        i, j, score = survivors(some, b, rotation, floor, ceiling, fits)
        # An anchor's lists lie together: each survivor meets each of them.
        start, stop = np.searchsorted(own, i), np.searchsorted(own, i, "right")
        size = stop - start
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size) + first
        score, ids = np.repeat(score, size), np.repeat(b.ids[j], size)
        kept = (score >= low[at]) & (score <= high[at]) & (score >= best.least()[at])
        best.add(at[kept], score[kept], ids[kept])


def _slice(a: Rows, begin: int, end: int) -> Rows:
    out = object.__new__(Rows)
    out.ids, out.labels, out.x, out.y, out.norm, out.rest = a.ids[begin:end], a.labels[begin:end], a.x[begin:end], a.y[begin:end], a.norm[begin:end], a.rest[:, begin:end]
    return out


def _first(found: DataFrame, most: int) -> DataFrame:
    """The `most` first rows of each list, with their rank."""
    rank = F.row_number().over(Window.partitionBy("block", "at").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= most)


def hard_negatives(df: DataFrame, anchors, key: str = "vec_id", vector: str = "embedding", label="label", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row of df where `anchors` holds and each
    of its first positives, rows of its label, the first negatives, rows of another, with low * positive_score <= 100 *
    negative_score <= high * positive_score. `anchors` and `label` are expressions over df's columns."""
    rows = whole(df, key, vector, scale, 0, label=F.expr(label).cast("bigint"), anchor=F.coalesce(F.expr(anchors), F.lit(False))).where("id is not null and label is not null")
    rows = checkpoint(rows.withColumn("id", F.col("id").cast("bigint")).distinct())
    width = width_of(rows)
    none = df.sparkSession.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    if width is None:
        return none
    largest = rows.agg(F.max(F.array_max(F.transform("x", F.abs)))).first()[0]
    if largest**2 * width * 100 >= 2**63:
        raise ValueError("numbers whose inner products could pass 2^63")
    rotation = Rotation(products(rows, "x", width, lambda x: x, width))
    asked, packed = _packed(rows.where("anchor"), ANCHORS), _packed(rows, ROWS)
    count = asked.agg(F.max("block")).first()[0]
    if count is None:
        return none
    count += 1
    groups = max(1, min(packed.count(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // count))

    def any_positive(said: dict):
        n = said["n"]
        return np.arange(n), np.full(n, NONE), np.full(n, np.iinfo(np.int64).max), True

    own = checkpoint(_first(_scan(asked, packed, count, groups, width, rotation, positives, any_positive), positives))
    named = own.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("at", "rank", "id", "score"))).alias("lists"))  # ANCHORS * positives at most

    def band(said: dict):
        lists = said["lists"]
        anchor, score = (np.array([x[k] for x in lists], np.int64) for k in ("at", "score"))
        none = score < 0  # no number lies in the band of a negative score
        return anchor, np.where(none, 1, -(-low * score // 100)), np.where(none, 0, high * score // 100), False

    with_lists = asked.join(named, "block")
    found = _first(_scan(with_lists, packed, count, groups, width, rotation, negatives, band), negatives)
    pairs = own.select("block", F.col("at").alias("anchor"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), F.row_number().over(Window.partitionBy("block").orderBy("at", "rank")).alias("list"))
    ids = asked.mapInArrow(_anchor_ids, "block int, anchor int, anchor_id bigint")
    out = found.select("block", (F.col("at") + 1).alias("list"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(pairs, ["block", "list"]).join(ids, ["block", "anchor"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _anchor_ids(batches):
    for batch in batches:
        for row in batch.to_pylist():
            ids = np.frombuffer(row["ids"], np.int64)
            yield batch_of(block=pa.array([row["block"]] * len(ids), pa.int32()), anchor=pa.array(np.arange(len(ids)), pa.int32()), anchor_id=ids)


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return hard_negatives(rows, "vec_id % 100 = 0", label="CASE WHEN vec_id % 7 = 0 THEN pmod(label + 1, 10) ELSE label END")


OP12_SQL = """
WITH e AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same,
         CAST(list_sum(list_transform(range(1, len(a.x) + 1), lambda i: a.x[i] * b.x[i])) AS BIGINT) AS score
  FROM e a, e b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 10
"""
