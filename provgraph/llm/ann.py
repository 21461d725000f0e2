"""Approximate nearest neighbours on robust-pruned directed graphs, one a shard.

Distinct vectors are dealt to shards by hash. A shard's graph grows in doubling batches: a greedy beam
search from the first node proposes each new node's neighbours, and relaxed distance pruning keeps an edge
only if no kept neighbour is `alpha` times closer to its end, so edges point different ways. Each shard then
doubles its beam until searches for a bounded sample of its own vectors find `RECALL` of their exact k nearest
in the shard. Queries run a beam search in each shard: a block of QUERY_BLOCK queries stays in a task while the shards of
one of a few groups stream past it, so no query is sent to each shard; what the beams hold is scored exactly, in double
precision, on the original vectors, each group sends its best of each query once, and these are merged. Largest
inner product becomes least distance by one more coordinate, sqrt(largest norm^2 - norm^2), for stored vectors
and 0 for queries.

Equal vectors are one node that keeps its k + 1 least ids; no other copy can be among the k nearest, as
ties go to the smaller id. So a vector that a third of all rows hold costs one node.

Defined results: vectors that are null, empty, zero, or hold a null or non-finite component take no part, as
queries or candidates; two lengths of vectors raise ValueError; fewer candidates than k are all returned;
rows that repeat an id and vector are one candidate, and a query with a repeated id is asked for each
distinct vector of it; an empty table gives an empty one. Only the id and the vector are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_of, checkpoint, table

#: Nodes of a shard, about; queries of a block, past which each shard's graph streams once.
SHARD_ROWS, QUERY_BLOCK = 4096, 65536
DEGREE, BEAM, ALPHA, EXPAND = 40, 96, 1.3, 4
#: Vectors of a shard that its beam is tuned on, and the share of their k nearest that it must find.
TUNED, RECALL = 64, 0.97


def beam_search(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, beam: int, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Of each query the nodes that its beam ends with, nearest first (-1: none), and their squared distances."""
    parts = [_beam(x, graph, queries[i : i + block], beam) for i in range(0, len(queries), block)]
    if not parts:
        return np.zeros((0, beam), np.int64), np.zeros((0, beam), np.float32)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _beam(x, graph, q, beam):
    n = len(q)
    node = np.full((n, beam), -1)
    far = np.full((n, beam), np.inf, np.float32)
    done = np.ones((n, beam), bool)
    seen = np.zeros((n, len(x)), bool)
    norm = (x * x).sum(axis=1)
    own = (q * q).sum(axis=1)
    node[:, 0], far[:, 0], done[:, 0] = 0, norm[0] - 2 * q @ x[0] + own, False
    seen[:, 0] = True
    live = np.arange(n)
    while len(live):
        open_far = np.where(done[live], np.inf, far[live])
        width = min(EXPAND, beam)
        pick = np.argpartition(open_far, width - 1, axis=1)[:, :width]
        valid = np.isfinite(np.take_along_axis(open_far, pick, axis=1))
        going = valid.any(axis=1)
        live, pick, valid = live[going], pick[going], valid[going]
        if not len(live):
            break
        done[live[:, None], pick] |= valid
        chosen = np.where(valid, node[live[:, None], pick], -1)
        near = np.where((chosen >= 0)[:, :, None], graph[chosen], -1).reshape(len(live), -1)
        near[seen[live[:, None], near]] = -1
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        fresh = near >= 0
        row = np.broadcast_to(live[:, None], near.shape)
        seen[row[fresh], near[fresh]] = True
        d = np.full(near.shape, np.inf, np.float32)
        at, to = row[fresh], near[fresh]
        d[fresh] = norm[to] - 2 * np.einsum("ij,ij->i", x[to], q[at]) + own[at]
        all_far = np.concatenate([far[live], d], axis=1)
        best = np.argpartition(all_far, beam - 1, axis=1)[:, :beam]
        far[live] = np.take_along_axis(all_far, best, axis=1)
        node[live] = np.take_along_axis(np.concatenate([node[live], near], axis=1), best, axis=1)
        done[live] = np.take_along_axis(np.concatenate([done[live], ~fresh], axis=1), best, axis=1)
    order = np.argsort(far, axis=1, kind="stable")
    far, node = np.take_along_axis(far, order, axis=1), np.take_along_axis(node, order, axis=1)
    node[~np.isfinite(far)] = -1
    return node, far


def robust_prune(x: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, alpha: float, block: int = 256) -> np.ndarray:
    """Of each point's candidates (-1: none) at most `degree`, nearest first, none of which a kept one stands for."""
    return np.concatenate([_prune(x, points[i : i + block], candidates[i : i + block], degree, alpha) for i in range(0, len(points), block)])


def _prune(x, points, candidates, degree, alpha):
    there = (candidates >= 0) & (candidates != points[:, None])
    c = x[candidates]
    far = np.where(there, ((c - x[points][:, None]) ** 2).sum(axis=2), np.inf)
    order = np.argsort(far, axis=1, kind="stable")
    far, candidates = np.take_along_axis(far, order, axis=1), np.take_along_axis(candidates, order, axis=1)
    c = np.take_along_axis(c, order[:, :, None], axis=1)
    norm = (c * c).sum(axis=2)
    apart = norm[:, :, None] + norm[:, None] - 2 * c @ c.transpose(0, 2, 1)
    alive, rows = np.isfinite(far), np.arange(len(points))
    out = np.full((len(points), degree), -1)
    for k in range(degree):
        first = alive.argmax(axis=1)
        some = alive[rows, first]
        if not some.any():
            break
        out[some, k] = candidates[rows, first][some]
        alive &= alpha * apart[rows, first] > far
        alive[rows, first] = False
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> np.ndarray:
    """Out-neighbours of each row of x (-1: none). Node 0 is where searches begin."""
    n = len(x)
    graph = np.full((n, degree), -1)
    done = 1
    while done < n:
        new = np.arange(done, min(n, done + max(1, min(done, n // 16 + 1))))
        near, _ = beam_search(x[: new[-1] + 1], graph, x[new], beam)
        if done < beam:  # few enough to look at all
            near = np.broadcast_to(np.arange(new[-1] + 1), (len(new), new[-1] + 1)).copy()
        graph[new] = robust_prune(x, new, near, degree, alpha)
        ends = graph[new]
        begin, to = np.repeat(new, degree)[ends.ravel() >= 0], ends.ravel()[ends.ravel() >= 0]
        order = np.argsort(to, kind="stable")
        begin, to = begin[order], to[order]
        targets, first, count = np.unique(to, return_index=True, return_counts=True)
        for lo in range(0, len(targets), 1024):
            t, f, c = targets[lo : lo + 1024], first[lo : lo + 1024], count[lo : lo + 1024]
            width = int(c.max())
            place = f[:, None] + np.arange(width)
            more = np.where(np.arange(width) < c[:, None], begin[np.minimum(place, len(begin) - 1)], -1)
            for part in range(0, width, 2 * degree):
                graph[t] = _joined(x, t, graph[t], more[:, part : part + 2 * degree], degree, alpha)
        done = int(new[-1]) + 1
    return graph


def _joined(x, t, old, more, degree, alpha):
    both = np.sort(np.concatenate([old, more], axis=1), axis=1)
    both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
    full = (both >= 0).sum(axis=1) > degree
    out = -np.sort(-both, axis=1)[:, :degree]
    if full.any():
        out[full] = robust_prune(x, t[full], both[full], degree, alpha)
    return out


def tuned_beam(x: np.ndarray, graph: np.ndarray, k: int, beam: int) -> int:
    """The beam, doubled until it finds RECALL of the k nearest nodes of TUNED of the nodes, asked for without their last coordinate."""
    n = len(x)
    beam, k = min(n, max(beam, k + 1)), min(n, k)
    q = x[np.unique(np.linspace(0, n - 1, TUNED).astype(np.int64))].copy()
    q[:, -1] = 0
    exact = np.argsort(-(q @ x.T), axis=1, kind="stable")[:, :k]
    while beam < n:
        node, _ = beam_search(x, graph, q, beam)
        if np.mean([np.isin(e, own).mean() for e, own in zip(exact, node, strict=True)]) >= RECALL:
            break
        beam = min(n, 2 * beam)
    return beam


class Best:
    """The k first (score falling, id rising) candidates of each of n queries so far; equal ones count once."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score, self.ids = np.full((n, k), -np.inf), np.zeros((n, k), np.int64)

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        lists = np.unique(at)
        at = np.concatenate([np.repeat(lists, self.k), at])
        score, ids = np.concatenate([self.score[lists].ravel(), score]), np.concatenate([self.ids[lists].ravel(), ids])
        order = np.lexsort((ids, -score, at))
        at, score, ids = at[order], score[order], ids[order]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (score[1:] != score[:-1]) | (ids[1:] != ids[:-1])
        at, score, ids = at[new], score[new], ids[new]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        first = rank < self.k
        self.score[lists], self.ids[lists] = -np.inf, 0
        self.score[at[first], rank[first]], self.ids[at[first], rank[first]] = score[first], ids[first]


def _valid(df: DataFrame, key: str, vector: str) -> DataFrame:
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df.select(F.col(key).cast("bigint").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda c: c != 0))


def nearest(df: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 20, shard_rows: int = SHARD_ROWS, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of df, other than itself, of largest inner product with each query."""
    rows = _valid(df, key, vector)
    least = rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= k + 1)
    nodes = checkpoint(least.groupBy("v").agg(F.sort_array(F.collect_set("id")).alias("ids")))
    asked = _valid(queries, key, vector)
    count, low, high, norm = nodes.agg(F.count("*"), F.min(F.size("v")), F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))).first()
    found = "query_id bigint, vec_id bigint, score double"
    if not count:
        return df.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    if low != high:
        raise ValueError("vectors of different lengths")
    shards = -(-count // shard_rows)

    def lifted(v: np.ndarray) -> np.ndarray:
        return np.concatenate([v, np.sqrt(np.maximum(norm - (v * v).sum(axis=1), 0))[:, None]], axis=1).astype(np.float32)

    def build(t: pa.Table) -> pa.Table:
        v = np.asarray(t["v"].combine_chunks().values).reshape(-1, low)
        x, ids = lifted(v), t["ids"].combine_chunks()
        graph = build_graph(x)
        packed = {"vectors": v, "graph": graph.astype(np.int32), "ids": np.asarray(ids.flatten()), "at": np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy())])}
        return pa.table({"shard": t["shard"][:1], "beam": pa.array([tuned_beam(x, graph, k, beam)], pa.int32()), **{n: pa.array([a.tobytes()], pa.binary()) for n, a in packed.items()}})

    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int"))
    graphs = checkpoint(dealt.groupBy("shard").applyInArrow(build, "shard int, beam int, vectors binary, graph binary, ids binary, at binary"))
    asked = checkpoint(asked.distinct())
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    groups = max(1, min(shards, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // blocks))

    def pack(t: pa.Table) -> pa.Table:
        packed = {"ids": t["id"].to_numpy(), "v": np.asarray(t["v"].combine_chunks().flatten())}
        return pa.table({"block": t["block"][:1], **{n: pa.array([x.tobytes()], pa.binary()) for n, x in packed.items()}})

    packed = asked.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int")).groupBy("block").applyInArrow(pack, "block int, ids binary, v binary")

    class Shard:
        def __init__(self, row: dict):
            self.v = np.frombuffer(row["vectors"]).reshape(-1, low)
            self.graph = np.frombuffer(row["graph"], np.int32).reshape(len(self.v), -1)
            self.ids, self.at = (np.frombuffer(row[c], np.int64) for c in ("ids", "at"))
            self.x, self.beam = lifted(self.v), row["beam"]

        def search(self, best: Best, who: np.ndarray, q: np.ndarray) -> None:
            for i in range(0, len(q), 1024):
                some = q[i : i + 1024]
                node, _ = beam_search(self.x, self.graph, np.concatenate([some, np.zeros((len(some), 1))], axis=1).astype(np.float32), self.beam)
                at, rank = np.nonzero(node >= 0)
                own = node[at, rank]
                score = np.empty(len(own))
                for j in range(0, len(own), 1 << 15):
                    e = slice(j, j + (1 << 15))
                    score[e] = (self.v[own[e]] * some[at[e]]).sum(axis=1)
                size = self.at[own + 1] - self.at[own]
                place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.at[own], size)
                at, score, vec = np.repeat(at, size) + i, np.repeat(score, size), self.ids[place]
                other = vec != who[at]
                best.add(at[other], score[other], vec[other])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who = q = best = None
        block = -1

        def out():
            at, rank = np.nonzero(best.score > -np.inf)
            for i in range(0, len(at), 1 << 16):
                e = (at[i : i + (1 << 16)], rank[i : i + (1 << 16)])
                yield batch_of(query_id=who[e[0]], vec_id=best.ids[e], score=best.score[e])

        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                if row["asked"] is not None:
                    if best is not None:
                        yield from out()
                    block, who, q = row["block"], np.frombuffer(row["asked"]["ids"], np.int64), np.frombuffer(row["asked"]["v"]).reshape(-1, low)
                    best = Best(len(who), k)
                elif row["block"] == block:
                    Shard(row["graph"]).search(best, who, q)
        if best is not None:
            yield from out()

    # A block of queries stays in its task while the shards of a group of them stream past.
    each, every = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (groups, blocks))
    none = [F.lit(None).cast("struct<ids:binary,v:binary>"), F.lit(None).cast("struct<beam:int,vectors:binary,graph:binary,ids:binary,at:binary>")]
    ask = packed.select("block", each.alias("part"), F.struct("ids", "v").alias("asked"), none[1].alias("graph"))
    held = graphs.select(every.alias("block"), F.pmod("shard", F.lit(groups)), none[0], F.struct("beam", "vectors", "graph", "ids", "at"))
    stream = ask.union(held).repartition("block", "part").sortWithinPartitions("block", "part", F.col("asked").isNull())
    each = stream.mapInArrow(search, found)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.distinct().withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_nearest(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where("vec_id % 20 = 0"))
