"""Substring dedup by seed and extend: maximal repeats of at least `length` words across documents.

Winnowing picks anchors so that equal runs of `length` words hold the same anchor: of every
`length - gram + 1` consecutive word grams, the one of least hash. Documents join on anchors. A shared anchor
is a seed and goes out once more with the words around it, as far as the windows that picked it reach
(40 bits a word); seeds of one anchor are extended both ways to these ends and compared, and a window that an
earlier document has too is confirmed. Overlapping and touching confirmed windows make one maximal repeat.
Seeds are compared by sorting, not in pairs: an anchor that n documents hold costs n log n. An anchor that very many
documents hold (at the edge of a common passage each goes on differently) is no one group: its seeds go out by window.

What a block of documents can settle by itself is settled before the shuffle: an anchor or window that
several of its documents share goes out once, so a passage that a third of all documents hold costs a
row a block, not a row a document.

Defined results: a null or empty text has no words and loses none; a text shorter than `length` words
loses none; a window repeated inside one document only is no repeat; of equal documents the one of least
key stays whole; rows with a null key stay whole and repeat nothing; rows that repeat a key are one
document, of which each loses what earlier documents have of its own text; an empty table gives an empty one.
Only the key and the text are read, so other columns, of any name, do not clash.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, batch_of, checkpoint, mix, odd, powers, signed, steps, swept, table, texts, whole_groups

GRAM = 5
#: Places of an anchor from which its seeds go out by window, and how many such anchors there may be (8 bytes each in all tasks).
HOT, HOT_KEYS = 20_000, 1 << 22


class Windows:
    """The windows of `length` words of some texts: first word, text, and the word where the anchor that each picked begins."""

    def __init__(self, array: pa.Array, length: int, gram: int):
        self.words = words = Words(array)
        self.length = length
        self.hashes = words.hashes(1)
        n = len(words) - length + 1
        self.at = np.flatnonzero(words.doc[:n] == words.doc[length - 1 :]) if n > 0 else np.zeros(0, np.int64)
        self.doc = words.doc[self.at]
        grams = np.full(len(words), np.iinfo(U64).max, U64)
        values, place = words.grams(self.hashes, gram, 1)
        grams[place] = values
        self.grams = grams
        best, pick = grams[self.at], self.at.copy()
        for j in range(1, length - gram + 1):
            other = grams[self.at + j]
            less = other < best
            pick[less] = self.at[less] + j
            np.minimum(best, other, out=best)
        self.pick = pick

    def fingerprints(self) -> tuple[np.ndarray, np.ndarray]:
        one, _ = self.words.grams(self.hashes, self.length, 2)
        two, _ = self.words.grams(self.words.hashes(2), self.length, 3)
        return one, two


def _groups(*keys: np.ndarray) -> np.ndarray:
    """A number for each row, equal for equal keys."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _least_most(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = int(group.max()) + 1 if len(group) else 0
    low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
    np.minimum.at(low, group, ids)
    np.maximum.at(high, group, ids)
    return low[group], high[group]


def _settled(ids: np.ndarray, doc: np.ndarray, place: np.ndarray):
    """Rows (key, id, packed places) of what needs no answer; they are dealt out by id."""
    order = np.lexsort((place, doc))
    doc, place = doc[order], place[order]
    cut = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
    parts = [x.astype(np.int32).tobytes() for x in np.split(place, cut[1:])] if len(doc) else []
    own = ids[doc[cut]]
    return signed(mix(own.view(U64))), own, parts


def _anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(key, id, place, n): anchors to ask about, and in how many places `n` the block has each; with `packed`, places of anchors
    that are known to be shared."""

    def run(batches):
        for batch in batches:
            for part in steps(batch):
                part = part.filter(part.column(0).is_valid()) if part.column(0).null_count else part
                w = Windows(texts(part), length, gram)
                picked = np.unique(w.pick)
                if not len(picked):
                    continue
                ids = part.column(0).to_numpy()
                doc = w.words.doc[picked]
                place, key = picked - w.words.first[doc], w.grams[picked]
                group = _groups(key)
                low, high = _least_most(group, ids[doc])
                shared = low < high
                asked = np.flatnonzero(~shared)
                _, envoy, several = np.unique(group[shared], return_index=True, return_counts=True)
                envoy = np.flatnonzero(shared)[envoy]
                known, own, parts = _settled(ids, doc[shared], place[shared])
                yield batch_of(
                    key=np.concatenate([signed(key[asked]), signed(key[envoy]), known]),
                    id=np.concatenate([ids[doc[asked]], ids[doc[envoy]], own]),
                    place=pa.concat_arrays([pa.array(place[asked].astype(np.int32)), pa.array([None] * (len(envoy) + len(own)), pa.int32())]),
                    packed=pa.array([None] * (len(asked) + len(envoy)) + parts, pa.binary()),
                    n=np.concatenate([np.ones(len(asked), np.int64), several, np.zeros(len(own), np.int64)]),
                )

    return docs.mapInArrow(run, "key bigint, id bigint, place int, packed binary, n bigint")


def _shared(docs: DataFrame, length: int, gram: int) -> tuple[DataFrame, np.ndarray]:
    """(id, place, packed): places of anchors that several documents have; and the anchors with very many places, HOT_KEYS at most.
    Anchors are counted where they lie before any are brought together, so a frequent one is not one task's work."""
    rows = _anchors(docs, length, gram)
    asks = rows.where("packed is null").groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.sum("n").alias("n"))
    known = checkpoint(asks.where(F.expr("low < high") | (F.col("n") > HOT)))
    total = known.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = known.where(F.col("n") > max(HOT, total // HOT_KEYS)).select("key").collect()
    marked = rows.join(known.where("low < high").select("key", F.lit(True).alias("hit")), "key", "left")
    return marked.where("packed is not null or (hit and place is not null)").select("id", "place", "packed"), np.sort(np.array([r[0] for r in hot], np.int64))


def _contexts(seeded: DataFrame, length: int, gram: int, hot: np.ndarray) -> DataFrame:
    """(key, id, kind, place, more, mask, context): seeds with the windows that picked them (bit o: begins o words before) and
    the words around, as far as those reach; with `packed`, runs of windows that an earlier document of the block has. The
    key is the anchor; of `hot` anchors it is the window's, and there is a row a window. Seeds of one document that are equal
    in all this are one row, with the other places in `more`."""
    reach = length - gram
    weights = [powers(odd(i), 2 * reach + 1)[1:] for i in (73, 74)]
    p, _ = _weights(reach)
    sent = seeded.sparkSession.sparkContext.broadcast(hot)
    around = np.concatenate([np.arange(-reach, 0), np.arange(gram, length)])

    def run(batches):
        for batch in batches:
            batch = batch.filter(batch.column(3).is_valid())
            for part in steps(batch):
                w = Windows(texts(part), length, gram)
                if not len(w.at):
                    continue
                seed = np.zeros(len(w.words), bool)
                for i in range(part.num_rows):
                    place = _places(part.column(3)[i], part.column(4)[i])  # also those of other texts of the key
                    seed[place[place < w.words.count[i]] + w.words.first[i]] = True
                some = np.flatnonzero(seed[w.pick])
                if not len(some):
                    continue
                one, two = (x[some] for x in w.fingerprints())
                doc, at, pick = w.doc[some], w.at[some], w.pick[some]
                ids, kinds = part.column(0).to_numpy(), part.column(1).to_numpy()
                low, _ = _least_most(_groups(one, two), ids[doc])
                later = ids[doc] > low
                _, own, parts = _settled(np.arange(part.num_rows), doc[later], at[later] - w.words.first[doc[later]])
                mine = signed(mix(ids[own].view(U64)))  # dealt out by document
                seeds, group = np.unique(pick[~later], return_inverse=True)
                back = pick[~later] - at[~later]
                mask, least, most = np.zeros(len(seeds), np.int64), np.full(len(seeds), reach), np.zeros(len(seeds), np.int64)
                np.bitwise_or.at(mask, group, np.int64(1) << back)
                np.minimum.at(least, group, back)
                np.maximum.at(most, group, back)
                used = np.concatenate([around[:reach] >= -most[:, None], around[reach:] < length - least[:, None]], axis=1)
                near = w.hashes[np.where(used, seeds[:, None] + around, 0)] >> U64(24)
                near[~used] = 0
                key = signed(w.grams[seeds])
                often = np.isin(key, sent.value)
                if often.any():
                    own_ = [np.flatnonzero(~often)]
                    keys, masks = [key[~often]], [mask[~often]]
                    for o in range(reach + 1):
                        of = np.flatnonzero(often & (mask >> o & 1).astype(bool))
                        window = mix(near[of, reach - o : 2 * reach - o].ravel()).reshape(len(of), reach)
                        own_.append(of)
                        keys.append(signed(mix(key[of].view(U64) ^ (window * p).sum(axis=1, dtype=U64)) ^ U64(o)))
                        masks.append(np.full(len(of), 1 << o))
                    of = np.concatenate(own_)
                    seeds, near, key, mask = seeds[of], near[of], np.concatenate(keys), np.concatenate(masks)
                held = w.words.doc[seeds]
                place = (seeds - w.words.first[held]).astype(np.int32)
                same = _groups(held, key, mask, *((near * x).sum(axis=1, dtype=U64) for x in weights))
                order = np.argsort(same, kind="stable")
                begin = np.flatnonzero(np.concatenate([[True], same[order][1:] != same[order][:-1]]))
                end, one_of = np.append(begin[1:], len(order)), order[begin]
                more = [None] * len(begin)
                for i in np.flatnonzero(end - begin > 1).tolist():
                    more[i] = place[order[begin[i] + 1 : end[i]]].tobytes()
                seeds, near, key, mask, held, place = seeds[one_of], near[one_of], key[one_of], mask[one_of], held[one_of], place[one_of]
                context = near.astype("<u8").view(np.uint8).reshape(len(seeds), 2 * reach, 8)[:, :, :5].tobytes()
                size = 10 * reach
                at = pa.array(np.arange(len(seeds) + 1) * size, pa.int32())
                none = [None] * len(own)
                yield batch_of(
                    key=np.concatenate([key, mine]),
                    id=np.concatenate([ids[held], ids[own]]), kind=np.concatenate([kinds[held], kinds[own]]),
                    place=pa.concat_arrays([pa.array(place), pa.array(none, pa.int32())]), more=pa.array(more + none, pa.binary()),
                    mask=np.concatenate([mask, np.zeros(len(own), np.int64)]),
                    context=pa.concat_arrays([pa.Array.from_buffers(pa.binary(), len(seeds), [None, at.buffers()[1], pa.py_buffer(context)]), pa.array(none, pa.binary())]),
                    packed=pa.array([None] * len(seeds) + [_runs(np.frombuffer(x, np.int32)).tobytes() for x in parts], pa.binary()),
                )

    return seeded.mapInArrow(run, "key bigint, id bigint, kind bigint, place int, more binary, mask bigint, context binary, packed binary")


def _weights(reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Two rows of odd numbers that tell windows apart by sums of products."""
    return powers(odd(71), reach + 1)[1:], powers(odd(72), reach + 1)[1:]


def _confirmed(contexts: DataFrame, length: int, gram: int) -> DataFrame:
    """(id, kind, place, more, mask, packed): of each seed the windows that an earlier document has."""
    reach = length - gram
    p, q = _weights(reach)

    def run(batches):
        for t in whole_groups(batches, "key"):
            asks = t.filter(pc.is_valid(t["context"])).combine_chunks()
            settled = t.filter(pc.is_null(t["context"])).combine_chunks()
            mask = np.zeros(asks.num_rows, np.int64)
            words = np.zeros((asks.num_rows, 2 * reach), U64)
            if words.size:
                raw = np.frombuffer(b"".join(x.as_buffer() for x in asks["context"]), np.uint8).reshape(asks.num_rows, 2 * reach, 5)
                wide = np.zeros((*raw.shape[:2], 8), np.uint8)
                wide[:, :, :5] = raw
                words = mix(wide.view("<u8").ravel()).reshape(words.shape)
            key, id_, picked = asks["key"].to_numpy().view(U64), asks["id"].to_numpy(), asks["mask"].to_numpy()
            for o in range(reach + 1):
                some = np.flatnonzero(picked >> o & 1)
                window = words[some, reach - o : 2 * reach - o]
                low, _ = _least_most(_groups(mix(key[some]) ^ (window * p).sum(axis=1, dtype=U64), (window * q).sum(axis=1, dtype=U64)), id_[some])
                mask[some[id_[some] > low]] |= 1 << o
            found = pa.array(mask > 0)
            out = asks.set_column(asks.column_names.index("mask"), "mask", pa.array(mask)).filter(found)
            yield from pa.concat_tables([out, settled]).select(["id", "kind", "place", "more", "mask", "packed"]).to_batches()

    return contexts.repartition("key").sortWithinPartitions("key").mapInArrow(run, "id bigint, kind bigint, place int, more binary, mask bigint, packed binary")


def _runs(place: np.ndarray) -> np.ndarray:
    """Sorted places as runs: the first place and the number of consecutive ones, in turn."""
    cut = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1] + 1]))
    return np.stack([place[cut], np.diff(np.append(cut, len(place)))], axis=1).astype(np.int32).ravel()


def _places(single, packed) -> np.ndarray:
    """Places from collected single ones and packed ones."""
    parts = [np.frombuffer(x.as_buffer(), np.int32) for x in packed.values] if packed.is_valid else []
    if single.is_valid:
        parts.append(single.values.to_numpy(zero_copy_only=False))
    return np.concatenate([np.zeros(0, np.int32), *parts]).astype(np.int64)


def _windows(kind: int, seeds, packed, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end (of the last window's begin) of the runs of confirmed windows of the text that `kind` tells."""
    begin, end = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if seeds.is_valid and len(seeds.values):
        own, place, mask = (seeds.values.field(i).to_numpy(zero_copy_only=False) for i in range(3))
        several = seeds.values.field(3)
        some = np.flatnonzero((own == kind) & ~np.asarray(several.is_null()))
        parts = [np.frombuffer(several[i].as_buffer(), np.int32) for i in some.tolist()]
        place, mask = np.concatenate([place[own == kind], *parts]).astype(np.int64), np.concatenate([mask[own == kind], *(np.full(len(x), mask[i]) for i, x in zip(some.tolist(), parts, strict=True))])
        for o in range(reach + 1):
            some = place[(mask >> o & 1).astype(bool)] - o
            begin.append(some)
            end.append(some + 1)
    for x in packed.values if packed.is_valid else ():
        if x["kind"].as_py() == kind:
            runs = np.frombuffer(x["packed"].as_buffer(), np.int32).reshape(-1, 2).astype(np.int64)
            begin.append(runs[:, 0])
            end.append(runs.sum(axis=1))
    return np.concatenate(begin), np.concatenate(end)


def repeats(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = 13, gram: int = GRAM) -> DataFrame:
    """(key, n_words, n_removed, text, repeats): the words that no maximal repeat of an earlier document covers,
    joined by one space, and those repeats as (begin, end) in words."""
    if not 1 <= gram <= length or length - gram > 60:
        raise ValueError("a gram has at least one word, and at most the length and 60 words less than it")
    docs = df.select(F.col(key).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).select("id", F.xxhash64("text").alias("kind"), "text")
    with swept(df.sparkSession):
        shared, hot = _shared(docs.select("id", "text"), length, gram)
        shared = shared.groupBy("id").agg(F.collect_list("place").alias("single"), F.collect_list("packed").alias("packed"))
        seeded = docs.join(shared, "id", "left").select("id", "kind", "text", "single", "packed")
        found = checkpoint(_confirmed(_contexts(seeded, length, gram, hot), length, gram))
    seed, run_ = F.when(F.col("place").isNotNull(), F.struct("kind", "place", "mask", "more")), F.when(F.col("packed").isNotNull(), F.struct("kind", "packed"))
    found = found.groupBy("id").agg(F.collect_list(seed).alias("seeds"), F.collect_list(run_).alias("runs"))

    def remove(batches):
        kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                rows = []
                for kind_, text_, seeds, runs in zip(*part.columns[1:], strict=True):
                    words = text_.as_buffer().to_pybytes().split()
                    covered = np.zeros(len(words) + 1, np.int64)
                    begin, end = _windows(kind_.as_py(), seeds, runs, length - gram)
                    np.add.at(covered, begin, 1)
                    np.add.at(covered, end + length - 1, -1)
                    covered = np.cumsum(covered)
                    edge = np.diff(np.concatenate([[0], (covered[:-1] > 0).astype(np.int8), [0]]))
                    spans = [{"begin": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]
                    gone = sum(s["end"] - s["begin"] for s in spans)
                    kept = compress(words, (covered[:-1] == 0).tolist()) if gone else words
                    rows.append((len(words), gone, b" ".join(kept).decode(), spans))
                n, removed, kept, spans = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, kind)], names=[key, "n_words", "n_removed", "text", "repeats"])

    return docs.join(found, "id", "left").select("id", "kind", "text", "seeds", "runs").mapInArrow(remove, f"`{key}` bigint, n_words bigint, n_removed bigint, text string, repeats array<struct<begin:int,end:int>>")


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = repeats(table(spark, sf_dir, "documents"), length=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP2_SQL = """
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), windows AS (
  SELECT doc_id, p, array_to_string(w[p : p + 12], ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS p FROM words WHERE len(w) >= 13)
), firsts AS (
  SELECT s, min(doc_id) AS first_doc FROM windows GROUP BY s
), gone AS (
  SELECT DISTINCT doc_id, p + i AS p
  FROM (SELECT w.doc_id, w.p, unnest(generate_series(0, 12)) AS i FROM windows w JOIN firsts f USING (s) WHERE f.first_doc < w.doc_id)
), each AS (
  SELECT doc_id, p, w[p] AS word FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS p FROM words)
), kept AS (
  SELECT e.doc_id, count(*) AS n_removed_not, string_agg(e.word, ' ' ORDER BY e.p) AS t
  FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.p = g.p WHERE g.p IS NULL GROUP BY e.doc_id
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(len(w.w) - coalesce(k.n_removed_not, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.t, '')) AS kept_sha256
FROM words w LEFT JOIN kept k USING (doc_id)
"""
