"""N-gram Jaccard join by partition of the universe: exact links between documents of similar shingle sets.

Sets fall into bands by size. In a band two linked sets differ in at most H shingles, so of H + 1 segments
that shingles are hashed into, one is equal in both (pigeonhole). Each set is indexed under its filled
segments in its own band and, where a smaller set may link with it, in the band below. Cost-based allocation:
a segment that is empty in a set would meet every other set whose segment is empty, so it is not indexed;
for each, the set pays with the one-deletion neighbourhood of one of its other segments (`_keys` says which
and why no link is lost).

Keys that sets of one class only hold are dropped, and of keys with the same members one is kept. Candidates
pass an exact bound (bits of a parity sketch that differ are at most the shingles that differ) and are then
verified on their texts, round by round: in a round each set names its first candidates in each bucket, links
join components, and a next round looks across components only, in the buckets where a set had more candidates than it
named, until there are none. So a group of copies costs a few rows a set in a round, and no link between components is missed.
Buckets of over BUCKET sets are dealt to blocks, anew in each of DEALS rounds, which joins what is alike. A large bucket
that then still has sets of two components or more is split (`_split`): by the rarest shingles of its sets, of which
linked sets share one, and where one shingle is not enough, by size too. So sets that share a template but not what
is their own do not meet. Only in buckets that are large even so, sets outside the largest component are compared with
all blocks.

Defined results: a null text is empty; a text without words has no shingles, links with nothing and is a
component by itself; with fewer than k words the whole sequence is the one shingle; a null key has no
component; rows that repeat a key are one document with the links of each. Only the key and the text
are read, so other columns, of any name, do not clash; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, batch_of, checkpoint, lowered, mix, signed, steps, swept, table, texts, whole_groups
from .components import components

BUCKET, DEALS = 2048, 3
#: Texts that are compared with one text in one group; requests for texts that are sent to all tasks at most (24 bytes each).
STAR, SENT = 512, 250_000
#: Hashes of the universe that a set with few filled segments goes through; counters that tell rare shingles from frequent ones.
TURNS, COUNTERS = 8, 1 << 17


class Bands:
    """Sizes in bands whose ends are (q/p)^2 apart, for sets that link if q * intersection >= p * union."""

    def __init__(self, p: int, q: int):
        if not 0 < p <= q:
            raise ValueError("the similarity lies above 0 and at 1 at most")
        self.p, self.q = p, q
        self.low, self.high = [1], []

    def reach(self, size: int) -> None:
        while not self.high or self.high[-1] < size:
            self.high.append(max(self.low[-1], self.low[-1] * self.q**2 // self.p**2))
            self.low.append(self.high[-1] + 1)

    def differ(self, x, y):
        """Shingles that linked sets of x and y shingles may differ in."""
        return (self.q - self.p) * (x + y) // (self.p + self.q)

    def segments(self, band: int) -> int:
        return int(self.differ(self.high[band], self.high[band] * self.q // self.p)) + 1

    def homes(self, size: int) -> list[int]:
        """The set's band, then the bands below that hold sets it may link with."""
        self.reach(size)
        band = int(np.searchsorted(self.high, size))
        out = [band]
        while band and self.high[band - 1] * self.q >= self.p * size:
            band -= 1
            out.append(band)
        return out


def shingles(array: pa.Array, k: int):
    """(document, hash) of the distinct shingles, by document."""
    w = Words(array, lower=True)
    hashes = w.hashes(5)
    values, place = w.grams(hashes, k, 5)
    doc = w.doc[place]
    for few in range(1, k):
        some = np.flatnonzero(w.count == few)
        if len(some):
            total = np.zeros(len(some), U64)
            for j in range(few):
                total = mix(total + hashes[w.first[some] + j])
            values, doc = np.concatenate([values, mix(total + U64(few))]), np.concatenate([doc, some])
    order = np.lexsort((values, doc))
    values, doc = values[order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], values[new]


def _keys(values: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """The keys of one set, and which are of its own band.

    With m segments, linked sets X and Y differ in m - 1 shingles at most. Suppose that no filled segment is
    equal, and let e segments be empty in both. The other m - e differ in one shingle or more each, so at most
    e - 1 of them differ in two or more. A set with E empty segments (E >= e) has the one-deletion keys of its
    first E segments of two shingles or more, or of all if it has fewer. Where X has e such segments that end
    no later than Y's first e (or Y has fewer), one of these differs in one shingle. If X is the fuller one
    there, its deletion key is Y's key, as Y has a shingle there; if Y is, it has three or more, so that the
    segment is among those Y deletes from. So a pair is missed only if both sets have fewer than e, hence than
    their own E, such segments; these sets go on to another hash of the universe, and after the last they have
    keys for their empty segments."""
    out, homes = [], []
    for number, band in enumerate(bands.homes(len(values))):
        m = bands.segments(band)
        if m == 1:  # sets that may not differ are one class
            continue
        weight, found = mix(values ^ U64(0xABCDEF)), []
        for turn in range(TURNS):
            segment = ((mix(values + U64(77 + 1000003 * turn)) >> U64(32)) * U64(m) >> U64(32)).astype(np.int64)
            sums, count = np.zeros(m, U64), np.bincount(segment, minlength=m)
            np.add.at(sums, segment, weight)
            salt = mix(np.arange(m, dtype=U64) + (U64(band) << U64(32)) + (U64(turn) << U64(56)))
            empty, several = m - np.count_nonzero(count), np.flatnonzero(count > 1)
            few = len(several) < empty
            own = count >= (0 if few and turn == TURNS - 1 else 1)
            found.append((sums ^ salt)[own])
            if empty:
                deleted = np.zeros(m, bool)
                deleted[several[:empty]] = True
                some = deleted[segment]
                found.append((sums[segment[some]] - weight[some]) ^ salt[segment[some]])
            if not few:
                break
        keys = np.unique(mix(np.concatenate(found)))
        out.append(keys)
        homes.append(np.full(len(keys), number == 0))
    return np.concatenate([*out, np.zeros(0, U64)]), np.concatenate([*homes, np.zeros(0, bool)])


def _sketch(values: np.ndarray, bands: Bands) -> bytes:
    """Parities of the shingles that fall on each of a power of two of bits, about 16 times those that may differ."""
    bits = 64
    while bits < 16 * bands.differ(len(values), len(values)):
        bits *= 2
    odd = np.bincount((mix(values + U64(991)) % U64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _by_text(part: pa.RecordBatch, k: int):
    """Shingles of the texts, where each text's begin, and of each text: number and two sums (128 bits) that tell sets apart."""
    doc, values = shingles(texts(part), k)
    first = np.searchsorted(doc, np.arange(part.num_rows + 1))
    one, two = (np.concatenate([[U64(0)], np.cumsum(mix(values ^ U64(x)))]) for x in (0, 0x5EED))
    n, one, two = np.diff(first), one[first[1:]] - one[first[:-1]], two[first[1:]] - two[first[:-1]]
    return values, first, n, one, two


def _kind(n: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """An even number for each class of equal sets."""
    return mix(one ^ mix(two + n.astype(U64))) & ~U64(1)


def _sets(docs: DataFrame, k: int, p: int, q: int) -> DataFrame:
    """(id, n, one, two, kind, sketch) of each row."""

    def run(batches):
        bands = Bands(p, q)
        for batch in batches:
            for part in steps(batch, limit=2 << 20):
                values, first, n, one, two = _by_text(part, k)
                sketches = [_sketch(values[a:b], bands) if b > a else b"" for a, b in zip(first[:-1], first[1:], strict=True)]
                yield batch_of(id=part.column(0), n=n, one=signed(one), two=signed(two), kind=signed(_kind(n, one, two)), sketch=pa.array(sketches, pa.binary()))

    return docs.mapInArrow(run, "id bigint, n bigint, one bigint, two bigint, kind bigint, sketch binary")


def _key_rows(docs: DataFrame, k: int, p: int, q: int) -> DataFrame:
    """(key, owner): the keys of each class that a slice of texts holds; an owner is the class, plus 1 where the key is of its own band."""

    def run(batches):
        bands = Bands(p, q)
        for batch in batches:
            for part in steps(batch, limit=8 << 20):
                values, first, n, one, two = _by_text(part, k)
                kind, keys, owners = _kind(n, one, two), [], []
                for i in np.unique(kind, return_index=True)[1]:
                    if n[i]:
                        own, home = _keys(values[first[i] : first[i + 1]], bands)
                        keys.append(own)
                        owners.append(kind[i] + home.astype(U64))
                key, owner = (signed(np.concatenate([*x, np.zeros(0, U64)])) for x in (keys, owners))
                for i in range(0, len(key), 1 << 16):
                    yield batch_of(key=key[i : i + (1 << 16)], owner=owner[i : i + (1 << 16)])

    return docs.where("id is not null").mapInArrow(run, "key bigint, owner bigint")


def _kept(rows: DataFrame) -> DataFrame:
    """(key, kind, home, many) for rows (key, kind, home), each once: keys with two classes or more, at home in one; of keys with
    equal members the least. A key's rows are summed where they lie, then joined, so a key that very many classes share
    is not one task's work."""
    marks = [F.bit_xor(F.xxhash64("kind", "home", F.lit(i))).alias(f"mark{i}") for i in range(2)]
    keys = rows.groupBy("key").agg(*marks, F.count("*").alias("many"), F.max("home").alias("homes")).where("many > 1 and homes")
    return rows.join(keys.groupBy("mark0", "mark1", "many").agg(F.min("key").alias("key")).select("key", "many"), "key")


def _buckets(docs: DataFrame, classes: DataFrame, k: int, p: int, q: int) -> DataFrame:
    """(key, kind, id, n, home, sketch, many): classes that share a key, which is at home in one."""
    home = F.col("owner").bitwiseAND(F.lit(1))
    rows = _key_rows(docs, k, p, q).select("key", (F.col("owner") - home).alias("kind"), (home == 1).alias("home"))
    # Most keys are one class's. These go first, by an aggregation that needs no key's rows in one place.
    shared = rows.groupBy("key").agg(F.min("kind").alias("low"), F.max("kind").alias("high"), F.max("home").alias("homes")).where("low <> high and homes").select("key")
    rows = checkpoint(rows.join(checkpoint(shared), "key"))
    return checkpoint(_kept(rows.distinct()).join(classes, "kind").select("key", "kind", "id", "n", "home", "sketch", "many"))


def _counts(docs: DataFrame, k: int) -> np.ndarray:
    """How many of the texts have a shingle of each of COUNTERS hashes: COUNTERS numbers, whatever the number of texts."""
    each = COUNTERS >> 6

    def run(batches):
        counts = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for part in steps(batch, limit=8 << 20):
                counts += np.bincount(_counter(shingles(texts(part), k)[1]), minlength=COUNTERS)
        for i in range(64):
            own = np.flatnonzero(counts[i * each : (i + 1) * each])
            if len(own):
                packed = [own.astype(np.int32), counts[i * each + own]]
                yield batch_of(part=pa.array([i], pa.int32()), **{n: pa.array([x.tobytes()], pa.binary()) for n, x in zip(("at", "n"), packed, strict=True)})

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(each, np.int64)
        for at, n in zip(t["at"].to_pylist(), t["n"].to_pylist(), strict=True):
            total[np.frombuffer(at, np.int32)] += np.frombuffer(n, np.int64)
        return pa.table({"part": t["part"][:1], "n": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros(COUNTERS, np.int64)
    for part, n in docs.mapInArrow(run, "part int, at binary, n binary").groupBy("part").applyInArrow(add, "part int, n binary").collect():
        out[part * each : (part + 1) * each] = np.frombuffer(n, np.int64)
    return out


def _counter(values: np.ndarray) -> np.ndarray:
    return (mix(values + U64(4242)) % U64(COUNTERS)).astype(np.int64)


def _rarest(docs: DataFrame, counts: np.ndarray, k: int, p: int, q: int) -> DataFrame:
    """(kind, shingle, place): of each text's shingles, rarest first, as many as leave fewer than a linked set must share."""

    def run(batches):
        for batch in batches:
            for part in steps(batch, limit=8 << 20):
                values, first, n, one, two = _by_text(part, k)
                kind, rows = _kind(n, one, two), []
                for i in np.unique(kind, return_index=True)[1]:
                    own = values[first[i] : first[i + 1]]
                    own = own[np.lexsort((own, counts[_counter(own)]))][: len(own) + -p * len(own) // q + 1]
                    rows.append((np.full(len(own), kind[i]), own, np.arange(len(own))))
                kinds, own, place = (np.concatenate(x) for x in zip(*rows, strict=True))
                for i in range(0, len(own), 1 << 16):
                    e = slice(i, i + (1 << 16))
                    yield batch_of(kind=signed(kinds[e].astype(U64)), shingle=signed(own[e]), place=pa.array(place[e], pa.int32()))

    return docs.mapInArrow(run, "kind bigint, shingle bigint, place int").distinct()


def _size_class(n, p: int, q: int):
    """A number that does not fall as n rises: n itself at first, then some 8 numbers for sizes up to q / p times n."""
    base = 8 * q // (q - p)
    return F.when(n <= base, n).otherwise(base + F.floor(F.log(n / base) * (8 / np.log(q / p)))).cast("bigint")


def _split(buckets: DataFrame, label: DataFrame | None, docs: DataFrame, k: int, p: int, q: int) -> DataFrame:
    """Buckets without the large ones of two labels or more, and with smaller ones that have all pairs of theirs that may link.

    Any order of all shingles will do; here rare ones come first. Linked sets X, Y share p / q of either set's shingles
    at least, so all but x - ceil(p x / q) of X's. If of the first x - ceil(p x / q) + 1 of X and the like of Y none were
    shared, take the set whose last of these comes first, say X: a shared shingle is not among these of X, hence comes after
    them, and X has fewer than p x / q left. So the first shared shingle is among both, and is a bucket of both.
    If it stands at place i (from 0) of X, the sets share x - i at most, which p (x + y) / (p + q) may not pass: that bounds
    y. A shingle with over BUCKET sets has a bucket a size class, for sets whose first shared shingle it may be: a set is at
    home in its own class and goes to smaller classes within its bounds, so each pair meets in the smaller set's class."""
    rows = _open(buckets, label)
    hot = checkpoint(rows.where(F.col("many") > BUCKET).select("kind", "id", "n", "sketch").dropDuplicates(["kind"]))
    rest = buckets.where(F.col("many") <= BUCKET)
    ids = hot.select("id").distinct()
    ids = F.broadcast(ids) if hot.count() <= SENT else ids.hint("merge")
    own = docs.join(ids, "id")
    found = _rarest(own, _counts(own, k), k, p, q).join(hot.select("kind", "n"), "kind")
    x, i = F.col("n"), F.col("place")
    low, high = F.ceil(x * p / q), F.least(F.floor(x * q / p), F.floor((p + q) * (x - i) / p) - x)
    found = checkpoint(found.withColumns({"low": low - 1, "high": high + 1}).where("low <= high"))  # a size to spare for rounding
    many = found.groupBy("shingle").agg(F.count("*").alias("many")).where("many > 1")
    found = found.join(many, "shingle")
    few = found.where(F.col("many") <= BUCKET).select(F.xxhash64("shingle").alias("key"), "kind", F.lit(True).alias("home"))
    some = found.where(F.col("many") > BUCKET).select("shingle", "kind", *(_size_class(F.col(c), p, q).alias(c) for c in ("n", "low", "high")))
    home = some.where("high >= n").select("shingle", "kind", F.col("n").alias("class"), F.lit(True).alias("home"))
    guest = some.where("low < n and low <= high").select("shingle", "kind", F.explode(F.sequence("low", F.least(F.col("n") - 1, F.col("high")))).alias("class"), F.lit(False).alias("home"))
    split = home.union(guest).select(F.xxhash64("shingle", "class").alias("key"), "kind", "home")
    new = _kept(few.union(split)).join(hot, "kind").select("key", "kind", "id", "n", "home", "sketch", "many")
    return checkpoint(rest.unionByName(new))


class _Block:
    """Rows of whole blocks of buckets, and which pairs of them may link."""

    def __init__(self, t: pa.Table, bands: Bands):
        self.bands = bands
        self.id, self.n, self.label = (t[c].to_numpy() for c in ("id", "n", "label"))
        self.home, self.guest = (np.asarray(t[c]) for c in ("home", "guest"))
        raw = [np.frombuffer(x.as_buffer(), U64) for x in t["sketch"]]
        self.words = np.array([len(x) for x in raw], np.int64)
        self.at = np.cumsum(self.words) - self.words
        self.bits = np.concatenate([*raw, np.zeros(0, U64)])

    def fits(self, i: np.ndarray, j: np.ndarray):
        """The pairs that may link, and in how many bits they differ."""
        x, y = self.n[i], self.n[j]
        ok = (self.home[i] | self.home[j]) & (np.minimum(x, y) * self.bands.q >= self.bands.p * np.maximum(x, y))
        some = np.flatnonzero(ok & (self.id[i] != self.id[j]) & (self.label[i] != self.label[j]) & ~(self.guest[i] & self.guest[j]))
        i, j = i[some], j[some]
        far, sizes = np.zeros(len(i), np.int64), self.words[i] * 2**32 + self.words[j]
        for size in np.unique(sizes):
            now = np.flatnonzero(sizes == size)
            one, two = (self.bits[self.at[r[now]][:, None] + np.arange(int(w))] for r, w in ((i, size >> 32), (j, size & (2**32 - 1))))
            while one.shape[1] > two.shape[1]:
                one = one[:, : one.shape[1] // 2] ^ one[:, one.shape[1] // 2 :]
            while two.shape[1] > one.shape[1]:
                two = two[:, : two.shape[1] // 2] ^ two[:, two.shape[1] // 2 :]
            far[now] = np.bitwise_count(one ^ two).sum(axis=1)
        ok = far <= self.bands.differ(self.n[i], self.n[j])
        return i[ok], j[ok], far[ok]


def _fitting(block: _Block, begin: np.ndarray, end: np.ndarray):
    """Pairs of rows of one block that may link, some at a time."""
    size = end - begin
    for s in np.unique(size[(size > 1) & (size <= 64)]):
        left, right = np.triu_indices(int(s), 1)
        starts = begin[size == s]
        each = max(1, (1 << 16) // len(left))
        for k in range(0, len(starts), each):
            yield block.fits((starts[k : k + each, None] + left).ravel(), (starts[k : k + each, None] + right).ravel())
    for a, b in zip(begin[size > 64], end[size > 64], strict=True):
        each = max(1, (1 << 16) // int(b - a))
        for k in range(a, b, each):
            i, j = np.meshgrid(np.arange(k, min(b, k + each)), np.arange(k + 1, b), indexing="ij")
            yield block.fits(i[i < j], j[i < j])


def _foremost(rows: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of (row, measure, partner) in columns the `most` of least measure of each row, and the rows that have more."""
    rows = rows[:, np.lexsort((rows[2], rows[1], rows[0]))]
    first = np.searchsorted(rows[0], rows[0])
    rank = np.arange(rows.shape[1]) - first
    return rows[:, rank < most], rows[0, rank == most]


def _candidates(blocks: DataFrame, p: int, q: int, most: int, nearest: bool, dealt: bool) -> DataFrame:
    """(u, v): of each row in a block the first `most` rows that it may link with, by id or by nearness. Beside these, with u and
    v null, (key, more) of the buckets whose pairs are not all there: more where a row has others, else where the bucket is `dealt`
    to several blocks."""

    def emit(t: pa.Table):
        key, part, many = (t[k].to_numpy() for k in ("key", "part", "many"))
        cut = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])]))
        block = _Block(t, Bands(p, q))
        held, over = np.zeros((3, 0), np.int64), [np.zeros(0, np.int64)]
        for i, j, far in _fitting(block, cut, np.append(cut[1:], t.num_rows)):
            measure = (far, far) if nearest else (block.id[j], block.id[i])
            new = np.stack([np.concatenate(x) for x in ((i, j), measure, (j, i))])
            held, others = _foremost(np.concatenate([held, new], axis=1), most)
            over.append(others)
        if held.shape[1]:
            a, b = block.id[held[0]], block.id[held[2]]
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            none = [pa.nulls(pairs.shape[1], kind) for kind in (pa.int64(), pa.bool_())]
            yield batch_of(u=pairs[0], v=pairs[1], key=none[0], more=none[1])
        more = np.unique(key[np.concatenate(over)])
        rest = np.setdiff1d(key[many > BUCKET], more) if dealt else more[:0]
        if len(more) + len(rest):
            none = pa.nulls(len(more) + len(rest), pa.int64())
            yield batch_of(u=none, v=none, key=np.concatenate([more, rest]), more=pa.array(np.arange(len(none)) < len(more)))

    def run(batches):
        for t in whole_groups(batches, "key", "part"):
            yield from emit(t)

    rows = blocks.select("key", "part", "id", "n", "home", "guest", "label", "sketch", "many").repartition("key", "part").sortWithinPartitions("key", "part", "id")
    return rows.mapInArrow(run, "u bigint, v bigint, key bigint, more boolean").groupBy("u", "v", "key").agg(F.max("more").alias("more"))


def _open(buckets: DataFrame, label: DataFrame | None) -> DataFrame:
    """The rows of buckets with two labels or more, with their label."""
    if label is None:
        return buckets.withColumn("label", F.col("id"))
    rows = buckets.join(label, "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")
    open_ = rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    return rows.join(open_, "key", "left_semi")


def _blocks(buckets: DataFrame, label: DataFrame | None, deal: int) -> DataFrame:
    """The rows of buckets with two labels or more, dealt to blocks; from deal number DEALS on, when large buckets are split, a
    row of a bucket that is large even so, whose label is not the bucket's most frequent one, is a guest in its other blocks."""
    rows = _open(buckets, label)
    parts = F.ceil(F.col("many") / BUCKET).cast("int")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("key", "id", F.lit(min(deal, DEALS))), parts).cast("int")).withColumn("guest", F.lit(False))
    large = rows.where(F.col("many") > BUCKET)
    if deal < DEALS or large.isEmpty():
        return rows
    most = large.groupBy("key", "label").count().groupBy("key").agg(F.max_by("label", "count").alias("most"))
    guests = large.join(most, "key").where("label <> most").withColumn("own", F.col("part")).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return rows.unionByName(guests.where("part <> own").drop("own", "most").withColumn("guest", F.lit(True)))


def _set(text: bytes, k: int) -> set[bytes]:
    words = lowered(np.frombuffer(text, np.uint8)).tobytes().split()
    if len(words) < k:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False)))


def _verified(pairs: DataFrame, docs: DataFrame, k: int, p: int, q: int, send: bool) -> DataFrame:
    """Pairs (u, v, linked) judged by their whole texts: v's text goes to u's, STAR texts to each copy of u's.
    With `send` the ids of the pairs, SENT at most, go to the tasks that read the texts; else both are dealt out by id."""
    size = pairs.groupBy("u").agg(F.ceil(F.count("*") / STAR).cast("int").alias("salts"))
    members = pairs.join(size, "u").select(F.col("v").alias("id"), F.col("u").alias("hub"), F.pmod(F.xxhash64("v"), F.col("salts")).cast("int").alias("salt"))
    hubs = size.select(F.col("u").alias("id"), F.col("u").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    asked = members.union(hubs)
    asked = F.broadcast(asked) if send else asked.hint("merge")
    sent = docs.join(asked, "id").select("hub", "salt", "id", "text").repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.col("id") != F.col("hub"))

    def run(batches):
        known, own = None, []
        for batch in batches:
            u, v, linked = [], [], []
            for hub, salt, i, text in zip(*(batch.column(c).to_pylist() for c in range(3)), batch.column(3), strict=True):
                if (hub, salt) != known:
                    known, own = (hub, salt), []
                found = _set(text.as_buffer().to_pybytes(), k)
                if i == hub:
                    own.append(found)
                    continue
                u.append(hub)
                v.append(i)
                linked.append(any(x and q * len(x & found) >= p * len(x | found) for x in own))
            yield batch_of(u=pa.array(u, pa.int64()), v=pa.array(v, pa.int64()), linked=pa.array(linked, pa.bool_()))

    return sent.mapInArrow(run, "u bigint, v bigint, linked boolean").groupBy("u", "v").agg(F.max("linked").alias("linked"))


def _links(buckets: DataFrame, docs: DataFrame, k: int, p: int, q: int) -> tuple[DataFrame, DataFrame | None]:
    """Links (u, v) whose components are those of all links, and the components."""
    judged = buckets.sparkSession.createDataFrame([], "u bigint, v bigint, linked boolean")
    large = not buckets.where(F.col("many") > BUCKET).isEmpty()
    label, turn, most = None, 0, 1
    while True:
        if large and turn == DEALS:
            buckets = _split(buckets, label, docs, k, p, q)
        found = checkpoint(_candidates(_blocks(buckets, label, turn), p, q, most, nearest=turn > 0, dealt=turn < DEALS))
        new = found.where("key is null").select("u", "v")
        new = checkpoint(new.join(judged, ["u", "v"], "left_anti")) if turn else new
        count, linked = new.count(), False
        if count:
            verdict = checkpoint(_verified(new, docs, k, p, q, send=turn > 0 and 2 * count <= SENT))
            judged = judged.union(verdict)
            linked = not verdict.where("linked").isEmpty()
        if linked:  # what was linked before is as its components say
            links = verdict.where("linked").select("u", "v")
            label = components(links if label is None else links.union(label.select(F.col("id").alias("u"), F.col("component").alias("v"))))
        # All pairs across components of the other buckets are judged, and stay so as components grow.
        rest = found.where("key is not null").select("key", "more")
        open_, more = rest.agg(F.count("*"), F.max("more")).first()
        if not open_:
            return judged.where("linked").select("u", "v"), label
        buckets = checkpoint(buckets.join(rest.select("key"), "key", "left_semi"))
        if more and (not linked or not large):
            most *= 8
        turn += 1


def similar(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, p: int = 80, q: int = 100) -> DataFrame:
    """(key, n_shingles, component_id): documents link if q * |intersection| >= p * |union| of their shingles of k words."""
    docs = df.select(F.col(key).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    of_class = ["n", "one", "two"]
    with swept(df.sparkSession):
        sets = checkpoint(_sets(docs, k, p, q))
        classes = sets.where("id is not null and n > 0").groupBy(*of_class).agg(F.min("id").alias("id"), F.min("kind").alias("kind"), F.min("sketch").alias("sketch"))
        classes = checkpoint(classes)
        buckets = _buckets(docs, classes.select("kind", "id", "n", "sketch"), k, p, q)
        links, label = _links(buckets, docs.where("id is not null"), k, p, q)
        named = sets.select("id", *of_class).join(classes.select(*of_class, F.col("id").alias("class")), of_class, "left")
        # A key with several texts links their classes.
        several = named.where("id is not null").groupBy("id").agg(F.min("class").alias("u"), F.max("class").alias("high")).where("u <> high").select("id", "u")
        own = checkpoint(named.join(several, "id").where("class <> u").select("u", F.col("class").alias("v")))
        if not own.isEmpty():
            label = components(links.union(own))
        if label is None:
            label = sets.sparkSession.createDataFrame([], "id bigint, component bigint")
    named = sets.select("id", *of_class).join(classes.select(*of_class, F.col("id").alias("class")), of_class, "left")
    out = named.join(label.select(F.col("id").alias("class"), "component"), "class", "left")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "class", "id")).alias("component_id"))


def op5_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents"), k=3, p=90, q=100)
