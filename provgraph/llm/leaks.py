"""Benchmark decontamination by a generalised suffix automaton of the test items' words.

Items are dealt to shards by their text; a task a shard builds the automaton of its items (a state for each class
of runs of words that end at the same places, suffix links, transitions by word number). Documents stream through:
words that no item has, or pairs of neighbours that none has, end a match; on the runs between, all runs of a
slice at once, the automaton tracks the longest run of item words that ends at each word. Where it is as long as a
window, the window's words are hit and the window's state names the items that hold it; an item shorter than a
window is found on the chain of suffix links. Spans of hit words are cut from the text, and a document with too
large a share of hit words is marked to go as a whole.

A document is a row a shard only where shards do not fit one pass: automata of `PASS_WORDS` item words together
are sent to all tasks at once, and a larger benchmark takes more passes over the documents, whose findings are
merged by row. An item of over `SHARD_WORDS` words is cut into pieces that overlap by a window less a word, so
that no window is lost. Words are compared by their bytes where they meet in a match, not by their hash alone.

Defined results: a null text has no words; items with a null id, a null text or no words take no part; items that
repeat an id are one item with the windows of each text; rows that repeat a document's key are judged each by its
own text, and a null key is kept; an empty table of documents gives an empty one, an empty benchmark hits nothing.
Only keys and texts are read, so other columns, of any name, do not clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, batch_of, checkpoint, hash_ranges, steps, table, texts

#: Item words of a shard, and of the shards that one pass over the documents takes (some 60 bytes a word in each task).
SHARD_WORDS, PASS_WORDS = 100_000, 400_000

#: Bytes between words: all of ASCII but digits and letters.
APART = np.ones(256, bool)
APART[0x30:0x3A] = APART[0x41:0x5B] = APART[0x61:0x7B] = APART[0x80:] = False


class Automaton:
    """The generalised suffix automaton of some rows of word numbers. State 0 is the empty run."""

    def __init__(self, rows: list[list[int]]):
        self.longest, self.link, self.to = [0], [-1], [{}]
        for row in rows:
            last = 0
            for word in row:
                last = self._extend(last, word)

    def _new(self, longest: int, link: int, to: dict[int, int]) -> int:
        self.longest.append(longest)
        self.link.append(link)
        self.to.append(to)
        return len(self.to) - 1

    def _split(self, state: int, word: int) -> int:
        """The state of the longest run of `state` followed by `word`; its own if the transition's target has longer ones too."""
        target = self.to[state][word]
        if self.longest[target] == self.longest[state] + 1:
            return target
        own = self._new(self.longest[state] + 1, self.link[target], dict(self.to[target]))
        self.link[target] = own
        while state >= 0 and self.to[state].get(word) == target:
            self.to[state][word] = own
            state = self.link[state]
        return own

    def _extend(self, last: int, word: int) -> int:
        if word in self.to[last]:
            return self._split(last, word)
        own, state = self._new(self.longest[last] + 1, 0, {}), last
        while state >= 0 and word not in self.to[state]:
            self.to[state][word] = own
            state = self.link[state]
        if state >= 0:
            self.link[own] = self._split(state, word)
        return own

    def walk(self, row: list[int]) -> list[int]:
        """The state after each word of a row that the automaton has."""
        out, state = [], 0
        for word in row:
            state = self.to[state][word]
            out.append(state)
        return out


def _item_words(text: str) -> list[bytes]:
    w = Words(pa.array([text]), lower=True, apart=APART)
    raw = w.raw.tobytes()
    return [raw[a:b] for a, b in zip(w.begin.tolist(), w.end.tolist(), strict=True)]


def _packed(arrays: dict[str, np.ndarray]) -> dict[str, pa.Array]:
    return {k: pa.array([a.tobytes()], pa.binary()) for k, a in arrays.items()}


#: The arrays of a packed shard and their types.
ARRAYS = {"letters": np.uint8, "ends": np.int64, "keys": np.int64, "targets": np.int32, "longest": np.int32, "link": np.int32, "window": np.int32, "short": np.int32, "short_size": np.int32, "at": np.int64, "items": np.int64}


def build(rows: list[tuple[int, list[bytes]]], length: int) -> dict[str, np.ndarray]:
    """The packed automaton of (item, words) rows, for windows of `length` words.

    letters, ends: the vocabulary in byte order. keys (state * vocabulary + word, rising), targets: transitions.
    window: of each state the one on its chain of links whose runs include those of `length` words, or -1. short,
    short_size: the nearest state of the chain, itself included, at which an item of fewer words ends, or -1, and that
    item's words. at, items: of each state the items whose windows or whole words end in it."""
    vocabulary = sorted({x for _, words in rows for x in words})
    number = {x: i for i, x in enumerate(vocabulary)}
    own = [[number[x] for x in words] for _, words in rows]
    auto, n = Automaton(own), max(1, len(vocabulary))
    longest, link = np.array(auto.longest), np.array(auto.link)
    window, short, size = np.full(len(link), -1), np.full(len(link), -1), np.zeros(len(link), np.int64)
    order = np.argsort(longest, kind="stable")
    for v in order[longest[order] >= length].tolist():
        window[v] = v if longest[link[v]] < length else window[link[v]]
    held = set()
    for (item, _), words in zip(rows, own, strict=True):
        states = auto.walk(words)
        if len(words) < length:
            held.add((states[-1], item))
            short[states[-1]], size[states[-1]] = states[-1], len(words)
        else:
            held |= {(int(window[v]), item) for v in states[length - 1 :]}
    for v in order[1:].tolist():
        if short[v] < 0 and short[link[v]] >= 0:
            short[v], size[v] = short[link[v]], size[link[v]]
    states, items = np.array(sorted(held), np.int64).reshape(-1, 2).T
    moves = sorted((v * n + word, target) for v, to in enumerate(auto.to) for word, target in to.items())
    keys, targets = np.array(moves, np.int64).reshape(-1, 2).T
    found = {
        "letters": np.frombuffer(b"".join(vocabulary), np.uint8), "ends": np.cumsum([0, *map(len, vocabulary)]), "keys": keys, "targets": targets, "longest": longest, "link": link,
        "window": window, "short": short, "short_size": size, "at": np.searchsorted(states, np.arange(len(link) + 1)), "items": items,
    }
    return {k: np.ascontiguousarray(v, ARRAYS[k]) for k, v in found.items()}


class Matcher:
    """Finds a packed automaton's windows in texts."""

    def __init__(self, arrays: dict[str, bytes], length: int):
        self.length = length
        for k, kind in ARRAYS.items():
            setattr(self, k, np.frombuffer(arrays[k], kind))
        begin, end = self.ends[:-1], self.ends[1:]
        self.size = end - begin
        hashes = hash_ranges(self.letters, begin, end, 3)
        self.order = np.argsort(hashes)
        self.hashes, self.n = hashes[self.order], max(1, len(begin))
        # Pairs of neighbours: the transitions out of the states that single words lead to from the start.
        first = self.targets[: np.searchsorted(self.keys, self.n)].astype(np.int64)
        pairs = [self._pairs(w, v) for w, v in zip(self.keys[: len(first)].tolist(), first.tolist(), strict=True)]
        self.pairs = np.concatenate([*pairs, np.zeros(0, np.int64)])
        sizes = self.short_size[self.short >= 0]
        self.least = min(length, int(sizes.min())) if len(sizes) else length

    def _pairs(self, word: int, state: int) -> np.ndarray:
        a, b = np.searchsorted(self.keys, [state * self.n, (state + 1) * self.n])
        return word * self.n + (self.keys[a:b] - state * self.n)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number in the vocabulary of each word by its hash, -1 where it has none."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        spot = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[spot] == hashes, self.order[spot], -1)

    def _move(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        key = state.astype(np.int64) * self.n + word
        spot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[spot] == key, self.targets[spot], -1)

    def runs(self, w: Words, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First word and length of each run of words whose neighbours are neighbours in an item."""
        there = number >= 0
        if len(number) > 1:
            near = np.flatnonzero(there[:-1] & there[1:] & (w.doc[:-1] == w.doc[1:]))
            key = number[near] * self.n + number[near + 1]
            near = near[self.pairs[np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)] == key] if len(self.pairs) else near[:0]
        else:
            near = np.zeros(0, np.int64)
        joined = np.zeros(len(number) + 1, bool)
        joined[near + 1] = True  # to the word before
        begin = np.flatnonzero(there & ~joined[:-1])
        if not len(begin):
            return begin, begin
        stop = np.flatnonzero(~joined[1:] & there) + 1
        size = stop - begin
        long = size >= self.least
        return begin[long], size[long]

    def _same(self, w: Words, at: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Whether the words at these places have the bytes of their numbers."""
        size = w.end[at] - w.begin[at]
        ok = size == self.size[number]
        some = np.flatnonzero(ok)
        size = size[some]
        if not len(some):
            return ok
        rank = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        equal = w.raw[rank + np.repeat(w.begin[at[some]], size)] == self.letters[rank + np.repeat(self.ends[number[some]], size)]
        ok[some] = np.logical_and.reduceat(equal, np.cumsum(size) - size)
        return ok

    def longest_matches(self, w: Words, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place, state and length of the longest run of item words that ends there, for the words of runs."""
        begin, size = self.runs(w, number)
        inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)
        other = inside[~self._same(w, inside, number[inside])]
        if len(other):  # two words with one hash
            number = number.copy()
            number[other] = -1
            begin, size = self.runs(w, number)
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        state, long = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
        out = []
        for t in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -t, "left"))  # runs of more than t words
            word, v, m = number[begin[:n] + t], state[:n].copy(), long[:n].copy()
            left = np.arange(n)
            while len(left):
                to = self._move(v[left], word[left])
                hit = to >= 0
                m[left[hit]] += 1
                v[left[hit]] = to[hit]
                left = left[~hit]
                v[left] = self.link[v[left]]
                m[left] = self.longest[v[left]]
            state[:n], long[:n] = v, m
            out.append((begin[:n] + t, v, m))
        if not out:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def find(self, w: Words, number: np.ndarray):
        """Which words are hit, (text, state) of the windows found, each once, and each text's longest match."""
        place, state, long = self.longest_matches(w, number)
        edges, docs, states = np.zeros(len(w) + 1, np.int64), [], []
        full = long >= self.length
        p = place[full]
        np.add.at(edges, p - self.length + 1, 1)
        np.add.at(edges, p + 1, -1)
        docs.append(w.doc[p])
        states.append(self.window[state[full]])
        best = np.zeros(len(w.count), np.int64)
        np.maximum.at(best, w.doc[place], long)
        # Of a state's own runs those of up to `long` words end here; of the states its links lead to, all.
        v = np.where((self.short[state] == state) & (self.short_size[state] > long), self.link[state], state) if len(state) else state
        while len(v):
            v = np.where(v >= 0, self.short[v], -1)
            there = v >= 0
            place, v = place[there], v[there]
            size = self.short_size[v]
            np.add.at(edges, place - size + 1, 1)
            np.add.at(edges, place + 1, -1)
            docs.append(w.doc[place])
            states.append(v)
            v = self.link[v]
        found = np.unique(np.stack([np.concatenate(docs), np.concatenate(states)]), axis=1)
        return np.cumsum(edges[:-1]) > 0, found[0], found[1], best


def _shards(items: DataFrame, key: str, text: str, length: int) -> tuple[DataFrame, list[list[int]]]:
    """Packed automata (shard, arrays) in the shared folder, and the shards of each pass."""
    rows = items.select(F.col(key).cast("string").alias("item"), F.col(text).alias("text")).where("item is not null and text is not null")
    rows = rows.groupBy("text").agg(F.sort_array(F.collect_set("item")).alias("names"))

    def cut(batches):
        for batch in batches:
            for part in steps(batch):
                words, own = [], []
                for i, x in enumerate(texts(part)):
                    found = _item_words(x.as_py())
                    for a in range(0, max(1, len(found) - length + 1), SHARD_WORDS):
                        if found:
                            words.append(found[a : a + SHARD_WORDS + length - 1])
                            own.append(i)
                yield batch_of(names=part.column(1).take(pa.array(own, pa.int64())), words=pa.array(words, pa.list_(pa.binary())))

    pieces = checkpoint(rows.mapInArrow(cut, "names array<string>, words array<binary>"))
    total = pieces.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    shards = max(1, -(-total // SHARD_WORDS))

    def pack(t: pa.Table) -> pa.Table:
        names = t["names"].to_pylist()
        arrays = build([(i, words) for i, words in enumerate(t["words"].to_pylist())], length)
        return pa.table({"shard": t["shard"][:1], "words": pa.array([len(t["words"].combine_chunks().flatten())], pa.int64()), "names": pa.array([names], pa.list_(pa.list_(pa.string()))), **_packed(arrays)})

    schema = "shard int, words bigint, names array<array<string>>, " + ", ".join(f"{k} binary" for k in ARRAYS)
    built = checkpoint(pieces.withColumn("shard", F.pmod(F.xxhash64("words"), F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(pack, schema))
    passes, held = [], PASS_WORDS
    for shard, words in sorted(tuple(r) for r in built.select("shard", "words").collect()):
        if held + words > PASS_WORDS or not passes:
            passes.append([])
            held = 0
        passes[-1].append(shard)
        held += words
    return built, passes


FINDINGS = "longest int, begins array<int>, ends array<int>, items array<string>"


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _pass(docs: DataFrame, shards: list[dict], length: int, keep: bool) -> DataFrame:
    """docs (id, text), the text only with `keep`, with what one pass finds: the number of words, the longest match, first
    word and last + 1 of each run of hit words, items."""
    sent = docs.sparkSession.sparkContext.broadcast(shards)
    out = docs if keep else docs.drop("text")
    names = out.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [(Matcher(s, length), s["names"]) for s in sent.value]
        for batch in batches:
            for part in steps(batch):
                w = Words(texts(part), lower=True, apart=APART)
                hashes = w.hashes(3)
                hit, best, items = np.zeros(len(w), bool), np.zeros(part.num_rows, np.int64), [set() for _ in range(part.num_rows)]
                for matcher, named in known:
                    own, doc, state, long = matcher.find(w, matcher.numbers(hashes))
                    hit |= own
                    best = np.maximum(best, long)
                    for d, v in zip(doc.tolist(), state.tolist(), strict=True):
                        for i in matcher.items[matcher.at[v] : matcher.at[v + 1]].tolist():
                            items[d].update(named[i])
                first = np.flatnonzero(hit & ~(np.append(False, hit[:-1]) & (np.append(-1, w.doc[:-1]) == w.doc)))
                last = np.flatnonzero(hit & ~(np.append(hit[1:], False) & (np.append(w.doc[1:], -1) == w.doc))) + 1
                cut = pa.array(np.searchsorted(w.doc[first], np.arange(part.num_rows + 1)), pa.int32())
                base = w.first[w.doc[first]]
                lists = [pa.ListArray.from_arrays(cut, pa.array(x - base, pa.int32())) for x in (first, last)]
                columns = {c: part[c] for c in names} | {"n_words": pa.array(w.count, pa.int64()), "longest": pa.array(best, pa.int32()), "begins": lists[0], "ends": lists[1]}
                yield batch_of(**columns, items=pa.array([sorted(x) for x in items], pa.list_(pa.string())))

    return docs.mapInArrow(run, f"{_schema(out)}, n_words bigint, {FINDINGS}")


def _union(t: pa.Table) -> pa.Table:
    """One row's findings of several passes."""
    begins, ends = (np.concatenate([x.values.to_numpy() for x in t[c]]) for c in ("begins", "ends"))
    edges = np.zeros(int(ends.max(initial=0)) + 1, np.int64)
    np.add.at(edges, begins, 1)
    np.add.at(edges, ends, -1)
    inside = np.diff(np.concatenate([[0], np.cumsum(edges) > 0, [0]]).astype(np.int8))
    spans = {k: pa.array([np.flatnonzero(inside == v)], pa.list_(pa.int32())) for k, v in (("begins", 1), ("ends", -1))}
    items = sorted({x for row in t["items"].to_pylist() for x in row})
    return pa.table({"row": t["row"][:1], "longest": pa.array([max(t["longest"].to_pylist())], pa.int32()), **spans, "items": pa.array([items], pa.list_(pa.string()))})


def _merged(docs: DataFrame, built: DataFrame, passes: list[list[int]], length: int, keep: bool) -> DataFrame:
    """docs (id, text) with the findings of all passes."""
    if len(passes) <= 1:
        return _pass(docs, [r.asDict() for r in built.collect()], length, keep)
    docs = checkpoint(docs.withColumn("row", F.expr("uuid()")))
    every = _pass(docs, [], length, keep).drop(*(x.split()[0] for x in FINDINGS.split(", ")))
    found = None
    for shards in passes:
        own = _pass(docs.select("row", "text"), [r.asDict() for r in built.where(F.col("shard").isin(shards)).collect()], length, False)
        own = own.where("longest > 0").drop("n_words")
        found = own if found is None else found.unionByName(own)
    merged = found.groupBy("row").applyInArrow(_union, f"row string, {FINDINGS}")
    none = {"longest": F.lit(0)} | {k: F.expr(f"cast(array() as array<{v}>)") for k, v in (("begins", "int"), ("ends", "int"), ("items", "string"))}
    return every.join(merged, "row", "left").drop("row").withColumns({k: F.coalesce(k, v) for k, v in none.items()})


def _findings(df: DataFrame, items: DataFrame, key: str, text: str, item: str, item_text: str, length: int, keep: bool) -> DataFrame:
    if length < 1:
        raise ValueError("a window has a word at least")
    docs = df.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = _merged(docs, *_shards(items, item, item_text, length), length, keep)
    return found.withColumn("n_hit", F.aggregate(F.zip_with("begins", "ends", lambda a, b: b - a), F.lit(0).cast("bigint"), lambda a, b: a + b))


def contamination(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", length: int = 10) -> DataFrame:
    """(key, n_words, n_hit, longest, begins, ends, items): of each row the words that occurring windows of items cover, as runs
    from word `begins` to before word `ends`, the items they are of (as strings, sorted), and the longest match."""
    found = _findings(df, items, key, text, item, item_text, length, keep=False)
    return found.select(F.col("id").alias(key), "n_words", "n_hit", "longest", "begins", "ends", "items")


def decontaminate(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", length: int = 10, coverage: float = 0.5) -> DataFrame:
    """(key, text, n_words, n_hit, longest, items, removed): the texts without the spans of hit words; `removed` says that more
    than `coverage` of the words are hit, so that the document had better go as a whole."""

    def cut(batches):
        for batch in batches:
            for part in steps(batch):
                w, out = Words(texts(part), apart=APART), []
                for i, (value, begins, ends) in enumerate(zip(part["text"], part["begins"], part["ends"], strict=True)):
                    raw, base, start = value.as_buffer().to_pybytes(), w.first[i], w.at[i]
                    at, kept = 0, []
                    for a, b in zip(begins.as_py(), ends.as_py(), strict=True):
                        kept.append(raw[at : w.begin[base + a] - start])
                        at = int(w.end[base + b - 1] - start)
                    out.append(b"".join([*kept, raw[at:]]).decode())
                yield part.set_column(part.schema.get_field_index("text"), "text", pa.array(out, pa.string()))

    found = _findings(df, items, key, text, item, item_text, length, keep=True)
    cleaned = found.mapInArrow(cut, _schema(found))
    return cleaned.select(F.col("id").alias(key), "text", "n_words", "n_hit", "longest", "items", (F.col("n_hit") > coverage * F.col("n_words")).alias("removed"))


def op11_decontamination(spark, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.concat_ws(",", "items"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: Every length of window that the items have is looked for by itself; DuckDB lower-cases all letters with lower().
OP11_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), i AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), long AS (SELECT item, w, least(10, len(w)) AS m FROM i WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item, m, array_to_string(w[p:p + m - 1], ' ') AS s FROM (SELECT item, w, m, unnest(generate_series(1, len(w) - m + 1)) AS p FROM long)
), places AS (
  SELECT r, p, m, array_to_string(w[p:p + m - 1], ' ') AS s
  FROM (SELECT r, w, m, unnest(generate_series(1, len(w) - m + 1)) AS p FROM d, (SELECT DISTINCT m FROM windows) WHERE len(w) >= m)
), hits AS (SELECT r, p, m, s FROM places WHERE (m, s) IN (SELECT (m, s) FROM windows)
), words AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(generate_series(p, p + m - 1)) AS q FROM hits) GROUP BY r
), named AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT h.r, x.item FROM hits h JOIN windows x ON h.m = x.m AND h.s = x.s) GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN named USING (r)
"""
