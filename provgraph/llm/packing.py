"""Best-fit packing of token pieces into sequences by a configuration linear program.

Every document's ids are cut into pieces of `capacity` tokens at most. The histogram of piece lengths (exact
up to a capacity of 4096; in 4096 classes or more, rounded up, beyond it) is all that the driver sees. Its
configuration program, one variable per way to fill a sequence, is solved by multiplicative weights: a knapsack dynamic program
prices the fullest configuration under the present weights, the configuration is used, and the weights of
the lengths that it covers go down. Whole uses are kept, the program is solved again for what is left, and
the last remainder, whose size does not depend on the number of documents, is rounded up or goes by best fit.
A plan never has more sequences than best fit over all lengths. Pieces then find their configuration from
their rank within their class, so no piece passes through the driver.

Defined results: a null text is empty and makes one piece, the end id alone; an empty table gives an empty
one; equal rows are pieces of their own; a null key is packed as any other. `pack` keeps all columns of the
pieces it is given, and names its own `sequence_id` and `offset`; a column of such a name is refused.
"""

from __future__ import annotations

import functools
import os
import re
import unicodedata
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import as_strided
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_of, bytes_of, checkpoint, free, offsets_of, steps, table, texts

CAPACITY, CLASSES = 4096, 4096
#: Bytes of words and their ids that a worker keeps, about, and as many of before; rows of one class that one task ranks, about.
KEPT, RANKED = 96 << 20, 200_000
#: Bytes of a kept word beside its letters and ids; new words that the tokenizer gets at once; marks that part from letters.
ENTRY, TOGETHER, MARKS = 170, 8192, b".,;:!?#$%&*+-/<=>@()[]{}|~^\"\\`"
#: Whether a word has small letters of Latin-1 alone.
SMALL = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch
STEP, ROUNDS, PHASES = 0.05, 1500, 4
#: Rounds after which what is found is tried.
TRIED = (100, 200, 400, 800)
#: Items that best fit takes without the program; rooms that one step of the dynamic program looks at.
REST, BLOCK = 4096, 64


def _letters(word: bytes) -> bool:
    """Whether a word has letters alone, and so has its normal form in lower case."""
    if word.isascii():
        return word.isalpha()
    s = word.decode()
    return s.isalpha() and s.lower().isalpha() and unicodedata.is_normalized("NFC", s)


def _joined(tokenizer, words: list[str]) -> np.ndarray:
    """The ids of words as one text."""
    return np.array(tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")


class WordTokens:
    """Ids of texts by a tokenizers file whose ids of a word do not depend on the words around it. The file's added tokens
    (<|endoftext|> and the like) are cut out first, as they stand, where they are not to be `plain` text."""

    def __init__(self, path: str, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        added = {} if plain else {t.content.encode(): i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.specials = list(added)
        # Known by a key that no word has, as words are in lower case.
        self.added = {b"A" + k: array("I", [i]).tobytes() for k, i in added.items()}
        self.cut = re.compile(b"(" + b"|".join(map(re.escape, sorted(added, key=len, reverse=True))) + b")") if added else None
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)  # ids that end a word
        for token, i in self.tokenizer.get_vocab().items():
            self.last[i] = bool(suffix) and token.endswith(suffix)
        self.known, self.before, self.kept = dict(self.added), {}, 0
        # Small Latin letters need no normal form, and only white space parts them; tried on some, in case the file has it otherwise.
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        some = [w for t in sorted(self.tokenizer.get_vocab()) if SMALL((w := t.removesuffix(suffix or "")).encode())]
        some = [x + w + y for w in some[:: len(some) // 1000 + 1] for x, y in (("", ""), ("\xe9", "\xdf"))]
        if not np.array_equal(*(_joined(t, some) for t in (self.bare, self.tokenizer))):
            self.bare = self.tokenizer

    def words(self, batch: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The words of all texts, and where those of each text begin (with the end as last)."""
        raw = bytes_of(batch)[0].tobytes()
        if any(x in raw for x in self.specials):
            lists = [self._words_beside_added(x.as_buffer().to_pybytes()) for x in batch]
            at = np.cumsum([0, *map(len, lists)])
            return pa.array([w for x in lists for w in x], pa.large_binary()), at
        lists = pc.ascii_split_whitespace(pc.ascii_lower(batch))  # the tokenizer lower-cases too
        return lists.flatten(), offsets_of(lists)

    def _words_beside_added(self, text: bytes) -> list[bytes]:
        parts = self.cut.split(text)
        return [w for i, part in enumerate(parts) for w in ([b"A" + part] if i % 2 else part.lower().split())]

    def encode(self, batch: list[bytes]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        ids, at = self.ids(pa.array(batch, pa.large_string()))
        raw, at = ids.tobytes(), (4 * at).tolist()
        return [raw[a:b] for a, b in zip(at, at[1:])]

    def ids(self, batch: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where those of each text begin (with the end as last). Words lie between ASCII white
        space; each distinct one is looked up once."""
        words, first = self.words(batch)
        words = words.dictionary_encode()
        own = self._ids_of(words.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist())
        at, flat = np.cumsum([0, *map(len, own)]) // 4, np.frombuffer(b"".join(own), "<u4")
        word = words.indices.to_numpy(zero_copy_only=False)
        end = np.concatenate([[0], np.cumsum(np.diff(at)[word])])
        n = np.diff(end)
        return flat[np.arange(end[-1]) + np.repeat(at[word] - end[:-1], n)], end[first]

    def _ids_of(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words."""
        if self.kept > KEPT:  # what is met again is taken over
            self.known, self.before, self.kept = dict(self.added), self.known, 0
        known = self.known
        out = [*map(known.get, words)]
        new = [i for i, x in enumerate(out) if x is None]
        if self.before:
            again = {w: x for w in map(words.__getitem__, new) if (x := self.before.get(w)) is not None}
            self._keep(again.keys(), again.values())
        self._learn([w for i in new if (w := words[i]) not in known])
        for i in new:
            out[i] = known[words[i]]
        return out

    def _keep(self, words, ids) -> None:
        self.known.update(zip(words, ids, strict=True))
        self.kept += len(words) * ENTRY + sum(map(len, words)) + sum(map(len, ids))

    def _learn(self, new: list[bytes]) -> None:
        """Ids of words: those of letters alone, which are a word of the tokenizer's own each, as one text; others a text each.
        Letters and the marks after them are a word of the tokenizer's own each, too."""
        known, plain, letters, others, ends = self.known, set(), set(), set(), []
        for w in new:
            if w.isalpha():
                plain.add(w)
                continue
            stem = w.rstrip(MARKS)
            own = plain if SMALL(stem) else letters if stem and _letters(stem) else None
            if own is None:
                others.add(w)
                continue
            if stem not in known:
                own.add(stem)
            if stem != w:
                mark = w[len(stem) :]
                ends.append((w, stem, mark))
                if mark not in known:
                    others.add(mark)
        for tokenizer, words in ((self.bare, [*plain]), (self.tokenizer, [*letters])):
            for i in range(0, len(words), TOGETHER):
                part = words[i : i + TOGETHER]
                ids = _joined(tokenizer, [w.decode() for w in part])
                stops = np.flatnonzero(self.last[ids]) + 1
                if len(stops) != len(part):
                    others.update(part)
                    continue
                raw, stops = ids.tobytes(), (4 * stops).tolist()
                self._keep(part, [*map(raw.__getitem__, map(slice, [0, *stops[:-1]], stops))])
        others = [*others]
        for i in range(0, len(others), TOGETHER):
            part = others[i : i + TOGETHER]
            found = self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
            self._keep(part, [array("I", e.ids).tobytes() for e in found])
        self._keep([w for w, _, _ in ends], [known[stem] + known[mark] for _, stem, mark in ends])


@functools.lru_cache(2)
def tokens(path: str, plain: bool = False) -> WordTokens:
    return WordTokens(path, plain)


def pieces(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = 1, plain: bool = False) -> DataFrame:
    """(key, piece, start, length, ids): a document's ids and the end id, cut where the capacity is reached. The strings of
    the file's added tokens are these tokens, as in the library; with `plain` they are ordinary text."""

    def run(batches):
        words = tokens(path, plain)
        for batch in batches:
            for part in steps(batch, text, 1 << 20):
                flat, at = words.ids(texts(part, text))
                at = at + np.arange(len(at))  # with the end ids
                size = np.diff(at)
                raw = np.full(at[-1], end_id, "<u4")
                own = np.ones(len(raw), bool)
                own[at[1:] - 1] = False
                raw[own] = flat
                count = -(-size // capacity)
                begin = np.repeat(at[:-1], count)
                number = np.arange(len(begin)) - np.repeat(np.cumsum(count) - count, count)
                begin += number * capacity
                length = np.minimum(capacity, np.repeat(at[1:], count) - begin)
                coded = raw.tobytes()
                ids = [coded[4 * i : 4 * (i + n)] for i, n in zip(begin.tolist(), length.tolist(), strict=True)]
                yield batch_of(
                    **{key: part.column(0).take(pa.array(np.repeat(np.arange(len(size)), count)))},
                    piece=number.astype(np.int32), start=number * capacity, length=length, ids=pa.array(ids, pa.binary()),
                )
            pa.default_memory_pool().release_unused()  # the worker stays, and so would this memory

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, piece int, start bigint, length bigint, ids binary")


def fullest(values: np.ndarray, units: int) -> tuple[np.ndarray, np.ndarray]:
    """The best multiset of sizes 1..units within `units`, by dynamic programming: its sizes and how many of each.
    values[s] is the worth of one item of size s; sizes not there are worth nothing. Sizes of BLOCK and more are
    done a block of rooms at a time, smaller ones a size at a time; the best split of the room joins both."""
    worth = np.where(values > 0, values, -np.inf).astype(np.float32)
    padded = np.full(2 * units + 1, -np.inf, np.float32)
    best = padded[units:]
    best[:BLOCK] = 0
    if (values[BLOCK:] > 0).any():
        back, space = worth[::-1].copy(), np.empty(BLOCK * units, np.float32)
        for begin in range(BLOCK, units + 1, BLOCK):
            end = min(begin + BLOCK, units + 1)
            # Row i: rooms that sizes end - 1 down to BLOCK leave in a room of begin + i.
            left = as_strided(padded[units + begin - end + 1 :], (end - begin, end - BLOCK), padded.strides * 2, writeable=False)
            total = np.add(left, back[units + 1 - end : units + 1 - BLOCK], out=space[: left.size].reshape(left.shape))
            best[begin:end] = np.maximum.accumulate(np.maximum(total.max(1), best[begin - 1]))
    else:
        best[:] = 0
    small = np.flatnonzero(values[:BLOCK] > 0)
    tables = [np.zeros(units + 1)]
    for size in small:
        rows = -(-(units + 1) // size)
        grid = np.full(rows * size, -np.inf)
        grid[: units + 1] = tables[-1]
        gain = np.arange(rows)[:, None] * values[size]
        tables.append((np.maximum.accumulate(grid.reshape(rows, size) - gain) + gain).ravel()[: units + 1])
    rest = int((best[::-1] + tables[-1]).argmax())
    out, room = {}, units - rest
    while room := int(np.searchsorted(best, best[room])):
        size = BLOCK + int((best[room - BLOCK :: -1] + worth[BLOCK : room + 1]).argmax())
        out[size] = out.get(size, 0) + 1
        room -= size
    for size, below in zip(small[::-1], tables[-2::-1], strict=True):
        n = int((below[rest::-size] + np.arange(rest // size + 1) * values[size]).argmax())
        if n:
            out[int(size)] = n
            rest -= n * int(size)
    sizes = np.array(sorted(out), np.int64)
    return sizes, np.array([out[x] for x in sizes.tolist()], np.int64)


def solve(counts: np.ndarray, units: int, rounds: int = ROUNDS, step: float = STEP) -> Iterator[list[tuple[tuple, float]]]:
    """Configurations and how often each is used, fractionally; together they cover about each length's count. They come
    as far as they are after some of the rounds, TRIED, and at the end."""
    used: dict[bytes, list] = {}
    weight = np.where(counts > 0, np.arange(units + 1) / units, 0.0)
    covered, need = np.zeros(units + 1), np.maximum(counts, 1)
    for done in range(rounds):
        if not weight.any():
            break
        if done in TRIED:
            yield [(c, x) for c, x in used.values()]
        own, n = config = fullest(weight, units)
        times = min(float((need[own] / n).min()) * 0.5, float(((counts[own] - covered[own]) / n).min()))
        entry = used.setdefault(np.stack(config).tobytes(), [config, 0.0])
        entry[1] += times
        covered[own] += times * n
        weight[own] *= np.exp(-step * times * n / need[own])
        weight[own[covered[own] >= counts[own] - 0.5]] = 0.0
    yield [(c, x) for c, x in used.values()]


def plan(counts: np.ndarray, units: int) -> list[tuple[tuple, int]]:
    """Configurations (sizes, how many of each) and whole numbers of uses that take exactly `counts` items of each size,
    in no more sequences than best fit alone takes. The program is solved for what is left, phase by phase; first the
    uses of full sequences, rounded down, are kept, then any, for as long as a phase takes a good part and the sequences
    are more than the tokens need. What is left goes by the last fractions, rounded up, and by best fit. Rounds end once
    what they have found, so completed, takes no more sequences than the tokens need."""
    left, out, phase = counts.astype(np.int64).copy(), [], 1
    best, bound = best_fit(left, units), -(-int(left @ np.arange(units + 1)) // units)
    while (before := int(left.sum())) and (phase == 1 or before > REST):
        for found in solve(left, units):
            found, up, rest = sorted(found, key=lambda x: -x[1]), left.copy(), left.copy()
            nearly = _taken(up, found, units, lambda x: np.ceil(x - 1e-9), full=False)
            whole = _taken(rest, found, units, lambda x: np.floor(x + 1e-9), full=phase < PHASES)
            way = min(out + whole + best_fit(rest, units), out + nearly + best_fit(up, units), key=_sequences)
            if _sequences(way) <= bound:
                return way
            best = min(way, best, key=_sequences)
        left, out = rest, out + whole
        if _sequences(best) <= bound or (phase >= PHASES and left.sum() > before / 2):
            break
        phase += 1
    return best


def _sequences(way: list[tuple[tuple, int]]) -> int:
    return sum(times for _, times in way)


def _taken(left: np.ndarray, found, units: int, rounded, full: bool) -> list[tuple[tuple, int]]:
    """Whole uses of fractional configurations, most used first, taken off `left`."""
    out = []
    for config, times in found:
        own, n = config
        if full and own @ n < units:
            continue
        whole = int(min(rounded(times), (left[own] // n).min()))
        if whole > 0:
            left[own] -= whole * n
            out.append((config, whole))
    return out


def best_fit(counts: np.ndarray, units: int) -> list[tuple[tuple, int]]:
    """Largest items first, each into the fullest sequence that has room; equal sequences are filled together, so the
    work follows the number of sizes and not that of items."""
    rooms: list[int] = []
    bins: dict[int, list[tuple[dict, int]]] = {}

    def add(room, config, times):
        if room not in bins:
            insort(rooms, room)
        bins.setdefault(room, []).append((config, times))

    for size in np.flatnonzero(counts)[::-1].tolist():
        n, filled = int(counts[size]), []
        while n:
            i = bisect_left(rooms, size)
            if i < len(rooms):
                room = rooms[i]
                config, times = bins[room].pop()
                if not bins[room]:
                    del bins[room], rooms[i]
            else:
                room, config, times = units, {}, -(-n // (units // size))
            each = room // size
            whole = min(times, n // each)
            more = n - whole * each if whole < times else 0
            n -= whole * each + more
            if whole:
                filled.append((room - each * size, config | {size: each}, whole))
            if more:
                filled.append((room - more * size, config | {size: more}, 1))
            if times - whole - (more > 0):
                filled.append((room, config, times - whole - (more > 0)))
        for x in filled:
            add(*x)
    return [((np.array(sorted(c), np.int64), np.array([c[x] for x in sorted(c)], np.int64)), times) for own in bins.values() for c, times in own]


def _slots(configs: list[tuple[tuple, int]]):
    """By class: first ranks, items a use, first sequence and place of the uses of each configuration that has it."""
    parts: dict[int, list] = {}
    begun: dict[int, int] = {}
    sequence = 0
    for (sizes, each), times in configs:
        for place, (size, n) in enumerate(zip(sizes.tolist(), each.tolist(), strict=True)):
            parts.setdefault(size, []).append((begun.get(size, 0), n, sequence, place))
            begun[size] = begun.get(size, 0) + n * times
        sequence += times
    return {size: np.array(rows, np.int64).T for size, rows in parts.items()}


def pack(df: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """The pieces (with their `length`, at least 1 and at most the capacity) and sequence_id and offset of each.
    `order` are columns that tell pieces apart; the rank of a piece within its class follows them, and where they
    are equal a piece's other columns that can be ordered."""
    if {"sequence_id", "offset"} & {c.lower() for c in df.columns}:
        raise ValueError("the pieces have a column sequence_id or offset already")
    unit = max(1, capacity // CLASSES)
    units = capacity // unit
    names = df.columns
    class_, salt, rank, base, slot, n, mark = (free(df, c) for c in ("class", "salt", "rank", "base", "slot", "n", "mark"))
    df = df.withColumns({class_: F.ceil(F.col("length") / unit).cast("int"), mark: F.xxhash64(*(c for c in names if not df.schema[c].dataType.simpleString().startswith("map")))})
    counts = np.zeros(units + 1, np.int64)
    for row in df.groupBy(class_).count().collect():
        if not 1 <= (row[0] or 0) <= units:
            raise ValueError("a piece's length lies outside 1 and the capacity")
        counts[row[0]] = row[1]
    slots = _slots(plan(counts, units))
    salts = max(1, -(-int(counts.max()) // RANKED))
    df = df.withColumn(salt, F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    group = [class_, salt]
    before = df.groupBy(*group).agg(F.count("*").alias(n)).withColumn(base, F.sum(n).over(Window.partitionBy(class_).orderBy(salt)) - F.col(n)).drop(n)
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order, mark)) - 1).join(before, group)
    ranked = ranked.select(*names, class_, (F.col(rank) + F.col(base)).alias(rank))

    def place(batches):
        for batch in batches:
            size, at_ = batch.column(len(names)).to_numpy(), batch.column(len(names) + 1).to_numpy()
            sequence, spot = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
            for own in np.unique(size):
                at = np.flatnonzero(size == own)
                first, each, begin, turn = slots[int(own)]
                i = np.searchsorted(first, at_[at], "right") - 1
                t = at_[at] - first[i]
                sequence[at], spot[at] = begin[i] + t // each[i], turn[i] * (1 << 20) + t % each[i]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(sequence), pa.array(spot)], names=[*names, "sequence_id", slot])

    schema = ", ".join(f"`{c}` {ranked.schema[c].dataType.simpleString()}" for c in names) + f", sequence_id bigint, `{slot}` bigint"
    within = Window.partitionBy("sequence_id").orderBy(slot)
    placed = ranked.mapInArrow(place, schema).withColumn("offset", F.sum("length").over(within) - F.col("length"))
    return placed.drop(slot)


def packed_documents(docs: DataFrame) -> DataFrame:
    """Documents, cut by the public word tokenizer and packed: (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    import public_tokenizers

    cut = pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pack(checkpoint(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))))


def op6_packing(spark, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))
