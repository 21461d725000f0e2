"""Byte-level BPE encoding and decoding with the tokenizers library, over Arrow batches.

The vocabulary comes as ranks (one base64 token and its rank a line). The tokenizers library works on
characters, so each of the 256 bytes is given one visible character; a token's string in its vocabulary
is the bytes so mapped. A pair of tokens merges when the joined bytes are a token, in the order of
ranks, and a piece that is a token itself is taken whole.

Defined results: a null text counts as empty and has no ids; an empty list decodes to no bytes; ids that
are null or outside the vocabulary raise ValueError; text that is no valid UTF-8 after decoding shows
U+FFFD for the broken parts in `decoded` and keeps its bytes in `decoded_bytes`. Special tokens' strings
are ordinary text. Equal texts get equal ids. Only the key and the text are read, so other columns of any
name do not clash.
"""

from __future__ import annotations

import base64
import codecs
import functools
import hashlib
import os
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batch_of, steps, table, texts

#: Pieces whose ids a worker keeps.
KEPT = 300_000


@functools.cache
def byte_characters() -> tuple[str, ...]:
    """The character of each byte: visible Latin-1 ones stand for themselves, the others follow from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return tuple(chr(b) if b in plain else chr(next(others)) for b in range(256))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class ByteBPE:
    """An encoder and decoder for one rank file."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import regex
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks = read_ranks(path)
        self.character = byte_characters()
        shown = {token: "".join(self.character[b] for b in token) for token in ranks}
        vocabulary = {shown[token]: rank for token, rank in ranks.items()}
        merges = []
        for token, _ in sorted(ranks.items(), key=lambda x: x[1]):
            pairs = [(token[:i], token[i:]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
            merges += [(shown[a], shown[b]) for a, b in sorted(pairs, key=lambda p: (ranks[p[0]], ranks[p[1]]))]
        self.tokenizer = Tokenizer(models.BPE(vocabulary, merges, ignore_merges=True))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.tokenizer.encode_special_tokens = True
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        self.token = {rank: token for token, rank in ranks.items()}
        self.at = np.zeros(max(ranks.values(), default=-1) + 2, np.int64)
        sizes = np.zeros(len(self.at) - 1, np.int64)
        for rank, token in self.token.items():
            sizes[rank] = len(token)
        self.at[1:] = np.cumsum(sizes)
        #: The bytes of each token in the order of ids, by the byte table reversed.
        back = {c: b for b, c in enumerate(self.character)}
        strings = (self.tokenizer.id_to_token(i) or "" for i in range(len(sizes)))
        self.bytes = np.frombuffer(bytes(back[c] for s in strings for c in s), np.uint8)

    def encode(self, batch: list[str]) -> list[np.ndarray]:
        """Each text's ids. The pattern's matches are encoded each by itself, so a batch's new ones are given
        to the library once and the ids of known ones are kept, KEPT at most."""
        pieces = [self.split(x) for x in batch]
        if len(self.known) > KEPT:
            self.known.clear()
        new = [x for x in set().union(*pieces) if x not in self.known]
        for piece, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self.known[piece] = array("I", e.ids).tobytes()
        return [np.frombuffer(b"".join(map(self.known.__getitem__, x)), "<u4") for x in pieces]

    def encode_with_offsets(self, batch: list[str]) -> list[tuple[list[int], list[tuple[int, int]]]]:
        """Ids, and the characters (begin, end) that hold each token's bytes; a split character counts for each part."""
        return [(e.ids, e.offsets) for e in self.tokenizer.encode_batch(batch, add_special_tokens=False)]

    def decode(self, ids: np.ndarray) -> bytes:
        ids = np.asarray(ids, np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.at) - 1 or (self.at[ids + 1] == self.at[ids]).any()):
            raise ValueError("an id is not in the vocabulary")
        size = self.at[ids + 1] - self.at[ids]
        place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.at[ids], size)
        return self.bytes[place].tobytes()

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text for each id as it comes; bytes of a split character wait for its other part."""
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            if i not in self.token:
                raise ValueError("an id is not in the vocabulary")
            yield decoder.decode(self.token[i])
        yield decoder.decode(b"", final=True)


@functools.lru_cache(2)
def tokenizer(path: str, pattern: str) -> ByteBPE:
    return ByteBPE(path, pattern)


def encode(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", offsets: bool = False) -> DataFrame:
    """(key, ids) and, if asked for, (starts, ends) in characters."""

    def run(batches):
        bpe = tokenizer(path, pattern)
        for batch in batches:
            for part in steps(batch, text, 1 << 20):
                values = texts(part, text).to_pylist()
                if not offsets:
                    ids = bpe.encode(values)
                    at = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]), pa.int32())
                    flat = pa.array(np.concatenate([*ids, np.zeros(0, "<u4")]).astype(np.int32))
                    yield batch_of(**{key: part.column(0), "ids": pa.ListArray.from_arrays(at, flat)})
                    continue
                found = bpe.encode_with_offsets(values)
                yield batch_of(
                    **{key: part.column(0), "ids": pa.array([i for i, _ in found], pa.list_(pa.int32()))},
                    starts=pa.array([[a for a, _ in o] for _, o in found], pa.list_(pa.int32())),
                    ends=pa.array([[b for _, b in o] for _, o in found], pa.list_(pa.int32())),
                )

    more = ", starts array<int>, ends array<int>" if offsets else ""
    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, ids array<int>{more}")


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    for i in range(len(column)):
        item = column[i]
        if item.is_valid and item.values.null_count:
            raise ValueError("an id is null")
        yield item.values.to_numpy(zero_copy_only=False) if item.is_valid else np.zeros(0, np.int32)


def decode(df: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, decoded, decoded_bytes)."""

    def run(batches):
        bpe = tokenizer(path, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                raw = [bpe.decode(x) for x in _lists(part.column(1))]
                yield batch_of(**{key: part.column(0)}, decoded=pa.array([x.decode("utf-8", "replace") for x in raw], pa.string()), decoded_bytes=pa.array(raw, pa.binary()))

    return df.select(key, ids).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, decoded string, decoded_bytes binary")


def digests(df: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of encoded rows: the ids as unsigned 32-bit little-endian, and what they decode to."""

    def run(batches):
        bpe = tokenizer(path, pattern)
        for batch in batches:
            rows = [(len(x), hashlib.sha256(x.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(bpe.decode(x)).hexdigest()) for x in _lists(batch.column(1))]
            n, coded, decoded = zip(*rows, strict=True) if rows else ([], [], [])
            yield batch_of(**{key: batch.column(0)}, n_tokens=pa.array(n, pa.int64()), ids_sha256=pa.array(coded, pa.string()), decoded_sha256=pa.array(decoded, pa.string()))

    return df.select(key, ids).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op4_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return digests(encode(table(spark, sf_dir, "documents"), path, pattern), path, pattern)
