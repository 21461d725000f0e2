"""Which terms are substrings of which texts.

Terms go, a bounded number of characters at a time, into an automaton (a trie with failure links) that every task holds;
each text is read once a pass, and a row comes out for each hit, whatever the length of the longest term. A dictionary
of more than PASSES passes is joined with the texts instead, by the terms' first characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of terms that a pass takes (some 60 bytes each in a task); passes before terms are joined instead.
PASS_CHARS, PASSES = 500_000, 8
#: Characters of a term by which its places in a text are found when terms are joined.
HEAD = 4


def contained(texts: DataFrame, key: str, text: str, terms: DataFrame, term: str) -> DataFrame:
    """(key, term): the terms, but for empty ones, that are substrings of the texts; each pair of a text and a term once."""
    every = terms.select(term).where(F.length(term) > 0).distinct()
    total = every.agg(F.coalesce(F.sum(F.length(term)), F.lit(0))).first()[0]
    passes = -(-total // PASS_CHARS)
    rows = texts.select(key, text).where(F.length(text) > 0)
    if passes > PASSES:
        return _joined(rows, key, text, every, term)
    out = None
    for number in range(max(1, passes)):
        own = every if passes <= 1 else every.where(F.pmod(F.xxhash64(term), F.lit(passes)) == number)
        found = _scanned(rows, key, text, [r[0] for r in own.collect()], term)  # PASS_CHARS characters, about
        out = found if out is None else out.union(found)
    return out


def _scanned(rows: DataFrame, key: str, text: str, terms: list[str], term: str) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ahocorasick import Automaton

        automaton = Automaton()
        for t in sent.value:
            automaton.add_word(t, t)
        automaton.make_automaton()
        for batch in batches:
            at, hits = [], []
            for i, value in enumerate(batch.column(1).to_pylist()):
                own = {t for _, t in automaton.iter(value)} if sent.value else ()
                at += [i] * len(own)
                hits += own
                if len(hits) > 1 << 16:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(hits, pa.string())], names=[key, term])
                    at, hits = [], []
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(hits, pa.string())], names=[key, term])

    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, `{term}` string")


def _joined(rows: DataFrame, key: str, text: str, every: DataFrame, term: str) -> DataFrame:
    """Places whose first characters are a term's, with the lengths of such terms; then the substrings, and the terms."""
    out = None
    for n in range(1, HEAD + 1):
        own = every.where(F.length(term) >= HEAD if n == HEAD else F.length(term) == n)
        heads = own.groupBy(F.substring(term, 1, n).alias("head")).agg(F.collect_set(F.length(term)).alias("sizes"))
        starts = F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.struct(F.substring(F.col(text), i, F.lit(n)).alias("head"), i.alias("at")))  # noqa: B023
        places = rows.where(F.length(text) >= n).select(key, F.explode(starts).alias("p")).select(key, "p.head", "p.at")
        found = places.join(heads, "head").select(key, "at", F.explode("sizes").alias("size"))
        found = found.join(rows, key).select(key, F.substring(F.col(text), F.col("at"), F.col("size")).alias(term)).join(own, term).select(key, term)
        out = found if out is None else out.union(found)
    return out.distinct()
