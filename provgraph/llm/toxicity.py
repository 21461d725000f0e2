"""Toxicity by classifier chains: categories in turn, each model fed with the probabilities of the ones before.

A text's features are whether it holds each word, each word's beginning of 4 and 5 bytes and each run of
marks (hashed), and in which range its shares of capitals and marks lie. A category's model is linear
(logistic, trained by follow-the-regularised-leader with an L1 term, so most weights are 0). Models later in
the chain see the earlier categories' log-odds; in training these come from models that did not see the row
(`FOLDS` folds, equal texts in one fold), in use from the models of all training rows.

The training rows are a bounded sample: the `sample` labelled documents whose ids hash lowest. All documents
are scored on their whole texts.

Defined results: a null text counts as empty; a document without labels is scored all the same; labels that
disagree count as 1; a null label, and a label without its document, trains nothing; a category that has one
class only in the sample is predicted as that class; without any training row every probability is 0; rows
that repeat a key get equal scores for equal texts; a column of the scores' name is replaced, and all others
pass through; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, bytes_of, free, hash_ranges, lowered, mix, steps, table, texts

#: Labelled documents that the models are trained on, at most.
SAMPLE = 8000
FOLDS, BATCH, LEAST_ROWS = 3, 32, 4
#: Text bytes whose features are made at once; they take some 60 times as much memory.
STEP = 1 << 20
#: Rounds over its rows that a model is trained for, whatever their number.
ROUNDS = 12
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 0.01

_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_MARK[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) not in ".,'-"]] = True


def _stretches(flags: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the runs of true flags, which end where a text ends."""
    padded = np.concatenate([[False], flags, [False]])
    begin = np.flatnonzero(padded[1:-1] & (~padded[:-2] | cut[:-1]))
    end = np.flatnonzero(padded[1:-1] & (~padded[2:] | cut[1:])) + 1
    return begin, end


def features(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of hashed features, with repeats."""
    raw, at = bytes_of(array)
    n = len(at) - 1
    cut = np.zeros(len(raw) + 1, bool)
    cut[at] = True
    small, docs, found = lowered(raw), [], []
    begin, end = _stretches(_LETTER[raw], cut)
    owner = np.searchsorted(at, begin, "right") - 1
    for seed, size in ((31, None), (32, 4), (33, 5)):
        some = np.flatnonzero(end - begin >= (size or 1))
        found.append(hash_ranges(small, begin[some], end[some] if size is None else begin[some] + size, seed))
        docs.append(owner[some])
    marks = _stretches(_MARK[raw], cut)
    found.append(hash_ranges(small, *marks, 34))
    docs.append(np.searchsorted(at, marks[0], "right") - 1)
    size = np.maximum(np.diff(at), 1)
    for seed, flags in ((35, (raw >= 0x41) & (raw <= 0x5A)), (36, _MARK[raw])):
        total = np.concatenate([[0], np.cumsum(flags)])
        share = np.minimum((total[at[1:]] - total[at[:-1]]) * 20 // size, 10)
        found.append(mix(U64(seed << 8) + share.astype(U64)))
        docs.append(np.arange(n))
    return np.concatenate(docs), np.concatenate(found)


def _parts(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with the (text, feature) of each."""
    for batch in batches:
        for part in steps(batch, text, STEP):
            yield part, *features(texts(part, text))
        pa.default_memory_pool().release_unused()  # the worker stays, and so would this memory


class Linear:
    """A logistic model over few features, trained BATCH rows at a time; its weights are those with a reason to differ from 0."""

    def __init__(self, size: int, dense: int):
        self.n, self.z, self.bias = np.zeros(size + dense), np.zeros(size + dense), np.zeros(2)
        self.size = size

    def weights(self, at):
        z = self.z[at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)
        w[np.abs(z) <= L1] = 0.0
        return w

    def fit(self, rows: list[np.ndarray], dense: np.ndarray, y: np.ndarray) -> Linear:
        everything, total = np.arange(len(self.z)), len(self.z)
        for epoch in range(ROUNDS):
            order = np.argsort(mix(np.arange(len(rows), dtype=U64) + U64(epoch << 32)))
            for some in (order[i : i + BATCH] for i in range(0, len(order), BATCH)):
                at = np.concatenate([rows[i] for i in some])
                owner = np.repeat(np.arange(len(some)), [len(rows[i]) for i in some])
                w, bias = self.weights(everything), self._bias()
                odds = np.bincount(owner, w[at], minlength=len(some)) + dense[some] @ w[self.size :] + bias
                off = 1 / (1 + np.exp(-np.clip(odds, -30, 30))) - y[some]
                g = np.bincount(at, off[owner], minlength=total)
                g[self.size :] = off @ dense[some]
                self.z += g - (np.sqrt(self.n + g * g) - np.sqrt(self.n)) / ALPHA * w
                self.n += g * g
                g = off.sum()
                self.bias += [g - (np.sqrt(self.bias[1] + g * g) - np.sqrt(self.bias[1])) / ALPHA * bias, g * g]
        return self

    def _bias(self) -> float:
        return float(-self.bias[0] / ((BETA + np.sqrt(self.bias[1])) / ALPHA))

    def final(self) -> tuple[np.ndarray, np.ndarray, float]:
        w = self.weights(np.arange(len(self.z)))
        return w[: self.size], w[self.size :], self._bias()


@dataclass
class Chain:
    """The models of the categories in their order: sorted features, weights of each, weights of earlier log-odds, bias, threshold."""

    categories: list[str]
    known: np.ndarray
    weights: np.ndarray
    earlier: list[np.ndarray]
    bias: list[float]
    threshold: list[float]

    def odds(self, doc: np.ndarray, found: np.ndarray, n: int) -> np.ndarray:
        """Log-odds of each category (columns) for n texts with features (doc, found)."""
        out = np.zeros((n, len(self.categories)))
        place = np.minimum(np.searchsorted(self.known, found), max(0, len(self.known) - 1))
        hit = self.known[place] == found if len(self.known) else np.zeros(len(found), bool)
        pair = np.unique(doc[hit] * max(1, len(self.known)) + place[hit])
        doc, place = np.divmod(pair, max(1, len(self.known)))
        for c in range(len(self.categories)):
            linear = np.bincount(doc, self.weights[c][place], minlength=n) if len(pair) else np.zeros(n)
            out[:, c] = np.clip(linear + out[:, :c] @ self.earlier[c] + self.bias[c], -30, 30)
        return out


def _odds(rows, dense, model) -> np.ndarray:
    w, extra, bias = model.final()
    return np.clip([w[r].sum() for r in rows] + dense @ extra + bias, -30, 30) if len(rows) else np.zeros(0)


def _cutoff(odds: np.ndarray, y: np.ndarray) -> float:
    """The probability with the best balance of precision and recall on rows that the models did not see; midway between its neighbours."""
    if not y.any() or y.all():
        return 0.5
    order = np.argsort(-odds, kind="stable")
    hits = np.cumsum(y[order])
    last = np.append(odds[order][1:] != odds[order][:-1], True)
    f = np.where(last, 2 * hits / (np.arange(1, len(y) + 1) + y.sum()), 0)
    i = int(f.argmax())
    return float(1 / (1 + np.exp(-(odds[order][i] + odds[order][min(i + 1, len(y) - 1)]) / 2)))


def train(found: list[np.ndarray], labels: np.ndarray, folds: np.ndarray, categories: Sequence[str]) -> Chain:
    """found: each row's distinct features; labels: a column for each category."""
    flat = np.concatenate([*found, np.zeros(0, U64)])
    flat.sort()
    begin = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])[: len(flat)])
    known = flat[begin[np.diff(begin, append=len(flat)) >= LEAST_ROWS]]
    del flat, begin
    rows = []
    for f in found:
        place = np.searchsorted(known, f)
        there = place < len(known)
        place, f = place[there], f[there]
        rows.append(place[known[place] == f].astype(np.int32))
    chain = Chain(list(categories), known, np.zeros((len(categories), len(known))), [], [], [])
    before = np.zeros((len(rows), 0))
    for c in range(len(categories)):
        y, unseen = labels[:, c].astype(float), np.zeros(len(rows))
        if not len(y) or y.min() == y.max():
            chain.earlier.append(np.zeros(c))
            chain.bias.append(30.0 if len(y) and y[0] else -30.0)
            chain.threshold.append(0.5)
            before = np.column_stack([before, np.full(len(rows), chain.bias[-1])])
            continue
        for fold in range(FOLDS):
            held, rest = np.flatnonzero(folds == fold), np.flatnonzero(folds != fold)
            model = Linear(len(known), c).fit([rows[i] for i in rest], before[rest], y[rest])
            unseen[held] = _odds([rows[i] for i in held], before[held], model)
        chain.weights[c], earlier, bias = Linear(len(known), c).fit(rows, before, y).final()
        chain.earlier.append(earlier)
        chain.bias.append(bias)
        chain.threshold.append(_cutoff(unseen, y))
        before = np.column_stack([before, unseen])
    used = (chain.weights != 0).any(axis=0)
    chain.known, chain.weights = known[used], chain.weights[:, used]
    return chain


def fit(docs: DataFrame, labels: DataFrame, categories: Sequence[str], key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Chain:
    """A chain over the columns `categories` of labels (0 or 1), from the texts of docs."""
    hashed = F.xxhash64("id")
    own = labels.select(F.col(key).cast("bigint").alias("id"), *(F.col(c).cast("int").alias(f"c{i}") for i, c in enumerate(categories))).dropna()
    own = own.groupBy("id").agg(*(F.max(f"c{i}").alias(f"c{i}") for i in range(len(categories)))).orderBy(hashed, "id").limit(sample)
    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("id is not null")
    rows = rows.join(F.broadcast(own), "id").withColumn("order", hashed)  # `sample` rows at most
    names = [f"c{i}" for i in range(len(categories))]

    def extract(batches):
        for part, doc, found in _parts(batches):
            packed = _split(doc, found, part.num_rows)
            yield pa.RecordBatch.from_arrays([part["order"], *(part[c] for c in names), pa.array(packed, pa.binary())], names=["order", *names, "found"])

    made = rows.select("order", *names, "text").mapInArrow(extract, f"order bigint, {', '.join(f'{c} int' for c in names)}, found binary")
    # One row for equal feature sets, so copies are in one fold and count once; then the rows of one bounded sample train.
    made = made.groupBy("found").agg(F.min("order").alias("order"), *(F.max(c).alias(c) for c in names))

    def learn(t: pa.Table) -> pa.Table:
        at = pc.sort_indices(t["order"])  # the features themselves stay where they are
        own = t.select(["order", *names]).take(at)
        found = [np.frombuffer(x.as_buffer(), U64) for x in t["found"]]
        y = np.stack([own[c].to_numpy() for c in names], axis=1)
        chain = train([found[i] for i in at.to_pylist()], y, (mix(own["order"].to_numpy().view(U64)) % U64(FOLDS)).astype(int), categories)
        packed = [chain.known.tobytes(), chain.weights.tobytes()]
        return pa.table({"known": pa.array(packed[:1], pa.binary()), "weights": pa.array(packed[1:], pa.binary()), "earlier": pa.array([[x.tolist() for x in chain.earlier]], pa.list_(pa.list_(pa.float64()))), "bias": pa.array([chain.bias], pa.list_(pa.float64())), "threshold": pa.array([chain.threshold], pa.list_(pa.float64()))})

    model = made.groupBy(F.lit(0).alias("all")).applyInArrow(learn, "known binary, weights binary, earlier array<array<double>>, bias array<double>, threshold array<double>").first()
    if model is None:
        return Chain(list(categories), np.zeros(0, U64), np.zeros((len(categories), 0)), [np.zeros(c) for c in range(len(categories))], [-30.0] * len(categories), [0.5] * len(categories))
    weights = np.frombuffer(bytes(model["weights"])).reshape(len(categories), -1)
    return Chain(list(categories), np.frombuffer(bytes(model["known"]), U64), weights, [np.array(x) for x in model["earlier"]], list(model["bias"]), list(model["threshold"]))


def _split(doc, found, n):
    order = np.lexsort((found, doc))
    doc, found = doc[order], found[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (found[1:] != found[:-1])]) if len(doc) else np.zeros(0, bool)
    at = np.searchsorted(doc[new], np.arange(n + 1))
    return [found[new][a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]


def score(df: DataFrame, chain: Chain, text: str = "text", out: str = "toxicity") -> DataFrame:
    """The rows and `out`: a struct of p_<category> and is_<category> for each category of the chain."""
    rest = [c for c in df.columns if c != out]
    rows, scored = df.select(*rest), text
    if text not in rest or dict(df.dtypes)[text] != "string":  # else the text goes to the workers once
        scored = free(df, "scored")
        rows = df.select(*rest, F.col(text).cast("string").alias(scored))
    fields = ",".join(f"p_{c}:double,is_{c}:boolean" for c in chain.categories)
    shared = df.sparkSession.sparkContext.broadcast(chain)  # bounded by the sample's features

    def run(batches):
        model = shared.value
        for part, doc, found in _parts(batches, scored):
            p = 1 / (1 + np.exp(-model.odds(doc, found, part.num_rows)))
            columns = [x for c, name in enumerate(model.categories) for x in ((f"p_{name}", pa.array(p[:, c])), (f"is_{name}", pa.array(p[:, c] >= model.threshold[c])))]
            made = pa.StructArray.from_arrays([x for _, x in columns], names=[n for n, _ in columns])
            yield pa.RecordBatch.from_arrays([*part.columns[: len(rest)], made], names=[*rest, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*rest).schema)
    return rows.mapInArrow(run, f"{schema}, `{out}` struct<{fields}>")


CATEGORIES = ("low_quality", "toxic")


def chain_of(docs: DataFrame, labels: DataFrame) -> Chain:
    """The chain for the tables' two labels: junk first, then toxicity."""
    own = labels.select("doc_id", (F.lit(1) - F.col("quality")).alias("low_quality"), "toxic")
    return fit(docs, own, CATEGORIES)


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, chain_of(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", "toxicity.p_low_quality", "toxicity.p_toxic", F.col("toxicity.is_toxic").cast("int").alias("is_toxic"))
