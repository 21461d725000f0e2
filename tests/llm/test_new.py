"""Decontamination, hard negatives and whitening against brute force, with awkward rows."""

import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as engine
from provgraph.llm import leaks, negatives, tiles, whitening

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


# op11


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def hits(text, items, length):
    w, hit, named = words(text), set(), set()
    for item, other in items:
        v = words(other)
        m = min(length, len(v))
        if item is None or not m:
            continue
        windows = {tuple(v[i : i + m]) for i in range(len(v) - m + 1)}
        for i in range(len(w) - m + 1):
            if tuple(w[i : i + m]) in windows:
                hit |= set(range(i, i + m))
                named.add(str(item))
    return len(w), sorted(hit), sorted(named)


def random_case(seed):
    r = random.Random(seed)
    word = lambda: r.choice(["a", "b", "C", "dé", "Éa", "x1", "zz"])
    text = lambda n: "".join(word() + r.choice([" ", "\n", ", ", "_"]) for _ in range(n))
    items = [(i, text(r.randrange(0, 9))) for i in range(12)] + [(3, text(6)), (None, text(7)), (40, None), (41, ""), (42, "a"), (43, items_twice := text(8)), (44, items_twice)]
    docs = [(i, text(r.randrange(0, 40)) if r.random() < 0.9 else None) for i in range(60)] + [(7, text(9)), (None, text(30)), (100, text(20000))]
    return docs, items if seed % 2 else [x for x in items if x[0] != 42]


@pytest.mark.parametrize(("length", "shard", "passes"), [(4, 100_000, 400_000), (3, 20, 400_000), (5, 12, 30)])
def test_contamination_equals_brute_force(spark, monkeypatch, length, shard, passes):
    monkeypatch.setattr(leaks, "SHARD_WORDS", shard)
    monkeypatch.setattr(leaks, "PASS_WORDS", passes)
    docs, items = random_case(length)
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS items", "3 AS row", "4 AS n_words")
    it = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS names", "2 AS words")
    want = sorted(repr((i, *hits(t, items, length))) for i, t in docs)
    got = [(r["doc_id"], r["n_words"], [x for a, b in zip(r["begins"], r["ends"]) for x in range(a, b)], r["items"]) for r in rows(leaks.contamination(df, it, length=length))]
    assert sorted(map(repr, got)) == want


def test_decontaminate_cuts_spans(spark):
    item = " ".join(f"w{i}" for i in range(12))
    docs = [(1, f"Before, {item.upper()}; after"), (2, "clean text"), (3, item), (4, None), (5, "Ünïcode é " + item.replace(" ", "\n") + " ß")]
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_hit"], r["longest"], r["removed"]) for r in rows(leaks.decontaminate(df, it))}
    assert got == {1: ("Before, ; after", 12, 12, True), 2: ("clean text", 0, 0, False), 3: ("", 12, 12, True), 4: ("", 0, 0, False), 5: ("Ünïcode é  ß", 12, 12, True)}
    none = it.where("false")
    assert {r["n_hit"] for r in rows(leaks.decontaminate(df, none))} == {0} and rows(leaks.decontaminate(df.where("false"), it)) == []


def test_automaton_has_every_run_and_no_other():
    r = random.Random(5)
    own = [[r.randrange(3) for _ in range(r.randrange(1, 30))] for _ in range(6)]
    auto = leaks.Automaton(own)
    runs = {tuple(x[i:j]) for x in own for i in range(len(x)) for j in range(i + 1, len(x) + 1)}
    found, stack = set(), [((), 0)]
    while stack:
        run, state = stack.pop()
        found.add(run)
        stack += [((*run, c), to) for c, to in auto.to[state].items()]
    assert found - {()} == runs
    assert all(auto.longest[auto.link[v]] < auto.longest[v] for v in range(1, len(auto.to)))


# op12


def mined(table, positives=5, negatives=10):
    """(anchor, positive, rank, negative, scores) by comparing all rows."""
    own = set()
    for i, v, label in table:
        if i is not None and v and label is not None and all(c is not None and np.isfinite(c) for c in v):
            own.add((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(int(np.floor(256 * float(np.float32(c)))) for c in v)))
    for i, label, x in own:
        if i % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(x, y)), j, other == label) for j, other, y in own if j != i)
        for s, j, _ in [r for r in scored if r[2]][:positives]:
            hard = [(t, k) for t, k, same in scored if not same and 30 * -s <= 100 * -t <= 90 * -s][:negatives]
            yield from ((i, j, rank, k, -s, -t) for rank, (t, k) in enumerate(hard, 1))


def vectors(seed, n=1200, d=12):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(4, d)) * np.geomspace(1, 0.02, d)
    table = [(i, (middle[r.integers(4)] + r.normal(size=d) * np.geomspace(0.5, 0.01, d)).tolist(), int(r.integers(10))) for i in range(n)]
    copies = [(n + i, table[i % 3][1], int(i % 10)) for i in range(60)]  # ties
    odd = [(2000, None, 1), (2100, [float("nan")] + [0.0] * (d - 1), 1), (2200, [None] + [0.0] * (d - 1), 1), (None, table[0][1], 1), (2300, table[0][1], None), (2400, [], 1), (100, table[100][1], table[100][2]), (2500, [0.0] * d, 3)]
    return table + copies + odd


EMB = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize(("rows_", "anchors"), [(1024, 8192), (64, 5)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, rows_, anchors):
    monkeypatch.setattr(negatives, "ROWS", rows_)
    monkeypatch.setattr(negatives, "ANCHORS", anchors)
    monkeypatch.setattr(negatives, "PAIRS", 1 << 12)
    table = vectors(rows_)
    df = spark.createDataFrame(table, EMB).selectExpr("*", "1 AS id", "2 AS block", "3 AS x", "4 AS anchor", "5 AS v")
    got = [tuple(r.values()) for r in rows(negatives.hard_negatives(df, "vec_id % 100 = 0", label="CASE WHEN vec_id % 7 = 0 THEN pmod(label + 1, 10) ELSE label END"))]
    assert len(got) > 200 and sorted(got) == sorted(mined(table))


def test_hard_negatives_of_few_rows(spark):
    one = spark.createDataFrame([(100, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.5, 0.5], 2), (3, [-1.0, 0.0], 2)], EMB)
    label = "label"
    assert [tuple(r.values()) for r in rows(negatives.hard_negatives(one, "vec_id % 100 = 0", label=label))] == [(100, 1, 1, 2, 65536, 32768)]
    for few in (one.where("false"), one.where("vec_id = 100"), one.where("vec_id <> 100"), one.where("vec_id <> 1")):
        assert rows(negatives.hard_negatives(few, "vec_id % 100 = 0", label=label)) == []
    with pytest.raises(ValueError):
        negatives.hard_negatives(one.union(spark.createDataFrame([(9, [1.0], 1)], EMB)), "true", label=label)


def test_bounds_discard_most_pairs():
    r = np.random.default_rng(1)
    x = np.floor(256 * r.normal(size=(600, 32)) * np.geomspace(1, 0.01, 32)).astype(np.int64)
    rotation = negatives.Rotation((x.T @ x).astype(float))
    own = negatives.Rows(np.arange(600), np.zeros(600, np.int64), x, rotation)
    exact = x @ x.T
    low, high = np.sort(exact, axis=1)[:, -20], np.sort(exact, axis=1)[:, -5]
    i, j, score = negatives.survivors(own, own, rotation, low, high, np.ones((600, 600), bool))
    want = (exact >= low[:, None]) & (exact <= high[:, None])
    assert {*zip(i, j)} == {*zip(*np.nonzero(want))} and (score == exact[i, j]).all()


# op13


def whitened(table, scale=64, shift=1_000_000):
    some = [(i, [int(np.floor(scale * float(np.float32(c)))) + shift for c in v]) for i, v, _ in table if v and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in some}))
    off = fit - fit.mean(axis=0)
    values, basis = np.linalg.eigh(off.T @ off / len(fit))
    return some, fit, values[::-1], basis[:, ::-1]


def same_whitening(got, table, most=16):
    some, fit, values, basis = whitened(table)
    n, sums = len(fit), fit.sum(axis=0).tolist()
    k = min(most, len(sums))
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], []).append(r)
    assert len(got) == k * len(some)
    sign = {}
    for i, x in some:
        want = (np.array(x) - fit.mean(axis=0)) @ basis[:, :k] / np.sqrt(values[:k])
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        for r in by[i]:
            c = r["component"] - 1
            assert (r["n"], int(r["deviation"])) == (n, deviation) and abs(r["explained"] - values[c] / values.sum()) <= 1e-9 and r["identity_error"] <= 1e-6
            if abs(want[c]) > 1e-3 and sum(j == i for j, _ in some) == 1:
                sign.setdefault(c, set()).add(np.sign(want[c] * r["whitened"]))
                assert abs(abs(want[c]) - abs(r["whitened"])) <= 1e-6 * max(1, abs(want[c]))
    assert all(len(s) == 1 for s in sign.values())


@pytest.mark.parametrize(("tile", "block"), [(32, 1 << 20), (5, 4096)])
def test_whitening_equals_numpy(spark, monkeypatch, tile, block):
    monkeypatch.setattr(tiles, "TILE", tile)
    monkeypatch.setattr(tiles, "BLOCK_BYTES", block)
    table = vectors(tile, 800, 20)
    df = spark.createDataFrame(table, EMB).selectExpr("*", "1 AS id", "2 AS x", "3 AS n", "4 AS component")
    same_whitening(rows(whitening.whiten(df)), table)


def test_whitening_query_equals_numpy(spark):
    t = pq.read_table(f"{SF}/embeddings.parquet").to_pydict()
    same_whitening(rows(engine.queries()["op13_whitening"](spark, SF)), list(zip(t["vec_id"], t["embedding"], t["label"])))


def test_whitening_of_little(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1), (None, [3.0, 2.0], None)], EMB)
    assert rows(whitening.whiten(df.where("false"))) == []
    same = rows(whitening.whiten(df.where("vec_id IN (1, 2)")))
    assert {(r["n"], int(r["deviation"]), r["whitened"], r["explained"], r["identity_error"]) for r in same} == {(1, 0, None, None, None)} and len(same) == 4
    flat = {(r["vec_id"], r["component"]): r for r in rows(whitening.whiten(df))}
    assert abs(flat[None, 1]["whitened"]) == 1 and flat[1, 2]["whitened"] is None and flat[1, 1]["explained"] == 1 and int(flat[1, 1]["deviation"]) == 128**2
    assert whitening.Centre(10**6, [0, 0]).deviations(np.array([[2**40, 3]])).to_pylist() == [(10**6 * 2**40) ** 2 + 9 * 10**12]
    with pytest.raises(ValueError):
        whitening.whiten(df.union(spark.createDataFrame([(9, [1.0], 1)], EMB)))
