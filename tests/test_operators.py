"""Operators on small hand-made frames: nulls, blanks, ties, circles."""

import random

import pytest

from provgraph.functions import text as T
from provgraph.operators import changes as C
from provgraph.operators import graph as G
from provgraph.operators import parse as P
from provgraph.operators import resolve as R
from provgraph.operators import terms as terms_module
from provgraph.operators.terms import contained
from pyspark.sql import functions as F


def test_norm_and_repeated_chunks(spark):
    df = spark.createDataFrame([("d", 0, "a   b "), ("d", 1, "a b"), ("d", 2, None), ("d", 3, "")], "doc string, pos int, text string")
    out = {r.pos: (r.occ, r.chunk_id) for r in T.chunk_ids(df, "doc", "text", F.lit(""), ["pos"]).collect()}
    assert [out[i][0] for i in range(4)] == [0, 1, 0, 1] and len({c for _, c in out.values()}) == 4


def test_record_boundaries(spark):
    df = spark.createDataFrame([(1, "a b", "c"), (2, "a", "b c")], "k int, x string, y string").withColumn("doc", F.concat(F.lit("d"), F.col("k").cast("string")))
    tail = lambda strict: {r.record_id.split(":")[1] for r in T.record_ids(df, "doc", ["x", "y"], ["k"], strict).collect()}
    assert len(tail(False)) == 1 and len(tail(True)) == 2


def test_ditto_chain_and_first_row(spark):
    df = spark.createDataFrame([("s", 0, "〃"), ("s", 1, "x"), ("s", 2, "상동"), ("s", 3, "〃"), ("s", 4, None)], "doc string, row int, v string")
    assert [r.v for r in P.ditto_fill(df, "doc", "row", "v").orderBy("row").collect()] == ["〃", "x", "x", "x", None]


def test_heading_levels_reset(spark):
    lines = ["1. A", "1.1 B", "x", "2. C", "y", "z", ""]
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(lines)], "doc string, pos int, t string")
    assert {(r.section, r.text) for r in P.heading_chunks(df, "doc", "pos", "t").collect()} == {("A > B", "x"), ("C", "y\nz")}


def test_redirects_end_where_a_circle_is_met(spark):
    moved = [(1, 2), (2, 3), (8, 9), (9, 8), (7, 9), (6, 7), (5, 5), (4, 5), (3, None)] + [(i, i + 1) for i in range(100, 400)] + [(500 + i, 500 + (i + 1) % 77) for i in range(77)]
    df = spark.createDataFrame(moved, "id long, into long")
    out = {r.id: r.target for r in G.redirects(df).collect()}
    assert out == {1: 3, 2: 3, 8: 8, 9: 9, 7: 9, 6: 9, 5: 5, 4: 5} | {i: 400 for i in range(100, 400)} | {500 + i: 500 + i for i in range(77)}
    assert {tuple(r) for r in G.chain_defects(df).collect()} == {("chain_circle", "8", 2, 4), ("chain_circle", "5", 1, 2), ("chain_circle", "500", 77, 77)}
    steps = {r.id: r.steps for r in G.chains(df).collect()}
    assert steps[100] == 300 and steps[1] == 2 and steps[8] is None and G.redirects(df.where("false")).isEmpty()


def test_rules_within_a_batch(spark):
    nodes = spark.createDataFrame([("a", "A", "k", None, None), ("b", "B", "k", None, None), ("c", "C", "k", None, "a"), ("d", "D", "k", None, None), ("t", "T", "k", "a", None)], "id string, canonical string, category string, merged_into string, replaced_by string").withColumn("status", F.lit("auto"))
    names = spark.createDataFrame([("a", "X"), ("b", "X"), ("c", "T"), ("t", "Y"), ("d", "D2"), ("d", "D3"), ("z", "Q")], "id string, new string")
    done, refused = C.rename(nodes, names)
    assert {r.id: r.canonical for r in done.collect()} == {"a": "A", "b": "B", "c": "T", "d": "D", "t": "T"}
    assert {(r.id, r.new) for r in refused.collect()} == {("a", "X"), ("b", "X"), ("t", "Y"), ("d", "D2"), ("d", "D3"), ("z", "Q")}
    gone = spark.createDataFrame([("a", "b"), ("b", "a"), ("d", "c")], "id string, replaced_by string")
    assert {(r.id, r.reason) for r in C.obsolete_refusals(nodes, gone).collect()} == {("a", "circle"), ("b", "circle")}
    assert {r.id: (r.status, r.replaced_by) for r in C.obsolete(nodes, gone).collect()} == {"a": ("auto", None), "b": ("auto", None), "c": ("auto", "a"), "d": ("obsolete", "c"), "t": ("auto", None)}
    assert {(r.id, r.reason) for r in C.obsolete_refusals(nodes, spark.createDataFrame([("a", "c"), ("b", None), ("z", None)], "id string, replaced_by string")).collect()} == {("a", "circle"), ("z", "missing")}


def test_anchors_in_normal_form(spark):
    pieces, known = spark.createDataFrame([(1, "Foo  Bar "), (2, " "), (3, "Foo")], "k int, s string"), spark.createDataFrame([("Foo Bar", "n", "P"), ("Foo", "m", "P"), (" Foo", "o", "P")], "surface string, node_id string, category string")
    assert {(r.k, r.surface, r.hits, r.node_id) for r in R.anchors(pieces, known, "k", "s", "P").collect()} == {(1, "Foo  Bar ", 1, "n"), (3, "Foo", 2, None)}


def test_deleted_edges_stay_deleted(spark):
    e = spark.createDataFrame([("a", "r", "b", 1), ("a", "r", "c", 1)], "src string, rel string, dst string, doc int")
    assert [r.dst for r in G.upsert(e.where("false"), e, e.where("dst = 'b'")).collect()] == ["c"]


def test_contained_on_empty_and_short(spark):
    texts = spark.createDataFrame([(1, "abc"), (2, ""), (3, None)], "k int, t string")
    terms = spark.createDataFrame([("bc",), ("abcd",), ("c",)], "term string")
    assert {(r.k, r.term) for r in contained(texts, "k", "t", terms, "term").collect()} == {(1, "bc"), (1, "c")}
    assert contained(texts, "k", "t", terms.where("false"), "term").isEmpty()


@pytest.mark.parametrize(("chars", "passes"), [(500_000, 8), (60, 50), (60, 0)])
def test_contained_equals_plain_search(spark, monkeypatch, chars, passes):
    """In one pass, in several, and joined; with a term of 2,000 characters."""
    monkeypatch.setattr(terms_module, "PASS_CHARS", chars)
    monkeypatch.setattr(terms_module, "PASSES", passes)
    r = random.Random(1)
    word = lambda n: "".join(r.choice("ab é") for _ in range(n))
    texts, terms = [(i, word(r.randrange(40))) for i in range(60)] + [(99, None), (100, "ab" * 1000 + "c")], sorted({word(r.randrange(1, 8)) for _ in range(40)} | {"ab" * 1000})
    found = contained(spark.createDataFrame(texts, "k int, t string"), "k", "t", spark.createDataFrame([(t,) for t in [*terms, "", terms[0]]], "term string"), "term")
    assert sorted(map(tuple, found.collect())) == sorted((i, t) for i, x in texts for t in terms if x and t in x)


def in_order(surfaces, known, threshold):
    """As match_in_order, one surface after the other."""
    nodes, out = [(o.replace(" ", ""), n, None, "::" in o) for n, o, _ in sorted(known, key=lambda k: k[2])], {}
    for s, _ in sorted(surfaces, key=lambda x: (x[1], x[0])):
        b, best = s.replace(" ", ""), (0.0, None, None)
        for c, node, maker, scoped in nodes:
            score = 1.0 if b == c else 0.95 if b in c or c in b else 0.0
            if score > best[0] and not (scoped and "::" not in s):
                best = (score, node, maker)
        if best[0] >= threshold:
            out[s] = (best[1], best[2], best[0])
        else:
            out[s] = (None, s, best[0])
            nodes.append((b, None, s, "::" in s))
    return out


@pytest.mark.parametrize(("seed", "threshold"), [(1, 0.85), (2, 0.85), (3, 0.97)])
def test_surfaces_match_as_in_order(spark, seed, threshold):
    r = random.Random(seed)
    word = lambda: " ".join("".join(r.choice("abc") for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(1, 4))) + r.choice(["", "", "::ab"])
    names = sorted({word() for _ in range(80)})
    surfaces = [(n, r.randrange(40)) for n in names]
    known = [(f"n{i}", word(), i) for i in range(3)]
    left = spark.createDataFrame([(*s, "k") for s in surfaces], "norm string, seq int, category string").repartition(5)
    right = spark.createDataFrame([(*k, "k") for k in known] + [("z", names[0], 0, "other")], "node_id string, canonical string, seq int, category string")
    got = {x.norm: (x.node_id, x.maker, x.score) for x in R.match_in_order(left, right, ("category",), threshold).collect()}
    assert got == in_order(surfaces, known, threshold)


def test_next_of_climbs_to_the_first_ancestor_with_a_successor(spark):
    rows = [("A", None, "none"), ("B", None, "none"), ("A:x", "A", "x"), ("B:x", "B", "x"), ("u", "A:x", "x"), ("v", "u", "y"), ("w", None, "x"), ("c", "d", "x"), ("d", "c", "x")]
    nodes = spark.createDataFrame([(*r, "detail" if ":" in r[0] else "unit") for r in rows], "id string, parent string, polarity string, tier string")
    out = {r.id: (r.next, r.how) for r in G.next_of(nodes, spark.createDataFrame([("A", "B")], "src string, dst string")).collect()}
    assert out == {"A": ("B", "self"), "B": (None, "none"), "A:x": ("B:x", "derived_instance"), "B:x": (None, "none"), "u": ("B:x", "derived_instance"), "v": ("B", "derived_merge"), "w": (None, "none"), "c": (None, "none"), "d": (None, "none")}


def test_rename_of_scoped_names(spark):
    names = {1: "A", 2: "A::b", 3: "A::b::c", 4: "A::bc", 5: "E", 6: "E::b"}
    nodes = spark.createDataFrame([(i, n, "k") for i, n in names.items()], "id long, canonical string, category string")
    done, refused = C.rename(nodes, spark.createDataFrame([(2, "A::x"), (5, "F"), (6, "A")], "id long, new string"))
    assert {r.id: r.canonical for r in done.collect()} == {1: "A", 2: "A::x", 3: "A::x::c", 4: "A::bc", 5: "F", 6: "F::b"}
    assert [(r.id, r.new) for r in refused.collect()] == [(6, "A")]
