"""Chains of `into`: against a plain walk, and how much is done for them."""

import random

import pytest

from provgraph.operators import graph as G


def walked(moved):
    """id -> (target, steps, circle, length, member), one id after the other."""
    into = {}
    for i, to in moved:
        if to is not None:
            into[i] = min(to, into.get(i, to))
    out = {}
    for i in into:
        seen, at = {}, i
        while at in into and at not in seen:
            seen[at] = len(seen)
            at = into[at]
        if at in seen:
            ring = [x for x, n in seen.items() if n >= seen[at]]
            out[i] = (None, None, min(ring), len(ring), i in ring)
        else:
            out[i] = (at, len(seen), None, None, False)
    return out


def frame(spark, moved, kind):
    return spark.createDataFrame(moved, f"id {kind}, into {kind}").repartition(3)


def shapes():
    r = random.Random(7)
    yield "long", [(i, r.randrange(400)) for i in range(300)] + [(5, None), (6, r.randrange(400))]
    # Tails whose least id stays their own, longer than all circles; a circle longer than all tails; short chains beside them.
    rings = [(9000 + 2 * i + b, 9000 + 2 * i + 1 - b) for i in range(60) for b in (0, 1)]
    yield "long", [(i, i + 1) for i in range(70)] + [(70, 9000)] + rings
    yield "long", [(500 + (i * 7) % 93, 500 + (i + 1) * 7 % 93) for i in range(93)] + [(i, i + 1) for i in range(0, 300, 3)] + rings
    yield "string", [(f"k{i}", f"k{r.randrange(60)}") for i in range(50)]


@pytest.mark.parametrize(("kind", "moved"), list(shapes()))
def test_chains_equal_a_plain_walk(spark, kind, moved):
    got = {r.id: tuple(r)[1:] for r in G.chains(frame(spark, moved, kind)).collect()}
    assert got == walked(moved)


def test_rounds_follow_the_length_of_circles_not_their_number(spark, monkeypatch):
    """200 circles of three ids, and a chain of three: reach 1, 2, 4 and a round that finds nothing new."""
    rounds = []
    monkeypatch.setattr(G, "stored", lambda df, real=getattr(G, "stored", None): rounds.append(df.columns) or real(df), raising=False)
    monkeypatch.setattr(G, "checkpoint", lambda df, real=G.checkpoint: rounds.append(df.columns) or real(df))
    df = frame(spark, [(3 * i + b, 3 * i + (b + 1) % 3) for i in range(200) for b in range(3)] + [(1000 + i, 1001 + i) for i in range(3)], "long")
    assert G.chain_defects(df).count() == 200
    assert len(rounds) <= 6


def test_the_planner_does_not_multiply_sizes_round_by_round(spark):
    """A chain of 1,000 takes ten rounds; the guess at what comes out may not have hundreds of digits."""
    done = G.chains(frame(spark, [(i, i + 1) for i in range(1000)], "long"))
    assert done.where("steps = 1000").count() == 1
    assert done._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 1000


def test_redirects_store_again_only_what_circles(spark, monkeypatch):
    """90 ids come to an end, 12 run into circles: the second pass is over these alone."""
    kept = []

    def checkpoint(df, real=G.checkpoint):
        kept.append((real(df), df.columns))
        return kept[-1][0]

    monkeypatch.setattr(G, "checkpoint", checkpoint)
    moved = [(i, i + 1) for i in range(90)] + [(200 + i, 200 + (i + 1) % 5) for i in range(5)] + [(300 + i, 301 + i if i < 6 else 203) for i in range(7)]
    out = {r.id: r.target for r in G.redirects(frame(spark, moved, "long")).collect()}
    assert out == {i: 90 for i in range(90)} | {200 + i: 200 + i for i in range(5)} | {300 + i: 203 for i in range(7)}
    assert [df.count() for df, columns in kept if "member" in columns] == [12]
