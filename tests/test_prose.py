"""The prose build's last mentions: the same as by comparing all of them, in a row for each that is asked."""

import random

from provgraph.operators import prose as T
from provgraph.operators.prose import _last


def asks(r, n):
    return [(f"d{r.randrange(2)}", r.randrange(40), r.choice(["a", " b  c", "z", None]), f"x{i}") for i in range(n)]


def test_last_mention_equals_a_plain_search(spark):
    r = random.Random(4)
    mentions = [(f"d{r.randrange(2)}", r.randrange(40), r.choice(["a", "b c", "q", None]), r.randrange(3), f"n{i:03}") for i in range(120)]
    rows = asks(r, 150)
    asked = spark.createDataFrame(rows, "doc string, piece long, src string, more string")
    found = _last(asked, spark.createDataFrame(mentions, "doc string, piece long, norm string, n int, node_id string"), "src", "src_id")
    assert found.columns == ["doc", "piece", "src", "more", "src_id"]
    want = []
    for doc, piece, src, more in rows:
        own = [(at, n, node) for d, at, norm, n, node in mentions if d == doc and norm is not None and src is not None and norm == " ".join(src.split()) and at <= piece]
        want.append((doc, piece, src, more, max(own)[2] if own else None))
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))


def test_last_mentions_are_not_paired(spark):
    """3,000 pieces that mention one surface and ask for it: no part of the plan may give more rows than went in."""
    n = 3000
    mentions = spark.range(n).selectExpr("'d' AS doc", "id AS piece", "'a' AS norm", "1 AS n", "concat('n', id) AS node_id")
    found = T._last(spark.range(n).selectExpr("'d' AS doc", "id AS piece", "'a' AS src"), mentions, "src", "out")
    assert sorted((x.piece, x.out) for x in found.collect()) == [(i, f"n{i}") for i in range(n)]
    most, nodes = 0, [found._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        inner = node.getClass().getSimpleName()
        below = [node.executedPlan()] if inner == "AdaptiveSparkPlanExec" else [node.plan()] if inner.endswith("QueryStageExec") else [node.children().apply(i) for i in range(node.children().size())]
        nodes += below
        if node.metrics().contains("numOutputRows"):
            most = max(most, node.metrics().apply("numOutputRows").value())
    assert 0 < most <= 2 * n
