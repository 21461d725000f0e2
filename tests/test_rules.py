"""Rules of the engine on small frames made for them: depth, circles, refusals, order, arrival and state."""

import pytest

from provgraph.functions import text as T
from provgraph.operators import answer as A
from provgraph.operators import build as B
from provgraph.operators import changes as C
from provgraph.operators import export as E
from provgraph.operators import graph as G
from provgraph.operators import intake as I
from provgraph.operators import parse as P
from provgraph.operators import resolve as R
from provgraph.operators import skeleton as S
from provgraph.operators.state import shared_dir
from provgraph.sources import contract
from provgraph.sources.adapters import Adapter, extract, register


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_walks_and_closures_have_no_depth_limit(spark):
    chain = spark.createDataFrame([(f"n{i}", "in", f"n{i + 1}") for i in range(30)], "src string, rel string, dst string")
    walked = rows(G.expand(spark.createDataFrame([(1, "n0")], "qid long, node string"), chain, [("in", "out", True)]))
    assert len(walked) == 31 and (1, "n30", 30) in walked
    nodes = chain.selectExpr("src AS id", "dst AS parent").union(spark.createDataFrame([("n30", None)], "id string, parent string"))
    assert ("n0", "n30", 30) in rows(R.closure(nodes)) and R.closure(nodes).count() == 31 * 32 // 2
    circle = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "d")], "id string, parent string")
    assert R.closure(circle).count() == 10


def test_headings_of_any_depth(spark):
    lines = [".".join("1" * d) + f" h{d}" for d in range(1, 13)] + ["deep", "1.1 up", "body"]
    df = spark.createDataFrame([("d", n, x) for n, x in enumerate(lines)], "doc string, pos int, text string")
    assert rows(P.heading_chunks(df, "doc", "pos", "text")) == [("d", 12, " > ".join(f"h{d}" for d in range(1, 13)), "deep"), ("d", 13, "h1 > up", "body")]


def test_repeated_pattern_does_not_double_edges(spark):
    patterns = spark.createDataFrame([("A", "r", "B", False)] * 2, "src_cat string, rel string, dst_cat string, symmetric boolean")
    edges = spark.createDataFrame([("A", "r", "B", "x"), ("B", "r", "A", "x")], "src_cat string, rel string, dst_cat string, path string")
    assert sorted(r.verdict for r in G.gate(edges, patterns).collect()) == ["commit", "direction_conflict"]


def test_collisions_are_found(spark):
    ids = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "chunk_id string, doc int")
    assert rows(T.collisions(ids, "chunk_id")) == [("a", 2)]


def test_revision_replaces_what_a_document_left(spark):
    """Twelve rows become six: six chunks stay, lost evidence fires, standing queue rows are as before."""
    docs = spark.createDataFrame([(1,)], "doc long")
    chunks = spark.createDataFrame([(f"c{i}", 1, str(i)) for i in range(12)] + [("z", 10, "0")], "chunk_id string, doc long, locator string")
    evidence = spark.createDataFrame([(f"n{i}", 1, str(i)) for i in range(12)] + [("n0", 10, "0")], "item string, doc long, locator string")
    values = spark.createDataFrame([("n0", 1), ("n1", 2)], "item string, value long")
    queue = spark.createDataFrame([("auto_node", 1, "n0", "-"), ("spec_conflict", 1, "n1", "-"), ("spec_conflict", 10, "n2", "-")], "kind string, doc long, key string, detail string")
    queue, chunks, evidence, values = I.withdraw(docs, queue, chunks, evidence, values)
    assert rows(queue.select("kind", "doc")) == [("auto_node", 1), ("spec_conflict", 10)] and chunks.count() == 1 and rows(values) == [("n0", 1)]
    again = evidence.union(spark.createDataFrame([(f"n{i}", 1, str(i)) for i in range(6)], evidence.schema))
    nodes = spark.createDataFrame([(f"n{i}", "auto") for i in range(12)], "id string, status string")
    lost = G.lost(nodes, spark.createDataFrame([], "src string, rel string, dst string, status string"), again)
    assert {r.key for r in lost.collect()} == {f"n{i}" for i in range(6, 12)}
    healed = I.self_heal(queue, lost.selectExpr("kind", "CAST(NULL AS long) AS doc", "key", "'-' AS detail"))
    assert healed.count() == 2 + 6 == I.self_heal(healed, lost.selectExpr("kind", "CAST(NULL AS long) AS doc", "key", "'-' AS detail")).count()


def test_equal_new_surfaces_make_one_node_in_any_order(spark):
    mention = [("d1", 1, 1, "f", "New  Thing", "Unit", "l", "none"), ("d2", 1, 1, "f", "New Thing", "Unit", "l", "none"), ("d2", 2, 2, "f", "New Thing", "Unit", "l", "left"), ("d2", 3, 3, "f", "x", "Ghost", "l", "none"), ("d2", 4, 4, "f", " ", "Unit", "l", "none")]
    schema = "doc string, piece int, pos int, field string, surface string, category string, layer string, polarity string"
    none = spark.createDataFrame([], "surface string, node_id string, category string, layer string, polarity string")
    one, two = (B.resolve(spark.createDataFrame(m, schema), none, ["Unit"]) for m in (mention, mention[::-1]))
    assert rows(one[1]) == rows(two[1]) and one[1].count() == 2 and rows(one[2]) == rows(two[2])
    assert rows(one[2].select("kind")) == [("auto_node",), ("auto_node",), ("invalid_category",)]
    known = B.register_surfaces(none, one[0])
    assert B.resolve(spark.createDataFrame(mention, schema), known, ["Unit"])[1].count() == 0


def test_merge_and_split_refuse_and_redirect(spark):
    nodes = spark.createDataFrame([("a", "A", "U", "l", "auto", None), ("b", "B", "U", "l", "auto", None), ("s", "S", "U", "l", "seed", None), ("t", "T", "U", "l", "seed", None), ("m", "M", "U", "l", "merged_into", "a")], "id string, canonical string, category string, layer string, status string, merged_into string")
    pairs = spark.createDataFrame([("b", "a"), ("s", "t"), ("a", "a"), ("m", "s"), ("q", "s")], "absorbed string, survivor string")
    dictionary = spark.createDataFrame([("A", "a", "U", "l"), ("bee", "b", "U", "l")], "surface string, node_id string, category string, layer string")
    values = spark.createDataFrame([("a", "w", "M1", 1, 2, "d2"), ("b", "w", "M1", 3, 1, "d1"), ("b", "w", "M2", 4, 3, "d1")], "node string, attr string, context string, value int, seq int, doc string")
    edges = spark.createDataFrame([("a", "r", "b", "d"), ("b", "r", "t", "d"), ("a", "r", "t", "d")], "src string, rel string, dst string, doc string")
    assert rows(C.merge_refusals(pairs, nodes)) == [("a", "a", "itself"), ("b", "a", "chain"), ("m", "s", "chain"), ("q", "s", "missing"), ("s", "t", "two_seeds")]
    out = C.merge(pairs.where("absorbed = 'b'"), nodes, dictionary, values, edges)
    assert rows(out["dictionary"].select("surface", "node_id")) == [("A", "a"), ("B", "a"), ("bee", "a")]
    assert rows(out["edges"]) == [("a", "r", "t", "d")] and rows(out["loops"]) == [("a", "r", "d")]
    assert rows(out["values"].select("context", "kept", "n_values")) == [("M1", 3, 2), ("M2", 4, 1)] and rows(out["conflicts"].select("kept", "other")) == [(3, 1)]
    items = {"alias": spark.createDataFrame([("x",), ("y",)], "item string")}
    plan = spark.createDataFrame([("alias", "x", "a1"), ("alias", "y", "a2")], "frame string, item string, target string")
    assert rows(C.split("a", plan.where("item = 'x'"), nodes, items)["residual"]) == [("alias", "y")]
    done = C.split("a", plan, nodes, items)["nodes"]
    assert rows(done.where("id like 'a%'").select("id", "merged_into")) == [("a", "a1"), ("a1", None), ("a2", None)]
    with pytest.raises(ValueError, match="actor"):
        C.log_rows(nodes, "merge", " ", "")


def test_tombstone_is_not_revived(spark):
    edges = spark.createDataFrame([("a", "r", "b", "auto"), ("a", "r", "c", "auto")], "src string, rel string, dst string, status string")
    deleted = C.delete_edges(edges, edges.where("dst = 'b'")).where("status = 'deleted_by_user'")
    new = spark.createDataFrame([("a", "r", "b", 1), ("a", "r", "d", 1)], "src string, rel string, dst string, doc int")
    assert {r.dst for r in G.upsert(new.limit(0), new, deleted).collect()} == {"d"}


def test_trees_that_break_the_rules(spark):
    for tree in ({"A@up": None}, {"left": None}, {"A": {"B": None}, "B": None}, {"A": [{"@odd": "B"}]}, {"::left": None}):
        with pytest.raises(S.TreeError):
            S.parse_tree(spark, tree, ["left", "right"])


def test_tree_as_configuration_and_as_table(spark):
    tree = {
        "Intake": {"Sort": {"Scan@split": None, "Weigh": None}, "Store": ["::left", "Shelf"]},
        "Press": {"Cut": {"@noflow": None, "Blade": None, "Guard": None}, "Fold": [{"@unordered": "Check"}, "Crease", "Glue"]},
        "Ship": None,
    }
    want = {
        ("Intake", "main", None, None, True), ("Sort", "sub", "Intake", None, True), ("Sort::Scan", "detail", "Sort", None, True), ("Sort::Scan::left", "detail", "Sort::Scan", "left", False),
        ("Sort::Scan::right", "detail", "Sort::Scan", "right", False), ("Sort::Weigh", "detail", "Sort", None, True), ("Store", "sub", "Intake", None, True), ("Store::left", "detail", "Store", "left", False),
        ("Store::Shelf", "detail", "Store", None, True), ("Press", "main", None, None, True), ("Cut", "sub", "Press", None, True), ("Cut::Blade", "detail", "Cut", None, False), ("Cut::Guard", "detail", "Cut", None, False),
        ("Fold", "sub", "Press", None, True), ("Fold::Check", "detail", "Fold", None, False), ("Fold::Crease", "detail", "Fold", None, True), ("Fold::Glue", "detail", "Fold", None, True), ("Ship", "main", None, None, True),
    }
    rows, stack = [], [(tree, None)]
    while stack:
        parts, parent = stack.pop()
        for place, (item, below) in enumerate(parts.items() if isinstance(parts, dict) else ((p, None) for p in parts)):
            rows.append((len(rows), parent, place, item["@unordered"] if isinstance(item, dict) else item, isinstance(item, dict)))
            stack += [(below, rows[-1][0])] if below else []
    table = spark.createDataFrame(rows, "node int, parent int, place int, item string, unordered boolean")
    own = lambda df: {(r.canonical, r.tier, r.parent, r.axis, r.ordered) for r in df.collect()}
    found, defects = S.tree_of(table, ["left", "right"])
    assert own(S.parse_tree(spark, tree, ["left", "right"])) == own(found) == want and defects.isEmpty()


def test_csv_begins_with_the_byte_order_mark(spark, tmp_path):
    df = spark.createDataFrame([("a", ["x", "y"]), ("b", None), ("c", [])], "id string, docs array<string>").coalesce(1)
    E.write_csv(E.csv_rows(df, ["docs"]), str(tmp_path / "csv"))
    (file,) = (tmp_path / "csv").glob("part-*.csv")
    assert file.read_bytes().startswith(b"\xef\xbb\xbfid,docs") and [x.split(",")[0] for x in file.read_text("utf-8-sig").splitlines()] == ["id", "a", "b", "c"] and "a,x | y" in file.read_text("utf-8-sig")


def test_adapters_of_users(spark):
    class Good(Adapter):
        fields, required = ("a", "b"), ("a",)

        def records(self, cells):
            for sheet, row, _, value in cells:
                if value == "boom":
                    raise KeyError("boom")
                yield f"{sheet}!R{row}", {"a": None if value == "-" else value, **({"c": "1"} if value == "odd" else {})}

    register(spark, "good_adapter", Good)
    cells = spark.createDataFrame([("d1", "s", 1, "A", "x"), ("d2", "s", 1, "A", "x"), ("d2", "s", 2, "A", "-"), ("d3", "s", 1, "A", "boom"), ("d4", "s", 1, "A", "odd")], "doc string, sheet string, row int, col string, value string")
    records, wrong = extract(cells, "good_adapter")
    assert [(r.doc, r.locator, r.fields) for r in records.collect()] == [("d1", "s!R1", {"a": "x"})]
    assert {(r.doc, r.locator, r.violation) for r in wrong.collect()} == {("d2", "s!R2", "missing:a"), ("d3", None, "KeyError: 'boom'"), ("d4", "s!R1", "undeclared:c")}
    with pytest.raises(ValueError):
        register(spark, "no_adapter", type("No", (Adapter,), {"required": ("x",)}))


def test_names_that_clash_with_helpers(spark):
    df = spark.createDataFrame([("d", 1, "x", "L1", "p,q"), ("d", 2, "〃", "L2", "r")], "doc string, o int, f string, l string, m string").selectExpr("*", "'h' AS hit", "'w' AS which", "'n' AS n", "'v' AS value", "'s' AS several", "'e' AS held")
    rows = P.normalise(df, "doc", "o", "l", ["f"], ["m"])[0]
    assert {(r.f, r.l, r.m, r.hit, r.which, r.n, r.value, r.held) for r in rows.collect()} == {("x", "L1#1", "p", "h", "w", "n", "v", "e"), ("x", "L1#2", "q", "h", "w", "n", "v", "e"), ("x", "L2", "r", "h", "w", "n", "v", "e")}
    assert P.contract_defects(df, "doc", "l", "m").isEmpty()


def test_state_and_contracts(spark, tmp_path):
    root = f"{shared_dir(spark)}/{tmp_path.name}"
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    assert contract.read_snapshot(df.limit(0), root, "s").count() == 0
    assert [contract.write_snapshot(df, root, "s"), contract.write_snapshot(df.limit(0), root, "s")] == [1, 2]
    assert contract.read_snapshot(df, root, "s").count() == 0
    contract.append_log(df, f"{root}/log")
    contract.append_log(df, f"{root}/log")
    assert contract.read_or(spark, f"{root}/log", df).count() == 2
    whole = tmp_path / "in"
    whole.mkdir()
    (whole / "a.json").write_text('[{"doc_id": "d", "context": {"m": "1"}, "pieces": [{"locator": "x", "context": {"m": "2"}}, {"locator": "y"}]}]')
    assert rows(contract.pieces(contract.read_contracts(spark, str(whole))).selectExpr("locator", "context['m']")) == [("x", "2"), ("y", "1")]


def test_order_falls_back_and_says_where_from(spark):
    nodes = spark.createDataFrame([("p", "P", None, "none"), ("q", "Q", None, "none"), ("pl", "P::left", "p", "left"), ("ql", "Q::left", "q", "left"), ("pr", "P::right", "p", "right")], "id string, canonical string, parent string, polarity string")
    after = G.next_of(nodes, spark.createDataFrame([("p", "precedes", "q")], "src string, rel string, dst string"))
    asked = spark.createDataFrame([(1, "p"), (2, "pl"), (3, "pr"), (4, "q")], "qid long, node string")
    assert [r.fact for r in A.order_facts(asked, after, nodes, "{src}>{dst}", "{src}>{dst} by {scope}", "none").orderBy("qid").collect()] == ["P>Q", "P::left>Q::left by P", "P::right>Q by P", "none"]
