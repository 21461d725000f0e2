"""The training-data operators against brute force, round trips and held-out labels, on small tables with awkward rows."""

import hashlib
import os

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as engine
from provgraph.llm import ann, bpe, gif, jaccard, lines, packing, pii, repeats, toxicity, warc
from provgraph.llm.registry import ORACLE_SQL

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty texts, repeated rows, copies, a long text, and columns whose names clash with the operators' own."""
    long = " ".join(f"w{i % 977}" for i in range(30000))
    rows = [(1, None), (2, ""), (None, "a null key has text too, of more than a line\nsecond shared line"), (3, "one two three"), (3, "one two three"), (4, long), (5, long), (6, "x\nsecond shared line\ny"), (7, "y\n Second Shared LINE \nz"), (8, "mail a@b.cd, ip 1.2.3.4")]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS h", "2 AS kind", "3 AS id", "4 AS spans", "5 AS toxicity")


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    cursor = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    key = lambda found: sorted(repr(sorted(r.items())) for r in found)
    assert key(rows(engine.queries()[name](spark, SF))) == key(dict(zip(names, r, strict=True)) for r in cursor.fetchall())


def test_media_round_trip(spark):
    texts = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    want = {}
    for i, t in zip(texts["doc_id"], texts["text"], strict=True):
        raw = (t or "").encode()
        want[i] = (len(raw), hashlib.sha256(raw.ljust(max(64, -len(raw) % 64 + len(raw)), b"\0")).hexdigest())
    got = {r["doc_id"]: (r["n_bytes"], r["payload_sha256"]) for r in rows(engine.queries()["op1_media"](spark, SF))}
    assert got == want


def test_gif_rules():
    red, blue = b"\xff\0\0" + b"\0\0\xff", b"\0\0\xff" * 2
    frames = [gif.Frame(np.zeros((2, 2), np.uint8), red, disposal=1, delay_ms=10), gif.Frame(np.array([[0, 1]], np.uint8), blue, top=1, disposal=2, transparent=1, delay_ms=20), gif.Frame(np.ones((1, 1), np.uint8), red)]
    shown = [c.copy() for _, c in gif.composite(*gif.decode_gif(gif.encode_gif(frames, 2, 2)))]
    assert shown[0][..., 0].tolist() == [[255, 255]] * 2
    assert shown[1][1].tolist() == [[0, 0, 255, 255], [255, 0, 0, 255]]
    assert shown[2][1].tolist() == [[0, 0, 0, 0], [0, 0, 0, 0]] and shown[2][0, 0].tolist() == [0, 0, 255, 255]
    data = np.random.default_rng(1).integers(0, 7, 50000).astype(np.uint8).tobytes()
    assert gif.lzw_decode(gif.lzw_encode(data), 8, len(data)) == data


def test_arc_versions():
    for version in (1, 2):
        data = warc.write_arc([("http://a/", "1.2.3.4", "2001", "text/plain", b"x\n\n"), ("http://b/", "1.2.3.4", "20010203040506", "text/plain", b"")], version)
        found = list(warc.parse_arc(data))
        assert [r.block for r in found[1:]] == [b"x\n\n", b""] and {r.version for r in found} == {version}
        back = next(warc.parse_warc(warc.dump(warc.to_warc(found[1]))))
        assert back.fields["WARC-Date"] == "2001-01-01T00:00:00Z" and back.block == b"x\n\n"
    with pytest.raises(warc.ArcError):
        list(warc.parse_arc(data[:-4]))


def test_bpe_equals_tiktoken(spark):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    texts = [*pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist()[:60], "", "𝔘né 😀\n\n  x", "<|endoftext|>"]
    own = bpe.ByteBPE(path, P.PATTERN)
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == other.encode_ordinary(text) and own.decode(ids).decode() == text
    assert "".join(own.stream(own.encode(["😀é"])[0].tolist())) == "😀é"


def test_jaccard_equals_brute_force(spark):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    sets = {i: jaccard._set((t or "").encode(), 3) for i, t in zip(docs["doc_id"], docs["text"], strict=True)}
    label = {i: i for i in sets}
    for a in sorted(sets):
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                x, y = label[a], label[b]
                label = {k: min(x, y) if v in (x, y) else v for k, v in label.items()}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(engine.queries()["op5_jaccard_join"](spark, SF))}
    assert got == {i: (len(sets[i]), label[i]) for i in sets}


def test_packing_is_gapless_and_close_to_the_bound(spark):
    found = rows(engine.queries()["op6_packing"](spark, SF))
    by = {}
    for r in found:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r["length"] for r in found)
    assert len(by) <= -(-total // 4096) * 1.02 + 2


def test_nearest_recall(spark):
    t = pq.read_table("/root/testdata/sf0.01/embeddings.parquet").to_pydict()
    v, ids = np.array(t["embedding"], np.float64), np.array(t["vec_id"])
    got = {}
    for r in rows(engine.queries()["op10_nearest"](spark, "/root/testdata/sf0.01")):
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in ids[ids % 20 == 0]:
        s = v @ v[ids == q][0]
        s[ids == q] = -np.inf
        hits += len(set(ids[np.lexsort((ids, -s))[:20]].tolist()) & got[q])
    assert hits >= 0.9 * 20 * len(got) and len(got) == (ids % 20 == 0).sum()


def test_toxicity_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    chain = toxicity.chain_of(docs, labels.where("doc_id % 3 <> 2"))
    found = rows(toxicity.score(docs.select("doc_id", "text"), chain).join(labels.where("doc_id % 3 = 2"), "doc_id").selectExpr("toxicity.is_toxic AS p", "toxic = 1 AS y"))
    hit = sum(r["p"] and r["y"] for r in found)
    # About 300 toxic rows to learn from. The settings were chosen by training on doc_id % 3 = 0 and looking at doc_id % 3 = 1 only.
    assert hit >= 0.9 * sum(r["y"] for r in found) and hit >= 0.9 * sum(r["p"] for r in found)


def test_awkward_rows(spark, odd):
    n = odd.count()
    assert lines.dedup_lines(odd).count() == n
    kept = {r["doc_id"]: r["text"] for r in rows(lines.dedup_lines(odd))}
    assert kept[7] == "y\nz" and kept[6] == "x\nsecond shared line\ny" and kept[1] == ""
    assert repeats.repeats(odd).count() == n
    assert {r["doc_id"]: r["n_removed"] for r in rows(repeats.repeats(odd))}[5] == 30000
    clean = rows(pii.sanitise(odd))
    assert len(clean) == n and next(r for r in clean if r["doc_id"] == 8)["text"] == "mail <EMAIL>, ip <IP>" and clean[0]["h"] == 1
    assert {r["doc_id"]: r["component_id"] for r in rows(jaccard.similar(odd))} == {1: 1, 2: 2, None: None, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7, 8: 8}
    labels = spark.createDataFrame([(3, 1), (8, 0), (9, 1), (None, 1), (4, None)], "doc_id long, toxic int")
    assert toxicity.score(odd, toxicity.fit(odd, labels, ["toxic"])).count() == n


@pytest.mark.parametrize("run", [lambda d: lines.dedup_lines(d), lambda d: repeats.repeats(d), lambda d: jaccard.similar(d), lambda d: pii.sanitise(d), lambda d: gif.gif_digests(gif.store_as_gif(d)), lambda d: packing.packed_documents(d)])
def test_empty_tables(spark, run):
    assert run(spark.createDataFrame([], DOC)).count() == 0


def test_awkward_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (20, None), (40, [0.0, 0.0]), (60, [float("nan"), 1.0]), (1, [1.0, 0.0]), (2, [2.0, 1.0]), (2, [2.0, 1.0])], "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows(ann.nearest(df, df.where("vec_id % 20 = 0")))]
    assert sorted(got) == [(0, 1, 2, 2.0), (0, 2, 1, 1.0)]


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in c.STAGES[1:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == list(c.COLUMNS), name
    assert docs.count() > 150


def test_hot_line_costs_a_shard_one_entry_a_block(spark, monkeypatch):
    from pyspark.sql import GroupedData

    asked, cogroup = [], GroupedData.cogroup
    monkeypatch.setattr(GroupedData, "cogroup", lambda self, other: asked.append(other._df) or cogroup(self, other))
    hot = "\n".join(["a line that all documents hold"] * 50)
    docs = spark.createDataFrame([(i, f"{hot}\nand a line of document {i}") for i in range(400)], "doc_id long, text string").coalesce(1)
    kept = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in rows(lines.dedup_lines(docs))}
    assert kept[0] == (51, 0, f"{hot}\nand a line of document 0")
    assert all(kept[i] == (51, 50, f"and a line of document {i}") for i in range(1, 400))
    (sent,) = (df for df in asked if "shard" in df.columns)
    sizes = [sum(len(v) for v in r.values() if isinstance(v, (bytes, bytearray))) for r in rows(sent)]
    assert 0 < sum(sizes) <= 32 * 401  # 20,400 occurrences


@pytest.mark.parametrize("lengths", [[1] * 10000, [1, 2, 3, 5] * 30000, [65] * 60000])
def test_packing_of_short_pieces_is_close_to_the_bound(lengths):
    counts = np.bincount(lengths, minlength=packing.CLASSES + 1)
    found = packing.plan(counts, packing.CLASSES)
    taken = np.zeros_like(counts)
    for (sizes, n), times in found:
        assert sizes @ n <= packing.CAPACITY
        taken[sizes] += n * times
    assert (taken == counts).all()
    assert sum(times for _, times in found) <= -(-sum(lengths) // packing.CAPACITY) + 1


def test_packing_fills_sequences_with_empty_texts(spark):
    docs = spark.range(10000).selectExpr("id AS doc_id", "CAST(NULL AS string) AS text")
    found = rows(packing.packed_documents(docs).groupBy("sequence_id").agg({"length": "sum", "*": "count"}))
    assert sorted(r["sum(length)"] for r in found) == [1808, 4096, 4096]
