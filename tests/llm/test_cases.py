"""Awkward inputs, exact brute force on small fixtures, and results at the size of a shard, operator by operator."""

import base64
import gzip
import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as engine
from provgraph.llm import ann, bpe, common, gif, jaccard, lines, packing, pii, repeats, toxicity, warc

SF = "/root/testdata/sf0.001"


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def documents(sf=SF):
    t = pq.read_table(f"{sf}/documents.parquet").to_pydict()
    return dict(zip(t["doc_id"], (x or "" for x in t["text"]), strict=True))


# op1


def late_clear(samples, bits=8):
    """A code stream that goes on with its full table and never clears it."""
    clear, known, free, width, out, prefix = 1 << bits, {}, (1 << bits) + 2, bits + 1, [], None
    value, filled = clear, width
    for sample in samples:
        if prefix is None:
            prefix = sample
        elif (prefix, sample) in known:
            prefix = known[prefix, sample]
        else:
            value, filled = value | prefix << filled, filled + width
            if free < 4096:
                known[prefix, sample] = free
                free += 1
                width += free > 1 << width and width < 12
            prefix = sample
    value, filled = value | prefix << filled, filled + width
    value, filled = value | (clear + 1) << filled, filled + width
    return value.to_bytes(-(-filled // 8), "little")


def test_gif_reads_a_full_table_without_clear():
    samples = np.random.default_rng(3).integers(0, 256, 30000).astype(np.uint8).tobytes()
    assert gif.lzw_decode(late_clear(samples), 8, len(samples)) == samples
    assert gif.lzw_decode(late_clear(samples[:50]), 8, 50) == samples[:50]


def test_media_digests_are_of_what_is_stored(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stored = {r["doc_id"]: bytes(r["media"]) for r in rows(gif.store_as_gif(docs))}
    for r in rows(engine.queries()["op1_media"](spark, SF)):
        raw = documents()[r["doc_id"]].encode()
        payload = raw.ljust(max(64, -len(raw) % 64 + len(raw)), b"\0")
        counts = np.bincount(np.frombuffer(payload, np.uint8) // 16, minlength=16)
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(raw), len(payload), zlib.crc32(payload[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored[r["doc_id"]]), hashlib.sha256(stored[r["doc_id"]]).hexdigest())
        assert r["feature"].endswith(": " + " ".join(map(str, counts)))


def test_timed_frames_with_histograms(spark):
    red, blue = b"\xff\0\0" + b"\0\0\xff", b"\0\0\xff" * 2
    frames = [gif.Frame(np.zeros((2, 2), np.uint8), red, delay_ms=30, disposal=1), gif.Frame(np.ones((1, 2), np.uint8), red, top=1, delay_ms=50, disposal=3), gif.Frame(np.array([[1]], np.uint8), blue, delay_ms=10, transparent=0)]
    data = gif.encode_gif(frames, 2, 2)
    df = spark.createDataFrame([(1, bytearray(data)), (2, None), (3, bytearray(data[:20])), (4, bytearray(b""))], "doc_id long, media binary").selectExpr("*", "1 AS frame", "2 AS rgba")
    got = rows(gif.gif_frames(df))
    assert [(r["frame"], r["at_ms"], r["delay_ms"], r["disposal"]) for r in got if r["doc_id"] == 1] == [(0, 0, 30, 1), (1, 30, 50, 3), (2, 80, 10, 0)]
    assert [(r["hist_red"][15], r["hist_blue"][15]) for r in got if r["doc_id"] == 1] == [(4, 0), (2, 2), (3, 1)]
    assert {r["doc_id"] for r in got if r["error"]} == {2, 3, 4} and all(r["frame"] is None for r in got if r["error"])


def test_broken_gifs_are_errors(spark):
    frame = gif.Frame(np.arange(64, dtype=np.uint8).reshape(8, 8), gif.GRAY)
    data = gif.encode_gif([frame, frame], 8, 8)
    head = 13 + (6 << (data[10] & 7) if data[10] & 0x80 else 0)
    at = data.index(b"\x2c", head)
    size = at + 10 + (6 << (data[at + 9] & 7) if data[at + 9] & 0x80 else 0)
    short = gif.lzw_encode(bytes(10))
    early = data[: size + 1] + bytes([len(short)]) + short + b"\0\x3b"
    odd = {1: data[:size] + bytes([11]) + data[size + 1 :], 2: early, 3: data[: at + 5] + b"\xff\xff\xff\xff" + data[at + 9 :], 4: data[:6] + b"\xff\xff\xff\xff" + data[10:], 5: data[:-30], 6: b"GIF89a", 7: data}
    got = rows(gif.gif_frames(spark.createDataFrame([(k, bytearray(v)) for k, v in odd.items()], "doc_id long, media binary")))
    assert {r["doc_id"] for r in got if r["error"]} == {1, 2, 3, 4, 5, 6} and sum(r["doc_id"] == 7 and r["frame"] is not None for r in got) == 2
    assert [r["frame"] for r in got if r["doc_id"] == 5] == [0, None] and all("\n" not in r["error"] for r in got if r["error"])
    assert not rows(gif.store_as_gif(spark.createDataFrame([], "doc_id long, text string")))


def test_long_texts_as_media(spark):
    long = "é" * 1_500_000
    df = spark.createDataFrame([(1, long), (2, None)], "doc_id long, text string").selectExpr("*", "1 AS media", "2 AS n_bytes")
    got = {r["doc_id"]: r for r in rows(gif.gif_digests(gif.store_as_gif(df)))}
    raw = long.encode()
    assert got[1]["payload_sha256"] == hashlib.sha256(raw.ljust(-len(raw) % 64 + len(raw), b"\0")).hexdigest() and got[2]["payload_bytes"] == 64


# op2


def covered(rows_, length):
    first = {}
    split = [(i, (t or "").split()) for i, t in rows_]
    for i, w in split:
        for s in range(len(w) - length + 1 if i is not None else 0):
            first[tuple(w[s : s + length])] = min(first.get(tuple(w[s : s + length]), i), i)
    for i, w in split:
        gone = [False] * len(w)
        for s in range(len(w) - length + 1 if i is not None else 0):
            if first[tuple(w[s : s + length])] < i:
                gone[s : s + length] = [True] * length
        yield repr((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))


@pytest.mark.parametrize(("length", "gram", "parts", "hot"), [(13, 5, 5, 20_000), (13, 5, 5, 2), (4, 4, 2, 20_000), (4, 4, 3, 1)])
def test_repeats_equal_brute_force(spark, monkeypatch, length, gram, parts, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    r = random.Random(length)
    pool = [[f"w{r.randrange(300)}" for _ in range(60)] for _ in range(10)]
    table = []
    for _ in range(200):
        words = []
        for _ in range(r.randrange(6)):
            at = r.randrange(40)
            part = r.choice(pool)[at : at + r.randrange(1, 40)] if r.random() < 0.6 else [f"w{r.randrange(50)}" for _ in range(r.randrange(30))]
            words += [*part[:3], "zz", *part[4:]] if r.random() < 0.2 else part
        table.append((r.randrange(180) if r.random() < 0.97 else None, " ".join(words) if r.random() < 0.95 else None))  # keys repeat, with other texts
    df = spark.createDataFrame(table, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS kind", "3 AS packed").repartition(parts)
    assert sorted(repr((x["doc_id"], x["n_words"], x["n_removed"], x["text"])) for x in rows(repeats.repeats(df, length=length, gram=gram))) == sorted(covered(table, length))


def test_hot_anchor_is_split_by_window(spark, monkeypatch):
    """A passage in a third of the documents, each of which goes on in its own way: no key gathers them."""
    monkeypatch.setattr(repeats, "HOT", 50)
    largest = []
    confirmed = repeats._confirmed
    monkeypatch.setattr(repeats, "_confirmed", lambda c, *a: largest.append(c.groupBy("key").count().agg({"count": "max"}).first()[0]) or confirmed(c, *a))
    r = random.Random(3)
    passage = [f"p{i}" for i in range(20)]
    own = lambda n: [f"x{r.randrange(10**9)}" for _ in range(n)]
    table = [(i, " ".join([*own(15), *(passage if i % 3 == 0 else []), *own(15)])) for i in range(3000)]
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(30)
    assert sorted(repr((x["doc_id"], x["n_words"], x["n_removed"], x["text"])) for x in rows(repeats.repeats(df))) == sorted(covered(table, 13))
    assert largest[0] <= 60


@pytest.mark.parametrize("hot", [20_000, 2])
def test_what_a_document_repeats_is_a_row(spark, monkeypatch, hot):
    """A line that a document holds hundreds of times, and others too: equal seeds of one document go out once."""
    monkeypatch.setattr(repeats, "HOT", hot)
    sizes = []
    confirmed = repeats._confirmed
    monkeypatch.setattr(repeats, "_confirmed", lambda c, *a: sizes.append(c.count()) or confirmed(c, *a))
    line = " ".join(f"l{i}" for i in range(14))
    table = [(i, f"head{i} " + (line + " ") * (300 if i < 3 else 1 + i % 2) + " ".join(["w"] * 400 if i == 5 else [f"t{i}"])) for i in range(12)]
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(4)
    assert sorted(repr((x["doc_id"], x["n_words"], x["n_removed"], x["text"])) for x in rows(repeats.repeats(df))) == sorted(covered(table, 13))
    assert sizes[0] < 600


def test_repeated_key_keeps_its_other_text(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    got = rows(repeats.repeats(spark.createDataFrame([(1, a), (5, a), (5, b)], "doc_id long, text string")))
    assert sorted((r["doc_id"], r["n_removed"], r["text"] == b) for r in got) == [(1, 0, False), (5, 0, True), (5, 40, False)]


# op3


def test_archives_keep_odd_pages(spark):
    body = "x" * 2000
    pages = [(1, "filedesc://a", "p"), (2, "http://b/\n c\r", "q"), (3, None, None), (None, "http://n/", "n"), (4, "http://d/", body), (5, "http://e/", body), (6, "http://f/\t", body), (6, "http://g/", body), (7, "", "é" * 400)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS last", "3 AS key", "4 AS payload")
    archives = warc.page_records(warc.with_revisits(df, "page_id", "html"))
    path = warc.write_archives(archives, f"{common.shared_dir(spark)}/odd-pages")
    got = rows(warc.read_archives(spark, path))
    assert sorted(str((r["key"], r["type"], r["refers_to"], r["payload_bytes"])) for r in got) == sorted(map(str, [(1, "response", None, 1), (2, "response", None, 1), (3, "response", None, 0), (None, "response", None, 1), (4, "revisit", 6, 2000), (5, "revisit", 6, 2000), (6, "response", None, 2000), (6, "response", None, 2000), (7, "response", None, 800)]))
    content = b"".join(bytes(r["content"]) for r in rows(spark.read.format("binaryFile").load(path)))
    found = list(warc.parse_warc(gzip.decompress(content)))
    revisits = [r.fields for r in found if r.fields["WARC-Type"] == "revisit"]
    assert {(r["WARC-Refers-To-Target-URI"], r["WARC-Refers-To-Date"]) for r in revisits} == {("http://g/", "2024-07-01T00:00:00Z")}
    assert {r["WARC-Refers-To"] for r in revisits} <= {r.fields["WARC-Record-ID"] for r in found}
    assert all(r.fields["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(r.block).digest()).decode() for r in found if "WARC-Block-Digest" in r.fields)
    assert content.count(b"\x1f\x8b\x08") >= len(found)  # a member a record
    with pytest.raises(ValueError):
        warc.with_revisits(df.withColumn("refers_to", df.page_id), "page_id", "html")


def test_archives_of_an_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    path = warc.write_archives(warc.page_records(warc.with_revisits(df, "page_id", "html")), f"{common.shared_dir(spark)}/no-pages")
    assert warc.read_archives(spark, path).count() == 0


# op4


def test_bpe_query_offsets_and_decoding(spark):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    for r in rows(engine.queries()["op4_byte_bpe"](spark, SF)):
        text = documents()[r["doc_id"]]
        ids = np.array(other.encode_ordinary(text), "<u4")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    odd = spark.createDataFrame([(1, "né 😀𝔘 x"), (2, None), (3, ""), (3, "")], "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS decoded")
    coded = bpe.encode(odd, path, P.PATTERN, offsets=True)
    assert {r["doc_id"]: r["decoded"] for r in rows(bpe.decode(coded, path, P.PATTERN))} == {1: "né 😀𝔘 x", 2: "", 3: ""}
    one = next(r for r in rows(coded) if r["doc_id"] == 1)
    assert len(one["ids"]) == len(one["starts"]) == len(one["ends"]) and one["starts"][0] == 0 and one["ends"][-1] == len("né 😀𝔘 x")
    split = spark.createDataFrame([(1, other.encode_ordinary("😀")[:1]), (2, None), (3, [])], "doc_id long, ids array<int>")
    got = {r["doc_id"]: (r["decoded"], bytes(r["decoded_bytes"])) for r in rows(bpe.decode(split, path, P.PATTERN))}
    assert got[1] == ("�", "😀".encode()[: len(got[1][1])]) and got[2] == got[3] == ("", b"")
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(spark.createDataFrame([(1, [10**8])], "doc_id long, ids array<int>"), path, P.PATTERN).count()


# op5


def test_linked_sets_share_a_key_at_home():
    r = np.random.default_rng(5)
    for p in (60, 80, 90):
        bands = jaccard.Bands(p, 100)
        for _ in range(1500):
            size = int(r.integers(2, 60))
            x = r.integers(1, 2**62, size).astype(np.uint64)
            y = x[r.permutation(size)[: size - int(r.integers(0, 1 + size // 5))]]
            y = np.concatenate([y, r.integers(1, 2**62, int(r.integers(0, 1 + size // 5))).astype(np.uint64)])
            same, union = len(np.intersect1d(x, y)), len(np.union1d(x, y))
            if 100 * same < p * union or same == union:
                continue
            (a, home_a), (b, home_b) = (jaccard._keys(np.unique(s), bands) for s in (x, y))
            shared, i, j = np.intersect1d(a, b, return_indices=True)
            assert (home_a[i] | home_b[j]).any(), (p, len(x), len(y))


def linked_brute(table, k, p):
    sets = {i: jaccard._set(t.encode(), k) for i, t in table}
    label, ids = {i: i for i in sets}, sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if label[a] != label[b] and sets[a] and 100 * len(sets[a] & sets[b]) >= p * len(sets[a] | sets[b]):
                both = (label[a], label[b])
                label = {i: min(both) if x in both else x for i, x in label.items()}
    return {i: (len(sets[i]), label[i]) for i in sets}


@pytest.mark.parametrize(("k", "p", "bucket"), [(1, 80, 4), (3, 90, 2048)])
def test_jaccard_of_large_buckets_equals_brute_force(spark, monkeypatch, k, p, bucket):
    monkeypatch.setattr(jaccard, "BUCKET", bucket)
    r, table = random.Random(k), []
    for _ in range(20):
        base = [f"w{r.randrange(2000)}" for _ in range(r.choice([3, 6, 8, 11, 20, 60]))]
        for _ in range(r.choice([1, 3, 20])):
            t = list(base)
            for _ in range(r.randrange(1 + max(1, len(t) // 8))):
                t[r.randrange(len(t))] = f"w{r.randrange(2000)}"
            table.append((len(table), " ".join(t)))
    r.shuffle(table)
    df = spark.createDataFrame(table, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS kind", "3 AS label", "4 AS n")
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in rows(jaccard.similar(df, k=k, p=p))} == linked_brute(table, k, p)


def templates(n, seed, own=6):
    """Texts of one template that do not link, and some that do."""
    r = random.Random(seed)
    common = [f"c{i}" for i in range(30)]
    table = []
    for i in range(n):
        words = [*common[:15], *(f"o{r.randrange(10**6)}" for _ in range(own)), *common[15:]]
        table.append((i, " ".join(words if r.random() > 0.02 or not table else r.choice(table)[1].split()[::1] + ["more"])))
    return table


def test_jaccard_of_templates_is_linear(spark, monkeypatch):
    """A bucket that very many texts of one template share is split: what is compared grows with the texts, not with their square."""
    monkeypatch.setattr(jaccard, "BUCKET", 128)
    dealt = []
    blocks = jaccard._blocks
    monkeypatch.setattr(jaccard, "_blocks", lambda *a: dealt[-1].append(blocks(*a)) or dealt[-1][-1])
    sizes = []
    for n in (800, 1600):
        dealt.append([])
        table = templates(n, n)
        got = {x["doc_id"]: x["component_id"] for x in rows(jaccard.similar(spark.createDataFrame(table, "doc_id long, text string"), k=3, p=90))}
        assert got == {i: c for i, (_, c) in linked_brute(table, 3, 90).items()}
        # Pairs that blocks compare, and rows dealt out.
        sizes.append([(d.count(), d.groupBy("key", "part").count().selectExpr("coalesce(sum(count * count), 0)").first()[0]) for d in dealt[-1][jaccard.DEALS :]])
    assert max(x for x, _ in sizes[1]) <= 2.6 * max(max(x for x, _ in sizes[0]), 100)
    assert max(x for _, x in sizes[1]) <= 2.6 * max(max(x for _, x in sizes[0]), 1000)


@pytest.mark.parametrize(("p", "own"), [(80, 3), (90, 2), (70, 8)])
def test_split_buckets_lose_no_link(spark, monkeypatch, p, own):
    """Texts near the bound: of one template with few words of their own, in buckets that stay large."""
    monkeypatch.setattr(jaccard, "BUCKET", 8)
    monkeypatch.setattr(jaccard, "DEALS", 0)
    r = random.Random(p)
    common = [f"c{i}" for i in range(25)]
    table = []
    for i in range(250):
        words = [w for w in common if r.random() > 0.03] + [f"o{r.randrange(60)}" for _ in range(r.randrange(own + 1))]
        table.append((i, " ".join(words)))
    got = {x["doc_id"]: x["component_id"] for x in rows(jaccard.similar(spark.createDataFrame(table, "doc_id long, text string"), k=1, p=p))}
    assert got == {i: c for i, (_, c) in linked_brute(table, 1, p).items()}


def test_jaccard_leaves_judged_buckets(spark, monkeypatch):
    """Buckets whose sets named all their candidates are not dealt out again, though they hold sets of several components."""
    dealt, blocks = [], jaccard._blocks
    monkeypatch.setattr(jaccard, "_blocks", lambda *a: dealt.append(blocks(*a)) or dealt[-1])
    r, table = random.Random(8), []
    for i in range(60):  # pairs that share keys and do not link
        common = [f"c{i}x{j}" for j in range(30)]
        for own in "ab":
            table.append((len(table), " ".join(common + [f"{own}{i}x{j}" for j in range(10)])))
    base = [f"g{j}" for j in range(60)]
    for _ in range(12):  # a group of near copies: more candidates than a first round names
        table.append((len(table), " ".join(w if r.random() > 0.08 else f"h{r.randrange(10**6)}" for w in base)))
    got = {x["doc_id"]: x["component_id"] for x in rows(jaccard.similar(spark.createDataFrame(table, "doc_id long, text string"), k=1, p=80))}
    assert got == {i: c for i, (_, c) in linked_brute(table, 1, 80).items()}
    sizes = [d.where("id < 120").count() for d in dealt]
    assert sizes[0] > 20 and len(sizes) > 1 and not any(sizes[1:]), sizes


def test_key_with_two_texts_joins_their_groups(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    got = rows(jaccard.similar(spark.createDataFrame([(1, a), (2, b), (5, a), (5, b), (9, "")], "doc_id long, text string")))
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (2, 1), (5, 1), (5, 1), (9, 9)]


# op6


def test_pieces_equal_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows(engine.queries()["op6_packing"](spark, SF))}
    want, counts = {}, np.zeros(4097, np.int64)
    for i, text in documents().items():
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 1], "<u4")
        for n in range(-(-len(ids) // 4096)):
            part = ids[4096 * n : 4096 * (n + 1)]
            want[i, n] = (4096 * n, len(part), zlib.crc32(part.tobytes()))
            counts[len(part)] += 1
    assert got == want
    used = {r["sequence_id"] for r in rows(engine.queries()["op6_packing"](spark, SF))}
    assert len(used) <= sum(t for _, t in packing.best_fit(counts, 4096))


def test_added_tokens_are_the_library_s(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["a <|endoftext|> b", "<|startoftext|>Word<|endoftext|>", "x<|endoftext|>Y.<|ENDOFTEXT|> z", "<|endoftext|><|endoftext|>", "<|endoftext", "É\u0301 <|startoftext|>\u0301e", "", " ".join(f"w{i}<|endoftext|>" for i in range(300_000))]
    for plain in (False, True):
        library = Tokenizer.from_file(path)
        library.encode_special_tokens = plain
        own = packing.WordTokens(path, plain)
        for batch in (texts, texts[::-1]):
            assert [np.frombuffer(x, "<u4").tolist() for x in own.encode([t.encode() for t in batch])] == [library.encode(t, add_special_tokens=False).ids for t in batch]
    df = spark.createDataFrame([(1, texts[0]), (2, texts[7])], "doc_id long, text string")
    got = rows(packing.pieces(df, path))
    assert [r["length"] for r in got if r["doc_id"] == 1] == [4] and sum(r["length"] for r in got if r["doc_id"] == 2) > 900_000


class Counted:
    """A tokenizer that notes how many texts it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, 0

    def encode_batch_fast(self, texts, **more):
        self.texts += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **more)

    def encode(self, text, **more):
        self.texts += 1
        return self.tokenizer.encode(text, **more)


def test_ids_of_odd_words_and_what_the_tokenizer_is_given():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, own, r = Tokenizer.from_file(path), packing.WordTokens(path), np.random.default_rng(6)
    parts = [*"abzAZ09'.,_<|>$+\\`\"~-", "'s", "'ll", "\xe9", "\xc9", "\xdf", "\xff", "\xd7", "\xf7", "\xb5", "\u0130", "\u01c5", "e\u0301", "\u0301", "\u0338", "\u00a0", "\u2028", "\u3000", "\u4e2d", "\U0001d518", "\U0001f600", "\0", "\x1c", "\x85", " ", " ", "\t", "\n", "\x0b", "\x0c", "\r\n"]
    texts = ["", " ", " lead", "trail ", "a.", "it's", "don't!?", "s'", "\xc9t\xe9###"] + ["".join(parts[i] for i in r.integers(0, len(parts), r.integers(1, 40))) for _ in range(4000)]
    for batch in (texts, texts[::-1], [], [""], ["", " "]):
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode([t.encode() for t in batch])] == [library.encode(t, add_special_tokens=False).ids for t in batch]
    words = ["".join(x) + y for x in np.array([*"abcdefghijklmnopqrstuvwxyz\xe9\xf6\xdf"])[r.integers(0, 29, (3000, 9))] for y in ("", "&&&", ".")]
    own = packing.WordTokens(path)
    own.tokenizer = Counted(own.tokenizer)
    got = own.encode([" ".join(words).encode()])
    assert np.frombuffer(got[0], "<u4").tolist() == library.encode(" ".join(words), add_special_tokens=False).ids
    assert own.tokenizer.texts <= 2  # the marks; words of letters need the model alone


def test_pieces_at_the_capacity_and_of_empty_texts(spark):
    import public_tokenizers

    df = spark.createDataFrame([(n, " ".join(["a"] * n) if n else None) for n in (0, 3, 4, 5, 7, 8)] + [(9, "  ")], "doc_id long, text string").coalesce(1)
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], len(r["ids"]) // 4, r["ids"][-4:] == b"\x09\0\0\0") for r in rows(packing.pieces(df, public_tokenizers.path("word_bpe_49k.json"), capacity=4, end_id=9))]
    want = [(n, i // 4, i, min(4, size - i), min(4, size - i), i + 4 >= size) for n in (0, 3, 4, 5, 7, 8, 9) for size in [n + 1 if n < 9 else 1] for i in range(0, size, 4)]
    assert sorted(got) == want


def test_rounds_end_where_the_bound_is_reached(monkeypatch):
    counts, asked, fullest = np.bincount(np.random.default_rng(4).integers(1, 900, 40_000), minlength=4097), [], packing.fullest
    monkeypatch.setattr(packing, "fullest", lambda *x: asked.append(1) or fullest(*x))
    found, taken = packing.plan(counts, 4096), np.zeros_like(counts)
    for (sizes, n), times in found:
        assert sizes @ n <= 4096
        taken[sizes] += n * times
    assert (taken == counts).all() and sum(t for _, t in found) == -(-int(counts @ np.arange(4097)) // 4096)
    assert 0 < len(asked) <= packing.ROUNDS // 2


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_packing_is_never_above_best_fit(spark, sf):
    import public_tokenizers

    lengths = packing.pieces(spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json")).groupBy("length").count().collect()
    counts = np.zeros(4097, np.int64)
    for length, n in lengths:
        counts[length] = n
    found = packing.plan(counts, 4096)
    taken = np.zeros_like(counts)
    for (sizes, n), times in found:
        assert sizes @ n <= 4096
        taken[sizes] += n * times
    assert (taken == counts).all()
    assert sum(t for _, t in found) <= sum(t for _, t in packing.best_fit(counts, 4096))


def test_packing_of_equal_and_odd_rows(spark):
    df = spark.createDataFrame([(1, 0, 3000, 7)] * 3 + [(None, 0, 1096, 1), (1, 0, 1096, 8), (2, 0, 4096, 9)], "doc_id long, piece int, length long, rank int").selectExpr("*", "1 AS class", "2 AS salt", "3 AS __rank", "map('a', 1) AS base")
    out = packing.pack(df)
    assert out.columns == [*df.columns, "sequence_id", "offset"]
    got = rows(out)
    assert len(got) == 6 and len({(r["sequence_id"], r["offset"]) for r in got}) == 6 and len({r["sequence_id"] for r in got}) == 4
    with pytest.raises(ValueError):
        packing.pack(df.withColumn("offset", df.length))


# op8


def test_lines_of_a_repeated_key_and_clashing_names(spark):
    table = [(2, "first shared line\nb"), (1, "first shared line\na"), (1, "another long line"), (3, "another long line\n\nFirst Shared LINE  "), (3, ""), (None, "first shared line")]
    df = spark.createDataFrame(table, "doc_id long, text string").selectExpr("*", "1 AS kind", "2 AS gone", "3 AS rest", "4 AS n_lines")
    got = sorted(str((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"])) for r in rows(lines.dedup_lines(df)))
    with pytest.raises(ValueError, match="carried"):
        lines.dedup_lines(df, carry=("n_lines",))
    assert got == sorted(map(str, [(2, 2, 1, "b"), (1, 2, 0, "first shared line\na"), (1, 1, 0, "another long line"), (3, 3, 2, ""), (3, 1, 0, ""), (None, 1, 0, "first shared line")]))


# op9


def test_toxicity_of_odd_tables(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a " * 50000), (3, "a " * 50000), (None, "!!!!!!!!!!!!")], "doc_id long, text string").selectExpr("*", "1 AS scored", "2 AS toxicity")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    chain = toxicity.fit(df, labels, ["toxic"])
    got = rows(toxicity.score(df, chain))
    assert len(got) == 5 and {r["toxicity"]["p_toxic"] < 1e-9 for r in got} == {True} and {r["scored"] for r in got} == {1}
    assert toxicity.score(df.limit(0), chain).count() == 0
    runs = toxicity.features(common.pa.array(["!" * 8, "!" * 9]))
    assert len(set(runs[1][np.isin(runs[0], [0, 1])])) == len(np.unique(runs[1])) and set(runs[1][runs[0] == 0]) != set(runs[1][runs[0] == 1])


def test_toxicity_takes_little_memory(spark, monkeypatch):
    df, sent = spark.createDataFrame([(1, "a")], "doc_id long, text string"), {}
    chain = toxicity.Chain(["toxic"], np.zeros(0, np.uint64), np.zeros((1, 0)), [np.zeros(0)], [-30.0], [0.5])
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: sent.update(run=run, columns=self.columns))
    toxicity.score(df, chain)
    assert sent["columns"] == ["doc_id", "text"]  # a text goes to the workers once
    texts = [" ".join(f"word{i * j % 9973}" for j in range(250)) for i in range(4000)]  # 9 MB
    batch = common.pa.record_batch({c: range(4000) if c == "doc_id" else texts for c in sent["columns"]})
    found = [np.arange(i, i + 1000, dtype=np.uint64) for i in range(3000)]  # 24 MB
    monkeypatch.setattr(toxicity, "ROUNDS", 1)
    y, folds = np.arange(3000)[:, None] % 2, np.arange(3000) % 3
    for run, most in ((lambda: sum(x.num_rows for x in sent["run"](iter([batch]))), 100e6), (lambda: len(toxicity.train(found, y, folds, ["toxic"]).bias), 45e6)):
        tracemalloc.start()
        try:
            assert run() in (4000, 1) and tracemalloc.get_traced_memory()[1] < most
        finally:
            tracemalloc.stop()


# op10


def nearest_brute(v, ids, asked, k):
    for q in asked:
        s = v @ v[q]
        s[q] = -np.inf
        order = np.lexsort((ids, -s))[:k]
        yield ids[q], [(int(ids[i]), float(s[i])) for i in order]


def test_nearest_over_shards_of_full_size(spark):
    r = np.random.default_rng(8)
    v = np.concatenate([r.normal(size=(3000, 32)) * r.uniform(0.5, 2, (3000, 1)), r.normal(size=(40, 32)).repeat(50, axis=0) + 0.1 * r.normal(size=(2000, 32))])
    ids = r.permutation(len(v)) + 1
    df = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v, strict=True)], "vec_id long, embedding array<double>")
    asked = np.flatnonzero(ids % 20 == 0)
    got = {}
    for x in rows(ann.nearest(df, df.where("vec_id % 20 = 0"), shard_rows=2048)):
        got.setdefault(x["query_id"], {})[x["rank"]] = (x["vec_id"], x["score"])
    place = {i: n for n, i in enumerate(ids.tolist())}
    hits = 0
    for q, want in nearest_brute(v, ids, asked, 20):
        own = [got[q][n] for n in range(1, 21)]
        assert own == sorted(own, key=lambda x: (-x[1], x[0])) and q not in {i for i, _ in own}
        assert all(s == pytest.approx(float(v[place[i]] @ v[place[int(q)]]), rel=1e-12) for i, s in own)
        hits += len({i for i, _ in own} & {i for i, _ in want})
    assert hits >= 0.9 * 20 * len(asked)


def test_nearest_of_many_copies_and_large_k(spark):
    r = np.random.default_rng(9)
    v = r.normal(size=(300, 8))
    v[100:200] = v[100]  # a vector that a third of all rows hold
    df = spark.createDataFrame([(n, x.tolist()) for n, x in enumerate(v)], "vec_id long, embedding array<double>").selectExpr("*", "1 AS id", "2 AS v", "3 AS shard")
    got = {}
    for x in rows(ann.nearest(df, df.where("vec_id % 50 = 0"), k=150)):
        got.setdefault(x["query_id"], {})[x["rank"]] = x["vec_id"]
    for q, want in nearest_brute(v, np.arange(300), range(0, 300, 50), 150):
        assert [got[q][n] for n in range(1, 151)] == [i for i, _ in want]
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert ann.nearest(empty, empty).count() == 0 and ann.nearest(df, empty).count() == 0


# pipeline


def test_pipeline_stage_by_stage(spark, monkeypatch):
    """run() gives what its stages give in turn, and each stage what plain Python gives on its input."""
    import corpus_pipeline as c

    seen, stages = {}, []
    for name, stage in c.STAGES:
        def watched(spark, docs, sf_dir, name=name, stage=stage):
            seen[name] = docs
            return stage(spark, docs, sf_dir)

        stages.append((name, watched))
    monkeypatch.setattr(c, "STAGES", stages)
    packed = rows(c.run(spark, SF))
    after = [name for name, _ in c.STAGES][1:]
    texts = {name: {r["doc_id"]: r["text"] or "" for r in rows(seen[name])} for name in seen}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scored = rows(toxicity.score(docs, toxicity.chain_of(docs, spark.read.parquet(f"{SF}/labels.parquet"))))
    assert set(texts["line dedup"]) == {r["doc_id"] for r in scored if not r["toxicity"]["is_toxic"]}
    first, lines_ = {}, lambda t: [(x, x.strip(" \t\n\v\f\r").translate({n: n + 32 for n in range(65, 91)})) for x in t.split("\n")]
    for i, text in texts["line dedup"].items():
        for _, k in lines_(text):
            first[k] = min(first.get(k, i), i)
    kept = {i: "\n".join(x for x, k in lines_(t) if len(k) < 10 or first[k] == i) for i, t in texts["line dedup"].items()}
    assert kept == texts[after[1]]
    labels = linked_brute(list(kept.items()), 5, 80)
    assert set(texts[after[2]]) == {i for i, (_, least) in labels.items() if i == least}
    assert set(texts[after[3]]) == set(texts[after[2]]) and not any(re.search(pii._PLAIN["email"], t) for t in texts[after[3]].values())
    by = {}
    for r in packed:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == list(np.cumsum([0, *(n for _, n in own)])[:-1]) and sum(n for _, n in own) <= 4096
    assert {r["doc_id"] for r in packed} == set(texts[after[3]])


@pytest.mark.parametrize("number", range(1, 4))
def test_pipeline_stages_of_odd_and_empty_tables(spark, number):
    import corpus_pipeline as c

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "x", "en", "s", 1), (2, "", "en", None, 0), (2, "", "en", None, 0)], schema)
    out = c.STAGES[number][1](spark, odd, SF)
    assert out.columns == list(c.COLUMNS) and out.count() == 4
    assert c.STAGES[number][1](spark, odd.limit(0), SF).count() == 0
