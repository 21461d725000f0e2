"""Personal data: patterns for e-mail, IP, card and phone, and information-theoretic sanitisation of what reveals them.

All of it is DataFrame functions. Each value that the patterns find is a protected entity. Over the lines of
all distinct texts, n(e), n(t) and n(e, t) count the lines that hold an entity, a term (a run of letters and
digits), or both, of N lines. A term discloses PMI(e; t) = log(n(e, t) N / (n(e) n(t))) of the entity's
information IC(e) = log(N / n(e)). Where at least `support` lines show it, a term that discloses the share
`generalise` of an entity is replaced by its class in documents that hold the entity, and one that discloses
the share `remove` is removed. Copies of a text are one text: they are no further evidence.

The patterns have possessive quantifiers, which match what the plain ones would, as nothing that follows
could take back a character; so they neither recurse nor try a run of characters twice.

Defined results: a null text is empty and has no span; a null key is a document like any other; rows that
repeat key and text get equal results; a column that the caller keeps passes through under its own name,
but `n_<kind>`, `spans` and the text are the operator's; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, table

KINDS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
SIGN = {"email": "@", "ip": ".", "card": "", "phone": "+"}
TERM = r"[\p{L}\p{N}]+"
SUPPORT, GENERALISE, REMOVE = 3, 0.85, 0.95
#: Pairs of a text and a disclosing term that are sent to all tasks at most (about 50 bytes each).
SENT = 200_000


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _octet(x: Column) -> Column:
    small = F.ltrim(x, F.lit("0"))
    return (F.length(small) < 3) | ((F.length(small) == 3) & (small <= "255"))


VALID = {
    "email": lambda x: F.lit(True),
    "ip": lambda x: F.forall(F.split(x, r"\."), _octet),
    "card": lambda x: F.length(_digits(x)).between(16, 19) & F.call_function("luhn_check", _digits(x)),
    "phone": lambda x: F.length(_digits(x)).between(8, 15),
}


def _matches(text: str, kind: str) -> Column:
    found = F.regexp_extract_all(F.col(text), F.lit(KINDS[kind]), F.lit(0))
    return F.when(F.instr(F.col(text), SIGN[kind]) > 0, found) if SIGN[kind] else found


def base_spans(docs: DataFrame) -> DataFrame:
    """(h, ord, kind, start, end, value) of what the patterns find in docs (h, text), once a text, from one scan."""
    found = docs.select("h", "text", *(_matches("text", kind).alias(f"m{number}") for number, kind in enumerate(KINDS)))
    parts = []
    for number, (kind, pattern) in enumerate(KINDS.items()):
        gaps = F.transform(F.split("text", pattern, -1), F.length)
        each = lambda gaps: lambda x, i: F.struct(F.lit(number).alias("ord"), i.alias("pos"), x.alias("value"), F.get(gaps, i).alias("gap"))  # noqa: B023, E731
        parts.append(F.when(F.exists(f"m{number}", VALID[kind]), F.transform(f"m{number}", each(gaps))))
    empty = F.from_json(F.lit("[]"), "array<struct<ord int, pos int, value string, gap int>>")
    rows = found.select("h", F.inline(F.concat(*(F.coalesce(x, empty) for x in parts)))).dropDuplicates(["h", "ord", "pos"])
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.length("value")).over(Window.partitionBy("h", "ord").orderBy("pos")))
    good, name = F.lit(False), F.lit(None).cast("string")
    for number, (kind, valid) in enumerate(VALID.items()):
        good = good | ((F.col("ord") == number) & valid(F.col("value")))
        name = F.when(F.col("ord") == number, kind).otherwise(name)
    return rows.where(good).select("h", "ord", name.alias("kind"), (F.col("end") - F.length("value")).alias("start"), "end", "value")


def disclosure(docs: DataFrame, base: DataFrame, support: int = SUPPORT, least: float = GENERALISE) -> DataFrame:
    """(value, term, share) of terms that disclose at least a share of an entity, by lines of all distinct texts.
    Texts are dealt out once; lines, entities, terms and pairs of them are counted in one aggregation."""
    held = base.groupBy("h").agg(F.collect_set("value").alias("values"))
    texts = docs.groupBy("h").agg(F.first("text").alias("text")).join(held, "h", "left")
    lines = texts.select(F.explode(F.split("text", "\n", -1)).alias("line"), "values")
    words = F.array_remove(F.array_distinct(F.split("line", rf"[^\p{{L}}\p{{N}}]+", -1)), "")
    lines = lines.select(words.alias("words"), F.filter("values", lambda v: F.contains("line", v)).alias("inside"))
    none = F.lit(None).cast("string")
    cell = lambda value, term: F.struct(value.alias("value"), term.alias("term"))
    pairs = F.transform("inside", lambda v: F.concat(F.array(cell(v, none)), F.transform(F.filter("words", lambda t: ~F.contains(v, t)), lambda t: cell(v, t))))
    cells = F.concat(F.array(cell(none, none)), F.transform("words", lambda t: cell(none, t)), F.coalesce(F.flatten(pairs), F.array().cast("array<struct<value:string,term:string>>")))
    counts = lines.select(F.inline(cells)).groupBy("value", "term").agg(F.count("*").alias("n"))
    counts = checkpoint(counts.where(F.col("value").isNull() | (F.col("n") >= support)))
    total = counts.where("value is null and term is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_t = counts.where("value is null").select("term", F.col("n").alias("n_t"))
    n_e = counts.where("term is null").select("value", F.col("n").alias("n_e"))
    both = counts.select("value", "term", F.col("n").alias("n_et")).join(n_e, "value").join(n_t, "term")
    pmi = F.ln(F.col("n_et") * F.lit(float(total)) / (F.col("n_e") * F.col("n_t")))
    both = both.where(F.col("n_e") < total).select("value", "term", (pmi / F.ln(F.lit(float(total)) / F.col("n_e"))).alias("share"))
    return both.where(F.col("share") >= least)


def _instead(word: Column, share: Column, remove: float) -> Column:
    """What a term becomes: nothing, or its class."""
    kind = F.when(word.rlike("^[0-9]+$"), "<NUMBER>").when(word.rlike("[0-9]"), "<CODE>").when(word.rlike(r"^\p{Lu}"), "<NAME>").otherwise("<WORD>")
    return F.when(share >= remove, "").otherwise(kind)


def _hits(text: str, share: str, remove: float) -> Column:
    """(start, end, instead) of the terms of a text that have a share, in one pass over its words. Hits are held in
    runs of 256, so that a text with very many is not copied with each."""
    m, g = F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.transform(F.split(text, TERM, -1), F.length)
    hit = "struct<start:int,end:int,instead:string>"
    empty = F.array().cast(f"array<{hit}>")
    begin = F.struct(F.lit(0).alias("at"), empty.alias("run"), F.array().cast(f"array<array<{hit}>>").alias("done"))

    def step(state, x):
        start = state["at"] + x["gap"]
        end = start + F.length(x["word"])
        most = F.try_element_at(F.col(share), x["word"])
        one = F.array(F.struct(start.alias("start"), end.alias("end"), _instead(x["word"], most, remove).alias("instead")))
        full = F.size(state["run"]) >= 256
        moved = F.struct(end.alias("at"), F.when(full, one).otherwise(F.concat(state["run"], one)).alias("run"), F.when(full, F.concat(state["done"], F.array(state["run"]))).otherwise(state["done"]).alias("done"))
        return F.when(most.isNull(), F.struct(end.alias("at"), state["run"].alias("run"), state["done"].alias("done"))).otherwise(moved)

    each = F.zip_with(m, F.slice(g, F.lit(1), F.size(m)), lambda word, gap: F.struct(word.alias("word"), gap.alias("gap")))
    return F.aggregate(each, begin, step, lambda state: F.concat(F.flatten(state["done"]), state["run"]))


def term_spans(docs: DataFrame, base: DataFrame, terms: DataFrame, remove: float = REMOVE) -> DataFrame:
    """(h, start, end, instead): where terms that disclose an entity stand in the texts that hold it, off base spans.
    Up to SENT terms of texts go to the tasks that read the texts; more are dealt out with the texts by h."""
    of_value = terms.groupBy("value").agg(F.collect_list(F.struct("term", "share")).alias("terms"))
    owned = base.select("h", "value").distinct().join(of_value, "value").select("h", F.inline("terms"))
    owned = owned.groupBy("h", "term").agg(F.max("share").alias("share")).groupBy("h").agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("share"))
    owned = checkpoint(owned)
    size = owned.agg(F.coalesce(F.sum(F.size("share")), F.lit(0))).first()[0]
    held = docs.join(F.broadcast(owned) if size <= SENT else owned.hint("merge"), "h")
    rows = held.select("h", _hits("text", "share", remove).alias("hits")).groupBy("h").agg(F.first("hits").alias("hits")).select("h", F.inline("hits"))
    # A term is off the base spans if the last of these to begin before it has ended, and the next begins after it.
    all_ = base.select("h", "start", "end", F.lit(None).cast("string").alias("instead")).union(rows.select("h", "start", "end", "instead"))
    is_base = F.col("instead").isNull()
    past = F.max(F.when(is_base, F.col("end"))).over(Window.partitionBy("h").orderBy("start", F.col("instead").isNotNull()).rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.min(F.when(is_base, F.col("start"))).over(Window.partitionBy("h").orderBy(F.desc("start"), F.col("instead").isNull()).rowsBetween(Window.unboundedPreceding, 0))
    free = (F.coalesce("past", F.lit(0)) <= F.col("start")) & F.coalesce(F.col("ahead") >= F.col("end"), F.lit(True))
    return all_.withColumn("past", past).withColumn("ahead", ahead).where(~is_base & free).select("h", "start", "end", "instead")


def sanitise(df: DataFrame, key: str = "doc_id", text: str = "text", support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """The rows with n_<kind> of each kind, `spans` (kind, start, end: code points, end exclusive; terms last) and the
    text with base spans replaced by <KIND> and disclosing terms generalised or removed."""
    made = {*(f"n_{kind}" for kind in KINDS), "spans", text}
    rest = [c for c in df.columns if c not in made | {key}]
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(key).alias("id"), F.unhex(F.md5(whole)).alias("h"), whole.alias("text"), F.struct(F.lit(0).alias("_"), *rest).alias("rest"))
    docs = rows.select("h", "text")
    base = checkpoint(base_spans(docs))
    terms = checkpoint(disclosure(docs, base, support, generalise))
    more = term_spans(docs, base, terms, remove)
    spans = base.select("h", "ord", "kind", "start", "end", F.concat(F.lit("<"), F.upper("kind"), F.lit(">")).alias("instead"))
    spans = spans.union(more.select("h", F.lit(len(KINDS)), F.lit("term"), "start", "end", "instead"))
    before = Window.partitionBy("h").orderBy("start", "end", "ord").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("past", F.coalesce(F.max("end").over(before), F.lit(0)))
    piece = F.when(F.col("end") > F.col("past"), F.struct(F.col("past"), F.greatest("start", "past").alias("start"), "end", "instead"))
    found = spans.groupBy("h").agg(
        *(F.sum((F.col("kind") == kind).cast("bigint")).alias(f"n_{kind}") for kind in KINDS),
        F.array_sort(F.collect_list(F.struct("ord", "start", "end", "kind"))).alias("spans"),
        F.array_sort(F.collect_list(piece)).alias("pieces"),
    )
    all_ = rows.join(found, "h", "left")
    kept = F.transform("pieces", lambda p: F.concat(F.substring(F.col("text"), p["past"] + 1, p["start"] - p["past"]), p["instead"]))
    clean = F.when(F.col("pieces").isNull(), F.col("text")).otherwise(
        F.concat(F.array_join(kept, ""), F.substring(F.col("text"), F.array_max(F.transform("pieces", lambda p: p["end"])) + 1, F.length("text")))
    )
    nothing = F.from_json(F.lit("[]"), "array<struct<kind string, start bigint, end bigint>>")
    shown = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].cast("bigint").alias("start"), s["end"].cast("bigint").alias("end")))
    return all_.select(
        F.col("id").alias(key), *(F.coalesce(f"n_{kind}", F.lit(0).cast("bigint")).alias(f"n_{kind}") for kind in KINDS),
        F.coalesce(shown, nothing).alias("spans"), clean.alias(text), *(F.col("rest")[c].alias(c) for c in rest),
    )


def op7_pii(spark, sf_dir: str) -> DataFrame:
    out = sanitise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "term")
    return out.select("doc_id", *(f"n_{kind}" for kind in KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


_PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[ -]?[0-9])+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_KIND_SQL = " UNION ALL ".join(
    f"SELECT doc_id, {n} AS ord, '{kind}' AS kind, p, m[p] AS value, list_sum(list_transform(g[:p], lambda x: length(x))) + coalesce(list_sum(list_transform(m[:p - 1], lambda x: length(x))), 0) AS s"
    f" FROM (SELECT doc_id, m, g, unnest(generate_series(1, len(m))) AS p FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS m, regexp_split_to_array(t, '{p}') AS g FROM docs WHERE regexp_matches(t, '{p}')))"
    for n, (kind, p) in enumerate(_PLAIN.items())
)
OP7_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS (SELECT *, regexp_replace(value, '[^0-9]', '', 'g') AS digits FROM ({_KIND_SQL})),
base AS (
  SELECT doc_id, ord, kind, value, CAST(s AS BIGINT) AS s, CAST(s + length(value) AS BIGINT) AS e FROM found
  WHERE CASE kind WHEN 'email' THEN true
    WHEN 'ip' THEN len(list_filter(string_split(value, '.'), lambda x: CAST(x AS HUGEINT) > 255)) = 0
    WHEN 'card' THEN length(digits) BETWEEN 16 AND 19 AND list_sum(list_transform(generate_series(1, length(digits)), lambda i:
      CASE WHEN i % 2 = 1 THEN CAST(reverse(digits)[i] AS INTEGER) ELSE (CAST(reverse(digits)[i] AS INTEGER) * 2) // 10 + (CAST(reverse(digits)[i] AS INTEGER) * 2) % 10 END)) % 10 = 0
    ELSE length(digits) BETWEEN 8 AND 15 END
), firsts AS (SELECT t, min(doc_id) AS doc_id FROM docs GROUP BY t),
lines AS (SELECT doc_id, n, l, list_distinct(regexp_extract_all(l, '{TERM}')) AS words
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l, unnest(generate_series(1, len(string_split(t, chr(10))))) AS n FROM firsts)),
total AS (SELECT count(*) AS n FROM lines),
n_t AS (SELECT term, count(*) AS n_t FROM (SELECT unnest(words) AS term FROM lines) GROUP BY term),
inside AS (SELECT DISTINCT l.doc_id, l.n, l.words, b.value FROM lines l JOIN base b ON b.doc_id = l.doc_id AND contains(l.l, b.value)),
n_e AS (SELECT value, count(*) AS n_e FROM inside GROUP BY value HAVING count(*) >= {SUPPORT}),
n_et AS (SELECT value, term, count(*) AS n_et FROM (SELECT value, unnest(words) AS term FROM inside) WHERE NOT contains(value, term) GROUP BY value, term HAVING count(*) >= {SUPPORT}),
shares AS (SELECT value, term, ln(n_et * CAST(n AS DOUBLE) / (n_e * n_t)) / ln(CAST(n AS DOUBLE) / n_e) AS share
  FROM n_et JOIN n_e USING (value) JOIN n_t USING (term), total WHERE n_e < n),
owned AS (SELECT DISTINCT b.doc_id, s.term FROM base b JOIN shares s ON b.value = s.value WHERE s.share >= {GENERALISE}),
words AS (
  SELECT doc_id, m[p] AS term, p, sum(length(g[p]) + length(m[p])) OVER (PARTITION BY doc_id ORDER BY p) AS e
  FROM (SELECT doc_id, m, g, unnest(generate_series(1, len(m))) AS p FROM (
    SELECT doc_id, regexp_extract_all(t, '{TERM}') AS m, regexp_split_to_array(t, '{TERM}') AS g FROM docs WHERE doc_id IN (SELECT doc_id FROM owned)))
), terms AS (
  SELECT w.doc_id, {len(KINDS)} AS ord, 'term' AS kind, CAST(w.e - length(w.term) AS BIGINT) AS s, CAST(w.e AS BIGINT) AS e
  FROM words w JOIN owned o ON w.doc_id = o.doc_id AND w.term = o.term
), spans AS (
  SELECT doc_id, ord, kind, s, e FROM base UNION ALL
  SELECT * FROM terms t WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = t.doc_id AND b.s < t.e AND t.s < b.e)
)
SELECT d.doc_id, {", ".join(f"count(*) FILTER (WHERE kind = '{kind}') AS n_{kind}" for kind in KINDS)},
       sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY ord, s) FILTER (WHERE kind <> 'term'), '')) AS base_sha256,
       coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY ord, s) FILTER (WHERE kind IS NOT NULL), '') AS spans
FROM docs d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id
"""
