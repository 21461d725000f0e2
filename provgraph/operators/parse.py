"""From cells, slides and lines to pieces: filling, splitting, heading paths, routing and checks.

All of it is windows and joins within a document (sheet, deck): rows are ordered by a column the caller names.
Nulls: an empty cell is null or the empty string after trimming.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .state import free

#: Marks that mean "as above", separators of several values in their order, and heading lines.
DITTO = ("〃", "〝", "상동", "same as above")
SEPARATORS = (",", "/", "\n")
SIGNALS = ("heading", "section", "split")
HEADING = r"^(\d+(?:\.\d+)*)\.?\s+(.+)$"
SLIDE_CHARS, SLIDE_SHAPES = 600, 5


def ditto_fill(df: DataFrame, doc: str, order: str, field: str) -> DataFrame:
    """`field` with each ditto mark replaced by the last value above; `was_ditto` says where."""
    mark = F.trim(F.col(field)).isin(*DITTO)
    value = F.when(~F.coalesce(mark, F.lit(False)) & (F.trim(F.col(field)) != ""), F.col(field))
    above = F.last(value, ignorenulls=True).over(Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    hit = F.coalesce(mark, F.lit(False)) & above.isNotNull()
    own = free(df, "hit")
    return df.withColumn(own, hit).withColumn(field, F.when(F.col(own), above).otherwise(F.col(field))).withColumnRenamed(own, "was_ditto")


def merged_fill(cells: DataFrame, merged: DataFrame) -> DataFrame:
    """cells (path, sheet, row, col, value) with the empty ones of merged ranges (path, sheet, r1, c1, r2, c2) given the
    range's first value. A range's cells are listed, so the join is on equal keys."""
    spots = merged.withColumn("row", F.explode(F.sequence("r1", "r2"))).withColumn("col", F.explode(F.sequence("c1", "c2")))
    corner = cells.select("path", "sheet", F.col("row").alias("r1"), F.col("col").alias("c1"), F.col("value").alias("corner"))
    spots = spots.join(corner, ["path", "sheet", "r1", "c1"]).select("path", "sheet", "row", "col", "corner")
    full = cells.join(spots, ["path", "sheet", "row", "col"], "full_outer")
    return full.select("path", "sheet", "row", "col", F.coalesce(F.nullif(F.col("value"), F.lit("")), "corner").alias("value"))


def multi_split(df: DataFrame, locator: str, fields: list[str]) -> DataFrame:
    """A row for each value of the first field that holds several; the locator gets #n. Of a field only the first separator in it is tried."""
    blank = F.lit(None).cast("array<string>")
    chosen: Column = F.lit(-1)
    parts: Column = blank
    for i, f in reversed(list(enumerate(fields))):
        split = blank
        for s in reversed(SEPARATORS):
            split = F.when(F.instr(F.col(f), s) > 0, F.filter(F.transform(F.split(F.col(f), s), lambda x: F.trim(x)), lambda x: x != "")).otherwise(split)
        parts = F.when(F.size(split) > 1, split).otherwise(parts)
        chosen = F.when(F.size(split) > 1, F.lit(i)).otherwise(chosen)
    which, held, n, value = (free(df, c) for c in ("which", "held", "n", "value"))
    rows = df.select("*", chosen.alias(which), F.coalesce(parts, F.array(F.lit(None).cast("string"))).alias(held))
    rows = rows.select("*", F.posexplode(held).alias(n, value))
    new = {f: F.when(F.col(which) == i, F.col(value)).otherwise(F.col(f)) for i, f in enumerate(fields)}
    new[locator] = F.when(F.col(which) >= 0, F.concat(F.col(locator), F.lit("#"), (F.col(n) + 1).cast("string"))).otherwise(F.col(locator))
    return rows.select(*(new.get(c, F.col(c)).alias(c) for c in df.columns))


def headings(df: DataFrame, text: str) -> DataFrame:
    """depth (null: no heading) and title of each line."""
    line = F.trim(F.col(text))
    is_heading = line.rlike(HEADING)
    return df.withColumn("depth", F.when(is_heading, F.size(F.split(F.regexp_extract(line, HEADING, 1), r"\."))).cast("int")).withColumn("title", F.when(is_heading, F.trim(F.regexp_extract(line, HEADING, 2))))


def propose_maps(lines: DataFrame, stored: DataFrame, doc: str, order: str, text: str) -> DataFrame:
    """(doc, order, heading, level, source): a row a line of each document's map: the `stored` one (doc, order, heading, level), as it is, if
    there is one, else by numbered headings, with level 0 for the other lines."""
    kept = stored.select(doc, order, "heading", F.col("level").cast("int").alias("level"), F.lit("stored").alias("source"))
    rest = headings(lines.join(stored.select(doc).distinct(), doc, "left_anti"), text)
    return kept.union(rest.select(doc, order, F.col("depth").isNotNull(), F.coalesce("depth", F.lit(0)), F.lit("heuristic")))


def heading_paths(heads: DataFrame, doc: str, order: str) -> DataFrame:
    """(doc, chunk, section) for headings (doc, order, depth, title): the path of titles that holds after the chunk'th
    heading, of any depth. A document's outline is folded in order; a heading closes those as deep or deeper."""
    outline = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), "depth", "title")))
    start = F.struct(F.array().cast("array<struct<depth:int,title:string>>").alias("open"), F.array().cast("array<string>").alias("paths"))

    def step(state, head):
        open_ = F.concat(F.filter(state["open"], lambda x: x["depth"] < head["depth"]), F.array(F.struct(head["depth"].alias("depth"), head["title"].alias("title"))))
        path = F.array_join(F.transform(open_, lambda x: x["title"]), " > ")
        return F.struct(open_.alias("open"), F.concat(state["paths"], F.array(path)).alias("paths"))

    held = heads.groupBy(doc).agg(outline.alias("outline")).select(doc, F.posexplode(F.aggregate("outline", start, step, lambda s: s["paths"])).alias("at", "section"))
    return held.select(doc, (F.col("at") + 1).cast("bigint").alias("chunk"), "section")


def heading_chunks(df: DataFrame, doc: str, order: str, text: str) -> DataFrame:
    """(doc, chunk, section, text): consecutive body lines joined, under the path of headings that hold at that place.
    A heading of some depth holds until one as deep or less deep comes."""
    so_far = Window.partitionBy(doc).orderBy(order)
    rows = headings(df, text).withColumn("chunk", F.sum(F.col("depth").isNotNull().cast("bigint")).over(so_far))
    paths = heading_paths(rows.where("depth is not null"), doc, order)
    body = rows.where(F.col("depth").isNull() & (F.trim(F.coalesce(F.col(text), F.lit(""))) != ""))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.trim(F.col(text)).alias("t")))), lambda x: x["t"]), "\n")
    out = body.groupBy(doc, "chunk").agg(joined.alias("text")).join(paths, [doc, "chunk"], "left")
    return out.select(doc, "chunk", F.coalesce("section", F.lit("")).alias("section"), "text")


def slide_routes(shapes: DataFrame, doc: str, slide: str, text: str) -> DataFrame:
    """(doc, slide, chars, shapes, route): one chunk a slide, a chunk a shape, or the structure map for a long single shape."""
    some = shapes.where(F.trim(F.col(text)) != "")
    out = some.groupBy(doc, slide).agg(F.sum(F.length(F.trim(F.col(text)))).alias("chars"), F.count("*").alias("shapes"))
    small = (F.col("chars") <= SLIDE_CHARS) & (F.col("shapes") <= SLIDE_SHAPES)
    return out.withColumn("route", F.when(small, "slide").when(F.col("shapes") > 1, "shape").otherwise("structure_map"))


def map_defects(maps: DataFrame, doc: str, order: str) -> DataFrame:
    """(doc, reasons): what is wrong with a map of (row, heading, level); the reasons in order, none for a good one."""
    previous = F.lag("level").over(Window.partitionBy(doc).orderBy(order))
    heads = maps.where("heading").withColumn("jump", F.col("level") > F.coalesce(previous, F.lit(0)) + 1)
    found = heads.groupBy(doc).agg(F.max(F.col("level") < 1).alias("low"), F.max("jump").alias("jump"))
    every = maps.select(doc).distinct().join(found, doc, "left")
    reasons = F.concat_ws(",", F.when(F.col("low").isNull(), "no_heading"), F.when(F.col("low"), "level_below_one"), F.when(F.col("jump"), "level_jump"))
    return every.select(doc, reasons.alias("reasons"))


def preflight(actual: DataFrame, declared: dict[str, list[str]], doc: str) -> DataFrame:
    """(doc, adapter, matched, missing, extra, ok): each document's header labels against each declared adapter's."""
    catalogue = F.array(*(F.struct(F.lit(name).alias("adapter"), F.array(*map(F.lit, labels)).alias("declared")) for name, labels in declared.items()))
    both = actual.select(doc, "labels", F.inline(catalogue))
    counts = {"matched": F.array_intersect("labels", "declared"), "missing": F.array_except("declared", "labels"), "extra": F.array_except("labels", "declared")}
    out = both.select(doc, "adapter", *(F.array_join(F.array_sort(c), "|").alias(n) for n, c in counts.items()))
    return out.withColumn("ok", (F.col("missing") == "") & (F.col("extra") == ""))


def contract_defects(pieces: DataFrame, doc: str, locator: str, text: str) -> DataFrame:
    """(doc, defect, n): locators that are empty or repeated, unresolved ditto marks, pieces without text."""
    several = free(pieces, "several")
    many = F.count("*").over(Window.partitionBy(doc, locator))
    checks = {
        "locator_missing": F.coalesce(F.trim(F.col(locator)), F.lit("")) == "",
        "locator_repeated": F.col(several) > 1,
        "ditto_left": F.coalesce(F.trim(F.col(text)).isin(*DITTO), F.lit(False)),
        "text_missing": F.coalesce(F.trim(F.col(text)), F.lit("")) == "",
    }
    hit = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in checks.items())))
    return pieces.withColumn(several, many).select(doc, F.explode(hit).alias("defect")).groupBy(doc, "defect").agg(F.count("*").alias("n"))


def fill_rates(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, fill_rate): the share of rows whose value is not blank, three digits."""
    rates = df.agg(*(F.round(F.avg(F.when(F.trim(F.coalesce(F.col(f).cast("string"), F.lit(""))) != "", 1.0).otherwise(0.0)), 3).alias(f) for f in fields))
    return rates.unpivot([], fields, "field", "fill_rate")


def normalise(df: DataFrame, doc: str, order: str, locator: str, fields: list[str], split: list[str]) -> tuple[DataFrame, DataFrame]:
    """df with the ditto marks of `fields` filled and the several values of the first `split` field that has some as rows of
    their own; and (doc, ditto_hits, split_rows)."""
    hits: Column = F.lit(0)
    for f in fields:
        df = ditto_fill(df, doc, order, f).withColumn(f"was_ditto_{f}", F.col("was_ditto").cast("int")).drop("was_ditto")
        hits = hits + F.col(f"was_ditto_{f}")
    df = df.withColumn("ditto_hits", hits).drop(*(f"was_ditto_{f}" for f in fields))
    rows = multi_split(df, locator, split)
    filled = df.groupBy(doc).agg(F.sum("ditto_hits").alias("ditto_hits"), F.count("*").alias("before"))
    counts = rows.groupBy(doc).agg(F.count("*").alias("after")).join(filled, doc).select(doc, "ditto_hits", (F.col("after") - F.col("before")).alias("split_rows"))
    return rows.drop("ditto_hits"), counts


def normalise_observed(df: DataFrame, doc: str, order: str, locator: str, fields: list[str], split: list[str]) -> tuple[DataFrame, Callable[[], dict[str, int]]]:
    """The rows of normalise, and what counts them (rows, ditto_hits, split_rows) once they have been written: the metrics are taken as
    the rows pass, by no job of their own. Each call makes its own metrics; a plan that is run twice counts the first run."""
    hits: Column = F.lit(0)
    for f in fields:
        was = free(df, f"was_ditto_{f}")
        df = ditto_fill(df, doc, order, f).withColumnRenamed("was_ditto", was)
        hits = hits + F.col(was).cast("bigint")
    filled = df.observe(before := Observation(), F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(hits), F.lit(0)).alias("ditto_hits"))
    rows = multi_split(filled.select(*(c for c in df.columns if not c.startswith("was_ditto_") and not c.startswith("_was_ditto_"))), locator, split).observe(after := Observation(), F.count(F.lit(1)).alias("rows"))

    def counts() -> dict[str, int]:
        one, two = before.get, after.get
        return {"rows": two["rows"], "ditto_hits": one["ditto_hits"], "split_rows": two["rows"] - one["rows"]}

    return rows, counts


def table_rows(cells: DataFrame, columns: dict[str, str], first_row: int, required: list[str], ditto: list[str], context: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Records of sheets' cells (doc, sheet, row, col, value) by a declared adapter: `columns` is the field of each column
    letter, data begins at `first_row`, rows without any value are none, locators are Sheet!R<row>, and `context` is the
    field that goes to the context as {model: value}. Also the violations (doc, locator, field) of required fields; a
    document with one has no records at all."""
    letter = F.trim("value")
    rows = cells.where(F.col("row") >= first_row).groupBy("doc", "sheet", "row").agg(*(F.max(F.when((F.col("col") == c) & (letter != ""), letter)).alias(f) for c, f in columns.items()))
    fields = list(columns.values())
    rows = rows.where(F.coalesce(*fields).isNotNull()).withColumn("locator", F.concat("sheet", F.lit("!R"), F.col("row").cast("string"))).withColumn("own", F.concat_ws("\x00", "doc", "sheet"))
    for f in ditto:
        rows = ditto_fill(rows, "own", "row", f).drop("was_ditto")
    lacks = F.array_compact(F.array(*(F.when(F.col(f).isNull(), F.lit(f)) for f in required)))
    bad = rows.select("doc", "locator", F.explode(lacks).alias("field"))
    held = F.create_map(F.lit("model"), F.col(context)) if context else F.create_map().cast("map<string,string>")
    good = rows.join(bad.select("doc").distinct(), "doc", "left_anti")
    return good.select("doc", "locator", *fields, F.map_filter(held, lambda k, v: v.isNotNull()).alias("context")), bad


def cell_context(cells: DataFrame, row: int, col: str, pattern: str) -> DataFrame:
    """(doc, value): what the first group of the pattern finds in one cell of a document, for records without a context."""
    found = F.regexp_extract("value", pattern, 1)
    return cells.where((F.col("row") == row) & (F.col("col") == col)).groupBy("doc").agg(F.max(F.when(found != "", found)).alias("value"))


def with_default_context(records: DataFrame, defaults: DataFrame, key: str, doc: str = "doc") -> DataFrame:
    """Records (context map) that have the field `key`, those without a model in their context with their document's."""
    both = records.where(F.trim(F.coalesce(key, F.lit(""))) != "").join(defaults.select(doc, F.col("value").alias("model")), doc, "left")
    given = F.coalesce(F.try_element_at("context", F.lit("model")), "model")
    return both.withColumn("context", F.map_filter(F.create_map(F.lit("model"), given), lambda k, v: v.isNotNull())).drop("model")


def as_ints(df: DataFrame, fields: list[str]) -> DataFrame:
    """Fields as whole numbers; what is none is null."""
    return df.withColumns({f: F.col(f).try_cast("bigint") for f in fields})


def map_or_flat(lines: DataFrame, defects: DataFrame, doc: str, order: str, text: str) -> DataFrame:
    """(doc, chunk, section, text, hierarchy_unresolved): chunks by headings where the document's map (doc, reasons) has no
    defect, else one flat chunk of all its lines, which is flagged."""
    broken = defects.where("reasons <> ''").select(doc)
    good = heading_chunks(lines.join(broken, doc, "left_anti"), doc, order, text).withColumn("hierarchy_unresolved", F.lit(False))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.trim(F.col(text)).alias("t")))), lambda x: x["t"]), "\n")
    some = lines.join(broken, doc, "left_semi").where(F.trim(F.coalesce(F.col(text), F.lit(""))) != "")
    flat = some.groupBy(doc).agg(body.alias("text")).select(doc, F.lit(0).cast("bigint").alias("chunk"), F.lit("").alias("section"), "text", F.lit(True).alias("hierarchy_unresolved"))
    return good.union(flat)


def map_rows_defects(maps: DataFrame, lines: DataFrame, doc: str, order: str) -> DataFrame:
    """(doc, missing, extra): how many lines a map does not cover, and how many rows of the map are no lines."""
    one, two = maps.select(doc, order, F.lit(1).alias("m")).distinct(), lines.select(doc, order, F.lit(1).alias("l")).distinct()
    both = one.join(two, [doc, order], "full_outer").groupBy(doc).agg(F.count_if(F.col("m").isNull()).alias("missing"), F.count_if(F.col("l").isNull()).alias("extra"))
    return both.where("missing + extra > 0")


def prose_preflight(expects: DataFrame, doc: str, key: str) -> DataFrame:
    """(doc, ok): whether any key that an adapter expects says how to split."""
    signal = F.lit(False)
    for word in SIGNALS:
        signal = signal | F.contains(F.lower(key), F.lit(word))
    return expects.groupBy(doc).agg(F.coalesce(F.max(signal), F.lit(False)).alias("ok"))


def confirm(wanted: DataFrame, scanned: DataFrame, doc: str) -> DataFrame:
    """wanted (doc, adapter) with accepted: only what a scan (doc, adapter, ok) found to be a candidate goes on to parsing."""
    return wanted.join(scanned.where("ok").select(doc, "adapter", F.lit(True).alias("hit")).distinct(), [doc, "adapter"], "left").select(doc, "adapter", F.coalesce("hit", F.lit(False)).alias("accepted"))


def tag_coordinates(pieces: DataFrame, closed: DataFrame, ancestors: DataFrame, key: str, ref: str) -> DataFrame:
    """(key, ref, node_id, process_group): the node that a reference names by its canonical name, else by its first alias (closed:
    id, canonical, tier, alias, place), and the nearest ancestor of tier main. An unknown reference is left as it is."""
    by_name = closed.groupBy(F.col("canonical").alias(ref)).agg(F.min("id").alias("named"))
    by_alias = closed.where("alias is not null").groupBy(F.col("alias").alias(ref)).agg(F.min_by("id", F.struct("place", "id")).alias("aliased"))
    main = closed.where("tier = 'main'").select(F.col("id").alias("ancestor"), F.col("canonical").alias("main")).distinct()
    group = ancestors.join(main, "ancestor").groupBy(F.col("node").alias("node_id")).agg(F.min_by("main", "depth").alias("process_group"))
    out = pieces.select(key, ref).join(by_name, ref, "left").join(by_alias, ref, "left").withColumn("node_id", F.coalesce("named", "aliased"))
    return out.join(group, "node_id", "left").select(key, ref, "node_id", "process_group")


def coordinate_report(tagged: DataFrame, ref: str) -> DataFrame:
    """(tagged, outside, without): pieces with a node, with a reference that names none, and without a reference."""
    blank = F.trim(F.coalesce(F.col(ref), F.lit(""))) == ""
    return tagged.agg(F.count_if(F.col("node_id").isNotNull()).alias("tagged"), F.count_if(F.col("node_id").isNull() & ~blank).alias("outside"), F.count_if(blank).alias("without"))


def image_text(pieces: DataFrame, text: str, image: str) -> DataFrame:
    """Pieces whose text is blank with a summary of their image, where they have one."""
    none = (F.trim(F.coalesce(F.col(text), F.lit(""))) == "") & F.col(image).isNotNull()
    return pieces.withColumn(text, F.when(none, F.concat(F.lit("MOCK 요약: "), image)).otherwise(F.col(text)))


def envelope(pieces: DataFrame, doc: str, order: str, columns: list[str]) -> DataFrame:
    """(doc, n, pieces): a document's pieces in order, as one row."""
    body = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), *columns))), lambda x: F.struct(*(x[c].alias(c) for c in columns)))
    return pieces.groupBy(doc).agg(F.count("*").alias("n"), body.alias("pieces"))


def slide_chunks(shapes: DataFrame, doc: str, slide: str, order: str, text: str) -> DataFrame:
    """(doc, locator, text, split_path): a chunk a slide where it is small, a chunk a shape (locator #k) where it is not and has
    several, and for one long shape a chunk a heading, or one flat chunk flagged hierarchy_unresolved without headings."""
    some = shapes.where(F.trim(F.coalesce(F.col(text), F.lit(""))) != "")
    routed = some.join(slide_routes(some, doc, slide, text).select(doc, slide, "route"), [doc, slide])
    place = F.concat(F.lit("slide "), F.col(slide).cast("string"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.trim(text).alias("t")))), lambda x: x["t"]), "\n")
    whole = routed.where("route = 'slide'").groupBy(doc, slide).agg(body.alias("text")).select(doc, place.alias("locator"), "text", F.lit("slide").alias("split_path"))
    k = F.row_number().over(Window.partitionBy(doc, slide).orderBy(order))
    each = routed.where("route = 'shape'").select(doc, F.concat(place, F.lit("#"), k.cast("string")).alias("locator"), F.trim(text).alias("text"), F.lit("shape").alias("split_path"))
    long = routed.where("route = 'structure_map'").select(doc, F.struct(F.col(doc), F.col(slide)).alias("own"), place.alias("place"), F.posexplode(F.split(text, "\n")).alias("line", "words"))
    maps = headings(long, "words").groupBy("own").agg(F.count("depth").alias("heads"), F.first(doc).alias(doc), F.first("place").alias("place"))
    parts = heading_chunks(long, "own", "line", "words").join(maps, "own")
    mapped = parts.select(doc, F.when(F.col("heads") > 0, F.concat("place", F.lit("#"), F.col("chunk").cast("string"))).otherwise(F.col("place")).alias("locator"), "text", F.when(F.col("heads") > 0, "structure_map").otherwise("hierarchy_unresolved").alias("split_path"))
    return whole.union(each).union(mapped)


def flatten(df: DataFrame, key: str, nested: str, keep: tuple[str, ...] = ("context", "meta")) -> DataFrame:
    """(key, field, value): one level of a map of maps as parent.child fields; what `keep` names stays as it is, as JSON."""
    parts = df.select(key, F.explode(nested).alias("parent", "inner"))
    own = parts.where(F.col("parent").isin(*keep)).select(key, F.col("parent").alias("field"), F.to_json("inner").alias("value"))
    return own.union(parts.where(~F.col("parent").isin(*keep)).select(key, "parent", F.explode("inner").alias("child", "value")).select(key, F.concat_ws(".", "parent", "child"), "value"))


def content_chunks(records: DataFrame, fields: list[str]) -> DataFrame:
    """(chunk_id, section, field, text): a record's (record_id, locator) content fields as chunks of their own."""
    return records.unpivot(["record_id", "locator"], fields, "field", "text").where("text is not null").select(F.concat_ws("-", "record_id", "field").alias("chunk_id"), F.col("locator").alias("section"), "field", "text")
