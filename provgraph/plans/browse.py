"""Queries on sheets and prose by declared adapters, on order and attribute facts, and on what can be looked at."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import answer as A
from ..operators import browse as V
from ..operators import graph as G
from ..operators import parse as P
from ..operators import resolve as R
from ..operators.state import shared_dir
from ..sources.adapters import Adapter, extract, register
from . import world as W
from .world import SQL, read


def _s(x):
    return F.col(x).cast("string")


def normalise_counts(spark, sf_dir):
    """Parts of a brand with ditto marks and names of several words."""
    k = F.col("p_partkey")
    rows = read(spark, sf_dir, "part").select("p_brand", "p_partkey", F.concat(F.lit("R"), _s("p_partkey")).alias("locator"), F.when(k % 3 == 0, F.col("p_type")).otherwise("〃").alias("type"), F.replace("p_name", F.lit(" "), F.when(k % 2 == 0, ",").otherwise(" ")).alias("name"))
    return P.normalise(rows, "p_brand", "p_partkey", "locator", ["type"], ["name"])[1]


def _cells(spark, sf_dir):
    """Sheets of orders' lines: a row a line from row 3 on, columns A to C, the part as a ditto mark on even lines; a title in A1."""
    line = read(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber")
    values = F.create_map(F.lit("A"), F.when(n % 2 == 0, "〃").otherwise(_s("l_partkey")), F.lit("B"), F.when((F.col("l_orderkey") % 10 != 0) | (n % 3 != 0), _s("l_suppkey")), F.lit("C"), F.when(n % 2 == 1, F.col("l_returnflag")))
    rows = line.groupBy("l_orderkey", "l_linenumber").agg(*(F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_returnflag")))
    cells = rows.select(_s("l_orderkey").alias("doc"), F.lit("Sheet").alias("sheet"), (n + 2).alias("row"), F.explode(values).alias("col", "value"))
    return cells.union(read(spark, sf_dir, "orders").select(_s("o_orderkey"), F.lit("Sheet"), F.lit(1), F.lit("A"), F.concat(F.lit("model: M"), F.col("o_orderkey") % 4)))


def _table(spark, sf_dir):
    return P.table_rows(_cells(spark, sf_dir), {"A": "part", "B": "supplier", "C": "flag"}, 3, ["supplier"], ["part"], "flag")


def table_records(spark, sf_dir):
    return _table(spark, sf_dir)[0].select("doc", "locator", "part", "supplier", F.col("context")["model"].alias("model"))


class LineAdapter(Adapter):
    """The sheets of _cells, in a user's own code."""

    fields, required = ("part", "supplier", "flag"), ("supplier",)

    def records(self, cells):
        rows, last = {}, None
        for sheet, row, col, value in cells:
            if row >= 3:
                rows.setdefault((sheet, row), {})[col] = value
        for (sheet, row), own in rows.items():
            last = last if own.get("A") == "〃" and last else own.get("A")
            yield f"{sheet}!R{row}", {"part": last, "supplier": own.get("B"), "flag": own.get("C")}


def adapter_udtf(spark, sf_dir):
    """What table_records gives, by an adapter that is code."""
    register(spark, "line_adapter", LineAdapter)
    rows = extract(_cells(spark, sf_dir), "line_adapter")[0]
    value = lambda c: F.col("fields")[c]
    return rows.select("doc", "locator", value("part").alias("part"), value("supplier").alias("supplier"), value("flag").alias("model"))


def adapter_violations(spark, sf_dir):
    register(spark, "line_adapter", LineAdapter)
    return extract(_cells(spark, sf_dir), "line_adapter")[1]


def normalise_observed(spark, sf_dir):
    """Counts that were taken while the rows were written."""
    k = F.col("p_partkey")
    rows = read(spark, sf_dir, "part").select("p_brand", "p_partkey", F.concat(F.lit("R"), _s("p_partkey")).alias("locator"), F.when(k % 3 == 0, F.col("p_type")).otherwise("〃").alias("type"), F.replace("p_name", F.lit(" "), F.when(k % 2 == 0, ",").otherwise(" ")).alias("name"))
    out, counts = P.normalise_observed(rows, "p_brand", "p_partkey", "locator", ["type"], ["name"])
    out.write.parquet(f"{shared_dir(spark)}/observed-{uuid.uuid4()}")
    return spark.createDataFrame([counts()], "rows long, ditto_hits long, split_rows long")


def table_violations(spark, sf_dir):
    return _table(spark, sf_dir)[1]


def table_default_context(spark, sf_dir):
    defaults = P.cell_context(_cells(spark, sf_dir), 1, "A", r"model: (\w+)")
    rows = P.with_default_context(_table(spark, sf_dir)[0], defaults, "part")
    return rows.select("doc", "locator", F.col("context")["model"].alias("model"))


def table_ints(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise(_s("p_size")).alias("size"))
    return P.as_ints(rows, ["size"])


def _lines(spark, sf_dir):
    """Documents of numbered lines by supplier: every seventh part a heading of depth 1 to 3."""
    part = F.col("l_partkey")
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc"), part.alias("pos")).distinct().withColumn("l_partkey", F.col("pos"))
    depth = F.when(part % 7 == 0, "1").when(part % 7 == 1, "1.1").when(part % 7 == 2, "1.1.1")
    return rows.select("doc", "pos", F.when(depth.isNotNull(), F.concat(depth, F.lit(" part "), _s("l_partkey"))).otherwise(F.concat(F.lit("line "), _s("l_partkey"))).alias("text"))


def map_flat_fallback(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    defects = lines.select("doc").distinct().withColumn("reasons", F.when(F.col("doc") % 3 == 0, "level_jump").otherwise(""))
    return P.map_or_flat(lines, defects, "doc", "pos", "text").groupBy("doc", "hierarchy_unresolved").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"))


def map_rows_defects(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    maps = lines.where("pos % 11 <> 0").select("doc", "pos").union(lines.select("doc", F.lit(-1).cast("long")).where("doc % 2 = 0").distinct())
    return P.map_rows_defects(maps, lines, "doc", "pos")


def prose_preflight(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("user_id", F.when((F.col("event_type") == "error") & (F.col("event_id") % 2 == 0), "Heading rule").otherwise(F.col("event_type")).alias("key"))
    return P.prose_preflight(rows, "user_id", "key")


def scan_confirm(spark, sf_dir):
    k = F.col("o_custkey")
    docs = read(spark, sf_dir, "orders").select("o_custkey").distinct()
    scanned = docs.select("o_custkey", F.lit("a").alias("adapter"), (k % 3 == 0).alias("ok"))
    return P.confirm(docs.select("o_custkey", F.when(k % 2 == 0, "a").otherwise("b").alias("adapter")), scanned, "o_custkey")


def _tagged(spark, sf_dir):
    k = F.col("s_suppkey")
    pieces = read(spark, sf_dir, "supplier").select("s_suppkey", F.when(k % 5 == 4, "").when(k % 5 == 3, "nowhere").when(k % 5 == 2, F.concat(F.lit("land "), _s("s_nationkey"))).otherwise(F.concat(F.lit("NATION_"), _s("s_nationkey"))).alias("ref"))
    nodes = W.nodes(spark, sf_dir).where("status = 'seed'")
    closed = nodes.select("id", "canonical", "tier", F.when(F.col("tier") == "sub", F.concat(F.lit("land "), F.substring("id", 2, 9))).alias("alias"), F.lit(0).alias("place"))
    return P.tag_coordinates(pieces, closed, R.closure(nodes), "s_suppkey", "ref")


def coordinate_tags(spark, sf_dir):
    return _tagged(spark, sf_dir)


def coordinate_report(spark, sf_dir):
    return P.coordinate_report(_tagged(spark, sf_dir), "ref")


def image_summaries(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(" ").alias("text"), F.when(F.col("event_id") % 2 == 0, F.format_string("img_%03d", (F.col("event_id") % 1000).cast("int"))).alias("image"))
    return P.image_text(rows, "text", "image").select("event_id", "text")


def envelopes(spark, sf_dir):
    out = P.envelope(read(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("at"), "l_partkey"), "l_orderkey", "at", ["l_partkey"])
    return out.select("l_orderkey", "n", F.array_join(F.transform("pieces", lambda x: x["l_partkey"].cast("string")), ",").alias("parts"))


def _walked(spark, sf_dir):
    return A.link(W.questions(spark, sf_dir).where("qid < 500"), W.dictionary(spark, sf_dir)).select("qid", F.col("node_id").alias("node")).distinct()


def order_facts(spark, sf_dir):
    asked = _walked(spark, sf_dir).where("qid < 25 or qid between 400 and 424")
    after = G.next_of(W.nodes(spark, sf_dir), W.precedes(spark, sf_dir))
    return A.order_facts(asked, after, W.nodes(spark, sf_dir), "after {src} comes {dst}", "after {src} comes {dst} (by {scope})", "no order for {src}").select("qid", "how", "fact")


def attribute_lines(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem").where("l_linenumber = 1")
    context = F.create_map(F.lit("status"), "l_linestatus", F.lit("flag"), "l_returnflag")
    kept = R.attributes(line.select(F.concat(F.lit("S"), _s("l_suppkey")).alias("node"), "l_linestatus", "l_returnflag", context.alias("context"), F.col("l_quantity").cast("long").alias("value"), F.struct("l_orderkey", "l_partkey", "l_extendedprice").alias("seq")), ["node", "l_linestatus", "l_returnflag"], "value", ["seq"])
    values = kept.select("node", F.lit("quantity").alias("attr"), context.alias("context"), F.col("kept").alias("value"))
    walked = W.nodes(spark, sf_dir).where("category = 'Unit'").select(F.lit(1).alias("qid"), F.col("id").alias("node"))
    return A.attribute_facts(walked, values, W.nodes(spark, sf_dir), "{attr} of {node} is {value}").select("qid", "node", "fact")


def transit_notes(spark, sf_dir):
    k = F.col("s_suppkey")
    nodes = read(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), _s("s_suppkey")).alias("id"), F.when((k % 4 == 1) | (k % 8 == 4), "obsolete").otherwise("auto").alias("status"), F.when(k % 8 == 1, F.concat(F.lit("S"), (k + 3).cast("string"))).when(k % 8 == 4, "S0").alias("replaced_by"))
    moved = read(spark, sf_dir, "supplier").where("s_suppkey % 4 = 2").select(F.concat(F.lit("S"), _s("s_suppkey")).alias("id"), F.concat(F.lit("S"), (k - 1).cast("string")).alias("into"))
    linked = nodes.select(F.lit(1).alias("qid"), F.col("id").alias("node_id"))
    return A.transit_notes(linked, nodes, G.redirects(moved))


def miss_log(spark, sf_dir):
    q = W.questions(spark, sf_dir)
    return A.misses(q, A.link(q, W.dictionary(spark, sf_dir))).select("qid", "kind")


def entity_match_gated(spark, sf_dir):
    """Names against nodes of the same category and polarity only."""
    k = F.col("s_suppkey")
    found = read(spark, sf_dir, "supplier").select("s_suppkey", F.when(k % 2 == 0, F.concat(F.lit("the "), "s_name")).otherwise(F.concat(F.lit("NATION_"), _s("s_nationkey"))).alias("surface"), F.when(k % 4 < 2, "Unit").otherwise("Process").alias("category"), F.when(k % 2 == 0, "supplier").otherwise("none").alias("polarity"))
    known = W.nodes(spark, sf_dir).where("category in ('Unit', 'Process')").select(F.col("id").alias("node_id"), "canonical", "category", "polarity")
    return R.entity_matches(found, known, "s_suppkey", ("category", "polarity"))


def node_detail(spark, sf_dir):
    wanted = spark.createDataFrame([("NATION_3",), ("customer",), ("TION_24",), ("nothing",)], "wanted string")
    return V.node_detail(wanted, W.nodes(spark, sf_dir), W.dictionary(spark, sf_dir), W.edges(spark, sf_dir))


def chunk_detail(spark, sf_dir):
    chunks = W.occurs_in(spark, sf_dir).select(F.col("dst").alias("doc"), F.concat(F.lit("O"), F.lpad(_s("doc"), 10, "0")).alias("chunk_id"))
    return V.chunk_detail(chunks, W.chunks(spark, sf_dir), W.nodes(spark, sf_dir))


def tree_detail(spark, sf_dir):
    nodes = W.nodes(spark, sf_dir)
    alias = nodes.where("tier = 'detail'").select("id", F.col("polarity").alias("alias"))
    return V.tree(nodes, R.closure(nodes.where("status = 'seed'")), W.precedes(spark, sf_dir), alias)


def _schemas(spark, sf_dir):
    field = lambda name, role, category: F.struct(F.lit(name).alias("field"), F.lit(role).alias("role"), F.lit(category).cast("string").alias("category"), F.lit(None).cast("string").alias("target_layer"))
    return read(spark, sf_dir, "region").select(F.col("r_name").alias("doc_type"), F.array(field("name", "entity", "Unit"), field("note", "content", None)).alias("fields"))


def schema_roles(spark, sf_dir):
    return V.schema_roles(_schemas(spark, sf_dir))


def header_unmappable(spark, sf_dir):
    nation = read(spark, sf_dir, "nation")
    headers = nation.select(F.col("n_regionkey").cast("string").alias("doc_type"), F.col("n_nationkey").cast("string").alias("col"), F.col("n_name").alias("label"))
    roles = nation.where("n_nationkey % 2 = 0").select(F.col("n_regionkey").cast("string").alias("doc_type"), F.col("n_nationkey").cast("string").alias("col"), F.when(F.col("n_nationkey") % 4 == 0, "unmappable").otherwise("entity").alias("role"))
    return V.unmappable(headers, roles)


def map_propose(spark, sf_dir):
    """Documents of lines, a third of which have a stored map that calls every line a heading."""
    lines = _lines(spark, sf_dir)
    stored = lines.where("doc % 3 = 0").select("doc", "pos", F.lit(True).alias("heading"), F.lit(1).alias("level"))
    return P.propose_maps(lines, stored, "doc", "pos", "text").groupBy("doc", "source").agg(F.count("*").alias("n"), F.count_if("heading").alias("headings"), F.sum("level").alias("levels"))


def review_anomalies(spark, sf_dir):
    """Orders as samples of a type a customer: violations of their sheets, types with one sample, columns that no role was found for."""
    k = F.col("o_orderkey")
    kind = F.concat(F.lit("T"), _s("o_custkey"))
    samples = read(spark, sf_dir, "orders").select(kind.alias("doc_type"), _s("o_orderkey").alias("doc"))
    failures = _table(spark, sf_dir)[1].select("doc", F.col("field").alias("reason"))
    unmapped = read(spark, sf_dir, "orders").where(k % 4 == 0).select(kind.alias("doc_type"), F.col("o_orderpriority").alias("field"))
    return V.anomalies(samples, failures, unmapped)


def review_depths(spark, sf_dir):
    chunks = P.heading_chunks(_lines(spark, sf_dir), "doc", "pos", "text")
    return V.review_stats(chunks.withColumn("text", F.when(F.col("chunk") % 2 == 0, F.col("text"))), "doc", "section", "text")


def slides_over(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations")
    slides = P.slide_routes(turns.withColumn("slide", F.floor(F.col("turn") / 4).cast("int")), "conv_id", "slide", "text")
    return V.over_threshold(slides, "conv_id", P.SLIDE_CHARS, P.SLIDE_SHAPES)


def platform_counts(spark, sf_dir):
    docs = read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("doc_type"))
    ops = read(spark, sf_dir, "events").select(F.col("event_type").alias("op"))
    return V.platform_counts(W.nodes(spark, sf_dir), docs, ops)


def contract_sample(spark, sf_dir):
    return V.contract_sample(read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("doc_type"), F.col("o_orderkey").alias("doc_id")))


QUERIES = {f.__name__: f for f in (normalise_counts, normalise_observed, table_records, adapter_udtf, adapter_violations, table_violations, table_default_context, table_ints, map_flat_fallback, map_rows_defects, prose_preflight, scan_confirm, coordinate_tags, coordinate_report, image_summaries, envelopes, order_facts, attribute_lines, transit_notes, miss_log, entity_match_gated, node_detail, chunk_detail, tree_detail, schema_roles, header_unmappable, map_propose, review_anomalies, review_depths, slides_over, platform_counts, contract_sample)}

_ROWS = """WITH l AS (SELECT l_orderkey, l_linenumber AS n, min(l_partkey) AS p, min(l_suppkey) AS s, min(l_returnflag) AS f FROM lineitem GROUP BY 1, 2),
 t AS (SELECT l_orderkey, CAST(l_orderkey AS VARCHAR) AS doc, 'Sheet!R' || (n + 2) AS locator, n, CASE WHEN n % 2 = 1 THEN CAST(p AS VARCHAR) END AS own, CASE WHEN l_orderkey % 10 <> 0 OR n % 3 <> 0 THEN CAST(s AS VARCHAR) END AS supplier, CASE WHEN n % 2 = 1 THEN f END AS flag FROM l),
 r AS (SELECT *, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY doc ORDER BY n), '〃') AS part FROM t), bad AS (SELECT doc FROM r WHERE supplier IS NULL) """
_L = "SELECT DISTINCT l_suppkey AS doc, l_partkey AS pos FROM lineitem"
_TEXT = "CASE WHEN pos % 7 < 3 THEN NULL ELSE 'line ' || pos END"
_NAME = "CASE WHEN p_partkey % 2 = 0 THEN len(string_split(p_name, ' ')) ELSE 1 END"
_REF = "SELECT s_suppkey, CASE s_suppkey % 5 WHEN 4 THEN '' WHEN 3 THEN 'nowhere' WHEN 2 THEN 'land ' || s_nationkey ELSE 'NATION_' || s_nationkey END AS ref, CASE WHEN s_suppkey % 5 < 3 THEN 'N' || s_nationkey END AS node_id FROM supplier"
_DEPTHS = f"""WITH o AS ({_L}), h AS (SELECT *, CASE WHEN pos % 7 < 3 THEN pos % 7 + 1 END AS depth FROM o),
 s AS (SELECT *, count(depth) OVER w AS chunk, max(CASE WHEN depth = 1 THEN pos END) OVER w AS a, max(CASE WHEN depth = 2 THEN pos END) OVER w AS b, max(CASE WHEN depth = 3 THEN pos END) OVER w AS c FROM h WINDOW w AS (PARTITION BY doc ORDER BY pos)),
 k AS (SELECT doc, chunk, min((a IS NOT NULL)::INT + (b IS NOT NULL AND (a IS NULL OR b > a))::INT + (c IS NOT NULL AND (a IS NULL OR c > a) AND (b IS NULL OR c > b))::INT) AS deep FROM s WHERE depth IS NULL GROUP BY 1, 2) """
_UP = "up(node, ancestor, depth) AS (SELECT id, id, 0 FROM nodes UNION ALL SELECT node, n.parent, depth + 1 FROM up JOIN nodes n ON n.id = up.ancestor WHERE n.parent IS NOT NULL)"

ORACLE_SQL = {
    "normalise_counts": f"""WITH p AS (SELECT *, p_partkey % 3 <> 0 AND count(CASE WHEN p_partkey % 3 = 0 THEN 1 END) OVER (PARTITION BY p_brand ORDER BY p_partkey) > 0 AS hit FROM part)
 SELECT p_brand, CAST(count(*) FILTER (WHERE hit) AS BIGINT) AS ditto_hits, CAST(sum({_NAME}) - count(*) AS BIGINT) AS split_rows FROM p GROUP BY 1""",
    "normalise_observed": f"""SELECT CAST((SELECT count(*) FROM part) + sum(split_rows) AS BIGINT) AS rows, CAST(sum(ditto_hits) AS BIGINT) AS ditto_hits, CAST(sum(split_rows) AS BIGINT) AS split_rows FROM (WITH p AS (SELECT *, p_partkey % 3 <> 0 AND count(CASE WHEN p_partkey % 3 = 0 THEN 1 END) OVER (PARTITION BY p_brand ORDER BY p_partkey) > 0 AS hit FROM part)
 SELECT p_brand, CAST(count(*) FILTER (WHERE hit) AS BIGINT) AS ditto_hits, CAST(sum({_NAME}) - count(*) AS BIGINT) AS split_rows FROM p GROUP BY 1)""",
    "adapter_udtf": _ROWS + "SELECT doc, locator, part, supplier, flag AS model FROM r WHERE doc NOT IN (SELECT doc FROM bad)",
    "adapter_violations": _ROWS + "SELECT doc, locator, 'missing:supplier' AS violation FROM r WHERE supplier IS NULL",
    "table_records": _ROWS + "SELECT doc, locator, part, supplier, flag AS model FROM r WHERE doc NOT IN (SELECT doc FROM bad)",
    "table_violations": _ROWS + "SELECT doc, locator, 'supplier' AS field FROM r WHERE supplier IS NULL",
    "table_default_context": _ROWS + "SELECT doc, locator, coalesce(flag, 'M' || l_orderkey % 4) AS model FROM r WHERE doc NOT IN (SELECT doc FROM bad)",
    "table_ints": "SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_size AS BIGINT) END AS size FROM part",
    "map_flat_fallback": f"""{_DEPTHS} SELECT doc, false AS hierarchy_unresolved, count(*) AS chunks, CAST(sum(n) AS BIGINT) AS chars FROM (SELECT doc, chunk, sum(length('line ' || pos)) + count(*) - 1 AS n FROM s WHERE depth IS NULL AND doc % 3 <> 0 GROUP BY 1, 2) GROUP BY 1
 UNION ALL SELECT doc, true, 1, CAST(sum(length(CASE pos % 7 WHEN 0 THEN '1 part ' WHEN 1 THEN '1.1 part ' WHEN 2 THEN '1.1.1 part ' ELSE 'line ' END || pos)) + count(*) - 1 AS BIGINT) FROM o WHERE doc % 3 = 0 GROUP BY 1""",
    "map_rows_defects": f"SELECT doc, count(*) FILTER (WHERE pos % 11 = 0) AS missing, CASE WHEN doc % 2 = 0 THEN 1 ELSE 0 END AS extra FROM ({_L}) GROUP BY doc HAVING count(*) FILTER (WHERE pos % 11 = 0) > 0 OR doc % 2 = 0",
    "prose_preflight": "SELECT user_id, bool_or(event_type = 'error' AND event_id % 2 = 0) AS ok FROM events GROUP BY 1",
    "scan_confirm": "SELECT DISTINCT o_custkey, CASE WHEN o_custkey % 2 = 0 THEN 'a' ELSE 'b' END AS adapter, o_custkey % 6 = 0 AS accepted FROM orders",
    "coordinate_tags": f"SELECT s_suppkey, ref, node_id, CASE WHEN node_id IS NOT NULL THEN r_name END AS process_group FROM ({_REF}) JOIN supplier USING (s_suppkey) JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey",
    "coordinate_report": f"SELECT count(node_id) AS tagged, count(*) FILTER (WHERE ref = 'nowhere') AS outside, count(*) FILTER (WHERE ref = '') AS without FROM ({_REF})",
    "image_summaries": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 2 = 0 THEN 'MOCK 요약: img_' || lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0') ELSE ' ' END AS text FROM events",
    "envelopes": "SELECT l_orderkey, count(*) AS n, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS parts FROM lineitem GROUP BY 1",
    "order_facts": SQL + """, own AS (SELECT n.id, n.canonical, p.dst, d.canonical AS name FROM nodes n LEFT JOIN precedes p ON p.src = n.id LEFT JOIN nodes d ON d.id = p.dst WHERE n.tier = 'sub')
 SELECT q.qid, CASE WHEN q.qid < 25 THEN CASE WHEN dst IS NULL THEN 'none' ELSE 'self' END ELSE CASE WHEN dst IS NULL THEN 'none' ELSE 'derived_instance' END END AS how,
 CASE WHEN q.qid < 25 THEN CASE WHEN dst IS NULL THEN 'no order for ' || canonical ELSE 'after ' || canonical || ' comes ' || name END
 ELSE CASE WHEN dst IS NULL THEN 'no order for ' || canonical || '::customer' ELSE 'after ' || canonical || '::customer comes ' || name || '::customer (by ' || canonical || ')' END END AS fact
 FROM questions q JOIN own ON own.id = 'N' || (q.qid % 100) WHERE q.qid < 25 OR q.qid BETWEEN 400 AND 424""",
    "attribute_lines": "SELECT 1 AS qid, 'S' || l_suppkey AS node, '[flag=' || l_returnflag || ', status=' || l_linestatus || '] quantity of ' || s_name || ' is ' || CAST(arg_min(CAST(l_quantity AS BIGINT), (l_orderkey, l_partkey, l_extendedprice)) AS VARCHAR) AS fact FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_linenumber = 1 GROUP BY l_suppkey, s_name, l_returnflag, l_linestatus",
    "transit_notes": """SELECT 1 AS qid, 'S' || s_suppkey AS node_id, CASE s_suppkey % 8 WHEN 1 THEN CASE WHEN EXISTS (SELECT 1 FROM supplier o WHERE o.s_suppkey = s.s_suppkey + 3) THEN 'S0' ELSE 'S' || (s_suppkey + 3) END WHEN 4 THEN 'S0' WHEN 5 THEN NULL WHEN 2 THEN 'S' || (s_suppkey - 1) WHEN 6 THEN 'S' || (s_suppkey - 1) ELSE 'S' || s_suppkey END AS target,
 CASE s_suppkey % 8 WHEN 1 THEN 'replaced' WHEN 4 THEN 'replaced' WHEN 5 THEN 'obsolete' WHEN 2 THEN 'merged' WHEN 6 THEN 'merged' END AS note FROM supplier s""",
    "miss_log": SQL + "SELECT qid, 'miss' AS kind FROM questions WHERE qid NOT IN (SELECT qid FROM linked)",
    "entity_match_gated": """SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'S' || s_suppkey ELSE m.id END AS node_id, CASE WHEN s_suppkey % 2 = 0 THEN CAST(0.95 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END AS score FROM supplier LEFT JOIN (SELECT 'NATION_' || n_nationkey AS c, 'N' || n_nationkey AS id FROM nation) m ON c = 'NATION_' || s_nationkey
 WHERE (s_suppkey % 2 = 0 AND s_suppkey % 4 < 2) OR (s_suppkey % 2 = 1 AND s_suppkey % 4 >= 2)""",
    "node_detail": SQL + """, w(wanted, id, how) AS (SELECT 'NATION_3', 'N3', 'canonical' UNION ALL SELECT 'customer', id, 'alias' FROM nodes WHERE polarity = 'customer' AND tier = 'detail' UNION ALL SELECT 'TION_24', id, 'candidate' FROM nodes WHERE contains(canonical, 'TION_24'))
 SELECT wanted, n.id, n.canonical, n.category, n.status, how, (SELECT count(*) FROM edges e WHERE e.src = n.id) AS out_edges, (SELECT count(*) FROM edges e WHERE e.dst = n.id) AS in_edges FROM w JOIN nodes n ON n.id = w.id""",
    "chunk_detail": SQL + "SELECT node AS doc, chunk_id, canonical AS linked FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY chunk_id) AS r FROM chunks) JOIN nodes ON id = node WHERE r <= 20",
    "tree_detail": SQL + f", {_UP} SELECT string_agg(a.canonical, '/' ORDER BY u.depth DESC) AS path, n.id, CAST(max(u.depth) AS INTEGER) AS depth, n.tier, n.polarity AS axis, CASE WHEN n.tier = 'detail' THEN n.polarity ELSE '' END AS aliases, min(p.dst) AS next FROM nodes n JOIN up u ON u.node = n.id JOIN nodes a ON a.id = u.ancestor LEFT JOIN precedes p ON p.src = n.id WHERE n.status = 'seed' GROUP BY n.id, n.tier, n.polarity",
    "schema_roles": "SELECT r_name AS doc_type, p AS place, f AS field, o AS role, t AS target FROM region, (VALUES (0, 'name', 'entity', 'Unit'), (1, 'note', 'content', '')) v(p, f, o, t)",
    "header_unmappable": "SELECT CAST(n_regionkey AS VARCHAR) AS doc_type, CAST(n_nationkey AS VARCHAR) AS col, n_name AS label FROM nation WHERE n_nationkey % 4 <> 2",
    "map_propose": f"SELECT doc, CASE WHEN doc % 3 = 0 THEN 'stored' ELSE 'heuristic' END AS source, count(*) AS n, count(*) FILTER (WHERE doc % 3 = 0 OR pos % 7 < 3) AS headings, CAST(sum(CASE WHEN doc % 3 = 0 THEN 1 WHEN pos % 7 < 3 THEN pos % 7 + 1 ELSE 0 END) AS BIGINT) AS levels FROM ({_L}) GROUP BY 1",
    "review_anomalies": _ROWS + "SELECT 'T' || o_custkey AS doc_type, count(*) AS samples, CAST(coalesce(sum(f.n), 0) AS BIGINT) AS failures, CAST(count(*) < 2 AS BIGINT) AS warnings, count(DISTINCT o_orderpriority) FILTER (WHERE o_orderkey % 4 = 0) AS questions FROM orders LEFT JOIN (SELECT doc, count(*) AS n FROM r WHERE supplier IS NULL GROUP BY 1) f ON f.doc = CAST(o_orderkey AS VARCHAR) GROUP BY o_custkey",
    "review_depths": _DEPTHS + "SELECT doc, count(*) AS pieces, count(*) FILTER (WHERE chunk % 2 = 1) AS blank, CAST(max(deep) AS INTEGER) AS deepest FROM k GROUP BY 1",
    "slides_over": "SELECT conv_id, count(*) AS slides, count(*) FILTER (WHERE chars > 600 OR shapes > 5) AS over FROM (SELECT conv_id, turn // 4 AS slide, sum(length(trim(text))) AS chars, count(*) AS shapes FROM conversations WHERE trim(text) <> '' GROUP BY 1, 2) GROUP BY 1",
    "platform_counts": SQL + "SELECT 'node' AS what, status AS name, count(*) AS n FROM nodes GROUP BY 2 UNION ALL SELECT 'document', o_orderstatus, count(*) FROM orders GROUP BY 2 UNION ALL SELECT 'change', event_type, count(*) FROM events GROUP BY 2",
    "contract_sample": "SELECT o_orderpriority AS doc_type, count(*) AS n, min(o_orderkey) AS sample FROM orders GROUP BY 1",
}
