"""Queries on identity and parsing, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import parse as P

NORM = "trim(regexp_replace(?, '" + T.SPACE + "', ' ', 'g'))"


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _n(x: str) -> str:
    return NORM.replace("?", x, 1)


def norm_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(T.norm("text")).alias("norm_md5"))


def _lines(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def chunk_ids_documents(spark, sf_dir):
    return T.chunk_ids(_lines(spark, sf_dir), "doc_id", "line", F.col("source"), ["pos"]).select("doc_id", "pos", "occ", "chunk_id")


def chunk_ids_conversations(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations")
    return T.chunk_ids(rows, "conv_id", "text", F.col("role"), ["turn"]).select("conv_id", "turn", "occ", "chunk_id")


def record_ids_part(spark, sf_dir):
    rows = read(spark, sf_dir, "part").withColumn("doc", F.concat(F.lit("part-"), F.col("p_brand")))
    return T.record_ids(rows, "doc", ["p_name", "p_type", "p_size"], ["p_partkey"]).select("p_partkey", "occ", "record_id")


def record_ids_lineitem(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem")
    return T.record_ids(rows, "l_orderkey", ["l_partkey", "l_suppkey", "l_linenumber", "l_returnflag"], ["l_shipdate", "l_extendedprice"]).groupBy("l_orderkey").agg(F.count("*").alias("n"), F.countDistinct("record_id").alias("ids"), F.min("record_id").alias("least"))


def _hashes(spark, sf_dir):
    return T.doc_hashes(_lines(spark, sf_dir), "doc_id", F.lit("prose"), F.lit("1"), ["line"], "pos")


def doc_hash_groups(spark, sf_dir):
    return _hashes(spark, sf_dir).groupBy("doc_hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


def duplicate_doc_hold(spark, sf_dir):
    return T.duplicate_holds(_hashes(spark, sf_dir), "doc_id")


def id_collisions(spark, sf_dir):
    return T.collisions(T.chunk_ids(_lines(spark, sf_dir), "doc_id", "line", F.col("source"), ["pos"]), "chunk_id")


def id_collisions_planted(spark, sf_dir):
    """Order lines whose ids leave out their place, so that equal lines share one."""
    rows = read(spark, sf_dir, "lineitem").select(T.content_id(F.lit("line"), F.col("l_partkey").cast("string"), F.col("l_returnflag")).alias("chunk_id"))
    return T.collisions(rows, "chunk_id")


def content_chunks_unpivot(spark, sf_dir):
    rows = T.record_ids(read(spark, sf_dir, "part").withColumn("doc", F.lit("part")), "doc", ["p_partkey"], ["p_partkey"])
    long = rows.unpivot(["record_id", "p_partkey"], ["p_name", "p_type"], "field", "text")
    return long.select(F.concat_ws("-", "record_id", "field").alias("chunk_id"), F.concat(F.lit("part!R"), F.col("p_partkey").cast("string")).alias("section"), "field", "text")


def ditto_fill(spark, sf_dir):
    """Prices' sheet with repeated types marked as ditto, filled again."""
    rows = read(spark, sf_dir, "part").select("p_brand", "p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).otherwise(F.lit("〃")).alias("value"))
    return P.ditto_fill(rows, "p_brand", "p_partkey", "value")


def merged_fill(spark, sf_dir):
    nation = read(spark, sf_dir, "nation")
    cells = nation.select(F.lit("w").alias("path"), F.col("n_regionkey").cast("string").alias("sheet"), (F.col("n_nationkey") + 1).alias("row"), F.lit(1).alias("col"), F.when(F.col("n_nationkey") < 5, F.col("n_name")).otherwise("").alias("value"))
    ranges = nation.where("n_nationkey < 5").select(F.lit("w").alias("path"), F.col("n_regionkey").cast("string").alias("sheet"), (F.col("n_nationkey") + 1).alias("r1"), F.lit(1).alias("c1"), (F.col("n_nationkey") + 6).alias("r2"), F.lit(2).alias("c2"))
    return P.merged_fill(cells, ranges)


def multi_split(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("S!R"), F.col("p_partkey").cast("string")).alias("locator"), F.when(F.col("p_partkey") % 2 == 0, F.concat_ws(", ", "p_type", "p_brand")).otherwise(F.col("p_type")).alias("a"), F.regexp_replace("p_name", " ", "/").alias("b"))
    return P.multi_split(rows, "locator", ["a", "b"])


def _outline(spark, sf_dir):
    """Order lines as an outline: now and then a heading of depth 1 to 3, made of the line's own numbers."""
    depth = F.when(F.col("l_partkey") % 7 == 0, 1).when(F.col("l_partkey") % 7 == 1, 2).when(F.col("l_partkey") % 7 == 2, 3)
    number = F.array_join(F.slice(F.array(F.lit("1"), F.lit("2"), F.lit("3")), F.lit(1), depth), ".")
    line = F.when(depth.isNotNull(), F.concat(number, F.lit(". part "), F.col("l_partkey").cast("string"))).otherwise(F.concat(F.lit("supplier "), F.col("l_suppkey").cast("string")))
    return read(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.lit(1)).withColumn("line", line).select(F.col("l_suppkey").alias("doc"), F.col("l_partkey").alias("pos"), "line")


def heading_chunks(spark, sf_dir):
    return P.heading_chunks(_outline(spark, sf_dir), "doc", "pos", "line")


def slide_routes(spark, sf_dir):
    return P.slide_routes(read(spark, sf_dir, "conversations").withColumn("slide", (F.col("turn") / 4).cast("int")), "conv_id", "slide", "text")


def map_validate(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_type") != "view").alias("heading"), (F.col("event_id") % 4).cast("int").alias("level"))
    return P.map_defects(rows, "user_id", "event_id")


ADAPTERS = {"a": ["1-URGENT", "2-HIGH"], "b": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]}


def preflight_diff(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("labels"))
    return P.preflight(rows, ADAPTERS, "o_custkey")


def fingerprint_scan(spark, sf_dir):
    return preflight_diff(spark, sf_dir).groupBy("adapter").agg(F.count_if("ok").alias("candidates"), F.count("*").alias("documents"))


def contract_defects(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("user_id", F.when(F.col("event_type") != "error", F.concat_ws("#", "event_type", F.col("value").cast("int").cast("string"))).alias("locator"), F.when(F.col("event_id") % 50 == 0, "〃").when(F.col("event_id") % 11 != 0, F.col("props")).alias("text"))
    return P.contract_defects(rows, "user_id", "locator", "text")


def review_fill_rate(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("flag"), F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("discount"), F.col("l_linestatus").alias("status"))
    return P.fill_rates(rows, ["flag", "discount", "status"])


def flatten_nested(spark, sf_dir):
    """One level of a nested object as parent.child fields."""
    props = F.from_json("props", "map<string,string>")
    rows = read(spark, sf_dir, "events").select("event_id", F.explode(props).alias("k", "value"))
    return rows.select("event_id", F.concat(F.lit("props."), F.col("k")).alias("field"), "value")


_LINES = "(SELECT doc_id, source, g - 1 AS pos, ls[g] AS line FROM (SELECT doc_id, source, ls, unnest(generate_series(1, len(ls))) AS g FROM (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents)))"
_CHUNKS = f"SELECT *, row_number() OVER (PARTITION BY doc_id, a, b ORDER BY pos) - 1 AS occ FROM (SELECT *, coalesce({_n('line')}, '') AS a, coalesce({_n('source')}, '') AS b FROM {_LINES})"
_ID = "CAST({d} AS VARCHAR) || ':' || substr(sha256(a || chr(0) || b || chr(0) || CAST(occ AS VARCHAR)), 1, 12)"
_HASHES = f"SELECT doc_id, sha256('prose' || chr(31) || '1' || chr(31) || string_agg('line=' || coalesce({_n('line')}, '') || chr(0), chr(31) ORDER BY pos)) AS doc_hash FROM {_LINES} GROUP BY doc_id"
_PREFLIGHT = """SELECT o_custkey, adapter, array_to_string(list_sort(list_intersect(labels, declared)), '|') AS matched,
 array_to_string(list_sort(list_filter(declared, lambda x: NOT list_contains(labels, x))), '|') AS missing,
 array_to_string(list_sort(list_filter(labels, lambda x: NOT list_contains(declared, x))), '|') AS extra
 FROM (SELECT o_custkey, list(DISTINCT o_orderpriority) AS labels FROM orders GROUP BY 1),
 (VALUES ('a', ['1-URGENT', '2-HIGH']), ('b', ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'])) v(adapter, declared)"""

QUERIES = {f.__name__: f for f in (norm_text, chunk_ids_documents, chunk_ids_conversations, record_ids_part, record_ids_lineitem, doc_hash_groups, duplicate_doc_hold, id_collisions, id_collisions_planted, content_chunks_unpivot, ditto_fill, merged_fill, multi_split, heading_chunks, slide_routes, map_validate, preflight_diff, fingerprint_scan, contract_defects, review_fill_rate, flatten_nested)}

ORACLE_SQL = {
    "norm_text": f"SELECT doc_id, md5({_n('text')}) AS norm_md5 FROM documents",
    "chunk_ids_documents": f"SELECT doc_id, CAST(pos AS INTEGER) AS pos, occ, {_ID.format(d='doc_id')} AS chunk_id FROM ({_CHUNKS})",
    "chunk_ids_conversations": f"SELECT conv_id, turn, occ, {_ID.format(d='conv_id')} AS chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, a, b ORDER BY turn) - 1 AS occ FROM (SELECT *, coalesce({_n('text')}, '') AS a, coalesce({_n('role')}, '') AS b FROM conversations))",
    "record_ids_part": f"SELECT p_partkey, occ, doc || ':' || substr(sha256(k || chr(0) || CAST(occ AS VARCHAR)), 1, 12) AS record_id FROM (SELECT *, row_number() OVER (PARTITION BY doc, k ORDER BY p_partkey) - 1 AS occ FROM (SELECT p_partkey, 'part-' || p_brand AS doc, {_n('coalesce(p_name, chr(32)) || chr(31) || coalesce(p_type, chr(32)) || chr(31) || coalesce(CAST(p_size AS VARCHAR), chr(32))')} AS k FROM part))",
    "record_ids_lineitem": f"SELECT l_orderkey, count(*) AS n, count(DISTINCT id) AS ids, min(id) AS least FROM (SELECT l_orderkey, CAST(l_orderkey AS VARCHAR) || ':' || substr(sha256(k || chr(0) || CAST(occ AS VARCHAR)), 1, 12) AS id FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, k ORDER BY l_shipdate, l_extendedprice) - 1 AS occ FROM (SELECT *, concat_ws(' ', l_partkey, l_suppkey, l_linenumber, l_returnflag) AS k FROM lineitem))) GROUP BY 1",
    "doc_hash_groups": f"SELECT doc_hash, count(*) AS n, min(doc_id) AS first_doc FROM ({_HASHES}) GROUP BY 1",
    "duplicate_doc_hold": f"SELECT doc_id, doc_hash, first_doc FROM (SELECT *, min(doc_id) OVER (PARTITION BY doc_hash) AS first_doc FROM ({_HASHES})) WHERE doc_id <> first_doc",
    "id_collisions": f"SELECT chunk_id, count(*) AS n FROM (SELECT {_ID.format(d='doc_id')} AS chunk_id FROM ({_CHUNKS})) GROUP BY 1 HAVING count(*) > 1",
    "id_collisions_planted": "SELECT 'line:' || substr(sha256(CAST(l_partkey AS VARCHAR) || chr(0) || l_returnflag), 1, 12) AS chunk_id, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1",
    "content_chunks_unpivot": "SELECT 'part:' || substr(sha256(CAST(p_partkey AS VARCHAR) || chr(0) || '0'), 1, 12) || '-' || field AS chunk_id, 'part!R' || p_partkey AS section, field, text FROM (SELECT p_partkey, 'p_name' AS field, p_name AS text FROM part UNION ALL SELECT p_partkey, 'p_type', p_type FROM part)",
    "ditto_fill": "SELECT p_brand, p_partkey, CASE WHEN v = '〃' AND above IS NOT NULL THEN above ELSE v END AS value, v = '〃' AND above IS NOT NULL AS was_ditto FROM (SELECT *, last_value(CASE WHEN v <> '〃' THEN v END IGNORE NULLS) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE '〃' END AS v FROM part))",
    "merged_fill": "WITH c AS (SELECT CAST(n_regionkey AS VARCHAR) AS sheet, n_nationkey + 1 AS r, 1 AS c, CASE WHEN n_nationkey < 5 THEN n_name ELSE '' END AS v FROM nation), m AS (SELECT CAST(n_regionkey AS VARCHAR) AS sheet, unnest(generate_series(n_nationkey + 1, n_nationkey + 6)) AS r, n_name FROM nation WHERE n_nationkey < 5), s AS (SELECT sheet, r, unnest([1, 2]) AS c, n_name FROM m) SELECT 'w' AS path, coalesce(c.sheet, s.sheet) AS sheet, CAST(coalesce(c.r, s.r) AS INTEGER) AS row, CAST(coalesce(c.c, s.c) AS INTEGER) AS col, coalesce(nullif(v, ''), n_name) AS value FROM c FULL JOIN s ON c.sheet = s.sheet AND c.r = s.r AND c.c = s.c",
    "multi_split": "SELECT p_partkey, 'S!R' || p_partkey || '#' || i AS locator, CASE WHEN p_partkey % 2 = 0 THEN CASE i WHEN 1 THEN p_type ELSE p_brand END ELSE p_type END AS a, CASE WHEN p_partkey % 2 = 0 THEN replace(p_name, ' ', '/') ELSE string_split(p_name, ' ')[i] END AS b FROM part, (VALUES (1), (2)) t(i)",
    "heading_chunks": """WITH o AS (SELECT DISTINCT l_suppkey AS doc, l_partkey AS pos FROM lineitem), h AS (SELECT *, CASE WHEN pos % 7 < 3 THEN pos % 7 + 1 END AS depth FROM o),
 s AS (SELECT *, count(depth) OVER w AS chunk, max(CASE WHEN depth = 1 THEN pos END) OVER w AS a, max(CASE WHEN depth = 2 THEN pos END) OVER w AS b, max(CASE WHEN depth = 3 THEN pos END) OVER w AS c FROM h WINDOW w AS (PARTITION BY doc ORDER BY pos))
 SELECT doc, chunk, min(concat_ws(' > ', 'part ' || a, CASE WHEN a IS NULL OR b > a THEN 'part ' || b END, CASE WHEN (a IS NULL OR c > a) AND (b IS NULL OR c > b) THEN 'part ' || c END)) AS section, string_agg('supplier ' || doc, chr(10)) AS text FROM s WHERE depth IS NULL GROUP BY doc, chunk""",
    "slide_routes": "SELECT *, CASE WHEN chars <= 600 AND shapes <= 5 THEN 'slide' WHEN shapes > 1 THEN 'shape' ELSE 'structure_map' END AS route FROM (SELECT conv_id, CAST(turn // 4 AS INTEGER) AS slide, CAST(sum(length(trim(text))) AS BIGINT) AS chars, count(*) AS shapes FROM conversations WHERE trim(text) <> '' GROUP BY 1, 2)",
    "map_validate": "WITH h AS (SELECT user_id, event_id % 4 AS level, event_id % 4 > coalesce(lag(event_id % 4) OVER (PARTITION BY user_id ORDER BY event_id), 0) + 1 AS jump FROM events WHERE event_type <> 'view') SELECT u.user_id, concat_ws(',', CASE WHEN low IS NULL THEN 'no_heading' END, CASE WHEN low THEN 'level_below_one' END, CASE WHEN j THEN 'level_jump' END) AS reasons FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN (SELECT user_id, bool_or(level < 1) AS low, bool_or(jump) AS j FROM h GROUP BY 1) x USING (user_id)",
    "preflight_diff": f"SELECT *, missing = '' AND extra = '' AS ok FROM ({_PREFLIGHT})",
    "fingerprint_scan": f"SELECT adapter, count(*) FILTER (WHERE missing = '' AND extra = '') AS candidates, count(*) AS documents FROM ({_PREFLIGHT}) GROUP BY 1",
    "contract_defects": """WITH p AS (SELECT user_id, CASE WHEN event_type <> 'error' THEN event_type || '#' || CAST(trunc(value) AS INTEGER) END AS loc, CASE WHEN event_id % 50 = 0 THEN '〃' WHEN event_id % 11 <> 0 THEN props END AS t FROM events), m AS (SELECT *, count(*) OVER (PARTITION BY user_id, loc) AS n FROM p),
 d AS (SELECT user_id, 'locator_missing' AS defect FROM m WHERE loc IS NULL UNION ALL SELECT user_id, 'locator_repeated' FROM m WHERE n > 1 UNION ALL SELECT user_id, 'ditto_left' FROM m WHERE t = '〃' UNION ALL SELECT user_id, 'text_missing' FROM m WHERE coalesce(trim(t), '') = '')
 SELECT user_id, defect, count(*) AS n FROM d GROUP BY 1, 2""",
    "review_fill_rate": "SELECT 'flag' AS field, round(avg(CASE WHEN l_returnflag <> 'N' THEN 1.0 ELSE 0.0 END), 3) AS fill_rate FROM lineitem UNION ALL SELECT 'discount', round(avg(CASE WHEN l_discount > 0 THEN 1.0 ELSE 0.0 END), 3) FROM lineitem UNION ALL SELECT 'status', round(avg(CASE WHEN l_linestatus <> '' THEN 1.0 ELSE 0.0 END), 3) FROM lineitem",
    "flatten_nested": "SELECT event_id, 'props.k' AS field, json_extract_string(props, '$.k') AS value FROM events",
}
