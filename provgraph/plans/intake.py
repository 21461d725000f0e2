"""Queries on sources, state, the stream, intake, extraction and the build of records and prose."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import build as B
from ..operators import graph as G
from ..operators import intake as I
from ..operators.state import shared_dir
from ..sources import contract as C
from ..sources import validate as V
from ..streaming.intake import intake
from . import world as W
from .world import SQL, read


def _folder(spark):
    return f"{shared_dir(spark)}/plans-{uuid.uuid4()}"


def _s(x):
    return F.col(x).cast("string")


def _contracts(spark, sf_dir):
    """A contract document a customer, a piece an order."""
    fields = F.create_map(F.lit("status"), "o_orderstatus", F.lit("day"), F.date_format("o_orderdate", "yyyy-MM-dd"))
    piece = F.struct(F.lit("table").alias("kind"), F.concat(F.lit("O"), _s("o_orderkey")).alias("locator"), F.col("o_orderpriority").alias("section"), F.lit(None).cast("string").alias("text"), fields.alias("fields"), F.create_map(F.lit("model"), "o_orderstatus").alias("context"), F.array().cast("array<string>").alias("image_refs"))
    by_key = lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)
    own = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("k"), piece.alias("p"))), by_key).alias("p"))
    return own.select(F.concat(F.lit("C"), _s("o_custkey")).alias("doc_id"), F.lit("orders").alias("doc_type"), F.lit("1").alias("revision"), F.lit("-").alias("path"), F.create_map(F.lit("site"), F.lit("a"), F.lit("model"), F.lit("x")).alias("context"), F.transform("p", lambda x: x["p"]).alias("pieces"))


def contract_round_trip(spark, sf_dir):
    back = C.read_contracts(spark, C.write_contracts(_contracts(spark, sf_dir), _folder(spark)), multi_line=False)
    return C.pieces(back).select("doc_id", "pos", "locator", "section", F.col("fields")["status"].alias("status"), F.col("fields")["day"].alias("day"), F.col("context")["site"].alias("site"), F.col("context")["model"].alias("model"))


def stream_intake(spark, sf_dir):
    """Documents, then some of them again with fewer pieces, as two files of a stream."""
    docs, folder = _contracts(spark, sf_dir), _folder(spark)
    again = docs.where("substring(doc_id, 2) % 3 = 0").withColumn("revision", F.lit("2")).withColumn("pieces", F.slice("pieces", 1, 2))
    for part in (docs, again):
        part.coalesce(1).write.mode("append").json(f"{folder}/in")
    return intake(spark, f"{folder}/in", f"{folder}/state", files_a_batch=1).groupBy("doc_id", "revision").agg(F.count("*").alias("n"), F.min("locator").alias("least"))


def stream_bucketed(spark, sf_dir):
    """Documents of revision 9, some again as 10 with fewer pieces, some of these without any, then older revisions, new
    documents and files that came before."""
    docs, folder = _contracts(spark, sf_dir).withColumn("revision", F.lit("9")), _folder(spark)
    k = F.substring("doc_id", 2, 10).cast("bigint")
    some = docs.where(k % 3 == 0).withColumn("revision", F.lit("10")).withColumn("pieces", F.when(k % 2 == 0, F.slice("pieces", 1, 2)).otherwise(F.slice("pieces", 1, 0)))
    old = docs.where(k % 2 == 0).withColumn("revision", F.lit("2")).withColumn("pieces", F.slice("pieces", 1, 1))
    new = docs.where(k % 5 == 0).withColumn("doc_id", F.concat(F.lit("X"), "doc_id")).withColumn("revision", F.lit("1"))
    for part in (docs, some, old, new, docs):
        part.coalesce(1).write.mode("append").json(f"{folder}/in")
    found = intake(spark, f"{folder}/in", f"{folder}/state", files_a_batch=1, buckets=8)
    return found.groupBy("doc_id", "revision").agg(F.count("*").alias("n"), F.min("locator").alias("least"), F.max("pos").alias("last"))


def contract_validate(spark, sf_dir):
    """A document a customer as JSON, of every twelve eleven with a defect each, some no JSON; what each has, or that it goes in."""
    k = F.col("o_custkey")
    turn = lambda n, v, other: F.when(k % 12 == n, v).otherwise(other)
    first = F.col("at") == 0
    body = F.struct(
        F.when(~((k % 12 == 6) & first), F.when(k % 12 == 10, "L").otherwise(F.concat(F.lit("L"), _s("at")))).alias("source_locator"), F.when((k % 12 == 7) & first, "r").alias("record_id"),
        F.when((k % 12 == 8) & first, " 〃 ").otherwise(F.col("o_orderstatus")).alias("status"), F.when((k % 12 != 9) | ~first, "words").alias("text"),
    )
    rows = read(spark, sf_dir, "orders").withColumn("at", F.explode(F.array(F.lit(0), F.lit(1)))).groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "at", body.alias("b")))).alias("b"))
    two = F.slice(F.transform("b", lambda x: x["b"]), 1, 2)
    prose = k % 12 == 9
    doc = F.struct(
        F.concat(F.lit("C"), _s("o_custkey")).alias("doc_id"), F.lit("t").alias("doc_type"), F.lit("p").alias("source_path"), F.when(k % 12 != 3, "1").alias("revision"), turn(4, "", F.lit("now")).alias("parsed_at"), F.lit("1").alias("parser_version"), F.lit("1").alias("adapter_version"),
        turn(0, "slides", turn(9, "prose", F.lit("table"))).alias("payload_kind"), F.when(~prose, F.when(k % 12 == 2, F.slice(two, 1, 0)).otherwise(two)).alias("records"), F.when(prose | (k % 12 == 1), two).alias("chunks"),
    )
    text = F.to_json(doc)
    context = F.concat(F.lit('{"context": '), F.when(k % 12 == 5, '"x"').otherwise('{"m": 1}'), F.lit(", "), F.substring(text, 2, 10**6))
    raw = rows.select("o_custkey", F.when(k % 37 == 0, F.substring(context, 1, 40)).otherwise(context).alias("value"))
    taken, queue = V.accept(V.documents(raw), "o_custkey")
    return queue.select(F.col("key").cast("bigint").alias("o_custkey"), "doc", "detail").union(taken.select("o_custkey", "doc_id", F.lit("accepted")))


def snapshot_latest(spark, sf_dir):
    nation, root = read(spark, sf_dir, "nation").select("n_nationkey", "n_name"), _folder(spark)
    for part in (nation, nation.where("n_nationkey % 2 = 0")):
        C.write_snapshot(part, root, "nation")
    none = C.read_snapshot(nation.limit(0), root, "absent")
    return C.read_snapshot(nation, root, "nation").unionByName(none)


def log_append(spark, sf_dir):
    """Questions that link to nothing, logged in two runs."""
    path, q = _folder(spark), W.questions(spark, sf_dir)
    for low, high in ((0, 699), (700, 10**12)):
        C.append_log(q.where(F.col("qid").between(low, high) & F.contains("q", F.lit("planet"))).select("qid", F.lit("miss").alias("kind")), path)
    return C.read_or(spark, path, spark.createDataFrame([], "qid long, kind string")).groupBy("kind").agg(F.count("*").alias("n"), F.min("qid").alias("least"))


def layer_open(spark, sf_dir):
    cross = F.col("rel") == "occurs_in"
    edges = W.edges(spark, sf_dir).withColumn("layer", F.when(cross, "quality").otherwise("process")).withColumn("status", F.when(cross & F.endswith("dst", F.lit("3")), "deleted_by_user").otherwise("auto"))
    nodes, live, gone = C.open_layer(W.nodes(spark, sf_dir), edges, "quality")
    return live.select("src", "rel", "dst", F.lit("live").alias("what")).union(gone.select("src", "rel", "dst", F.lit("tombstone"))).union(nodes.select("id", "canonical", "category", F.lit("node")))


def doc_catalogue(spark, sf_dir):
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    builtin = nation.select(F.col("n_name").alias("doc_type"), F.lit("1").alias("revision"))
    own = nation.where("n_nationkey % 3 = 0").select(F.col("n_name").alias("doc_type"), F.lit("2").alias("revision")).union(region.select("r_name", F.lit("1")))
    return C.catalogue(builtin, own)


def head_sample(spark, sf_dir):
    return C.head(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_linenumber", 3)


def _chunks(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select(F.concat_ws("-", F.lit("L"), _s("l_orderkey"), _s("l_linenumber")).alias("chunk_id"), F.col("l_orderkey").alias("doc"), _s("l_linenumber").alias("locator"))


def doc_locators(spark, sf_dir):
    envelopes = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), F.when(F.col("o_orderstatus") != "P", F.lit("head")).alias("locator"))
    return I.doc_locators(envelopes, _chunks(spark, sf_dir))


def _queue(spark, sf_dir):
    k = F.col("o_orderkey")
    kind = F.when(k % 4 == 0, "auto_node").when(k % 4 == 1, "spec_conflict").when(k % 4 == 2, "evidence_lost").otherwise("orphan_anchor")
    return read(spark, sf_dir, "orders").select(kind.alias("kind"), k.alias("doc"), F.col("o_orderpriority").alias("key"), F.lit("-").alias("detail"))


def reingest_withdraw(spark, sf_dir):
    """What is left of each frame after the intake of some orders was withdrawn."""
    docs = read(spark, sf_dir, "orders").where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("doc"))
    evidence = W.has_property(spark, sf_dir).select(F.concat_ws("|", "src", "dst").alias("item"), "doc")
    values = evidence.select("item").distinct()
    queue, chunks, kept, left = I.withdraw(docs, _queue(spark, sf_dir), _chunks(spark, sf_dir), evidence, values)
    rows = queue.groupBy(F.concat(F.lit("queue:"), "kind").alias("frame")).agg(F.count("*").alias("n"))
    for name, frame in (("chunks", chunks), ("evidence", kept), ("values", left)):
        rows = rows.union(frame.groupBy(F.lit(name)).agg(F.count("*")))
    return rows


def doc_upsert(spark, sf_dir):
    k = F.col("o_orderkey")
    docs = read(spark, sf_dir, "orders").select(k.alias("doc"), F.md5("o_orderpriority").alias("doc_hash"), _s("o_orderdate").alias("first_ingested_at"), _s("o_orderdate").alias("ingested_at"))
    new = read(spark, sf_dir, "orders").select((k + F.when(k % 3 == 0, 1000000).otherwise(0)).alias("doc"), F.md5("o_orderstatus").alias("doc_hash"), F.lit("later").alias("ingested_at")).where("doc % 2 = 0")
    return I.upsert_docs(docs, new)


def queue_enqueue(spark, sf_dir):
    new = _queue(spark, sf_dir).withColumn("detail", F.lit("new")).withColumn("doc", F.when(F.col("doc") % 3 != 0, F.col("doc")))
    return I.enqueue(_queue(spark, sf_dir), new).groupBy("kind", "detail").agg(F.count("*").alias("n"), F.count("doc").alias("with_doc"))


def queue_self_heal(spark, sf_dir):
    fresh = read(spark, sf_dir, "nation").select(F.lit("evidence_lost").alias("kind"), F.lit(None).cast("long").alias("doc"), F.col("n_name").alias("key"), F.lit("now").alias("detail"))
    return I.self_heal(_queue(spark, sf_dir), fresh).groupBy("kind", "detail").agg(F.count("*").alias("n"))


def shape_defects(spark, sf_dir):
    k = F.col("event_id")
    body = F.concat(F.lit('{"name": '), F.when(k % 3 == 0, '{"x": 1}').when(k % 3 == 1, "[1]").otherwise('"n"'), F.lit(', "context": '), F.when(k % 2 == 0, '"m"').otherwise('{"m": "1"}'), F.lit("}"))
    return I.shape_defects(read(spark, sf_dir, "events").select("event_id", body.alias("body")), "event_id", "body", ["name", "code"], "context")


def ulid_orders(spark, sf_dir):
    id_ = I.ulid(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) * 1000, F.col("o_orderkey"))
    return read(spark, sf_dir, "orders").select("o_orderkey", id_.alias("id")).withColumn("valid", I.is_ulid(F.col("id")))


def _said(spark, sf_dir):
    """Lines of prose: what parts cause, need, or neither."""
    k = F.col("p_partkey")
    text = F.when(k % 3 == 0, F.concat(F.lit("the "), "p_name", F.lit(" causes "), "p_type")).when(k % 3 == 1, F.concat("p_name", F.lit(" needs "), "p_brand", F.lit(" and causes harm"))).otherwise(F.col("p_name"))
    return read(spark, sf_dir, "part").select(F.concat(F.lit("D"), (k % 7).cast("string")).alias("doc"), _s("p_partkey").alias("locator"), k.alias("pos"), text.alias("text"))


PATTERNS = [("needs", r"^(.+) needs (\S+)"), ("causes", r"^the (.+) causes (.+)$")]


def extract_rules(spark, sf_dir):
    lines = _said(spark, sf_dir)
    hints = lines.where("pos % 10 = 0").select("doc", "locator", F.lit("a").alias("src"), F.lit("told").alias("rel"), F.lit("b").alias("dst"))
    return I.extract(lines, hints, PATTERNS).select("doc", "locator", "src", "rel", "dst", "how")


def extract_pending(spark, sf_dir):
    """Lines without a checkpoint that still holds: the content of one document has changed."""
    lines = _said(spark, sf_dir).select("doc", "locator")
    done = lines.where("locator % 2 = 0").withColumn("doc_hash", F.md5("doc"))
    hashes = lines.select("doc", F.when(F.col("doc") == "D3", "new").otherwise(F.md5("doc")).alias("doc_hash")).distinct()
    return I.pending(lines, done, hashes)[0]


def _records(spark, sf_dir):
    k = F.col("s_suppkey")
    nation = F.concat(F.lit("NATION_"), _s("s_nationkey"))
    fields = F.create_map(F.lit("name"), F.concat(F.lit(" "), "s_name"), F.lit("site"), F.when(k % 4 == 0, F.concat(F.lit("new  "), nation)).otherwise(nation), F.lit("odd"), F.when(k % 9 == 0, F.lit("x")), F.lit("note"), F.lit("n"), F.lit("page"), F.lit("p"), F.lit("where"), F.lit("w"))
    return read(spark, sf_dir, "supplier").select(F.concat(F.lit("D"), (k % 5).cast("string")).alias("doc"), k.alias("piece"), fields.alias("fields"))


def _schema(spark):
    return spark.createDataFrame([("name", "entity", "Unit", None, "site", "part_of"), ("site", "entity", "Process", None, None, None), ("odd", "entity", "Ghost", None, None, None), ("note", "remark", None, None, None, None), ("page", "meta", None, None, None, None), ("where", "locator", None, None, None, None)], "field string, role string, category string, rel string, attach_to string, attach_rel string")


def _resolved(spark, sf_dir):
    rows, _ = B.by_role(_records(spark, sf_dir), _schema(spark).select("field", "role", "category", "rel"))
    mentions = rows.where("role = 'entity'").select("doc", "piece", F.col("piece").alias("pos"), "field", F.col("value").alias("surface"), "category", F.lit("process").alias("layer"), F.when(F.col("field") == "name", "supplier").otherwise("none").alias("polarity"))
    own = W.nodes(spark, sf_dir).select(F.col("canonical").alias("surface"), F.col("id").alias("node_id"), "category", "layer", "polarity")
    return B.resolve(mentions, own.where("category = 'Process' or surface like '%2'"), ["Unit", "Process"]), own


def build_roles(spark, sf_dir):
    rows, invalid = B.by_role(_records(spark, sf_dir), _schema(spark).select("field", "role", "category", "rel"))
    return rows.groupBy("field", "role").agg(F.count("*").alias("n")).union(invalid.select("field", "role", F.lit(-1).cast("long")))


def build_records(spark, sf_dir):
    (resolved, _, _), _ = _resolved(spark, sf_dir)
    return resolved.select("piece", "field", F.when(F.startswith("node_id", F.lit("auto:")), "new").otherwise(F.col("node_id")).alias("node_id"))


def build_new_nodes(spark, sf_dir):
    return _resolved(spark, sf_dir)[0][1].select("canonical", "category", "layer", "polarity", "status")


def build_queue(spark, sf_dir):
    return _resolved(spark, sf_dir)[0][2].groupBy("kind").agg(F.count("*").alias("n"), F.min("doc").alias("least_doc"))


def build_dictionary(spark, sf_dir):
    (resolved, _, _), own = _resolved(spark, sf_dir)
    return B.register_surfaces(own, resolved).groupBy("category").agg(F.count("*").alias("n"))


def build_edges(spark, sf_dir):
    (resolved, _, _), _ = _resolved(spark, sf_dir)
    declared = spark.createDataFrame([("name", "sited", "site"), ("@process_ref", "leads", "name")], "src_field string, rel string, dst_field string")
    refs = _records(spark, sf_dir).where("piece % 2 = 0").select("doc", "piece", F.lit("R0").alias("node_id"))
    return B.record_edges(resolved, declared, refs).groupBy("rel", "doc").agg(F.count("*").alias("n"))


def build_attachments(spark, sf_dir):
    (resolved, _, _), _ = _resolved(spark, sf_dir)
    schema = _schema(spark).select("field", "attach_to", F.col("attach_rel").alias("rel"))
    return B.attachments(resolved, schema).groupBy("rel").agg(F.count("*").alias("n"), F.countDistinct("piece").alias("pieces"))


def build_describes(spark, sf_dir):
    (resolved, _, _), _ = _resolved(spark, sf_dir)
    chunks = _records(spark, sf_dir).select("doc", _s("piece").alias("locator"), F.concat(F.lit("K"), _s("piece")).alias("chunk_id"))
    return B.describes(resolved.where("field = 'site'").withColumn("locator", _s("piece")), chunks).groupBy("chunk_id").agg(F.count("*").alias("n"))


def _prose(spark, sf_dir):
    k = F.col("s_suppkey")
    own = read(spark, sf_dir, "supplier")
    doc = F.concat(F.lit("D"), (k % 5).cast("string")).alias("doc")
    resolved = own.select(doc, k.alias("pos"), F.concat(F.lit("it "), (k % 3).cast("string")).alias("surface"), F.concat(F.lit("S"), _s("s_suppkey")).alias("node_id"))
    relations = own.select(doc, k.alias("pos"), F.concat(F.lit("it  "), (k % 4).cast("string")).alias("src_surface"), F.lit("near").alias("rel"), F.concat(F.lit("NATION_"), (k % 30).cast("string")).alias("dst_surface"))
    return B.prose_edges(relations, resolved, W.dictionary(spark, sf_dir))


def build_prose(spark, sf_dir):
    return _prose(spark, sf_dir)[0]


def build_prose_defects(spark, sf_dir):
    return _prose(spark, sf_dir)[1].select("doc", "pos")


def build_pair_relation(spark, sf_dir):
    pairs = read(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), _s("s_suppkey")).alias("src"), F.lit("Unit").alias("src_cat"), F.concat(F.lit("N"), _s("s_nationkey")).alias("dst"), F.when(F.col("s_suppkey") % 2 == 0, "Process").otherwise("Property").alias("dst_cat"), F.lit("D").alias("doc"))
    return B.pair_relation(pairs, spark.createDataFrame([("Unit", "Process", "part_of"), ("Failure", "Process", "occurs_in")], "src_cat string, dst_cat string, rel string"))


def gate_route(spark, sf_dir):
    """Committed edges, queue rows and rejects of evidence from orders, some of it the wrong way round."""
    turn = F.col("doc") % 3 == 0
    rows = W.occurs_in(spark, sf_dir).select(F.when(turn, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(F.col("doc") % 7 == 0, "owns").otherwise(F.col("rel")).alias("rel"), F.when(turn, F.col("src")).otherwise(F.col("dst")).alias("dst"), "doc", F.when(turn, "Process").otherwise("Failure").alias("src_cat"), F.when(turn, "Failure").otherwise("Process").alias("dst_cat"), F.lit("schema").alias("path"))
    patterns = spark.createDataFrame(W.PATTERNS, "src_cat string, rel string, dst_cat string, symmetric boolean")
    committed, queue, rejected = B.route(G.gate(rows, patterns.union(patterns)))
    out = committed.select(F.lit("committed").alias("what"), F.size("docs").cast("long").alias("size"))
    out = out.union(queue.select("kind", F.lit(1).cast("long"))).union(rejected.select("verdict", "n"))
    return out.groupBy("what").agg(F.sum("size").alias("n"), F.count("*").alias("rows"))


QUERIES = {f.__name__: f for f in (contract_round_trip, stream_intake, stream_bucketed, contract_validate, snapshot_latest, log_append, layer_open, doc_catalogue, head_sample, doc_locators, reingest_withdraw, doc_upsert, queue_enqueue, queue_self_heal, shape_defects, ulid_orders, extract_rules, extract_pending, build_roles, build_records, build_new_nodes, build_queue, build_dictionary, build_edges, build_attachments, build_describes, build_prose, build_prose_defects, build_pair_relation, gate_route)}

_PIECES = "SELECT 'C' || o_custkey AS doc_id, o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS pos, 'O' || o_orderkey AS locator, o_orderpriority AS section, o_orderstatus AS status, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders"
_QUEUE = "SELECT CASE o_orderkey % 4 WHEN 0 THEN 'auto_node' WHEN 1 THEN 'spec_conflict' WHEN 2 THEN 'evidence_lost' ELSE 'orphan_anchor' END AS kind, o_orderkey AS doc, o_orderpriority AS key FROM orders"
_MENTIONS = """, mention AS (SELECT s_suppkey AS piece, 'D' || s_suppkey % 5 AS doc, 'name' AS field, s_name AS norm, 'Unit' AS category FROM supplier
 UNION ALL SELECT s_suppkey, 'D' || s_suppkey % 5, 'site', CASE WHEN s_suppkey % 4 = 0 THEN 'new ' ELSE '' END || 'NATION_' || s_nationkey, 'Process' FROM supplier),
 done AS (SELECT m.*, n.id FROM mention m LEFT JOIN nodes n ON n.canonical = m.norm AND n.category = m.category AND n.polarity = CASE WHEN field = 'name' THEN 'supplier' ELSE 'none' END AND (n.category = 'Process' OR n.canonical LIKE '%2')) """
_BASE32 = "translate(lpad(to_base({n}, 32), {d}, '0'), 'ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHJKMNPQRSTVWXYZ')"
_ULID = " || ".join([_BASE32.format(n="CAST(epoch(o_orderdate) AS BIGINT) * 1000", d=10), *(_BASE32.format(n=f"CAST('0x' || substr(sha256(CAST(o_orderkey AS VARCHAR)), {i}, 10) AS BIGINT)", d=8) for i in (1, 11))])
_SAID = "SELECT 'D' || p_partkey % 7 AS doc, CAST(p_partkey AS VARCHAR) AS locator, p_partkey AS pos, p_name, p_type, p_brand FROM part"

ORACLE_SQL = {
    "contract_round_trip": f"SELECT doc_id, pos, locator, section, status, day, 'a' AS site, status AS model FROM ({_PIECES})",
    "stream_intake": f"SELECT doc_id, CASE WHEN o_custkey % 3 = 0 THEN '2' ELSE '1' END AS revision, count(*) AS n, min(locator) AS least FROM ({_PIECES}) WHERE o_custkey % 3 <> 0 OR pos < 2 GROUP BY 1, 2",
    "stream_bucketed": f"SELECT doc_id, CASE WHEN o_custkey % 3 = 0 THEN '10' ELSE '9' END AS revision, count(*) AS n, min(locator) AS least, max(pos) AS last FROM ({_PIECES}) WHERE o_custkey % 3 <> 0 OR (o_custkey % 2 = 0 AND pos < 2) GROUP BY 1, 2 UNION ALL SELECT 'X' || doc_id, '1', count(*), min(locator), max(pos) FROM ({_PIECES}) WHERE o_custkey % 5 = 0 GROUP BY 1",
    "contract_validate": """SELECT k AS o_custkey, CASE WHEN k % 37 <> 0 THEN 'C' || k END AS doc, CASE WHEN k % 37 = 0 THEN 'unreadable' ELSE CASE k % 12 WHEN 0 THEN 'payload_kind' WHEN 1 THEN 'body_of_other_kind' WHEN 2 THEN 'body_empty' WHEN 3 THEN 'missing:revision' WHEN 4 THEN 'missing:parsed_at' WHEN 5 THEN 'context_type'
 WHEN 6 THEN 'locator_missing' WHEN 7 THEN 'id_given' WHEN 8 THEN 'ditto_left' WHEN 9 THEN 'text_missing' WHEN 10 THEN 'locator_repeated' ELSE 'accepted' END END AS detail FROM (SELECT DISTINCT o_custkey AS k FROM orders)""",
    "snapshot_latest": "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 2 = 0",
    "log_append": SQL + "SELECT 'miss' AS kind, count(*) AS n, min(qid) AS least FROM questions WHERE contains(q, 'planet')",
    "layer_open": SQL + "SELECT src, rel, dst, CASE WHEN suffix(dst, '3') THEN 'tombstone' ELSE 'live' END AS what FROM edges WHERE rel = 'occurs_in' UNION ALL SELECT id, canonical, category, 'node' FROM nodes WHERE layer = 'quality'",
    "doc_catalogue": "SELECT n_name AS doc_type, CASE WHEN n_nationkey % 3 = 0 THEN '2' ELSE '1' END AS revision, CASE WHEN n_nationkey % 3 = 0 THEN 'registered' ELSE 'builtin' END AS origin FROM nation UNION ALL SELECT r_name, '1', 'registered' FROM region",
    "head_sample": "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_linenumber <= 3",
    "doc_locators": "SELECT DISTINCT l_orderkey AS doc, CAST(l_linenumber AS VARCHAR) AS locator FROM lineitem UNION SELECT o_orderkey, 'head' FROM orders WHERE o_orderstatus <> 'P'",
    "reingest_withdraw": SQL + f"SELECT 'queue:' || kind AS frame, count(*) AS n FROM ({_QUEUE}) WHERE kind = 'auto_node' OR doc % 5 <> 0 GROUP BY 1 UNION ALL SELECT 'chunks', count(*) FROM lineitem WHERE l_orderkey % 5 <> 0 UNION ALL SELECT 'evidence', count(*) FROM has_property WHERE doc % 5 <> 0 UNION ALL SELECT 'values', count(*) FROM (SELECT DISTINCT src, dst FROM has_property WHERE doc % 5 <> 0)",
    "doc_upsert": """WITH d AS (SELECT o_orderkey AS doc, md5(o_orderpriority) AS h, CAST(o_orderdate AS VARCHAR) AS at FROM orders), n AS (SELECT * FROM (SELECT o_orderkey + CASE WHEN o_orderkey % 3 = 0 THEN 1000000 ELSE 0 END AS doc, md5(o_orderstatus) AS h FROM orders) WHERE doc % 2 = 0)
 SELECT coalesce(n.doc, d.doc) AS doc, coalesce(n.h, d.h) AS doc_hash, coalesce(d.at, 'later') AS first_ingested_at, CASE WHEN n.doc IS NOT NULL THEN 'later' ELSE d.at END AS ingested_at FROM d FULL JOIN n ON d.doc = n.doc""",
    "queue_enqueue": f"SELECT kind, '-' AS detail, count(*) AS n, count(doc) AS with_doc FROM ({_QUEUE}) GROUP BY 1 UNION ALL SELECT kind, 'new', count(*), 0 FROM (SELECT DISTINCT kind, key FROM ({_QUEUE}) WHERE doc % 3 = 0) GROUP BY 1",
    "queue_self_heal": f"SELECT kind, '-' AS detail, count(*) AS n FROM ({_QUEUE}) WHERE kind <> 'evidence_lost' GROUP BY 1 UNION ALL SELECT 'evidence_lost', 'now', count(*) FROM nation",
    "shape_defects": "SELECT event_id, 'missing_field' AS kind, 'name' AS field FROM events WHERE event_id % 3 < 2 UNION ALL SELECT event_id, 'missing_field', 'context' FROM events WHERE event_id % 2 = 0",
    "ulid_orders": f"SELECT o_orderkey, {_ULID} AS id, true AS valid FROM orders",
    "extract_rules": f"""SELECT doc, locator, CASE WHEN pos % 10 = 0 THEN 'a' WHEN pos % 3 < 2 THEN p_name END AS src, CASE WHEN pos % 10 = 0 THEN 'told' WHEN pos % 3 = 0 THEN 'causes' WHEN pos % 3 = 1 THEN 'needs' END AS rel,
 CASE WHEN pos % 10 = 0 THEN 'b' WHEN pos % 3 = 0 THEN p_type WHEN pos % 3 = 1 THEN string_split(p_brand, ' ')[1] END AS dst, CASE WHEN pos % 10 = 0 THEN 'hint' WHEN pos % 3 < 2 THEN 'rule' ELSE 'none' END AS how FROM ({_SAID})""",
    "extract_pending": f"SELECT doc, locator FROM ({_SAID}) WHERE pos % 2 = 1 OR doc = 'D3'",
    "build_roles": "SELECT field, 'entity' AS role, count(*) AS n FROM (SELECT unnest(['name', 'site']) AS field FROM supplier) GROUP BY 1 UNION ALL SELECT 'odd', 'entity', count(*) FROM supplier WHERE s_suppkey % 9 = 0 HAVING count(*) > 0 UNION ALL SELECT 'page', 'meta', count(*) FROM supplier UNION ALL SELECT * FROM (VALUES ('note', 'remark', -1), ('where', 'locator', -1)) t(field, role, n)",
    "build_records": SQL + _MENTIONS + "SELECT piece, field, coalesce(id, 'new') AS node_id FROM done",
    "build_new_nodes": SQL + _MENTIONS + "SELECT DISTINCT norm AS canonical, category, 'process' AS layer, CASE WHEN field = 'name' THEN 'supplier' ELSE 'none' END AS polarity, 'auto' AS status FROM done WHERE id IS NULL",
    "build_queue": SQL + _MENTIONS + "SELECT 'auto_node' AS kind, count(*) AS n, min(doc) AS least_doc FROM (SELECT norm, min(doc) AS doc FROM done WHERE id IS NULL GROUP BY 1) UNION ALL SELECT 'invalid_category', count(*), min(doc) FROM (SELECT DISTINCT 'D' || s_suppkey % 5 AS doc FROM supplier WHERE s_suppkey % 9 = 0) HAVING count(*) > 0",
    "build_dictionary": SQL + _MENTIONS + ", new AS (SELECT DISTINCT norm, category FROM done WHERE id IS NULL) SELECT category, CAST(sum(n) AS BIGINT) AS n FROM (SELECT category, count(*) AS n FROM nodes WHERE true GROUP BY 1 UNION ALL SELECT category, count(*) FROM new GROUP BY 1) GROUP BY 1",
    "build_edges": SQL + _MENTIONS + "SELECT rel, doc, count(*) AS n FROM (SELECT DISTINCT 'sited' AS rel, a.doc, coalesce(a.id, a.norm) AS s, coalesce(b.id, b.norm) AS d FROM done a JOIN done b ON a.piece = b.piece AND a.field = 'name' AND b.field = 'site' UNION ALL SELECT DISTINCT 'leads', doc, 'R0', norm FROM done WHERE field = 'name' AND piece % 2 = 0) GROUP BY 1, 2",
    "build_attachments": "SELECT 'part_of' AS rel, count(*) AS n, count(*) AS pieces FROM supplier",
    "build_describes": "SELECT 'K' || s_suppkey AS chunk_id, 1 AS n FROM supplier",
    "build_prose": """WITH own AS (SELECT 'D' || s_suppkey % 5 AS doc, s_suppkey % 3 AS k, max(s_suppkey) AS last FROM supplier GROUP BY 1, 2), near AS (SELECT 'D' || s_suppkey % 5 AS doc, s_suppkey % 4 AS k, s_suppkey % 30 AS d FROM supplier)
 SELECT DISTINCT 'S' || last AS src, 'near' AS rel, 'N' || d AS dst, doc FROM near JOIN own USING (doc, k) WHERE d < 25""",
    "build_prose_defects": "WITH own AS (SELECT DISTINCT 'D' || s_suppkey % 5 AS doc, s_suppkey % 3 AS k FROM supplier) SELECT 'D' || s_suppkey % 5 AS doc, s_suppkey AS pos FROM supplier s WHERE s_suppkey % 30 >= 25 OR NOT EXISTS (SELECT 1 FROM own WHERE own.doc = 'D' || s.s_suppkey % 5 AND own.k = s.s_suppkey % 4)",
    "build_pair_relation": "SELECT 'S' || s_suppkey AS src, 'part_of' AS rel, 'N' || s_nationkey AS dst, 'D' AS doc FROM supplier WHERE s_suppkey % 2 = 0",
    "gate_route": SQL + """, j AS (SELECT *, CASE WHEN doc % 7 = 0 THEN 'undeclared_relation' WHEN doc % 3 = 0 THEN 'direction_conflict' ELSE 'commit' END AS v FROM occurs_in)
 SELECT 'committed' AS what, count(*) AS n, count(DISTINCT (src, dst)) AS rows FROM j WHERE v = 'commit' UNION ALL SELECT v, count(*), count(*) FROM j WHERE v = 'direction_conflict' GROUP BY 1 UNION ALL SELECT v, count(*), 1 FROM j WHERE v = 'undeclared_relation' GROUP BY 1""",
}
