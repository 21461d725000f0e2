"""Changes by people: rename, survivors and edges of a merge, the residual of a split, obsolete; each gives new frames,
none changes a frame in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import chains
from .resolve import SCOPE
from .state import checkpoint

#: Fixed: the order of statuses when a survivor is chosen.
RANK = {"seed": 3, "registered": 2, "auto": 1}


def rename(nodes: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes with names (id, new) applied, names that start with the old one and :: following (the longest renamed start
    counts), a `mirror_scope` column too if there is one; and what was refused, as (id, new): names that another live node of the
    category has, names that the same batch gives to several of a category, several names for a node, and nodes that are not
    live. Tombstones keep nothing from being renamed, and none of a batch depends on its order: all that contradict go."""
    gone = "merged_into" in nodes.columns
    alive = live(nodes) if gone else nodes
    asked = names.select("id", "new").distinct()
    own = asked.join(alive.select("id", "canonical", "category"), "id", "left")
    taken = alive.select(F.col("canonical").alias("new"), "category", F.col("id").alias("other"))
    refused = own.join(taken, ["new", "category"]).where("other <> id").select("id", "new")
    refused = refused.union(own.where("canonical is null").select("id", "new"))
    for key in (["category", "new"], ["id"]):
        many = own.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key)
        refused = refused.union(own.join(many, key, "left_semi").select("id", "new"))
    refused = refused.distinct()
    valid = own.join(refused, ["id", "new"], "left_anti")
    old = valid.select(F.col("canonical").alias("head"), "category", "new")
    parts = F.split("canonical", SCOPE)
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), SCOPE))
    starts = alive.select("id", "category", F.explode(heads).alias("head")).join(old, ["head", "category"])
    moved = nodes.join(starts.groupBy("id").agg(F.max_by(F.struct("head", "new"), F.length("head")).alias("by")), "id", "left")
    name = F.when(F.col("by").isNotNull(), F.concat("by.new", F.substring(F.col("canonical"), F.length("by.head") + 1, F.length("canonical")))).otherwise(F.col("canonical"))
    moved = moved.withColumn("canonical", name)
    if "mirror_scope" in nodes.columns:  # a scope is a name, of whatever category
        scope = valid.groupBy(F.col("canonical").alias("mirror_scope")).agg(F.min("new").alias("to"))
        moved = moved.join(scope, "mirror_scope", "left").withColumn("mirror_scope", F.coalesce("to", "mirror_scope"))
    return moved.select(*nodes.columns), refused


def survivors(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, survivor): the one that people chose (`override`, a column that pairs may have), else the higher status, then the
    smaller id. An override that is neither leaves no survivor."""
    rank = F.lit(0)
    for status, value in RANK.items():
        rank = F.when(F.col("status") == status, value).otherwise(rank)
    own = nodes.select("id", rank.alias("rank"))
    both = pairs.join(own.select(F.col("id").alias("a"), F.col("rank").alias("ra")), "a").join(own.select(F.col("id").alias("b"), F.col("rank").alias("rb")), "b")
    by_rank = F.when(F.col("ra") > F.col("rb"), F.col("a")).when(F.col("ra") < F.col("rb"), F.col("b")).otherwise(F.least("a", "b"))
    chosen = F.col("override") if "override" in pairs.columns else F.lit(None)
    return both.select("a", "b", F.when(chosen.isNull(), by_rank).when(chosen.isin(F.col("a"), F.col("b")), chosen).alias("survivor"))


def merge_edges(edges: DataFrame, redirect: DataFrame) -> DataFrame:
    """edges (src, rel, dst, doc) with ids replaced by redirect (id, target); loops go, equal edges share their evidence."""
    moved = edges
    for end in ("src", "dst"):
        moved = moved.join(redirect.select(F.col("id").alias(end), F.col("target").alias("to")), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    return moved.where("src <> dst").groupBy("src", "rel", "dst").agg(F.countDistinct("doc").alias("evidence"))


def split_residual(items: DataFrame, plan: DataFrame, keys: list[str]) -> DataFrame:
    """What a split's plan leaves unassigned; a split is only done if this is empty."""
    return items.select(*keys).distinct().join(plan.select(*keys).distinct(), keys, "left_anti")


def obsolete_refusals(nodes: DataFrame, gone: DataFrame) -> DataFrame:
    """(id, replaced_by, reason) of gone (id, replaced_by): a node or a target that is not there, itself, several targets for one
    node, and what would close a circle with what is replaced already and with the rest of gone: all of a batch's that lie on
    the circle, as their order does not count."""
    own = nodes.select("id", F.lit(True).alias("there"))
    asked = gone.select("id", "replaced_by").distinct()
    many = asked.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit(True).alias("several"))
    rows = asked.join(own, "id", "left").join(own.select(F.col("id").alias("replaced_by"), F.col("there").alias("target")), "replaced_by", "left").join(many, "id", "left")
    reason = F.when(F.col("there").isNull(), "missing").when(F.col("id").eqNullSafe(F.col("replaced_by")), "itself").when(F.col("replaced_by").isNotNull() & F.col("target").isNull(), "missing_target").when(F.col("several"), "several")
    rows = checkpoint(rows.withColumn("reason", reason).select("id", "replaced_by", "reason"))
    fresh = rows.where("reason is null and replaced_by is not null").select("id", F.col("replaced_by").alias("into"))
    before = nodes.where("replaced_by is not null").select("id", F.col("replaced_by").alias("into")) if "replaced_by" in nodes.columns else fresh.limit(0)
    after = before.join(rows.where("reason is null").select("id"), "id", "left_anti").union(fresh)
    circling = fresh.join(chains(after).where("member").select("id"), "id", "left_semi").select("id", F.col("into").alias("replaced_by"), F.lit("circle").alias("reason"))
    return rows.where("reason is not null").union(circling)


def obsolete(nodes: DataFrame, gone: DataFrame) -> DataFrame:
    """nodes with status and replaced_by for gone (id, replaced_by) but for what obsolete_refusals names."""
    refused = obsolete_refusals(nodes, gone).select("id").distinct()
    valid = gone.select("id", "replaced_by").distinct().join(refused, "id", "left_anti").select("id", F.col("replaced_by").alias("by"), F.lit("obsolete").alias("new"))
    out = nodes.join(valid, "id", "left")
    by = F.col("by") if "replaced_by" not in nodes.columns else F.when(F.col("new").isNotNull(), F.col("by")).otherwise(F.col("replaced_by"))
    return out.withColumn("replaced_by", by).withColumn("status", F.coalesce("new", "status")).drop("new", "by")


def merge_candidates(nodes: DataFrame, freq: DataFrame, block: list[str]) -> DataFrame:
    """(block, id, freq, place): the nodes of a block, most evidence first, then the higher status, then by name and id."""
    rank = F.lit(0)
    for status, value in RANK.items():
        rank = F.when(F.col("status") == status, value).otherwise(rank)
    rows = nodes.join(freq, "id", "left").select(*block, "id", "canonical", F.coalesce("freq", F.lit(0).cast("bigint")).alias("freq"), rank.alias("rank"))
    return ranked(rows, block, [F.desc("freq"), F.desc("rank"), F.asc("canonical"), F.asc("id")], "place").select(*block, "id", "freq", "place")


def ranked(df: DataFrame, block: list[str], order: list, out: str) -> DataFrame:
    """df with the place of each row, from 1, in its block. Rows are dealt to ranges of (block, order), ranked within each, and moved
    on by the rows of the block in the ranges before, so that no task holds a block."""
    rows = checkpoint(df.repartitionByRange(*block, *order).withColumn("range", F.spark_partition_id()))  # the ranges are sampled: once
    before = Window.partitionBy(*block).orderBy("range")
    count = rows.groupBy(*block, "range").agg(F.count("*").alias("n"))  # a row a block and range
    base = count.withColumn("base", F.sum("n").over(before) - F.col("n")).drop("n").withColumnRenamed("range", "r")
    same = F.col("range") == F.col("r")
    for b in block:
        base = base.withColumnRenamed(b, f"{b}_of")
        same = same & F.col(b).eqNullSafe(F.col(f"{b}_of"))
    own = rows.withColumn("turn", F.row_number().over(Window.partitionBy("range", *block).orderBy(*order)))
    return own.join(base, same).withColumn(out, (F.col("turn") + F.col("base")).cast("int")).select(*df.columns, out)


def live(nodes: DataFrame) -> DataFrame:
    """Nodes that no merge or split has put elsewhere; only these are targets of a change."""
    return nodes.where("merged_into is null")


def scope_children(nodes: DataFrame, parents: DataFrame, bound: list[str]) -> DataFrame:
    """(parent_id, id): live nodes of the bound categories whose name begins with a parent's (id, canonical) and ::."""
    parts = F.split("canonical", "::")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "::"))
    own = live(nodes).where(F.col("category").isin(*bound) & F.contains("canonical", F.lit("::")))
    return own.select("id", F.explode(heads).alias("head")).join(parents.select(F.col("id").alias("parent_id"), F.col("canonical").alias("head")), "head").select("parent_id", "id")


def old_names(nodes: DataFrame, renamed: DataFrame) -> DataFrame:
    """(surface, node_id, category, layer): names that a rename took from nodes, which stay as surfaces of the dictionary."""
    new = renamed.select("id", F.col("canonical").alias("new"))
    return nodes.join(new, "id").where("canonical <> new").select(F.col("canonical").alias("surface"), F.col("id").alias("node_id"), "category", "layer")


def preview(targets: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, edges, neighbours, children): what a change of the targets (id) would touch; nothing is written."""
    ends = edges.select(F.col("src").alias("id"), F.col("dst").alias("other")).union(edges.select("dst", "src"))
    touched = targets.select("id").join(ends, "id", "left").groupBy("id").agg(F.count("other").alias("edges"), F.countDistinct("other").alias("neighbours"))
    below = nodes.groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("children"))
    return touched.join(below, "id", "left").select("id", "edges", "neighbours", F.coalesce("children", F.lit(0)).alias("children"))


def redirect_dictionary(dictionary: DataFrame, redirect: DataFrame) -> DataFrame:
    """The dictionary with the ids of redirect (id, target) replaced; where there is no target the surface goes. Nothing twice."""
    moved = dictionary.join(redirect.select(F.col("id").alias("node_id"), "target", F.lit(True).alias("hit")), "node_id", "left").where("hit is null or target is not null")
    return moved.withColumn("node_id", F.coalesce("target", "node_id")).select(*dictionary.columns).distinct()


def merge_refusals(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(absorbed, survivor, reason): a node with itself, two seeds, a node that is merged already, one that another merge of
    these absorbs, or one that is not there."""
    own = nodes.select("id", "status", "merged_into")
    both = pairs
    for end in ("absorbed", "survivor"):
        both = both.join(own.select(F.col("id").alias(end), F.col("status").alias(f"{end}_status"), F.col("merged_into").alias(f"{end}_into")), end, "left")
    both = both.join(pairs.select(F.col("absorbed").alias("survivor"), F.lit(True).alias("moves")).distinct(), "survivor", "left")
    reason = (
        F.when(F.col("absorbed") == F.col("survivor"), "itself").when(F.col("absorbed_status").isNull() | F.col("survivor_status").isNull(), "missing")
        .when(F.col("absorbed_into").isNotNull() | F.col("survivor_into").isNotNull() | F.coalesce("moves", F.lit(False)), "chain")
        .when((F.col("absorbed_status") == "seed") & (F.col("survivor_status") == "seed"), "two_seeds")
    )
    return both.select("absorbed", "survivor", reason.alias("reason")).where("reason is not null")


def merge(pairs: DataFrame, nodes: DataFrame, dictionary: DataFrame, values: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """Merges of pairs (absorbed, survivor) that nothing refuses, as new frames: `nodes` with tombstones, `dictionary` with
    the absorbed names, `values` (node, attr, context, value, seq, doc) regrouped with the first value of each context and
    their `conflicts`, `edges` (src, rel, dst, doc) without loops, the `loops` that went, and what was `refused`."""
    from .resolve import attributes, conflicts

    refused = merge_refusals(pairs, nodes)
    valid = pairs.join(refused, ["absorbed", "survivor"], "left_anti")
    redirect = valid.groupBy(F.col("absorbed").alias("id")).agg(F.min("survivor").alias("target"))
    tombs = nodes.join(redirect, "id", "left")
    out = {"refused": refused, "nodes": tombs.withColumn("merged_into", F.coalesce("target", "merged_into")).withColumn("status", F.when(F.col("target").isNotNull(), "merged_into").otherwise(F.col("status"))).select(*nodes.columns)}
    names = nodes.join(redirect, "id").select(F.col("canonical").alias("surface"), F.col("target").alias("node_id"), "category", "layer")
    out["dictionary"] = redirect_dictionary(dictionary, redirect).union(names.select(*dictionary.columns)).distinct()
    moved = values.join(redirect.select(F.col("id").alias("node"), "target"), "node", "left").withColumn("node", F.coalesce("target", "node")).drop("target")
    keys = ["node", "attr", "context"]
    out["values"], out["conflicts"] = attributes(moved, keys, "value", ["seq"]), conflicts(moved, keys, "value", ["seq"])
    ends = edges
    for end in ("src", "dst"):
        ends = ends.join(redirect.select(F.col("id").alias(end), F.col("target").alias("to")), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    out["edges"] = ends.where("src <> dst").select("src", "rel", "dst", "doc").distinct()
    out["loops"] = ends.where("src = dst").select("src", "rel", "doc").distinct()
    return out


def split(node: str, plan: DataFrame, nodes: DataFrame, items: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """A node split by a plan (frame, item, target): each of its items, by frame the rows (item) of `items`, goes to a target.
    Where the plan leaves some out nothing is split, and `residual` (frame, item) says what. Else `nodes` has the targets with
    the node's other columns, and the node as a tombstone to its least target; `assigned` says where each item went."""
    every = None
    for frame, own in items.items():
        rows = own.select(F.lit(frame).alias("frame"), F.col("item").cast("string").alias("item"))
        every = rows if every is None else every.union(rows)
    every = every.distinct()
    residual = every.join(plan.select("frame", "item"), ["frame", "item"], "left_anti")
    if not residual.isEmpty():
        return {"residual": residual, "nodes": nodes, "assigned": plan.limit(0)}
    assigned = every.join(plan, ["frame", "item"])
    targets = assigned.select(F.col("target").alias("new")).distinct()
    copies = nodes.join(targets.withColumn("id", F.lit(node)), "id")
    copies = copies.withColumn("id", F.col("new")).withColumn("canonical", F.col("new")).withColumn("status", F.lit("auto")).select(*nodes.columns)
    first = targets.agg(F.min("new")).first()[0]
    own = F.col("id") == node
    tomb = nodes.withColumn("merged_into", F.when(own, F.lit(first)).otherwise(F.col("merged_into"))).withColumn("status", F.when(own, "merged_into").otherwise(F.col("status")))
    return {"residual": residual, "nodes": tomb.select(*nodes.columns).union(copies), "assigned": assigned}


def split_graph(plan: DataFrame, targets: DataFrame, nodes: DataFrame, dictionary: DataFrame, edges: DataFrame, values: DataFrame, evidence: DataFrame) -> dict[str, DataFrame]:
    """Splits of several nodes at once, item by item. targets are (node, target, canonical, ord); plan rows (node, frame, item, target) say
    where an item goes: `alias` a surface of the dictionary (surface, node_id, ...), `evidence` a doc of evidence (node, doc), `edge` an
    edge src|rel|dst that has the node as an end (edges: src, rel, dst, doc, status). An item may go to several targets.

    A node with an item that goes nowhere is refused as a whole; `residual` (node, frame, item) says what (a surface that is a target's
    name is its own). Else `nodes` has the targets, with what the node had, and the node as a tombstone to its first target; `edges` has
    the node's edges as deleted and those of the targets with all their evidence; `values` (node, ...) are copied to each target;
    `evidence` moves; `dictionary` has the targets' names and the surfaces that went to them in place of the node's."""
    own = targets.select("node").distinct()
    deal = plan.select("node", "frame", F.col("item").cast("string").alias("item"), "target").distinct()
    key = F.concat_ws("|", "src", "rel", "dst")
    ends = edges.where("status <> 'deleted_by_user'").select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("node"), key.alias("item")).distinct()
    items = ends.select("node", F.lit("edge").alias("frame"), "item").union(evidence.select("node", F.lit("evidence"), F.col("doc").cast("string"))).union(dictionary.select(F.col("node_id"), F.lit("alias"), "surface"))
    named = targets.select("node", F.lit("alias").alias("frame"), F.col("canonical").alias("item")).union(nodes.select(F.col("id"), F.lit("alias"), "canonical"))
    residual = checkpoint(items.distinct().join(own, "node", "left_semi").join(deal.select("node", "frame", "item").union(named), ["node", "frame", "item"], "left_anti"))
    whole = checkpoint(targets.join(residual.select("node"), "node", "left_anti"))
    deal = checkpoint(deal.join(whole.select("node", "target"), ["node", "target"], "left_semi"))
    first = whole.groupBy("node").agg(F.min_by("target", "ord").alias("into"))
    tombs = nodes.join(first.withColumnRenamed("node", "id"), "id", "left")
    tombs = tombs.withColumn("merged_into", F.coalesce("into", "merged_into")).withColumn("status", F.when(F.col("into").isNotNull(), "merged_into").otherwise(F.col("status"))).select(*nodes.columns)
    new = nodes.join(whole.select(F.col("node").alias("id"), "target", F.col("canonical").alias("name")), "id").withColumns({"id": F.col("target"), "canonical": F.col("name")}).select(*nodes.columns)
    moved = edges.withColumn("item", key)
    for end in ("src", "dst"):
        to = deal.where("frame = 'edge'").select(F.col("node").alias(end), "item", F.col("target").alias(f"{end}_to"))
        moved = moved.join(to, [end, "item"], "left")
    moved = checkpoint(moved)
    hit = F.col("src_to").isNotNull() | F.col("dst_to").isNotNull()
    fresh = moved.where(hit & (F.col("status") != "deleted_by_user")).select(F.coalesce("src_to", "src").alias("src"), "rel", F.coalesce("dst_to", "dst").alias("dst"), "doc", "status").distinct()
    old = moved.select(*edges.columns, hit.alias("hit")).distinct().withColumn("status", F.when(F.col("hit"), "deleted_by_user").otherwise(F.col("status"))).select(*edges.columns)
    gone = whole.select("node").distinct()
    copied = values.join(whole.select("node", "target"), "node", "left").withColumn("node", F.coalesce("target", "node")).select(*values.columns)
    seen = _dealt(evidence, "doc", deal.where("frame = 'evidence'"))
    words = _dealt(dictionary.withColumnRenamed("node_id", "node"), "surface", deal.where("frame = 'alias'")).withColumnRenamed("node", "node_id").select(*dictionary.columns)
    words = words.join(gone.withColumnRenamed("node", "node_id"), "node_id", "left_anti").select(*dictionary.columns)
    names = new.select(F.col("canonical").alias("surface"), F.col("id").alias("node_id"), *(c for c in dictionary.columns if c not in ("surface", "node_id")))
    return {"residual": residual, "nodes": tombs.union(new), "edges": old.union(fresh.select(*edges.columns)), "values": copied, "evidence": seen, "dictionary": words.union(names.select(*dictionary.columns)).distinct()}


def _dealt(rows: DataFrame, item: str, deal: DataFrame) -> DataFrame:
    """rows (node, item, ...) with the targets of the deal (node, item, target) in place of the node."""
    to = deal.select("node", F.col("item").alias("own"), "target")
    return rows.withColumn("own", F.col(item).cast("string")).join(to, ["node", "own"], "left").withColumn("node", F.coalesce("target", "node")).select(*rows.columns)


def delete_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """edges with status deleted_by_user for the keys (src, rel, dst) of gone; they stay, so that no later intake revives them."""
    hit = edges.join(gone.select("src", "rel", "dst").distinct().withColumn("hit", F.lit(True)), ["src", "rel", "dst"], "left")
    return hit.withColumn("status", F.when(F.col("hit"), "deleted_by_user").otherwise(F.col("status"))).select(*edges.columns)


def log_rows(targets: DataFrame, op: str, actor: str, reason: str) -> DataFrame:
    """(op, actor, target, reason, at) for the log of changes; a change without an actor is refused."""
    if not actor.strip():
        raise ValueError("a change needs an actor")
    return targets.select(F.lit(op).alias("op"), F.lit(actor).alias("actor"), F.col("id").alias("target"), F.lit(reason).alias("reason"), F.current_timestamp().alias("at"))
