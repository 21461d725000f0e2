"""Edges, the gate, evidence, and walks over the graph.

Frames: `edges` (src, rel, dst, ...), `nodes` as in resolve, evidence as rows (node or edge key, doc).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .state import checkpoint, stored, swept

EDGE = ["src", "rel", "dst"]


def upsert(known: DataFrame, new: DataFrame, deleted: DataFrame) -> DataFrame:
    """Edges (src, rel, dst, evidence): known and new ones, each once with the evidence of all; deleted keys do not come back."""
    live = new.join(deleted.select(*EDGE).distinct(), EDGE, "left_anti")
    return known.select(*EDGE, "doc").union(live.select(*EDGE, "doc")).groupBy(*EDGE).agg(F.countDistinct("doc").alias("evidence"))


def gate(edges: DataFrame, patterns: DataFrame) -> DataFrame:
    """edges (key, src_cat, rel, dst_cat, path) with a verdict, by declared patterns (src_cat, rel, dst_cat, symmetric)."""
    fwd = patterns.groupBy("src_cat", "rel", "dst_cat").agg(F.max("symmetric").alias("fwd"))
    back = fwd.where("not fwd").select(F.col("dst_cat").alias("src_cat"), "rel", F.col("src_cat").alias("dst_cat"), F.lit(True).alias("back"))
    declared = patterns.select("rel").distinct().withColumn("declared", F.lit(True))
    rows = edges.join(declared, "rel", "left").join(fwd, ["src_cat", "rel", "dst_cat"], "left").join(back, ["src_cat", "rel", "dst_cat"], "left")
    unsure = (F.col("path") == "extract") & (F.col("src_cat") == F.col("dst_cat")) & ~F.col("fwd")
    verdict = (
        F.when(F.col("src_cat").isNull() | F.col("dst_cat").isNull(), "unresolved_endpoint").when(F.col("declared").isNull(), "undeclared_relation")
        .when(F.col("fwd").isNotNull(), F.when(unsure, "direction_unverifiable").otherwise("commit"))
        .when(F.col("back"), "direction_conflict").otherwise("invalid_pattern")
    )
    return rows.withColumn("verdict", verdict).drop("declared", "fwd", "back")


def mirrors(members: DataFrame, scope: str, name: str, axis: str, values: list[str]) -> DataFrame:
    """(scope, name, seen, outcome): mirror where all axis values are there, mirror_asymmetry where some lack."""
    seen = members.where(F.col(axis).isin(values)).groupBy(scope, name).agg(F.array_join(F.array_sort(F.collect_set(axis)), ",").alias("seen"), F.countDistinct(axis).alias("n"))
    return seen.select(scope, name, "seen", F.when(F.col("n") == len(values), "mirror").otherwise("mirror_asymmetry").alias("outcome"))


def withdraw(evidence: DataFrame, docs: DataFrame, doc: str = "doc") -> DataFrame:
    """Evidence without that of the documents."""
    return evidence.join(docs.select(doc).distinct(), doc, "left_anti")


def without_evidence(items: DataFrame, evidence: DataFrame, keys: list[str]) -> DataFrame:
    return items.join(evidence.select(*keys).distinct(), keys, "left_anti")


def _followed(moved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What chains() tells, apart: (id, target, steps) of ids that come to an end, (id, circle, length, member) of those that don't.

    A round in which none comes to its end has seen all ends: some id of a longer chain would be between once and twice `reach`
    from its end. Then all that are left run into circles. If besides no least id got smaller, `reach` is no less than any
    circle's length; if as many ids as before are come to, they change places among themselves, so all are members."""
    kept, none = moved.where("into is not null").groupBy("id").agg(F.min("into").alias("to")), F.lit(None)
    kind = kept.schema["id"].dataType
    with swept(moved.sparkSession):
        first = stored(kept)
        goes = first.select(F.col("id").alias("to"), F.lit(True).alias("goes"))
        on = stored(first.join(goes, "to", "left").select("id", "to", F.when(F.col("goes").isNull(), 1).cast("bigint").alias("steps"), F.col("id").alias("low")))
        done, way = on.where("steps is not null").select("id", "to", "steps"), on.where("steps is null").select("id", "to", "low")
        reach, left, last = 1, way.count(), False
        while left and not last:
            there = done.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("steps").alias("more"), none.cast(kind).alias("least"))
            there = there.union(way.select(F.col("id").alias("to"), F.col("to").alias("next"), none.cast("bigint").alias("more"), F.col("low").alias("least")))
            on = way.join(there, "to").select("id", F.col("next").alias("to"), (F.col("more") + reach).alias("steps"), F.least("low", "least").alias("low"), (F.col("least") < F.col("low")).alias("fell"))
            on = stored(on)
            before, way = way, on.where("steps is null").select("id", "to", "low")
            done = done.union(on.where("steps is not null").select("id", "to", "steps"))
            now, fell = on.where("steps is null").agg(F.count("*"), F.max("fell")).first()
            last = left <= reach or now == left and not fell and before.select("to").distinct().count() == way.select("to").distinct().count()
            reach, left = 2 * reach, now
    # What is left has come to a member of its circle; such a member has seen all of it and nothing else.
    own = way.select(F.col("to").alias("id")).distinct().join(way.select("id", "low"), "id")
    size = own.groupBy("low").agg(F.count("*").alias("length"))
    circling = way.select("id", "to").join(own.select(F.col("id").alias("to"), "low"), "to").join(size, "low").join(own.select("id", F.lit(True).alias("member")), "id", "left")
    return done.select("id", F.col("to").alias("target"), "steps"), circling.select("id", F.col("low").alias("circle"), "length", F.coalesce("member", F.lit(False)).alias("member"))


def chains(moved: DataFrame) -> DataFrame:
    """(id, target, steps, circle, length, member) for moved (id, into): where a chain of any length ends and after how many steps;
    or, where it runs into a circle, the circle's least member, its length, and whether the id is a member (then target and
    steps are null). Of several `into` of an id the least counts. Pointers double: each round joins those still on their way, whose number falls, with where
    they have come to. An id that is `reach` steps or more from its end has as many ids between on their way as it is
    further, so once no more are on their way than `reach`, the next round has all ends, and what is left circles."""
    done, circling = _followed(moved)
    kind, none = done.schema["id"].dataType, F.lit(None)
    return done.select("id", "target", "steps", none.cast(kind).alias("circle"), none.cast("bigint").alias("length"), F.lit(False).alias("member")).union(
        circling.select("id", none.cast(kind), none.cast("bigint"), "circle", "length", "member")
    )


def redirects(moved: DataFrame) -> DataFrame:
    """(id, target) for moved (id, into): where the chain of each ends. In a circle it ends where it comes for the second time:
    at the id itself, or at the first member of the circle that it comes to (chain_defects names the circle)."""
    done, circling = _followed(moved)
    straight, circling = done.select("id", "target"), checkpoint(circling.select("id", "member"))
    if circling.isEmpty():
        return straight
    members = circling.where("member").select("id", F.col("id").alias("target"))
    tails = moved.join(circling.where("not member").select("id"), "id", "left_semi")
    return straight.union(members).union(_followed(tails)[0].select("id", "target"))


def chain_defects(moved: DataFrame) -> DataFrame:
    """(kind, key, length, ids) for each circle of moved (id, into): its least member, its length, and how many ids end in it."""
    rows = _followed(moved)[1].groupBy("circle", "length").agg(F.count("*").alias("ids"))
    return rows.select(F.lit("chain_circle").alias("kind"), F.col("circle").cast("string").alias("key"), "length", "ids")


def expand(seeds: DataFrame, edges: DataFrame, rules: list[tuple[str, str, bool]]) -> DataFrame:
    """(qid, node, level) that walks from seeds (qid, node) reach. A rule (relation, out | in | both, recursive) says how a
    relation is followed; only nodes that a recursive rule reached go on, until nothing new is reached."""
    steps = None
    for rel, direction, recursive in rules:
        own = edges.where(F.col("rel") == rel)
        for way, src, dst in (("out", "src", "dst"), ("in", "dst", "src")):
            if direction in (way, "both"):
                step = own.select(F.col(src).alias("node"), F.col(dst).alias("to"), F.lit(recursive).alias("on"))
                steps = step if steps is None else steps.union(step)
    return walk(seeds.select("qid", "node"), steps)


def walk(seeds: DataFrame, hops: DataFrame) -> DataFrame:
    """seeds (qid, node, and what else, such as a layer) and all that steps (node, to, on, and the same) reach from them, with the
    level. Each level is one join on the frontier, and a node that was seen does not come back, so circles end."""
    keys = seeds.columns
    same = [c for c in keys if c in hops.columns]
    hops = checkpoint(hops.select(*same, "to", F.col("on").alias("go")))
    seen = checkpoint(seeds.distinct().select(*keys, F.lit(0).alias("level"), F.lit(True).alias("on")))
    frontier = seen
    level = 0
    while True:
        level += 1
        reached = frontier.where("on").join(hops, same).drop("node").withColumnRenamed("to", "node").groupBy(*keys).agg(F.max("go").alias("on"))
        frontier = checkpoint(reached.join(seen.select(*keys), keys, "left_anti").select(*keys, F.lit(level).alias("level"), "on"))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen.select(*keys, "level")


def next_of(nodes: DataFrame, precedes: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(id, next, how, at): the next sibling of the nearest of a node and its ancestors that has one (`at`), or that sibling's
    instance of the node's axis value if there is one; of the `asked` nodes (id) only, if given. Each level is one join on the
    nodes that have found none yet."""
    own = nodes if asked is None else nodes.join(asked, "id", "left_semi")
    after = precedes.groupBy(F.col("src").alias("at")).agg(F.min("dst").alias("over"))
    above = nodes.where("parent is not null").select(F.col("id").alias("at"), "parent")
    frontier = seen = checkpoint(own.select("id", F.col("id").alias("at")))
    found = frontier.join(after, "at")
    while True:
        up = frontier.join(after, "at", "left_anti").join(above, "at").select("id", F.col("parent").alias("at"))
        frontier = checkpoint(up.join(seen, ["id", "at"], "left_anti"))
        if frontier.isEmpty():
            break
        seen, found = seen.union(frontier), found.union(frontier.join(after, "at"))
    instance = nodes.where("polarity <> 'none'").groupBy(F.col("parent").alias("over"), "polarity").agg(F.min("id").alias("same"))
    out = own.select("id", "polarity").join(found, "id", "left").join(instance, ["over", "polarity"], "left")
    how = F.when(F.col("at").isNull(), "none").when(F.col("at") == F.col("id"), "self").when(F.col("same").isNotNull(), "derived_instance").otherwise("derived_merge")
    return out.select("id", F.coalesce("same", "over").alias("next"), how.alias("how"), "at")


def hubs(edges: DataFrame, nodes: DataFrame, top: int = 3) -> DataFrame:
    """(layer, id, degree, rank): the nodes of each layer with the most edges, either way."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    rank = F.row_number().over(Window.partitionBy("layer").orderBy(F.desc("degree"), F.desc("id")))
    return ends.join(nodes.select("id", "layer"), "id").withColumn("rank", rank).where(F.col("rank") <= top).select("layer", "id", "degree", "rank")


def mirror_links(nodes: DataFrame, axis: list[str]) -> tuple[DataFrame, DataFrame]:
    """Edges (src, rel, dst) between a node and its mirror, both ways, and (scope, name, seen) of those that lack one. Nodes (id,
    canonical, category, parent, polarity, status) of the axis mirror each other where they have one name and one scope:
    their parent, or, where that is an instance of an axis value itself, its concept. Seeds have mirrors already."""
    concept = nodes.where(F.col("polarity").isin(*axis)).select(F.col("id").alias("parent"), F.col("parent").alias("lifted"))
    own = nodes.where(F.col("polarity").isin(*axis) & (F.col("status") != "seed")).join(concept, "parent", "left")
    own = own.withColumn("scope", F.coalesce("lifted", "parent", F.lit(""))).withColumn("name", F.element_at(F.split("canonical", "::"), -1))
    for value in axis:
        own = own.withColumn("name", F.when(F.startswith("name", F.lit(f"{value} ")), F.substring("name", len(value) + 2, 10**6)).otherwise(F.col("name")))
    first = own.groupBy("scope", "name", "category", "polarity").agg(F.min("id").alias("id"))
    sides = first.groupBy("scope", "name", "category").agg(F.map_from_entries(F.collect_list(F.struct("polarity", "id"))).alias("sides"))
    whole = sides.where(F.size("sides") == len(axis)).select(F.map_values("sides").alias("ids"))
    edges = whole.select(F.explode("ids").alias("src"), "ids").select("src", F.lit("mirrors").alias("rel"), F.explode("ids").alias("dst")).where("src <> dst")
    return edges, sides.where(F.size("sides") < len(axis)).select("scope", "name", F.array_join(F.array_sort(F.map_keys("sides")), ",").alias("seen"))


def lost(nodes: DataFrame, edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """Queue rows (kind, key): automatic nodes (id) and edges (src, rel, dst) that no evidence (item) is left for."""
    items = nodes.where("status = 'auto'").select(F.col("id").alias("item")).union(edges.where("status = 'auto'").select(F.concat_ws("|", *EDGE)))
    return items.join(evidence.select("item").distinct(), "item", "left_anti").select(F.lit("evidence_lost").alias("kind"), F.col("item").alias("key"))


def flow_chain(edges: DataFrame, nodes: DataFrame, rel: str) -> DataFrame:
    """(src, dst) of the relation between concepts: sources without an axis value."""
    concepts = nodes.where("polarity is null or polarity = 'none'").select(F.col("id").alias("src"))
    return edges.where(F.col("rel") == rel).join(concepts, "src", "left_semi").select("src", "dst")


def axis_mismatch(pieces: DataFrame, nodes: DataFrame, key: str, node: str, axis: str) -> DataFrame:
    """(key, node, axis, bound): pieces whose axis value is another than the one that their node is bound to."""
    bound = nodes.where("polarity not in ('none', 'unbound')").select(F.col("id").alias(node), F.col("polarity").alias("bound"))
    return pieces.where(F.col(axis).isNotNull()).join(bound, node).where(F.col(axis) != F.col("bound")).select(key, node, axis, "bound")
