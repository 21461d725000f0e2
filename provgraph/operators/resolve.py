"""From a piece's fields to nodes: anchors, coordinates, names, entities and attributes.

Frames: `dictionary` (surface, node_id, category), `nodes` (id, canonical, category, parent, polarity),
`closure` (node, ancestor, depth). Lookups are equi-joins; the planner broadcasts a side only below its size limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm
from .state import checkpoint
from .terms import contained

MATCH = 0.85
SCOPE = "::"
#: Scores of equal names (without spaces) and of names of which one holds the other.
EQUAL, HOLDS = 1.0, 0.95


def anchors(pieces: DataFrame, dictionary: DataFrame, key: str, surface: str, category: str) -> DataFrame:
    """(key, surface, hits, node_id, outcome): resolved for one hit of the category, orphan_anchor for none or several, nothing for a
    blank. Both sides are compared in their normal form; the surface is given back as it stands."""
    own = dictionary.where(F.col("category") == category).groupBy(norm("surface").alias("norm")).agg(F.countDistinct("node_id").alias("hits"), F.min("node_id").alias("one"))
    out = pieces.select(key, F.col(surface).alias("surface"), norm(surface).alias("norm")).where("norm <> ''").join(own, "norm", "left")
    hits = F.coalesce("hits", F.lit(0)).cast("bigint")
    return out.select(key, "surface", hits.alias("hits"), F.when(hits == 1, F.col("one")).alias("node_id"), F.when(hits == 1, "resolved").otherwise("orphan_anchor").alias("outcome"))


def descend(resolved: DataFrame, nodes: DataFrame, axis: str) -> DataFrame:
    """The instance of the anchor that has the axis value, where there is one."""
    instance = nodes.where("parent is not null and tier = 'detail'").select(F.col("parent").alias("node_id"), F.col("polarity").alias(axis), F.col("id").alias("instance"))
    return resolved.join(instance, ["node_id", axis], "left").withColumn("target", F.coalesce("instance", "node_id")).drop("instance")


def closure(nodes: DataFrame) -> DataFrame:
    """(node, ancestor, depth), each node its own at depth 0. What is known is joined with itself, so reach doubles with
    each round, until nothing is new; in a circle of parents a node's least depth counts."""
    known = nodes.select(F.col("id").alias("node"), F.col("id").alias("ancestor"), F.lit(0).alias("depth"))
    up = nodes.where("parent is not null and parent <> id").select(F.col("id").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).alias("depth"))
    known, count = checkpoint(known.union(up)), -1
    while (now := known.count()) > count:
        count = now
        further = known.where("depth > 0").select(F.col("node").alias("ancestor"), F.col("ancestor").alias("to"), F.col("depth").alias("more"))
        both = known.where("depth > 0").join(further, "ancestor").select("node", F.col("to").alias("ancestor"), (F.col("depth") + F.col("more")).alias("depth"))
        known = checkpoint(known.union(both).groupBy("node", "ancestor").agg(F.min("depth").alias("depth")))
    return known


def off_group(pieces: DataFrame, ancestors: DataFrame, node: str, group: str) -> DataFrame:
    """Pieces whose group resolved and is no ancestor of the node, nor the node itself."""
    known = ancestors.select(F.col("node").alias(node), F.col("ancestor").alias(group))
    return pieces.where(F.col(group).isNotNull() & F.col(node).isNotNull()).join(known, [node, group], "left_anti")


def bind_axis(surface: Column, axis: Column, bound: Column) -> Column:
    return F.when(bound & axis.isNotNull() & ~F.startswith(surface, F.concat(axis, F.lit(" "))), F.concat(axis, F.lit(" "), surface)).otherwise(surface)


def polarity(anchor: Column, axis: Column, bindable: Column) -> Column:
    """The anchor's own value, none if nothing is known, unbound for categories that bind no axis, else the axis value."""
    return F.when(anchor.isNotNull() & ~anchor.isin("none", "unbound"), anchor).when(~bindable, "unbound").when(axis.isNull(), "none").otherwise(axis)


def scope(parent: Column, surface: Column) -> Column:
    return F.when(parent.isNull() | F.contains(surface, F.lit(SCOPE)), surface).otherwise(F.concat(parent, F.lit(SCOPE), surface))


def entity_matches(found: DataFrame, known: DataFrame, key: str, block: tuple[str, ...] = ()) -> DataFrame:
    """(key, node_id, score) for found (key, surface) and known (node_id, canonical): 1.0 for equal names without spaces,
    0.95 where one holds the other; the best score, then the least node, wins; nothing below MATCH. `block` are columns
    of both (category, layer, polarity) that must be equal; scoped names only match scoped surfaces. Surfaces are
    matched once each, whatever number of keys has them, and each side is reduced to its best node before it is joined."""
    bare = lambda c: F.replace(F.col(c), F.lit(" "), F.lit(""))
    left = found.select(key, bare("surface").alias("s"), F.contains("surface", F.lit(SCOPE)).alias("scoped"), *block)
    right = known.select("node_id", bare("canonical").alias("c"), F.contains("canonical", F.lit(SCOPE)).alias("c_scoped"), *block)
    one = checkpoint(left.select("s", "scoped", *block).distinct())
    names = right.groupBy("c", "c_scoped", *block).agg(F.min("node_id").alias("node_id"))
    inside = contained(one.select("s", F.col("s").alias("t")).distinct(), "s", "t", names, "c")
    around = contained(names.select("c", F.col("c").alias("t")).distinct(), "c", "t", one, "s")
    score = F.when(F.col("s") == F.col("c"), -1.0).otherwise(-0.95)
    best = None
    for pairs in (inside.select("s", "c"), around.select("s", "c")):
        own = pairs.join(names, "c").join(one, ["s", *block]).where("scoped or not c_scoped")
        own = own.groupBy("s", "scoped", *block).agg(F.min(F.struct(score.alias("score"), "node_id")).alias("best"))
        best = own if best is None else best.union(own)
    best = best.groupBy("s", "scoped", *block).agg(F.min("best").alias("best"))
    out = left.join(best, ["s", "scoped", *block]).groupBy(key).agg(F.min("best").alias("best"))
    return out.select(key, "best.node_id", (-F.col("best.score")).alias("score")).where(F.col("score") >= MATCH)


def match_in_order(surfaces: DataFrame, known: DataFrame, block: tuple[str, ...], threshold: float = MATCH) -> DataFrame:
    """(norm, block, node_id, maker, score): what each surface is, when they come one after the other: the best of the nodes there are
    (score EQUAL, or HOLDS where one holds the other; then the earlier node), those before and those that earlier surfaces
    made; or, where no score reaches the threshold, a new node, which `maker` (the surface's own norm) stands for.

    surfaces are (norm, block, seq), a row each, known nodes (node_id, canonical, block, seq). A surface that is not scoped
    is compared with no scoped node. The pairs of related surfaces are a table, and surfaces are settled in rounds: what has an earlier
    related node is none; what has no earlier related surface that could still become one is one. So the result is that
    of going through them in order, however the rows are partitioned."""
    bare, scoped = lambda c: F.replace(norm(c), F.lit(" "), F.lit("")), lambda c: F.contains(c, F.lit(SCOPE))
    mine = checkpoint(surfaces.select("norm", *block, "seq", bare("norm").alias("b"), scoped("norm").alias("scoped")).where("b <> ''"))
    old = checkpoint(known.select("node_id", *block, F.col("seq").alias("old_seq"), bare("canonical").alias("o"), scoped("canonical").alias("o_scoped")).where("o <> ''"))
    ours, theirs = mine.select("b").distinct(), old.select("o").distinct()
    related = lambda left, l, right, r: contained(left.select(l, F.col(l).alias("text")), l, "text", right, r)  # noqa: E731, E741
    score = lambda a, b: F.when(F.col(a) == F.col(b), EQUAL).otherwise(HOLDS)
    to_old = related(ours, "b", theirs, "o").select("b", "o").union(related(theirs, "o", ours, "b").select("b", "o")).distinct()
    before = mine.join(to_old, "b").join(old, ["o", *block]).where("scoped or not o_scoped")
    first = checkpoint(before.groupBy("norm", *block).agg(F.min(F.struct((-score("b", "o")).alias("minus"), "old_seq", "node_id")).alias("best")).select("norm", *block, (-F.col("best.minus")).alias("old_score"), F.col("best.node_id").alias("node_id")))
    inner = ours.withColumnRenamed("b", "e")
    pairs = related(ours, "b", inner, "e")
    both = pairs.select("b", "e").union(pairs.select(F.col("e").alias("b"), F.col("b").alias("e"))).distinct()
    earlier = mine.select(F.col("norm").alias("by"), *block, F.col("seq").alias("by_seq"), F.col("b").alias("e"), F.col("scoped").alias("by_scoped"))
    links = mine.join(both, "b").join(earlier, ["e", *block]).where("(by_seq < seq or (by_seq = seq and by < norm)) and (scoped or not by_scoped)")
    links = checkpoint(links.select("norm", *block, "by", "by_seq", score("b", "e").alias("score")))
    strong = links.where(F.col("score") >= threshold).select("norm", *block, "by")
    settled = checkpoint(first.where(F.col("old_score") >= threshold).select("norm", *block, F.lit(False).alias("node")))
    while True:
        open_ = mine.select("norm", *block).join(settled, ["norm", *block], "left_anti")
        state = settled.select(F.col("norm").alias("by"), *block, "node")
        seen = open_.join(strong, ["norm", *block], "left").join(state, ["by", *block], "left")
        verdict = seen.groupBy("norm", *block).agg(F.max(F.coalesce("node", F.lit(False))).alias("taken"), F.max(F.col("by").isNotNull() & F.col("node").isNull()).alias("waits"))
        new = checkpoint(verdict.where("taken or not waits").select("norm", *block, (~F.col("taken")).alias("node")))
        if new.isEmpty():
            break
        settled = checkpoint(settled.union(new))
    makers = settled.where("node").select(F.col("norm").alias("by"), *block)
    own = links.join(makers, ["by", *block]).groupBy("norm", *block).agg(F.min(F.struct((-F.col("score")).alias("minus"), "by_seq", "by")).alias("made"))
    out = mine.select("norm", *block).join(settled, ["norm", *block]).join(first, ["norm", *block], "left").join(own, ["norm", *block], "left")
    made = -F.col("made.minus")
    best = F.greatest(F.coalesce("old_score", F.lit(0.0)), F.coalesce(made, F.lit(0.0)))
    to_old = F.coalesce(F.col("old_score") >= F.coalesce(made, F.lit(0.0)), F.lit(False))
    return out.select("norm", *block, F.when(~F.col("node") & to_old, F.col("node_id")).alias("node_id"), F.when(F.col("node"), F.col("norm")).when(~to_old, F.col("made.by")).alias("maker"), best.alias("score"))


def attributes(values: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """(keys, kept, n_values): the first value of each node, attribute and context, in the order of intake."""
    first = F.min(F.struct(*order, F.col(value).alias("__v")))
    return values.groupBy(*keys).agg(first.alias("f"), F.countDistinct(value).alias("n_values")).select(*keys, F.col("f.__v").alias("kept"), "n_values")


def conflicts(values: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """(keys, kept, other): every other value that disagrees with the first."""
    kept = attributes(values, keys, value, order).where("n_values > 1").select(*keys, "kept")
    return values.select(*keys, F.col(value).alias("other")).distinct().join(kept, keys).where(F.col("other") != F.col("kept")).select(*keys, "kept", "other")


def field_defects(pieces: DataFrame, key: str, fields: str, required: list[str], optional: list[str]) -> DataFrame:
    """(key, kind, field): fields that the schema lacks, and required ones that a piece lacks or leaves empty."""
    names = F.map_keys(F.map_filter(fields, lambda k, v: v.isNotNull() & (v != "")))
    unknown = F.transform(F.array_except(F.map_keys(fields), F.array(*map(F.lit, [*required, *optional]))), lambda f: F.struct(F.lit("unknown_field").alias("kind"), f.alias("field")))
    missing = F.transform(F.array_except(F.array(*map(F.lit, required)), names), lambda f: F.struct(F.lit("missing_field").alias("kind"), f.alias("field")))
    return pieces.select(key, F.inline(F.concat(unknown, missing)))


def override(outer: Column, inner: Column) -> Column:
    """Two maps as one; the inner one's values win."""
    keep = F.map_filter(F.coalesce(outer, F.expr("map()").cast("map<string,string>")), lambda k, v: ~F.array_contains(F.coalesce(F.map_keys(inner), F.array().cast("array<string>")), k))
    return F.map_concat(keep, F.coalesce(inner, F.expr("map()").cast("map<string,string>")))
