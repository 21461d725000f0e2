"""The skeleton of a layer: its tree read from configuration, planted once, and what follows from it.

A tree is nested: a dict from a name to its parts (a dict, a list of names, or nothing), one level a tier. `::v` below
a concept is its instance with axis value v; `@split` stands for an instance of every axis value and `@v` after a name
for one; {"@unordered": name} takes no part in the order of its level, and a level that begins with "@noflow" has none.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .state import checkpoint

#: Fixed: tiers by depth.
TIERS = ("main", "sub", "detail")
SCOPE = "::"
NODES = "canonical string, tier string, parent string, axis string, place int, ordered boolean"


class TreeError(ValueError):
    """The tree breaks the rules of its notation."""


def _level(parts) -> tuple[list, bool]:
    items = list(parts.items()) if isinstance(parts, dict) else [(p, None) for p in parts or ()]
    flow = not (items and items[0][0] == "@noflow")
    return items if flow else items[1:], flow


def _rows(parts, axis: list[str], depth: int, parent: str | None) -> Iterator[tuple]:
    items, flow = _level(parts)
    for place, (item, below) in enumerate(items):
        ordered = flow
        if isinstance(item, dict):
            if set(item) != {"@unordered"}:
                raise TreeError(f"an unknown marker in {item}")
            item, ordered = item["@unordered"], False
        if item.startswith(SCOPE):
            if parent is None or item[2:] not in axis:
                raise TreeError(f"{item} is no axis value of a concept")
            yield f"{parent}{item}", TIERS[min(depth, 2)], parent, item[2:], place, False
            continue
        name, _, marker = item.partition("@")
        name = name.strip()
        if marker and marker != "split" and marker not in axis:
            raise TreeError(f"an unknown marker @{marker}")
        if not name or name in axis:
            raise TreeError(f"{item!r} is no name")
        tier = TIERS[min(depth, 2)]
        canonical = f"{parent}{SCOPE}{name}" if tier == "detail" and parent else name
        yield canonical, tier, parent, None, place, ordered
        for value in axis if marker == "split" else [marker] * bool(marker):
            yield f"{canonical}{SCOPE}{value}", tier, canonical, value, place, False
        yield from _rows(below, axis, depth + 1, canonical)


def parse_tree(spark: SparkSession, tree: dict, axis: list[str]) -> DataFrame:
    """NODES of a tree (a configuration, which is small). One name for two nodes of tiers main and sub is an error."""
    rows = list(_rows(tree, axis, 0, None))
    names = [r[0] for r in rows]
    if len(set(names)) < len(names):
        raise TreeError("one name for two nodes: " + ", ".join(sorted({n for n in names if names.count(n) > 1})))
    return spark.createDataFrame(rows, NODES)


def tree_of(rows: DataFrame, axis: list[str]) -> tuple[DataFrame, DataFrame]:
    """NODES of a tree that is a table (node, parent, place, item, unordered), item in the notation above, one level after the other; and
    (node, reason) of rows that break it: marker, axis_value, no_name, and same_name for nodes of one name. These, and what
    lies below them, are no nodes."""
    item = F.trim("item")
    instance, name, marker = F.startswith(item, F.lit(SCOPE)), F.trim(F.split(item, "@")[0]), F.when(F.contains(item, F.lit("@")), F.substring_index(item, "@", -1))
    flow = rows.where(item == "@noflow").select(F.col("parent").alias("of")).distinct().withColumn("noflow", F.lit(True))
    own = rows.where(item != "@noflow").join(flow, F.col("parent").eqNullSafe(F.col("of")), "left")
    value = F.when(instance, F.substring(item, 3, 10**6))
    own = own.select("node", "parent", "place", value.alias("value"), F.when(~instance, name).alias("name"), F.when(~instance, marker).alias("marker"), (F.col("noflow").isNull() & ~F.coalesce("unordered", F.lit(False))).alias("ordered"))
    bad_value = F.col("value").isNotNull() & (~F.col("value").isin(*axis) | F.col("parent").isNull())
    bad_name = F.col("value").isNull() & ((F.coalesce("name", F.lit("")) == "") | F.col("name").isin(*axis))
    reason = F.when(bad_value, "axis_value").when(F.col("marker").isNotNull() & ~F.col("marker").isin("split", *axis), "marker").when(bad_name, "no_name")
    own = checkpoint(own.withColumn("reason", reason))
    defects, left = own.where("reason is not null").select("node", "reason"), own.where("reason is null").drop("reason")
    level, found, depth = left.where("parent is null").withColumn("above", F.lit(None).cast("string")), None, 0
    while not level.isEmpty():
        tier, scoped = TIERS[min(depth, 2)], F.concat("above", F.lit(SCOPE), F.coalesce("value", "name"))
        canonical = F.when(F.col("value").isNotNull() | F.lit(depth >= 2), scoped).otherwise(F.col("name"))
        level = checkpoint(level.withColumn("canonical", canonical).withColumn("tier", F.lit(tier)))
        found = level if found is None else found.union(level)
        level = left.join(level.where("value is null").select(F.col("node").alias("parent"), F.col("canonical").alias("above")), "parent").select(*left.columns, "above")
        depth += 1
    if found is None:
        return rows.sparkSession.createDataFrame([], NODES), defects
    concepts = found.select("node", "canonical", "tier", F.col("above").alias("parent"), F.col("value").alias("axis"), F.col("place").cast("int").alias("place"), (F.col("ordered") & F.col("value").isNull()).alias("ordered"))
    values = F.when(F.col("marker") == "split", F.array(*map(F.lit, axis))).otherwise(F.array("marker"))
    split = found.where("marker is not null").select("node", "canonical", "tier", "place", F.explode(values).alias("axis"))
    split = split.select("node", F.concat("canonical", F.lit(SCOPE), "axis"), "tier", "canonical", "axis", F.col("place").cast("int"), F.lit(False))
    every = checkpoint(concepts.union(split))
    twice = every.groupBy("canonical").agg(F.count("*").alias("n")).where("n > 1").select("canonical")
    same = every.join(twice, "canonical", "left_semi").select("node", F.lit("same_name").alias("reason")).distinct()
    return every.join(twice, "canonical", "left_anti").select("canonical", "tier", "parent", "axis", "place", "ordered"), defects.union(same)


def flat(names: DataFrame, name: str = "name") -> DataFrame:
    """NODES of a list of names, all of tier main and without order."""
    return names.select(F.col(name).alias("canonical"), F.lit("main").alias("tier"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("axis"), F.lit(0).alias("place"), F.lit(False).alias("ordered"))


def precedes(nodes: DataFrame) -> DataFrame:
    """(src, rel, dst): each participating sibling and the next one."""
    after = F.lead("canonical").over(Window.partitionBy("parent").orderBy("place"))
    return nodes.where("ordered and axis is null").select(F.col("canonical").alias("src"), F.lit("precedes").alias("rel"), after.alias("dst")).where("dst is not null")


def seed_mirrors(nodes: DataFrame, axis: list[str]) -> DataFrame:
    """(src, rel, dst): instances of a concept that has one of every axis value, each to each other."""
    own = nodes.where(F.col("axis").isin(*axis)).groupBy("parent").agg(F.collect_set("canonical").alias("all"), F.countDistinct("axis").alias("n")).where(F.col("n") == len(axis))
    ends = own.select(F.explode("all").alias("src"), "all")
    return ends.select("src", F.lit("mirrors").alias("rel"), F.explode("all").alias("dst")).where("src <> dst")


def aliases(nodes: DataFrame, extra: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(alias, canonical): last segments that one node only has, "axis name" of instances, and `extra` ones (alias,
    canonical); and the extra ones that stand for several nodes."""
    last = F.element_at(F.split("canonical", SCOPE), -1)
    short = nodes.where("axis is null").select(last.alias("alias"), "canonical")
    unique = short.groupBy("alias").agg(F.count("*").alias("n"), F.min("canonical").alias("canonical")).where("n = 1 and alias <> canonical").drop("n")
    named = nodes.where("axis is not null").select(F.concat_ws(" ", "axis", F.element_at(F.split("parent", SCOPE), -1)).alias("alias"), "canonical")
    single = named.groupBy("alias").agg(F.count("*").alias("n"), F.min("canonical").alias("canonical")).where("n = 1").drop("n")
    unclear = extra.groupBy("alias").agg(F.countDistinct("canonical").alias("n")).where("n > 1")
    return unique.union(single).union(extra.join(unclear, "alias", "left_anti").select("alias", "canonical")).distinct(), unclear


def plant(known: DataFrame, nodes: DataFrame, category: str) -> DataFrame:
    """Nodes (id, canonical, category, tier, status) after planting: one that is there by name and category keeps its id and
    becomes a seed; the others get one from their name. Planting again changes nothing."""
    own = nodes.select("canonical", F.lit(category).alias("category"), "tier").distinct()
    old = known.select("id", "canonical", "category")
    made = F.concat(F.lit("seed:"), F.substring(F.sha2(F.concat_ws("\x00", "category", "canonical"), 256), 1, 16))
    seeds = own.join(old, ["canonical", "category"], "left").select(F.coalesce("id", made).alias("id"), "canonical", "category", "tier", F.lit("seed").alias("status"))
    return known.join(seeds.select("canonical", "category"), ["canonical", "category"], "left_anti").select("id", "canonical", "category", "tier", "status").union(seeds)


def stale(known: DataFrame, nodes: DataFrame) -> DataFrame:
    """Seeds that the tree does not have any more."""
    return known.where("status = 'seed'").join(nodes.select("canonical").distinct(), "canonical", "left_anti")


def category_owner(declared: DataFrame) -> DataFrame:
    """(category, owner): the first layer, by name, that declares a category."""
    return declared.groupBy("category").agg(F.min("layer").alias("owner"))


def flow_lines(nodes: DataFrame) -> DataFrame:
    """(parent, line): the participating parts of a level in their order."""
    own = nodes.where("ordered and axis is null").groupBy("parent").agg(F.array_sort(F.collect_list(F.struct("place", F.element_at(F.split("canonical", SCOPE), -1).alias("name")))).alias("parts"))
    return own.select("parent", F.array_join(F.transform("parts", lambda x: x["name"]), " → ").alias("line"))
