"""The graph as text: Cypher statements, CSV rows with lists, Mermaid lines; and their files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def literal(x: Column) -> Column:
    """A quoted Cypher string with backslashes, quotes and line ends escaped."""
    for a, b in (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.concat(F.lit("'"), x, F.lit("'"))


def cypher_nodes(nodes: DataFrame) -> DataFrame:
    more = F.when(F.col("polarity") != "none", F.concat(F.lit(", polarity: "), literal(F.col("polarity")))).otherwise("")
    return nodes.select(F.concat(F.lit("CREATE (:"), "category", F.lit(":Node {id: "), literal(F.col("id")), F.lit(", canonical: "), literal(F.col("canonical")), more, F.lit("})")).alias("line"))


def cypher_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.concat(F.lit("MATCH (a:Node {id: "), literal(F.col("src")), F.lit("}), (b:Node {id: "), literal(F.col("dst")), F.lit("}) CREATE (a)-[:"), "rel", F.lit("]->(b)")).alias("line"))


def live_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is exported: nodes that nothing absorbed, and edges that are not deleted and have both ends among them."""
    alive = nodes.where("merged_into is null")
    ids = alive.select("id")
    kept = edges.where("status <> 'deleted_by_user'").join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return alive, kept.select(*edges.columns)


def cypher_attributes(values: DataFrame) -> DataFrame:
    """A statement a node (node, attr, context map, value) that sets its attributes as one JSON string, in order."""
    items = F.array_sort(F.collect_list(F.struct("attr", F.to_json("context").alias("context"), F.col("value").cast("string").alias("value"))))
    own = values.groupBy("node").agg(F.to_json(items).alias("attrs"))
    return own.select(F.concat(F.lit("MATCH (a:Node {id: "), literal(F.col("node")), F.lit("}) SET a.attrs = "), literal(F.col("attrs"))).alias("line"))


def mermaid(precedes: DataFrame, nodes: DataFrame) -> DataFrame:
    last = F.element_at(F.split("canonical", "::"), -1)
    src, dst = (nodes.select(F.col("id").alias(e), last.alias(f"{e}_name"), F.col("polarity").alias(f"{e}_pol")) for e in ("src", "dst"))
    both = precedes.join(src, "src").join(dst, "dst").where("src_pol = 'none'")
    return both.select(F.concat(F.lit("  "), "src", F.lit("["), "src_name", F.lit("] --> "), "dst", F.lit("["), "dst_name", F.lit("]")).alias("line"))


def csv_rows(items: DataFrame, lists: list[str]) -> DataFrame:
    """Lists joined by ' | ', the rest as it is."""
    return items.select(*(F.array_join(c, " | ").alias(c) if c in lists else F.col(c) for c in items.columns))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("line").write.mode("overwrite").text(path)


def write_csv(items: DataFrame, path: str) -> None:
    """CSV files whose header begins with the byte order mark."""
    first = items.columns[0]
    items.withColumnRenamed(first, "﻿" + first).write.mode("overwrite").option("header", True).csv(path)
