"""The whole build of table records, many documents at once: coordinates, entities, attributes, contents and edges.

Records are (doc, piece, locator, ref, grp, axis, context, fields), schema rows (field, role, category, target_layer, attach_to, attr,
contextual). All fields go from wide to long in one pass; each row carries its role as a tag, and the record's own coordinate
and the nodes of its fields come to it within the record, after one shuffle by record. Surfaces that no dictionary has
are matched in order (`match_in_order`), so records of many documents are built together as if one came after another.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm
from .build import ROLES, route
from .graph import axis_mismatch, gate
from .resolve import MATCH, anchors, bind_axis, descend, match_in_order, off_group, polarity, scope
from .state import checkpoint

#: Fixed: what stands for a record's own coordinate among the ends of declared edges, and the category of coordinates.
PROCESS_REF, COORDINATE = "@process_ref", "Process"
RECORD, NAME = ["doc", "piece"], ["norm", "category", "layer", "polarity"]


@dataclass
class Layer:
    """What a layer declares: its name, the layer that owns each category, which categories take the axis value into their
    names, and which the name of their place; at which score a surface is a node that there is."""

    name: str
    owners: dict[str, str]
    axis: list[str] = field(default_factory=list)
    bound: list[str] = field(default_factory=list)
    scoped: list[str] = field(default_factory=list)
    threshold: float = MATCH


def _among(column: str, values: list[str]):
    return F.coalesce(F.col(column).isin(*values), F.lit(False)) if values else F.lit(False)


def long_rows(records: DataFrame, schema: DataFrame) -> DataFrame:
    """A row a field with a value: (doc, piece, place, field, value, role, ...); the coordinate and the group are fields too, at the places
    -1 and -2. Fields that the schema does not have are left out; a role that is none is kept as it is."""
    rows = records.select(*RECORD, "locator", "axis", F.map_entries("fields").alias("e"), F.struct(F.lit(PROCESS_REF).alias("key"), F.col("ref").alias("value")).alias("r"), F.struct(F.lit("@process_group").alias("key"), F.col("grp").alias("value")).alias("g"))
    rows = rows.select(*RECORD, "locator", "axis", F.explode(F.concat(F.array("r", "g"), F.col("e"))).alias("f")).select(*RECORD, "locator", "axis", F.col("f.key").alias("field"), F.col("f.value").alias("value"))
    known = schema.withColumn("own", F.lit(True))
    rows = rows.join(known, "field", "left").where(F.col("own") | F.startswith("field", F.lit("@"))).drop("own")
    at = F.startswith("field", F.lit("@"))
    return rows.where(norm("value") != "").withColumn("role", F.when(at, "anchor").otherwise(F.col("role"))).withColumn("category", F.when(at, COORDINATE).otherwise(F.col("category")))


def resolve_in_order(mentions: DataFrame, dictionary: DataFrame, nodes: DataFrame, layer: Layer) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(mentions with node_id, new nodes, queue rows) of mentions (doc, piece, field, canonical, category, layer, polarity, seq): the node that
    the dictionary (surface, node_id, category, layer, polarity) has for it (the least), else what matching in order finds or
    makes; new nodes are auto_node in the queue, or uncertain_match where something was like them, below the threshold."""
    own = F.lit(None).cast("string")
    for category, name in layer.owners.items():
        own = F.when(F.col("category") == category, F.lit(name)).otherwise(own)
    named = mentions.withColumn("norm", norm("canonical"))
    invalid = named.where(own.isNull()).select(F.lit("invalid_category").alias("kind"), "doc", F.concat_ws(":", F.coalesce("category", F.lit("")), "norm").alias("key")).distinct()
    known = dictionary.withColumn("norm", norm("surface")).groupBy(*NAME).agg(F.min("node_id").alias("old"))
    named = checkpoint(named.where(own.isNotNull()).join(known, NAME, "left"))
    fresh = named.where("old is null").groupBy(*NAME).agg(F.min("seq").alias("seq"), F.min("doc").alias("doc"))
    there = nodes.where("merged_into is null").select("node_id" if "node_id" in nodes.columns else F.col("id").alias("node_id"), "canonical", *NAME[1:], F.col("id").alias("seq"))
    found = match_in_order(fresh.select(*NAME, "seq"), there, tuple(NAME[1:]), layer.threshold)
    made = lambda c: F.concat(F.lit("auto:"), F.substring(F.sha2(F.concat_ws("\x00", c, *NAME[1:]), 256), 1, 16))
    found = checkpoint(found.withColumn("new", F.coalesce("node_id", made("maker"))).withColumn("fresh", F.col("maker").eqNullSafe(F.col("norm"))))
    out = named.join(found.select(*NAME, "new"), NAME, "left").withColumn("node_id", F.coalesce("old", "new")).drop("old", "new", "norm")
    firsts = found.where("fresh").join(fresh.select(*NAME, "doc"), NAME)
    new = firsts.select(F.col("new").alias("id"), F.col("norm").alias("canonical"), *NAME[1:], F.lit("auto").alias("status"))
    queue = firsts.select(F.when(F.col("score") > 0, "uncertain_match").otherwise("auto_node").alias("kind"), "doc", F.col("new").alias("key"))
    return out, new, queue.union(invalid)


def places(at: DataFrame, records: DataFrame, nodes: DataFrame, ancestors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc, piece, axis, ref, grp, parent, anchor) of the records whose coordinate resolved: its node, or this one's instance of the axis
    value; and queue rows for those whose group is no ancestor of it, or whose axis value is another than the node's. `at` are
    the anchors that resolved (doc, piece, field, node_id)."""
    ref = at.where(F.col("field") == PROCESS_REF).select(*RECORD, "node_id").join(records.select(*RECORD, "axis"), RECORD)
    ref = descend(ref, nodes, "axis").select(*RECORD, "axis", F.col("target").alias("ref"))
    grp = at.where("field = '@process_group'").select(*RECORD, F.col("node_id").alias("grp"))
    place = ref.join(grp, RECORD, "left").join(nodes.select(F.col("id").alias("ref"), F.col("canonical").alias("parent"), F.col("polarity").alias("anchor")), "ref")
    place = checkpoint(place.withColumn("rid", F.struct(*RECORD)))
    off = off_group(place, ancestors, "ref", "grp").select("rid", "ref").union(axis_mismatch(place, nodes, "rid", "ref", "axis").select("rid", "ref"))
    return place, off.select(F.lit("coord_mismatch").alias("kind"), F.col("rid.doc").alias("doc"), F.concat_ws("@", "ref", F.col("rid.piece").cast("string")).alias("key")).distinct()


def entity_names(rows: DataFrame, place: DataFrame, layer: Layer) -> DataFrame:
    """rows (doc, piece, axis, value, category, target_layer, ...) of entities with the surface, the canonical name, which carries the axis value
    and the place where the layer says so, the layer and the polarity."""
    rows = rows.join(place.select(*RECORD, "parent", "anchor"), RECORD, "left")
    scoped, bound = _among("category", layer.scoped), _among("category", layer.bound)
    axis = F.when(_among("axis", layer.axis), F.col("axis"))
    inherits = scoped & F.col("anchor").isNotNull() & ~F.col("anchor").isin("none", "unbound")
    surface = bind_axis(norm("value"), F.when(~inherits, axis), bound)
    canonical = F.when(scoped, scope(F.col("parent"), surface)).otherwise(surface)
    return rows.withColumns({"surface": norm("value"), "canonical": canonical, "layer": F.coalesce("target_layer", F.lit(layer.name)), "polarity": polarity(F.when(scoped, F.col("anchor")), axis, bound)})


def build(records: DataFrame, schema: DataFrame, declared: DataFrame, dictionary: DataFrame, nodes: DataFrame, ancestors: DataFrame, chunks: DataFrame, patterns: DataFrame, layer: Layer) -> dict[str, DataFrame]:
    """All that the records give: `nodes` (new ones), `resolved` (doc, piece, field, node_id), `surfaces` for the dictionary, `values` (node, attr,
    context, value, doc, locator), `describes` (chunk_id, node_id), `edges` that the gate lets in, `rejected` by verdict, `queue` (kind, doc, key)
    and `defects` (doc, field, role). declared are edges (src_field, rel, dst_field), nodes (id, canonical, category, layer, polarity, parent, tier,
    merged_into), ancestors (node, ancestor), chunks (chunk_id, doc, field, locator), patterns as for the gate."""
    rows = checkpoint(long_rows(records, schema).withColumn("rid", F.struct(*RECORD, "field")))
    roles = F.coalesce(F.col("role").isin(*ROLES), F.lit(False))
    defects = rows.where(~roles).select("doc", "field", "role").distinct()
    own = None
    for category in [COORDINATE, *(r[0] for r in schema.where("role = 'anchor'").select("category").distinct().collect() if r[0] and r[0] != COORDINATE)]:
        part = anchors(rows.where((F.col("role") == "anchor") & (F.col("category") == category)), dictionary, "rid", "value", category)
        own = part if own is None else own.union(part)
    own = checkpoint(own)
    queue = own.where("outcome = 'orphan_anchor' and rid.field <> '@process_group'").select(F.lit("orphan_anchor").alias("kind"), F.col("rid.doc").alias("doc"), F.col("surface").alias("key")).distinct()
    at = own.where("node_id is not null").select(*(F.col(f"rid.{c}").alias(c) for c in (*RECORD, "field")), "node_id")
    place, wrong = places(at, records, nodes, ancestors)
    queue = queue.union(wrong)
    names = entity_names(rows.where("role = 'entity'").withColumn("seq", F.struct(*RECORD, "field")), place, layer).select(*RECORD, "field", "surface", "canonical", "category", "layer", "polarity", "seq")
    resolved, new, more = resolve_in_order(names, dictionary, nodes, layer)
    resolved = checkpoint(resolved)
    queue = queue.union(more)
    # What each field of a record stands for, beside each of its other fields.
    ends = resolved.select(*RECORD, "field", "node_id").union(at.where(~F.startswith("field", F.lit("@")))).union(place.select(*RECORD, F.lit(PROCESS_REF), "ref"))
    ends = ends.groupBy(*RECORD).agg(F.map_from_entries(F.collect_list(F.struct("field", "node_id"))).alias("ends"))  # a row a field of one record
    beside = checkpoint(rows.where("role in ('attribute', 'content')").join(ends, RECORD).withColumn("node", F.col("ends")[F.col("attach_to")]).where("node is not null").join(records.select(*RECORD, "context"), RECORD))
    context = F.when(F.coalesce("contextual", F.lit(False)), F.col("context"))
    values = beside.where("role = 'attribute'").select("node", F.coalesce("attr", "field").alias("attr"), context.alias("context"), "value", "doc", "locator")
    describes = beside.where("role = 'content'").select("doc", "field", "locator", F.col("node").alias("node_id")).join(chunks, ["doc", "field", "locator"]).select("chunk_id", "node_id").distinct()
    pairs = records.select(*RECORD).join(ends, RECORD, "left").crossJoin(F.broadcast(declared))  # a row a declared edge of the schema
    pairs = pairs.select(F.col("ends")[F.col("src_field")].alias("src"), "rel", F.col("ends")[F.col("dst_field")].alias("dst"), "doc")
    category = nodes.select("id", "category").union(new.select("id", "category"))
    for end in ("src", "dst"):
        pairs = pairs.join(category.select(F.col("id").alias(end), F.col("category").alias(f"{end}_cat")), end, "left")
    edges, doubt, rejected = route(checkpoint(gate(pairs.withColumn("path", F.lit("schema")), patterns)))
    surfaces = resolved.select("surface", "node_id", *NAME[1:]).distinct()
    all_ends = resolved.select(*RECORD, "field", "node_id").union(at)
    return {"nodes": new, "resolved": all_ends, "surfaces": surfaces, "values": values, "describes": describes, "edges": edges, "rejected": rejected, "queue": queue.union(doubt), "defects": defects}
