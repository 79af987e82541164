"""Degradation to the base layer on the node table, rule by rule, for elements that keep their rows.

These are the rules that rename, re-parent or drop nodes; the rules that make new nodes around
text are in `functions.trees.lowered`, which does all of them on one tree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .nodes import FIELDS, field

#: Element: its name in the base layer, without fields.
RENAMED = {"article": "section", "abstract": "section", "sidebar": "section", "signature-block": "term-list", "provenance": "term-list"}
LISTS = {"contents": "true", "bibliography": "false", "field-choice": "false"}


def renamed(nodes: DataFrame) -> DataFrame:
    """Elements that only change their name, with the fields that the new one has."""
    t, made, held = F.col("t"), F.col("t"), F.col("fields")
    pair = lambda name, kind, value: F.array(F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind"), value.alias("value")))
    for a, b in RENAMED.items():
        made, held = F.when(t == a, b).otherwise(made), F.when(t == a, F.array().cast(FIELDS)).otherwise(held)
    for a, ordered in LISTS.items():
        made, held = F.when(t == a, "list").otherwise(made), F.when(t == a, pair("ordered", "bool", F.lit(ordered))).otherwise(held)
    made = F.when(t == "citation", "reference").when(t == "state-link", "link").otherwise(made)
    held = F.when(t == "state-link", pair("href", "str", F.concat(F.lit("?"), field("key"), F.lit("="), field("value")))).otherwise(held)
    return nodes.withColumns({"__t": made, "__f": held}).drop("t", "fields").withColumnsRenamed({"__t": "t", "__f": "fields"}).where("t <> 'payload'")


def spliced(nodes: DataFrame, element: str = "table-section") -> DataFrame:
    """Children of an element take its place under its parent, in order: all children of that parent are numbered anew.

    `path` and `place` are of the old tree; they are left out.
    """
    gone = nodes.where(F.col("t") == element).select("doc_id", F.col("pos").alias("parent_pos"), F.struct(F.col("parent_pos").alias("up"), F.col("ord").alias("at")).alias("moved"))
    held = nodes.where(F.col("t") != element).drop("path", "place").join(gone, ["doc_id", "parent_pos"], "left")
    up = F.coalesce(F.col("moved.up"), F.col("parent_pos"))
    place = F.struct(F.coalesce(F.col("moved.at"), F.col("ord")), F.when(F.col("moved").isNotNull(), F.col("ord")))
    nth = F.row_number().over(Window.partitionBy("doc_id", "parent_pos").orderBy("sorted")) - 1
    above = F.when(F.col("moved").isNull(), F.col("depth")).otherwise(F.col("depth") - 1)
    moved = held.withColumns({"sorted": place, "depth": above, "parent_pos": up}).withColumn("ord", nth.cast("int")).drop("sorted", "moved")
    if "n_children" not in moved.columns:
        return moved
    n = moved.groupBy("doc_id", F.col("parent_pos").alias("pos")).agg(F.count("*").cast("int").alias("n"))
    return moved.join(n, ["doc_id", "pos"], "left").withColumn("n_children", F.coalesce("n", F.lit(0))).drop("n")
