"""Operators on ordered nodes, as windows within one document or one parent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .nodes import field


def repeated_ids(nodes: DataFrame) -> DataFrame:
    """Nodes whose id an earlier node of the document has."""
    held = nodes.withColumn("id", field("id", "str")).where("id is not null")
    return held.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "id").orderBy("pos"))).where("nth > 1").drop("nth")


def without_repeated_ids(nodes: DataFrame) -> DataFrame:
    """The first of equal ids stays, the others lose the field."""
    ident = field("id", "str")
    nth = F.row_number().over(Window.partitionBy("doc_id", "__id").orderBy("pos"))
    held = nodes.withColumn("__id", F.coalesce(ident, F.concat(F.lit("\0"), F.col("pos").cast("string")))).withColumn("__nth", nth)
    return held.withColumn("fields", F.when(F.col("__nth") > 1, F.filter("fields", lambda f: f["name"] != "id")).otherwise(F.col("fields"))).drop("__id", "__nth")


def numbered(items: DataFrame, by: list[str], order: str, start: str | None = None) -> DataFrame:
    """Items with their number in the list; blank items take a number too."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    return items.withColumn("number", n + (F.coalesce(start, F.lit(1)) if start else F.lit(1)) - 1)


def islands(rows: DataFrame, by: list[str], order: str, inside: str) -> DataFrame:
    """Consecutive rows for which `inside` holds share a run number; the others have none."""
    w = Window.partitionBy(*by).orderBy(order)
    begins = F.expr(inside) & ~F.coalesce(F.lag(F.expr(inside)).over(w), F.lit(False))
    held = rows.withColumn("__begins", begins.cast("int"))
    return held.withColumn("run", F.when(F.expr(inside), F.sum("__begins").over(w))).drop("__begins")


def followed(rows: DataFrame, by: list[str], order: str, column: str) -> DataFrame:
    """Each row with the next one's value."""
    return rows.withColumn("following", F.lead(column).over(Window.partitionBy(*by).orderBy(order)))


def columns_in_order(cells: DataFrame, by: str, row: str, place: str, name: str) -> DataFrame:
    """The columns of tables in order of first appearance: by row, then by place in it."""
    first = cells.groupBy(by, name).agg(F.min(F.struct(row, place)).alias("first"))
    return first.withColumn("column", F.row_number().over(Window.partitionBy(by).orderBy("first"))).drop("first")


def clamped_depth(nodes: DataFrame, low: int = 1, high: int = 6) -> DataFrame:
    return nodes.withColumn("level", F.least(F.greatest("depth", F.lit(low)), F.lit(high)))


def inside(nodes: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Nodes below any of the ancestors given: a range of positions in one document, by a running maximum, not a range join."""
    marked = nodes.join(ancestors.select("doc_id", "pos", F.lit(True).alias("__up")), ["doc_id", "pos"], "left")
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return marked.withColumn("__to", F.max(F.when(F.col("__up"), F.col("last_pos"))).over(before)).where("__to >= pos").drop("__up", "__to")


#: Levels that one expression joins: 4096 leaves.
STRETCH_BITS = 12


def heights(sizes: DataFrame) -> int:
    """Levels above the leaves of the largest tree, from rows with `n` leaves each; one number comes to the driver."""
    most = sizes.agg(F.max("n")).first()[0] or 0
    return max(0, most - 1).bit_length()


def _joined(hashes: Column, domain: bytes, levels: int) -> Column:
    """Root of an array of up to 2 ** levels digests: pairs meet, the odd last one goes up as it is."""
    head, out = F.lit(domain + b"\0"), hashes
    for _ in range(levels):
        half = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / 2).cast("int")), lambda i: F.when(F.get(x, 2 * i + 1).isNull(), F.get(x, 2 * i)).otherwise(F.unhex(F.sha2(F.concat(head, F.get(x, 2 * i), F.get(x, 2 * i + 1)), 256))))
        out = F.get(F.transform(F.array(out), lambda x: F.when(F.size(x) > 1, half(x)).otherwise(x)), F.lit(0))
    return F.get(out, F.lit(0))


def merkle(leaves: DataFrame, by: str, order: str, digest: str, domain: str = "merkle") -> DataFrame:
    """Root of each tree from its leaves, whose `order` is an integer that no two share.

    Trees of up to 4096 leaves, if there are no others, take one group each. Else leaves are counted in ranges of the order, so that their places
    need no window over a whole tree; then each aligned stretch of 4096 becomes one digest, as often as the largest tree
    needs. No task sees more than a range of a tree.
    """
    held = leaves.select(F.col(by).alias("tree"), F.floor(F.col(order) / (1 << STRETCH_BITS)).alias("part"), F.col(order).cast("long").alias("o"), F.col(digest).alias("h"))
    counts = held.groupBy("tree", "part").agg(F.count("*").alias("n"))
    height = heights(counts.groupBy("tree").agg(F.sum("n").alias("n")))
    if height <= STRETCH_BITS:
        at = held.select("tree", F.lit(0).alias("j"), F.col("o").alias("i"), "h")
    else:
        ahead = F.coalesce(F.sum("n").over(Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        nth = F.row_number().over(Window.partitionBy("tree", "part").orderBy("o")) - 1
        at = held.withColumn("nth", nth).join(counts.select("tree", "part", ahead.alias("ahead")), ["tree", "part"]).select("tree", (F.col("ahead") + F.col("nth")).alias("i"), "h")
        at = at.select("tree", F.shiftright("i", STRETCH_BITS).alias("j"), "i", "h")
    while True:
        at = at.groupBy("tree", "j").agg(F.array_sort(F.collect_list(F.struct("i", "h"))).alias("x"))
        at = at.select("tree", F.col("j").alias("i"), _joined(F.transform("x", lambda x: x["h"]), domain.encode(), min(height, STRETCH_BITS)).alias("h"))
        height -= STRETCH_BITS
        if height <= 0:
            return at.select(F.col("tree").alias(by), F.lower(F.hex("h")).alias("root"))
        at = at.select("tree", F.shiftright("i", STRETCH_BITS).alias("j"), "i", "h")
