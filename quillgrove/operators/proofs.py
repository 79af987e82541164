"""Merkle levels as a table, and proofs of any set of leaves.

The levels are stored once: 4096 leaves make twelve levels in one group, so a tree of a million leaves takes two shuffles
and no task sees more than an aligned stretch; the largest tree's size says how many levels are made. A proof of several leaves is a table operation on them: the
places of a level that can be computed from the leaves, their mates that can't, and an equijoin with the stored
digests; a mate that several leaves share is sent once. Checking a proof is one expression.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kept import kept
from .ordered import STRETCH_BITS, heights

LEVEL = "array<binary>"


def indexed(leaves: DataFrame, by: str, order: str, digest: str) -> DataFrame:
    """tree, i (from 0 in the order), h; `order` is an integer that no two leaves of a tree share, `digest` is binary.

    Leaves are counted in ranges of the order, so no window sees a whole tree.
    """
    part = F.floor(F.col(order) / (1 << STRETCH_BITS)).alias("part")
    held = leaves.select(F.col(by).alias("tree"), F.col(order).cast("long").alias("o"), part, F.col(digest).alias("h"))
    counts = held.groupBy("tree", "part").agg(F.count("*").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    nth = F.row_number().over(Window.partitionBy("tree", "part").orderBy("o")) - 1
    return held.withColumn("nth", nth).join(counts.select("tree", "part", ahead.alias("ahead")), ["tree", "part"]).select("tree", (F.col("ahead") + F.col("nth")).alias("i"), "h", "o")


def _pair(a: Column, b: Column, domain: str) -> Column:
    """A digest over two; the one that has no mate goes up as it is."""
    return F.when(b.isNull(), a).otherwise(F.unhex(F.sha2(F.concat(F.lit(domain.encode() + b"\0"), a, b), 256)))


def _above(level: Column, domain: str) -> Column:
    half = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / 2).cast("int")), lambda j: _pair(F.get(x, 2 * j), F.get(x, 2 * j + 1), domain))
    return F.when(F.size(level) > 1, half(level)).otherwise(level)


def levels(leaves: DataFrame, domain: str = "merkle") -> DataFrame:
    """tree, n (leaves), level, i, h of every level from the leaves (0) to the root, from rows (tree, i, h).

    Leaves are read for the sizes, the height, level 0 and the first stretches, so they are written once.
    """
    leaves = kept(leaves.select("tree", "i", "h"))
    sizes = leaves.groupBy("tree").agg(F.count("*").alias("n"))
    height = heights(sizes)
    at, made = leaves.select("tree", "i", "h"), [leaves.select("tree", F.lit(0).alias("level"), "i", "h")]
    for step in range(-(-height // STRETCH_BITS)):
        bits = min(STRETCH_BITS, height - step * STRETCH_BITS)
        stretch = at.groupBy("tree", F.shiftright("i", STRETCH_BITS).alias("j")).agg(F.array_sort(F.collect_list(F.struct("i", "h"))).alias("x"))
        stretch = stretch.select("tree", "j", F.transform("x", lambda x: x["h"]).alias("l0"))
        for k in range(bits):
            stretch = stretch.withColumn(f"l{k + 1}", _above(F.col(f"l{k}"), domain))
        every = [F.transform(F.col(f"l{k}"), lambda h, i: F.struct(F.lit(step * STRETCH_BITS + k).alias("level"), (F.shiftleft("j", STRETCH_BITS - k) + i).alias("i"), h.alias("h"))) for k in range(1, bits + 1)]
        rows = stretch.select("tree", F.inline(F.flatten(F.array(*every))))
        made.append(rows)
        at = rows.where(F.col("level") == (step + 1) * STRETCH_BITS).select("tree", "i", "h")
    # A tree of n leaves has levels up to the first with one digest.
    held = reduce(DataFrame.unionAll, made).join(sizes, "tree")
    return held.where(F.col("level") <= _height(F.col("n"))).select("tree", "n", "level", "i", "h")


def _halved(i: Column, times: Column) -> Column:
    """i // 2 ** times, rounded down."""
    return F.call_function("shiftright", i.cast("long"), times.cast("int"))


def _height(n: Column) -> Column:
    return F.ceil(F.log2(n.cast("double"))).cast("int")


def multiproofs(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """tree, n, leaves, proof, root for the leaves asked for (tree, i).

    `leaves` are structs of i and h, `proof` of level, i and h: what a reader who has only the leaves
    needs to compute the root. Leaves that a tree doesn't have are left out, and trees that none is asked of.
    """
    roots = stored.where(F.col("level") == _height(F.col("n"))).select("tree", "n", F.col("h").alias("root"))
    asked = wanted.select("tree", "i").distinct().join(roots.select("tree", "n"), "tree").where("i >= 0 and i < n")
    places = F.transform(F.sequence(F.lit(0), F.greatest(_height(F.col("n")) - 1, F.lit(0))), lambda k: F.struct(k.cast("int").alias("level"), _halved(F.col("i"), k).alias("i")))
    known = asked.select("tree", F.inline(F.when(F.col("n") > 1, places).otherwise(F.slice(places, 1, 1)))).distinct()
    mates = known.select("tree", "level", F.col("i").bitwiseXOR(F.lit(1).cast("long")).alias("i")).join(known, ["tree", "level", "i"], "left_anti")
    needed = known.where("level = 0").withColumn("own", F.lit(True)).unionAll(mates.withColumn("own", F.lit(False)))
    found = needed.join(stored.select("tree", "level", "i", "h"), ["tree", "level", "i"])
    part = lambda own: F.array_sort(F.collect_list(F.when(F.col("own") == own, F.struct("level", "i", "h"))))
    proofs = found.groupBy("tree").agg(part(True).alias("leaves"), part(False).alias("proof"))
    return proofs.join(roots, "tree").select("tree", "n", F.transform("leaves", lambda x: F.struct(x["i"].alias("i"), x["h"].alias("h"))).alias("leaves"), "proof", "root")


def computed_root(leaves: Column, proof: Column, n: Column, domain: str = "merkle") -> Column:
    """The root that leaves and proof give: level by level, each place from the two below it; null if one of them is missing."""
    start = leaves.cast("array<struct<i:bigint,h:binary>>")

    def up(state: Column, level: Column) -> Column:
        beside = F.transform(F.filter(proof, lambda p: p["level"] == level), lambda p: F.struct(p["i"].alias("i"), p["h"].alias("h")))
        held = F.map_from_entries(F.concat(state, beside))
        size = -_halved(-n, level)  # rounded up
        parents = F.array_distinct(F.transform(state, lambda x: F.shiftright(x["i"], 1)))

        def made(p: Column) -> Column:
            a, b = F.try_element_at(held, 2 * p), F.try_element_at(held, 2 * p + 1)
            digest = F.when(2 * p + 1 >= size, a).otherwise(F.unhex(F.sha2(F.concat(F.lit(domain.encode() + b"\0"), a, b), 256)))
            return F.struct(p.alias("i"), digest.alias("h"))

        return F.transform(parents, made).cast("array<struct<i:bigint,h:binary>>")

    climbed = F.when(n > 1, F.aggregate(F.sequence(F.lit(0), _height(n) - 1), start, up)).otherwise(start)
    return F.get(climbed, F.lit(0))["h"]


def holds(leaves: Column, proof: Column, n: Column, root: Column, domain: str = "merkle") -> Column:
    return F.coalesce(computed_root(leaves, proof, n, domain) == root, F.lit(False))
