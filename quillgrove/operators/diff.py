"""Structural differences of two versions of documents.

Both versions' nodes carry digests, and the comparison goes down from the roots: of a pair whose digests are equal nothing below is
looked at, so a round joins only the children of pairs that differ. Children are paired by place; a
pair of different elements is one difference and isn't followed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import fold
from .kept import kept

#: Differences of a document that a report shows.
MOST = 7


def _side(nodes: DataFrame, mark: str) -> DataFrame:
    """A version's nodes with digest, columns marked."""
    held = nodes.join(fold.digests(nodes), ["doc_id", "pos"])
    fields = F.map_from_entries(F.transform("fields", lambda f: F.struct(f["name"], F.concat(f["kind"], F.lit(":"), F.coalesce(f["value"], F.lit(""))))))
    said = F.array_join(F.transform(F.array_sort(F.map_entries(fields)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")
    return held.select("doc_id", "ord", *[c.alias(f"{n}_{mark}") for n, c in (("pos", F.col("pos")), ("up", F.col("parent_pos")), ("t", F.col("t")), ("kids", F.col("n_children")), ("fields", said), ("digest", F.col("digest")))])


def differences(before: DataFrame, after: DataFrame, most: int | None = MOST) -> DataFrame:
    """doc_id, nth, path, kind, before, after: the first differences of each document that both tables have, in document order.

    kind: `element` (of another name), `fields` or `children` (their number). `most` bounds the report of a document, not the comparison; None gives all.
    """
    a, b = kept(_side(before, "a")), kept(_side(after, "b"))
    # A missing digest (no canonical form) says nothing: such a pair is looked into.
    apart = ~F.coalesce(F.col("digest_a") == F.col("digest_b"), F.lit(False))
    seen = ["doc_id", "path", *[f"{n}_{m}" for m in "ab" for n in ("pos", "t", "kids", "fields")]]
    level = a.where("up_a < 0").drop("ord").join(b.where("up_b < 0").drop("ord"), "doc_id").where(apart).withColumn("path", F.array().cast("array<int>")).select(*seen)
    every = None
    while True:
        level = kept(level)
        every = level if every is None else every.unionAll(level)
        follow = level.where(F.col("t_a").eqNullSafe(F.col("t_b"))).select("doc_id", "path", F.col("pos_a").alias("up_a"), F.col("pos_b").alias("up_b"))
        if follow.isEmpty():
            break
        down = follow.join(a, ["doc_id", "up_a"]).join(b, ["doc_id", "up_b", "ord"]).where(apart)
        level = down.withColumn("path", F.concat("path", F.array("ord"))).select(*seen)
    return _report(every, most)


def _report(pairs: DataFrame, most: int | None) -> DataFrame:
    same = F.col("t_a").eqNullSafe(F.col("t_b"))
    said = lambda rank, kind, x, y: F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x.alias("before"), y.alias("after"))
    count = lambda c: F.col(c).cast("string")
    found: list[tuple[Column, Column]] = [
        (~same, said(0, "element", F.col("t_a"), F.col("t_b"))),
        (same & (F.col("fields_a") != F.col("fields_b")), said(1, "fields", F.col("fields_a"), F.col("fields_b"))),
        (same & (F.col("kids_a") != F.col("kids_b")), said(2, "children", count("kids_a"), count("kids_b"))),
    ]
    rows = pairs.select("doc_id", "path", F.inline(F.array_compact(F.array(*[F.when(c, d) for c, d in found]))))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("path", "rank"))
    held = rows.withColumn("nth", nth)
    return (held if most is None else held.where(F.col("nth") <= most)).select("doc_id", "nth", "path", "kind", "before", "after")
