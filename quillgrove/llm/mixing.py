"""Mixing sources to target weights by entropy balancing.

Targets: sources in code point order (null last) weigh 5, 2, 1, repeating, and share 150 % of
all words; a target stops at twice its source's size and the excess goes to the others by
weight. The level at which nobody is above its stop is found in one ordered pass over the
sources' caps.

Rates: of all rates from 0 to 2 that meet a source's target, entropy balancing takes those
closest to one copy each; they are min(2, exp(tilt * size / mean size)). The tilt of each source
is the root of the dual's gradient, found by Newton steps kept inside a bracket; every step
is one aggregation over the histogram (source, size, count), for all sources at once.

Copies: within a source, documents stand in order of size and, within a size, of a hash of their id. A
document takes as many copies as whole numbers its stretch of summed rates passes; the
running sum makes the words taken follow the target to within about one document. Of
`OFFSETS` starting points each source takes the one that comes closest. Sums run over
sizes, then over parts of a size, then inside a part, so no task holds a whole source.

Defined cases: null texts have no words; documents without words take part with rate 1 and take
nothing; rows with one id are rows each; a source without words has target 0; an empty table
gives an empty result; other columns are ignored. Nothing is random: reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, read_table, slim, text_of

WEIGHTS = (5, 2, 1)
TOTAL, MOST = 1.5, 2.0
STEPS, TOLERANCE, OFFSETS, PARTS = 30, 1e-9, 32, 1 << 16
UNIT_BITS = 24
UNIT = 1 << UNIT_BITS
KEY = ("no_source", "source")


def sizes(docs: DataFrame, *, id_col: str, text_col: str, source_col: str) -> DataFrame:
    words = F.size(F.array_remove(F.split(text_of(text_col), r"[\x20\x09-\x0D]+"), "")).cast("long")
    source = F.col(f"`{source_col}`").cast("string")
    return slim(docs, id_col, text_col, source_col).select(F.col(f"`{id_col}`").alias("doc_id"), source.isNull().alias("no_source"), F.coalesce(source, F.lit("")).alias("source"), words.alias("size"))


def targets(sums: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """sums (source key, source_size) with `target`; the windows run over one row for each source."""
    by_name = Window.orderBy(*KEY)
    whole = Window.partitionBy()
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights)).cast("int"))
    s = sums.withColumns({"weight": weight, "cap": F.col("source_size") * F.lit(most)})
    order = Window.orderBy(F.col("cap") / F.col("weight"), *KEY)
    before, left = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("level", (F.sum("source_size").over(whole) * F.lit(total) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(left))
    s = s.withColumn("stopped", F.col("cap") / F.col("weight") <= F.col("level"))
    level = F.min(F.when(~F.col("stopped"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(whole)["level"]
    return s.withColumn("target", F.when(F.col("stopped"), F.col("cap")).otherwise(F.col("weight") * level)).select(*KEY, "source_size", "target")


def rate(tilt: Column, x: Column, most: float = MOST) -> Column:
    return F.least(F.lit(most), F.exp(F.least(tilt * x, F.lit(50.0))))


def _exact(x: Column) -> Column:
    """A sum that doesn't depend on the order of its rows."""
    return F.sum(x.cast("decimal(38,6)")).cast("double")


def solve(histogram: DataFrame, goals: DataFrame, most: float = MOST) -> DataFrame:
    """goals with `tilt` and `mean`: Newton steps on the dual, one aggregation over the histogram a step."""
    mean = histogram.groupBy(*KEY).agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    state = goals.join(mean, [*KEY]).withColumns({"full": F.col("target") >= F.col("source_size") * most * (1 - 1e-12), "tilt": F.lit(0.0), "low": F.lit(-60.0), "high": F.lit(60.0)})
    state = cut(state.withColumn("tilt", F.when(F.col("full"), F.lit(60.0)).otherwise(F.col("tilt"))))
    for _ in range(STEPS):
        x = F.col("size") / F.col("mean")
        r = rate(F.col("tilt"), x, most)
        words = F.col("n") * F.col("size")
        summed = histogram.where("size > 0").join(state.where(~F.col("full")), [*KEY]).groupBy(*KEY).agg(_exact(words * r).alias("got"), _exact(F.when(r < most, words * x * r).otherwise(0.0)).alias("slope"))
        found = state.join(summed, [*KEY], "left").withColumn("over", F.col("got") - F.col("target"))
        low = F.when(F.col("over") < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(F.col("over") > 0, F.col("tilt")).otherwise(F.col("high"))
        step = F.col("tilt") - F.col("over") / F.col("slope")
        inside = (F.col("slope") > 0) & (step > low) & (step < high)
        tilt = F.when(F.col("over").isNull() | (F.col("over") == 0), F.col("tilt")).when(inside, step).otherwise((low + high) / 2)
        state = cut(found.select(*KEY, "source_size", "target", "mean", "full", tilt.alias("tilt"), low.alias("low"), high.alias("high"), (F.abs("over") / F.greatest("target", F.lit(1.0))).alias("off")))
        if (state.agg(F.max("off")).first()[0] or 0.0) <= TOLERANCE:
            break
        state = state.drop("off")
    return state.select(*KEY, "source_size", "target", "mean", "tilt")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, rate of every row."""
    known = cut(sizes(docs, id_col=id_col, text_col=text_col, source_col=source_col))
    histogram = cut(known.groupBy(*KEY, "size").agg(F.count("*").alias("n")))
    sums = histogram.groupBy(*KEY).agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goals = solve(histogram, targets(sums, weights, total, most), most)
    found = F.when(F.col("size") == 0, F.lit(1.0)).otherwise(rate(F.col("tilt"), F.col("size") / F.col("mean"), most))
    rated = histogram.join(goals, [*KEY]).withColumn("rate", F.round(found * UNIT).cast("long"))  # whole units add up exactly
    # Summed rates before each size of a source; before each part of a size; within a part by hash and id.
    before = Window.partitionBy(*KEY).orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    rated = rated.withColumn("start", F.coalesce(F.sum(F.col("n") * F.col("rate")).over(before), F.lit(0))).select(*KEY, "size", "source_size", "target", "rate", "start")
    h = F.xxhash64(F.col("doc_id").cast("string"))
    dealt = known.withColumns({"h": h, "part": F.pmod(h, F.lit(PARTS))})
    within = Window.partitionBy(*KEY, "size", "part").orderBy("h", "doc_id")
    parts = dealt.groupBy(*KEY, "size", "part").agg(F.count("*").alias("m"))
    ahead = Window.partitionBy(*KEY, "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("ahead", F.coalesce(F.sum("m").over(ahead), F.lit(0))).join(rated, [*KEY, "size"]).drop("m")
    placed = cut(dealt.withColumn("place", F.row_number().over(within)).join(parts, [*KEY, "size", "part"]).withColumn("end", F.col("start") + (F.col("ahead") + F.col("place")) * F.col("rate")).select("doc_id", *KEY, "size", "source_size", "target", "rate", "end"))

    def copies(offset: Column) -> Column:
        return F.shiftright(F.col("end") + offset, UNIT_BITS) - F.shiftright(F.col("end") - F.col("rate") + offset, UNIT_BITS)

    tried = placed.groupBy(*KEY).agg(F.first("target").alias("t"), *[F.sum(copies(F.lit((2 * k + 1) * UNIT // (2 * OFFSETS)).cast("long")) * F.col("size")).alias(f"k{k}") for k in range(OFFSETS)])
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"k{k}") - F.col("t")).alias("off"), F.lit((2 * k + 1) * UNIT // (2 * OFFSETS)).cast("long").alias("at")) for k in range(OFFSETS)]))["at"]
    placed = placed.join(F.broadcast(tried.select(*KEY, best.alias("at"))) if _few(tried) else tried.select(*KEY, best.alias("at")), [*KEY])
    return placed.withColumn("copies", copies(F.col("at"))).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", (F.col("rate") / UNIT).alias("rate"))


def _few(sources: DataFrame, most: int = 10_000) -> bool:
    return sources.select(*KEY).limit(most + 1).count() <= most


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents")).drop("copies", "rate")
