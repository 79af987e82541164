"""Measures over a corpus: histograms, coverage, sizes, losses, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..plans.register import PROVISIONAL, Register, dimensions
from .nodes import field


def histogram(nodes: DataFrame, reg: Register, by: tuple[str, ...] = ()) -> DataFrame:
    """How often each element of the register occurs."""
    known = F.broadcast(dimensions(nodes.sparkSession, reg)["elements"].select("t", "layer", "cls"))
    return nodes.join(known, "t").groupBy(*by, "t", "layer", "cls").agg(F.count("*").alias("n"))


def by_layer(reg_elements: DataFrame) -> DataFrame:
    return reg_elements.groupBy("layer").agg(F.count("*").alias("n"))


def unused(nodes: DataFrame, reg: Register) -> DataFrame:
    """Elements of the register that no document uses, in order."""
    return dimensions(nodes.sparkSession, reg)["elements"].select("t").join(nodes.select("t").distinct(), "t", "left_anti").orderBy("t")


def blocks(nodes: DataFrame, reg: Register) -> DataFrame:
    """Block nodes, nested ones too."""
    known = F.broadcast(dimensions(nodes.sparkSession, reg)["elements"].where("cls = 'block'").select("t"))
    return nodes.join(known, "t", "left_semi")


def units(nodes: DataFrame) -> DataFrame:
    """doc_id, pos, unit: everything that a reader sees; a multiset."""
    t = F.col("t")
    integer = lambda k: field(k, "int").cast("decimal(38,0)")
    own = (
        F.when(t == "text", F.coalesce(field("v"), F.lit("")))
        .when(t == "quantity", C.quantity_text(F.coalesce(integer("significand"), F.lit(0)), F.coalesce(field("scale").cast("int"), F.lit(0)), field("unit")))
        .when(t == "power", C.power_text(F.coalesce(field("base"), F.lit("")), F.coalesce(field("exponent"), F.lit(""))))
        .when(t == "date", F.coalesce(field("value"), F.lit("")))
    )
    seen = F.lit(None).cast("string")
    for element, name in C.SEEN.items():
        seen = F.when(t == element, field(name, "str")).otherwise(seen)
    found = F.array_compact(F.array(own, F.when(~C.blank(seen), seen)))
    every = nodes.select("doc_id", "pos", F.explode(found).alias("unit"))
    # Units are in NFC; only what has a character that could change goes through Python.
    wide = F.col("unit").rlike(C.WIDE)
    return every.where(~wide).unionAll(every.where(wide).select("doc_id", "pos", F.get(C.nfc_each(F.array("unit")), F.lit(0)).alias("unit")))


def lost(before: DataFrame, after: DataFrame) -> DataFrame:
    """doc_id, unit, n: how many of a unit are in `before` and not in `after`."""
    count = lambda d, n: d.groupBy("doc_id", "unit").agg(F.count("*").alias(n))
    both = count(before, "b").join(count(after, "a"), ["doc_id", "unit"], "left")
    return both.select("doc_id", "unit", (F.col("b") - F.coalesce("a", F.lit(0))).alias("n")).where("n > 0")


def not_carried(source: DataFrame, carried: DataFrame, plain: DataFrame) -> DataFrame:
    """Strings of a source (doc_id, s) that its document neither carries as a unit nor shows in its squeezed text (doc_id, plain)."""
    rest = source.distinct().join(carried.select("doc_id", F.col("unit").alias("s")).distinct(), ["doc_id", "s"], "left_anti")
    return rest.join(plain.select("doc_id", C.squeezed(F.col("plain")).alias("p")), "doc_id", "left").where(~F.coalesce(F.contains("p", C.squeezed(F.col("s"))), F.lit(False))).select("doc_id", "s")


def coverage(flags: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """documents, covered and percent from doc rows with errors, lost and escapes."""
    ok = (F.col("errors") == 0) & (F.col("lost") == 0) & (F.col("escapes") == 0)
    return flags.groupBy(*by).agg(F.count("*").alias("documents"), F.count_if(ok).alias("covered")).withColumn("percent", F.round(100 * F.col("covered") / F.greatest("documents", F.lit(1)), 1))


def envelope(views: DataFrame, columns: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """Mean bytes of each representation, rounded down."""
    mean = lambda c: F.floor(F.sum(F.octet_length(c)) / F.greatest(F.count("*"), F.lit(1))).cast("long").alias(f"mean_{c}")
    return views.groupBy(*by).agg(F.count("*").alias("documents"), *[mean(c) for c in columns])


def scales(lexemes: DataFrame, column: str, currency: str | None = None) -> DataFrame:
    """Amounts by digits after the point, and the currencies seen with each."""
    found = lexemes.select(C.decimal_scale(F.col(column)).alias("scale"), (F.col(currency) if currency else F.lit(None).cast("string")).alias("currency"))
    return found.groupBy("scale").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("currency")).alias("currencies"))


def most_common(events: DataFrame, key: str, k: int, first: str | None = None) -> DataFrame:
    """The k most frequent keys; ties by first appearance if an order is given, then by key. A top-k report."""
    held = events.groupBy(key).agg(F.count("*").alias("n"), (F.min(first) if first else F.lit(0)).alias("first"))
    return held.orderBy(F.desc("n"), "first", key).limit(k).select(key, "n")


def verdicts(used: DataFrame, reg: Register, fixture: DataFrame | None = None) -> DataFrame:
    """What stands behind each element: (genre, t) rows of corpora, and elements of a fixture.

    Provisional comes first, then the number of genres, then the fixture.
    """
    spark = used.sparkSession
    genres = used.select("genre", "t").distinct().groupBy("t").agg(F.count("*").alias("genres"))
    shown = (fixture if fixture is not None else spark.createDataFrame([], "t string")).select("t").distinct().withColumn("shown", F.lit(True))
    every = dimensions(spark, reg)["elements"].select("t", "layer").join(genres, "t", "left").join(shown, "t", "left")
    n = F.coalesce("genres", F.lit(0))
    verdict = F.when(F.col("t").isin(*PROVISIONAL), "PROVISIONAL").when(n >= 2, "CORPUS").when(n == 1, "ONE GENRE").when(F.col("shown"), "FIXTURE").otherwise("UNTESTED")
    return every.select("t", "layer", n.alias("genres"), verdict.alias("verdict"))


def union_of(verdicts: DataFrame) -> DataFrame:
    """One row: how many elements there are, how many some genre uses, and the base-layer elements that no genre does."""
    unproven = F.array_sort(F.collect_list(F.when((F.col("layer") == 0) & F.col("verdict").isin("FIXTURE", "UNTESTED"), F.col("t"))))
    return verdicts.agg(F.count("*").alias("elements"), F.count_if(F.col("genres") > 0).alias("used"), unproven.alias("unproven"))


def distinct_values(rows: DataFrame, *columns: str) -> DataFrame:
    """One row: how many values each column has; a missing one is one."""
    return rows.agg(*[(F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).cast("long").alias(c) for c in columns])


def projection_ratio(pages: DataFrame, live: str, text: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Bytes of live pages and of their text, the share of markup (percent, rounded down) and how many times larger the page is."""
    held = pages.groupBy(*by).agg(F.count("*").alias("documents"), F.sum(live).alias("live_bytes"), F.sum(text).alias("text_bytes"))
    share = C.floor_percent(F.col("live_bytes") - F.col("text_bytes"), F.col("live_bytes"))
    return held.withColumns({"markup_percent": share, "ratio": F.round(F.col("live_bytes") / F.greatest("text_bytes", F.lit(1)), 1)})


def label_sources(controls: DataFrame, labels: DataFrame) -> DataFrame:
    """Controls (page_id, control_id, wrapped, aria, placeholder) with the label and where it is from."""
    said = labels.select("page_id", F.col("for_id").alias("control_id"), F.col("label").alias("named"))
    joined = controls.join(said, ["page_id", "control_id"], "left")
    ways = [("for", "named"), ("wrapping", "wrapped"), ("aria", "aria"), ("placeholder", "placeholder")]
    filled: list[tuple[str, Column]] = [(w, F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))) for w, c in ways]
    way = F.lit("none")
    for w, c in reversed(filled):
        way = F.when(c.isNotNull(), w).otherwise(way)
    return joined.withColumns({"label": F.coalesce(*[c for _, c in filled], F.lit("")), "way": way}).drop("named")
