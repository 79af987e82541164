"""Quality rules: divergence of a document's histograms from its language's, in DataFrame functions only.

Two histograms are compared with references by Jensen-Shannon distance (the square root of the
divergence in bits, 0 to 1): character classes, and the common words of the language against
all other words. The common words of a language are the `N_WORDS` that are in most of its documents; every
value of the language column has its own, learned from all documents. The references are the sums
over every document of the language that passes the base rules, so they cover the whole corpus.

A document is kept if it passes the base rules and, where it is long enough (`min_letters`
characters in words, `min_words` words), neither distance exceeds its limit.

All counts of a document come from its own row; what is shuffled is a count for each language and word,
and the reference sums. Both tables have a row for each language and are broadcast up to `FEW` of them.

Defined cases: null and empty texts have no words and fail the base rules; a missing language is one
of its own; if no document of a language passes the base rules there is nothing to compare with
and the distances are zero; repeated rows are judged alike; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, read_table, slim, text_of

#: Classes of characters, by what is left out of them; symbols are one too, and the rest (small letters).
CLASSES = {"upper": "[A-Z]+", "digit": "[0-9]+", "point": r"[.,;:!?'\"()-]+", "wide": r"[^\x00-\x7F]+"}
SYMBOLS = "[#*$%&|<>]+"
SPACE_RUN = r"[\x20\x09-\x0D]+"
MIN_WORDS, MAX_REPEATED = 50, 50
MIN_LETTERS, MIN_COMPARED, MAX_CLASS, MAX_WORD = 200, 100, 0.19, 0.345
N_WORDS, N_CLASSES, FEW = 20, len(CLASSES) + 1, 10_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with its argument computed once for a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_repeats(held: DataFrame) -> DataFrame:
    """With n_repeat_words: how many of `w` lie in three-word windows found twice or more.

    Each step is a column of its own, so that all but the lambdas is compiled and computed once.
    """
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    hashes = F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))
    placed = F.sort_array(F.arrays_zip(F.col("h").alias("h"), F.sequence(F.lit(0), F.size("h") - 1).alias("i")))
    # Sorted by hash, each beside the hash before and after it; concat makes one entry more, which equals nothing and goes.
    beside = F.arrays_zip(F.col("s.h").alias("h"), F.col("s.i").alias("i"), F.slice("s.h", 2, F.size("s")).alias("after"), F.concat(F.array(F.lit(None).cast("bigint")), "s.h").alias("before"))
    steps = F.zip_with("p", F.slice("p", 2, F.size("p")), lambda a, b: F.least(F.lit(3), b - a))  # the last has no next: least() leaves out the null
    return (
        held.withColumn("h", F.when(F.size("w") < 4, F.array().cast("array<bigint>")).otherwise(hashes))
        .withColumn("s", F.when(F.size(F.array_distinct("h")) == F.size("h"), none).otherwise(placed))
        .withColumn("p", F.when(F.size("s") == 0, F.array().cast("array<int>")).otherwise(F.sort_array(F.filter(beside, lambda x: (x["h"] == x["after"]) | (x["h"] == x["before"]))["i"])))
        .withColumn("n_repeat_words", F.aggregate(steps, F.lit(0), lambda a, x: a + x).cast("long"))
    )


def rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """doc_id, t and the language, an empty one for none."""
    lang = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(""))
    return slim(docs, id_col, text_col, lang_col).select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("t"), lang.alias("lang"))


def common_words(base: DataFrame) -> DataFrame:
    """lang and `own`: its words in most documents, N_WORDS of them, missing ones empty."""
    seen = base.select("lang", F.explode(F.array_distinct(F.array_remove(F.split(F.lower("t"), SPACE_RUN), ""))).alias("word")).groupBy("lang", "word").count()
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "word"))  # its limit is taken before the shuffle too
    top = seen.withColumn("place", place).where(F.col("place") <= N_WORDS)
    words = F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"])
    return top.groupBy("lang").agg(words.alias("w")).select("lang", F.concat("w", F.array_repeat(F.lit(""), N_WORDS - F.size("w"))).alias("own"))


def few(languages: DataFrame) -> DataFrame:
    """Broadcast if its size is known to be small."""
    return F.broadcast(languages) if languages.limit(FEW + 1).count() <= FEW else languages


def counts(docs: DataFrame, *, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """The base counts of each document, and its histograms `classes` and `frequent`."""
    t = F.col("t")
    base = rows(docs, id_col, text_col, lang_col)
    base = base.join(few(cut(common_words(base).withColumn("joined", F.array_join("own", "\n")))), "lang", "left").withColumn("own", F.coalesce("own", F.array_repeat(F.lit(""), N_WORDS)))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    without = lambda pattern: F.length(t) - F.length(F.regexp_replace(t, pattern, ""))
    # Most words aren't even part of the common ones set side by side, which is quicker to see.
    listed = F.array_remove(F.filter(F.split(F.lower(t), SPACE_RUN), lambda x: F.contains("joined", x) & F.array_contains("own", x)), "")
    frequent = F.transform("own", lambda w: (F.size("listed") - F.size(F.array_remove("listed", w))).cast("long"))
    return with_repeats(base.withColumn("w", F.array_remove(F.split(t, SPACE_RUN), ""))).select(
        "doc_id",
        "lang",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        "n_repeat_words",
        without(SYMBOLS).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.array(*[without(p).cast("long") for p in CLASSES.values()]).alias("classes"),
        "own",
        listed.alias("listed"),
    ).select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", frequent.alias("frequent"),
        F.concat("classes", F.array("n_symbols")).alias("classes"),
    ).withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")))


def histogram(parts: Column, total: Column) -> Column:
    """Shares of the parts and of the rest, which is never below zero."""
    return let(parts, lambda p: let(F.aggregate(p, F.lit(0).cast("long"), lambda a, x: a + x), lambda s: let(F.greatest(s, total, F.lit(1)), lambda n: F.transform(F.concat(p, F.array(n - s)), lambda x: x / n))))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms, in bits."""
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))
    terms = F.zip_with(p, q, lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0)))


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_class: float = MAX_CLASS, max_word: float = MAX_WORD) -> DataFrame:
    """doc_id, the base counts, base_failed, both distances and kept of every document."""
    known = cut(counts(docs, id_col=id_col, text_col=text_col, lang_col=lang_col))
    usable = known.where(~F.col("base_failed"))
    # The first references hold the odd documents too; the second are of those that agree with the first.
    near = _against(usable, _references(usable))
    judged = _against(known, _references(near.where(~_far(max_class, max_word))))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~_far(max_class, max_word)).alias("kept"), "class_distance", "word_distance")


def _far(max_class: float, max_word: float) -> Column:
    return ((F.col("word_chars") >= MIN_LETTERS) & (F.col("class_distance") > max_class)) | ((F.col("n_words") >= MIN_COMPARED) & (F.col("word_distance") > max_word))


def _references(known: DataFrame) -> DataFrame:
    """Sums of the histograms: a row for each language."""
    sums = lambda name, n: F.array(*[F.sum(F.get(name, F.lit(i))) for i in range(n)])
    return known.groupBy("lang").agg(F.sum("n_words").alias("ref_words"), F.sum("word_chars").alias("ref_chars"), sums("classes", N_CLASSES).alias("ref_c"), sums("frequent", N_WORDS).alias("ref_f"))


def _against(known: DataFrame, references: DataFrame) -> DataFrame:
    """With class_distance and word_distance to the reference of each document's language."""
    held = known.drop("class_distance", "word_distance").join(few(cut(references)), "lang", "left").withColumns({
        "class_distance": F.coalesce(distance(histogram(F.col("classes"), F.col("word_chars")), histogram(F.col("ref_c"), F.col("ref_chars"))), F.lit(0.0)),
        "word_distance": F.coalesce(distance(histogram(F.col("frequent"), F.col("n_words")), histogram(F.col("ref_f"), F.col("ref_words"))), F.lit(0.0)),
    })
    return held.drop("ref_words", "ref_chars", "ref_c", "ref_f")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


def _sql() -> str:
    classes = ", ".join(f"length(t) - length(regexp_replace(t, '{p.replace(chr(39), chr(39) * 2)}', '', 'g'))" for p in [*CLASSES.values(), SYMBOLS])
    sums = lambda name, n: "[" + ", ".join(f"sum({name}[{i + 1}])" for i in range(n)) + "]"
    hist = lambda parts, total: f"list_transform(list_concat({parts}, [greatest(list_sum({parts}), {total}, 1) - list_sum({parts})]), lambda x: x / greatest(list_sum({parts}), {total}, 1))"
    part = lambda a, b: f"CASE WHEN {a} > 0 THEN {a} * log2({a} / (({a} + {b}) / 2)) ELSE 0 END"
    dist = lambda p, q: f"sqrt(greatest(list_sum(list_transform(list_zip({p}, {q}), lambda z: {part('z[1]', 'z[2]')} + {part('z[2]', 'z[1]')})) / 2, 0))"

    def against(rows: str, ref: str) -> str:
        return (
            f"SELECT k.*, coalesce({dist('k.hc', f'{ref}.hc')}, 0) AS class_distance, coalesce({dist('k.hf', f'{ref}.hf')}, 0) AS word_distance FROM {rows} k LEFT JOIN {ref} ON {ref}.lang = k.lang"
        )

    def reference(rows: str) -> str:
        return f"SELECT lang, {hist('c', 'chars')} AS hc, {hist('f', 'words')} AS hf FROM (SELECT lang, {sums('classes', N_CLASSES)} AS c, {sums('frequent', N_WORDS)} AS f, sum(word_chars) AS chars, sum(n_words) AS words FROM {rows} GROUP BY lang)"

    far = f"((word_chars >= {MIN_LETTERS} AND class_distance > {MAX_CLASS}) OR (n_words >= {MIN_COMPARED} AND word_distance > {MAX_WORD}))"
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS lang FROM documents
), e AS (
  SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS place
  FROM (SELECT lang, unnest(list_distinct(list_filter(regexp_split_to_array(lower(t), '{SPACE_RUN}'), lambda x: x <> ''))) AS word FROM d) GROUP BY lang, word
), o AS (
  SELECT lang, list_resize(list(word ORDER BY place), {N_WORDS}, '') AS own FROM e WHERE place <= {N_WORDS} GROUP BY lang
), w AS (
  SELECT d.*, list_filter(regexp_split_to_array(t, '{SPACE_RUN}'), lambda x: x <> '') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines, list_filter(regexp_split_to_array(lower(t), '{SPACE_RUN}'), lambda x: x <> '') AS low,
    coalesce(o.own, list_transform(range({N_WORDS}), lambda x: '')) AS own FROM d LEFT JOIN o USING (lang)
), g AS (
  SELECT doc_id, i, [words[i], words[i + 1], words[i + 2]] AS gram FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 1))) AS i FROM w)
), r AS (
  SELECT doc_id, CAST(len(list_distinct(flatten(list([i, i + 1, i + 2])))) AS BIGINT) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS times FROM g) WHERE times > 1 GROUP BY doc_id
), f AS (
  SELECT doc_id, list(times ORDER BY i) AS frequent FROM (SELECT doc_id, i, len(list_filter(low, lambda x: x = own[i])) AS times FROM (SELECT doc_id, list_filter(low, lambda x: list_contains(own, x)) AS low, own, unnest(range(1, {N_WORDS + 1})) AS i FROM w)) GROUP BY doc_id
), c AS (
  SELECT doc_id, lang, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '{SYMBOLS}', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, [{classes}] AS classes, frequent
  FROM w LEFT JOIN r USING (doc_id) JOIN f USING (doc_id)
), b AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed, {hist("classes", "word_chars")} AS hc, {hist("frequent", "n_words")} AS hf FROM c
), u AS (SELECT * FROM b WHERE NOT base_failed
), r1 AS ({reference("u")}
), j1 AS ({against("u", "r1")}
), n1 AS (SELECT * FROM j1 WHERE NOT {far}
), r2 AS ({reference("n1")}
), j2 AS ({against("b", "r2")}
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT {far} AS kept FROM j2
"""


ORACLE_SQL = _sql()
