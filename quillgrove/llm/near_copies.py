"""SimHash near-dedup of texts whose five-word shingles have a Jaccard similarity of 4/5 or more.

Two texts link if their sets of lower-cased five-word shingles have that similarity; links
make components. A text of fewer words has all its words as its one shingle.

Equal sets are one entry with a fingerprint of two 64-bit words. The Gray-order index (`simhash.link`) finds
entries whose first words differ in 3 bits or fewer. At this similarity fingerprints may differ in
more, so entries also meet by shingle: shingles have one order for all texts, those that are
frequent in a sample last, others by hash. Two sets that link share one of the first n - ceil(4n/5) + 1 shingles of
each; the sample decides how much meets, never the result. First each entry that meets others is
compared with the smallest one there, which makes most components. Then the pairs that meet and are in different
components are compared, so a large group of near copies costs a comparison or two for each member,
not one for each pair. A pair is compared exactly unless its fingerprints differ in more than MAX_BITS of 128: a
bit differs with a chance below 0.19 where sets link, so a link goes with one of below 10^-8.

Texts and shingles that can't matter are left out before a shuffle by a `sieve`, a table of fixed size.

Defined cases: texts without a word are copies of each other; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import components
from .simhash import link
from .textvec import U, as_bytes, mix, pieces, window_hashes

SHINGLE = 5
SAMPLE, FREQUENT, SEEN = 20_000, 200_000, 3
#: Bits of 128 in which fingerprints of linked sets may differ.
MAX_BITS = 52
#: Bits of a sieve; with 64 in a row, at most 2**20 rows are broadcast.
SIEVE_BITS = 1 << 26
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingle_sets(texts: list[bytes], shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, ascending."""
    for piece in pieces(texts):
        piece.data = LOWER[piece.data]
        piece.words()
        words = piece.word_hashes()
        h = window_hashes(words, shingle)
        for a, b in zip(piece.word_start[:-1].tolist(), piece.word_start[1:].tolist(), strict=True):
            if b - a >= shingle:
                yield np.unique(h[a : b - shingle + 1])
            else:
                yield mix(window_hashes(words[a:b], b - a) + U(b - a)) if b > a else np.zeros(0, U)


def lead(n: int) -> int:
    """So many first shingles of n hold one of any set that links."""
    return n - (4 * n + 4) // 5 + 1 if n else 0


def _lists(held: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, held)]).astype(np.int32)
    flat = np.concatenate([*held, np.zeros(0, U)]).astype(U).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def sets(docs: DataFrame, carried: str) -> DataFrame:
    """The carried column and the shingles of `t`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(list(shingle_sets(as_bytes(batch.column(1)))))], [carried, "s"])

    kind = docs.schema[carried].dataType.simpleString()
    return docs.select(carried, "t").mapInArrow(run, f"{carried} {kind}, s array<bigint>")


def frequent(docs: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Shingles seen in several texts of a sample, the rarest first; at most FREQUENT of them."""
    n = docs.count()
    some = docs if n <= sample else docs.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int((1 << 30) * sample / n))
    seen = sets(some, "key").select(F.explode("s").alias("h")).groupBy("h").count().where(F.col("count") >= SEEN)
    top = seen.orderBy(F.desc("count"), "h").limit(FREQUENT).select("h").toArrow()["h"].to_numpy()
    return top[::-1].copy().view(U)


def bits_of(s: np.ndarray) -> int:
    """Each bit that is set in over half the hashes, as a signed word."""
    count = np.zeros(64, np.int64)
    for c in range(0, len(s), 1 << 15):
        count += np.unpackbits(s[c : c + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(count * 2 > len(s)).view(">u8")[0].astype(np.int64))


def prefixes(docs: DataFrame, late: np.ndarray) -> DataFrame:
    """key, e (a hash of the set), n, the fingerprint's words and the first shingles in the common order."""
    order = np.argsort(late)
    known = late[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, first = [], []
            for s in shingle_sets(as_bytes(batch.column(1))):
                spread = mix(s * U(0x9E3779B97F4A7C15) + U(len(s)))
                numbers.append((int(spread.sum(dtype=U).astype(np.int64)), len(s), bits_of(s), bits_of(mix(s ^ U(0x5851F42D4C957F2D)))))
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    s = s[np.argsort(np.where(known[at] == s, order[at] + 1, 0), kind="stable")]
                first.append(s[: lead(len(s))])
            columns = [pa.array([x[k] for x in numbers], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, _lists(first)], ["key", "e", "n", "fp", "fp2", "first"])

    kind = docs.schema["key"].dataType.simpleString()
    return docs.select("key", "t").mapInArrow(run, f"key {kind}, e bigint, n bigint, fp bigint, fp2 bigint, first array<bigint>")


def sieve(hashes: DataFrame) -> DataFrame:
    """Of the one column of hashes: for each 64 bits of a table of SIEVE_BITS which are taken."""
    at = F.col(hashes.columns[0]).bitwiseAND(F.lit(SIEVE_BITS - 1))
    bit = F.expr("shiftleft(1L, cast(at & 63 as int))")
    return cut(hashes.select(at.alias("at")).groupBy(F.shiftrightunsigned("at", 6).alias("of")).agg(F.bit_or(bit).alias("taken")))


def sifted(rows: DataFrame, by: Column, held: DataFrame, inside: bool = True) -> DataFrame:
    """Rows whose hash the sieve may hold (all that it does, and few others while most of its bits are free), or the other rows."""
    at = by.bitwiseAND(F.lit(SIEVE_BITS - 1))
    met = rows.withColumn("at", at).join(F.broadcast(held), F.shiftrightunsigned("at", 6) == F.col("of"), "left")
    hit = F.coalesce(F.expr("shiftrightunsigned(taken, cast(at & 63 as int)) & 1L"), F.lit(0)) == 1
    return met.where(hit if inside else ~hit).select(*[F.col(f"`{c}`") for c in rows.columns])


def confirmed(pairs: DataFrame, entries: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose fingerprints are near and whose sets have the similarity."""
    marks = lambda c: entries.select(F.col("e").alias(c), F.col("fp").alias(f"{c}1"), F.col("fp2").alias(f"{c}2"))
    apart = F.bit_count(F.col("a1").bitwiseXOR(F.col("b1"))) + F.bit_count(F.col("a2").bitwiseXOR(F.col("b2")))
    pairs = cut(pairs.join(marks("a"), "a").join(marks("b"), "b").where(apart <= MAX_BITS).select("a", "b"))
    wanted = cut(entries.join(pairs.select(F.explode(F.array("a", "b")).alias("e")).distinct(), "e").select("e", "key"))
    some = sifted(docs, F.xxhash64("key"), sieve(wanted.select(F.xxhash64("key"))))
    # Rows of one key are equal.
    held = cut(sets(some, "key").join(wanted, "key").dropDuplicates(["key"]).select("e", "s"))
    both = pairs.join(held.select(F.col("e").alias("a"), F.col("s").alias("x")), "a").join(held.select(F.col("e").alias("b"), F.col("s").alias("y")), "b")
    return cut(both.where(9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))).select("a", "b"))


def indexed(entries: DataFrame) -> DataFrame:
    """Pairs (a, b) that the Gray-order index links by the first word of their fingerprints."""
    marks = cut(entries.groupBy("fp").agg(F.min("e").alias("id")))
    equal = entries.join(marks, "fp").where("e <> id").select(F.col("id").alias("a"), F.col("e").alias("b"))
    return link(marks).select("a", "b").unionAll(equal).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def grouped(docs: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, DataFrame]:
    """Of rows with key and t: the smallest key of each component, and the keys of texts that have copies or links."""
    known = cut(prefixes(docs, frequent(docs, sample)))
    # Equal sets are counted before their shuffle, so that many copies are never one task's group.
    entries = cut(known.groupBy("e").agg(F.min("key").alias("key"), F.first("fp").alias("fp"), F.first("fp2").alias("fp2"), F.count("*").alias("m")))
    # Made anew each time it is read: written out, its rows would take several times the texts' shuffles.
    posted = known.select("e", "n", F.posexplode("first").alias("i", "h"))
    # The shingles that several entries lead with; by far the most have one entry.
    shared = posted.groupBy("h").agg(F.min("e").alias("low"), F.max("e").alias("high")).where("low < high").select("h")
    met = cut(sifted(posted, F.col("h"), sieve(shared)).distinct())
    # Small sides are cut, so that a crowded shingle can be split.
    least = cut(met.groupBy("h").agg(F.min(F.struct("e", "n", "i")).alias("x"), F.count("*").alias("m")).where("m > 1").select("h", *[F.col(f"x.{c}").alias(f"{c}1") for c in ("e", "n", "i")]))
    fits = lambda a, b: 5 * F.least(a, b) >= 4 * F.greatest(a, b)
    # From the first shingle that a pair shares, no more than the shorter rest can be common.
    ample = lambda n1, i1, n2, i2: 9 * F.least(F.col(n1) - F.col(i1), F.col(n2) - F.col(i2)) >= 4 * (F.col(n1) + F.col(n2))
    stars = met.join(least, "h").where((F.col("e1") < F.col("e")) & fits(F.col("n"), F.col("n1")) & ample("n1", "i1", "n", "i")).select(F.col("e1").alias("a"), F.col("e").alias("b"))
    stars = cut(stars.unionAll(indexed(entries)).distinct())
    links = confirmed(stars, entries, docs)
    part = components(links)
    placed = cut(met.join(part, F.col("e") == F.col("node"), "left").select("h", "e", "n", "i", F.coalesce("component", "e").alias("c")))
    mixed = cut(placed.groupBy("h").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("h"))
    left = cut(placed.join(mixed, "h"))
    x, y = (left.select("h", *[F.col(c).alias(f"{c}{k}") for c in ("e", "n", "i", "c")]) for k in (1, 2))
    ahead = x.join(y, "h").where((F.col("c1") != F.col("c2")) & (F.col("e1") < F.col("e2")) & fits(F.col("n1"), F.col("n2")) & ample("n1", "i1", "n2", "i2"))
    rest = cut(ahead.select(F.col("e1").alias("a"), F.col("e2").alias("b")).distinct().join(stars, ["a", "b"], "left_anti"))
    more = confirmed(rest, entries, docs)
    if not more.isEmpty():
        part = components(links.unionAll(more))
    placed = cut(entries.join(part, F.col("e") == F.col("node"), "left").select("e", "key", "m", "component"))
    first = placed.groupBy(F.coalesce("component", "e")).agg(F.min("key").alias("key")).select("key")
    return first, known.join(placed.where("m > 1 or component is not null").select("e"), "e").select("key")


def kept(docs: DataFrame, *, key_col: str, text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """The smallest key of each component; rows of one key have to be equal."""
    return grouped(_slim(docs, key_col, text_col), sample)[0]


def thinned(rows: DataFrame, *, key_col: str, text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row of each component, that of the smallest key; rows of one key have to be equal. Other rows aren't shuffled."""
    first, loose = grouped(_slim(rows, key_col, text_col), sample)
    held = sieve(loose.select(F.xxhash64("key")).distinct())
    whole = rows.select(F.col(f"`{key_col}`").alias("key"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"))
    settled = sifted(whole, F.xxhash64("key"), held).join(first, "key", "left_semi").dropDuplicates(["key"])
    return sifted(whole, F.xxhash64("key"), held, inside=False).unionAll(settled).select("row.*")


def _slim(docs: DataFrame, key_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{key_col}`").alias("key"), F.col(f"`{text_col}`").cast("string").alias("t"))
