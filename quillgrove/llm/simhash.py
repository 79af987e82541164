"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints of 64 bits link at `max_bits` or fewer differing bits; links make components.

Equal fingerprints are one entry. As at most three bits differ, two linked fingerprints agree
in one of four 16-bit fields, so each entry goes to four buckets (field, its value); buckets
of one field are dealt in runs of values. Each run is sorted by value and, within it, by
Gray rank, where neighbours share long bit patterns. Nodes over 4, 16, 64, ... consecutive
entries keep the bits on which all below agree. The search walks pairs of nodes from the
top, adds up the differences of agreed bits and drops both groups as a whole once they
exceed the limit, or once all below is in one component already. What is left are links;
each run returns stars (entry, smallest entry linked to it), never all pairs.

A bucket with more than `bucket_limit` distinct fingerprints is dealt anew: within it three
bits are spread over 48, so two linked entries agree in one of four 12-bit fields too.

Defined cases: words and shingles of null and empty texts: none, fingerprint zero, linked like
any other; a null id ranks after all others and stays null; repeated rows share their
fingerprint; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LAST_ID, cut, read_table, slim
from .components import components
from .textvec import IS_SPACE, U, as_bytes, pieces

SHINGLE, SEED, MAX_BITS = 3, 42, 3
FIELDS, FIELD_BITS = 4, 16
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
RUN_ROWS = 40_000
BUCKET_LIMIT = 200_000
FAN = 4


def fingerprints(texts: list[bytes], shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """64-bit majority of the XXH64 values of every shingle, for each text."""
    out = np.zeros(len(texts), U)
    for piece in pieces(texts):
        piece.words()
        keep = ~IS_SPACE[piece.data]
        keep[piece.end] = True  # one separator after each word
        at = np.cumsum(keep) - 1
        lowered = np.where(IS_SPACE[piece.data], np.uint8(32), LOWER[piece.data])[keep].tobytes()
        start, end = at[piece.start], at[piece.end]
        view, digest = memoryview(lowered), xxhash.xxh64_intdigest
        for k in range(len(piece.texts)):
            a, b = int(piece.word_start[k]), int(piece.word_start[k + 1])
            if a == b:
                continue
            width = min(shingle, b - a)
            n = b - a - width + 1
            h = np.fromiter([digest(view[x:y], seed) for x, y in zip(start[a : a + n].tolist(), end[a + width - 1 : b].tolist(), strict=True)], U, n)
            count = np.zeros(64, np.int64)
            for c in range(0, n, 1 << 15):
                count += np.unpackbits(h[c : c + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
            out[piece.first + k] = np.packbits(count * 2 > n).view(">u8")[0]
    return out


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each word in the order in which neighbours differ in one bit."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> U(s))
    return x


class Index:
    """Nodes over runs of entries that are sorted by bucket and Gray rank."""

    def __init__(self, value: np.ndarray, bucket: np.ndarray) -> None:
        self.n = len(value)
        self.levels = [(value, ~np.zeros(len(value), U), bucket, bucket)]
        while len(self.levels[-1][0]) > FAN:
            v, mask, low, high = self.levels[-1]
            edge = np.arange(0, len(v), FAN)
            both, any_ = np.bitwise_and.reduceat(v, edge), np.bitwise_or.reduceat(v, edge)
            shared = np.bitwise_and.reduceat(mask, edge) & ~(both ^ any_)
            self.levels.append((both & shared, shared, low[edge], np.maximum.reduceat(high, edge)))

    def close(self, level: int, a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
        """Which pairs of nodes may hold linked entries of one bucket."""
        v, mask, low, high = self.levels[level]
        return (low[a] <= high[b]) & (low[b] <= high[a]) & (np.bitwise_count((v[a] ^ v[b]) & mask[a] & mask[b]) <= max_bits)

    def links(self, max_bits: int, chunk: int = 200_000) -> np.ndarray:
        """Smallest index linked to each entry, directly or over others."""
        label = np.arange(self.n)
        top = len(self.levels) - 1
        a, b = np.triu_indices(len(self.levels[top][0]))
        stack = [(top, a.astype(np.int64), b.astype(np.int64))]
        while stack:
            level, a, b = stack.pop()
            if len(a) > chunk:
                for at in range(0, len(a), chunk):
                    stack.append((level, a[at : at + chunk], b[at : at + chunk]))
                continue
            ok = self.close(level, a, b, max_bits)
            a, b = a[ok], b[ok]
            if level == 0:
                ok = a != b
                label = join(label, a[ok], b[ok])
                continue
            if level <= 3 and len(a):  # all below both nodes is one component already
                low, high = self.ends(label, level)
                ok = ~((low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b]))
                a, b = a[ok], b[ok]
            if not len(a):
                continue
            below = len(self.levels[level - 1][0])
            i, j = np.repeat(np.arange(FAN), FAN), np.tile(np.arange(FAN), FAN)
            x, y = (a[:, None] * FAN + i).ravel(), (b[:, None] * FAN + j).ravel()
            ok = (x <= y) & (x < below) & (y < below)
            stack.append((level - 1, x[ok], y[ok]))
        return label

    def ends(self, label: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        edge = np.arange(0, self.n, FAN**level)
        return np.minimum.reduceat(label, edge), np.maximum.reduceat(label, edge)


def join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after linking a[i] with b[i]: the smallest index of each component."""
    while len(a):
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            break
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        parent = np.arange(len(label))
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        label = parent[label]
    return label


def stars(value: np.ndarray, bucket: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Entries and the first entry of their component, within the buckets given."""
    order = np.lexsort((gray_rank(value), bucket))
    label = Index(value[order], bucket[order]).links(max_bits)
    own = np.flatnonzero(label != np.arange(len(label)))
    return order[own], order[label[own]]


def _field(fp: str, k: int, bits: int, of: int = 64) -> F.Column:
    return F.shiftrightunsigned(F.col(fp), of - bits * (k + 1)).bitwiseAND(F.lit((1 << bits) - 1)).cast("long")


def link(entries: DataFrame, *, max_bits: int = MAX_BITS, run_rows: int = RUN_ROWS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Links (a, b) between ids of distinct fingerprints; entries has columns id and fp, one row a fingerprint."""
    if max_bits >= FIELDS:
        raise ValueError(f"four fields find links of up to {FIELDS - 1} bits")
    n = entries.count()
    wide = entries.select("id", "fp", F.explode(F.array(*[F.struct(F.lit(k).alias("field"), _field("fp", k, FIELD_BITS).alias("value")) for k in range(FIELDS)])).alias("k")).select("id", "fp", F.col("k.field").alias("field"), F.col("k.value").alias("bucket"))
    runs = max(1, min(1 << FIELD_BITS, -(-n // run_rows)))
    crowded = []
    if n > bucket_limit:
        # At most 4 n / bucket_limit buckets can be that large.
        crowded = wide.groupBy("field", "bucket").count().where(F.col("count") > bucket_limit).select("field", "bucket").collect()
    usual, ddl = wide, "a long, b long"
    if crowded:
        deals = max(1024, -(-n // run_rows))  # sixteen times so many runs, whatever the number of crowded buckets
        hot = F.broadcast(entries.sparkSession.createDataFrame(crowded, "field int, bucket long"))
        usual = wide.join(hot, ["field", "bucket"], "left_anti")
        inner = F.explode(F.array(*[F.struct(F.lit(k).alias("sub"), F.col("rest").alias("rest"), F.shiftrightunsigned(F.col("rest"), 36 - 12 * k).bitwiseAND(F.lit(4095)).alias("v")) for k in range(4)]))
        again = wide.join(hot, ["field", "bucket"]).withColumn("rest", _without("fp", F.col("field"))).select("id", "fp", "field", "bucket", inner.alias("s"))
        dealt = again.select("id", "fp", (F.col("field") * 4 + F.col("s.sub") + 16).cast("long").alias("field"), (F.col("bucket") * 4096 + F.col("s.v")).alias("bucket"))
        dealt = dealt.withColumn("run", F.struct("field", F.pmod(F.xxhash64("bucket"), F.lit(deals)).alias("of")))
    ran = usual.select("id", "fp", F.col("field").cast("long").alias("field"), "bucket").withColumn("run", F.struct("field", F.floor(F.col("bucket") * runs / (1 << FIELD_BITS)).alias("of")))
    if crowded:
        ran = ran.unionAll(dealt)

    def find(table: pa.Table) -> pa.Table:
        ids = table["id"].to_numpy()
        x, y = stars(table["fp"].to_numpy().view(U), table["bucket"].to_numpy(), max_bits)
        return pa.table({"a": pa.array(ids[x], pa.int64()), "b": pa.array(ids[y], pa.int64())})

    return ran.groupBy("run").applyInArrow(lambda t: find(t), ddl)


def _without(fp: str, field: F.Column) -> F.Column:
    """The 48 bits of a fingerprint outside a field."""
    out = F.lit(None).cast("long")
    for k in range(FIELDS):
        low = 64 - FIELD_BITS * (k + 1)
        high = F.shiftrightunsigned(F.col(fp), low + FIELD_BITS) if k else F.lit(0).cast("long")
        rest = F.col(fp).bitwiseAND(F.lit((1 << low) - 1)) if low else F.lit(0).cast("long")
        out = F.when(field == k, F.shiftleft(high, low).bitwiseOR(rest) if k else rest).otherwise(out)
    return out


def fingerprint(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints(as_bytes(batch.column(1)), shingle).view(np.int64))], ["doc_id", "fp"])

    return slim(docs, id_col, text_col).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("t")).mapInArrow(run, "doc_id long, fp long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS, **how) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    known = cut(fingerprint(docs, id_col=id_col, text_col=text_col, shingle=shingle).withColumn("doc_id", F.coalesce("doc_id", F.lit(LAST_ID))))
    entries = cut(known.groupBy("fp").agg(F.min("doc_id").alias("id")))
    found = components(link(entries, max_bits=max_bits, **how))
    named = entries.join(found, entries["id"] == found["node"], "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    blank = lambda c: F.when(F.col(c) != LAST_ID, F.col(c))
    return known.join(named, "fp").select(blank("doc_id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), blank("component_id").alias("component_id"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
