"""Vector code compression: a vector is written as the nearest codebook entry of each of its parts.

The nearest entry is found through lower bounds by segment means. A part is cut in blocks; with S the
sums of blocks and r the norm of what the blocks' means leave over,
    distance^2 >= sum over blocks of (S_x - S_c)^2 / length + (r_x - r_c)^2
                = |x|^2 + |c|^2 - 2 (sum of S_x S_c / length + r_x r_c),
as means and residuals are orthogonal. One block first, then two, four and so on: an entry whose bound is above
an exact distance already known (that of the entry with the least bound) is out, so the survivors, which alone get
exact integer distances, hold every nearest entry. Bounds are reduced by more than their rounding; what is left
over is an integer before the root is taken, so it doesn't cancel.

Codebooks are learned over all vectors in rounds: a partition sends integer sums for each entry, which
meet in a groupBy; at most parts x entries rows come to the driver, and every task gets the codebooks.

Defined cases: rows whose vector is null or has a null or infinite component or NaN are left out. A vector of another
number of components than `dims` can't be cut alike: it stays, with code and error null, and has no
share in codebooks. Missing ids come last when the first entries are picked, repeated ids
in order of their vectors; fewer vectors than entries: as many entries. Null labels are one label. An empty
table gives an empty result; other columns are ignored. A component whose integer is beyond 2**27 raises.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read_table
from .vectors import floor_mean, integers, vectors

DIMS, PARTS, ENTRIES, ROUNDS, SCALE = 64, 16, 64, 2, 256
#: Rows that bounds are taken of at once.
STRETCH = 4096
#: Share of the squared norms by which bounds are reduced; rounding is below 1e-14 of them.
SLACK = 1e-12
#: A label with a larger share of the rows is hot: there are fewer than this many.
HOT_SHARE = 4096


class Segments:
    """Vectors, their squared norms, and for 1, 2, 4, ... blocks their coordinates: block means (times the root of the length) and the norm of what is left."""

    def __init__(self, points: np.ndarray) -> None:
        width = points.shape[1]
        self.points, self.levels = points, []
        self.square = (points * points).sum(axis=1).astype(np.float64)
        blocks = 1
        while blocks < width or width == blocks == 1:
            edges = [width * b // blocks for b in range(blocks + 1)]
            lengths = np.diff(edges)
            sums = np.stack([points[:, a:b].sum(axis=1) for a, b in zip(edges, edges[1:], strict=False)], axis=1)
            squares = np.stack([(points[:, a:b] * points[:, a:b]).sum(axis=1) for a, b in zip(edges, edges[1:], strict=False)], axis=1)
            left = np.sqrt(((lengths * squares - sums * sums) / lengths).sum(axis=1))
            self.levels.append(np.concatenate([sums / np.sqrt(lengths), left[:, None]], axis=1))
            blocks *= 2


def _bounds(level: int, some: Segments, entries: Segments) -> np.ndarray:
    """Lower bounds of the squared distances of all rows to all entries: |x|^2 + |c|^2 less twice the product of the coordinates."""
    products = some.levels[level] @ entries.levels[level].T
    products *= -2
    products += some.square[:, None] * (1 - SLACK)
    products += entries.square * (1 - SLACK)
    return products


def _exact(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows that go together, a component at a time."""
    out = np.zeros(len(points), np.int64)
    for j in range(points.shape[1]):
        difference = points[:, j] - entries[:, j]
        out += difference * difference
    return out


def nearest(points: np.ndarray, entries: Segments) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each point the nearest entry (ties to the lower index), its squared distance, and how many distances were taken exactly."""
    n, table = len(points), entries.points
    some, known, survive = Segments(points), np.full(n, np.iinfo(np.int64).max), True
    for level in range(len(some.levels)):
        bounds = _bounds(level, some, entries)
        known = np.minimum(known, _exact(points, table[bounds.argmin(axis=1)]))  # the most promising entry
        survive = survive & (bounds <= known[:, None])
    rows, at = np.nonzero(survive)
    distance = _exact(points[rows], table[at])
    first = np.searchsorted(rows, np.arange(n))  # rows ascend and none is without a survivor
    least = np.minimum.reduceat(distance, first)
    hit = np.flatnonzero(distance == least[rows])
    _, lowest = np.unique(rows[hit], return_index=True)
    return at[hit[lowest]], least, n * len(some.levels) + len(rows)


def coded(points: np.ndarray, books: list[Segments]) -> tuple[np.ndarray, np.ndarray]:
    """Entries (rows x parts) and errors of vectors."""
    width = points.shape[1] // len(books)
    at, error = np.empty((len(points), len(books)), np.int64), np.zeros(len(points), np.int64)
    for begin in range(0, len(points), STRETCH):
        rows = slice(begin, begin + STRETCH)
        for p, book in enumerate(books):
            at[rows, p], distance, _ = nearest(points[rows, p * width : (p + 1) * width], book)
            error[rows] += distance
    return at, error


def _matrix(column: pa.Array, scale: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return integers(values.reshape(len(column), -1), scale)


def moved(points: DataFrame, books: np.ndarray, scale: int) -> np.ndarray:
    """One round of codebooks (parts x entries x width): each used entry goes to the floor of its parts' mean."""
    sent_books = points.sparkSession.sparkContext.broadcast(books)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = sent_books.value.shape
        found = [Segments(b) for b in sent_books.value]
        sums, n = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            if batch.num_rows:
                rows = _matrix(batch.column(0), scale)
                at, _ = coded(rows, found)
                for p in range(parts):
                    np.add.at(sums[p], at[:, p], rows[:, p * width : (p + 1) * width])
                    n[p] += np.bincount(at[:, p], minlength=entries)
        p, e = np.nonzero(n)
        columns = [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e], pa.int64()), pa.array(list(sums[p, e]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "n", "sums"])

    sent = points.select("vector").mapInArrow(partial, "part int, entry int, n long, sums array<long>")
    width = books.shape[2]
    merged = sent.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"))
    after = books.copy()
    for r in merged.collect():  # a row for each entry of each part
        after[r["part"], r["entry"]] = floor_mean(r["sums"], r["n"])
    return after


def fit(points: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> np.ndarray:
    """Codebooks (parts x entries x width) after so many rounds over all vectors."""
    first = points.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()
    if not first:
        return np.zeros((parts, 0, 0), np.int64)
    books = np.stack(np.split(integers(np.array([r["vector"] for r in first], np.float64), scale), parts, axis=1))
    for _ in range(rounds):
        books = moved(points, books, scale)
    return books


def codebooks_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def codes(points: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """The rows with `code` (two hex digits a part) and `error` in place of their vector; null where its length isn't that of the books."""
    kept = [c for c in points.columns if c != "vector"]
    sent_books = points.sparkSession.sparkContext.broadcast(books)
    dims = books.shape[0] * books.shape[2]
    schema = ", ".join([*[f"`{c}` {points.schema[c].dataType.simpleString()}" for c in kept], "code string, error long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Segments(b) for b in sent_books.value] if dims else []
        for batch in batches:
            code, error = [None] * batch.num_rows, [None] * batch.num_rows
            vector = batch.column(batch.schema.get_field_index("vector"))
            whole = [i for i, n in enumerate(vector.value_lengths().to_pylist()) if n == dims and dims]
            if whole:
                at, off = coded(_matrix(vector.take(pa.array(whole)), scale), found)
                for i, row, e in zip(whole, at.astype(np.uint8), off.tolist(), strict=True):
                    code[i], error[i] = row.tobytes().hex(), e
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(code, pa.string()), pa.array(error, pa.int64())], [*kept, "code", "error"])

    return points.mapInArrow(run, schema)


def with_group_sums(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """The rows with the sum of `value` over all rows of their key; null is a key.

    A key with at least one row in HOT_SHARE is hot; fewer than HOT_SHARE + 1 keys can be, and their sums are broadcast, so
    their rows aren't shuffled. The others meet their sums by key, no key with more than that share.
    """
    totals = cut(rows.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("__n"), F.sum(value).alias("__sum")))
    n = totals.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    hot, cold = totals.where(F.col("__n") * HOT_SHARE >= n), totals.where(F.col("__n") * HOT_SHARE < n)
    met = rows.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("__key")), "left")
    out = met.where(F.col("__n").isNotNull()).select(*rows.columns, F.col("__sum").alias(name))
    if cold.isEmpty():
        return out
    rest = met.where(F.col("__n").isNull()).select(*rows.columns).join(cold, F.col(key).eqNullSafe(F.col("__key")))
    return out.unionByName(rest.select(*rows.columns, F.col("__sum").alias(name)))


def compress(table: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", dims: int = DIMS, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every vector."""
    if dims % parts or entries > 256:
        raise ValueError("parts must cut a vector evenly, and an entry's index must fit two hex digits")
    held = vectors(table, id_col, vector_col, label_col).withColumnRenamed(label_col, "label") if label_col != id_col else vectors(table, id_col, vector_col).withColumn("label", F.col("vec_id"))
    books = fit(held.where(F.size("vector") == dims).select("vec_id", "vector"), parts=parts, entries=entries, rounds=rounds, scale=scale)
    # Read three times from here on: a checkpoint of ids, labels, codes and errors, not of vectors.
    found = cut(codes(held, books, scale))
    return with_group_sums(found, "label", "error", "label_error").select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(read_table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    """The rounds written out over (vector, part) rows."""
    width = DIMS // PARTS
    squared = " + ".join(f"(v[{i}] - m[{i}]) * (v[{i}] - m[{i}])" for i in range(1, width + 1))
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"a{r} AS (SELECT vec_id, p, any_value(v) v, any_value(label) label, arg_min(e, (d, e)) e, min(d) d FROM (SELECT vec_id, label, x.p, v, e, {squared} d FROM parts x JOIN c{r} USING (p)) GROUP BY vec_id, p)")
        if r < ROUNDS:
            means = ", ".join(f"CAST((sum(v[{i}]) - (((sum(v[{i}]) % count(*)) + count(*)) % count(*))) // count(*) AS BIGINT)" for i in range(1, width + 1))
            steps.append(f"m{r} AS (SELECT p, e, [{means}] m FROM a{r} GROUP BY p, e), c{r + 1} AS (SELECT c{r}.p, c{r}.e, coalesce(m{r}.m, c{r}.m) m FROM c{r} LEFT JOIN m{r} USING (p, e))")
    return (
        f"WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) v FROM embeddings "
        "WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0), "
        f"parts AS (SELECT vec_id, label, p, v[p * {width} + 1 : p * {width} + {width}] v FROM kept CROSS JOIN range(0, {PARTS}) t(p)), "
        f"c0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 e, v m FROM parts QUALIFY e < {ENTRIES}), " + ", ".join(steps) + ", "
        f"found AS (SELECT vec_id, any_value(label) label, string_agg(printf('%02x', e), '' ORDER BY p) code, CAST(sum(d) AS BIGINT) error FROM a{ROUNDS} GROUP BY vec_id), "
        f"books AS (SELECT sha256(string_agg(array_to_string(m, ','), ',' ORDER BY p, e)) digest FROM c{ROUNDS}) "
        "SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, digest AS codebooks_sha256 FROM found CROSS JOIN books"
    )


ORACLE_SQL = _oracle()
