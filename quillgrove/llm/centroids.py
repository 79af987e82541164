"""Centroid clustering: plain Lloyd rounds on integer vectors.

Centroids are a table of k rows, broadcast to every task. `mapInPandas` takes the squared
differences to each centroid in NumPy integers; argmin gives ties to the lower number. A
partition sends one row of integer sums for each centroid that it has vectors of; these meet
in a groupBy, and at most k rows of sums come to the driver, which makes the next centroids.
A lost executor costs its partitions' work again: nothing is kept between rounds but the centroids.

Defined cases: rows whose vector is null, of another number of components, or has a null or
infinite component or NaN are left out. A missing id counts as the empty text in the hash that picks the
first centroids; repeated ids are in order of their vectors, repeated rows each count. Fewer
vectors than k: as many centroids as vectors. An empty table gives an empty result. An empty
cluster's centroid stays. Other columns are ignored. A component whose integer is beyond
2**27 raises: its distances don't fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table
from .vectors import floor_mean, integers, vectors

K, ROUNDS, DIMS, SCALE = 16, 3, 64, 64
PREFIX = "1:"


@dataclass(frozen=True)
class Centroids:
    """k integer vectors (k x dims) and the scale that made them."""

    table: np.ndarray
    scale: int

    def digest(self, c: int) -> str:
        return hashlib.sha256(",".join(map(str, self.table[c].tolist())).encode()).hexdigest()


def nearest(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each point the nearest centroid and the squared distance; ties to the lower number."""
    distances = np.empty((len(points), len(centroids)), np.int64)
    for c, centroid in enumerate(centroids):
        difference = points - centroid
        distances[:, c] = (difference * difference).sum(axis=1)
    best = distances.argmin(axis=1)
    return best, distances[np.arange(len(points)), best]


def _points(column: pd.Series, scale: int) -> np.ndarray:
    return integers(np.stack(column.to_numpy()), scale)


def held(table: DataFrame, id_col: str, vector_col: str, dims: int) -> DataFrame:
    return vectors(table.where(F.size(F.col(f"`{vector_col}`")) == dims), id_col, vector_col)


def started(points: DataFrame, k: int, scale: int, prefix: str) -> Centroids:
    """The k vectors whose ids have the smallest hashes, in that order."""
    rank: Column = F.sha2(F.concat(F.lit(prefix), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = points.select("vector", rank.alias("rank")).orderBy("rank", "vector").limit(k).collect()
    return Centroids(integers(np.array([r["vector"] for r in rows], np.float64), scale), scale)


def moved(points: DataFrame, centroids: Centroids) -> Centroids:
    """One round: each non-empty centroid goes to the floor of its vectors' mean."""
    spark = points.sparkSession
    table, scale = spark.sparkContext.broadcast(centroids.table), centroids.scale

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, n = np.zeros_like(table.value), np.zeros(len(table.value), np.int64)
        for batch in batches:
            if len(batch):
                at = _points(batch["vector"], scale)
                best, _ = nearest(at, table.value)
                np.add.at(sums, best, at)
                n += np.bincount(best, minlength=len(n))
        some = np.flatnonzero(n)
        yield pd.DataFrame({"cluster": some.astype(np.int32), "n": n[some], "sums": list(sums[some])})

    sent = points.select("vector").mapInPandas(partial, "cluster int, n long, sums array<long>")
    dims = table.value.shape[1]
    merged = sent.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(dims)]).alias("sums"))
    after = centroids.table.copy()
    for r in merged.collect():  # a row for each centroid
        after[r["cluster"]] = floor_mean(r["sums"], r["n"])
    return Centroids(after, scale)


def fit(points: DataFrame, *, k: int = K, rounds: int = ROUNDS, scale: int = SCALE, prefix: str = PREFIX) -> Centroids:
    """Centroids after so many rounds over all vectors."""
    centroids = started(points, k, scale, prefix)
    for _ in range(rounds if len(centroids.table) else 0):
        centroids = moved(points, centroids)
    return centroids


def assign(points: DataFrame, centroids: Centroids) -> DataFrame:
    """vec_id, cluster, distance (squared) of every vector."""
    kind = points.schema["vec_id"].dataType.simpleString()
    table, scale = points.sparkSession.sparkContext.broadcast(centroids.table), centroids.scale

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                best, distance = nearest(_points(batch["vector"], scale), table.value)
                yield pd.DataFrame({"vec_id": batch["vec_id"], "cluster": best.astype(np.int32), "distance": distance})

    return points.mapInPandas(run, f"vec_id {kind}, cluster int, distance long")


def cluster(table: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMS, k: int = K, rounds: int = ROUNDS, scale: int = SCALE, prefix: str = PREFIX) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector."""
    points = held(table, id_col, vector_col, dims)
    centroids = fit(points, k=k, rounds=rounds, scale=scale, prefix=prefix)
    assigned = assign(points, centroids)
    found = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect() if len(centroids.table) else []
    inertia = sum(r["cluster_inertia"] for r in found)
    rows = [(r["cluster"], r["cluster_inertia"], inertia, centroids.digest(r["cluster"])) for r in found]
    known = table.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(read_table(spark, sf_dir, "embeddings"))


def _floor_division(s: str, n: str) -> str:
    return f"CAST(({s} - ((({s} % {n}) + {n}) % {n})) // {n} AS BIGINT)"


def _oracle() -> str:
    """The rounds written out, each a join with 16 rows."""
    squared = "CAST(list_sum(list_transform(range(1, 65), lambda i: (v[i] - m[i]) * (v[i] - m[i]))) AS BIGINT)"
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"a{r} AS (SELECT vec_id, any_value(v) v, arg_min(c, (d, c)) c, min(d) d FROM (SELECT vec_id, v, c, {squared} d FROM kept CROSS JOIN c{r}) GROUP BY vec_id)")
        if r < ROUNDS:
            steps.append(
                f"s{r} AS (SELECT c, i, sum(v[i])::HUGEINT s, count(*)::HUGEINT n FROM a{r} CROSS JOIN range(1, 65) t(i) GROUP BY c, i), "
                f"m{r} AS (SELECT c, list({_floor_division('s', 'n')} ORDER BY i) m FROM s{r} GROUP BY c), "
                f"c{r + 1} AS (SELECT c{r}.c, coalesce(m{r}.m, c{r}.m) m FROM c{r} LEFT JOIN m{r} ON c{r}.c = m{r}.c)"
            )
    return (
        "WITH kept AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) v FROM embeddings "
        "WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0), "
        "c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 c, v m FROM kept QUALIFY c < 16), " + ", ".join(steps) + f" SELECT vec_id, CAST(a{ROUNDS}.c AS INTEGER) AS cluster, d AS distance, "
        f"CAST(sum(d) OVER (PARTITION BY a{ROUNDS}.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256 "
        f"FROM a{ROUNDS} JOIN c{ROUNDS} ON a{ROUNDS}.c = c{ROUNDS}.c"
    )


ORACLE_SQL = _oracle()
