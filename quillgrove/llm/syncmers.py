"""Document fingerprints from closed syncmers, matched by position.

A window of `K` bytes is a closed syncmer if the smallest hash of its inner substrings of `S`
bytes is the first or the last of them. That depends on the window alone, not on what
surrounds it, so a passage keeps its anchors wherever it stands. Of a text's syncmers
the fingerprint keeps the `SIZE` with the smallest hashes, each with its position in bytes,
in order of hash; a text without a syncmer (any of `2 * K - S` bytes has one) has itself as its one
anchor. All texts have one scale, whatever their length.

The likeness of two fingerprints is the share, among the smallest hashes of both together,
of anchors that both have and whose positions agree on one shift up to `SLACK` bytes.

Next documents: ids descend; ties go by hash of the text, then text. Blocks in order of id are put in order
in one task each, and each block also gets the first document of the block after it, so texts
are shuffled once and no task sees the whole table. What says which document that is has a row
for each block; it is broadcast up to `FEW` rows and joined by a shuffle beyond.

Defined cases: null texts count as empty; the fingerprint of an empty text is empty; two empty
fingerprints have likeness 1, an empty and another 0; a null id comes after all others in
the ascending order, so first here; a single document is its own next; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LAST_ID, cut, keyed, ordered_blocks, read_table
from .textvec import U, as_bytes, mix, pieces

K, S, SIZE, SLACK = 16, 6, 32, 8
BLOCK_BYTES, FEW, CHAIN = 4 << 20, 200_000, 4096
Anchors = tuple[np.ndarray, np.ndarray]


def anchors(texts: list[bytes], size: int = SIZE, k: int = K, s: int = S) -> list[Anchors]:
    """The smallest syncmer hashes of each text, ascending, and their first positions."""
    out: list[Anchors] = []
    for piece in pieces(texts):
        wide = piece.data.astype(U)
        inner = wide[: len(wide) - s + 1].copy() if len(wide) >= s else np.zeros(0, U)
        for j in range(1, s):
            inner |= wide[j : j + len(inner)] << U(8 * j)
        inner = mix(inner)
        n, span = len(piece.data) - k + 1, k - s
        found = np.zeros(0, np.int64)
        if n > 0:
            low = inner.copy()
            reach = 1  # minimum over `reach` inner substrings
            while reach * 2 <= span + 1:
                low = np.minimum(low[:-reach], low[reach:])
                reach *= 2
            low = np.minimum(low[:n], low[span + 1 - reach : span + 1 - reach + n])
            found = np.flatnonzero((low == inner[:n]) | (low == inner[span : span + n]))
        value = (piece.hashes(piece.prefix(), found, found + k) >> U(32)) if len(found) else np.zeros(0, U)
        a = np.searchsorted(found, piece.row_start)
        b = np.searchsorted(found, piece.row_end - k, side="right")
        for t, i, j, start in zip(piece.texts, a, b, piece.row_start, strict=True):
            if i < j:
                v, p = value[i:j], found[i:j] - start
                if len(v) > 4 * size:
                    few = np.sort(np.argpartition(v, 3 * size)[: 3 * size])
                    if len(np.unique(v[few])) >= size:
                        v, p = v[few], p[few]
                v, first = np.unique(v, return_index=True)
                out.append((v[:size], _first(value[i:j], found[i:j] - start, v[:size], p[first[:size]])))
            elif t:
                out.append((np.array([int(hashlib.sha256(t).hexdigest()[:8], 16)], U), np.zeros(1, np.int64)))
            else:
                out.append((np.zeros(0, U), np.zeros(0, np.int64)))
    return out


def _first(value: np.ndarray, position: np.ndarray, wanted: np.ndarray, candidate: np.ndarray) -> np.ndarray:
    """First position of each wanted hash; the candidates are right unless a hash repeats."""
    hit = np.isin(value, wanted)
    if hit.sum() == len(wanted):
        return candidate
    v, first = np.unique(value[hit], return_index=True)
    return position[hit][first]


def written(found: Anchors) -> str:
    """Eight hex digits of hash and the position in hex, joined by commas."""
    return ",".join(f"{h:08x}:{p:x}" for h, p in zip(found[0].tolist(), found[1].tolist(), strict=True))


def read(fingerprint: str) -> Anchors:
    """The anchors of a written fingerprint."""
    parts = [x.split(":") for x in fingerprint.split(",") if x]
    return np.array([int(h, 16) for h, _ in parts], U), np.array([int(p, 16) for _, p in parts], np.int64)


def likeness(x: Anchors, y: Anchors, size: int = SIZE, slack: int = SLACK) -> float:
    """Share of anchors in agreement, from 0 to 1."""
    if not len(x[0]) or not len(y[0]):
        return float(len(x[0]) == len(y[0]))
    common, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    # Only hashes that each side would have kept can be compared.
    both = np.union1d(x[0], y[0])[:size]
    ok = np.isin(common, both)
    if not ok.any():
        return 0.0
    shift = np.sort(x[1][i[ok]] - y[1][j[ok]])
    return float((np.searchsorted(shift, shift + slack, side="right") - np.arange(len(shift))).max() / len(both))


def firsts(blocked: DataFrame) -> DataFrame:
    """k, h of the first document of each block, and `guest`: the block before it, in descending order."""
    heads = cut(blocked.groupBy("block").agg(F.max(F.struct("k", "h")).alias("x")).select("block", "x.k", "x.h", F.floor(F.col("block") / CHAIN).alias("chain")))
    # Block numbers may have gaps: the next higher number in the chain, else the lowest of the next chain.
    chains = heads.groupBy("chain").agg(F.min("block").alias("low"))
    after = Window.orderBy("chain").rowsBetween(1, Window.unboundedFollowing)
    whole = Window.orderBy("chain").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    chains = chains.select("chain", F.coalesce(F.first("low").over(after), F.first("low").over(whole)).alias("turn"))  # a row for each CHAIN blocks
    above = F.lead("block").over(Window.partitionBy("chain").orderBy("block"))
    return cut(heads.withColumn("above", above).join(chains, "chain").select("k", "h", F.coalesce("above", "turn").alias("guest")))


def compare(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    blocked, _ = ordered_blocks(keyed(docs, id_col, text_col), block_bytes)
    blocked = blocked.select("k", "h", "text", "block")
    wanted = firsts(blocked)
    wanted = F.broadcast(wanted) if wanted.limit(FEW + 1).count() <= FEW else wanted
    own = F.struct("block", F.lit(False).alias("visits"))
    both = F.when(F.col("guest").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("guest").alias("block"), F.lit(True).alias("visits"))))
    dealt = blocked.join(wanted, ["k", "h"], "left").withColumn("to", F.explode(both)).select("k", "h", "text", "to.block", "to.visits")
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(table: pa.Table) -> pa.Table:
        keys, visits, h = (table[c].to_pylist() for c in ("k", "visits", "h"))
        raw = as_bytes(table["text"])
        rank = lambda i: (-keys[i], -h[i], raw[i])
        rows = sorted((i for i in range(len(keys)) if not visits[i]), key=rank)
        # Equal rows may be first in the next block together.
        rows += sorted((i for i in range(len(keys)) if visits[i]), key=rank)[:1]
        texts = [raw[i].decode("utf-8", "replace") for i in rows]
        edited = []
        for t, following in zip(texts[:-1], texts[1:], strict=True):
            half = len(t) // 2
            edited.append((t[: len(t) - half] + following[:half]).encode())
        own = anchors([raw[i] for i in rows])
        other = anchors(edited)
        out = [
            (None if keys[i] == LAST_ID else keys[i], len(t), hashlib.sha256(e).hexdigest(), written(a), written(c), likeness(a, c), likeness(a, b))
            for i, t, e, a, b, c in zip(rows, texts, edited, own[:-1], own[1:], other, strict=False)
        ]
        return pa.Table.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    return dealt.groupBy("block").applyInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op4_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare(read_table(spark, sf_dir, "documents"))
