"""Quality classifier: supervised subword embeddings.

Every word gives one hashed word feature and its hashed character n-grams (3 to 5 bytes,
word ends marked); a word that repeats the one before gives one more. A document is the
average of the learned vectors of all its features and of `SMOOTH` zero vectors; a softmax over two classes follows. Vectors and output weights are fitted by plain
stochastic gradient descent in numpy.

The fit takes a bounded sample of the labelled rows (`max_rows`, a parameter: the rows
with the smallest hash of their id); scoring covers every whole text. As the output is
linear in the average, the fitted vectors are folded into one number per feature before
scoring, which is a table of fixed size (`2 ** bits` floats, 1 MiB by default).

Defined cases: a null or empty text has no features and scores the intercept; null ids
stay null and count as the empty text for the fold; repeated rows are scored each; an
empty table gives an empty result; without labels of both classes the share of class 1
(or 0.5) is every document's score. Other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, py_crc_mod, read_table, slim
from .textvec import IS_SPACE, U, Piece, as_bytes, mix, pieces

GRAMS = (3, 4, 5)
#: Features with a zero vector that every average holds, so that a few words say little.
SMOOTH = np.float32(40)
#: The hash of every word that repeats the one before: a word 2-gram of equal words, whichever they are.
AGAIN = 0x7C15F39CC0605CED


@dataclass
class Model:
    """One number per feature, and the intercept."""

    weights: np.ndarray
    bias: float
    bits: int


def features(piece: Piece, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature of each word and n-gram of the piece, and the position in data where it stands."""
    data = np.where(IS_SPACE[piece.data], np.uint8(32), piece.data)
    space = data == 32
    wide, found, at = data.astype(U), [], []
    piece.words()
    word = piece.word_hashes()
    found.append(word >> U(64 - bits))
    at.append(piece.start)
    again = np.flatnonzero((word[1:] == word[:-1]) & (np.diff(piece.row_of_word()) == 0)) + 1
    found.append(np.full(len(again), AGAIN >> (64 - bits), U))
    at.append(piece.start[again])
    n, gram = len(data), wide.copy()
    inner = np.zeros(n, bool)  # a separator strictly inside
    for size in range(2, max(GRAMS) + 1):
        m = n - size + 1
        if m <= 0:
            break
        gram = gram[:m] | wide[size - 1 :] << U(8 * (size - 1))
        inner = inner[:m] | (space[size - 2 : size - 2 + m] if size > 2 else np.zeros(m, bool))
        if size in GRAMS:
            ok = np.flatnonzero(~inner & ~(space[:m] & space[size - 1 :]))
            found.append(mix(gram[ok] + U(size)) >> U(64 - bits))
            at.append(ok)
    return np.concatenate(found).astype(np.int64), np.concatenate(at)


def rows_of(piece: Piece, at: np.ndarray) -> np.ndarray:
    """The row of each position; the separator before a row counts to it."""
    return np.searchsorted(piece.row_start - 1, at, side="right") - 1


def bags(texts: list[bytes], bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its features and their shares."""
    out = []
    for piece in pieces(texts):
        f, at = features(piece, bits)
        row = rows_of(piece, at)
        keys, counts = np.unique(row.astype(np.int64) << 40 | f, return_counts=True)
        cut = np.searchsorted(keys >> 40, np.arange(len(piece.texts) + 1))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            c = counts[a:b].astype(np.float32)
            out.append((keys[a:b] & ((1 << 40) - 1), c / (c.sum() + SMOOTH)))
    return out


def fit(texts: list[bytes], labels: np.ndarray, bits: int = 18, dim: int = 12, epochs: int = 6, rate: float = 0.5, seed: int = 7) -> Model:
    """Stochastic gradient descent, one document a step, with a falling rate."""
    labels = np.asarray(labels, np.int64)
    if len(labels) == 0 or labels.min() == labels.max():
        share = 0.5 if len(labels) == 0 else float(labels[0]) * 0.98 + 0.01
        return Model(np.zeros(1 << bits, np.float32), float(np.log(share / (1 - share))), bits)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    out, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    bag, step, steps = bags(texts, bits), 0, epochs * len(texts)
    for _ in range(epochs):
        for i in rng.permutation(len(texts)):
            ids, share = bag[i]
            step += 1
            lr = np.float32(rate * (1 - step / (steps + 1)))
            mean = share @ vectors[ids]
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = p @ out
            out -= lr * np.outer(p, mean)
            bias -= lr * p
            # An average of thousands of features moves each but little; the step is scaled to the squared length of the bag.
            vectors[ids] -= (lr / max(float(share @ share), 1e-4) * 0.2) * share[:, None] * back[None, :]
    return Model((vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]), bits)


def scores(texts: list[bytes], model: Model) -> np.ndarray:
    """Probability of class 1 of each whole text."""
    out = []
    for piece in pieces(texts):
        f, at = features(piece, model.bits)
        row, n = rows_of(piece, at), len(piece.texts)
        total = np.bincount(row, weights=model.weights[f], minlength=n)
        z = total / (np.bincount(row, minlength=n) + SMOOTH) + model.bias
        out.append(1 / (1 + np.exp(-np.clip(z, -500, 500))))
    return np.concatenate(out) if out else np.zeros(0)


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, max_rows: int = 4000, max_text_bytes: int = 16 << 20) -> Model:
    """Fit on at most `max_rows` labelled rows outside the held-out fold, and at most `max_text_bytes` of their text.

    The sample takes both classes alike where both have enough rows; the intercept is then
    set back to the shares that the whole labelled fold has.
    """
    own = slim(labels, id_col, label_col).where(F.col(f"`{label_col}`").isin(0, 1) & F.col(f"`{id_col}`").isNotNull() & (crc_mod(F.col(f"`{id_col}`"), folds) != 0))
    shares = {int(r[0]): int(r[1]) for r in own.groupBy(F.col(f"`{label_col}`").cast("int")).count().collect()}
    sample = None
    for kind in shares:
        some = own.where(F.col(f"`{label_col}`") == kind).orderBy(F.xxhash64(F.col(f"`{id_col}`").cast("string")), F.col(f"`{id_col}`")).limit(max_rows // 2)
        sample = some if sample is None else sample.unionAll(some)
    if sample is None:
        return fit([], np.zeros(0))
    sample = sample.select(F.col(f"`{id_col}`").alias("k"), F.col(f"`{label_col}`").cast("int").alias("y"))
    # At most max_rows rows, hence broadcast; its match in the documents is collected up to the stated bytes.
    taken = slim(docs, id_col, text_col).join(F.broadcast(sample), F.col(f"`{id_col}`") == F.col("k")).select("k", "y", F.col(f"`{text_col}`").alias("t"))
    texts, y, size = [], [], 0
    for r in sorted(taken.orderBy(F.xxhash64(F.col("k").cast("string"))).limit(max_rows).toLocalIterator(), key=lambda r: (str(r["k"]), r["y"])):
        raw = (r["t"] or "").encode()
        if size + len(raw) <= max_text_bytes:
            texts.append(raw)
            y.append(r["y"])
            size += len(raw)
    model = fit(texts, np.array(y))
    ones, zeros = sum(y), len(y) - sum(y)
    if ones and zeros and all(shares.values()):
        model.bias += float(np.log(shares.get(1, 1) / shares.get(0, 1)) - np.log(ones / zeros))
    return model


def classify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    ids = docs.schema[id_col].dataType
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            p = scores(as_bytes(batch.column(1)), shared.value)
            held = [py_crc_mod(i, folds) == 0 for i in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.bool_()), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return slim(docs, id_col, text_col).mapInArrow(run, f"doc_id {ids.simpleString()}, held_out boolean, score double, predicted int")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return classify(docs, train(docs, read_table(spark, sf_dir, "labels")))
