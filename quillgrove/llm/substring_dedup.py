"""Substring dedup: Rabin-Karp hashes of every window of a fixed number of words.

1. Texts are shuffled to blocks in order of id. A block sends the sorted set of the hashes of
   its windows, dealt by hash range, about five bytes a hash.
2. For each hash range Spark brings the sets together; a hash that is in more than one
   block is sent back to every block but the lowest, which holds the smallest ids.
3. Each block hashes its texts again: a window is a repeat if its hash was sent back or a
   smaller id of the same block has it. Overlapping repeated windows merge into
   maximal intervals, whose words go.

A frequent window is one entry for each block that has it, so no task sees it once for each
document. Hashes have 64 bits.

Defined cases: null and empty texts have no words; texts shorter than a window lose nothing;
rows with one id are one document's parts and don't remove each other's windows, however many
blocks they fill; a null id comes after all others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LAST_ID, keyed, ordered_blocks, pack_keys, read_table, unpack_keys
from .textvec import U, Piece, as_bytes, pieces, window_hashes

WINDOW = 13
BLOCK_BYTES = 4 << 20
#: Hashes that one range has at most on average.
RANGE = 3_000_000
SENT = pa.schema([("range", pa.int32()), ("block", pa.int64()), ("place", pa.int64()), ("keys", pa.binary())])


def windows(piece: Piece, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window within a row, and the index of its first word in the piece."""
    piece.words()
    h, row = window_hashes(piece.word_hashes(), size), piece.row_of_word()
    at = np.flatnonzero(row[: len(h)] == row[size - 1 :]) if len(h) else np.zeros(0, np.int64)
    return h[at], at


def ranges_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Where each of the n equal hash ranges begins in sorted keys; then their number."""
    marks = np.array([(k << 64) // n for k in range(1, n)], U)
    return np.concatenate([[0], np.searchsorted(keys, marks), [len(keys)]]).astype(np.int64)


def give_back(table: pa.Table) -> pa.Table:
    """Of one hash range: to each block the keys that a block of a lower place has too."""
    sent = sorted(zip(*[table[c].to_pylist() for c in ("place", "block", "keys")], strict=True), key=lambda r: r[:2])
    sets = [unpack_keys(r[2]) for r in sent]
    keys = np.concatenate(sets) if sets else np.zeros(0, U)
    of = np.repeat(np.arange(len(sent)), [len(s) for s in sets])
    place = np.array([r[0] for r in sent], np.int64)
    del sets
    order = np.argsort(keys, kind="stable")
    keys, of = keys[order], of[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    lowest = place[of[np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))]]
    again = np.flatnonzero(place[of] > lowest)
    order = again[np.argsort(of[again], kind="stable")]
    keys, of = keys[order], of[order]
    edge = np.append(np.flatnonzero(np.diff(of, prepend=-1)), len(of))
    found = [(sent[of[a]][1], pack_keys(keys[a:b])) for a, b in zip(edge[:-1], edge[1:], strict=True)]
    return pa.table({"block": pa.array([f[0] for f in found], pa.int64()), "keys": pa.array([f[1] for f in found], pa.binary())})


def removed(ids: list[int | None], texts: list[bytes], sent_back: np.ndarray, size: int) -> Iterator[tuple[int, Piece, np.ndarray]]:
    """For rows in ascending order of id: the piece and which of its words go."""
    rank = np.cumsum(np.append(0, [a != b for a, b in zip(ids[1:], ids[:-1], strict=True)])) if ids else np.zeros(0, int)
    keys, where, spans, at = [], [], [], 0
    for piece in pieces(texts):
        h, first = windows(piece, size)
        keys.append(h)
        where.append(rank[piece.first + piece.row_of_word()[first]] if len(first) else first)
        spans.append((at, at + len(h)))
        at += len(h)
    if not keys:
        return
    key, doc = np.concatenate(keys), np.concatenate(where)
    order = np.argsort(key, kind="stable")
    new = np.ones(len(key), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    smallest = np.empty(len(key), doc.dtype)
    smallest[order] = doc[order][np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
    again = doc > smallest
    if len(sent_back) and len(key):
        again |= sent_back[np.minimum(np.searchsorted(sent_back, key), len(sent_back) - 1)] == key
    for piece, (a, b) in zip(pieces(texts), spans, strict=True):
        _, first = windows(piece, size)
        first = first[again[a:b]]
        turn = np.zeros(len(piece.start) + 1, np.int32)
        np.add.at(turn, first, 1)
        np.add.at(turn, first + size, -1)
        yield piece.first, piece, np.cumsum(turn)[:-1] > 0


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document; with_text adds `kept_text` and `spans` (first and end word of each removed interval)."""
    blocked, total = ordered_blocks(keyed(docs, id_col, text_col), block_bytes)
    blocked = blocked.select("doc_id", "text", "block", "place")
    n_ranges = max(1, -(-total // (6 * RANGE)))

    def collect(key: tuple, table: pa.Table) -> pa.Table:
        own = np.unique(np.concatenate([np.zeros(0, U), *[windows(piece, window)[0] for piece in pieces(as_bytes(table["text"]))]]))
        cut = ranges_of(own, n_ranges)
        place = table["place"][0].as_py()
        sent = [(r, key[0].as_py(), place, pack_keys(own[cut[r] : cut[r + 1]])) for r in np.flatnonzero(np.diff(cut)).tolist()]
        return pa.Table.from_arrays([pa.array([x[i] for x in sent], f.type) for i, f in enumerate(SENT)], schema=SENT)

    def finish(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        ids = left["doc_id"].to_pylist()
        texts = as_bytes(left["text"])
        order = sorted(range(len(ids)), key=lambda i: LAST_ID if ids[i] is None else ids[i])
        ids, texts = [ids[i] for i in order], [texts[i] for i in order]
        sent_back = np.sort(np.concatenate([unpack_keys(b) for b in right["keys"].to_pylist()] or [np.zeros(0, U)]))
        out: list[tuple] = []
        for first, piece, gone in removed(ids, texts, sent_back, window):
            for k, text in enumerate(piece.texts):
                a, b = piece.word_start[k], piece.word_start[k + 1]
                drop, words = gone[a:b], text.split()
                kept = b" ".join(compress(words, (~drop).tolist()) if drop.any() else words)
                row = (ids[first + k], len(words), int(drop.sum()), hashlib.sha256(kept).hexdigest())
                if with_text:
                    turn = np.diff(drop.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
                    row += (kept.decode("utf-8", "replace"), [{"start": int(x), "end": int(y)} for x, y in zip(np.flatnonzero(turn == 1), np.flatnonzero(turn == -1), strict=True)])
                out.append(row)
        return pa.Table.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
    ddl = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    if with_text:
        schema = schema.append(pa.field("kept_text", pa.string())).append(pa.field("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))))
        ddl += ", kept_text string, spans array<struct<start:int,end:int>>"
    # Both uses of the blocks read one exchange of texts.
    sent = blocked.groupBy("block").applyInArrow(collect, "range int, block long, place long, keys binary")
    back = sent.groupBy("range").applyInArrow(give_back, "block long, keys binary")
    return blocked.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(finish, ddl)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(read_table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), p AS (
  SELECT doc_id, words, unnest(range(1, greatest(len(words) - 11, 1))) AS i FROM w
), k AS (
  SELECT doc_id, i, array_to_string(words[i : i + 12], ' ') AS win FROM p
), f AS (
  SELECT win, min(doc_id) AS first_doc FROM k GROUP BY win HAVING min(doc_id) < max(doc_id)
), r AS (
  SELECT k.doc_id, list_distinct(flatten(list(range(k.i, k.i + 13)))) AS gone FROM k JOIN f USING (win) WHERE k.doc_id > f.first_doc GROUP BY k.doc_id
)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(coalesce(len(r.gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN r.gone IS NULL THEN w.words ELSE list_transform(list_filter(list_transform(w.words, lambda x, j: {'w': x, 'j': j}), lambda s: NOT list_contains(r.gone, s.j)), lambda s: s.w) END, ' ')) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id)
"""
