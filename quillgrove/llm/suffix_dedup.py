"""Suffix-array dedup: repeated byte strings by bounded interval expansion on a Burrows-Wheeler transform.

A byte goes if a string of `length` bytes that covers it also starts anywhere else.

The corpus is cut so that equal strings meet. Every string has an anchor: the leftmost
smallest hash among its `GRAM`-byte substrings, a function of its content. Consecutive strings with
one anchor make a stretch; it is split in classes by distance from the anchor, and all strings
of a class share a core of at least `length - CLASS + 1` bytes.

Texts are shuffled to blocks by hash of id and text. Three rounds of messages follow:

1. Each block sends the hashes of its cores; they are added up, and each block gets
   back those that occur twice or more. Other strings can't be repeated.
2. Each block sends the remaining stretches, equal ones once with all their places, dealt by anchor.
   In a task the stretches become one text; its suffixes are sorted by prefix doubling and
   give its Burrows-Wheeler transform. The boundaries that doubling knows at its last length below `length`
   are the first intervals; breadth-first backward extension finds the boundaries with a common prefix
   of one byte more in each turn and stops at `length`: where no boundary was found,
   neighbours share `length` bytes or more.
3. Each block gets the places of the repeated strings, and merges what they cover.

Anchors that more than `CROWD` stretches have would gather in one task. Their strings take another exact
way: each block sends the set of their hashes, and gets back those that occur twice.

Defined cases: null and empty texts and texts shorter than `length` lose nothing; rows with one
id are texts of their own; a null id is kept; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_blocks, keyed, pack_array, pack_keys, read_table, total_bytes, unpack_array, unpack_keys
from .textvec import U, Piece, as_bytes, mix, pieces

LENGTH, GRAM, CLASS, CROWD = 400, 32, 47, 2000
BLOCK_BYTES, TASK_BYTES, RANGE = 6 << 20, 1 << 21, 3_000_000
FIRST = 7  # symbols of nine bits in one number
PLACE = U((1 << 28) - 1)
NO_KEYS = np.zeros(0, U)
SENT = pa.schema([("dest", pa.int32()), ("block", pa.int32()), ("kind", pa.string()), ("keys", pa.binary()), ("more", pa.binary())])
BACK = pa.schema([("block", pa.int32()), ("kind", pa.string()), ("keys", pa.binary()), ("more", pa.binary())])
SENT_DDL, BACK_DDL = "dest int, block int, kind string, keys binary, more binary", "block int, kind string, keys binary, more binary"


def rows(table: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*table, strict=True)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


class Stretches:
    """Anchors of a piece and their classes: anchor key and row; class core key, first and last start."""

    def __init__(self, piece: Piece, length: int) -> None:
        data, n = piece.data, len(piece.data)
        self.prefix = piece.prefix()
        empty = np.zeros(0, np.int64)
        self.row, self.anchor_key, self.of, self.key, self.low, self.high = empty, NO_KEYS, empty, NO_KEYS, empty, empty
        if not (piece.row_end - piece.row_start >= length).any():
            return
        gram = piece.hashes(self.prefix, np.arange(n - GRAM + 1), np.arange(GRAM, n + 1))
        least = (gram & ~PLACE) | np.arange(len(gram)).astype(U)
        span, reach = length - GRAM + 1, 1
        while reach * 2 <= span:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if span > reach:
            least = np.minimum(least[: len(least) - (span - reach)], least[span - reach :])
        turn = np.zeros(n + 1, np.int8)
        long = piece.row_end - piece.row_start >= length
        turn[piece.row_start[long]] += 1
        turn[piece.row_end[long] - length + 1] -= 1
        start = np.flatnonzero(np.cumsum(turn[:-1], dtype=np.int8))
        anchor = (least[start] & PLACE).astype(np.int64)
        first = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(start, prepend=-2) != 1))
        low, high, anchor = start[first], start[np.append(first[1:], len(start)) - 1], anchor[first]
        self.row = np.searchsorted(piece.row_start, low, side="right") - 1
        self.anchor_key = mix(gram[anchor] ^ U(0x51C64B5E2A7F3D11))
        near, far = (anchor - high) // CLASS, (anchor - low) // CLASS
        self.of = np.repeat(np.arange(len(low)), far - near + 1)
        within = np.arange(len(self.of)) - np.repeat(np.cumsum(far - near + 1) - (far - near + 1), far - near + 1)
        step = np.repeat(far, far - near + 1) - within  # starts ascend as distance falls
        a = anchor[self.of]
        self.low = np.maximum(low[self.of], a - step * CLASS - CLASS + 1)
        self.high = np.minimum(high[self.of], a - step * CLASS)
        core = a - step * CLASS
        self.key = mix(piece.hashes(self.prefix, core, core + length - CLASS + 1) + gram[a] * U(3) + step.astype(U))

    def kept(self, twice: np.ndarray, crowded: np.ndarray) -> tuple[np.ndarray, ...]:
        """Row, anchor key, first and last start of each run of classes whose cores occur twice, and whether its anchor is crowded."""
        ok = found(twice, self.key)
        of, low, high = self.of[ok], self.low[ok], self.high[ok]
        new = np.ones(len(of), bool)
        new[1:] = (of[1:] != of[:-1]) | (low[1:] != high[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(of))[: len(first)] - 1
        of = of[first]
        return self.row[of], self.anchor_key[of], low[first], high[last], found(crowded, self.anchor_key[of])


def found(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted), bool)
    return keys[np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)] == wanted


def windows(piece: Piece, s: Stretches, low: np.ndarray, high: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Every start of the stretches, and the hash of the string there."""
    n = high - low + 1
    start = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return start, piece.hashes(s.prefix, start, start + length)


# -- adding up hashes over blocks ----------------------------------------------------


def send_counts(kind: str, block: int, keys: np.ndarray, dests: int, shift: int = 0) -> Iterator[tuple]:
    """The sorted keys of a block with their numbers, cut by hash range."""
    own, n = np.unique(keys, return_counts=True)
    n = np.minimum(n, 65535).astype("<u2")
    dealt = ((own >> U(32)) * U(dests) >> U(32)).astype(np.int64)
    edge = np.append(np.flatnonzero(np.diff(dealt, prepend=-1)), len(own))
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        yield shift + int(dealt[a]), block, kind, pack_keys(own[a:b]), pack_array(n[a:b])


def add_up(table: pa.Table, crowd: int) -> list[tuple]:
    """To each block those of its keys that occur twice or more in all; anchors only if more often than `crowd`; its own notes as they are."""
    out = []
    for kind in ("core", "anchor", "string"):
        part = table.filter(pa.compute.equal(table["kind"], kind))
        if not part.num_rows:
            continue
        sets = [unpack_keys(b) for b in part["keys"].to_pylist()]
        keys, n = np.concatenate(sets), np.concatenate([unpack_array(b, "<u2") for b in part["more"].to_pylist()])
        unique, inverse = np.unique(keys, return_inverse=True)
        often = np.bincount(inverse, weights=n, minlength=len(unique))[inverse] >= (crowd + 1 if kind == "anchor" else 2)
        at = 0
        for b, s in zip(part["block"].to_pylist(), sets, strict=True):
            again = s[often[at : at + len(s)]]
            at += len(s)
            if len(again):
                out.append((b, kind, pack_keys(again), b""))
    part = table.filter(pa.compute.equal(table["kind"], "crowded"))
    return out + list(zip(*[part[c].to_pylist() for c in ("block", "kind", "keys", "more")], strict=True))


def told(table: pa.Table, kind: str) -> np.ndarray:
    blobs = table.filter(pa.compute.equal(table["kind"], kind))["keys"].to_pylist()
    return np.unique(np.concatenate([unpack_keys(b) for b in blobs])) if blobs else NO_KEYS


# -- the transform -----------------------------------------------------------------


def suffix_order(symbol: np.ndarray, left: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Suffixes sorted by at least their first `length` symbols, each one's rank, and where the first `base` symbols begin to differ.

    `left` is how many symbols are left before the text's separator (0), where a suffix ends.
    `base` is the last length below `length` that doubling passes.
    """
    n = len(symbol)
    key = np.zeros(n, U)
    padded = np.append(symbol, np.zeros(FIRST, symbol.dtype)).astype(U)
    for j in range(FIRST):
        key = key << U(9) | np.where(left > j, padded[j : j + n], U(0))
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    new = np.ones(n, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    known, base, early = FIRST, FIRST, new.copy()
    while known < length:
        base, early = known, new.copy()
        single = new & np.append(new[1:], True)
        open_ = np.flatnonzero(~single)
        open_ = open_[left[order[open_]] > known]
        if not len(open_):
            break
        # Suffixes that end within the known symbols can only stand first in their group.
        at = order[open_]
        pair = rank[at].astype(U) << U(32) | np.where(left[at] > known, rank[np.minimum(at + known, n - 1)] + 1, 0).astype(U)
        by = np.argsort(pair, kind="stable")
        at, pair = at[by], pair[by]
        group = (pair >> U(32)).astype(np.int64)
        begin = np.flatnonzero(np.diff(group, prepend=-1))
        size = np.diff(np.append(begin, len(group)))
        ends = np.append(np.flatnonzero(new)[1:], n)[np.searchsorted(np.flatnonzero(new), group[begin])]
        # Those that ended keep the front places of the group, the others follow in their new order.
        place = np.repeat(ends - size, size) + np.arange(len(at)) - np.repeat(begin, size)
        fronts = np.flatnonzero(~single)
        ended = order[fronts][left[order[fronts]] <= known]
        if len(ended):
            g = rank[ended]
            o = np.argsort(g, kind="stable")
            g, ended = g[o], ended[o]
            b = np.flatnonzero(np.diff(g, prepend=-1))
            order[g + np.arange(len(g)) - np.repeat(b, np.diff(np.append(b, len(g))))] = ended
        order[place] = at
        fresh = np.ones(len(at), bool)
        fresh[1:] = pair[1:] != pair[:-1]
        new[place[fresh]] = True
        rank[at] = np.maximum.accumulate(np.where(fresh, place, 0))
        known *= 2
    rank[order] = np.arange(n)
    return order, rank, early, base


def boundaries(symbol: np.ndarray, order: np.ndarray, rank: np.ndarray, early: np.ndarray, base: int, left: np.ndarray, length: int) -> np.ndarray:
    """Whether the suffixes before and at each place share fewer than `length` symbols.

    Breadth first: the intervals of all strings of one length give those of strings one
    symbol longer at the front; an interval goes on only if one of its ends is new.
    """
    n = len(symbol)
    edge = np.append(early, True)
    low = np.flatnonzero(edge)[:-1]
    high = np.flatnonzero(edge)[1:]
    whole = left[order[low]] >= base
    low, high = low[whole], high[whole]
    before = symbol[order - 1]  # the transform; the first suffix has a separator before it
    back = np.where(before > 0, rank[order - 1], -1)
    head = symbol[order]
    owner = np.full(n + 2, -1, np.int32)
    for _ in range(base, length):
        if not len(low):
            break
        width = high - low
        place = np.repeat(low - (np.cumsum(width) - width), width) + np.arange(width.sum())
        to = back[place]
        ok = to >= 0
        to, own = to[ok], np.repeat(np.arange(len(low), dtype=np.int32), width)[ok]
        owner[to + 1] = own
        starts = to[(owner[to] != own) | (head[to - 1] != head[to])]
        after = np.minimum(to + 1, n - 1)
        ends = to[(owner[to + 2 - (to + 1 >= n)] != own) | (head[after] != head[to]) | (to + 1 >= n)] + 1
        owner[to + 1] = -1
        starts.sort()
        ends.sort()
        fresh = ~(edge[starts] & edge[ends])
        low, high = starts[fresh], ends[fresh]
        edge[low] = True
        edge[high] = True
    return edge


def repeated(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text, whether the string of `length` bytes at each start is anywhere else in the texts."""
    sizes = np.array([len(t) for t in texts])
    data = np.frombuffer(b"\0" + b"\0".join(texts) + b"\0", np.uint8)
    begin = np.cumsum(np.append(1, sizes[:-1] + 1))
    symbol = data.astype(np.int16) + 1
    symbol[0] = symbol[-1] = 0
    symbol[begin - 1] = 0
    left = np.zeros(len(data), np.int64)
    stop = np.repeat(begin + sizes, sizes + 1)
    left[1:] = stop - np.arange(1, len(data))
    order, rank, early, base = suffix_order(symbol, left, length)
    edge = boundaries(symbol, order, rank, early, base, left, length)
    valid = left[order] >= length
    again = np.zeros(len(data), bool)
    joined = np.flatnonzero(~edge[1:-1] & valid[1:] & valid[:-1]) + 1
    again[order[joined]] = True
    again[order[joined - 1]] = True
    return [again[b : b + max(0, s - length + 1)] for b, s in zip(begin, sizes, strict=True)]


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    turn = np.diff(mask.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    return np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)


def blobs(parts: list[bytes]) -> bytes:
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def parts_of(blob: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(blob):
        n = int.from_bytes(blob[at : at + 4], "little")
        out.append(blob[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def pack_stretches(items: list[tuple[int, int, list[tuple[int, int]], bytes]]) -> tuple[bytes, bytes]:
    """(hash, anchor key, places as row and start, text), by ascending hash."""
    items = sorted(items)
    h, g = (np.array([x[i] for x in items], U) for i in range(2))
    n, size = (np.array([len(x[i]) for x in items], "<u4") for i in (2, 3))
    row, start = (np.array([p[i] for x in items for p in x[2]], "<u4") for i in range(2))
    return pack_keys(h), blobs([pack_array(g), *map(pack_array, (n, size, row, start)), pack_array(np.frombuffer(b"".join(x[3] for x in items), np.uint8))])


def meet(table: pa.Table, length: int, task_bytes: int) -> list[tuple]:
    """Of the stretches in one task: to each block what the repeated strings cover there, as row, start and end."""
    number: dict[int, int] = {}
    text: dict[int, tuple[int, bytes]] = {}
    senders: list[tuple] = []
    for b, keys, more in zip(*[table[c].to_pylist() for c in ("block", "keys", "more")], strict=True):
        g, n, size, row, start, data = parts_of(more)
        own, n, end, data = unpack_keys(keys).tolist(), unpack_array(n, "<u4"), np.cumsum(unpack_array(size, "<u4")).tolist(), unpack_array(data, "u1").tobytes()
        for h, anchor, m, x, y in zip(own, unpack_array(g, "<u8").tolist(), n.tolist(), [0, *end], end, strict=False):
            number[h] = number.get(h, 0) + m
            if h not in text:
                text[h] = (anchor, data[x:y])
        senders.append((b, own, n, row, start))
    spans: dict[int, np.ndarray] = {}
    some: list[int] = []
    size = 0
    ordered = sorted(text, key=lambda h: (text[h][0], h))
    for i, h in enumerate(ordered):
        some.append(h)
        size += len(text[h][1]) + 1
        full = size >= task_bytes and i + 1 < len(ordered) and text[ordered[i + 1]][0] != text[h][0]
        if not full and i + 1 < len(ordered):
            continue
        for k, mask in zip(some, repeated([text[k][1] for k in some], length), strict=True):
            if number[k] > 1:  # a stretch that is there twice has the weight of two
                mask = np.ones(len(mask), bool)
            a, b = runs(mask)
            if len(a):
                spans[k] = np.stack([a, b - 1 + length], axis=1)
        some, size = [], 0
    none = np.zeros((0, 2), np.int64)
    out = []
    for b, own, n, row, start in senders:
        found = [spans.get(k, none) for k in own]
        place = np.stack([unpack_array(row, "<u4"), unpack_array(start, "<u4")], axis=1).astype(np.int64)
        of = np.repeat(np.arange(len(own)), n)
        per = np.array([len(f) for f in found], np.int64)
        # Each place of a stretch has each of its spans.
        times = per[of]
        if not times.sum():
            continue
        flat, first = np.concatenate(found), np.cumsum(per) - per
        which = np.repeat(first[of] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        covered = np.repeat(place[:, 1], times)[:, None] + flat[which]
        out.append((b, "span", b"", blobs([pack_array(x.astype("<u4")) for x in (np.repeat(place[:, 0], times), covered[:, 0], covered[:, 1])])))
    return out


# -- the operator -------------------------------------------------------------------


def in_order(table: pa.Table) -> tuple[list, list[bytes]]:
    """Ids and texts of a block, the same order whenever it is read; only equal rows change places."""
    ids, texts = table["doc_id"].to_pylist(), as_bytes(table["text"])
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
    return [ids[i] for i in order], [texts[i] for i in order]


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, block_bytes: int = BLOCK_BYTES, task_bytes: int = TASK_BYTES, range_keys: int = RANGE, crowd: int = CROWD, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document; with_text adds `kept` (binary)."""
    if length < GRAM + CLASS:
        raise ValueError(f"strings have at least {GRAM + CLASS} bytes")
    base = keyed(docs, id_col, text_col)
    total = total_bytes(base)
    blocked = hash_blocks(base, total, block_bytes).select("doc_id", "text", "block")
    ranges, tasks = max(1, -(-total // (32 * range_keys))), max(1, -(-total // (4 * task_bytes)))

    def cores(key: tuple, table: pa.Table) -> pa.Table:
        held = [Stretches(piece, length) for piece in pieces(in_order(table)[1])]
        block = int(key[0].as_py())
        sent = [r for kind, keys in (("core", [s.key for s in held]), ("anchor", [s.anchor_key for s in held])) for r in send_counts(kind, block, np.concatenate([NO_KEYS, *keys]), ranges)]
        return pa.Table.from_batches([rows(sent, SENT)])

    def sums(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([rows(add_up(table, crowd), BACK)])

    def stretches(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        twice, crowded, block = told(right, "core"), told(right, "anchor"), int(key[0].as_py())
        held: dict[int, list] = {}
        strings, notes = [NO_KEYS], [np.zeros((0, 3), np.int64)]
        for piece in pieces(in_order(left)[1]) if len(twice) else ():
            s = Stretches(piece, length)
            row, g, low, high, crush = s.kept(twice, crowded)
            start = low - piece.row_start[row]
            row = row + piece.first
            strings.append(windows(piece, s, low[crush], high[crush], length)[1])
            notes.append(np.stack([row[crush], start[crush], (high - low)[crush]], axis=1))
            row, start, g, low, high = (x[~crush] for x in (row, start, g, low, high))
            h = piece.hashes(s.prefix, low, high + length)
            for k, a, r, o, x, y in zip(*(v.tolist() for v in (h, g, row, start, low, high + length)), strict=True):
                if k in held:
                    held[k][2].append((r, o))
                else:
                    held[k] = [k, a, [(r, o)], piece.data[x:y].tobytes()]
        dealt: dict[int, list] = {}
        for item in held.values():
            dealt.setdefault((item[1] >> 32) * tasks >> 32, []).append(tuple(item))
        sent = [(d, block, "stretch", *pack_stretches(items)) for d, items in dealt.items()]
        string = np.concatenate(strings)
        if len(string):
            sent += send_counts("string", block, string, ranges, tasks)
            sent.append((tasks + block % ranges, block, "crowded", b"", blobs([pack_array(x.astype("<u4")) for x in np.concatenate(notes).T])))
        return pa.Table.from_batches([rows(sent, SENT)])

    def settle(table: pa.Table) -> pa.Table:
        own = table.filter(pa.compute.equal(table["kind"], "stretch"))
        return pa.Table.from_batches([rows(meet(own, length, task_bytes) if own.num_rows else add_up(table, crowd), BACK)])

    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), *([("kept", pa.binary())] if with_text else [])])

    def finish(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = lambda k: [parts_of(m) for m in right.filter(pa.compute.equal(right["kind"], k))["more"].to_pylist()]
        spans = [np.stack([unpack_array(x, "<u4") for x in p], axis=1).astype(np.int64) for p in kinds("span")]
        row, start, end = np.concatenate([np.zeros((0, 3), np.int64), *spans]).T
        crowded = np.concatenate([np.zeros((0, 3), np.int64), *(np.stack([unpack_array(x, "<u4") for x in p], axis=1).astype(np.int64) for p in kinds("crowded"))])
        string = told(right, "string")
        ids, texts = in_order(left)
        out = []
        for piece in pieces(texts):
            turn = np.zeros(len(piece.data) + 1, np.int32)
            own = (row >= piece.first) & (row < piece.first + len(piece.texts))
            at = piece.row_start[row[own] - piece.first]
            np.add.at(turn, at + start[own], 1)
            np.add.at(turn, at + end[own], -1)
            own = crowded[(crowded[:, 0] >= piece.first) & (crowded[:, 0] < piece.first + len(piece.texts))] if len(string) else crowded[:0]
            if len(own):
                low = piece.row_start[own[:, 0] - piece.first] + own[:, 1]
                n = own[:, 2] + 1
                begin = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
                begin = begin[found(string, piece.hashes(piece.prefix(), begin, begin + length))]
                np.add.at(turn, begin, 1)
                np.add.at(turn, begin + length, -1)
            gone = np.cumsum(turn[:-1]) > 0
            for k, text in enumerate(piece.texts):
                drop = gone[piece.row_start[k] : piece.row_end[k]]
                kept = piece.data[piece.row_start[k] : piece.row_end[k]][~drop].tobytes() if drop.any() else text
                out.append((ids[piece.first + k], len(text), int(drop.sum()), len(runs(drop)[0]), hashlib.sha256(kept).hexdigest(), *([kept] if with_text else [])))
        return pa.Table.from_batches([rows(out, schema)])

    # All three uses of the blocks read one exchange of texts.
    twice = blocked.groupBy("block").applyInArrow(cores, SENT_DDL).groupBy("dest").applyInArrow(sums, BACK_DDL)
    sent = blocked.groupBy("block").cogroup(twice.groupBy("block")).applyInArrow(stretches, SENT_DDL)
    back = sent.groupBy("dest").applyInArrow(settle, BACK_DDL)
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    return blocked.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(finish, ddl)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(read_table(spark, sf_dir, "documents"))
