"""LM scoring with a hierarchical Pitman-Yor model over words.

Restaurants: one for each word (and the end mark) that stands before a token in training, and one parent
that they share. A token is a customer in the restaurant of the word before it; the first customer of each table is a
customer of the parent too, whose base is uniform over the known words and one unknown.

Documents are shuffled to blocks by hash; blocks, ranges of pairs and ranges of words exchange messages:

1. A block sends its distinct (word, word before) pairs with their training counts, by hash of the pair,
   and its words with theirs, by hash of the word. Ranges add them up; no word gathers its pairs in one task.
2. Seating starts with one table for each pair. In a round, ranges of words add up the tables of each word
   as a dish (the parent's customers) and as a restaurant, seat the parent's customers, and tell the
   ranges of pairs; these take the customers of each dish out and seat them again, given all others.
   Totals are exact when a round begins, and stay as they are while it lasts. The last round draws
   `KEEP` seatings, whose tables are averaged.
3. Ranges tell each block what it asked for, in the order in which it asked, and the block scores its texts with
   the predictive probabilities of the averaged seating.

Seating a dish is a blocked Gibbs step: the number of tables of `c` customers has the exact conditional
weights S(c, t) * (strength + discount * tables) * ... * (parent's probability of each new customer) with
generalised Stirling numbers S, up to `EXACT` customers. What a dish has beyond them joins in doubling groups by
the expected number of new tables, rounded at random: a step for each would be as long as the largest count.
Random numbers come from hashes of pair, round and draw, so results don't depend on how rows are dealt.
Discounts are estimated from all counts (n1 / (n1 + 2 n2), of pairs and of the parent's first customers).

Defined cases: null texts are empty and have the end only; unknown words share one unseen word's
probability; rows with one id are rows each; without training documents every token
is unknown; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_blocks, keyed, pack_array, pack_keys, packed, py_crc_mod, read_table, total_bytes, unpack_array, unpack_keys, unpacked
from .textvec import U, Piece, mix, pieces

FOLDS, HELD_FOLD = 7, 2
ROUNDS, KEEP, EXACT = 2, 4, 64
STRENGTH = (5.0, 1.0)  # of contexts, of the parent
BLOCK_BYTES, RANGE_BYTES, WORD_RANGES = 10 << 20, 32 << 20, 4
#: Words are told apart by hashes of 56 bits, pairs by 64.
WORD_BITS, LOW, PAIR_LOW = 56, 4, 5
END = U(0x5EED0FE2D0FD0C)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
NO_KEYS = np.zeros(0, U)


def tokens(piece: Piece) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of each row and its end; where each row begins, then their number."""
    piece.data = LOWER[piece.data]
    piece.words()
    found = np.insert(piece.word_hashes() >> U(64 - WORD_BITS), piece.word_start[1:], END)
    return found, piece.word_start + np.arange(len(piece.word_start))


def pair_keys(word: np.ndarray, before: np.ndarray) -> np.ndarray:
    return mix(word + mix(before ^ U(0x2545F4914F6CDD1D)) * U(0xA0761D6478BD642F))


def dealt(keys: np.ndarray, n: int, bits: int = WORD_BITS) -> np.ndarray:
    """Which of n equal ranges each hash is in."""
    return ((keys >> U(bits - 32)) * U(n) >> U(32)).astype(np.int64)


def uniform(keys: np.ndarray, turn: int) -> np.ndarray:
    """Numbers in [0, 1) that only the key and the turn decide."""
    return (mix(keys ^ mix(np.full(1, turn + 1, U) * U(0x9E3779B97F4A7C15))) >> U(11)).astype(np.float64) / float(1 << 53)


# -- seating ---------------------------------------------------------------------------


def stirling(discount: float, most: int = EXACT) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers S(c, t), rows by c."""
    s = np.zeros((most + 1, most + 1))
    s[0, 0] = 1.0
    for c in range(most):
        s[c + 1, 1:] = s[c, :-1] + (c - discount * np.arange(1, most + 1)) * s[c, 1:]
        s[c + 1, c + 2 :] = 0.0
    with np.errstate(divide="ignore"):
        return np.log(np.maximum(s, 0.0))


@dataclass
class Others:
    """What a dish meets: tables of its restaurant, and the parent's customers and tables of the dish, all without its own."""

    tables: np.ndarray
    customers: np.ndarray
    parent_tables: np.ndarray


def parent_weight(others: Others, at: np.ndarray, i: np.ndarray, discount: float, total: float, rest: float) -> np.ndarray:
    """Probability that the parent gives a dish when `i` of its customers here are there already; a dish without others opens a table first."""
    customers, tables = others.customers[at, None], others.parent_tables[at, None]
    held = np.where(customers > 0, tables, np.minimum(i, 1.0))
    return np.maximum(customers + i - discount * held, 0.0) / total + rest


def seat(customers: np.ndarray, keys: np.ndarray, turn: int, strength: float, discount: float, others: Others, parent, log_s: np.ndarray) -> np.ndarray:
    """Tables of each dish, drawn given everything else. parent(at, i): probability of the dish for its i-th new table, for the dishes `at`."""
    out = np.minimum(customers, 1).astype(np.float64)
    u = uniform(keys, turn)
    head = np.minimum(customers, EXACT)
    order = np.argsort(head, kind="stable")
    edge = np.searchsorted(head[order], np.arange(2, EXACT + 2))
    for c, a, b in zip(range(2, EXACT + 1), edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        for x in range(a, b, 1 << 16):
            at = order[x : min(b, x + (1 << 16))]
            i = np.arange(c, dtype=np.float64)[None, :]
            with np.errstate(divide="ignore"):
                steps = np.log(strength + discount * (others.tables[at, None] + i)) + np.log(parent(at, i))
            weight = np.cumsum(steps, axis=1) + log_s[c, 1 : c + 1]
            weight = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
            out[at] = 1 + (weight < u[at, None] * weight[:, -1:]).sum(axis=1)
    j = EXACT
    many = np.flatnonzero(customers > j)
    while len(many):
        some = np.minimum(customers[many] - j, j)
        fresh = (strength + discount * (others.tables[many] + out[many])) * parent(many, np.full((1, 1), 1.0))[:, 0]
        expected = some * fresh / (fresh + np.maximum(j + some / 2 - discount * out[many], 1.0))
        out[many] += np.minimum(np.floor(expected + uniform(keys[many], turn + 1000 * j)), some)
        j *= 2
        many = many[customers[many] > j]
    return out


@dataclass
class Totals:
    """Sums over all ranges."""

    n: float  # training tokens
    v: float  # known words
    customers: float  # of the parent
    tables: float  # of the parent
    discount: float  # of contexts
    parent_discount: float
    strength: float = STRENGTH[0]
    parent_strength: float = STRENGTH[1]

    @classmethod
    def of(cls, sums: list) -> Totals:
        n, v, customers, tables, once, twice, pairs_once, pairs_twice = (float(x or 0) for x in sums)
        rate = lambda a, b: min(0.95, max(0.05, a / (a + 2 * b))) if a else 0.5
        return cls(n, v, customers, tables, rate(pairs_once, pairs_twice), rate(once, twice))

    def rest(self) -> float:
        """What the parent keeps for any word, one unknown among them."""
        return (self.parent_strength + self.parent_discount * self.tables) / (self.parent_strength + self.customers) / (self.v + 1)

    def parent(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        return np.maximum(customers - self.parent_discount * tables, 0.0) / (self.parent_strength + self.customers) + self.rest()


def seat_pairs(customers: np.ndarray, keys: np.ndarray, tables: np.ndarray, restaurant: np.ndarray, dish: np.ndarray, dish_tables: np.ndarray, totals: Totals, turn: int, log_s: np.ndarray) -> np.ndarray:
    """New tables of pairs, from their present ones, all tables of their restaurants, and the parent's customers and tables of their words."""
    left = dish - tables
    others = Others(restaurant - tables, left, np.minimum(dish_tables, left))
    total, rest = totals.parent_strength + totals.customers, totals.rest()
    return seat(customers, keys, turn, totals.strength, totals.discount, others, lambda at, i: parent_weight(others, at, i, totals.parent_discount, total, rest), log_s)


def seat_parent(customers: np.ndarray, keys: np.ndarray, totals: Totals, turn: int, log_s: np.ndarray) -> np.ndarray:
    """Tables of the parent for each word, from its customers; a word's own tables are one at least, and so many are left out."""
    others = Others(np.full(len(keys), max(totals.tables - 1.0, 0.0)), customers, np.ones(len(keys)))
    return seat(np.rint(customers).astype(np.int64), keys, turn, totals.parent_strength, totals.parent_discount, others, lambda at, i: np.full((len(at), i.shape[1]), 1.0 / (totals.v + 1)), log_s)


# -- messages ----------------------------------------------------------------------------

SUMS = 8
MESSAGE = pa.schema([("dest", pa.int32()), ("src", pa.int32()), ("kind", pa.string()), ("data", pa.binary()), ("sums", pa.list_(pa.float64()))])
DDL = "dest int, src int, kind string, data binary, sums array<double>"


def dump(*arrays: np.ndarray, low: int = LOW) -> bytes:
    """Sorted keys first, then any arrays."""
    parts = [bytes([low]) + pack_keys(arrays[0], low), *(np.dtype(a.dtype).str.encode() + b":" + pack_array(a) for a in arrays[1:])]
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def load(blob: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(blob):
        n = int.from_bytes(blob[at : at + 4], "little")
        part = blob[at + 4 : at + 4 + n]
        kind, _, body = part.partition(b":") if out else (b"", b"", part)
        out.append(unpack_array(body, kind.decode()) if out else unpack_keys(part[1:], part[0]))
        at += 4 + n
    return out


def small(x: np.ndarray) -> np.ndarray:
    """Counts in as few bytes as they need."""
    top = int(x.max()) if len(x) else 0
    return x.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8")


class Box:
    """The messages of a task by kind, and those that it sends."""

    def __init__(self, *tables: pa.Table) -> None:
        self.held: dict[str, list[tuple[int, bytes]]] = {}
        self.sums: list | None = None
        for table in tables:
            for src, kind, data, sums in zip(*[table[c].to_pylist() for c in ("src", "kind", "data", "sums")], strict=True):
                self.held.setdefault(kind, []).append((src, data))
                self.sums = sums or self.sums
        for found in self.held.values():
            found.sort()
        self.out: list[tuple] = []

    def get(self, kind: str) -> list[tuple[int, list[np.ndarray]]]:
        return [(src, load(data)) for src, data in self.held.get(kind, ())]

    def send(self, dest: int, src: int, kind: str, *arrays: np.ndarray, low: int = LOW) -> None:
        self.out.append((dest, src, kind, dump(*arrays, low=low), None))

    def forward(self, dest: int, *kinds: str) -> None:
        self.out += [(dest, src, kind, data, None) for kind in kinds for src, data in self.held.get(kind, ())]

    def add(self, **sums: float) -> None:
        names = ("n", "v", "customers", "tables", "once", "twice", "pairs_once", "pairs_twice")
        self.out.append((-1, 0, "sums", b"", [float(sums.get(k, 0)) for k in names]))

    def table(self) -> pa.Table:
        columns = list(zip(*self.out, strict=True)) or [[] for _ in MESSAGE]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, MESSAGE, strict=True)], schema=MESSAGE)


@dataclass
class Book:
    """A block's tokens as indices of its words, and its distinct pairs."""

    ids: list
    held: np.ndarray  # by text
    begin: np.ndarray
    words: np.ndarray  # sorted hashes
    word: np.ndarray
    before: np.ndarray
    train: np.ndarray  # by token

    @classmethod
    def of(cls, chunks: list[bytes]) -> Book:
        ids, texts = unpacked(chunks)
        found, begin, n = [], [], 0
        for piece in pieces(texts):
            f, b = tokens(piece)
            found.append(f)
            begin.append(b[:-1] + n)
            n += len(f)
        held = np.array([py_crc_mod(i, FOLDS) == HELD_FOLD for i in ids], bool)
        starts = np.append(np.concatenate(begin), n)
        words, word = np.unique(np.concatenate(found), return_inverse=True)
        del found
        word = word.astype(np.int32)
        before = np.append(np.searchsorted(words, END), word[:-1]).astype(np.int32)  # a text begins after an end
        return cls(ids, held, starts, words, word, before, np.repeat(~held, np.diff(starts)))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word and word before of each distinct pair, by word; its training count; and the pair of each token."""
        codes, of = np.unique(self.word.astype(np.int64) * len(self.words) + self.before, return_inverse=True)
        of = of.astype(np.int32)
        word, before = np.divmod(codes, len(self.words))
        return word, before, np.bincount(of, weights=self.train, minlength=len(codes)).astype(np.int64), of


def tell(chunks: list[bytes], block: int, ranges: int, word_ranges: int, box: Box) -> None:
    """A block's pairs, by range of pairs, and its words, by range of words."""
    book = Book.of(chunks)
    word, before, count, _ = book.pairs()
    to = dealt(pair_keys(book.words[word], book.words[before]), ranges, 64)
    order = np.argsort(to, kind="stable")
    edge = np.searchsorted(to[order], np.arange(ranges + 1))
    for r in np.flatnonzero(np.diff(edge)).tolist():
        own = order[edge[r] : edge[r + 1]]
        used = np.unique(np.concatenate([word[own], before[own]]))
        # Entries are in order of their word: how many each word has says which word they are of.
        per = np.bincount(np.searchsorted(used, word[own]), minlength=len(used))
        box.send(r, block, "cell", book.words[used], small(per), small(np.searchsorted(used, before[own])), small(count[own]))
    n = np.bincount(book.word, weights=book.train, minlength=len(book.words)).astype(np.int64)
    edge = np.searchsorted(dealt(book.words, word_ranges), np.arange(word_ranges + 1))
    for q in np.flatnonzero(np.diff(edge)).tolist():
        box.send(ranges + q, block, "ask", book.words[edge[q] : edge[q + 1]], small(n[edge[q] : edge[q + 1]]))


def summed(found: list[tuple[int, list[np.ndarray]]], width: int) -> list[np.ndarray]:
    """Sorted keys of all messages and the sums of their arrays."""
    if not found:
        return [NO_KEYS, *[np.zeros(0)] * width]
    keys, of = np.unique(np.concatenate([x[0] for _, x in found]), return_inverse=True)
    return [keys, *(np.bincount(of, weights=np.concatenate([x[k + 1] for _, x in found]), minlength=len(keys)) for k in range(width))]


def by_range(box: Box, kind: str, keys: np.ndarray, ranges: int, word_ranges: int, src: int, *arrays: np.ndarray) -> None:
    edge = np.searchsorted(dealt(keys, word_ranges), np.arange(word_ranges + 1))
    for q in np.flatnonzero(np.diff(edge)).tolist():
        box.send(ranges + q, src, kind, keys[edge[q] : edge[q + 1]], *(a[edge[q] : edge[q + 1]] for a in arrays))


def cells(box: Box) -> tuple[list[int], list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Blocks and sizes of the cells; hash, word, word before and count of their entries in turn."""
    found = box.get("cell")
    word = np.concatenate([NO_KEYS, *(np.repeat(x[0], x[1]) for _, x in found)])
    before = np.concatenate([NO_KEYS, *(x[0][x[2]] for _, x in found)])
    count = np.concatenate([np.zeros(0, np.int64), *(x[3].astype(np.int64) for _, x in found)])
    return [b for b, _ in found], [len(x[2]) for _, x in found], pair_keys(word, before), word, before, count


def build(dest: int, box: Box, ranges: int, word_ranges: int) -> None:
    """Adds up pairs or words; seating begins with one table for each pair."""
    if dest >= ranges:
        keys, n = summed(box.get("ask"), 1)
        box.send(dest, 0, "words", keys[n > 0], small(n[n > 0]))
        return
    _, _, h, word, before, count = cells(box)
    keys, first, of = np.unique(h, return_index=True, return_inverse=True)
    c = np.bincount(of, weights=count, minlength=len(keys)).astype(np.int64)
    word, before = word[first], before[first]
    known = c > 0
    used, at = np.unique(np.concatenate([word[known], before[known]]), return_inverse=True)
    half = known.sum()
    dishes, tables = np.bincount(at[:half], minlength=len(used)), np.bincount(at[half:], minlength=len(used))
    many = np.flatnonzero(c > 1)
    seen, at = np.unique(np.concatenate([word[many], before[many]]), return_inverse=True)
    by_range(box, "first", used, ranges, word_ranges, dest, small(dishes), small(tables), np.isin(used, seen, assume_unique=True).astype("<u1"))
    used = seen
    box.send(dest, 0, "seats", used, small(at[: len(many)]), small(at[len(many) :]), small(c[many]), np.ones(len(many), "<u1"))
    box.out.append((dest, 0, "pair sums", dump(NO_KEYS, np.array([(c == 1).sum(), (c == 2).sum()], "<f8")), None))


def add_up(dest: int, box: Box, ranges: int, turn: int, last: bool) -> None:
    """Words: customers and tables of all; after a round the parent is seated anew. Told to the ranges of pairs, or kept at the end."""
    if dest < ranges:
        box.forward(dest, "mean")
        for _, (_, x) in box.get("pair sums"):
            box.add(pairs_once=x[0], pairs_twice=x[1])
        return
    (_, (keys, n)), *_ = box.get("words")
    first = box.get("first")
    # What a range of pairs hears of later are the words that it marked, in their order; they aren't named again.
    marked = {src: x[0][x[3] > 0] for src, x in first}
    f = summed(first, 2)
    dish, tables, parent = np.zeros(len(keys)), np.zeros(len(keys)), np.ones(len(keys))
    at = np.searchsorted(keys, f[0])
    dish[at], tables[at] = f[1], f[2]
    if turn:
        f = summed([(src, [marked[src], *x[1:]]) for src, x in box.get("more")], 2)
        at = np.searchsorted(keys, f[0])
        dish[at] += f[1]
        tables[at] += f[2]
        totals = Totals.of(box.sums)
        parent = seat_parent(dish, keys, totals, 5000 + turn, stirling(totals.parent_discount))
    if last:
        box.send(dest, 0, "words", keys, small(n), small(parent), dish.astype("<f4"), tables.astype("<f4"))
    else:
        for src, asked in marked.items():
            at = np.searchsorted(keys, asked)
            box.send(src, dest, "told", NO_KEYS, small(tables[at]), small(dish[at]), small(parent[at]))
    box.add(n=n.sum(), v=len(keys), customers=dish.sum(), tables=parent.sum(), once=(np.rint(dish) == 1).sum(), twice=(np.rint(dish) == 2).sum())


def sweep(dest: int, box: Box, ranges: int, word_ranges: int, turn: int, last: bool) -> None:
    """Pairs: every dish with more than one customer is seated anew."""
    if dest >= ranges:
        return
    (_, (used, word, before, c, tables)), *_ = box.get("seats")
    totals = Totals.of(box.sums)
    # Ranges of words follow each other in the order of the words.
    restaurant, dish, parent = (np.concatenate([np.zeros(0), *(x[k].astype(np.float64) for _, x in box.get("told"))]) for k in (1, 2, 3))
    h, c, tables = pair_keys(used[word], used[before]), c.astype(np.int64), tables.astype(np.float64)
    log_s = stirling(totals.discount)
    drawn = np.zeros(len(c))
    for k in range(KEEP if last else 1):
        # The draws of the last round follow each other under the totals of its beginning.
        now = seat_pairs(c, h, tables, restaurant[before], dish[word], parent[word], totals, 100 * turn + k, log_s)
        drawn += now
    mean = drawn / (KEEP if last else 1)
    fresh = np.bincount(word, weights=mean - 1, minlength=len(used)), np.bincount(before, weights=mean - 1, minlength=len(used))
    edge = np.searchsorted(dealt(used, word_ranges), np.arange(word_ranges + 1))
    fresh = [x.astype("<f4") if last else small(x) for x in fresh]
    for q in np.flatnonzero(np.diff(edge)).tolist():
        box.send(ranges + q, dest, "more", NO_KEYS, *(x[edge[q] : edge[q + 1]] for x in fresh))
    if last:
        order = np.argsort(h)
        box.send(dest, 0, "mean", h[order], mean[order].astype("<f4"), low=PAIR_LOW)
    else:
        box.send(dest, 0, "seats", used, small(word), small(before), small(c), small(now))


def answer(dest: int, box: Box, ranges: int, first_block: int) -> None:
    """To each block what it asked for, in its order: discounted counts of its pairs; counts, tables and parent's probability of its words."""
    totals = Totals.of(box.sums)
    if dest < ranges:
        blocks, sizes, h, _, _, count = cells(box)
        keys, of = np.unique(h, return_inverse=True)
        c = np.bincount(of, weights=count, minlength=len(keys))
        tables = np.minimum(c, 1.0)
        for _, (seen, mean) in box.get("mean"):
            tables[np.searchsorted(keys, seen)] = mean
        value = (c - totals.discount * tables)[of].astype("<f4")
        at = 0
        for b, n in zip(blocks, sizes, strict=True):
            box.send(first_block + b, dest, "pairs", NO_KEYS, value[at : at + n])
            at += n
        return
    state = [x for _, x in box.get("words")]
    keys, n, parent, dish, tables = state[0] if state else [NO_KEYS, *[np.zeros(0)] * 4]
    p = totals.parent(dish.astype(np.float64), parent.astype(np.float64))
    for b, (asked, _) in box.get("ask"):
        at = np.minimum(np.searchsorted(keys, asked), max(len(keys) - 1, 0))
        there = keys[at] == asked if len(keys) else np.zeros(len(asked), bool)
        pick = lambda x, other, at=at, there=there: np.where(there, x[at], other) if len(keys) else np.full(len(asked), other)
        box.send(first_block + b, dest, "words", NO_KEYS, small(pick(n.astype(np.int64), 0)), pick(tables, 0).astype("<f4"), pick(p, totals.rest()).astype("<f4"))


SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def finish(chunks: list[bytes], box: Box, ranges: int) -> pa.Table:
    """Scores of a block's texts."""
    book, totals = Book.of(chunks), Totals.of(box.sums)
    word, before, _, of = book.pairs()
    to = dealt(pair_keys(book.words[word], book.words[before]), ranges, 64)
    value = np.zeros(len(word))
    value[np.argsort(to, kind="stable")] = np.concatenate([x[1] for _, x in box.get("pairs")])
    n, tables, p0 = (np.concatenate([x[k] for _, x in box.get("words")]).astype(np.float64) for k in (1, 2, 3))
    size = totals.strength + n
    p = value[of] / size[book.before] + ((totals.strength + totals.discount * tables) / size)[book.before] * p0[book.word]
    base = np.log10((n + 1) / (totals.n + totals.v + 1))[book.word]
    sums = [np.add.reduceat(x, book.begin[:-1]) for x in ((n > 0).astype(np.int64)[book.word], base, np.log10(p))]
    columns = [book.ids, book.held, np.diff(book.begin), sums[0], np.full(len(book.ids), int(totals.n)), *sums[1:]]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SCORES, strict=True)], schema=SCORES)


# -- the operator --------------------------------------------------------------------------


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    base = keyed(docs, id_col, text_col)
    total = total_bytes(base)
    ranges = max(1, -(-total // range_bytes))
    word_ranges = max(1, ranges // WORD_RANGES)
    first_block = ranges + word_ranges
    held = packed(hash_blocks(base, total, block_bytes)).select((F.col("block") + first_block).cast("int").alias("dest"), "chunk")

    def hop(fn):
        """One step of messages: fn(dest, box) for all that came to a task."""

        def run(key: tuple, table: pa.Table) -> pa.Table:
            box, dest = Box(table), int(key[0].as_py())
            if dest >= 0:
                fn(dest, box)
            return box.table()

        return run

    def with_sums(messages: DataFrame) -> DataFrame:
        """Messages with the sums over all tasks; each task's part came as a message of its own."""
        parts = messages.where("dest = -1").agg(F.array(*[F.coalesce(F.sum(F.get("sums", F.lit(i))), F.lit(0.0)) for i in range(SUMS)]).alias("sums"))
        return messages.where("dest >= 0").select("dest", "src", "kind", "data", parts.scalar().alias("sums"))

    def told(key: tuple, table: pa.Table) -> pa.Table:
        box = Box()
        block = int(key[0].as_py()) - first_block
        tell(table["chunk"].to_pylist(), block, ranges, word_ranges, box)
        return box.table()

    def answered(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        box = Box(left, right)
        answer(int(key[0].as_py()), box, ranges, first_block)
        box.out = [(*r[:4], box.sums) for r in box.out]
        return box.table()

    def scored(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return finish(left["chunk"].to_pylist(), Box(right), ranges)

    def swept(turn: int, last: bool):
        def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            box = Box(left, right)
            sweep(int(key[0].as_py()), box, ranges, word_ranges, turn, last)
            box.out = [(*r[:4], box.sums) for r in box.out]  # the parent is seated with these totals
            return box.table()

        return run

    def added(turn: int, last: bool):
        def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            box = Box(left, right)
            add_up(int(key[0].as_py()), box, ranges, turn, last)
            return box.table()

        return run

    # One plan: texts, blocks' messages and each step's messages are shuffled once and read by all that need them.
    sent = held.groupBy("dest").applyInArrow(told, DDL)
    seats = built = sent.groupBy("dest").applyInArrow(hop(lambda d, box: build(d, box, ranges, word_ranges)), DDL)
    now = with_sums(built.groupBy("dest").applyInArrow(hop(lambda d, box: add_up(d, box, ranges, 0, False)), DDL))
    for k in range(1, rounds + 1):
        seats = seats.groupBy("dest").cogroup(now.groupBy("dest")).applyInArrow(swept(k, k == rounds), DDL)
        now = with_sums(built.groupBy("dest").cogroup(seats.groupBy("dest")).applyInArrow(added(k, k == rounds), DDL))
    back = sent.groupBy("dest").cogroup(now.groupBy("dest")).applyInArrow(answered, DDL)
    ddl = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return held.groupBy("dest").cogroup(back.groupBy("dest")).applyInArrow(scored, ddl)


def op7_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read_table(spark, sf_dir, "documents"))
