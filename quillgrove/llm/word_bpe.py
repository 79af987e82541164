"""BPE with word ends: encoding through an index of pairs and their places, and decoding.

A text is cut at ASCII white space, which no match of the pattern spans and which normalising leaves apart; the
units between are normalised and cut into words by the file's own normaliser and
pattern. Words not met before are laid out as one row of symbols. An index maps each pair
that has a rank to all its places in that row; ranks are applied in ascending order, each at all its places from
left to right, and a merge moves its two neighbour places from the lists of their old pairs to those of the new ones
(a place says which pair it belongs to now, so the old list passes it over).
That is what merging each word by itself gives, provided that a token is made by one merge alone
and used by later ones only; the file is checked for that.

Units are kept in a bounded memory (two generations; a unit still met goes on), which changes no result.

Defined cases: null and empty texts, and texts of white space, have no tokens and decode to the empty text;
strings of special tokens in a text become these tokens, as in the library; repeated rows are encoded each; a unit of any
length is one row of symbols (a word of n bytes takes some 150 n bytes of a worker's memory); an empty table gives an empty result; other input columns are ignored by the
digest and kept by `encode`, whose new column replaces one of the same name.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import os
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import byte_table
from .common import read_table, slim, text_of
from .textvec import as_bytes

VOCABULARY = "word_bpe_49k.json"
#: Units and words kept in memory by a worker, in two generations each: of the older, those still met go on.
UNITS, WORDS = 400_000, 600_000
#: A longer unit or word isn't kept.
KEPT_UNIT = 64
#: Bytes laid out at once; a longer word is a row of its own.
ROW = 1 << 20
#: The file's pattern, and what it is for units of printable ASCII and Latin letters alone, whose classes no Unicode version has changed.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LATIN = re.compile("[\x21-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]*")
LATIN_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u017f]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u017f]+")
#: Between words, and in place of a symbol that a merge took; a pair without a rank.
GAP, TAKEN, NONE = -1, -2, -1


class Merges:
    """Merge rules by rank, applied to many words at once."""

    def __init__(self, pairs: list[tuple[int, int]], made: list[int]) -> None:
        self.made = made
        self.from_left: dict[int, dict[int, int]] = {}
        self.to_right: dict[int, dict[int, int]] = {}
        for r, (a, b) in enumerate(pairs):
            self.from_left.setdefault(b, {})[a] = r
            self.to_right.setdefault(a, {})[b] = r
        by = {m: r for r, m in enumerate(made)}
        if len(by) < len(made) or len(set(pairs)) < len(pairs) or any(by.get(x, -1) >= r for r, p in enumerate(pairs) for x in p):
            raise ValueError("a token is made by two merges, or used before it is made")
        keys = np.array([a << 32 | b for a, b in pairs], np.int64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    def ranks(self, symbols: np.ndarray) -> np.ndarray:
        """The rank of the pair that begins at each place, or NONE."""
        out = np.full(len(symbols), NONE, np.int64)
        if len(self.keys) and len(symbols):
            inside = np.flatnonzero((symbols[:-1] >= 0) & (symbols[1:] >= 0))
            keys = symbols[inside] << 32 | symbols[inside + 1]
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            found = self.keys[at] == keys
            out[inside[found]] = self.order[at[found]]
        return out

    def apply(self, row: np.ndarray) -> np.ndarray:
        """A row of symbols, words between gaps (one at either end), after all merges; symbols that were merged away are TAKEN."""
        first = self.ranks(row)
        held = first.tolist()  # the rank of the pair that begins at a place now
        at = np.flatnonzero(first >= 0)
        at = at[np.argsort(first[at], kind="stable")]
        active, begins = np.unique(first[at], return_index=True)
        places = {r: some.tolist() for r, some in zip(active.tolist(), np.split(at, begins[1:]), strict=True)} if len(at) else {}
        symbols, after, before = row.tolist(), list(range(1, len(row) + 1)), list(range(-1, len(row) - 1))
        queue = list(places)
        heapq.heapify(queue)
        while queue:
            r = heapq.heappop(queue)
            made = self.made[r]
            from_left, to_right = self.from_left.get(made), self.to_right.get(made)  # ranks of the pairs that end and begin with it
            for here in sorted(places.pop(r)):
                if held[here] != r:  # a merge beside it took the pair off this list
                    continue
                mate = after[here]
                up, down = before[here], after[mate]
                symbols[here], symbols[mate] = made, TAKEN
                after[here], before[down] = down, here
                held[mate] = NONE
                new = held[up] = from_left.get(symbols[up], NONE) if from_left else NONE
                if new >= 0:
                    if new in places:
                        places[new].append(up)
                    else:
                        places[new] = [up]
                        heapq.heappush(queue, new)
                new = held[here] = to_right.get(symbols[down], NONE) if to_right else NONE
                if new >= 0:
                    if new in places:
                        places[new].append(here)
                    else:
                        places[new] = [here]
                        heapq.heappush(queue, new)
        return np.array(symbols, np.int64)


class Codec:
    """Encoder and decoder from a tokenizer file."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        model, added, cuts = held["model"], held["added_tokens"], held["pre_tokenizer"].get("pretokenizers", [])
        level = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
        if (
            model["type"] != "BPE" or held["decoder"] or held["post_processor"] or model["dropout"] or model["byte_fallback"] or model["continuing_subword_prefix"]
            or any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] for a in added)
            or [c["type"] for c in cuts] != ["Split", "ByteLevel"] or any(cuts[1][k] != v for k, v in level.items()) or not (cuts[0]["invert"] and cuts[0]["behavior"] == "Removed")
        ):
            raise ValueError("a tokenizer file of another kind")
        pattern = cuts[0]["pattern"]["Regex"]
        self.normal = Tokenizer.from_file(path).normalizer.normalize_str
        self.split = pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str
        self.latin = pattern == PATTERN
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        ordered = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = Merges([(vocab[a], vocab[b]) for a, b in ordered], [vocab[a + b] for a, b in ordered])
        table = byte_table()
        self.inner, self.last = np.array([vocab[c] for c in table], np.int64), np.array([vocab[c + end] for c in table], np.int64)
        self.token = {i: c for c, i in vocab.items()} | {a["id"]: a["content"] for a in added}
        self.spelled = {i: c.encode() + b" " for i, c in self.token.items()}
        self.special = {a["content"]: a["id"] for a in added}
        self.specials = re.compile("(" + "|".join(re.escape(c) for c in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.mark = re.compile(b"|".join(re.escape(c.encode()) for c in self.special) or rb"(?!)")
        self.words: dict[str | int, tuple[bytes, bytes]] = {}
        self.older_words: dict[str | int, tuple[bytes, bytes]] = {}
        self.units: dict[bytes, tuple[bytes, bytes]] = {}
        self.older: dict[bytes, tuple[bytes, bytes]] = {}

    def words_of(self, unit: bytes) -> list[str | int]:
        """Words of a unit, and the ids of special tokens."""
        text = unit.decode("utf-8", "replace")
        special = self.mark.search(unit)
        if self.latin and not special and LATIN.fullmatch(text):
            return LATIN_WORDS.findall(text.lower())
        out: list[str | int] = []
        for part in self.specials.split(text) if special else [text]:
            out += [self.special[part]] if part in self.special else [w for w, _ in self.split(self.normal(part))] if part else []
        return out

    def learn_words(self, words: Iterable[str], known: dict[str, tuple[bytes, bytes]]) -> None:
        """Ids of words, and their tokens with a space after each."""
        rows: list[tuple[str, bytes]] = []
        size = 0
        for w in words:
            rows.append((w, w.encode()))
            size += len(rows[-1][1])
            if size >= ROW:
                self._lay(rows, known)
                rows, size = [], 0
        if rows:
            self._lay(rows, known)

    def _lay(self, words: list[tuple[str, bytes]], known: dict[str, tuple[bytes, bytes]]) -> None:
        raw = np.frombuffer(b"".join([b for _, b in words]), np.uint8)
        lengths = np.array([len(b) for _, b in words])
        ends = np.cumsum(lengths)
        symbols = self.inner[raw]
        symbols[ends - 1] = self.last[raw[ends - 1]]
        row = np.full(len(raw) + len(words) + 1, GAP, np.int64)
        row[np.arange(len(raw)) + np.repeat(np.arange(1, len(words) + 1), lengths)] = symbols
        row = self.merges.apply(row)
        row = row[row != TAKEN]
        stops = np.flatnonzero(row == GAP)
        ids = row[row != GAP]
        edges = (stops - np.arange(len(stops))).tolist()
        packed, spelled = ids.astype("<u4").tobytes(), [self.spelled[i] for i in ids.tolist()]
        for (w, _), a, b in zip(words, edges, edges[1:], strict=False):
            known[w] = (packed[4 * a : 4 * b], b"".join(spelled[a:b]))

    def learn(self, units: Iterable[bytes], known: dict[bytes, tuple[bytes, bytes]]) -> None:
        """Ids of units not met before, and their tokens with a space after each."""
        fresh = {u: self.words_of(u) for u in units}
        if len(self.words) > WORDS // 2:
            self.older_words, self.words = self.words, {}
        words, older, unknown = self.words, self.older_words, set()
        for w in {w for some in fresh.values() for w in some}.difference(words):
            if isinstance(w, int):
                words[w] = (struct.pack("<I", w), self.spelled[w])
            elif w in older:
                words[w] = older[w]
            else:
                unknown.add(w)
        self.learn_words(unknown, words)
        for u, some in fresh.items():
            if len(some) == 1:
                known[u] = words[some[0]]
            else:
                parts = [words[w] for w in some]
                known[u] = (b"".join([p[0] for p in parts]), b"".join([p[1] for p in parts]))
        for w in unknown:
            if len(w) > KEPT_UNIT:
                del words[w]

    def digests(self, texts: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Ids as little-endian 32-bit integers, and the decoded text, of each text."""
        if len(self.units) > UNITS // 2:
            self.older, self.units = self.units, {}
        cut, known, older = [t.split() for t in texts], self.units, self.older
        fresh = set()
        for u in set().union(*cut).difference(known):
            if u in older:
                known[u] = older[u]
            else:
                fresh.add(u)
        paused = gc.isenabled()
        gc.disable()  # it would walk all that is kept, again and again; nothing here is in a cycle
        try:
            self.learn(fresh, known)
        finally:
            if paused:
                gc.enable()
        for c in cut:
            found = list(map(known.__getitem__, c))
            yield b"".join([f[0] for f in found]), b"".join([f[1] for f in found])[:-1]
        for u in fresh:
            if len(u) > KEPT_UNIT:
                del known[u]

    def encode(self, text: str) -> list[int]:
        ((ids, _),) = self.digests([text.encode()])
        return list(struct.unpack(f"<{len(ids) // 4}I", ids))

    def decode(self, ids: Iterable[int]) -> str:
        """The tokens with a space between; the file has no decoder that would join them. Ids that it doesn't have are left out."""
        return " ".join(self.token[i] for i in ids if i in self.token)


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One for each worker and file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _place(path: str | None) -> str:
    import public_tokenizers

    return path or public_tokenizers.path(VOCABULARY)


def _groups(texts: list[bytes], budget: int = 4 << 20) -> Iterator[list[bytes]]:
    some, size = [], 0
    for t in texts:
        some.append(t)
        size += len(t)
        if size >= budget:
            yield some
            some, size = [], 0
    if some:
        yield some


def round_trip(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(_place(path))
        for batch in batches:
            n, ids, decoded = [], [], []
            for group in _groups(as_bytes(batch.column(1))):
                for i, d in model.digests(group):
                    n.append(len(i) // 4)
                    ids.append(hashlib.sha256(i).hexdigest())
                    decoded.append(hashlib.sha256(d).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return slim(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, *, text_col: str = "text", path: str | None = None) -> DataFrame:
    """The input's columns with `ids` of every whole text."""

    @F.pandas_udf("array<int>")
    def tokens(texts):
        import pandas as pd

        model = codec(_place(path))
        return pd.Series([model.encode(t) for t in texts])

    return docs.withColumn("ids", tokens(text_of(text_col)))


def decode(tokens: DataFrame, *, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """The input's columns with `decoded`: the text of the ids (null ids: empty)."""

    @F.pandas_udf("string")
    def text(ids):
        import pandas as pd

        model = codec(_place(path))
        return pd.Series([model.decode([] if i is None else i) for i in ids])

    return tokens.withColumn("decoded", text(F.col(f"`{ids_col}`")))


def op12_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read_table(spark, sf_dir, "documents"))
