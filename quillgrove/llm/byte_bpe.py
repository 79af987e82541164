"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The ranks of a `.tiktoken` file become a BPE model: each byte is written as one printable
character (the byte table), and every way to put a token together from two others is a
merge, ordered by the token's rank, so the merge order is that of the ranks.

A text is cut where one space stands between two characters that aren't white space.
No match of the pattern spans such a cut but by taking the space in front, so the units
are encoded one by one, and a unit seen before is looked up (a bounded memory, which
changes no result). Other stretches, with runs of white space, are units as a whole.

Decoding maps the characters of the tokens back through the byte table. A character whose
bytes are split over tokens comes out whole, as bytes are joined before they are read.
The offsets of a token are the code points that it holds bytes of, first and end, from the
lengths of the tokens and the first bytes of the characters; tokens that share a character share its place.

Defined cases: null and empty texts have no tokens; repeated rows are encoded each; an empty
table gives an empty result; other input columns are ignored by the digest and kept by
`encode`, whose new columns replace any of the same name.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, slim, text_of
from .textvec import as_bytes

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Units kept in memory by a worker, in two generations: of the older, those still met go on.
MEMORY = 600_000
#: A longer unit isn't kept.
KEPT_UNIT = 64
CUT = re.compile(r"(?<=\S) (?=\S)")
IRREGULAR = re.compile(r"\s\s|^\s|\s$|[\x1c-\x1f]")


def byte_table() -> list[str]:
    """A printable character for each byte: itself where it is printable Latin-1, else the next from 256 on."""
    table, following = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b:
            table.append(chr(b))
        else:
            table.append(chr(following))
            following += 1
    return table


class Codec:
    """A tokenizer from a file of ranks."""

    def __init__(self, path: str, pattern: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Regex, Tokenizer, pre_tokenizers
        from tokenizers.models import BPE

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        table = byte_table()
        self.to_byte = {c: b for b, c in enumerate(table)}
        written = {t: "".join(table[b] for b in t) for t in ranks}
        merges = []
        for token, _ in sorted(ranks.items(), key=lambda x: x[1]):
            halves = [(max(ranks[token[:i]], ranks[token[i:]]), i) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
            merges += [(written[token[:i]], written[token[i:]]) for _, i in sorted(halves)]
        self.tokenizer = Tokenizer(BPE(vocab={written[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.characters = {r: written[t] for t, r in ranks.items()}
        self.bytes_of: dict[int, bytes] = {}
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        self.length[list(ranks.values())] = [len(t) for t in ranks]
        self.first: dict[str, tuple[bytes, bytes]] = {}
        self.later: dict[str, tuple[bytes, bytes]] = {}
        self.older: dict[str, tuple[bytes, bytes]] = {}

    def token_bytes(self, i: int) -> bytes:
        """A token's bytes: its characters back through the byte table; looked up once."""
        if i not in self.bytes_of:
            self.bytes_of[i] = bytes(self.to_byte[c] for c in self.characters[i])
        return self.bytes_of[i]

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token_bytes, ids))

    def decode(self, ids: list[int]) -> str:
        """Text of the ids; bytes that are no UTF-8 even when joined become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def encode(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        """Ids and the span of code points that each stands for; parts of one character share its span."""
        found = self.tokenizer.encode(text, add_special_tokens=False)
        return found.ids, found.offsets

    def offsets(self, ids: np.ndarray, decoded: bytes) -> tuple[np.ndarray, np.ndarray]:
        """First and end code point of each token of a text."""
        end = np.cumsum(self.length[ids])
        character = np.cumsum(np.frombuffer(decoded, np.uint8) & 0xC0 != 0x80)
        return character[end - self.length[ids]] - 1, character[end - 1]

    def learn(self, units: set[str], lead: str, known: dict[str, tuple[bytes, bytes]], older: dict[str, tuple[bytes, bytes]]) -> None:
        fresh = []
        for u in units.difference(known):
            if u in older:
                known[u] = older[u]
            else:
                fresh.append(u)
        for at in range(0, len(fresh), 20_000):
            some = fresh[at : at + 20_000]
            for u, e in zip(some, self.tokenizer.encode_batch_fast([lead + u for u in some], add_special_tokens=False), strict=True):
                ids = e.ids
                known[u] = (struct.pack(f"<{len(ids)}I", *ids), self.decode_bytes(ids))

    def digests(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """Ids as little-endian 32-bit integers, and their decoded bytes, of each text."""
        cut = [t.split(" ") if not IRREGULAR.search(t) else CUT.split(t) for t in texts]
        if len(self.later) > MEMORY // 2:
            self.older, self.later = self.later, {}
        if len(self.first) > MEMORY // 20:
            self.first = {}
        self.learn({c[0] for c in cut}, "", self.first, {})
        self.learn(set().union(*(c[1:] for c in cut)), " ", self.later, self.older)
        long = [u for c in cut for u in (c if max(map(len, c)) > KEPT_UNIT else ()) if len(u) > KEPT_UNIT]
        for c in cut:
            parts = [self.first[c[0]], *map(self.later.__getitem__, c[1:])]
            yield b"".join([p[0] for p in parts]), b"".join([p[1] for p in parts])
        for u in long:
            self.first.pop(u, None)
            self.later.pop(u, None)


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One for each worker and file."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def _place(path: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return path or public_tokenizers.path(VOCABULARY), pattern or public_tokenizers.PATTERN


def _groups(texts: list[bytes], budget: int = 1 << 20) -> Iterator[list[str]]:
    some, size = [], 0
    for t in texts:
        some.append(t.decode("utf-8", "replace"))
        size += len(t)
        if size >= budget:
            yield some
            some, size = [], 0
    if some:
        yield some


def round_trip(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256, n_split of every whole text.

    spans_sha256 is the digest of the tokens' first and end code points in turn (little-endian
    32-bit integers), n_split the number of tokens that begin inside a character.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(*_place(path, pattern))
        for batch in batches:
            n, ids, decoded, spans, split = [], [], [], [], []
            for group in _groups(as_bytes(batch.column(1))):
                for i, d in model.digests(group):
                    n.append(len(i) // 4)
                    ids.append(hashlib.sha256(i).hexdigest())
                    decoded.append(hashlib.sha256(d).hexdigest())
                    first, end = model.offsets(np.frombuffer(i, "<u4"), d) if i else (np.zeros(0, np.int64),) * 2
                    spans.append(hashlib.sha256(np.stack([first, end], axis=1).astype("<u4").tobytes()).hexdigest())
                    split.append(int((first[1:] < end[:-1]).sum()))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string()), pa.array(spans, pa.string()), pa.array(split, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256", "n_split"])

    return slim(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string, n_split long")


def encode(docs: DataFrame, *, text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The input's columns with `ids`, `starts` and `ends` (code points) of every whole text."""

    @F.pandas_udf("ids array<int>, starts array<int>, ends array<int>")
    def tokens(texts):
        import pandas as pd

        model = codec(*_place(path, pattern))
        found = [model.encode(t) for t in texts]
        return pd.DataFrame({"ids": [f[0] for f in found], "starts": [[a for a, _ in f[1]] for f in found], "ends": [[b for _, b in f[1]] for f in found]})

    new = ("ids", "starts", "ends")
    kept = [c for c in docs.columns if c not in new]
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), tokens(text_of(text_col)).alias("found"))
    return held.select(*[F.col("row").getField(c).alias(c) for c in kept], *[F.col("found").getField(c).alias(c) for c in new])


def decode(tokens: DataFrame, *, ids_col: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The input's columns with `decoded`: the text of the ids (null ids: empty)."""

    @F.pandas_udf("string")
    def text(ids):
        import pandas as pd

        model = codec(*_place(path, pattern))
        return pd.Series([model.decode([] if i is None else list(i)) for i in ids])

    return tokens.withColumn("decoded", text(F.col(f"`{ids_col}`")))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read_table(spark, sf_dir, "documents"))
