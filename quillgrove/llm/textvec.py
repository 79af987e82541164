"""Words and rolling hashes of many texts at once, on their UTF-8 bytes, with numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Odd multipliers of the polynomial hashes over bytes and over words.
BYTE_BASE = 0x9E3779B97F4A7C15 | 1
WORD_BASE = U(0xD6E8FEB86659FD93)
#: Bytes handled together; a longer text is one piece of its own.
PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over the 64 bits (a finaliser without fixed structure in its low bits)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_powers = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, PIECE + (1 << 16))
        for k, base in enumerate((BYTE_BASE, pow(BYTE_BASE, -1, 1 << 64))):
            steps = np.full(size, base, U)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=U)
    return _powers[0][:n], _powers[1][:n]


@dataclass
class Piece:
    """Texts of rows first, first + 1, ...; in data, a space stands before, between and after them."""

    first: int
    texts: list[bytes]
    data: np.ndarray
    row_start: np.ndarray
    row_end: np.ndarray

    def words(self) -> None:
        """Sets start and end of each word, and word_start: the first word of each row, then their number."""
        inside = np.zeros(len(self.data) + 1, np.int8)
        inside[:-1] = ~IS_SPACE[self.data]
        turn = np.diff(inside, prepend=np.int8(0))
        self.start, self.end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        self.word_start = np.append(np.searchsorted(self.start, self.row_start), len(self.start))

    def prefix(self) -> np.ndarray:
        """Sums of byte times power before each position."""
        p, _ = powers(len(self.data))
        out = np.zeros(len(self.data) + 1, U)
        np.cumsum((self.data.astype(U) + U(1)) * p, out=out[1:])
        return out

    def hashes(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Rabin-Karp hashes of data[start:end], for each pair."""
        _, inverse = powers(len(self.data))
        return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(U) * U(0x632BE59BD9B4E019))

    def word_hashes(self) -> np.ndarray:
        return self.hashes(self.prefix(), self.start, self.end)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.texts)), np.diff(self.word_start))


def as_bytes(texts: pa.Array) -> list[bytes]:
    """UTF-8 of each text; nulls as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if pa.types.is_null(texts.type):
        return [b""] * len(texts)
    large = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    filled = texts.cast(pa.large_binary() if large else pa.binary())
    return pc.fill_null(filled, b"").to_pylist()


def pieces(texts: list[bytes], budget: int = PIECE) -> Iterator[Piece]:
    """Runs of texts with about `budget` bytes each."""
    at = 0
    while at < len(texts):
        size, to = 0, at
        while to < len(texts) and (to == at or size + len(texts[to]) <= budget):
            size += len(texts[to]) + 1
            to += 1
        some = texts[at:to]
        data = np.frombuffer(b" " + b" ".join(some) + b" ", np.uint8)
        lengths = np.array([len(x) for x in some], np.int64)
        start = np.cumsum(np.append(1, lengths[:-1] + 1))
        yield Piece(at, some, data, start, start + lengths)
        at = to


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Rolling hashes of every `size` consecutive word hashes, whatever rows they are of."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.zeros(n, U)
    for k in range(size):
        out = out * WORD_BASE + words[k : k + n]
    return mix(out)
