"""What the corpus operators share: text columns, shared storage and document blocks.

A *block* is a set of documents with a bounded amount of text, by hash or in order of id. Operators
that compare documents shuffle texts to their blocks once; a block sends compact
summaries through a shuffle, and what is learned is joined back to the block that asked.
"""

from __future__ import annotations

import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words: space and the control characters tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"
#: The order of a missing document id: after every other.
LAST_ID = (1 << 63) - 1


def text_of(column: str = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def slim(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so columns of other names can't clash with an operator's own."""
    return docs.select(*[F.col(f"`{c}`") for c in columns])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_shared_dir(spark: SparkSession) -> None:
    """Use the cluster's spark.checkpoint.dir; a local session without one gets a folder of its own, a cluster must set it."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a reliable checkpoint: computed once, kept when executors are lost."""
    ensure_shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def crc_mod(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text modulo `modulus`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def py_crc_mod(doc_id: object, modulus: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus


# -- blocks ------------------------------------------------------------------------

#: Bytes that a row counts for besides its text, so blocks of empty texts are bounded too.
ROW_BYTES = 64
#: About as many blocks there are at most, as a power of two; and those that one task packs.
MOST_BLOCKS_BITS, PART_BLOCKS = 20, 32
HASH_RANGE = float(1 << 63)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text (null: empty) and `h`, 63 bits of the text's hash."""
    return slim(docs, id_col, text_col).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(text_col).alias("text")).withColumn("h", F.shiftrightunsigned(F.xxhash64("text"), 1))


def total_bytes(base: DataFrame) -> int:
    return base.agg(F.coalesce(F.sum(F.octet_length("text").cast("long") + ROW_BYTES), F.lit(0))).first()[0]


def hash_blocks(base: DataFrame, total: int, block_bytes: int) -> DataFrame:
    """keyed rows with `block`, by hash of id and text: about block_bytes each, rows of one id apart."""
    n = max(1, -(-total // block_bytes))
    return base.withColumn("block", F.pmod(F.xxhash64("doc_id", "h"), F.lit(n)).cast("int"))


#: Text that a worker holds before it sends it on.
PACK_BYTES = 24 << 20


def packed(blocked: DataFrame) -> DataFrame:
    """block and `chunk`: the ids and texts of a task's documents of a block, compressed together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        size = 0

        def chunks() -> pa.RecordBatch:
            made = [(b, _pack_rows(*rows)) for b, rows in held.items()]
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in made], pa.int32()), pa.array([c for _, c in made], pa.binary())], ["block", "chunk"])

        for batch in batches:
            for b, i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                ids, texts = held.setdefault(b, ([], []))
                ids.append(i)
                texts.append(t)
                size += len(t) + ROW_BYTES
                if size >= PACK_BYTES:
                    yield chunks()
                    held, size = {}, 0
        if held:
            yield chunks()

    return blocked.select("block", "doc_id", "text").mapInArrow(run, "block int, chunk binary")


def _pack_rows(ids: list, texts: list[bytes]) -> bytes:
    body = b"".join([np.array([LAST_ID if i is None else i for i in ids], "<i8").tobytes(), np.array([len(t) for t in texts], "<u4").tobytes(), *texts])
    return len(ids).to_bytes(4, "little") + _pack_text.compress(body)


def unpacked(chunks: list[bytes]) -> tuple[list[int | None], list[bytes]]:
    """Ids and texts of a block's chunks in order of id and text, the same whenever they are read."""
    rows: list[tuple[int, bytes]] = []
    for chunk in chunks:
        n, body = int.from_bytes(chunk[:4], "little"), _unpack.decompress(chunk[4:])
        end = 12 * n + np.cumsum(np.frombuffer(body, "<u4", n, 8 * n).astype(np.int64))
        rows += zip(np.frombuffer(body, "<i8", n).tolist(), [body[a:b] for a, b in zip([12 * n, *end.tolist()], end.tolist(), strict=False)], strict=True)
    rows.sort()
    return [None if i == LAST_ID else i for i, _ in rows], [t for _, t in rows]


def ordered_blocks(base: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """keyed rows with `k` (the id, a missing one last), `block` and `place`; and the bytes of all.

    Blocks ascend with ids and hold `block_bytes` at most, whatever the ids are: bytes are summed by id, ids are put in order by a range shuffle, and
    each of its partitions packs them, as many neighbours as fit. An id with more than a block alone takes blocks of its own, dealt by the text's
    hash: they share their `place`, and other blocks have their own. Rows with one id and one text stay together.
    What comes to the driver and goes to every task is a row for each block (its first id), 2 ** (MOST_BLOCKS_BITS + 1) at most: beyond
    that blocks grow with the input.
    """
    base = base.withColumn("k", F.coalesce("doc_id", F.lit(LAST_ID)))
    total = total_bytes(base)
    limit = max(block_bytes, total >> MOST_BLOCKS_BITS)
    sizes = base.groupBy("k").agg(F.sum(F.octet_length("text").cast("long") + ROW_BYTES).alias("size"))
    parts = max(1, min(4096, total // (PART_BLOCKS * limit)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, cuts = TaskContext.get().partitionId() << 32, None, []
        for batch in batches:
            for k, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held is not None and size <= limit and held + size <= limit:
                    held += size
                    continue
                n = max(1, -(-size // limit))
                cuts.append((k, number, n))
                number, held = number + n, size if n == 1 else None
        yield pa.RecordBatch.from_arrays([pa.array([c[i] for c in cuts], pa.int64()) for i in range(3)], ["k", "first", "n"])

    packed_ids = sizes.repartitionByRange(parts, "k").sortWithinPartitions("k").mapInArrow(pack, "k long, first long, n long").toArrow().sort_by("k")
    begins = base.sparkSession.sparkContext.broadcast([packed_ids.column(c).to_numpy() for c in ("k", "first", "n")])

    @F.pandas_udf("block long, place long")
    def dealt(k: pd.Series, h: pd.Series) -> pd.DataFrame:
        ids, first, n = begins.value
        at = np.searchsorted(ids, k.to_numpy(), side="right") - 1
        share = np.minimum(n[at] - 1, (h.to_numpy() / HASH_RANGE * n[at]).astype(np.int64))
        return pd.DataFrame({"block": first[at] + share, "place": first[at]})

    return base.withColumn("to", dealt("k", "h")).select("doc_id", "text", "h", "k", "to.block", "to.place"), total


# -- sorted sets of 64-bit keys as bytes --------------------------------------------

LOW_BYTES = 5
_pack = zstandard.ZstdCompressor(level=1)
_pack_text = zstandard.ZstdCompressor(level=3)
_unpack = zstandard.ZstdDecompressor()


def pack_keys(keys: np.ndarray, low_bytes: int = LOW_BYTES) -> bytes:
    """A sorted array of 64-bit keys: low bytes as they are, the slowly rising high part (four bytes at most) as steps."""
    high = keys >> np.uint64(8 * low_bytes)
    steps = np.diff(high, prepend=np.uint64(0)).astype("<u4")
    low = np.ascontiguousarray(keys.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :low_bytes]
    packed = _pack.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes())
    return len(keys).to_bytes(4, "little") + len(packed).to_bytes(4, "little") + packed + low.tobytes()


def unpack_keys(blob: bytes, low_bytes: int = LOW_BYTES) -> np.ndarray:
    n, size = int.from_bytes(blob[:4], "little"), int.from_bytes(blob[4:8], "little")
    if not n:
        return np.zeros(0, np.uint64)
    planes = np.frombuffer(_unpack.decompress(blob[8 : 8 + size]), np.uint8).reshape(4, n)
    steps = np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.uint64)
    out = np.zeros((n, 8), np.uint8)
    out[:, :low_bytes] = np.frombuffer(blob[8 + size :], np.uint8).reshape(n, low_bytes)
    return out.view("<u8").ravel().astype(np.uint64) | np.cumsum(steps, dtype=np.uint64) << np.uint64(8 * low_bytes)


def pack_array(values: np.ndarray) -> bytes:
    """Any numbers, byte plane by byte plane, compressed."""
    flat = np.ascontiguousarray(values)
    return _pack.compress(flat.view(np.uint8).reshape(len(flat), flat.itemsize).T.tobytes() if len(flat) else b"")


def unpack_array(blob: bytes, dtype: str) -> np.ndarray:
    raw, size = np.frombuffer(_unpack.decompress(blob), np.uint8), np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).ravel()
