"""The corpus pipeline: stages over documents, each written and read again as the next one's input.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrove.llm import byte_bpe, line_templates, mixing, near_copies, quality_rules
from quillgrove.llm.common import LAST_ID, ensure_shared_dir, read_table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.col(f"`{c}`") for c in COLUMNS])


def _keyed(docs: DataFrame) -> DataFrame:
    """With a key of each row, in order of id (a null one last); only equal rows share theirs."""
    held = _documents(docs)
    digest = F.xxhash64(*[F.col(c) for c in COLUMNS], *[F.col(c).isNull() for c in COLUMNS])
    return held.withColumn("key", F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"), digest.alias("digest")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep, each judged by its own text."""
    rows = _keyed(docs)
    kept = quality_rules.judge(rows, id_col="key").where("kept").select(F.col("doc_id").alias("key"))
    return _documents(rows.join(kept, "key", "left_semi"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of recurring templates; n_chars follows the text."""
    return _documents(line_templates.apply(docs).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies (five-word shingles, similarity of 0.8 or more): that with the smallest id."""
    return _documents(near_copies.thinned(_keyed(docs), key_col="key"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many rows of each document as the mix takes copies."""
    rows = _keyed(docs)
    # Equal rows share a key: they come once, with all their copies.
    copies = mixing.mix(rows, id_col="key").groupBy(F.col("doc_id").alias("key")).agg(F.sum("copies").alias("copies")).where("copies > 0")
    taken = rows.dropDuplicates(["key"]).join(copies, "key")
    return _documents(taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids and what they decode to, of every row."""
    return byte_bpe.round_trip(docs)


STAGES = [("quality rules", quality), ("line dedup", line_dedup), ("near dedup", near_dedup), ("mixing", mix_sources), ("byte bpe", tokens)]
#: Near copies, entropy balancing and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage's rows are written to the shared folder and read again."""
    ensure_shared_dir(spark)
    jvm = spark.sparkContext._jvm
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{jvm.java.util.UUID.randomUUID()}"
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:  # nothing reads the stage before last any more
                _remove(spark, f"{folder}/{k - 1}")
    return docs


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
