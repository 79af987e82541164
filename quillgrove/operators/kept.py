"""Results that several rules read, computed once, and rows dealt over tasks."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def _shared(spark: SparkSession) -> None:
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))


def kept(df: DataFrame, compression: str | None = None) -> DataFrame:
    """The same rows from Parquet in spark.checkpoint.dir, so that each reader takes only its columns; only a local session without one gets a folder of its own."""
    folder = shared_folder(df.sparkSession, "kept")
    (df.write.option("compression", compression) if compression else df.write).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """The same rows dealt over tasks by key, before each becomes much work: a file of keys is small, so it is read by one task or a few, whatever its rows are to become."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *keys)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that executors share."""
    _shared(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{spark.sparkContext._jvm.java.util.UUID.randomUUID()}"
