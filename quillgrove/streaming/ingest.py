"""Documents that arrive as a stream: validated as they come, counted in windows of event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import nodes, validate
from ..operators.kept import kept
from ..plans.register import Register


def documents(spark: SparkSession, path: str, schema: str = "doc_id string, raw string") -> DataFrame:
    """A stream of rows from Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def validated(stream: DataFrame, reg: Register, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each batch's diagnostics go to `write` with the batch's number, so a repeated batch can overwrite itself."""

    def one(batch: DataFrame, number: int) -> None:
        write(validate.validate(kept(nodes.from_trees(batch)), reg), number)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, *, time: str = "ts", key: str = "event_type", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of each key in windows of event time; state is dropped once it is `late` behind."""
    held = events.withWatermark(time, late) if events.isStreaming else events
    return held.groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")
