"""Documents whose nodes arrive as a stream, with state: the ids seen, counts of elements, and an end.

A document's state is its ids, its counts and its first and last time. A repeated id is found however far apart the
two come. A document ends when nothing of it has come for `gap`: the next node begins it anew, and
a timer on the watermark drops the state of those that are never heard of again. Results are updates: the totals of a
document so far, each time that something of it came; the last of each (document, start) is final, and is the same however
the nodes are dealt to batches, as long as each document's come in order of time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

SCHEMA = "doc_id string, start timestamp, last timestamp, nodes long, repeated long, elements map<string,long>"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Ids of a document that are read and written with its totals; those beyond are asked for one at a time.
HELD = 1_000


class Arrivals(StatefulProcessor):
    """State of one document: `span` (its totals, counts, timer and first ids), and the rest of its ids (`ids`).

    A call of a state is a message to the JVM, so a document's batch makes a few calls, however many nodes come.
    """

    def __init__(self, gap_ms: int, most: int = HELD) -> None:
        self.gap_ms, self.most = gap_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ids = handle.getMapState("ids", "id string", "n long")
        self.span = handle.getValueState("span", "start long, last long, nodes long, repeated long, counts map<string,long>, first array<string>, more long, timer long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        arrived = sorted(rows, key=lambda r: r["ms"])
        held = self.span.get()
        span = self.opened(arrived[0]["ms"]) if held is None else dict(zip(self.opened(0), held, strict=True))
        span["counts"], timer = dict(span["counts"]), span["timer"]
        first = set(span["first"])
        for r in arrived:
            if r["ms"] - span["last"] > self.gap_ms:
                yield self.totals(key, span)
                if span["more"]:
                    self.ids.clear()
                span, first = self.opened(r["ms"]), set()
            span["last"], span["nodes"] = max(span["last"], r["ms"]), span["nodes"] + 1
            span["counts"][r["t"]] = span["counts"].get(r["t"], 0) + 1
            ident = r["id"]
            if ident is None:
                continue
            if ident in first or (span["more"] and self.ids.containsKey((ident,))):
                span["repeated"] += 1
            elif len(first) < self.most:
                first.add(ident)
            else:
                self.ids.updateValue((ident,), (1,))
                span["more"] += 1
        if timer is not None:
            self.handle.deleteTimer(timer)
        span["first"], span["timer"] = list(first), span["last"] + self.gap_ms + 1
        self.handle.registerTimer(span["timer"])
        self.span.update(tuple(span.values()))
        yield self.totals(key, span)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        for state in (self.ids, self.span):
            state.clear()
        return iter(())

    @staticmethod
    def opened(ms: int) -> dict:
        return {"start": ms, "last": ms, "nodes": 0, "repeated": 0, "counts": {}, "first": [], "more": 0, "timer": None}

    @staticmethod
    def totals(key: tuple, span: dict) -> Row:
        return Row(doc_id=key[0], start=span["start"], last=span["last"], nodes=span["nodes"], repeated=span["repeated"], elements=dict(span["counts"]))


def arriving(nodes: DataFrame, *, gap_seconds: int, late: str = "10 minutes") -> DataFrame:
    """Totals of documents from a stream (or a table) of rows doc_id, ts, t, id."""
    held = nodes.select(F.col("doc_id").cast("string").alias("doc_id"), "ts", "t", F.col("id").cast("string").alias("id"), F.unix_millis("ts").alias("ms"))
    held = held.withWatermark("ts", late) if nodes.isStreaming else held
    found = held.groupBy("doc_id").transformWithState(Arrivals(gap_seconds * 1000), SCHEMA.replace("timestamp", "long"), "Update", "EventTime" if nodes.isStreaming else "None")
    return found.withColumns({c: F.timestamp_millis(c) for c in ("start", "last")})


def replayed(nodes: DataFrame, read: Callable[[], DataFrame], batches: int, folder: str, *, gap_seconds: int) -> DataFrame:
    """The final totals of documents whose nodes are dealt to batches by time, each written to a folder and taken up by a query that goes on from its checkpoint.

    `read` gives the stream of that folder (`folder`/nodes); what the query writes is in `folder`/totals, a part for each batch, so a
    repeated batch replaces itself.
    """
    spark = nodes.sparkSession
    low, high = nodes.agg(F.min(F.unix_millis("ts")), F.max(F.unix_millis("ts"))).first()
    share = F.least(F.lit(batches - 1), F.floor((F.unix_millis("ts") - F.lit(low)) * batches / F.lit(max(1, (high or 0) - (low or 0)))))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/totals/batch={number}")

    store = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        for k in range(batches if low is not None else 0):
            nodes.where(share == k).write.mode("append").parquet(f"{folder}/nodes")
            query: StreamingQuery = arriving(read(), gap_seconds=gap_seconds).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
            query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", store)
    if low is None:
        return spark.createDataFrame([], SCHEMA)
    every = spark.read.schema(SCHEMA + ", batch int").parquet(f"{folder}/totals")
    last = every.groupBy("doc_id", "start").agg(F.max_by(F.struct("last", "nodes", "repeated", "elements"), "nodes").alias("x"))
    return last.select("doc_id", "start", "x.*")
