"""Representations written out, and the table that a server of them needs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import trees

#: Media type: the column of a view that has it; the first is sent by default.
FORMS = {"text/html": "html", "application/json": "canonical", "text/markdown": "markdown", "text/plain": "plain", "application/cbor": "cbor"}
#: What a request may name instead of a media type.
NAMES = {"html": "text/html", "canonical": "application/json", "markdown": "text/markdown", "text": "text/plain", "cbor": "application/cbor"}


def write_views(views: DataFrame, path: str) -> None:
    views.write.mode("overwrite").parquet(path)


def served(requests: DataFrame, views: DataFrame) -> DataFrame:
    """(doc_id, accept) requests, and `form` if there is such a column, with status, media type and body.

    A form goes before the header. 404 without a document or for a form that there isn't, 406 if no form fits the header.
    """
    form = F.col("form") if "form" in requests.columns else F.lit(None).cast("string")
    named = F.lit(None).cast("string")
    for name, media in NAMES.items():
        named = F.when(form == name, media).otherwise(named)
    chosen = requests.withColumn("media", F.when(form.isNotNull(), named).otherwise(C.negotiated(F.col("accept"), list(FORMS))))
    held = chosen.join(views.withColumn("there", F.lit(True)), "doc_id", "left")
    body = F.lit(None).cast("binary")
    for media, column in FORMS.items():
        body = F.when(F.col("media") == media, F.col(column).cast("binary")).otherwise(body)
    status = F.when(F.col("there").isNull() | (form.isNotNull() & F.col("media").isNull()), 404).when(F.col("media").isNull(), 406).otherwise(200)
    return held.select("doc_id", "accept", status.alias("status"), F.when(status == 200, F.col("media")).alias("media"), F.when(status == 200, body).alias("body"))


def index(views: DataFrame) -> DataFrame:
    """A row for each document: where it is served and its root. A page of it is a range of ids."""
    return views.select("doc_id", F.concat(F.lit("/"), C.anchor(F.col("doc_id"))).alias("path"), "root")


def export(views: DataFrame, doc_id: str, path: str) -> None:
    """One document's canonical JSON, HTML and plain text, each as text below `path`."""
    for column in ("canonical", "html", "plain"):
        views.where(F.col("doc_id") == doc_id).select(F.col(column).cast("string").alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/{column}")


def crashes(docs: DataFrame, path: str | None = None, *, id_col: str = "doc_id", raw_col: str = "raw") -> DataFrame:
    """doc_id, step, error, raw of documents on which a representation fails for another reason than that the tree is no document.

    Every step is tried on every document, in Arrow batches; with a `path` the records are written there, so that each can be run again.
    """
    steps = {"canonical": trees.canonical_json, "digest": trees.structural_hash, "units": trees.content_units, "rows": trees.flattened}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for step, make in steps.items():
                    try:
                        make(trees.load_json(raw))
                    except ValueError:  # what the step refuses
                        continue
                    except Exception as e:  # noqa: BLE001 - what it should have refused, or done
                        out.append((doc_id, step, f"{type(e).__name__}: {e}", raw))
            columns = [pa.array([r[i] for r in out], pa.string()) for i in range(4)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "step", "error", "raw"])

    found = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(raw_col).cast("string").alias("raw")).mapInArrow(run, "doc_id string, step string, error string, raw string")
    if path is not None:
        found.write.mode("overwrite").parquet(path)
        return docs.sparkSession.read.parquet(path)
    return found
