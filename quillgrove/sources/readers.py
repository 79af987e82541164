"""Documents as rows: (doc_id, raw) from files in the forms that trees come in."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import forms, markup, records, surface, trees
from ..operators.nodes import CHARS_AT_ONCE, DOCS_AT_ONCE, in_short
from ..plans.register import Register, built_in


def files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """doc_id (file name without suffix), path, raw of every file below a path."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    held = (read.option("pathGlobFilter", pattern) if pattern else read).load(path)
    return held.select(F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1).alias("doc_id"), "path", F.col("content").alias("raw"))


def _surface(reg: Register) -> Callable[[bytes | str], object]:
    return lambda raw: surface.read(raw if isinstance(raw, str) else bytes(raw).decode(), reg)


def reader(kind: str, reg: Register | None = None, **how: str) -> Callable[[bytes | str], object]:
    """From a document's bytes to its tree: json, cbor, surface, or XML of standards, articles or laws."""
    if kind == "json":
        return trees.load_json
    if kind == "cbor":
        return lambda raw: trees.from_cbor(bytes(raw))
    if kind == "surface":
        return _surface(reg or built_in())
    if kind in markup.GENRES:
        name = how.get("doc_id", f"urn:{kind}:document")
        return lambda raw: markup.xml_document(raw if isinstance(raw, bytes) else raw.encode(), kind, name)[0]
    raise ValueError(f"no reader of {kind}")


_CONVERTED = pa.schema([("doc_id", pa.string()), ("raw", pa.string()), ("found", pa.map_(pa.string(), pa.int32()))])


def converted(rows: DataFrame, convert: Callable[..., tuple[str, dict]]) -> DataFrame:
    """doc_id, raw, found: what `convert` makes of the values after doc_id; a task holds a few documents at a time, not a whole Arrow batch of them."""
    n = len(rows.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, chars = [], 0
        for doc_id, *values in in_short(batches, n):
            raw, found = convert(*values)
            held.append((doc_id, raw, list(found.items())))
            chars += len(raw)
            if len(held) >= DOCS_AT_ONCE or chars > CHARS_AT_ONCE:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _CONVERTED, strict=True)], schema=_CONVERTED)
                held, chars = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _CONVERTED, strict=True)], schema=_CONVERTED)

    return rows.mapInArrow(run, "doc_id string, raw string, found map<string,int>")


def forms_of(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """doc_id, raw, found: a page's forms as a document's JSON, and its findings."""
    import json

    def convert(url: str | None, html: str | None) -> tuple[str, dict]:
        doc, found = forms.forms_document(url or "", html or "")
        return json.dumps(doc, ensure_ascii=False), found

    return converted(pages.select(F.col(id_col).cast("string").alias("doc_id"), url_col, html_col), convert)


def record(title: str = "Record", namespace: str = "record") -> Callable[[object, str | None], tuple[dict, dict]]:
    """From a nested record (its key and JSON text) to a document and what was found; numbers keep their digits."""

    def read(k: object, r: str | None) -> tuple[dict, dict]:
        held = trees.load_json(r) if r else {}
        held = held if isinstance(held, dict) else {"value": held}
        doc, found = records.record_document({"all": held}, f"urn:{namespace}:{k}", f"{title} {k}", [("Key", str(k))], sections="all")
        return doc, dict(found)

    return read


def records_of(rows: DataFrame, raw_col: str, *, id_col: str, title: str = "Record", namespace: str = "record") -> DataFrame:
    """doc_id, raw, found: nested records (JSON text) as documents."""
    import json

    read = record(title, namespace)

    def convert(k: str, r: str | None) -> tuple[str, dict]:
        doc, found = read(k, r)
        return json.dumps(doc, ensure_ascii=False), found

    key = F.col(id_col).cast("string")
    return converted(rows.select(key.alias("doc_id"), key.alias("key"), raw_col), convert)


@dataclass(frozen=True)
class Layout:
    """Where a kind of record keeps what: (label, key, kind) of its provenance, and the keys of the rest."""

    key: str
    title: str
    pairs: tuple[tuple[str, str, str], ...] = ()
    sections: str | None = None
    attachments: str | None = None
    signers: str | None = None
    source: str | None = None
    href: str | None = None


def labels_of(rows: DataFrame, raw_col: str, layout: Layout, labels: DataFrame, id_col: str) -> DataFrame:
    """key, known: for each record a map of the entities that it names to their labels, by a join with the table (uid, label)."""
    named = [k for _, k, kind in layout.pairs if kind in ("entity", "entities")] + ([layout.signers] if layout.signers else [])
    listed = lambda k: F.coalesce(F.from_json(F.get_json_object(raw_col, f"$.{k}"), "array<string>"), F.array_compact(F.array(F.get_json_object(raw_col, f"$.{k}"))))
    asked = rows.select(F.col(id_col).cast("string").alias("key"), F.explode(F.flatten(F.array(*[listed(k) for k in named]))).alias("uid")).distinct()
    met = asked.join(labels.select(F.col("uid").cast("string").alias("uid"), "label"), "uid").where("label is not null")
    return met.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("uid", "label"))).alias("known"))


def laid_out(rows: DataFrame, raw_col: str, layout: Layout, *, id_col: str, labels: DataFrame | None = None, namespace: str = "record") -> DataFrame:
    """doc_id, raw, found: records (JSON text) of a layout as documents, entities by their labels."""
    import json

    @F.pandas_udf("raw string, found map<string,int>")
    def convert(key, raw, known):
        import pandas as pd

        out = []
        consumed = tuple(k for _, k, _ in layout.pairs) + (layout.title,)
        for k, r, names in zip(key, raw, known, strict=True):
            record = trees.load_json(r) if r else {}
            record, said = record if isinstance(record, dict) else {"value": record}, dict(names or ())
            doc, found = records.record_document(
                record, f"urn:{namespace}:{k}", str(record.get(layout.title) or record.get(layout.key) or k), records.provenance_of(record, layout.pairs, said), consumed=consumed, sections=layout.sections,
                attachments=layout.attachments, signers=layout.signers, source=layout.source, key=layout.key, href=layout.href, labels=said,
            )
            out.append((json.dumps(doc, ensure_ascii=False, default=lambda x: x.lexeme), dict(found)))
        return pd.DataFrame({"raw": [a for a, _ in out], "found": [b for _, b in out]})

    key = F.col(id_col).cast("string")
    held = rows.select(key.alias("key"), F.col(raw_col).alias("x"))
    if labels is not None:
        held = held.join(labels_of(rows, raw_col, layout, labels, id_col), "key", "left")
    else:
        held = held.withColumn("known", F.lit(None).cast("map<string,string>"))
    return held.select(F.col("key").alias("doc_id"), convert("key", "x", "known").alias("y")).select("doc_id", "y.raw", "y.found")


def xml_of(rows: DataFrame, raw_col: str, genre: str, *, id_col: str, namespace: str | None = None) -> DataFrame:
    """doc_id, raw, found, missed: XML of a genre as documents, each with an id of its own.

    `missed` are the strings of the source that no unit and no line of the document shows; what can't be read
    as XML has a null `raw` and one finding.
    """
    import json

    @F.pandas_udf("raw string, found map<string,int>, missed array<string>")
    def convert(key, raw):
        import pandas as pd

        out = []
        for k, r in zip(key, raw, strict=True):
            source = r.encode() if isinstance(r, str) else bytes(r or b"")
            try:
                doc, found = markup.xml_document(source, genre, f"urn:{namespace or genre}:{k}")
            except markup.ET.ParseError:
                out.append((None, {"unreadable": 1}, []))
                continue
            shown = " ".join(" ".join(trees.content_units(doc)).split()) + "\n" + forms.squeezed(trees.plain_text(trees.lowered(doc, built_in())))
            out.append((json.dumps(doc, ensure_ascii=False), dict(found), [s for s in markup.source_strings(source, genre) if s not in shown]))
        return pd.DataFrame({"raw": [x[0] for x in out], "found": [x[1] for x in out], "missed": [x[2] for x in out]})

    key = F.col(id_col).cast("string")
    return rows.select(key.alias("doc_id"), convert(key, F.col(raw_col)).alias("x")).select("doc_id", "x.raw", "x.found", "x.missed")


def findings(mapped: DataFrame, genre: str) -> DataFrame:
    """doc_id, genre, key, n: what mappers counted.

    For `explode` Spark would ask whether there is something before the mapper's shuffle, and so map all in the few tasks that read the files.
    """
    return mapped.select("doc_id", F.lit(genre).alias("genre"), F.explode_outer("found").alias("key", "n")).where("key is not null")
