"""Large XML documents in pieces: cut in front of sections, mapped in parallel, joined on the node table.

A document of millions of nodes isn't mapped by one task: one pass cuts it, its pieces are dealt anew and mapped wherever there is room,
and what needs the whole is done on rows, which are shuffled by document once: positions and places by sums over the pieces before, the numbers of notes
likewise, equal ids and references to ids that don't exist by a window and a rewrite. Mapped pieces and the result are all that is kept.
"""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import markup
from ..operators import rewrite
from ..operators.kept import kept
from ..operators.nodes import FIELDS, Flat, field

ROW = f"struct<pos:int,depth:int,parent_pos:int,ord:int,t:string,fields:{FIELDS},n_children:int,malformed:array<string>,last_pos:int>"
REFERRING = ("reference", "citation", "note-ref")
#: Characters of XML after which a piece ends in front of the next section.
PIECE = 65_536


def cut(rows: DataFrame, raw_col: str, genre: str, *, id_col: str, namespace: str | None = None) -> DataFrame:
    """doc_id, piece, kind, content, fields, cited of every document; one that can't be read has the one piece `unreadable`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                source = raw.encode() if isinstance(raw, str) else bytes(raw or b"")
                try:
                    fields, cited, found = markup.pieces(source, genre, f"urn:{namespace or genre}:{key}", PIECE)
                except ET.ParseError:
                    fields, cited, found = {}, set(), [("unreadable", "")]
                out += [(key, i, kind, content, json.dumps(fields), sorted(cited)) for i, (kind, content) in enumerate(found)]
            kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["doc_id", "piece", "kind", "content", "fields", "cited"])

    return rows.select(F.col(id_col).cast("string").alias("doc_id"), raw_col).mapInArrow(run, "doc_id string, piece int, kind string, content string, fields string, cited array<string>")


def mapped(pieces: DataFrame, genre: str) -> DataFrame:
    """doc_id, piece, fields, nodes (rows of the piece's trees, from position 0), tops (how many trees), notes, found; what can't be read has null fields."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, flat, ends = [], Flat(), [0]
            for r in batch.to_pylist():
                if r["kind"] == "unreadable":
                    flat.add(r["doc_id"], {"t": "piece"})
                    ends.append(len(flat))
                    out.append((r["doc_id"], r["piece"], None, 0, 0, [("unreadable", 1)]))
                    continue
                kids, found, notes = markup.piece_nodes(r["kind"], r["content"], genre, set(r["cited"]))
                # Flattened under a root of their own, which `trimmed` leaves out.
                flat.add(r["doc_id"], {"t": "piece", "c": kids})
                ends.append(len(flat))
                out.append((r["doc_id"], r["piece"], r["fields"], len(kids), notes, list(found.items())))
            doc, piece, fields, tops, notes, found = zip(*out, strict=True) if out else ((),) * 6
            columns = {"doc_id": doc, "piece": piece, "fields": fields, "tops": tops, "notes": notes, "found": found}
            yield pa.RecordBatch.from_arrays([trimmed(flat.batch(), ends) if f.name == "nodes" else pa.array(columns[f.name], f.type) for f in SCHEMA], schema=SCHEMA)

    return pieces.mapInArrow(run, f"doc_id string, piece int, fields string, nodes array<{ROW}>, tops int, notes int, found map<string,int>")


_FIELDS = pa.list_(pa.struct([("name", pa.string()), ("kind", pa.string()), ("value", pa.string())]))
_ROW = pa.struct([("pos", pa.int32()), ("depth", pa.int32()), ("parent_pos", pa.int32()), ("ord", pa.int32()), ("t", pa.string()), ("fields", _FIELDS), ("n_children", pa.int32()), ("malformed", pa.list_(pa.string())), ("last_pos", pa.int32())])
SCHEMA = pa.schema([("doc_id", pa.string()), ("piece", pa.int32()), ("fields", pa.string()), ("nodes", pa.list_(_ROW)), ("tops", pa.int32()), ("notes", pa.int32()), ("found", pa.map_(pa.string(), pa.int32()))])


def trimmed(rows: pa.RecordBatch, ends: list[int]) -> pa.Array:
    """The rows of trees, each tree's in one list, without its root; positions begin after it."""
    keep = np.ones(rows.num_rows, bool)
    keep[ends[:-1]] = False
    left = rows.filter(pa.array(keep))
    less = lambda c: pc.subtract(left.column(c), pa.scalar(1, pa.int32()))
    values = pa.StructArray.from_arrays([less(f.name) if f.name in ("pos", "parent_pos", "last_pos") else left.column(f.name) for f in _ROW], fields=list(_ROW))
    return pa.ListArray.from_arrays(pa.array(np.array(ends) - np.arange(len(ends)), pa.int32()), values)


def joined(done: DataFrame) -> DataFrame:
    """The node table of the whole documents, ids and references as they come. Each document's first piece brings its root, so that pieces are shuffled once and their rows are by document."""
    pieces = Window.partitionBy("doc_id").orderBy("piece")
    before, every = pieces.rowsBetween(Window.unboundedPreceding, -1), pieces.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ahead = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).cast("int")
    whole = lambda c: F.sum(c).over(every).cast("int")
    # A piece goes through the shuffle as a list for each column; a node's position is its place in them.
    lists = [f.name for f in _ROW if f.name != "pos"]
    listed = done.select("doc_id", "piece", F.col("fields").alias("own"), "tops", "notes", F.size("nodes").alias("size"), *[F.col(f"nodes.{c}").alias(c) for c in lists])
    held = listed.withColumns({"at": ahead("size") + 1, "nth": ahead("tops"), "numbered": ahead("notes"), "first": F.row_number().over(pieces) == 1, "below": whole("size"), "all_tops": whole("tops")})
    start = len(markup.UNNUMBERED) + 1

    def named(f):
        late = (f["name"] == "id") & f["value"].startswith(markup.UNNUMBERED)
        number = F.substring(f["value"], start, 12).cast("int") + F.col("numbered")
        return F.struct(f["name"].alias("name"), f["kind"].alias("kind"), F.when(late, F.concat(F.lit("fn-"), number.cast("string"))).otherwise(f["value"]).alias("value"))

    top = lambda n: n["parent_pos"] < 0
    moved = F.transform(F.arrays_zip(*lists), lambda n, i: F.struct(
        (i + F.col("at")).alias("pos"), n["depth"].alias("depth"), F.when(top(n), 0).otherwise(n["parent_pos"] + F.col("at")).alias("parent_pos"), F.when(top(n), n["ord"] + F.col("nth")).otherwise(n["ord"]).alias("ord"),
        n["t"].alias("t"), F.transform(n["fields"], named).alias("fields"), n["n_children"].alias("n_children"), n["malformed"].alias("malformed"), (n["last_pos"] + F.col("at")).alias("last_pos"),
    ))
    own = F.array(*[F.struct(F.lit(k).alias("name"), F.lit("str").alias("kind"), F.get_json_object("own", f"$.{k}").alias("value")) for k in ("id", "lang", "title")])
    root = F.struct(F.lit(0).alias("pos"), F.lit(0).alias("depth"), F.lit(-1).alias("parent_pos"), F.lit(0).alias("ord"), F.lit("document").alias("t"), own.alias("fields"), F.col("all_tops").alias("n_children"), F.array().cast("array<string>").alias("malformed"), F.col("below").alias("last_pos"))
    rows = f"array<{ROW}>"
    return held.select("doc_id", F.inline(F.concat(F.when(F.col("first"), F.array(root)).otherwise(F.array()).cast(rows), moved.cast(rows))))


def repaired(nodes: DataFrame) -> DataFrame:
    """Ids unique and references whole, over whole documents; `again` is 1 where an id went, `before` the last position on a root before references went.

    An id, those that repeat it and the references to it meet in one window by document and id, in which ids come first.
    """
    ident, refers = field("id", "str"), F.col("t").isin(*REFERRING)
    key = F.coalesce(ident, F.when(refers, field("target", "str")), F.concat(F.lit("\0"), F.col("pos").cast("string")))
    held = nodes.withColumns({"__key": key, "__asks": (ident.isNull() & F.coalesce(refers, F.lit(False))).cast("int")})
    meeting = Window.partitionBy("doc_id", "__key").orderBy("__asks", "pos")
    met = held.withColumns({"__nth": F.row_number().over(meeting), "__first": F.first("__asks").over(meeting)})
    again = (F.col("__asks") == 0) & (F.col("__nth") > 1)
    once = met.withColumns({"fields": F.when(again, F.filter("fields", lambda f: f["name"] != "id")).otherwise(F.col("fields")), "again": again.cast("int"), "before": F.when(F.col("pos") == 0, F.col("last_pos")).otherwise(0)})
    return rewrite.left(once, F.col("__first") == 0, "again", "before")


def xml_in_parts(rows: DataFrame, raw_col: str, genre: str, *, id_col: str, namespace: str | None = None, partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The node table (without path and place, kept) of XML documents, and doc_id, key, n of findings: what `readers.xml_of` gives, by pieces.

    Pieces are dealt evenly over `partitions` (those of a shuffle by default). A document that can't be read has no rows and the finding `unreadable`.
    """
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = cut(rows, raw_col, genre, id_col=id_col, namespace=namespace).repartition(n, "doc_id", "piece")
    done = kept(mapped(pieces, genre), "zstd")
    nodes = kept(repaired(joined(done.where("fields is not null").drop("found"))), "zstd")
    said = done.select("doc_id", F.explode("found").alias("key", "n")).groupBy("doc_id", "key").agg(F.sum("n").cast("int").alias("n"))
    roots = nodes.where("pos = 0").select("doc_id", F.lit("references dropped").alias("key"), (F.col("before") - F.col("last_pos")).alias("n")).where("n > 0")
    ids = nodes.where("again = 1").groupBy("doc_id").agg(F.count("*").cast("int").alias("n")).select("doc_id", F.lit("ids dropped").alias("key"), "n")
    return nodes.select(*rewrite.COLUMNS), said.unionAll(ids).unionAll(roots)
