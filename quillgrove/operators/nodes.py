"""The node table: one row for each node of each document, in document order."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import trees
from ..plans.register import Register

FIELDS = "array<struct<name:string,kind:string,value:string>>"
SCHEMA = f"doc_id string, pos int, path array<int>, depth int, parent_pos int, ord int, t string, fields {FIELDS}, n_children int, malformed array<string>, last_pos int, place string"


_I, _S, _SS = pa.int32(), pa.string(), pa.list_(pa.string())
ROWS = pa.schema([("doc_id", _S), ("pos", _I), ("path", pa.list_(_I)), ("depth", _I), ("parent_pos", _I), ("ord", _I), ("t", _S), ("fields", pa.list_(pa.struct([("name", _S), ("kind", _S), ("value", _S)]))), ("n_children", _I), ("malformed", _SS), ("last_pos", _I), ("place", _S)])
#: What rows may have besides: a node's children in order, and on a root what its reader found.
KIDS, FOUND = "array<struct<pos:int,t:string>>", "map<string,int>"
KINDS = {f.name: "int" if f.type == _I else "string" for f in ROWS} | {"path": "array<int>", "fields": FIELDS, "malformed": "array<string>", "kids": KIDS, "found": FOUND}
#: What the validator needs in one pass.
CHECKED = ("doc_id", "pos", "depth", "t", "fields", "n_children", "malformed", "last_pos", "place", "kids")


def _rows(table: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(table, schema=schema)


#: Documents that a task turns from Arrow into Python at a time.
DOCS_AT_ONCE = 256
#: Rows or characters of output after which a task hands a batch on.
ROWS_AT_ONCE, CHARS_AT_ONCE = 20_000, 4_000_000


def in_short(batches: Iterator[pa.RecordBatch], columns: int = 2) -> Iterator[tuple]:
    """The rows of batches as tuples; only a few documents at a time are Python's."""
    for batch in batches:
        for at in range(0, batch.num_rows, DOCS_AT_ONCE):
            part = batch.slice(at, DOCS_AT_ONCE)
            yield from zip(*[part.column(i).to_pylist() for i in range(columns)], strict=True)


def _listed(ends: list[int], values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, _I), values)


class Flat:
    """Rows of the node table as columns, filled document by document; paths and places only if they are wanted."""

    def __init__(self, columns: tuple[str, ...] | None = None) -> None:
        self.columns = columns or tuple(ROWS.names)
        self.found: list[tuple[int, dict]] = []
        self.plain: dict[str, list] = {k: [] for k in ("doc_id", "pos", "depth", "parent_pos", "ord", "t", "n_children", "last_pos", "place")}
        self.ends: dict[str, list[int]] = {k: [0] for k in ("path", "fields", "malformed")}
        self.path, self.malformed, self.names, self.kinds, self.values = [], [], [], [], []

    def __len__(self) -> int:
        return len(self.plain["pos"])

    def add(self, doc_id: str, tree: object) -> None:
        """A document's nodes in document order, as `trees.flattened` gives them; all or, if one has no row, none."""
        marks = [(x, len(x)) for x in (*self.plain.values(), *self.ends.values(), self.path, self.malformed, self.names, self.kinds, self.values)]
        try:
            self._fill(doc_id, tree)
        except Exception:
            for x, n in marks:
                del x[n:]
            raise

    def _fill(self, doc_id: str, tree: object) -> None:
        docs, poss, depths, ups, orders, ts, counts, lasts, places = self.plain.values()
        begin, path_ends, field_ends, bad_ends = len(poss), *self.ends.values()
        names, kinds, values, malformed = self.names, self.kinds, self.values, self.malformed
        traced, placed = "path" in self.columns, "place" in self.columns
        stack: list[tuple] = [(tree, (), 0, -1, 0, "")]
        pos = -1
        while stack:
            at, path, depth, parent, order, place = stack.pop()
            pos += 1
            kids: list = []
            t = None
            if not isinstance(at, dict):
                malformed.append("node")
            else:
                t = at.get("t")
                if "c" in at:
                    c = at["c"]
                    if isinstance(c, list):
                        kids = [x for x in c if isinstance(x, dict)]
                        malformed += ["child"] * (len(c) - len(kids))
                    else:
                        malformed.append("children")
                if not isinstance(t, str):
                    if "t" in at:
                        malformed.append("type")
                    t = None
                for k, v in at.items():
                    if k != "t" and k != "c":
                        kind, value = ("str", v) if type(v) is str else trees.tagged(v)
                        names.append(str(k))
                        kinds.append(kind)
                        values.append(value)
            docs.append(doc_id)
            poss.append(pos)
            depths.append(depth)
            ups.append(parent)
            orders.append(order)
            ts.append(t)
            counts.append(len(kids))
            lasts.append(pos)
            places.append(place or "/")
            if traced:
                self.path += path
            path_ends.append(len(self.path))
            field_ends.append(len(names))
            bad_ends.append(len(malformed))
            for i in range(len(kids) - 1, -1, -1):
                stack.append((kids[i], (*path, i) if traced else path, depth + 1, pos, i, f"{place}/{i}:{trees.kind_of(kids[i])}" if placed else ""))
        for at in range(len(poss) - 1, begin, -1):
            up = begin + ups[at]
            if lasts[at] > lasts[up]:
                lasts[up] = lasts[at]

    def unreadable(self, doc_id: str, why: str) -> None:
        for k, v in zip(self.plain, (doc_id, 0, 0, -1, 0, None, 0, 0, "/"), strict=True):
            self.plain[k].append(v)
        self.malformed.append(why)
        for k, held in zip(self.ends, (self.path, self.names, self.malformed), strict=True):
            self.ends[k].append(len(held))

    def _kids(self) -> pa.Array:
        """The children of each row, of all rows at once: those with a parent in order of it."""
        pos, up = (np.array(self.plain[c], np.int64) for c in ("pos", "parent_pos"))
        parents = np.where(up >= 0, np.arange(len(pos)) - pos + up, -1)
        order = np.argsort(parents, kind="stable")[np.count_nonzero(parents < 0) :]
        ends = np.concatenate([[0], np.cumsum(np.bincount(parents[order], minlength=len(pos)))])
        kids = pa.StructArray.from_arrays([pa.array(pos[order], _I), pa.array(self.plain["t"], _S).take(pa.array(order))], ["pos", "t"])
        return pa.ListArray.from_arrays(pa.array(ends, _I), kids)

    def _column(self, name: str) -> pa.Array:
        if name == "fields":
            return _listed(self.ends[name], pa.StructArray.from_arrays([pa.array(x, _S) for x in (self.names, self.kinds, self.values)], ["name", "kind", "value"]))
        if name in self.ends:
            return _listed(self.ends[name], pa.array(getattr(self, name), ROWS.field(name).type.value_type))
        if name == "kids":
            return self._kids()
        if name == "found":
            held: list = [None] * len(self)
            for at, found in self.found:
                held[at] = list(found.items())
            return pa.array(held, pa.map_(_S, _I))
        return pa.array(self.plain[name], ROWS.field(name).type)

    def batch(self) -> pa.RecordBatch:
        """The rows, of the columns asked for."""
        made = [self._column(c) for c in self.columns]
        return pa.RecordBatch.from_arrays(made, schema=pa.schema([ROWS.field(c) if c in ROWS.names else (c, x.type) for c, x in zip(self.columns, made, strict=True)]))


def from_trees(docs: DataFrame, read: Callable[..., object] | None = None, *, id_col: str = "doc_id", raw_col: str | tuple[str, ...] = "raw", columns: tuple[str, ...] | None = None) -> DataFrame:
    """Nodes of documents given as bytes or text; unreadable ones give one malformed row. `columns` are those wanted, if not all of the node table.

    With several columns of raw values, `read` takes as many. If `found` is among the columns, `read` gives the tree and what it found on the way, which stands on the root's row.
    """
    read = read or trees.load_json
    raw_cols = (raw_col,) if isinstance(raw_col, str) else raw_col
    finds = "found" in (columns or ())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Flat(columns)
        for doc_id, *raw in in_short(batches, 1 + len(raw_cols)):
            at = len(out)
            try:
                tree, found = read(*raw) if finds else (read(*raw), None)
                out.add(doc_id, tree)
                if found:
                    out.found.append((at, found))
            except (ValueError, TypeError, IndexError, KeyError, RecursionError) as e:
                out.unreadable(doc_id, f"unreadable: {type(e).__name__}")
            if len(out) > ROWS_AT_ONCE:
                yield out.batch()
                out = Flat(columns)
        yield out.batch()

    return docs.select(F.col(id_col).cast("string").alias("doc_id"), *raw_cols).mapInArrow(run, ", ".join(f"{c} {KINDS[c]}" for c in columns) if columns else SCHEMA)


def written(tree: object) -> str:
    """JSON of a tree with inexact numbers as they were written."""
    raw = json.dumps(tree, ensure_ascii=False, default=lambda x: f"\0{x.lexeme}\0")
    return re.sub(r'"\\u0000([^"]*?)\\u0000"', r"\1", raw)


def rebuilt(nodes: DataFrame) -> DataFrame:
    """doc_id and the tree's JSON, from its rows; a document's rows meet in one group."""

    def build(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        return pa.table({"doc_id": [rows[0]["doc_id"]], "raw": [written(trees.from_rows(rows))]})

    return nodes.groupBy("doc_id").applyInArrow(build, "doc_id string, raw string")


def field(name: str, kind: str | None = None) -> Column:
    """A node's field as text, null where it isn't there."""
    held = F.filter("fields", lambda f: (f["name"] == name) & ((f["kind"] == kind) if kind else F.lit(True)))
    return F.get(held, F.lit(0))["value"]


def from_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", namespace: str = "corpus") -> DataFrame:
    """Nodes of plain texts, in the JVM alone: a paragraph with one text for each line that isn't blank."""
    doc = F.col(id_col).cast("string")
    lines = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1), lambda x: F.trim(x) != "")
    made = lambda *pairs: F.array(*[F.struct(F.lit(k).alias("name"), F.lit("str").alias("kind"), v.alias("value")) for k, v in pairs])
    none = F.array().cast(FIELDS)
    base = docs.select(doc.alias("doc_id"), lines.alias("lines"), (F.coalesce(F.col(lang_col), F.lit("en")) if lang_col else F.lit("en")).alias("lang"))
    n = F.size("lines")
    shape = lambda pos, path, depth, parent, order, t, fields, kids, last, place: F.struct(pos.cast("int").alias("pos"), path.cast("array<int>").alias("path"), F.lit(depth).alias("depth"), parent.cast("int").alias("parent_pos"), order.cast("int").alias("ord"), F.lit(t).alias("t"), fields.cast(FIELDS).alias("fields"), kids.cast("int").alias("n_children"), F.array().cast("array<string>").alias("malformed"), last.cast("int").alias("last_pos"), place.alias("place"))
    root = shape(F.lit(0), F.array(), 0, F.lit(-1), F.lit(0), "document", made(("id", F.concat(F.lit(f"urn:{namespace}:"), F.col("doc_id"))), ("lang", F.col("lang")), ("title", F.concat(F.lit("Document "), F.col("doc_id")))), n, n * 2, F.lit("/"))

    def pair(line: Column, i: Column) -> Column:
        place = F.concat(F.lit("/"), i.cast("string"), F.lit(":paragraph"))
        return F.array(
            shape(i * 2 + 1, F.array(i), 1, F.lit(0), i, "paragraph", none, F.lit(1), i * 2 + 2, place),
            shape(i * 2 + 2, F.array(i, F.lit(0)), 2, i * 2 + 1, F.lit(0), "text", made(("v", line)), F.lit(0), i * 2 + 2, F.concat(place, F.lit("/0:text"))),
        )

    rows = F.concat(F.array(root), F.flatten(F.transform("lines", pair)))
    return base.select("doc_id", F.inline(rows)).select(*[c.split(" ")[0] for c in SCHEMA.replace("name:string,kind:string,value:string", "x").split(", ")])


def views(docs: DataFrame, reg: Register, read: Callable[[bytes], object] | None = None, *, id_col: str = "doc_id", raw_col: str = "raw", domain: str = "node", columns: tuple[str, ...] | None = None, more: tuple[tuple[str, ...], Callable[[dict], dict], dict[str, str]] | None = None) -> DataFrame:
    """Representations and digests of each document, all or the columns asked for; null where the tree has none. `markdown` is the surface.

    `more` are columns made from others that needn't be given themselves: those, the function from them, and the flags (boolean) or texts that it gives.
    """
    from ..functions import surface

    read, tag = read or trees.load_json, domain.encode()
    # Each is made from the tree, its base-layer form or its blocks' digests; those are made once, if they are needed.
    made: dict[str, tuple[str, Callable]] = {
        "canonical": ("doc", trees.canonical_json), "cbor": ("doc", trees.cbor), "surface": ("doc", surface.write), "markdown": ("doc", surface.write), "digest": ("doc", lambda d: trees.structural_hash(d, tag).hex()), "units": ("doc", trees.content_units),
        "base": ("base", trees.canonical_json), "html": ("base", trees.to_html), "plain": ("base", trees.plain_text), "base_units": ("base", trees.content_units),
        "root": ("blocks", lambda b: trees.merkle_root(b).hex()), "blocks": ("blocks", len),
    }
    wanted = columns or tuple(c for c in made if c != "markdown")
    needed, derive, derived = more or ((), lambda held: {}, {})
    own = tuple(dict.fromkeys([*(c for c in wanted if c not in derived), *needed]))
    kinds = {**{c: (k, pa.bool_() if k == "boolean" else _S) for c, k in derived.items()}, **dict.fromkeys(("canonical", "cbor", "base"), ("binary", pa.binary())), **dict.fromkeys(("units", "base_units"), ("array<string>", _SS)), "blocks": ("int", _I)}
    schema = pa.schema([("doc_id", _S), *[(c, kinds.get(c, ("string", _S))[1]) for c in wanted]])

    def view(raw: object) -> dict:
        sources: dict[str, object] = {"doc": read(raw)}
        for source, make in (("base", lambda d: trees.lowered(d, reg)), ("blocks", lambda d: trees.block_digests(d, reg, tag))):
            if any(made[c][0] == source for c in own):
                sources[source] = make(sources["doc"])
        held = {c: made[c][1](sources[made[c][0]]) for c in own}
        held |= derive(held)
        return {c: held[c] for c in wanted}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, chars = [], 0
        for doc_id, raw in in_short(batches):
            try:
                found = view(raw)
            except (ValueError, TypeError, KeyError, AttributeError, IndexError):
                found = dict.fromkeys(wanted)
            out.append({"doc_id": doc_id, **found})
            chars += len(raw or "")
            if chars > CHARS_AT_ONCE or len(out) >= ROWS_AT_ONCE:
                yield _rows(out, schema)
                out, chars = [], 0
        yield _rows(out, schema)

    ddl = "doc_id string, " + ", ".join(f"{c} {kinds.get(c, ('string',))[0]}" for c in wanted)
    return docs.select(F.col(id_col).cast("string").alias("doc_id"), raw_col).mapInArrow(run, ddl)
