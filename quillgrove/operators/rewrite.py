"""Rewriting documents on the node table: rows go, rows come, and all that are left are numbered without gaps.

A rewrite says for each row what it emits where it opens (rows in front of it, itself, rows that become its first
descendants) and where it closes (its last descendants), and how much deeper what is inside it goes. Both are
events in one order by document; prefix sums over them give new positions, spans and depths. Parents and
places among siblings follow from a window by document and level. All windows are within a document, so rows are
shuffled once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..plans.register import Register, dimensions
from .nodes import FIELDS, ROWS, ROWS_AT_ONCE, field

#: A row to be made: element, fields, levels below the row that makes it, and how many made rows are below it (WHOLE: all to the end of that row).
MADE = f"array<struct<t:string,fields:{FIELDS},down:int,below:int>>"
WHOLE = -1
COLUMNS = ("doc_id", "pos", "depth", "parent_pos", "ord", "t", "fields", "n_children", "malformed", "last_pos")


def no_fields() -> Column:
    return F.array().cast(FIELDS)


def one_field(name: str, kind: str, value: Column | str) -> Column:
    return F.array(F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind"), (F.lit(value) if isinstance(value, str) else value).alias("value"))).cast(FIELDS)


def new_row(t: str, fields: Column | None = None, down: int = 1, below: int = 0) -> Column:
    return F.struct(F.lit(t).alias("t"), (no_fields() if fields is None else fields).alias("fields"), F.lit(down).alias("down"), F.lit(below).alias("below"))


def new_text(v: Column, down: int = 2) -> Column:
    return new_row("text", one_field("v", "str", v), down)


def rewritten(rows: DataFrame) -> DataFrame:
    """The node table (without path and place) after a rewrite.

    `rows` has the node table's doc_id, pos, depth, parent_pos, last_pos, t, fields and malformed, and `stays` (a row that doesn't leaves its
    children to its parent), `before`, `opening`, `closing` (MADE), `inside` (levels that what is inside goes down), `run` (siblings of one number go one
    level down together, under a new row) and `around` (MADE with that new row, at the first of them).
    """
    at_open = F.size("around") + F.size("before") + F.col("stays").cast("int") + F.size("opening")
    own = F.when(F.col("run").isNotNull(), 1).otherwise(0)
    row = F.struct("parent_pos", "depth", "t", "fields", "malformed", "stays", "before", "opening", "closing", "inside", "run", "around")
    open_ = F.struct(F.struct("pos", F.lit(0).alias("side"), F.lit(0).alias("inner")).alias("at"), at_open.alias("rows"), (own + F.col("inside")).alias("deeper"), row.alias("row"))
    close = F.struct(F.struct(F.col("last_pos").alias("pos"), F.lit(1).alias("side"), (-F.col("pos")).alias("inner")).alias("at"), F.size("closing").alias("rows"), (-own - F.col("inside")).alias("deeper"), F.lit(None).cast(rows.select(row.alias("r")).schema["r"].dataType).alias("row"))
    events = rows.select("doc_id", "pos", F.explode(F.array(open_, close)).alias("e")).select("doc_id", "pos", "e.*")
    so_far = Window.partitionBy("doc_id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = events.withColumns({"emitted": F.sum("rows").over(so_far), "deep": F.sum("deeper").over(so_far)})
    opened = F.col("row").isNotNull()
    spans = summed.groupBy("doc_id", "pos").agg(
        F.first("row", True).alias("r"),
        F.max(F.when(opened, F.col("emitted") - F.col("rows"))).alias("start"),
        F.max(F.when(opened, F.col("deep") - F.col("row.inside"))).alias("deep"),
        F.max(F.when(~opened, F.col("emitted"))).alias("end"),
    ).select("doc_id", "r.*", "start", (F.col("depth") + F.col("deep")).alias("level"), "end")
    together = Window.partitionBy("doc_id", "parent_pos", "run")
    held = spans.withColumn("run_end", F.max("end").over(together))
    nothing = F.array().cast("array<string>")

    def emitted(made: Column, first: Column, end: Column, up: int = 0) -> Column:
        at = lambda i: (first + i).cast("int")
        return F.transform(made, lambda m, i: F.struct(at(i).alias("pos"), (F.col("level") + m["down"] - up).cast("int").alias("depth"), m["t"].alias("t"), m["fields"].alias("fields"), nothing.alias("malformed"), F.when(m["below"] == WHOLE, end - 1).otherwise(at(i) + m["below"]).cast("int").alias("last_pos")))

    around, before, stays = F.size("around"), F.size("before"), F.col("stays").cast("int")
    own_at = F.col("start") + around + before
    itself = F.struct(own_at.cast("int").alias("pos"), F.col("level").cast("int").alias("depth"), F.col("t"), F.col("fields"), F.col("malformed"), (F.col("end") - 1).cast("int").alias("last_pos"))
    every = F.concat(
        emitted(F.col("around"), F.col("start"), F.col("run_end"), 1),
        emitted(F.col("before"), F.col("start") + around, F.col("end")),
        F.filter(F.array(itself), lambda _: F.col("stays")),
        emitted(F.col("opening"), own_at + stays, F.col("end")),
        emitted(F.col("closing"), F.col("end") - F.size("closing"), F.col("end")),
    )
    return placed(held.select("doc_id", F.inline(every)))


def placed(rows: DataFrame) -> DataFrame:
    """parent_pos, ord and n_children of rows that have pos and depth, in document order without gaps."""
    row = F.struct("pos", "depth", "t", "fields", "malformed", "last_pos")
    child = F.struct(F.col("depth").alias("level"), "pos", row.alias("row"))
    parent = F.struct((F.col("depth") + 1).alias("level"), "pos", F.lit(None).cast(rows.select(row.alias("r")).schema["r"].dataType).alias("row"))
    w = Window.partitionBy("doc_id", "level").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = rows.select("doc_id", F.inline(F.array(child, parent))).withColumn("nth", F.count("row").over(w))
    up = lambda c: F.last(F.when(F.col("row").isNull(), F.col(c)), True).over(w)
    found = both.withColumns({"parent": up("pos"), "ahead": up("nth")}).where("row is not null")
    linked = found.select("doc_id", "row", F.coalesce("parent", F.lit(-1)).alias("parent_pos"), F.when(F.col("parent").isNull(), 0).otherwise(F.col("nth") - F.col("ahead") - 1).cast("int").alias("ord"))
    # A row counts for its parent; both meet by document and position.
    here = F.struct(F.col("row.pos").alias("at"), F.struct("row", "parent_pos", "ord").alias("x"), F.lit(0).alias("n"))
    above = F.struct(F.col("parent_pos").alias("at"), F.lit(None).cast(linked.select(F.struct("row", "parent_pos", "ord").alias("x")).schema["x"].dataType).alias("x"), F.lit(1).alias("n"))
    met = linked.select("doc_id", F.inline(F.array(here, above))).groupBy("doc_id", "at").agg(F.first("x", True).alias("x"), F.sum("n").cast("int").alias("n_children"))
    return met.where("x is not null").select("doc_id", "x.row.*", "x.parent_pos", "x.ord", "n_children").select(*COLUMNS)


def located(nodes: DataFrame) -> DataFrame:
    """The rows with `path` and `place`, from the numbers and names of the rows above each: one running value a level."""
    levels = nodes.agg(F.max("depth")).first()[0] or 0
    so_far = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    name = F.concat(F.col("ord").cast("string"), F.lit(":"), F.coalesce("t", F.lit("None")))
    above = [F.last(F.when(F.col("depth") == k, F.struct("ord", name.alias("name"))), True).over(so_far) for k in range(1, levels + 1)]
    chain = F.slice(F.array(*above), 1, F.col("depth")) if levels else F.array().cast("array<struct<ord:int,name:string>>")
    held = nodes.withColumn("__above", chain)
    path = F.transform("__above", lambda x: x["ord"])
    return held.withColumns({"path": path.cast("array<int>"), "place": F.concat(F.lit("/"), F.array_join(F.transform("__above", lambda x: x["name"]), "/"))}).drop("__above")


def asked(rows: DataFrame, **changes: Column) -> DataFrame:
    """The columns of a rewrite; what isn't named stays as it is."""
    made = F.array().cast(MADE)
    asked = {"t": F.col("t"), "fields": F.col("fields"), "stays": F.lit(True), "before": made, "opening": made, "closing": made, "inside": F.lit(0), "run": F.lit(None).cast("long"), "around": made} | changes
    kinds = {"before": MADE, "opening": MADE, "closing": MADE, "around": MADE, "fields": FIELDS}
    return rows.select("doc_id", "pos", "depth", "parent_pos", "last_pos", "malformed", *[(c.cast(kinds[k]) if k in kinds else c).alias(k) for k, c in asked.items()])


# -- rows that only go -----------------------------------------------------------------------

_LEFT = pa.schema([ROWS.field(c) for c in COLUMNS])


def left_of(rows: pa.Table) -> pa.Table:
    """What is left of whole documents, rows in order of document and position; the last column says whether a row stays, those between are numbers that it keeps."""
    n = rows.num_rows
    ids = rows.column("doc_id").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    pos, up, last, depth = (rows.column(c).to_numpy().astype(np.int64) for c in ("pos", "parent_pos", "last_pos", "depth"))
    doc = np.cumsum(np.diff(ids, prepend=ids[:1]) != 0) if n else np.zeros(0, np.int64)
    wide = max(pos.max(initial=0), last.max(initial=0)) + 2
    at = doc * wide + pos
    parent = np.where(up >= 0, np.searchsorted(at, doc * wide + np.maximum(up, 0)), -1)
    end = np.searchsorted(at, doc * wide + last, "right")  # the row after the span
    flag = rows.column(-1).to_numpy().astype(bool)

    def above(marks: np.ndarray) -> np.ndarray:
        """How many of the marked rows each row is below."""
        change = np.zeros(n + 1, np.int64)
        np.add.at(change, np.flatnonzero(marks) + 1, 1)
        np.add.at(change, np.maximum(end[marks], np.flatnonzero(marks) + 1), -1)
        return np.cumsum(change)[:n]

    gone = ~flag
    levels = depth - above(gone)
    while (lost := (parent >= 0) & gone[parent]).any():
        parent[lost] = parent[parent[lost]]
    number = np.concatenate([[0], np.cumsum(flag)])  # rows left before each
    first = number[np.searchsorted(doc, doc)]  # those of earlier documents
    kept_at = np.flatnonzero(flag)
    own = parent[kept_at]
    by_parent = np.argsort(own, kind="stable")
    sorted_ = own[by_parent]
    nth = np.zeros(len(kept_at), np.int64)
    nth[by_parent] = np.arange(len(sorted_)) - np.searchsorted(sorted_, sorted_)
    kids = np.bincount(own[own >= 0], minlength=n)[kept_at]
    table = rows.take(pa.array(kept_at))
    start = first[kept_at]
    made = {"pos": number[kept_at] - start, "depth": levels[kept_at], "parent_pos": np.where(own >= 0, number[np.maximum(own, 0)] - start, -1), "ord": np.where(own >= 0, nth, 0), "n_children": kids, "last_pos": number[end[kept_at]] - start - 1}
    schema = pa.schema([*_LEFT, *[(c, pa.int32()) for c in rows.column_names[len(_LEFT) : -1]]])
    return pa.table([pa.array(made[f.name], f.type) if f.name in made else table.column(f.name).cast(f.type) for f in schema], schema=schema)


def left(rows: DataFrame, stays: Column, *more: str) -> DataFrame:
    """The node table (without path and place) without the rows that don't stay, whose children go to their parents; a document's rows are in memory at once.

    `more` are columns of integers that go along. A window puts the rows in order, so that they are shuffled only if they aren't by document yet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            held.append(batch)
            names = batch.column(0)
            if sum(b.num_rows for b in held) >= ROWS_AT_ONCE and held[0].column(0)[0] != names[-1]:
                table = pa.Table.from_batches(held)
                ids = table.column(0).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                whole = int(np.flatnonzero(ids != ids[-1])[-1]) + 1  # the last document may go on
                yield from left_of(table.slice(0, whole)).to_batches()
                held = table.slice(whole).to_batches()
        if held:
            yield from left_of(pa.Table.from_batches(held)).to_batches()

    kinds = {"fields": FIELDS, "malformed": "array<string>", "doc_id": "string", "t": "string"}
    flagged = rows.select(*COLUMNS, *more, F.coalesce(stays, F.lit(False)).alias("__flag"))
    # The window is over the flag, so that Spark puts it behind those that the flag is from.
    so_far = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    in_order = flagged.select(*COLUMNS, *more, F.sum(F.col("__flag").cast("int")).over(so_far).cast("int").alias("__nth"), "__flag").sortWithinPartitions("doc_id", "pos")
    return in_order.mapInArrow(run, ", ".join(f"{c} {kinds.get(c, 'int')}" for c in (*COLUMNS, *more, "__nth"))).drop("__nth")


# -- pruning ---------------------------------------------------------------------------------


def pruned(nodes: DataFrame, reg: Register) -> DataFrame:
    """Without blank texts, and without containers that hold nothing else; the root stays.

    A container stays if a row that counts by itself is in its span: the next such row at or after it, a running minimum
    from the end of the document, tells. What counts: texts that aren't blank, elements without content in the register, and
    unknown elements without children. A known container without children is empty, however it was written.
    """
    levels = nodes.agg(F.max("depth")).first()[0] or 0
    known = F.broadcast(dimensions(nodes.sparkSession, reg)["elements"].select("t", "model"))
    held = nodes.join(known, "t", "left")
    text = F.col("t") == "text"
    counts = F.coalesce(F.when(text, ~C.blank(F.coalesce(field("v"), F.lit("")))).otherwise((F.col("model") == "none") | (F.col("model").isNull() & (F.col("n_children") == 0))), F.col("n_children") == 0)
    onwards = Window.partitionBy("doc_id").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    following = F.min(F.when(counts, F.col("pos"))).over(onwards)
    stays = F.when(text.eqNullSafe(True), counts).otherwise(F.coalesce(following <= F.col("last_pos"), F.lit(False)) | (F.col("depth") == 0))
    stayed = held.withColumn("__stays", stays).where("__stays")
    return renumbered(stayed, levels) if levels <= LEVELS else rewritten(asked(stayed))


#: Levels up to which rows are numbered anew by running values for each level.
LEVELS = 24


def renumbered(rows: DataFrame, levels: int) -> DataFrame:
    """The node table (without path and place) after whole subtrees went.

    Running values for each level, from either end of the document, tell how many rows are below each row and which is above
    it: between a row and the next one of its level, those a level deeper are its children.
    """
    every = range(levels + 1)
    back, ahead = (Window.partitionBy("doc_id").orderBy(o) for o in (F.desc("pos"), F.asc("pos")))
    now, earlier = (Window.unboundedPreceding, Window.currentRow), (Window.unboundedPreceding, -1)
    at = lambda k, c: F.when(F.col("depth") == k, F.col(c))
    of = lambda name, by: F.get(F.array(*[F.col(f"__{name}{k}") for k in every]), by)
    deep = F.col("depth")

    def counted(held: DataFrame, w: Window) -> DataFrame:
        """`__n`: rows so far; `__of<k>`: those of a level; `__was<k>`: those of the level below when the last one of level k came."""
        held = held.withColumns({"__n": F.count("*").over(w.rowsBetween(*now)), **{f"__of{k}": F.count(at(k, "pos")).over(w.rowsBetween(*now)) for k in every}})
        return held.withColumns({f"__was{k}": F.last(at(k, f"__of{k + 1}"), True).over(w.rowsBetween(*earlier)) for k in every if k < levels} | {f"__was{levels}": F.lit(0)})

    held = counted(rows.select(*COLUMNS), back).withColumns({f"__end{k}": F.max(at(k, "__n")).over(back.rowsBetween(*earlier)) for k in every})
    # What is after a row's span begins with the next row that isn't deeper.
    after = F.array_max(F.slice(F.array(F.lit(0).cast("long"), *[F.col(f"__end{k}") for k in every]), 1, deep + 2))
    held = held.select(*COLUMNS, (F.col("__n") - 1 - after).alias("__below"), F.coalesce(of("of", deep + 1) - F.coalesce(of("was", deep), F.lit(0)), F.lit(0)).alias("__kids"))
    held = counted(held, ahead).withColumns({f"__at{k}": F.last(at(k, "__n"), True).over(ahead.rowsBetween(*earlier)) for k in every})
    top = deep == 0
    new = {"pos": F.col("__n") - 1, "parent_pos": F.when(top, -1).otherwise(of("at", deep - 1) - 1), "ord": F.when(top, 0).otherwise(of("of", deep) - of("was", deep - 1) - 1), "n_children": F.col("__kids"), "last_pos": F.col("__n") - 1 + F.col("__below")}
    return held.select(*[new[c].cast("int").alias(c) if c in new else F.col(c) for c in COLUMNS])


# -- the base layer ---------------------------------------------------------------------------

#: Elements whose row only changes its name, and those that become a list (ordered or not).
RENAMED = {**dict.fromkeys(("article", "abstract", "sidebar", "tab-group", "admonition", "disclosure", "tab", "form"), "section"), **dict.fromkeys(("signature-block", "provenance"), "term-list"), "citation": "reference", "field": "definition", "field-text": "paragraph", "field-option": "item", "submit": "paragraph", "state-link": "link", "rendering": "figure"}
LISTS = {"contents": "true", "bibliography": "false", "field-choice": "false"}
#: Elements that a heading goes into, and the field that it shows.
TITLED = {"admonition": "kind", "disclosure": "summary", "tab": "label"}
LIFTED, DROPPED = "table-section", "payload"
#: Elements whose content is a field; what is below them isn't carried.
FILLED = {"field-text": "value", "submit": "label"}
PAIRED = ("field", "term", "definition")


def _formless(reg: Register) -> tuple[set[str], set[str]]:
    """Elements above the base layer, and those of them that have no form there."""
    above = {t for t, e in reg.elements.items() if e.layer > 0}
    return above, above - {*RENAMED, *LISTS, LIFTED, DROPPED}


def without_form(nodes: DataFrame, reg: Register) -> DataFrame:
    """doc_id, t, n: what keeps documents from being lowered; `lowered` leaves these documents out."""
    return nodes.where(F.col("t").isin(*_formless(reg)[1])).groupBy("doc_id", "t").agg(F.count("*").alias("n"))


def lowered(nodes: DataFrame, reg: Register) -> DataFrame:
    """Documents in base-layer elements only, as rows: `functions.trees.lowered`, flattened.

    Elements that the register doesn't know stay. A label or title that is missing (in no valid document) is an empty text. Documents with an
    element above the base layer that has no form there are left out. What is in a table section of a form, which
    no valid document has, isn't paired.
    """
    above, formless = _formless(reg)
    if formless:
        nodes = nodes.join(without_form(nodes, reg).select("doc_id").distinct(), "doc_id", "left_anti")
    t = F.when(F.col("t").isin(*above), F.col("t"))  # the element, if a rule is for it
    said = lambda k: F.coalesce(field(k), F.lit(""))

    # 1. Rows below what shows a field instead, and payloads, go.
    earlier = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    hidden = F.max(F.when(t.isin(*FILLED, DROPPED), F.col("last_pos"))).over(earlier)
    held = nodes.withColumn("__hidden", F.coalesce(hidden >= F.col("pos"), F.lit(False)) | F.coalesce(t == DROPPED, F.lit(False))).where("not __hidden")
    in_order = Window.partitionBy("doc_id").orderBy("pos")
    held = held.withColumn("__filled", F.coalesce(F.lead("pos").over(in_order) <= F.col("last_pos"), F.lit(False)))

    # 2. Runs of pairs among a form's children; a form heads its children's group.
    row = F.struct(*[F.col(c) for c in held.columns if c != "doc_id"])
    head = F.lit(None).cast(held.select(row.alias("r")).schema["r"].dataType)
    group = F.array(F.struct(F.col("parent_pos").alias("up"), F.col("ord").alias("nth"), row.alias("row")), F.struct(F.when(F.coalesce(t == "form", F.lit(False)), F.col("pos")).alias("up"), F.lit(-1).alias("nth"), head.alias("row")))
    groups = held.select("doc_id", F.inline(F.filter(group, lambda g: g["up"].isNotNull())))
    siblings = Window.partitionBy("doc_id", "up").orderBy("nth")
    in_form = F.max(F.col("nth") == -1).over(siblings.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    pairs = groups.withColumn("__pair", in_form & F.coalesce(F.col("row.t").isin(*PAIRED), F.lit(False)))
    pairs = pairs.withColumn("__first", F.col("__pair") & ~F.coalesce(F.lag("__pair").over(siblings), F.lit(False)))
    pairs = pairs.withColumn("__run", F.when(F.col("__pair"), F.sum(F.col("__first").cast("long")).over(siblings.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    held = pairs.where("row is not null").select("doc_id", "row.*", "__run", "__first")

    # 3. What each row becomes and brings.
    name, own = F.col("t"), F.col("fields")
    for a, b in RENAMED.items():
        name = F.when(t == a, b).otherwise(name)
    name = F.when(t.isin(*LISTS), "list").otherwise(name)
    own = F.when(t.isNull(), own).otherwise(no_fields())
    for a, ordered in LISTS.items():
        own = F.when(t == a, one_field("ordered", "bool", ordered)).otherwise(own)
    own = F.when(t == "citation", F.filter("fields", lambda f: f["name"] == "target")).when(t == "state-link", one_field("href", "str", F.concat(F.lit("?"), said("key"), F.lit("="), said("value")))).otherwise(own)
    none = F.array().cast(MADE)
    title = lambda k: F.array(new_row("heading", one_field("level", "int", "3"), 1, 1), new_text(said(k)))
    opening = none
    for a, k in TITLED.items():
        opening = F.when(t == a, title(k)).otherwise(opening)
    for a, k in FILLED.items():
        opening = F.when((t == a) & ~C.blank(said(k)), F.array(new_text(said(k), 1))).otherwise(opening)
    opening = F.when(t == "field-option", F.array(new_row("paragraph", None, 1, WHOLE))).when((t == "field") & ~F.col("__filled"), F.array(new_row("paragraph"))).otherwise(opening)
    before = F.when(t == "field", F.array(new_row("term", None, 0, 1), new_text(said("label"), 1))).otherwise(none)
    closing = F.when(t == "rendering", F.array(new_row("caption", None, 1, 1), new_text(said("fallback")))).otherwise(none)
    inside = F.when(t == LIFTED, -1).when(t == "field-option", 1).otherwise(0)
    around = F.when(F.col("__first"), F.array(new_row("term-list", None, 0, WHOLE))).otherwise(none)
    changes = {"t": name, "fields": own, "stays": F.coalesce(t != LIFTED, F.lit(True)), "before": before, "opening": opening, "closing": closing, "inside": inside, "run": F.col("__run"), "around": around}
    return rewritten(asked(held, **changes))
