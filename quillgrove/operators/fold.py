"""Bottom-up computations on the node table: every node's value from its children's, whatever the size of a document.

Trees are contracted by height. A round hands the values that are ready to their parents: one
shuffle by (document, parent), in which only nodes that still wait and the values made in the last round
take part; a node whose children have all arrived is done. Leaves, which hold nearly all of the text, are
done at once and send their values alone. No document is in one task, there are as many rounds as the highest tree
has levels, and each round's rows are written to the shared folder, so a lost executor costs one round's work.
A node's children meet in one row: that is the size that counts, not the document's.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from .kept import kept
from .nodes import FIELDS, field

def normal(nodes: DataFrame) -> DataFrame:
    """The rows with names and texts of fields in NFC; only rows with a character beyond U+02FF go through Python, and none if there is none."""
    wide = F.exists("fields", lambda f: f["name"].rlike(C.WIDE) | F.coalesce(f["value"].rlike(C.WIDE) & (f["kind"] == "str"), F.lit(False))) | F.coalesce(F.col("t").rlike(C.WIDE), F.lit(False))
    if nodes.where(wide).isEmpty():
        return nodes
    names, values = F.transform("fields", lambda f: f["name"]), F.transform("fields", lambda f: f["value"])
    again = F.arrays_zip(C.nfc_each(names).alias("name"), F.transform("fields", lambda f: f["kind"]).alias("kind"), C.nfc_each(values).alias("value"))
    # Values of other kinds are digits, flags or JSON as it was written; only texts are changed.
    fields = F.transform(F.arrays_zip(again.alias("x"), F.col("fields").alias("y")), lambda z: F.struct(z["x"]["name"].alias("name"), z["x"]["kind"].alias("kind"), F.when(z["x"]["kind"] == "str", z["x"]["value"]).otherwise(z["y"]["value"]).alias("value")))
    made = nodes.where(wide).withColumns({"fields": fields.cast(FIELDS), "t": F.get(C.nfc_each(F.array("t")), F.lit(0))})
    return nodes.where(~wide).unionByName(made)


def folded(nodes: DataFrame, own: Column, leaf: Callable[[Column], Column], combine: Callable[[Column, Column], Column]) -> DataFrame:
    """doc_id, pos, value of every node.

    `own` is what a node brings itself, `leaf(own)` its value without children, `combine(own, kids)` with them; kids
    are structs of `ord` and `value` in order. A table whose children's rows aren't all there raises.
    """
    base = nodes.select("doc_id", "pos", "parent_pos", "ord", F.col("n_children").alias("n"), own.alias("own"))
    done = F.col("n") == 0
    value = leaf(F.col("own"))
    state = kept(base.select("doc_id", "pos", "parent_pos", "ord", "n", F.when(~done, F.col("own")).alias("own"), F.when(done, value).alias("value"), done.alias("done")))
    kid = F.struct("ord", "value")
    state = state.withColumn("kids", F.array().cast(f"array<{state.select(kid.alias('x')).schema['x'].dataType.simpleString()}>"))
    ready: list[DataFrame] = []
    while True:
        ready.append(state.where("done").select("doc_id", "pos", "value"))
        waiting = state.where("not done")
        counts = state.agg(F.count_if("done"), F.count_if(~F.col("done"))).first()
        if not counts[1]:
            break
        if not counts[0]:
            raise ValueError(f"{counts[1]} nodes have fewer rows of children than they say")
        row = F.struct("parent_pos", "ord", "n", "own")
        stay = waiting.select("doc_id", F.col("pos").alias("at"), row.alias("row"), "kids")
        up = state.where("done and parent_pos >= 0").select("doc_id", F.col("parent_pos").alias("at"), F.lit(None).cast(stay.schema["row"].dataType).alias("row"), F.array(kid).alias("kids"))
        met = stay.unionAll(up).groupBy("doc_id", F.col("at").alias("pos")).agg(F.first("row", True).alias("row"), F.flatten(F.collect_list("kids")).alias("kids")).where("row is not null")
        state = met.select("doc_id", "pos", "row.*", F.array_sort("kids").alias("kids")).withColumn("done", F.size("kids") == F.col("n"))
        made = F.when(F.col("done"), combine(F.col("own"), F.col("kids")))
        state = kept(state.select("doc_id", "pos", "parent_pos", "ord", "n", "own", made.alias("value"), "done", F.when(~F.col("done"), F.col("kids")).otherwise(F.slice("kids", 1, 0)).alias("kids")))
    return reduce(DataFrame.unionAll, ready)


# -- identity -------------------------------------------------------------------------------


def digests(nodes: DataFrame, domain: str = "node") -> DataFrame:
    """doc_id, pos, digest of every node: the digests of `functions.trees.structural_hash`.

    A node with a value that has no canonical form (an inexact number, null, a list) has none, nor have those above it.
    """
    exact = ~F.exists("fields", lambda f: ~f["kind"].isin("bool", "int", "str"))
    pairs = F.flatten(F.transform("fields", lambda f: F.array(f["name"], f["value"])))
    head = F.concat_ws("\0", F.lit(domain), F.coalesce("t", F.lit("")), F.concat(F.lit("f"), F.size("fields").cast("string")), pairs)
    own = F.struct(F.when(exact, head).alias("head"))

    def made(head: Column, n: Column, below: Column) -> Column:
        count = F.concat(head, F.lit("\0c"), n.cast("string"), F.lit("\0")).cast("binary")
        return F.lower(F.sha2(F.concat(count, below), 256))

    def combine(own: Column, kids: Column) -> Column:
        whole = ~F.exists(kids, lambda k: k["value"].isNull())
        return F.when(whole, made(own["head"], F.size(kids), F.unhex(F.array_join(F.transform(kids, lambda k: k["value"]), ""))))

    ordered = nodes.withColumn("fields", F.array_sort("fields"))  # by their names as they are written
    return folded(normal(ordered), own, lambda own: made(own["head"], F.lit(0), F.lit(b"")), combine).withColumnRenamed("value", "digest")


# -- plain text -----------------------------------------------------------------------------

LINES = "array<string>"


def _filled(lines: Column) -> Column:
    return F.filter(lines, lambda x: ~C.blank(x))


def _physical(lines: Column) -> Column:
    """Lines as they are on a page, without blank ones; none if all are blank."""
    held = _filled(lines)
    return F.when(F.size(held) > 0, F.split(F.array_join(held, "\n"), "\n", -1)).otherwise(F.array().cast(LINES))


def _in_a_row(lines: Column) -> Column:
    return F.array_join(_filled(lines), " ")


def _indented(lines: Column, by: str) -> Column:
    return F.transform(_physical(lines), lambda x: F.concat(F.lit(by), x))


def _hanging(lines: Column, mark: Column) -> Column:
    return F.transform(_physical(lines), lambda x, i: F.concat(F.when(i == 0, F.concat(mark, F.lit(" "))).otherwise("  "), x))


def _said(own: Column, name: str) -> Column:
    return F.coalesce(own[name], F.lit("None"))


def _inline(own: Column, inner: Column) -> Column:
    """What an element shows in a line."""
    t = own["t"]
    return (
        F.when(t.isin("text", "quantity", "power", "date"), own["shown"])
        .when(t == "line-break", "\n")
        .when(t == "note-ref", F.concat(F.lit("["), _said(own, "target"), F.lit("]")))
        .when(t == "code", F.concat(F.lit("`"), inner, F.lit("`")))
        .when(t == "link", F.concat(inner, F.lit(" <"), _said(own, "href"), F.lit(">")))
        .otherwise(inner)
    )


def _lines(own: Column, inline: Column, kids: Column) -> Column:
    """The lines of an element, from those of its children."""
    t, lines = own["t"], F.flatten(F.transform(kids, lambda k: k["value"]["lines"]))
    one = lambda *parts: F.array(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))
    some = lambda s: s.isNotNull() & (s != "")
    none = F.array().cast(LINES)
    number = lambda i: F.concat((F.coalesce(own["start"].cast("long"), F.lit(1)) + i).cast("string"), F.lit("."))
    mark = lambda i: F.when(own["ordered"] == "true", number(i)).otherwise("-")
    block = (
        F.when(t == "heading", one(F.repeat(F.lit("#"), F.least(F.coalesce(own["level"].cast("int"), F.lit(1)), F.lit(6))), " ", inline))
        .when(t == "paragraph", one(inline))
        .when(t == "caption", one("(", inline, ")"))
        .when(t == "media", one("[", _said(own, "kind"), ": ", _said(own, "alt"), "]"))
        .when(t == "note", one("[", _said(own, "id"), "] ", _in_a_row(lines)))
        .when(t == "list", F.flatten(F.transform(kids, lambda k, i: _hanging(k["value"]["lines"], mark(i)))))
        .when(t == "term-list", F.flatten(F.transform(kids, lambda k: F.when(k["value"]["t"] == "term", F.array(F.concat(k["value"]["inline"], F.lit(":")))).otherwise(_indented(k["value"]["lines"], "  ")))))
        .when(t == "quote", F.concat(_indented(lines, "> "), F.when(some(own["source"]), one("> -- ", own["source"])).otherwise(none)))
        .when(t == "code-block", F.concat(one("```", F.coalesce(own["language"], F.lit(""))), F.split(inline, "\n", -1), one("```")))
        .when(t == "table", F.concat(F.when(some(own["summary"]), one("[table: ", own["summary"], "]")).otherwise(none), lines))
    )
    title = own["title"]
    close = (
        F.when(t == "document", F.concat(F.array(title, F.repeat(F.lit("="), F.length(title)), F.lit("")), lines))
        .when(t == "row", F.array(F.array_join(F.transform(kids, lambda k: _in_a_row(k["value"]["lines"])), " | ")))
        .when(t.isin("text", "quantity", "power", "date", "emphasis", "strong", "code", "link", "reference", "note-ref", "line-break"), F.array(inline))
        .otherwise(lines)
    )
    return F.when(block.isNotNull(), F.concat(block, F.array(F.lit("")))).otherwise(close)


#: Fields that plain text is made from.
READ = ("target", "href", "start", "ordered", "level", "kind", "alt", "id", "source", "language", "summary", "title")


def plain_lines(nodes: DataFrame) -> DataFrame:
    """doc_id, pos, value (t, inline, lines) of every node of base-layer documents."""
    t = F.col("t")
    integer = lambda k: F.coalesce(field(k, "int").cast("decimal(38,0)"), F.lit(0))
    shown = (
        F.when(t == "text", F.coalesce(field("v"), F.lit("")))
        .when(t == "quantity", C.quantity_text(integer("significand"), F.coalesce(field("scale").cast("int"), F.lit(0)), field("unit")))
        .when(t == "power", C.power_text(F.coalesce(field("base"), F.lit("")), F.coalesce(field("exponent"), F.lit(""))))
        .when(t == "date", F.coalesce(field("value"), F.lit("")))
    )
    own = F.struct(F.col("t"), shown.alias("shown"), *[field(k).alias(k) for k in READ])
    value = lambda own, inline, lines: F.struct(own["t"].alias("t"), inline.alias("inline"), lines.alias("lines"))
    no_kids = F.array().cast("array<struct<ord:int,value:struct<t:string,inline:string,lines:array<string>>>>")

    def leaf(own: Column) -> Column:
        inline = _inline(own, F.lit(""))
        return value(own, inline, _lines(own, inline, no_kids))

    def combine(own: Column, kids: Column) -> Column:
        inline = _inline(own, F.array_join(F.transform(kids, lambda k: k["value"]["inline"]), ""))
        return value(own, inline, _lines(own, inline, kids))

    return folded(normal(nodes), own, leaf, combine)


def plain_text(nodes: DataFrame) -> DataFrame:
    """doc_id, plain: the text of base-layer documents, equal to `functions.trees.plain_text`."""
    root = plain_lines(nodes).where("pos = 0")
    return root.select("doc_id", C.stripped_right(F.array_join(F.col("value")["lines"], "\n")).alias("plain"))
