"""The validator: every rule is a filter or a join of the node table with the register.

A diagnostic is (doc_id, pos, rule, place, detail). Below an unknown element and beyond
`MAX_DEPTH` nothing else is reported, but references are followed everywhere.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..plans.register import Register, dimensions
from .nodes import field

MAX_DEPTH = 100
#: Shapes of typed values.
SHAPES = {"hash": r"^[0-9a-f]{64}$", "urn": r"(?i)^urn:[a-z0-9][a-z0-9\-]{0,31}:\S+$", "lang": r"^[a-zA-Z]{2,8}(?:-[a-zA-Z0-9]{1,8})*$"}
DATE = r"^\d{4}(-\d{2}(-\d{2}(T\d{2}:\d{2}(:\d{2})?(Z|[+\-]\d{2}:\d{2})?)?)?)?$"
PAYLOAD = r"^-?\d+(?:[eE]-\d+)?(?:,-?\d+(?:[eE]-\d+)?)*$"
FILLED, PAIRED = ("list", "contents", "bibliography"), ("term-list", "signature-block", "provenance")
REFERRING = {"reference": "target", "note-ref": "target", "citation": "target", "rendering": "payload"}


def _checks(v: Column, kind: Column, spec: Column) -> list[tuple[str, Column]]:
    """Rules with what breaks them in a declared field."""
    t = spec["type"]
    whole, flag, written = t == "int", t == "bool", ~t.isin("int", "bool")
    text, number = written & (kind == "str"), whole & (kind == "int")
    shaped = F.lit(False)
    for name, pattern in SHAPES.items():
        shaped = shaped | ((t == name) & ~v.rlike(pattern))
    scheme = F.lower(F.regexp_extract(v, C.SCHEME, 1))
    return [
        ("R5", (whole & (kind != "int")) | (flag & (kind != "bool")) | (written & (kind != "str"))),
        ("R7", number & spec["low"].isNotNull() & ~v.try_cast("decimal(38,0)").between(spec["low"], spec["high"])),
        ("R8", text & spec["required"] & C.blank(v)),
        ("R6", text & (F.size(spec["enum"]) > 0) & ~F.array_contains(spec["enum"], v)),
        ("R10", text & (t == "path") & C.leads_elsewhere(v)),
        ("R17", text & t.isin("path", "iri") & v.rlike(C.CONTROL)),
        ("R19", text & (t == "iri") & (scheme != "") & ~scheme.isin(*C.SCHEMES)),
        ("R5", text & shaped),
    ]


def _broken(v: Column, kind: Column, spec: Column) -> Column:
    """Rules that a declared field breaks, as an array."""
    found = F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in _checks(v, kind, spec)]))
    return F.when(kind == "float", F.array(F.lit("R13"))).otherwise(found)


def _suspect() -> Column:
    """Whether a node may break a rule by itself; false for nearly all, which then need no array of what they break."""
    t = F.col("t")
    faulty = lambda f, s: (f["kind"] == "float") | F.coalesce(reduce(Column.__or__, [c for _, c in _checks(f["value"], f["kind"], s)]), F.lit(False))
    missing = F.exists("specs", lambda s: s["required"] & ~F.exists("fields", lambda f: f["name"] == s["name"]))
    unfit = F.exists("fields", lambda f: ~F.exists("specs", lambda s: (s["name"] == f["name"]) & ~faulty(f, s)))
    shape = (F.size("malformed") > 0) | F.col("et").isNull() | ((F.col("depth") == 0) & (t != "document")) | (F.col("depth") > MAX_DEPTH) | t.isin("date", "payload") | ((F.col("n_children") == 0) & t.isin(*FILLED, *PAIRED, "document"))
    return F.coalesce(shape | missing | unfit, F.lit(True))


def _said(rule: Column | str, detail: Column | str) -> Column:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(as_column(rule).alias("rule"), as_column(detail).alias("detail"))


def _own_rules() -> Column:
    """Everything that a node alone decides, as an array of (rule, detail)."""
    t, known = F.col("t"), F.col("et").isNotNull()
    none = F.array().cast("array<struct<rule:string,detail:string>>")
    one = lambda c, rule, detail: F.when(c, F.array(_said(rule, detail))).otherwise(none)
    missing = F.filter("specs", lambda s: s["required"] & ~F.exists("fields", lambda f: f["name"] == s["name"]))

    def of_field(f: Column) -> Column:
        # The field's spec is a lambda's variable: an expression would be looked up again for each rule.
        broken = F.flatten(F.transform(F.filter("specs", lambda s: s["name"] == f["name"]), lambda s: F.transform(_broken(f["value"], f["kind"], s), lambda r: _said(r, f["name"]))))
        exempt = (t == "document") & (f["name"] == "register")
        return F.when(F.exists("specs", lambda s: s["name"] == f["name"]), broken).when(exempt, none).otherwise(F.array(_said("R4", F.concat(F.lit("unknown field "), f["name"]))))

    inside = F.concat(
        F.transform(missing, lambda s: _said("R3", F.concat(F.lit("missing "), s["name"]))),
        F.flatten(F.transform("fields", of_field)),
        one(F.coalesce((t == "date") & ~field("value", "str").rlike(DATE), F.lit(False)), "R5", "value"),
        one(F.coalesce((t == "payload") & ~field("data", "str").rlike(PAYLOAD), F.lit(False)), "R14", "data"),
        one(t.isin(*FILLED) & (F.col("n_children") == 0), "R16", "no items"),
        one(t.isin(*PAIRED) & (F.col("n_children") == 0), "R16", "no term first"),
        one((t == "document") & (F.col("n_children") == 0), "R18", "empty"),
    )
    deep = F.col("depth") > MAX_DEPTH
    shallow = F.concat(F.transform("malformed", lambda m: _said("R20", m)), F.when(known, inside).otherwise(F.array(_said("R1", F.concat(F.lit("unknown element "), F.coalesce(t, F.lit("")))))))
    root = one((F.col("depth") == 0) & ~t.eqNullSafe("document"), "R2", F.concat(F.lit("the root is "), F.coalesce(t, F.lit("nothing"))))
    return F.concat(root, F.when(deep, F.array(_said("R21", f"nested deeper than {MAX_DEPTH}"))).otherwise(shallow))


#: Marks of a document's nodes: a diagnostic, an id, a reference to one, an unknown element; the last comes last at its position, as it hides what is below it only.
FOUND, NAMED, ASKED, UNKNOWN = range(4)
MARKS = "array<struct<kind:int,rule:string,place:string,detail:string,id:string,to:int,on:int,text:string>>"


def _mark(kind: int, rule: Column | str | None = None, place: Column | None = None, detail: Column | None = None, ident: Column | None = None, to: Column | None = None, on: Column | None = None, text: Column | None = None) -> Column:
    """`on` is the node that is at fault, if it isn't the one that sets the mark; a mark with a `text` counts if that isn't in NFC."""
    typed = lambda c, kind: (F.lit(c) if c is None or isinstance(c, str) else c).cast(kind)
    return F.struct(F.lit(kind).alias("kind"), typed(rule, "string").alias("rule"), typed(place, "string").alias("place"), typed(detail, "string").alias("detail"), typed(ident, "string").alias("id"), typed(to, "int").alias("to"), F.coalesce(typed(on, "int"), F.col("pos")).alias("on"), typed(text, "string").alias("text"))


def _marks() -> Column:
    """All marks that a node sets by itself; most nodes set none."""
    one = lambda c, mark: F.when(c, F.array(mark))
    ident, target = field("id", "str"), F.coalesce(*[F.when(F.col("t") == t, field(k, "str")) for t, k in REFERRING.items()])
    own = F.transform(_own_rules(), lambda d: _mark(FOUND, d["rule"], F.when(d["rule"] == "R2", "/").otherwise(F.col("place")), d["detail"]))
    known = F.col("et").isNotNull()
    has_id = F.exists("fields", lambda f: (f["name"] == "id") & (f["kind"] == "str"))
    marks = [
        F.when((F.col("depth") <= MAX_DEPTH + 1) & _suspect(), own),
        one(known & (F.col("depth") <= MAX_DEPTH) & has_id & ident.isNotNull(), _mark(NAMED, "R12", F.col("place"), ident, ident)),
        one(F.col("t").isin(*REFERRING) & target.isNotNull(), _mark(ASKED, "R11", F.concat(F.lit("/"), "t"), target, target)),
        one(~known, _mark(UNKNOWN, to=F.col("last_pos"))),
    ]
    return F.flatten(F.array_compact(F.array(*marks)))


def _kin(kid: Column, order: Column, pos: Column, following: Column, up: dict[str, Column]) -> Column:
    """What a child and its known parent decide, as marks; `up` is the parent's element, place, number of children and facts."""
    t, here, model = up["t"], up["place"], up["model"]
    none, paired = model == "none", t.isin(*PAIRED)
    unfit = F.when(none, order == 0).when(model.isin("text", "list"), F.coalesce(~F.array_contains(up["permitted"], kid), F.lit(True))).otherwise(F.coalesce(F.array_contains(up["barred"], kid), F.lit(False)))
    at = F.concat(F.when(here == "/", "").otherwise(here), F.lit("/"), order.cast("string"))
    found = [
        (unfit, _mark(FOUND, "R9", F.when(none, here).otherwise(at), F.concat(t, F.lit(" holds "), F.coalesce(kid, F.lit("nothing"))), on=pos)),
        (paired & (order == 0) & ~kid.eqNullSafe("term"), _mark(FOUND, "R16", here, F.lit("no term first"), on=pos)),
        (paired & (kid == "term") & (order < up["among"] - 1) & ~following.eqNullSafe("definition"), _mark(FOUND, "R16", here, F.lit("a term without definition"), on=pos)),
    ]
    return F.array_compact(F.array(*[F.when(c, d) for c, d in found]))


def _kin_rules() -> Column:
    """What a known parent and its children decide, as marks that the parent sets on them."""
    up = {"t": F.col("t"), "place": F.col("place"), "among": F.size("kids"), **{c: F.col(c) for c in ("model", "permitted", "barred")}}
    return F.flatten(F.transform("kids", lambda kid, i: _kin(kid["t"], i, kid["pos"], F.get("kids", i + 1)["t"], up)))


def _fitting() -> Column:
    """Whether all children surely suit their parent, without going through them one by one."""
    kinds, model = F.col("kids.t"), F.col("model")
    suited = F.when(model == "none", False).when(model.isin("text", "list"), F.size(F.array_except(kinds, F.col("permitted"))) == 0).otherwise(~F.coalesce(F.arrays_overlap(kinds, F.col("barred")), F.lit(False)))
    # Names that are permitted have no line breaks, so that pairs can be read off their lines.
    lines = F.concat(F.concat_ws("\n", kinds), F.lit("\n"))
    pairs = (model == "list") & F.startswith(lines, F.lit("term\n")) & ~lines.rlike(r"(?<![^\n])term\n(?!definition\n|\z)")
    return (F.col("n_children") == 0) | F.coalesce(suited & (~F.col("t").isin(*PAIRED) | pairs), F.lit(False))


def _quiet() -> Column:
    """Whether a node surely sets no mark: a known element below the root, with no field or with the one that it needs. No arrays are gone through here, as nearly all nodes end here."""
    t, n = F.col("t"), F.size("fields")
    f = F.get("fields", F.lit(0))
    number = f["value"].try_cast("decimal(38,0)")
    fits = F.when(F.col("sole_type") == "text", (f["kind"] == "str") & ~C.blank(f["value"]) & ((F.size("sole_enum") == 0) | F.array_contains("sole_enum", f["value"]))).when(F.col("sole_type") == "bool", f["kind"] == "bool").otherwise((f["kind"] == "int") & (F.col("sole_low").isNull() | number.between(F.col("sole_low"), F.col("sole_high"))))
    fields = F.when(n == 0, F.col("free")).when(n == 1, (f["name"] == F.col("sole")) & (f["name"] != "id") & fits).otherwise(False)
    shape = F.col("et").isNotNull() & (F.size("malformed") == 0) & F.col("depth").between(1, MAX_DEPTH) & ~t.isin("date", "payload", *REFERRING) & ((F.col("n_children") > 0) | ~t.isin(*FILLED, *PAIRED, "document"))
    return F.coalesce(shape & fields, F.lit(False))


def _sole(specs: Column) -> Column:
    """The field by which a node of the element is sound if it has no other: the one that is required, or the first if none is, one of few values before others; null where several are, or where its text may be wrong in more ways than being blank or none of the values."""
    required, listed = (F.filter(specs, f) for f in (lambda s: s["required"], lambda s: F.size(s["enum"]) > 0))
    one = F.get(F.when(F.size(required) == 0, F.concat(listed, specs)).when(F.size(required) == 1, required), F.lit(0))
    return F.when((one["type"] == "text") | (one["type"].isin("int", "bool") & (F.size(one["enum"]) == 0)), one)


def validate(nodes: DataFrame, reg: Register) -> DataFrame:
    """All diagnostics of the documents in a node table.

    One pass marks what a node decides alone or with its children; only marks go on, to windows by document for what unknown elements hide, ids and
    references. A table without `kids` is shuffled once more, as children have to meet their parents. The register is tens of rows and is broadcast.
    """
    return validate_by(nodes.withColumn("register", F.lit(reg.digest)), [reg]).drop("register")


def validate_by(nodes: DataFrame, registers: list[Register]) -> DataFrame:
    """Diagnostics of documents by the register that their rows name in `register` (a digest); a document may be there once for each of several.

    Registers are data: their elements are joined by digest and name, tens of rows a version, so any number of versions takes the plan of one.
    """
    return settled(marked_by(nodes, registers))


def _facts(spark: SparkSession, registers: list[Register]) -> DataFrame:
    """What the registers say of each element, by digest `er` and name `et`; `barred` are those that can't be its children, if its model names a class."""
    every = [dimensions(spark, r) for r in registers]
    elements_of, fields_of = (reduce(DataFrame.unionAll, [d[k] for d in every]) for k in ("elements", "fields"))
    specs = fields_of.groupBy("register", "t").agg(F.collect_list(F.struct("name", "type", "required", "enum", "low", "high")).alias("specs"))
    others = [(r.digest, x.name, [y.name for y in r.elements.values() if y.cls not in ("invisible", "inline" if x.model == "inline" else "block")]) for r in registers for x in r.elements.values()]
    elements = elements_of.join(specs, ["register", "t"], "left").join(spark.createDataFrame(others, "register string, t string, barred array<string>"), ["register", "t"])
    held = elements.withColumns({"specs": F.coalesce("specs", F.array().cast(specs.schema["specs"].dataType)), "permitted": F.when(F.col("model") == "text", F.array(F.lit("text"))).otherwise(F.col("permitted"))})
    sole = F.col("one")
    return held.withColumn("one", _sole(F.col("specs"))).select(F.col("register").alias("er"), F.col("t").alias("et"), "model", "permitted", "barred", "specs", F.expr("not exists(specs, s -> s.required)").alias("free"), sole["name"].alias("sole"), sole["type"].alias("sole_type"), sole["enum"].alias("sole_enum"), sole["low"].alias("sole_low"), sole["high"].alias("sole_high"))


def marked(nodes: DataFrame, reg: Register) -> DataFrame:
    """The rows with `register` and `marks`, for `settled`."""
    return marked_by(nodes.withColumn("register", F.lit(reg.digest)), [reg])


def marked_by(nodes: DataFrame, registers: list[Register]) -> DataFrame:
    """The rows of a node table with `marks`: everything that a node decides alone or with its children; null for nearly all.

    With `kids` in the table that is a pass over its rows. Without, children meet their parents in a window of few columns, and what they decide comes in rows of its own.
    """
    facts = _facts(nodes.sparkSession, registers)
    known = nodes.join(F.broadcast(facts), (F.col("register") == F.col("er")) & (F.col("t") == F.col("et")), "left")
    good = F.coalesce((F.col("depth") <= MAX_DEPTH) & F.col("et").isNotNull(), F.lit(False))

    # Only characters beyond U+02FF can keep a text from being in NFC.
    beyond = lambda f: (f["kind"] == "str") & f["value"].rlike(C.WIDE) & F.exists("specs", lambda s: (s["name"] == f["name"]) & ~s["type"].isin("int", "bool"))
    wide = good & F.concat_ws("", F.col("fields.value")).rlike(C.WIDE)
    unnormal = F.transform(F.filter("fields", beyond), lambda f: _mark(FOUND, "R15", F.col("place"), f["name"], text=f["value"]))
    together = "kids" in nodes.columns
    fitting = ~good | _fitting() if together else F.lit(True)
    marks = F.flatten(F.array_compact(F.array(F.when(~_quiet(), _marks()), F.when(wide, unnormal), *([F.when(~fitting, _kin_rules())] if together else []))))
    own = known.select(*nodes.columns, F.when(~(_quiet() & ~wide & fitting), F.filter(F.array(marks), lambda m: F.size(m) > 0)).alias("m")).select(*nodes.columns, F.get("m", F.lit(0)).cast(MARKS).alias("marks"))
    return own if together else own.unionByName(_met(nodes, known.where(good), facts), allowMissingColumns=True)


def _met(nodes: DataFrame, good: DataFrame, facts: DataFrame) -> DataFrame:
    """doc_id, register, pos, marks of parents: what their children decide with them, by a window."""
    doc = ["doc_id", "register"]  # sorted by what differs first
    # A parent stands in front of its children in one order by place, so that they meet in a window, not in a join of the table with itself.
    parents = good.where(F.col("last_pos") > F.col("pos")).select(*doc, "pos", F.col("pos").alias("up"), F.lit(-1).alias("ord"), "t", "place", F.col("n_children").alias("among"))
    children = nodes.where("parent_pos >= 0").select(*doc, "pos", F.col("parent_pos").alias("up"), "ord", "t", F.lit(None).cast("string").alias("place"), F.lit(None).cast("int").alias("among"))
    family = Window.partitionBy(*doc, "up").orderBy("ord")
    met = parents.unionAll(children).withColumns({"p": F.first(F.struct("ord", "t", "place", "among")).over(family), "following": F.lead("t").over(family)}).where("ord >= 0 and p.ord = -1")
    kids = met.join(F.broadcast(facts.select("er", "et", "model", "permitted", "barred")), (F.col("register") == F.col("er")) & (F.col("p.t") == F.col("et")))
    up = {c: F.col(f"p.{c}") for c in ("t", "place", "among")} | {c: F.col(c) for c in ("model", "permitted", "barred")}
    return kids.select(*doc, F.col("up").alias("pos"), _kin(F.col("t"), F.col("ord"), F.col("pos"), F.col("following"), up).cast(MARKS).alias("marks")).where(F.size("marks") > 0)


def settled(marked: DataFrame) -> DataFrame:
    """Diagnostics from rows (doc_id, register, pos, marks): what unknown elements hide goes, and ids and references of a document meet."""
    doc = ["doc_id", "register"]  # sorted by what differs first
    set_ = marked.where("marks is not null").select(*doc, F.col("pos").alias("at"), F.explode("marks").alias("m")).select(*doc, "at", "m.*")
    marks = set_.where(F.col("text").isNull() | ~C.is_nfc(F.col("text"))).withColumnRenamed("on", "pos").drop("text")
    before = Window.partitionBy(*doc).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, -1)
    seen = marks.withColumn("stop", F.max("to").over(before)).where((F.col("kind") != UNKNOWN) & ((F.col("kind") == ASKED) | F.col("stop").isNull() | (F.col("stop") < F.col("at"))))
    named = Window.partitionBy(*doc, "id").orderBy("kind", "pos")
    held = seen.withColumns({"nth": F.row_number().over(named), "first": F.first("kind").over(named)})
    found = held.where((F.col("kind") == FOUND) | ((F.col("kind") == NAMED) & (F.col("nth") > 1)) | ((F.col("kind") == ASKED) & (F.col("first") == ASKED)))
    return found.select("doc_id", "pos", "rule", "place", "detail", "register")


def rendered(diags: DataFrame) -> DataFrame:
    return diags.select("doc_id", F.format_string("error [%s] %s: %s", "rule", "place", "detail").alias("line"))


def by_rule(diags: DataFrame) -> DataFrame:
    return diags.groupBy("rule").agg(F.count("*").alias("n"))


def conforming(docs: DataFrame, diags: DataFrame) -> DataFrame:
    """doc_id, errors, conforms of every document."""
    found = diags.groupBy("doc_id").agg(F.count("*").alias("errors"))
    # Both sides grow with the documents: neither is to be broadcast because its file is small.
    return docs.select("doc_id").join(found.hint("merge"), "doc_id", "left").select("doc_id", F.coalesce("errors", F.lit(0)).alias("errors"), F.col("errors").isNull().alias("conforms"))


def pinned(nodes: DataFrame, current: Register, archive: dict[str, Register]) -> DataFrame:
    """Each document's pin: none, current, archived or unresolvable."""
    pin = nodes.where("depth = 0").select("doc_id", field("register", "str").alias("pin"))
    known = F.broadcast(nodes.sparkSession.createDataFrame([(d,) for d in archive] or [("",)], "digest string"))
    joined = pin.join(known, F.col("pin") == F.col("digest"), "left")
    return joined.select("doc_id", "pin", F.when(F.col("pin").isNull(), "none").when(F.col("pin") == current.digest, "current").when(F.col("digest").isNotNull(), "archived").otherwise("unresolvable").alias("outcome"))


def validate_pinned(nodes: DataFrame, current: Register, archive: dict[str, Register]) -> DataFrame:
    """Diagnostics with the `register` that they are by: of every document by the current one, and of those with an archived pin by that one too.

    One plan for all versions: a document with an archived pin has its rows twice, under either register.
    """
    pins = pinned(nodes, current, archive).where("outcome = 'archived'").select("doc_id", "pin")
    held = nodes.join(pins.hint("merge"), "doc_id", "left")
    by = F.array_compact(F.array(F.lit(current.digest), F.col("pin")))
    return validate_by(held.withColumn("register", F.explode(by)).drop("pin"), [current, *[r for d, r in archive.items() if d != current.digest]])
