"""Queries over documents made from the driver's rows, so that what each has to find is known by its key.

A query takes a table, makes a document (or page, or XML) of each row, of a kind that the row's key
chooses, and applies an operator to all of them; its SQL counts or writes the same from the key alone.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import trees
from .operators import measures, nodes, ordered, reports, validate
from .operators.kept import kept, spread
from .plans.register import ELEMENTS, Register, built_in, from_json
from .sources import readers, writers

REG = built_in()


def rows_of(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet").select(F.col(key).cast("long").alias("k")), "k")


def by_key(cases: list[str], k: Column | None = None) -> Column:
    """One of the texts, chosen by the key, with every KEY in it replaced by the key."""
    k = F.col("k") if k is None else k
    chosen = F.get(F.array(*[F.lit(c) for c in cases]), (k % len(cases)).cast("int"))
    return F.replace(chosen, F.lit("KEY"), k.cast("string"))


def sql_by_key(cases: list[str], key: str) -> str:
    quoted = [c.replace("'", "''") for c in cases]
    return f"replace(CASE {key} % {len(cases)} " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(quoted)) + f" END, 'KEY', CAST({key} AS VARCHAR))"


def text(v: str) -> dict:
    return {"t": "text", "v": v}


def par(*kids: dict) -> dict:
    return {"t": "paragraph", "c": list(kids)}


def doc(*kids: dict, **more: object) -> dict:
    return {"t": "document", "id": "urn:made:KEY", "lang": "en", "title": "T", **more, "c": list(kids)}


def made(rows: DataFrame, cases: list[str]) -> DataFrame:
    return rows.select(F.col("k").cast("string").alias("doc_id"), by_key(cases).alias("raw"))


# -- the validator -------------------------------------------------------------------


def _deep(n: int) -> dict:
    inner = par(text("x"))
    for _ in range(n):
        inner = {"t": "section", "c": [inner]}
    return inner


def _media(**more: object) -> dict:
    return {"t": "media", "src": "a", "alt": "a", "kind": "image", **more}


#: A document without a fault, then one for each rule that breaks it once.
FAULTS = [json.dumps(x, ensure_ascii=False) for x in (
    doc(par(text("x"))),
    doc(par(text("x")), {"t": "strange"}),
    {"t": "section", "c": [par(text("x"))]},
    doc({"t": "media", "src": "a", "alt": "a"}),
    doc({**par(text("x")), "colour": "red"}),
    doc(par(text("x")), lang="no language"),
    doc(_media(kind="smell")),
    doc({"t": "heading", "level": 7, "c": [text("x")]}),
    doc(_media(alt="  ")),
    doc({"t": "list", "ordered": True, "c": [par(text("x"))]}),
    doc(_media(src="https://a/b")),
    doc(par({"t": "reference", "target": "nowhere", "c": [text("x")]})),
    doc({"t": "section", "id": "a", "c": [par(text("x"))]}, {"t": "note", "id": "a", "c": [par(text("x"))]}),
    doc(par({"t": "quantity", "significand": "FLOAT", "scale": 0, "unit": "m"})),
    doc({"t": "payload", "id": "p", "type": "numbers", "data": "1;2"}),
    doc(par(text("é"))),
    doc({"t": "contents"}),
    doc(par({"t": "link", "href": "a\u0085b", "c": [text("x")]})),
    {k: v for k, v in doc().items() if k != "c"},
    doc(par({"t": "link", "href": "vbscript:x", "c": [text("x")]})),
    {**doc(), "c": [par(text("x")), "loose"]},
    doc(_deep(101)),
)]
FAULTS[13] = FAULTS[13].replace('"FLOAT"', "2.50")


def rules_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule of the validator, each broken by its share of the events."""
    n = kept(nodes.from_trees(made(rows_of(spark, sf_dir, "events", "event_id"), FAULTS)))
    return validate.by_rule(validate.validate(n, REG))


def later_register() -> Register:
    """The register with one element more, as a later or earlier version has it."""
    body = json.loads(ELEMENTS.read_bytes())
    body["elements"].append({"n": "motto", "layer": 1, "class": "block", "children": "inline", "fields": {}})
    return from_json(json.dumps(body).encode())


def pinned_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a pinned register: the outcome, and their errors by the current and by the archived register."""
    archived = later_register()
    pins = [None, REG.digest, archived.digest, "0" * 64]
    motto = {"t": "motto", "c": [text("x")]}
    cases = [json.dumps(doc(motto, **({"register": p} if p else {}))) for p in pins]
    n = kept(nodes.from_trees(made(rows_of(spark, sf_dir, "part", "p_partkey"), cases)))
    found = validate.validate_pinned(n, REG, {archived.digest: archived}).groupBy("doc_id").agg(F.count_if(F.col("register") == REG.digest).alias("now"), F.count_if(F.col("register") == archived.digest).alias("then"))
    held = validate.pinned(n, REG, {archived.digest: archived}).join(found, "doc_id", "left")
    return held.groupBy("outcome").agg(F.count("*").alias("documents"), F.sum(F.coalesce("now", F.lit(0))).alias("errors_now"), F.sum(F.coalesce("then", F.lit(0))).alias("errors_then"))


def repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents whose sections take the speaker as id: how many ids repeat, how many stay, what is below them."""
    said = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    section = F.struct("turn", F.to_json(F.struct(F.lit("section").alias("t"), F.col("role").alias("id"), F.array(F.struct(F.lit("paragraph").alias("t"))).alias("c"))).alias("s"))
    held = said.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(section)), lambda x: x["s"]), ",").alias("c"))
    raw = F.concat(F.lit('{"t":"document","id":"urn:made:1","lang":"en","title":"T","c":['), "c", F.lit("]}"))
    n = kept(nodes.from_trees(held.select(F.col("conv_id").cast("string").alias("doc_id"), raw.alias("raw"))))
    once = ordered.without_repeated_ids(n)
    again = ordered.repeated_ids(n).groupBy("doc_id").agg(F.count("*").alias("repeated"))
    left = once.where("t = 'section'").groupBy("doc_id").agg(F.count(nodes.field("id")).alias("kept"), F.max("depth").cast("long").alias("depth"))
    below = ordered.inside(n, n.where("t = 'section'")).groupBy("doc_id").agg(F.count("*").alias("inside"))
    levels = ordered.clamped_depth(n).groupBy("doc_id").agg(F.sum("level").alias("levels"))
    return left.join(again, "doc_id", "left").join(below, "doc_id").join(levels, "doc_id").select("doc_id", "kept", "depth", F.coalesce("repeated", F.lit(0)).alias("repeated"), "inside", "levels")


# -- the base layer, plain text and HTML -----------------------------------------------

#: (blocks, plain text, HTML): what each element is to a reader. KEY is the row's key.
SHAPES: list[tuple[list[dict], str, str]] = [
    ([{"t": "article", "id": "a", "c": [par(text("art KEY"))]}], "art KEY", "<section><p>art KEY</p></section>"),
    ([{"t": "abstract", "c": [par(text("abs KEY"))]}], "abs KEY", "<section><p>abs KEY</p></section>"),
    ([{"t": "sidebar", "c": [par(text("side"))]}, par(text("KEY"))], "side\n\nKEY", "<section><p>side</p></section><p>KEY</p>"),
    ([{"t": "contents", "c": [{"t": "item", "c": [par(text("one"))]}, {"t": "item", "c": [par(text("KEY"))]}]}], "1. one\n2. KEY", "<ol><li><p>one</p></li><li><p>KEY</p></li></ol>"),
    ([{"t": "bibliography", "c": [{"t": "item", "c": [par(text("book KEY"))]}]}], "- book KEY", "<ul><li><p>book KEY</p></li></ul>"),
    ([{"t": "section", "id": "s", "c": [par({"t": "citation", "target": "s", "c": [text("cite KEY")]})]}], "cite KEY", '<section id="s"><p><a href="#s">cite KEY</a></p></section>'),
    ([{"t": "admonition", "kind": "caution", "c": [par(text("mind KEY"))]}], "### caution\n\nmind KEY", "<section><h3>caution</h3><p>mind KEY</p></section>"),
    ([{"t": "signature-block", "c": [{"t": "term", "c": [text("By")]}, {"t": "definition", "c": [par(text("KEY"))]}]}], "By:\n  KEY", "<dl><dt>By</dt><dd><p>KEY</p></dd></dl>"),
    ([{"t": "provenance", "c": [{"t": "term", "c": [text("From")]}, {"t": "definition", "c": [par(text("KEY"))]}]}], "From:\n  KEY", "<dl><dt>From</dt><dd><p>KEY</p></dd></dl>"),
    ([{"t": "table", "summary": "sum", "c": [{"t": "table-section", "kind": "head", "c": [{"t": "row", "c": [{"t": "header-cell", "scope": "row", "c": [par(text("h"))]}]}]}, {"t": "table-section", "kind": "body", "c": [{"t": "row", "c": [{"t": "cell", "colspan": 2, "c": [par(text("KEY"))]}, {"t": "cell", "c": [par(text("b"))]}]}]}]}], "[table: sum]\nh\nKEY | b", '<table><caption>sum</caption><tbody><tr><th scope="row"><p>h</p></th></tr><tr><td colspan="2"><p>KEY</p></td><td><p>b</p></td></tr></tbody></table>'),
    ([{"t": "form", "action": "go", "method": "get", "c": [{"t": "field", "name": "q", "label": "Ask", "c": [{"t": "field-text", "value": "KEY"}]}, {"t": "field", "name": "o", "label": "Pick", "c": [{"t": "field-choice", "c": [{"t": "field-option", "value": "1", "c": [text("uno")]}]}]}, {"t": "submit", "label": "Send"}]}], "Ask:\n  KEY\nPick:\n  - uno\n\nSend", "<section><dl><dt>Ask</dt><dd><p>KEY</p></dd><dt>Pick</dt><dd><ul><li><p>uno</p></li></ul></dd></dl><p>Send</p></section>"),
    ([{"t": "disclosure", "summary": "More", "open": False, "c": [par(text("KEY"))]}], "### More\n\nKEY", "<section><h3>More</h3><p>KEY</p></section>"),
    ([par({"t": "state-link", "key": "k", "value": "KEY", "c": [text("here")]})], "here <?k=KEY>", '<p><a href="?k=KEY" rel="noreferrer">here</a></p>'),
    ([{"t": "payload", "id": "p", "type": "numbers", "data": "1"}, {"t": "rendering", "renderer": "0" * 64, "payload": "p", "fallback": "chart KEY"}], "(chart KEY)", "<figure><figcaption>chart KEY</figcaption></figure>"),
    ([{"t": "heading", "level": 6, "c": [text("head <KEY>")]}], "###### head <KEY>", "<h6>head &lt;KEY&gt;</h6>"),
    ([{"t": "list", "ordered": True, "start": 9, "c": [{"t": "item", "c": [par(text("KEY")), par(text("more"))]}, {"t": "item", "c": [par(text("z"))]}]}], "9. KEY\n  more\n10. z", '<ol start="9"><li><p>KEY</p><p>more</p></li><li><p>z</p></li></ol>'),
    ([{"t": "quote", "source": "A & B", "c": [par(text("said KEY"))]}], "> said KEY\n> -- A & B", '<blockquote cite="A &amp; B"><p>said KEY</p></blockquote>'),
    ([{"t": "code-block", "language": "c", "c": [text("int x = KEY;\nx < 1")]}], "```c\nint x = KEY;\nx < 1\n```", '<pre><code class="language-c">int x = KEY;\nx &lt; 1</code></pre>'),
    ([{"t": "note", "id": "n", "c": [par(text("one")), par(text("KEY"))]}, par({"t": "note-ref", "target": "n"})], "[n] one KEY\n\n[n]", '<aside id="n" role="note"><p>one</p><p>KEY</p></aside><p><sup><a href="#n">n</a></sup></p>'),
    ([{"t": "figure", "c": [{"t": "media", "src": "KEY.png", "alt": "a view", "kind": "image"}, {"t": "caption", "c": [text("cap")]}]}], "[image: a view]\n\n(cap)", '<figure><img src="KEY.png" alt="a view"><figcaption>cap</figcaption></figure>'),
    ([{"t": "figure", "c": [{"t": "media", "src": "KEY.mp4", "alt": "a film", "kind": "video"}]}], "[video: a film]", '<figure><video controls src="KEY.mp4"></video><p>a film</p></figure>'),
    ([par({"t": "quantity", "significand": -7, "scale": 3, "unit": "KEY"}, text(" "), {"t": "power", "base": "m", "exponent": "2"}, {"t": "line-break"}, {"t": "date", "value": "2024", "precision": "year"})], "-0.007 KEY m^2\n2024", '<p><data value="-0.007 KEY">-0.007 KEY</data> <span data-power="m^2">m<sup>2</sup></span><br><time datetime="2024">2024</time></p>'),
    ([par({"t": "emphasis", "c": [text("e")]}, {"t": "strong", "c": [text("s")]}, {"t": "code", "c": [text("KEY")]}, {"t": "link", "href": "https://a.example/?x=1&y=KEY", "c": [text("l")]})], "es`KEY`l <https://a.example/?x=1&y=KEY>", '<p><em>e</em><strong>s</strong><code>KEY</code><a href="https://a.example/?x=1&amp;y=KEY" rel="noreferrer">l</a></p>'),
    ([par({"t": "link", "href": "javascript:KEY", "c": [text("bad")]})], "bad <javascript:KEY>", "<p>bad</p>"),
]
HTML_HEAD = '<!DOCTYPE html>\n<html lang="en">\n<head><meta charset="utf-8"><meta name="viewport" content="width=device-width,initial-scale=1"><title>T</title></head>\n<body>'


def shown_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every element lowered to the base layer, as plain text and as HTML."""
    cases = [json.dumps(doc(*s[0]), ensure_ascii=False) for s in SHAPES]
    held = made(rows_of(spark, sf_dir, "supplier", "s_suppkey"), cases)
    return nodes.views(held, REG, columns=("plain", "html")).select("doc_id", "plain", "html")


def lowered_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of the base layer after lowering, by kind of document; what is above the layer is gone and no unit is lost."""
    cases = [json.dumps(doc(*s[0]), ensure_ascii=False) for s in SHAPES]
    views = nodes.views(made(rows_of(spark, sf_dir, "customer", "c_custkey"), cases), REG, columns=("base", "units", "base_units"))
    held = kept(views.select("doc_id", "base", F.size("units").cast("long").alias("units"), F.size(F.array_except("units", "base_units")).cast("long").alias("lost")))
    low = nodes.from_trees(held.select("doc_id", F.col("base").alias("raw")), columns=("doc_id", "t")).where("t <> 'text'")
    # A document's elements and its counts meet in one group.
    both = low.select("doc_id", "t", F.lit(None).cast("long").alias("units"), F.lit(None).cast("long").alias("lost")).unionAll(held.select("doc_id", F.lit(None).cast("string").alias("t"), "units", "lost"))
    per = both.groupBy("doc_id").agg(F.array_sort(F.collect_list("t")).alias("elements"), F.max("units").alias("units"), F.max("lost").alias("lost"))
    return per.where(F.size("elements") > 0).select("doc_id", F.array_join("elements", " ").alias("elements"), "units", "lost")


#: Elements of the base layer that each of SHAPES becomes, without texts; and its units.
LOWERED = [
    ("document paragraph section", 1), ("document paragraph section", 1), ("document paragraph paragraph section", 2), ("document item item list paragraph paragraph", 2), ("document item list paragraph", 1),
    ("document paragraph reference section", 1), ("document heading paragraph section", 2), ("definition document paragraph term term-list", 2), ("definition document paragraph term term-list", 2),
    ("cell cell document header-cell paragraph paragraph paragraph row row table", 3), ("definition definition document item list paragraph paragraph paragraph section term term term-list", 4),
    ("document heading paragraph section", 2), ("document link paragraph", 1), ("caption document figure", 1), ("document heading", 1), ("document item item list paragraph paragraph paragraph", 3), ("document paragraph quote", 2),
    ("code-block document", 1), ("document note note-ref paragraph paragraph paragraph", 2), ("caption document figure media", 2), ("document figure media", 1), ("date document line-break paragraph power quantity", 4),
    ("code document emphasis link paragraph strong", 4), ("document link paragraph", 1),
]


# -- bytes and identity ------------------------------------------------------------------


def encoded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text node of each customer's name: canonical JSON, CBOR and digest, and the proof of its paragraph."""
    c = spread(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name"), "c_custkey").select(F.col("c_custkey").cast("string").alias("doc_id"), F.to_json(F.struct(F.col("c_name").alias("v"), F.lit("text").alias("t"))).alias("raw"))
    v = nodes.views(c, REG, columns=("canonical", "cbor", "digest"))
    return v.select("doc_id", F.col("canonical").cast("string").alias("canonical"), F.lower(F.hex("cbor")).alias("cbor"), "digest")


def proven_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of k % 9 + 1 paragraphs: root over their digests, and siblings of the middle one's proof."""
    kids = F.transform(F.sequence(F.lit(0), F.col("k") % 9), lambda i: F.struct(F.lit("paragraph").alias("t")))
    raw = F.to_json(F.struct(F.lit("document").alias("t"), kids.alias("c")))
    held = rows_of(spark, sf_dir, "supplier", "s_suppkey").select(F.col("k").cast("string").alias("doc_id"), raw.alias("raw"))
    proofs = reports.excerpt_proofs(held, REG)
    return proofs.join(nodes.views(held, REG, columns=("root",)), "doc_id").select("doc_id", "blocks", "siblings", "bytes", "holds", "forged_holds", "root")


def _root_sql(n: int) -> str:
    """Root over n digests `h` of an empty paragraph."""
    level = ["h"] * n
    while len(level) > 1:
        up = [f"unhex(sha256(encode('merkle') || '\\x00'::BLOB || {a} || {b}))" for a, b in zip(level[::2], level[1::2], strict=False)]
        level = up + level[2 * len(up) :]
    return level[0]


def _siblings(n: int) -> int:
    at, left, out = n // 2, n, 0
    while left > 1:
        out += (at ^ 1) < left
        at, left = at // 2, (left + 1) // 2
    return out


# -- forms ----------------------------------------------------------------------------

PAGE = [
    '<label for="q">Name <b>KEY</b></label><input id="q" name="q" value="KEY" required>',
    '<label>Name KEY <textarea name="q"></textarea></label>',
    '<input name="q" aria-label="Name KEY">',
    '<input name="q" placeholder="Name KEY">',
    '<input name="q">',
]


def pages_with_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    when = lambda c, s: F.when(c, F.lit(s)).otherwise(F.lit(""))
    html = F.concat(
        F.lit('<form action="/find" method="POST">'), by_key(PAGE),
        F.lit('<select name="s" aria-label="Pick"><option value="1">One</option><option>Two</option><option value=""></option></select><input type="hidden" name="h">'),
        when(k % 3 == 0, '<input type="checkbox" name="c" title="Tick" value="y">'), when(k % 2 == 0, "<button>Go</button>"),
        F.lit('</form><form action="https://other/"><input aria-label="x"></form>'), when(k % 7 == 0, "<details></details>"), when(k % 4 == 0, '<a href="/x?page=2">next</a>'),
    )
    return rows_of(spark, sf_dir, "customer", "c_custkey").select(k.alias("page_id"), F.lit("https://shop.example/p").alias("url"), html.alias("html"))


def form_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with forms as documents: elements, and errors of the validator."""
    n = kept(nodes.from_trees(readers.forms_of(pages_with_forms(spark, sf_dir))))
    errors = validate.validate(n, REG).agg(F.lit("(errors)").alias("t"), F.count("*").alias("n"))
    return measures.histogram(n, REG).select("t", "n").unionAll(errors)


def form_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was counted on the way: controls, where labels come from, actions that lead elsewhere."""
    return reports.finding_totals(readers.findings(readers.forms_of(pages_with_forms(spark, sf_dir)), "forms"))


def control_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Controls with the label that comes first among for, wrapping, aria and placeholder, by join; then how many rest on which."""
    k = F.col("k")
    key = k.cast("string")
    every = rows_of(spark, sf_dir, "customer", "c_custkey")
    controls = every.select((k % 25).alias("page_id"), key.alias("control_id"), F.when(k % 3 == 0, F.concat(F.lit(" w"), key)).alias("wrapped"), F.when(k % 5 == 0, F.lit("a")).otherwise(F.lit(" ")).alias("aria"), F.when(k % 2 == 0, F.lit("p")).alias("placeholder"))
    labels = every.where(k % 4 == 0).select((k % 25).alias("page_id"), key.alias("for_id"), F.concat(F.lit("f"), key).alias("label"))
    held = measures.label_sources(controls, labels)
    return held.groupBy("page_id").agg(F.count("*").alias("controls"), *[F.count_if(F.col("way") == w).alias(f"by_{w}") for w in ("for", "wrapping", "aria", "placeholder", "none")], F.max("label").alias("last_label"))


# -- XML ----------------------------------------------------------------------------------


def _xml(spark: SparkSession, sf_dir: str, table: str, key: str, genre: str, *parts: Column) -> DataFrame:
    rows = rows_of(spark, sf_dir, table, key)
    return kept(readers.xml_of(rows.select("k", F.concat(*parts).alias("x")), "x", genre, id_col="k"))


def _if(every: int, s: str, other: str = "") -> Column:
    return F.replace(F.when(F.col("k") % every == 0, F.lit(s)).otherwise(F.lit(other)), F.lit("KEY"), F.col("k").cast("string"))


def _counted(held: DataFrame, genre: str) -> DataFrame:
    """Elements and findings of mapped documents, their errors, and how many ids and missed strings there are."""
    n = kept(nodes.from_trees(held.select("doc_id", "raw")))
    elements = measures.histogram(n, REG).select("t", "n")
    found = reports.finding_totals(readers.findings(held, genre)).select(F.concat(F.lit("found "), "key").alias("t"), "n")
    other = held.agg(F.sum(F.size("missed")).alias("missed"), F.count_distinct(F.get_json_object("raw", "$.id")).alias("ids")).select(F.expr("stack(2, 'missed', missed, 'ids', ids) as (t, n)"))
    errors = validate.validate(n, REG).agg(F.lit("errors").alias("t"), F.count("*").alias("n"))
    return elements.unionAll(found).unionAll(other).unionAll(errors)


def _standards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _xml(
        spark, sf_dir, "part", "p_partkey", "standards",
        F.lit("<rfc"), _if(12, ' number="KEY" category="std"'), F.lit('><front><title>Title</title><author fullname="A B"/><date year="2024"/></front><middle><section anchor="s1"><name>Name</name><t>See <xref target="R1"/> and <xref target="'),
        _if(3, "gone", "s1"), F.lit('">that</xref>, 2<sup>10</sup></t>'), _if(4, "<ul><li>item one</li><li>item two</li></ul>"), _if(5, '<sourcecode type="c">code KEY</sourcecode>'), _if(6, "<t><odd>kept KEY</odd></t>"),
        _if(7, '<t><eref target="javascript:x">bad link</eref></t>'), _if(8, '<dl><dt>term</dt><dd>meaning</dd></dl>'), _if(9, '<table><thead><tr><th>head</th></tr></thead><tbody><tr><td colspan="2">cell</td></tr></tbody></table>'),
        _if(10, '<t>by <contact fullname="Ann KEY Lee"/>.</t>'), _if(11, "<t>f(x)<sup>2</sup></t>"), _if(13, "<figure>loose words KEY</figure>"),
        _if(14, "<figure><name>Fig</name><artwork>art KEY</artwork><t>aside</t></figure>"), _if(15, "<dl><dt>one</dt><dt>two</dt><dd>def</dd><dt/><dd>more</dd></dl>"),
        F.lit('</section></middle><back><references><name>Refs</name><reference anchor="R1"><front><title>Work</title></front></reference></references></back></rfc>'),
    )


def standards_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(_standards(spark, sf_dir), "standards")


def standards_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What share of the standards conforms, loses nothing and has no escape."""
    held = _standards(spark, sf_dir)
    n = kept(nodes.from_trees(held.select("doc_id", "raw")))
    state = validate.conforming(n.where("depth = 0"), validate.validate(n, REG))
    escapes = F.aggregate(F.map_values(F.map_filter("found", lambda k, v: k.startswith("escape"))), F.lit(0), lambda a, x: a + x)
    flags = state.join(held.select("doc_id", F.size("missed").alias("lost"), escapes.alias("escapes")), "doc_id")
    return measures.coverage(flags.withColumn("genre", F.lit("standards")), ("genre",))


def articles_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _xml(
        spark, sf_dir, "supplier", "s_suppkey", "articles",
        F.lit('<article xmlns:xlink="http://www.w3.org/1999/xlink"><front><article-meta>'), _if(8, '<article-id pub-id-type="pmc">KEY</article-id>'), F.lit('<article-id pub-id-type="doi">10.1/x</article-id><title-group><article-title>Title</article-title></title-group><abstract><p>short</p></abstract></article-meta></front><body><sec id="s"><title>Name</title><p>x<sup>'),
        _if(3, "a", "2"), F.lit('</sup> <xref ref-type="bibr" rid="b1">[1]</xref> <xref ref-type="fn" rid="f1"/></p><fig id="g"><label>Fig</label><caption><p>shows</p></caption><graphic xlink:href="a.png">'), _if(2, "<alt-text>a view</alt-text>"),
        F.lit('</graphic></fig><fn id="f1"><p>foot</p></fn>'), _if(9, '<fn id="f1"><p>other KEY</p></fn><fn><p>loose KEY</p></fn>'), F.lit("</sec>"), _if(4, '<sec id="s"><p>again KEY</p></sec>'), _if(5, '<list list-type="order"><list-item><p>point</p></list-item></list>'), _if(6, "<disp-quote><p>quoted</p></disp-quote>"), _if(7, "<boxed-text><p>boxed</p></boxed-text>"),
        _if(10, '<p><bold>b</bold><monospace>m</monospace><styled-content>s</styled-content> <ext-link xlink:href="https://a.example/">l</ext-link> <email>a@b.example</email> <uri xlink:href="file:///KEY">f</uri></p>'),
        F.lit('</body><back><ref-list><ref id="b1"><mixed-citation>Book</mixed-citation></ref></ref-list></back></article>'),
    )
    return _counted(held, "articles")


def laws_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _xml(
        spark, sf_dir, "customer", "c_custkey", "laws",
        F.lit('<Legislation><Metadata><Year Value="1999"/><title>Act</title></Metadata>'), _if(5, '<Contents><ContentsPart IdURI="https://law.example/p1"><ContentsNumber>Part 1</ContentsNumber><ContentsTitle>Of things</ContentsTitle></ContentsPart><ContentsPart><ContentsTitle>Rest</ContentsTitle></ContentsPart></Contents>'), F.lit('<Primary><Body><Part id="p1"><Number>Part 1</Number><Title>Of things</Title><P1 id="s1"><Pnumber>1</Pnumber><P1para><Text>Shall <Emphasis>be</Emphasis>'),
        _if(2, ' <CommentaryRef Ref="c1"/>'), F.lit("</Text>"), _if(3, "<UnorderedList><ListItem><Para><Text>thing KEY</Text></Para></ListItem></UnorderedList>"), F.lit("</P1para></P1></Part></Body>"),
        _if(4, '<Schedules><Schedule id="c9"><Title>Schedule</Title><ScheduleBody><Para><Text>more</Text></Para></ScheduleBody></Schedule></Schedules>'),
        F.lit("</Primary>"), _if(2, '<Commentaries><Commentary id="c1"><Para><Text>comment</Text></Para></Commentary></Commentaries>'), F.lit("</Legislation>"),
    )
    return _counted(held, "laws")


# -- records and serving -----------------------------------------------------------------------


def records_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of orders with money, flags, lists, maps and rows: elements, findings and errors."""
    o = rows_of(spark, sf_dir, "orders", "o_orderkey")
    raw = F.concat(
        F.lit('{"paidAmount": {"amount": '), F.when(F.col("k") % 3 == 0, F.lit("12.5")).when(F.col("k") % 3 == 1, F.lit("7")).otherwise(F.lit("null")), F.lit(', "currency": "EUR"}, "isOpen": true, "notes": ["first", ""], "pairs": {"k": "v", "e": ""}'),
        _if(2, ', "rows": [{"a": 1}, {"b": "x", "a": 2}]'), F.lit("}"),
    )
    n = nodes.from_trees(o.select(F.col("k").cast("string").alias("k"), raw.alias("x")), readers.record(), id_col="k", raw_col=("k", "x"), columns=(*nodes.CHECKED, "found"))
    held = kept(validate.marked(n, REG).select("doc_id", "register", "pos", "t", "marks", "found"))
    found = reports.finding_totals(readers.findings(held.where("found is not null"), "records")).select(F.concat(F.lit("found "), "key").alias("t"), "n")
    errors = validate.settled(held).agg(F.lit("errors").alias("t"), F.count("*").alias("n"))
    return measures.histogram(held, REG).select("t", "n").unionAll(found).unionAll(errors)


def served_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for documents that are there or not, in forms that can be had or not: status, type and bytes."""
    docs = rows_of(spark, sf_dir, "supplier", "s_suppkey").where("k % 3 <> 0").select(F.col("k").cast("string").alias("doc_id"), F.lit(json.dumps(doc(par(text("x"))))).alias("raw"))
    views = nodes.views(docs, REG, columns=("html", "plain", "canonical", "cbor", "markdown"))
    accept = ["text/plain", "image/png", "", "application/json;q=0.9, text/markdown"]
    asked = rows_of(spark, sf_dir, "supplier", "s_suppkey").select(F.col("k").cast("string").alias("doc_id"), by_key(accept).alias("accept"), F.when(F.col("k") % 5 == 0, F.lit("markdown")).alias("form"))
    out = writers.served(asked, views)
    return out.select("doc_id", F.col("status").cast("long").alias("status"), "media", F.octet_length("body").cast("long").alias("bytes"))


QUERIES = {
    f.__name__: f
    for f in (rules_broken, pinned_documents, repeated_ids, shown_elements, lowered_nodes, encoded_texts, proven_rows, form_elements, form_findings, control_labels, standards_mapped, standards_coverage, articles_mapped, laws_mapped, records_mapped, served_requests)
}


def _sums(table: str, key: str, counts: dict[str, str]) -> str:
    """A row for each name: how often it is there, from the keys; none for nothing."""
    return "SELECT t, CAST(n AS BIGINT) AS n FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS t, sum({re.sub(r'\bk\b', key, expr)}) AS n FROM {table}" for t, expr in counts.items()) + ") WHERE n > 0 OR t IN ('errors', '(errors)', 'missed')"


def _is(every: int, rest: int = 0) -> str:
    return f"(k % {every} = {rest})::INT"


_EMPTY_PARAGRAPH = r"unhex(sha256(encode('node') || '\x00'::BLOB || encode('paragraph') || '\x00'::BLOB || encode('f0') || '\x00'::BLOB || encode('c0') || '\x00'::BLOB))"
_JSON = trees.canonical_json(doc(par(text("x")))).decode()
_FORM = {"text/html": len(HTML_HEAD.encode()) + len("<p>x</p></body>\n</html>"), "text/plain": len("T\n=\n\nx"), "application/json": len(_JSON), "text/markdown": len("---\nid: urn:made:KEY\nlang: en\ntitle: T\n---\n\nx\n")}

ORACLE = {
    "rules_broken": "SELECT 'R' || (event_id % 22) AS rule, count(*) AS n FROM events WHERE event_id % 22 > 0 GROUP BY 1",
    "pinned_documents": "SELECT ['none', 'current', 'archived', 'unresolvable'][p_partkey % 4 + 1] AS outcome, count(*) AS documents, count(*) AS errors_now, CAST(0 AS BIGINT) AS errors_then FROM part GROUP BY 1",
    "repeated_ids": "SELECT CAST(conv_id AS VARCHAR) AS doc_id, count(DISTINCT role) AS kept, CAST(1 AS BIGINT) AS depth, count(*) - count(DISTINCT role) AS repeated, count(*) AS inside, 1 + 3 * count(*) AS levels FROM conversations GROUP BY conv_id",
    "shown_elements": f"SELECT CAST(s_suppkey AS VARCHAR) AS doc_id, 'T' || chr(10) || '=' || chr(10) || chr(10) || {sql_by_key([s[1] for s in SHAPES], 's_suppkey')} AS plain, '{HTML_HEAD}' || {sql_by_key([s[2] for s in SHAPES], 's_suppkey')} || '</body>' || chr(10) || '</html>' AS html FROM supplier",
    "lowered_nodes": f"SELECT CAST(c_custkey AS VARCHAR) AS doc_id, {sql_by_key([e for e, _ in LOWERED], 'c_custkey')} AS elements, CAST({sql_by_key([str(n) for _, n in LOWERED], 'c_custkey')} AS BIGINT) AS units, CAST(0 AS BIGINT) AS lost FROM customer",
    "encoded_texts": r"""SELECT CAST(c_custkey AS VARCHAR) AS doc_id, '{"t":"text","v":"' || c_name || '"}' AS canonical, 'a261746474657874' || '6176' || CASE WHEN strlen(c_name) < 24 THEN printf('%02x', 96 + strlen(c_name)) ELSE '78' || printf('%02x', strlen(c_name)) END || lower(hex(encode(c_name))) AS cbor,
sha256(encode('node') || '\x00'::BLOB || encode('text') || '\x00'::BLOB || encode('f1') || '\x00'::BLOB || encode('v') || '\x00'::BLOB || encode(c_name) || '\x00'::BLOB || encode('c0') || '\x00'::BLOB) AS digest FROM customer""",
    "proven_rows": "SELECT CAST(s_suppkey AS VARCHAR) AS doc_id, CAST(n AS BIGINT) AS blocks, CAST(s AS BIGINT) AS siblings, CAST(32 * s AS BIGINT) AS bytes, true AS holds, false AS forged_holds, lower(hex(r)) AS root FROM (SELECT *, CASE s_suppkey % 9 "
    + " ".join(f"WHEN {i} THEN {_root_sql(i + 1)}" for i in range(9)) + " END AS r, CASE s_suppkey % 9 " + " ".join(f"WHEN {i} THEN {_siblings(i + 1)}" for i in range(9)) + f" END AS s FROM (SELECT s_suppkey, s_suppkey % 9 + 1 AS n, {_EMPTY_PARAGRAPH} AS h FROM supplier))",
    "form_elements": _sums("customer", "c_custkey", {
        **dict.fromkeys(("document", "heading", "provenance", "term", "definition", "link", "form", "submit"), "1"), "paragraph": f"1 + {_is(7)} + {_is(4)}", "field": f"2 - {_is(5, 4)} + {_is(3)}", "field-text": f"1 - {_is(5, 4)}",
        "field-choice": f"1 + {_is(3)}", "field-option": f"2 + {_is(3)}", "disclosure": _is(7), "state-link": _is(4), "text": f"5 + {_is(3)} + {_is(7)} + {_is(4)}", "(errors)": "0",
    }),
    "form_findings": "SELECT 'forms' AS genre, t AS key, n FROM (" + _sums("customer", "c_custkey", {
        "actions": "2", "cross_origin": "1", "controls": f"2 + {_is(3)}", "label_for": _is(5), "label_wrapping": _is(5, 1), "label_aria": f"{_is(5, 2)} + 1 + {_is(3)}", "label_placeholder": _is(5, 3), "label_none": _is(5, 4), "forms": "1",
    }) + ")",
    "control_labels": "WITH w AS (SELECT c_custkey % 25 AS page_id, CASE WHEN c_custkey % 4 = 0 THEN 'for' WHEN c_custkey % 3 = 0 THEN 'wrapping' WHEN c_custkey % 5 = 0 THEN 'aria' WHEN c_custkey % 2 = 0 THEN 'placeholder' ELSE 'none' END AS way, CASE WHEN c_custkey % 4 = 0 THEN 'f' || c_custkey WHEN c_custkey % 3 = 0 THEN 'w' || c_custkey WHEN c_custkey % 5 = 0 THEN 'a' WHEN c_custkey % 2 = 0 THEN 'p' ELSE '' END AS label FROM customer) SELECT page_id, count(*) AS controls, "
    + ", ".join(f"count(*) FILTER (way = '{w}') AS by_{w}" for w in ("for", "wrapping", "aria", "placeholder", "none")) + ", max(label) AS last_label FROM w GROUP BY page_id",
    "standards_mapped": _sums("part", "p_partkey", {
        **dict.fromkeys(("document", "provenance", "date", "citation", "power", "bibliography", "ids"), "1"), "heading": "3", "term": f"2 + {_is(8)} + 3 * {_is(12)} + 2 * {_is(15)}", "definition": f"2 + {_is(8)} + 3 * {_is(12)} + 2 * {_is(15)}", "figure": _is(14), "caption": _is(14), "section": "2", "paragraph": f"4 + 2 * {_is(4)} + {_is(6)} + {_is(7)} + {_is(8)} + 2 * {_is(9)} + {_is(10)} + {_is(11)} + 3 * {_is(12)} + {_is(14)} + 3 * {_is(15)}", "link": _is(12),
        "reference": f"1 - {_is(3)}", "item": f"1 + 2 * {_is(4)}", "list": _is(4), "code-block": f"{_is(5)} + {_is(14)}", "term-list": f"{_is(8)} + {_is(15)}", "table": _is(9), "table-section": f"2 * {_is(9)}", "row": f"2 * {_is(9)}", "header-cell": _is(9), "cell": _is(9),
        "text": f"12 + 2 * {_is(4)} + {_is(5)} + {_is(6)} + {_is(7)} + 2 * {_is(8)} + 2 * {_is(9)} + 3 * {_is(10)} + 2 * {_is(11)} + 6 * {_is(12)} + 3 * {_is(14)} + 5 * {_is(15)}", "found references dropped": _is(3), "found escape odd": _is(6), "found escape link": _is(7), "found escape sup": _is(11), "found figures": f"{_is(13)} + {_is(14)}", "missed": _is(13), "errors": "0",
    }),
    "standards_coverage": "SELECT 'standards' AS genre, count(*) AS documents, count(*) FILTER (p_partkey % 6 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 11 <> 0 AND p_partkey % 13 <> 0) AS covered, round(100 * count(*) FILTER (p_partkey % 6 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 11 <> 0 AND p_partkey % 13 <> 0) / count(*), 1) AS percent FROM part",
    "articles_mapped": _sums("supplier", "s_suppkey", {
        **dict.fromkeys(("document", "provenance", "abstract", "citation", "note-ref", "figure", "media", "caption", "bibliography", "ids", "found figures", "found graphics"), "1"), "term": f"1 + 2 * {_is(8)}", "definition": f"1 + 2 * {_is(8)}", "link": f"1 + {_is(8)} + 2 * {_is(10)}", "strong": _is(10), "code": _is(10), "found escape link": _is(10), "note": f"1 + 2 * {_is(9)}", "heading": "2", "section": f"2 + {_is(4)}",
        "paragraph": f"5 + {_is(4)} + {_is(5)} + {_is(6)} + {_is(7)} + 2 * {_is(8)} + 2 * {_is(9)} + {_is(10)}", "power": f"1 - {_is(3)}", "list": _is(5), "item": f"1 + {_is(5)}", "quote": _is(6), "sidebar": _is(7), "text": f"10 + 2 * {_is(3)} + {_is(4)} + {_is(5)} + {_is(6)} + {_is(7)} + 4 * {_is(8)} + 2 * {_is(9)} + 6 * {_is(10)}",
        "found raised text": _is(3), "found graphics without alt": f"1 - {_is(2)}", "found footnotes": f"1 + 2 * {_is(9)}", "found ids dropped": f"{_is(4)} + {_is(9)}", "missed": "0", "errors": _is(9),
    }),
    "laws_mapped": _sums("customer", "c_custkey", {
        **dict.fromkeys(("document", "provenance", "term", "definition", "date", "emphasis", "ids"), "1"), "heading": f"3 + {_is(4)}", "section": "2", "contents": _is(5), "link": _is(5), "paragraph": f"2 + {_is(2)} + {_is(3)} + {_is(4)} + 2 * {_is(5)}", "note": _is(2), "note-ref": _is(2),
        "list": _is(3), "item": f"{_is(3)} + 2 * {_is(5)}", "article": _is(4), "text": f"7 + {_is(2)} + {_is(3)} + 2 * {_is(4)} + 2 * {_is(5)}", "missed": "0", "errors": "0",
    }),
    "records_mapped": _sums("orders", "o_orderkey", {
        **dict.fromkeys(("document", "provenance", "list", "item", "term-list"), "1"), "heading": f"5 - {_is(3, 2)} + {_is(2)}", "section": f"4 - {_is(3, 2)} + {_is(2)}", "term": "2", "definition": "2", "paragraph": f"5 - {_is(3, 2)} + 5 * {_is(2)}", "quantity": f"1 - {_is(3, 2)}",
        "table": _is(2), "table-section": f"2 * {_is(2)}", "row": f"3 * {_is(2)}", "header-cell": f"2 * {_is(2)}", "cell": f"4 * {_is(2)}", "text": f"11 - {_is(3, 2)} + 6 * {_is(2)}", "found scale 1": _is(3), "found scale 0": _is(3, 1), "found amounts left out": _is(3, 2), "errors": "0",
    }),
    "served_requests": f"WITH r AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 5 = 0 THEN 'text/markdown' ELSE ['text/plain', NULL, 'text/html', 'text/markdown'][s_suppkey % 4 + 1] END AS m FROM supplier) SELECT CAST(k AS VARCHAR) AS doc_id, CAST(CASE WHEN k % 3 = 0 THEN 404 WHEN m IS NULL THEN 406 ELSE 200 END AS BIGINT) AS status, CASE WHEN k % 3 <> 0 THEN m END AS media, CASE WHEN k % 3 <> 0 THEN CAST(CASE m "
    + " ".join(f"WHEN '{m}' THEN {n}" for m, n in _FORM.items()) + " END AS BIGINT) END AS bytes FROM r",
}
