"""Queries over whole documents and conversations as trees: what every text says goes through the node table, and the SQL derives the same from the texts."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns as C
from .functions import surface, trees
from .operators import diff, fold, measures, nodes, proofs, reports, rewrite, validate
from .operators.kept import kept, shared_folder, spread
from .plans.register import ELEMENTS, Register, built_in, from_json
from .sources import readers, xml_parts
from .streaming import arrivals

REG = built_in()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.trim(x) != "")


def element(t: str, *kids: Column, c: Column | None = None, **fields: Column | str | int | bool) -> Column:
    """JSON of an element; kids are JSON, `c` an array of it."""
    own = F.to_json(F.struct(F.lit(t).alias("t"), *[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()]))
    inner = c if c is not None else F.array(*kids)
    return F.concat(F.regexp_replace(own, r"\}\z", ""), F.lit(',"c":['), F.array_join(inner, ","), F.lit("]}"))


def leaf(t: str, **fields: Column | str) -> Column:
    return F.to_json(F.struct(F.lit(t).alias("t"), *[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()]))


def paragraph(v: Column | str) -> Column:
    return element("paragraph", leaf("text", v=v))


def joined(turns: DataFrame, title: Column, identifier: Column) -> DataFrame:
    """doc_id, raw from rows (conv_id, turn, part), parts in order of their turns."""
    held = turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "part"))), lambda x: x["part"]).alias("parts"))
    return held.select(F.col("conv_id").cast("string").alias("doc_id"), element("document", c=F.col("parts"), id=identifier, lang="en", title=title).alias("raw"))


def talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as node tables; turn by turn an admonition, a disclosure, contents of its lines, a form, a sidebar."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    part = F.get(
        F.array(
            element("admonition", paragraph(text), kind="note"),
            element("disclosure", paragraph(text), summary=role, open=False),
            element("contents", c=F.transform(lines_of(text), lambda x: element("item", paragraph(x)))),
            element("form", element("field", leaf("field-text", value=text), name="said", label=role), leaf("submit", label="Send"), action="go", method="get"),
            element("sidebar", paragraph(text)),
        ),
        (F.col("turn") % 5).cast("int"),
    )
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", part.alias("part"))
    key = F.col("conv_id").cast("string")
    return kept(nodes.from_trees(joined(said, F.concat(F.lit("Conversation "), key), F.concat(F.lit("urn:talk:"), key))))


def document_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of every document, from its rows."""
    n = kept(nodes.from_lines(table(spark, sf_dir, "documents")))
    return fold.digests(n).where("pos = 0").select("doc_id", "digest")


def conversation_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation lowered and written as plain text, from its rows."""
    return fold.plain_text(kept(rewrite.lowered(talks(spark, sf_dir), REG)))


def conversation_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each conversation is in the base layer: nodes, levels, nodes below nodes, places among siblings, elements."""
    low = rewrite.lowered(talks(spark, sf_dir), REG)
    return low.groupBy("doc_id").agg(
        F.count("*").alias("nodes"), F.sum("depth").alias("levels"), F.sum(F.col("last_pos") - F.col("pos")).alias("below"), F.sum("ord").alias("places"), F.sum("n_children").alias("children"),
        F.max("pos").cast("long").alias("last"), F.count_if(F.col("t") == "term-list").alias("term_lists"), F.array_join(F.array_sort(F.collect_set("t")), " ").alias("elements"),
    )


def conversation_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract of lowering: nothing that a reader sees is lost, and a document without errors gives one without errors."""
    before = talks(spark, sf_dir)
    after = kept(rewrite.located(rewrite.lowered(before, REG)))
    lost = measures.lost(measures.units(before), measures.units(after)).groupBy("doc_id").agg(F.sum("n").alias("lost"))
    units = measures.units(before).groupBy("doc_id").agg(F.count("*").alias("units"))
    state = validate.conforming(before.where("depth = 0"), validate.validate(before, REG)).select("doc_id", F.col("errors").alias("errors_before"))
    low = validate.conforming(after.where("depth = 0"), validate.validate(after, REG)).select("doc_id", F.col("errors").alias("errors_after"))
    return state.join(low, "doc_id").join(units, "doc_id").join(lost, "doc_id", "left").select("doc_id", "units", F.coalesce("lost", F.lit(0)).alias("lost"), "errors_before", "errors_after")


def diagnostics_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The diagnostics of texts and conversations as lines for a reader."""
    return validate.rendered(_genres(spark, sf_dir)[1])


def documents_in_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as XML with a section for each line, mapped in pieces: anchors repeat, and lines refer to anchors that may not be there."""
    anchor = lambda n: F.concat(F.lit("a"), F.pmod(n, F.lit(50)).cast("string"))
    section = lambda x: F.concat(F.lit('<section anchor="'), anchor(F.length(x)), F.lit('"><t>'), C.escaped(x), F.lit('<xref target="'), anchor(F.length(x) + 1), F.lit('"/></t></section>'))
    key = F.col("doc_id").cast("string")
    raw = F.concat(F.lit("<rfc><front><title>Document "), key, F.lit("</title></front><middle>"), F.array_join(F.transform(lines_of(F.col("text")), section), ""), F.lit("</middle></rfc>"))
    n, found = xml_parts.xml_in_parts(table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw")), "raw", "standards", id_col="doc_id")
    shown = measures.units(n).groupBy("doc_id").agg(F.sum(F.length("unit")).alias("chars"))
    went = found.groupBy("doc_id").pivot("key", ["ids dropped", "references dropped"]).agg(F.sum("n")).select("doc_id", F.col("`ids dropped`").alias("ids"), F.col("`references dropped`").alias("references"))
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return n.groupBy("doc_id").agg(F.count("*").alias("nodes"), F.max("last_pos").cast("long").alias("last_pos"), F.count_if(F.col("t") == "reference").alias("alive")).join(shown, "doc_id").join(went, "doc_id", "left").select("doc_id", "nodes", "last_pos", "alive", "chars", none("ids"), none("references"))


def sentences_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sections of lines and paragraphs of what stands between full stops, without the blank ones."""
    pieces = lambda x: F.transform(F.split(x, "[.]", -1), paragraph)
    sections = F.transform(lines_of(F.col("text")), lambda x: element("section", c=pieces(x)))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), element("document", c=sections, id="urn:a:b", lang="en", title="T").alias("raw"))
    left = rewrite.pruned(kept(nodes.from_trees(docs)), REG)
    return left.groupBy("doc_id").agg(F.count("*").alias("nodes"), F.sum("depth").alias("levels"), F.sum(F.col("last_pos") - F.col("pos")).alias("below"), F.sum("ord").alias("places"), F.sum("n_children").alias("children"))


def excerpts_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One proof for all paragraphs of at least 80 characters of each document: its size, that it holds, and that it doesn't with one leaf forged."""
    n = kept(nodes.from_lines(table(spark, sf_dir, "documents")))
    # Leaves are paragraphs below the root, so the root's own digest isn't asked for.
    leaves = fold.digests(n.where("depth > 0")).join(n.where("t = 'paragraph'").select("doc_id", "pos"), ["doc_id", "pos"])
    stored = kept(proofs.levels(proofs.indexed(leaves.withColumn("h", F.unhex("digest")), "doc_id", "pos", "h")))
    wanted = n.where("t = 'text'").where(F.length(nodes.field("v")) >= 80).select(F.col("doc_id").alias("tree"), F.get("path", F.lit(0)).cast("long").alias("i"))
    made = proofs.multiproofs(stored, wanted)
    forged = F.transform("leaves", lambda x, k: F.struct(x["i"].alias("i"), F.when(k == 0, F.unhex(F.sha2(F.lit("forged"), 256))).otherwise(x["h"]).alias("h")))
    proof, size, root = F.col("proof"), F.col("n"), F.col("root")
    return made.select(
        F.col("tree").alias("doc_id"), size.alias("leaves"), F.size("leaves").cast("long").alias("asked"), F.size("proof").cast("long").alias("siblings"), (F.size("proof") * 32).cast("long").alias("bytes"),
        proofs.holds(F.col("leaves"), proof, size, root).alias("holds"), proofs.holds(forged, proof, size, root).alias("forged_holds"),
    )


def versions() -> dict[str, Register]:
    """The register and three versions of it: one element more, one less and a narrower range, one field more required."""
    later, older, strict = (json.loads(ELEMENTS.read_bytes()) for _ in range(3))
    later["elements"].append({"n": "motto", "layer": 1, "class": "block", "children": "inline", "fields": {}})
    older["elements"] = [e for e in older["elements"] if e["n"] != "sidebar"]
    next(e for e in older["elements"] if e["n"] == "heading")["fields"]["level"]["range"] = [1, 3]
    next(e for e in strict["elements"] if e["n"] == "section")["fields"]["id"]["required"] = True
    return {"current": REG} | {k: from_json(json.dumps(v).encode()) for k, v in (("later", later), ("older", older), ("strict", strict))}


def versions_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as documents that are pinned to versions of the register: errors by the current one and by their own."""
    known = versions()
    pins = [None, *[r.digest for r in known.values()], "0" * 64]
    pin = F.get(F.array(*[F.lit(p) for p in pins]), (F.col("p_partkey") % len(pins)).cast("int"))
    level = F.element_at(F.array(*[F.lit(k) for k in range(1, 7)]), (F.col("p_size") % 6 + 1).cast("int"))
    kids = [element("motto", leaf("text", v=F.col("p_name"))), element("sidebar", paragraph(F.col("p_brand"))), element("heading", leaf("text", v=F.col("p_type")), level=level), element("section", paragraph("x"))]
    raw = element("document", *kids, id="urn:a:b", lang="en", title=F.col("p_name"), register=pin)
    n = kept(nodes.from_trees(spread(table(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").cast("string").alias("doc_id"), raw.alias("raw"))))
    archive = {r.digest: r for r in known.values()}
    found = validate.validate_pinned(n, REG, archive).groupBy("doc_id").agg(F.count_if(F.col("register") == REG.digest).alias("now"), F.count_if(F.col("register") != REG.digest).alias("then"))
    held = validate.pinned(n, REG, archive).join(found, "doc_id", "left")
    name = F.coalesce(*[F.when(F.col("pin") == r.digest, k) for k, r in known.items()], F.lit("-"))
    return held.groupBy("outcome", name.alias("version")).agg(F.count("*").alias("documents"), F.sum(F.coalesce("now", F.lit(0))).alias("errors_now"), F.sum(F.coalesce("then", F.lit(0))).alias("errors_then"))


def conversation_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation against the next one (by id): the first seven differences, by kind."""
    part = element("section", paragraph(F.coalesce("text", F.lit(""))), id=F.coalesce("role", F.lit("")))
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", part.alias("part"))
    n = kept(nodes.from_trees(joined(said, F.lit("T"), F.lit("urn:a:b"))))
    found = diff.differences(n, n.withColumn("doc_id", (F.col("doc_id").cast("long") - 1).cast("string")))
    return found.groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.max("nth").cast("long").alias("last"), F.max(F.size("path")).cast("long").alias("deepest"))


def users_arriving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the nodes of their users' documents, arriving in four batches; a day of silence ends a document."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("doc_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("t"), F.get_json_object("props", "$.k").alias("id"))
    folder = shared_folder(spark, "arrivals")
    found = arrivals.replayed(e, lambda: spark.readStream.schema(e.schema).parquet(f"{folder}/nodes"), 4, folder, gap_seconds=86_400)
    said = F.array_join(F.array_sort(F.transform(F.map_entries("elements"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string")))), " ")
    return found.select("doc_id", F.unix_millis("start").alias("start_ms"), F.unix_millis("last").alias("last_ms"), "nodes", "repeated", said.alias("elements"))


def conversation_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations in the plain-text surface; whether they are read back as the same tree, and written again as the same text."""
    said, role = F.transform(lines_of(F.col("text")), paragraph), F.coalesce("role", F.lit(""))
    items = F.transform(lines_of(F.col("text")), lambda x: element("item", paragraph(x)))
    kinds = [element("admonition", c=said, kind="note"), element("disclosure", c=said, summary=role, open=False), element("list", c=items, ordered=True, start=F.col("turn") + 1), element("quote", c=said, source=role)]
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.get(F.array(*kinds), (F.col("turn") % 4).cast("int")).alias("part"))
    key = F.col("conv_id").cast("string")
    def read_back(talk: dict) -> dict:
        tree = surface.read(talk["surface"], REG)
        return {"same_tree": trees.structural_hash(tree).hex() == talk["digest"], "same_text": surface.write(tree) == talk["surface"]}

    # Each is read back where it was written, one at a time.
    talks_ = joined(turns, F.concat(F.lit("Conversation "), key), F.concat(F.lit("urn:talk:"), key))
    return nodes.views(talks_, REG, columns=("surface", "same_tree", "same_text"), more=(("surface", "digest"), read_back, {"same_tree": "boolean", "same_text": "boolean"}))


ORDER = readers.Layout(key="key", title="subject", pairs=(("Status", "status", "text"), ("Customer", "customer", "entity"), ("Issued", "issued", "day")), attachments="files", signers="signers", href="https://orders.example/{key}/files/{id}")


def records_signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as signed records in plain text; customers that owe nothing are known by name."""
    key, customer = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    file = F.struct(F.col("o_orderkey").alias("id"), F.concat(F.lit("Order "), key).alias("description"), F.col("o_totalprice").cast("long").alias("size"))
    record = F.struct(key.alias("key"), F.concat(F.lit("Order "), key).alias("subject"), F.col("o_orderstatus").alias("status"), customer.alias("customer"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("issued"), F.array(file).alias("files"), F.array(customer).alias("signers"))
    rows = spread(table(spark, sf_dir, "orders"), "o_orderkey").select("o_orderkey", F.to_json(record).alias("raw"))
    labels = table(spark, sf_dir, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("uid"), F.col("c_name").alias("label"))
    return nodes.views(readers.laid_out(rows, "raw", ORDER, id_col="o_orderkey", labels=labels), REG, columns=("plain",))


def pages_scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What in each live page fetches, names a host or could run."""
    html = F.coalesce("html", F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", *[F.size(f(html)).cast("long").alias(k) for k, f in (("fetchers", C.fetchers), ("hosts", C.named_hosts), ("executable", C.executable))])


def page_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live pages against their text, by the language that they say they are in."""
    html = F.coalesce("html", F.lit(""))
    held = table(spark, sf_dir, "pages").select(F.regexp_extract(html, r'<html lang="([^"]*)"', 1).alias("lang"), F.octet_length(html).alias("live"), F.octet_length(C.stripped(html)).alias("said"))
    return measures.projection_ratio(held, "live", "said", ("lang",))


def _genres(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Texts and conversations as node tables of two genres, and their diagnostics; a conversation's roles are ids, which repeat."""
    part = element("section", paragraph(F.coalesce("text", F.lit(""))), id=F.coalesce("role", F.lit("")))
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", part.alias("part"))
    talk = nodes.from_trees(joined(said, F.lit("T"), F.lit("urn:a:b"))).withColumn("genre", F.lit("talks"))
    text = nodes.from_lines(table(spark, sf_dir, "documents")).withColumn("genre", F.lit("texts"))
    n = kept(text.unionByName(talk.withColumn("doc_id", F.concat(F.lit("t"), "doc_id"))))
    return n, validate.validate(n, REG).withColumn("genre", F.when(F.col("doc_id").startswith("t"), "talks").otherwise("texts"))


def reports_by_genre(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of each genre: coverage, elements, rules, and which languages and roles were found."""
    n, diags = _genres(spark, sf_dir)
    found = n.where("depth = 0 or t = 'section'").select("genre", F.when(F.col("depth") == 0, F.concat(F.lit("lang "), nodes.field("lang"))).otherwise(F.concat(F.lit("role "), nodes.field("id"))).alias("key"), F.lit(1).alias("n"))
    return reports.by_genre(n, diags, found, REG)


def reports_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements that the written reports of the genres list: how many elements there are, how many are used, which of the base layer aren't."""
    n, _ = _genres(spark, sf_dir)
    report = reports.by_genre(n, spark.createDataFrame([], "genre string, doc_id string, rule string"), spark.createDataFrame([], "genre string, key string, n long"), REG)
    folder = shared_folder(spark, "reports")
    reports.element_lines(report, REG).write.partitionBy("genre").text(folder)
    union = measures.union_of(measures.verdicts(reports.used_in(spark, folder), REG))
    return union.select("elements", "used", F.array_join("unproven", " ").alias("unproven"))


def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages and sources of documents; a missing one counts."""
    return measures.distinct_values(table(spark, sf_dir, "documents"), "lang", "source")


QUERIES = {f.__name__: f for f in (document_digests, conversation_texts, conversation_bases, sentences_pruned, excerpts_of_documents, versions_validated, conversation_differences, users_arriving, records_signed, pages_scanned, page_ratios, reports_by_genre, reports_read_back, distinct_values, conversation_surfaces, conversation_contracts, diagnostics_rendered, documents_in_pieces)}

Q = "SELECT doc_id, lang, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM (SELECT doc_id, coalesce(lang, 'en') AS lang, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '') AS ls FROM documents)"
STRIPPED = r"trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"
ELEMENT_ROWS = "(VALUES " + ", ".join(f"('{e.name}', {e.layer})" for e in REG.elements.values()) + ") AS e(t, layer)"
_TURNS = "SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '') AS ls, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM conversations"


def _digest(t: str, fields: list[tuple[str, str]], n: str, below: str = "") -> str:
    """SQL of a node's digest; values and n are SQL, below a blob."""
    nul = r"'\x00'::BLOB"
    parts = ["encode('node')", f"encode('{t}')", f"encode('f{len(fields)}')", *[x for k, v in fields for x in (f"encode('{k}')", f"encode(nfc_normalize({v}))")], f"encode('c' || {n})"]
    return "sha256(" + f" || {nul} || ".join(parts) + f" || {nul}" + (f" || {below}" if below else "") + ")"


_TITLE = "'Conversation ' || conv_id"
_PART = (
    "CASE turn % 5 WHEN 0 THEN '### note' || chr(10) || chr(10) || text || chr(10) WHEN 1 THEN '### ' || role || chr(10) || chr(10) || text || chr(10) "
    "WHEN 2 THEN coalesce(array_to_string(list_transform(range(1, len(ls) + 1), lambda i: i || '. ' || ls[i]), chr(10)) || chr(10), '') "
    "WHEN 3 THEN role || ':' || chr(10) || CASE WHEN trim(text) = '' THEN '' ELSE '  ' || replace(text, chr(10), chr(10) || '  ') || chr(10) END || chr(10) || 'Send' || chr(10) ELSE text || chr(10) END"
)
_BLANK = "(trim(text) <> '')::INT"
ORACLE = {
    "document_digests": f"WITH p AS (SELECT doc_id, i, {_digest('paragraph', [], "'1'", "unhex(" + _digest('text', [('v', 'line')], "'0'") + ")")} AS h FROM ({Q})), k AS (SELECT doc_id, count(*) AS n, unhex(string_agg(h, '' ORDER BY i)) AS below FROM p GROUP BY doc_id) "
    f"SELECT CAST(d.doc_id AS VARCHAR) AS doc_id, {_digest('document', [('id', "'urn:corpus:' || d.doc_id"), ('lang', "coalesce(lang, 'en')"), ('title', "'Document ' || d.doc_id")], 'coalesce(n, 0)', "coalesce(below, ''::BLOB)")} AS digest FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id",
    "conversation_texts": f"SELECT CAST(conv_id AS VARCHAR) AS doc_id, regexp_replace({_TITLE} || chr(10) || repeat('=', length({_TITLE})) || chr(10) || chr(10) || string_agg(nfc_normalize({_PART}), chr(10) ORDER BY turn), '\\s+$', '') AS plain FROM ({_TURNS}) GROUP BY conv_id",
    "conversation_bases": f"WITH t AS (SELECT *, len(ls) AS l, {_BLANK} AS s FROM ({_TURNS})), c AS (SELECT *, CASE turn % 5 WHEN 2 THEN 1 + 3 * l WHEN 3 THEN 8 + s WHEN 4 THEN 2 + s ELSE 4 + 1 END AS n, CASE turn % 5 WHEN 2 THEN 1 + 9 * l WHEN 3 THEN 22 + 5 * s WHEN 4 THEN 3 + 3 * s ELSE 11 END AS d, "
    "k + CASE turn % 5 WHEN 2 THEN l * (l - 1) // 2 WHEN 3 THEN 2 WHEN 4 THEN 0 ELSE 1 END AS o FROM t), "
    "e AS (SELECT conv_id, string_agg(DISTINCT x, ' ' ORDER BY x) AS elements FROM (SELECT conv_id, unnest(CASE turn % 5 WHEN 2 THEN CASE WHEN l > 0 THEN ['document', 'list', 'item', 'paragraph', 'text'] ELSE ['document', 'list'] END WHEN 3 THEN ['document', 'section', 'term-list', 'term', 'definition', 'paragraph', 'text'] WHEN 4 THEN ['document', 'section', 'paragraph', 'text'] ELSE ['document', 'section', 'heading', 'paragraph', 'text'] END) AS x FROM t) GROUP BY conv_id) "
    "SELECT CAST(conv_id AS VARCHAR) AS doc_id, CAST(1 + sum(n) AS BIGINT) AS nodes, CAST(sum(d) AS BIGINT) AS levels, CAST(sum(d) AS BIGINT) AS below, CAST(sum(o) AS BIGINT) AS places, CAST(sum(n) AS BIGINT) AS children, CAST(sum(n) AS BIGINT) AS last, count(*) FILTER (turn % 5 = 3) AS term_lists, any_value(elements) AS elements FROM c JOIN e USING (conv_id) GROUP BY conv_id",
    "sentences_pruned": f"WITH s AS (SELECT doc_id, i, len(list_filter(string_split(line, '.'), lambda x: trim(x) <> '')) AS k FROM ({Q})), d AS (SELECT doc_id, count(*) AS n, sum(k) AS k, sum(k * (k - 1) // 2) AS o FROM s WHERE k > 0 GROUP BY doc_id) "
    "SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(1 + coalesce(n + 2 * k, 0) AS BIGINT) AS nodes, CAST(coalesce(n + 5 * k, 0) AS BIGINT) AS levels, CAST(coalesce(n + 5 * k, 0) AS BIGINT) AS below, CAST(coalesce(n * (n - 1) // 2 + o, 0) AS BIGINT) AS places, CAST(coalesce(n + 2 * k, 0) AS BIGINT) AS children FROM documents LEFT JOIN d USING (doc_id)",
    "excerpts_of_documents": f"WITH l AS (SELECT doc_id, i - 1 AS i, length(line) AS c, count(*) OVER (PARTITION BY doc_id) AS n FROM ({Q})), w AS (SELECT doc_id, i, n FROM l WHERE c >= 80), "
    "k AS (SELECT DISTINCT doc_id, k, i >> k AS j, (n + (1 << k) - 1) >> k AS m FROM w CROSS JOIN (SELECT CAST(k AS INTEGER) AS k FROM range(20) r(k)) WHERE (n + (1 << k) - 1) >> k > 1), "
    "s AS (SELECT doc_id, count(*) AS s FROM k a WHERE xor(j, 1) < m AND NOT EXISTS (SELECT 1 FROM k b WHERE b.doc_id = a.doc_id AND b.k = a.k AND b.j = xor(a.j, 1)) GROUP BY doc_id) "
    "SELECT CAST(doc_id AS VARCHAR) AS doc_id, any_value(n) AS leaves, count(*) AS asked, coalesce(any_value(s), 0) AS siblings, 32 * coalesce(any_value(s), 0) AS bytes, true AS holds, false AS forged_holds FROM w LEFT JOIN s USING (doc_id) GROUP BY doc_id",
    "versions_validated": "SELECT ['none', 'current', 'archived', 'archived', 'archived', 'unresolvable'][p_partkey % 6 + 1] AS outcome, ['-', 'current', 'later', 'older', 'strict', '-'][p_partkey % 6 + 1] AS version, count(*) AS documents, count(*) AS errors_now, "
    "CAST(sum(CASE p_partkey % 6 WHEN 3 THEN 2 + (p_size % 6 + 1 > 3)::INT WHEN 4 THEN 2 ELSE 0 END) AS BIGINT) AS errors_then FROM part GROUP BY ALL",
    "conversation_differences": f"WITH t AS ({_TURNS}), n AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id), d AS (SELECT a.conv_id, -1 AS k, 0 AS deep, 'children' AS kind FROM n a JOIN n b ON b.conv_id = a.conv_id + 1 WHERE a.n <> b.n "
    "UNION ALL SELECT a.conv_id, a.k, x.deep, 'fields' FROM t a JOIN t b ON b.conv_id = a.conv_id + 1 AND a.k = b.k CROSS JOIN (VALUES (1), (3)) x(deep) WHERE CASE x.deep WHEN 1 THEN a.role <> b.role ELSE nfc_normalize(a.text) <> nfc_normalize(b.text) END), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY k, deep) AS nth FROM d) SELECT CAST(conv_id AS VARCHAR) AS doc_id, kind, count(*) AS n, max(nth) AS last, CAST(max(deep) AS BIGINT) AS deepest FROM r WHERE nth <= 7 GROUP BY conv_id, kind",
    "users_arriving": "WITH e AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, event_type AS t, json_extract_string(props, '$.k') AS id FROM events), g AS (SELECT *, CASE WHEN ms - lag(ms) OVER w > 86400000 THEN 1 ELSE 0 END AS b FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ms)), "
    "s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ms) AS s FROM g), c AS (SELECT user_id, s, string_agg(t || '=' || n, ' ' ORDER BY t) AS elements FROM (SELECT user_id, s, t, count(*) AS n FROM s GROUP BY ALL) GROUP BY ALL) "
    "SELECT CAST(user_id AS VARCHAR) AS doc_id, min(ms) AS start_ms, max(ms) AS last_ms, count(*) AS nodes, count(id) - count(DISTINCT id) AS repeated, any_value(elements) AS elements FROM s JOIN c USING (user_id, s) GROUP BY user_id, s",
    "records_signed": "WITH r AS (SELECT o_orderkey AS k, 'Order ' || o_orderkey AS t, o_orderstatus AS s, CASE WHEN c_acctbal >= 0 THEN c_name || ' (' || o_custkey || ')' ELSE CAST(o_custkey AS VARCHAR) END AS c, strftime(o_orderdate, '%Y-%m-%d') AS d, CAST(trunc(o_totalprice) AS BIGINT) AS z FROM orders LEFT JOIN customer ON o_custkey = c_custkey) "
    "SELECT CAST(k AS VARCHAR) AS doc_id, concat_ws(chr(10), t, repeat('=', length(t)), '', '# ' || t, '', 'Status:', '  ' || s, 'Customer:', '  ' || c, 'Issued:', '  ' || d, '', '## Documents', '', '- ' || t || ' <https://orders.example/' || k || '/files/' || k || '>', '  Size:', '    ' || z, '  Id:', '    ' || k, '', 'Signed by:', '  ' || c) AS plain FROM r",
    "pages_scanned": r"""SELECT page_id, len(regexp_extract_all(html, '(?i)<\s*(?:script|iframe|embed|object|base)\b|@import\b|\burl\s*\(', 0)) + len(list_filter(regexp_extract_all(html, '(?i)<\s*link\b[^>]*>', 0), lambda x: NOT regexp_full_match(trim(lower(regexp_extract(x, '(?i)\brel\s*=\s*"([^"]*)"', 1))), '(alternate|canonical|author|license|next|prev|help|search|bookmark|nofollow)(\s+(alternate|canonical|author|license|next|prev|help|search|bookmark|nofollow))*'))) AS fetchers, """
    r"""len(list_filter(regexp_extract_all(html, '(?i)\b(?:src|srcset|poster|background)\s*=\s*"([^"]*)"', 1), lambda x: regexp_matches(x, '^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:|//)'))) AS hosts, CAST(contains(lower(html), 'javascript:')::INT + contains(lower(html), 'vbscript:')::INT + contains(lower(html), '<script')::INT + contains(lower(html), 'onerror=')::INT + contains(lower(html), 'data:text/html')::INT AS BIGINT) AS executable FROM pages""",
    "page_ratios": rf"WITH p AS (SELECT regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang, strlen(html) AS l, strlen({STRIPPED}) AS s FROM pages) SELECT lang, count(*) AS documents, CAST(sum(l) AS BIGINT) AS live_bytes, CAST(sum(s) AS BIGINT) AS text_bytes, CAST((sum(l) - sum(s)) * 100 // greatest(sum(l), 1) AS BIGINT) AS markup_percent, round(sum(l) / greatest(sum(s), 1), 1) AS ratio FROM p GROUP BY lang",
    "reports_by_genre": f"WITH c AS (SELECT conv_id, count(*) AS n, count(*) - count(DISTINCT role) AS r FROM ({_TURNS}) GROUP BY conv_id), l AS (SELECT count(*) AS n FROM ({Q})), t AS (SELECT 'texts' AS genre, 'coverage' AS section, 'documents' AS key, count(*) AS n FROM documents UNION ALL SELECT 'texts', 'coverage', 'conforming', count(*) FILTER (doc_id IN (SELECT doc_id FROM ({Q}))) FROM documents "
    f"UNION ALL SELECT 'texts', 'elements', 'document', count(*) FROM documents UNION ALL SELECT 'texts', 'elements', x, n FROM l CROSS JOIN (VALUES ('paragraph'), ('text')) v(x) UNION ALL SELECT 'texts', 'rules', 'R18', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({Q})) UNION ALL SELECT 'texts', 'findings', 'lang ' || coalesce(lang, 'en'), count(*) FROM documents GROUP BY 3 "
    "UNION ALL SELECT 'talks', 'coverage', 'documents', count(*) FROM c UNION ALL SELECT 'talks', 'coverage', 'conforming', count(*) FILTER (r = 0) FROM c UNION ALL SELECT 'talks', 'elements', 'document', count(*) FROM c UNION ALL SELECT 'talks', 'elements', x, CAST(sum(n) AS BIGINT) FROM c CROSS JOIN (VALUES ('section'), ('paragraph'), ('text')) v(x) GROUP BY 3 "
    f"UNION ALL SELECT 'talks', 'rules', 'R12', CAST(sum(r) AS BIGINT) FROM c UNION ALL SELECT 'talks', 'findings', 'role ' || role, count(*) FROM ({_TURNS}) GROUP BY 3 UNION ALL SELECT 'talks', 'findings', 'lang en', count(*) FROM c) SELECT * FROM t WHERE n > 0 OR section = 'coverage'",
    "reports_read_back": f"WITH e AS (SELECT * FROM {ELEMENT_ROWS}), u AS (SELECT 'document' AS t UNION ALL SELECT 'section' UNION ALL SELECT 'paragraph' UNION ALL SELECT 'text') SELECT (SELECT count(*) FROM e) AS elements, (SELECT count(*) FROM u) AS used, (SELECT string_agg(t, ' ' ORDER BY t) FROM e WHERE layer = 0 AND t NOT IN (SELECT t FROM u)) AS unproven FROM (SELECT count(*) AS n FROM conversations) WHERE n > 0",
    "distinct_values": "SELECT count(DISTINCT lang) + max((lang IS NULL)::INT) AS lang, count(DISTINCT source) + max((source IS NULL)::INT) AS source FROM documents",
    "conversation_surfaces": rf"""WITH t AS (SELECT *, list_transform(ls, lambda x: regexp_replace(x, '([\\*_`\[\]{{}}#>|:])', '\\\1', 'g')) AS es FROM ({_TURNS})) SELECT CAST(conv_id AS VARCHAR) AS doc_id, '---' || chr(10) || 'id: urn:talk:' || conv_id || chr(10) || 'lang: en' || chr(10) || 'title: Conversation ' || conv_id || chr(10) || '---' || chr(10) || chr(10) || string_agg(CASE turn % 4 WHEN 0 THEN '::: admonition kind=note' || chr(10) || array_to_string(es, chr(10) || chr(10)) || chr(10) || ':::' WHEN 1 THEN '::: disclosure open=false summary=' || role || chr(10) || array_to_string(es, chr(10) || chr(10)) || chr(10) || ':::' WHEN 2 THEN array_to_string(list_transform(range(1, len(es) + 1), lambda i: (i + turn) || '. ' || es[i]), chr(10)) ELSE '> ' || array_to_string(es, chr(10) || '> ') || chr(10) || '> {{{{source v=' || role || '}}}}' END, chr(10) || chr(10) ORDER BY turn) || chr(10) AS surface, true AS same_tree, true AS same_text FROM t GROUP BY conv_id""",
    "conversation_contracts": f"SELECT CAST(conv_id AS VARCHAR) AS doc_id, CAST(sum(CASE turn % 5 WHEN 2 THEN len(ls) WHEN 4 THEN 1 ELSE 2 END) AS BIGINT) AS units, CAST(0 AS BIGINT) AS lost, CAST(0 AS BIGINT) AS errors_before, CAST(0 AS BIGINT) AS errors_after FROM ({_TURNS}) GROUP BY conv_id",
    "diagnostics_rendered": f"SELECT 't' || conv_id AS doc_id, 'error [R12] /' || k || ':section: ' || role AS line FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY k) AS nth FROM ({_TURNS})) WHERE nth > 1 UNION ALL SELECT CAST(doc_id AS VARCHAR), 'error [R18] /: empty' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({Q}))",
    "documents_in_pieces": f"WITH l AS (SELECT doc_id, length(line) % 50 AS a, (length(line) + 1) % 50 AS b, length(regexp_replace(line, '\\s+', ' ', 'g')) AS c FROM ({Q})), r AS (SELECT l.*, (EXISTS (SELECT 1 FROM l m WHERE m.doc_id = l.doc_id AND m.a = l.b))::INT AS alive FROM l), "
    "g AS (SELECT doc_id, count(*) AS n, sum(alive) AS alive, count(*) - count(DISTINCT a) AS ids, count(*) - sum(alive) AS refs, sum(c + length('a' || b)) AS c FROM r GROUP BY doc_id) SELECT CAST(d.doc_id AS VARCHAR) AS doc_id, CAST(3 + 4 * coalesce(n, 0) + coalesce(alive, 0) AS BIGINT) AS nodes, "
    "CAST(2 + 4 * coalesce(n, 0) + coalesce(alive, 0) AS BIGINT) AS last_pos, CAST(coalesce(alive, 0) AS BIGINT) AS alive, CAST(length('Document ' || d.doc_id) + coalesce(c, 0) AS BIGINT) AS chars, coalesce(ids, 0) AS ids, CAST(coalesce(refs, 0) AS BIGINT) AS \"references\" FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id",
}
