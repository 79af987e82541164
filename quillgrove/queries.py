"""The registered queries over document trees and the driver's tables, with the SQL that checks them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns as C
from .functions import surface, trees
from . import made, whole
from .operators import degrade, generate, measures, nodes, ordered, reports, validate
from .operators.kept import kept, spread
from .plans.register import built_in
from .sources import readers, writers
from .streaming import ingest

REG = built_in()
Q = "SELECT doc_id, lang, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM (SELECT doc_id, coalesce(lang, 'en') AS lang, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '') AS ls FROM documents)"
ELEMENTS = "(VALUES " + ", ".join(f"('{e.name}', {e.layer}, '{e.cls}')" for e in REG.elements.values()) + ") AS e(t, layer, cls)"
HREFS = "SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages"
STRIPPED = r"trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _nodes(spark: SparkSession, sf_dir: str, lang_col: str | None = "lang") -> DataFrame:
    return nodes.from_lines(table(spark, sf_dir, "documents"), lang_col=lang_col)


def _trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON trees, made in the JVM."""
    docs = table(spark, sf_dir, "documents")
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.trim(x) != "")
    kids = F.transform(lines, lambda x: F.struct(F.lit("paragraph").alias("t"), F.array(F.struct(F.lit("text").alias("t"), x.alias("v"))).alias("c")))
    key = F.col("doc_id").cast("string")
    tree = F.to_json(F.struct(F.lit("document").alias("t"), F.concat(F.lit("urn:corpus:"), key).alias("id"), F.coalesce("lang", F.lit("en")).alias("lang"), F.concat(F.lit("Document "), key).alias("title"), kids.alias("c")))
    return docs.select(key.alias("doc_id"), "lang", tree.alias("raw"))


def node_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan to nodes, join with the register, count elements."""
    return measures.histogram(_nodes(spark, sf_dir), REG)


def layer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.by_layer(measures.histogram(_nodes(spark, sf_dir), REG).select("t", "layer"))


def content_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.units(_nodes(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("units"), F.sum(F.length("unit")).alias("chars"))


def units_lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiset difference: what of a document's units is lost if each is said once."""
    found = measures.units(_nodes(spark, sf_dir))
    return measures.lost(found, found.select("doc_id", "unit").distinct())


def block_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.blocks(_nodes(spark, sf_dir), REG).groupBy("doc_id").agg(F.count("*").alias("blocks"), F.max("last_pos").alias("last_pos"))


def unused_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.unused(_nodes(spark, sf_dir), REG)


def errors_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources stand in for languages here, so that rules are broken."""
    return validate.by_rule(validate.validate(_nodes(spark, sf_dir, "source"), REG))


def coverage_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: validate every document and report what share conforms, by language."""
    n = _nodes(spark, sf_dir)
    state = validate.conforming(n.where("depth = 0"), validate.validate(n, REG))
    flags = state.join(n.where("depth = 0").select("doc_id", nodes.field("lang").alias("lang")), "doc_id")
    # A line is lost if it isn't among the units; nodes of unknown elements are escapes.
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.trim(x) != "")
    said = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.explode(F.transform(lines, lambda x: F.xxhash64(x))).alias("unit"))
    lost = measures.lost(said, measures.units(n).select("doc_id", F.xxhash64("unit").alias("unit"))).groupBy("doc_id").agg(F.sum("n").alias("lost"))
    escapes = n.where(~F.col("t").isin(*REG.elements)).groupBy("doc_id").agg(F.count("*").alias("escapes"))
    held = flags.join(lost, "doc_id", "left").join(escapes, "doc_id", "left")
    return measures.coverage(held.withColumns({"lost": F.coalesce("lost", F.lit(0)), "escapes": F.coalesce("escapes", F.lit(0))}), ("lang",))


def evidence_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpora of texts and of records made from events; a fixture shows tables."""
    n = _nodes(spark, sf_dir).select(F.lit("texts").alias("genre"), "t")
    events, record = spread(table(spark, sf_dir, "events").select("event_id", "props"), "event_id").withColumn("key", F.col("event_id").cast("string")), readers.record()
    # The records' nodes are made where the records are read, without their JSON in between; only their elements are asked for.
    held = nodes.from_trees(events, lambda k, r: record(k, r)[0], id_col="key", raw_col=("key", "props"), columns=("t",)).select(F.lit("records").alias("genre"), "t")
    used = n.unionAll(held)
    fixture = spark.createDataFrame([("table",), ("row",)], "t string")
    return measures.verdicts(used, REG, fixture)


def envelope_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean bytes of the canonical and plain forms."""
    held = _trees(spark, sf_dir)
    made = nodes.views(held, REG, columns=("canonical", "plain")).join(held.select("doc_id", "lang"), "doc_id")
    return measures.envelope(made, ("canonical", "plain"), ("lang",))


def fixed_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether JSON and CBOR of each document have one digest, and the surface is a fixed point; each is read back where it was written, one document at a time."""
    held = nodes.views(_trees(spark, sf_dir), REG, columns=("digest", "cbor", "surface", "units", "base_units"))

    def read_back(doc: dict) -> dict:
        tree = surface.read(doc["surface"], REG)
        same = sorted(doc["units"]) == sorted(doc["base_units"])
        return {"by_cbor": trees.structural_hash(trees.from_cbor(doc["cbor"])).hex() == doc["digest"], "again": surface.write(tree) == doc["surface"], "same": same}

    back = nodes.views(_trees(spark, sf_dir), REG, columns=("by_cbor", "again", "same"), more=(("digest", "cbor", "surface", "units", "base_units"), read_back, {"by_cbor": "boolean", "again": "boolean", "same": "boolean"}))
    return back.agg(F.count("*").alias("documents"), F.count_if("by_cbor").alias("by_cbor"), F.count_if("again").alias("surface_again"), F.count_if("same").alias("nothing_lost"))


def not_carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the next document (by id) that a document neither carries nor shows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lines = docs.select("doc_id", F.explode(F.split("text", "\n", -1)).alias("s")).where("trim(s) <> ''")
    return measures.not_carried(lines.select((F.col("doc_id") - 1).alias("doc_id"), "s"), lines.select("doc_id", F.col("s").alias("unit")), docs.select("doc_id", F.col("text").alias("plain"))).groupBy("doc_id").agg(F.count("*").alias("n"))


def merkle_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A root for each conversation over its turns' digests."""
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("h"))
    return ordered.merkle(said, "conv_id", "turn", "h")


def turns_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    held = ordered.followed(ordered.numbered(said, ["conv_id"], "turn"), ["conv_id"], "turn", "role")
    return ordered.islands(held, ["conv_id"], "turn", "role = 'user'").select("conv_id", "turn", F.col("number").cast("long").alias("number"), "following", F.col("run").cast("long").alias("run"))


def columns_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of event properties, by event type, in order of first appearance."""
    e = table(spark, sf_dir, "events").select("event_type", "event_id", F.posexplode(F.json_object_keys("props")).alias("place", "name"))
    return ordered.columns_in_order(e, "event_type", "event_id", "place", "name").select("event_type", "name", F.col("column").cast("long").alias("column"))


def top_event_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.most_common(table(spark, sf_dir, "events"), "event_type", 3, "event_id")


def decimal_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("value").cast("decimal(18,2)").cast("string").alias("v"), "event_type")
    return measures.scales(e, "v", "event_type").select(F.col("scale").cast("long").alias("scale"), "n", F.array_join("currencies", ",").alias("currencies"))


def quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices as significand, scale and unit, written out."""
    price = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    held = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), C.decimal_significand(price).alias("n"), C.decimal_scale(price).alias("scale"))
    return held.select("l_orderkey", "l_linenumber", C.quantity_text(F.col("n"), F.col("scale"), F.lit("EUR")).alias("price"))


def event_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", C.day(ms).alias("day"), C.second(ms).alias("second"), C.label_for(F.col("event_type")).alias("label"))


def entity_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by their nation's label, or the bare key where it isn't known."""
    # Every third customer names a nation that isn't known.
    named = F.col("c_nationkey") + F.when(F.col("c_custkey") % 3 == 0, 100).otherwise(0)
    held = table(spark, sf_dir, "customer").withColumn("named", named).join(table(spark, sf_dir, "nation"), F.col("named") == F.col("n_nationkey"), "left")
    return held.groupBy(C.entity_label(F.col("n_name"), F.col("named")).alias("body")).agg(F.count("*").alias("n"))


def provenance_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled values of each supplier, as rows; absent ones give none."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("doc_id"), "s_name", F.col("s_nationkey").cast("string").alias("nation"), F.when(F.col("s_acctbal") >= 0, F.col("s_suppkey").cast("string")).alias("credit"))
    return s.select("doc_id", F.expr("stack(3, 'Name', s_name, 'Nation', nation, 'In credit', credit) as (label, value)")).where("value is not null")


def safe_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    href = F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))
    held = table(spark, sf_dir, "pages").select(href.alias("href"))
    return held.groupBy(C.safe_iri(F.col("href")).alias("safe"), C.leads_elsewhere(F.col("href")).alias("elsewhere")).agg(F.count("*").alias("n"))


def page_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", C.host(u).alias("host"), C.slug(C.host(u)).alias("slug"), C.cache_key(u).alias("cache_key"), C.anchor(u).alias("anchor"))


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recoverable text of a page, its share of the bytes, and what a browser would fetch."""
    text = C.stripped(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.octet_length("html").cast("long").alias("bytes"), F.octet_length(text).cast("long").alias("text_bytes"), C.floor_percent(F.octet_length(text).cast("long"), F.octet_length("html").cast("long")).alias("percent"), C.fetched(F.col("html")).cast("long").alias("fetched"))


def escaped_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", C.escaped(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))


def query_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(C.query_links(F.col("html")), "&").alias("links"))


def form_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' forms as documents: how often each element occurs."""
    return measures.histogram(nodes.from_trees(readers.forms_of(table(spark, sf_dir, "pages"))), REG).select("t", "n")


def record_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties as documents, validated: elements and errors."""
    n = nodes.from_trees(readers.records_of(spread(table(spark, sf_dir, "events").select("event_id", "props"), "event_id"), "props", id_col="event_id"))
    n = kept(n)  # parsed once for all rules
    errors = validate.validate(n, REG).agg(F.count("*").alias("n")).select(F.lit("(errors)").alias("t"), "n")
    return measures.histogram(n, REG).select("t", "n").unionAll(errors)


def degraded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as a table by region, degraded: sections of the table give way to their rows."""
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("int").alias("k"))
    none = F.array().cast(nodes.FIELDS)
    made = lambda d, pos, parent, order, t, last, depth: d.select(F.lit("nations").alias("doc_id"), pos.cast("int").alias("pos"), F.lit(depth).alias("depth"), parent.cast("int").alias("parent_pos"), order.cast("int").alias("ord"), F.lit(t).alias("t"), none.alias("fields"), last.cast("int").alias("last_pos"))
    sections = made(r, F.col("k") * 100, F.lit(-1), F.col("k"), "table-section", F.col("k") * 100 + 99, 1)
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("int").alias("k"), F.col("n_nationkey").cast("int").alias("i"))
    rows = made(n, F.col("k") * 100 + F.col("i") + 1, F.col("k") * 100, F.col("i"), "row", F.col("k") * 100 + F.col("i") + 1, 2)
    low = degrade.spliced(degrade.renamed(sections.unionAll(rows)))
    return low.select("t", *[F.col(c).cast("long").alias(c) for c in ("pos", "parent_pos", "depth", "ord")])


def negotiated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is sent for a client's wishes; each of five headers is asked by a fifth of the pages."""
    headers = ["", "text/html;q=0.1, text/plain", "application/*", "image/png", "text/html;q=0, */*;q=0.5"]
    header = F.get(F.array(*[F.lit(h) for h in headers]), (F.col("page_id") % 5).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", C.negotiated(header, list(writers.FORMS)).alias("media"))


def excerpt_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of every document's middle paragraph."""
    return reports.excerpt_proofs(_trees(spark, sf_dir), REG).select("doc_id", "blocks", "holds", "forged_holds")


def not_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text isn't in NFC."""
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("documents"), F.count_if(~C.is_nfc(F.coalesce("text", F.lit("")))).alias("not_normal"))


def smallest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's name in the smallest document of an element, which the part's key chooses: how many there are of each element, what they show, and that they conform."""
    cases = [generate.hosted(e, REG) for e in REG.elements]
    chosen = F.get(F.array(*[F.lit(json.dumps(c)) for c in cases]), (F.col("p_partkey") % len(cases)).cast("int"))
    raw = F.replace(chosen, F.lit('"v": "x"'), F.concat(F.lit('"v": '), F.expr("substring(to_json(array(p_name)), 2, length(to_json(array(p_name))) - 2)")))
    held = kept(nodes.from_trees(spread(table(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").cast("string").alias("doc_id"), raw.alias("raw"))))
    state = validate.conforming(held.where("depth = 0"), validate.validate(held, REG))
    named = F.get(F.array(*[F.lit(e) for e in REG.elements]), (F.col("doc_id").cast("long") % len(cases)).cast("int"))
    shown = measures.units(held.where("t = 'text'")).groupBy("doc_id").agg(F.sum(F.length("unit")).alias("chars"), F.count("*").alias("texts"))
    return state.join(shown, "doc_id").groupBy(named.alias("t")).agg(F.count("*").alias("documents"), F.sum("errors").alias("errors"), F.sum(F.col("chars") / F.col("texts")).cast("long").alias("chars"))


def events_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.windowed(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))).select(F.unix_millis("start").alias("start_ms"), "event_type", "n")


def _merkle_sql(levels: int = 7) -> str:
    out = "WITH l0 AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, unhex(sha256(coalesce(text, ''))) AS h FROM conversations)"
    for k in range(levels):
        out += f", l{k + 1} AS (SELECT conv_id, i // 2 AS i, CASE WHEN count(*) = 1 THEN any_value(h) ELSE unhex(sha256(encode('merkle') || '\\x00'::BLOB || max(h) FILTER (i % 2 = 0) || max(h) FILTER (i % 2 = 1))) END AS h FROM l{k} GROUP BY conv_id, i // 2)"
    return out + f" SELECT conv_id, lower(hex(h)) AS root FROM l{levels}"


QUERIES = {
    f.__name__: f
    for f in (
        node_histogram, layer_counts, content_units, units_lost, block_counts, unused_elements, errors_by_rule, coverage_by_language, evidence_verdicts, envelope_by_language, fixed_points, not_carried, merkle_roots, turns_numbered,
        columns_in_order, top_event_types, decimal_scales, quantities, event_dates, entity_labels, provenance_pairs, safe_links, page_names, page_text, escaped_titles, query_links, form_documents, record_documents, degraded, negotiated, excerpt_proofs, not_normal, smallest_documents, events_by_hour,
    )
}
FLAGSHIP = "coverage_by_language"

KINDS = f"SELECT 'document' AS t, count(*) AS n FROM documents UNION ALL SELECT 'paragraph', count(*) FROM ({Q}) UNION ALL SELECT 'text', count(*) FROM ({Q})"
ORACLE = {
    "node_histogram": f"SELECT k.t, layer, cls, n FROM ({KINDS}) k JOIN {ELEMENTS} USING (t) WHERE n > 0",
    "layer_counts": f"SELECT layer, count(*) AS n FROM ({KINDS}) k JOIN {ELEMENTS} USING (t) WHERE n > 0 GROUP BY layer",
    "content_units": f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, count(*) AS units, CAST(sum(length(line)) AS BIGINT) AS chars FROM ({Q}) GROUP BY doc_id",
    "units_lost": f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, line AS unit, count(*) - 1 AS n FROM ({Q}) GROUP BY doc_id, line HAVING count(*) > 1",
    "block_counts": f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, count(*) AS blocks, 2 * count(*) AS last_pos FROM ({Q}) GROUP BY doc_id",
    "unused_elements": f"SELECT t FROM {ELEMENTS} WHERE t NOT IN (SELECT t FROM ({KINDS}) WHERE n > 0)",
    "errors_by_rule": f"SELECT rule, count(*) AS n FROM (SELECT 'R5' AS rule FROM documents WHERE source IS NOT NULL AND NOT regexp_full_match(source, '[a-zA-Z]{{2,8}}(-[a-zA-Z0-9]{{1,8}})*') UNION ALL SELECT 'R18' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({Q}))) GROUP BY rule",
    "coverage_by_language": f"SELECT coalesce(lang, 'en') AS lang, count(*) AS documents, count(*) FILTER (doc_id IN (SELECT doc_id FROM ({Q}))) AS covered, round(100 * count(*) FILTER (doc_id IN (SELECT doc_id FROM ({Q}))) / count(*), 1) AS percent FROM documents GROUP BY 1",
    "evidence_verdicts": f"WITH u AS (SELECT 'texts' AS genre, unnest(['document', 'paragraph', 'text']) AS t UNION SELECT 'records', unnest(['document', 'heading', 'provenance', 'section', 'term', 'definition', 'paragraph', 'text'])) SELECT t, layer, coalesce(g, 0) AS genres, CASE WHEN t IN ('payload', 'rendering') THEN 'PROVISIONAL' WHEN g >= 2 THEN 'CORPUS' WHEN g = 1 THEN 'ONE GENRE' WHEN t IN ('table', 'row') THEN 'FIXTURE' ELSE 'UNTESTED' END AS verdict FROM {ELEMENTS} LEFT JOIN (SELECT t, count(DISTINCT genre) AS g FROM u GROUP BY t) USING (t)",
    "envelope_by_language": f"""WITH l AS (SELECT doc_id, string_agg('{{"c":[{{"t":"text","v":' || CAST(to_json(line) AS VARCHAR) || '}}],"t":"paragraph"}}', ',' ORDER BY i) AS c, string_agg(line, chr(10) || chr(10) ORDER BY i) AS p FROM ({Q}) GROUP BY doc_id),
d AS (SELECT lang, '{{' || CASE WHEN c IS NULL THEN '"c":[],' ELSE '"c":[' || c || '],' END || '"id":"urn:corpus:' || doc_id || '","lang":"' || coalesce(lang, 'en') || '","t":"document","title":"Document ' || doc_id || '"}}' AS j, rtrim('Document ' || doc_id || chr(10) || repeat('=', length('Document ' || doc_id)) || coalesce(chr(10) || chr(10) || p, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS p FROM documents LEFT JOIN l USING (doc_id))
SELECT lang, count(*) AS documents, CAST(floor(sum(strlen(j)) / count(*)) AS BIGINT) AS mean_canonical, CAST(floor(sum(strlen(p)) / count(*)) AS BIGINT) AS mean_plain FROM d GROUP BY lang""",
    "not_carried": r"WITH k AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS s FROM documents) WHERE trim(s) <> ''), p AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS p FROM documents) SELECT k.doc_id - 1 AS doc_id, count(*) AS n FROM k LEFT JOIN p ON p.doc_id = k.doc_id - 1 WHERE (k.doc_id - 1, s) NOT IN (SELECT (doc_id, s) FROM k) AND NOT coalesce(contains(p, trim(regexp_replace(s, '\s+', ' ', 'g'))), false) GROUP BY 1",
    "merkle_roots": _merkle_sql(),
    "turns_numbered": "WITH t AS (SELECT conv_id, turn, role, row_number() OVER w AS number, lead(role) OVER w AS following, CASE WHEN role = 'user' AND coalesce(lag(role = 'user') OVER w, false) = false THEN 1 ELSE 0 END AS b FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, number, following, CASE WHEN role = 'user' THEN CAST(sum(b) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) END AS run FROM t",
    "columns_in_order": 'WITH k AS (SELECT event_type, event_id, unnest(json_keys(props)) AS name FROM events) SELECT event_type, name, row_number() OVER (PARTITION BY event_type ORDER BY min(event_id)) AS "column" FROM k GROUP BY event_type, name',
    "top_event_types": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, min(event_id) LIMIT 3",
    "decimal_scales": "SELECT CAST(2 AS BIGINT) AS scale, count(*) AS n, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS currencies FROM events",
    "quantities": "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(18, 2)) AS VARCHAR) || ' EUR' AS price FROM lineitem",
    "event_dates": "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS second, upper(left(event_type, 1)) || lower(substr(event_type, 2)) AS label FROM events",
    "entity_labels": "SELECT coalesce(n_name || ' (' || k || ')', CAST(k AS VARCHAR)) AS body, count(*) AS n FROM (SELECT c_nationkey + CASE WHEN c_custkey % 3 = 0 THEN 100 ELSE 0 END AS k FROM customer) LEFT JOIN nation ON k = n_nationkey GROUP BY 1",
    "provenance_pairs": "SELECT CAST(s_suppkey AS VARCHAR) AS doc_id, 'Name' AS label, s_name AS value FROM supplier UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'Nation', CAST(s_nationkey AS VARCHAR) FROM supplier UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'In credit', CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_acctbal >= 0",
    "safe_links": rf"SELECT NOT regexp_matches(href, '[\x00-\x1f\x7f]') AND (lower(regexp_extract(href, '^([a-zA-Z][a-zA-Z0-9+.\-]*):', 1)) IN ('', 'http', 'https', 'mailto', 'urn', 'tel', 'ftp', 'ftps')) AS safe, regexp_matches(href, '^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:|//|\\)') AS elsewhere, count(*) AS n FROM ({HREFS}) GROUP BY 1, 2",
    "page_names": r"SELECT page_id, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)', 1) AS host, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)', 1)), '[^a-z0-9]+', '-', 'g') AS slug, left(regexp_replace(url, '[^A-Za-z0-9]+', '_', 'g'), 80) AS cache_key, coalesce(nullif(regexp_replace(url, '[^A-Za-z0-9_.:-]', '-', 'g'), ''), 'x') AS anchor FROM pages",
    "page_text": rf"SELECT page_id, strlen(html) AS bytes, strlen({STRIPPED}) AS text_bytes, strlen({STRIPPED}) * 100 // greatest(strlen(html), 1) AS percent, len(regexp_extract_all(html, '(?i)<(?:img|script|iframe|source|video|audio|embed)\b[^>]*\bsrc\s*=|<link\b[^>]*\brel\s*=\s*\"?(?:stylesheet|preload|icon)', 0)) AS fetched FROM pages",
    "escaped_titles": "SELECT page_id, replace(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS title FROM pages",
    "query_links": "SELECT page_id, array_to_string(regexp_extract_all(html, 'href=\"[^\"]*\\?([a-zA-Z0-9_]+=[^\"&]{1,40})\"', 1)[1:5], '&') AS links FROM pages",
    "form_documents": "WITH l AS (SELECT least(5, len(regexp_extract_all(html, 'href=\"[^\"]*\\?([a-zA-Z0-9_]+=[^\"&]{1,40})\"', 1))) AS n FROM pages), c AS (SELECT count(*) AS p, CAST(sum(n) AS BIGINT) AS s, count(*) FILTER (n > 0) AS w FROM l) SELECT t, CAST(n AS BIGINT) AS n FROM (SELECT unnest(['document', 'heading', 'provenance', 'term', 'definition', 'link', 'paragraph', 'text', 'state-link']) AS t, unnest([p, p, p, p, p, p, p + w, 3 * p + s, s]) AS n FROM c) WHERE n > 0",
    "record_documents": "SELECT t, CAST(k * (SELECT count(*) FROM events) AS BIGINT) AS n FROM (VALUES ('document', 1), ('heading', 2), ('provenance', 1), ('section', 1), ('term', 1), ('definition', 1), ('paragraph', 2), ('text', 5), ('(errors)', 0)) v(t, k)",
    "degraded": "SELECT 'row' AS t, CAST(n_regionkey * 100 + n_nationkey + 1 AS BIGINT) AS pos, CAST(-1 AS BIGINT) AS parent_pos, CAST(1 AS BIGINT) AS depth, row_number() OVER (ORDER BY n_regionkey, n_nationkey) - 1 AS ord FROM nation",
    "negotiated": "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'text/html' WHEN 1 THEN 'text/plain' WHEN 2 THEN 'application/json' WHEN 4 THEN 'text/html' END AS media FROM pages",
    "excerpt_proofs": f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, count(l.doc_id_) AS blocks, count(l.doc_id_) > 0 AS holds, false AS forged_holds FROM documents LEFT JOIN (SELECT doc_id AS doc_id_ FROM ({Q})) l ON doc_id = doc_id_ GROUP BY doc_id",
    "not_normal": "SELECT lang, count(*) AS documents, count(*) FILTER (nfc_normalize(coalesce(text, '')) <> coalesce(text, '')) AS not_normal FROM documents GROUP BY lang",
    "smallest_documents": f"SELECT e.t, count(*) AS documents, CAST(0 AS BIGINT) AS errors, CAST(sum(length(p_name)) AS BIGINT) AS chars FROM part JOIN (SELECT t, row_number() OVER () - 1 AS i FROM {ELEMENTS}) e ON p_partkey % {len(REG.elements)} = e.i GROUP BY e.t",
    "events_by_hour": "SELECT epoch_ms(date_trunc('hour', ts)) AS start_ms, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "fixed_points": "SELECT count(*) AS documents, count(*) AS by_cbor, count(*) AS surface_again, count(*) AS nothing_lost FROM documents",
}
QUERIES |= made.QUERIES | whole.QUERIES
ORACLE |= made.ORACLE | whole.ORACLE
