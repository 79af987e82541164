"""Operators on the node table, and the registered queries against their SQL."""

from __future__ import annotations

import json
import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from quillgrove.functions import columns as C
from quillgrove.functions import trees
from quillgrove.operators import degrade, generate, measures, nodes, ordered, reports, validate
from quillgrove import made
from quillgrove.plans.register import ELEMENTS, built_in, register_digest
from quillgrove.queries import ORACLE, QUERIES
from quillgrove.sources import readers, writers
from quillgrove.streaming import ingest

from test_trees import DOC, p, t

REG = built_in()
DATA = "/root/testdata/sf0.001"


def node_table(spark, *docs):
    return nodes.from_trees(spark.createDataFrame([(str(i), d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)], "doc_id string, raw string"))


def doc(*kids, **more):
    return {"t": "document", "id": "urn:a:b", "lang": "en", "title": "x", **more, "c": list(kids)}


BROKEN = {
    "R1": doc({"t": "odd"}), "R2": p(t("x")), "R3": doc({"t": "heading", "c": [t("x")]}), "R4": doc({**p(t("x")), "align": "left"}), "R5": doc(p({"t": "date", "value": "soon", "precision": "day"})),
    "R6": doc({"t": "media", "src": "a", "alt": "a", "kind": "smell"}), "R7": doc({"t": "heading", "level": 9, "c": [t("x")]}), "R8": doc({"t": "media", "src": "a", "alt": " ", "kind": "image"}), "R9": doc(p(p(t("x")))),
    "R10": doc({"t": "media", "src": "//a/b", "alt": "a", "kind": "image"}), "R11": doc(p({"t": "note-ref", "target": "no"})), "R12": doc({"t": "section", "id": "a", "c": [p(t("x"))]}, {"t": "section", "id": "a", "c": [p(t("x"))]}),
    "R14": doc({"t": "payload", "id": "i", "type": "t", "data": "1.5"}), "R15": doc(p(t("é"))), "R16": doc({"t": "term-list", "c": [{"t": "term", "c": [t("a")]}, {"t": "term", "c": [t("b")]}]}),
    "R17": doc(p({"t": "link", "href": "a\u0001", "c": [t("x")]})), "R18": {k: v for k, v in doc().items() if k != "c"}, "R19": doc(p({"t": "link", "href": "javascript:x", "c": [t("x")]})), "R20": {**doc(p(t("x"))), "c": [p(t("x")), 5]},
}


def test_each_rule_is_reported_once(spark):
    deep = p(t("x"))
    for _ in range(102):
        deep = {"t": "section", "c": [deep]}
    cases = {**{k: json.dumps(v) for k, v in BROKEN.items()}, "R13": '{"t":"document","id":"urn:a:b","lang":"en","title":"x","c":[{"t":"paragraph","c":[{"t":"quantity","significand":1.5,"scale":0,"unit":"m"}]}]}', "R21": json.dumps(doc(deep)), "none": json.dumps(DOC)}
    table = nodes.from_trees(spark.createDataFrame(list(cases.items()), "doc_id string, raw string")).persist()
    found: dict[str, list] = {}
    for r in validate.validate(table, REG).collect():
        found.setdefault(r["doc_id"], []).append(r["rule"])
    assert found.pop("R18") == ["R18"]
    assert found == {k: [k] for k in cases if k not in ("none", "R18")}
    state = {r["doc_id"]: r["conforms"] for r in validate.conforming(table.where("depth = 0"), validate.validate(table, REG)).collect()}
    assert state["none"] and not any(v for k, v in state.items() if k != "none")


def test_pins(spark):
    old = built_in()
    table = node_table(spark, doc(p(t("x"))), doc(p(t("x")), register="a" * 64), doc(p(t("x")), register="b" * 64), doc(p(t("x")), register=REG.digest))
    found = {r["doc_id"]: r["outcome"] for r in validate.pinned(table, REG, {"a" * 64: old}).collect()}
    assert found == {"0": "none", "1": "archived", "2": "unresolvable", "3": "current"}
    assert REG.digest == register_digest(ELEMENTS.read_bytes()) and len(REG.digest) == 64


def test_archived_pins_are_read_twice(spark):
    later = made.later_register()
    motto = {"t": "motto", "c": [t("x")]}
    table = node_table(spark, doc(motto, register=later.digest), doc(motto), doc({"t": "odd"}, register=later.digest))
    found = Counter((r["doc_id"], r["register"] == REG.digest, r["rule"]) for r in validate.validate_pinned(table, REG, {later.digest: later}).collect())
    assert found == Counter([("0", True, "R1"), ("1", True, "R1"), ("2", True, "R1"), ("2", False, "R1")])


def test_spliced_children_are_numbered_anew(spark):
    section = lambda kind, *names: {"t": "table-section", "kind": kind, "c": [{"t": "row", "c": [{"t": "cell", "c": [p(t(x))]}]} for x in names]}
    table = node_table(spark, doc({"t": "table", "c": [section("head", "a"), section("body", "b", "c"), {"t": "caption", "c": [t("d")]}]}))
    low = degrade.spliced(table)
    found = sorted((r["ord"], r["t"], r["depth"]) for r in low.where("depth = 2").collect())
    assert found == [(0, "row", 2), (1, "row", 2), (2, "row", 2), (3, "caption", 2)]
    assert low.where("t = 'table'").first()["n_children"] == 4 and "place" not in low.columns


def test_unreadable_documents_are_rows(spark):
    table = node_table(spark, "{", "[1]", DOC)
    assert [r["malformed"] for r in table.where("doc_id = '0'").collect()] == [["unreadable: JSONDecodeError"]]
    assert nodes.rebuilt(table.where("doc_id = '2'")).first()["raw"] and trees.load_json(nodes.rebuilt(table.where("doc_id = '2'")).first()["raw"]) == DOC


def test_units_and_views_agree_with_the_tree(spark):
    table = node_table(spark, DOC)
    assert sorted(r["unit"] for r in measures.units(table).collect()) == sorted(trees.content_units(DOC))
    view = nodes.views(spark.createDataFrame([("a", json.dumps(DOC)), ("b", "{")], "doc_id string, raw string"), REG).orderBy("doc_id").collect()
    assert view[0]["digest"] == trees.structural_hash(DOC).hex() and view[1]["digest"] is None
    assert measures.lost(measures.units(table), measures.units(table)).count() == 0
    blocks = {r["pos"] for r in measures.blocks(table, REG).collect()}
    assert len(blocks) == view[0]["blocks"]


def test_merkle_levels_in_spark(spark):
    for n in (1, 2, 5, 13, 4097):
        leaves = [trees.structural_hash(t(str(i))) for i in range(n)]
        d = spark.createDataFrame([("d", i, bytearray(h)) for i, h in enumerate(leaves)], "d string, i int, h binary")
        assert ordered.merkle(d, "d", "i", "h").first()["root"] == trees.merkle_root(leaves).hex()


def test_ordered_operators(spark):
    table = node_table(spark, BROKEN["R12"])
    assert ordered.repeated_ids(table).count() == 1
    assert ordered.repeated_ids(ordered.without_repeated_ids(table)).count() == 0
    ups = table.where("t = 'section'")
    assert {r["t"] for r in ordered.inside(table, ups).collect()} == {"paragraph", "text"}
    assert ordered.clamped_depth(table).agg(F.min("level"), F.max("level")).first()[:] == (1, 3)


def test_degradation_on_the_table(spark):
    table = node_table(spark, doc({"t": "article", "c": [p({"t": "state-link", "key": "a", "value": "b", "c": [t("x")]})]}, {"t": "contents", "c": [{"t": "item", "c": [p(t("y"))]}]}, BROKEN["R14"]["c"][0]))
    low = degrade.spliced(degrade.renamed(table))
    assert Counter(r["t"] for r in low.collect()) == Counter(["document", "section", "paragraph", "link", "text", "list", "item", "paragraph", "text"])


def test_column_functions(spark):
    d = spark.createDataFrame([("-5", 2, "EUR"), ("12345", 2, "EUR"), ("7", 0, "m"), ("0", 3, "x")], "n string, s int, u string")
    want = [trees.quantity_text({"significand": int(n), "scale": s, "unit": u}) for n, s, u in [tuple(r) for r in d.collect()]]
    assert [r[0] for r in d.select(C.quantity_text(F.col("n").cast("decimal(38,0)"), F.col("s"), F.col("u"))).collect()] == want
    h = spark.createDataFrame([("text/html;q=0.1, text/plain",), ("image/*",), ("",), (None,), ("*/*;q=0.5, application/json;q=x",), ("text/*",)], "h string")
    assert [r[0] for r in h.select(C.negotiated(F.col("h"), list(writers.FORMS))).collect()] == ["text/plain", None, "text/html", "text/html", "text/html", "text/html"]
    u = spark.createDataFrame([("https://a/",), ("javascript:x",), ("a/b",), ("a\x01",), (None,)], "u string")
    assert [r[0] for r in u.select(C.safe_iri(F.col("u"))).collect()] == [True, False, True, False, False]
    k = spark.createDataFrame([("camelCaseKey",), ("x",)], "k string")
    assert [r[0] for r in k.select(C.label_for(F.col("k"))).collect()] == ["Camel case key", "X"]


def test_label_sources(spark):
    controls = spark.createDataFrame([(1, "a", None, None, "p"), (1, "b", " w ", "x", None), (1, "c", "", None, None)], "page_id int, control_id string, wrapped string, aria string, placeholder string")
    labels = spark.createDataFrame([(1, "a", "named")], "page_id int, for_id string, label string")
    assert {r["control_id"]: (r["label"], r["way"]) for r in measures.label_sources(controls, labels).collect()} == {"a": ("named", "for"), "b": ("w", "wrapping"), "c": ("", "none")}


def test_served(spark):
    views = nodes.views(spark.createDataFrame([("a", json.dumps(DOC))], "doc_id string, raw string"), REG, columns=("html", "plain", "canonical", "cbor", "markdown", "root"))
    asked = spark.createDataFrame([("a", "text/plain"), ("a", "image/png"), ("b", "*/*")], "doc_id string, accept string")
    assert {(r["doc_id"], r["accept"]): r["status"] for r in writers.served(asked, views).collect()} == {("a", "text/plain"): 200, ("a", "image/png"): 406, ("b", "*/*"): 404}
    assert writers.index(views).count() == 1


def test_hostile_documents_never_crash(spark):
    made = generate.hostile_documents(spark, 300, seed=1)
    assert sorted(r["raw"] for r in made.collect()) == sorted(r["raw"] for r in generate.hostile_documents(spark, 300, seed=1, partitions=3).collect())
    table = nodes.from_trees(made).persist()
    assert table.select("doc_id").distinct().count() == 300
    assert validate.validate(table, REG).count() > 300 and nodes.views(made, REG).count() == 300


def test_reports(spark):
    table = node_table(spark, DOC)
    text = reports.markdown(validate.by_rule(validate.validate(node_table(spark, BROKEN["R1"]), REG)), "Rules")
    assert text == "# Rules\n\n| rule | n |\n|-|-|\n| R1 | 1 |\n"
    assert measures.unused(table, REG).count() < 50
    pages = spark.createDataFrame([(1, "https://a/", "<form action='/s'><input aria-label='q' name='q'></form>")], "page_id long, url string, html string")
    totals = {(r["genre"], r["key"]): r["n"] for r in reports.finding_totals(readers.findings(readers.forms_of(pages), "forms")).collect()}
    assert totals["forms", "label_aria"] == 1
    ways = spark.createDataFrame([("for",), ("aria",), ("none",)], "way string")
    assert reports.control_statistics(ways).first()[:5] == (3, 2, 1, 0, 1)


def test_files_and_streams(spark, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "one.json").write_bytes(trees.canonical_json(DOC))
    (folder / "two.cbor").write_bytes(trees.cbor(DOC))
    for kind in ("json", "cbor"):
        read = readers.files(spark, str(folder), f"*.{kind}")
        assert nodes.from_trees(read, readers.reader(kind)).count() == len(trees.flattened(DOC))
    stream = tmp_path / "stream"
    spark.createDataFrame([("a", json.dumps(BROKEN["R1"])), ("b", json.dumps(DOC))], "doc_id string, raw string").write.parquet(str(stream))
    seen = []
    ingest.validated(ingest.documents(spark, str(stream)), REG, lambda d, n: seen.extend(r["rule"] for r in d.collect()), str(tmp_path / "cp")).awaitTermination()
    assert seen == ["R1"]


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.split('.')[0]} as from '{DATA}/{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_match_their_sql(spark, oracle, name):
    got = QUERIES[name](spark, DATA)
    cols = sorted(got.columns)
    want = oracle.sql(ORACLE[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert Counter(tuple(r[c] for c in cols) for r in got.collect()) == Counter(tuple(r[i] for i in at) for r in want.fetchall())
