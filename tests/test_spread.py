"""Work that is dealt over tasks, and tables that are filled and read a column at a time."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quillgrove import made
from quillgrove.functions import trees
from quillgrove.operators import kept, nodes, validate
from quillgrove.plans.register import built_in

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("table", "key"), [("part", "p_partkey"), ("customer", "c_custkey"), ("orders", "o_orderkey")])
def test_keys_of_one_file_are_dealt_over_tasks(spark, table, key):
    """F1-F4: one file of keys was one task, whatever documents were made of them."""
    rows = made.rows_of(spark, DATA, table, key)
    held = rows.groupBy(F.spark_partition_id().alias("p")).count().collect()
    total = spark.read.parquet(f"{DATA}/{table}.parquet").count()
    assert sum(r["count"] for r in held) == total and len(held) > spark.sparkContext.defaultParallelism and max(r["count"] for r in held) < total / 4


def test_nodes_by_column_are_those_of_flattened():
    cases = [*made.FAULTS, *(json.dumps(made.doc(*s[0])) for s in made.SHAPES), "[1]", '"x"', '{"t":3,"c":4}', '{"t":"a","c":[1,{"t":null},{"x":{"y":1.5}}],"z":null}']
    flat = nodes.Flat()
    for i, c in enumerate(cases):
        flat.add(str(i), trees.load_json(c))
    want = [{"doc_id": str(i), **r} for i, c in enumerate(cases) for r in trees.flattened(trees.load_json(c))]
    assert flat.batch().to_pylist() == want


def test_a_document_without_rows_leaves_none_behind():
    flat = nodes.Flat()
    with pytest.raises(TypeError):
        flat.add("1", {"t": "document", "c": [{"t": "text", "v": {(1, 2): 3}}]})
    assert len(flat) == 0 and flat.batch().num_rows == 0


def test_a_validated_table_is_not_joined_with_itself(spark):
    n = kept.kept(nodes.from_trees(spark.createDataFrame([(str(i), c) for i, c in enumerate(made.FAULTS)], "doc_id string, raw string")))
    found = validate.validate(n, built_in())
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and plan.count("Relation [doc_id") <= 4
    assert {(r["doc_id"], r["rule"]) for r in found.collect()} == {(str(i), f"R{i}") for i in range(1, 22)}


@pytest.mark.parametrize("query", ["fixed_points", "conversation_surfaces"])
def test_documents_are_read_back_one_at_a_time(spark, query):
    """F8, F20: whole Arrow batches of documents were read back and held as trees in Python."""
    from quillgrove.queries import QUERIES

    plan = QUERIES[query](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "MapInArrow" in plan


def test_columns_made_from_others(spark):
    docs = spark.createDataFrame([("1", json.dumps(made.doc(made.par(made.text("x"))))), ("2", "{")], "doc_id string, raw string")
    held = nodes.views(docs, built_in(), columns=("plain", "long"), more=(("plain", "digest"), lambda d: {"long": len(d["digest"]) > len(d["plain"])}, {"long": "boolean"}))
    assert sorted(map(tuple, held.collect())) == [("1", "T\n=\n\nx", True), ("2", None, None)]


def test_nodes_that_set_no_mark_are_left_out_before_their_fields_are_gone_through(spark):
    """F16: the arrays of all nodes were gone through, field by field."""
    n = kept.kept(nodes.from_trees(spark.createDataFrame([(str(i), c) for i, c in enumerate(made.FAULTS)], "doc_id string, raw string")))
    found = validate.validate(n, built_in())
    assert "sole_type" in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["doc_id"], r["rule"]) for r in found.collect()} == {(str(i), f"R{i}") for i in range(1, 22)}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_findings_are_mapped_once_and_behind_the_shuffle(spark):
    """what was found was asked for before the shuffle too, in the one task that reads the keys."""
    from quillgrove.operators.kept import spread
    from quillgrove.sources import readers

    pages = spark.createDataFrame([(i, "https://a.example/", '<form action="x"><input aria-label="a"></form>') for i in range(20)] + [(20, None, None)], "page_id long, url string, html string")
    xml = spark.createDataFrame([(1, "<rfc><middle><t>x</t></middle></rfc>"), (2, "<broken")], "k long, x string")
    for held, want in ((readers.forms_of(spread(pages, "page_id")), {"forms": 20, "actions": 20}), (readers.xml_of(spread(xml, "k"), "x", "standards", id_col="k"), {"unreadable": 1})):
        found = readers.findings(held, "g")
        assert _plan(found).count("ArrowEvalPython") + _plan(found).count("MapInArrow") == 1
        got = {r["key"]: r["n"] for r in found.groupBy("key").agg(F.sum("n").alias("n")).collect()}
        assert {k: got[k] for k in want} == want


def test_nodes_of_records_are_made_in_one_worker(spark):
    """two Python workers a task held whole Arrow batches of records, their JSON and all columns of their nodes."""
    from quillgrove.queries import QUERIES
    from quillgrove.sources import readers

    plan = _plan(QUERIES["evidence_verdicts"](spark, DATA))
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan
    rows = spark.createDataFrame([("a", '{"x": 1.50, "y": [{"z": true}]}'), ("b", None), ("c", "[1]")], "k string, raw string")
    read = readers.record()
    got = nodes.from_trees(rows, lambda k, r: read(k, r)[0], id_col="k", raw_col=("k", "raw"), columns=("doc_id", "pos", "t")).collect()
    assert sorted(got) == sorted(nodes.from_trees(readers.records_of(rows, "raw", id_col="k")).select("doc_id", "pos", "t").collect()) and len(got) > 20
    bad = nodes.from_trees(spark.createDataFrame([("d", "{")], "k string, raw string"), lambda k, r: read(k, r)[0], id_col="k", raw_col=("k", "raw")).collect()
    assert [r["malformed"] for r in bad] == [["unreadable: JSONDecodeError"]]


def test_a_task_hands_on_a_few_converted_documents(spark, monkeypatch):
    from quillgrove.sources import readers

    monkeypatch.setattr(readers, "DOCS_AT_ONCE", 7)
    rows = spark.range(50).selectExpr("string(id) as k", "concat('{\"a\": ', id, '}') as raw")
    assert [r["doc_id"] for r in readers.records_of(rows, "raw", id_col="k").orderBy(F.col("doc_id").cast("int")).collect()] == [str(i) for i in range(50)]


def test_documents_are_lowered_once(spark):
    """the views were made twice, for their nodes and for their units, and joined."""
    plan = _plan(made.lowered_nodes(spark, DATA))
    assert plan.count("MapInArrow") == 1 and "Join" not in plan


CROSSED = [
    '{"t":"document","id":"urn:a:b","lang":"en","title":"T","c":[%s]}' % c
    for c in (
        '{"t":"term-list","c":[{"t":"definition"},{"t":"term"},{"t":"term"},{"t":"odd\\nterm"},{"t":"term"}]}', '{"t":"provenance","c":[{"t":"term"},{"t":"definition"},{"t":"term"},{"t":"definition"},{"t":"definition"}]}', '{"t":"signature-block","c":[{"t":"term"}]}',
        '{"t":"odd","c":[{"t":"text","v":"x"}]},{"t":"text","v":"y"}', '{"t":"line-break","c":[{"t":"text","v":"x"},{"t":4}]}', '{"t":"list","ordered":true,"c":[{"t":null},{"t":"item","c":[{"t":"strong"}]}]}', '{"t":"code-block","c":[{"t":"strong"},{"t":"text","v":"\u0391\u0301"}]}',
        '{"t":"table","c":[{"t":"row","c":[{"t":"header-cell","scope":"corner"},{"t":"header-cell","scope":""},{"t":"header-cell","scope":"row"},{"t":"cell","colspan":"2"},{"t":"header-cell","colspan":2}]},{"t":"table-section","kind":"legs"}]}',
        '{"t":"paragraph","c":[{"t":"paragraph"},{"t":"payload","id":"p","type":"t","data":"1"},{"t":"reference","target":"p"},{"t":"reference","target":"q"}]}', '{"t":"note","id":"n"},{"t":"note","id":"n"},{"t":"odd","c":[{"t":"note","id":"n"}]}',
    )
]


def test_children_meet_their_parents_without_a_shuffle(spark):
    """all nodes of mapped records were shuffled and sorted, so that children met their parents."""
    docs = spark.createDataFrame([(str(i), c) for i, c in enumerate([*made.FAULTS, *CROSSED, *(json.dumps(made.doc(*s[0])) for s in made.SHAPES), "[1]"])], "doc_id string, raw string")
    want = validate.validate(nodes.from_trees(docs), built_in())
    got = validate.validate(nodes.from_trees(docs, columns=nodes.CHECKED), built_in())
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str) and want.where("rule = 'R16'").count() > 3
    assert "MapInArrow" in _plan(validate.marked(nodes.from_trees(docs, columns=nodes.CHECKED), built_in())) and "Exchange hash" not in _plan(validate.marked(nodes.from_trees(docs, columns=nodes.CHECKED), built_in())).split("MapInArrow")[0].split("BroadcastExchange")[0]


def test_records_are_trees_once(spark, monkeypatch):
    """records were written as JSON, which was read again for their nodes, and again for what was found."""
    from quillgrove.sources import readers

    keeps = []
    monkeypatch.setattr(made, "kept", lambda df: keeps.append(df) or kept.kept(df))
    monkeypatch.setattr(made.validate, "_met", lambda *_: pytest.fail("children meet their parents in a window"))
    got = {r["t"]: r["n"] for r in made.records_mapped(spark, DATA).collect()}
    n = spark.read.parquet(f"{DATA}/orders.parquet").count()
    assert got["document"] == n and got["errors"] == 0 and len(keeps) == 1 and _plan(keeps[0]).count("MapInArrow") == 1
    rows = spark.createDataFrame([("a", '{"x": {"amount": 1.50, "currency": "EUR"}, "y": [{"z": true}]}'), ("b", None)], "k string, raw string")
    one = nodes.from_trees(rows, readers.record(), id_col="k", raw_col=("k", "raw"), columns=("doc_id", "pos", "found", "kids")).collect()
    assert [(r["doc_id"], r["found"]) for r in one if r["found"]] == [("a", {"scale 2": 1})]
    assert {(r["doc_id"], k["pos"]) for r in one for k in r["kids"]} == {(r["doc_id"], r["pos"]) for r in one if r["pos"]}
