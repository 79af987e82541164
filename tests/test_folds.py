"""Folds over the node table against the functions on one tree."""

from __future__ import annotations

import json
import random

import pytest

from quillgrove import made
from quillgrove.functions import trees
from quillgrove.operators import fold, nodes
from quillgrove.plans.register import built_in

REG = built_in()
DECOMPOSED = "é"


def node_table(spark, docs):
    return nodes.from_trees(spark.createDataFrame([(k, json.dumps(d, ensure_ascii=False)) for k, d in docs.items()], "doc_id string, raw string"))


def shapes():
    return {str(i): made.doc(*s[0]) for i, s in enumerate(made.SHAPES)}


def random_tree(rnd, depth=0):
    """Any shape: unknown elements, empty containers, values of each kind, texts that aren't in NFC."""
    kind = rnd.choice(["text", "section", "paragraph", "list", "item", "odd", "emphasis"])
    node = {"t": kind, **{rnd.choice(["v", "b", "lang", DECOMPOSED]): rnd.choice(["x", DECOMPOSED, "", -3, True, "Ω"]) for _ in range(rnd.randrange(3))}}
    if kind != "text" and depth < 7 and rnd.random() < 0.8:
        node["c"] = [random_tree(rnd, depth + 1) for _ in range(rnd.randrange(4))]
    return node


def test_digests_are_those_of_one_tree(spark):
    rnd = random.Random(8)
    docs = shapes() | {f"r{i}": {"t": "document", "id": "a", "c": [random_tree(rnd), random_tree(rnd)]} for i in range(40)} | {"lone": {"t": "document"}, "wide": {"t": "document", "c": [{"t": "text", "v": DECOMPOSED}]}}
    table = node_table(spark, docs).persist()
    found = {(r["doc_id"], r["pos"]): r["digest"] for r in fold.digests(table).collect()}
    for key, d in docs.items():
        for pos, (n, _) in enumerate(trees.walk(d)):
            assert found.pop((key, pos)) == trees.structural_hash(n).hex(), (key, pos)
    assert not found
    other = {(r["doc_id"], r["pos"]): r["digest"] for r in fold.digests(table, domain="own").where("pos = 0").collect()}
    assert other["lone", 0] == trees.structural_hash(docs["lone"], b"own").hex()


def test_a_value_without_canonical_form_leaves_what_is_above_without_digest(spark):
    raw = '{"t":"document","c":[{"t":"paragraph","c":[{"t":"quantity","significand":2.5}]},{"t":"paragraph","c":[{"t":"text","v":"x"}]}]}'
    table = nodes.from_trees(spark.createDataFrame([("a", raw)], "doc_id string, raw string"))
    found = {r["pos"]: r["digest"] for r in fold.digests(table).collect()}
    assert [found[k] is None for k in range(5)] == [True, True, True, False, False]


def test_a_deep_chain_and_a_wide_document(spark):
    chain = {"t": "paragraph", "c": [{"t": "text", "v": "end"}]}
    for _ in range(40):
        chain = {"t": "section", "c": [chain]}
    wide = made.doc(*[made.par(made.text(str(i))) for i in range(30_000)])
    table = node_table(spark, {"chain": made.doc(chain), "wide": wide})
    found = {r["doc_id"]: r["digest"] for r in fold.digests(table).where("pos = 0").collect()}
    assert found == {"chain": trees.structural_hash(made.doc(chain)).hex(), "wide": trees.structural_hash(wide).hex()}


def test_rows_that_are_missing_are_reported_and_empty_tables_are_empty(spark):
    table = node_table(spark, {"a": made.doc(made.par(made.text("x")))})
    with pytest.raises(ValueError, match="fewer rows"):
        fold.digests(table.where("t <> 'text'"))
    assert fold.digests(table.limit(0)).count() == 0 and fold.plain_text(table.limit(0)).count() == 0


def test_plain_text_is_that_of_one_tree(spark):
    odd = {
        "blank": made.doc(made.par(made.text("   ")), {"t": "list", "ordered": True, "c": [{"t": "item"}, {"t": "item", "c": [made.par(made.text("a\n\n b"))]}]}),
        "wide": made.doc({"t": "quote", "c": [made.par(made.text(DECOMPOSED + "\n 　"))]}, {"t": "code-block", "c": [made.text("a\n"), made.text("b")]}),
        "cells": made.doc({"t": "table", "c": [{"t": "row", "c": [{"t": "cell"}, {"t": "cell", "c": [made.par(made.text("p")), made.par(made.text("q"))]}]}]}),
        "nested": made.doc({"t": "list", "ordered": False, "c": [{"t": "item", "c": [made.par(made.text("o")), {"t": "list", "ordered": True, "start": 0, "c": [{"t": "item", "c": [made.par(made.text("i"))]}]}]}]}),
        "pairs": made.doc({"t": "term-list", "c": [{"t": "definition", "c": [{"t": "note", "id": "n", "c": [made.par(made.text("x"))]}]}, {"t": "term", "c": [{"t": "emphasis", "c": [made.text("e")]}]}]}),
        "none": {"t": "document", "title": "only"},
        "unknown": made.doc({"t": "odd", "c": [made.par(made.text("x"))]}, {"t": "heading", "c": [made.text("h")]}),
    }
    low = {k: trees.lowered(d, REG) for k, d in (shapes() | odd).items()}
    table = node_table(spark, low)
    found = {r["doc_id"]: r["plain"] for r in fold.plain_text(table).collect()}
    assert found == {k: trees.plain_text(d) for k, d in low.items()}


def test_narrow_documents_meet_no_python(spark):
    table = nodes.from_lines(spark.createDataFrame([(1, "café\n\nb", "fr"), (2, None, None)], "doc_id long, text string, lang string"))
    same = fold.normal(table)
    plan = same._jdf.queryExecution().executedPlan().toString() + fold.plain_text(table)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
