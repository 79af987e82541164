"""Rewrites of the node table against rewriting one tree and flattening it."""

from __future__ import annotations

import json
import random
from dataclasses import replace

from quillgrove import made
from quillgrove.functions import trees
from quillgrove.operators import fold, nodes, rewrite
from quillgrove.plans.register import Element, Register, built_in
from quillgrove.made import doc, par, text

REG = built_in()
COLUMNS = ("pos", "path", "depth", "parent_pos", "ord", "t", "fields", "n_children", "malformed", "last_pos", "place")


def node_table(spark, docs):
    return nodes.from_trees(spark.createDataFrame([(k, json.dumps(d, ensure_ascii=False)) for k, d in docs.items()], "doc_id string, raw string"))


def as_rows(table):
    """doc_id to rows, each as comparable values."""
    out: dict[str, list] = {}
    for r in table.orderBy("doc_id", "pos").collect():
        row = {c: r[c] for c in COLUMNS} | {"fields": sorted((f["name"], f["kind"], f["value"]) for f in r["fields"]), "path": list(r["path"])}
        out.setdefault(r["doc_id"], []).append(row)
    return out


def flat(tree):
    return [{c: r[c] for c in COLUMNS} | {"fields": sorted((f["name"], f["kind"], f["value"]) for f in r["fields"])} for r in trees.flattened(tree)]


field = lambda name, *kids, **more: {"t": "field", "name": name, "label": name.upper(), "c": list(kids), **more}
MORE = {
    "runs": doc({"t": "form", "action": "a", "method": "get", "c": [field("a", {"t": "field-text"}), {"t": "heading", "level": 2, "c": [text("h")]}, field("b"), {"t": "term", "c": [text("t")]}, field("c", {"t": "field-choice", "c": [{"t": "field-option", "value": "v"}]}), {"t": "submit", "label": " "}, {"t": "submit", "label": "go"}, field("d", {"t": "field-text", "value": "x", "c": [text("unseen")]})]}, par(text("after"))),
    "payloads": doc({"t": "payload", "id": "p", "type": "n", "data": "1", "c": [par(text("gone"))]}, {"t": "sidebar", "c": [{"t": "payload", "id": "q", "type": "n", "data": "1"}]}, {"t": "rendering", "renderer": "0", "payload": "p", "fallback": "f", "c": [{"t": "caption", "c": [text("own")]}]}, {"t": "payload", "id": "r", "type": "n", "data": "1"}),
    "nested": doc({"t": "disclosure", "summary": "s", "open": False, "c": [{"t": "admonition", "kind": "note", "c": [{"t": "rendering", "renderer": "0", "payload": "p", "fallback": "f"}]}]}, {"t": "table", "c": [{"t": "caption", "c": [text("c")]}, {"t": "table-section", "kind": "head", "c": [{"t": "row", "c": [{"t": "cell", "c": [par(text("1"))]}]}]}, {"t": "table-section", "kind": "body"}, {"t": "row"}]}),
    "unknown": doc({"t": "odd", "c": [{"t": "tab", "label": "x", "c": [par(text("y"))]}]}),
    "empty": {"t": "document"},
}


def grown(rnd, depth=0):
    """A tree of elements from all layers, each with the fields that it needs."""
    e = rnd.choice([x for x in REG.elements.values() if x.name not in ("document", "table-section")])
    node = {"t": e.name, **{f.name: {"int": 1, "bool": True}.get(f.type, rnd.choice(["v", " ", "w"])) for f in e.fields if f.required or rnd.random() < 0.3}}
    if e.name in ("field-text", "submit") or e.model != "none":
        node["c"] = [grown(rnd, depth + 1) for _ in range(rnd.randrange(4))] if depth < 5 else []
    return node


def test_lowering_on_rows_is_lowering_one_tree(spark):
    rnd = random.Random(11)
    docs = {f"s{i}": doc(*s[0]) for i, s in enumerate(made.SHAPES)} | MORE | {f"g{i}": doc(*[grown(rnd) for _ in range(3)]) for i in range(60)}
    table = node_table(spark, docs)
    found = as_rows(rewrite.located(rewrite.lowered(table, REG)))
    for k, d in docs.items():
        assert found[k] == flat(trees.lowered(d, REG)), k
    plain = {r["doc_id"]: r["plain"] for r in fold.plain_text(rewrite.lowered(table.where("doc_id like 's%'"), REG)).collect()}
    assert plain == {k: trees.plain_text(trees.lowered(d, REG)) for k, d in docs.items() if k[0] == "s"}


def test_documents_without_base_form_are_left_out(spark):
    elements = {**REG.elements, "motto": replace(REG.elements["sidebar"], name="motto"), "tab": Element("tab", 2, "block", "flow")}
    table = node_table(spark, {"a": doc({"t": "motto", "c": [par(text("x"))]}), "b": doc({"t": "tab", "label": "L", "c": [par(text("x"))]})})
    assert [tuple(r) for r in rewrite.without_form(table, Register(elements)).collect()] == [("a", "motto", 1)]
    found = as_rows(rewrite.located(rewrite.lowered(table, Register(elements))))
    assert found == {"b": flat(trees.lowered(doc({"t": "tab", "label": "L", "c": [par(text("x"))]}), Register(elements)))}


def test_pruning_on_rows_is_pruning_one_tree(spark):
    rnd = random.Random(12)
    blanks = lambda: text(rnd.choice(["", " ", "\n　", "x"]))

    def tree(depth=0):
        kind = rnd.choice(["section", "paragraph", "odd", "media", "line-break", "text", "text"])
        if kind == "text":
            return blanks()
        if kind in ("media", "line-break"):
            return {"t": kind} | ({"c": [blanks()]} if rnd.random() < 0.3 else {})
        return {"t": kind, "c": [tree(depth + 1) for _ in range(rnd.randrange(4) if kind != "odd" else rnd.randrange(1, 4))] if depth < 6 else [blanks()]}

    docs = {f"r{i}": doc(*[tree() for _ in range(rnd.randrange(1, 4))]) for i in range(150)} | {"full": doc(par(text("x")), {"t": "section", "c": [par(text(" ")), par(text("y"))]}), "one": {"t": "document", "id": "a", "c": [text("x")]}}
    found = as_rows(rewrite.located(rewrite.pruned(node_table(spark, docs), REG)))
    for k, d in docs.items():
        left = trees.pruned([d], REG)
        want = flat(left[0]) if left else flat({f: v for f, v in d.items() if f != "c"})  # the root stays
        assert found[k] == want, k


def test_rewrites_shuffle_once_and_stay_in_the_jvm(spark):
    table = nodes.from_lines(spark.createDataFrame([(1, "a\nb", "en"), (2, None, "de")], "doc_id long, text string, lang string"))
    for made_by in (rewrite.lowered(table, REG), rewrite.pruned(table, REG)):
        made_by.collect()
        plan = made_by._jdf.queryExecution().executedPlan().toString()
        final = plan.split("== Initial Plan ==")[0]
        assert final.count("Exchange hashpartitioning") == 1 and "Python" not in plan and "Arrow" not in plan
    assert rewrite.lowered(table.limit(0), REG).count() == 0 == rewrite.pruned(table.limit(0), REG).count() == rewrite.located(table.limit(0)).count()


def test_pruning_sorts_a_few_times_and_deep_trees_give_the_same(spark, monkeypatch):
    rnd = random.Random(4)

    def tree(depth=0):
        if depth == 5 or rnd.random() < 0.2:
            return {"t": "text", "v": rnd.choice(["x", " ", ""])}
        return {"t": rnd.choice(["section", "line-break", "strange"]), "c": [tree(depth + 1) for _ in range(rnd.randrange(1, 4))]}

    raw = [(f"d{i}", json.dumps({"t": "document", "c": [tree() for _ in range(3)]})) for i in range(30)]
    n = nodes.from_trees(spark.createDataFrame(raw, "doc_id string, raw string"))
    key = lambda r: (r["doc_id"], r["pos"])
    flat = rewrite.pruned(n, REG)
    got = sorted(flat.collect(), key=key)
    assert flat._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count(" Sort [") <= 2
    monkeypatch.setattr(rewrite, "LEVELS", 2)
    assert got == sorted(rewrite.pruned(n, REG).collect(), key=key) and len(got) > 100
