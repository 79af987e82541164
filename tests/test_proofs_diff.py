"""Proofs of sets of leaves and structural differences against plain functions."""

from __future__ import annotations

import hashlib
import json
import random

from pyspark.sql import functions as F

from quillgrove.functions import trees
from quillgrove.made import doc, par, text
from quillgrove.operators import diff, nodes, proofs

SIZES = [1, 2, 3, 4, 5, 7, 8, 45, 124, 5000]


def leaf(tree, i):
    return hashlib.sha256(f"{tree}/{i}".encode()).digest()


def stored_levels(spark, sizes):
    rows = [(n, i, bytearray(leaf(n, i))) for n in sizes for i in range(n)]
    random.Random(1).shuffle(rows)
    return proofs.indexed(spark.createDataFrame(rows, "size int, place int, h binary").withColumn("place", F.col("place") * 3 - 7), "size", "place", "h")


def test_levels_are_those_of_one_tree(spark):
    found = {}
    for r in proofs.levels(stored_levels(spark, SIZES)).collect():
        found.setdefault(r["tree"], {}).setdefault(r["level"], {})[r["i"]] = bytes(r["h"])
    for n in SIZES:
        want = trees.merkle_levels([leaf(n, i) for i in range(n)])
        assert [[found[n][k][i] for i in range(len(level))] for k, level in enumerate(want)] == want
        assert len(found[n]) == len(want) and sum(map(len, found[n].values())) == sum(map(len, want))


def needed(n, wanted):
    """Places that can't be computed, by definition: mates outside of what the leaves give."""
    out, known, size, level = set(), set(wanted), n, 0
    while size > 1:
        out |= {(level, i ^ 1) for i in known if i ^ 1 < size and i ^ 1 not in known}
        known, size, level = {i >> 1 for i in known}, (size + 1) // 2, level + 1
    return out


def test_proofs_of_any_set_hold_and_forged_ones_fail(spark):
    rnd = random.Random(5)
    sets = {n: sorted(rnd.sample(range(n), rnd.randrange(1, n + 1))) if n < 200 else [0, 4095, 4096, 4999] for n in SIZES}
    stored = proofs.levels(stored_levels(spark, SIZES)).persist()
    wanted = spark.createDataFrame([(n, i) for n, some in sets.items() for i in [*some, some[0]]] + [(3, 99), (77, 0)], "tree int, i long")
    made = proofs.multiproofs(stored, wanted)
    forged = F.transform("leaves", lambda x, k: F.struct(x["i"].alias("i"), F.when(k == 0, F.unhex(F.sha2(F.lit("forged"), 256))).otherwise(x["h"]).alias("h")))
    checked = made.withColumns({
        "good": proofs.holds(F.col("leaves"), F.col("proof"), F.col("n"), F.col("root")), "bad": proofs.holds(forged, F.col("proof"), F.col("n"), F.col("root")),
        "short": proofs.holds(F.col("leaves"), F.slice("proof", 2, 999), F.col("n"), F.col("root")), "other": proofs.holds(F.col("leaves"), F.col("proof"), F.col("n"), F.col("root"), "own"),
    })
    got = {r["tree"]: r for r in checked.collect()}
    assert set(got) == set(SIZES)
    for n, some in sets.items():
        r = got[n]
        assert [x["i"] for x in r["leaves"]] == some and [bytes(x["h"]) for x in r["leaves"]] == [leaf(n, i) for i in some]
        assert {(x["level"], x["i"]) for x in r["proof"]} == needed(n, some) and len(r["proof"]) == len(needed(n, some))
        assert bytes(r["root"]) == trees.merkle_root([leaf(n, i) for i in range(n)])
        assert r["good"] and not r["bad"] and (not r["short"] or not r["proof"]) and (n == 1 or not r["other"])


def test_single_leaves_of_every_place(spark):
    n = 13
    stored = proofs.levels(stored_levels(spark, [n]).where(F.col("tree") == n)).persist()
    for i in range(n):
        r = proofs.multiproofs(stored, spark.createDataFrame([(n, i)], "tree int, i long")).select(proofs.holds(F.col("leaves"), F.col("proof"), F.col("n"), F.col("root")).alias("ok"), "proof").first()
        mine = trees.merkle_proof(trees.merkle_levels([leaf(n, k) for k in range(n)]), i)
        assert r["ok"] and [bytes(x["h"]) for x in r["proof"]] == [h for _, h in mine]


def node_table(spark, docs):
    return nodes.from_trees(spark.createDataFrame([(k, json.dumps(d)) for k, d in docs.items()], "doc_id string, raw string"))


def plain_differences(a, b, path=()):
    """By definition, without digests."""
    if trees.kind_of(a) != trees.kind_of(b):
        return [(list(path), "element")]
    out = [(list(path), "fields")] if trees.fields_of(a) != trees.fields_of(b) else []
    ka, kb = trees.children_of(a), trees.children_of(b)
    out += [(list(path), "children")] if len(ka) != len(kb) else []
    for i, (x, y) in enumerate(zip(ka, kb, strict=False)):
        out += plain_differences(x, y, (*path, i))
    return out


def test_differences_are_those_of_a_walk(spark):
    rnd = random.Random(9)

    def grown(depth=0):
        return text(rnd.choice("ab")) if depth > 4 or rnd.random() < 0.3 else {"t": rnd.choice(["section", "paragraph"]), **({"id": rnd.choice("xy")} if rnd.random() < 0.3 else {}), "c": [grown(depth + 1) for _ in range(rnd.randrange(4))]}

    def changed(n):
        if rnd.random() < 0.12:
            return grown(3)
        return {**n, "c": [changed(x) for x in n["c"]]} if "c" in n else n

    before = {f"d{i}": doc(*[grown() for _ in range(3)]) for i in range(60)}
    after = {k: changed(d) for k, d in before.items()}
    before |= {"same": doc(par(text("x"))), "gone": doc(par(text("x"))), "typed": doc(par({"t": "text", "v": 1}))}
    after |= {"same": doc(par(text("x"))), "new": doc(par(text("x"))), "typed": doc(par({"t": "text", "v": "1"}))}
    a, b = node_table(spark, before), node_table(spark, after)
    found: dict[str, list] = {}
    for r in diff.differences(a, b, most=None).orderBy("doc_id", "nth").collect():
        found.setdefault(r["doc_id"], []).append((list(r["path"]), r["kind"]))
    # Digests take "1" and 1 as equal, as the recipe does; everything else is found.
    want = {k: d for k in before if k in after and k != "typed" and (d := plain_differences(before[k], after[k]))}
    assert found == want
    first = {k: n for k, n in diff.differences(a, b, most=2).groupBy("doc_id").count().collect()}
    assert first == {k: min(2, len(d)) for k, d in want.items()}
    one = diff.differences(node_table(spark, {"a": doc(par(text("x")))}), node_table(spark, {"a": doc(par(text("y")))})).first()
    assert (one["kind"], one["before"], one["after"]) == ("fields", "v=str:x", "v=str:y")


def test_leaves_of_levels_are_read_once(spark):
    """whatever makes the leaves ran for the sizes, the height, level 0 and the stretches."""
    from quillgrove.operators import proofs

    ran = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            ran.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([("a", i, bytes([i])) for i in range(5)], "tree string, i long, h binary").mapInArrow(counted, "tree string, i long, h binary")
    held = proofs.levels(rows)
    assert held.count() == 5 + 3 + 2 + 1 and held.where("level = 3").count() == 1
    assert ran.value == 5
