"""The corpus operators against brute force, on small fixtures with awkward rows."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillgrove.llm import byte_bpe, line_templates, mixing, pitman_yor, quality_classifier, quality_rules, simhash, substring_dedup, suffix_dedup, syncmers
from quillgrove.llm.common import LAST_ID, keyed, ordered_blocks, pack_keys, unpack_keys
from quillgrove.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = SCHEMA + ", block int, n_words string, kept string, word long"


def corpus(n=60, seed=1):
    """Texts of invented words with copies, shared passages, repeated lines, nulls and extremes."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 7))) for _ in range(80)] + ["The", "of", "and"]
    say = lambda k: " ".join(rnd.choice(words) for _ in range(k))
    passage, line = say(70), say(9)
    rows = []
    for i in range(n):
        text = "\n".join(say(rnd.randrange(1, 60)) for _ in range(rnd.randrange(1, 6)))
        if i % 5 == 0:
            text += "\n" + passage + " " + say(5)
        if i % 4 == 0:
            text = line + "\n" + text
        if i % 9 == 8:
            text = rows[-3][1]
        rows.append((i, text, rnd.choice(["en", "de", None]), rnd.choice(["a", "b", None]), 0))
    rows += [(n, None, None, None, None), (n + 1, "", "en", "a", 0), (n + 2, "  \n\t", "en", "", 3), (None, passage, None, "é", 1), (n + 3, "w " * 9000, "en", "a", 0), (n + 3, passage, "en", "a", 0), (n + 4, "one", "fr", "a", 3)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 7, "x", "y", 1) for r in corpus()], EXTRA).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


def words_of(t):
    return (t or "").encode().split()


def digest(b):
    return hashlib.sha256(b).hexdigest()


def test_common(spark):
    keys = np.unique(np.random.default_rng(0).integers(0, 2**64, 5000, dtype=np.uint64))
    assert (unpack_keys(pack_keys(keys)) == keys).all() and len(unpack_keys(pack_keys(keys[:0]))) == 0


@pytest.mark.parametrize("ids", [list(range(500)), [None] * 300, [7] * 300 + [1 << 61], [-(1 << 62), *range(300), (1 << 62), None, None], [k * k * k for k in range(-200, 200)]])
def test_ordered_blocks(spark, ids):
    rows = [(i, f"text {k} " * 20) for k, i in enumerate(ids)] + [(ids[0], "long " * 4000)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    out, total = ordered_blocks(keyed(d, "doc_id", "text"), 2000)
    got = out.collect()
    assert len(got) == len(rows) and total == sum(len(t.encode()) + 64 for _, t in rows)
    by: dict = {}
    for r in got:
        by.setdefault(r["block"], []).append(r)
    held = [by[b] for b in sorted(by)]
    for x, y in zip(held[:-1], held[1:], strict=True):
        assert max((r["k"], r["h"]) for r in x) < min((r["k"], r["h"]) for r in y) or max(r["k"] for r in x) < min(r["k"] for r in y)
        assert (x[0]["place"] == y[0]["place"]) == (x[0]["k"] == y[0]["k"])
    small = [sum(len(r["text"]) + 64 for r in x) for x in held if all(len(r["text"]) < 1000 for r in x)]
    assert len(held) > total / 60_000 and max(small, default=0) < 12_000  # equal and missing ids are parted too
    assert "array" not in out._jdf.queryExecution().optimizedPlan().toString().lower()


@pytest.mark.parametrize(
    "ids",
    [[*range(4000), 10**15, 9 * 10**18], [*range(2000), *range(7 * 10**17, 7 * 10**17 + 2000), 9 * 10**18], [*range(-(2**62), -(2**62) + 900), *range(900)], [xxhash.xxh64_intdigest(str(k)) >> 1 for k in range(3000)], [k % 40 for k in range(4000)], [5] * 3000 + [*range(200)]],
    ids=["outliers", "clusters", "two generators", "hashes", "repeated", "one heavy"],
)
def test_blocks_are_bounded_whatever_the_ids(spark, ids):
    d = spark.createDataFrame([(i, f"text {k} " * 20) for k, i in enumerate(ids)], "doc_id long, text string")
    out, total = ordered_blocks(keyed(d, "doc_id", "text"), 20_000)
    sizes: Counter = Counter()
    for r in out.collect():
        sizes[r["block"]] += len(r["text"]) + 64
    assert max(sizes.values()) <= 40_000 and len(sizes) <= 2 * total / 20_000 + 4 and sum(sizes.values()) == total


def test_dedup_and_fingerprints_with_scattered_ids(spark):
    rows = [(i, t) for i, t, *_ in corpus(40)]
    far = {i: k for k, i in zip([*range(30), 10**15, 10**15 + 1, *range(9 * 10**18, 9 * 10**18 + 60)], sorted({i for i, _ in rows if i is not None}), strict=False)}
    moved = [(None if i is None else far[i], t) for i, t in rows]
    plain, scattered = (spark.createDataFrame(r, "doc_id long, text string") for r in (rows, moved))
    for op, cols in ((substring_dedup.dedup, ("n_words", "n_removed", "kept_sha256")), (syncmers.compare, ("n_chars", "edited_sha256", "near_edited", "near_next"))):
        want = Counter((far.get(r["doc_id"]), *(r[c] for c in cols)) for r in op(plain).collect())
        assert Counter((r["doc_id"], *(r[c] for c in cols)) for r in op(scattered, block_bytes=3000).collect()) == want


def test_substring_dedup(docs, empty):
    rows = corpus()
    first: dict = {}
    for i, t, *_ in rows:
        w, key = words_of(t), LAST_ID if i is None else i
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            first[g] = min(first.get(g, key), key)
    want = Counter()
    for i, t, *_ in rows:
        w, key, gone = words_of(t), LAST_ID if i is None else i, set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < key:
                gone |= set(range(k, k + 13))
        want[i, len(w), len(gone), digest(b" ".join(x for k, x in enumerate(w) if k not in gone))] += 1
    for size in (1 << 20, 3000):
        assert rows_of(substring_dedup.dedup(docs, block_bytes=size), "doc_id", "n_words", "n_removed", "kept_sha256") == want
    full = substring_dedup.dedup(docs, with_text=True).where("n_removed > 0").first()
    assert sum(s["end"] - s["start"] for s in full["spans"]) == full["n_removed"] and digest(full["kept_text"].encode()) == full["kept_sha256"]
    assert substring_dedup.dedup(empty).count() == 0


def without_repeats(rows, length):
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[k : k + length] for k in range(len(b) - length + 1))
    want = Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        want[i, len(b), int(gone.sum()), len(suffix_dedup.runs(gone)[0]), digest(np.frombuffer(b, np.uint8)[~gone].tobytes())] += 1
    return want


@pytest.mark.parametrize("how", [{}, {"block_bytes": 4000, "task_bytes": 2000, "range_keys": 100}, {"block_bytes": 4000, "crowd": 1, "range_keys": 300}])
def test_suffix_dedup(docs, how):
    cols = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert rows_of(suffix_dedup.dedup(docs, length=120, **how), *cols) == without_repeats([r[:2] for r in corpus()], 120)


def test_suffix_dedup_at_the_production_length(spark):
    rnd = random.Random(12)
    say = lambda n: "".join(rnd.choice("abcdefgh é") for _ in range(n))
    shared = [say(n) for n in (320, 395, 399, 400, 401, 420, 900, 2500)]
    rows = [(i, say(rnd.randrange(700)) + "".join(rnd.choice(shared) + say(rnd.randrange(90)) for _ in range(rnd.randrange(4)))) for i in range(60)]
    rows += [(None, rows[7][1]), (None, None), (7, rows[3][1] + "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = without_repeats(rows, suffix_dedup.LENGTH)
    for how in ({}, {"block_bytes": 8000, "task_bytes": 5000, "range_keys": 50}, {"block_bytes": 8000, "crowd": 2, "range_keys": 50}):
        assert rows_of(suffix_dedup.dedup(d, **how), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_interval_expansion():
    rnd = random.Random(3)
    for _ in range(30):
        length = rnd.choice([9, 12, 30, 80])
        pool = [bytes(rnd.choice(b"ab\0c") for _ in range(rnd.choice([20, 50, 200]))) for _ in range(4)]
        texts = [b"".join(rnd.choice(pool)[rnd.randrange(10) :] for _ in range(rnd.randrange(1, 6))) for _ in range(8)]
        c = Counter(x[i : i + length] for x in texts for i in range(len(x) - length + 1))
        for x, got in zip(texts, suffix_dedup.repeated(texts, length), strict=True):
            assert got.tolist() == [c[x[i : i + length]] > 1 for i in range(len(x) - length + 1)]


def test_suffix_dedup_of_nothing(empty):
    assert suffix_dedup.dedup(empty).count() == 0


def test_syncmers(docs, empty, spark):
    hashed = lambda t: xxhash.xxh64_intdigest((t or "").encode(), 42) >> 1
    rows = sorted(corpus(), key=lambda r: (-(LAST_ID if r[0] is None else r[0]), -hashed(r[1])))
    texts = [r[1] or "" for r in rows]
    want = Counter()
    for k, (i, *_) in enumerate(rows):
        a, b = texts[k], texts[(k + 1) % len(rows)]
        half = len(a) // 2
        edited = a[: len(a) - half] + b[:half]
        x, y, z = (syncmers.anchors([s.encode()])[0] for s in (a, edited, b))
        want[i, len(a), digest(edited.encode()), syncmers.written(x), syncmers.written(y), syncmers.likeness(x, y), syncmers.likeness(x, z)] += 1
    cols = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    for size in (1 << 20, 3000):
        assert rows_of(syncmers.compare(docs, block_bytes=size), *cols) == want
    assert syncmers.compare(empty).count() == 0
    one = syncmers.compare(docs.where("doc_id = 3")).first()
    assert one["near_next"] == 1.0


def test_syncmers_have_one_scale():
    rnd = random.Random(9)
    for n in (60, 150, 199, 205, 210, 300, 420):
        text = "".join(rnd.choice("abcdefghijklmno ") for _ in range(n)).encode()
        x, y = syncmers.anchors([text, text[: n - n // 20]])
        assert syncmers.likeness(x, y) >= 0.75
    near = [syncmers.likeness(*syncmers.anchors(["".join(rnd.choice("abcdefghijklmno ") for _ in range(n)).encode() for _ in range(2)])) for n in range(30, 600)]
    assert max(near) <= 0.1
    for n in range(2 * syncmers.K - syncmers.S, 60):  # a syncmer is certain from here on
        x = syncmers.anchors([bytes(rnd.randrange(97, 123) for _ in range(n))])[0]
        assert x[0][0] != int(hashlib.sha256(b"").hexdigest()[:8], 16) and len(x[0])


def test_syncmers_are_context_free_and_written_back():
    rnd = random.Random(2)
    core = bytes(rnd.choice(b"abcdefgh ") for _ in range(900))
    a, b = core, bytes(rnd.choice(b"xyz ") for _ in range(50)) + core
    x, y = syncmers.anchors([a, b], size=10_000)
    assert len(set(x[0]) - set(y[0])) == 0
    back = syncmers.read(syncmers.written(x))
    assert (back[0] == x[0]).all() and (back[1] == x[1]).all()
    # The definition, by hand.
    inner = syncmers.mix(np.array([int.from_bytes(a[i : i + syncmers.S], "little") for i in range(len(a) - syncmers.S + 1)], np.uint64))
    span = syncmers.K - syncmers.S
    places = {i for i in range(len(a) - syncmers.K + 1) if inner[i : i + span + 1].min() in (inner[i], inner[i + span])}
    assert set(x[1].tolist()) <= places and len(x[0]) == len({a[i : i + syncmers.K] for i in places})


def test_quality_rules(docs, empty, spark, tmp_path):
    got = quality_rules.judge(docs)
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    docs.select("text", F.when(F.col("doc_id") % 3 == 0, "xx").otherwise(F.col("lang")).alias("lang"), F.monotonically_increasing_id().alias("doc_id")).coalesce(1).write.parquet(str(tmp_path / "d"))
    c = duckdb.connect()
    c.execute(f"create view documents as from '{tmp_path}/d/*.parquet'")
    sub = quality_rules.judge(spark.read.parquet(str(tmp_path / "d")))
    assert rows_of(sub, *cols) == Counter(tuple(r) for r in c.sql(f"select {', '.join(cols)} from ({quality_rules.ORACLE_SQL})").fetchall())
    assert got.count() == docs.count() and not got.where("base_failed and kept").count()
    assert quality_rules.judge(empty).count() == 0
    nodes = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in nodes and "Arrow" not in nodes


def template_lines(rows, lead=3, least=5, share=0.9):
    """Lines that stay, by brute force over (id, text) documents."""
    docs = sorted({(LAST_ID if i is None else i, t or "") for i, t in rows})
    place = {}
    for d in docs:
        for no, line in enumerate(d[1].split("\n")):
            w = tuple("<*>" if any(c in "0123456789" for c in x) else x for x in re.split("[\x20\x09-\x0d]+", line) if x)
            if any(x != "<*>" for x in w):
                place.setdefault((len(w), w[:lead]), {}).setdefault(w, {}).setdefault(d, []).append(no)
    gone = {d: set() for d in docs}
    for held in place.values():
        if len({d for ds in held.values() for d in ds}) < least:
            continue
        support = Counter()
        for w, ds in held.items():
            for k, x in enumerate(w):
                support[k, x] += len(ds)
        by = {}
        for w, ds in held.items():
            known = [k for k, x in enumerate(w) if x != "<*>"]
            fixed = [k for k in known if support[k, w[k]] >= least]
            if fixed and len(fixed) >= share * len(known):
                by.setdefault(tuple((k, w[k]) for k in fixed), []).extend((d, no) for d, nos in ds.items() for no in nos)
        for found in by.values():
            if len({d for d, _ in found}) >= least:
                first = min(d for d, _ in found)
                for d, no in found:
                    if d != first:
                        gone[d].add(no)
    return {d: "\n".join(x for no, x in enumerate(d[1].split("\n")) if no not in gone[d]) for d in docs}


def test_line_templates(docs, empty, spark, tmp_path):
    jobs = [f"job {i} started on host h{i} at port {i * 7} by the usual scheduler service" for i in range(12)]
    ends = ["dogs bark", "cats meow", "rain falls", "birds sing", "wind blows", "snow melts", "time flies"]
    extra = [(100 + i, f"{x}\nRead more\nunique {'abcdefghijkl'[i] * 4} stands here alone\n{i} {i}\n") for i, x in enumerate(jobs)]
    extra += [(200 + i, f"He said that {x}") for i, x in enumerate(ends)]
    extra += [(300 + i, f"we thank all our dear readers {x} and wish them well") for i, x in enumerate("abcdef")]
    extra += [(None, f"Read more\nnull {x}") for x in ("a", "b")] + [(400, "Read more"), (400, "Read more"), (400, "x\nRead more")]
    both = docs.select("doc_id", "text").unionAll(spark.createDataFrame(extra, "doc_id long, text string"))
    rows = [(r["doc_id"], r["text"]) for r in both.collect()]
    want = template_lines(rows)
    got = line_templates.apply(both).collect()
    kept = {(LAST_ID if i is None else i, t or ""): want[LAST_ID if i is None else i, t or ""] for i, t in rows}
    assert Counter((r["doc_id"], r["text"] or "") for r in got) == Counter((i, kept[LAST_ID if i is None else i, t or ""]) for i, t in rows)
    by = {r["doc_id"]: r["text"] for r in got}
    assert by[100] == extra[0][1] and not any("job" in by[k] or "Read" in by[k] for k in range(101, 112)) and all("unique" in by[k] for k in range(100, 112))
    assert all(by[200 + i] == f"He said that {x}" for i, x in enumerate(ends))  # distinct short lines stay
    assert [by[300 + i] == "" for i in range(6)] == [False] + [True] * 5  # one word of eleven varies
    odd = docs.selectExpr("doc_id", "text", "1 as `doc`", "2 as `digest`", "3 as `gone`", "4 as `row`", "5 as `a.b`")
    assert line_templates.apply(odd).columns == odd.columns and line_templates.apply(odd).count() == docs.count()
    assert line_templates.apply(docs).where("text is null").count() == 1
    assert line_templates.apply(empty).count() == 0
    spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"create view documents as from '{tmp_path}/documents.parquet/*.parquet'")
    op = line_templates.op6_line_templates(spark, str(tmp_path))
    assert Counter(map(tuple, op.collect())) == Counter(c.sql(line_templates.ORACLE_SQL).fetchall())
    plan = op._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_simhash(docs, empty, spark):
    rows = corpus()

    def brute(t):
        w = bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()).split()
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    f = [brute(r[1]) for r in rows]
    keys = [LAST_ID if r[0] is None else r[0] for r in rows]
    label = list(keys)
    for _ in rows:
        label = [min(label[j] for j in range(len(f)) if (f[i] ^ f[j]).bit_count() <= 3) for i in range(len(f))]
    want = Counter((r[0], format(x, "016x"), None if c == LAST_ID else c) for r, x, c in zip(rows, f, label, strict=True))
    for how in ({}, {"run_rows": 20}, {"bucket_limit": 2}):
        assert rows_of(simhash.near_duplicates(docs, **how), "doc_id", "fingerprint", "component_id") == want
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("hot", [False, True])
def test_gray_order_index_loses_no_link(spark, hot):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 40, dtype=np.uint64)
    near = [int(b) ^ int(sum(1 << int(k) for k in rng.choice(64, 3, replace=False))) for b in base for _ in range(20)]
    if hot:  # a third of the fingerprints in one bucket
        near = [x & ~(0xFFFF << 48) for x in near]
    f = np.unique(np.array([*base.tolist(), *near], np.uint64))
    bucket = np.zeros(len(f), np.int64)
    label = np.arange(len(f))
    for _ in range(len(f)):
        fresh = np.array([label[np.bitwise_count(f ^ x) <= 3].min() for x in f])
        if (fresh == label).all():
            break
        label = fresh
    a, b = simhash.stars(f, bucket, 3)
    got = simhash.join(np.arange(len(f)), a, b)
    assert len(np.unique(got)) == len(np.unique(label)) and len({(x, y) for x, y in zip(got, label, strict=True)}) == len(np.unique(label))
    e = spark.createDataFrame([(i, int(x)) for i, x in enumerate(f.view(np.int64))], "id long, fp long")
    for how in ({}, {"bucket_limit": 30, "run_rows": 50}):
        found = {r["node"]: r["component"] for r in components(simhash.link(e, **how)).collect()}
        assert [found.get(i, i) for i in range(len(f))] == label.tolist()


def test_components_of_a_path_and_a_hub(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 400)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert set(got.values()) == {0, 1000} and len(got) == 301 + 400


def test_mixing(docs, empty, spark):
    rows = spark.createDataFrame([(i, "w " * (1 + i * 37 % 90), "en", s, 0) for i in range(900) for s in ["abcdé"[i % 5] if i % 11 else None]], SCHEMA)
    got = mixing.mix(rows).collect()
    assert len(got) == 900
    size = Counter()
    for r, (i,) in zip(sorted(got, key=lambda r: r["doc_id"]), [(i,) for i in range(900)], strict=True):
        s = None if i % 11 == 0 else "abcdé"[i % 5]
        size[s] += r["size"]
        assert r["size"] == 1 + i * 37 % 90 and r["taken"] <= 2 * r["size"] and r["taken"] % r["size"] == 0
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, rest, free = {}, 1.5 * sum(size.values()), set(order)
    while True:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * size[s]]
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 2.0 * size[s]
            rest -= target[s]
            free.discard(s)
    taken = Counter()
    for r in got:
        s = None if r["doc_id"] % 11 == 0 else "abcdé"[r["doc_id"] % 5]
        taken[s] += r["taken"]
        assert r["source_size"] == size[s] and math.isclose(r["target"], target[s], rel_tol=1e-9)
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] for s in size)
    # The rates solve the dual: their words meet the target, and their logarithm is linear in the size.
    for s in size:
        own = [r for r in got if (None if r["doc_id"] % 11 == 0 else "abcdé"[r["doc_id"] % 5]) == s]
        assert math.isclose(sum(r["rate"] * r["size"] for r in own), target[s], rel_tol=1e-6)
        tilts = [math.log(r["rate"]) / r["size"] for r in own if r["rate"] < 2]
        assert not tilts or max(tilts) - min(tilts) < 1e-6
    assert sorted(map(tuple, mixing.mix(rows).collect())) == sorted(map(tuple, got))
    assert mixing.mix(empty).count() == 0 and mixing.mix(docs).count() == docs.count()


def test_classifier(spark, docs, empty):
    rnd = random.Random(4)
    good = lambda: " ".join(rnd.choice(["the", "cat", "sat", "on", "mats", "often"]) for _ in range(40))
    rows = [(i, good() if i % 3 else good().upper() + " !!! ###", "en", "a", 0) for i in range(300)]
    d = spark.createDataFrame(rows, SCHEMA)
    y = spark.createDataFrame([(i, int(bool(i % 3)), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    model = quality_classifier.train(d, y)
    got = quality_classifier.classify(d, model).collect()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r["predicted"] == bool(r["doc_id"] % 3) for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert quality_classifier.classify(docs, model).count() == docs.count()
    assert quality_classifier.classify(empty, quality_classifier.train(empty, y.limit(0))).count() == 0


def seated(tok, held, rounds=pitman_yor.ROUNDS):
    """The model on a plain dictionary of pairs: the same draws, one dish at a time. Returns log10 probabilities by text."""
    P, end = pitman_yor, None
    pairs, n = Counter(), Counter()
    for x, h in zip(tok, held, strict=True):
        if not h:
            n.update(x)
            pairs.update(zip(x, [end, *x[:-1]], strict=True))
    hashed = {w: int(P.END) if w is end else int(P.tokens(next(iter(P.pieces([w]))))[0][0]) for w in {*n, *(w for x in tok for w in x)}}
    key = {p: P.pair_keys(*(np.array([hashed[w]], np.uint64) for w in p)) for p in pairs}
    def rate(counts):
        c = Counter(counts)
        return min(0.95, max(0.05, c[1] / (c[1] + 2 * c[2]))) if c[1] else 0.5

    d2 = rate(pairs.values())
    tables = dict.fromkeys(pairs, 1.0)

    def added(t):
        dish, rest = Counter(), Counter()
        for (w, u), x in t.items():
            dish[w] += x
            rest[u] += x
        return dish, rest

    dish, rest = added(tables)
    parent = dict.fromkeys(n, 1.0)
    for k in range(rounds):
        t = P.Totals(sum(n.values()), len(n), sum(dish.values()), sum(parent.values()), d2, rate(round(x) for x in dish.values()))
        new = {}
        for p, c in pairs.items():
            one = lambda x: np.array([float(x)])
            turns = range(P.KEEP) if k == rounds - 1 else range(1)
            new[p] = float(np.mean([P.seat_pairs(np.array([c]), key[p], one(tables[p]), one(rest[p[1]]), one(dish[p[0]]), one(parent[p[0]]), t, 100 * (k + 1) + j, P.stirling(d2))[0] for j in turns])) if c > 1 else 1.0
        tables = new
        dish, rest = added(tables)
        parent = {w: float(P.seat_parent(np.array([dish[w]]), np.array([hashed[w]], np.uint64), t, 5001 + k, P.stirling(t.parent_discount))[0]) for w in n}
    t = P.Totals(sum(n.values()), len(n), sum(dish.values()), sum(parent.values()), d2, rate(round(x) for x in dish.values()))

    def p(w, u):
        p0 = max(dish[w] - t.parent_discount * parent.get(w, 0), 0) / (1 + t.customers) + t.rest()
        return max(pairs[w, u] - d2 * tables.get((w, u), 0), 0) / (5 + n[u]) + (5 + d2 * rest[u]) / (5 + n[u]) * p0

    known = [*n]
    for u in known[:20]:  # probabilities add up, an unknown word among them
        assert math.isclose(sum(p(w, u) for w in known) + p(b"unknown word", u), 1, rel_tol=1e-6)
    return [sum(math.log10(p(w, u)) for w, u in zip(x, [end, *x[:-1]], strict=True)) for x in tok]


def test_pitman_yor(docs, empty):
    rows = corpus()
    tok = [[bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in words_of(t)] + [None] for _, t, *_ in rows]
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i, *_ in rows]
    c = Counter(w for x, h in zip(tok, held, strict=True) if not h for w in x)
    n, v = sum(c.values()), len(c)
    want = Counter((r[0], h, len(x), sum(c[w] > 0 for w in x), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x), 6)) for r, x, h in zip(rows, tok, held, strict=True))
    plain = sorted((len(x), s) for x, s in zip(tok, seated(tok, held), strict=True))
    for how in ({}, {"block_bytes": 3000, "range_bytes": 2000}):  # one range, and dozens of blocks and ranges
        got = pitman_yor.score(docs, **how).collect()
        assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
        assert all(m == r[0] and math.isclose(s, r[1], rel_tol=1e-4) for (m, s), r in zip(sorted((r["n_tokens"], r["score"]) for r in got), plain, strict=True))
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    assert pitman_yor.score(empty).count() == 0


def test_seating_has_the_exact_conditional_distribution():
    c, d, strength, customers, tables = 6, 0.6, 2.0, 3.0, 4.0
    s = pitman_yor.stirling(d)
    parts = lambda n, k: [[n]] if k == 1 else [[a, *x] for a in range(1, n) for x in parts(n - a, k - 1)]
    rising = lambda n: math.prod(j - d for j in range(1, n))
    for t in range(1, c + 1):  # S(c, t): weights of all seatings at t tables
        ways = sum(math.factorial(c) / math.prod(map(math.factorial, p)) * math.prod(map(rising, p)) for p in parts(c, t)) / math.factorial(t)
        assert math.isclose(math.exp(s[c, t]), ways, rel_tol=1e-9)
    n = 40_000
    others = pitman_yor.Others(np.full(n, tables), np.full(n, customers), np.ones(n))
    chance = lambda i: (customers + i - 0.5) / 50 + 0.01
    got = pitman_yor.seat(np.full(n, c), np.arange(n).astype(np.uint64), 3, strength, d, others, lambda at, i: pitman_yor.parent_weight(others, at, i, 0.5, 50.0, 0.01), s)
    weight = np.array([math.exp(s[c, t]) * math.prod((strength + d * (tables + i)) * chance(i) for i in range(t)) for t in range(1, c + 1)])
    assert np.abs(np.bincount(got.astype(int), minlength=c + 1)[1:] / n - weight / weight.sum()).max() < 0.01
    big = pitman_yor.seat(np.array([5000, 65, 1, 0]), np.arange(4).astype(np.uint64), 1, strength, d, pitman_yor.Others(*[np.full(4, 9.0)] * 3), lambda at, i: np.full((len(at), i.shape[1]), 0.05), s)
    assert big[2] == 1 and big[3] == 0 and big[0] > big[1] >= 1 and big[0] <= 5000


def test_byte_bpe(docs, empty):
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers as P

    path = P.path(byte_bpe.VOCABULARY)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    odd = ["a  b", " lead", "trail ", "tab\tand\nnew\n\nline", "it's we'll I'd", "x y  z", "\x1c \x1d", "日本語 🙂 é́", "12 345,6 %$#", "\r\n \r\n", "aaaa" * 3000, "<|endoftext|> x"]
    model = byte_bpe.codec(path, P.PATTERN)
    for t, (ids, back) in zip(odd, model.digests(odd), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(t) and back == t.encode()
    split = 0
    for t, (ids, back) in zip(odd, model.digests(odd), strict=True):
        first, end = model.offsets(np.frombuffer(ids, "<u4"), back)
        assert list(zip(first.tolist(), end.tolist(), strict=True)) == [tuple(x) for x in model.encode(t)[1]]
        at = np.cumsum([0, *(len(enc.decode_single_token_bytes(i)) for i in enc.encode_ordinary(t))])
        of = [k for k, c in enumerate(t) for _ in c.encode()]
        assert first.tolist() == [of[b] for b in at[:-1]] and end.tolist() == [of[b - 1] + 1 for b in at[1:]]
        split += int((first[1:] < end[:-1]).sum())
    assert split > 0  # characters over several tokens are among them
    ids, spans = model.encode("é🙂 x")
    assert model.decode(ids) == "é🙂 x" and spans[-1][1] == 4 and len(ids) == len(spans)
    want = Counter()
    for i, t, *_ in corpus():
        ids = enc.encode_ordinary(t or "")
        want[i, len(ids), digest(np.array(ids, "<u4").tobytes()), digest((t or "").encode())] += 1
    assert rows_of(byte_bpe.round_trip(docs), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    spans = {r["doc_id"]: r for r in byte_bpe.round_trip(docs.where("doc_id < 20")).collect()}
    for r in byte_bpe.encode(docs.where("doc_id < 20")).collect():
        pairs = np.array([x for p in zip(r["starts"], r["ends"], strict=True) for x in p], "<u4")
        assert spans[r["doc_id"]]["spans_sha256"] == digest(pairs.tobytes()) and spans[r["doc_id"]]["n_split"] == sum(a < b for a, b in zip(r["starts"][1:], r["ends"][:-1], strict=True))
    clash = byte_bpe.encode(docs.selectExpr("doc_id", "text", "1 as ids", "2 as `row`", "3 as `a.b`"))
    assert clash.columns == ["doc_id", "text", "row", "a.b", "ids", "starts", "ends"] and clash.count() == docs.count()
    again = byte_bpe.decode(byte_bpe.encode(docs.where("doc_id < 20")))
    assert again.where(F.col("decoded") != F.coalesce("text", F.lit(""))).count() == 0
    assert byte_bpe.round_trip(empty).count() == 0


def test_pipeline_against_the_operators(spark, docs):
    import corpus_pipeline as cp

    rows = docs.select("doc_id", "text", "lang", "source", "n_chars").where("doc_id is not null").dropDuplicates(["doc_id"]).persist()
    kept = {r["doc_id"] for r in quality_rules.judge(rows).where("kept").collect()}
    a = cp.quality(spark, rows, "")
    assert {r["doc_id"] for r in a.collect()} == kept
    odd = rows.selectExpr("cast(null as long) as doc_id", "text", "lang", "source", "n_chars", "1 as kept_id", "2 as `key`", "3 as copies")
    assert cp.quality(spark, odd, "").count() == len(kept) and cp.mix_sources(spark, odd, "").columns == list(cp.COLUMNS)  # rows without ids are judged one by one
    b = cp.line_dedup(spark, a, "")
    assert b.columns == list(cp.COLUMNS) and b.count() == a.count() and b.where("n_chars <> length(text)").count() == 0
    c = cp.near_dedup(spark, b, "").persist()
    groups = {r["component_id"] for r in simhash.near_duplicates(b).collect()}
    assert {r["doc_id"] for r in c.collect()} == groups
    d = cp.mix_sources(spark, c, "").persist()
    want = Counter({r["doc_id"]: r["copies"] for r in mixing.mix(c).collect() if r["copies"]})
    assert Counter(r["doc_id"] for r in d.collect()) == want
    assert cp.tokens(spark, d, "").count() == d.count()
    assert [n for n, _ in cp.STAGES] == ["quality rules", "line dedup", "near dedup", "mixing", "byte bpe"]


def test_near_dedup_takes_all_pairs_of_four_fifths(spark):
    import corpus_pipeline as cp

    rnd = random.Random(8)
    words = [f"w{k}" for k in range(4000)]
    common = [rnd.choice(words) for _ in range(30)]
    rows = []
    for _ in range(25):
        text = [rnd.choice(words) for _ in range(rnd.randrange(60, 160))]
        for edits in (0, 1, 2, 3, 4):
            own = list(text)
            for _ in range(edits):
                own[rnd.randrange(len(own))] = rnd.choice(words)
            rows.append((len(rows), " ".join(own + (common if len(rows) % 2 else [])), "en", "a", 0))
    chain = [f"c{k}" for k in range(100)]
    for k in range(8):  # each links with the next alone
        rows.append((len(rows), " ".join([*chain[6 * k :], *[f"d{j}" for j in range(6 * k)]]), "en", "a", 0))
    rnd.shuffle(rows)
    grams = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (r[1].split() for r in rows)]
    label = [r[0] for r in rows]
    near = [[j for j in range(len(rows)) if len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j])] for i in range(len(rows))]
    for _ in rows:
        label = [min(label[j] for j in near[i]) for i in range(len(rows))]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = simhash.near_duplicates(docs).select("component_id").distinct().count()
    assert sorted(r["doc_id"] for r in cp.near_dedup(spark, docs, "").collect()) == sorted(set(label)) and len(set(label)) < found


def test_near_dedup_keeps_rows_without_or_with_repeated_ids(spark):
    import corpus_pipeline as cp

    say = lambda c, k=30: " ".join(f"{c}{j}" for j in range(k))
    rows = [(None, say("a"), "en", "a", 0), (None, say("b"), "en", "a", 0), (7, say("c"), "en", "a", 0), (7, say("d"), "en", "a", 0), (7, say("d"), "en", "a", 0), (9, say("a"), "en", "a", 0), (None, None, "en", "a", 0), (8, "", "en", "a", 0)]
    got = cp.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == [(0, say("b")), (7, say("c")), (7, say("d")), (8, ""), (9, say("a"))]


def test_near_copies_leave_other_columns_and_lose_nothing_to_a_full_sieve(spark, monkeypatch):
    from quillgrove.llm import near_copies

    say = lambda c, k=40: " ".join(f"{c}{j}" for j in range(k))
    texts = [say(c) + end for c in "abcdefgh" for end in ("", " z", " y x")] + ["", "  ", None, "A b", "a B"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, text string").selectExpr("id", "text", "1 as at", "2 as of", "3 as taken", "4 as `row`", "5 as `a.b`")
    want = [*range(0, 24, 3), 24, 27]
    for bits in (near_copies.SIEVE_BITS, 64):
        monkeypatch.setattr(near_copies, "SIEVE_BITS", bits)
        got = near_copies.thinned(rows, key_col="id")
        assert got.columns == rows.columns and sorted(r["id"] for r in got.collect()) == want
        assert sorted(r["key"] for r in near_copies.kept(rows, key_col="id").collect()) == want
    assert near_copies.thinned(rows.limit(0), key_col="id").count() == 0
    s = np.unique(near_copies.mix(np.arange(999, dtype=np.uint64)))
    plain = sum(1 << b for b in range(64) if sum(int(x) >> b & 1 for x in s) * 2 > len(s))
    assert near_copies.bits_of(s) % (1 << 64) == plain and near_copies.bits_of(s[:0]) == 0
