"""Centroids, vector codes and BPE with word ends against brute force, the library and SQL, with awkward rows."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from quillgrove.llm import centroids, vector_codes, word_bpe
from quillgrove.llm.queries import ORACLE, QUERIES
from quillgrove.llm.vectors import integers

SF = "/root/testdata/sf0.001"
TABLE = "vec_id long, embedding array<float>, label int, vector int, cluster string, distance string, code int, error string, n int"
NAN, INF = float("nan"), float("inf")


def table(spark, vectors, first=0):
    """Rows of (id, vector, label), with columns whose names an operator uses itself."""
    return spark.createDataFrame([(i, v, lab, 1, "c", "d", 2, "e", 3) for i, v, lab in vectors], TABLE)


def some_vectors(dims=8, n=90, seed=3):
    rnd = random.Random(seed)
    near = [[rnd.uniform(-1, 1) for _ in range(dims)] for _ in range(5)]
    rows = [(k, [float(np.float32(x + rnd.gauss(0, 0.1))) for x in near[k % 5]], [None, 1, 1, 1, 2][k % 5]) for k in range(n)]
    rows += [(500 + k, rows[0][1], 7) for k in range(20)]  # copies
    rows += [(3, rows[4][1], 1), (3, rows[4][1], 1), (4, rows[9][1], None), (None, rows[5][1], 9)]  # repeated and missing ids
    return rows


BAD = [(900, None, 1), (901, [0.5] * 7 + [None], 1), (902, [NAN] + [0.5] * 7, 2), (903, [0.5] * 7 + [INF], None), (904, [-INF] * 8, None)]


def distance(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def lloyd(rows, k, rounds, scale):
    """Centroids and (id, cluster, distance) by definition."""
    held = [(i, [int(np.floor(scale * x)) for x in v]) for i, v, _ in rows]
    ranked = sorted(held, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    table = [v for _, v in ranked[:k]]
    pick = lambda v: min(range(len(table)), key=lambda c: (distance(v, table[c]), c))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in held:
            groups[pick(v)].append(v)
        table = [[sum(x) // len(groups[c]) for x in zip(*groups[c], strict=True)] if c in groups else t for c, t in enumerate(table)]
    return table, [(i, pick(v), distance(v, table[pick(v)])) for i, v in held]


@pytest.mark.parametrize("k", [1, 6, 500])
def test_centroids_are_those_of_plain_lloyd(spark, k):
    rows = some_vectors()
    other = [(950, [0.1] * 9, 1), (951, [], 1)]
    got = centroids.cluster(table(spark, rows + BAD + other).repartition(3), dims=8, k=k).collect()
    want_table, want = lloyd(rows, k, 3, 64)
    sums = Counter()
    for _, c, d in want:
        sums[c] += d
    expected = Counter((i, c, d, sums[c], sum(sums.values()), hashlib.sha256(",".join(map(str, want_table[c])).encode()).hexdigest()) for i, c, d in want)
    assert Counter(tuple(r) for r in got) == expected and sum(expected.values()) == len(rows)


def test_an_empty_centroid_stays_and_ties_go_to_the_lower_number():
    at, far = np.array([[0, 0], [2, 0], [1, 0]]), np.array([[0, 0], [2, 0], [99, 99]])
    best, d = centroids.nearest(at, far)
    assert best.tolist() == [0, 1, 0] and d.tolist() == [0, 0, 1]
    assert integers(np.array([-0.5, 0.99, -1 / 128]), 64).tolist() == [-32, 63, -1]
    with pytest.raises(ValueError, match="beyond"):
        integers(np.array([1e9]), 64)


def quantised(rows, dims, parts, entries, rounds, scale):
    """Codebooks and codes by definition, without bounds."""
    held = [(i, [int(np.floor(scale * x)) for x in v], lab) for i, v, lab in rows]
    width = dims // parts
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    first = sorted(held, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v)[p] for _, v, _ in first] for p in range(parts)]
    pick = lambda x, book: min(range(len(book)), key=lambda e: (distance(x, book[e]), e))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v, _ in held:
            for p, x in enumerate(cut(v)):
                groups[p, pick(x, books[p])].append(x)
        books = [[[sum(x) // len(groups[p, e]) for x in zip(*groups[p, e], strict=True)] if (p, e) in groups else entry for e, entry in enumerate(book)] for p, book in enumerate(books)]
    out = []
    for i, v, lab in held:
        chosen = [pick(x, books[p]) for p, x in enumerate(cut(v))]
        out.append((i, "".join(f"{e:02x}" for e in chosen), sum(distance(x, books[p][e]) for p, (x, e) in enumerate(zip(cut(v), chosen, strict=True))), lab))
    return books, out


@pytest.mark.parametrize(("entries", "share"), [(1, 4096), (6, 4096), (6, 3), (256, 30)])
def test_vector_codes_are_those_of_all_distances(spark, monkeypatch, entries, share):
    monkeypatch.setattr(vector_codes, "HOT_SHARE", share)  # with 3 only the largest labels are hot, the others are joined by key
    rows, odd = some_vectors(), (960, [0.25] * 6, 1)
    found = vector_codes.compress(table(spark, rows + BAD + [odd]).repartition(3), dims=8, parts=2, entries=entries)
    books, want = quantised(rows, 8, 2, entries, 2, 256)
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    sums = Counter()
    for *_, e, lab in want:
        sums[lab] += e
    expected = Counter((i, code, e, sums[lab], digest) for i, code, e, lab in want) + Counter([(960, None, None, sums[1], digest)])
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert Counter(tuple(r) for r in found.collect()) == expected


@pytest.mark.parametrize("width", [1, 2, 3, 4, 5, 16])
def test_bounds_keep_every_nearest_entry_and_drop_most(width):
    rng = np.random.default_rng(width)
    for most in (2, 300, 1 << 27):
        book = rng.integers(-most, most + 1, (64, width))
        book[40] = book[7]  # a tie
        points = np.concatenate([rng.integers(-most, most + 1, (300, width)), book])
        every = ((points[:, None, :] - book[None]) ** 2).sum(axis=2)
        at, d, taken = vector_codes.nearest(points, vector_codes.Segments(book))
        assert (at == every.argmin(axis=1)).all() and (d == every.min(axis=1)).all()
        assert len(points) < taken and (width != 4 or most == 2 or taken < 0.5 * every.size)


def test_lower_bounds_never_exceed_distances():
    rng = np.random.default_rng(5)
    points, book = rng.integers(-500, 500, (200, 8)), vector_codes.Segments(rng.integers(-500, 500, (30, 8)))
    some, exact = vector_codes.Segments(points), ((points[:, None, :] - book.points[None]) ** 2).sum(axis=2)
    bounds = [vector_codes._bounds(k, some, book) for k in range(3)]
    assert all((b <= exact).all() for b in bounds) and bounds[0].mean() < bounds[1].mean() < bounds[2].mean()


def test_no_vectors_give_no_rows(spark):
    for rows in ([], BAD):
        held = table(spark, rows)
        assert centroids.cluster(held).count() == 0 and centroids.cluster(held).columns[0] == "vec_id"
        assert vector_codes.compress(held).count() == 0


@pytest.mark.parametrize("name", ["op11_centroids", "op13_vector_codes"])
def test_registered_vector_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.sql(ORACLE[name])
    got = QUERIES[name](spark, SF)
    order = [got.columns.index(c) for c in want.columns]
    assert Counter(tuple(r[k] for k in order) for r in got.collect()) == Counter(want.fetchall())


# -- BPE with word ends ---------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(word_bpe.VOCABULARY))


@pytest.fixture(scope="module")
def model():
    import public_tokenizers

    return word_bpe.Codec(public_tokenizers.path(word_bpe.VOCABULARY))


AWKWARD = ["it's", "DON'T", "ΟΔΥΣΣΕΥΣ", "İstanbul", "straße", "é", "́", "a\x0bb", "a\x1cb", "a\x85b", "a b", "a b", "<|endoftext|>", "<|ENDOFTEXT|>", "x<|startoftext|>y", "<|endof", "日本語", "1²3", "１２", "!!??", "'ll'", "''s", "ﬁ", "ẛ̣", "aaaaaaaaa", "ab" * 40, "\x00", "\x7f", "👩‍👧", "﻿", " ", "\t", "\r\n", "\x0c", "é", "Ç", "×÷", "ſ", "ǅ"]


def test_ids_and_decoded_texts_are_the_librarys(library, model):
    rnd = random.Random(2)
    texts = AWKWARD + ["".join(rnd.choice(AWKWARD) + rnd.choice(["", " ", "\n"]) for _ in range(rnd.randrange(12))) for _ in range(800)]
    texts += ["".join(chr(rnd.choice([rnd.randrange(1, 0x180), rnd.randrange(0x300, 0x400), rnd.randrange(0x1E00, 0x2100), rnd.randrange(0xE000, 0x1F800)])) for _ in range(rnd.randrange(30))) for _ in range(800)]
    for text, (ids, decoded) in zip(texts, model.digests([t.encode() for t in texts]), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want == model.encode(text), text
        assert decoded.decode() == library.decode(want, skip_special_tokens=False) == model.decode(want), text


def test_a_very_long_word_and_a_full_memory_change_nothing(library, monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(word_bpe, "UNITS", 20)
    monkeypatch.setattr(word_bpe, "WORDS", 10)
    monkeypatch.setattr(word_bpe, "ROW", 1000)
    small, rnd = word_bpe.Codec(public_tokenizers.path(word_bpe.VOCABULARY)), random.Random(4)
    for k in range(30):
        texts = [" ".join("".join(rnd.choice("abé") for _ in range(rnd.randrange(1, 4))) for _ in range(20)) for _ in range(3)] + [rnd.choice("ab") * 5000 + " " + "".join(rnd.choice("aeinst") for _ in range(3000))] * (k % 9 == 0)
        for text, (ids, _) in zip(texts, small.digests([t.encode() for t in texts]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(small.words) < 200 and not any(len(u) > word_bpe.KEPT_UNIT for u in [*small.units, *small.words])


def test_the_index_gives_what_merging_each_word_gives():
    rnd = random.Random(6)
    for _ in range(60):
        made, pairs = list(range(4)), []
        while len(pairs) < 12:
            p = (rnd.choice(made), rnd.choice(made))
            if p not in pairs:
                pairs.append(p)
                made.append(len(made))
        merges = word_bpe.Merges(pairs, made[4:])
        words = [[rnd.randrange(4) for _ in range(rnd.randrange(1, 14))] for _ in range(40)]
        row = merges.apply(np.array([-1, *(x for w in words for x in [*w, -1])], np.int64))
        got = [[int(x) for x in w] for w in np.split(row[row != word_bpe.TAKEN], np.flatnonzero(row[row != word_bpe.TAKEN] == -1))][1:-1]
        for w, g in zip(words, got, strict=True):
            while ranks := [pairs.index(p) for p in zip(w, w[1:], strict=False) if p in pairs]:
                r = min(ranks)
                at = next(k for k, p in enumerate(zip(w, w[1:], strict=False)) if p == pairs[r])
                w = [*w[:at], 4 + r, *w[at + 2 :]]
            assert [x for x in g if x >= 0] == w
    with pytest.raises(ValueError, match="two merges"):
        word_bpe.Merges([(0, 1), (1, 0)], [5, 5])
    with pytest.raises(ValueError, match="before it is made"):
        word_bpe.Merges([(6, 1), (1, 0)], [5, 6])


def test_round_trip_of_awkward_rows(spark, library):
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "Hello, World's end"), (4, "Hello, World's end"), (None, "é" * 3000), (5, "x " * 20000)]
    docs = spark.createDataFrame([(i, t, "n", 0) for i, t in rows], "doc_id long, text string, ids string, n_tokens int")
    want = Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in word_bpe.round_trip(docs).collect()) == want
    assert word_bpe.round_trip(docs.limit(0)).count() == 0
    both = word_bpe.decode(word_bpe.encode(docs)).collect()
    assert {(r["doc_id"], r["decoded"]) for r in both} == {(i, library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)) for i, t in rows}


def test_registered_query_equals_the_library_on_whole_documents(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op12_word_bpe"](spark, SF).collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
