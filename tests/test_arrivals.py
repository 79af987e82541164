"""The paged source on a folder of bodies, and documents that arrive in batches."""

from __future__ import annotations

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from quillgrove.operators import nodes
from quillgrove.sources import paged, readers
from quillgrove.streaming import arrivals


def bodies(page):
    return b'{"decisions": [{"ada": "A%d", "amount": 6200.50, "n": 1e3}, {"ada": "B%d", "list": [1.10]}]}' % (page, page)


def read(spark, folder, **options):
    r = spark.read.format("paged").option("items", "decisions").option("cache", folder)
    for k, v in options.items():
        r = r.option(k, v)
    return r.load()


def test_pages_are_read_from_the_cache(spark, tmp_path):
    spark.dataSource.register(paged.Paged)
    folder = f"file://{tmp_path}/bodies"
    paged.cached_pages({0: bodies(0), 7: bodies(7), 14: b"{broken", 21: b'{"decisions": []}'}, folder)
    held = read(spark, folder, pages=5, apart=7, fetch="never")
    assert held.rdd.getNumPartitions() == 5
    rows = {(r["page"], r["nth"]): r for r in held.collect()}
    assert set(rows) == {(0, 0), (0, 1), (7, 0), (7, 1), (14, None), (28, None)}
    assert json.loads(rows[7, 1]["item"])["ada"] == "B7" and '"amount": 6200.50' in rows[0, 0]["item"] and "1e3" in rows[0, 0]["item"]
    assert "JSONDecodeError" in rows[14, None]["error"] and "isn't kept" in rows[28, None]["error"]
    docs = readers.records_of(held.where("error is null").select(F.concat_ws("-", "page", "nth").alias("key"), "item"), "item", id_col="key")
    assert nodes.from_trees(docs).where("t = 'document'").count() == 4
    with pytest.raises(Exception, match="needs"):
        read(spark, folder, fetch="never").collect()


def test_pages_are_asked_for_once(spark, tmp_path):
    spark.dataSource.register(paged.Paged)
    asked = []

    class Service(BaseHTTPRequestHandler):
        def do_GET(self):
            page = int(self.path.rpartition("=")[2])
            asked.append(page)
            self.send_response(200 if page < 2 else 500)
            self.end_headers()
            self.wfile.write(bodies(page))

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    how = {"url": f"http://127.0.0.1:{server.server_port}/search?size={{size}}&page={{page}}", "pages": 3, "pause": 0}
    first = Counter(map(tuple, read(spark, f"file://{tmp_path}/kept", **how).collect()))
    server.shutdown()
    assert sorted(asked) == [0, 1, 2] and sum(1 for r in first if r[3]) == 1
    again = Counter(map(tuple, read(spark, f"file://{tmp_path}/kept", pages=3, fetch="never").collect()))
    assert {r for r in again if not r[3]} == {r for r in first if not r[3]}


def test_bodies_by_key(spark, tmp_path):
    from quillgrove.functions import columns as C
    from quillgrove.sources import fetched

    folder, asked = f"file://{tmp_path}/xml", []

    class Service(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            self.send_response(404 if "404" in self.path else 200)
            self.end_headers()
            self.wfile.write(b"<rfc><middle><t>%s</t></middle></rfc>" % self.path[1:].encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    keys = spark.createDataFrame([("9",), ("404",), (None,), ("21",)], "number string").repartition(2)
    first = {r["doc_id"]: r for r in fetched.fetched(keys, folder, key_col="number", url=f"http://127.0.0.1:{server.server_port}/rfc{{key}}.xml", pause=0, suffix=".xml").collect()}
    server.shutdown()
    assert sorted(asked) == ["/rfc21.xml", "/rfc404.xml", "/rfc9.xml"] and first["404"]["raw"] is None and "404" in first["404"]["error"] and "no key" in first[None]["error"]
    again = fetched.fetched(keys, folder, key_col="number", fetch="never", suffix=".xml")
    assert {r["doc_id"]: r["raw"] for r in again.collect()} == {k: r["raw"] for k, r in first.items()}
    mapped = readers.xml_of(again.where("error is null"), "raw", "standards", id_col="doc_id")
    assert nodes.from_trees(mapped).where("t = 'document'").count() == 2
    url = "https://a.example/x?y=1&z=" + "q" * 90
    name = spark.createDataFrame([(url,)], "u string").select(C.cache_key(F.col("u"))).first()[0]
    assert name == fetched.sanitised(url) and len(name) == 80
    pages = spark.createDataFrame([('{"id": "PMC1"}',), ('{"id": "PMC2"}',), ('{"id": "PMC1"}',), ("{}",), (None,)], "item string")
    assert sorted(r["key"] for r in fetched.discovered(pages, "$.id").collect()) == ["PMC1", "PMC2"]


def plain_totals(rows, gap):
    """By definition: (doc, start) to (last, nodes, repeated, counts)."""
    out, open_ = {}, {}
    for doc, s, t, ident in sorted(rows, key=lambda r: r[1]):
        if doc in open_ and s - out[doc, open_[doc]][0] > gap:
            del open_[doc]
        start = open_.setdefault(doc, s)
        last, n, again, counts, ids = out.get((doc, start), (s, 0, 0, Counter(), Counter()))
        out[doc, start] = (max(last, s), n + 1, again + (ident is not None and ids[ident] > 0), counts + Counter([t]), ids + Counter([ident] if ident is not None else []))
    return {k: (v[0], v[1], v[2], dict(v[3])) for k, v in out.items()}


@pytest.mark.parametrize("batches", [1, 4])
def test_totals_are_the_same_however_nodes_are_dealt(spark, tmp_path, batches):
    import random

    rnd = random.Random(3)
    rows, s = [], 0
    for _ in range(300):
        s += rnd.choice([1, 5, 40])
        rows.append((f"d{rnd.randrange(5)}", s, rnd.choice(["section", "text"]), rnd.choice(["a", "b", "c", None])))
    table = spark.createDataFrame(rows, "doc_id string, s long, t string, id string").select("doc_id", F.timestamp_seconds("s").alias("ts"), "t", "id")
    folder = str(tmp_path / "run")
    found = arrivals.replayed(table, lambda: spark.readStream.schema(table.schema).parquet(f"{folder}/nodes"), batches, folder, gap_seconds=100)
    got = {(r["doc_id"], r["a"]): (r["b"], r["nodes"], r["repeated"], r["elements"]) for r in found.withColumns({"a": F.unix_seconds("start"), "b": F.unix_seconds("last")}).collect()}
    assert got == plain_totals(rows, 100) and len(got) > 5
    assert arrivals.replayed(table.limit(0), None, batches, folder, gap_seconds=100).count() == 0


@pytest.mark.parametrize("most", [2, 1000])
def test_a_documents_batch_makes_few_state_calls(most):
    import random

    from pyspark.sql import Row

    calls = []

    class State(dict):
        value = None

        def get(self):
            calls.append("get")
            return self.value

        def update(self, value):
            calls.append("update")
            self.value = value

        def clear(self):
            calls.append("clear")
            self.value = None
            dict.clear(self)

        def containsKey(self, k):
            calls.append("containsKey")
            return k in self

        def updateValue(self, k, v):
            calls.append("updateValue")
            self[k] = v

    class Handle:
        timers: set = set()

        def getMapState(self, *_):
            return State()

        getValueState = getMapState

        def registerTimer(self, ms):
            calls.append("register")
            self.timers.add(ms)

        def deleteTimer(self, ms):
            calls.append("delete")
            self.timers.remove(ms)

    rnd, s, rows = random.Random(5), 0, []
    for _ in range(600):
        s += rnd.choice([1, 2, 30, 200]) if rnd.random() < 0.1 else 1
        rows.append(("d", s, rnd.choice(["section", "text"]), rnd.choice(["a", "b", "c", "d", "e", "f", None])))
    handle, found = Handle(), {}
    state = arrivals.Arrivals(100, most)
    state.init(handle)
    for at in range(0, 600, 150):
        for r in state.handleInputRows(("d",), iter([Row(ms=s, t=t, id=i) for _, s, t, i in reversed(rows[at : at + 150])]), None):
            found[r["doc_id"], r["start"]] = (r["last"], r["nodes"], r["repeated"], r["elements"])
        assert handle.timers == {rows[at + 149][1] + 101}
    assert found == plain_totals(rows, 100) and len(found) > 3
    assert most < 1000 or len(calls) < 20
    assert (most < 1000) == ("containsKey" in calls)


def test_scans_of_pages(spark):
    from quillgrove.functions import columns as C

    html = [
        '<LINK rel="alternate author"><link rel="stylesheet"><link href="x"><p style="background: URL (a)"><Object>@import x', '<img src="//a/b.png" srcset="c.png"><video poster="https://d/e">', '<a href="JavaScript:x" onError="y">', "", "<p>plain</p>",
    ]
    rows = spark.createDataFrame([(k, h) for k, h in enumerate(html)], "k int, h string").select("k", C.fetchers(F.col("h")).alias("f"), C.named_hosts(F.col("h")).alias("n"), C.executable(F.col("h")).alias("x")).orderBy("k").collect()
    assert [len(r["f"]) for r in rows] == [5, 0, 0, 0, 0] and [r["n"] for r in rows][1] == ["//a/b.png", "https://d/e"]
    assert [sorted(r["x"]) for r in rows] == [[], [], ["javascript:", "onerror="], [], []]


def test_exports_and_crashes(spark, tmp_path):
    from quillgrove.functions import trees
    from quillgrove.operators import generate
    from quillgrove.plans.register import built_in
    from quillgrove.sources import writers

    reg = built_in()
    docs = generate.smallest_documents(spark, reg)
    writers.export(nodes.views(docs, reg), "heading", str(tmp_path / "one"))
    tree = trees.load_json("".join(r["value"] for r in spark.read.text(f"{tmp_path}/one/canonical").collect()))
    assert tree == generate.hosted("heading", reg) and spark.read.text(f"{tmp_path}/one/plain").count() > 2
    assert writers.crashes(docs).count() == 0
    hostile = generate.hostile_documents(spark, 400)
    odd = spark.createDataFrame([("a", "[1"), ("b", "null"), ("c", '{"t": "quantity", "scale": "x", "significand": 5}')], "doc_id string, raw string")
    found = writers.crashes(hostile.unionAll(odd), str(tmp_path / "crashes"))
    got = {r["doc_id"]: r for r in found.where("step = 'units'").collect()}
    assert "TypeError" in got["c"]["error"] and got["c"]["raw"].startswith("{") and "a" not in got
    assert spark.read.parquet(f"{tmp_path}/crashes").count() == found.count()


def test_statistics(spark):
    from quillgrove.operators import measures, reports

    found = spark.createDataFrame([("actions", 3), ("cross_origin", 1), ("actions", 1)], "key string, n int")
    assert tuple(reports.action_statistics(found).first()) == (4, 1, 25.0)
    assert tuple(reports.action_statistics(found.limit(0)).first()) == (0, 0, 0.0)
    pages = spark.createDataFrame([(100, 10), (101, 9), (0, 0)], "live int, said int")
    assert tuple(measures.projection_ratio(pages, "live", "said").first()) == (3, 201, 19, 90, 10.6)
    assert tuple(measures.distinct_values(spark.createDataFrame([("a", None), ("b", None), ("a", None)], "x string, y string"), "x", "y").first()) == (2, 1)
