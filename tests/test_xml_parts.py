"""XML documents in pieces against the mapper of whole documents."""

from __future__ import annotations

import json
import random

from quillgrove.functions import markup, trees
from quillgrove.sources import xml_parts

COLUMNS = ("pos", "depth", "parent_pos", "ord", "t", "n_children", "malformed", "last_pos")
STANDARD = """<rfc number="3"><front><title>T</title><author fullname="A B"/><abstract><t>Abs</t></abstract></front><middle>loose <em>words</em> first
%s</middle><back><references><name>Refs</name><reference anchor="R1"><front><title>Ref</title></front></reference></references><section anchor="s1"><t>again <xref target="R1"/></t></section></back></rfc>"""
ARTICLE = '<article xmlns:xlink="http://www.w3.org/1999/xlink"><front><article-meta><title-group><article-title>T</article-title></title-group></article-meta></front><body><p>lead</p>%s</body><back><fn-group><fn><p>last</p></fn></fn-group><ref-list><ref id="b1"><mixed-citation>Book</mixed-citation></ref></ref-list></back></article>'
LAW = '<Legislation><Metadata><Year Value="1999"/><title>Act</title></Metadata><Contents><ContentsPart><ContentsTitle>One</ContentsTitle></ContentsPart></Contents><Primary><Body>%s</Body></Primary><Commentaries><Commentary id="c1"><Para><Text>comment</Text></Para></Commentary><Commentary><Para><Text>other</Text></Para></Commentary></Commentaries></Legislation>'


def documents(seed):
    rnd = random.Random(seed)

    def standard(depth=0):
        parts = [rnd.choice(["<t>x <xref target='s%d'/> y<sup>2</sup></t>" % rnd.randrange(6), "<t/>", "tail words", "<odd>kept</odd>", "<ul><li>a</li></ul>", "<t>see <xref target='gone'><em>this</em></xref></t>"]) for _ in range(rnd.randrange(4))]
        return f"<section anchor='s{rnd.randrange(6)}'><name>N</name>{''.join(parts)}{standard(depth + 1) if depth < 3 and rnd.random() < 0.5 else ''}</section>" + rnd.choice(["", " between ", "<em>also</em> loose"])

    def article():
        return f"<sec id='s{rnd.randrange(4)}'><title>N</title><p>x <xref ref-type='bibr' rid='b1'>1</xref> <xref ref-type='fn' rid='f{rnd.randrange(3)}'/> z</p>{rnd.choice(['<fn><p>n</p></fn>', '<fn id="f1"><p>m</p></fn>', ''])}</sec>"

    def law():
        return f"<Part id='p{rnd.randrange(3)}'><Number>1</Number><Title>Of things</Title><P1 id='q{rnd.randrange(5)}'><Pnumber>1</Pnumber><P1para><Text>Shall <CommentaryRef Ref='c{rnd.randrange(3)}'/></Text></P1para></P1></Part>"

    many = lambda f: "".join(f() for _ in range(rnd.randrange(7)))
    return {"standards": STANDARD % many(standard), "articles": ARTICLE % many(article), "laws": LAW % many(law)}


def test_pieces_give_what_the_whole_gives(spark):
    made = {f"d{i}": documents(i) for i in range(25)}
    for genre in markup.GENRES:
        rows = spark.createDataFrame([(k, d[genre]) for k, d in made.items()] + [("broken", "<rfc><middle>"), ("none", None)], "k string, x string")
        nodes, found = xml_parts.xml_in_parts(rows, "x", genre, id_col="k", partitions=3)
        got: dict = {}
        for r in nodes.orderBy("doc_id", "pos").collect():
            got.setdefault(r["doc_id"], []).append({c: r[c] for c in COLUMNS} | {"fields": sorted(map(tuple, r["fields"]))})
        counts: dict = {}
        for r in found.collect():
            counts.setdefault(r["doc_id"], {})[r["key"]] = r["n"]
        assert counts.pop("broken") == counts.pop("none") == {"unreadable": 1}
        assert set(got) == set(made)
        dropped = 0
        for k, d in made.items():
            doc, want = markup.xml_document(d[genre].encode(), genre, f"urn:{genre}:{k}")
            flat = trees.flattened(json.loads(json.dumps(doc)))
            assert got[k] == [{c: r[c] for c in COLUMNS} | {"fields": sorted((f["name"], f["kind"], f["value"]) for f in r["fields"])} for r in flat], (genre, k)
            assert counts.get(k, {}) == want, (genre, k)
            dropped += want.get("ids dropped", 0) * want.get("references dropped", 0)
        assert dropped or genre == "laws"


def test_pieces_are_cut_at_sections():
    raw = STANDARD % "".join(f"<section anchor='a{i}'><t>x</t></section>" for i in range(5))
    fields, cited, found = markup.pieces(raw.encode(), "standards", "urn:a:b")
    assert fields["title"] == "T" and cited == {"R1"}
    assert [k for k, _ in found] == ["front", "blocks", *["blocks"] * 5, "blocks", "blocks"]


def test_small_sections_share_a_piece():
    raw = (STANDARD % "".join(f"<section anchor='a{i}'><t>x &amp; <em>y</em></t></section> tail &lt; " for i in range(50))).encode()
    _, _, one = markup.pieces(raw, "standards", "urn:a:b")
    _, _, few = markup.pieces(raw, "standards", "urn:a:b", 1000)
    assert len(few) < len(one) / 3
    blocks = lambda found: [k for kind, content in found for k in markup.piece_nodes(kind, content, "standards", {"R1"})[0]]
    assert blocks(few) == blocks(one)


def test_rows_go_as_by_a_rewrite(spark, monkeypatch):
    from pyspark.sql import functions as F

    from quillgrove.operators import nodes, rewrite

    rnd = random.Random(2)

    def tree(depth=0):
        return {"t": rnd.choice("ab"), "v": str(rnd.random()), **({"c": [tree(depth + 1) for _ in range(rnd.randrange(4))]} if depth < 6 else {})}

    monkeypatch.setattr(rewrite, "ROWS_AT_ONCE", 40)
    n = nodes.from_trees(spark.createDataFrame([(f"d{i:02}", json.dumps({"t": "root", "c": [tree()]})) for i in range(40)], "doc_id string, raw string")).cache()
    stays = (F.col("t") != "b") | (F.col("depth") == 0)
    want = rewrite.rewritten(rewrite.asked(n, stays=stays, inside=F.when(stays, 0).otherwise(-1)))
    got = rewrite.left(n, stays)
    key = lambda r: (r["doc_id"], r["pos"])
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key) and got.count() < n.count()
    assert rewrite.left(n.limit(0), stays).count() == 0


def test_pieces_are_shuffled_by_document_once(spark, monkeypatch):
    """whole rows were kept five times and shuffled for ids, for references and for the rewrite."""
    keeps = []
    real = xml_parts.kept
    monkeypatch.setattr(xml_parts, "kept", lambda df, *how: keeps.append(df) or real(df, *how))
    rows = spark.createDataFrame([(k, documents(k)["standards"]) for k in range(3)], "k long, x string")
    nodes, _ = xml_parts.xml_in_parts(rows, "x", "standards", id_col="k", partitions=3)
    assert nodes.count() and len(keeps) == 2
    plans = [k._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0] for k in keeps]
    assert [p.count("Exchange hashpartitioning") for p in plans] == [1, 1] and "Join" not in plans[1]
