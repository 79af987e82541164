"""Line dedup with a log-template tree of fixed depth, in DataFrame functions only.

A line's tokens lead it down the tree: their number, then the first `LEAD` of them (a shorter line
has all of its own). A token with a digit is a variable field, written `<*>`. In a leaf that
`MIN_DOCS` documents or more reach, a token is fixed if, over the distinct lines with it at its place,
their documents add up to `MIN_DOCS`; another token is a variable field too. What remains is the
line's template. A template is recurring if it is in `MIN_DOCS` documents or more and the fixed
tokens, those of the lead included, are `MIN_SHARE` of the line's tokens without a digit, one at
least. So lines of fewer than ten tokens must agree in all but their digits. A recurring template's lines
stay in its first document (smallest id, then digest of the text) and are dropped from all others.

Lines without a word, and lines of digits alone, stay. `MIN_DOCS` is the support a template needs: a line
in fewer documents isn't a recurring one.

Only hashes of lines and tokens are shuffled; tokens meet once for each distinct line of a leaf. The
flagged line numbers then meet their document once.

Defined cases: null texts count as empty; a document is a row's id and text, so rows with one id and
different texts, or without an id, are documents of their own, and equal rows are treated alike; a
null id comes after all others; a document whose lines all go keeps an empty text; an empty
table gives an empty result; `apply` keeps the input's columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LAST_ID, cut, read_table, slim, text_of
from .quality_rules import let

LEAD, MIN_DOCS, MIN_SHARE = 3, 5, 0.9
SPACE_RUN = r"[\x20\x09-\x0D]+"
FIELD = r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*"
ANY = "<*>"


def _key(id_col: str, text_col: str) -> list[Column]:
    """What tells documents apart: id, a null one last, and a digest of the text."""
    return [F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST_ID)).alias("doc"), F.xxhash64(text_of(text_col)).alias("digest")]


def parsed(line: Column) -> Column:
    """Leaf, hash, token hashes and number of tokens without a digit of a line; null for a line without such."""
    masked = F.when(line.rlike("[0-9]"), F.regexp_replace(line, FIELD, ANY)).otherwise(line)

    def parts(w: Column) -> Column:
        n = F.size(w)
        plain = n - F.size(F.filter(w, lambda x: x == ANY))
        leaf = F.xxhash64(n, F.array_join(F.slice(w, 1, LEAD), " "))
        return F.when(plain > 0, F.struct(leaf.alias("leaf"), F.xxhash64(F.array_join(w, " ")).alias("line"), F.transform(w, lambda x: F.when(x == ANY, F.lit(0)).otherwise(F.hash(x))).alias("tokens")))

    return let(F.array_remove(F.split(masked, SPACE_RUN), ""), parts)


def lines(docs: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """doc, digest, line number, leaf, line hash and token hashes of every line that can be dropped."""
    base = slim(docs, id_col, text_col).select(*_key(id_col, text_col), F.split(text_of(text_col), "\n", -1).alias("l"))
    found = base.select("doc", "digest", F.posexplode(F.transform("l", parsed)).alias("no", "p")).where("p is not null")
    return found.select("doc", "digest", "no", "p.leaf", "p.line", "p.tokens")


def templates(inside: DataFrame, min_docs: int, min_share: float) -> DataFrame:
    """leaf, line and template of the distinct lines of crowded leaves, if enough of their tokens are fixed."""
    held = inside.select("leaf", "line", "tokens", "doc", "digest").distinct().groupBy("leaf", "line", "tokens").agg(F.count("*").alias("docs"))
    held = cut(held)
    placed = held.select("leaf", "line", "docs", F.posexplode("tokens").alias("at", "token")).where(F.col("token") != 0)
    fixed = cut(placed.groupBy("leaf", "at", "token").agg(F.sum("docs").alias("m")).where(F.col("m") >= min_docs).select("leaf", "at", "token", F.lit(1).alias("fixed")))
    marked = placed.join(fixed, ["leaf", "at", "token"], "left")
    own = F.bit_xor(F.when(F.col("fixed") == 1, F.xxhash64("at", "token")).otherwise(F.lit(0)))
    agreed = marked.groupBy("leaf", "line").agg(own.alias("own"), F.count("fixed").alias("n_fixed"), F.count("*").alias("n"))
    return agreed.where((F.col("n_fixed") >= F.col("n") * min_share) & (F.col("n_fixed") > 0)).select("leaf", "line", F.xxhash64("leaf", "own").alias("template"))


def flagged(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """doc, digest and `gone`: the numbers of the document's lines that go."""
    known = cut(lines(docs, id_col=id_col, text_col=text_col))
    # The small sides are cut, so that the joins deal both sides anew and a crowded leaf can be split.
    leaves = cut(known.select("leaf", "doc", "digest").distinct().groupBy("leaf").count().where(F.col("count") >= min_docs).select("leaf"))
    inside = cut(known.join(leaves, "leaf"))
    lined = cut(inside.drop("tokens").join(cut(templates(inside, min_docs, min_share)), ["leaf", "line"]).select("doc", "digest", "no", "template"))
    each = lined.select("template", "doc", "digest").distinct()
    recurring = cut(each.groupBy("template").agg(F.count("*").alias("docs"), F.min(F.struct("doc", "digest")).alias("first")).where(F.col("docs") >= min_docs))
    return lined.join(recurring, "template").where(F.struct("doc", "digest") > F.col("first")).groupBy("doc", "digest").agg(F.collect_set("no").alias("gone"))


def _kept(text: Column, gone: Column) -> Column:
    held = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(gone, i)), "\n")
    return F.when(gone.isNull(), text).otherwise(held)


def apply(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """The input with its texts shortened; a null text stays null."""
    found = flagged(docs, id_col=id_col, text_col=text_col, min_docs=min_docs, min_share=min_share)
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_key(id_col, text_col)).join(found, ["doc", "digest"], "left")
    own = {c: F.col("row").getField(c) for c in docs.columns}
    return held.select(*[(F.when(own[c].isNotNull(), _kept(own[c].cast("string"), F.col("gone"))) if c == text_col else own[c]).alias(c) for c in docs.columns])


def op6_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed and the digest of the kept text of every document."""
    docs = read_table(spark, sf_dir, "documents")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("t"), *_key("doc_id", "text"))
    n = F.size(F.split("t", "\n", -1)).cast("long")
    return base.join(flagged(docs), ["doc", "digest"], "left").select("doc_id", n.alias("n_lines"), F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("long").alias("n_removed"), F.sha2(_kept(F.col("t"), F.col("gone")), 256).alias("kept_sha256"))


#: From the definition, with the tokens themselves in place of hashes.
ORACLE_SQL = f"""
WITH l AS (
  SELECT doc_id, generate_subscripts(ls, 1) - 1 AS no, unnest(ls) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), w AS (
  SELECT doc_id, no, list_filter(regexp_split_to_array(regexp_replace(line, '{FIELD}', '{ANY}', 'g'), '{SPACE_RUN}'), lambda x: x <> '') AS w FROM l
), p AS (
  SELECT doc_id, no, w, len(w) AS n, w[1:{LEAD}] AS lead FROM w WHERE len(list_filter(w, lambda x: x <> '{ANY}')) > 0
), c AS (
  SELECT p.* FROM p JOIN (SELECT n, lead FROM p GROUP BY n, lead HAVING count(DISTINCT doc_id) >= {MIN_DOCS}) USING (n, lead)
), d AS (
  SELECT n, lead, w, count(DISTINCT doc_id) AS docs FROM c GROUP BY n, lead, w
), u AS (
  SELECT n, lead, w, docs, unnest(range(1, n + 1)) AS k FROM d
), t AS (
  SELECT n, lead, w, docs, k, w[k] AS token FROM u WHERE w[k] <> '{ANY}'
), f AS (
  SELECT n, lead, k, token FROM t GROUP BY n, lead, k, token HAVING sum(docs) >= {MIN_DOCS}
), m AS (
  SELECT t.n, t.lead, t.w, list([CAST(t.k AS VARCHAR), t.token] ORDER BY t.k) FILTER (f.token IS NOT NULL) AS template
  FROM t LEFT JOIN f ON t.n = f.n AND t.lead = f.lead AND t.k = f.k AND t.token = f.token
  GROUP BY t.n, t.lead, t.w HAVING count(f.token) > 0 AND count(f.token) >= {MIN_SHARE} * count(*)
), x AS (
  SELECT c.doc_id, c.no, c.n, c.lead, m.template FROM c JOIN m ON c.n = m.n AND c.lead = m.lead AND c.w = m.w
), r AS (
  SELECT n, lead, template, min(doc_id) AS first_doc FROM x GROUP BY n, lead, template HAVING count(DISTINCT doc_id) >= {MIN_DOCS}
), g AS (
  SELECT doc_id, no FROM x JOIN r USING (n, lead, template) WHERE doc_id > first_doc
)
SELECT l.doc_id, count(*) AS n_lines, count(g.no) AS n_removed, sha256(coalesce(string_agg(CASE WHEN g.no IS NULL THEN line END, chr(10) ORDER BY l.no), '')) AS kept_sha256
FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.no = g.no GROUP BY l.doc_id
"""
