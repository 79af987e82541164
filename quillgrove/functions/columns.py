"""Scalar functions as column expressions; all run in the JVM but `is_nfc`."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The field that a reader sees, by element; the schemes that a link may have.
SEEN = {"media": "alt", "submit": "label", "field": "label", "disclosure": "summary", "tab": "label", "rendering": "fallback", "admonition": "kind", "quote": "source"}
SCHEMES = ("http", "https", "mailto", "urn", "tel", "ftp", "ftps")
ELSEWHERE = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:|//|\\)"
CONTROL = r"[\x00-\x1f\x7f-\x9f  ]"
SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.\-]*):"
BLANK = r"^[\s\x1c-\x1f\x85   -     　]*$"


#: Below this every string is in NFC: the first combining character is U+0300, as is the first that composes or is replaced.
WIDE = r"[^\x{0}-\x{2FF}]"


def blank(s: Column) -> Column:
    return s.rlike(BLANK)


def leads_elsewhere(s: Column) -> Column:
    """Whether a path names a scheme or a host."""
    return s.rlike(ELSEWHERE)


def safe_iri(s: Column) -> Column:
    """No control characters, and no scheme or an allowed one."""
    scheme = F.lower(F.regexp_extract(s, SCHEME, 1))
    return s.isNotNull() & ~s.rlike(CONTROL) & ((scheme == "") | scheme.isin(*SCHEMES))


def squeezed(s: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def anchor(s: Column) -> Column:
    made = F.regexp_replace(F.coalesce(s, F.lit("")), r"[^A-Za-z0-9_.:-]", "-")
    return F.when(made == "", "x").otherwise(made)


def slug(s: Column) -> Column:
    return F.regexp_replace(F.lower(s), r"[^a-z0-9]+", "-")


def cache_key(url: Column, length: int = 80) -> Column:
    return F.left(F.regexp_replace(url, r"[^A-Za-z0-9]+", "_"), F.lit(length))


def host(url: Column) -> Column:
    """Authority of a URL, with port and user."""
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1)


def query_links(markup: Column, most: int = 5) -> Column:
    """`key=value` of the first links that carry a query."""
    return F.slice(F.regexp_extract_all(markup, F.lit(r'href="[^"]*\?([a-zA-Z0-9_]+=[^"&]{1,40})"'), F.lit(1)), 1, most)


def stripped(markup: Column) -> Column:
    """Text that is left without scripts, styles and tags."""
    bare = F.regexp_replace(F.regexp_replace(markup, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), r"(?s)<[^>]+>", " ")
    return squeezed(bare)


def fetched(markup: Column) -> Column:
    """How many subresources a page makes a browser fetch."""
    return F.size(F.regexp_extract_all(markup, F.lit(r"(?i)<(?:img|script|iframe|source|video|audio|embed)\b[^>]*\bsrc\s*=|<link\b[^>]*\brel\s*=\s*\"?(?:stylesheet|preload|icon)"), F.lit(0)))


def escaped(s: Column, quotes: bool = True) -> Column:
    """HTML escapes; the ampersand first."""
    out = s
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *((('"', "&quot;"), ("'", "&#x27;")) if quotes else ())):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def label_for(key: Column, names: dict[str, str] | None = None) -> Column:
    """The key's name, else its camel-case parts: first letter large, the rest small."""
    parts = F.regexp_replace(key, r"(?<!^)(?=[A-Z])", " ")
    made = F.concat(F.upper(F.left(parts, F.lit(1))), F.lower(F.substring(parts, 2, 1 << 20)))
    for k, v in (names or {}).items():
        made = F.when(key == k, v).otherwise(made)
    return made


def decimal_scale(lexeme: Column) -> Column:
    """Digits after the point of a plain decimal as it was written."""
    return F.length(F.regexp_extract(lexeme, r"\.(\d+)$", 1))


def decimal_significand(lexeme: Column) -> Column:
    return F.replace(lexeme, F.lit("."), F.lit("")).cast("decimal(38,0)")


def quantity_text(significand: Column, scale: Column, unit: Column) -> Column:
    """Sign, digits padded to one before the point, the point, and the unit."""
    digits = F.abs(significand).cast("string")
    digits = F.when(F.length(digits) <= scale, F.concat(F.repeat(F.lit("0"), scale + 1 - F.length(digits)), digits)).otherwise(digits)
    number = F.when(scale == 0, digits).otherwise(F.concat(F.left(digits, F.length(digits) - scale), F.lit("."), F.right(digits, scale)))
    return F.trim(F.concat(F.when(significand < 0, "-").otherwise(""), number, F.lit(" "), F.coalesce(unit, F.lit(""))))


def power_text(base: Column, exponent: Column) -> Column:
    return F.concat_ws("^", base, exponent)


def day(ms: Column) -> Column:
    """Date of milliseconds since 1970, in UTC whatever the session's zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / 86_400_000).cast("int")).cast("string")


def second(ms: Column) -> Column:
    s = F.pmod(F.floor(ms / 1000), F.lit(86_400))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat(day(ms), F.lit("T"), two(F.floor(s / 3600)), F.lit(":"), two(F.floor(s / 60) % 60), F.lit(":"), two(s % 60), F.lit("Z"))


def entity_label(label: Column, uid: Column) -> Column:
    """`label (uid)`, or the uid where nothing is known of it."""
    return F.coalesce(F.concat(label, F.lit(" ("), uid.cast("string"), F.lit(")")), uid.cast("string"))


def floor_percent(part: Column, whole: Column) -> Column:
    return F.floor(part * 100 / F.greatest(whole, F.lit(1))).cast("long")


def accepted(header: Column) -> Column:
    """Media ranges of an Accept header, best first: by q, then specificity, then place."""
    parts = F.transform(F.split(header, ","), lambda p, i: F.struct(F.trim(p).alias("p"), i.alias("i")))
    parts = F.filter(parts, lambda x: x["p"] != "")

    def ranked(x: Column) -> Column:
        kind = F.lower(F.trim(F.get(F.split(x["p"], ";"), F.lit(0))))
        written = F.regexp_extract(x["p"], r"(?i);\s*q=\s*([^;\s]*)", 1)
        q = F.when(~x["p"].rlike(r"(?i);\s*q="), 1.0).otherwise(F.coalesce(written.try_cast("double"), F.lit(0.0)))
        general = F.when(kind == "*/*", 2).when(kind.endswith("/*"), 1).otherwise(0)
        return F.struct((-q).alias("less"), general.alias("general"), x["i"].alias("i"), kind.alias("kind"))

    return F.transform(F.array_sort(F.transform(parts, ranked)), lambda x: F.struct(x["kind"].alias("kind"), (-x["less"]).alias("q")))


def negotiated(header: Column, available: list[str]) -> Column:
    """The representation to send, the first for an empty header, null if none will do."""
    offers = F.array(*[F.lit(a) for a in available])
    fits = lambda r: F.get(F.filter(offers, lambda a: (r["kind"] == a) | (r["kind"] == "*/*") | (r["kind"].endswith("/*") & a.startswith(F.regexp_replace(r["kind"], r"\*$", "")))), F.lit(0))
    found = F.filter(F.transform(F.filter(accepted(header), lambda r: r["q"] > 0), fits), lambda x: x.isNotNull())
    return F.when(F.coalesce(F.trim(header), F.lit("")) == "", available[0]).otherwise(F.get(found, F.lit(0)))


def is_nfc(s: Column) -> Column:
    """Python is asked only for texts beyond ASCII."""

    @F.pandas_udf("boolean")
    def normal(v: pd.Series) -> pd.Series:
        return v.map(lambda x: x is None or unicodedata.is_normalized("NFC", x))

    return F.when(s.rlike(r"[^\x00-\x7F]"), normal(s)).otherwise(F.lit(True))


def nfc_each(texts: Column) -> Column:
    """An array of texts in NFC; in Python, as the JVM's functions have no normal forms."""

    @F.pandas_udf("array<string>")
    def normal(v: pd.Series) -> pd.Series:
        return v.map(lambda xs: None if xs is None else [None if x is None else unicodedata.normalize("NFC", x) for x in xs])

    return normal(texts)


def stripped_right(s: Column) -> Column:
    return F.regexp_replace(s, BLANK[1:-2] + r"+\z", "")


#: What makes a client fetch, relations of links that don't, attributes that are fetched, and what an emitter must never write.
FETCHERS = r"(?i)<\s*(?:script|iframe|embed|object|base)\b|@import\b|\burl\s*\("
LINK_TAG = r"(?i)<\s*link\b[^>]*>"
LINK_REL = r'(?i)\brel\s*=\s*"([^"]*)"'
NOT_FETCHED = ("alternate", "canonical", "author", "license", "next", "prev", "help", "search", "bookmark", "nofollow")
FETCHED_ATTRIBUTE = r'(?i)\b(?:src|srcset|poster|background)\s*=\s*"([^"]*)"'
NAMES_A_HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:|//)"
EXECUTABLE = ("javascript:", "vbscript:", "<script", "onerror=", "data:text/html")


def fetchers(markup: Column) -> Column:
    """What in a page makes a client fetch: elements and rules, and links with a relation that isn't known to be harmless."""

    def fetched_link(link: Column) -> Column:
        relations = F.filter(F.split(F.lower(F.regexp_extract(link, LINK_REL, 1)), r"\s+"), lambda r: r != "")
        return (F.size(relations) == 0) | F.exists(relations, lambda r: ~r.isin(*NOT_FETCHED))

    every = lambda pattern: F.regexp_extract_all(markup, F.lit(pattern), F.lit(0))
    return F.concat(every(FETCHERS), F.filter(every(LINK_TAG), fetched_link))


def named_hosts(markup: Column) -> Column:
    """Subresources of a page that name a scheme or a host."""
    return F.filter(F.regexp_extract_all(markup, F.lit(FETCHED_ATTRIBUTE), F.lit(1)), lambda v: v.rlike(NAMES_A_HOST))


def executable(markup: Column) -> Column:
    """What in a page could run at a client."""
    low = F.lower(markup)
    return F.filter(F.array(*[F.lit(x) for x in EXECUTABLE]), lambda x: F.contains(low, x))
