"""Nested records as trees: maps become term lists, lists of maps tables, money quantities."""

from __future__ import annotations

import re
from collections import Counter
from datetime import UTC, datetime
from urllib.parse import quote

from .trees import Inexact, Node, text


def label_for(key: str, names: dict[str, str] | None = None) -> str:
    """The key's name, else its camel-case parts as one phrase."""
    return (names or {}).get(key) or re.sub(r"(?<!^)(?=[A-Z])", " ", key).capitalize()


def decimal_parts(lexeme: str) -> tuple[int, int]:
    """Significand and scale of a number as it was written."""
    m = re.fullmatch(r"(-?)(\d+)(?:\.(\d*))?(?:[eE]([+-]?\d+))?", lexeme)
    if not m:
        raise ValueError("not a number")
    digits, scale = int(m[2] + (m[3] or "")), len(m[3] or "") - int(m[4] or 0)
    if scale < 0:
        digits, scale = digits * 10**-scale, 0
    return (-digits if m[1] else digits), scale


def quantity(lexeme: str, unit: str, least_scale: int = 2) -> Node:
    """An amount with at least so many decimals."""
    n, scale = decimal_parts(lexeme)
    wide = max(least_scale, scale)
    return {"t": "quantity", "significand": n * 10 ** (wide - scale), "scale": wide, "unit": unit}


def paragraph(*kids: Node) -> Node:
    return {"t": "paragraph", "c": list(kids)}


def pair(label: str, *blocks: Node) -> list[Node]:
    return [{"t": "term", "c": [text(label)]}, {"t": "definition", "c": list(blocks)}]


def blocks(v: object, found: Counter, names: dict[str, str] | None = None) -> list[Node]:
    """Blocks that show a value; nothing for nulls and empty values."""
    if v is None or (isinstance(v, (str, list, dict)) and not v):
        return []
    if isinstance(v, bool):
        return [paragraph(text("yes" if v else "no"))]
    if isinstance(v, (int, str)):
        return [paragraph(text(str(v)))] if str(v).strip() else []
    if isinstance(v, Inexact):
        return [paragraph(text(v.lexeme))]
    if isinstance(v, dict):
        if "amount" in v and set(v) <= {"amount", "currency"}:
            if v["amount"] is None:
                found["amounts left out"] += 1
                return []
            lexeme = v["amount"].lexeme if isinstance(v["amount"], Inexact) else str(v["amount"])
            if not v.get("currency"):
                return [paragraph(text(lexeme))]
            found[f"scale {decimal_parts(lexeme)[1]}"] += 1
            return [paragraph(quantity(lexeme, v["currency"]))]
        pairs = [(k, blocks(x, found, names)) for k, x in v.items()]
        kids = [n for k, inner in pairs if inner for n in pair(label_for(k, names), *inner)]
        return [{"t": "term-list", "c": kids}] if kids else []
    if all(isinstance(x, dict) for x in v):
        return table(v, found, names)
    items = [inner for inner in (blocks(x, found, names) for x in v) if inner]
    return [{"t": "list", "ordered": False, "c": [{"t": "item", "c": x} for x in items]}] if items else []


def table(rows: list[dict], found: Counter, names: dict[str, str] | None = None) -> list[Node]:
    """Columns in order of first appearance; an absent value is an empty cell."""
    columns = list(dict.fromkeys(k for r in rows for k in r))
    if not columns:
        return []
    head = {"t": "table-section", "kind": "head", "c": [{"t": "row", "c": [{"t": "header-cell", "scope": "column", "c": [paragraph(text(label_for(k, names)))]} for k in columns]}]}
    body = [{"t": "row", "c": [{"t": "cell", **({"c": inner} if (inner := blocks(r.get(k), found, names)) else {})} for k in columns]} for r in rows]
    return [{"t": "table", "c": [head, {"t": "table-section", "kind": "body", "c": body}]}]


def stamp(ms: int, precision: str) -> Node:
    """A date from milliseconds since 1970, in UTC."""
    at = datetime.fromtimestamp(ms / 1000, UTC)
    return {"t": "date", "precision": precision, "value": at.strftime("%Y-%m-%d" if precision == "day" else "%Y-%m-%dT%H:%M:%SZ")}


def visible(v: object) -> list[str]:
    """Every string that a reader of the record would miss."""
    if isinstance(v, dict):
        return [s for x in v.values() for s in visible(x)]
    if isinstance(v, list):
        return [s for x in v for s in visible(x)]
    return [v.strip()] if isinstance(v, str) and v.strip() else []


def entity(uid: object, labels: dict[str, str] | None) -> str:
    """`label (uid)`, or the uid where nothing is known of it."""
    known = (labels or {}).get(str(uid))
    return f"{known} ({uid})" if known else str(uid)


def provenance_of(record: dict, pairs: tuple[tuple[str, str, str], ...], labels: dict[str, str] | None = None) -> list[tuple[str, object]]:
    """Labelled values of a record's keys, by kind: text; day or second (from milliseconds); entity (by label); each or entities (a pair for each of a list)."""
    out: list[tuple[str, object]] = []
    for label, key, kind in pairs:
        v = record.get(key)
        if v in (None, "", [], {}):
            continue
        if kind in ("day", "second"):
            out.append((label, stamp(int(v), kind)))
        elif kind in ("each", "entities"):
            out += [(label, entity(x, labels) if kind == "entities" else x) for x in (v if isinstance(v, list) else [v])]
        else:
            out.append((label, entity(v, labels) if kind == "entity" else v))
    return out


def record_document(
    record: dict, doc_id: str, title: str, provenance: list[tuple[str, object]], *, lang: str = "en", consumed: tuple[str, ...] = (), sections: str | None = None, attachments: str | None = None, signers: str | None = None,
    source: str | None = None, key: str | None = None, href: str | None = None, labels: dict[str, str] | None = None, names: dict[str, str] | None = None,
) -> tuple[Node, Counter]:
    """A record as a document: provenance, one section for each key of `sections`, documents (the source and attachments), signatures.

    An attachment without a URL is addressed through its record: `href` is a template of {key} (the value of `key`) and {id}. Signers are shown by
    their label. Keys that nothing consumed are counted as findings, never dropped in silence.
    """
    found: Counter = Counter()
    kids: list[Node] = [{"t": "heading", "level": 1, "c": [text(title)]}]
    pairs = [n for label, v in provenance for inner in [[paragraph(v)] if isinstance(v, dict) and "t" in v else blocks(v, found, names)] if inner for n in pair(label, *inner)]
    if pairs:
        kids.append({"t": "provenance", "c": pairs})
    for k, v in (record.get(sections or "") or {}).items():
        if inner := blocks(v, found, names):
            kids.append({"t": "section", "c": [{"t": "heading", "level": 2, "c": [text(label_for(k, names))]}, *inner]})
    items = []
    if source and record.get(source):
        items.append({"t": "item", "c": [paragraph({"t": "link", "href": record[source], "c": [text("Source document")]})]})
    for a in record.get(attachments or "") or []:
        if not isinstance(a, dict):
            items.append({"t": "item", "c": [paragraph(text(str(a)))]})
            continue
        name = str(a.get("description") or a.get("filename") or "Attachment")
        at = a.get("url") or (href.format(key=quote(str(record[key])), id=a["id"]) if href and key and record.get(key) and a.get("id") not in (None, "") else None)
        detail = [n for k in ("filename", "mimeType", "size", "checksum", "id") if (inner := blocks(a.get(k), found, names)) for n in pair(label_for(k, names), *inner)]
        items.append({"t": "item", "c": [paragraph({"t": "link", "href": at, "c": [text(name)]} if at else text(name)), *([{"t": "term-list", "c": detail}] if detail else [])]})
    if items:
        kids.append({"t": "section", "c": [{"t": "heading", "level": 2, "c": [text("Documents")]}, {"t": "list", "ordered": False, "c": items}]})
    signed = [n for s in record.get(signers or "") or [] for n in pair("Signed by", paragraph(text(entity(s, labels))))]
    if signed:
        kids.append({"t": "signature-block", "c": signed})
    for k, v in record.items():
        if k not in (*consumed, sections, attachments, signers, source, key) and v not in (None, "", [], {}):
            found[f"unmapped {k}"] += 1
    return {"t": "document", "id": doc_id, "lang": lang, "title": title, "c": kids}, found
