"""XML of three genres as trees: internet standards, journal articles and legislation.

A dialect is a table from tag to rule; the rules are shared. What no rule takes is counted
as an escape and its text is kept. Afterwards ids are made unique and references to ids
that don't exist are replaced by what they enclose.
"""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from .trees import Node, fields_of, fold, kind_of, pruned, safe_iri, text, walk

LINK = "{http://www.w3.org/1999/xlink}href"


def tag(el: ET.Element) -> str:
    return el.tag.rpartition("}")[2] if isinstance(el.tag, str) else ""


def clean(s: str | None) -> str:
    return re.sub(r"\s+", " ", s or "").strip()


def anchor(s: str | None) -> str:
    """An id of letters, digits and `_.:-`."""
    return re.sub(r"[^A-Za-z0-9_.:-]", "-", s or "") or "x"


def all_text(el: ET.Element) -> str:
    return clean("".join(el.itertext()))


def spaced(groups: list[list[Node]]) -> list[Node]:
    """Inline groups one after another, a space between two in the text that stands there."""
    out: list[Node] = []
    for group in filter(None, map(pruned, groups)):
        if out and kind_of(out[-1]) == "text":
            out[-1] = text(out[-1]["v"] + " ")
        elif out and kind_of(group[0]) == "text":
            group = [text(" " + group[0]["v"]), *group[1:]]
        out += group
    return out


def said(el: ET.Element, d: "Dialect") -> str:
    """What an element shows that is in an attribute."""
    return next((clean(el.get(k)) for k in d.said.get(tag(el), ()) if clean(el.get(k))), "")


@dataclass(frozen=True)
class Dialect:
    """Tags by what they become."""

    wrap: dict[str, str] = field(default_factory=dict)  # inline element
    through: frozenset = frozenset()  # inline or block: only the content
    skip: frozenset = frozenset()
    inline: dict[str, str] = field(default_factory=dict)  # name of an inline rule
    block: dict[str, str] = field(default_factory=dict)  # name of a block rule
    title: tuple[str, ...] = ("title",)
    ident: tuple[str, ...] = ("id",)
    citing: frozenset = frozenset({"bibr"})
    noting: frozenset = frozenset({"fn", "table-fn", "author-notes", "corresp"})
    base: re.Pattern = re.compile(r"([A-Za-z0-9)\]]+)$")  # what a raised text is an exponent of
    exponent: re.Pattern = re.compile(r".+", re.S)
    raised: str = "raised text"  # what is counted where there is no base, and for a lowered text
    lowered: str = "lowered text"
    said: dict[str, tuple[str, ...]] = field(default_factory=dict)  # attributes that a reader sees, the first that is there


#: Tags of the three genres, and what each becomes.
STANDARDS = Dialect(
    wrap={"em": "emphasis", "strong": "strong", "tt": "code", "bcp14": "strong", "u": "emphasis", "spanx": "emphasis"},
    through=frozenset({"cref", "svg", "postal", "address"}),
    skip=frozenset({"iref", "toc", "name", "seriesInfo", "workgroup", "area", "keyword"}),
    inline={"xref": "refer", "relref": "refer", "eref": "link", "br": "break_", "sup": "power", "sub": "lower", "contact": "person"},
    block={
        "t": "paragraph", "ul": "bullets", "ol": "numbers", "dl": "terms", "sourcecode": "code", "artwork": "code", "blockquote": "quote", "aside": "sidebar", "note": "remark", "figure": "figure", "table": "table",
        "section": "section", "references": "references", "reference": "entry", "abstract": "abstract", "artset": "through",
    },
    title=("name",), ident=("anchor",), base=re.compile(r"([A-Za-z0-9]+)$"), raised="escape sup", lowered="escape sub", said={"contact": ("fullname", "surname")},
)
ARTICLES = Dialect(
    wrap={"italic": "emphasis", "bold": "strong", "monospace": "code", "sc": "emphasis", "underline": "emphasis", "code": "code"},
    through=frozenset({"styled-content", "named-content", "label", "inline-formula", "alternatives", "roman", "x-ref", "ext"}),
    skip=frozenset({"inline-graphic", "object-id", "permissions", "caption", "title", "alt-text", "journal-meta", "article-meta"}),
    inline={"xref": "refer", "ext-link": "link", "uri": "link", "email": "mail", "sup": "power", "sub": "lower", "break": "break_", "math": "formula"},
    block={
        "p": "paragraph", "sec": "section", "app": "section", "ack": "section", "app-group": "through", "fn-group": "through", "list": "listed", "boxed-text": "sidebar", "def-list": "terms", "disp-quote": "quote", "disp-formula": "code", "code": "code", "preformat": "code",
        "fig": "figure", "fig-group": "through", "table-wrap": "wrapped", "graphic": "graphic", "supplementary-material": "supplement", "fn": "remarked", "ref-list": "references", "ref": "entry", "table": "table", "abstract": "abstract", "table-wrap-foot": "through",
    },
    exponent=re.compile(r"[-+−]?\d+"),
)
LAWS = Dialect(
    wrap={"Emphasis": "emphasis", "Term": "emphasis", "Definition": "emphasis", "SmallCaps": "emphasis", "Strong": "strong"},
    through=frozenset({"Superior", "Inferior", "Addition", "Substitution", "Repeal", "Acronym", "Abbreviation", "Character", "Span", "CitationSubRef"}),
    skip=frozenset({"Number", "Pnumber", "Title", "Reference", "CommentaryRefs", "Metadata"}),
    inline={"Citation": "link", "ExternalLink": "link", "InternalLink": "refer", "CommentaryRef": "note", "FootnoteRef": "note", "Math": "formula"},
    block={
        "Text": "paragraph", "Para": "through", "P1para": "through", "P2para": "through", "P3para": "through", "P4para": "through", "P5para": "through", "Body": "through", "Primary": "through", "Secondary": "through", "Schedules": "through", "PrimaryPrelims": "through",
        "TitleBlock": "through", "P1": "section", "P2": "section", "P3": "section", "P4": "section", "P5": "section", "P6": "section", "P1group": "section", "P2group": "section", "Part": "section", "Chapter": "section", "Pblock": "section", "PsubBlock": "section", "Schedule": "article", "ScheduleBody": "through",
        "UnorderedList": "bullets", "OrderedList": "numbers", "ListItem": "through", "Tabular": "table", "Commentary": "remarked", "Footnote": "remarked", "BlockText": "quote", "Contents": "contents", "Figure": "figure",
    },
    title=("Title", "Number", "Pnumber"), ident=("id", "Id"),
)


class Mapper:
    def __init__(self, dialect: Dialect) -> None:
        self.d, self.found = dialect, Counter()
        self.cited: set[str] = set()
        self.notes, self.unnamed = 0, "fn-"

    # -- inline

    def inlines(self, el: ET.Element) -> list[Node]:
        out: list[Node] = []
        self.say(out, el.text)
        for child in el:
            out += self.one(child, out)
            self.say(out, child.tail)
        return pruned(out)

    def say(self, out: list[Node], raw: str | None) -> None:
        if raw and raw.strip():
            out.append(text(re.sub(r"\s+", " ", raw)))
        elif raw and out:
            out.append(text(" "))

    def one(self, el: ET.Element, before: list[Node]) -> list[Node]:
        t = tag(el)
        if not t or t in self.d.skip:
            return []
        if t in self.d.wrap:
            kids = [text(all_text(el))] if self.d.wrap[t] == "code" else self.inlines(el)
            return [{"t": self.d.wrap[t], "c": kids}] if kids else []
        if t in self.d.inline:
            return getattr(self, "in_" + self.d.inline[t])(el, before)
        if t in self.d.block:
            self.found["block inside a line"] += 1
        elif t not in self.d.through:
            self.found[f"escape {t}"] += 1
        return self.inlines(el)

    def in_refer(self, el: ET.Element, before: list[Node]) -> list[Node]:
        target = anchor(el.get("target") or el.get("rid") or el.get("Ref"))
        kind = el.get("ref-type", "")
        kids = self.inlines(el) or [text(target)]
        if kind in self.d.noting:
            return [{"t": "note-ref", "target": target}]
        return [{"t": "citation" if kind in self.d.citing or target in self.cited else "reference", "target": target, "c": kids}]

    def in_note(self, el: ET.Element, before: list[Node]) -> list[Node]:
        return [{"t": "note-ref", "target": anchor(el.get("Ref"))}]

    def in_link(self, el: ET.Element, before: list[Node]) -> list[Node]:
        href = el.get(LINK) or el.get("target") or el.get("URI") or all_text(el)
        kids = self.inlines(el) or [text(href)]
        if safe_iri(href) and href:
            return [{"t": "link", "href": href, "c": kids}]
        self.found["escape link"] += 1
        return kids

    def in_mail(self, el: ET.Element, before: list[Node]) -> list[Node]:
        return [{"t": "link", "href": "mailto:" + all_text(el), "c": [text(all_text(el))]}]

    def in_break_(self, el: ET.Element, before: list[Node]) -> list[Node]:
        return [{"t": "line-break"}]

    def in_power(self, el: ET.Element, before: list[Node]) -> list[Node]:
        """The base is the last token of the text before, which loses it."""
        exponent = all_text(el)
        m = self.d.base.search(before[-1]["v"]) if before and kind_of(before[-1]) == "text" else None
        if not m or not self.d.exponent.fullmatch(exponent):
            self.found[self.d.raised] += 1
            return self.inlines(el)
        before[-1] = text(before[-1]["v"][: m.start()])
        return [{"t": "power", "base": m[1], "exponent": exponent}]

    def in_lower(self, el: ET.Element, before: list[Node]) -> list[Node]:
        self.found[self.d.lowered] += 1
        return self.inlines(el)

    def in_person(self, el: ET.Element, before: list[Node]) -> list[Node]:
        """A person's name is an attribute."""
        name = said(el, self.d)
        return [text(name)] if name else self.inlines(el)

    def in_formula(self, el: ET.Element, before: list[Node]) -> list[Node]:
        self.found["formula as code"] += 1
        return [{"t": "code", "c": [text(all_text(el))]}] if all_text(el) else []

    # -- blocks

    def blocks(self, el: ET.Element, depth: int = 1) -> list[Node]:
        """Loose inline content is gathered in a paragraph before the next block."""
        out: list[Node] = []
        loose: list[Node] = []

        def settle() -> None:
            kids = pruned(loose)
            if kids:
                out.append({"t": "paragraph", "c": kids})
            loose.clear()

        self.say(loose, el.text)
        for child in el:
            t = tag(child)
            if t in self.d.block and t not in self.d.skip:
                settle()
                out += getattr(self, "b_" + self.d.block[t])(child, depth)
            elif t and t not in self.d.skip:
                loose += self.one(child, loose)
            self.say(loose, child.tail)
        settle()
        return out

    def heading(self, el: ET.Element, depth: int) -> list[Node]:
        kids = spaced([self.inlines(c) for name in self.d.title[::-1] for c in el if tag(c) == name])
        return [{"t": "heading", "level": min(max(depth, 1), 6), "c": kids}] if kids else []

    def ident(self, el: ET.Element) -> dict:
        raw = next((el.get(k) for k in self.d.ident if el.get(k)), None)
        return {"id": anchor(raw)} if raw else {}

    def box(self, element: str, kids: list[Node], **fields: object) -> list[Node]:
        return [{"t": element, **fields, "c": kids}] if kids else []

    def b_through(self, el: ET.Element, depth: int) -> list[Node]:
        return [*self.heading(el, depth), *self.blocks(el, depth)]

    def b_paragraph(self, el: ET.Element, depth: int) -> list[Node]:
        return self.blocks(el, depth)

    def b_section(self, el: ET.Element, depth: int) -> list[Node]:
        return self.box("section", [*self.heading(el, depth + 1), *self.blocks(el, depth + 1)], **self.ident(el))

    def b_article(self, el: ET.Element, depth: int) -> list[Node]:
        return self.box("article", [*self.heading(el, depth + 1), *self.blocks(el, depth + 1)], **self.ident(el))

    def b_abstract(self, el: ET.Element, depth: int) -> list[Node]:
        return self.box("abstract", [*self.heading(el, depth + 1), *self.blocks(el, depth + 1)])

    def b_sidebar(self, el: ET.Element, depth: int) -> list[Node]:
        return self.box("sidebar", [*self.heading(el, depth + 1), *self.blocks(el, depth)])

    def b_remark(self, el: ET.Element, depth: int) -> list[Node]:
        return self.box("admonition", self.blocks(el, depth), kind="note")

    def b_remarked(self, el: ET.Element, depth: int) -> list[Node]:
        """A note; those without an id are numbered."""
        self.notes += 1
        if tag(el) == "fn":
            self.found["footnotes"] += 1
        return self.box("note", self.blocks(el, depth), **(self.ident(el) or {"id": f"{self.unnamed}{self.notes}"}))

    def b_quote(self, el: ET.Element, depth: int) -> list[Node]:
        source = clean(el.get("quotedFrom"))
        return self.box("quote", self.blocks(el, depth), **({"source": source} if source else {}))

    def b_code(self, el: ET.Element, depth: int) -> list[Node]:
        raw, kind = "".join(el.itertext()).strip("\n"), el.get("type") or el.get("language")
        return [{"t": "code-block", **({"language": kind} if kind else {}), "c": [text(raw)]}] if raw.strip() else []

    def items(self, el: ET.Element, depth: int) -> list[Node]:
        made = [[*self.blocks(c, depth)] for c in el if tag(c) in ("li", "list-item", "ListItem")]
        return [{"t": "item", "c": k} for k in made if k]

    def b_bullets(self, el: ET.Element, depth: int) -> list[Node]:
        return self.box("list", self.items(el, depth), ordered=False)

    def b_numbers(self, el: ET.Element, depth: int) -> list[Node]:
        start = el.get("start", "")
        return self.box("list", self.items(el, depth), ordered=True, **({"start": int(start)} if start.isdigit() else {}))

    def b_listed(self, el: ET.Element, depth: int) -> list[Node]:
        ordered = el.get("list-type", "") in ("order", "ordered", "alpha-lower", "alpha-upper", "roman-lower", "roman-upper")
        return self.box("list", self.items(el, depth), ordered=ordered)

    def b_terms(self, el: ET.Element, depth: int) -> list[Node]:
        """Terms with their definitions; an empty term carries the definition before on."""
        pairs = [c for x in el for c in (x if tag(x) == "def-item" else [x])]
        out: list[Node] = []
        for c in pairs:
            if tag(c) in ("dt", "term"):
                kids = self.inlines(c)
                if kids:
                    if out and out[-1]["t"] == "term":
                        out.append({"t": "definition", "c": [{"t": "paragraph", "c": [text("-")]}]})
                    out.append({"t": "term", "c": kids})
            elif tag(c) in ("dd", "def"):
                inner = self.blocks(c, depth)
                if out and out[-1]["t"] == "definition":
                    out[-1]["c"] += inner
                elif out:
                    out.append({"t": "definition", "c": inner})
        if out and out[-1]["t"] == "term":
            out.append({"t": "definition", "c": [{"t": "paragraph", "c": [text("-")]}]})
        return self.box("term-list", out)

    def caption(self, el: ET.Element) -> list[Node]:
        named = [self.inlines(c) for c in el if tag(c) in ("label", "name", "title")]
        kids = spaced(named + [self.inlines(p) for c in el if tag(c) == "caption" for p in c])
        return [{"t": "caption", "c": kids}] if kids else []

    def b_figure(self, el: ET.Element, depth: int) -> list[Node]:
        inner = [n for c in el if tag(c) not in ("label", "name", "caption") and tag(c) in self.d.block for n in getattr(self, "b_" + self.d.block[tag(c)])(c, depth)]
        lifted = [k for n in inner for k in (n["c"] if n["t"] == "figure" else [n])]
        held, rest = [n for n in lifted if n["t"] in ("media", "table", "code-block", "caption")], [n for n in lifted if n["t"] not in ("media", "table", "code-block", "caption")]
        self.found["figures"] += 1
        return [*self.box("figure", [*held, *self.caption(el)], **self.ident(el)), *rest]

    def b_graphic(self, el: ET.Element, depth: int) -> list[Node]:
        href, alt = el.get(LINK) or "", clean(el.findtext("./alt-text"))
        self.found["graphics"] += 1
        if re.match(r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:|//|\\)", href) or not href:
            self.found["escape graphic"] += 1
            return []
        if not alt:
            self.found["graphics without alt"] += 1
        return [{"t": "figure", "c": [{"t": "media", "src": href, "alt": alt or f"graphic {href.rpartition('/')[2]}", "kind": "image"}]}]

    def b_table(self, el: ET.Element, depth: int) -> list[Node]:
        sections = []
        for part, kind in (("thead", "head"), ("tbody", "body"), ("tfoot", "foot")):
            for c in el.iter():
                if tag(c) == part and (rows := self.rows(c, depth)):
                    sections.append({"t": "table-section", "kind": kind, "c": rows})
        direct = [] if sections else self.rows(el, depth)
        if not sections and not direct:
            self.found["table without rows"] += 1
            direct = [{"t": "row", "c": [{"t": "cell"}]}]
        return [{"t": "table", "c": [*self.caption(el), *sections, *direct], **self.ident(el)}]

    def rows(self, el: ET.Element, depth: int) -> list[Node]:
        out = []
        for r in el:
            cells = [{"t": "header-cell" if tag(c) == "th" else "cell", **{k: int(c.get(k)) for k in ("colspan", "rowspan") if (c.get(k) or "").isdigit()}, "c": self.blocks(c, depth)} for c in r if tag(c) in ("td", "th")] if tag(r) == "tr" else []
            if cells:
                out.append({"t": "row", "c": [c if c["c"] else {k: v for k, v in c.items() if k != "c"} for c in cells]})
        return out

    def b_wrapped(self, el: ET.Element, depth: int) -> list[Node]:
        out = [n for c in el if tag(c) in self.d.block for n in getattr(self, "b_" + self.d.block[tag(c)])(c, depth)]
        head = next((n for n in out if n["t"] == "table"), None)
        if head is not None:
            head["c"] = [*self.caption(el), *head["c"]]
        return out

    def b_supplement(self, el: ET.Element, depth: int) -> list[Node]:
        href, shown = el.get(LINK) or "", all_text(el) or "supplement"
        return [{"t": "paragraph", "c": [{"t": "link", "href": href, "c": [text(shown)]} if href and safe_iri(href) else text(shown)]}]

    def b_references(self, el: ET.Element, depth: int) -> list[Node]:
        nested = [n for c in el if tag(c) in ("references", "ref-list") for n in self.b_references(c, depth + 1)]
        entries = [n for c in el if tag(c) in ("reference", "ref") for n in self.b_entry(c, depth)]
        return self.box("section", [*self.heading(el, depth + 1), *self.box("bibliography", entries), *nested], **self.ident(el))

    def b_entry(self, el: ET.Element, depth: int) -> list[Node]:
        shown = all_text(el)
        return [{"t": "item", **self.ident(el), "c": [{"t": "paragraph", "c": [text(shown)]}]}] if shown else []

    def b_contents(self, el: ET.Element, depth: int) -> list[Node]:
        items = []
        for c in el.iter():
            if tag(c).startswith("Contents") and c is not el and (shown := clean(" ".join(all_text(x) for x in c if tag(x) in ("ContentsNumber", "ContentsTitle")))):
                href = c.get("IdURI") or c.get("DocumentURI") or ""
                items.append({"t": "item", "c": [{"t": "paragraph", "c": [{"t": "link", "href": href, "c": [text(shown)]} if href and safe_iri(href) else text(shown)]}]})
        return self.box("contents", items)


def unique_ids(doc: Node) -> int:
    """The first of equal ids stays; the others go, those of notes too. Returns how many went."""
    seen: set[str] = set()
    gone = 0
    for n, _ in walk(doc):
        if "id" in n:
            if n["id"] in seen:
                del n["id"]
                gone += 1
            else:
                seen.add(n["id"])
    return gone


def resolved(doc: Node) -> tuple[Node, int]:
    """References to ids that don't exist give way to what they enclose."""
    ids = {n["id"] for n, _ in walk(doc) if isinstance(n.get("id"), str)}
    gone = 0

    def step(n: Node, below: list) -> list[Node]:
        nonlocal gone
        kids = [x for some in below for x in some]
        if kind_of(n) in ("reference", "citation", "note-ref") and n.get("target") not in ids:
            gone += 1
            return kids
        return [{**fields_of(n), "t": kind_of(n), **({"c": kids} if "c" in n else {})}]

    return fold(doc, step)[0], gone


def _parts(root: ET.Element, genre: str) -> Iterator[tuple[str, ET.Element]]:
    names = {"standards": ("middle", "back"), "articles": ("body", "back"), "laws": ("Contents", "Primary", "Secondary", "Body", "Schedules")}[genre]
    taken: set[ET.Element] = set()
    for name in names:
        el = next((x for x in root.iter() if tag(x) == name), None)
        if el is not None and el not in taken:  # a part may lie in one before it
            taken.update(el.iter())
            yield name, el


GENRES: dict[str, Dialect] = {"standards": STANDARDS, "articles": ARTICLES, "laws": LAWS}
TITLES: dict[str, Callable[[ET.Element], str]] = {
    "standards": lambda r: clean(r.findtext("./front/title")),
    "articles": lambda r: next((all_text(x) for x in r.iter() if tag(x) == "article-title"), ""),
    "laws": lambda r: next((all_text(x) for x in r.iter() if tag(x) in ("title", "Title")), ""),
}


#: How many authors are named.
AUTHORS = {"standards": 8, "articles": 10}


def _front(root: ET.Element, genre: str, m: Mapper) -> list[Node]:
    """What stands before the body: number, category, identifiers, date, authors, source, abstract and notes."""
    term = lambda label, kids: [{"t": "term", "c": [text(label)]}, {"t": "definition", "c": [{"t": "paragraph", "c": kids}]}]
    link = lambda href, shown: [{"t": "link", "href": href, "c": [text(shown)]}]
    pairs: list[Node] = []
    names: list[str] = []
    source: list[Node] = []
    if genre == "standards":
        number = clean(root.get("number"))
        if number:
            pairs += term("Document", [text(f"RFC {number}")])
            source = term("Source", link(f"https://www.rfc-editor.org/rfc/rfc{number}", f"rfc-editor.org/rfc/rfc{number}"))
        if root.get("category"):
            pairs += term("Category", [text(root.get("category"))])
        names = [clean(a.get("fullname")) or all_text(a) for a in root.findall("./front/author")]
        d = root.find("./front/date")
        if d is not None and d.get("year"):
            month = clean(f"{d.get('month') or ''} {d.get('year')}")
            pairs += term("Date", [text(month)] if d.get("month") else [{"t": "date", "value": d.get("year"), "precision": "year"}])
    elif genre == "articles":
        names = [clean(f"{x.findtext('./name/given-names') or ''} {x.findtext('./name/surname') or ''}") for x in root.iter() if tag(x) == "contrib"]
        known = {x.get("pub-id-type"): all_text(x) for x in root.iter() if tag(x) == "article-id"}
        pmc = (known.get("pmc") or known.get("pmcid") or "").removeprefix("PMC")
        if pmc:
            pairs += term("Identifier", [text(f"PMC{pmc}")])
            source = term("Source", link(f"https://europepmc.org/article/PMC/{pmc}", "Europe PMC"))
        if known.get("doi"):
            pairs += term("DOI", link(f"https://doi.org/{known['doi']}", known["doi"]))
        journal = next((all_text(x) for x in root.iter() if tag(x) == "journal-title"), "")
        if journal:
            pairs += term("Journal", [text(journal)])
    else:
        year = next((x.get("Value") for x in root.iter() if tag(x) == "Year" and x.get("Value")), None)
        if year:
            pairs += term("Year", [{"t": "date", "value": year, "precision": "year"}])
    for name in [n for n in names if n][: AUTHORS.get(genre)]:
        pairs += term("Author", [text(name)])
    pairs += source
    out = [{"t": "provenance", "c": pairs}] if pairs else []
    held = next((x for x in root.iter() if tag(x) == "abstract"), None) if genre != "laws" else None
    notes = [n for x in root.findall("./front/note") for n in m.b_remark(x, 1)] if genre == "standards" else []
    return out + (m.b_abstract(held, 1) if held is not None else []) + notes


def cited_by(root: ET.Element) -> set[str]:
    """Anchors of the bibliography; what refers to them is a citation."""
    return {anchor(x.get(k)) for x in root.iter() if tag(x) in ("reference", "ref") for k in ("anchor", "id") if x.get(k)}


def _head(root: ET.Element, genre: str, doc_id: str, m: Mapper) -> tuple[dict, list[Node]]:
    """The document's fields, and its heading and front matter."""
    title = TITLES[genre](root)[:300] or doc_id
    fields = {"id": doc_id, "lang": root.get("{http://www.w3.org/XML/1998/namespace}lang") or "en", "title": title}
    return fields, [{"t": "heading", "level": 1, "c": [text(title)]}, *_front(root, genre, m)]


def _loose_notes(root: ET.Element, genre: str) -> list[ET.Element]:
    """Commentaries of laws that stand outside of the parts."""
    inside = {x for _, p in _parts(root, genre) for x in p.iter()} if genre == "laws" else set()
    return [c for c in root.iter() if tag(c) == "Commentary" and c not in inside] if genre == "laws" else []


def xml_document(raw: bytes, genre: str, doc_id: str) -> tuple[Node, dict[str, int]]:
    """XML of a genre as a document, and counts of findings."""
    root = ET.fromstring(raw)
    m = Mapper(GENRES[genre])
    m.cited = cited_by(root)
    fields, kids = _head(root, genre, doc_id, m)
    for name, el in _parts(root, genre):
        kids += m.b_contents(el, 1) if name == "Contents" else m.blocks(el, 1)
    kids += [n for c in _loose_notes(root, genre) for n in m.b_remarked(c, 1)]
    doc: Node = {"t": "document", **fields, "c": kids}
    m.found["ids dropped"] = unique_ids(doc)
    doc, m.found["references dropped"] = resolved(doc)
    return doc, {k: v for k, v in m.found.items() if v}


# -- in pieces -----------------------------------------------------------------------------

#: Kinds of pieces: what is in front, a stretch of blocks, a list of contents, a note by itself.
FRONT, BLOCKS, CONTENTS, NOTE = "front", "blocks", "contents", "note"


def pieces(raw: bytes, genre: str, doc_id: str, least: int = 0) -> tuple[dict, set[str], list[tuple[str, str]]]:
    """The document's fields, the anchors cited, and (kind, content) of its pieces in order.

    A part is cut in front of each of its sections: there a mapper ends the paragraph that loose content stands in, so the pieces' blocks are the
    part's; a piece of fewer than `least` characters goes on. The front is mapped here (its content is JSON), as it draws on the whole; the others are XML.
    """
    root, d = ET.fromstring(raw), GENRES[genre]
    m = Mapper(d)
    m.cited = cited_by(root)
    fields, front = _head(root, genre, doc_id, m)
    out = [(FRONT, json.dumps({"kids": front, "found": dict(m.found)}, ensure_ascii=False))]
    for name, part in _parts(root, genre):
        if name == "Contents":
            out.append((CONTENTS, ET.tostring(part, "unicode")))
            continue
        lead = ET.Element("piece")
        lead.text = part.text or ""
        written = lambda inner: ET.tostring(lead, "unicode", short_empty_elements=False).replace("</piece>", "".join(inner) + "</piece>")
        inner: list[str] = []
        size = 0
        for child in part:
            if d.block.get(tag(child)) in ("section", "article") and tag(child) not in d.skip and (inner or lead.text.strip()) and size >= least:
                out.append((BLOCKS, written(inner)))
                lead.text, inner, size = "", [], 0
            inner.append(ET.tostring(child, "unicode"))
            size += len(inner[-1])
        out.append((BLOCKS, written(inner)))
    out += [(NOTE, ET.tostring(c, "unicode")) for c in _loose_notes(root, genre)]
    return fields, m.cited, out


#: What the generated id of a note begins with until the notes of all pieces are counted.
UNNUMBERED = "\0fn-"


def piece_nodes(kind: str, content: str, genre: str, cited: set[str]) -> tuple[list[Node], dict[str, int], int]:
    """The nodes of a piece, its findings and how many notes it has; notes without an id get one by their number in the piece."""
    if kind == FRONT:
        held = json.loads(content)
        return held["kids"], held["found"], 0
    m = Mapper(GENRES[genre])
    m.cited, m.unnamed = cited, UNNUMBERED
    el = ET.fromstring(content)
    kids = m.b_contents(el, 1) if kind == CONTENTS else m.b_remarked(el, 1) if kind == NOTE else m.blocks(el, 1)
    return kids, {k: v for k, v in m.found.items() if v}, m.notes


def source_strings(raw: bytes, genre: str, shortest: int = 4) -> list[str]:
    """Strings of the source that a reader would miss, for the check that nothing is lost."""
    root, d = ET.fromstring(raw), GENRES[genre]
    out: list[str] = []

    def gather(el: ET.Element) -> None:
        if tag(el) in d.skip and tag(el) not in d.title:
            return
        out.extend(s for s in (said(el, d), clean(el.text), *(clean(c.tail) for c in el)) if len(s) >= shortest)
        for c in el:
            gather(c)

    for _, part in _parts(root, genre):
        gather(part)
    return out
