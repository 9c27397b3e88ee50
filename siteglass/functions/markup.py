"""What a page's markup says, in one pass over its tokens, on Arrow batches.

A page is read into tokens once (tags with decoded attributes, and text with decoded references); everything else is a fold over them:
the record of an audit, what a reader could see and what is kept from view, and the text of an answer page. A fold keeps
how many elements of each name are open, so an end tag costs what it closes, and time grows with the page alone.
Null and empty pages have empty records. Markup that breaks off gives what came before.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

# fixed values: elements that may stand in a head, that have no end, whose content is no text, and that frame a page
HEAD = frozenset("html head title meta link base script style noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
QUIET = frozenset("script style noscript template".split())
INERT = QUIET | {"svg", "iframe"}
CHROME = frozenset(("nav", "footer", "aside"))
HEADINGS = frozenset(f"h{n}" for n in range(1, 7))
OPEN_GRAPH = ("title", "description", "image", "url")
# fixed values: from how far off a page counts as moved out of sight, by unit, and the properties that move
FAR = {"": 999, "px": 999, "pt": 999, "vw": 100, "vh": 100, "em": 50, "rem": 50}
MOVING = frozenset("left top right bottom margin-left margin-top text-indent".split())
UNITS = frozenset(("", "px", "em", "rem", "pt", "%", "vw", "vh", "ex", "ch"))
# fixed values: labels and headings of lists of questions and of sources
FAQ_LABEL, FAQ_HEADING = re.compile(r"\bfaq\b|자주\s*묻는"), re.compile(r"\bfaq\b|자주\s*묻는\s*질문", re.I)
SOURCES = re.compile(r"\bsources?\b|\breferences?\b|출처|참고\s*자료", re.I)
SPACE = re.compile(r"\s+")

#: Pages whose folds are held as Python objects at once.
PAGES = 64

OPEN, CLOSE, BOTH, TEXT = range(4)
Token = tuple[int, str, dict[str, str | None]]


REFERENCE = re.compile(r"&(#\d+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)?")


class _Reader(HTMLParser):
    def __init__(self, mark: str = "") -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[Token] = []
        self.mark = mark

    def _plain(self, x: str | None) -> str | None:
        return x.replace(self.mark, "&") if self.mark and x else x

    def handle_starttag(self, tag, attrs, kind=OPEN):
        self.found.append((kind, self._plain(tag), {self._plain(k): self._plain(v) for k, v in attrs}))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs, BOTH)

    def handle_endtag(self, tag):
        self.found.append((CLOSE, self._plain(tag), {}))

    def handle_data(self, data):
        self.found.append((TEXT, self._plain(data), {}))


def tokens(html: str | None, closed: bool = False) -> list[Token]:
    """The tokens of a page. Browsers also decode some references without a semicolon, as when a text breaks off in one; where closed, those stay as written."""
    mark = ""
    if closed and html and "&" in html:
        # an ampersand that begins no closed reference is read as a character that pages do not have
        mark = next(c for c in map(chr, range(0x10FFFF, 0x80, -1)) if c not in html)
        html = REFERENCE.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else mark + m[0][1:], html)
    reader = _Reader(mark)
    try:
        reader.feed(html or "")
        reader.close()
    except (AssertionError, ValueError):
        pass  # what was read before stays
    return reader.found


def squeezed(x: str) -> str:
    return SPACE.sub(" ", x).strip()


def types_of(block: str) -> list[str] | None:
    """All types of a JSON-LD block at any depth; None where it is no JSON."""
    try:
        rest, out = [json.loads(block)], []
    except (ValueError, RecursionError):
        return None
    while rest:
        node = rest.pop()
        if isinstance(node, dict):
            said = node.get("@type")
            out += [x for x in (said if isinstance(said, list) else [said]) if isinstance(x, str)]
            rest += node.values()
        elif isinstance(node, list):
            rest += node
    return out


RECORD = "lang string, title string, description string, robots string, googlebot string, canonical string, naver_verified boolean, og map<string,string>, h1 array<string>, refs array<string>, alternates array<struct<lang:string,href:string>>, text string, jsonld array<string>, jsonld_invalid int, jsonld_types array<string>"


def record(html: str | None, closed: bool = False) -> dict:
    """What an audit asks of a page. Of several titles all text counts, of descriptions and canonicals the first, of robots all; alternates count in the head alone."""
    lang = canonical = description = None
    robots: dict[str, list[str]] = {"robots": [], "googlebot": []}
    titles, h1, refs, alternates, texts, blocks = [], [], [], [], [], []
    og: dict[str, str] = {}
    naver = closed_head = in_title = titled = False
    block: list[str] | None = None
    heading: list[str] = []
    quiet = headings = 0
    for kind, tag, attrs in tokens(html, closed):
        if kind == TEXT:
            if block is not None:
                block.append(tag)
                continue
            if in_title:
                titles.append(tag)
            if not quiet:
                if headings:
                    heading.append(tag)
                texts.append(tag)
        elif kind == CLOSE:
            if tag == "head":
                closed_head = True
            elif tag == "title":
                in_title, titled = False, True
            elif tag == "h1" and headings:
                headings -= 1
                h1.append(squeezed("".join(heading)))
                heading = []
            elif tag == "script" and block is not None:
                blocks.append("".join(block))
                block = None
            elif tag in QUIET:
                quiet = max(0, quiet - 1)
        else:
            a = {k: v or "" for k, v in attrs.items()}
            closed_head |= tag not in HEAD
            if tag == "html":
                lang = lang or a.get("lang")
            elif tag == "title":
                in_title = True
            elif tag == "meta":
                name, content = (a.get("name") or a.get("property") or a.get("http-equiv") or "").lower(), a.get("content", "")
                if name == "description":
                    description = content if description is None else description
                elif name in robots:
                    robots[name] += [content] if content else []
                elif name == "naver-site-verification":
                    naver = True
                elif name.startswith("og:") and name[3:] in OPEN_GRAPH:
                    og.setdefault(name[3:], content)
            elif tag == "link":
                rel = a.get("rel", "").lower()
                if "canonical" in rel:
                    canonical = canonical or a.get("href")
                if "alternate" in rel.split() and not closed_head and a.get("hreflang", "").strip() and a.get("href", "").strip():
                    alternates.append({"lang": a["hreflang"].strip().lower(), "href": a["href"].strip()})
            elif tag == "a" and a.get("href"):
                refs.append(a["href"])
            elif tag == "h1":
                headings, heading = headings + 1, []
            elif tag in QUIET and kind == OPEN:
                if tag == "script" and "ld+json" in a.get("type", "").lower():
                    block = []
                else:
                    quiet += 1
    types = [types_of(b) for b in blocks]
    good = [b for b, t in zip(blocks, types, strict=True) if t is not None]
    return {
        "lang": lang or "", "title": squeezed("".join(titles)) if titled else "", "description": description or "", "robots": ", ".join(robots["robots"]), "googlebot": ", ".join(robots["googlebot"]),
        "canonical": canonical or None, "naver_verified": naver, "og": list(og.items()), "h1": h1, "refs": refs, "alternates": alternates, "text": squeezed("".join(texts)),
        "jsonld": good, "jsonld_invalid": len(blocks) - len(good), "jsonld_types": sorted({x for t in types if t for x in t}),
    }


def hidden_style(style: str | None) -> bool:
    """Whether an inline style keeps text out of view: not displayed, not visible, of no size, or moved far off."""
    for declaration in (style or "").lower().split(";"):
        name, _, value = (x.strip() for x in declaration.partition(":"))
        value = re.sub(r"\s*!\s*important$", "", value)
        number = re.fullmatch(r"(-?)\s*([\d.]*\d)([a-z%]*)", value)
        if name == "display" and value == "none" or name == "visibility" and value in ("hidden", "collapse"):
            return True
        if name == "font-size" and number and not number[1] and number[3] in UNITS and not number[2].strip("0."):
            return True
        away = number if name in MOVING else re.search(r"translate(?:x|y|3d)?\(\s*(-)\s*(\d+(?:\.\d+)?)([a-z]*)", value) if name == "transform" else None
        if away and away[1] and re.fullmatch(r"\d+(?:\.\d+)?", away[2]) and float(away[2]) >= FAR.get(away[3], float("inf") if name in MOVING else FAR[""]):
            return True
    return False


RESEARCH = "title string, h1 string, headings array<string>, text string, has_table boolean, has_faq boolean, has_sources boolean, hidden array<string>"


def research(html: str | None, closed: bool = False) -> dict:
    """What a reader could see and cite: title, headings and text without menus, footers, asides and hidden elements; and apart from it, the text of
    each hidden element, unless it holds code or stands in the head."""
    stack: list[tuple[str, bool, bool, bool]] = []
    open_tags: Counter = Counter()
    out_of_sight = concealed = inert = 0
    titles, headings, h1, texts, hidden = [], [], [], [], []
    active: list[tuple[str, list[str]]] = []
    table = faq = sources = False
    for kind, tag, attrs in tokens(html, closed):
        if kind == TEXT:
            value = squeezed(tag)
            if not value:
                continue
            if out_of_sight:
                if concealed and not inert and not open_tags["head"]:
                    hidden[-1].append(value)
                continue
            if open_tags["title"]:
                titles.append(value)
            if active:
                active[-1][1].append(value)
            if not open_tags["head"]:
                texts.append(value)
            continue
        if kind in (OPEN, BOTH) and tag not in VOID:
            own_inert = tag in INERT
            own_hidden = "hidden" in attrs or (attrs.get("aria-hidden") or "").strip().lower() == "true" or hidden_style(attrs.get("style"))
            if own_hidden and not concealed:
                hidden.append([])
            unseen = own_inert or own_hidden or tag in CHROME
            stack.append((tag, unseen, own_hidden, own_inert))
            open_tags[tag] += 1
            out_of_sight, concealed, inert = out_of_sight + unseen, concealed + own_hidden, inert + own_inert
            if not out_of_sight:
                if tag in HEADINGS:
                    active.append((tag, []))
                label = " ".join(attrs.get(k) or "" for k in ("id", "class", "aria-label")).lower()
                table, faq, sources = table or tag == "table", faq or bool(FAQ_LABEL.search(label)), sources or bool(SOURCES.search(label))
        if kind in (CLOSE, BOTH):
            if active and active[-1][0] == tag:
                _, pieces = active.pop()
                if value := " ".join(pieces):
                    headings.append(value)
                    h1 += [value] if tag == "h1" else []
                    faq, sources = faq or bool(FAQ_HEADING.search(value)), sources or bool(SOURCES.search(value))
            while open_tags[tag]:
                last, unseen, own_hidden, own_inert = stack.pop()
                open_tags[last] -= 1
                out_of_sight, concealed, inert = out_of_sight - unseen, concealed - own_hidden, inert - own_inert
                if last == tag:
                    break
    return {"title": " ".join(titles), "h1": " ".join(h1), "headings": headings, "text": " ".join(texts), "has_table": table, "has_faq": faq, "has_sources": sources, "hidden": [" ".join(x) for x in hidden if x]}


ANSWER = "text string"


def answer(html: str | None, closed: bool = False) -> dict:
    """The text of an answer page outside of code, titles and forms; all text nodes, as they are, joined by a space."""
    apart, quiet, parts = 0, 0, []
    for kind, tag, _ in tokens(html, closed):
        if kind == TEXT:
            parts += [] if apart or quiet else [tag]
        elif tag in ("title", "form", "textarea"):
            apart = max(0, apart + (kind == OPEN) - (kind == CLOSE))
        elif tag in ("script", "style"):
            quiet = max(0, quiet + (kind == OPEN) - (kind == CLOSE))
    return {"text": " ".join(parts)}


def read(pages: DataFrame, fold: Callable[[str | None], dict], fields: str, html: str = "html") -> DataFrame:
    """pages without html, with the fields that a fold over each page gives; other columns pass."""
    kept = [f for f in pages.schema.fields if f.name != html]
    added = _parse_datatype_string(fields)
    types = to_arrow_schema(added)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(i, PAGES) for b in batches for i in range(0, b.num_rows, PAGES)):
            rows = [fold(x) for x in b.column(html).to_pylist()]
            columns = [pa.array([r[f.name] for r in rows], f.type) for f in types]
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in kept], *columns], [*[f.name for f in kept], *types.names])

    return pages.mapInArrow(work, StructType(kept + added.fields))
