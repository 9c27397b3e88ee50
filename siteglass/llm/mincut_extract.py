"""Operator 5: main text of pages by minimum-cut labelling.

A page is cut into blocks of text, each with its place in the element tree. A logistic classifier says from a block's
words, links, punctuation and element how likely it is content; its log-odds and what its surroundings say become
costs, and these capacities to the two terminals. Neighbouring blocks, and neighbours within one
container, are joined by smoothness edges that weaken with their distance in the tree. The minimum cut
between the terminals, found by maximum flow, labels the blocks. Blocks whose own costs outweigh all their
edges have their label in every minimum cut; they are settled first, and flow is pushed only among the rest.

The classifier is fitted on the pages themselves: blocks that an article holds are content, those of menus, footers,
adverts and the like are not, and blocks of neither take no part. It is fitted on the blocks of at most
SAMPLE_PAGES pages, those of the smallest hashes, and at most SAMPLE_BLOCKS of these, and held near the weights
that are used where pages show no blocks of both kinds. An article inside of a container whose name only hints at a layout, or of a form,
counts as an article; in menus, footers, adverts and comments it does not.

Character references are decoded, white space within a block becomes one space, blocks are trimmed and
joined by one space in page order. Line breaks (br, hr) are white space. A null or empty page, or one
without text, gives an empty string. A tag that is not closed goes to the page's end, and elements beyond a depth of
DEEPEST open none, so time is linear in a page's length. Rows are handled one by one: order, ties and repeats do not
matter for them, and rows with one id are pages of their own.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, text_batches

_REST = r"((?:[^>\"']++|\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z)"
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|math|iframe|object|select|title|xmp)\b" + _REST + r".*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][^\s/>]*+)" + _REST + r"|<[!?/][^>]*+(?:>|\Z)",
    re.I | re.S,
)
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html li legend main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUTSIDE = frozenset("nav footer aside form menu dialog button head option".split())
INSIDE = frozenset("article main".split())
ROLES_OUTSIDE = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar status toolbar".split())
HINT_OUTSIDE = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscri\w+|breadcrumbs?|footer|masthead|comments?|comment\w*|disqus\w*|respond|repl(?:y|ies)|related|recommend\w*|pagination|pager|copyright|legal)(?=$|[\s_-])", re.I)
#: Names that layouts use too: of containers that may hold the article.
HINT_LAYOUT = re.compile(r"(?:^|[\s_-])(?:signup|login|sidebar|side|menu\w*|nav\w*|share|sharing|social|widget\w*|toolbar|skip|tags?)(?=$|[\s_-])", re.I)
HINT_INSIDE = re.compile(r"(?:^|[\s_-])(?:article\w*|content|post|entry|story|main|body\w*|text)(?=$|[\s_-])", re.I)
ATTRIBUTE = re.compile(r"([\w:-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Smoothness of neighbours and of neighbours in one container.
NEIGHBOURS, SIBLINGS = 1.2, 1.2
#: Log-odds of places: outside for certain, outside by layout, unknown, inside by name, inside.
OUT, HINT, NONE, NAMED, IN = -7.0, -3.0, 0.0, 2.5, 5.0
#: Log-odds that the classifier gives at most, so that places and edges have their say.
MOST = 3.5
DEEPEST = 128
SAMPLE_PAGES, SAMPLE_BLOCKS = 1000, 50_000


def zone(tag: str, attributes: str, now: float) -> float:
    """Log-odds of the inside of an element by its place."""
    if now == OUT or tag in OUTSIDE and tag != "form" or (tag == "header" and now <= NONE):
        return OUT
    if tag == "form":
        return HINT if now <= NONE else OUT
    if attributes and tag not in ("html", "body"):
        a = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
        role = a.get("role", "").lower()
        if role in ROLES_OUTSIDE or "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower():
            return OUT
        name = f"{a.get('class', '')} {a.get('id', '')}"
        if tag not in INSIDE and HINT_OUTSIDE.search(name):
            return OUT
        if role == "main" or a.get("itemprop") == "articleBody":
            return IN
        if tag not in INSIDE and HINT_LAYOUT.search(name):
            return HINT if now <= NONE else OUT
        if now == NONE and HINT_INSIDE.search(name):
            return IN if tag in INSIDE else NAMED
    return IN if tag in INSIDE else now


def blocks(html: str) -> list[tuple[str, float, float, int, str, int]]:
    """(text, share in links, zone, container, tag, depth) of each block."""
    out: list[tuple] = []
    stack: list[tuple[str, float, int]] = [("", NONE, 0)]  # tag, zone, number
    parts: list[str] = []
    linked, links, made, at, over = 0, 0, 0, 0, 0

    def close() -> None:
        nonlocal linked
        text = " ".join(unescape("".join(parts)).split()) if parts else ""
        if text:
            k = len(stack) - 1
            while k and stack[k][0] not in BLOCKS:
                k -= 1
            box = stack[k - 1] if k and stack[k][0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "dd", "dt") else stack[k]
            out.append((text, linked / len(text), stack[-1][1], box[2], stack[k][0], k))
        parts.clear()
        linked = 0

    for m in TOKEN.finditer(html):
        if m.start() > at:
            piece = html[at : m.start()]
            parts.append(piece)
            if links:
                linked += len(piece.strip())
        at = m.end()
        tag = m[4]
        if not tag:
            if m[1]:
                parts.append(" ")
            continue
        tag = tag.lower()
        if tag in VOID:
            parts.append(" " if tag in ("br", "hr") else "")
            if tag == "hr":
                close()
            continue
        if m[3] and over:
            over -= 1  # of an element that was too deep to open
            if tag in BLOCKS:
                close()
        elif m[3]:
            k = len(stack) - 1
            while k and stack[k][0] != tag and not (tag not in BLOCKS and stack[k][0] in BLOCKS):
                k -= 1
            if tag in BLOCKS:
                close()
            if k and stack[k][0] == tag:
                links -= sum(x[0] == "a" for x in stack[k:])
                del stack[k:]
        else:
            if tag in BLOCKS:
                close()
                k = len(stack) - 1
                ends = ("li",) if tag == "li" else ("td", "th", "tr") if tag == "tr" else ("td", "th") if tag in ("td", "th") else ("dd", "dt") if tag in ("dd", "dt") else ()
                while k and (stack[k][0] not in BLOCKS or stack[k][0] in ("h1", "h2", "h3", "h4", "h5", "h6") and tag not in ("p", "div", "span")):
                    k -= 1
                if k and (stack[k][0] == "p" or stack[k][0] in ends):
                    links -= sum(x[0] == "a" for x in stack[k:])
                    del stack[k:]
            if not (m[5] or "").endswith("/") and len(stack) >= DEEPEST:
                over += 1
            elif not (m[5] or "").endswith("/"):
                made += 1
                links += tag == "a"
                stack.append((tag, zone(tag, m[5] or "", stack[-1][1]), made))
    if at < len(html):
        parts.append(html[at:])
    close()
    return out


#: Weights of a block's features where pages do not teach them.
WEIGHTS = (-1.2, 0.9, -4.0, 0.6, 0.5, 0.8, 0.3, -0.4)


def features(text: str, in_links: float, tag: str) -> tuple[float, ...]:
    """One, the logarithm of the number of words, the share in links, marks of punctuation and of the element."""
    return (1.0, math.log(text.count(" ") + 1), in_links, float(text[-1] in ".!?…\"”»"), float(text.count(",") + text.count(".") > 1), float(tag in ("p", "blockquote", "pre")), float(tag[:1] == "h"), float(tag == "li"))


def fit(x: np.ndarray, content: np.ndarray, penalty: float = 0.02, rounds: int = 25) -> tuple[float, ...]:
    """Logistic weights of features x, both kinds of blocks weighing the same, held near WEIGHTS; by Newton's method."""
    start = w = np.array(WEIGHTS)
    if not content.any() or content.all():
        return WEIGHTS
    weight = np.where(content, 0.5 / content.sum(), 0.5 / (~content).sum())
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - content)) + penalty * (w - start)
        w = w - np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w)), slope)
    return tuple(w.tolist())


def learned(pages: DataFrame, html: str = "html", sample_pages: int = SAMPLE_PAGES, sample_blocks: int = SAMPLE_BLOCKS) -> tuple[float, ...]:
    """The classifier's weights, from a bounded sample of the pages' own blocks."""
    mark = F.xxhash64(html)
    marks = pages.select(mark.alias("mark")).orderBy("mark").limit(sample_pages).agg(F.max("mark")).first()[0]
    if marks is None:
        return WEIGHTS

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = [x for x in blocks(page or "") if x[2] in (OUT, IN)]
                rows = [features(x[0], x[1], x[4]) for x in found]
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(found), pa.int64()), pa.array(range(len(found)), pa.int64()), pa.array([x[2] == IN for x in found], pa.bool_()), pa.array(rows, pa.list_(pa.float64()))], ["mark", "number", "content", "features"])

    rows = pages.select(mark.alias("mark"), html).where(F.col("mark") <= marks).mapInArrow(work, "mark long, number long, content boolean, features array<double>")
    rows = rows.distinct().orderBy(F.xxhash64("mark", "number"), "mark", "number").limit(sample_blocks).toArrow()
    if not len(rows):
        return WEIGHTS
    return fit(np.array(rows["features"].to_pylist()), rows["content"].to_numpy().astype(bool))


def min_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node is on the source's side of a minimum cut; source[i] is the cost of putting i on the sink's side."""
    n = len(source)
    lean = [a - b for a, b in zip(source, sink, strict=True)]
    around: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for a, b, c in edges:
        around[a].append((b, c))
        around[b].append((a, c))
    loose = [sum(c for _, c in x) for x in around]
    side: list[bool | None] = [None] * n
    queue = [i for i in range(n) if abs(lean[i]) >= loose[i]]
    while queue:  # a node that leans more than its edges hold is settled, and pulls its neighbours
        i = queue.pop()
        if side[i] is not None:
            continue
        side[i] = lean[i] > 0
        for j, c in around[i]:
            if side[j] is None:
                lean[j] += c if side[i] else -c
                loose[j] -= c
                if abs(lean[j]) >= loose[j] - 1e-12:
                    queue.append(j)
    rest = [i for i in range(n) if side[i] is None]
    if not rest:
        return [bool(x) for x in side]
    number = {x: k for k, x in enumerate(rest)}
    s, t = len(rest), len(rest) + 1
    to, room, adjacent = [], [], [[] for _ in range(len(rest) + 2)]

    def join(a: int, b: int, forth: float, back: float) -> None:
        adjacent[a].append(len(to))
        to.append(b)
        room.append(forth)
        adjacent[b].append(len(to))
        to.append(a)
        room.append(back)

    for i in rest:
        join(s, number[i], max(0.0, lean[i]), 0.0)
        join(number[i], t, max(0.0, -lean[i]), 0.0)
    for a, b, c in edges:
        if a in number and b in number:
            join(number[a], number[b], c, c)
    while True:  # blocking flows over shortest paths
        level = [-1] * (t + 1)
        level[s], line = 0, [s]
        for x in line:
            for e in adjacent[x]:
                if room[e] > 1e-12 and level[to[e]] < 0:
                    level[to[e]] = level[x] + 1
                    line.append(to[e])
        if level[t] < 0:
            break
        tried, path, x = [0] * (t + 1), [], s
        while True:
            if x == t:
                push = min(room[e] for e in path)
                for e in path:
                    room[e] -= push
                    room[e ^ 1] += push
                k = next(k for k, e in enumerate(path) if room[e] <= 1e-12)
                x = to[path[k] ^ 1]
                del path[k:]
            for e in adjacent[x][tried[x] :]:
                if room[e] > 1e-12 and level[to[e]] == level[x] + 1:
                    path.append(e)
                    x = to[e]
                    break
                tried[x] += 1
            else:
                if not path:
                    break
                x = to[path.pop() ^ 1]
                tried[x] += 1
    for i in rest:
        side[i] = level[number[i]] >= 0
    return [bool(x) for x in side]


def labelled(html: str | None, weights: tuple[float, ...] = WEIGHTS, neighbours: float = NEIGHBOURS, siblings: float = SIBLINGS) -> list[tuple[str, bool]]:
    """(text, whether it is content) of each block of a page, by the minimum cut."""
    found = blocks(html or "")
    source, sink, edges, last = [], [], [], {}
    for i, (text, in_links, where, box, tag, depth) in enumerate(found):
        s = where + max(-MOST, min(MOST, sum(a * b for a, b in zip(weights, features(text, in_links, tag), strict=True))))
        source.append(max(s, 0.0))
        sink.append(max(-s, 0.0))
        if i:
            edges.append((i - 1, i, neighbours / (1 + abs(depth - found[i - 1][5]) + (box != found[i - 1][3]))))
        if box in last:
            edges.append((last[box], i, siblings))
        last[box] = i
    return [(x[0], keep) for x, keep in zip(found, min_cut(source, sink, edges) if found else [], strict=True)]


def main_text(html: str | None, weights: tuple[float, ...] = WEIGHTS) -> str:
    return " ".join(text for text, keep in labelled(html, weights) if keep)


def extract(pages: DataFrame, html: str = "html", weights: tuple[float, ...] | None = None) -> DataFrame:
    """pages with text and n_chars in place of html; columns of these names are replaced. Weights are learned from the pages where none are given."""
    text_batches(pages.sparkSession)
    weights = weights or learned(pages, html)
    new = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    own = [f for f in pages.schema.fields if f.name not in ("text", "n_chars", html)]
    pages = pages.select(*[f"`{f.name}`" for f in own], f"`{html}`")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x, weights) for x in b.column(len(own)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [*[f.name for f in own], "text", "n_chars"])

    return pages.mapInArrow(work, T.StructType([*own, *new]))


def op5_mincut_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


QUERIES = {"op5_mincut_extract": op5_mincut_extract}
ORACLES: dict[str, str] = {}
