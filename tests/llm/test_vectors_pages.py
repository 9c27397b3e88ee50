"""Operators 1, 2, 5 and 10 on pages and embeddings."""

import base64
import hashlib
import html as html_module
import itertools
import math
import random
import re
import time
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siteglass.llm import additive_ann, bitsliced_topk, mincut_extract, warc_zip
from siteglass.llm.common import scratch_dir, table, written
from siteglass.llm.tiles import vectors

from .helpers import SF

PAGES = "page_id long, url string, html string, text int, payload string, sha string, least long"
PAGE_ROWS = [(3, "http://a/ x", "<p>é</p>"), (1, None, None), (2, "u", ""), (None, "u", "<p>é</p>"), (7, "u", "<p>é</p>"), (7, "u", "<p>é</p>"), (9, "v", "line\r\n\r\nWARC/1.1\r\n\r\n"), (10, "v", "z" * 5_000_000)]


def odd_pages(spark):
    return spark.createDataFrame([(*r, 1, "p", "s", 5) for r in PAGE_ROWS], PAGES)


def warc_of(spark, pages, name):
    archives = warc_zip.write_archives(warc_zip.with_revisits(pages), f"{scratch_dir(spark)}/{name}")
    return warc_zip.read_records(written(warc_zip.locate(archives), "runs")), archives


def expected_records(rows):
    rows = [(i, (h or "").encode()) for i, h in rows]
    least = {}
    for i, d in rows:
        if i is not None:
            least[d] = min(i, least.get(d, i))
    out = []
    for i, d in rows:
        first = least.get(d)
        refers = first if first is not None and first != i and sum(x == d for _, x in rows) > 1 else None
        out.append((i, len(d), base64.b32encode(hashlib.sha1(d).digest()).decode(), "response" if refers is None else "revisit", refers))
    return sorted(map(repr, out))


def columns(rows):
    return sorted(repr((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in rows)


def test_warc_round_trip(spark):
    pages = table(spark, SF, "pages").collect()
    assert columns(warc_zip.op1_warc(spark, SF).collect()) == expected_records([(r.page_id, r.html) for r in pages])


def test_warc_odd_inputs(spark):
    records, archives = warc_of(spark, odd_pages(spark), "odd")
    rows = records.collect()
    assert columns(rows) == expected_records([(i, h) for i, _, h in PAGE_ROWS])
    assert all(hashlib.sha1(r.payload).digest() == base64.b32decode(r.payload_digest) for r in rows if r.record_type == "response")
    assert warc_of(spark, odd_pages(spark).where("false"), "none")[0].count() == 0


@pytest.mark.parametrize("wide", [False, True])
def test_zip_directories(tmp_path, monkeypatch, wide):
    if wide:  # the directory then has ZIP64 fields and a ZIP64 end record
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 5)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    path = tmp_path / "a.wacz"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.writestr("x/first", b"0123456789")
        z.writestr("y/second", b"PK\5\6 not the end")
        z.comment = b"a comment"
    with pa.OSFile(str(path)) as f:
        found = warc_zip.members(f)
        assert {k: warc_zip._range(f, a, n) for k, (a, n, _) in found.items()} == {"x/first": b"0123456789", "y/second": b"PK\5\6 not the end"}


def test_archive_without_index_is_scanned(spark, tmp_path):
    path = tmp_path / "b.wacz"
    rows = [(5, b"five"), (6, b""), (7, b"\r\n\r\n")]
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.writestr(warc_zip.RECORDS, b"".join(warc_zip.record(i, "u", d, warc_zip.sha1_base32(d), None) for i, d in rows))
    runs = warc_zip.locate(spark.createDataFrame([(f"file://{path}",)], "path string"))
    assert sorted((r.page_id, bytes(r.payload)) for r in warc_zip.read_records(runs).collect()) == rows


VECTORS = [(1, [0.5, -0.25]), (2, [0.5, -0.25]), (2, [1.0, 1.0]), (20, [1.0, 0.0]), (40, [-1.0, 2.0, 0.5]), (60, []), (80, None), (100, [None, 1.0]), (None, [1.0, 1.0]), (120, [float("nan"), 1.0]), (140, [float("inf"), 0.0]), (200, [0.1, 0.2]), (300, [0.0, 0.0]), (7, [0.5, -0.25])]


def odd_vectors(spark):
    return spark.createDataFrame([(i, v, 1, "r") for i, v in VECTORS], "vec_id long, embedding array<float>, score int, `rank` string")


def brute(rows, every, k, f):
    out = []
    for q, v in rows:
        if q % every == 0:
            found = sorted((-f(v, w), i) for i, w in rows if i != q)[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(found, 1)]
    return sorted(out)


def good(rows):
    return [(i, [float(np.float32(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]


def whole_product(v, w):
    return sum(math.floor(1024 * a) * math.floor(1024 * b) for a, b in zip(v, w, strict=False))


def test_bitsliced_top_rows(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, SF, "embeddings").collect()]
    got = sorted(tuple(r) for r in bitsliced_topk.op2_bitsliced_topk(spark, SF).select("query_id", "rank", "vec_id", "score").collect())
    m = np.floor(1024 * np.array([v for _, v in rows], np.float64)).astype(np.int64)
    score = m @ m.T
    at = {i: k for k, (i, _) in enumerate(rows)}
    assert got == brute([(i, i) for i, _ in rows], 100, 10, lambda a, b: int(score[at[a], at[b]]))


def test_bitsliced_odd_inputs_and_ties(spark):
    rows = vectors(odd_vectors(spark), "vec_id", "embedding")
    got = sorted(tuple(r) for r in bitsliced_topk.topk(rows, rows.where("id % 20 = 0"), 4, tile_rows=3, query_rows=2).collect())
    assert got == brute(good(VECTORS), 20, 4, whole_product)
    ties = spark.range(1, 400).select("id", F.array(F.lit(0.5), F.lit(-0.5)).alias("v"))
    got = sorted(tuple(r) for r in bitsliced_topk.topk(ties, ties.where("id % 100 = 0"), 5, tile_rows=50).collect())
    assert got == brute([(i, [0.5, -0.5]) for i in range(1, 400)], 100, 5, whole_product)
    assert bitsliced_topk.topk(rows.where("false"), rows.where("false"), 3).count() == 0


def test_bitsliced_keeps_large_vectors(spark):
    large = [(20, [1.0, -70_000.0]), (40, [3.0e6, 0.5, 2.0]), (60, [-9.0e14, 0.25]), (1, [2.0e5, 3.0]), (2, [1.0e6, 1.0e6]), (3, [0.5, 1.0]), (4, [-8.0e15, 0.0]), (5, [2.0**20 + 0.001])]
    rows = spark.createDataFrame(large, "id long, v array<double>")
    got = sorted(tuple(r) for r in bitsliced_topk.topk(rows, rows.where("id in (20, 40)"), 3, tile_rows=3, query_rows=1).collect())
    want = [x for x in brute(large, 20, 3, whole_product) if x[0] in (20, 40)]
    assert got == want
    with pytest.raises(Exception, match="leaves 64 bits"):
        bitsliced_topk.topk(rows, rows.where("id = 4"), 3).collect()


def test_additive_codes_search(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, SF, "embeddings").collect()]
    got = additive_ann.op10_additive_ann(spark, SF).collect()
    m = np.array([v for _, v in rows], np.float64)
    score = m @ m.T
    at = {i: k for k, (i, _) in enumerate(rows)}
    want = brute([(i, i) for i, _ in rows], 20, 20, lambda a, b: float(score[at[a], at[b]]))
    assert len(got) == len(want)
    assert all(r.score == pytest.approx(score[at[r.query_id], at[r.vec_id]], abs=1e-12) for r in got)
    recall = len({(r.query_id, r.vec_id) for r in got} & {(q, i) for q, _, i, _ in want}) / len(want)
    assert recall >= 0.9


def test_additive_codes_bind_the_search(spark):
    """With few reranked rows the codes decide what is found; recall stays useful and far above chance."""
    rows = vectors(table(spark, SF, "embeddings"), "vec_id", "embedding")
    n = rows.count()
    got = additive_ann.nearest(rows, rows.where("id % 20 = 0"), 20, reranked=40).collect()
    local = {r.id: np.array(r.v) for r in rows.collect()}
    hit = total = 0
    for q in {r.query_id for r in got}:
        best = sorted((-float(local[q] @ v), i) for i, v in local.items() if i != q)[:20]
        hit += len({i for _, i in best} & {r.vec_id for r in got if r.query_id == q})
        total += 20
    assert hit / total >= 0.9 > 40 / n


def test_additive_odd_inputs(spark):
    rows = vectors(odd_vectors(spark), "vec_id", "embedding")
    some = [(i, v) for i, v in good(VECTORS) if any(v)]
    got = sorted(tuple(r) for r in additive_ann.nearest(rows, rows.where("id % 20 = 0"), 4, tile_rows=3, query_rows=2).collect())
    assert got == brute(some, 20, 4, lambda v, w: sum(a * b for a, b in zip(v, w, strict=False)))
    assert additive_ann.nearest(rows.where("false"), rows.where("false"), 3).count() == 0


def test_additive_search_among_copies(spark):
    """A third of more rows than a tile holds are copies: of these the smallest ids must be found, also by copies themselves."""
    rng = np.random.default_rng(8)
    m = rng.integers(-8, 9, (9000, 16)) / 8
    m[np.arange(9000) % 3 == 1] = m[1]
    m[0], m[300] = m[1] + 0.125, m[1] * 2
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(m.tolist())] + [(301, [*m[1].tolist(), 0.0])] * 2, "id long, v array<double>")
    got = {(r.query_id, r.vec_id) for r in additive_ann.nearest(rows, rows.where("id % 300 = 0 or id in (1, 4)"), 20).collect()}
    queries = [q for q in range(9000) if q % 300 == 0 or q in (1, 4)]
    ids, m = np.append(np.arange(9000), [301, 301]), np.vstack([m, m[1], m[1]])
    want = {q: {i for _, i in [x for x in sorted(zip((-(m @ m[q])).tolist(), ids.tolist(), strict=True)) if x[1] != q][:20]} for q in queries}
    recall = {q: len(w & {i for a, i in got if a == q}) / len(w) for q, w in want.items()}
    assert all(recall[q] == 1 for q in (0, 1, 4, 300)), recall
    assert sum(recall.values()) / len(recall) >= 0.9


def test_minimum_cut_is_minimal():
    rng = np.random.default_rng(4)
    for n in range(1, 9):
        for _ in range(30):
            a, b = rng.random(n).round(2).tolist(), rng.random(n).round(2).tolist()
            edges = [(i, j, round(float(rng.random()), 2)) for i in range(n) for j in range(i) if rng.random() < 0.5]

            def cost(side):
                return sum(b[i] if s else a[i] for i, s in enumerate(side)) + sum(c for i, j, c in edges if side[i] != side[j])

            least = min(map(cost, itertools.product([False, True], repeat=n)))
            assert cost(mincut_extract.min_cut(a, b, edges)) == pytest.approx(least, abs=1e-9)


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><a href="/">Home</a> Site name</header><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>
<div class="cookie-notice">We use cookies to make this site work, please accept them all.</div>
<article><h1>A heading</h1><p>First&nbsp;paragraph of the story &amp; more,
 with <b>bold</b> words.</p><p>Short one.</p><ul><li>point one</li><li>point two</li></ul><p>It ends here, after a longer sentence.</p></article>
<div class="ad">Buy now, it is cheap and good, and there are only few left.</div><aside>Related things are listed here.</aside>
<div id="comments"><p>A reader says that this was a fine story indeed.</p></div><form><p>Sign up here</p><input></form><footer>Copyright 2024 and so on.</footer></body></html>"""


def test_main_text_of_a_page():
    assert mincut_extract.main_text(PAGE) == "A heading First paragraph of the story & more, with bold words. Short one. point one point two It ends here, after a longer sentence."


def plain_page(seed):
    """(html, [(text, whether it is content)]) of a page of containers whose names say nothing, in which short lines belong to either side."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 8)))
    line = lambda n, end: " ".join(word() for _ in range(n)) + end
    made = []

    def box(rows):
        made.extend(rows)
        return "<div>" + "".join(f"<p>{'<a href=x>' + t + '</a>' if link else t}</p>" for t, _, link in rows) + "</div>"

    menu = [(line(r.randint(1, 3), ""), False, True) for _ in range(r.randint(3, 8))]
    menu.insert(r.randrange(len(menu)), (line(r.randint(8, 12), "."), False, False))
    body = [(line(r.randint(25, 60), "."), True, False) for _ in range(r.randint(4, 7))]
    for _ in range(3):
        body.insert(r.randrange(1, len(body)), (line(r.randint(1, 2), ""), True, False))
    foot = [(line(r.randint(1, 4), ""), False, r.random() < 0.8) for _ in range(r.randint(3, 6))]
    html = "<html><body>" + box(menu) + box(body) + box(foot) + "</body></html>"
    return html, [(t, content) for t, content, _ in made]


def test_the_cut_decides_and_helps():
    """On pages without marks, blocks change sides by the cut, and held-out F1 rises over the classifier alone."""
    right = {}
    for name, edges in (("alone", (0.0, 0.0)), ("cut", (mincut_extract.NEIGHBOURS, mincut_extract.SIBLINGS))):
        hit = found = real = 0
        for seed in range(60):
            html, want = plain_page(seed)
            got = mincut_extract.labelled(html, mincut_extract.WEIGHTS, *edges)
            assert [t for t, _ in got] == [t for t, _ in want]
            hit += sum(a and b for (_, a), (_, b) in zip(got, want, strict=True))
            found, real = found + sum(a for _, a in got), real + sum(b for _, b in want)
        right[name] = 2 * hit / (found + real)
    assert right["cut"] > right["alone"] + 0.03 and right["cut"] > 0.95, right


def test_classifier_learns_from_marked_pages(spark):
    pages = table(spark, SF, "pages")
    weights = mincut_extract.learned(pages)
    assert weights == mincut_extract.learned(pages) != mincut_extract.WEIGHTS
    found = [b for r in table(spark, "/root/testdata/sf0.01", "pages").collect()[100:] for b in mincut_extract.blocks(r.html) if b[2] in (mincut_extract.OUT, mincut_extract.IN)]
    score = [sum(a * b for a, b in zip(weights, mincut_extract.features(t, links, tag), strict=True)) > 0 for t, links, _, _, tag, _ in found]
    assert sum(s == (b[2] == mincut_extract.IN) for s, b in zip(score, found, strict=True)) / len(found) > 0.9
    assert mincut_extract.learned(pages.where("false")) == mincut_extract.WEIGHTS


def test_all_pages_give_their_article(spark):
    """op5 on whole pages, against the texts between the tags of the one article that each holds."""
    want = {}
    for r in table(spark, SF, "pages").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        inner = re.sub(r"<script.*?</script>|<style.*?</style>|<!--.*?-->", " ", inner, flags=re.S)
        inner = re.sub(r"<div class=\"ad\">.*?</div>", " ", inner, flags=re.S)
        want[r.page_id] = " ".join(html_module.unescape(re.sub(r"<(?:/?(?:p|h1|h2|h3|li|ul|ol|div|br|blockquote)\b[^>]*)>", " ", inner)).replace("<b>", "").replace("</b>", "").split())
    got = {r.page_id: r.text for r in mincut_extract.op5_mincut_extract(spark, SF).collect()}
    assert got.keys() == want.keys()
    assert sum(re.sub(r"<[^>]*>", "", want[i]).split() == got[i].split() for i in want) / len(want) > 0.95


@pytest.mark.parametrize("html", ["<a " * 330_000, "<!" * 500_000, "<a '\"" * 200_000, "<script " * 125_000, "<b>" * 150_000 + "</i>" * 150_000, "<div>" * 100_000 + "x</div>" * 50_000, '<a href="x ' * 90_000])
def test_broken_pages_take_linear_time(html):
    begun = time.process_time()
    mincut_extract.main_text(html)
    assert time.process_time() - begun < 8


def test_articles_in_layout_containers():
    story = "<p>A long enough sentence, with a comma, that a reader would want to see.</p>" * 3
    inside = "A long enough sentence, with a comma, that a reader would want to see."
    for html in (f'<div class="site sidebar-right"><article>{story}</article></div>', f"<form><main>{story}</main></form>", f'<div class="menu-open"><div role="main">{story}</div></div>'):
        assert mincut_extract.main_text(html) == " ".join([inside] * 3), html
    for html in (f'<div id="comments"><article>{story}</article></div>', f"<footer><article>{story}</article></footer>", f"<aside><main>{story}</main></aside>"):
        assert mincut_extract.main_text(html) == "", html


def test_extract_odd_inputs(spark):
    rows = [(1, "u", None, 1, "p", "s", 2), (2, None, "", 1, "p", "s", 2), (None, "u", "<<<>>> &#x;&bogus; <p", 1, "p", "s", 2), (3, "u", PAGE, 1, "p", "s", 2), (3, "u", PAGE, 1, "p", "s", 2), (4, "u", "<div>" * 3000 + "<p>Deep text, in many boxes.</p>" + "x " * 20000, 1, "p", "s", 2)]
    pages = spark.createDataFrame(rows, PAGES)
    got = mincut_extract.extract(pages).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {"page_id", "url", "text", "n_chars", "payload", "sha", "least"}
    assert all(r.n_chars == len(r.text) for r in got)
    assert {r.text for r in got if r.page_id in (1, 2)} == {""}
    assert len({r.text for r in got if r.page_id == 3}) == 1
    assert mincut_extract.extract(pages.where("false")).count() == 0


@pytest.mark.parametrize(("measure", "width", "spread"), [("ip", 192, 0), ("l2", 64, 1.5)])
def test_neighbours_are_found_where_codes_say_little(spark, measure, width, spread):
    r = np.random.default_rng(5)
    x = r.normal(size=(3000, width)) * np.exp(spread * r.normal(size=3000))[:, None]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, v array<double>")
    got = {(g.query_id, g.vec_id) for g in additive_ann.nearest(rows, rows.where("id % 20 = 0"), 20, measure, reranked=20).collect()}
    q = np.arange(0, 3000, 20)
    score = x[q] @ x.T if measure == "ip" else -((x[q, None] - x[None]) ** 2).sum(2)
    score[np.arange(len(q)), q] = -np.inf
    want = {(int(a), int(b)) for a, near in zip(q, np.argsort(-score, axis=1)[:, :20], strict=True) for b in near}
    assert len(got & want) >= 0.95 * len(want)
