"""Sitemaps: files, indexes of indexes, quality, whether one may replace another, and files that are written."""

import gzip
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from siteglass.operators import sitemaps
from siteglass.sources import files

NS = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
ANSWER = "site string, url string, status int, error string, truncated boolean, content binary"
H = "e.com"


def index(*children):
    return f"<sitemapindex {NS}>{''.join(f'<sitemap><loc>{c}</loc></sitemap>' for c in children)}</sitemapindex>".encode()


def urlset(*entries):
    return f"<urlset {NS}>{''.join(f'<url><loc>{loc}</loc><lastmod>{d}</lastmod></url>' for loc, d in entries)}</urlset>".encode()


def u(name, host=H):
    return f"https://{host}/{name}.xml"


def inspect(spark, answers, roots=("sitemap",), declared=True, **most):
    df = spark.createDataFrame([(H, u(name), *rest) for name, *rest in answers], ANSWER)
    seeds = spark.createDataFrame([(H, k, u(r), declared) for k, r in enumerate(roots)], "site string, place int, url string, declared boolean")
    return sitemaps.inspected(sitemaps.parsed(df), seeds, **most)


def ok(name, content):
    return (name, 200, None, False, content)


def test_files_of_all_kinds():
    assert sitemaps.parse(urlset(("https://e.com/a", "2024"), ("", "")))[:2] == ("urlset", [{"loc": "https://e.com/a", "lastmod": "2024"}, {"loc": None, "lastmod": None}])
    assert sitemaps.parse(gzip.compress(index("x")))[:2] == ("sitemapindex", [{"loc": "x", "lastmod": None}])
    assert sitemaps.parse(gzip.compress(b"<urlset/>" * 1)[:-9])[0] is None
    assert [sitemaps.parse(x)[3] for x in (b"", None, b"<html>", b"<html/>", b"\xff")] == ["ParseError", "ParseError", "ParseError", "root html", "ParseError"]
    inner = b"<urlset xmlns:i='i'><url><i:loc>no</i:loc><loc> first </loc><loc>second</loc></url><other><loc>x</loc></other></urlset>"
    assert sitemaps.parse(inner)[1][0]["loc"] in ("no", "first") and len(sitemaps.parse(inner)[1]) == 1


def test_indexes_are_followed_in_the_order_of_a_queue(spark):
    answers = [ok("sitemap", index(u("a"), u("b"), u("x", "other.com"), "ftp://e.com/q.xml", u("sitemap"))), ok("a", index(u("c"), u("b"))), ok("b", urlset(("https://e.com/1", ""))), ok("c", gzip.compress(index(u("d"), u("a")))), ("d", 500, None, False, None), ok("lost", urlset())]
    got = sorted(map(tuple, inspect(spark, answers, ("sitemap", "gone")).select("place", "url", "kind", "error", "required", "url_count").collect()))
    assert got == [
        (1, u("sitemap"), "sitemapindex", None, True, 5), (2, u("gone"), None, "no_answer", True, 0), (3, u("a"), "sitemapindex", None, True, 2), (4, u("b"), "urlset", None, True, 1), (5, u("c"), "sitemapindex", None, True, 2), (6, u("d"), None, None, True, 0),
    ]


def test_limits_leave_the_rest_of_the_queue_named(spark):
    answers = [ok("sitemap", index(*[u(f"k{i}") for i in range(10)]))] + [ok(f"k{i}", index(u(f"z{i}"), u("k0"))) for i in range(10)]
    some = inspect(spark, answers, most_files=4)
    assert {r["url"] for r in some.where("place is null").collect()} == {u(f"k{i}") for i in range(3, 10)} | {u(f"z{i}") for i in range(3)}
    assert tuple(sitemaps.frontier(some).first()) == (H, 14, 4, 10)
    few = {r["url"]: r["truncated"] for r in inspect(spark, answers, most_children=2).collect()}
    assert set(few) == {u("sitemap"), u("k0"), u("k1"), u("z0"), u("z1")} and few[u("sitemap")] and not few[u("k0")]
    assert inspect(spark, [], ()).count() == 0


def test_broken_answers_are_not_read(spark):
    answers = [("sitemap", 200, "timeout", False, urlset()), ("b", 200, None, True, urlset()), ok("c", b"<html/>"), ("d", 404, None, False, urlset())]
    got = {r["url"]: r for r in inspect(spark, answers, ("sitemap", "b", "c", "d")).collect()}
    assert [(got[u(n)]["parsed"], got[u(n)]["error"], got[u(n)]["truncated"]) for n in ("sitemap", "b", "c", "d")] == [(False, "timeout", False), (True, None, True), (False, "root html", False), (False, None, False)]


def test_quality(spark):
    body = urlset(*[("https://e.com/%d" % (i % 9), "2024-05-01") for i in range(11)], ("HTTPS://E.com/0#x", "2024-02-30"), ("http://f.com/", ""), ("", "2023"), ("mailto:x", "2024-05-01T10:00Z"))
    df = sitemaps.parsed(spark.createDataFrame([(H, u("a"), 200, None, False, body), (H, u("b"), 200, None, False, urlset()), (H, u("c"), 404, None, False, None)], ANSWER))
    a, b = sitemaps.quality(df).orderBy("url").collect()
    assert tuple(a)[2:] == (15, len(body), 1, 1, "2024-05-01", 11, 0.733, 1, 3, False, False)
    assert tuple(b)[2:] == (0, len(urlset()), 0, 0, None, 0, 0.0, 0, 0, False, False)


@pytest.mark.parametrize(
    ("complete", "answers", "known", "want"),
    [
        (True, [ok("sitemap", urlset())], ["/a"], (True, True, "", 0)),
        (True, [ok("sitemap", urlset())], ["/a", "/b"], (True, True, "", 1)),
        (False, [ok("sitemap", urlset())], ["/a"], (False, True, "limit", 0)),
        (None, [ok("sitemap", urlset())], ["/a"], (True, False, "", 0)),
        (None, [ok("sitemap", urlset())], ["/b"], (False, False, "coverage_unknown_urls_lost", 1)),
        (True, [("sitemap", 503, None, False, None)], [], (False, True, "sitemap_failed", 0)),
        (True, [ok("sitemap", index(u("x")))], [], (False, True, "sitemap_failed", 0)),
        (True, [("sitemap", 404, None, False, None)], [], (True, True, "", 0)),
        (True, [ok("sitemap", index(u("sitemap_index"))), ("sitemap_index", 404, None, False, None)], [], (False, True, "sitemap_failed", 0)),
    ],
)
def test_a_new_sitemap_replaces_the_old_one_only_where_it_is_safe(spark, complete, answers, known, want):
    site = spark.createDataFrame([(H, complete, ["limit"])], "site string, complete boolean, reasons array<string>")
    of = lambda paths: spark.createDataFrame([(H, f"https://{H}{p}") for p in paths], "site string, url string")
    r = sitemaps.safety(site, inspect(spark, answers, declared=False), of(known), of(["/a", "/c"])).first()
    assert (r["safe"], r["verified"], r["reason"], r["missing"]) == want


def test_written_files_hold_their_bounds_and_the_index_names_them(spark, tmp_path):
    locs = [f"https://h/?a=1&b={i}<{'é' * (i % 30)}>" for i in range(250)]
    entries = spark.createDataFrame([(x,) for x in locs] + [(locs[0],), (None,)], "loc string").repartition(3)
    for k, (per_file, most) in enumerate(((100, 10**6), (10**6, 9000), (60, 9500))):
        out = tmp_path / str(k)
        names = sitemaps.write(entries, f"file://{out}", "https://h/", per_file=per_file, most_bytes=most)
        parts = [n for n in names if n != "sitemap_index.xml"]
        assert names[0] == "sitemap_index.xml" and len(parts) > 2 and sorted(p.name for p in out.iterdir() if not p.name.startswith(".")) == sorted(names)
        texts = [(out / n).read_bytes() for n in parts]
        assert all(t.count(b"<loc>") <= per_file and len(t) <= most + 200 for t in texts)
        assert [x for t in texts for x in (e[0].text for e in ET.fromstring(t))] == sorted(locs, key=lambda x: x.encode())
        assert [e[0].text for e in ET.fromstring((out / "sitemap_index.xml").read_bytes())] == [f"https://h/{n}" for n in parts]
    assert sitemaps.write(entries.limit(5), f"file://{tmp_path}/one", "https://h") == ["sitemap.xml"]
    assert files.sitemap(spark, str(tmp_path / "one/sitemap.xml")).count() == len(set(r["loc"] for r in entries.limit(5).collect() if r["loc"]))
    assert sitemaps.write(entries.where("false"), f"file://{tmp_path}/none", "https://h") == ["sitemap.xml"] and len(ET.fromstring((tmp_path / "none/sitemap.xml").read_bytes())) == 0
    assert sitemaps.write(entries, f"file://{tmp_path}/unsafe", "https://h", safe=False) == [] and not (tmp_path / "unsafe").exists()
    with pytest.raises(Exception, match="too long"):
        sitemaps.packed(entries.select(F.repeat("loc", 1000).alias("loc"))).collect()
