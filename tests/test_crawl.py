"""Page records, findings, JSON-LD, planning helpers, logs and streams on small fixtures."""

from urllib.parse import urldefrag, urljoin

import pytest
from pyspark.sql import functions as F

from siteglass.functions import text, urls
from siteglass.operators import crawl, jsonld, measure, planning
from siteglass.sources import files
from siteglass.streaming import log

PAGE = """<!doctype html><html lang="ko"><head><title> A  title | Shop </title><meta name='description' content="About it"><meta name=robots content="NoSnippet, max-snippet: 0">
<link rel="canonical" href="../a?x=1#top"><link rel="alternate" hreflang="EN" href="/en"><meta property="og:title" content="t"><!-- <h1>no</h1> -->
<script type="application/ld+json">{"@type": "FAQPage"}</script><script type="application/ld+json">{bad</script></head>
<body><h1>First <b>one</b></h1><h1>Two</h1><a href="next">n</a><a href="#x">self</a><a href='//other.org/y'>o</a><script>var a = "<h1>z</h1>";</script>text</body></html>"""
CRAWL = "page_id long, url string, final_url string, status int, x_robots string, intended_indexable boolean, html string"


def test_absolute_urls(spark):
    bases = ["http://h.org/a/b?q=1", "https://h.org", "http://h.org/a/", "http://h.org/a/b/c"]
    refs = ["x", "../x", "../../../x", "./", "..", "/y?z", "?k=1", "", "#f", "//o.org/p#f", "https://o.org/p", "x/./y/../z", "http://h2.org", "a:b"[0:1], "x;y", "../", "/a/../b"]
    got = spark.createDataFrame([(b, r) for b in bases for r in refs], "b string, r string").select("b", "r", urls.absolute(F.col("b"), F.col("r")).alias("u")).collect()
    assert all(x.u == urldefrag(urljoin(x.b, x.r))[0] for x in got if not (x.b == "https://h.org" and x.r in ("", "#f", "?k=1", "./", "..", "../", "../x", "../../../x"))), [(x.b, x.r, x.u, urljoin(x.b, x.r)) for x in got if x.u != urldefrag(urljoin(x.b, x.r))[0]]
    assert spark.range(1).select(urls.absolute(F.lit("http://h.org/a"), F.lit("mailto:x@y.z"))).first()[0] == "mailto:x@y.z"


def test_page_record(spark):
    pages = spark.createDataFrame([(1, "http://h.org/d/p", None, 200, "googlebot: noindex\nother: none", True, PAGE), (2, "http://h.org/d/q", None, 200, None, True, None)], CRAWL)
    r = crawl.records(pages).orderBy("page_id").collect()
    assert (r[0].title, r[0].description, r[0].canonical, r[0].lang, r[0].h1) == ("A title | Shop", "About it", "http://h.org/a?x=1", "ko", ["First one", "Two"])
    assert r[0].links == ["http://h.org/d/next", "http://h.org/d/p", "http://other.org/y"] and r[0].hreflang == ["en http://h.org/en"] and r[0].og_count == 1
    assert (r[0].jsonld_blocks, r[0].jsonld_invalid, r[0].jsonld_types) == (2, 1, ["FAQPage"]) and r[0].directives == ["max-snippet:0", "noindex", "nosnippet", "other:none"]
    assert (r[1].title, r[1].h1, r[1].text_chars, r[1].canonical) == ("", [], 0, None)
    codes = {f.code for f in crawl.page_findings(crawl.records(pages)).where("page_id = 1").collect()}
    assert {"NOINDEX", "SNIPPET_RESTRICTED", "CANONICAL_NOT_SELF", "H1_MULTIPLE", "JSONLD_INVALID", "THIN_TEXT"} <= codes and not codes & {"JSONLD_MISSING", "TITLE_MISSING", "CANONICAL_MISSING"}


def test_directives_keep_their_scope(spark):
    cases = [("noindex", None, ["noindex"]), (None, "none", ["nofollow", "noindex", "none"]), (None, "otherbot: noindex, nofollow", []), ("all", "googlebot: max-snippet:0, nosnippet", ["all", "max-snippet:0", "nosnippet"]), (None, "otherbot: noindex\ngooglebot: nofollow", ["nofollow"])]
    cases += [("noindex nofollow", None, ["nofollow", "noindex"]), (None, "otherbot: noindex\nnoindex", ["noindex"]), (None, "x: noindex", ["x:noindex"]), ("a;b", "googlebot-news: noindex, nosnippet", ["a", "b"]), (None, "GoogleBot : noindex , nofollow\r\notheruser: all", ["nofollow", "noindex"])]
    got = spark.createDataFrame(cases, "m string, h string, want array<string>").select("want", text.page_directives(F.col("m"), F.col("h"), "Googlebot").alias("got")).collect()
    assert all(r.want == r.got for r in got), got


def test_leaves_and_values(spark):
    rows = [(1, '{"@type": ["B", "A"], "a~/b": [1, {"url": "HTTP://X.org#f"}], "n": null, "t": true, "price": 1.50, "sku": "007"}'), (2, "{broken"), (3, None), (4, '"alone"')]
    got = {(r.id, r.pointer): (r.value, r.kind, r.types) for r in jsonld.leaves(spark.createDataFrame(rows, "id long, j string"), "id", "j").collect()}
    assert got[1, "/a~0~1b/1/url"] == ("HTTP://X.org#f", "string", []) and got[1, "/n"] == ("null", "null", ["A", "B"]) and got[1, "/t"][1] == "boolean" and got[4, ""][0] == "alone"
    cases = [("price", "1.50", "1.5", True), ("sku", "007", "7", False), ("price", "007", "7", False), ("name", " a  b", "a b", True), ("url", "HTTP://X.org", "http://x.org/", True), ("value", "1.0", "1", False)]
    same = jsonld.same_value(F.col("a"), F.col("b"), F.col("k"), F.array().cast("array<string>"), F.lit("string"), F.lit("string"))
    assert all(r.want == r.same for r in spark.createDataFrame(cases, "k string, a string, b string, want boolean").withColumn("same", same).collect())


def test_numbering_in_pieces(spark):
    rows = spark.range(1000).select((F.col("id") % 3 == 0).alias("k"), F.col("id"))
    got = {r.id: r.turn for r in planning.numbered(rows, ["k"], "id", step=7).collect()}
    for k in (True, False):
        assert [got[i] for i in range(1000) if (i % 3 == 0) == k] == list(range(1, 1 + sum((i % 3 == 0) == k for i in range(1000))))


def test_log_chain(spark, tmp_path):
    line = '{{"schema": "v2", "date": "2024-01-01", "question_id": "q", "engine": "e", "run_no": 1, "fingerprint": "f", "outcome": "{0}", "reservation": {1}{2}}}\n'
    (tmp_path / "log.jsonl").write_text(line.format("unmeasured", "true", "") + line.format("observed", "false", ', "session_id": "s"') + line.format("observed", "false", ', "session_id": "t"') + line.format("odd", "false", "") + '{"schema": "v9", "date": "2024-01-01", "engine": "e"}\n{"date": "", "engine": "e"}\n{"date": "2024-01-01", "engine": "?"}\n')
    rows, broken = files.observation_log(spark, str(tmp_path))
    rows = files.gated(rows, ["e"], ["v2"]).withColumn("seq", F.monotonically_increasing_id())
    assert rows.count() == 3 and broken.count() == 0
    assert sorted(r.session_id for r in measure.current(rows).collect()) == ["s", "t"]


def test_exports_are_taken_whole_or_not(spark, tmp_path):
    (tmp_path / "ok.csv").write_text("Queries,Clicks,Impressions,CTR,Average position\na,1,2,50%,1\n")
    assert [tuple(r) for r in files.search_export(spark, str(tmp_path / "ok.csv")).collect()] == [("a", 1, 2, 0.5, 1.0)]
    for n, row in enumerate(("a,1,2,50%,-3", "a,1,2,50%,1e3", "a,1,2,1e-1,1", "a,x,2,50%,1")):
        (tmp_path / f"bad{n}.csv").write_text(f"Queries,Clicks,Impressions,CTR,Position\nb,1,2,50%,1\n{row}\n")
        with pytest.raises(Exception, match="search export"):
            files.search_export(spark, str(tmp_path / f"bad{n}.csv")).collect()
    for head in ("Queries,Pages,Clicks,Impressions,CTR,Position", "Queries,Clicks,Clicks,Impressions,CTR,Position", "Queries,Clicks,Impressions,CTR", "Odd,Clicks,Impressions,CTR,Position"):
        with pytest.raises(ValueError):
            files.export_columns(head.split(","))


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"k": "x", "n": 1, "t": "2024-01-01T00:00:10Z", "engine": "e", "outcome": "error"}\n{"k": "x", "n": 2, "t": "2024-01-01T00:05:00Z", "engine": "e", "outcome": "observed"}\n')
    stream = spark.readStream.schema("k string, n long, t timestamp, engine string, outcome string").json(str(tmp_path / "in"))
    for name, df, mode in (("latest", log.latest(stream, ["k"], "n"), "complete"), ("windowed", log.windowed(stream, "t", "1 minute", "1 hour"), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
    assert [(r.k, r.n) for r in spark.table("latest").collect()] == [("x", 2)]
    assert sorted((r.attempts, r.errors) for r in spark.table("windowed").collect()) == [(1, 0), (1, 1)]
