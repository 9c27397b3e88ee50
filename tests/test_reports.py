"""Tables of a report on small inputs."""

import datetime as d
from decimal import Decimal

from pyspark.sql import functions as F

from siteglass.operators import reports


def test_rates_that_do_not_add_up(spark):
    rows = spark.createDataFrame([(1, 10, 100, 0.1), (2, 10, 100, 0.106), (3, 10, 100, 0.1049), (4, 0, 0, 0.5), (5, 10, 100, None)], "id int, clicks long, impressions long, ctr double")
    assert [(r["id"], r["computed"]) for r in reports.rate_mismatches(rows).collect()] == [(2, 0.1)]


def test_gaps_name_the_first_days(spark):
    day = lambda n: d.date(2024, 1, 1) + d.timedelta(n)
    rows = spark.createDataFrame([(day(0),), (day(100),)], "date date")
    r = reports.gaps(rows).first()
    assert r["missing"] == 99 and r["first"] == [day(k) for k in range(1, 63)]
    assert tuple(reports.gaps(rows.where("false")).first()) == (0, [])


def test_costs_without_a_price_are_not_zero(spark):
    calls = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "engine string")
    price = spark.createDataFrame([("a", Decimal("0.0003"))], "engine string, price decimal(18,4)")
    r = reports.costs(calls, price).first()
    assert r["total"] == Decimal("0.0006") and r["priced_calls"] == 2 and [(x["engine"], x["calls"]) for x in r["unknown"]] == [(None, 1), ("b", 1)]
    r = reports.costs(calls, price.where("false")).first()
    assert r["total"] is None and r["priced_calls"] == 0 and len(r["unknown"]) == 3


def test_ages(spark):
    rows = spark.createDataFrame([(d.date(2024, 1, 1),), (d.date(2024, 5, 1),), (d.date(2024, 1, 2),), (d.date(2024, 5, 2),), (None,)], "checked_at date")
    assert [r["state"] for r in reports.staleness(rows.coalesce(1), "2024-05-01").collect()] == ["stale", "fresh", "fresh", "future", "unknown"]


def test_classes_of_domains_by_their_longest_suffix(spark):
    cited = spark.createDataFrame([("a.b.com",), ("b.com",), ("x.a.b.com",), ("ab.com",), ("my.org",), ("s.my.org",), ("notmy.org",)], "domain string")
    classes = spark.createDataFrame([("b.com", "news"), ("a.b.com", "press"), ("my.org", "never")], "suffix string, class string")
    got = {r["domain"]: r["class"] for r in reports.domain_classes(cited, classes, "my.org").collect()}
    assert got == {"a.b.com": "press", "x.a.b.com": "press", "b.com": "news", "ab.com": "other", "my.org": "owned", "s.my.org": "owned", "notmy.org": "other"}


def test_runs_meet_classes_by_the_sets_of_domains_that_they_cite(spark):
    """No row of a run goes to the one task of a domain that all runs cite, and rows are read once."""
    many = spark.range(5000).select(F.col("id").alias("seq"), F.when(F.col("id") % 2 == 0, F.array(F.lit("https://my.org/a"))).otherwise(F.array(F.lit("https://my.org/a"), F.lit("https://x.b.com/"))).alias("cited_urls"))
    few = spark.createDataFrame([(1, ["http://b.com"]), (1, ["http://x.b.com/2", None]), (2, ["http://c.com", "http://www.my.org:80/"]), (6000, []), (6001, None), (6002, [None])], "seq long, cited_urls array<string>")
    rows = many.unionByName(few)
    assert {tuple(r["domains"]): r["n"] for r in reports.domain_sets(rows).collect()} == {("my.org",): 2499, ("my.org", "x.b.com"): 2499, ("b.com", "my.org", "x.b.com"): 1, ("c.com", "my.org"): 1, (): 3}
    got = reports.channel_domains(rows, spark.createDataFrame([("b.com", "news")], "suffix string, class string"), "my.org")
    assert sorted(map(tuple, got.collect())) == [("news", 2500, ["x.b.com", "b.com"]), ("other", 1, ["c.com"]), ("owned", 5000, ["my.org"])]
    assert "Range (" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_sites_are_compared_on_their_own_host_and_only_with_a_sitemap(spark):
    listed = spark.createDataFrame([("e.com", "https://e.com/a/"), ("e.com", "https://other.com/x"), ("e.com", "https://e.com/b")], "site string, url string")
    there = spark.createDataFrame([("e.com", "http://e.com/a"), ("e.com", "https://e.com/c"), ("f.com", "https://f.com/")], "site string, url string")
    assert sorted(tuple(r) for r in reports.sitemap_against_crawl(listed, there).collect()) == [("e.com", "e.com/b", "sitemap"), ("e.com", "e.com/c", "crawl")]


def test_texts_are_reconciled_in_their_folded_form(spark):
    old = spark.createDataFrame([(1, "What  is ＩＴ?"), (2, "Straße"), (3, "x")], "id long, text string")
    new = spark.createDataFrame([(1, "what is it?"), (2, "Weg"), (9, "STRASSE"), (10, "y")], "id long, text string")
    assert {r["id"]: r["state"] for r in reports.reconciled(new, old).collect()} == {1: "same", 2: "changed", 9: "text_taken", 10: "new"}


def test_pages_wait_for_findings_of_their_url_or_site(spark):
    rows = [("f1", "finding", "critical", "u", "s"), ("f2", "finding", "critical", None, "s"), ("f3", "finding", "warn", "u", "s"), ("f4", "finding", "critical", None, "t"), ("p1", "page", None, "u", "s"), ("p2", "page", None, "v", "s"), ("p3", "page", "critical", "v", None)]
    got = reports.blocked_by(spark.createDataFrame(rows, "id string, kind string, severity string, url string, site string"))
    assert sorted(tuple(r) for r in got.collect()) == [("p1", "f1"), ("p1", "f2"), ("p2", "f2")]


def test_pages_and_findings_that_repeat_wait_once_and_only_they_are_made_distinct(spark):
    rows = [("p1", "page", None, "u", "s"), ("p1", "page", None, "u", "t"), ("p1", "page", None, "v", "s"), ("p2", "page", None, None, "s"), ("f1", "finding", "critical", "u", "s"), ("f1", "finding", "critical", "v", "s"), ("f1", "finding", "critical", None, "s"), ("f2", "finding", "critical", None, "s"), ("f3", "finding", "info", "u", "s"), ("f4", "finding", "critical", None, None)]
    got = reports.blocked_by(spark.createDataFrame(rows, "id string, kind string, severity string, url string, site string"))
    assert sorted(map(tuple, got.collect())) == [("p1", "f1"), ("p1", "f2"), ("p2", "f1"), ("p2", "f2")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union")


def test_rows_of_a_finding_lie_together_and_findings_travel_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(reports, "BLOCK", 3, raising=False)
    rows = [(f"p{i}", "page", None, f"u{i % 2}", "s" if i % 3 else None) for i in range(700)] + [(f"f{i}", "finding", "critical", f"u{i % 2}" if i % 5 else None, "s") for i in range(120)]
    rows += [("f1", "finding", "critical", "u0", "s"), ("f1", "finding", "critical", None, "s"), (None, "finding", "critical", "u0", "s"), (None, "page", None, "u0", None)]
    got = reports.blocked_by(spark.createDataFrame(rows, "id string, kind string, severity string, url string, site string"))
    pages, found = ([r for r in rows if r[1] == kind] for kind in ("page", "finding"))
    want = {(p[0], f[0]) for p in pages for f in found if (f[3] == p[3] if f[3] else f[4] == p[4])}
    lists = [[tuple(r) for r in part] for part in got.select(F.spark_partition_id().alias("n"), "id", "blocker").groupBy("n").agg(F.collect_list(F.struct("id", "blocker")).alias("x")).toPandas()["x"]]
    every = [r for part in lists for r in part]
    assert len(every) == len(want) and set(every) == want
    # what one part of a key says of one finding is one run, so runs are few next to rows
    runs = sum(a[1] != b[1] for part in lists for a, b in zip(part, part[1:], strict=False))
    assert runs < len(every) / 2
    assert "collect_list" in got._jdf.queryExecution().optimizedPlan().toString()
