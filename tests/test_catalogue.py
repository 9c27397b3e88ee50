"""Each code of the audit on a site that earns it and on one that does not; scorecards, coverage and checks of two audits."""

import pytest

from siteglass.operators import catalogue, crawl

FACTS = "site string, page_id long, url string, status int, intended_indexable boolean, title string, description string, canonical string, h1 array<string>, jsonld_blocks int, jsonld_invalid int, jsonld_types array<string>, text_chars int, directives array<string>, naver_verified boolean, internal_links int, linked boolean"
PAGE = {"url": None, "status": 200, "intended_indexable": True, "title": "A title of a page that is as long as it should be, {n}", "description": "A description that says in as many words as it should what the page is about, and neither more nor less than that {n}", "canonical": None, "h1": ["One"], "jsonld_blocks": 1, "jsonld_invalid": 0, "jsonld_types": ["FAQPage"], "text_chars": 500, "directives": [], "naver_verified": True, "internal_links": 3, "linked": True}
SITE = {"complete": True, "robots_state": "ok", "sitemap_declared": 1, "sitemaps_live": 1, "sitemaps_read": 1, "only_in_sitemap": 0, "only_in_crawl": 0, "llms_status": 200, "probe_404": 404, "redirect_hops": 1, "alt_result": "ok", "mirrors": [], "hidden_hosts": 0, "wildcard": False, "nonstandard_agents": 0, "managed": False, "content_signals": 0, "proxied": False}
QUALITY = {"over_limit": 0, "foreign_host": 0, "duplicate_urls": 0, "lastmod_invalid": 0, "lastmod_missing": 0, "uniform": 0}
MIRROR = lambda kind, blocked: {"mirrors": [("dev.e.com", kind, blocked)]}
#: Code: what is different on all pages, on the first page, of the site, of its sitemaps.
EARNED = {
    "NOINDEX": ({}, {"directives": ["noindex"]}), "INTENTIONAL_NOINDEX": ({}, {"directives": ["noindex"], "intended_indexable": False}), "SNIPPET_RESTRICTED": ({}, {"directives": ["max-snippet:0"]}), "TITLE_DUPLICATE": ({"title": "The same title on all of the pages of this one site"}, {}),
    "TITLE_MISSING": ({}, {"title": ""}), "TITLE_TOO_LONG": ({}, {"title": "x" * 61}), "TITLE_TOO_SHORT": ({}, {"title": "x" * 19}), "DESC_DUPLICATE": ({"description": PAGE["description"].replace("{n}", "")}, {}), "DESC_MISSING": ({}, {"description": ""}), "DESC_TOO_LONG": ({}, {"description": "x" * 161}),
    "DESC_TOO_SHORT": ({}, {"description": "x" * 74}), "JSONLD_INVALID": ({}, {"jsonld_invalid": 1}), "JSONLD_MISSING": ({}, {"jsonld_blocks": 0}), "FAQ_MISSING": ({"jsonld_types": []}, {"jsonld_types": ["Organization"]}), "ORG_JSONLD_MISSING": ({}, {"jsonld_types": ["FAQPage"]}), "ORG_JSONLD_SCATTERED": ({"jsonld_types": ["FAQPage", "Corporation"]}, {}),
    "CANONICAL_MISSING": ({}, {"canonical": None}), "CANONICAL_NOT_SELF": ({}, {"canonical": "https://e.com/other"}), "H1_MISSING": ({}, {"h1": []}), "H1_MULTIPLE": ({}, {"h1": ["a", "b"]}), "THIN_TEXT": ({}, {"text_chars": 299}), "LINKS_NOT_IN_HTML": ({}, {"internal_links": 0}), "SITEMAP_ONLY_PAGES": ({}, {"linked": False}),
    "HTTP_ERROR": ({}, {"status": None}), "HTTP_THROTTLED": ({}, {"status": 429}), "NAVER_VERIFY_MISSING": ({"naver_verified": False}, {}),
    "CRAWL_INCOMPLETE": ({}, {}, {"complete": False}), "ROBOTS_UNREACHABLE": ({}, {}, {"robots_state": "unreachable"}), "ROBOTS_MISSING": ({}, {}, {"robots_state": "absent"}), "SITEMAP_NOT_DECLARED": ({}, {}, {"sitemap_declared": 0}), "SITEMAP_MISSING": ({}, {}, {"sitemaps_live": 0}), "SITEMAP_CRAWL_MISMATCH": ({}, {}, {"only_in_crawl": 1}),
    "LLMS_TXT_MISSING": ({}, {}, {"llms_status": None}), "SOFT_404": ({}, {}, {"probe_404": 200}), "REDIRECT_HOPS": ({}, {}, {"redirect_hops": 2}), "ALT_HOST_UNREACHABLE": ({}, {}, {"alt_result": "tls_fail"}), "ALT_HOST_NONPUBLIC": ({}, {}, {"alt_result": "nonpublic_address"}), "MIRROR_NOINDEX": ({}, {}, MIRROR("noindex", True)), "MIRROR_PRESENT": ({}, {}, MIRROR("unrestricted", True)),
    "MIRROR_PUBLIC": ({}, {}, MIRROR("unrestricted", False)), "MIRROR_INDEXABILITY_UNKNOWN": ({}, {}, MIRROR(None, False)), "MIRROR_NONPUBLIC_DNS": ({}, {}, {"hidden_hosts": 1}), "MIRROR_WILDCARD_DNS": ({}, {}, {"wildcard": True}), "ROBOTS_NONSTANDARD_UA": ({}, {}, {"nonstandard_agents": 1}), "ROBOTS_CDN_MANAGED": ({}, {}, {"managed": True}), "CONTENT_SIGNAL_PRESENT": ({}, {}, {"content_signals": 1}), "PROXY_ADDRESS_UNVERIFIED": ({}, {}, {"proxied": True}),
    **{code: ({}, {}, {}, {name: 1}) for code, name in (("SITEMAP_LIMIT_EXCEEDED", "over_limit"), ("SITEMAP_FOREIGN_HOST", "foreign_host"), ("SITEMAP_DUPLICATE_URLS", "duplicate_urls"), ("SITEMAP_LASTMOD_INVALID", "lastmod_invalid"), ("SITEMAP_LASTMOD_MISSING", "lastmod_missing"), ("SITEMAP_LASTMOD_UNIFORM", "uniform"))},
}


def tables(spark, cases):
    """Facts, sites and quality of sites named by cases: (all pages, first page, site, quality)."""
    pages, sites, quality = [], [], []
    for name, (every, first, *rest) in cases.items():
        for k in range(5):
            p = PAGE | {"url": f"https://{name.lower().replace('_', '-')}.com/" + (f"p{k}" if k else "")}
            p |= {"title": p["title"].format(n=k), "description": p["description"].format(n=k), "canonical": p["url"], "jsonld_types": ["FAQPage", "Organization"] if k == 0 else ["FAQPage"]}
            p |= every | (first if k == 0 else {})
            pages.append((name, len(pages), *p.values()))
        sites.append((name, *(SITE | (rest[0] if rest else {})).values()))
        quality.append((name, *(QUALITY | (rest[1] if len(rest) > 1 else {})).values()))
    return spark.createDataFrame(pages, FACTS), spark.createDataFrame(sites, catalogue.SITE), spark.createDataFrame(quality, "site string, " + catalogue.QUALITY)


@pytest.fixture(scope="module")
def audited(spark):
    facts, sites, quality = tables(spark, {"clean": ({}, {})} | EARNED)
    out = {}
    for r in catalogue.audit(facts, sites, quality).collect():
        out.setdefault(r["site"], {})[r["code"]] = r
    return out


@pytest.mark.parametrize("code", EARNED)
def test_codes(audited, code):
    assert code in audited[code] and code not in audited.get("clean", {})
    assert set(audited[code]) <= {code, "CRAWL_INCOMPLETE", "JSONLD_MISSING"} or code in ("H1_MISSING", "HTTP_ERROR", "HTTP_THROTTLED", "FAQ_MISSING", "ROBOTS_UNREACHABLE", "ORG_JSONLD_SCATTERED"), set(audited[code])


def test_a_clean_site_has_no_findings_and_all_codes_are_there(audited):
    assert "clean" not in audited
    policies = {"AI_CRAWLER_BLOCKED", "AI_CRAWLER_PARTIAL", "AI_TRAINING_BLOCKED", "AI_CRAWLER_UNDECLARED", "NAVER_CRAWLER_BLOCKED", "DAUM_CRAWLER_BLOCKED", "DAUM_CRAWLER_UNDECLARED"}
    assert len(set(EARNED) | policies) == 60


def test_severities_evidence_and_what_a_robots_file_withholds(spark):
    cases = {"thin": ({"text_chars": 10}, {}), "alone": ({"linked": False}, {}), "open": ({"linked": False}, {}, {"complete": False}), "dark": ({"naver_verified": False}, {}, {"robots_state": "unreachable", "probe_404": 200, "sitemaps_live": 0}), "blank": ({"status": 500}, {})}
    facts, sites, quality = tables(spark, cases)
    got = {}
    for r in catalogue.audit(facts, sites.where("site <> 'blank'"), quality).collect():
        got.setdefault(r["site"], {})[r["code"]] = r
    assert got["thin"]["THIN_TEXT"]["severity"] == "critical" and got["thin"]["THIN_TEXT"]["pages"] == 5
    assert got["alone"]["SITEMAP_ONLY_PAGES"]["severity"] == "warn" and "SITEMAP_ONLY_PAGES" not in got["open"]
    assert got["thin"]["THIN_TEXT"]["urls"] == sorted(got["thin"]["THIN_TEXT"]["urls"]) and len(got["thin"]["THIN_TEXT"]["urls"]) == 5
    assert set(got["dark"]) == {"ROBOTS_UNREACHABLE"} and set(got["blank"]) == {"HTTP_ERROR"}
    none = catalogue.audit(facts.where("false"), sites.where("false"))
    assert none.count() == 0


def test_scorecards_and_coverage(spark):
    facts, sites, quality = tables(spark, {"good": ({}, {}), "bad": ({}, {"title": ""}), "dark": ({}, {"jsonld_invalid": 1}, {"robots_state": "unreachable"}), "part": ({}, {}, {"complete": None})})
    board = catalogue.scorecard(catalogue.audit(facts, sites, quality), sites)
    state = {(r["site"], r["lane"]): (r["state"], r["unassessed"]) for r in board.collect()}
    assert state["good", "SEO"] == ("ok", []) and state["good", "reputation"] == ("na", []) and state["bad", "SEO"][0] == "bad"
    assert state["dark", "AEO"] == ("warn", ["page_content"]) and state["dark", "GEO"] == ("na", ["crawler_policy"]) and state["dark", "SEO"] == ("warn", [])
    cover = {r["site"]: r for r in catalogue.lane_coverage(board, sites).collect()}
    assert [cover[s]["conclusive"] for s in ("good", "bad", "dark", "part")] == [True, True, False, False]
    assert cover["dark"]["partial"] == ["AEO"] and cover["dark"]["unassessed"] == ["GEO", "KEO", "LLMO", "NEO", "reputation"] and cover["good"]["total"] == 7


def test_checks_of_two_audits(spark):
    say = lambda rows: spark.createDataFrame(rows, "site string, code string, severity string, pages long")
    before = say([("a", "GONE", "warn", 1), ("a", "ROBOTS_MISSING", "warn", 0), ("a", "STAYS", "warn", 2), ("b", "ROBOTS_MISSING", "warn", 0), ("b", "GONE", "warn", 1), ("c", "GONE", "warn", 1), ("d", "STAYS", "critical", 1)])
    after = say([("a", "STAYS", "warn", 3), ("a", "NEW", "critical", 1), ("d", "STAYS", "critical", 1), ("d", "NEW", "warn", 1)])
    boards = spark.createDataFrame([("a", "SEO", "ok", "bad"), ("a", "AEO", "bad", "warn"), ("b", "SEO", "ok", "na"), ("c", "SEO", "na", "bad"), ("d", "SEO", "ok", "ok")], "site string, lane string, before string, after string")
    blind = spark.createDataFrame([("b", False, True), ("c", True, False)], "site string, skipped boolean, blind boolean")
    checks = catalogue.diff_checks(before, after, boards, blind, ("ROBOTS_MISSING",))
    got = {(r["site"], r["check"]): (r["status"], r["codes"]) for r in checks.collect()}
    assert got == {
        ("a", "diff.resolved"): ("pass", ["GONE", "ROBOTS_MISSING"]), ("a", "diff.persisting"): ("warn", ["STAYS"]), ("a", "diff.new"): ("fail", ["NEW"]), ("a", "diff.scorecard"): ("fail", ["SEO"]),
        ("b", "diff.unverified"): ("warn", ["ROBOTS_MISSING"]), ("b", "diff.resolved"): ("pass", ["GONE"]), ("b", "diff.scorecard"): ("warn", ["SEO"]),
        ("c", "diff.unverified"): ("warn", ["GONE"]), ("c", "diff.scorecard"): ("pass", []), ("d", "diff.persisting"): ("warn", ["STAYS"]), ("d", "diff.new"): ("pass", ["NEW"]), ("d", "diff.scorecard"): ("pass", []),
    }
    order = [r["check"] for r in catalogue.ordered(checks).where("site = 'a'").orderBy("place").collect()]
    assert order == ["diff.new", "diff.scorecard", "diff.persisting", "diff.resolved"]
    codes = catalogue.exit_codes(checks, checks.where("check = 'diff.unverified'"))
    assert {r["site"]: r["code"] for r in codes.collect()} == {"a": 1, "b": 2, "c": 2, "d": 0}


def test_markup_is_read_once_for_the_whole_audit(spark):
    pages = spark.createDataFrame([(i, f"http://h.org/{i}", None, 200, None, True, "<title>T</title>") for i in range(6)], "page_id long, url string, final_url string, status int, x_robots string, intended_indexable boolean, html string")
    from pyspark.sql import functions as F

    facts = catalogue.page_facts(crawl.records(pages), F.lit("s"))
    found = catalogue.audit(facts, spark.createDataFrame([("s", *SITE.values())], catalogue.SITE))
    assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()
    assert {"TITLE_DUPLICATE", "TITLE_TOO_SHORT", "SITEMAP_ONLY_PAGES"} <= {r["code"] for r in found.collect()}
