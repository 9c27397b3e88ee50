"""The audit as one table of rules, for many sites at once.

Pages are read once into facts (operators.crawl). Rules about single pages are tests that one projection turns into codes; rules about groups count titles and
descriptions; rules about sites are tests over one row a site, which holds aggregates of its pages beside what was observed of the site itself. A finding has a lane, a severity, how
many pages it is about and the first of their URLs. What was not observed makes no finding: nothing is inferred from null, and a robots file that was not reached
stops every rule that would need what it withholds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import urls
from ..sources.scratch import kept
from . import crawl

# fixed values: lanes in order, those that need robots files or page content, and how mirrors and alternative hosts answer
LANES = ("SEO", "AEO", "GEO", "LLMO", "NEO", "KEO", "reputation")
POLICY_LANES, CONTENT_LANES = ("GEO", "NEO", "KEO"), ("AEO", "LLMO")
OFF_SITE = "reputation"
UNREACHED = ("tls_fail", "dns_fail", "error")
MANY = 0.5

FINDING = "struct<code:string,lane:string,severity:string>"
MIRRORS = "array<struct<host:string,indexability:string,blocked:boolean>>"
#: What is known of a site: null where it was not observed.
SITE = f"site string, complete boolean, robots_state string, sitemap_declared int, sitemaps_live int, sitemaps_read int, only_in_sitemap long, only_in_crawl long, llms_status int, probe_404 int, redirect_hops int, alt_result string, mirrors {MIRRORS}, hidden_hosts int, wildcard boolean, nonstandard_agents int, managed boolean, content_signals int, proxied boolean"
QUALITY = "over_limit long, foreign_host long, duplicate_urls long, lastmod_invalid long, lastmod_missing long, uniform long"


def page_facts(found: DataFrame, site: Column) -> DataFrame:
    """Facts of records for the audit, written: the site, links to the page's own host, and whether others link to it."""
    read = ["page_id", "url", "final_url", "status", "intended_indexable", "title", "description", "canonical", "h1", "links", "jsonld_blocks", "jsonld_invalid", "jsonld_types", "text_chars", "directives", "naver_verified"]
    found = kept(found.select(*read), "records")  # markup is read here, and nowhere else
    linked = crawl.linked(found).select("page_id", "linked")
    own = F.size(F.filter("links", lambda x: urls.host(x) == urls.host(F.col("url"))))
    rows = found.withColumn("site", site).withColumn("internal_links", own).join(linked, "page_id")
    kept_columns = ["site", "page_id", "url", "status", "intended_indexable", "title", "description", "canonical", "h1", "jsonld_blocks", "jsonld_invalid", "jsonld_types", "text_chars", "directives", "naver_verified", "internal_links", "linked"]
    return kept(rows.select(*kept_columns), "facts")


def page_rules() -> list[tuple[str, str, str, Column]]:
    """(code, lane, severity, test) over a page of any status; those of crawl.page_rules ask for status 200."""
    ok = F.col("status") == 200
    start = F.regexp_like("url", F.lit(r"^[^:/?#]+://[^/?#]*/?$"))
    return [
        *[(code, lane, severity, ok & test) for code, lane, severity, test in crawl.page_rules()],
        ("HTTP_ERROR", "SEO", "warn", F.col("status").isNull() | ((F.col("status") >= 400) & ~F.col("status").isin(*crawl.THROTTLED))),
        ("HTTP_THROTTLED", "SEO", "info", F.col("status").isin(*crawl.THROTTLED)),
        ("LINKS_NOT_IN_HTML", "GEO", "warn", ok & start & (F.col("internal_links") == 0)),
        ("SITEMAP_ONLY_PAGES", "GEO", "info", ok & F.col("complete") & ~F.col("linked")),
    ]


def site_rules() -> list[tuple[str, str, str, Column, bool]]:
    """(code, lane, severity, test, whether it needs a robots file that was reached) over a site's row."""
    c = F.col
    mirror = lambda test: F.exists("mirrors", test)
    shown = F.lit("unknown")
    kind = lambda m: F.coalesce(m["indexability"], shown)
    barred = lambda m: F.coalesce(m["blocked"], F.lit(False))
    live = c("sitemaps_live")
    return [
        ("CRAWL_INCOMPLETE", "SEO", "critical", c("complete") == F.lit(False), False),
        ("ROBOTS_UNREACHABLE", "SEO", "warn", c("robots_state") == "unreachable", False),
        ("ROBOTS_MISSING", "SEO", "warn", c("robots_state") == "absent", True),
        ("SITEMAP_NOT_DECLARED", "SEO", "warn", (c("robots_state") == "ok") & (c("sitemap_declared") == 0), True),
        ("SITEMAP_MISSING", "SEO", "warn", live == 0, True),
        ("SITEMAP_CRAWL_MISMATCH", "SEO", "warn", (live > 0) & (c("only_in_sitemap") + c("only_in_crawl") > 0), True),
        ("LLMS_TXT_MISSING", "GEO", "info", F.coalesce(c("llms_status"), F.lit(0)) != 200, True),
        ("SOFT_404", "SEO", "warn", F.coalesce(c("probe_404"), F.lit(0)) != 404, True),
        ("REDIRECT_HOPS", "SEO", "info", c("redirect_hops") > 1, True),
        ("ALT_HOST_UNREACHABLE", "SEO", "warn", c("alt_result").isin(*UNREACHED), True),
        ("ALT_HOST_NONPUBLIC", "SEO", "info", c("alt_result") == "nonpublic_address", True),
        ("MIRROR_NOINDEX", "SEO", "info", mirror(lambda m: kind(m) == "noindex"), True),
        ("MIRROR_PRESENT", "SEO", "warn", mirror(lambda m: (kind(m) != "noindex") & barred(m)), True),
        ("MIRROR_PUBLIC", "SEO", "critical", mirror(lambda m: (kind(m) == "unrestricted") & ~barred(m)), True),
        ("MIRROR_INDEXABILITY_UNKNOWN", "SEO", "info", mirror(lambda m: ~kind(m).isin("noindex", "unrestricted") & ~barred(m)), True),
        ("MIRROR_NONPUBLIC_DNS", "SEO", "info", c("hidden_hosts") > 0, True),
        ("MIRROR_WILDCARD_DNS", "SEO", "info", c("wildcard"), True),
        ("NAVER_VERIFY_MISSING", "NEO", "warn", c("naver") == 0, True),
        ("FAQ_MISSING", "AEO", "info", (c("n") > 0) & (c("faq") == 0), False),
        ("ORG_JSONLD_MISSING", "LLMO", "info", (c("n") > 0) & (c("org") == 0), False),
        ("ORG_JSONLD_SCATTERED", "LLMO", "info", c("org") > 1, False),
        ("SITEMAP_LIMIT_EXCEEDED", "SEO", "info", c("over_limit") > 0, False),
        ("SITEMAP_FOREIGN_HOST", "SEO", "info", c("foreign_host") > 0, False),
        ("SITEMAP_DUPLICATE_URLS", "SEO", "info", c("duplicate_urls") > 0, False),
        ("SITEMAP_LASTMOD_INVALID", "SEO", "info", c("lastmod_invalid") > 0, False),
        ("SITEMAP_LASTMOD_MISSING", "SEO", "info", c("lastmod_missing") > 0, False),
        ("SITEMAP_LASTMOD_UNIFORM", "SEO", "info", c("uniform") > 0, False),
        ("ROBOTS_NONSTANDARD_UA", "SEO", "info", c("nonstandard_agents") > 0, False),
        ("ROBOTS_CDN_MANAGED", "GEO", "info", c("managed"), False),
        ("CONTENT_SIGNAL_PRESENT", "GEO", "info", c("content_signals") > 0, False),
        ("PROXY_ADDRESS_UNVERIFIED", "SEO", "info", c("proxied"), False),
    ]


def _found(code: str, lane: str, severity: str, test: Column) -> Column:
    return F.when(test, F.struct(F.lit(code).alias("code"), F.lit(lane).alias("lane"), F.lit(severity).alias("severity")))


def _first_urls(rows: DataFrame) -> DataFrame:
    """(site, code, lane, severity, pages, urls): tasks keep so many URLs of a site's code before they send them."""
    place = F.row_number().over(Window.partitionBy("site", "code").orderBy("url", "page_id"))
    first = rows.withColumn("place", place).where(F.col("place") <= crawl.EVIDENCE).groupBy("site", "code").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "url"))), lambda x: x["url"]).alias("urls"))
    return rows.groupBy("site", "code", "lane", "severity").agg(F.count("*").alias("pages")).join(first, ["site", "code"])


def shared(facts: DataFrame, field: str, code: str) -> DataFrame:
    """Pages of status 200 that share a title or description with others of their site."""
    ok = facts.where("status = 200").where(F.col(field) != "")
    several = ok.groupBy("site", field).agg(F.count("*").alias("n")).where("n > 1").select("site", field)
    return ok.join(several, ["site", field]).select("site", "page_id", "url", F.lit(code).alias("code"), F.lit("SEO").alias("lane"), F.lit("warn").alias("severity"))


def sitemap_quality(files: DataFrame) -> DataFrame:
    """A row a site of the quality of its files (operators.sitemaps.quality)."""
    uniform = (F.col("top_count") >= 10) & (F.col("top_share") >= 0.9)
    total = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    return files.groupBy("site").agg(F.count_if(F.col("over_url_limit") | F.col("over_size_limit")).alias("over_limit"), total("foreign_host"), total("duplicate_urls"), total("lastmod_invalid"), total("lastmod_missing"), F.count_if(uniform).alias("uniform"))


def audit(facts: DataFrame, sites: DataFrame, quality: DataFrame | None = None, policies: DataFrame | None = None) -> DataFrame:
    """(site, code, lane, severity, pages, urls) of the facts of pages and of sites (SITE); quality is a row a site (QUALITY), policies (site, code, lane, severity) what robots files say to crawlers.

    Sites without pages and pages of sites that are not listed count too: what is not observed is null. A site's rules have no pages and no URLs.
    """
    sites = kept(sites.select(*StructType.fromDDL(SITE).names), "sites")
    known = facts.join(sites.select("site", "complete"), "site", "left")
    codes = F.array_compact(F.array(*[_found(*r) for r in page_rules()]))
    by_page = known.select("site", "page_id", "url", codes.alias("found")).where(F.size("found") > 0).select("site", "page_id", "url", F.explode("found").alias("x")).select("site", "page_id", "url", "x.*")
    pages = _first_urls(by_page.unionByName(shared(facts, "title", "TITLE_DUPLICATE")).unionByName(shared(facts, "description", "DESC_DUPLICATE")))

    has = lambda *types: F.arrays_overlap("jsonld_types", F.array(*map(F.lit, types)))
    ok = F.col("status") == 200
    sums = facts.groupBy("site").agg(
        F.count_if(ok).alias("n"), F.count_if(ok & has("FAQPage", "QAPage")).alias("faq"), F.count_if(ok & has(*crawl.ORGANIZATIONS)).alias("org"),
        F.count_if(ok & F.col("naver_verified")).alias("naver"), F.count_if(ok & (F.col("text_chars") < 300)).alias("thin"), F.count_if(ok & ~F.col("linked")).alias("alone"),
    )
    sums = kept(sums, "sums")
    # more than half of a site's pages make what is said of each worse
    worse = sums.where("n > 0").select("site", F.explode(F.array_compact(F.array(F.when(F.col("thin") > MANY * F.col("n"), F.struct(F.lit("THIN_TEXT").alias("code"), F.lit("critical").alias("worse"))), F.when(F.col("alone") >= MANY * F.col("n"), F.struct(F.lit("SITEMAP_ONLY_PAGES").alias("code"), F.lit("warn").alias("worse")))))).alias("w")).select("site", "w.*")
    pages = pages.join(worse, ["site", "code"], "left").withColumn("severity", F.coalesce("worse", "severity")).drop("worse")

    row = sites.join(sums, "site", "full").fillna(0, ["n", "faq", "org", "naver"])
    none = F.lit(None).cast("long")
    row = row.join(quality, "site", "left") if quality is not None else row.withColumns({f.split()[0]: none for f in QUALITY.split(", ")})
    reached = F.coalesce(F.col("robots_state") != "unreachable", F.lit(True)) & F.col("robots_state").isNotNull()
    each = [_found(code, lane, severity, (reached & test) if gated else test) for code, lane, severity, test, gated in site_rules()]
    found = row.select("site", F.array_compact(F.array(*each)).alias("found")).select("site", F.explode("found").alias("x")).select("site", "x.*")
    if policies is not None:
        found = found.unionByName(policies.select("site", "code", "lane", "severity").distinct())
    return pages.unionByName(found.select("site", "code", "lane", "severity", F.lit(0).cast("long").alias("pages"), F.array().cast("array<string>").alias("urls")))


def scorecard(found: DataFrame, sites: DataFrame) -> DataFrame:
    """(site, place, lane, state, findings, codes, unassessed): the worst that a lane's findings say; ok without any.

    What could not be assessed makes a lane that would be ok na, and is noted beside any other: crawler policies where the robots file was not reached, page content too then. The
    reputation of a site is off the site, and always na.
    """
    lanes = F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(x).alias("lane")) for i, x in enumerate(LANES)]))
    unreached = F.col("robots_state") == "unreachable"
    all_lanes = sites.select("site", unreached.alias("unreached"), lanes.alias("l")).select("site", "unreached", "l.*")
    missing = F.when(F.col("unreached") & F.col("lane").isin(*POLICY_LANES), F.array(F.lit("crawler_policy"))).when(F.col("unreached") & F.col("lane").isin(*CONTENT_LANES), F.array(F.lit("page_content"))).otherwise(F.array().cast("array<string>"))
    worst = F.min(F.array_position(F.array(*map(F.lit, crawl.SEVERITIES)), F.col("severity")))
    by = found.groupBy("site", "lane").agg(worst.alias("worst"), F.count("*").alias("findings"), F.array_sort(F.collect_set("code")).alias("codes"))
    rows = all_lanes.join(by, ["site", "lane"], "left").withColumn("unassessed", missing)
    state = F.when(F.col("lane") == OFF_SITE, "na").when(F.col("worst") == 1, "bad").when(F.col("worst") == 2, "warn").when(F.size("unassessed") > 0, "na").otherwise("ok")
    return rows.select("site", "place", "lane", state.alias("state"), F.coalesce("findings", F.lit(0)).alias("findings"), F.coalesce("codes", F.array().cast("array<string>")).alias("codes"), "unassessed")


def lane_coverage(board: DataFrame, sites: DataFrame) -> DataFrame:
    """(site, assessed, total, unassessed, partial, crawl_complete, conclusive): conclusive where the crawl was complete and every lane but the one off the site was assessed in full."""
    names = lambda test: F.array_sort(F.array_compact(F.collect_list(F.when(test, F.col("lane")))))
    na, part = F.col("state") == "na", (F.col("state") != "na") & (F.size("unassessed") > 0)
    by = board.groupBy("site").agg(F.count_if(~na).alias("assessed"), F.count("*").alias("total"), names(na).alias("unassessed"), names(part).alias("partial"))
    done = F.coalesce(F.col("complete"), F.lit(False))
    out = by.join(sites.select("site", "complete"), "site", "left")
    return out.select("site", "assessed", "total", "unassessed", "partial", done.alias("crawl_complete"), (done & (F.size("partial") == 0) & (F.size(F.array_remove("unassessed", OFF_SITE)) == 0)).alias("conclusive"))


# fixed values: checks in the order of a report, worst first
CHECK_ORDER = ("fail", "warn", "pass", "skip")


def diff_checks(before: DataFrame, after: DataFrame, boards: DataFrame, robots_blind: DataFrame, derived: tuple[str, ...]) -> DataFrame:
    """(site, check, status, codes) of two audits (site, code, severity, pages): what is resolved, new, persists, and what cannot be said.

    Findings that are gone while the robots file was not reached after (robots_blind: site, skipped, blind) are unverified if they come from it (derived), or all if the audit's probes were skipped.
    New critical ones fail; persisting ones that are critical, or about more pages than before, warn. boards are (site, lane, before, after): a worse lane fails, one that is no more assessed warns.
    """
    side = lambda df, name: df.select("site", "code", F.col("severity").alias(f"{name}_severity"), F.col("pages").alias(f"{name}_pages"))
    both = side(before, "before").join(side(after, "after"), ["site", "code"], "full").join(robots_blind, "site", "left").fillna(False, ["skipped", "blind"])
    gone, new = F.col("after_severity").isNull(), F.col("before_severity").isNull()
    unsure = gone & (F.col("skipped") | (F.col("blind") & F.col("code").isin(*derived)))
    check = F.when(unsure, "diff.unverified").when(gone, "diff.resolved").when(new, "diff.new").otherwise("diff.persisting")
    bad = F.when(unsure, "warn").when(gone, "pass").when(new, F.when(F.col("after_severity") == "critical", "fail").otherwise("pass")).otherwise(F.when((F.col("after_severity") == "critical") | (F.col("after_pages") > F.col("before_pages")), "warn").otherwise("pass"))
    each = both.select("site", check.alias("check"), bad.alias("status"), "code")
    rank = F.array(*map(F.lit, crawl.STATES))
    place = lambda c: F.array_position(rank, F.col(c))
    lane = F.when((F.col("after") == "na") & (F.col("before") != "na"), "warn").when((F.col("before") != "na") & (place("after") < place("before")), "fail").otherwise("pass")
    lanes = boards.select("site", F.lit("diff.scorecard").alias("check"), lane.alias("status"), F.when(lane != "pass", F.col("lane")).alias("code"))
    worst = F.min(F.array_position(F.array(*map(F.lit, CHECK_ORDER)), F.col("status")))
    by = each.unionByName(lanes).groupBy("site", "check").agg(worst.alias("worst"), F.array_sort(F.collect_set("code")).alias("codes"))
    return by.select("site", "check", F.element_at(F.array(*map(F.lit, CHECK_ORDER)), F.col("worst").cast("int")).alias("status"), "codes")


def ordered(checks: DataFrame) -> DataFrame:
    """checks with place: within a site failures first, then warnings, passes and what was skipped, by name."""
    rank = F.array_position(F.array(*map(F.lit, CHECK_ORDER)), F.col("status"))
    return checks.withColumn("place", F.row_number().over(Window.partitionBy("site").orderBy(rank, "check")))


def exit_codes(checks: DataFrame, incomplete: DataFrame | None = None) -> DataFrame:
    """(site, code): 1 where a check failed, 2 where nothing failed but something could not be concluded (site in incomplete), else 0."""
    by = checks.groupBy("site").agg(F.bool_or(F.col("status") == "fail").alias("failed"))
    open_ = by.withColumn("open", F.lit(False)) if incomplete is None else by.join(incomplete.select("site").distinct().withColumn("open", F.lit(True)), "site", "left").fillna(False, ["open"])
    return open_.select("site", F.when(F.col("failed"), 1).when(F.col("open"), 2).otherwise(0).alias("code"))
