"""Operators over a crawl: page records, links between pages, the catalogue of audit rules, lanes and their scorecard.

A crawled page has page_id, url, final_url, status, x_robots, intended_indexable and html. Its HTML is read once; what several
rules ask for is written as one narrow table of facts, and only facts are shuffled.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import markup, text, urls
from ..sources.scratch import kept

#: Order of severities and of a lane's states, worst first.
SEVERITIES, STATES = ("critical", "warn", "info"), ("bad", "warn", "ok", "na")
LANES = ("SEO", "AEO", "GEO", "LLMO", "NEO", "KEO")
ORGANIZATIONS = ("Organization", "LocalBusiness", "Corporation")
THROTTLED = (429, 503)
#: URLs that a finding names.
EVIDENCE = 20


def records(pages: DataFrame, closed: bool = False) -> DataFrame:
    """One record for each page: title, description, canonical, language, headings, links, hreflang, open graph, JSON-LD, visible characters and robots directives.

    Markup is read once, in Arrow batches (functions.markup); addresses and directives are column expressions over what it says.
    closed: only references that end in a semicolon are decoded.
    """
    read = markup.read(pages.select("page_id", "url", F.coalesce("final_url", "url").alias("final_url"), "status", "x_robots", "intended_indexable", "html"), partial(markup.record, closed=closed), markup.RECORD)
    base, c = F.col("final_url"), F.col
    return read.select(
        "page_id",
        "url",
        "final_url",
        "status",
        "intended_indexable",
        "title",
        "description",
        urls.absolute(base, c("canonical")).alias("canonical"),
        "lang",
        "h1",
        F.transform("refs", lambda x: urls.absolute(base, x)).alias("links"),
        F.array_sort(F.array_distinct(F.transform("alternates", lambda a: F.concat(a["lang"], F.lit(" "), urls.absolute(base, a["href"]))))).alias("hreflang"),
        F.size("og").alias("og_count"),
        (F.size("jsonld") + c("jsonld_invalid")).alias("jsonld_blocks"),
        "jsonld_invalid",
        "jsonld_types",
        F.length("text").alias("text_chars"),
        text.page_directives(c("robots"), c("x_robots"), "googlebot", c("googlebot")).alias("directives"),
        "naver_verified",
    )


def ok_pages(found: DataFrame) -> DataFrame:
    return found.where("status = 200")


def indexable() -> Column:
    return ~F.array_contains("directives", "noindex")


def indexable_pages(found: DataFrame) -> DataFrame:
    return ok_pages(found).where(indexable())


def eligible(found: DataFrame) -> Column:
    """Whether a page may stand in a sitemap: on its own URL, and its canonical, if any, is itself."""
    return urls.same_page(F.col("url"), F.col("final_url")) & (F.col("canonical").isNull() | urls.same_page(F.col("canonical"), F.col("url")))


def membership(found: DataFrame) -> DataFrame:
    """page_id, url and why a page is in the crawl's set of pages or not: member, noindex, non_canonical or not_ok."""
    state = F.when(F.col("status") != 200, "not_ok").when(~indexable(), "noindex").when(~eligible(found), "non_canonical").otherwise("member")
    return found.select("page_id", "url", F.when(F.col("status").isNull(), "not_ok").otherwise(state).alias("membership"))


def linked(found: DataFrame) -> DataFrame:
    """(page_id, url, linked): whether another page of the same host links to a page, at its own URL or the one that it leads to. Equal pages by link key share what is linked.

    A host's start page, and where it leads to, is reached by definition.
    """
    key = urls.link_key(F.col("url"))
    start = F.regexp_like("url", F.lit(r"^[^:/?#]+://[^/?#]*/?$"))
    pages = found.select("page_id", "url", key.alias("key"), urls.link_key(F.col("final_url")).alias("leads"), start.alias("start"))
    out = found.select(key.alias("of"), F.explode("links").alias("to"), urls.host(F.col("url")).alias("h")).where(urls.host(F.col("to")) == F.col("h"))
    out = out.select("of", urls.link_key(F.col("to")).alias("key")).where("of <> key").select("key")
    reached = out.unionByName(pages.where("start").select("leads").withColumnRenamed("leads", "key")).distinct().withColumn("linked", F.lit(True))
    by_key = pages.join(reached, "key", "left").join(reached.select(F.col("key").alias("leads"), F.col("linked").alias("led")), "leads", "left")
    return by_key.select("page_id", "url", (F.coalesce("linked", F.lit(False)) | F.coalesce("led", F.lit(False)) | F.col("start")).alias("linked"))


def facts(found: DataFrame) -> DataFrame:
    """What rules ask of records, without links and texts, as a written table: records are read once, whatever the number of rules."""
    return kept(found.select("page_id", "url", "status", "intended_indexable", "title", "description", "canonical", "h1", "jsonld_blocks", "jsonld_invalid", "jsonld_types", "text_chars", "directives", "naver_verified"), "facts")


def page_rules() -> list[tuple[str, str, str, Column]]:
    """(code, lane, severity, test) of the rules that one page of status 200 breaks by itself."""
    c, has = F.col, lambda d: F.array_contains("directives", d)
    title, description = text.length_verdict(c("title"), "title"), text.length_verdict(c("description"), "description")
    low = lambda x, kind, share: F.when(text.script(c(x)) == "ko", text.LENGTHS[kind]["ko"][0] * share).otherwise(text.LENGTHS[kind]["en"][0] * share)
    return [
        ("NOINDEX", "SEO", "critical", has("noindex") & c("intended_indexable")),
        ("INTENTIONAL_NOINDEX", "SEO", "info", has("noindex") & ~c("intended_indexable")),
        ("SNIPPET_RESTRICTED", "AEO", "warn", has("nosnippet") | has("max-snippet:0")),
        ("TITLE_MISSING", "SEO", "critical", c("title") == ""),
        ("TITLE_TOO_LONG", "SEO", "info", title == "long"),
        ("TITLE_TOO_SHORT", "SEO", "warn", (c("title") != "") & (F.length("title") < low("title", "title", 0.4))),
        ("DESC_MISSING", "SEO", "warn", c("description") == ""),
        ("DESC_TOO_LONG", "SEO", "info", description == "long"),
        ("DESC_TOO_SHORT", "SEO", "info", (c("description") != "") & (F.length("description") < low("description", "description", 0.5))),
        ("JSONLD_INVALID", "AEO", "warn", c("jsonld_invalid") > 0),
        ("JSONLD_MISSING", "AEO", "info", c("jsonld_blocks") == 0),
        ("CANONICAL_MISSING", "SEO", "warn", c("canonical").isNull()),
        ("CANONICAL_NOT_SELF", "SEO", "info", c("canonical").isNotNull() & ~urls.same_page(c("canonical"), c("url"))),
        ("H1_MISSING", "SEO", "warn", F.size("h1") == 0),
        ("H1_MULTIPLE", "SEO", "info", F.size("h1") > 1),
        ("THIN_TEXT", "SEO", "warn", c("text_chars") < 300),
    ]


def page_findings(found: DataFrame) -> DataFrame:
    """(page_id, url, code, lane, severity): rules of single pages, and statuses of pages that were not answered."""
    http = [
        ("HTTP_ERROR", "SEO", "warn", F.col("status").isNull() | ((F.col("status") >= 400) & ~F.col("status").isin(*THROTTLED))),
        ("HTTP_THROTTLED", "SEO", "info", F.col("status").isin(*THROTTLED)),
    ]
    rule = lambda code, lane, severity, test: F.when(test, F.struct(F.lit(code).alias("code"), F.lit(lane).alias("lane"), F.lit(severity).alias("severity")))
    each = [rule(code, lane, severity, (F.col("status") == 200) & test) for code, lane, severity, test in page_rules()] + [rule(*r) for r in http]
    return found.select("page_id", "url", F.explode(F.array_compact(F.array(*each))).alias("x")).select("page_id", "url", "x.*")


def shared_values(found: DataFrame, field: str, code: str) -> DataFrame:
    """(page_id, url, code, lane, severity) of pages of status 200 that share a title or description."""
    ok = ok_pages(found).where(F.col(field) != "")
    several = ok.groupBy(field).agg(F.count("*").alias("n")).where("n > 1").select(field)
    return ok.join(several, field).select("page_id", "url", F.lit(code).alias("code"), F.lit("SEO").alias("lane"), F.lit("warn").alias("severity"))


def site_findings(found: DataFrame) -> DataFrame:
    """(code, lane, severity) of rules over all pages of status 200; none of them where there are no such pages."""
    has = lambda *types: F.arrays_overlap("jsonld_types", F.array(*map(F.lit, types)))
    s = ok_pages(found).agg(F.count("*").alias("n"), F.count_if(has("FAQPage", "QAPage")).alias("faq"), F.count_if(has(*ORGANIZATIONS)).alias("org"), F.count_if("naver_verified").alias("naver"), F.count_if(F.col("text_chars") < 300).alias("thin")).where("n > 0")
    rule = lambda code, lane, severity, test: F.when(test, F.struct(F.lit(code).alias("code"), F.lit(lane).alias("lane"), F.lit(severity).alias("severity")))
    c = F.col
    rules = [
        rule("FAQ_MISSING", "AEO", "info", c("faq") == 0),
        rule("ORG_JSONLD_MISSING", "LLMO", "info", c("org") == 0),
        rule("ORG_JSONLD_SCATTERED", "LLMO", "info", c("org") > 1),
        rule("NAVER_VERIFY_MISSING", "NEO", "warn", c("naver") == 0),
        rule("THIN_SITE", "SEO", "critical", c("thin") * 2 > c("n")),
    ]
    return s.select(F.explode(F.array_compact(F.array(*rules))).alias("x")).select("x.*")


def findings(found: DataFrame) -> DataFrame:
    """(code, lane, severity, pages, urls) of the audit: for each code its pages and the first few URLs. More than half of thin pages make THIN_TEXT critical."""
    found = facts(found)
    by_page = page_findings(found).unionByName(shared_values(found, "title", "TITLE_DUPLICATE")).unionByName(shared_values(found, "description", "DESC_DUPLICATE"))
    # the first URLs only: tasks keep so many of each code before they send them
    first = by_page.withColumn("place", F.row_number().over(Window.partitionBy("code").orderBy("url", "page_id"))).where(F.col("place") <= EVIDENCE)
    first = first.groupBy("code").agg(F.array_sort(F.collect_list("url")).alias("urls"))
    ranked = by_page.groupBy("code", "lane", "severity").agg(F.count("*").alias("pages")).join(first, "code")
    site = site_findings(found)
    thin = site.where("code = 'THIN_SITE'").select(F.lit("THIN_TEXT").alias("code"), F.lit("critical").alias("worse"))
    out = ranked.join(F.broadcast(thin), "code", "left").withColumn("severity", F.coalesce("worse", "severity")).drop("worse")
    rest = site.where("code <> 'THIN_SITE'").select("code", "lane", "severity", F.lit(0).cast("long").alias("pages"), F.array().cast("array<string>").alias("urls"))
    return out.unionByName(rest)


def scorecard(found: DataFrame, unassessed: tuple[str, ...] = ()) -> DataFrame:
    """(lane, state, findings, codes): the worst that a lane's findings say; ok without any, na where nothing was assessed."""
    lanes = found.sparkSession.createDataFrame([(i, x, x in unassessed) for i, x in enumerate(LANES)], "place int, lane string, unassessed boolean")
    worst = F.min(F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")))
    by = found.groupBy("lane").agg(worst.alias("worst"), F.count("*").alias("findings"), F.array_sort(F.collect_set("code")).alias("codes"))
    state = F.when(F.col("worst") == 1, "bad").when(F.col("worst") == 2, "warn").when(F.col("unassessed"), "na").otherwise("ok")
    return lanes.join(by, "lane", "left").select("place", "lane", state.alias("state"), F.coalesce("findings", F.lit(0)).alias("findings"), F.coalesce("codes", F.array().cast("array<string>")).alias("codes"))


def coverage(board: DataFrame) -> DataFrame:
    """Lanes assessed, and whether the audit is conclusive: every lane was."""
    return board.agg(F.count("*").alias("lanes"), F.count_if(F.col("state") != "na").alias("assessed"), F.bool_and(F.col("state") != "na").alias("conclusive"))


def lane_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(lane, before, after, change) over the fixed lanes: worse, better, same, or unconcluded where one side was not assessed."""
    rank = lambda x: F.array_position(F.array(*map(F.lit, STATES)), F.col(x))
    both = before.select("lane", F.col("state").alias("before")).join(after.select("lane", F.col("state").alias("after")), "lane", "full")
    both = both.select("lane", F.coalesce("before", F.lit("na")).alias("before"), F.coalesce("after", F.lit("na")).alias("after"))
    change = F.when((F.col("before") == "na") | (F.col("after") == "na"), "unconcluded").when(rank("after") < rank("before"), "worse").when(rank("after") > rank("before"), "better").otherwise("same")
    return both.withColumn("change", change)


def metrics(found: DataFrame) -> DataFrame:
    """(metric, value): pages, dup_titles, jsonld_pages (with a readable block) and noindex of pages of status 200."""
    ok = ok_pages(kept(found.select("status", "title", "jsonld_blocks", "jsonld_invalid", "directives"), "metrics"))
    dup = ok.where("title <> ''").groupBy("title").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("dup_titles"))
    one = ok.agg(F.count("*").alias("pages"), F.count_if(F.col("jsonld_blocks") > F.col("jsonld_invalid")).alias("jsonld_pages"), F.count_if(~indexable()).alias("noindex"))
    # two single rows
    wide = one.join(dup)
    names = ["pages", "dup_titles", "jsonld_pages", "noindex"]
    return wide.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.col(n).cast("long") for n in names]))).alias("metric", "value"))


def metric_verdicts(before: DataFrame, after: DataFrame) -> DataFrame:
    """(metric, before, after, verdict): more noindex or shared titles and fewer pages with JSON-LD are regressions; numbers of pages only inform."""
    both = before.withColumnRenamed("value", "before").join(after.withColumnRenamed("value", "after"), "metric")
    more, less = F.col("after") > F.col("before"), F.col("after") < F.col("before")
    bad = F.when(F.col("metric").isin("noindex", "dup_titles"), more).when(F.col("metric") == "jsonld_pages", less).when(F.col("metric") == "sitemap_urls", F.col("after") < F.col("before") * 0.8).otherwise(False)
    good = F.when(F.col("metric").isin("noindex", "dup_titles"), less).when(F.col("metric").isin("jsonld_pages", "sitemap_urls"), more).otherwise(False)
    return both.withColumn("verdict", F.when(F.col("metric") == "pages", "informational").when(bad, "regression").when(good, "improvement").otherwise("unchanged"))


def brand_suffix(found: DataFrame, field: str = "title") -> DataFrame:
    """(separator, tail, n) that ends most titles, if two and half of all titles have it; else no row."""
    shape = r"^.*\S(\s[|\-–—:]\s)([^|–—:]+)$"
    ended = found.where(F.col(field) != "").select(F.trim(F.regexp_extract(field, shape, 1)).alias("separator"), F.trim(F.regexp_extract(field, shape, 2)).alias("tail"))
    total = ended.agg(F.count("*").alias("total"))
    best = ended.where("tail <> ''").groupBy("separator", "tail").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "separator", "tail").limit(1)
    return best.join(total).where("n >= greatest(2, total / 2)").select("separator", "tail", "n")


def title_core(title: Column, separator: str, tail: str) -> Column:
    """A title without the site's suffix."""
    end = f" {separator} {tail}"
    return F.when(F.endswith(title, F.lit(end)), F.trim(F.left(title, F.length(title) - len(end)))).otherwise(title)


def collisions(drafts: DataFrame, field: str) -> DataFrame:
    """drafts with collides: whether another draft has the same value. Counted by groups, so a common value makes no hot window."""
    n = drafts.where(F.col(field) != "").groupBy(field).agg(F.count("*").alias("n")).where("n > 1").select(field, F.lit(True).alias("collides"))
    return drafts.join(n, field, "left").withColumn("collides", F.coalesce("collides", F.lit(False)))


def labels(found: DataFrame) -> DataFrame:
    """(label, uses): how many pages use a first heading, or where there is none a title, as their label."""
    label = F.coalesce(F.nullif(F.try_element_at("h1", F.lit(1)), F.lit("")), F.col("title"))
    return found.where(label != "").groupBy(label.alias("label")).agg(F.count("*").alias("uses"))


def type_frequencies(found: DataFrame) -> DataFrame:
    """(type, pages) of JSON-LD types on pages of status 200."""
    return ok_pages(found).select("page_id", F.explode("jsonld_types").alias("type")).groupBy("type").agg(F.count("*").alias("pages"))


def sitemap_candidates(declared: DataFrame, base: str) -> DataFrame:
    """(place, url): declared sitemaps of the site's own host, in order, each once, and the two usual places."""
    origin = F.lit(base.rstrip("/"))
    usual = declared.sparkSession.createDataFrame([(1 << 40, "/sitemap.xml"), (1 << 41, "/sitemap_index.xml")], "place long, path string").select("place", F.concat(origin, "path").alias("url"))
    own = declared.where(F.regexp_like("url", F.lit("(?i)^https?://")) & (urls.host(F.col("url")) == urls.host(origin))).select(F.col("place").cast("long").alias("place"), "url")
    return own.unionByName(usual).groupBy("url").agg(F.min("place").alias("place"))


def lost_lines(before: DataFrame, after: DataFrame) -> DataFrame:
    """Lines of the old robots file (file, value) that the live one lacks, trimmed and each once; blank ones do not count."""
    lines = lambda df: df.select("file", F.explode(F.split("value", r"\r\n|\n|\r")).alias("line")).select("file", F.trim("line").alias("line")).where("line <> ''").distinct()
    return lines(before).join(lines(after), ["file", "line"], "left_anti")
