"""Tables of a report: counts by engine and type of question, cohorts, quality, rates that do not add up, statuses, costs, timelines, and what is out of date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, urls
from ..functions.arrow import folded
from ..functions.stats import rate
from ..sources.scratch import kept
from . import crawl, measure, shares

# fixed values: what a cohort is, how far a click rate may be off, days after which a source is old, and gaps that are listed
COHORT = ("engine", "mode", "surface", "locale", "login", "search_enabled", "model", "campaign_id")
RATE_TOLERANCE, STALE_DAYS, LISTED_GAPS, TOP = 0.005, 120, 62, 5
#: Parts into which the pages of a URL or site are dealt when they meet their findings, and sets of domains when they meet their classes.
PARTS = 64
#: Chunks into which the findings of a URL or site are dealt, and findings of a block.
CHUNKS, BLOCK = 16, 1000


def of_questions(rows: DataFrame, questions: DataFrame) -> DataFrame:
    """Observations with the type of their question (question_id, type); those of unknown questions go."""
    return rows.join(questions.select("question_id", "type"), "question_id")


def cohorts(rows: DataFrame) -> DataFrame:
    """Counts of each cohort, with its questions as a list in order: how often each was tried, known and cited. A question set is bounded, so is the list."""
    each = rows.groupBy(*COHORT, "question_id").agg(*measure.counts())
    names = ["attempts", "runs", "errors", "unmeasured", "citation_known", "cited"]
    own = F.struct("question_id", F.col("attempts").alias("attempts"), F.col("citation_known").alias("known"), F.col("cited").alias("cited"))
    return each.groupBy(*COHORT).agg(*[F.sum(n).alias(n) for n in names], F.array_sort(F.collect_list(own)).alias("questions"))


def question_totals(rows: DataFrame, cited_urls: DataFrame) -> DataFrame:
    """(question_id, attempts, known, cited, engines, urls): each engine's known runs and hits as text by name, and the most cited URLs (seq, url)."""
    by_engine = rows.groupBy("question_id", "engine").agg(*measure.counts())
    cell = F.struct("engine", F.concat_ws("/", F.col("cited").cast("string"), F.col("citation_known").cast("string")).alias("cell"))
    total = by_engine.groupBy("question_id").agg(F.sum("attempts").alias("attempts"), F.sum("citation_known").alias("known"), F.sum("cited").alias("cited"), F.map_from_entries(F.array_sort(F.collect_list(cell))).alias("engines"))
    counted = cited_urls.join(rows.select("seq", "question_id"), "seq").groupBy("question_id", "url").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("n"), "url"))
    top = counted.withColumn("place", place).where(F.col("place") <= TOP).groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "url"))), lambda x: x["url"]).alias("urls"))
    return total.join(top, "question_id", "left").withColumn("urls", F.coalesce("urls", F.array().cast("array<string>")))


def quality(rows: DataFrame, by: list[str]) -> DataFrame:
    """Counts that decide whether a group can be compared later: nothing failed, nothing unmeasured, and something known."""
    out = measure.slots(rows, by).select(*by, "attempts", "errors", "unmeasured", "citation_known")
    return out.withColumn("regression_eligible", (F.col("errors") == 0) & (F.col("unmeasured") == 0) & (F.col("citation_known") > 0))


def rate_mismatches(rows: DataFrame) -> DataFrame:
    """Rows whose reported click rate (ctr) is further off clicks over impressions than rounding explains; rows without impressions have no rate."""
    computed = F.when(F.col("impressions") > 0, F.col("clicks") / F.col("impressions"))
    return rows.withColumn("computed", F.round(computed, 6)).where(F.abs(F.col("ctr") - computed) > RATE_TOLERANCE)


def gaps(rows: DataFrame, date: str = "date") -> DataFrame:
    """(missing, first): how many days lack rows between the first and the last, and the first of them."""
    found = measure.date_gaps(rows, date)
    listed = found.orderBy(date).limit(LISTED_GAPS).agg(F.array_sort(F.collect_list(date)).alias("first"))
    return found.agg(F.count("*").alias("missing")).join(listed)  # two single rows


def duplicate_groups(facts: DataFrame, field: str) -> DataFrame:
    """(groups, pages, ratio) of pages of status 200 that share a value with others."""
    ok = crawl.ok_pages(facts)
    by = ok.where(F.col(field) != "").groupBy(field).agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("pages"))
    total = ok.agg(F.greatest(F.count("*"), F.lit(1)).alias("total"))  # single rows both
    return by.join(total).select("groups", "pages", F.round(F.col("pages") / F.col("total"), 3).alias("ratio"))


def page_stats(facts: DataFrame) -> DataFrame:
    """One row: pages crawled, and of those of status 200 the different titles and descriptions, those with a readable JSON-LD block, and those not to be indexed."""
    ok = F.col("status") == 200
    said = lambda c: F.count_distinct(F.when(ok & (F.col(c) != ""), F.col(c)))
    return facts.agg(F.count("*").alias("pages_crawled"), said("title").alias("unique_titles"), said("description").alias("unique_descriptions"), F.count_if(ok & (F.col("jsonld_blocks") > F.col("jsonld_invalid"))).alias("pages_with_jsonld"), F.count_if(ok & F.array_contains("directives", "noindex")).alias("pages_noindex"))


def statuses(pages: DataFrame) -> DataFrame:
    """(status, kind, pages): errors are answers of 400 and more and no answer, but for those that ask to come later."""
    kind = F.when(F.col("status").isin(*crawl.THROTTLED), "throttled").when(F.col("status").isNull() | (F.col("status") >= 400), "error").otherwise("ok")
    return pages.groupBy("status").agg(F.count("*").alias("pages")).select("status", kind.alias("kind"), "pages")


def outcome_table(rows: DataFrame, outcomes: list[str]) -> DataFrame:
    """A row an engine with a column for each outcome, all that are known, and observed runs in which the engine did not search."""
    wide = rows.groupBy("engine").pivot("outcome", outcomes).agg(F.count(F.lit(1))).fillna(0)
    quiet = rows.groupBy("engine").agg(F.count_if((F.col("outcome") == "observed") & (F.col("search_enabled") == F.lit(False))).alias("observed_without_search"))
    return wide.join(quiet, "engine")


def first_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key; whole rows are combined before they are sent."""
    rest = [c for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(F.min(F.struct(order, *rest)).alias("m")).select(key, f"m.{order}", *[f"m.{c}" for c in rest])


def baseline_delta(rows: DataFrame) -> DataFrame:
    """(date, citation_rate, points): each day's rate against that of the first day. The window is over one row for each day."""
    days = measure.trend(rows).select("date", rate(F.col("cited"), F.col("runs")).alias("citation_rate"))
    return days.withColumn("points", F.round((F.col("citation_rate") - F.first("citation_rate").over(Window.orderBy("date"))) * 100, 1))


def timeline(snapshots: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """A row a date with the last snapshot (date, kind, seq, label) of each kind, null where there is none."""
    last = snapshots.groupBy("date", "kind").agg(F.max_by("label", "seq").alias("label"))
    return last.groupBy("date").pivot("kind", list(kinds)).agg(F.first("label"))


def staleness(rows: DataFrame, today: str) -> DataFrame:
    """rows (checked_at date) with age in days and state: fresh, stale after 120 days, future, or unknown without a date."""
    age = F.date_diff(F.lit(today).cast("date"), "checked_at").cast("long")
    return rows.withColumns({"age": age, "state": F.when(age.isNull(), "unknown").when(age < 0, "future").when(age > STALE_DAYS, "stale").otherwise("fresh")})


def costs(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """(total, priced_calls, unknown): the cost of all calls (engine) by prices (engine, price decimal), and the engines that have none, each with its calls. Nothing known is null, not zero."""
    by = calls.groupBy("engine").agg(F.count("*").alias("calls")).join(prices, "engine", "left")
    missing = F.array_sort(F.array_compact(F.collect_list(F.when(F.col("price").isNull(), F.struct("engine", "calls")))))
    return by.agg(F.sum(F.col("price") * F.col("calls")).alias("total"), F.coalesce(F.sum(F.when(F.col("price").isNotNull(), F.col("calls"))), F.lit(0)).alias("priced_calls"), missing.alias("unknown"))


def domain_classes(cited: DataFrame, classes: DataFrame, site: str) -> DataFrame:
    """Different domains (domain) with class: owned, what the longest suffix says (suffix, class), or other. Domains meet suffixes by equal keys, under each of their own."""
    labels = F.split("domain", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    named = cited.select("domain").distinct()
    met = named.select("domain", F.posexplode(suffixes).alias("at", "suffix")).join(classes, "suffix").groupBy("domain").agg(F.min_by("class", "at").alias("class"))
    return named.join(met, "domain", "left").select("domain", F.when(urls.owned(F.col("domain"), F.lit(site)), "owned").otherwise(F.coalesce("class", F.lit("other"))).alias("class"))


def domain_sets(rows: DataFrame) -> DataFrame:
    """(domains, n): the different sets of domains that runs (seq, cited_urls) cite, and how many runs cite each.

    A run's rows are one window. Windows stream over rows in the order of seq, which a merge join by seq already has; no task holds a table of its runs, and equal sets are counted before they leave it.
    """
    own = F.array_compact(F.transform(F.array_distinct("cited_urls"), urls.domain)).alias("own")
    run = Window.partitionBy("seq")
    whole = rows.select("seq", own, F.monotonically_increasing_id().alias("row")).select("row", F.min("row").over(run).alias("first"), F.collect_list("own").over(run).alias("all"))
    return whole.where("row = first").groupBy(F.array_sort(F.array_distinct(F.flatten("all"))).alias("domains")).agg(F.count("*").alias("n"))


def channel_domains(rows: DataFrame, classes: DataFrame, site: str) -> DataFrame:
    """(class, n_runs, domains): runs that cite each class of domains, once each, and the domains that most runs cite, ties to the first name.

    Runs count by the set of domains that they cite. Sets are dealt into PARTS, each of which meets all classes of domains, so no domain is one task.
    """
    sets = kept(domain_sets(rows), "domain-sets")
    each = sets.select("domains", "n", F.explode("domains").alias("domain"))
    by = each.groupBy("domain").agg(F.sum("n").alias("n"))
    of = kept(domain_classes(by, classes, site), "domain-classes")
    dealt = of.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    met = each.withColumn("part", F.pmod(F.xxhash64("domains"), F.lit(PARTS)).cast("int")).join(dealt, ["domain", "part"])
    runs = met.select("domains", "class", "n").distinct().groupBy("class").agg(F.sum("n").alias("n_runs"))
    place = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("n"), "domain"))
    top = by.join(of, "domain").withColumn("place", place).where(F.col("place") <= TOP).groupBy("class").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "domain"))), lambda x: x["domain"]).alias("domains"))
    return runs.join(top, "class")


def sitemap_against_crawl(listed: DataFrame, crawled: DataFrame) -> DataFrame:
    """(site, key, side) of addresses (site, url) on one side only, by link key, of each site's own host. A site whose sitemap lists nothing is not compared."""
    own = lambda df: df.where(urls.host(F.col("url")) == F.col("site")).select("site", urls.link_key(F.col("url")).alias("key")).distinct()
    a, b = own(listed), own(crawled)
    b = b.join(a.select("site").distinct(), "site", "left_semi")
    return a.subtract(b).withColumn("side", F.lit("sitemap")).unionByName(b.subtract(a).withColumn("side", F.lit("crawl")))


def reconciled(new: DataFrame, existing: DataFrame) -> DataFrame:
    """new (id, text) with state: same, changed (id with another text), text_taken (text under another id) or new; texts in compatibility form, without case and repeated white space."""
    by_id = existing.select("id", folded(F.col("text")).alias("old"))
    by_text = existing.select("id", folded(F.col("text")).alias("p")).groupBy("p").agg(F.min("id").alias("other"))
    out = new.select("id", folded(F.col("text")).alias("p")).join(by_id, "id", "left").join(by_text, "p", "left")
    return out.select("id", F.when(F.col("old") == F.col("p"), "same").when(F.col("old").isNotNull(), "changed").when(F.col("other").isNotNull(), "text_taken").otherwise("new").alias("state"))


def label_usage(facts: DataFrame) -> DataFrame:
    """(kind, label, pages): how many pages use a heading, and how many a title, each counted apart."""
    both = F.array(F.struct(F.lit("heading").alias("kind"), F.try_element_at("h1", F.lit(1)).alias("label")), F.struct(F.lit("title").alias("kind"), F.col("title").alias("label")))
    rows = facts.select(F.explode(both).alias("x")).select("x.kind", text.squeezed(F.col("x.label")).alias("label")).where("label <> ''")
    return rows.groupBy("kind", "label").agg(F.count("*").alias("pages"))


def blocked_by(tasks: DataFrame) -> DataFrame:
    """(id, blocker) of pages and the critical findings that they wait for: those about their own URL, or about the whole site. tasks are (id, kind, severity, url, site).

    There are as many pairs as pages times findings of a URL or site. They leave the join as they are made: only those of findings that occur under
    more than one URL or site can repeat, and go through a distinct. The pages of a key are dealt into PARTS, each of which meets all findings of the key, so no
    key is one task. Findings travel in blocks of BLOCK at most, since each part gets a copy of them, and a finding is said beside all pages of a part before the
    next one is, so that rows near each other are alike and take little room where they are written.
    """
    critical = tasks.where("kind = 'finding' and severity = 'critical'").select(F.col("id").alias("blocker"), F.when(F.col("url").isNull(), "site").otherwise("url").alias("of"), F.coalesce("url", "site").alias("key")).where("key is not null")
    of = lambda name: F.struct(F.lit(name).alias("of"), F.col(name).alias("key"))
    pages = tasks.where("kind = 'page'").select("id", F.explode(F.array(of("url"), of("site"))).alias("x")).select("id", "x.*").where("key is not null")
    dealt = lambda df: df.repartition(4 * PARTS, "of", "key", "part")
    # one exchange for the distinct and the join
    pages = dealt(pages.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(PARTS)))).distinct()
    critical = critical.distinct().withColumn("again", F.count("*").over(Window.partitionBy("blocker")) > 1).withColumn("chunk", F.pmod(F.xxhash64("blocker"), F.lit(CHUNKS)))
    number = F.row_number().over(Window.partitionBy("of", "key", "chunk", "again").orderBy("blocker"))
    blocks = critical.withColumn("block", F.floor((number - 1) / BLOCK)).groupBy("of", "key", "chunk", "again", "block").agg(F.transform(F.collect_list(F.struct("blocker")), lambda x: x["blocker"]).alias("blockers"))
    met = blocks.select("of", "key", "again", "blockers", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))).alias("part"))
    pairs = lambda b: dealt(b.drop("again")).withColumn("blocker", F.explode("blockers")).hint("merge").join(pages, ["of", "key", "part"]).select("id", "blocker")
    return pairs(met.where("not again")).unionByName(pairs(met.where("again")).distinct())
