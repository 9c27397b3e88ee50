"""Which intents a page speaks to, how that is known, what to do about each intent, and which pages of others to compare with.

Intents are (intent, query_id, term, ...): a question has one intent and some terms. Terms are looked for in titles and first headings as strings, without case, by the
index of rare grams (operators.quotes), never by comparing every term with every page.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.arrow import caseless
from ..sources.scratch import kept
from . import quotes

#: How a page came to an intent, strongest first.
WAYS = ("query", "page", "term")


def page_key(url: Column) -> Column:
    """A URL without closing slashes and case."""
    return F.lower(F.regexp_replace(url, "/+$", ""))


def term_hits(pages: DataFrame, terms: DataFrame, without_case: Callable[[Column], Column] = caseless) -> DataFrame:
    """(source_id, intent): pages (source_id, title, h1) whose title or first heading holds a term (intent, term) of two characters or more. Terms that many intents share are looked for once.

    without_case takes the case from both; the default folds it, so that a term with ss is in a title with ß.
    """
    wanted = terms.where(F.length(F.regexp_replace("term", r"^\p{Zs}+|\p{Zs}+$", "")) >= 2).select("intent", without_case(F.col("term")).alias("quote")).distinct()
    wanted = kept(wanted, "terms")
    said = pages.select("source_id", without_case(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("h1", F.lit("")))).alias("text"))
    found = quotes.containing(wanted.select(F.col("quote").alias("quote_id"), "quote").distinct(), said)
    return wanted.join(found.select(F.col("quote_id").alias("quote"), "source_id"), "quote").select("source_id", "intent").distinct()


def scoped(pages: DataFrame, questions: DataFrame, explicit: DataFrame, terms: DataFrame, site: str, without_case: Callable[[Column], Column] = caseless) -> DataFrame:
    """(source_id, intent, ways): the intents of each page (source_id, url, title, h1, query_ids), and how they are known: by a question that found the page, by an
    own page that was named for an intent (intent, url), or by a term in the title of an own page, which is a candidate and no proof. questions are (query_id, intent).
    """
    own = pages.where(urls.owned(urls.host(F.col("url")), F.lit(site)))
    by_query = pages.select("source_id", F.explode("query_ids").alias("query_id")).join(questions.select("query_id", "intent"), "query_id").select("source_id", "intent", F.lit("query").alias("way"))
    named = explicit.select("intent", page_key(F.col("url")).alias("key")).distinct()
    by_page = own.select("source_id", page_key(F.col("url")).alias("key")).join(named, "key").select("source_id", "intent", F.lit("page").alias("way"))
    by_term = term_hits(own, terms, without_case).withColumn("way", F.lit("term"))
    ways = F.array_agg("way")
    each = by_query.unionByName(by_page).unionByName(by_term).distinct()
    return each.groupBy("source_id", "intent").agg(F.filter(F.array(*map(F.lit, WAYS)), lambda w: F.array_contains(ways, w)).alias("ways"))


def page_conflicts(explicit: DataFrame, hits: DataFrame) -> DataFrame:
    """(key) of own pages that more than one intent is named for (intent, url), or more than one finds by a term (intent, url)."""
    several = lambda df: df.select(page_key(F.col("url")).alias("key"), "intent").distinct().groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    return several(explicit).union(several(hits)).distinct()


def actions(intents: DataFrame, explicit: DataFrame, hits: DataFrame, complete: bool) -> DataFrame:
    """(intent, action, reason, candidates) of intents (intent, n_terms, page_types): review, update or create, and how many own pages are candidates.

    Several candidates or kinds of page, or a page that other intents want too, are for a person to look at; one named page is to be updated; without any a page is to be
    created only where the crawl was complete and there were terms to look for.
    """
    conflicts = page_conflicts(explicit, hits).withColumn("conflict", F.lit(True))
    named = explicit.select("intent", "url", F.lit(True).alias("named")).distinct()
    pages = named.unionByName(hits.select("intent", "url", F.lit(False).alias("named")).distinct())
    each = pages.groupBy("intent", "url").agg(F.bool_or("named").alias("named")).withColumn("key", page_key(F.col("url"))).join(conflicts, "key", "left")
    by = each.groupBy("intent").agg(F.count("*").alias("candidates"), F.bool_or(F.coalesce("conflict", F.lit(False))).alias("conflict"), F.bool_or("named").alias("named"))
    rows = intents.join(by, "intent", "left").fillna(0, ["candidates"]).fillna(False, ["conflict", "named"])
    c = F.col
    reason = (
        F.when(c("conflict") | (c("candidates") > 1) | (c("page_types") > 1), "overlap")
        .when(c("candidates") == 1, F.when(c("named"), "named_page").otherwise("term_candidate"))
        .when(c("n_terms") == 0, "nothing_to_look_for")
        .otherwise("none_in_complete_crawl" if complete else "crawl_incomplete")
    )
    action = F.when(reason == "named_page", "update").when(reason == "none_in_complete_crawl", "create").otherwise("review")
    return rows.select("intent", action.alias("action"), reason.alias("reason"), "candidates")


def comparisons(pages: DataFrame, questions: DataFrame, observed: DataFrame, discovered: DataFrame, competitors: DataFrame, hits: DataFrame, candidates: DataFrame, site: str) -> DataFrame:
    """(intent, source_id, role, n_observed, n_discovered) of pages (source_id, url, final_url) to compare for an intent: own candidates (intent, url), and of other sites' pages those that
    answers named (observed: query_id, url), a search found (discovered: query_id, url), or a declared competitor (host) has with a term of the intent (hits: source_id, intent)."""
    own = urls.owned(urls.host(F.coalesce("final_url", "url")), F.lit(site))
    both = pages.select("source_id", own.alias("own"), F.coalesce("final_url", "url").alias("at"), F.explode(F.array_distinct(F.array(F.coalesce("final_url", "url"), F.col("url")))).alias("url"))
    mine = both.where("own").join(candidates.select("intent", "url").distinct(), "url").select("intent", "source_id", F.lit("owned").alias("role")).distinct()
    asked = questions.select("query_id", "intent")
    count = lambda df, name: both.where("not own").join(df.join(asked, "query_id"), "url").groupBy("intent", "source_id").agg(F.count("*").alias(name))
    # a competitor's host or one below it: every host is looked up under its own suffixes
    host = pages.where(~own).select("source_id", urls.host(F.coalesce("final_url", "url")).alias("host"))
    labels = F.split("host", r"\.")
    suffixes = host.select("source_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))).alias("host"))
    declared = suffixes.join(competitors.select(F.lower("host").alias("host")).distinct(), "host").select("source_id").distinct()
    theirs = hits.join(declared, "source_id").select("intent", "source_id", F.lit(True).alias("declared"))
    rows = count(observed, "n_observed").join(count(discovered, "n_discovered"), ["intent", "source_id"], "full").join(theirs, ["intent", "source_id"], "full").fillna(0, ["n_observed", "n_discovered"])
    role = F.when(F.col("n_observed") > 0, "observed_publisher").when(F.col("n_discovered") > 0, "discovered_source").otherwise("declared_competitor")
    rows = rows.select("intent", "source_id", role.alias("role"), "n_observed", "n_discovered")
    zero = F.lit(0).cast("long")
    return rows.unionByName(mine.withColumns({"n_observed": zero, "n_discovered": zero}))
