"""Operators that plan and review: filters of comparable runs, priorities, intents, headings, drafts against live pages, checks, backlogs and limits.

Tables are small or large alike: everything is a grouped aggregate or an equi-join, and a cap is a top-k that tasks apply before they send rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import measure

#: Order of check states, worst first.
CHECKS = ("fail", "warn", "pass", "skip")
KINDS = ("audit", "measure", "gsc", "verify")


def latest_day(rows: DataFrame, cumulative: bool = False, since: str | None = None, until: str | None = None) -> DataFrame:
    """Rows of [since, until], and of the last day of these with any attempt unless cumulative. An invalid last day gives no earlier one in its place."""
    if since:
        rows = rows.where(F.col("date") >= F.lit(since).cast("date"))
    if until:
        rows = rows.where(F.col("date") <= F.lit(until).cast("date"))
    # one row, so the join is a broadcast
    return rows if cumulative else rows.join(F.broadcast(rows.agg(F.max("date").alias("date"))), "date", "left_semi")


def coerced(rows: DataFrame) -> DataFrame:
    """cited stays only where the answer is complete, or where it is true: what was not seen is not absent."""
    return rows.withColumn("cited", F.when((F.col("coverage") == "complete") | F.col("cited"), F.col("cited")))


def comparable(rows: DataFrame, surfaces: list[str]) -> DataFrame:
    """Known runs by hand or browser, signed out, with search, on the surfaces."""
    return rows.where(F.col("mode").isin("manual", "browser") & (F.col("login") == "signed_out") & F.col("search_enabled") & F.col("surface").isin(*surfaces) & measure.citation_known())


def priorities(questions: DataFrame, rows: DataFrame) -> DataFrame:
    """questions (question_id, fingerprint, core) with runs, misses and priority: 3, less 1 for a core question, less 1 for one with a miss."""
    by = rows.groupBy("question_id", "fingerprint").agg(F.count("*").alias("runs"), F.count_if(~F.col("cited")).alias("misses"))
    out = questions.join(by, ["question_id", "fingerprint"], "left").fillna(0, ["runs", "misses"])
    return out.withColumn("priority", 3 - F.col("core").cast("int") - (F.col("misses") > 0).cast("int"))


def cohort_signatures(rows: DataFrame, window: list[str]) -> DataFrame:
    """A digest of each window's cohorts, with observed and attempted runs of each question: windows with one digest can be compared."""
    name = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in (*measure.COHORT, "question_id")])
    each = rows.groupBy(*window, name.alias("name")).agg(F.count_if(F.col("outcome") == "observed").alias("observed"), F.count("*").alias("attempts"))
    line = F.concat_ws("|", "name", F.col("observed").cast("string"), F.col("attempts").cast("string"))
    return each.groupBy(*window).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("signature"), F.count("*").alias("cohorts"))


def capped_protocol(slots: DataFrame, order: list[str], cap: int) -> tuple[DataFrame, DataFrame]:
    """(the first cap slots, one row with how many there are and how many are left out)."""
    count = slots.agg(F.count("*").alias("slots"))
    return slots.orderBy(*order).limit(cap), count.select("slots", F.greatest(F.lit(0).cast("long"), F.col("slots") - cap).alias("omitted"))


def surface_coverage(surfaces: DataFrame, rows: DataFrame) -> DataFrame:
    """(surface, observed, status, reason) of every surface: unmeasured is not zero."""
    by = rows.groupBy("surface").agg(F.count_if(F.col("outcome") == "observed").alias("observed"), F.count("*").alias("attempts"))
    out = surfaces.join(by, "surface", "left").fillna(0, ["observed", "attempts"])
    status = F.when(F.col("observed") > 0, "observed").otherwise("unmeasured")
    return out.select("surface", "observed", status.alias("status"), F.when(F.col("attempts") == 0, "never tried").when(F.col("observed") == 0, "no usable answer").alias("reason"))


def intents(questions: DataFrame) -> DataFrame:
    """(intent, priority, first, questions): the least priority of an intent's questions, and these in the order in which they came."""
    each = questions.groupBy("intent").agg(F.min("priority").alias("priority"), F.min("place").alias("first"), F.array_sort(F.collect_list(F.struct("place", "question_id"))).alias("q"))
    return each.select("intent", "priority", "first", F.col("q.question_id").alias("questions"))


def conflicts(mapped: DataFrame) -> DataFrame:
    """(url, intents) of pages to which more than one intent is mapped, whether by hand or by terms."""
    return mapped.groupBy("url").agg(F.array_sort(F.collect_set("intent")).alias("intents")).where(F.size("intents") > 1)


def heading_gaps(required: DataFrame, found: DataFrame) -> DataFrame:
    """required (intent, heading) with state: present, missing, or unknown where an intent has no page; headings are compared without case."""
    heads = found.where("heading is not null").select("intent", F.lower("heading").alias("h")).distinct().withColumn("present", F.lit(True))
    known = found.select("intent").distinct().withColumn("known", F.lit(True))
    out = required.withColumn("h", F.lower("heading")).join(heads, ["intent", "h"], "left").join(known, "intent", "left")
    return out.select("intent", "heading", F.when(F.col("present"), "present").when(F.col("known"), "missing").otherwise("unknown").alias("state"))


def feature_gaps(pages: DataFrame, features: list[str]) -> DataFrame:
    """(intent, feature): what some external page of an intent has and its own pages are known not to have. pages have intent, owned and a boolean for each feature."""
    long = pages.select("intent", "owned", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("has")) for f in features])).alias("x")).select("intent", "owned", "x.*")
    by = long.groupBy("intent", "feature").agg(F.bool_or(~F.col("owned") & F.col("has")).alias("outside"), F.bool_or(F.when(F.col("owned"), F.col("has"))).alias("own"))
    return by.where("outside and own = false").select("intent", "feature")


def drafts_applied(drafts: DataFrame, live: DataFrame, fields: list[str]) -> DataFrame:
    """(url, field, state) of every drafted field against the live page: applied, differs, or unverified where the page was not read."""
    both = drafts.alias("d").join(live.alias("l"), "url", "left").select("url", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"d.{f}").alias("want"), F.col(f"l.{f}").alias("got"), F.col("l.seen").alias("seen")) for f in fields])).alias("x"))
    state = F.when(F.col("x.seen").isNull(), "unverified").when(F.col("x.want").eqNullSafe(F.col("x.got")), "applied").otherwise("differs")
    return both.where("x.want is not null").select("url", "x.field", state.alias("state"))


def new_noindex(before: DataFrame, after: DataFrame) -> DataFrame:
    """(url, state) of pages that could be indexed before: newly_noindex, kept, or unverified where they were not read again."""
    out = before.where("not noindex").select("url").join(after.select("url", F.col("noindex").alias("now")), "url", "left")
    return out.select("url", F.when(F.col("now").isNull(), "unverified").when(F.col("now"), "newly_noindex").otherwise("kept").alias("state"))


def roadmap(found: DataFrame, rules: DataFrame, last: int = 99) -> DataFrame:
    """Findings (code, severity, pages) with the step and rank of the first rule for their code, most severe first, then by rank."""
    first = rules.groupBy("code").agg(F.min(F.struct("rank", "step")).alias("r")).select("code", "r.*")
    out = found.join(F.broadcast(first), "code", "left").withColumn("rank", F.coalesce("rank", F.lit(last)))
    weight = F.array_position(F.array(F.lit("critical"), F.lit("warn"), F.lit("info")), F.col("severity")).cast("int")
    return out.withColumn("weight", weight).orderBy("weight", "rank", "code")


def reconciled(new: DataFrame, existing: DataFrame) -> DataFrame:
    """new (id, text) with state: same, changed (id with another text), text_taken (text under another id) or new; texts without case and repeated white space."""
    plain = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    by_id = existing.select("id", plain(F.col("text")).alias("old"))
    by_text = existing.groupBy(plain(F.col("text")).alias("p")).agg(F.min("id").alias("other"))
    out = new.withColumn("p", plain(F.col("text"))).join(by_id, "id", "left").join(by_text, "p", "left")
    return out.select("id", F.when(F.col("old") == F.col("p"), "same").when(F.col("old").isNotNull(), "changed").when(F.col("other").isNotNull(), "text_taken").otherwise("new").alias("state"))


def backlog(tasks: DataFrame) -> DataFrame:
    """tasks (id, kind, severity) with priority and depends_on: critical findings come first, and every page waits for all of them. The list of these is one row."""
    blockers = tasks.where("kind = 'finding' and severity = 'critical'").agg(F.array_sort(F.collect_set("id")).alias("blockers"))
    page, critical = F.col("kind") == "page", (F.col("kind") == "finding") & F.coalesce(F.col("severity") == "critical", F.lit(False))
    return tasks.join(F.broadcast(blockers)).select("id", F.when(critical, 1).when(page, 2).otherwise(3).alias("priority"), F.when(page, F.size("blockers")).otherwise(0).alias("depends_on"))


def tally(checks: DataFrame) -> DataFrame:
    """One row: how many checks failed, warned, passed and were skipped, and the exit code: 1 after a failure, 2 where something was skipped, else 0."""
    out = checks.agg(*[F.count_if(F.col("status") == s).alias(s) for s in CHECKS])
    return out.withColumn("exit_code", F.when(F.col("fail") > 0, 1).when(F.col("skip") > 0, 2).otherwise(0))


def fact_states(facts: DataFrame, live: DataFrame, package: DataFrame) -> DataFrame:
    """facts (url, pointer, expected) against live and package leaves (url, pointer, value): agree, mismatch, missing, or unverified where the page was not read."""
    read = live.select("url").distinct().withColumn("read", F.lit(True))
    out = facts.join(live.select("url", "pointer", F.col("value").alias("live")), ["url", "pointer"], "left").join(package.select("url", "pointer", F.col("value").alias("packed")), ["url", "pointer"], "left").join(read, "url", "left")
    state = F.when(F.col("live") == F.col("expected"), "agree").when(F.col("live").isNotNull(), "mismatch").when(F.col("read"), "missing").otherwise("unverified")
    return out.select("url", "pointer", state.alias("state"), F.col("packed").eqNullSafe(F.col("expected")).alias("packed_agrees"))


def fact_verdict(states: DataFrame) -> DataFrame:
    """One row: fail with a mismatch or what a package claims and a page lacks, warn with what was not verified, else pass."""
    out = states.agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("agree", "mismatch", "missing", "unverified")], F.count_if((F.col("state") == "missing") & F.col("packed_agrees")).alias("claimed_missing"))
    return out.withColumn("verdict", F.when(F.col("mismatch") + F.col("claimed_missing") > 0, "fail").when(F.col("missing") + F.col("unverified") > 0, "warn").otherwise("pass"))


def discovery_coverage(requests: DataFrame) -> DataFrame:
    """One row: requests by state, and whether the search was complete, partial or failed."""
    states = ("searched", "omitted", "failed", "invalid")
    out = requests.agg(F.count("*").alias("requested"), *[F.count_if(F.col("state") == s).alias(s) for s in states])
    return out.withColumn("status", F.when(F.col("searched") == F.col("requested"), "complete").when(F.col("searched") > 0, "partial").otherwise("failed"))


def cycle_status(slots: DataFrame, by: list[str]) -> DataFrame:
    """The state of each cycle of slots (status, cited_count): complete, blocked, partial or pending, and completed slots without any citation."""
    out = slots.groupBy(*by).agg(F.count("*").alias("slots"), *[F.count_if(F.col("status") == s).alias(s) for s in ("complete", "blocked", "pending")], F.count_if((F.col("status") == "complete") & (F.col("cited_count") == 0)).alias("without_citations"))
    return out.withColumn("state", F.when(F.col("complete") == F.col("slots"), "complete").when(F.col("blocked") == F.col("slots"), "blocked").when(F.col("complete") > 0, "partial").otherwise("pending"))


def ordinals(headings: DataFrame, by: str, order: str) -> DataFrame:
    """headings with anchor: the slug, and a number from the second time on that a page has it."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.trim("heading")), r"[^\p{L}\p{N}\s_-]", ""), r"\s", "-")
    n = F.row_number().over(Window.partitionBy(by, "slug").orderBy(order)) - 1
    return headings.withColumn("slug", slug).withColumn("n", n).withColumn("anchor", F.when(F.col("n") > 0, F.concat("slug", F.lit("-"), F.col("n").cast("string"))).otherwise(F.col("slug"))).drop("n", "slug")


def proposals(candidates: DataFrame, seen: DataFrame, most: int = 3) -> DataFrame:
    """(intent, heading) of the first headings of each intent that its page does not have yet, each once; the number is the feature."""
    first = candidates.groupBy("intent", "heading").agg(F.min("place").alias("place")).join(seen, ["intent", "heading"], "left_anti")
    return first.withColumn("n", F.row_number().over(Window.partitionBy("intent").orderBy("place", "heading"))).where(F.col("n") <= most).select("intent", "heading", "n")


def limited(rows: DataFrame, order: list[str], n: int) -> tuple[DataFrame, DataFrame]:
    """(the first n rows, one row with how many remain): limits keep count of what they leave."""
    return rows.orderBy(*order).limit(n), rows.agg(F.greatest(F.lit(0).cast("long"), F.count("*") - n).alias("remaining"))


def ordered_changes(changes: DataFrame, cap: int = 200) -> DataFrame:
    """Changes (url, field, regression), regressions first, at most cap, with truncated: whether there were more."""
    total = changes.agg((F.count("*") > cap).alias("truncated"))
    return changes.orderBy(F.desc("regression"), "url", "field").limit(cap).join(F.broadcast(total))


def merged_sources(*sources: DataFrame) -> DataFrame:
    """Observations of several sources, each id once: the first source that has it wins."""
    all_ = None
    for i, s in enumerate(sources):
        one = s.withColumn("source_no", F.lit(i))
        all_ = one if all_ is None else all_.unionByName(one, allowMissingColumns=True)
    rest = [c for c in all_.columns if c not in ("id", "source_no")]
    return all_.groupBy("id").agg(F.min(F.struct("source_no", *rest)).alias("m")).select("id", "m.*")


def ordered_union(*arrays: Column) -> Column:
    """Values of arrays in order, each once."""
    return F.array_distinct(F.concat(*[F.coalesce(a, F.array().cast("array<string>")) for a in arrays]))


def cost_range(calls: DataFrame, prices: DataFrame, tokens_in: tuple[int, int] = (5_000, 15_000), tokens_out: int = 700, searches: int = 3) -> DataFrame:
    """calls (engine, model, calls) with the least and most that they may cost; null for a model without a price."""
    out = calls.join(F.broadcast(prices), ["engine", "model"], "left")
    each = lambda n: (F.col("price_in") * n + F.col("price_out") * tokens_out) / 1_000_000 + F.col("price_search") * searches
    return out.select("engine", "model", "calls", F.round(each(tokens_in[0]) * F.col("calls"), 4).alias("least"), F.round(each(tokens_in[1]) * F.col("calls"), 4).alias("most"))


def days_left(snapshots: DataFrame, today: Column, interval: int = 14) -> DataFrame:
    """(kind, last, due_in, overdue): days until each kind of snapshot is due again."""
    last = snapshots.groupBy("kind").agg(F.max("date").alias("last"))
    due = F.date_diff(F.date_add("last", interval), today)
    return last.select("kind", "last", due.alias("due_in"), (due < 0).alias("overdue"))


def numbered(rows: DataFrame, by: list[str], order: str, step: int = 10_000) -> DataFrame:
    """turn: a row's number within its group by an integer order. Groups are numbered in pieces of the order's range, with the pieces' counts before them, so a hot group is spread."""
    rows = rows.withColumn("_piece", F.floor(F.col(order) / step))
    counts = rows.groupBy(*by, "_piece").agg(F.count("*").alias("n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    own = Window.partitionBy(*by, "_piece").orderBy(order)
    return rows.join(before, [*by, "_piece"]).withColumn("turn", (F.row_number().over(own) + F.col("_before")).cast("int")).drop("_piece", "_before")


def collector_tally(rows: DataFrame) -> DataFrame:
    """(question_id, engine) with runs, hits, errors and unusable answers of a collector."""
    return rows.groupBy("question_id", "engine").agg(F.count("*").alias("runs"), F.count_if(F.coalesce("cited", F.lit(False)) & (F.col("outcome") == "observed")).alias("hits"), F.count_if(F.col("outcome") == "error").alias("errors"), F.count_if(F.col("outcome").isin("unmeasured", "blocked", "partial")).alias("unusable"))


def queue_status(slots: DataFrame, states: list[str]) -> DataFrame:
    """One row: slots by state, and how many are claimed without an end, to be reconciled by hand."""
    return slots.agg(*[F.count_if(F.col("status") == s).alias(s) for s in states], F.count_if((F.col("status") == "claimed") & F.col("submitted_at").isNotNull()).alias("to_reconcile"))


def channel_states(channels: DataFrame, rows: DataFrame) -> DataFrame:
    """(channel, state): observed where any run on it was observed, else unmeasured."""
    by = rows.groupBy("channel").agg(F.bool_or(F.col("outcome") == "observed").alias("seen"))
    return channels.join(by, "channel", "left").select("channel", F.when(F.col("seen"), "observed").otherwise("unmeasured").alias("state"))


def coverage_reasons(sites: DataFrame) -> DataFrame:
    """sites (site, remaining, robots_state, failed_sitemaps, truncated) with the sorted reasons why a crawl proves no absence; none means it is complete."""
    reasons = F.array_compact(F.array(F.when(F.col("remaining") > 0, "page_limit"), F.when(F.col("robots_state") == "unreachable", "robots_unreachable"), F.when(F.col("failed_sitemaps") > 0, "sitemap_failed"), F.when(F.col("truncated") > 0, "body_truncated")))
    return sites.select("site", F.array_sort(reasons).alias("reasons"), (F.size(reasons) == 0).alias("complete"))


def review_counts(issues: DataFrame, pages: DataFrame) -> DataFrame:
    """(page, issues, manual) of every page: found issues, and those that only a person can settle."""
    by = issues.groupBy("page").agg(F.count_if(~F.col("manual")).alias("issues"), F.count_if("manual").alias("manual"))
    return pages.join(by, "page", "left").fillna(0, ["issues", "manual"]).select("page", "issues", "manual")


def question_scope(questions: DataFrame) -> DataFrame:
    """questions (id, kind, text) with why they are left out of a protocol: brand questions and drafts; null for those that are in."""
    reason = F.when(F.col("kind") != "nonbrand", "brand").when(F.contains("text", F.lit("<<TODO")), "draft")
    return questions.select("id", reason.alias("excluded"))


def review_candidates(urls_: DataFrame, origin: str, most: int = 30) -> DataFrame:
    """The first different URLs of the origin, in their order; the number is the feature."""
    own = urls_.where(F.startswith("url", F.lit(origin + "/")) | (F.col("url") == origin)).groupBy("url").agg(F.min("place").alias("place"))
    return own.orderBy("place", "url").limit(most)


def faq_targets(items: DataFrame, crawled: DataFrame) -> DataFrame:
    """items (id, url) with why they get no markup: no_url, not_crawled or not_ok; null for those that do."""
    state = crawled.groupBy("url").agg(F.max((F.col("status") == 200).cast("int")).alias("ok"))
    out = items.join(state, "url", "left")
    return out.select("id", F.when(F.coalesce("url", F.lit("")) == "", "no_url").when(F.col("ok").isNull(), "not_crawled").when(F.col("ok") == 0, "not_ok").alias("skipped"))


def research_ids(pages: DataFrame, hits: DataFrame, runs: DataFrame) -> DataFrame:
    """pages (url) with the ids of discovery hits and of observed runs of their URL, sorted, each once."""
    ids = lambda df, name: df.groupBy("url").agg(F.array_sort(F.collect_set("id")).alias(name))
    none = F.array().cast("array<bigint>")
    out = pages.select("url").distinct().join(ids(hits, "hits"), "url", "left").join(ids(runs, "runs"), "url", "left")
    return out.select("url", F.coalesce("hits", none).alias("hits"), F.coalesce("runs", none).alias("runs"))


def from_log(rows: DataFrame, questions: DataFrame) -> DataFrame:
    """Observed citations of a log as evidence: of questions with their present fingerprint, not by API, with search, finished; one row for each URL, with an id that does not change."""
    usable = (F.col("mode") != "api") & F.col("search_enabled") & (F.col("outcome") == "observed") & F.col("answer_complete")
    each = measure.compatible(rows.drop("kind"), questions).where(F.col("compatible") & usable).select("seq", "date", "question_id", "engine", F.explode(F.array_distinct("cited_urls")).alias("url"))
    return each.withColumn("id", F.left(F.sha2(F.concat_ws("|", "date", F.col("question_id").cast("string"), "engine", F.col("seq").cast("string"), "url"), 256), F.lit(16)))


def stale_slots(queue: DataFrame, protocol: DataFrame, key: list[str]) -> DataFrame:
    """(key, state) of slots that queue and protocol do not share: gone from the protocol, or not yet in the queue. None means the queue is current."""
    both = queue.select(*key, F.lit(True).alias("_queued")).unionByName(protocol.select(*key, F.lit(False).alias("_queued")))
    # keys with nulls equal nothing, so their sides stay apart
    empty = F.exists(F.array(*[F.col(k).isNull() for k in key]), lambda x: x)
    sides = both.withColumn("_own", F.when(empty, F.col("_queued"))).groupBy(*key, "_own").agg(F.bool_and("_queued").alias("_all"), F.bool_or("_queued").alias("_any"))
    return sides.where(F.col("_all") == F.col("_any")).select(*key, F.when(F.col("_any"), "gone").otherwise("missing").alias("state"))
