"""Operators over observations: did an engine cite or mention the site for a question, run by run.

An observation has date, question_id, kind, engine, run_no, planned_runs, mode, locale, surface, login, search_enabled,
fingerprint, reservation, outcome, answer_complete, coverage, cited, mentioned, organic, seq. Unknown is never zero: a
rate's denominator holds only runs whose answer is known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import rate, wilson

KEY = ["date", "question_id", "engine", "run_no", "mode", "surface", "locale", "login", "search_enabled", "campaign_id", "model", "session_id"]
#: What a reserved run and the run that fulfils it have in common.
SLOT = ["date", "question_id", "fingerprint", "engine", "run_no", "mode", "campaign_id"]
COHORT = ["engine", "mode", "surface", "locale", "login", "search_enabled"]


def key_value(name: str) -> Column:
    """A key's field as rows are told apart by it: a missing mode is manual, a missing surface the engine, other missing ones empty."""
    if name == "mode":
        return F.coalesce(name, F.lit("manual"))
    if name == "surface":
        return F.coalesce(name, "engine")
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in ("locale", "login", "search_enabled", "campaign_id", "model", "session_id", "fingerprint") else F.col(name)


def last_write_wins(rows: DataFrame, key: list[str] = KEY, order: str = "seq") -> DataFrame:
    """The last row of each key; a partial aggregate, not a window, so a hot key is combined before the shuffle."""
    rest = [c for c in rows.columns if c != order]
    return rows.groupBy(*[key_value(c).alias(f"_{c}") for c in key]).agg(F.max(F.struct(order, *rest)).alias("m")).select("m.*").select(*rows.columns)


def compatible(rows: DataFrame, questions: DataFrame) -> DataFrame:
    """rows of known questions, with compatible: whether the fingerprint is the question's now."""
    now = questions.select("question_id", F.col("fingerprint").alias("expected"), "kind")
    return rows.join(now, "question_id").withColumn("compatible", F.col("fingerprint").eqNullSafe(F.col("expected")))


def without_fulfilled(rows: DataFrame) -> DataFrame:
    """Reserved rows whose slot has an observed row go; all others stay."""
    slot = [key_value(c).alias(f"_{c}") for c in SLOT]
    names = [f"_{c}" for c in SLOT]
    done = rows.where("outcome = 'observed'").select(*slot).distinct()
    reserved = rows.where("reservation").select("*", *slot).join(done, names, "left_anti").drop(*names)
    return reserved.unionByName(rows.where("reservation is null or not reservation"))


def current(rows: DataFrame, order: str = "seq") -> DataFrame:
    """A log's rows as they are now: the last of each key, without fulfilled reservations."""
    return without_fulfilled(last_write_wins(rows, KEY, order))


def citation_known() -> Column:
    full = (F.coalesce("coverage", F.lit("unknown")) == "complete") | F.coalesce("cited", F.lit(False))
    return (F.col("outcome") == "observed") & F.coalesce("answer_complete", F.lit(False)) & full & F.col("cited").isNotNull()


def counts() -> list[Column]:
    known, observed = citation_known(), F.col("outcome") == "observed"
    return [
        F.count("*").alias("attempts"),
        F.count_if(observed).alias("runs"),
        F.count_if(F.col("outcome") == "error").alias("errors"),
        F.count_if(F.col("outcome").isin("unmeasured", "blocked", "partial")).alias("unmeasured"),
        F.count_if(known).alias("citation_known"),
        F.count_if(known & F.col("cited")).alias("cited"),
        F.count_if(observed & F.col("mentioned").isNotNull()).alias("mention_known"),
        F.count_if(observed & F.coalesce("mentioned", F.lit(False))).alias("mention_hits"),
        F.count_if(observed & F.col("organic").isNotNull()).alias("organic_known"),
        F.count_if(observed & F.coalesce("organic", F.lit(False))).alias("organic_visible"),
    ]


def slots(rows: DataFrame, by: list[str]) -> DataFrame:
    """Counts of attempts, runs, errors, unmeasured, known and hits."""
    return rows.groupBy(*by).agg(*counts())


def rates(rows: DataFrame, by: list[str]) -> DataFrame:
    c = F.col
    return slots(rows, by).select(*by, "citation_known", "cited", rate(c("cited"), c("citation_known")).alias("citation_rate"), rate(c("mention_hits"), c("mention_known")).alias("mention_rate"), rate(c("organic_visible"), c("organic_known")).alias("organic_rate"))


def question_hits(rows: DataFrame, by: list[str]) -> DataFrame:
    """For each group, questions with a known run and those cited at least once."""
    each = rows.where(citation_known()).groupBy(*by, "question_id").agg(F.max(F.col("cited").cast("int")).alias("hit"))
    return each.groupBy(*by).agg(F.count("*").alias("questions"), F.sum("hit").cast("long").alias("hit_questions"))


def trend(rows: DataFrame) -> DataFrame:
    known = citation_known()
    return rows.groupBy("date").agg(F.count_if(known).alias("runs"), F.count("*").alias("attempts"), F.count_if(F.col("outcome") == "error").alias("errors"), F.count_if(F.col("outcome") == "unmeasured").alias("unmeasured"), F.count_if(known & F.col("cited")).alias("cited"))


def plan_coverage(rows: DataFrame) -> DataFrame:
    """Planned runs (the largest plan or run number of each condition, summed) against completed and confirmed ones."""
    condition = ["date", "engine", "question_id", "mode", "surface", "locale"]
    each = rows.groupBy(*condition).agg(F.max(F.coalesce("planned_runs", "run_no")).alias("planned"), F.count_if(F.col("outcome") == "observed").alias("completed"), F.count_if(citation_known()).alias("confirmed"))
    out = each.groupBy("date", "engine", "question_id").agg(F.sum("planned").cast("long").alias("planned"), F.sum("completed").cast("long").alias("completed"), F.sum("confirmed").cast("long").alias("confirmed"))
    return out.withColumn("unmeasured", F.greatest(F.lit(0).cast("long"), F.col("planned") - F.col("completed")))


def conditions(rows: DataFrame) -> DataFrame:
    """Sorted distinct values of each condition, one row for each."""
    names = ["engine", "mode", "surface", "locale", "login"]
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(n).alias("condition"), F.col(n).alias("value")) for n in names])).alias("x")).select("x.*")
    return long.groupBy("condition", "value").agg(F.count("*").alias("n_rows"))


def pooled(rows: DataFrame, by: list[str]) -> DataFrame:
    low, high = wilson(F.col("cited"), F.col("citation_known"))
    return slots(rows, by).select(*by, "citation_known", "cited", rate(F.col("cited"), F.col("citation_known")).alias("citation_rate"), low.alias("low"), high.alias("high"))


def verdicts(before: DataFrame, after: DataFrame, by: list[str], least_runs: int = 5, least_change: float = 0.10) -> DataFrame:
    """Change of the citation rate between two windows: improved, regressed or steady, or not_comparable with too few known runs or errors."""
    a = slots(before, by).select(*by, F.col("citation_known").alias("known_before"), F.col("cited").alias("cited_before"), F.col("errors").alias("errors_before"))
    b = slots(after, by).select(*by, F.col("citation_known").alias("known_after"), F.col("cited").alias("cited_after"), F.col("errors").alias("errors_after"))
    out = a.join(b, by, "full").fillna(0, ["known_before", "cited_before", "errors_before", "known_after", "cited_after", "errors_after"])
    change = F.round(F.col("cited_after") / F.col("known_after") - F.col("cited_before") / F.col("known_before"), 4)
    enough = (F.least("known_before", "known_after") >= least_runs) & (F.col("errors_before") + F.col("errors_after") == 0)
    out = out.withColumn("change", F.when(enough, change))
    return out.withColumn("verdict", F.when(~enough, "not_comparable").when(F.col("change") >= least_change, "improved").when(F.col("change") <= -least_change, "regressed").otherwise("steady"))


def outer_counts(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Counts of each key in two sets, 0 where it is missing, and whether it is new, lost or kept."""
    a, b = before.groupBy(key).agg(F.count("*").alias("n_before")), after.groupBy(key).agg(F.count("*").alias("n_after"))
    out = a.join(b, key, "full").fillna(0, ["n_before", "n_after"])
    return out.withColumn("state", F.when(F.col("n_before") == 0, "new").when(F.col("n_after") == 0, "lost").otherwise("kept"))


def as_of(left: DataFrame, right: DataFrame, by: str, date: str, value: str) -> DataFrame:
    """left with the latest value of right on or before its date: one union, one running last value, no range join."""
    from pyspark.sql import Window

    both = left.select(by, date, F.lit(None).cast(right.schema[value].dataType).alias(value), F.lit(1).alias("asks")).unionByName(right.select(by, date, value, F.lit(0).alias("asks")))
    w = Window.partitionBy(by).orderBy(date, "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(w)).where("asks = 1").drop("asks")


def performance(rows: DataFrame, by: list[str]) -> DataFrame:
    """Clicks, impressions, click rate and impression-weighted position; rows without impressions have no weight."""
    shown = F.col("impressions") > 0
    out = rows.groupBy(*by).agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), F.sum(F.when(shown, F.col("position") * F.col("impressions"))).alias("weighted"), F.count_if(~shown).alias("zero_rows"))
    return out.select(*by, "clicks", "impressions", F.when(F.col("impressions") > 0, F.round(F.col("clicks") / F.col("impressions"), 6)).alias("ctr"), F.when(F.col("impressions") > 0, F.round(F.col("weighted") / F.col("impressions"), 4)).alias("position"), "zero_rows")


def date_gaps(rows: DataFrame, date: str = "date") -> DataFrame:
    """Days between the first and the last on which there are no rows."""
    span = rows.agg(F.min(date).alias("a"), F.max(date).alias("b"))
    return span.where("a is not null").select(F.explode(F.sequence("a", "b")).alias(date)).join(rows.select(date).distinct(), date, "left_anti")


def protocol(questions: DataFrame, engines: list[str], runs: int) -> DataFrame:
    """A slot for each question, engine and run. engines and runs are short literals, so rows are made by explode."""
    return questions.select("question_id", F.explode(F.array(*map(F.lit, engines))).alias("engine")).withColumn("run_no", F.explode(F.sequence(F.lit(1), F.lit(runs))))
