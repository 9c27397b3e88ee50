"""Checks of texts before they are published, of the claims in them, and of what profiles say of a brand. They find; whether a text is right is for a person to say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrow, lines, markup, parsing, text

# fixed values: words of comparisons, and of their limits
COMPARES = r"\b(?:vs\.?|versus|compare|comparison)\b|비교|대안"
LIMITS = r"제한|단점|부적합|주의|한계|적합하지|limitations?|trade.?offs?|not suitable"
IDENTITY = ("name", "category", "audience")


def _has(x: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_like(x, F.lit("(?iu)" + pattern)), F.lit(False))


def _date(x: Column, name: str) -> Column:
    return F.when(F.coalesce(x, F.lit("")) == "", f"{name}_missing").when(parsing.strict_date(x).isNull(), f"{name}_invalid")


def _rows(df: DataFrame, key: str, codes: Column, state: str) -> DataFrame:
    own = F.col("claim") if "claim" in df.columns else F.lit(None).cast("int")
    return df.select(key, own.alias("claim"), F.explode(F.array_compact(codes)).alias("code")).select(key, "claim", "code", F.lit(state).alias("state"), F.lit(None).cast("string").alias("heading"))


def checks(pages: DataFrame, claims: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, claim, code, state, heading) of pages (key, body, updated_at) and their claims (key, claim, text, source_url, quote, source_text, source_date).

    State is found for what is amiss, observed_in_input for a quote that its source text has, review for what a person has to look at. Null texts are empty. Claims of pages that are not there give nothing.
    """
    pages = pages.select(key, F.coalesce("body", F.lit("")).alias("body"), "updated_at")
    body = F.col("body")
    amiss = F.array(F.when(_has(body, lines.PLACEHOLDER.pattern), "placeholder"), F.when(_has(body, r"(?m)^\s*[-*]\s*\[ \]"), "unchecked_task"), _date(F.col("updated_at"), "page_date"))
    with_claims = pages.join(claims.select(key).distinct().withColumn("some", F.lit(True)), key, "left")
    manual = F.array(F.lit("visible_date_author"), F.when(_has(body, COMPARES), F.when(_has(body, LIMITS), "comparison_with_limits").otherwise("comparison_without_limits")), F.when(F.col("some").isNull(), "evidence_coverage"))
    asked = markup.read(pages.select(key, "body"), lines.question_answers, lines.ANSWERS, "body")
    none = F.array(F.struct(F.lit(None).cast("string").alias("heading"), F.lit("direct_answer").alias("code")))
    each = F.transform("questions", lambda q: F.struct(q["heading"].alias("heading"), F.when(q["candidate"], "question_answer").otherwise("question_without_answer").alias("code")))
    answers = asked.select(key, F.explode(F.when(F.size("questions") > 0, each).otherwise(none)).alias("q")).select(key, F.lit(None).cast("int").alias("claim"), "q.code", F.lit("review").alias("state"), "q.heading")

    own = claims.select(key, "claim", F.coalesce("text", F.lit("")).alias("text"), F.trim(F.coalesce("source_url", F.lit(""))).alias("source_url"), F.trim(F.coalesce("quote", F.lit(""))).alias("quote"), F.coalesce("source_text", F.lit("")).alias("source_text"), "source_date").join(pages.select(key, "body"), key)
    lacking = (F.col("source_url") == "") | (F.col("quote") == "") | (F.col("source_text") == "")
    quoted = F.contains(F.col("source_text"), F.col("quote"))
    wrong = F.array(F.when(~F.contains(body, F.col("text")), "claim_absent"), F.when(lacking, "claim_evidence_missing").when(~quoted, "quote_absent"), _date(F.col("source_date"), "source_date"))
    good = F.array(F.when(~lacking & quoted, "literal_quote_match"))
    parts = [_rows(pages, key, amiss, "found"), _rows(with_claims, key, manual, "review"), answers, _rows(own, key, wrong, "found"), _rows(own, key, good, "observed_in_input"), _rows(own, key, F.array(F.lit("claim_truth")), "review")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def summary(found: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, detected_issues, editorial_checks)."""
    return found.groupBy(key).agg(F.count_if(F.col("state") == "found").alias("detected_issues"), F.count_if(F.col("state") == "review").alias("editorial_checks"))


def identity_states(identity: DataFrame, profiles: DataFrame, by: str) -> DataFrame:
    """(by, profile_url, field, expected, supplied, state): every field of a profile against that of its brand (by): unknown where one is empty, literal_match without regard to case and white space, else review. A profile of a brand that is not known is unknown."""
    fields = lambda df, name, *own: df.select(by, *own, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f), F.lit("")).alias(name)) for f in IDENTITY])).alias("x")).select(by, *own, "x.*")
    both = fields(profiles, "supplied", "profile_url").join(fields(identity.dropDuplicates([by]), "expected"), [by, "field"], "left")
    plain = lambda c: arrow.caseless(text.squeezed(F.coalesce(F.col(c), F.lit(""))))
    both = both.withColumns({"a": plain("expected"), "b": plain("supplied")})
    state = F.when((F.col("a") == "") | (F.col("b") == ""), "unknown").when(F.col("a") != F.col("b"), "review").otherwise("literal_match")
    return both.select(by, "profile_url", "field", F.coalesce("expected", F.lit("")).alias("expected"), "supplied", state.alias("state"))
