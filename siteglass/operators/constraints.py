"""Inputs held to declared constraints: every violation with its place, or nothing at all.

Constraints are of three kinds: a test of a row, values that are unique, and values that must stand in another table. They are compiled into one plan: all tests of rows in
one projection, one count for each unique key, one join for each reference. `checked` adds each row's problems in the order of declaration, `violations` lists them, and `enforced` gives the
rows back only if there are none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parsing
from ..functions.arrow import public_url


@dataclass(frozen=True)
class Holds:
    """A test that each row must pass; a test that is null is not passed."""

    name: str
    test: Column


@dataclass(frozen=True)
class Unique:
    """Values of which each comes once; rows in which one of them is null are left alone."""

    name: str
    by: tuple[str, ...]


@dataclass(frozen=True)
class Refers:
    """Values that must stand in another table, unless one of them is null."""

    name: str
    by: tuple[str, ...]
    to: DataFrame
    its: tuple[str, ...]


Constraint = Holds | Unique | Refers


def checked(rows: DataFrame, constraints: list[Constraint]) -> DataFrame:
    """rows with problems: the names of the constraints that each breaks."""
    out, failed = rows, []
    for k, c in enumerate(constraints):
        if isinstance(c, Holds):
            failed.append(F.when(~F.coalesce(c.test, F.lit(False)), c.name))
            continue
        mark, keys = f"_c{k}", [f"_k{k}_{i}" for i in range(len(c.by))]
        if isinstance(c, Unique):
            side = rows.groupBy(*[F.col(b).alias(n) for b, n in zip(c.by, keys, strict=True)]).agg(F.count("*").alias(mark)).where(F.col(mark) > 1)
            failed.append(F.when(F.col(mark).isNotNull(), c.name))
        else:
            side = c.to.select(*[F.col(b).alias(n) for b, n in zip(c.its, keys, strict=True)]).distinct().withColumn(mark, F.lit(1))
            given = F.lit(True)
            for b in c.by:
                given = given & F.col(b).isNotNull()
            failed.append(F.when(given & F.col(mark).isNull(), c.name))
        same = F.lit(True)
        for b, n in zip(c.by, keys, strict=True):
            same = same & (out[b] == side[n])
        out = out.join(side, same, "left").drop(*keys)
    return out.select(*rows.columns, F.array_compact(F.array(*failed)).alias("problems"))


def violations(rows: DataFrame, place: list[str], constraints: list[Constraint]) -> DataFrame:
    """(place, problem): one row for each constraint that a row breaks."""
    return checked(rows, constraints).select(*place, F.explode("problems").alias("problem"))


def enforced(rows: DataFrame, place: list[str], constraints: list[Constraint], shown: int = 10) -> DataFrame:
    """rows, if all constraints hold; else an error that names the first violations and counts all."""
    broken = violations(rows, place, constraints)
    n = broken.count()
    if n:
        first = [", ".join(f"{k} {r[k]}" for k in place) + f": {r['problem']}" for r in broken.orderBy(*place, "problem").limit(shown).collect()]
        raise ValueError(f"{n} violations: " + "; ".join(first))
    return rows


def said(name: str) -> Column:
    return F.coalesce(F.trim(name), F.lit("")) != ""


def bounded(name: str, most: int, required: bool = True) -> Column:
    """Text of at most so many characters, which may lack where it is not required."""
    fits = said(name) & (F.length(name) <= most)
    return fits if required else F.col(name).isNull() | (F.length(name) <= most)


def words(name: str) -> Column:
    """A list of texts none of which is blank."""
    return F.col(name).isNotNull() & ~F.exists(name, lambda x: x.isNull() | (F.trim(x) == ""))


def observations(questions: DataFrame, channels: DataFrame) -> list[Constraint]:
    """Of imported observations (id, query_id, query_text, channel, outcome, observed_at, url, evidence_url, position): questions are (id, text), channels (channel)."""
    seen = F.col("outcome") != "observed"
    return [
        *[Holds(f"no_{name}", said(name)) for name in ("id", "query_id", "channel", "outcome", "observed_at")],
        Unique("repeated_id", ("id",)),
        Refers("unknown_question", ("query_id",), questions, ("id",)),
        Refers("unknown_channel", ("channel",), channels, ("channel",)),
        Refers("other_text", ("query_id", "query_text"), questions, ("id", "text")),
        Holds("no_text", F.col("query_text").isNotNull()),
        Holds("bad_time", parsing.zoned_timestamp(F.col("observed_at"))),
        Holds("bad_outcome", F.col("outcome").isin("observed", "unmeasured", "error")),
        Holds("private_url", seen | (public_url(F.col("url")) & public_url(F.col("evidence_url")))),
        Holds("bad_position", F.col("position").isNull() | (F.col("position") >= 1)),
    ]


def brief_questions() -> list[Constraint]:
    """Of a brief's questions (id, text, intent_id, page_type, terms, required_sections, priority, type)."""
    return [
        *[Holds(f"no_{name}", said(name)) for name in ("id", "text", "intent_id", "page_type")],
        Holds("bad_terms", words("terms")),
        Holds("bad_sections", words("required_sections")),
        Unique("repeated_id", ("id",)),
        Holds("bad_priority", F.col("priority").isNull() | F.col("priority").isin(1, 2, 3)),
        Holds("bad_type", F.col("type").isNull() | F.col("type").isin("brand", "nonbrand")),
    ]


def brief_facts(intents: DataFrame) -> list[Constraint]:
    """Of a brief's facts, one row for each intent that a fact names (id, text, source_url, verified, intent_id)."""
    return [
        *[Holds(f"no_{name}", said(name)) for name in ("id", "text")],
        Holds("private_source", public_url(F.col("source_url"))),
        Holds("no_verdict", F.col("verified").isNotNull()),
        Unique("repeated_id", ("id", "intent_id")),
        Refers("unknown_intent", ("intent_id",), intents, ("intent_id",)),
    ]


def brief_pages(intents: DataFrame, site_url: str) -> list[Constraint]:
    """Of a brief's pages (intent_id, url), all on the site's own host."""
    host = lambda x: F.regexp_replace(F.lower(F.regexp_extract(x, r"(?i)^https?://([^/?#:]+)", 1)), r"\.$", "")
    return [
        Holds("no_intent", said("intent_id")),
        Holds("private_url", public_url(F.col("url"))),
        Refers("unknown_intent", ("intent_id",), intents, ("intent_id",)),
        Holds("other_host", host(F.col("url")) == host(F.lit(site_url))),
    ]


def ledger() -> list[Constraint]:
    """Of a ledger of facts (url, pointer, expected, kind, evidence, type): what a pointer into a page's JSON-LD must give; kind is that of the JSON value, absent where there is none."""
    return [
        Holds("bad_url", F.regexp_like(F.trim("url"), F.lit("^https?://"))),
        Holds("bad_pointer", F.startswith("pointer", F.lit("/")) & (F.col("pointer") != "/")),
        Holds("no_expected", F.col("kind") != "absent"),
        Holds("bad_expected", ~F.col("kind").isin("null", "object", "array")),
        Holds("blank_expected", (F.col("kind") != "string") | said("expected")),
        Holds("not_finite", (F.col("kind") != "number") | F.col("expected").try_cast("double").between(-1.7976931348623157e308, 1.7976931348623157e308)),
        Holds("no_evidence", said("evidence")),
        Holds("blank_type", F.col("type").isNull() | said("type")),
    ]


MOST_CLAIMS = 100


def review_pages() -> list[Constraint]:
    """Of pages to review (id, url, intent, body, n_claims, updated_at)."""
    return [
        Holds("bad_id", bounded("id", 120)),
        Unique("repeated_id", ("id",)),
        Holds("private_url", public_url(F.col("url")) & (F.length("url") <= 2048)),
        Holds("bad_intent", bounded("intent", 500)),
        Holds("bad_body", bounded("body", 100_000)),
        Holds("too_many_claims", F.col("n_claims").between(0, MOST_CLAIMS)),
        Holds("bad_updated_at", bounded("updated_at", 40, required=False)),
    ]


def review_claims(pages: DataFrame) -> list[Constraint]:
    """Of their claims (page_id, text, source_url, quote, source_text, source_date)."""
    return [
        Refers("unknown_page", ("page_id",), pages, ("id",)),
        Holds("bad_text", bounded("text", 2000)),
        *[Holds(f"bad_{name}", bounded(name, most, required=False)) for name, most in (("quote", 2000), ("source_text", 30_000), ("source_date", 40))],
        Holds("private_source", (F.coalesce("source_url", F.lit("")) == "") | (public_url(F.col("source_url")) & (F.length("source_url") <= 2048))),
    ]
