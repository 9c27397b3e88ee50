"""Which page is to be kept, improved, merged or made, by what an analysis proposes and what its evidence admits; evidence out of job queues; what an audit observed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrow

# fixed values: what a plan's action means for a page, and what is left to a person
DERIVED = {"update": "improve", "create": "new"}
CONFLICT = "Resolve conflicting source statements before writing claims."
MANUAL = "Confirm answer coverage and source meaning manually."
ALWAYS = "Confirm conversion action and factual eligibility before publication."
ADMITTED = "struct<action:string,reason:string,source_id:string,quote:string>"


def decided(plan: DataFrame, analysis: DataFrame, structural: bool = False) -> DataFrame:
    """(intent_id, decision, reason, source_id, quote, unresolved) of plan rows by the proposals of an analysis; intents that it does not have are left out.

    plan: (intent_id, action, rationale, candidates, missing_facts, doubtful_facts: arrays of texts, open_gaps boolean). analysis, a row an intent: (intent_id, proposed ADMITTED or null, owned
    array of (id, url), explicit array of URLs, scope_sources array of ids whose finding is on the scope of an answer, conflicts boolean). A proposal counts if its evidence admits it:
    review always; keep for the one candidate that is mapped explicitly, is among the owned sources, has a finding on its scope, and leaves nothing missing or in conflict; improve for such
    a candidate; consolidate for two or more explicit ones that are all owned sources; new where the plan says create. Else the plan's action decides. Nulls in arrays count as nothing.
    """
    empty = F.array().cast("array<string>")
    own = lambda c: F.array_compact(F.coalesce(F.col(c), empty))
    rows = plan.join(analysis, "intent_id").withColumns({c: own(c) for c in ("candidates", "missing_facts", "doubtful_facts", "explicit", "scope_sources")}).withColumn("conflicts", F.coalesce("conflicts", F.lit(False)))
    owned = F.coalesce("owned", F.array().cast("array<struct<id:string,url:string>>"))
    rows = rows.withColumns({"owned_ids": F.array_compact(F.transform(owned, lambda x: x["id"])), "matched": F.array_intersect("candidates", "explicit")})
    rows = rows.withColumn("cited", F.array_intersect("matched", F.array_compact(F.transform(owned, lambda x: x["url"]))))
    one = (F.size("candidates") == 1) & (F.size("cited") > 0)
    clean = ~F.col("conflicts") & (F.size("missing_facts") == 0) & ~F.coalesce("open_gaps", F.lit(False))
    wants = F.col("proposed.action")
    admitted = (
        (wants == "review") | ((wants == "keep") & one & F.arrays_overlap("scope_sources", "owned_ids") & clean) | ((wants == "improve") & one)
        | ((wants == "consolidate") & (F.size("matched") >= 2) & (F.size("cited") == F.size("matched"))) | ((wants == "new") & (F.col("action") == "create"))
    )
    admitted = F.coalesce(admitted, F.lit(False))
    derived = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in DERIVED.items() for x in pair]), F.coalesce("action", F.lit(""))), F.lit("review"))
    rows = rows.withColumns({"decision": F.when(admitted, wants).otherwise(derived), "reason": F.when(admitted, F.col("proposed.reason")).otherwise(F.coalesce("rationale", F.lit("")))})
    # a proposal that comes to the same as what the plan says still lends its evidence
    same = F.coalesce(F.col("decision") == wants, F.lit(False))
    doubts = F.transform("doubtful_facts", lambda x: F.concat(F.lit("Verify fact relevance: "), x))
    open_ = F.concat("missing_facts", doubts, F.when(F.col("conflicts"), F.array(F.lit(CONFLICT))).otherwise(empty), F.array(F.lit(MANUAL)) if structural else empty, F.array(F.lit(ALWAYS)))
    return rows.select("intent_id", "decision", "reason", F.when(same, F.col("proposed.source_id")).alias("source_id"), F.when(same, F.col("proposed.quote")).alias("quote"), F.array_distinct(open_).alias("unresolved"))


def queue_citations(slots: DataFrame, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What slots of a job queue (slot_id, question_id, text_sha256, provider, status, answer_complete, observed_at, cited_urls) observed of questions (question_id, text), and what was left out.

    Rows are (row_id, slot_id, place, question_id, provider, url, observed_at), one a cited URL of slots that ended and whose answer is complete. Left out, as (slot_id, reason): stale_slot, whose
    question has gone or changed, and not_public, for URLs that no one could open.
    """
    asked = questions.dropDuplicates(["question_id"]).select("question_id", F.sha2("text", 256).alias("now"))
    each = slots.join(asked, "question_id", "left").withColumn("stale", ~F.coalesce(F.col("now") == F.col("text_sha256"), F.lit(False)))
    done = each.where("not stale and status in ('complete', 'incomplete') and answer_complete")
    cited = done.select("slot_id", "question_id", "provider", "observed_at", F.posexplode("cited_urls").alias("place", "url")).withColumn("public", F.coalesce(arrow.public_url("url"), F.lit(False)))
    row_id = F.concat(F.lit("queue-"), F.left(F.sha2(F.col("slot_id").cast("string"), 256), F.lit(12)), F.lit("-"), F.col("place").cast("string"))
    rows = cited.where("public").select(row_id.alias("row_id"), "slot_id", "place", "question_id", "provider", "url", "observed_at")
    left = each.where("stale").select("slot_id", F.lit("stale_slot").alias("reason")).unionByName(cited.where("not public").select("slot_id", F.lit("not_public").alias("reason")))
    return rows, left


def surface_states(sites: DataFrame) -> DataFrame:
    """(site, surface, state) of sites (site, robots_state, pages, sitemap_files, mirrors_checked, mirrors_found): observed, not_exposed for mirrors that were looked for and not found, or unmeasured: never a zero for what was not looked at.

    Nothing was observed of a site whose robots file was not reached. A null is what was not looked at.
    """
    blind = F.coalesce(F.col("robots_state") == "unreachable", F.lit(False))
    some = lambda c: F.when(F.coalesce(F.col(c), F.lit(0)) > 0, "observed").otherwise("unmeasured")
    mirrors = F.when(~F.coalesce(F.col("mirrors_checked") > 0, F.lit(False)), "unmeasured").when(F.coalesce(F.col("mirrors_found"), F.lit(0)) > 0, "observed").otherwise("not_exposed")
    states = {"pages": some("pages"), "robots": F.when(F.col("robots_state").isNotNull(), "observed").otherwise("unmeasured"), "sitemap": some("sitemap_files"), "mirrors": mirrors}
    each = F.array(*[F.struct(F.lit(k).alias("surface"), F.when(blind, "unmeasured").otherwise(v).alias("state")) for k, v in states.items()])
    return sites.select("site", F.explode(each).alias("x")).select("site", "x.*")


def control_values(pages: DataFrame, fields: list[str]) -> DataFrame:
    """(page_id, field, observed, value) of pages with status and error: a control of a page that was not read, or that its record lacks, was not observed; an empty one was."""
    seen = F.coalesce((F.col("status") == 200) & (F.coalesce(F.col("error"), F.lit("")) == ""), F.lit(False))
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    out = pages.select("page_id", seen.alias("seen"), F.explode(each).alias("x")).select("page_id", "seen", "x.*")
    known = F.col("seen") & F.col("value").isNotNull()
    return out.select("page_id", "field", known.alias("observed"), F.when(known, F.col("value")).alias("value"))
