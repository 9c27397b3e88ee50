"""Queries over logs that are folded into states, and the SQL they must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from ..streaming import jobs

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def job_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a log of jobs: a user is a slot, a type of event a kind, a day of the month's third a dispatch, and values are what was seen."""
    kind = F.create_map(*[F.lit(x) for pair in (("view", "claim"), ("click", "submit"), ("purchase", "record"), ("error", "block"), ("signup", "requeue")) for x in pair])
    v, day = F.col("value"), F.dayofmonth("ts")
    complete = F.when(v >= 3, v >= 20)
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("slot"),
        F.col("event_id").alias("seq"),
        F.element_at(kind, F.col("event_type")).alias("kind"),
        F.concat(F.lit("d"), F.floor(day / 10).cast("string")).alias("dispatch"),
        F.when(v >= 2, F.concat(F.lit("session "), F.floor(day / 15).cast("string"))).alias("evidence"),
        F.when(v < 60, "quota").when(v < 90, "auth").otherwise("weather").alias("reason"),
        (v >= 10).alias("confirmed"),
        complete.alias("answer_complete"),
        F.when(v >= 40, "complete").when(v >= 5, "partial").alias("coverage"),
        F.when(complete | (v < 4), v >= 50).alias("mentioned"),
        F.array(F.floor(v).cast("string")).alias("cited"),
    )


#: The log by users, numbered from 1, and the fold: each step takes the next event of all users at once.
REPLAY_SQL = """WITH RECURSIVE l AS (SELECT user_id AS slot, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n,
        CASE event_type WHEN 'view' THEN 'claim' WHEN 'click' THEN 'submit' WHEN 'purchase' THEN 'record' WHEN 'error' THEN 'block' WHEN 'signup' THEN 'requeue' END AS kind,
        'd' || day(ts) // 10 AS dispatch, CASE WHEN value >= 2 THEN 'session ' || day(ts) // 15 END AS evidence,
        CASE WHEN value < 60 THEN 'quota' WHEN value < 90 THEN 'auth' ELSE 'weather' END AS reason, value >= 10 AS confirmed,
        CASE WHEN value < 3 THEN 'answer_complete' WHEN value < 4 THEN 'brand_mentioned' WHEN value < 5 THEN 'citation_coverage' END AS problem,
        value >= 40 AS finished, concat_ws(',', value >= 20, CASE WHEN value >= 40 THEN 'complete' ELSE 'partial' END, CASE WHEN value >= 20 THEN value >= 50 END, floor(value)) AS result FROM events),
    v AS (SELECT slot, 0::BIGINT AS n, NULL::BIGINT AS seq, NULL::VARCHAR AS kind, NULL::VARCHAR AS verdict, 'pending' AS status, 0 AS attempts, NULL::VARCHAR AS dispatch, NULL::VARCHAR AS evidence, false AS submitted, NULL::VARCHAR AS result, NULL::VARCHAR AS reason FROM l GROUP BY slot
        UNION ALL SELECT slot, n, seq, kind, verdict,
            CASE WHEN verdict <> 'done' THEN status WHEN kind = 'claim' THEN 'claimed' WHEN kind = 'submit' THEN 'submitted' WHEN kind = 'record' THEN CASE WHEN finished THEN 'complete' ELSE 'incomplete' END WHEN kind = 'block' THEN 'blocked' ELSE 'pending' END,
            CASE WHEN verdict = 'done' AND kind = 'claim' THEN attempts + 1 ELSE attempts END,
            CASE WHEN verdict <> 'done' THEN dispatch WHEN kind = 'claim' THEN e_dispatch WHEN kind = 'requeue' THEN NULL ELSE dispatch END,
            CASE WHEN verdict <> 'done' THEN evidence WHEN kind IN ('claim', 'requeue') THEN NULL WHEN kind = 'submit' THEN e_evidence ELSE evidence END,
            CASE WHEN verdict <> 'done' THEN submitted WHEN kind IN ('claim', 'requeue') THEN false WHEN kind = 'submit' THEN true ELSE submitted END,
            CASE WHEN verdict <> 'done' THEN result WHEN kind IN ('claim', 'requeue') THEN NULL WHEN kind = 'record' THEN e_result ELSE result END,
            CASE WHEN verdict <> 'done' THEN reason WHEN kind IN ('claim', 'requeue', 'record') THEN NULL WHEN kind = 'block' THEN e_reason ELSE reason END
        FROM (SELECT v.slot, l.n, l.seq, l.kind, v.status, v.attempts, v.dispatch, v.evidence, v.submitted, v.result, v.reason, l.dispatch AS e_dispatch, l.evidence AS e_evidence, l.result AS e_result, l.reason AS e_reason, l.finished,
            CASE WHEN l.kind = 'claim' THEN CASE WHEN v.status = 'claimed' AND v.dispatch = l.dispatch THEN 'repeated' WHEN v.status <> 'pending' THEN 'not pending' ELSE 'done' END
                WHEN v.dispatch IS NULL OR v.dispatch <> l.dispatch THEN 'stale dispatch'
                WHEN l.kind = 'submit' THEN CASE WHEN l.evidence IS NULL THEN 'no evidence' WHEN v.status = 'submitted' AND v.evidence = l.evidence THEN 'repeated' WHEN v.status <> 'claimed' THEN 'not claimed' ELSE 'done' END
                WHEN l.kind = 'record' THEN CASE WHEN l.problem IS NOT NULL THEN 'bad result: ' || l.problem WHEN v.status IN ('complete', 'incomplete') AND v.result = l.result THEN 'repeated'
                    WHEN NOT v.submitted OR v.status NOT IN ('submitted', 'incomplete', 'blocked') THEN 'not submitted' WHEN l.evidence IS DISTINCT FROM v.evidence THEN 'other evidence' ELSE 'done' END
                WHEN l.kind = 'block' THEN CASE WHEN l.reason = 'weather' THEN 'unknown reason' WHEN v.status IN ('claimed', 'submitted', 'incomplete', 'blocked') THEN 'done' ELSE 'not active' END
                WHEN l.kind = 'requeue' THEN CASE WHEN NOT l.confirmed THEN 'not confirmed' WHEN v.submitted OR v.status NOT IN ('claimed', 'blocked') THEN 'not requeueable' ELSE 'done' END
                ELSE 'unknown event' END AS verdict
            FROM v JOIN l ON l.slot = v.slot AND l.n = v.n + 1))"""


@query(f"{REPLAY_SQL} SELECT slot, seq, kind, verdict, status, attempts, dispatch, submitted, reason FROM v WHERE n > 0")
def r03_job_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.replay(job_log(spark, sf_dir)).select("slot", "seq", "kind", "verdict", "status", "attempts", "dispatch", "submitted", "reason")


@query(f"""{REPLAY_SQL}, j AS (SELECT slot, arg_max(status, n) AS status FROM v WHERE n > 0 GROUP BY slot)
    SELECT place, s.status, count(slot) AS jobs, CASE WHEN s.status IN ('pending', 'complete') THEN 0 ELSE count(slot) END AS to_reconcile
    FROM (SELECT unnest(range(6))::INTEGER AS place, unnest(['pending', 'claimed', 'submitted', 'incomplete', 'complete', 'blocked']) AS status) s LEFT JOIN j USING (status) GROUP BY place, s.status""")
def c20_job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.status(jobs.latest(jobs.replay(job_log(spark, sf_dir))))
