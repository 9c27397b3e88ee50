"""The job state machine: transitions, replays, a stream that is stopped and started again."""

import pytest
from pyspark.sql import functions as F

from siteglass.plans.jobs import job_log
from siteglass.streaming import jobs
from siteglass.streaming.jobs import Event, Job, step

SF = "/root/testdata/sf0.001"


def event(seq, kind, dispatch="a", evidence="s", reason="quota", confirmed=True, result="r", finished=True, problem=None):
    return Event(seq, kind, dispatch, evidence, reason, confirmed, result, finished, problem)


def run(*steps, job=None):
    job, said = job or Job(), []
    for k, s in enumerate(steps):
        job, verdict = step(job, s._replace(seq=k + 1 + (job.last_seq or 0) - k) if s.seq is None else s)
        said.append(verdict)
    return job, said


def test_a_job_runs_through_its_states():
    job, said = run(event(1, "claim"), event(2, "submit"), event(3, "record", finished=False), event(4, "record", result="r2"))
    assert said == ["done"] * 4 and (job.status, job.attempts, job.result) == ("complete", 1, "r2")


@pytest.mark.parametrize(
    ("steps", "verdict", "status"),
    [
        ([event(1, "submit")], "stale dispatch", "pending"),
        ([event(1, "claim"), event(2, "claim")], "repeated", "claimed"),
        ([event(1, "claim"), event(2, "claim", dispatch="b")], "not pending", "claimed"),
        ([event(1, "claim"), event(2, "submit", dispatch="b")], "stale dispatch", "claimed"),
        ([event(1, "claim"), event(2, "submit", evidence=" ")], "no evidence", "claimed"),
        ([event(1, "claim"), event(2, "submit", evidence="x" * 2049)], "no evidence", "claimed"),
        ([event(1, "claim"), event(2, "submit"), event(3, "submit")], "repeated", "submitted"),
        ([event(1, "claim"), event(2, "submit"), event(3, "submit", evidence="t")], "not claimed", "submitted"),
        ([event(1, "claim"), event(2, "record")], "not submitted", "claimed"),
        ([event(1, "claim"), event(2, "submit"), event(3, "record", evidence="t")], "other evidence", "submitted"),
        ([event(1, "claim"), event(2, "submit"), event(3, "record", problem="cited_urls")], "bad result: cited_urls", "submitted"),
        ([event(1, "claim"), event(2, "submit"), event(3, "record"), event(4, "record")], "repeated", "complete"),
        ([event(1, "claim"), event(2, "submit"), event(3, "record"), event(4, "record", result="r2")], "not submitted", "complete"),
        ([event(1, "claim"), event(2, "submit"), event(3, "record"), event(4, "block")], "not active", "complete"),
        ([event(1, "claim"), event(2, "block", reason="rain")], "unknown reason", "claimed"),
        ([event(1, "claim"), event(2, "submit"), event(3, "block"), event(4, "record")], "done", "complete"),
        ([event(1, "claim"), event(2, "block"), event(3, "record")], "not submitted", "blocked"),
        ([event(1, "claim"), event(2, "requeue", confirmed=None)], "not confirmed", "claimed"),
        ([event(1, "claim"), event(2, "submit"), event(3, "requeue")], "not requeueable", "submitted"),
        ([event(1, "claim"), event(2, "submit"), event(3, "block"), event(4, "requeue")], "not requeueable", "blocked"),
        ([event(1, "claim"), event(2, "block"), event(3, "requeue")], "done", "pending"),
        ([event(1, "claim"), event(9, "submit"), event(3, "block")], "repeated", "submitted"),
        ([event(1, "claim"), event(2, "dance")], "unknown event", "claimed"),
    ],
)
def test_transitions(steps, verdict, status):
    job, said = run(*steps)
    assert (said[-1], job.status) == (verdict, status)


def test_claims_do_not_expire_and_attempts_add_up():
    job, _ = run(event(1, "claim"), event(10**9, "requeue"), event(10**9 + 1, "claim", dispatch="b"))
    assert (job.status, job.attempts, job.dispatch, job.evidence) == ("claimed", 2, "b", None)


def test_problems_of_results(spark):
    rows = [(None, "complete", True, []), (True, "complete", None, []), (False, "partial", True, []), (True, "all", True, []), (True, None, True, []), (False, "complete", None, []), (True, "complete", True, None), (True, "complete", True, ["u"] * 101), (True, "complete", False, ["u"] * 100), (False, "unknown", None, [])]
    df = spark.createDataFrame(rows, "a boolean, c string, m boolean, u array<string>").coalesce(1)
    got = [r[0] for r in df.select(jobs.result_problem(*map(F.col, "acmu"))).collect()]
    assert got == ["answer_complete", "brand_mentioned", "brand_mentioned", "citation_coverage", "citation_coverage", "citation_coverage", "cited_urls", "cited_urls", None, None]


def test_a_replay_takes_nulls_repeats_and_no_rows(spark):
    log = job_log(spark, SF)
    once = sorted(map(tuple, jobs.latest(jobs.replay(log)).collect()), key=repr)
    again = log.unionByName(log).unionByName(log.withColumn("slot", F.lit(None).cast("long")))
    assert sorted(map(tuple, jobs.latest(jobs.replay(again)).collect()), key=repr) == once
    assert jobs.replay(log.where("false")).count() == 0
    assert {r["verdict"] for r in jobs.replay(log).collect()} > {"done", "stale dispatch", "not pending"}
    assert jobs.replay(log.withColumns({c: F.lit(None).cast(t) for c, t in log.dtypes if c not in ("slot", "seq")})).where("verdict <> 'stale dispatch'").count() == 0


def test_a_stream_started_again_equals_a_replay(spark, tmp_path):
    log = job_log(spark, SF)
    parts = [log.where(f"seq >= {a} and seq < {a + 250}") for a in range(0, 1000, 250)]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    here, out, at = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def go():
        rows = spark.readStream.schema(log.schema).parquet(here)
        q = jobs.stream(rows).writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start()
        q.awaitTermination(300)
        assert q.exception() is None

    parts[0].unionByName(parts[1]).coalesce(1).write.mode("append").parquet(here)
    go()
    # started again from its checkpoint, with a batch that it has seen already
    parts[1].unionByName(parts[2]).unionByName(parts[3]).coalesce(1).write.mode("append").parquet(here)
    go()
    keep = ["slot", "last_seq", "status", "attempts", "dispatch", "evidence", "submitted", "reason"]
    got = jobs.latest(spark.read.parquet(out).where("verdict <> 'repeated' or last_seq = seq"))
    want = jobs.latest(jobs.replay(log))
    assert sorted(map(repr, got.select(keep).collect())) == sorted(map(repr, want.select(keep).collect()))
    assert spark.read.parquet(out).where("seq < 500").count() == parts[0].count() + 2 * parts[1].count()
