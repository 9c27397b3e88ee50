"""Jobs of measurements as a state machine over a log of events: claimed, submitted, recorded, blocked and queued again.

An event has slot, seq, kind, dispatch, evidence, reason, confirmed and the columns of a result. A claim names its dispatch; every other event
must name the dispatch that holds the slot. Claims never expire: a slot that was claimed and then left stays claimed until
somebody confirms that nothing was submitted. `step` is one transition, and both ways of running use it: `replay` folds a whole log, one state
at a time, whatever the length of a slot's history, and `Jobs` keeps one state for each slot in a stream. Events at or before the
last seq of a slot are repeats and change nothing, so a batch that comes twice does no harm.

Events with a null slot or seq belong to no job and are dropped; nulls elsewhere are no dispatch, no evidence, or not confirmed.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# fixed values: states, reasons for a block, how far citations were seen, and the longest text of evidence
STATES = ("pending", "claimed", "submitted", "incomplete", "complete", "blocked")
REASONS = ("auth", "quota", "browser_unavailable", "ui_changed", "other")
COVERAGES = ("complete", "partial", "unknown")
MOST_TEXT, MOST_CITED = 2048, 100
#: States that wait for somebody.
OPEN = ("claimed", "submitted", "incomplete", "blocked")
ACTIVE = frozenset(OPEN)


class Job(NamedTuple):
    status: str = "pending"
    attempts: int = 0
    dispatch: str | None = None
    evidence: str | None = None
    submitted: bool = False
    result: str | None = None
    reason: str | None = None
    last_seq: int | None = None


class Event(NamedTuple):
    seq: int
    kind: str | None
    dispatch: str | None
    evidence: str | None
    reason: str | None
    confirmed: bool | None
    result: str | None
    finished: bool | None
    problem: str | None


JOB = "status string, attempts int, dispatch string, evidence string, submitted boolean, result string, reason string, last_seq long"
TAKEN = list(Event._fields)


def result_problem(answer_complete: Column, coverage: Column, mentioned: Column, cited: Column) -> Column:
    """What is wrong with a result, or null: an answer is complete or not, a brand is judged only in complete ones, and
    their citations alone can be complete."""
    return (
        F.when(answer_complete.isNull(), "answer_complete")
        .when(answer_complete != mentioned.isNotNull(), "brand_mentioned")
        .when(coverage.isNull() | ~coverage.isin(*COVERAGES), "citation_coverage")
        .when(~answer_complete & (coverage == "complete"), "citation_coverage")
        .when(cited.isNull() | (F.size(cited) > MOST_CITED), "cited_urls")
    )


def events(log: DataFrame) -> DataFrame:
    """(slot, and what a transition reads) of a log with slot, seq, kind, dispatch, evidence, reason, confirmed, answer_complete, coverage, mentioned, cited."""
    c = F.col
    problem = result_problem(c("answer_complete"), c("coverage"), c("mentioned"), c("cited"))
    result = F.sha2(F.to_json(F.struct("answer_complete", "coverage", "mentioned", "cited")), 256)
    finished = c("answer_complete") & (c("coverage") == "complete")
    return log.where("slot is not null and seq is not null").select(
        "slot", c("seq").cast("long").alias("seq"), "kind", "dispatch", "evidence", "reason", "confirmed",
        F.when(c("kind") == "record", result).alias("result"), F.coalesce(finished, F.lit(False)).alias("finished"), F.when(c("kind") == "record", problem).alias("problem"),
    )


def _text(x: str | None) -> bool:
    return bool(x and x.strip()) and len(x) <= MOST_TEXT


def step(job: Job, e: Event) -> tuple[Job, str]:
    """The job after an event, and done, repeated, or why it was refused. A job that refuses keeps its state."""
    if job.last_seq is not None and e.seq <= job.last_seq:
        return job, "repeated"
    seen = job._replace(last_seq=e.seq)
    holds = e.dispatch is not None and e.dispatch == job.dispatch
    if e.kind == "claim":
        if holds and job.status == "claimed":
            return seen, "repeated"
        if job.status != "pending" or e.dispatch is None:
            return seen, "not pending"
        return Job("claimed", job.attempts + 1, e.dispatch, last_seq=e.seq), "done"
    if not holds:
        return seen, "stale dispatch"
    if e.kind == "submit":
        if not _text(e.evidence):
            return seen, "no evidence"
        if job.status == "submitted" and job.evidence == e.evidence:
            return seen, "repeated"
        if job.status != "claimed":
            return seen, "not claimed"
        return seen._replace(status="submitted", evidence=e.evidence, submitted=True), "done"
    if e.kind == "record":
        if e.problem:
            return seen, f"bad result: {e.problem}"
        if job.status in ("complete", "incomplete") and job.result == e.result:
            return seen, "repeated"
        if not job.submitted or job.status not in ("submitted", "incomplete", "blocked"):
            return seen, "not submitted"
        if e.evidence != job.evidence:
            return seen, "other evidence"
        return seen._replace(status="complete" if e.finished else "incomplete", result=e.result, reason=None), "done"
    if e.kind == "block":
        if e.reason not in REASONS:
            return seen, "unknown reason"
        return (seen._replace(status="blocked", reason=e.reason), "done") if job.status in ACTIVE else (seen, "not active")
    if e.kind == "requeue":
        if not e.confirmed:
            return seen, "not confirmed"
        if job.submitted or job.status not in ("claimed", "blocked"):
            return seen, "not requeueable"
        return Job("pending", job.attempts, last_seq=e.seq), "done"
    return seen, "unknown event"


def _python(value: object) -> object:
    return None if value is None or value is pd.NA or value is pd.NaT or (isinstance(value, float) and value != value) else value


def replay(log: DataFrame) -> DataFrame:
    """(slot, seq, kind, verdict and the job after each event) of a whole log, in order of seq.

    Events are dealt by slot and sorted; a task holds the job of one slot and a batch of events, so a slot with a third of all events
    costs time but no memory. Of events with one seq the first by kind and dispatch counts.
    """
    rows = events(log)
    kind = dict(rows.dtypes)["slot"]
    dealt = rows.repartition("slot").sortWithinPartitions("slot", "seq", "kind", "dispatch", "evidence", "reason", "result")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, job = None, Job()
        for b in batches:
            slots = b.column("slot").to_pylist()
            out = []
            for slot, *event in zip(slots, *(b.column(c).to_pylist() for c in TAKEN), strict=True):
                if slot != now:
                    now, job = slot, Job()
                job, verdict = step(job, Event(*event))
                out.append((verdict, *job))
            columns = [pa.array(list(c)) for c in zip(*out, strict=True)] if out else []
            if out:
                types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.int64()]
                columns = [c.cast(t) for c, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("slot"), b.column("seq"), b.column("kind"), *columns], ["slot", "seq", "kind", "verdict", *Job._fields])

    return dealt.mapInArrow(work, f"slot {kind}, seq long, kind string, verdict string, {JOB}")


def latest(replayed: DataFrame) -> DataFrame:
    """The job of each slot after its last event."""
    rest = [c for c in Job._fields if c != "last_seq"]
    return replayed.groupBy("slot").agg(F.max(F.struct("seq", *rest)).alias("m")).select("slot", F.col("m.seq").alias("last_seq"), *[f"m.{c}" for c in rest])


def status(jobs: DataFrame) -> DataFrame:
    """(status, jobs, to_reconcile): how many jobs are in each state, all states named, and whether those wait for somebody."""
    names = jobs.sparkSession.createDataFrame([(i, s, s in OPEN) for i, s in enumerate(STATES)], "place int, status string, open boolean")
    counted = jobs.groupBy("status").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return names.join(counted, "status", "left").select("place", "status", n.alias("jobs"), F.when(F.col("open"), n).otherwise(0).alias("to_reconcile"))


class Jobs(StatefulProcessor):
    """One state for each slot; gives a row for each event, as replay does."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.job = handle.getValueState("job", JOB)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.job.get()
        job = Job(*(_python(x) for x in held)) if held is not None else Job()
        # a batch of a stream is bounded by its trigger; its events of one slot are sorted here
        batch = pd.concat([r.astype(object) for r in rows]).sort_values(["seq", "kind", "dispatch"], kind="stable")
        out = []
        for event in batch[TAKEN].itertuples(index=False):
            event = Event(*(_python(x) for x in event))
            job, verdict = step(job, event)
            out.append((key[0], event.seq, event.kind, verdict, *job))
        self.job.update(tuple(job))
        yield pd.DataFrame(out, columns=["slot", "seq", "kind", "verdict", *Job._fields])

    def close(self) -> None:
        pass


def stream(log: DataFrame) -> DataFrame:
    """replay's rows of a stream of events, in append mode; needs the RocksDB state store."""
    rows = events(log)
    kind = dict(rows.dtypes)["slot"]
    return rows.groupBy("slot").transformWithStateInPandas(statefulProcessor=Jobs(), outputStructType=f"slot {kind}, seq long, kind string, verdict string, {JOB}", outputMode="append", timeMode="none")
