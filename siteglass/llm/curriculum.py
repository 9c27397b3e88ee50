"""Operator 4: mixing sources to target weights by a time-varying curriculum. DataFrame functions only.

Sizes are words. Sources, by code point with null last, weigh 5, 2, 1 in turn, and share a budget of words
(150 % of all) by weight; a source's target stops at twice its size, and what is left over is shared again
by weight until no target is above. A source's need, its target rounded to words, is met by whole passes
over its documents and a last pass that ends where the need is met, within a document if it falls there.
So taken words sum to the need, and no document is taken more than twice.

Each source has a schedule of weights over the training time from 0 to 1, linear between knots. Its
integral is the share of the source's words that is due by a time; a document that begins at a share of
its source's words gets the time at which that share is due, by inverting the integral. The integrals of all sources, each
times its need, sum to the mix's cumulative demand, the words of all sources that are due by a time; this demand at the
document's time, as a share of the whole mix, is its training position. A document has a position for each pass in
which it begins before its source's need is met, and takes at each what is left of the need, at most itself: that
is how many of its words are taken. Documents are range-sorted by their first position.

Documents of a source are ordered by the MD5 digest of their ids, so reruns agree and the order says
nothing about content. Running sums are taken in pieces (source, first hexadecimal digits), so a source
with a third of all rows is no group of its own. Rows with the same id are ordered by size among
themselves. Null and empty texts have size 0, are taken 0 times and have no position, and sort last.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

WEIGHTS = (5, 2, 1)
#: Knots (time, weight) of each weight's schedule: heavy sources early, light ones late.
SCHEDULES = (((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))
#: Documents that one piece of a running sum should hold.
PIECE_ROWS = 50_000
WORD = r"[^\x20\x09-\x0D]+"


def position(share: Column, schedule: tuple[tuple[float, float], ...]) -> Column:
    """The time at which a share (0 to 1) of the schedule's integral is reached."""
    parts, total = [], 0.0
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False):
        parts.append((t0, t1, w0, w1, total))
        total += (t1 - t0) * (w0 + w1) / 2
    out = F.lit(schedule[-1][0])
    for t0, t1, w0, w1, before in reversed(parts):
        slope = (w1 - w0) / (t1 - t0)
        y = share * total - before
        root = F.sqrt(F.greatest(F.lit(0.0), F.lit(w0 * w0) + y * (2 * slope)))
        at = F.when(root + w0 > 0, y * 2 / (root + w0)).otherwise(0.0) + t0
        out = F.when(share * total <= before + (t1 - t0) * (w0 + w1) / 2, F.least(at, F.lit(t1))).otherwise(out)
    return F.greatest(out, F.lit(schedule[0][0]))


def integral(time: Column, schedule: tuple[tuple[float, float], ...]) -> Column:
    """The share (0 to 1) of the schedule's integral up to a time."""
    parts, total = [], 0.0
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False):
        parts.append((t0, t1, w0, w1, total))
        total += (t1 - t0) * (w0 + w1) / 2
    out = F.lit(total)
    for t0, t1, w0, w1, before in reversed(parts):
        past = time - t0
        out = F.when(time <= t1, past * (w0 * 2 + past * ((w1 - w0) / (t1 - t0))) / 2 + before).otherwise(out)
    return out / total


def demand(time: Column, words: dict[int, int], schedules: tuple) -> Column:
    """The share of the whole mix's words that is due by a time; words has those of all sources of each schedule."""
    out = F.lit(0.0)
    for i, schedule in enumerate(schedules):
        out = out + integral(time, schedule) * float(words.get(i, 0))
    return out / float(max(1, sum(words.values())))


def _positioned(schedule: tuple[tuple[float, float], ...], words: dict[int, int], schedules: tuple, need: Column):
    return lambda begin: demand(position(begin / need, schedule), words, schedules)


def ranked_sources(sources: DataFrame) -> DataFrame:
    """sources with place: their number from 0 by (none, source), from sorted ranges and the ranges' counts."""
    ranges = written(sources.repartitionByRange("none", "source").withColumn("range", F.spark_partition_id()), "ranges")
    counts = ranges.groupBy("range").agg(F.count("*").alias("n"))
    # one row for each range, so a window over all of them is bounded by the number of partitions
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    order = Window.partitionBy("range").orderBy("none", "source")
    return ranges.join(F.broadcast(before.select("range", "before")), "range").withColumn("place", F.row_number().over(order) - 1 + F.col("before")).drop("range", "before")


def targets(sources: DataFrame, budget: float, most: float) -> DataFrame:
    """sources (weight, source_size) with target: the budget by weight, at most most * source_size, the rest shared again."""
    full = F.lit(False)
    while True:
        words, weight, held = sources.agg(F.sum(F.when(full, F.col("source_size") * most)), F.sum(F.when(~full, F.col("weight"))), F.count_if(full)).first()
        if not weight:
            return sources.withColumn("target", F.col("source_size") * most)
        share = F.col("weight") * F.lit(float(budget - (words or 0))) / F.lit(float(weight))
        above = full | (share >= F.col("source_size") * most)
        if sources.agg(F.count_if(above)).first()[0] == held:
            return sources.withColumn("target", F.when(full, F.col("source_size") * most).otherwise(share))
        # what was full stays full, as shares only grow
        sources = written(sources.withColumn("full", above), "sources")
        full = F.col("full")


def curriculum(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, schedules: tuple = SCHEDULES, budget: float = 1.5, most: float = 2.0, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, source_size, target, taken, positions, mix_size) and the columns keep of docs, range-sorted by first position; see above."""
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").isNull().alias("none"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *keep)
    sized = written(sized.withColumn("mark", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), "sizes")
    digits = max(1, min(6, math.ceil(math.log(max(1, sized.count() / PIECE_ROWS), 16))))
    sized = sized.withColumn("piece", F.substring("mark", 1, digits))
    pieces = written(sized.groupBy("none", "source", "piece").agg(F.sum("size").alias("words")), "pieces")
    sources = pieces.groupBy("none", "source").agg(F.sum("words").alias("source_size"))
    placed = ranked_sources(written(sources, "sources"))
    kind = F.pmod("place", F.lit(len(weights)))
    placed = written(placed.withColumns({"kind": kind, "weight": F.element_at(F.array(*map(F.lit, weights)), (kind + 1).cast("int"))}), "placed")
    total = placed.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    shared = targets(placed, budget * total, most).select("none", "source", "source_size", "kind", "target")

    running = Window.partitionBy("none", "source").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    begun = pieces.withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0))).drop("words")
    begun = written(begun.join(shared, ["none", "source"]), "begun")
    own = Window.partitionBy("none", "source", "piece").orderBy("mark", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = sized.join(begun, ["none", "source", "piece"]).withColumn("start", F.col("before") + F.coalesce(F.sum("size").over(own), F.lit(0)))

    need, s = F.floor(F.col("target") + 0.5).cast("long"), F.col("source_size")
    due = {r.kind: r.words for r in shared.groupBy("kind").agg(F.sum(need).alias("words")).collect()}  # a row for each schedule
    passes = F.when(s > 0, F.floor(need / s)).otherwise(0).cast("long")
    rows = rows.withColumn("need", need)
    begins = F.transform(F.sequence(F.lit(0).cast("long"), passes), lambda p: p * s + F.col("start"))
    rows = rows.withColumn("begins", F.when(F.col("size") > 0, F.filter(begins, lambda x: x < F.col("need"))).otherwise(F.array().cast("array<long>")))
    taken = F.aggregate("begins", F.lit(0).cast("long"), lambda n, x: n + F.least(F.col("size"), F.col("need") - x))
    timed = F.lit(None).cast("array<double>")
    for i, schedule in enumerate(schedules):
        timed = F.when(F.col("kind") == i, F.transform("begins", _positioned(schedule, due, schedules, F.col("need")))).otherwise(timed)
    first = F.coalesce(F.try_element_at("positions", F.lit(1)), F.lit(float("inf")))
    rows = rows.withColumns({"taken": taken, "positions": timed}).withColumn("first", first)
    rows = rows.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), "taken", "positions", F.lit(sum(due.values())).cast("long").alias("mix_size"), *keep, "first")
    return rows.repartitionByRange("first", "doc_id").sortWithinPartitions("first", "doc_id").drop("first")


def op4_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With position, the word of the mix at which a document first begins, and passes, in how many it begins."""
    mix = curriculum(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken", F.floor(F.try_element_at("positions", F.lit(1)) * F.col("mix_size")).alias("position"), F.size("positions").cast("long").alias("passes"))


def _pieces(schedule: tuple[tuple[float, float], ...]) -> tuple[list[tuple[float, ...]], float]:
    parts, total = [], 0.0
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False):
        parts.append((t0, t1, w0, w1, total, total + (t1 - t0) * (w0 + w1) / 2))
        total = parts[-1][5]
    return parts, total


def _time_sql(share: str, schedule: tuple[tuple[float, float], ...]) -> str:
    """The time at which a share is due: within a piece, the root of the quadratic that its weights integrate to."""
    parts, total = _pieces(schedule)
    cases = []
    for t0, t1, w0, w1, before, after in parts:
        y = f"({share} * {total}::DOUBLE - {before}::DOUBLE)"
        root = f"(sqrt(greatest(0::DOUBLE, {w0 * w0}::DOUBLE + {y} * {2 * (w1 - w0) / (t1 - t0)}::DOUBLE)) + {w0}::DOUBLE)"
        cases.append(f"WHEN {share} * {total}::DOUBLE <= {after}::DOUBLE THEN least({y} * 2::DOUBLE / {root} + {t0}::DOUBLE, {t1}::DOUBLE)")
    return f"(CASE {' '.join(cases)} ELSE {schedule[-1][0]}::DOUBLE END)"


def _due_sql(time: str, schedule: tuple[tuple[float, float], ...]) -> str:
    parts, total = _pieces(schedule)
    cases = [f"WHEN {time} <= {t1}::DOUBLE THEN ({time} - {t0}::DOUBLE) * ({w0 * 2}::DOUBLE + ({time} - {t0}::DOUBLE) * {(w1 - w0) / (t1 - t0)}::DOUBLE) / 2::DOUBLE + {before}::DOUBLE" for t0, t1, w0, w1, before, _ in parts]
    return f"((CASE {' '.join(cases)} ELSE {total}::DOUBLE END) / {total}::DOUBLE)"


#: The same mix as SQL over a relation named in_docs (doc_id, source, text).
MIX_SQL = rf"""
    sized AS (SELECT doc_id, source IS NULL AS none, coalesce(source, '') AS source,
                     CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                     md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS mark FROM in_docs),
    sources AS (SELECT none, source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY ALL),
    kinds AS (SELECT *, (row_number() OVER (ORDER BY none, encode(source)) - 1) % 3 AS kind FROM sources),
    placed AS (SELECT *, CASE kind WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM kinds),
    filled AS (SELECT *, coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY source_size::DOUBLE / weight, none, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
                      sum(weight) OVER (ORDER BY source_size::DOUBLE / weight, none, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open,
                      1.5::DOUBLE * sum(source_size) OVER () AS budget FROM placed),
    marked AS (SELECT *, weight * (budget - below) >= 2.0::DOUBLE * source_size * open AS is_full FROM filled),
    level AS (SELECT any_value(budget) - coalesce(sum(2.0::DOUBLE * source_size) FILTER (is_full), 0) AS words, sum(weight) FILTER (NOT is_full) AS weight FROM marked),
    targets AS (SELECT none, source, source_size, kind, CASE WHEN is_full THEN 2.0::DOUBLE * source_size ELSE m.weight::DOUBLE * l.words / l.weight::DOUBLE END AS target FROM marked m, level l),
    begun AS (SELECT s.doc_id, s.size, t.source_size, t.target, t.kind, CAST(floor(t.target + 0.5) AS BIGINT) AS need,
                     coalesce(sum(s.size) OVER (PARTITION BY s.none, s.source ORDER BY s.mark, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
              FROM sized s JOIN targets t ON s.none = t.none AND s.source = t.source),
    passed AS (SELECT *, CASE WHEN source_size > 0 THEN need // source_size ELSE 0 END AS full_passes FROM begun),
    mixed AS (SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target, kind, need, start,
                     CAST(full_passes * size + greatest(0, least(size, need - full_passes * source_size - start)) AS BIGINT) AS taken,
                     CAST(CASE WHEN size > 0 THEN full_passes + CASE WHEN full_passes * source_size + start < need THEN 1 ELSE 0 END ELSE 0 END AS BIGINT) AS passes FROM passed),
    due AS (SELECT {", ".join(f"coalesce(sum(CAST(floor(target + 0.5) AS BIGINT)) FILTER (kind = {i}), 0)::DOUBLE AS due{i}" for i in range(len(SCHEDULES)))}, coalesce(sum(CAST(floor(target + 0.5) AS BIGINT)), 0) AS mix_size FROM targets),
    timed AS (SELECT *, CASE kind {" ".join(f"WHEN {i} THEN {_time_sql('(start::DOUBLE / need::DOUBLE)', s)}" for i, s in enumerate(SCHEDULES))} END AS time FROM mixed WHERE passes > 0),
    placed_docs AS (SELECT t.*, CAST(floor((0::DOUBLE + {" + ".join(f"{_due_sql('time', s)} * due{i}" for i, s in enumerate(SCHEDULES))}) / greatest(1, mix_size)::DOUBLE * mix_size::DOUBLE) AS BIGINT) AS position FROM timed t, due)
"""

QUERIES = {"op4_curriculum": op4_curriculum}
ORACLES = {
    "op4_curriculum": f"""WITH in_docs AS (SELECT doc_id, source, text FROM documents), {MIX_SQL}
        SELECT doc_id, size, source_size, target, taken, position, passes FROM placed_docs
        UNION ALL SELECT doc_id, size, source_size, target, taken, NULL, passes FROM mixed WHERE passes = 0"""
}
