"""Operator 7: removal of long repeated byte strings by interval expansion on a Burrows-Wheeler transform.

A string of `length` bytes is repeated if it also starts anywhere else in the corpus. Every such string
holds an anchor: the 32-byte gram with the smallest hash in it (the leftmost of equals). Equal strings have
the same anchor at the same place, so only starts whose anchor occurs twice or more can repeat. Each run of
starts with one anchor is a window, the bytes these starts cover; every start lies in exactly one window.

Windows travel as rows of numbers, without their bytes: (anchor, digest, number). Equal windows are one kind, whose
weight is how many there are. The weight of an interval of the transform is the sum of its suffixes' weights, and a
string repeats if the interval of depth `length` that holds it has a weight of 2 or more; so a kind of weight 2
decides all its starts at once, and only kinds of weight 1 whose anchor has other kinds need expansion. For these,
one window of each kind of the anchor is fetched; tasks join them into a text, sort its suffixes, take
the Burrows-Wheeler transform and expand intervals breadth first by backward extension: the intervals of depth d + 1
are those of depth d extended to the left by one byte. This finds common prefixes by increasing value and stops at
`length`; intervals then hold the equal strings. No group has more than FREQUENT windows: an anchor with more kinds (the edges of a
passage in very many documents) has each of its starts counted by digest instead, packed, and summed by bucket.

Bytes covered by repeated strings are removed, judged on the input. A null or empty text has 0 bytes and
the digest of nothing; texts shorter than `length` keep everything. Every row is a document of
its own, also where ids are null or repeat; rows with one id and one text have the same spans. Other columns of the input pass
through. Anchors and digests have 64 bits each. Joins are Spark's own choice; none is a forced broadcast, so plans are alike at every size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import aside, drop, table, text_batches, trimmed, written
from .wordhash import U, mix, powers, prefix, text_slices

GRAM = 32
#: Kinds of windows of one anchor that are compared in one task; starts of anchors with more are counted by digest.
FREQUENT = 1000
#: Bytes of windows whose suffixes are sorted at once; a group of one anchor is taken whole.
BLOCK_BYTES = 500_000
#: Digests that a task packs at once.
PACKED = 400_000


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place of the anchor, first start, past the last start) of each window of one text."""
    starts = len(data) - length + 1
    if starts <= 0:
        none = np.zeros(0, np.int64)
        return np.zeros(0, U), none, none, none
    h = prefix(data)
    g = mix((h[GRAM:] - h[:-GRAM]) * powers(len(data))[1][: len(data) - GRAM + 1])
    w = length - GRAM + 1
    p = np.full(-(-len(g) // w) * w, U(2**64 - 1))
    p[: len(g)] = g
    p = p.reshape(-1, w)
    after = np.minimum.accumulate(p[:, ::-1], axis=1)[:, ::-1].ravel()
    before = np.minimum.accumulate(p, axis=1).ravel()
    least = np.minimum(after[:starts], before[w - 1 : w - 1 + starts])
    # a window ends where the smallest hash changes, or past the leftmost place that has it
    at = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]])).tolist()
    places, firsts, ends = [], [], []
    for a, b in zip(at, [*at[1:], starts], strict=True):
        while a < b:
            place = a + int((g[a : a + w] == least[a]).argmax())
            places.append(place)
            firsts.append(a)
            a = min(b, place + 1)
            ends.append(a)
    firsts = np.array(firsts)
    return least[firsts], np.array(places), firsts, np.array(ends)


def repeated_starts(text: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """The starts in text whose next length bytes also start elsewhere, as a mask; strings do not go over ends.

    text holds bytes with one separator after each window, at the positions ends.
    """
    n = len(text)
    order, _ = _suffixes(text, ends)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    follow = place[np.minimum(order + 1, n - 1)]  # row of the suffix without its first symbol
    first = text.astype(np.int32)
    first[ends] = 256 + np.arange(len(ends))
    symbol = first[order]
    # depth 1: a boundary where the first symbol changes
    boundary = np.ones(n, bool)
    boundary[1:] = symbol[1:] != symbol[:-1]
    fresh = np.flatnonzero(boundary)
    # rows i - 1 and i with one first symbol part at depth d + 1 if a boundary of depth d lies above follow[i - 1], up to
    # follow[i]; that is follow[i] alone where these are neighbours, as in all but the first row of a run of the transform
    near = np.zeros(n, bool)
    near[1:] = ~boundary[1:] & (follow[1:] == follow[:-1] + 1)
    wide = np.flatnonzero(~boundary & ~near)
    for _ in range(1, length):
        if not len(fresh):
            break
        back = place[order[fresh[order[fresh] > 0]] - 1]  # backward extension of the intervals that begin here
        back = back[near[back] & ~boundary[back]]
        hit = np.searchsorted(fresh, follow[wide], "right") > np.searchsorted(fresh, follow[wide - 1], "right")
        fresh = np.sort(np.concatenate([back, wide[hit]]))
        boundary[fresh] = True
        wide = wide[~hit]
    active = np.flatnonzero(~boundary)
    same = np.zeros(n, bool)
    same[active] = True
    same[active - 1] = True
    out = np.zeros(n, bool)
    out[order[same]] = True
    return out


def _suffixes(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order and ranks by prefix doubling; separators rank by place, above all bytes."""
    n = len(text)
    key = text.astype(np.int64)
    key[ends] = 256 + np.arange(len(ends))
    base = int(key.max()) + 2
    wide = key + 1
    step = 1
    while base < 2**31 and step < 4 and base**2 < 2**62:  # pack symbols while they fit
        nxt = np.zeros(n, np.int64)
        nxt[:-step] = wide[step:]
        wide = wide * base + nxt
        base, step = base * base, step * 2
    order = np.argsort(wide, kind="stable")
    s = wide[order]
    rank = np.empty(n, np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])
    while rank[order[-1]] < n - 1:
        nxt = np.zeros(n, np.int64)
        nxt[:-step] = rank[step:] + 1
        # only what is not yet alone is sorted again, within its old rank
        count = np.bincount(rank)
        open_rows = np.flatnonzero(count[rank[order]] > 1)
        rows = order[open_rows]
        both = rank[rows] * (n + 2) + nxt[rows]
        o = np.argsort(both, kind="stable")
        order[open_rows] = rows[o]
        # the new rank of a row is the place where its run of equals begins
        merged = rank[order] * (n + 2) + nxt[order]
        start = np.concatenate([[True], merged[1:] != merged[:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(start) - 1
        step *= 2
    return order, rank



def _row_key(docs: DataFrame) -> DataFrame:
    """With (_id, _copy), which tell rows apart unless id and text are equal; equal rows have equal spans."""
    return docs.withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), "_copy": F.xxhash64("text")})


def _windows(docs: DataFrame, length: int) -> DataFrame:
    """(hash, digest, _id, _copy, first, starts) of every window."""
    names = ["hash", "digest", "_id", "_copy", "first", "starts"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hs, digests, firsts, starts, rows = [], [], [], [], []
            for x, y, data, off in text_slices(b.column(2)):
                for r in range(x, y):
                    d = data[off[r - x] : off[r - x + 1]]
                    h, _, first, end = anchors(d, length)
                    if len(h):
                        sums = prefix(d)
                        whole = (sums[end + length - 1] - sums[first]) * powers(len(d) + 1)[1][first]
                        hs.append(h.view(np.int64))
                        digests.append(mix(whole + (end - first).astype(U) * U(0xD1342543DE82EF95)).view(np.int64))
                        firsts.append(first)
                        starts.append(end - first)
                        rows.append(np.full(len(h), r))
            if hs:
                row = pa.array(np.concatenate(rows))
                cols = [np.concatenate(hs), np.concatenate(digests)]
                more = [np.concatenate(firsts).astype(np.int32), np.concatenate(starts).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), b.column(0).take(row), b.column(1).take(row), *map(pa.array, more)], names)

    return docs.select("_id", "_copy", "text").mapInArrow(trimmed(work), "hash long, digest long, _id long, _copy long, first int, starts int")


def _per_text(docs: DataFrame, windows: DataFrame, fields: list[str]) -> DataFrame:
    """One row (_id, _copy, text, windows) of each text that has windows, a list of structs of the fields."""
    lists = windows.groupBy("_id", "_copy").agg(F.collect_list(F.struct(*fields)).alias("windows"))
    return docs.select("_id", "_copy", "text").join(lists, ["_id", "_copy"])


def _judge(rows: list[tuple[int, int, int, bytes]], length: int) -> pa.RecordBatch:
    """(w, from, to) of runs of repeated starts in windows of weight 1; rows are (key, window, weight, bytes)."""
    text = np.frombuffer(b"".join(r[3] + b"\0" for r in rows), np.uint8)
    ends = np.cumsum([len(r[3]) + 1 for r in rows]) - 1
    mask = repeated_starts(text, ends, length)
    out = []
    for (_, w, weight, part), end in zip(rows, ends, strict=True):
        if weight > 1:
            continue  # every interval that holds one of its suffixes has a weight of 2 or more
        own = mask[end - len(part) : end - length + 1]
        edge = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]]))).tolist()
        out += [(w, a, b) for a, b in zip(edge[::2], edge[1::2], strict=True)]
    cols = list(zip(*out, strict=True)) if out else [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32()), strict=True)], ["w", "from", "to"])


def _expanded(docs: DataFrame, chosen: DataFrame, length: int) -> DataFrame:
    """(w, from, to) of repeated starts in the chosen windows (hash, w, n, _id, _copy, first, starts) of weight n = 1."""

    def bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r, (text, lists) in enumerate(zip(b.column(0), b.column(1), strict=True)):
                raw, seen, rows = text.as_buffer(), set(), []
                for w in lists.as_py():
                    if w["w"] not in seen:
                        seen.add(w["w"])
                        rows.append((w["hash"], w["w"], min(w["n"], 2), raw[w["first"] : w["first"] + w["starts"] + length - 1].to_pybytes()))
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["hash", "w", "n", "bytes"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size, done = 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:2] == done:
                    continue  # a text that two rows have
                if rows and size > BLOCK_BYTES and row[0] != rows[-1][0]:
                    yield _judge(rows, length)
                    rows, size = [], 0
                rows.append(row)
                done = row[:2]
                size += len(row[3])
        if rows:
            yield _judge(rows, length)

    texts = _per_text(docs, chosen, ["hash", "w", "n", "first", "starts"])
    parts = texts.select("text", "windows").mapInArrow(trimmed(bytes_of), "hash long, w long, n int, bytes binary")
    return parts.repartition("hash").sortWithinPartitions("hash", "w").mapInArrow(trimmed(work), "w long, `from` int, `to` int")


def _start_digests(text: np.ndarray, hash: int, first: int, starts: int, sums: np.ndarray, length: int) -> np.ndarray:
    at = np.arange(first, first + starts)
    return mix((sums[at + length] - sums[at]) * powers(len(text) + 1)[1][at] + U(hash % 2**64))


def _counted(docs: DataFrame, hot: DataFrame, length: int) -> DataFrame:
    """(w, from, to) of repeated starts in hot windows (hash, w, n, _id, _copy, first, starts), by the digests of all of them."""
    texts = written(_per_text(docs, hot, ["hash", "w", "n", "first", "starts"]), "hot")
    size = texts.select(F.coalesce(F.sum(F.aggregate("windows", F.lit(0).cast("long"), lambda x, w: x + w.starts)), F.lit(0))).first()[0]
    buckets = max(16, size // 1_000_000)

    def digests(b: pa.RecordBatch) -> Iterator[tuple[dict, np.ndarray]]:
        for text, lists in zip(b.column(0), b.column(1), strict=True):
            data = np.frombuffer(text.as_buffer(), np.uint8)
            sums, seen = prefix(data), set()
            for w in lists.as_py():
                if w["w"] not in seen:
                    seen.add(w["w"])
                    yield w, _start_digests(data, w["hash"], w["first"], w["starts"], sums, length)

    def packed(found: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(found), return_counts=True)
        h = np.concatenate([h, h[n > 1]])  # twice is enough
        bucket = (h % U(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        h, bucket = h[order], bucket[order]
        edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
        return pa.RecordBatch.from_arrays([pa.array(bucket[edge[:-1]]), pa.array([h[x:y].tobytes() for x, y in zip(edge, edge[1:], strict=False)], pa.binary())], ["bucket", "digests"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for b in batches:
            for w, h in digests(b):
                found += [h, h] if w["n"] > 1 else [h]
                held += len(h)
                if held > max(PACKED, 64 * buckets):
                    yield packed(found)
                    found, held = [], 0
        if found:
            yield packed(found)

    def twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        now = None

        def repeated() -> pa.RecordBatch:
            h, n = np.unique(np.frombuffer(b"".join(held), np.int64), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h[n > 1])], ["digest"])

        for b in batches:
            for bucket, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if bucket != now and held:
                    yield repeated()
                    held = []
                now = bucket
                held.append(part)
        if held:
            yield repeated()

    found = texts.select("text", "windows").mapInArrow(trimmed(count), "bucket int, digests binary").repartition("bucket").sortWithinPartitions("bucket")
    found = written(found.mapInArrow(trimmed(twice), "digest long"), "repeated")

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(w["w"], h) for w, h in digests(b) if w["n"] == 1]
            if rows:
                number = np.concatenate([np.arange(len(h)) for _, h in rows]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([w for w, _ in rows], [len(h) for _, h in rows]).astype(np.int64)), pa.array(number), pa.array(np.concatenate([h for _, h in rows]).view(np.int64))], ["w", "from", "digest"])

    if found.count() > 2_000_000:  # too many for each task to hold
        each = texts.select("text", "windows").mapInArrow(trimmed(starts), "w long, `from` int, digest long")
        return each.join(found, "digest", "left_semi").select("w", "from", (F.col("from") + 1).alias("to"))
    known = docs.sparkSession.sparkContext.broadcast(np.sort(found.toArrow()["digest"].to_numpy().view(U)))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = known.value
        for b in batches:
            out = []
            for w, own in digests(b):
                if w["n"] == 1 and len(h):
                    hit = h[np.minimum(np.searchsorted(h, own), len(h) - 1)] == own
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))).tolist()
                    out += [(w["w"], x, y) for x, y in zip(edge[::2], edge[1::2], strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32()), strict=True)], ["w", "from", "to"])

    return texts.select("text", "windows").mapInArrow(trimmed(runs), "w long, `from` int, `to` int")


def repeated_spans(docs: DataFrame, length: int, frequent: int = FREQUENT) -> DataFrame:
    """(_id, _copy, spans) of texts with repeated strings; spans are (from, to) in bytes and may overlap."""
    every = written(_windows(docs, length), "anchors")
    often = every.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    windows = every.join(often, "hash", "left_semi").withColumn("w", F.monotonically_increasing_id())
    windows = written(windows, "windows")
    drop(every)
    kinds = written(windows.groupBy("hash", "digest").agg(F.count("*").alias("n"), F.min("w").alias("w")), "kinds")
    # anchors with several kinds, of which one is a window alone
    open_ = kinds.groupBy("hash").agg(F.count("*").alias("kinds"), F.count_if(F.col("n") == 1).alias("alone")).where("kinds > 1 and alone > 0").select("hash", "kinds")
    open_ = written(open_, "open")
    place = windows.select("w", "_id", "_copy", "first", "starts")
    chosen = written(kinds.join(open_, "hash").select("hash", "n", "w", "kinds").join(place, "w"), "chosen")
    verdict = written(_expanded(docs, chosen.where(F.col("kinds") <= frequent), length), "verdict")
    if chosen.where(F.col("kinds") > frequent).limit(1).count():
        verdict = verdict.unionByName(written(_counted(docs, chosen.where(F.col("kinds") > frequent), length), "counted"))
    span = lambda a, b: F.struct(a.cast("int").alias("from"), (b + (length - 1)).cast("int").alias("to")).alias("span")
    some = chosen.join(verdict, "w").select("_id", "_copy", span(F.col("first") + F.col("from"), F.col("first") + F.col("to")))
    several = kinds.where("n > 1").select("hash", "digest")
    whole = windows.join(several, ["hash", "digest"], "left_semi").select("_id", "_copy", span(F.col("first"), F.col("first") + F.col("starts")))
    spans = written(whole.unionByName(some).groupBy("_id", "_copy").agg(F.collect_set("span").alias("spans")), "spans")
    drop(windows, kinds, open_, chosen, verdict)
    return spans


def remove_repeats(docs: DataFrame, length: int, frequent: int = FREQUENT) -> DataFrame:
    """docs (doc_id, text, ...) with n_bytes, n_removed, n_spans and kept, the bytes that stay; such columns of docs are replaced."""
    spark = docs.sparkSession
    text_batches(spark)
    new = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept", T.BinaryType())]
    docs, back = aside(docs.drop(*[f.name for f in new]), ("doc_id", "text"))
    fields = docs.schema.fields
    keyed = _row_key(docs)
    spans = repeated_spans(keyed, length, frequent)
    joined = keyed.join(spans, ["_id", "_copy"], "left").select(*[f.name for f in fields], F.col("spans").alias("_spans"))
    at = [f.name for f in fields].index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(fields))
            total, gone, runs, kept = [], [], [], []
            for x, y, data, off in text_slices(batch.column(at)):
                for r in range(x, y):
                    d = data[off[r - x] : off[r - x + 1]]
                    change = np.zeros(len(d) + 1, np.int32)
                    if lists[r].is_valid:
                        own = lists[r].values
                        np.add.at(change, own.field(0).to_numpy(zero_copy_only=False), 1)
                        np.add.at(change, own.field(1).to_numpy(zero_copy_only=False), -1)
                    drop = np.cumsum(change)[:-1] > 0
                    total.append(len(d))
                    gone.append(int(drop.sum()))
                    runs.append(int((np.diff(np.concatenate([[0], drop.astype(np.int8)])) == 1).sum()))
                    kept.append(d[~drop].tobytes())
            cols = [pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(fields)], *cols], [*[f.name for f in fields], *[f.name for f in new]])

    return back(joined.mapInArrow(trimmed(work), T.StructType([*fields, *new])))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), 400)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op7_suffix_dedup": op7_suffix_dedup}
ORACLES: dict[str, str] = {}
