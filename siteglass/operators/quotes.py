"""Quotes in texts: which texts hold which strings, by an index of rare grams, and evidence that must be quoted from its source.

A quote is found through one of its grams, the one that the fewest texts hold; a text's grams are its runs of so many bytes. Tasks hash all grams of
their texts and keep those that a bitmap of the quotes' grams lets through; the rarest gram of each quote is joined with them, and what meets is
compared as strings. So a quote meets the texts that share its rarest gram and no others, and the bitmap's size is fixed. Quotes of fewer bytes than a gram use shorter ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import kept

#: Bytes of grams, longest first; a quote uses the first that it is long enough for.
WIDTHS = (12, 6, 3, 1)
#: Bits of the bitmap, and of a piece of it.
BITS, PIECE = 1 << 27, 1 << 19
#: Bytes of texts whose grams are hashed at once.
SLICE = 1 << 20
#: Longest quote of an entry.
MOST_QUOTE = 1000


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a * np.uint64(0x9E3779B97F4A7C15)) ^ b
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def _all_grams(data: np.ndarray) -> dict[int, np.ndarray]:
    """Hashes of all runs of each width in bytes, in order; a run's is made of those of its parts."""
    one = _joined(data.astype(np.uint64) + np.uint64(1), np.uint64(0x94D049BB133111EB))
    two = _joined(one[:-1], one[1:])
    three = _joined(two[:-1], one[2:])
    six = _joined(three[:-3], three[3:])
    return {12: _joined(six[:-6], six[6:]), 6: six, 3: three, 1: one}


def _grams(raw: bytes, width: int) -> np.ndarray:
    return _all_grams(np.frombuffer(raw, np.uint8))[width]


def _slices(raws: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets from 0) of runs of rows of at most SLICE bytes, or one row."""
    raws = raws.cast(pa.large_binary())
    if not len(raws) or raws.buffers()[2] is None:
        return
    off = np.frombuffer(raws.buffers()[1], np.int64)[raws.offset : raws.offset + len(raws) + 1]
    data = np.frombuffer(raws.buffers()[2], np.uint8)
    a = 0
    while a < len(raws):
        b = max(a + 1, int(np.searchsorted(off, off[a] + SLICE, "right")) - 1)
        yield a, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def _width(n: int) -> int:
    return next(w for w in WIDTHS if n >= w)


def _quote_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for number, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            width = _width(len(raw))
            gram, place = np.unique(_grams(raw, width), return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), number)), pa.array(np.full(len(gram), width, np.int32)), pa.array(gram.view(np.int64)), pa.array(place)], ["number", "width", "gram", "place"])


def _bitmap(grams: DataFrame) -> np.ndarray:
    """One bit for each gram, modulo BITS; the driver gets BITS / PIECE pieces of fixed size."""
    bit = F.pmod("gram", F.lit(BITS))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            piece, place = (c.to_numpy() for c in b.columns)
            for p in np.unique(piece):
                held.setdefault(int(p), np.zeros(PIECE, bool))[place[piece == p]] = True
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([np.packbits(x).tobytes() for x in held.values()], pa.binary())], ["piece", "bits"])

    rows = grams.select(F.floor(bit / PIECE).alias("piece"), (bit % PIECE).alias("place")).distinct().repartition("piece").mapInArrow(pieces, "piece long, bits binary").collect()
    out = np.zeros(BITS // 8, np.uint8)
    for r in rows:
        out[r["piece"] * PIECE // 8 : (r["piece"] + 1) * PIECE // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def containing(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """(quote_id, source_id, place): every text (source_id, text) that holds a quote (quote_id, quote), and the character at which it first does, from 1.

    Null and empty quotes and null texts are in nothing; equal quotes and repeated ids each count.
    """
    spark = quotes.sparkSession
    wanted = kept(quotes.where("quote <> ''").groupBy("quote").agg(F.min(F.xxhash64("quote")).alias("number")), "quotes")
    grams = kept(wanted.select("number", F.col("quote").cast("binary")).mapInArrow(_quote_grams, "number long, width int, gram long, place long"), "grams")
    widths = [r["width"] for r in grams.select("width").distinct().collect()]  # at most len(WIDTHS) rows
    bits = spark.sparkContext.broadcast(_bitmap(grams))

    def survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = bits.value
        for b in batches:
            for first, data, off in _slices(b.column(1)):
                row = np.repeat(np.arange(len(off) - 1), np.diff(off))
                left = off[1:][row] - np.arange(len(data))  # bytes up to the text's end
                grams = _all_grams(data)
                for width in widths:
                    gram = grams[width]
                    at = (gram.view(np.int64) % BITS).astype(np.int64)
                    hit = np.flatnonzero((left[: len(gram)] >= width) & (bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 == 1))
                    # each gram of a text once; of single bytes there are few, of others hits are few
                    own = row[hit].astype(np.int64) * 256 + data[hit] if width == 1 else _joined(gram[hit], row[hit].astype(np.uint64))
                    hit = hit[np.unique(own, return_index=True)[1]]
                    if len(hit):
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(first + row[hit])), pa.array(np.full(len(hit), width, np.int32)), pa.array(gram[hit].view(np.int64))], ["source_id", "width", "gram"])

    kind = dict(texts.dtypes)["source_id"]
    rows = texts.where("text is not null")
    met = kept(rows.select("source_id", F.col("text").cast("binary")).mapInArrow(survivors, f"source_id {kind}, width int, gram long"), "met")
    frequency = met.groupBy("width", "gram").agg(F.count("*").alias("texts"))
    # a quote that has a gram that no text holds is in no text
    each = grams.join(frequency, ["width", "gram"], "left").fillna(0, ["texts"])
    rarest = each.groupBy("number").agg(F.min(F.struct("texts", "place", "width", "gram")).alias("m")).where("m.texts > 0")
    pairs = rarest.select("number", "m.width", "m.gram").join(met, ["width", "gram"]).select("number", "source_id").distinct()
    found = pairs.join(wanted, "number").join(rows.select("source_id", "text"), "source_id")
    found = found.withColumn("place", F.expr("locate(quote, text)")).where("place > 0").select("quote", "source_id", "place")
    return quotes.select("quote_id", "quote").join(found, "quote").select("quote_id", "source_id", "place")


def valid_entries(entries: DataFrame, sources: DataFrame, scope: DataFrame) -> DataFrame:
    """entries (entry_id, intent, source_id, quote) with problem: null, or why an entry does not count: source, scope (the intent is not one of its source), blank, long or not_quoted."""
    known = sources.select("source_id", "text")
    scoped = scope.select("source_id", "intent").distinct().withColumn("in_scope", F.lit(True))
    rows = entries.join(known, "source_id", "left").join(scoped, ["source_id", "intent"], "left")
    problem = (
        F.when(F.col("text").isNull(), "source")
        .when(F.col("in_scope").isNull(), "scope")
        .when(F.coalesce(F.trim("quote"), F.lit("")) == "", "blank")
        .when(F.length("quote") > MOST_QUOTE, "long")
        .when(~F.contains("text", F.col("quote")), "not_quoted")
    )
    return rows.select(*entries.columns, problem.alias("problem"))


def product_evidence(products: DataFrame, snapshots: DataFrame, site: str, today: str) -> DataFrame:
    """products (product_id, kind, status, verified, source_url, checked_at, snapshot, quotes) with snapshot_sha256 and problem: null, or why a product is no evidence.

    It is active, verified by a person, from a page of the site's own host, checked on a date that is not to come, and all that it says is in its snapshot (snapshot, text) to the letter.
    """
    host = F.lower(F.regexp_extract("source_url", r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    own = F.lower(F.regexp_extract(F.lit(site), r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rows = products.join(snapshots.select("snapshot", F.regexp_replace("text", "^﻿", "").alias("_text")), "snapshot", "left")
    checked = F.try_to_date("checked_at", "yyyy-MM-dd")
    missing = F.exists("quotes", lambda q: q.isNull() | (F.trim(q) == ""))
    problem = (
        F.when(~F.coalesce((F.col("kind") == "product") & (F.col("status") == "active"), F.lit(False)), "not_active")
        .when(~F.coalesce(F.col("verified"), F.lit(False)), "not_verified")
        .when(~F.coalesce((host != "") & (host == own), F.lit(False)), "not_official")
        .when(checked.isNull() | ~F.regexp_like("checked_at", F.lit(r"^\d{4}-\d\d-\d\d$")), "no_date")
        .when(checked > F.lit(today).cast("date"), "future_date")
        .when(F.col("_text").isNull(), "no_snapshot")
        .when(F.coalesce(missing, F.lit(True)) | (F.size("quotes") == 0), "no_quotes")
        .when(F.exists("quotes", lambda q: ~F.contains("_text", q)), "not_quoted")
    )
    return rows.select(*products.columns, F.when(problem.isNull(), F.sha2("_text", 256)).alias("snapshot_sha256"), problem.alias("problem"))
