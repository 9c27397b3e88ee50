"""Operator 11: dropping lines that many documents share, by a sharded minimal perfect hash over line hashes.

A line's key is the line without white space (space, \\t to \\r) at its ends, A-Z lower-cased. Keys of LEAST code points and
more that MIN_DOCS documents and more hold lose all their lines but those of the largest doc_id that holds them.

Tasks hash the keys of their documents to 128 bits and send, for each hash, only its MIN_DOCS largest different ids: enough to
know whether that many documents hold it, and which id is largest, so a line that a third of all documents share is a few
rows a task. Hashes are dealt into shards. A shard keeps the different hashes that more than one document holds in a minimal perfect
hash (levels of bit arrays; a key's position is the number of set bits before its own), which indexes three compact arrays:
fingerprints (the other 64 bits of the hash, which tell strangers apart), counts of documents (up to MIN_DOCS), and the
ids that keep the line. Hashes of one document alone, the bulk, need no place: no fingerprint answers to them.

Documents stay where they lie: shards come to them as broadcast blocks of at most about BLOCK_BYTES, and each document probes
the arrays with the hashes of its lines. One block, the usual case, decides and rewrites in the same pass. Where there are more
blocks, each is a pass over the documents that yields only the numbers of lines to drop, and these are joined to the documents
by id and a digest of the text, since no block can be dropped and no worker can hold them all.

Null and empty texts are one empty line. Rows with the same id are one document. A null id is an id below all others. Texts of any length are
taken whole. An empty table gives no rows. Other columns pass, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import aside, checked_broadcast, drop, table, text_batches, written
from .wordhash import U, mix

MIN_DOCS, LEAST = 3, 20
#: Bytes of arrays that a worker holds at a time.
BLOCK_BYTES = 128 << 20
#: Sent hashes for a shard, and keys that a task combines before it sends them.
SHARD_ROWS, FLUSH_KEYS = 500_000, 200_000
#: Bits of a level for each key.
GAMMA = 2
BLANKS = b" \t\n\x0b\x0c\r"
#: Stands for a null id.
NO_ID = -(2**63)


def key(line: bytes, least: int = LEAST) -> bytes | None:
    """A line's key, or None where it is too short to count."""
    k = line.strip(BLANKS)
    if len(k) < least or (not k.isascii() and len(k.decode("utf-8", "replace")) < least):
        return None
    return k.lower()


def digest(k: bytes) -> bytes:
    return hashlib.blake2b(k, digest_size=16).digest()


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _texts(batch: pa.RecordBatch, id: str, text: str) -> Iterator[tuple[int, bytes]]:
    ids = batch.column(id).to_pylist()
    raw = batch.column(text).cast(pa.binary())
    for i, x in zip(ids, raw, strict=True):
        yield NO_ID if i is None else i, x.as_py() or b""


def largest_ids(h1: np.ndarray, h2: np.ndarray, doc: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The most largest different ids of each hash, by hash and id."""
    at = np.lexsort((doc, h2, h1))
    h1, h2, doc = h1[at], h2[at], doc[at]
    same = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
    new = np.ones(len(at), bool)
    new[1:] = ~(same & (doc[1:] == doc[:-1]))
    h1, h2, doc = h1[new], h2[new], doc[new]
    last = np.flatnonzero(np.append((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]), True))
    group = np.searchsorted(last, np.arange(len(h1)))
    few = last[group] - np.arange(len(h1)) < most
    return h1[few], h2[few], doc[few]


def _hashes(min_docs: int, least: int):
    """Of a task's documents (id, text): each hash of a key with its largest ids."""

    def sent(found: list[bytes], docs: list[int]) -> pa.RecordBatch:
        h1, h2, doc = largest_ids(*_halves(found), np.array(docs, np.int64), min_docs)
        return pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(doc)], ["h1", "h2", "doc"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[bytes] = []
        docs: list[int] = []
        for b in batches:
            for doc, raw in _texts(b, "id", "text"):
                own = {digest(k) for k in (key(line, least) for line in raw.split(b"\n")) if k is not None}
                found += own
                docs += [doc] * len(own)
                if len(found) >= FLUSH_KEYS:
                    yield sent(found, docs)
                    found, docs = [], []
        if found:
            yield sent(found, docs)

    return work


def slots(h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
    """What a hash's bit in a level is taken from."""
    seed = U((level + 1) * 0x9E3779B97F4A7C15 % 2**64)
    return mix((h1 ^ seed) + mix(h2 + seed))


def perfect(h1: np.ndarray, h2: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(bits of each level, all levels' bits as 64-bit words, order): the key order[p] has position p. The hashes are different."""
    sizes, words, order, rest = [], [], [], np.arange(len(h1))
    while len(rest):
        size = -(-GAMMA * len(rest) // 64) * 64
        at = (slots(h1[rest], h2[rest], len(sizes)) % U(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        own = alone[at]
        order.append(rest[own][np.argsort(at[own])])
        words.append(np.packbits(alone, bitorder="little").view("<u8"))
        sizes.append(size)
        rest = rest[~own]
    none = np.zeros(0, np.int64)
    return sizes, np.concatenate(words or [np.zeros(0, "<u8")]), np.concatenate(order or [none])


INDEX = "shard long, levels array<long>, bits binary, fingerprints binary, counts binary, keepers binary"


def _shards(min_docs: int):
    """Of rows (shard, h1, h2, doc), sorted by shard: a row with the arrays of each shard. One shard is held at a time."""

    def arrays(shard: int, parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch | None:
        h1, h2, doc = largest_ids(*(np.concatenate(x) for x in zip(*parts, strict=True)), min_docs)
        last = np.flatnonzero(np.append((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]), True))
        count = np.diff(last, prepend=-1)
        last, count = last[count > 1], count[count > 1]
        if not len(last):
            return None
        sizes, words, order = perfect(h1[last], h2[last])
        last, count = last[order], count[order]
        columns = [words, h2[last], np.minimum(count, 255).astype(np.uint8), doc[last]]
        return pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([sizes]), *[pa.array([c.tobytes()], pa.binary()) for c in columns]], ["shard", "levels", "bits", "fingerprints", "counts", "keepers"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for b in batches:
            shard, h1, h2, doc = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            edges = np.append(np.flatnonzero(np.diff(shard, prepend=shard[:1] - 1)), len(shard))
            for a, z in zip(edges, edges[1:], strict=False):
                if parts and shard[a] != now:
                    if (row := arrays(now, parts)) is not None:
                        yield row
                    parts = []
                now = int(shard[a])
                parts.append((h1[a:z].view(U), h2[a:z].view(U), doc[a:z]))
        if parts and (row := arrays(now, parts)) is not None:
            yield row

    return work


def index(docs: DataFrame, min_docs: int = MIN_DOCS, least: int = LEAST, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, int]:
    """(a written table with a row of arrays for each shard, how many shards there can be) over the lines of docs (id, text)."""
    sent = written(docs.mapInArrow(_hashes(min_docs, least), "h1 long, h2 long, doc long"), "lines")
    n = max(1, math.ceil(sent.count() / shard_rows))
    # as shard_of() in numpy
    shard = F.shiftrightunsigned(F.shiftrightunsigned("h1", 32) * n, 32)
    dealt = sent.select(shard.alias("shard"), "h1", "h2", "doc").repartition("shard").sortWithinPartitions("shard")
    shards = written(dealt.mapInArrow(_shards(min_docs), INDEX), "shards")
    drop(sent)
    return shards, n


def shard_of(h1: np.ndarray, n: int) -> np.ndarray:
    return ((h1 >> U(32)) * U(n) >> U(32)).astype(np.int64)


class Arrays:
    """The shards of a block, one after the other: positions are numbers of set bits before a key's own."""

    def __init__(self, rows: list, n: int):
        self.n = n
        self.first = min((r["shard"] for r in rows), default=0)
        past = max((r["shard"] for r in rows), default=-1) + 1
        levels = max((len(r["levels"]) for r in rows), default=0)
        self.sizes = np.zeros((past - self.first, levels), np.int64)
        self.base = np.zeros((past - self.first, levels), np.int64)
        at = 0
        for r in sorted(rows, key=lambda r: r["shard"]):
            for level, size in enumerate(r["levels"]):
                self.sizes[r["shard"] - self.first, level], self.base[r["shard"] - self.first, level] = size, at
                at += size
        rows = sorted(rows, key=lambda r: r["shard"])
        joined = lambda name, kind: np.frombuffer(b"".join(bytes(r[name]) for r in rows), kind)
        self.words, self.fingerprints, self.counts, self.keepers = joined("bits", "<u8"), joined("fingerprints", "<u8"), joined("counts", np.uint8), joined("keepers", np.int64)
        set_bits = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(set_bits) - set_bits

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, keeper) of each hash; 0 and 0 for hashes that have no place."""
        count, keeper = np.zeros(len(h1), np.int64), np.zeros(len(h1), np.int64)
        shard = shard_of(h1, self.n) - self.first
        live = np.flatnonzero((shard >= 0) & (shard < len(self.sizes)))
        for level in range(self.sizes.shape[1]):
            live = live[self.sizes[shard[live], level] > 0]
            if not len(live):
                break
            size, base = self.sizes[shard[live], level], self.base[shard[live], level]
            at = (slots(h1[live], h2[live], level) % size.astype(U)).astype(np.int64) + base
            word, bit = self.words[at >> 6], (at & 63).astype(U)
            hit = (word >> bit) & U(1) == 1
            place = self.before[at[hit] >> 6] + np.bitwise_count(word[hit] & ((U(1) << bit[hit]) - U(1)))
            found = live[hit]
            own = self.fingerprints[place] == h2[found]
            count[found[own]], keeper[found[own]] = self.counts[place[own]], self.keepers[place[own]]
            live = live[~hit]
        return count, keeper


def _dropped(batch: pa.RecordBatch, arrays: Arrays, id: str, text: str, min_docs: int, least: int) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """(lines, numbers of the lines to drop) of each row: the rows of a batch probe the arrays together."""
    texts, found, lines, docs, at = [], [], [], [], [0]
    for doc, raw in _texts(batch, id, text):
        split = raw.split(b"\n")
        for i, line in enumerate(split):
            if (k := key(line, least)) is not None:
                found.append(digest(k))
                lines.append(i)
        docs += [doc] * (len(found) - at[-1])
        at.append(len(found))
        texts.append(split)
    count, keeper = arrays.probe(*_halves(found))
    gone = (count >= min_docs) & (keeper != np.array(docs, np.int64))
    lines = np.array(lines, np.int64)
    for r, split in enumerate(texts):
        own = slice(at[r], at[r + 1])
        yield split, lines[own][gone[own]]


def _without(split: list[bytes], gone: np.ndarray | list[int]) -> bytes:
    gone = set(int(i) for i in gone)
    return b"\n".join(x for i, x in enumerate(split) if i not in gone)


def drop_lines(docs: DataFrame, min_docs: int = MIN_DOCS, least: int = LEAST, block_bytes: int = BLOCK_BYTES, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """docs (doc_id, text, ...) with n_lines, n_dropped (long) and kept (string), the text without its dropped lines; see above."""
    if not 2 <= min_docs <= 255:
        raise ValueError("counts of documents are bytes, and a line of one document is not kept in the index")
    spark = docs.sparkSession
    text_batches(spark)
    plain, back = aside(docs, ("doc_id", "text"))
    plain = plain.withColumns({"_id": F.col("doc_id").cast("long"), "_raw": F.col("text")})
    shards, n = index(plain.select(F.col("_id").alias("id"), "text"), min_docs, least, shard_rows)
    size = shards.agg(F.coalesce(F.sum(F.octet_length("bits") + F.octet_length("fingerprints") + F.octet_length("counts") + F.octet_length("keepers")), F.lit(0))).first()[0]
    blocks = max(1, min(n, math.ceil(size / block_bytes)))
    added = T.StructType([T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept", T.StringType())])

    def arrays(k: int):
        # the shards of a block hold about block_bytes, as hashes are spread evenly
        rows = shards.where(F.floor(F.col("shard") * blocks / n) == k).collect()
        return spark.sparkContext.broadcast(Arrays(rows, n))

    if blocks == 1:
        known = arrays(0)

        def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [(len(split), len(gone), _without(split, gone)) for split, gone in _dropped(b, known.value, "_id", "_raw", min_docs, least)]
                columns = [pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*b.columns, *columns], [*b.schema.names, *added.names])

        out = plain.mapInArrow(rewrite, T.StructType(plain.schema.fields + added.fields))
        return back(out.drop("_id", "_raw"))

    marks = None
    for k in range(blocks):
        known = arrays(k)

        def numbers(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            for b in batches:
                gone = [x for _, x in _dropped(b, known.value, "id", "text", min_docs, least)]
                some = [i for i, x in enumerate(gone) if len(x)]
                columns = [b.column("id").take(pa.array(some, pa.int64())), b.column("sum").take(pa.array(some, pa.int64())), pa.array([gone[i] for i in some], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "sum", "gone"])

        found = written(plain.select(F.col("_id").alias("id"), F.sha2("_raw", 256).alias("sum"), "text").mapInArrow(numbers, "id long, sum string, gone array<long>"), "marks")
        known.destroy()
        marks = found if marks is None else marks.unionByName(found)
    # rows with one id and text have the same marks from each block: one row of a block each, so lists hold a document's lines and no more
    one = Window.partitionBy("id", "sum", "_block").orderBy("gone")
    marks = marks.withColumn("_block", F.get("gone", F.lit(0))).withColumn("_n", F.row_number().over(one)).where("_n = 1")
    marks = written(marks.groupBy("id", "sum").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone")), "gone")
    keyed = plain.withColumn("_sum", F.sha2("_raw", 256))
    marks = marks.select(F.col("id").alias("_of"), F.col("sum").alias("_its"), F.col("gone").alias("_gone"))
    joined = keyed.join(checked_broadcast(marks), keyed["_id"].eqNullSafe(F.col("_of")) & (F.col("_sum") == F.col("_its")), "left")
    lines = F.split(F.coalesce("_raw", F.lit("")), "\n", -1)
    stays = F.filter(lines, lambda x, i: ~F.array_contains("_gone", i.cast("long")))
    joined = joined.withColumns({
        "n_lines": F.size(lines).cast("long"),
        "n_dropped": F.coalesce(F.size("_gone"), F.lit(0)).cast("long"),
        "kept": F.when(F.col("_gone").isNull(), F.coalesce("_raw", F.lit(""))).otherwise(F.array_join(stays, "\n")),
    })
    return back(joined.drop("_id", "_raw", "_sum", "_of", "_its", "_gone"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with how many lines it has and loses, and a digest of what is left. Null and empty texts have one empty line."""
    out = drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op11_line_dedup": op11_line_dedup}
ORACLES = {
    "op11_line_dedup": f"""WITH lines AS (SELECT doc_id, generate_subscripts(parts, 1) AS n, unnest(parts) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
        keyed AS (SELECT doc_id, n, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
        shared AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= {LEAST} GROUP BY k HAVING count(DISTINCT doc_id) >= {MIN_DOCS})
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (keeper <> doc_id) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
        FROM keyed LEFT JOIN shared USING (k) GROUP BY doc_id"""
}
