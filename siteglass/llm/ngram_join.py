"""Operator 6: n-gram Jaccard join by PartEnum signatures.

Two sets of sizes a <= b can only have a Jaccard similarity of p % or more if b <= 100 * a / p and their Hamming
distance is at most (100 - p) * (a + b) / (100 + p). Sizes are covered by overlapping bands [low, high] such that
every such pair lies in the band of its smaller set, where the distance is at most k = (100 - p) * high / 100. In
a band the domain of hashed shingles is cut into n1 = k // 2 + 1 parts, so some part holds at most one difference,
and each part into three; two of the three agree. A set has, in each band that holds its size, a signature for each
part and each two of its three, and sets that are similar enough share one. Signatures only find candidates; every
link is checked on the whole sets.

Parts that hold no member of a set would make all such sets candidates, so empty signatures are left out. For that
the domain has spare parts: similar sets then agree in one part more than these, and share a signature that is not
empty unless both have empty ones in more parts than that. Such sets have the signatures of another partition of
the domain as well, and meet there. The last of FAMILIES partitions keeps its empty signatures.

Equal sets are one node. Tasks send signatures packed by bucket, sorted and joined in numpy; a bucket's task only
returns edges that connect the nodes of a signature, one for each node at most, never pairs. The connected
components of these edges are clusters: sets in different ones have no signature in common. Clusters of up to
CLUSTER_SETS sets and CLUSTER_SHINGLES shingles are compared by one task each, which sends on edges that connect its
similar sets. Larger clusters are often chains of texts that have no more than a frequent line in common. They are
connected again, signature by signature, by pairs whose parity sketches allow them to be similar: the bits of a sketch, from
PARITIES[0] to PARITIES[1] by the set's size, say which parts of the domain hold an odd number of members, so sets at a Hamming distance
of d differ in d bits at most. A sketch is folded by halves where the other has fewer bits. What is
still larger is dealt into tiles of that size, and every pair of sets is still compared, but for those
known to be in one class: within tiles, then the tiles' most central sets with all tiles, then the sets that are
outside of their cluster's largest class with all tiles.

A null or empty text, or one of white space, has an empty set, size 0, and is its own component. Texts with fewer
words than the width have one shingle, the whole sequence. Null ids are dropped; of rows with the same id every text
counts as that id's. Hashes have 64 bits (in packed signatures 48, next to their bucket). Long texts are one row, as all.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checked_broadcast, drop, table, text_batches, trimmed, written
from .components import components, forest
from .wordhash import U, mix, shingle_sets

#: A band begins at this many times the size at which the one before begins.
BAND_STEP = 1.4
#: Partitions of the domain that are tried for sets with empty parts.
FAMILIES = 4
#: Set keys that a task remembers, so that copies in one task send their signatures once.
SEEN = 500_000
#: Shingles of all sets for each bucket of signatures, and signatures that a task packs at once.
BUCKET_SHINGLES, PACKED = 250_000, 400_000
#: Sets and shingles that are compared in one task; larger clusters are dealt into tiles of this size.
CLUSTER_SETS, CLUSTER_SHINGLES = 1_500, 1_500_000
#: Least and most bits of a parity sketch, and members of a signature up to which pairs are told apart by it; with more, all are connected.
PARITIES, HOT_GROUP = (256, 4096), 50_000
#: Central sets that a tile offers, and of which a large cluster's tiles are all compared with the best.
OFFERED, CENTRAL = 4, 32


@functools.cache
def bands(percent: int) -> list[tuple[int, int]]:
    """(smallest, largest) size of each band; a pair is looked for in the band where its smaller set is below the next band."""
    out, low = [], 1
    while low < 2**40:
        upper = max(low + 1, int(low * BAND_STEP))
        out.append((low, (upper - 1) * 100 // percent))
        low = upper
    return out


@functools.cache
def layout(percent: int, band: int) -> tuple[int, int]:
    """(parts of the domain, those of them that are spare) in a band; no parts where only equal sets are similar."""
    low, high = bands(percent)[band]
    k = (100 - percent) * high // 100
    if not k:
        return 0, 0
    need = k // 2 + 1
    for spare in range(1, need + 1):
        mean = (need + spare) * 3 * math.exp(-2 / 3 * low / (need + spare))  # parts with an empty signature
        if spare >= mean + 1.5 * mean**0.5:
            break
    return need + spare, spare


def set_key(s: np.ndarray) -> int:
    return int((mix(mix(s).sum(dtype=U, keepdims=True) + U(len(s)))).astype(np.int64)[0])


def signatures(s: np.ndarray, percent: int) -> np.ndarray:
    """PartEnum signatures of a sorted set of hashes."""
    n, out = len(s), []
    if not n:
        return np.zeros(0, U)
    for band, (low, high) in enumerate(bands(percent)):
        if low > n:
            break
        n1, most_empty = layout(percent, band) if n <= high else (0, 0)
        if not n1:
            continue
        for family in range(FAMILIES):
            h = s if not family else np.sort(mix(s + U(family)))
            total = np.concatenate([np.zeros(1, U), np.cumsum(mix(h ^ U(0xA24BAED4963EE407)))])
            part = (h >> U(32)) * U(3 * n1) >> U(32)
            at = np.searchsorted(part, np.arange(3 * n1 + 1, dtype=U))
            size = np.diff(at).reshape(n1, 3)
            sums = mix(total[at[1:]] - total[at[:-1]]).reshape(n1, 3)
            pair = np.stack([sums[:, 0] + sums[:, 1] * U(3), sums[:, 0] + sums[:, 2] * U(5), sums[:, 1] + sums[:, 2] * U(7)], 1)
            which = np.arange(3 * n1, dtype=U).reshape(n1, 3) + (U(band * FAMILIES + family) << U(40))
            empty = np.stack([size[:, 0] + size[:, 1], size[:, 0] + size[:, 2], size[:, 1] + size[:, 2]], 1) == 0
            keep = ~empty if family < FAMILIES - 1 else np.ones_like(empty)
            out.append(mix(pair + mix(which))[keep])
            if empty.any(1).sum() <= most_empty:
                break
    return np.concatenate(out) if out else np.zeros(0, U)


def _sets(docs: DataFrame, width: int, carry: list[str]) -> DataFrame:
    """(doc_id, n_shingles, key, and the columns to carry)"""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, key = [], []
            for _, s in shingle_sets(b.column(1), width):
                n.append(len(s))
                key.append(set_key(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(key, pa.int64()), *b.columns[2:]], ["doc_id", "n_shingles", "key", *carry])

    return docs.mapInArrow(trimmed(work), ", ".join(["doc_id long, n_shingles long, key long", *(f"{c} long" for c in carry)]))


def _packed(docs: DataFrame, width: int, percent: int, buckets: int) -> DataFrame:
    """(bucket, signatures): (signature, key) of sets, packed by bucket: 6 bytes of each signature, then 8 of each key."""

    def pack(sigs: list[np.ndarray], keys: list[int]) -> pa.RecordBatch:
        key = np.repeat(np.array(keys, np.int64), [len(x) for x in sigs])
        sig = np.concatenate(sigs)
        bucket = (sig % U(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        rest, key, bucket = (sig[order] // U(buckets)).view(np.uint8).reshape(-1, 8)[:, :6], key[order], bucket[order]
        edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
        rows = [rest[x:y].tobytes() + key[x:y].tobytes() for x, y in zip(edge, edge[1:], strict=False)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[edge[:-1]]), pa.array(rows, pa.binary())], ["bucket", "signatures"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        sigs, keys, rows = [], [], 0
        for b in batches:
            for _, s in shingle_sets(b.column(0), width):
                if not len(s) or (key := set_key(s)) in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(key)
                sigs.append(signatures(s, percent))
                keys.append(key)
                rows += len(sigs[-1])
                if rows > max(PACKED, 64 * buckets):
                    yield pack(sigs, keys)
                    sigs, keys, rows = [], [], 0
        if rows:
            yield pack(sigs, keys)

    return docs.select("text").mapInArrow(trimmed(work), "bucket int, signatures binary")


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (bucket, signatures) sorted by bucket: edges (a, b) that connect the keys of each signature, b the smallest that
    a task connects; and the entries of signatures with several keys, packed: 4 bytes of the signature's number in the bucket, then 8 of each key."""
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def join(bucket: int, parts: list[bytes]) -> pa.RecordBatch | None:
        n = [len(p) // 14 for p in parts]
        wide = np.zeros((sum(n), 8), np.uint8)
        wide[:, :6] = np.frombuffer(b"".join(p[: 6 * k] for p, k in zip(parts, n, strict=True)), np.uint8).reshape(-1, 6)
        sig, key = wide.view(np.uint64).ravel(), np.frombuffer(b"".join(p[6 * k :] for p, k in zip(parts, n, strict=True)), np.int64)
        order = np.argsort(sig)
        sig, key = sig[order], key[order]
        same = sig[1:] == sig[:-1]
        edge = np.flatnonzero(same & (key[1:] != key[:-1]))
        if not len(edge):
            return None
        found.append((key[edge], key[edge + 1]))
        start = np.concatenate([[True], ~same])
        run = np.cumsum(start) - 1
        several = np.zeros(run[-1] + 1, bool)
        several[run[edge]] = True
        keep = several[run]
        packed = run[keep].astype(np.uint32).tobytes() + key[keep].tobytes()
        return pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([bucket], pa.int32()), pa.array([packed], pa.binary())], ["a", "b", "bucket", "entries"])

    held: list[bytes] = []
    now = None
    for b in batches:
        for bucket, packed in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if bucket != now and held:
                if (out := join(now, held)) is not None:
                    yield out
                held = []
                if len(found) > 64:
                    found = [forest(*(np.concatenate(x) for x in zip(*found, strict=True)))]
            now = bucket
            held.append(packed.as_py())
    if held and (out := join(now, held)) is not None:
        yield out
    if found:
        a, b = forest(*(np.concatenate(x) for x in zip(*found, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int32()), pa.nulls(len(a), pa.binary())], ["a", "b", "bucket", "entries"])


def parities(s: np.ndarray) -> bytes:
    """The parity sketch of a set; its bits are a power of two."""
    bits = PARITIES[0]
    while bits < PARITIES[1] and bits < 0.6 * len(s):
        bits *= 2
    odd = np.bincount((mix(s ^ U(0x5851F42D4C957F2D)) & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def _half(sketch: bytes) -> bytes:
    a = np.frombuffer(sketch, np.uint8).reshape(2, -1)
    return (a[0] ^ a[1]).tobytes()


def _apart(a: bytes, b: bytes) -> int:
    """A Hamming distance that two sets have at least, by their sketches."""
    while len(a) > len(b):
        a = _half(a)
    while len(b) > len(a):
        b = _half(b)
    return (int.from_bytes(a) ^ int.from_bytes(b)).bit_count()


def may_be_similar(n: np.ndarray, sketch: list[bytes], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges between the members of one signature that connect all pairs whose sizes and sketches allow them to be similar."""
    size = np.array([len(x) for x in sketch])
    # of each length the sketches as they are, and folded for those of half that length; sizes that are far apart are not similar anyway
    row, whole, half = np.zeros(len(n), np.int64), {}, {}
    if len(n) > 8:
        for length in np.unique(size).tolist():
            at = np.flatnonzero(size == length)
            row[at] = np.arange(len(at))
            whole[length] = np.frombuffer(b"".join(sketch[i] for i in at), np.uint64).reshape(len(at), -1)
            half[length] = whole[length][:, : length // 16] ^ whole[length][:, length // 16 :]
    label = np.arange(len(n))
    for i in range(len(n) - 1):
        other = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        other = other[np.minimum(n[other], n[i]) * 100 >= np.maximum(n[other], n[i]) * percent]
        if not len(other):
            continue
        if len(n) <= 8:
            apart = np.array([_apart(sketch[i], sketch[j]) for j in other])
        else:
            apart, own = np.zeros(len(other), np.int64), int(size[i])
            for length in np.unique(size[other]).tolist():
                at = np.flatnonzero(size[other] == length)
                rows = row[other[at]]
                if length == own:
                    differ = whole[length][rows] ^ whole[own][row[i]]
                elif length == 2 * own:
                    differ = half[length][rows] ^ whole[own][row[i]]
                elif 2 * length == own:
                    differ = whole[length][rows] ^ half[own][row[i]]
                else:
                    continue  # never so for similar sizes; a distance of 0 rules nothing out
                apart[at] = np.bitwise_count(differ).sum(1, dtype=np.int64)
        for x in np.unique(label[other[apart * (100 + percent) <= (n[other] + n[i]) * (100 - percent)]]):
            label[label == x] = label[i]
    far = np.flatnonzero(label != np.arange(len(n)))
    return far, label[far]


def _reconnected(shared: DataFrame, rows: DataFrame, width: int, percent: int) -> DataFrame:
    """Edges (a, b) between the sets of rows (key, n, text) that have a signature of shared in common and may be similar by their sketches."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [parities(s) for _, s in shingle_sets(b.column(2), width)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.binary())], ["key", "n", "sketch"])

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bucket, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                k = len(packed) // 12
                group = (np.int64(bucket) << np.int64(32)) + np.frombuffer(packed[: 4 * k], np.uint32).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(np.frombuffer(packed[4 * k :], np.int64))], ["group", "key"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        held: list[tuple[np.ndarray, np.ndarray, list[bytes]]] = []
        now = None

        def done() -> None:
            key, n = (np.concatenate(x) for x in list(zip(*held, strict=True))[:2])
            sketch = [y for x in held for y in x[2]]
            key, at = np.unique(key, return_index=True)
            if len(key) > HOT_GROUP:
                found.append((key[1:], key[:-1]))
            elif len(key) > 1:
                a, b = may_be_similar(n[at], [sketch[i] for i in at], percent)
                found.append((key[a], key[b]))

        for batch in batches:
            group, key, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            sketch = batch.column(3).to_pylist()
            cut = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(group)]
            for x, y in zip(cut, cut[1:], strict=False):
                if held and group[x] != now:
                    done()
                    held = []
                now = group[x]
                held.append((key[x:y], n[x:y], sketch[x:y]))
            if sum(len(a) for a, _ in found) > 1_000_000:
                found = [forest(*(np.concatenate(x) for x in zip(*found, strict=True)))]
        if held:
            done()
        if found:
            a, b = forest(*(np.concatenate(x) for x in zip(*found, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    # a set of several rows once
    sketches = written(rows.select("key", "n", "text").mapInArrow(trimmed(sketched), "key long, n long, sketch binary"), "sketches").dropDuplicates(["key"])
    each = shared.where("entries is not null").select("bucket", "entries").mapInArrow(trimmed(entries), "group long, key long")
    dealt = each.join(checked_broadcast(sketches), "key").select("group", "key", "n", "sketch").repartition("group").sortWithinPartitions("group")
    return dealt.mapInArrow(trimmed(joined), "a long, b long")


def similar(sets: list[np.ndarray], label: np.ndarray, percent: int, first: np.ndarray | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links between similar sets that connect all of those that are similar, and how central each set is.

    Sets with one label are known to be connected. Where first is given, only pairs with a set in first are compared.
    Central sets, whose shingles occur in many of the others, go first: they connect most, and what is connected is not compared.
    """
    n = np.array([len(s) for s in sets])
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    begin = np.concatenate([[0], np.cumsum(n)])
    central = np.add.reduceat(count[token].astype(np.float64), begin[:-1]) / n / len(sets)
    # shingles of one set alone can not be common to two
    common = count[token] > 1
    at = np.concatenate([[0], np.cumsum(np.add.reduceat(common.astype(np.int64), begin[:-1]))])
    token = token[common]
    label = label.copy()
    links: list[tuple[int, int]] = []
    todo = np.ones(len(sets), bool)
    mark = np.zeros(len(count), bool)
    for i in (np.argsort(-central, kind="stable") if len(sets) > 2 else np.arange(len(sets))):
        todo[i] = False
        if first is not None and not first[i]:
            continue
        other = np.flatnonzero((todo if first is None else todo | ~first) & (label != label[i]))
        other = other[np.minimum(n[other], n[i]) * 100 >= np.maximum(n[other], n[i]) * percent]
        if not len(other):
            continue
        own = token[at[i] : at[i + 1]]
        mark[own] = True
        size = at[other + 1] - at[other]
        end = np.cumsum(size)
        flat = mark[token[np.arange(end[-1] if len(end) else 0) + np.repeat(at[other] - (end - size), size)]]
        both = np.diff(np.concatenate([[0], np.cumsum(flat)])[np.concatenate([[0], end])])
        mark[own] = False
        for j in other[both * 100 >= (n[other] + n[i] - both) * percent].tolist():
            if label[j] != label[i]:
                links.append((int(i), j))
                label[label == label[j]] = label[i]
    return links, central


def _compared(rows: DataFrame, by: list[str], width: int, percent: int, offered: int = 0) -> DataFrame:
    """(cluster, a, b, central) from rows (cluster, .., key, label, first, text), one comparison for each value of by.

    Rows are edges between labels that the comparison connects. With offered, they are one for each key, with its new
    label, and the most central sets have how central they are.
    """
    names = ["cluster", "a", "b", "central"]

    def judged(cluster: int, keys: list[int], labels: list[int], firsts: list[bool], hashed: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key = np.array(keys, np.int64)
        keep = np.unique(key, return_index=True)[1]
        key, label, first = key[keep], np.array(labels, np.int64)[keep], np.array(firsts)[keep]
        sets = [hashed[i] for i in keep]
        links, central = similar(sets, np.unique(label, return_inverse=True)[1], percent, None if first.all() else first)
        a, b = forest(label[[x for x, _ in links]], label[[y for _, y in links]]) if links else (key[:0], key[:0])
        if not offered:
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), cluster)), pa.array(a), pa.array(b), pa.nulls(len(a), pa.float64())], names)
            return
        new = dict(zip(a.tolist(), b.tolist(), strict=True))
        some = np.ones(len(key), bool)
        some[np.argsort(-central, kind="stable")[:offered]] = False
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), cluster)), pa.array(key), pa.array([new.get(x, x) for x in label.tolist()], pa.int64()), pa.array(central, mask=some)], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now = None
        for batch in batches:
            # texts are hashed as they come, and only their sets are held
            hashed = (s for _, s in shingle_sets(batch.column(len(by) + 3), width))
            for *row, own_set in zip(*(c.to_pylist() for c in batch.columns[: len(by) + 3]), hashed, strict=True):
                group, own = tuple(row[: len(by)]), (*row[len(by) :], own_set)
                if group != now and held:
                    yield from judged(now[0], *map(list, zip(*held, strict=True)))
                    held = []
                now = group
                held.append(own)
        if held:
            yield from judged(now[0], *map(list, zip(*held, strict=True)))

    dealt = rows.select(*by, "key", "label", "first", "text").repartition(*by).sortWithinPartitions(*by)
    return dealt.mapInArrow(trimmed(work), "cluster long, a long, b long, central double")


def _large_clusters(rows: DataFrame, width: int, percent: int, sets: int, shingles: int) -> DataFrame:
    """Edges (a, b) within large clusters, from (cluster, key, n, m, size, text): m sets of size shingles in the cluster."""
    tiles = F.ceil(F.greatest(F.col("m") / sets, F.col("size") / shingles))
    rows = written(rows.withColumn("tile", F.pmod(F.xxhash64("key"), tiles)), "large")
    of_tile = written(rows.select("cluster", "tile").distinct(), "tiles")
    apart = rows.withColumns({"label": F.col("key"), "first": F.lit(True)})
    within = written(_compared(apart, ["cluster", "tile"], width, percent, OFFERED), "within")
    best = within.where("central is not null").groupBy("cluster").agg(F.slice(F.sort_array(F.collect_list(F.struct("central", "a")), False), 1, CENTRAL).alias("c"))
    best = written(best.select("cluster", F.explode("c.a").alias("key")), "best")
    named = written(rows.join(checked_broadcast(within.select(F.col("a").alias("key"), F.col("b").alias("label"))), "key").withColumn("first", F.lit(False)), "named")
    # first round: the most central sets of a cluster with all of its tiles
    centre = named.join(checked_broadcast(best), ["cluster", "key"], "left_semi").withColumn("first", F.lit(True))
    spread = centre.drop("tile").join(checked_broadcast(of_tile), "cluster").select(named.columns)
    more = written(_compared(named.unionByName(spread), ["cluster", "tile"], width, percent).select("a", "b"), "central")
    # second round: sets outside of their cluster's largest class with all of its tiles
    roots = checked_broadcast(components(more).select(F.col("id").alias("label"), "root"))
    classes = named.select("cluster", "key", "label", "n").join(roots, "label", "left").withColumn("label", F.coalesce("root", "label")).drop("root")
    classes = written(classes, "classes")
    by_class = written(classes.groupBy("cluster", "label").agg(F.count("*").alias("members"), F.sum("n").alias("n")), "by_class")
    top = by_class.groupBy("cluster").agg(F.max(F.struct("members", "label")).alias("top"), F.sum("members").alias("m"), F.sum("n").alias("n"), F.count("*").alias("classes")).where("classes > 1")
    top = top.join(by_class.select("cluster", F.col("label").alias("l"), F.col("members").alias("lm"), F.col("n").alias("ln")), "cluster").where("l = top.label")
    parts = F.ceil(F.greatest((F.col("m") - F.col("lm")) / sets, (F.col("n") - F.col("ln")) / shingles))
    top = written(top.select("cluster", F.col("l").alias("top"), parts.alias("parts")), "top")
    part = F.pmod(F.xxhash64("key", F.lit(1)), F.col("parts"))
    known = classes.select("key", "cluster", "label").join(checked_broadcast(top), "cluster")
    known = rows.select("key", "tile", "text").join(checked_broadcast(known), "key").withColumn("own", F.when(F.col("label") != F.col("top"), part))
    known = written(known, "known")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    # a set outside goes to all tiles with its own part; every set, but where it is there already, to all parts with its own tile
    left = known.withColumn("part", every).where("own is null or part <> own").withColumn("first", F.lit(False))
    right = known.where("own is not null").withColumn("part", F.col("own")).drop("tile").join(checked_broadcast(of_tile), "cluster").withColumn("first", F.lit(True))
    cols = ["cluster", "tile", "part", "key", "label", "first", "text"]
    last = written(_compared(right.select(cols).unionByName(left.select(cols)), ["cluster", "tile", "part"], width, percent).select("a", "b"), "outside")
    drop(named, rows, known, classes, by_class)
    return within.select("a", "b").unionByName(more).unionByName(last)


def similarity_classes(docs: DataFrame, width: int, percent: int, id: str = "doc_id", text: str = "text", carry: dict[str, str] | None = None, sets: int = CLUSTER_SETS, shingles: int = CLUSTER_SHINGLES) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document, and columns of longs to carry; see above."""
    spark = docs.sparkSession
    text_batches(spark)
    more = [F.col(c).cast("long").alias(name) for name, c in (carry or {}).items()]
    docs = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("copy"), *more).where("doc_id is not null")
    whole = written(_sets(docs, width, ["copy", *(carry or {})]), "sets")
    nodes = whole.where("key is not null").groupBy("key").agg(F.min(F.struct("doc_id", "copy")).alias("one"), F.first("n_shingles").alias("n"))
    nodes = written(nodes.select("key", F.col("one.doc_id").alias("id"), F.col("one.copy").alias("copy"), "n"), "nodes")
    count, total = nodes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    buckets = max(16, math.ceil(total / BUCKET_SHINGLES))
    docs = docs.select("doc_id", "copy", "text")
    # copies have one set; where a list of one document for each set is small, only these are signed
    firsts = docs.join(F.broadcast(nodes.select(F.col("id").alias("doc_id"), "copy")), ["doc_id", "copy"], "left_semi") if count <= 1_000_000 else docs
    dealt = _packed(firsts, width, percent, buckets).repartition("bucket").sortWithinPartitions("bucket")
    shared = written(dealt.mapInArrow(trimmed(_edges), "a long, b long, bucket int, entries binary"), "shared")

    def sized(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(clusters, their members with m and size, how many sets and shingles their cluster has)"""
        clusters = components(edges)
        members = clusters.select(F.col("id").alias("key"), "root").join(nodes, "key")
        of = members.groupBy("root").agg(F.count("*").alias("m"), F.sum("n").alias("size"))
        wanted = members.join(of, "root").select(F.col("root").alias("cluster"), "key", F.col("id").alias("doc_id"), "copy", "n", "m", "size")
        return clusters, written(wanted, "wanted")

    def texts_of(wanted: DataFrame) -> DataFrame:
        return docs.join(checked_broadcast(wanted), ["doc_id", "copy"]).select("cluster", "key", "n", "m", "size", "text")

    def compared_whole(wanted: DataFrame) -> DataFrame:
        return written(_compared(texts_of(wanted).withColumns({"label": F.col("key"), "first": F.lit(True)}), ["cluster"], width, percent).select("a", "b"), "inside")

    fits = (F.col("m") <= sets) & (F.col("size") <= shingles)
    clusters, wanted = sized(shared.where("a is not null").select("a", "b"))
    links = compared_whole(wanted.where(fits))
    if wanted.where(~fits).limit(1).count():
        again, closer = sized(written(_reconnected(shared, texts_of(wanted.where(~fits)), width, percent), "reconnected"))
        links = links.unionByName(compared_whole(closer.where(fits)))
        if closer.where(~fits).limit(1).count():
            links = links.unionByName(_large_clusters(texts_of(closer.where(~fits)), width, percent, sets, shingles))
        drop(again, closer)

    # rows of one id are one document
    again = whole.where("key is not null").groupBy("doc_id").agg(F.min("key").alias("a"), F.max("key").alias("z")).where("a <> z").drop("z")
    again = whole.join(checked_broadcast(written(again, "again")), "doc_id").select("a", F.col("key").alias("b")).where("b is not null")
    labels = components(links.unionByName(again))
    named = nodes.join(labels.withColumnRenamed("id", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    named = written(named.select("key", "root", "id"), "classes")
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    of_key = written(named.join(least, "root").select("key", "component_id"), "components")
    drop(nodes, shared, clusters, wanted, links, labels, named)
    return whole.join(of_key, "key", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), *(carry or {}))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_classes(table(spark, sf_dir, "documents"), width=4, percent=85)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op6_ngram_join": op6_ngram_join}
ORACLES: dict[str, str] = {}
