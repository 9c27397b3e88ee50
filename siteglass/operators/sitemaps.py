"""Sitemaps: files of recorded answers, indexes followed level by level, hygiene, comparison with a crawl, breadcrumbs, and files to write.

A recorded answer is (site, url, status, error, truncated, content), content as it came, perhaps gzipped. Sites are hosts, in lower case.
"""

from __future__ import annotations

import gzip
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import parsing, urls
from ..sources.scratch import kept

# fixed values: what a written sitemap file holds at most, what the protocol allows one, and from when dates count as uniform
URLS_PER_FILE, BYTES_PER_FILE = 45_000, 45 * 1024 * 1024
MOST_URLS, MOST_BYTES = 50_000, 52_428_800
UNIFORM_ENTRIES, UNIFORM_SHARE = 10, 0.9
#: An address's element beside the address itself, and the longest address.
ENTRY, MOST_URL = 40, 8 * 1024
#: Files whose entries a task holds at once.
FILES_AT_ONCE = 16
USUAL = ("/sitemap.xml", "/sitemap_index.xml")
PARSED = "kind string, entries array<struct<loc:string,lastmod:string>>, bytes long, problem string"


def hygiene(entries: DataFrame, host: str) -> DataFrame:
    """One row about entries (loc, lastmod): how many, without a date, with a bad one, on another host, and repeated."""
    bad = F.col("lastmod").isNotNull() & ~parsing.w3c_datetime(F.col("lastmod"))
    each = entries.groupBy("loc").agg(F.count("*").alias("n"), F.count_if(F.col("lastmod").isNull()).alias("missing"), F.count_if(bad).alias("invalid"))
    foreign = urls.host(F.col("loc")) != host
    return each.agg(F.sum("n").alias("entries"), F.sum("missing").alias("missing"), F.sum("invalid").alias("invalid"), F.sum(F.when(foreign, F.col("n")).otherwise(0)).alias("foreign_host"), F.sum(F.col("n") - 1).alias("duplicates"))


def against_crawl(sitemap: DataFrame, crawl: DataFrame) -> DataFrame:
    """(key, side) of addresses in the sitemap only or in the crawl only, by link key."""
    a, b = sitemap.select(urls.link_key(F.col("url")).alias("key")), crawl.select(urls.link_key(F.col("url")).alias("key"))
    return a.subtract(b).withColumn("side", F.lit("sitemap")).unionByName(b.subtract(a).withColumn("side", F.lit("crawl")))


def breadcrumbs(pages: DataFrame) -> DataFrame:
    """(page_id, depth, parent_id): for each proper prefix of a page's path the page that has it, with or without a closing slash."""
    host, path = urls.host(F.col("url")), urls.part(F.col("url"), 3)
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    keyed = pages.select("page_id", host.alias("host"), parts.alias("parts"))
    known = keyed.groupBy("host", F.array_join("parts", "/").alias("trail")).agg(F.min("page_id").alias("parent_id"))
    depth = F.when(F.size("parts") > 0, F.sequence(F.lit(0), F.size("parts") - 1))
    steps = keyed.withColumn("depth", F.explode(depth)).withColumn("trail", F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/"))
    return steps.join(known, ["host", "trail"]).select("page_id", "depth", "parent_id")


def _local(tag: object) -> str:
    return tag.rpartition("}")[2].lower() if isinstance(tag, str) else ""


def parse(content: bytes | None) -> tuple[str | None, list[dict], int, str | None]:
    """(kind, entries, bytes, problem) of a file, unzipped where it is zipped: urlset or sitemapindex, with the first loc and lastmod right inside of each entry."""
    raw = content or b""
    try:
        if raw[:2] == b"\x1f\x8b":
            raw = gzip.decompress(raw)
        root = ET.fromstring(raw)
    except (ET.ParseError, OSError, EOFError, zlib.error, ValueError) as e:
        return None, [], len(raw), type(e).__name__
    kind = _local(root.tag)
    if kind not in ("urlset", "sitemapindex"):
        return None, [], len(raw), f"root {kind}"
    entries = []
    for node in root:
        if _local(node.tag) in ("url", "sitemap"):
            said: dict[str, str] = {}
            for child in node:
                said.setdefault(_local(child.tag), (child.text or "").strip())
            entries.append({"loc": said.get("loc") or None, "lastmod": said.get("lastmod") or None})
    return kind, entries, len(raw), None


def parsed(answers: DataFrame) -> DataFrame:
    """answers with kind, entries, bytes and problem in place of content; only whole answers of status 200 are read."""
    rest = [c for c in answers.columns if c != "content"]
    good = (F.col("status") == 200) & F.col("error").isNull()
    rows = answers.withColumn("content", F.when(good, F.col("content").cast("binary")))
    entry = pa.list_(pa.struct([("loc", pa.string()), ("lastmod", pa.string())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(a, FILES_AT_ONCE) for whole in batches for a in range(0, whole.num_rows, FILES_AT_ONCE)):
            read = [(None, [], 0, None) if x is None else parse(x) for x in b.column("content").to_pylist()]
            columns = [pa.array([r[k] for r in read], t) for k, t in enumerate((pa.string(), entry, pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in rest], *columns], [*rest, "kind", "entries", "bytes", "problem"])

    kinds = dict(answers.dtypes)
    return rows.mapInArrow(work, ", ".join([f"{c} {kinds[c]}" for c in rest] + [PARSED]))


def inspected(read: DataFrame, roots: DataFrame, most_files: int = 100, most_children: int | None = 100) -> DataFrame:
    """(site, place, url, status, kind, url_count, parsed, truncated, error, required) of the files that each site's roots lead to.

    read is what parsed() gives, roots are (site, place, url, declared). Files are taken in the order of a queue: roots by place, then the
    children of each index by the index's place and their own; each file once, at most most_files of a site, and of an index its first
    most_children, those of the site's own host alone. Each level is a join with the answers and an anti-join with what is already taken, and is
    written. What is left in the queue where a site's files are used up is returned as not inspected, with place null and error inspection_limit. A file without an answer has
    no status and error no_answer. required: declared, or a child of an index.
    """
    answers = kept(read.select("site", "url", "status", "error", "truncated", "kind", "problem", "entries"), "answers")
    own = Window.partitionBy("site").orderBy("order")
    queue = roots.groupBy("site", "url").agg(F.min(F.array(F.col("place").cast("long"))).alias("order"), F.bool_or("declared").alias("required"))
    queue, taken, out, left, named = kept(queue, "queue"), None, None, None, None
    while True:
        fresh = queue if taken is None else queue.join(taken.select("site", "url"), ["site", "url"], "left_anti")
        used = None if taken is None else taken.groupBy("site").agg(F.count("*").alias("used"))
        ranked = fresh.withColumn("used", F.lit(0)) if used is None else fresh.join(used, "site", "left").fillna(0, ["used"])
        ranked = kept(ranked.withColumn("place", F.col("used") + F.row_number().over(own)).drop("used"), "level")
        level = kept(ranked.where(F.col("place") <= most_files).join(answers, ["site", "url"], "left"), "level")
        rest = ranked.where(F.col("place") > most_files).select("site", "url", "required")
        left = rest if left is None else left.unionByName(rest)
        out = level if out is None else out.unionByName(level)
        now = level.select("site", "url", "place")
        taken = now if taken is None else taken.unionByName(now)
        locs = F.filter(F.transform("entries", lambda e: e["loc"]), lambda x: x.isNotNull())
        locs = locs if most_children is None else F.slice(locs, 1, most_children)
        children = level.where("kind = 'sitemapindex'").select("site", "place", F.posexplode(locs).alias("at", "url"))
        children = children.where(F.regexp_like("url", F.lit("(?i)^https?://")) & (urls.host(F.col("url")) == F.col("site")))
        queue = kept(children.groupBy("site", "url").agg(F.min(F.array("place", F.col("at").cast("long"))).alias("order")).withColumn("required", F.lit(True)), "queue")
        children = queue.select("site", "url")
        named = children if named is None else named.unionByName(children)
        if queue.isEmpty():
            break
    # a file that an index names is required, whenever it was taken
    out = out.join(named.distinct().withColumn("named", F.lit(True)), ["site", "url"], "left").withColumn("required", F.col("required") | F.coalesce("named", F.lit(False)))
    n = F.coalesce(F.size("entries"), F.lit(0))
    error = F.coalesce("error", F.when(F.col("status").isNull(), "no_answer"), "problem")
    cut = F.coalesce("truncated", F.lit(False)) | ((F.col("kind") == "sitemapindex") & (n > (most_children or 1 << 30)))
    done = out.select("site", F.col("place").cast("int").alias("place"), "url", "status", "kind", F.when(F.col("kind").isNotNull(), n).otherwise(0).alias("url_count"), F.col("kind").isNotNull().alias("parsed"), F.coalesce(cut, F.lit(False)).alias("truncated"), error.alias("error"), "required")
    pending = left.groupBy("site", "url").agg(F.bool_or("required").alias("required")).join(taken.select("site", "url"), ["site", "url"], "left_anti")
    none = lambda kind: F.lit(None).cast(kind)
    return done.unionByName(pending.select("site", none("int").alias("place"), "url", none("int").alias("status"), none("string").alias("kind"), F.lit(0).alias("url_count"), F.lit(False).alias("parsed"), F.lit(True).alias("truncated"), F.lit("inspection_limit").alias("error"), "required"))


def frontier(files: DataFrame) -> DataFrame:
    """(site, discovered, checked, remaining) of inspected files."""
    return files.groupBy("site").agg(F.count("*").alias("discovered"), F.count("place").alias("checked"), F.count_if(F.col("place").isNull()).alias("remaining"))


def listed(read: DataFrame, files: DataFrame) -> DataFrame:
    """(site, file, loc, lastmod) of the entries of inspected files that list pages."""
    good = files.where("place is not null and kind = 'urlset'").select("site", "url")
    return read.join(good, ["site", "url"], "left_semi").select("site", F.col("url").alias("file"), F.explode("entries").alias("e")).select("site", "file", "e.loc", "e.lastmod")


def quality(read: DataFrame) -> DataFrame:
    """(site, url, entries, bytes, lastmod_missing, lastmod_invalid, top_value, top_count, top_share, foreign_host, duplicate_urls, over_url_limit, over_size_limit) of files that could be read.

    Of several dates that are as frequent the earliest counts. A file is a row, bounded by protocol, so its entries are counted in place.
    """
    # entries is a count in the result
    read = read.withColumnRenamed("entries", "listed")
    e = F.col("listed")
    dates = F.transform(e, lambda x: x["lastmod"])
    valid = F.filter(dates, lambda d: d.isNotNull() & parsing.w3c_datetime(d))
    n, distinct = F.size(e), F.array_sort(F.array_distinct(valid))
    # runs of the sorted dates: how often the value at a place comes
    runs = F.transform(distinct, lambda d: F.struct(F.size(F.filter(valid, lambda x: x == d)).alias("n"), d.alias("value")))
    top = F.aggregate(runs, F.struct(F.lit(0).alias("n"), F.lit(None).cast("string").alias("value")), lambda a, b: F.when(b["n"] > a["n"], b).otherwise(a))
    locs = F.filter(F.transform(e, lambda x: x["loc"]), lambda x: x.isNotNull())
    foreign = F.filter(locs, lambda u: F.regexp_like(u, F.lit("(?i)^https?://")) & (urls.host(u) != F.col("site")))
    return read.where("kind is not null").select(
        "site", "url", n.alias("entries"), "bytes", F.size(F.filter(dates, lambda d: d.isNull())).alias("lastmod_missing"),
        F.size(F.filter(dates, lambda d: d.isNotNull() & ~parsing.w3c_datetime(d))).alias("lastmod_invalid"),
        top["value"].alias("top_value"), top["n"].alias("top_count"), F.when(n > 0, F.round(top["n"] / n, 3)).otherwise(0.0).alias("top_share"),
        F.size(foreign).alias("foreign_host"), (F.size(locs) - F.size(F.array_distinct(F.transform(locs, urls.normalize)))).alias("duplicate_urls"),
        (n > MOST_URLS).alias("over_url_limit"), (F.col("bytes") > MOST_BYTES).alias("over_size_limit"),
    )


def failed(files: DataFrame) -> DataFrame:
    """Inspected files that should be there and could not be read whole. Only a usual place that nobody names may be absent."""
    usual = F.regexp_like("url", F.lit(r"(?i)^https?://[^/?#]+/sitemap(_index)?\.xml$"))
    absent = usual & ~F.col("required") & F.col("status").isin(404, 410) & F.col("error").isNull() & ~F.col("truncated")
    bad = F.coalesce(F.col("status") != 200, F.lit(True)) | F.col("error").isNotNull() | ~F.col("parsed") | F.col("truncated")
    return files.where(bad & ~F.coalesce(absent, F.lit(False)))


def safety(sites: DataFrame, files: DataFrame, known: DataFrame, eligible: DataFrame) -> DataFrame:
    """(site, safe, verified, reason, missing, failed) of sites (site, complete, reasons): whether a new sitemap may replace the old one.

    complete is null where a crawl says nothing about its coverage. known and eligible are (site, url). Not safe: a crawl that is not complete, a file
    that could not be read, or, where coverage is not known, old addresses that the new sitemap would lose.
    """
    lost = known.select("site", urls.normalize(F.col("url")).alias("url")).distinct().join(eligible.select("site", "url").distinct(), ["site", "url"], "left_anti").groupBy("site").agg(F.count("*").alias("missing"))
    broken = failed(files).groupBy("site").agg(F.count("*").alias("failed"))
    s = sites.join(lost, "site", "left").join(broken, "site", "left").fillna(0, ["missing", "failed"])
    reason = F.when(F.col("complete") == F.lit(False), F.when(F.size("reasons") > 0, F.array_join("reasons", "; ")).otherwise("crawl_incomplete")).when(F.col("failed") > 0, "sitemap_failed").when(F.col("complete").isNull() & (F.col("missing") > 0), "coverage_unknown_urls_lost")
    verified = F.col("complete").isNotNull() | (F.col("failed") > 0)
    return s.select("site", reason.isNull().alias("safe"), verified.alias("verified"), F.coalesce(reason, F.lit("")).alias("reason"), "missing", "failed")


def packed(entries: DataFrame, per_file: int = URLS_PER_FILE, most_bytes: int = BYTES_PER_FILE, longest: int = MOST_URL) -> DataFrame:
    """(loc, rank, chunk): addresses in order, each once, dealt to files of at most per_file addresses and most_bytes bytes.

    Addresses are sorted in ranges; a range's running counts and bytes go on from those of the ranges before, of which there is a row for each range. A file ends where
    either a multiple of per_file addresses is reached or one of bytes, so no file waits for the one before. Addresses longer than `longest` bytes are an error.
    """
    size = F.octet_length("loc") + ENTRY
    checked = F.when(F.octet_length("loc") > longest, F.raise_error(F.lit("an address is too long for a sitemap"))).otherwise(F.col("loc"))
    cut = kept(entries.where("loc is not null").select(checked.alias("loc")).distinct().repartitionByRange("loc").withColumn("range", F.spark_partition_id()), "ranges")
    sums = cut.groupBy("range").agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("n", "bytes")])
    own = Window.partitionBy("range").orderBy("loc").rowsBetween(Window.unboundedPreceding, -1)
    rows = cut.join(F.broadcast(sums), "range")
    rank = F.col("n_before") + F.coalesce(F.count("loc").over(own), F.lit(0))
    begins = F.col("bytes_before") + F.coalesce(F.sum(size).over(own), F.lit(0))
    # what begins in a stretch of so many bytes ends at most one address after it
    stretch = most_bytes - longest - ENTRY
    if stretch <= 0:
        raise ValueError("a file must hold one address at least")
    return rows.select("loc", rank.alias("rank"), F.struct(F.floor(rank / per_file).alias("by_count"), F.floor(begins / stretch).alias("by_bytes")).alias("chunk"))


HEADER = '<?xml version="1.0" encoding="UTF-8"?>\n<{0} xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'


def escaped(x: Column) -> Column:
    for plain, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        x = F.replace(x, F.lit(plain), F.lit(reference))
    return x


def write(entries: DataFrame, path: str, base: str, safe: bool = True, per_file: int = URLS_PER_FILE, most_bytes: int = BYTES_PER_FILE) -> list[str]:
    """Names of the files that were written for entries (loc): sitemap.xml, or sitemap-1.xml and so on and sitemap_index.xml, which comes last, so that
    an index never names a file that is not there. Nothing is written where it is not safe. Tasks write the files; the driver names them."""
    if not safe:
        return []
    spark = entries.sparkSession
    rows = packed(entries, per_file, most_bytes)
    firsts = rows.groupBy("chunk").agg(F.min("rank").alias("first"), F.max("rank").alias("last"))
    numbers = kept(firsts.withColumn("number", F.row_number().over(Window.orderBy("first"))), "chunks")  # a row for each file
    lines = rows.join(F.broadcast(numbers), "chunk").select("number", F.col("rank").alias("n"), F.concat(F.lit("  <url><loc>"), escaped(F.col("loc")), F.lit("</loc></url>")).alias("value"))
    ends = numbers.select("number", F.inline(F.array(F.struct(F.lit(-1).cast("long").alias("n"), F.lit(HEADER.format("urlset")).alias("value")), F.struct((F.col("last") + 1).alias("n"), F.lit("</urlset>").alias("value")))))
    whole = lines.unionByName(ends).repartition("number").sortWithinPartitions("number", "n").select("number", "value")
    whole.write.partitionBy("number").text(f"{path}/_parts")
    n = numbers.count()
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f"sitemap-{k}.xml" for k in range(1, n + 1)] if n > 1 else ["sitemap.xml"]

    def put(name: str, text: str) -> None:
        out = fs.create(at(f"{path}/{name}"), True)
        out.write(bytearray(text.encode()))
        out.close()

    for k in range(1, n + 1):
        (part,) = [f.getPath() for f in fs.listStatus(at(f"{path}/_parts/number={k}")) if f.getPath().getName().startswith("part-")]
        fs.rename(part, at(f"{path}/{names[k - 1]}"))
    fs.delete(at(f"{path}/_parts"), True)
    if not n:
        put("sitemap.xml", HEADER.format("urlset") + "\n</urlset>\n")
    if n > 1:
        put("sitemap_index.xml", "\n".join([HEADER.format("sitemapindex"), *[f"  <sitemap><loc>{base.rstrip('/')}/{name}</loc></sitemap>" for name in names], "</sitemapindex>\n"]))
        names = ["sitemap_index.xml", *names]
    return names
