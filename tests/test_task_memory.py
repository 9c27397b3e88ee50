"""What tasks hold of a batch of Arrow at once: a few files or one block, not all."""

import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from siteglass.llm import common, suffix_dedup
from siteglass.operators import sitemaps
from siteglass.sources import forms

FILES = 300


class Table:
    """A table that gives a fold over its batches back instead of running it."""

    columns = ["url", "status", "error", "content"]
    dtypes = [("url", "string"), ("status", "int"), ("error", "string"), ("content", "binary")]

    def select(self, *_):
        return self

    def withColumn(self, *_):
        return self

    def mapInArrow(self, work, _):
        return work


def peak(work, batch):
    """(rows, MB of Python's and numpy's memory at most) of a fold over one batch."""
    tracemalloc.start()
    rows = sum(b.num_rows for b in work(iter([batch])))
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return rows, most


def test_forms_are_read_one_by_one(spark):
    form = ("date,query_id,note\r\n" + "2024-01-01,q1,seen\r\n" * 2500).encode()
    rows, most = peak(forms.records(Table()), pa.RecordBatch.from_arrays([pa.array([str(k) for k in range(FILES)]), pa.array([form] * FILES, pa.binary())], ["file", "content"]))
    assert rows == FILES * 2500 and most < 10


def test_sitemaps_are_parsed_a_few_at_a_time(spark):
    content = b"<urlset>" + b"<url><loc>https://e.com/some/page</loc><lastmod>2024-01</lastmod></url>" * 500 + b"</urlset>"
    answers = [pa.array([str(k) for k in range(FILES)]), pa.array([200] * FILES, pa.int32()), pa.nulls(FILES, pa.string()), pa.array([content] * FILES, pa.binary())]
    rows, most = peak(sitemaps.parsed(Table()), pa.RecordBatch.from_arrays(answers, Table.columns))
    assert rows == FILES and most < 10


def test_a_block_of_windows_takes_little_memory():
    """Blocks close when they have BLOCK_BYTES; the sorts over one take many times that."""
    import numpy as np

    rng = np.random.default_rng(1)
    part = [rng.integers(97, 107, 320, dtype=np.uint8).tobytes() for _ in range(suffix_dedup.BLOCK_BYTES // 640)]
    rows = [(k // 2, k, 1, part[k // 2][k % 2 * 20 :]) for k in range(2 * len(part))]
    tracemalloc.start()
    found = suffix_dedup._judge(rows, 200)
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert found.num_rows == len(rows) and most < 100


def test_batches_of_large_rows_are_bounded_by_bytes(spark):
    common.text_batches(spark)
    rows = spark.range(0, 100, 1, 1).select(F.repeat(F.lit("x"), 200_000).cast("binary").alias("packed"))
    found = [r.n for r in rows.mapInArrow(lambda batches: (pa.RecordBatch.from_pylist([{"n": b.nbytes}]) for b in batches), "n long").collect()]
    assert sum(found) >= 100 * 200_000
    assert max(found) <= common.TEXT_BATCH_BYTES + 250_000
