"""What the operators share: tables, scratch tables in the shared folder, checked broadcasts."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of Arrow batches that carry whole texts; keeps a batch of long texts small.
TEXT_BATCH_ROWS = 500
#: Bytes of such a batch. Rows of packed numbers have 100 KB and more each, so that 500 of them would fill Spark's own limit of 64 MB, off the heap and again in Python.
TEXT_BATCH_BYTES = 4_000_000
#: A side of a join is broadcast only when it has at most this many (narrow) rows.
BROADCAST_ROWS = 1_000_000

_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share: under spark.checkpoint.dir. Where that is unset, a temporary
    folder if driver and executors are one process, and else a folder in the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not base and spark.sparkContext.master.partition("[")[0] == "local":
        base = _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="siteglass-"))
    elif not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{base.rstrip('/')}/{app}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder. It cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop(*tables: DataFrame | None) -> None:
    """Delete written tables that nothing reads any more: what was made of them is itself written."""
    for t in tables:
        if t is not None and getattr(t, "_scratch", None):
            _delete(t.sparkSession, t._scratch)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clean(spark: SparkSession) -> None:
    """Delete all scratch tables of this application; call it when results have been written."""
    _delete(spark, scratch_dir(spark))


def aside(docs: DataFrame, keep: tuple[str, ...]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with all columns but those to keep under names of no meaning, and a function that gives a result its names back.

    So columns of the input never clash with those that an operator adds; an added column replaces one of its name.
    """
    named = {(c if c in keep else f"__{i}"): c for i, c in enumerate(docs.columns)}

    def back(df: DataFrame) -> DataFrame:
        added = [c for c in df.columns if c not in named]
        return df.select(*[F.col(c).alias(named[c]) for c in df.columns if c in named and named[c] not in added], *added)

    return docs.select(*[F.col(f"`{c}`").alias(n) for n, c in named.items()]), back


def checked_broadcast(small: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """small with a broadcast hint if a count shows that it is small; else unchanged, for a shuffled join."""
    return F.broadcast(small) if small.limit(rows + 1).count() <= rows else small


def text_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(TEXT_BATCH_BYTES))


def trimmed(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work over a partition's batches, after which its process gives back the memory that it no longer uses.

    Spark keeps Python workers for later tasks, and what one stage allocated would else count beside what the next one needs. Where the C library cannot do it, only Arrow's pool is released.
    """

    @functools.wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return run
