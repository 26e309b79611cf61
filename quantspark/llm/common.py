"""Shared pieces of the training-data operators: tables, words, scratch space, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


#: Bounds of one Arrow batch: whole texts are long, and the defaults may not fit a worker.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table of a query; from then on the session sends texts to Python in batches of bounded rows and bytes."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{key}").rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_col(name: str = "text") -> Column:
    """The whole text; a null text counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def own_prefix(docs: DataFrame) -> str:
    """What no column name of ``docs`` starts with, for columns that come and go within an operator."""
    prefix = "__"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    return prefix


def words_col(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), 1)


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one where none is set and all tasks run in this process."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        own = spark.conf.get("spark.checkpoint.dir", None)
        if not own and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(own or tempfile.mkdtemp(prefix="checkpoint"))
    return sc._jsc.sc().getCheckpointDir().get()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cut off from their lineage, and read column by column."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` wrote, or unions of them, once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within, a query's shuffle files go when it ends: for queries that are checkpointed or collected once, and not run again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Rows of a few numbers that may be sent to every executor: some 30 MB.
SENT_ROWS = 1_000_000


def sent_if_small(df: DataFrame) -> DataFrame:
    """A side of a join, to be broadcast if it has few rows (counted here) and shuffled otherwise."""
    return F.broadcast(df) if df.limit(SENT_ROWS + 1).count() <= SENT_ROWS else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return [x or b"" for x in column.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()]


def slices(batch: pa.RecordBatch, column: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of the given string column, so that numpy temporaries stay small."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        done = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, done + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int, least: int) -> Iterator[pa.Table]:
    """Rows that arrive sorted by their first ``keys`` columns, as tables of whole groups with about ``least`` rows."""
    held, rows = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows < least:
            continue
        t, other = pa.Table.from_batches(held), np.zeros(rows, bool)
        for k in range(keys):
            other |= ~pc.equal(t.column(k), t.column(k)[rows - 1]).to_numpy()
        at = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
        if at:
            yield t.slice(0, at)
        t = t.slice(at)
        held, rows = t.combine_chunks().to_batches(), t.num_rows
        least = max(least, 2 * rows)
    if rows:
        yield pa.Table.from_batches(held)


def union_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For links a-b among 0..n-1: the smallest index reachable from each, by minimum labels and pointer jumping."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
        if np.array_equal(before, label):
            break
    return label
