"""Names, row identities and tables used by the operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from weft.storage import drop, materialize

__all__ = ["WORD", "documents", "drop", "fresh", "identified", "kept_rows", "lean", "materialize", "octets", "small_reads", "table", "text_parts"]

#: A word is a run of characters other than space and \t..\r.
WORD = r"[^\x20\x09-\x0D]+"

PIECE_BYTES = 1 << 20

#: Of text that a task reads, or sorts and writes; of text that goes to Python at once; rows that are decoded at once.
SPLIT_BYTES, BATCH_BYTES, READ_ROWS = 16 << 20, 8 << 20, 512


def small_reads(spark: SparkSession) -> None:
    """From now on the session reads in splits of SPLIT_BYTES, READ_ROWS rows at once, and sends BATCH_BYTES at once to Python; less, where
    it is set to less.

    A task that filters texts holds a row group that it reads and one that it writes, and the rows just decoded: with Spark's
    128 MB and 4,096 rows, eight tasks need more than a heap of 1 GB."""
    now = spark._jsparkSession.sessionState().conf()
    for key, held, most in (
        ("spark.sql.files.maxPartitionBytes", now.filesMaxPartitionBytes(), SPLIT_BYTES),
        ("spark.sql.parquet.columnarReaderBatchSize", now.parquetVectorizedReaderBatchSize(), READ_ROWS),
        ("spark.sql.execution.arrow.maxBytesPerBatch", now.arrowMaxBytesPerBatch(), BATCH_BYTES),
    ):
        if not 0 < held <= most:
            spark.conf.set(key, str(most))


def octets(docs: DataFrame) -> Column:
    """Bytes of each text; of a null one 0."""
    return F.coalesce(F.octet_length(docs["text"].cast("string")), F.lit(0)).cast("long")


def text_parts(n_bytes: int | None) -> int:
    """In how many partitions rows with so many bytes of text are sorted and written. Left to the planner they are as few as the
    cores, however large."""
    return max(1, -(-(n_bytes or 0) // SPLIT_BYTES))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that df does not have, whatever the case."""
    held, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in held:
            name = f"_{name}"
        held.add(name.lower())
        out.append(name)
    return out


def identified(df: DataFrame, source: str, row: str) -> DataFrame:
    """df with two more columns (long) that identify a row, alike in every scan of the result.

    Rows of Parquet files are known by a hash of the file's path and their place in it. Other frames are written to
    the shared folder with a number."""
    if df._jdf.queryExecution().analyzed().nodeName().startswith("LogicalRelation"):
        try:
            return df.select("*", F.xxhash64("_metadata.file_path").alias(source), F.col("_metadata.row_index").alias(row))
        except AnalysisException:  # a format without row numbers
            pass
    return materialize(df.select("*", F.lit(0).cast("long").alias(source), F.monotonically_increasing_id().alias(row)), "rows")


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, in a worker that returns freed memory to the system before each batch and at the task's end.

    Workers outlive their tasks; what their allocators keep counts against the executor while it sorts and joins."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(_returned_between(batches))
        finally:
            _return_freed()

    return task


def _returned_between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch
        del batch
        _return_freed()


def _return_freed() -> None:
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc alone
        trim(0)


def kept_rows(batch: pa.RecordBatch, keep: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of batch that keep marks, in order, in pieces cut from about `limit` bytes of text each, or from one row.

    A worker that returns whole batches holds their texts twice, and so does the JVM that reads them."""
    piece = np.cumsum(pc.binary_length(batch["text"]).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) // limit
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(piece)) + 1, [batch.num_rows]))
    for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if keep[low:high].any():
            yield batch.slice(low, high - low).filter(pa.array(keep[low:high]))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
