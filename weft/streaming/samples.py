"""Endless, resumable sample streams (STM1-STM4, UDF3): a streaming source whose offset is the sample index.

A sample is a pure function of (seed, rank, index), so the source only hands out ranges of sample numbers;
layouts are built from the numbers in each micro-batch by the same plans as in batch jobs. A checkpointed
query resumes at the next index, and neither triggers nor partitions change what a sample holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


class SampleReader(SimpleDataSourceStreamReader):
    """Ranges [low, high) of the next samplesPerTrigger numbers: in as many rows as `pieces`, or with `workers` one row a worker,
    whose numbers stride (start + worker, step workers). With `worker`, that one's alone. The offset is the number that
    all workers have reached, so a run may be resumed with another number of them."""

    def __init__(self, options: dict[str, str]):
        self.start = int(options.get("start", "0"))
        self.stop = int(options["stop"]) if "stop" in options else None
        self.per_batch = int(options.get("samplesPerTrigger", "1024"))
        self.pieces = int(options.get("pieces", "8"))
        self.workers = int(options.get("workers", "1"))
        self.worker = int(options["worker"]) if "worker" in options else None
        if self.workers < 1 or (self.worker is not None and not 0 <= self.worker < self.workers):
            raise ValueError("workers must be positive and a worker one of them")

    def initialOffset(self) -> dict:
        return {"index": self.start}

    def _ranges(self, low: int, high: int) -> Iterator[tuple[int, int, int]]:
        if self.workers > 1:
            chosen = range(self.workers) if self.worker is None else [self.worker]
            firsts = [low + (w - (low - self.start)) % self.workers for w in chosen]
            return iter([(first, high, self.workers) for first in firsts if first < high])
        n = max(1, min(self.pieces, high - low))
        cuts = [low + (high - low) * k // n for k in range(n + 1)]
        return iter([(a, b, 1) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a])

    def read(self, start: dict) -> tuple[Iterator[tuple[int, int, int]], dict]:
        low = start["index"]
        high = low + self.per_batch if self.stop is None else max(low, min(low + self.per_batch, self.stop))
        return self._ranges(low, high), {"index": high}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple[int, int, int]]:
        return self._ranges(start["index"], end["index"])

    def commit(self, end: dict) -> None:
        """Nothing is kept: numbers can be handed out again at any time."""


class SampleRangeSource(DataSource):
    """Format `sample_ranges`: options start, stop, samplesPerTrigger, and pieces or workers and worker."""

    @classmethod
    def name(cls) -> str:
        return "sample_ranges"

    def schema(self) -> str:
        return "low long, high long, step long"

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return SampleReader(self.options)


def sample_stream(spark: SparkSession, **options: int) -> DataFrame:
    """Streaming sample numbers."""
    spark.dataSource.register(SampleRangeSource)
    reader = spark.readStream.format("sample_ranges")
    for key, value in options.items():
        reader = reader.option(key, str(value))
    return reader.load().select(F.explode(F.sequence("low", F.col("high") - 1, "step")).alias("sample_index"))


def write_samples(indices: DataFrame, layout: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, **trigger: bool | str) -> StreamingQuery:
    """Build the layout of each micro-batch's samples and write it under the batch's number: a repeated batch replaces itself."""

    def sink(batch: DataFrame, number: int) -> None:
        layout(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return indices.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "0 seconds"})).start()
