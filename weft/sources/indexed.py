"""Line files with a byte-offset index: seek reads, line numbers and digests (SNK1, SRC5, J2, V9, AGG24, AGG25).

`PATH.idx` holds the offset at which each line of PATH begins, as 64-bit numbers in order. Writing, indexing and reading
work on ranges side by side, each task on its own bytes of a folder that all executors mount; other stores have no seek
for Python tasks, so there Spark's own readers are used (number_lines, file_digests).
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from weft.operators.ordering import running

#: The index's suffix and number type.
SUFFIX, OFFSET = ".idx", "<u8"
RANGE_BYTES = 64 << 20
CHUNK = 8 << 20
_ROW = (1 << 33) - 1


def mounted(path: str) -> str | None:
    """The file system's path, where tasks can open it."""
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    return None if "://" in path else path


def number_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of a text file in file order, on any store. Lines are counted for each block that Spark splits the file into;
    a line's number is its block's base and its place there. One row a block is sent to all tasks."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW)).alias("row"))
    blocks = lines.groupBy("file", "block").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = blocks.select("file", "block", (before - F.col("first")).alias("base"))
    # a column that is not deterministic keeps checks of values from moving below, before a filter on numbers
    barrier = F.when(F.monotonically_increasing_id() >= 0, F.col("value"))
    return lines.join(F.broadcast(base), ["file", "block"]).select((F.col("base") + F.col("row")).alias("line"), barrier.alias("value"))


# writing


def _put(descriptor: int, content: bytes, offset: int) -> None:
    while content:
        n = os.pwrite(descriptor, content, offset)
        content, offset = content[n:], offset + n


def write_lines(lines: DataFrame, path: str) -> None:
    """lines (record_index, value) in order as PATH and its index. Tasks write their bytes at their places of a file aside, so a
    repeated task writes the same again; both files are then renamed, the index last."""
    at = mounted(path)
    if at is None:
        raise ValueError("an indexed file needs a folder that all executors mount")
    if os.path.exists(at):
        raise FileExistsError(at)
    rows = running(lines.select("record_index", F.coalesce("value", F.lit("")).alias("value")), ["record_index"], {"offset": (F.octet_length("value") + 1).cast("long")})
    count, size = rows.agg(F.count("*"), F.coalesce(F.max(F.col("offset") + F.octet_length("value") + 1), F.lit(0))).first()
    os.makedirs(os.path.dirname(at) or ".", exist_ok=True)
    aside = f"{at}.{uuid.uuid4().hex}.tmp"
    for name, length in ((aside, size), (aside + SUFFIX, 8 * count)):
        with open(name, "wb") as f:
            f.truncate(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = [os.open(name, os.O_WRONLY) for name in (aside, aside + SUFFIX)]
        n = 0
        try:
            for batch in batches:
                number, offset = batch["number"].to_numpy(), batch["offset"].to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(number) != 1) + 1).tolist(), len(number)]
                bodies = batch["value"].to_pylist()
                for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                    if low < high:
                        _put(files[0], "".join(f"{b}\n" for b in bodies[low:high]).encode(), int(offset[low]))
                        _put(files[1], offset[low:high].astype(OFFSET).tobytes(), 8 * int(number[low]))
                n += len(number)
        finally:
            for f in files:
                os.close(f)
        yield pa.record_batch({"n": pa.array([n])})

    try:
        rows.select("number", "offset", "value").mapInArrow(run, "n long").agg(F.sum("n")).collect()
        os.replace(aside, at)
        os.replace(aside + SUFFIX, at + SUFFIX)
    finally:
        for name in (aside, aside + SUFFIX):
            if os.path.exists(name):
                os.unlink(name)


def _line_starts(path: str, low: int, high: int) -> Iterator[np.ndarray]:
    """Offsets in [low, high) at which a line begins, in chunks."""
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        f.seek(max(low - 1, 0))
        if low == 0 and size:
            yield np.zeros(1, np.int64)
        at = max(low - 1, 0)
        while at < high - 1 and (body := f.read(min(CHUNK, high - 1 - at))):
            found = np.flatnonzero(np.frombuffer(body, np.uint8) == 10) + at + 1
            yield found[found < size]
            at += len(body)


def build_index(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> int:
    """Write the index of a file made elsewhere: ranges are counted, then written at their places. Returns the number of lines."""
    at = mounted(path)
    size = os.path.getsize(at)
    n = max(1, -(-size // range_bytes))
    aside = f"{at}{SUFFIX}.{uuid.uuid4().hex}.tmp"
    ranges = spark.range(0, n, 1, min(n, 4 * spark.sparkContext.defaultParallelism)).select("id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [sum(map(len, _line_starts(at, k * range_bytes, min(size, (k + 1) * range_bytes)))) for k in batch["id"].to_pylist()]
            yield pa.record_batch({"id": batch["id"], "n": pa.array(held, pa.int64())})

    counts = [r["n"] for r in ranges.mapInArrow(count, "id long, n long").orderBy("id").collect()]  # one row a range
    before = np.concatenate(([0], np.cumsum(counts))).tolist()
    with open(aside, "wb") as f:
        f.truncate(8 * before[-1])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = os.open(aside, os.O_WRONLY)
        try:
            for batch in batches:
                for k in batch["id"].to_pylist():
                    place = before[k]
                    for found in _line_starts(at, k * range_bytes, min(size, (k + 1) * range_bytes)):
                        _put(f, found.astype(OFFSET).tobytes(), 8 * place)
                        place += len(found)
                yield batch
        finally:
            os.close(f)

    ranges.mapInArrow(write, "id long").agg(F.count("*")).collect()
    os.replace(aside, at + SUFFIX)
    return before[-1]


# reading


class Lines:
    """A file and its index, opened for seeks; `read_bytes` counts what was read of the file."""

    def __init__(self, path: str):
        self.path, self.size, self.read_bytes = path, os.path.getsize(path), 0
        self.offsets = np.memmap(path + SUFFIX, OFFSET, "r") if os.path.getsize(path + SUFFIX) else np.zeros(0, OFFSET)

    def __len__(self) -> int:
        return len(self.offsets)

    def end(self, index: int) -> int:
        return int(self.offsets[index + 1]) if index + 1 < len(self) else self.size

    def runs(self, wanted: Iterable[int]) -> list[tuple[int, int]]:
        """Ascending runs (first, last) of neighbours among the wanted lines; an index that is not there is an error."""
        out: list[list[int]] = []
        for index in sorted(set(wanted)):
            if not 0 <= index < len(self):
                raise IndexError(f"record index out of range: {index}")
            if out and out[-1][1] + 1 == index:
                out[-1][1] = index
            else:
                out.append([index, index])
        return [tuple(x) for x in out]

    def read(self, runs: Iterable[tuple[int, int]]) -> Iterator[tuple[int, str]]:
        """(index, line) of runs of lines, in chunks of whole lines."""
        with open(self.path, "rb") as f:
            for first, last in runs:
                while first <= last:
                    low = int(self.offsets[first])
                    stop = max(first + 1, min(last + 1, int(np.searchsorted(self.offsets, low + CHUNK, "right")) - 1))
                    f.seek(low)
                    body = f.read(self.end(stop - 1) - low)
                    self.read_bytes += len(body)
                    starts = self.offsets[first:stop].astype(np.int64) - low
                    for k, (a, b) in enumerate(zip(starts.tolist(), [*starts[1:].tolist(), len(body)], strict=True)):
                        yield first + k, body[a:b].rstrip(b"\r\n").decode()
                    first = stop


def seek_lines(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(place, record_index, value) of the wanted lines (place, record_index): tasks take stretches of the index and read those lines'
    bytes only. An index that is not there is an error."""
    at = mounted(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = Lines(at)
        for batch in batches:
            asked = batch["record_index"].to_pylist()
            held = dict(lines.read(lines.runs(asked)))
            yield pa.record_batch({"place": batch["place"], "record_index": batch["record_index"], "value": pa.array([held[k] for k in asked], pa.string())})

    rows = wanted.select(F.col("place").cast("long").alias("place"), F.col("record_index").cast("long").alias("record_index"))
    return rows.repartitionByRange("record_index").sortWithinPartitions("record_index").mapInArrow(run, "place long, record_index long, value string")


class _Runs(InputPartition):
    def __init__(self, runs: list[tuple[int, int]]):
        self.runs = runs


class _Reader(DataSourceReader):
    """Partitions are byte ranges of the file; filters on record_index choose lines before any byte is read."""

    def __init__(self, options: dict[str, str]):
        self.path, self.step = mounted(options["path"]), int(options.get("rangebytes", options.get("rangeBytes", RANGE_BYTES)))
        self.low, self.high, self.chosen = 0, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            value = getattr(f, "value", None)
            if getattr(f, "attribute", None) != ("record_index",) or value is None or (isinstance(f, In) and None in value):
                yield f
            elif isinstance(f, (EqualTo, In)):
                named = set(value) if isinstance(f, In) else {value}
                self.chosen = named if self.chosen is None else self.chosen & named
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, value + isinstance(f, GreaterThan))
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                last = value + isinstance(f, LessThanOrEqual)
                self.high = last if self.high is None else min(self.high, last)
            else:
                yield f

    def partitions(self) -> list[_Runs]:
        lines = Lines(self.path)
        high = len(lines) if self.high is None else min(self.high, len(lines))
        runs = [(self.low, high - 1)] if self.low < high else []
        if self.chosen is not None:
            runs = lines.runs(k for k in self.chosen if self.low <= k < high)
        out, held, size = [], [], 0
        for first, last in runs:
            while first <= last:
                room = int(lines.offsets[first]) + self.step - size
                stop = max(first + 1, min(last + 1, int(np.searchsorted(lines.offsets, room, "right")) - 1))
                if held and size + lines.end(stop - 1) - int(lines.offsets[first]) > self.step:
                    out, held, size = [*out, _Runs(held)], [], 0
                    continue
                held.append((first, stop - 1))
                size += lines.end(stop - 1) - int(lines.offsets[first])
                first = stop
        return [*out, _Runs(held)] if held else out or [_Runs([])]

    def read(self, partition: _Runs) -> Iterator[tuple[int, str]]:
        yield from Lines(self.path).read(partition.runs)


class IndexedLineSource(DataSource):
    """Format `indexed_lines`: options path, rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "indexed_lines"

    def schema(self) -> str:
        return "record_index long, value string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)


def read_lines(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(record_index, value) of an indexed file; filters on record_index reach the file."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(IndexedLineSource)
    return spark.read.format("indexed_lines").option("path", path).option("rangeBytes", range_bytes).load()


def index_table(spark: SparkSession, path: str, step: int = 1 << 20) -> DataFrame:
    """(record_index, offset, length) of every line, read from the index in stretches of `step` numbers."""
    at = mounted(path)
    n = -(-os.path.getsize(at + SUFFIX) // (8 * step))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = Lines(at)
        for batch in batches:
            for k in batch["id"].to_pylist():
                offset = lines.offsets[k * step : (k + 1) * step].astype(np.int64)
                after = np.append(offset[1:], lines.end(k * step + len(offset) - 1))
                yield pa.record_batch({"record_index": pa.array(np.arange(k * step, k * step + len(offset))), "offset": pa.array(offset), "length": pa.array(after - offset)})

    return spark.range(0, n, 1, max(1, min(n, 4 * spark.sparkContext.defaultParallelism))).select("id").mapInArrow(run, "record_index long, offset long, length long")


# digests


def chunked_digest(paths: Iterable[str], chunk: int = CHUNK) -> tuple[str, int]:
    """SHA-256 and length of files one after another."""
    state, size = hashlib.sha256(), 0
    for path in paths:
        with open(path, "rb") as f:
            while body := f.read(chunk):
                state.update(body)
                size += len(body)
    return state.hexdigest(), size


def file_digests(spark: SparkSession, paths: list[str], chunk: int = CHUNK) -> DataFrame:
    """path, sha256 and length of files (V9, AGG24), read in chunks side by side; a file is one sequence, so one task reads it.

    Files that tasks cannot open go through Spark's own reader, which takes 2 GB at most."""
    files = spark.read.format("binaryFile").load(paths)
    if any(mounted(p) is None for p in paths):
        return files.select("path", F.sha2("content", 256).alias("sha256"), "length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["path"].to_pylist():
                digest, size = chunked_digest([mounted(path)], chunk)
                yield pa.record_batch({"path": pa.array([path]), "sha256": pa.array([digest]), "length": pa.array([size])})

    named = files.select("path")
    return named.repartition("path").mapInArrow(run, "path string, sha256 string, length long")


def indexed_digest(spark: SparkSession, path: str, chunk: int = CHUNK) -> str:
    """SHA-256 of a file and, where there is one, of its index (AGG25), read by one task in chunks."""
    at = mounted(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["path"].to_pylist():
                yield pa.record_batch({"digest": pa.array([chunked_digest([p for p in (path, path + SUFFIX) if os.path.exists(p)], chunk)[0]])})

    return spark.createDataFrame([(at,)], "path string").coalesce(1).mapInArrow(run, "digest string").first()[0]
