"""Run-length collapse, delays, masks and segments (SEQ1-SEQ3, SEQ13-SEQ15, W1-W9, ARR1, AGG6)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from weft.functions.numeric import bind, run_starts
from weft.operators.ordering import running


def collapse(codes: Column, end: Column) -> Column:
    """struct(codes, frame_to_code): runs of equal entries merged after one end entry; the run of every entry.

    Arrays stay arrays: a sample's frames never become rows."""

    def shape(whole: Column, at: Column) -> Column:
        numbers = F.transform(at, lambda s, k: F.array_repeat(k, F.coalesce(F.get(at, k + 1), F.size(whole)) - s))
        return F.struct(F.transform(at, lambda s: F.get(whole, s)).alias("codes"), F.flatten(numbers).alias("frame_to_code"))

    return bind(F.concat(codes, F.array(end)), lambda whole: bind(run_starts(whole), lambda at: shape(whole, at)))


def frame_runs(frames: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Long form: frame and run number of each row (W2, W3)."""
    at = Window.partitionBy(*keys).orderBy(*order)
    changed = F.when(F.lag(value).over(at).eqNullSafe(F.col(value)) & (F.row_number().over(at) > 1), 0).otherwise(1)
    marked = frames.withColumn("frame", (F.row_number().over(at) - 1).cast("long")).withColumn("__new", changed)
    return marked.withColumn("run", (F.sum("__new").over(Window.partitionBy(*keys).orderBy("frame")) - 1).cast("long")).drop("__new")


def with_end(frames: DataFrame, keys: list[str], order: str, value: str, end: int) -> DataFrame:
    """One row more for each key: the end code after the last frame."""
    last = frames.groupBy(*keys).agg((F.max(order) + 1).alias(order)).withColumn(value, F.lit(end).cast(frames.schema[value].dataType))
    return frames.select(*keys, order, value).unionByName(last.select(*keys, order, value))


def run_lengths(runs: DataFrame, keys: list[str], value: str) -> DataFrame:
    return runs.groupBy(*keys, "run").agg(F.first(value).alias(value), F.count("*").alias("n"))


def collapse_boundary(prompt: Column, continuation: Column) -> Column:
    """The continuation without its first entry where that repeats the prompt's last."""
    same = F.try_element_at(prompt, F.lit(-1)) == F.try_element_at(continuation, F.lit(1))
    both = (F.size(prompt) > 0) & (F.size(continuation) > 0)
    return F.when(both & F.coalesce(same, F.lit(False)), F.slice(continuation, 2, F.greatest(F.size(continuation) - 1, F.lit(1)))).otherwise(continuation)


def delay(value: Column, steps: int, fill: Column, keys: list[str], order: str) -> Column:
    """The value `steps` positions before, or the fill (SEQ13, W6)."""
    at = Window.partitionBy(*keys).orderBy(order)
    return F.lag(value, steps).over(at) if fill is None else F.when(F.row_number().over(at) > steps, F.lag(value, steps).over(at)).otherwise(fill)


def undelay(value: Column, steps: int, keys: list[str], order: str) -> Column:
    return F.lead(value, steps).over(Window.partitionBy(*keys).orderBy(order))


def segments(mask: Column, keys: list[str], order: str) -> Column:
    """Number of the contiguous segment of true rows, -1 outside (W4)."""
    at = Window.partitionBy(*keys).orderBy(order)
    starts = F.when(mask & ~F.coalesce(F.lag(mask).over(at), F.lit(False)), 1).otherwise(0)
    return F.struct(mask.alias("inside"), starts.alias("starts"))


def segment_ids(df: DataFrame, mask: str, keys: list[str], order: str) -> DataFrame:
    marked = df.withColumn("__s", segments(F.col(mask), keys, order))
    number = F.sum("__s.starts").over(Window.partitionBy(*keys).orderBy(order)) - 1
    return marked.withColumn("segment", F.when(F.col("__s.inside"), number).otherwise(-1).cast("long")).drop("__s")


def causal_pairs(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Pairs (row, column) of one segment with column <= row (W5, SEQ15), as counts a row: visible positions.

    A row sees the rows of its segment up to itself, so the count is its rank there; no pair is made."""
    at = Window.partitionBy(*keys, "segment").orderBy(order)
    return df.withColumn("visible", F.row_number().over(at).cast("long"))


def masks_to_targets(df: DataFrame, keys: list[str], order: str, tokens: list[str], masks: list[str]) -> DataFrame:
    """Inputs and the next row's tokens and prediction masks; the last row has no target and goes (W8, SEQ18)."""
    at = Window.partitionBy(*keys).orderBy(order)
    shifted = df.select("*", *(F.lead(c).over(at).alias(f"target_{c}") for c in tokens), *(F.lead(c).over(at).alias(f"next_{c}") for c in masks), F.lead(order).over(at).alias("__next"))
    return shifted.where("__next is not null").drop("__next")


def offsets(df: DataFrame, keys: list[str], order: str, length: str) -> DataFrame:
    """Start of each row in its key's flat column: the running sum of the lengths before (W1).

    Sums run over ranges of (key, order), so a key may span many tasks; a key's own start is taken off, one row a key."""
    summed = running(df, [*keys, order], {"__before": F.col(length)})
    starts = summed.groupBy(*keys).agg(F.min("__before").alias("__start"))
    return summed.join(starts, keys).select(*df.columns, (F.col("__before") - F.col("__start")).cast("long").alias("offset"))


class ExpandRuns:
    """The table function expand_runs(TABLE(runs) PARTITION BY key ORDER BY place) of SQL (SEQ2, ARR1).

    runs: any columns and a whole `duration`; the result has the columns but duration and `frame`, the place from 0 on among all
    frames of the partition. A null duration is 0, a negative one an error."""

    def __init__(self):
        self.frame = 0

    @staticmethod
    def analyze(runs: AnalyzeArgument) -> AnalyzeResult:
        if not runs.isTable or "duration" not in runs.dataType.names:
            raise ValueError("expand_runs needs a table with a column duration")
        if not isinstance(runs.dataType["duration"].dataType, (IntegerType, LongType)):
            raise ValueError("duration must be a whole number")
        if "frame" in runs.dataType.names:
            raise ValueError("expand_runs adds a column frame")
        kept = [f for f in runs.dataType.fields if f.name != "duration"]
        return AnalyzeResult(StructType([*kept, StructField("frame", LongType())]))

    def eval(self, runs: Row) -> Iterator[tuple]:
        kept = tuple(v for k, v in runs.asDict().items() if k != "duration")
        times = runs["duration"] or 0
        if times < 0:
            raise ValueError("a duration must not be negative")
        for _ in range(times):
            yield *kept, self.frame
            self.frame += 1


def register_functions(spark: SparkSession) -> None:
    """Make the table functions known to spark.sql."""
    spark.udtf.register("expand_runs", F.udtf(ExpandRuns))
