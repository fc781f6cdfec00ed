"""Global order without a global window: numbers, running sums and neighbours by ranges of the order.

Rows are dealt out by ranges of the order, sorted inside and written once, with each row's place in its range. Totals of
the ranges, one row a partition, pass through the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType, StructField, StructType

from weft.storage import materialize

_ROW = (1 << 33) - 1  # the bits of monotonically_increasing_id() that count a partition's rows


def _ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """df in order, with its stretch (range) and place (row of the stretch)."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.withColumn("stretch", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW)))


def running(df: DataFrame, order: list[str], sums: dict[str, Column] | None = None) -> DataFrame:
    """df with a column number (0 and up, in the given order) and, for each entry of sums, its total over the rows before.

    Numbers need no second shuffle; sums are windows over the stretches. Longs are summed as longs, all else as doubles.
    df must not have columns named number, stretch, place or like an entry of sums."""
    whole = (ByteType, ShortType, IntegerType, LongType)
    kinds = {k: "long" if isinstance(df.select(c.alias("x")).schema["x"].dataType, whole) else "double" for k, c in (sums or {}).items()}
    sums = {k: F.coalesce(c.cast(kinds[k]), F.lit(0).cast(kinds[k])) for k, c in (sums or {}).items()}
    ranged = materialize(_ranged(df, order), "ranged")
    totals = ranged.groupBy("stretch").agg(F.count("*").alias("number"), *(F.sum(c).alias(k) for k, c in sums.items())).orderBy("stretch").collect()
    before, offsets = [0, *(0.0 if kinds[k] == "double" else 0 for k in sums)], []
    for r in totals:
        offsets.append((r["stretch"], *before))
        before = [a + r[k] for a, k in zip(before, ["number", *sums], strict=True)]
    table = df.sparkSession.createDataFrame(offsets, ", ".join(["stretch int, number_before long", *(f"{k}_before {kinds[k]}" for k in sums)]))
    inside = Window.partitionBy("stretch").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(table), "stretch")  # one row a partition
    own = {k: F.coalesce(F.sum(c).over(inside), F.lit(0).cast(kinds[k])) for k, c in sums.items()}
    return out.select(*df.columns, (F.col("place") + F.col("number_before")).alias("number"), *((c + F.col(f"{k}_before")).alias(k) for k, c in own.items()))


def _shifted(value: str, name: str):
    """Each row with the next row's value inside its partition; the partition's last row with none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                yield held.append_column(name, pa.concat_arrays([held[value].slice(1), batch[value].slice(0, 1)]))
            held = batch
        if held is not None:
            yield held.append_column(name, pa.concat_arrays([held[value].slice(1), pa.nulls(1, held[value].type)]))

    return run


def next_in_order(df: DataFrame, order: str, value: str) -> DataFrame:
    """df with next_<value>: that of the following row in the order; the last row gets the first row's.

    A stretch's last row takes the first value of the stretch behind it: one row a stretch goes through the driver."""
    name = f"next_{value}"
    ranged = _ranged(df, [order])
    kind = df.schema[value].dataType
    shape = StructType([*ranged.schema.fields, StructField(name, kind)])
    table = materialize(ranged.mapInArrow(_shifted(value, name), shape), "shifted")
    ends = table.groupBy("stretch").agg(F.min_by(value, "place").alias("first"), F.max("place").alias("last")).orderBy("stretch").collect()
    border = [(r["stretch"], r["last"], after["first"]) for r, after in zip(ends, [*ends[1:], *ends[:1]], strict=True)]
    kinds = StructType([StructField("stretch", IntegerType()), StructField("last_place", LongType()), StructField("border", kind)])
    out = table.join(F.broadcast(df.sparkSession.createDataFrame(border, kinds)), "stretch")  # one row a partition
    return out.select(*df.columns, F.when(F.col("place") == F.col("last_place"), F.col("border")).otherwise(F.col(name)).alias(name))
