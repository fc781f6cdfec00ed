"""Shard planning (PLAN1-PLAN3, LIM1, AGG26)."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from weft.functions.hashing import uniform
from weft.operators.digests import ordered_digest
from weft.storage import materialize


def range_bounds(total: Column, shard: Column, shards: int) -> tuple[Column, Column]:
    """[low, high) of a contiguous shard."""
    at = lambda k: F.floor(total * k / shards).cast("long")
    return at(shard), at(shard + 1)


def range_shard(index: Column, total: Column | int, shards: int) -> Column:
    """The contiguous shard that holds an index: no range join is needed."""
    total = F.lit(total) if isinstance(total, int) else total
    return F.floor(((index + 1) * shards - 1) / total).cast("int")


def weight(duration: Column, transcript: Column) -> Column:
    """A record's load: its duration if there is one, else its length, at least 1."""
    return F.when(duration.isNotNull() & (duration != 0), duration).otherwise(F.greatest(F.length(F.coalesce(transcript, F.lit(""))), F.lit(1)).cast("double"))


def balanced_plan(records: DataFrame, shards: int) -> DataFrame:
    """Longest first onto the least loaded shard, ties to the lowest: (shard_index, record_index, load).

    records: record_index, id, load. The rule is sequential, so the three columns meet in one group; texts and
    audio never do. `plan_groups` splits a larger manifest before it comes here."""
    if shards < 1:
        raise ValueError("a plan needs one shard at least")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        if len(part) < shards:
            raise ValueError("shards cannot exceed records")
        part = part.sort_values(["load", "id"], ascending=[False, True], kind="stable")
        heap, out = [(0.0, k) for k in range(shards)], []
        for load in part["load"]:
            total, k = heapq.heappop(heap)
            out.append(k)
            heapq.heappush(heap, (total + load, k))
        return pd.DataFrame({"shard_index": out, "record_index": part["record_index"].to_numpy(), "load": part["load"].to_numpy()})

    group = records.select(F.lit(0).alias("_g"), "record_index", "id", F.col("load").cast("double").alias("load"))
    return group.groupBy("_g").applyInPandas(run, "shard_index int, record_index long, load double")


def plan_groups(records: DataFrame, shards: int, groups: int) -> DataFrame:
    """The same rule within `groups` parts of the manifest, each with its own stretch of shards, in parallel.

    Parts come from the id's hash; the spread of loads stays below the largest record plus the parts' own spread."""
    if shards % groups:
        raise ValueError("groups must divide shards")
    each = shards // groups

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["load", "id"], ascending=[False, True], kind="stable")
        heap, out = [(0.0, k) for k in range(each)], []
        for load in part["load"]:
            total, k = heapq.heappop(heap)
            out.append(int(key[0]) * each + k)
            heapq.heappush(heap, (total + load, k))
        return pd.DataFrame({"shard_index": out, "record_index": part["record_index"].to_numpy(), "load": part["load"].to_numpy()})

    part = F.floor(uniform(F.col("id"), "plan") * groups).cast("int")
    return records.select(part.alias("_g"), "record_index", "id", F.col("load").cast("double").alias("load")).groupBy("_g").applyInPandas(run, "shard_index int, record_index long, load double")


def plan_loads(plan: DataFrame) -> DataFrame:
    """records, load and digest of the sorted indices (as a compact JSON list) of each shard."""
    loads = plan.groupBy("shard_index").agg(F.count("*").alias("records"), F.sum("load").alias("load"))
    told = ordered_digest(plan, ["shard_index"], ["record_index"], F.col("record_index").cast("string"), ",", "[", "]")
    return loads.join(told.select("shard_index", "digest"), "shard_index")


def chain_of_bins(sizes: np.ndarray, limit: int) -> list[tuple[int, int, int]]:
    """What rows of one key do to the bin that is open before them: (least size entering, size leaving, bins begun), ascending.

    The entering size only decides which row begins the first new bin, and fewer sizes than `limit` tell these rows apart.
    From there on the next beginning is the first row that no longer fits, by search on the sums of sizes. Where no bin is
    begun, what leaves is what enters and the size given."""
    n, sums = len(sizes), np.concatenate(([0], np.cumsum(sizes)))
    filled = np.append(np.flatnonzero(sizes > 0), n)
    filled = filled[np.searchsorted(filled, np.arange(n))]  # a bin is empty up to here
    after = np.maximum(np.searchsorted(sums, sums[:-1] + limit, "right") - 1, filled + 1)
    least = np.maximum(np.maximum(limit + 1 - sums[1:], 1 - sums[:-1]), 0)  # sizes from which on a row doesn't fit; they only fall
    begun: dict[int, tuple[int, int]] = {}  # by a bin's first row: size leaving, bins from this one on

    def follow(row: int) -> tuple[int, int]:
        path = []
        while row < n and row not in begun:
            path.append(row)
            row = int(after[row])
        used, bins = begun[row] if row < n else (int(sums[n] - sums[path[-1]]), 0)
        for at in reversed(path):
            bins += 1
            begun[at] = used, bins
        return used, bins

    first = np.flatnonzero(np.diff(least, prepend=np.iinfo(np.int64).max) < 0)
    out = [(int(least[row]), *follow(row)) for row in first.tolist()]
    return ([] if out and out[-1][0] == 0 else [(0, int(sums[n]), 0)]) + out[::-1]


def bounded_fill(items: DataFrame, limit: int, by: list[str] | None = None) -> DataFrame:
    """A new bin when the current one is not empty and would pass the limit: (key..., bin, place, size).

    items: place and size (whole numbers, not negative) in each key's order; null sizes count as 0. Rows are dealt out by
    ranges of (key, place), so a key may span many tasks. Each range says what it makes of the bin that is open when it
    begins (chain_of_bins); the driver follows these answers from range to range, a few numbers each, and the ranges
    are then filled side by side from their true beginnings."""
    keys = by or []
    kinds = {f.name: f.dataType for f in items.schema.fields}
    rows = items.select(*keys, F.col("place").cast("long").alias("place"), F.coalesce(F.col("size").cast("long"), F.lit(0).cast("long")).alias("size"))
    ranged = rows.repartitionByRange(*keys, "place").sortWithinPartitions(*keys, "place").withColumn("stretch", F.spark_partition_id())
    told = StructType([*ranged.schema.fields, *(StructField(c, LongType()) for c in ("row", "kind", "entering", "used", "bins"))])

    def names_of(batch: pa.RecordBatch) -> list[tuple]:
        return list(zip(*(batch[k].to_pylist() for k in keys), strict=True)) if keys else [()] * batch.num_rows

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows (kind 0), then the chains of the range's first (kind 1) and last key (kind 2)."""
        ends: list[list] = []  # the first and the last key: their value, their rows' sizes
        seen, batch = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            nothing = pa.nulls(batch.num_rows, pa.int64())
            number = pa.array(np.arange(seen, seen + batch.num_rows))
            yield pa.record_batch([*batch.columns, number, pa.array(np.zeros(batch.num_rows, np.int64)), nothing, nothing, nothing], names=told.names)
            seen += batch.num_rows
            sizes, names = batch["size"].to_numpy(), names_of(batch)
            cuts = [0, *(k for k in range(1, len(names)) if names[k] != names[k - 1]), len(names)]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                if ends and ends[-1][0] == names[low]:
                    ends[-1][1].append(sizes[low:high])
                else:
                    ends = [*ends[:1], [names[low], [sizes[low:high]]]]
        for kind, (name, parts) in enumerate(ends, 1):
            chain = chain_of_bins(np.concatenate(parts), limit)
            fixed = [pa.array([v] * len(chain), batch.schema.field(k).type) for k, v in zip(keys, name, strict=True)]
            stretch = pa.array([batch["stretch"][0].as_py()] * len(chain), pa.int32())
            zero = pa.array([0] * len(chain), pa.int64())
            yield pa.record_batch([*fixed, zero, zero, stretch, zero, pa.array([kind] * len(chain), pa.int64()), *(pa.array(c, pa.int64()) for c in zip(*chain, strict=True))], names=told.names)

    table = materialize(ranged.mapInArrow(survey, told), "bins")
    chains: dict[int, dict[int, list]] = {}
    for r in table.where("kind > 0").orderBy("stretch", "kind", "entering").collect():
        chains.setdefault(r["stretch"], {}).setdefault(r["kind"], []).append(r)
    begins, key, used, number = [], None, 0, 0
    for stretch, found in sorted(chains.items()):
        name = tuple(found[1][0][k] for k in keys)
        used, number = (used, number) if name == key else (0, 0)
        begins.append((stretch, used, number))
        last = found.get(2, found[1])
        used, number = (0, 0) if 2 in found else (used, number)
        step = [r for r in last if r["entering"] <= used][-1]
        used, number = step["used"] + (0 if step["bins"] else used), number + step["bins"]
        key = tuple(last[0][k] for k in keys)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretch, key, number, used = None, None, 0, 0
        for batch in batches:
            bins, names = [], names_of(batch)
            for name, size, place, first in zip(names, *(batch[c].to_pylist() for c in ("size", "stretch", "first")), strict=True):
                if place != stretch:
                    stretch, key, used, number = place, name, first["used"], first["number"]
                elif name != key:
                    key, number, used = name, 0, 0
                if used > 0 and used + size > limit:
                    number, used = number + 1, 0
                used += size
                bins.append(number)
            yield pa.record_batch([*(batch[k] for k in keys), pa.array(bins, pa.int32()), batch["place"], batch["size"]], names=[*keys, "bin", "place", "size"])

    first = items.sparkSession.createDataFrame(begins, "stretch int, used long, number long").select("stretch", F.struct("used", "number").alias("first"))
    rows = table.where("kind = 0").select(*keys, "place", "size", "stretch", "row").join(F.broadcast(first), "stretch")  # one row a range
    schema = ", ".join([*(f"`{k}` {kinds[k].simpleString()}" for k in keys), "bin int, place long, size long"])
    return rows.repartition("stretch").sortWithinPartitions("stretch", "row").mapInArrow(fill, schema)


def write_plan(plan: DataFrame, path: str, manifest: str, digest: str, records: int) -> None:
    """A plan as JSON lines (V15): one line a shard (index, record_indices ascending, estimated_load) and one with the
    manifest's path, digest and count. Indices of one shard meet in one row, as a shard's reader takes them."""
    shard = plan.groupBy(F.col("shard_index").alias("index")).agg(F.array_sort(F.collect_list("record_index")).alias("record_indices"), F.sum("load").alias("estimated_load"))
    shard.repartitionByRange("index").sortWithinPartitions("index").write.mode("errorifexists").json(path)
    told = {"format_version": 1, "manifest": manifest, "manifest_sha256": digest, "num_records": records}
    plan.sparkSession.createDataFrame([tuple(told.values())], "format_version int, manifest string, manifest_sha256 string, num_records long").coalesce(1).write.mode("errorifexists").json(f"{path}.meta")


def planned_records(spark: SparkSession, path: str, manifest: str, digest: str, shard: int) -> DataFrame:
    """record_index of one shard of a written plan. A plan of another manifest, of one that has changed since, a shard
    outside the plan or listed twice is refused."""
    told = spark.read.json(f"{path}.meta").first()
    if told["manifest"] != manifest:
        raise ValueError("the plan was made for a different manifest")
    if told["manifest_sha256"] != digest:
        raise ValueError("the manifest has changed since the plan was made")
    rows = spark.read.schema("index int, record_indices array<long>, estimated_load double").json(path).where(F.col("index") == shard)
    n = rows.count()
    if n != 1:
        raise ValueError(f"shard {shard} is outside the plan" if n == 0 else "malformed plan")
    return rows.select(F.explode("record_indices").alias("record_index"))
