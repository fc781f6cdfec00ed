"""Sharding by global byte-size prefix sums.

Documents are ordered by doc_id (nulls first; ties by content) with a range partitioning, so every
partition holds a stretch of the order. Sums run inside each stretch, the stretches' totals (one row a
partition) are summed up on the driver and added back. The shard of a document is the equal target its middle
byte falls in: shards are contiguous and differ by no more than about one document. Only ids, sizes and
checksums are shuffled, never texts.

Defined cases: a null text has no bytes (its size is the overhead alone) and checksum 0; repeated rows are
rows of their own, in an order that only their content fixes; an id that holds many rows is cut like any
other stretch, since the order goes on by size, checksum and source position; a very long text is one
size like any other, texts never move; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from weft.llm.common import materialize

SHARDS = 40
OVERHEAD = 16


def shards(docs: DataFrame, count: int = SHARDS, overhead: int = OVERHEAD) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("at"))
    order = ["doc_id", "size", "text_crc32", "at"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    stretched = materialize(ranged.withColumn("stretch", F.spark_partition_id()), "stretches")
    totals = stretched.groupBy("stretch").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).orderBy("stretch").collect()  # one row a partition
    before, rows_before, sums = 0, 0, []
    for r in totals:
        sums.append((r["stretch"], before, rows_before))
        before, rows_before = before + r["bytes"], rows_before + r["rows"]
    schema = "stretch int, bytes_before long, rows_before long"
    offsets = docs.sparkSession.createDataFrame(sums, schema)
    inside = Window.partitionBy("stretch").orderBy(*order)
    placed = stretched.select("*", (F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("begin"), (F.row_number().over(inside) - 1).alias("row"))
    placed = placed.join(F.broadcast(offsets), "stretch")  # one row a partition
    begin = F.col("begin") + F.col("bytes_before")
    middle = (begin.cast("decimal(38,0)") * 2 + F.col("size")) * count  # counted in half bytes
    shard = F.least(F.floor(middle / F.lit(2 * max(1, before))).cast("int"), F.lit(count - 1))
    cut = materialize(placed.select("doc_id", "size", "text_crc32", shard.alias("shard"), (F.col("row") + F.col("rows_before")).alias("row")), "shards")
    firsts = cut.groupBy("shard").agg(F.min("row").alias("first"))  # `count` rows at most
    return cut.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first")).cast("long").alias("slot"))
