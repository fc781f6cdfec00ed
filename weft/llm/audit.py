"""Audit of a chain of filters: what each one removes at each step of every order, by one incidence matrix product.

A document's failed filters are the bits of a mask (the first filter is bit 0), so each part of the table comes down to
three histograms of 2**k masks: of all its documents, of those labelled good and of those labelled toxic. The
histograms are stacked as rows and multiplied by integer matrices with a row for each mask and a column for each step
of each order (32 by 600 for five filters): 1 where the mask's documents are kept, removed, removed before, or fail
the step's filter alone. Only masks, ids and digests of texts are shuffled; counts are combined before they move.

A copy is known by the SHA-256 of its text. Of each text the rows with the smallest id pass, all others fail, so the
histogram of the copies is that of all rows less that of the first ones; no group of copies meets in one task.

Defined cases: a null text is an empty one, a null part the empty string; a null id is neither larger nor smaller than
another, so its row is never a copy, nor does it make copies, and it has no labels; repeated rows with equal ids are
first rows together; a label counts where any of an id's rows has it; a text of any length is one row, judged
whole; an empty table gives an empty result; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from weft.llm.common import WORD, materialize

LETTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 50, 65, 5
MARKS = "[#$%&*|]"
PARTS_AT_ONCE = 64
SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_failures(text: Column) -> list[Column]:
    """Whether a text fails each of the filters that look at it alone: A to D."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return [
        F.size(words) < MIN_WORDS,
        100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * F.size(words),
        100 * F.regexp_count(text, F.lit("[A-Z]")) > CAPITAL_PERCENT * F.length(text),
        text.rlike(MARKS),
    ]


def mask_of(failures: list[Column]) -> Column:
    return sum((f.cast("int") * (1 << k) for k, f in enumerate(failures)), F.lit(0))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows (doc_id, ...) with the booleans good and toxic; rows without an id are not sent to the join."""
    told = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    known = rows.where("doc_id is not null").join(told, "doc_id", "left").select(*rows.columns, *flags)
    return known.unionByName(rows.where("doc_id is null").select("*", F.lit(False).alias("good"), F.lit(False).alias("toxic")))


def counted(rows: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): the histograms of rows (part, mask, good, toxic)."""
    return rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))


def with_copies(rows: DataFrame, bit: int) -> DataFrame:
    """Histograms of rows (doc_id, digest, part, mask, good, toxic) with the bit of copies set.

    All rows count as copies first; the first rows of each text then move to the mask without the bit."""
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    ahead = counted(rows.join(first, ["digest", "doc_id"], "left_semi").unionByName(rows.where("doc_id is null")))
    copy = F.col("mask") + (1 << bit)
    moved = counted(rows).withColumn("mask", copy).unionByName(ahead).unionByName(ahead.select("part", copy.alias("mask"), *((-F.col(c)).alias(c) for c in ("n", "good", "toxic"))))
    return moved.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))


def orders(letters: str) -> list[str]:
    return ["".join(p) for p in permutations(letters)]


def matrices(letters: str) -> dict[str, np.ndarray]:
    """Integer matrices (2**k masks by k! * k steps): kept, removed, redundant, unique; and shares (steps by filters)."""
    k = len(letters)
    order = np.array([[letters.index(c) for c in o] for o in orders(letters)])
    bits = (np.arange(1 << k)[:, None, None] >> order) & 1  # mask, order, step: whether the step's filter fails
    before = np.cumsum(bits, axis=2) - bits
    out = {"kept": before + bits == 0, "removed": (bits == 1) & (before == 0), "redundant": (bits == 1) & (before > 0), "unique": (bits == 1) & (bits.sum(axis=2, keepdims=True) == 1)}
    return {name: x.reshape(1 << k, -1).astype(np.int64) for name, x in out.items()} | {"shares": (order.reshape(-1, 1) == np.arange(k)).astype(np.int64)}


def _product(letters: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, k = matrices(letters), len(letters)
        names = orders(letters)
        step_filter = m["shares"].argmax(axis=1)
        for batch in batches:
            for low in range(0, batch.num_rows, PARTS_AT_ONCE):
                rows = batch.slice(low, PARTS_AT_ONCE)
                cells = rows["cells"]
                at = np.repeat(np.arange(rows.num_rows), cells.value_lengths().to_numpy())
                flat = cells.flatten()
                mask = flat.field("mask").to_numpy()
                stacked = np.zeros((3, rows.num_rows, 1 << k), np.int64)
                for row, name in enumerate(("n", "good", "toxic")):
                    stacked[row, at, mask] = flat.field(name).to_numpy()
                removed = stacked @ m["removed"]
                shapley = (removed[0] @ m["shares"])[:, step_filter]
                columns = (stacked[0] @ m["kept"], removed[0], stacked[0] @ m["redundant"], stacked[0] @ m["unique"], removed[1], removed[2], shapley)
                n = len(names) * k
                yield pa.record_batch(
                    [
                        rows["part"].take(pa.array(np.repeat(np.arange(rows.num_rows), n))),
                        pa.array(np.tile(np.repeat(names, k), rows.num_rows).tolist(), pa.string()),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows.num_rows * len(names))),
                        *(pa.array(c.ravel()) for c in columns),
                    ],
                    names=[x.split()[0] for x in SCHEMA.split(", ")],
                )

    return run


def outcomes(histograms: DataFrame, letters: str = LETTERS) -> DataFrame:
    """SCHEMA's rows of histograms (part, mask, n, good, toxic), zeros included. A part's row holds 2**k cells at most."""
    cells = histograms.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    return cells.mapInArrow(_product(letters), SCHEMA)


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part (source), order of the five filters and step."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    judged = text.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask_of(text_failures(F.col("text"))).alias("mask"))
    rows = materialize(labelled(materialize(judged, "judged"), labels), "labelled")
    return outcomes(with_copies(rows, LETTERS.index("E")))
