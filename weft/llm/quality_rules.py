"""Quality rules: text counts, then a hashed n-gram logistic regression with calibrated probabilities.

Features are frequencies of hashed word 1- and 2-grams and 3- and 4-grams of code points, each kind
summing to one. A linear score over frequencies is a mean of weights over occurrences, so scoring needs
one table lookup per occurrence and no per-document dictionary.

The model is fitted on a bounded sample of the labelled rows (`sample` rows of each label, those with
the smallest hash of doc_id); whole texts are used. A row reaches the driver as at most BUCKETS pairs of
a bucket and a frequency, whatever its length, 6 bytes each: with the default sample 197 MB at the very
most, some 15 MB for texts of ordinary length. It is written first and read partition by partition, and
held there twice (by row and by bucket). One fifth of the sample is left out of the fit and
calibrates the probability (Platt scaling, weighted to the labels' own ratio).

Defined cases: a null text is an empty one (all counts 0, base_failed); repeated rows each get the same
result; without labels of both kinds the probability is 1 and only the base rules decide; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weft.llm.common import drop, kept_rows, lean, materialize
from weft.llm.kernel import Block, blocks, char_grams, grams, text_facts

BUCKETS = 1 << 14
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
KEEP_PROBABILITY = 0.5
SAMPLE_PER_LABEL = 1000
KINDS = 4

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double"


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float


def occurrences(b: Block, h: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind: (bucket, document) of every occurrence."""
    pairs, at = grams(h, b.doc, 2)
    out = [(h, b.doc), (pairs, b.doc[at]), *char_grams(b, 3, 4)]
    quarter = BUCKETS // KINDS
    return [((key % key.dtype.type(quarter)).astype(np.int64) + k * quarter, doc) for k, (key, doc) in enumerate(out)]


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        label = batch["label"].to_pylist()
        for low, _, b in blocks(batch["text"]):
            parts = occurrences(b, b.word_hashes())
            totals = [np.bincount(doc, minlength=b.n) for _, doc in parts]
            index, value = [[] for _ in range(b.n)], [[] for _ in range(b.n)]
            for (bucket, doc), total in zip(parts, totals, strict=True):
                key, count = np.unique(doc * BUCKETS + bucket, return_counts=True)
                at = np.searchsorted(key, np.arange(b.n + 1) * BUCKETS)
                for d in range(b.n):
                    index[d].append(key[at[d] : at[d + 1]] % BUCKETS)
                    value[d].append(count[at[d] : at[d + 1]] / max(total[d], 1))
            yield pa.record_batch({
                "label": pa.array([label[low + d] for d in range(b.n)], pa.int32()),
                "index": pa.array([np.concatenate(x).astype(np.uint16).tobytes() for x in index], pa.binary()),
                "value": pa.array([np.concatenate(x).astype(np.float32).tobytes() for x in value], pa.binary()),
            })


def labelled_sample(docs: DataFrame, labels: DataFrame, per_label: int, label: str = "quality") -> DataFrame:
    """At most per_label rows of each label, those of smallest hash: (doc_id, label, text)."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label"))
    order = [F.xxhash64(F.lit("sample"), "doc_id"), F.col("doc_id")]
    chosen = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy(*order).limit(per_label)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), "doc_id")  # 2 * per_label rows at most
    return found.groupBy("doc_id").agg(F.first("label").alias("label"), F.min("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_PER_LABEL, epochs: int = 120, penalty: float = 1e-7) -> Model | None:
    ratio = {r["label"]: r["n"] for r in labels.select("doc_id", F.col("quality").cast("int").alias("label")).where("label in (0, 1)").groupBy("label").agg(F.count("*").alias("n")).collect()}
    chosen = materialize(labelled_sample(docs, labels, sample).mapInArrow(lean(_sparse), "label int, index binary, value binary"), "sample")
    rows = [(hash_order(np.frombuffer(r["index"], np.uint16).astype(np.int32).tobytes() + r["value"]), r["label"], r["index"], r["value"]) for r in chosen.toLocalIterator()]
    drop(chosen)
    rows.sort(key=lambda r: r[:2])
    y = np.array([r[1] for r in rows], float)
    if len(ratio) < 2 or len(set(y)) < 2:
        return None
    n = len(rows)
    length = np.array([len(r[3]) // 4 for r in rows])
    index, value = np.empty(length.sum(), np.uint16), np.empty(length.sum(), np.float32)
    for high, size in zip(np.cumsum(length)[::-1].tolist(), length[::-1].tolist(), strict=True):  # a row goes as the arrays take it
        *_, buckets, shares = rows.pop()
        index[high - size : high], value[high - size : high] = np.frombuffer(buckets, np.uint16), np.frombuffer(shares, np.float32)
    value *= np.float32(100)
    held = np.arange(n) % 5 == 0
    if len(set(y[~held])) < 2 or len(set(y[held])) < 2:
        held[:] = False
    use = (~held).astype(float) * np.where(y == 1, 0.5 / max(1, (y[~held] == 1).sum()), 0.5 / max(1, (y[~held] == 0).sum()))
    margin = sums_of_runs(index, value, length)
    gradient = sums_of_runs(*by_bucket(index, value, length))
    w, bias, m, v = np.zeros(BUCKETS), 0.0, np.zeros(BUCKETS), np.zeros(BUCKETS)
    mb = vb = 0.0
    for step in range(1, epochs + 1):  # Adam, all rows each step
        slack = use * (1 / (1 + np.exp(-np.clip(margin(w) + bias, -40, 40))) - y)
        grad = gradient(slack) + penalty * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        mb, vb = 0.9 * mb + 0.1 * slack.sum(), 0.99 * vb + 0.01 * slack.sum() ** 2
        rate = 0.05 / (1 - 0.9**step) * np.sqrt(1 - 0.99**step)
        w, bias = w - rate * m / (np.sqrt(v) + 1e-8), bias - rate * mb / (np.sqrt(vb) + 1e-8)
    part = held if held.any() else ~held
    slope, offset = platt((margin(w) + bias)[part], y[part], ratio)
    return Model((w * 100).astype(np.float32), float(bias), slope, offset)


def by_bucket(index: np.ndarray, value: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and values sorted by bucket, rows ascending in each, and the buckets' lengths; made in ranges of buckets."""
    ends, sizes = np.cumsum(length), np.zeros(BUCKETS, np.int64)
    row, turned, at = np.empty(len(index), np.min_scalar_type(len(length))), np.empty(len(index), np.float32), 0
    for low in range(0, BUCKETS, BUCKETS // 16):
        found = np.flatnonzero((index >= low) & (index < low + BUCKETS // 16))
        found = found[np.argsort(index[found], kind="stable")]
        sizes += np.bincount(index[found], minlength=BUCKETS)
        row[at : at + len(found)], turned[at : at + len(found)] = np.searchsorted(ends, found, "right"), value[found]
        at += len(found)
    return row, turned, sizes


def sums_of_runs(index: np.ndarray, value: np.ndarray, length: np.ndarray, limit: int = 1 << 20) -> Callable[[np.ndarray], np.ndarray]:
    """x to the sums of value * x[index] over consecutive runs of the given lengths, about `limit` values (or one run) at once."""
    full = np.flatnonzero(length)
    begin = (np.cumsum(length) - length)[full]
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(begin // limit)) + 1, [len(full)]))
    bounds = np.append(begin, len(index))

    def run(x: np.ndarray) -> np.ndarray:
        out, x = np.zeros(len(length)), x.astype(np.float32)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) if len(full) else ():
            low, high = bounds[a], bounds[b]
            out[full[a:b]] = np.add.reduceat(value[low:high] * x[index[low:high]], begin[a:b] - low)
        return out

    return run


def hash_order(data: bytes) -> int:
    """An order of rows that does not depend on how they arrive."""
    import zlib

    return zlib.crc32(data)


def platt(s: np.ndarray, y: np.ndarray, ratio: dict[int, int]) -> tuple[float, float]:
    """Slope and offset of a logistic of s, rows weighted to the labels' own ratio, targets smoothed."""
    n1, n0 = max(1, (y == 1).sum()), max(1, (y == 0).sum())
    share = ratio.get(1, 1) / max(1, ratio.get(0, 0) + ratio.get(1, 0))
    weight = np.where(y == 1, share / n1, (1 - share) / n0)
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = max(s.std(), 1e-9)
    z, a, b = s / scale, 1.0, 0.0
    for _ in range(60):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        g = np.array([(weight * (p - target) * z).sum() + 1e-4 * a, (weight * (p - target)).sum()])
        q = weight * p * (1 - p)
        hessian = np.array([[(q * z * z).sum() + 1e-4, (q * z).sum()], [(q * z).sum(), q.sum() + 1e-6]])
        step = np.linalg.solve(hessian, g)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
    return float(max(a, 1e-6) / scale), float(b)


def judge(batch: pa.RecordBatch, model: Model | None) -> dict[str, np.ndarray]:
    """Counts and verdicts of a batch's texts; empty for an empty batch."""
    out: dict[str, list] = {}
    for _, _, b in blocks(batch["text"]):
        facts = text_facts(b)
        h = facts.pop("hashes")
        p = np.ones(b.n)
        if model:
            s = np.full(b.n, model.bias)
            for bucket, doc in occurrences(b, h):
                s += np.bincount(doc, model.weights[bucket], minlength=b.n) / np.maximum(np.bincount(doc, minlength=b.n), 1)
            p = 1 / (1 + np.exp(-np.clip(model.slope * s + model.offset, -40, 40)))
        facts["base_failed"] = (facts["n_words"] < MIN_WORDS) | (100 * facts["n_repeat_words"] > MAX_REPEAT_PERCENT * facts["n_words"])
        facts["kept"] = ~facts["base_failed"] & (p >= KEEP_PROBABILITY)
        facts["probability"] = p
        for k, x in facts.items():
            out.setdefault(k, []).append(x)
    return {k: np.concatenate(x) for k, x in out.items()}


def _apply(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if found := judge(batch, model):
                yield pa.record_batch({"doc_id": batch["doc_id"]} | {k: pa.array(x) for k, x in found.items()})

    return run


def _passing(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if found := judge(batch, model):
                yield from kept_rows(batch, found["kept"])

    return run


def passing(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs that the model and the base rules keep, all columns; judged where they are read, without a shuffle."""
    return docs.mapInArrow(lean(_passing(model)), docs.schema)


def quality_rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_PER_LABEL) -> DataFrame:
    """One row per document: the counts, base_failed, kept and the calibrated probability of quality 1."""
    model = fit(docs, labels, sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(_apply(model)), SCHEMA)
