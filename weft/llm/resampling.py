"""Target-distribution importance resampling: documents drawn in proportion to how much they look like a target.

Runs of words are hashed into buckets; a bucket's gain is the log ratio of its shares in the target and in the corpus,
so a document's weight is the sum of a table's entries at an array of buckets. Gumbel noise from a hash of the id makes
the highest scores a draw without replacement. The draw is a merge, not a global sort:

1. Each partition sorts its eligible rows by score (largest first) and id, and writes them as one run, in blocks.
2. Quantiles of the scores above the cut divide the runs into ranges; a range's total gives its first rank.
3. A task merges a range's slices of all runs by a tournament tree with a leaf for each run, and emits ranks. It stops
   after the exact number of draws; what is left in the range that holds the cut comes out without a rank.

Blocks reach a merge in order of their first rows, so a run's next block is there when its last one is used up, and a
merge holds one block of each run at most. Rows that are alike in all output columns stand once in a run, with their
number, so that one id that holds many rows makes no long run of ties. Texts are read twice (to count and to score)
and never shuffled; counts leave a task as one row for each bucket at most.

Defined cases: a null text has no words; a null id is hashed as an empty one and comes after all ids among equal
scores; equal ids and scores go by fewer features, then by smaller weight; equal rows are drawn as often as they stand
there; a document without features weighs 0; without eligible rows, or too few for one draw, all ranks are null; an
empty target counts as one without features; a text of any length is judged whole, in the task that reads it; an empty
table gives an empty result; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from weft.llm.common import materialize

BUCKETS, LONGEST = 10_000, 1
LEAST_WORDS, PERCENT, SEED = 20, 10, 2024
BLOCK_BYTES = 1 << 22
RUN_BLOCK = 1024
RANGE_ROWS = 1 << 20
LONG_WORD = 64

#: Bytes of words once A-Z are lower-cased, and the lower-casing.
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _crc_table() -> np.ndarray:
    """The byte table of CRC-32 (reflected polynomial 0xEDB88320)."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, out >> np.uint32(1) ^ np.uint32(0xEDB88320), out >> np.uint32(1))
    return out.astype(np.uint32)


_CRC = _crc_table()


def crc32s(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """CRC-32 of spans of bytes, each continuing from `before` (0 by default), a byte of every span at a time."""
    order = np.argsort(-np.minimum(lengths, LONG_WORD + 1).astype(np.int8), kind="stable")
    at, left = starts[order], lengths[order]
    out = np.zeros(len(at), np.uint32) if before is None else before[order]
    long = int(np.searchsorted(-left.clip(max=LONG_WORD + 1), -LONG_WORD, "left"))
    raw = memoryview(data)
    for k in range(long):
        out[k] = zlib.crc32(raw[at[k] : at[k] + left[k]], int(out[k]))
    state = out[long:] ^ np.uint32(0xFFFFFFFF)
    at, left = at[long:], left[long:]
    held = np.searchsorted(-left, -np.arange(1, LONG_WORD + 1), "right")  # spans with more than k bytes
    for k, n in enumerate(held[: int(left[0]) if len(left) else 0].tolist()):
        head = state[:n]
        state[:n] = _CRC[(head ^ data[at[:n] + k]) & np.uint32(0xFF)] ^ head >> np.uint32(8)
    out[long:] = state ^ np.uint32(0xFFFFFFFF)
    back = np.empty_like(out)
    back[order] = out
    return back


def features(texts: list[bytes], longest: int = LONGEST, buckets: int = BUCKETS) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words of each text, and for each run length (bucket, text) of every run of words."""
    raw = b"\n".join(texts) + b"\n"
    data = _LOWER[np.frombuffer(raw, np.uint8)]
    inside = np.zeros(len(data) + 1, bool)
    inside[1:] = _INSIDE[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])  # the last byte is outside, so edges come in pairs
    starts, lengths = edges[0::2], edges[1::2] - edges[0::2]
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    first = np.searchsorted(starts, np.concatenate(([0], ends)))
    words = np.diff(first)
    doc = np.repeat(np.arange(len(texts)), words)
    out, crc = [], None
    for n in range(1, longest + 1):
        if crc is None:
            crc = crc32s(data, starts, lengths)
        else:
            held = np.flatnonzero(doc[: len(crc) - 1] == doc[n - 1 :]) if len(crc) > 1 else np.zeros(0, np.int64)
            space = np.full(len(crc), 0x20, np.uint32)
            state = crc ^ np.uint32(0xFFFFFFFF)
            joined = (_CRC[(state ^ space) & np.uint32(0xFF)] ^ state >> np.uint32(8)) ^ np.uint32(0xFFFFFFFF)
            grown = np.zeros(max(len(crc) - 1, 0), np.uint32)
            grown[held] = crc32s(data, starts[held + n - 1], lengths[held + n - 1], joined[held])
            crc = grown
            out.append(((crc[held] % np.uint32(buckets)).astype(np.int64), doc[held]))
            continue
        out.append(((crc % np.uint32(buckets)).astype(np.int64), doc))
    return words, out


def _batches(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, whole texts) of about BLOCK_BYTES or one text; nulls count as empty."""
    low, held, size = 0, [], 0
    for k, text in enumerate(texts.cast(pa.large_binary())):
        value = text.as_py() or b""
        if held and size + len(value) > BLOCK_BYTES:
            yield low, held
            low, held, size = k, [], 0
        held.append(value)
        size += len(value)
    if held:
        yield low, held


def _count(longest: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, texts in _batches(batch["text"]):
                for bucket, _ in features(texts, longest, buckets)[1]:
                    total += np.bincount(bucket, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.record_batch({"bucket": pa.array(held.astype(np.int32)), "n": pa.array(total[held])})

    return run


def bucket_counts(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall in each bucket: `buckets` numbers reach the driver."""
    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_count(longest, buckets), "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed shares in the target and the corpus, rounded down."""
    buckets, s, t = len(corpus), float(corpus.sum()), float(target.sum())
    ratio = lambda a, b: (float(b + 1) * (s + buckets)) / (float(a + 1) * (t + buckets))
    return np.array([math.floor(1000 * math.log(ratio(a, b))) for a, b in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def _weigh(gain: np.ndarray, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, texts in _batches(batch["text"]):
                words, found = features(texts, longest, len(gain))
                n, weight = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
                for bucket, doc in found:
                    n += np.bincount(doc, minlength=len(texts))
                    weight += np.bincount(doc, gain[bucket], minlength=len(texts)).astype(np.int64)  # whole numbers below 2**53
                yield pa.record_batch({"doc_id": batch["doc_id"].slice(low, len(texts)), "n_words": pa.array(words), "n_features": pa.array(n), "weight": pa.array(weight)})

    return run


def noise(doc_id: Column, seed: int) -> Column:
    """Thousandths of a Gumbel variate that the id decides, rounded down."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scores(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every document, judged where it is read."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    weighed = rows.mapInArrow(_weigh(gain, longest), "doc_id long, n_words long, n_features long, weight long")
    return weighed.withColumn("score", (F.col("weight") + noise(F.col("doc_id"), seed)).cast("long"))


#: Columns of a run's rows after their number; a row's order is score (largest first), id (null last), features, weight.
FIELDS = ("score", "doc_id", "n_features", "weight")
ORDER = [F.desc, F.asc_nulls_last, F.asc, F.asc]
RUNS = "range int, run int, score long, doc_id long, n_features long, weight long, rows long, scores array<long>, doc_ids array<long>, features array<long>, weights array<long>, counts array<long>"


def _blocks(splits: np.ndarray, size: int):
    """Sorted rows as blocks of one range and `size` different rows at most; the first row stands in front."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = context.partitionId() if context else 0

        def packed(held: list[list]) -> dict:
            columns = list(zip(*held, strict=True))
            return dict(zip(("scores", "doc_ids", "features", "weights", "counts"), map(list, columns), strict=True)) | dict(zip(FIELDS, held[0][:4], strict=True)) | {"rows": sum(columns[4])}

        def emitted(done: list[tuple[int, list[list]]]) -> pa.RecordBatch:
            rows = [{"range": r, "run": number} | packed(held) for r, held in done]
            kinds = {x.split()[0]: {"int": pa.int32(), "long": pa.int64()}.get(x.split()[1], pa.list_(pa.int64())) for x in RUNS.split(", ")}
            return pa.RecordBatch.from_pylist([{k: row[k] for k in kinds} for row in rows], pa.schema(list(kinds.items())))

        at, held = -1, []
        for batch in batches:
            done = []
            ranges = (len(splits) - np.searchsorted(splits, batch["score"].to_numpy(), "right")).tolist()  # splits ascend, ranges count from the top
            for place, *row in zip(ranges, *(batch[c].to_pylist() for c in FIELDS), strict=True):
                if held and place == at and held[-1][:4] == row:
                    held[-1][4] += 1
                    continue
                if held and (place != at or len(held) == size):
                    done.append((at, held))
                    held = []
                at = place
                held.append([*row, 1])
            if done:
                yield emitted(done)
        if held:
            yield emitted([(at, held)])

    return run


#: Comes after every row.
_END = (math.inf,)


class Tournament:
    """A tournament tree over the blocks of many runs: the root names the leaf whose first row comes first.

    A row is (-score, id is null, id, features, weight, number)."""

    def __init__(self):
        self.leaf_of: dict[int, int] = {}
        self.leaves, self.blocks, self.at = 1, [[]], [0]
        self.heads, self.tree = [_END], [0, 0]

    def _replay(self, leaf: int) -> None:
        node = (leaf + self.leaves) >> 1
        while node:
            a, b = self.tree[2 * node], self.tree[2 * node + 1]
            self.tree[node] = a if self.heads[a] <= self.heads[b] else b
            node >>= 1

    def add(self, run: int, rows: list[tuple]) -> None:
        """A run's next block. All rows up to its first one are out, so the run's block before it is used up."""
        leaf = self.leaf_of.setdefault(run, len(self.leaf_of))
        if leaf == self.leaves:  # a leaf more than there is room for: double and play all matches anew
            n = self.leaves
            self.leaves *= 2
            self.blocks += [[] for _ in range(n)]
            self.at += [0] * n
            self.heads += [_END] * n
            self.tree = [0] * self.leaves + list(range(self.leaves))
            for node in range(self.leaves - 1, 0, -1):
                a, b = self.tree[2 * node], self.tree[2 * node + 1]
                self.tree[node] = a if self.heads[a] <= self.heads[b] else b
        assert self.heads[leaf] is _END
        self.blocks[leaf], self.at[leaf], self.heads[leaf] = rows, 0, rows[0]
        self._replay(leaf)

    def first(self) -> tuple:
        return self.heads[self.tree[1]] if self.leaves > 1 else self.heads[0]

    def pop(self) -> tuple:
        leaf = self.tree[1] if self.leaves > 1 else 0
        out = self.heads[leaf]
        self.at[leaf] += 1
        block = self.blocks[leaf]
        self.heads[leaf] = block[self.at[leaf]] if self.at[leaf] < len(block) else _END
        self._replay(leaf)
        return out

    def rest(self) -> Iterator[tuple]:
        """What the leaves still hold, in no order."""
        for block, at in zip(self.blocks, self.at, strict=True):
            yield from block[at:]


def merged(blocks: Iterator[tuple[int, list[tuple]]], first_rank: int, draws: int) -> Iterator[tuple[tuple, int | None]]:
    """(row, rank) of a range's blocks (run, rows) in order of their first rows: ranks up to `draws`, then none."""
    tree, rank = Tournament(), first_rank

    def out(row: tuple) -> Iterator[tuple[tuple, int | None]]:
        nonlocal rank
        for _ in range(row[5]):
            yield row, rank if rank <= draws else None
            rank += 1

    for run, rows in blocks:
        while rank <= draws and tree.first() <= rows[0]:
            yield from out(tree.pop())
        if rank <= draws:
            tree.add(run, rows)
        else:  # the draw is complete
            for row in rows:
                yield from out(row)
    while rank <= draws and tree.first() is not _END:
        yield from out(tree.pop())
    for row in tree.rest():
        yield from out(row)


OUTPUT = "doc_id long, n_features long, weight long, score long, rank long"


def _merge(first_ranks: dict[int, int], draws: int):
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[tuple]]]:
        for batch in batches:
            for r in range(batch.num_rows):
                lists = [batch[c][r].as_py() for c in ("scores", "doc_ids", "features", "weights", "counts")]
                yield batch["range"][r].as_py(), batch["run"][r].as_py(), [(-s, i is None, i or 0, f, w, n) for s, i, f, w, n in zip(*lists, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emitted(rows: list) -> pa.RecordBatch:
            columns = zip(*((None if x[1] else x[2], x[3], x[4], -x[0], rank) for x, rank in rows), strict=True)
            return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in OUTPUT.split(", ")])

        held = []
        for place, found in groupby(stream(batches), key=lambda x: x[0]):
            for row in merged(((number, rows) for _, number, rows in found), first_ranks[place], draws):
                held.append(row)
                if len(held) == 8192:
                    yield emitted(held)
                    held = []
        if held:
            yield emitted(held)

    return run


def drawn(scored: DataFrame, least: int = LEAST_WORDS, percent: int = PERCENT, range_rows: int = RANGE_ROWS) -> DataFrame:
    """OUTPUT's rows of a stored table of scores: ranks 1 and up for the highest `percent` of the eligible rows.

    One number a range, each of about `range_rows` draws, passes through the driver."""
    spark = scored.sparkSession
    eligible = scored.where(F.col("n_words") >= least)
    total = eligible.count()
    draws = percent * total // 100
    undrawn = lambda df: df.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    if not draws:
        return undrawn(scored)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-draws // range_rows))
    accuracy = max(2000, 10 * parts)  # a quantile's place is off by total / accuracy at most
    share = percent / 100
    places = [1 - share * k / parts for k in range(1, parts)] + [max(0.0, 1 - share - 2 / accuracy)]
    splits = np.unique(eligible.agg(F.percentile_approx("score", F.array(*map(F.lit, places)), F.lit(accuracy))).first()[0])
    lowest = int(splits[0]) if eligible.where(F.col("score") >= int(splits[0])).count() >= draws else None
    above = F.lit(True) if lowest is None else F.col("score") >= lowest
    ordered = eligible.where(above).select(*FIELDS).sortWithinPartitions(*(f(c) for f, c in zip(ORDER, FIELDS, strict=True)))
    runs = materialize(ordered.mapInArrow(_blocks(splits, RUN_BLOCK), RUNS), "runs")
    held, first_ranks, rank = {r["range"]: r["n"] for r in runs.groupBy("range").agg(F.sum("rows").alias("n")).collect()}, {}, 1
    for place in sorted(held):
        first_ranks[place] = rank
        rank += held[place]
    near = runs.repartition(parts, "range").sortWithinPartitions("range", *(f(c) for f, c in zip(ORDER, FIELDS, strict=True)))
    ranked = near.mapInArrow(_merge(first_ranks, draws), OUTPUT)
    return ranked.unionByName(undrawn(scored.where(~((F.col("n_words") >= least) & above))))


def resample(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, least: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """Every document's doc_id, n_features, weight, score and rank; target has a column text."""
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    return drawn(materialize(scores(docs, gain, longest, seed), "scores"), least, percent)
