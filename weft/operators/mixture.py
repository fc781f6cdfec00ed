"""Weighted sampling and sample layouts (AGG7, SMP1-SMP3, SEQ8-SEQ12, J6, J7, W11, W12).

A sample is a pure function of (seed, rank, index): all draws are counter-based uniforms, so results do not
depend on partitioning and a resumed run continues exactly. The draws follow the same distributions as
the reference, not the same random streams.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from weft.functions.hashing import sample_seed, uniform, uniform_of
from weft.storage import materialize

CELLS = 256
#: From so many draws on, a sample without any position counts as one that its sources never fill.
EMPTY_DRAWS = 4096
#: Words in a text chunk (10 to 30) and in one of the other modality (5 to 15), first modality's chance.
TEXT_WORDS, OTHER_WORDS, FIRST_TEXT = (10, 30), (5, 15), 0.5
#: Runs in one row of a packed table, runs that a task lays out (a source's own size aside), and rows that it takes at once.
PACK, TASK_RUNS, ROWS = 256, 1 << 19, 512


def shard_weights(shards: DataFrame, probabilities: DataFrame | None = None) -> DataFrame:
    """shard weight: its share of all tokens, or its dataset's probability times its share there (dataset, shard, tokens)."""
    if probabilities is None:
        return shards.withColumn("weight", F.col("tokens") / F.sum("tokens").over(Window.partitionBy(F.lit(0))))
    share = F.col("tokens") / F.sum("tokens").over(Window.partitionBy("dataset"))
    return shards.join(probabilities, "dataset").withColumn("weight", F.col("probability") * share)


def choices(weights: DataFrame, key: str) -> DataFrame:
    """[low, high) of each choice on the unit interval, in the key's order. One row a choice: shards or strategies."""
    one = Window.partitionBy(F.lit(0))
    at = one.orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("weight").over(one)
    high = F.sum("weight").over(at) / total
    return weights.where("weight > 0").select(key, ((F.sum("weight").over(at) - F.col("weight")) / total).alias("low"), F.when(F.row_number().over(one.orderBy(F.col(key).desc())) == 1, 1.0).otherwise(high).alias("high"))


def pick(draws: DataFrame, u: str, intervals: DataFrame, key: str, cells: int = CELLS) -> DataFrame:
    """The choice whose interval holds u: an equi-join on equal cells of the unit interval, the bounds a residual condition.

    An interval is filed under every cell that it meets, so a cell holds 1 + choices / cells of them on average."""
    cell = lambda x: F.floor(x * cells).cast("int")
    filed = intervals.where("low < high").select("low", "high", key, F.explode(F.sequence(cell(F.col("low")), F.least(cell(F.col("high")), F.lit(cells - 1)))).alias("__cell"))
    asked = draws.withColumn("__cell", F.least(cell(F.col(u)), F.lit(cells - 1)))
    return asked.join(filed, "__cell").where((F.col(u) >= F.col("low")) & (F.col(u) < F.col("high"))).drop("__cell", "low", "high")


def sample_plan(indices: DataFrame, seed: int, rank: int, strategies: DataFrame, shards: DataFrame) -> DataFrame:
    """sample_index with its seed, strategy (SMP1) and shard (SMP2)."""
    rows = indices.select("sample_index", sample_seed(seed, F.lit(rank), F.col("sample_index")).alias("seed"))
    rows = rows.withColumn("__s", uniform(F.col("seed"), "strategy")).withColumn("__d", uniform(F.col("seed"), "shard"))
    return pick(pick(rows, "__s", choices(strategies, "strategy"), "strategy"), "__d", choices(shards, "shard"), "shard").drop("__s", "__d")


def token_blocks(flat: DataFrame, block: int) -> DataFrame:
    """An index of a flat stream (position, token): block (position // `block`) and its tokens in order."""
    held = flat.groupBy(F.floor(F.col("position") / block).cast("long").alias("block")).agg(F.array_sort(F.collect_list(F.struct("position", "token"))).alias("x"))
    return held.select("block", F.transform("x", lambda x: x["token"]).alias("tokens"))


def windows(indices: DataFrame, seed: int, blocks: DataFrame, block: int, total: Column, size: int) -> DataFrame:
    """SEQ11: `size` positions of the flat stream from a uniform start, cut from its blocks (token_blocks).

    A window meets size / block + 1 blocks at most (two where a block is no shorter than a window), so the join has that many
    rows a sample and positions are made last."""
    starts = indices.select("sample_index", F.floor(uniform(F.lit(seed), F.col("sample_index"), "window") * (total - size + 1)).cast("long").alias("start"))
    at = lambda x: F.floor(x / block).cast("long")
    met = starts.select("sample_index", "start", F.explode(F.sequence(at(F.col("start")), at(F.col("start") + size - 1))).alias("block")).join(blocks, "block")
    low = F.greatest(F.col("start") - F.col("block") * block, F.lit(0))
    held = F.slice("tokens", (low + 1).cast("int"), F.least(F.lit(block), F.col("start") + size - F.col("block") * block).cast("int") - low.cast("int"))
    whole = met.groupBy("sample_index").agg(F.array_sort(F.collect_list(F.struct("block", held.alias("held")))).alias("x"))
    return whole.select("sample_index", F.posexplode(F.flatten(F.transform("x", lambda x: x["held"]))).alias("pos", "token")).select("sample_index", F.col("pos").cast("long").alias("pos"), "token")


def emissions(runs: DataFrame, end_of_word: int, pad: int, seed: int) -> DataFrame:
    """runs with their chunk, what each emits and the position at which it begins (interleave's first half).

    The word of a run is the number of end-of-word marks before it; chunk lengths are drawn per chunk and their running
    sum gives each chunk's words. Chunks' first words and runs are sorted together, so that a run takes the last chunk that
    begins no later: one pass, no pair of a run and a chunk is made."""
    by = Window.partitionBy("sample_index")
    before = by.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    worded = runs.withColumn("word", F.coalesce(F.sum((F.col("token") == end_of_word).cast("int")).over(before), F.lit(0)).cast("long"))
    words = worded.groupBy("sample_index").agg((F.max("word") + 1).alias("words"))
    chunks = words.select("sample_index", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("words") / OTHER_WORDS[0]).cast("long"))).alias("chunk"))
    chunks = chunks.withColumn("is_text", (F.col("chunk") + (uniform(F.lit(seed), F.col("sample_index"), "first") >= FIRST_TEXT).cast("int")) % 2 == 0)
    u = uniform(F.lit(seed), F.col("sample_index"), F.col("chunk"), "chunk")
    span = lambda r: r[0] + F.floor(u * (r[1] - r[0] + 1))
    n = F.when(F.col("is_text"), span(TEXT_WORDS)).otherwise(span(OTHER_WORDS)).cast("long")
    chunks = chunks.withColumn("n", n).withColumn("word", F.sum("n").over(by.orderBy("chunk")) - F.col("n")).drop("n")
    sorted_in = by.orderBy("word", "place")  # a chunk's row has place -1: before the runs of its first word
    both = worded.unionByName(chunks.withColumn("place", F.lit(-1).cast("long")), allowMissingColumns=True)
    chunk = F.last(F.when(F.col("place") < 0, F.struct("chunk", "is_text")), ignorenulls=True).over(sorted_in.rowsBetween(Window.unboundedPreceding, 0))
    joined = both.withColumn("at", chunk).where("place >= 0").withColumns({"chunk": F.col("at.chunk"), "is_text": F.col("at.is_text")}).drop("at")
    first = (F.col("chunk") > 0) & (F.coalesce(F.lag("chunk").over(sorted_in), F.lit(-1)) != F.col("chunk"))
    own = F.when(F.col("is_text"), F.col("token").isin(pad, end_of_word).__invert__().cast("long")).otherwise(F.col("duration").cast("long"))
    counted = joined.withColumn("switches", first).withColumn("own", own)
    counted = counted.withColumn("emitted", F.col("own") + F.col("switches").cast("long"))
    return counted.withColumn("begin", F.sum("emitted").over(sorted_in) - F.col("emitted"))


def interleave(runs: DataFrame, size: int, end_of_word: int, pad: int, switch: int, seed: int) -> DataFrame:
    """SEQ9 in closed form. runs: sample_index, place, token, duration, audio (frame where the run begins), source.

    The modality alternates from a drawn first one. Text chunks give one row a token (no padding, no mark), other chunks
    one row a frame; each chunk after the first begins with a switch row. Rows beyond `size` go. A run's rows are made
    last, after the rows before it are counted (emissions)."""
    counted = emissions(runs, end_of_word, pad, seed).where((F.col("begin") < size) & (F.col("emitted") > 0))
    rows = counted.select("sample_index", "source", "token", "audio", "is_text", "switches", "begin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("emitted") - 1)).alias("k"))
    at, is_switch = F.col("begin") + F.col("k"), F.col("switches") & (F.col("k") == 0)
    frame = F.col("audio") + F.col("k") - F.col("switches").cast("long")
    text = F.when(is_switch, switch).when(F.col("is_text"), F.col("token")).otherwise(pad)
    return rows.select("sample_index", at.alias("pos"), "source", text.cast("int").alias("text"), F.when(~is_switch & ~F.col("is_text"), frame).cast("long").alias("frame"), (is_switch | F.col("is_text")).alias("txt_in"), (~is_switch & ~F.col("is_text")).alias("other_in"), (~is_switch & F.col("is_text")).alias("txt_pred"), (~is_switch & ~F.col("is_text")).alias("other_pred")).where(F.col("pos") < size)


def draw_until_full(indices: DataFrame, draw: Callable[[DataFrame], DataFrame], emitted: Callable[[DataFrame], DataFrame], size: int, first: int = 8) -> DataFrame:
    """Runs of as many drawn sources as each sample of `indices` (sample_index) needs for `size` positions (SEQ8, SEQ9, SEQ12).

    draw: (sample_index, draw) to their sources' runs, the same for the same pair; emitted: runs to (sample_index, n), the
    positions that they give. All samples begin with `first` draws; those that are short draw twice as many in the next round,
    until none is short. Rounds go through tables in the shared folder, joined by sorting: they grow with the samples, and the
    planner takes exploded and compressed rows for small ones. A round that adds no position to a sample
    is an error, where all its draws so far gave none: such sources never fill it."""
    short, held, draws = indices.select("sample_index"), [], first
    while True:
        numbers = short.select("sample_index", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
        runs = materialize(draw(numbers), "runs")
        totals = materialize(short.join(emitted(runs).hint("merge"), "sample_index", "left").select("sample_index", F.coalesce("n", F.lit(0)).alias("n")), "totals")
        held.append(runs.join(totals.where(F.col("n") >= size).hint("merge"), "sample_index", "left_semi"))
        left = totals.where(F.col("n") < size).agg(F.count("*").alias("short"), F.min("n").alias("least")).first()
        if not left["short"]:
            return functools.reduce(DataFrame.unionByName, held)
        if draws >= EMPTY_DRAWS and not left["least"]:
            raise ValueError(f"{draws} drawn sources gave no position to a sample")
        short, draws = totals.where(F.col("n") < size).select("sample_index"), 2 * draws


def draw_runs(picks: DataFrame, runs: DataFrame) -> DataFrame:
    """The runs of the drawn sources one after another: picks (sample_index, draw, source), runs (source, place, token, duration, audio)."""
    joined = picks.join(runs.hint("merge"), "source")  # both grow with the samples or sources, whatever the planner estimates
    at = Window.partitionBy("sample_index").orderBy("draw", "place")
    return joined.select("sample_index", "source", "token", "duration", "audio", (F.row_number().over(at) - 1).cast("long").alias("place"))


def aligned_layout(runs: DataFrame, size: int, pad: int) -> DataFrame:
    """SEQ10: every frame has a text token and codes; the input mask is where the text is no padding."""
    order = Window.partitionBy("sample_index").orderBy("place")
    counted = runs.withColumn("begin", (F.sum("duration").over(order) - F.col("duration")).cast("long")).where(F.col("begin") < size)
    rows = counted.select("sample_index", "source", "token", "audio", "begin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("duration").cast("long") - 1)).alias("k"))
    return rows.select("sample_index", (F.col("begin") + F.col("k")).alias("pos"), "source", F.col("token").cast("int").alias("text"), (F.col("audio") + F.col("k")).alias("frame"), (F.col("token") != pad).alias("txt_in"), F.lit(True).alias("other_in"), F.lit(True).alias("txt_pred"), F.lit(True).alias("other_pred")).where(F.col("pos") < size)


def pack_runs(runs: DataFrame) -> DataFrame:
    """runs (source, place, token, duration, audio) as arrays: a row for each PACK places of a source.

    Columns: source, pack, token and duration (arrays in the places' order), audio (the first one), runs and frames (totals)."""
    runs = runs.where("source is not null").withColumn("duration", F.col("duration").cast("long"))
    held = runs.groupBy("source", F.floor(F.col("place") / PACK).cast("long").alias("pack")).agg(
        F.array_sort(F.collect_list(F.struct("place", "token", "duration"))).alias("x"), F.min("audio").alias("audio"), F.count("*").alias("runs"), F.coalesce(F.sum("duration"), F.lit(0)).alias("frames")
    )
    return held.select("source", "pack", "x.token", "x.duration", "audio", "runs", "frames")


def _asked(numbers: DataFrame, packs: DataFrame, seat: Callable[[Column, Column], Column], runs: float) -> DataFrame:
    """The packs of the drawn sources, each sample's in one task and in order. runs: how many runs they hold, about.

    The number of tasks follows the runs, whatever the session's number of partitions is."""
    picks = numbers.withColumn("seat", seat(F.col("sample_index"), F.col("draw")))
    met = picks.join(packs.hint("merge"), "seat").select("sample_index", "draw", "pack", "source", "token", "duration", "audio")
    return met.repartition(1 + int(runs // TASK_RUNS), "sample_index").sortWithinPartitions("sample_index", "draw", "pack")


class _Chunks:
    """The last word but one of each chunk of a sample, as far as they were asked for; flip: 1 if the first is no text."""

    def __init__(self, seed: int, sample: int):
        self.seed, self.sample, self.ends = seed, sample, []
        self.flip = int(uniform_of(seed, sample, "first") >= FIRST_TEXT)

    def reach(self, word: int) -> list[int]:
        """Ends of the chunks up to that of the word."""
        while not self.ends or self.ends[-1] <= word:
            k = len(self.ends)
            low, high = OTHER_WORDS if (k + self.flip) % 2 else TEXT_WORDS
            self.ends.append((self.ends[-1] if k else 0) + low + int(uniform_of(self.seed, self.sample, k, "chunk") * (high - low + 1)))
        return self.ends


class _Walk:
    """emissions() over packs that come sample by sample; the last sample stays open for the next rows."""

    def __init__(self, end_of_word: int, pad: int, seed: int):
        self.end_of_word, self.pad, self.seed = end_of_word, pad, seed
        self.sample, self.words, self.begin, self.chunk, self.chunks = None, 0, 0, -1, None

    def step(self, batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        """A value for each run. last: the runs that end the samples of these rows (the last sample may go on)."""
        n = pc.list_value_length(batch["token"]).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(batch.num_rows), n)
        tokens, durations = batch["token"].flatten(), batch["duration"].flatten()
        token, duration = (x.fill_null(-1 if x is tokens else 0).to_numpy(zero_copy_only=False) for x in (tokens, durations))
        unknown, untimed = (x.is_null().to_numpy(zero_copy_only=False) for x in (tokens, durations))
        sample = batch["sample_index"].to_numpy()[row]
        first = np.flatnonzero(np.append(True, sample[1:] != sample[:-1]))
        size = np.diff(np.append(first, len(sample)))
        last, of = first + size - 1, np.repeat(np.arange(len(first)), size)
        goes_on = sample[0] == self.sample
        if not goes_on:
            self.words, self.begin, self.chunk = 0, 0, -1

        def before(x: np.ndarray, carried: int) -> np.ndarray:
            """Sum of x over the sample's earlier runs."""
            total = np.cumsum(x) - x
            base = total[first]
            base[0] -= carried
            return total - base[of]

        ends = (token == self.end_of_word) & ~unknown
        word = before(ends.astype(np.int64), self.words)
        chunks = [self.chunks if goes_on and k == 0 else _Chunks(self.seed, x) for k, x in enumerate(sample[first].tolist())]
        bounds = [np.array(c.reach(w), np.int64) for c, w in zip(chunks, word[last].tolist(), strict=True)]
        until = np.concatenate([b + (k << 40) for k, b in enumerate(bounds)])
        begins = np.cumsum([0, *map(len, bounds)])[:-1]
        chunk = np.searchsorted(until, word + (of << 40), "right") - begins[of]
        is_text = (chunk + np.array([c.flip for c in chunks])[of]) % 2 == 0
        earlier = np.append(-1, chunk[:-1])
        earlier[first] = -1
        earlier[0] = self.chunk
        switches = (chunk > 0) & (earlier != chunk)
        own = np.where(is_text, ~(ends | ((token == self.pad) & ~unknown)), duration)
        emitted = np.where(untimed & ~is_text, 0, own + switches)
        begin = before(emitted, self.begin)
        audio = np.cumsum(duration) - duration
        audio += (batch["audio"].fill_null(0).to_numpy(zero_copy_only=False) - audio[np.cumsum(n) - n])[row]
        self.sample, self.words, self.begin, self.chunk, self.chunks = sample[-1], int(word[-1] + ends[-1]), int(begin[-1] + emitted[-1]), int(chunk[-1]), chunks[-1]
        return {"row": row, "sample": sample, "token": token, "unknown": unknown, "is_text": is_text, "switches": switches, "emitted": emitted, "begin": begin, "audio": audio, "last": last}


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, ROWS):
            yield batch.slice(low, ROWS)


def _needs(size: int, end_of_word: int, pad: int, seed: int):
    """Packs to sample_index, draws (those that give `size` positions, else null) and n (the positions up to there, or all)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, pending = _Walk(end_of_word, pad, seed), None  # pending: the open sample, if it is short so far

        def told(sample: list[int], draws: list[int | None], n: list[int]) -> pa.RecordBatch:
            return pa.record_batch({"sample_index": pa.array(sample, pa.int64()), "draws": pa.array(draws, pa.int32()), "n": pa.array(n, pa.int64())})

        for batch in _slices(batches):
            x = walk.step(batch)
            after = x["begin"] + x["emitted"]
            full = np.flatnonzero((x["begin"] < size) & (after >= size))
            draws = batch["draw"].to_numpy()[x["row"][full]] + 1
            short = x["last"][after[x["last"]] < size]
            rows = [(s, None, n) for s, n in zip(x["sample"][short].tolist(), after[short].tolist(), strict=True)]
            if pending and pending[0] != x["sample"][0]:
                rows.append(pending)
            pending = rows.pop([r[0] for r in rows].index(int(walk.sample))) if walk.begin < size else None
            rows += zip(x["sample"][full].tolist(), draws.tolist(), after[full].tolist(), strict=True)
            if rows:
                yield told(*map(list, zip(*rows, strict=True)))
        if pending:
            yield told(*([x] for x in pending))

    return run


def _positions(size: int, end_of_word: int, pad: int, switch: int, seed: int):
    """Packs to the rows of interleave()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = _Walk(end_of_word, pad, seed)
        for batch in _slices(batches):
            x = walk.step(batch)
            held = np.flatnonzero((x["begin"] < size) & (x["emitted"] > 0))
            count = np.minimum(x["emitted"][held], size - x["begin"][held])
            at = np.repeat(held, count)
            if not len(at):
                continue
            k = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
            is_switch = x["switches"][at] & (k == 0)
            text, other = x["is_text"][at] & ~is_switch, ~x["is_text"][at] & ~is_switch
            yield pa.record_batch({
                "sample_index": pa.array(x["sample"][at]),
                "pos": pa.array(x["begin"][at] + k),
                "source": batch["source"].take(pa.array(x["row"][at])),
                "text": pa.array(np.where(is_switch, switch, np.where(text, x["token"][at], pad)).astype(np.int32), mask=text & x["unknown"][at]),
                "frame": pa.array(x["audio"][at] + k - x["switches"][at], mask=~other),
                "txt_in": pa.array(~other), "other_in": pa.array(other), "txt_pred": pa.array(text), "other_pred": pa.array(other),
            })

    return run


def interleave_drawn(indices: DataFrame, packs: DataFrame, seat: Callable[[Column, Column], Column], runs: float, size: int, end_of_word: int, pad: int, switch: int, seed: int, first: int = 8) -> DataFrame:
    """interleave() of draw_until_full(): as many drawn sources as each sample of `indices` (sample_index) needs for `size` positions.

    packs: pack_runs() with each source's seat (long); seat: (sample_index, draw) to the drawn seat; runs: the mean of a
    source. Runs stay packed until their positions are made, and are never written: rounds of `first` draws, then of twice as
    many for the short samples, only tell how many each sample needs, and the layout draws those. A sample's packs come to one
    task in order and pass through it in pieces. Samples that no source ever fills are an error, as there."""
    held, short, draws, asked = [], indices.select("sample_index"), first, 0
    while True:
        numbers = short.select("sample_index", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
        counted = _asked(numbers, packs, seat, short.count() * draws * runs).mapInArrow(_needs(size, end_of_word, pad, seed), "sample_index long, draws int, n long")
        needs = materialize(short.join(counted.hint("merge"), "sample_index", "left").select("sample_index", "draws", F.coalesce("n", F.lit(0)).alias("n")), "needs")
        told = needs.agg(F.count(F.when(F.col("draws").isNull(), 1)).alias("short"), F.min(F.when(F.col("draws").isNull(), F.col("n"))).alias("least"), F.sum("draws").alias("draws")).first()
        held.append(needs.where("draws is not null"))
        asked += told["draws"] or 0
        if not told["short"]:
            break
        if draws >= EMPTY_DRAWS and not told["least"]:
            raise ValueError(f"{draws} drawn sources gave no position to a sample")
        short, draws = needs.where("draws is null").select("sample_index"), 2 * draws
    numbers = functools.reduce(DataFrame.unionByName, held).select("sample_index", F.explode(F.sequence(F.lit(0), F.col("draws") - 1)).alias("draw"))
    flags = [StructField(k, BooleanType()) for k in ("txt_in", "other_in", "txt_pred", "other_pred")]
    shape = StructType([StructField("sample_index", LongType()), StructField("pos", LongType()), packs.schema["source"], StructField("text", IntegerType()), StructField("frame", LongType()), *flags])
    return _asked(numbers, packs, seat, asked * runs).mapInArrow(_positions(size, end_of_word, pad, switch, seed), shape)
