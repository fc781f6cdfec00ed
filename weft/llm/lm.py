"""Hidden Markov language model trained by Baum-Welch, scored by the scaled forward recursion.

Every word of the corpus is counted exactly. A word belongs to one of CLASSES hash classes; the hidden
states emit classes, and within its class a word has probability (c + 1) / S, c being its training count
and S the sum of c + 1 over the class's training words plus one share for unseen words. The end of a text
is a class of its own. A text's probability is the forward probability of its class sequence times its
words' probabilities within their classes: exact for this model, whatever the text's length.

Texts are encoded once into blocks of about BLOCK_BYTES (token positions as local word numbers, the
block's distinct words and their training counts). Baum-Welch: each task adds up the expected counts of
its blocks, tasks are summed in two steps, the driver gets one table of fixed size (CLASSES x STATES).
The states start from the class shares of all training texts, each state tilted by random factors of its
own, alike for any corpus, so that no two begin alike; ROUNDS rounds pass over all training texts. Word
counts come back to each block by a join on the word, so no table of words is ever sent to all executors
or to the driver. Blocks are dealt out by number, evenly, and a task scores them one after another.

Words are identified by 64-bit hashes of their lower-cased bytes.

Defined cases: a null text is an empty one (the end token alone); a null doc_id is trained on; repeated
rows count as often as they stand there; without training texts the states are uniform; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from weft.llm.common import materialize
from weft.llm.kernel import blocks

STATES = 8
CLASSES = 1 << 14
ROUNDS = 6
PRIOR = 8000.0  # tokens of the classes' own shares added to each state
TILT, STICK = 2.0, 40  # shape of the starting factors' gamma law; a state's starting weight on itself
BLOCK_BYTES = 10 << 20
TASK_BLOCKS = 16  # blocks that one task scores, at most about
END_WORD = np.uint64(0x656E64)  # the end token's identity
FOLDS, HELD_FOLD = 7, 2
GROUP_TOKENS = 300_000
PARTS = 16

ENCODED = "block long, trains boolean, texts binary, tokens binary, words array<long>, counts array<int>"


def pack_numbers(x: np.ndarray) -> bytes:
    """uint32 numbers as compressed byte planes."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpack_numbers(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def pack_texts(doc_id: list[int | None], held: list[bool], n: np.ndarray) -> bytes:
    """A block's texts (id, whether held out, number of tokens) as one Arrow stream: one column, however they are moved."""
    table = pa.table({"doc_id": pa.array(doc_id, pa.int64()), "held": pa.array(held, pa.bool_()), "n": pa.array(n, pa.int64())})
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as stream:
        stream.write_table(table)
    return out.getvalue().to_pybytes()


def unpack_texts(data: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    table = pa.ipc.open_stream(data).read_all().combine_chunks()
    return table["doc_id"].combine_chunks(), table["held"].to_numpy(), table["n"].to_numpy()


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    context = TaskContext.get()
    task, number = (context.partitionId() if context else 0), 0
    names, held, sizes, hashes, size = [], [], [], [], 0

    def row() -> pa.RecordBatch:
        n = np.concatenate(sizes)
        out = np.empty(int(n.sum()), np.uint64)
        ends = np.cumsum(n) - 1
        word = np.ones(len(out), bool)
        word[ends] = False
        out[word], out[ends] = np.concatenate(hashes), END_WORD
        keys, local = np.unique(out, return_inverse=True)
        train = np.repeat(~np.array(held), n)
        counts = np.bincount(local[train], minlength=len(keys))
        return pa.record_batch([
            pa.array([task << 24 | number], pa.int64()), pa.array([not all(held)], pa.bool_()), pa.array([pack_texts(names, held, n)], pa.binary()),
            pa.array([pack_numbers(local)], pa.binary()), pa.array([keys.view(np.int64)], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int32())),
        ], names=[x.split()[0] for x in ENCODED.split(", ")])

    for batch in batches:
        ids, out = batch["doc_id"].to_pylist(), batch["held"].to_pylist()
        for low, high, b in blocks(batch["text"], lower=True):
            names += ids[low:high]
            held += out[low:high]
            sizes.append(b.counts + 1)
            hashes.append(b.word_hashes())
            size += len(b.raw)
            if size >= BLOCK_BYTES:
                yield row()
                names, held, sizes, hashes, size, number = [], [], [], [], 0, number + 1
    if names:
        yield row()


class Hmm:
    """start (STATES), move (STATES x STATES), emit (CLASSES + 1 x STATES, columns sum to one)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start.astype(np.float32), move.astype(np.float32), emit.astype(np.float32)

    @staticmethod
    def from_counts(start: np.ndarray, move: np.ndarray, emit: np.ndarray, share: np.ndarray, weight: float = PRIOR) -> Hmm:
        """Expected counts, smoothed by the classes' own shares."""
        k = len(start)
        return Hmm((start + 1) / (start.sum() + k), (move + 0.5) / (move.sum(1, keepdims=True) + 0.5 * k), (emit + weight * share[:, None]) / (emit.sum(0) + weight))

    def groups(self, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Sequences, longest first, in groups of at most GROUP_TOKENS places or one sequence: (numbers, how many run at each step)."""
        order = np.argsort(-n, kind="stable")
        low = 0
        while low < len(order):
            high = min(len(order), low + max(1, GROUP_TOKENS // max(1, int(n[order[low]]))))
            part = order[low:high]
            running = np.searchsorted(-n[part], -np.arange(int(n[part[0]])), "left")
            yield part, running
            low = high

    def _observed(self, obs: np.ndarray, first: np.ndarray, part: np.ndarray, running: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Classes step by step, and where each step begins."""
        begin = np.concatenate(([0], np.cumsum(running)))
        rank = np.arange(begin[-1]) - np.repeat(begin[:-1], running)
        return obs[first[part][rank] + np.repeat(np.arange(len(running)), running)], begin

    def score(self, obs: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Natural log probability of each class sequence; every sequence has one class at least."""
        first, out = np.cumsum(n) - n, np.zeros(len(n))
        for part, running in self.groups(n):
            seen, begin = self._observed(obs, first, part, running)
            scale = self._forward(seen, begin, running)[1]
            of = np.arange(len(seen)) - np.repeat(begin[:-1], running)
            out[part] = np.bincount(of, np.log(scale), minlength=len(part))
        return out

    def _forward(self, seen: np.ndarray, begin: np.ndarray, running: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        like = self.emit[seen]
        alpha, scale = np.empty_like(like), np.empty(len(seen), np.float32)
        now = None
        for t, m in enumerate(running.tolist()):
            s, e = begin[t], begin[t] + m
            now = like[s:e] * (self.start if t == 0 else now[:m] @ self.move)
            total = now.sum(1)
            now /= total[:, None]
            alpha[s:e], scale[s:e] = now, total
        return alpha, scale, like

    def expect(self, obs: np.ndarray, n: np.ndarray, sums: dict[str, np.ndarray]) -> None:
        """Add the expected counts of the sequences to sums."""
        first, back = np.cumsum(n) - n, np.ascontiguousarray(self.move.T)
        for part, running in self.groups(n):
            seen, begin = self._observed(obs, first, part, running)
            alpha, scale, like = self._forward(seen, begin, running)
            like /= scale[:, None]
            beta = np.ones((len(part), len(self.start)), np.float32)
            moved = np.zeros((len(self.start),) * 2, np.float64)
            gamma = alpha  # alpha's rows become the state probabilities, last step first
            for t in range(len(running) - 1, -1, -1):
                m, s = int(running[t]), begin[t]
                if t + 1 < len(running):
                    k = int(running[t + 1])
                    ahead = like[begin[t + 1] : begin[t + 1] + k] * beta[:k]
                    moved += alpha[s : s + k].T @ ahead
                    beta[:k] = ahead @ back
                gamma[s : s + m] *= beta[:m]
            sums["start"] += gamma[: len(part)].sum(0)
            sums["move"] += moved * self.move
            for k in range(len(self.start)):
                sums["emit"][:, k] += np.bincount(seen, gamma[:, k], minlength=CLASSES + 1)
            sums["log"] += np.log(scale).sum()


def zero_sums(states: int = STATES) -> dict[str, np.ndarray]:
    return {"start": np.zeros(states), "move": np.zeros((states, states)), "emit": np.zeros((CLASSES + 1, states)), "log": np.zeros(1)}


def classes_of(words: np.ndarray) -> np.ndarray:
    return np.where(words == END_WORD, CLASSES, (words % np.uint64(CLASSES)).astype(np.int64)).astype(np.int32)


def _training(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray]:
    """Class sequences of a block's training texts, and their lengths."""
    words = batch["words"][row].values.to_numpy().view(np.uint64)
    _, held, n = unpack_texts(batch["texts"][row].as_py())
    train = ~held
    obs = classes_of(words)[unpack_numbers(batch["tokens"][row].as_py())]
    return obs[np.repeat(train, n)], n[train]


def _flat(sums: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([sums[k].ravel() for k in ("start", "move", "emit", "log")])


def _unflat(x: np.ndarray, states: int) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, like in zero_sums(states).items():
        out[k] = x[at : at + like.size].reshape(like.shape)
        at += like.size
    return out


def _round(model: Hmm):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, task = zero_sums(len(model.start)), TaskContext.get().partitionId()
        for batch in batches:
            for row in range(batch.num_rows):
                obs, n = _training(batch, row)
                if len(n):
                    model.expect(obs, n, sums)
        parts = np.array_split(_flat(sums), PARTS)
        yield pa.record_batch({"part": pa.array(range(PARTS), pa.int32()), "slot": pa.array([task % 32] * PARTS, pa.int32()), "data": pa.array([p.tobytes() for p in parts], pa.binary())})

    return run


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py()) for x in table["data"])
    return pa.table({"part": table["part"].slice(0, 1).cast(pa.int32()), "slot": table["slot"].slice(0, 1).cast(pa.int32()), "data": pa.array([total.tobytes()], pa.binary())})


def start(share: np.ndarray, states: int = STATES) -> Hmm:
    """Starting model: the classes' shares over the whole corpus, tilted in each state by factors of their own."""
    emit = share[:, None] * np.random.default_rng(11).gamma(TILT, size=(len(share), states))
    move = np.full((states, states), 1.0) + np.eye(states) * STICK * states
    return Hmm(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def _score(model: Hmm, log_mass: np.ndarray, total: int, kinds: int):
    from math import log10

    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    floor = log10(total + kinds + 1)

    def block(batch: pa.RecordBatch, row: int, words: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(words)  # a block numbers its words in this order
        words, c = words[order], c[order]
        names, held, n = unpack_texts(batch["texts"][row].as_py())
        local = unpack_numbers(batch["tokens"][row].as_py())
        share, of_class = np.log10(c + 1.0), classes_of(words)
        inside = np.where(of_class == CLASSES, 0.0, share - log_mass[of_class])
        at = np.cumsum(n) - n
        add = lambda x: np.add.reduceat(x[local], at)
        return pa.record_batch([
            names, pa.array(held), pa.array(n), pa.array(add((c > 0).astype(np.int64))), pa.array(np.full(len(n), total)),
            pa.array(add(share) - n * floor), pa.array(model.score(of_class[local], n) / np.log(10) + add(inside)),
        ], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come block by block: the words with their counts, then the block itself."""
        words, c = [], []
        for batch in batches:
            own = np.flatnonzero(batch["tokens"].is_valid().to_numpy(zero_copy_only=False))
            word, count = (batch[x].fill_null(0).to_numpy() for x in ("word", "c"))  # nulls would make the numbers inexact
            low = 0
            for k in own.tolist():
                words.append(word[low:k].copy())
                c.append(count[low:k].copy())
                yield block(batch, k, np.concatenate(words).view(np.uint64), np.concatenate(c))
                words, c, low = [], [], k + 1
            words.append(word[low:].copy())
            c.append(count[low:].copy())

    return run


def train(encoded: DataFrame, share: np.ndarray, rounds: int = ROUNDS, states: int = STATES) -> Hmm:
    uniform = Hmm(np.full(states, 1 / states), np.full((states, states), 1 / states), np.repeat(share[:, None], states, 1))
    if encoded.where("trains").select("block").isEmpty():
        return uniform
    model = start(share, states)
    for _ in range(rounds):
        schema = "part int, slot int, data binary"
        sums = encoded.select("texts", "tokens", "words").mapInArrow(_round(model), schema)
        sums = sums.groupBy("part", "slot").applyInArrow(_add, schema).groupBy("part").applyInArrow(_add, schema)
        parts = {r["part"]: np.frombuffer(r["data"]) for r in sums.collect()}
        got = _unflat(np.concatenate([parts[k] for k in range(PARTS)]), states)
        model = Hmm.from_counts(got["start"], got["move"], got["emit"], share)
    return model


def numbered_blocks(encoded: DataFrame) -> tuple[DataFrame, int]:
    """encoded with a number for each block, 0 and up without gaps, and how many there are."""
    totals = encoded.groupBy(F.expr("block >> 24").cast("int").alias("task")).agg(F.count("*").alias("n")).orderBy("task").collect()  # one row a scan task
    before, offsets = 0, []
    for r in totals:
        offsets.append((r["task"], before))
        before += r["n"]
    table = encoded.sparkSession.createDataFrame(offsets, "task int, before long")
    number = (F.col("before") + F.expr("block & 16777215")).alias("number")
    return encoded.withColumn("task", F.expr("block >> 24").cast("int")).join(F.broadcast(table), "task").select(number, *encoded.columns), before


def language_scores(docs: DataFrame, rounds: int = ROUNDS, states: int = STATES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every document."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_FOLD, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held"), F.col("text").cast("string").alias("text"))
    encoded = materialize(rows.mapInArrow(_encode, ENCODED), "encoded")
    one = encoded.select(F.explode(F.arrays_zip("words", "counts")).alias("x")).select(F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    counts = materialize(one.groupBy("word").agg(F.sum("n").alias("c")), "counts")
    kind = F.when(F.col("word") == int(END_WORD), CLASSES).otherwise(F.expr(f"word & {CLASSES - 1}")).cast("int")
    facts = counts.where("c > 0").groupBy(kind.alias("class")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()  # CLASSES + 1 rows at most
    mass = np.ones(CLASSES + 1)
    for r in facts:
        mass[r["class"]] += r["c"] + r["v"]
    total, kinds = sum(r["c"] for r in facts), sum(r["v"] for r in facts)
    model = train(encoded, mass / mass.sum(), rounds, states)
    stored, n = numbered_blocks(encoded)
    asked = stored.select("number", F.explode("words").alias("word"))
    told = asked.join(counts.hint("merge"), "word").select("number", "word", "c")
    kept = stored.select("number", "texts", "tokens")  # the words come back with their counts
    both = told.unionByName(kept, allowMissingColumns=True)
    parts = max(1, min(n, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), -(-n // TASK_BLOCKS))
    dealt = both.repartitionById(parts, (F.col("number") % parts).cast("int")).sortWithinPartitions("number", F.col("tokens").isNotNull())
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.mapInArrow(_score(model, np.log10(mass), total, kinds), schema)
