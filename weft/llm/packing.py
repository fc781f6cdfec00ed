"""Best-fit packing of token pieces by exact complements.

Documents become token ids followed by an end id; only documents longer than a sequence are cut. How a
sequence is filled depends on lengths alone, so the plan is made on the histogram of lengths (at most
`capacity` numbers, whatever the corpus). Longest first, a length's gap is looked up in the index of the
single, pair and triple sums of the available lengths (see Sums) and filled exactly by what is filed
there; where no exact filling is left, best fit: the longest length that still fits, again and again.
Each pattern is used as often as its counts allow, so every step uses up some length and the plan has at
most a few thousand patterns. A piece finds its place from its length and its rank within that length;
ranks are counted in each scan task and shifted by the totals of the tasks before.

A worker keeps the ids of a bounded number of distinct pieces of text (see TokenEncoder), so the tokenizer
sees each piece of a task about once.

Defined cases: a null text is an empty one: one piece of the end id alone; repeated rows are packed once
each; a null doc_id is kept; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from weft.llm.common import lean, materialize
from weft.llm.kernel import span_hashes

CAPACITY = 2048
END_ID = 0
BLOCK = 1 << 20
TABLE_PIECES = 400_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long"


#: Classes of code points for the vocabulary's splitting rule; STRANGE ones are not assigned in Python's tables.
SPACE, LETTER, NUMBER, OTHER, STRANGE = 0, 1, 2, 3, 4


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER, "Z": SPACE, "Cn": STRANGE}
    names = map(unicodedata.category, map(chr, range(0x110000)))
    out = np.fromiter((kinds.get(name, kinds.get(name[0], OTHER)) for name in names), np.uint8, 0x110000)
    out[[*range(0x09, 0x0E), 0x85]] = SPACE
    return out


def strange(text: str) -> bool:
    return not text.isascii() and bool((classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)] == STRANGE).any())


class TokenEncoder:
    """Ids of whole texts by the vocabulary file; holds the ids of at most `table` distinct pieces.

    The file's rule lower-cases composed (NFC) text and cuts it into runs of letters, single numbers and runs
    of anything else but space; each piece is encoded alone. Pieces are found on code points in bulk and only
    new ones go through the tokenizer. Texts with an apostrophe, which the rule treats by cases, a capital
    sigma, whose lower case depends on its place, a special token's string or a code point that Python's tables
    don't know, while the tokenizer's may, go through the tokenizer whole."""

    def __init__(self, path: str, table: int = TABLE_PIECES):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole, self.table = Tokenizer.from_file(path), table
        self.single = Tokenizer(self.whole.model)
        self.single.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.whole.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a piece
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.slot: dict[int, int] = {}
        self.offset, self.length = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.ids, self.used = np.zeros(4096, np.uint32), 0

    def _add(self, keys: list[int], pieces: list[str]) -> None:
        ids = np.array(self.single.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, np.uint32)
        sizes = np.diff(np.flatnonzero(self.closes[ids]), prepend=-1)
        n, total = len(self.slot), int(sizes.sum())
        while len(self.ids) < self.used + total:
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.offset) < n + len(keys):
            self.offset, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.offset, self.length))
        self.ids[self.used : self.used + total] = ids
        self.offset[n : n + len(keys)] = self.used + np.cumsum(sizes) - sizes
        self.length[n : n + len(keys)] = sizes
        self.slot.update(zip(keys, range(n, n + len(keys)), strict=True))
        self.used += total

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        odd = [k for k, t in enumerate(texts) if "'" in t or "\u03a3" in t or any(x in t for x in self.special) or strange(t)]
        plain = list(texts)
        for k in odd:
            plain[k] = ""
        plain = [(t if t.isascii() or unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t)).lower() for t in plain]
        out = self._encode(plain)
        for k, e in zip(odd, self.whole.encode_batch_fast([texts[k] for k in odd], add_special_tokens=False) if odd else [], strict=True):
            out[k] = np.array(e.ids, np.uint32)
        return out

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        joined = "\n".join(texts) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = classes()[points]
        begin = np.flatnonzero((kind != SPACE) & np.concatenate(([True], (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER))))
        finish = np.flatnonzero((kind[:-1] != SPACE) & ((kind[1:] != kind[:-1]) | (kind[:-1] == NUMBER))) + 1
        keys, at, of_piece = np.unique(span_hashes(points, begin, finish), return_index=True, return_inverse=True)
        if len(self.slot) + len(keys) > self.table:
            self.clear()
        slots = np.fromiter(map(self.slot.get, keys.tolist(), repeat(-1)), np.int64, len(keys))
        fresh = np.flatnonzero(slots < 0)
        if len(fresh):
            slots[fresh] = np.arange(len(self.slot), len(self.slot) + len(fresh))
            self._add(keys[fresh].tolist(), [joined[s:e] for s, e in zip(begin[at[fresh]].tolist(), finish[at[fresh]].tolist(), strict=True)])
        slot = slots[of_piece]
        sizes = self.length[slot]
        ends = np.cumsum(sizes)
        flat = self.ids[np.repeat(self.offset[slot] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        doc_start = np.cumsum([0, *(len(t) + 1 for t in texts)])
        cut = np.concatenate(([0], ends))[np.searchsorted(begin, doc_start)]
        return [flat[s:e] for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def batches_of(texts: Iterable[str | None], limit: int = BLOCK) -> Iterator[tuple[int, list[str]]]:
    """(first index, whole texts) with about `limit` characters or one text; nulls count as empty."""
    low, held, size = 0, [], 0
    for k, text in enumerate(texts):
        if held and size + len(text or "") > limit:
            yield low, held
            low, held, size = k, [], 0
        held.append(text or "")
        size += len(text or "")
    if held:
        yield low, held


_encoders: dict[str, TokenEncoder] = {}


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:  # one a worker
            _encoders[path] = TokenEncoder(path)
        encoder = _encoders[path]
        context = TaskContext.get()
        task, seen = context.partitionId() if context else 0, Counter()
        for batch in batches:
            names = batch["doc_id"].to_pylist()
            for low, texts in batches_of(x.as_py() for x in batch["text"]):
                rows = []
                for d, ids in enumerate(encoder.encode(texts)):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for k, start in enumerate(range(0, len(ids), capacity)):
                        part = ids[start : start + capacity]
                        rows.append((names[low + d], k, start, len(part), zlib.crc32(part.tobytes()), task, seen[len(part)]))
                        seen[len(part)] += 1
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    return run


class Sums:
    """Index of the sums of one, two and three available lengths: a sum's entry is the filling with the largest member.

    Lengths only become fewer, so an entry that no longer holds is filed anew from its largest member downwards,
    and a sum without a filling stays without one. A sum is asked for by one length only, its complement; that
    length's own piece is set aside (`taken`) when an entry is tested."""

    def __init__(self, left: np.ndarray):
        self.left = left
        at = np.flatnonzero(left)
        self.pairs: dict[int, int] = {}  # sum to the larger member
        for x in at.tolist():  # ascending, so the largest member is filed last
            self.pairs.update(zip((x + at[at <= x]).tolist(), repeat(x)))
        self.triples: dict[int, int] = {}  # sum to the largest member
        self.longest = int(at[-1]) if len(at) else 0

    def _held(self, need: Counter) -> bool:
        return all(self.left[k] >= v for k, v in need.items())

    def single(self, total: int, taken: Counter) -> tuple[int, ...] | None:
        return (total,) if self._held(taken + Counter((total,))) else None

    def _pair_from(self, total: int, most: int, taken: Counter) -> tuple[int, ...] | None:
        """The pair whose larger member is the largest one up to `most`."""
        a = np.arange(min(total - 1, most), (total - 1) // 2, -1)
        for x in a[(self.left[a] > 0) & (self.left[total - a] > 0)].tolist() if len(a) else ():
            if self._held(taken + Counter((x, total - x))):
                return x, total - x
        return None

    def pair(self, total: int, taken: Counter) -> tuple[int, ...] | None:
        if total not in self.pairs:
            return None
        found = self._pair_from(total, self.pairs[total], taken)
        if found:
            self.pairs[total] = found[0]
        else:
            del self.pairs[total]
        return found

    def triple(self, total: int, taken: Counter) -> tuple[int, ...] | None:
        for a in range(min(self.triples.get(total, total - 2), self.longest), (total - 1) // 3, -1):
            if self.left[a] > taken[a] and total - a in self.pairs and (found := self._pair_from(total - a, a, taken + Counter((a,)))):
                self.triples[total] = a
                return a, *found
        self.triples[total] = 0
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of one sequence, how many such sequences) that use up all counts."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    sums = Sums(left)
    out: list[tuple[tuple[int, ...], int]] = []

    def use(items: tuple[int, ...]) -> None:
        need = Counter(items)
        n = min(int(left[x]) // k for x, k in need.items())
        for x, k in need.items():
            left[x] -= n * k
        out.append((items, n))

    def best_fit(length: int) -> tuple[int, ...]:
        chosen, gap = Counter((length,)), capacity - length
        items = []
        while gap:
            fits = np.flatnonzero(left[1 : gap + 1] > 0) + 1
            best = next((x for x in fits[::-1].tolist() if left[x] > chosen[x]), None)
            if best is None:
                break
            items.append(best)
            chosen[best] += 1
            gap -= best
        return tuple(items)

    for length in range(capacity, 0, -1):
        while left[length]:
            gap, taken = capacity - length, Counter((length,))
            items = () if not gap else sums.single(gap, taken) or sums.pair(gap, taken) or sums.triple(gap, taken)
            use((length, *(best_fit(length) if items is None else items)))
    return out


def places(patterns: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, number, first sequence, offset), sorted by length and rank."""
    rows, ranks, sequence = [], Counter(), 0
    for items, n in patterns:
        offset = 0
        for length in items:
            rows.append((length, ranks[length], n, sequence, offset))
            ranks[length] += n
            offset += length
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _place(table: np.ndarray):
    key = table[:, 0] << 40 | table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            row = table[np.searchsorted(key, length << 40 | rank, "right") - 1]
            kept = {c: batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
            yield pa.record_batch(kept | {"sequence_id": pa.array(row[:, 3] + rank - row[:, 1]), "offset": pa.array(row[:, 4].copy())})

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = materialize(rows.mapInArrow(lean(_pieces(tokenizer_path, capacity, end_id)), PIECES), "pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    shifts = by_task.select("length", "task", F.coalesce(before, F.lit(0)).alias("shift"))
    ranked = pieces.join(shifts, ["length", "task"]).withColumn("rank", F.col("rank") + F.col("shift"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(lean(_place(places(plan(counts, capacity)))), schema)
