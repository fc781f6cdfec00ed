"""Byte-level BPE: whole texts to token ids, as the vocabulary file's tokenizer gives them, and back.

Texts are cut where the tokenizer splits in any case: before white space (ASCII) that follows something else. Each
distinct piece goes through the tokenizer once a worker (a bounded table keeps its ids); pieces are found on bytes, in bulk.

A piece longer than a leaf, unsplit text, is encoded as a tree: its leaves, cut at any code point, go through the
tokenizer together, and neighbours are joined pair by pair. A join encodes a window of both sides' tokens anew and
doubles it until both sides agree:

* left: the window's first token is the one that stood there, with at least three characters of the left side after it;
* right: either the window's text and the right side start a word of the tokenizer's at the same place, three characters
  or more before the window's end (both continue alike from there), or the window ends inside a word of the right side and
  its last token is the one that stood there.

This is exact: what the splitting rule decides at a place depends on three characters from there on and on nothing
before it, and ids of a word are its encoding if every two neighbours are the encoding of their joined text; at both
seams the neighbours are as before. If the sides never agree, the window ends up as the whole text.

Texts of more than `spread` bytes are dealt out: their parts are encoded by different tasks, then one task a text joins
them along the same tree. All other texts are encoded where they are read, without a shuffle.

Defined cases: a null text is an empty one, without ids; a null id is kept; repeated rows each get a row; the special
token's string inside a text is that token, as in the file's tokenizer; bytes that are not UTF-8 count as U+FFFD; a text
of any length is encoded whole (one text's ids meet in one task); an empty table gives an empty result; extra columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from weft.llm.kernel import span_hashes

LEAF = 1 << 13
SPREAD = 1 << 20
PART = 1 << 18
BLOCK_BYTES = 1 << 20
TABLE_PIECES, TABLE_IDS = 400_000, 1 << 22
STRUNG = 1 << 14
#: Marks a token that begins a word of the tokenizer's, the stretch that merges stay inside.
MARK = np.uint32(1 << 31)
#: Bytes that hold three characters in any case: as far as the splitting rule looks.
REACH = 12

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII that is certainly no white space, and last two bytes of code points that may be.
_SOLID = np.zeros(256, bool)
_SOLID[0x21:0x7F] = True
_DOUBTFUL = np.zeros(1 << 16, bool)
for _c in (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF):
    _b = chr(_c).encode()
    _DOUBTFUL[_b[-2] << 8 | _b[-1]] = True


def byte_symbols() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable Latin-1 for themselves, then from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + k): b for k, b in enumerate(others)}


def certain_cuts(data: np.ndarray) -> np.ndarray:
    """Places where any text is split: white space whose neighbour to the left is none."""
    at = np.flatnonzero(_WHITE[data])
    at = at[at > 0]
    left = data[at - 1]
    pair = data[np.maximum(at - 2, 0)].astype(np.int64) << 8 | left
    return at[_SOLID[left] | ((left >= 0x80) & ~_DOUBTFUL[pair])]


def _ends_solid(piece: bytes) -> bool:
    """Whether white space after the piece would be a certain cut."""
    return bool(_SOLID[piece[-1]] or (piece[-1] >= 0x80 and not _DOUBTFUL[piece[-2] << 8 | piece[-1]]))


class ByteBpe:
    """Encoder and decoder of one vocabulary file; it must be byte-level, split by the usual rule, without a normalizer."""

    def __init__(self, path: str, leaf: int = LEAF, table: int = TABLE_PIECES):
        from tokenizers import Tokenizer

        self.whole, self.leaf, self.table = Tokenizer.from_file(path), leaf, table
        self.whole.no_truncation()
        self.whole.no_padding()
        told = json.loads(self.whole.to_str())
        split, model = told["pre_tokenizer"] or {}, told["model"]
        if told["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex") or model.get("dropout"):
            raise ValueError(f"not a plain byte-level vocabulary: {path}")
        symbol, special = byte_symbols(), self.whole.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word or any(c.isspace() for c in t.content) for t in special.values()):
            raise ValueError("special tokens must stand for their own string, without white space")
        vocabulary = {i: t for t, i in self.whole.get_vocab().items()}
        self.bytes_of = [b""] * (max(vocabulary) + 1)
        for i, t in vocabulary.items():
            self.bytes_of[i] = t.encode() if i in special else bytes(symbol[c] for c in t)
        self.size = np.fromiter(map(len, self.bytes_of), np.int64, len(self.bytes_of))
        self.continues = np.array([bool(t) and 0x80 <= t[0] < 0xC0 for t in self.bytes_of])
        self.special = [t.content.encode() for t in special.values()]
        self.clear()

    def clear(self) -> None:
        self.slot: dict[int, int] = {}
        self.offset, self.length = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.ids, self.used = np.zeros(4096, np.uint32), 0

    # encoding

    def plain(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of texts by the tokenizer itself, marked."""
        out = []
        for e in self.whole.encode_batch([t.decode() for t in texts], add_special_tokens=False):
            ids, word = np.array(e.ids, np.uint32), np.array(e.word_ids, np.int64)
            out.append(ids | np.where(np.diff(word, prepend=-1) != 0, MARK, np.uint32(0)))
        return out

    def text_of(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, (ids & ~MARK).tolist()))

    def leaves(self, data: bytes, limit: int) -> list[bytes]:
        """data halved until no part is much above `limit`, cut between code points and never inside a special string."""
        n = 1
        while len(data) > n * limit:
            n *= 2
        held, edges = [(k, k + len(s)) for s in self.special for k in _found(data, s)], [0]
        for k in range(1, n):
            at = len(data) * k // n
            while at < len(data) and 0x80 <= data[at] < 0xC0:
                at += 1
            at = next((high for low, high in held if low < at < high), at)
            edges.append(max(at, edges[-1]))
        edges.append(len(data))
        return [data[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True) if a < b]

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The encoding of two texts' concatenation, of their encodings."""
        if not len(left) or not len(right):
            return np.concatenate([left, right])
        ids_left, ids_right, a, c = left & ~MARK, right & ~MARK, 8, 8
        while True:
            a, c = min(a, len(left)), min(c, len(right))
            while a < len(left) and self.continues[ids_left[-a]]:
                a += 1
            while c < len(right) and self.continues[ids_right[c]]:
                c += 1
            window = self.plain([self.text_of(left[-a:]) + self.text_of(right[:c])])[0]
            ids = window & ~MARK
            before, ends = int(self.size[ids_left[-a:]].sum()), np.cumsum(self.size[ids])
            agrees = a == len(left) or (before >= REACH and ids[0] == ids_left[-a])
            if agrees and (cut := self._meets(window, ends, right, c, before)):
                kept, rest = cut
                if a < len(left):
                    window[0] = left[-a]
                return np.concatenate([left[: len(left) - a], window[:kept], right[rest:]])
            a, c = 2 * a, 2 * c

    def _meets(self, window: np.ndarray, ends: np.ndarray, right: np.ndarray, c: int, before: int) -> tuple[int, int] | None:
        """How many of the window's tokens to keep and which of the right side's to go on with; none if they don't agree."""
        if c == len(right):
            return len(window), c
        total, starts = int(ends[-1]), ends - self.size[window & ~MARK]
        begun = before + np.cumsum(self.size[right[:c] & ~MARK]) - self.size[right[:c] & ~MARK]
        ours, theirs = starts[window >= MARK], begun[right[:c] >= MARK]
        if right[c] < MARK and window[-1] & ~MARK == right[c - 1] & ~MARK and total - max(ours[-1], theirs[-1]) >= REACH:
            return len(window), c
        both = np.intersect1d(ours, theirs)
        both = both[both <= total - REACH]
        if not len(both):
            return None
        return int(np.searchsorted(starts, both[0])), int(np.searchsorted(begun, both[0]))

    def fold(self, parts: list[np.ndarray]) -> np.ndarray:
        """The parts of one text joined as a tree."""
        while len(parts) > 1:
            parts = [self.join(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return parts[0] if parts else np.zeros(0, np.uint32)

    def tree(self, data: bytes) -> np.ndarray:
        return self.fold(self.plain(self.leaves(data, self.leaf)))

    def _pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of distinct pieces. Those that are cut off for certain on both sides are strung together, as that changes none."""
        out: list[np.ndarray | None] = [None] * len(pieces)
        strung = [k for k, p in enumerate(pieces) if len(p) <= self.leaf and _WHITE[p[0]] and _ends_solid(p)]
        kept = set(strung)
        for low in range(0, len(strung), STRUNG):
            some = strung[low : low + STRUNG]
            ids = self.plain([b"".join(pieces[k] for k in some)])[0]
            ends = np.cumsum([len(pieces[k]) for k in some])
            at = np.searchsorted(np.cumsum(self.size[ids & ~MARK]), ends)
            for k, x in zip(some, np.split(ids, at[:-1] + 1), strict=True):
                out[k] = x
        alone = [k for k, p in enumerate(pieces) if k not in kept and len(p) <= self.leaf]
        for k, x in zip(alone, self.plain([pieces[k] for k in alone]), strict=True):
            out[k] = x
        return [self.tree(p) if x is None else x for p, x in zip(pieces, out, strict=True)]

    def _add(self, keys: list[int], pieces: list[bytes]) -> None:
        parts = self._pieces(pieces)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        n, total = len(self.slot), int(sizes.sum())
        while len(self.ids) < self.used + total:
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.offset) < n + len(keys):
            self.offset, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.offset, self.length))
        self.ids[self.used : self.used + total] = np.concatenate(parts)
        self.offset[n : n + len(keys)] = self.used + np.cumsum(sizes) - sizes
        self.length[n : n + len(keys)] = sizes
        self.slot.update(zip(keys, range(n, n + len(keys)), strict=True))
        self.used += total

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Marked ids of whole texts (UTF-8)."""
        raw = b"".join(texts)
        data = np.frombuffer(raw, np.uint8)
        doc_start = np.cumsum([0, *map(len, texts)])
        if not len(data):
            return [np.zeros(0, np.uint32)] * len(texts)
        begin = np.unique(np.concatenate([doc_start[:-1][np.diff(doc_start) > 0], certain_cuts(data)]))
        finish = np.append(begin[1:], len(data))
        keys, at, of_piece = np.unique(span_hashes(data, begin, finish), return_index=True, return_inverse=True)
        if len(self.slot) + len(keys) > self.table or self.used > TABLE_IDS:
            self.clear()
        slots = np.fromiter(map(self.slot.get, keys.tolist(), repeat(-1)), np.int64, len(keys))
        fresh = np.flatnonzero(slots < 0)
        if len(fresh):
            slots[fresh] = np.arange(len(self.slot), len(self.slot) + len(fresh))
            self._add(keys[fresh].tolist(), [raw[s:e] for s, e in zip(begin[at[fresh]].tolist(), finish[at[fresh]].tolist(), strict=True)])
        slot = slots[of_piece]
        sizes = self.length[slot]
        ends = np.cumsum(sizes)
        flat = self.ids[np.repeat(self.offset[slot] - (ends - sizes), sizes) + np.arange(ends[-1])]
        cut = np.concatenate(([0], ends))[np.searchsorted(begin, doc_start)]
        return [flat[s:e] for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]

    # decoding

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special tokens included; bytes that are not UTF-8 become U+FFFD."""
        return self.text_of(ids).decode("utf-8", "replace")


def _found(data: bytes, part: bytes) -> Iterator[int]:
    at = data.find(part)
    while at >= 0:
        yield at
        at = data.find(part, at + len(part))


def clean(text: bytes | None) -> bytes:
    """UTF-8 of a text; nulls are empty."""
    try:
        (text or b"").decode()
    except UnicodeDecodeError:
        return text.decode("utf-8", "replace").encode()
    return text or b""


def text_blocks(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, whole texts) of about BLOCK_BYTES or one text."""
    low, held, size = 0, [], 0
    for k, text in enumerate(texts.cast(pa.large_binary())):
        value = clean(text.as_py())
        if held and size + len(value) > BLOCK_BYTES:
            yield low, held
            low, held, size = k, [], 0
        held.append(value)
        size += len(value)
    if held:
        yield low, held


_coders: dict[str, ByteBpe] = {}


def coder(path: str) -> ByteBpe:
    """One a worker."""
    if path not in _coders:
        _coders[path] = ByteBpe(path)
    return _coders[path]


#: What becomes of rows: (doc ids, their ids, the coder) to a record batch.
Finish = Callable[[pa.Array, list[np.ndarray], ByteBpe], pa.RecordBatch]


def _whole(path: str, finish: Finish):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, texts in text_blocks(batch["text"]):
                yield finish(batch["doc_id"].slice(low, len(texts)), coder(path).encode(texts), coder(path))

    return run


PARTS = "doc_id long, task int, row long, part int, body binary"


def _split(path: str, limit: int):
    """Parts of long texts; a text is known by the task that read it and its number there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, row = TaskContext.get(), 0
        task = context.partitionId() if context else 0
        for batch in batches:
            for k in range(batch.num_rows):
                parts = coder(path).leaves(clean(batch["text"][k].cast(pa.large_binary()).as_py()), limit)
                row += 1
                n = len(parts)
                yield pa.record_batch([batch["doc_id"].take(pa.array([k] * n)), pa.array([task] * n, pa.int32()), pa.array([row] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(parts, pa.binary())], names=[x.split()[0] for x in PARTS.split(", ")])

    return run


def _encode_parts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, texts in text_blocks(batch["body"]):
                ids = [x.tobytes() for x in coder(path).encode(texts)]
                yield batch.slice(low, len(texts)).set_column(4, "body", pa.array(ids, pa.binary()))

    return run


def _fold(path: str, finish: Finish):
    def run(group: pa.Table) -> pa.Table:
        rows = group.sort_by("part")
        ids = coder(path).fold([np.frombuffer(x, np.uint32) for x in rows["body"].to_pylist()])
        return pa.Table.from_batches([finish(rows["doc_id"].combine_chunks().slice(0, 1), [ids], coder(path))])

    return run


def encoded(docs: DataFrame, path: str, finish: Finish, schema: str, spread: int = SPREAD, part: int = PART) -> DataFrame:
    """`finish` of every document's marked ids."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    long = F.coalesce(F.octet_length("text") > spread, F.lit(False))
    parts = rows.where(long).mapInArrow(_split(path, part), PARTS).repartition("task", "row", "part").mapInArrow(_encode_parts(path), PARTS)
    return rows.where(~long).mapInArrow(_whole(path, finish), schema).unionByName(parts.groupBy("task", "row").applyInArrow(_fold(path, finish), schema))


def _lists(names: pa.Array, ids: list[np.ndarray], _: ByteBpe) -> pa.RecordBatch:
    flat = (np.concatenate(ids) & ~MARK).astype(np.int32)
    return pa.record_batch({"doc_id": names, "ids": pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(flat))})


def encode(docs: DataFrame, path: str, spread: int = SPREAD, part: int = PART) -> DataFrame:
    """(doc_id, ids) of every document."""
    return encoded(docs, path, _lists, "doc_id long, ids array<int>", spread, part)


def decode(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x.values is None else coder(path).decode(x.values.to_numpy().astype(np.uint32)) for x in batch["ids"]]
            yield pa.record_batch({"doc_id": batch["doc_id"], "text": pa.array(texts, pa.string())})

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digests(names: pa.Array, ids: list[np.ndarray], codec: ByteBpe) -> pa.RecordBatch:
    plain = [(x & ~MARK).astype("<u4") for x in ids]
    sha = lambda data: hashlib.sha256(data).hexdigest()
    return pa.record_batch({"doc_id": names, "n_tokens": pa.array([len(x) for x in plain], pa.int64()), "ids_sha256": pa.array([sha(x.tobytes()) for x in plain], pa.string()), "decoded_sha256": pa.array([sha(codec.decode(x).encode()) for x in plain], pa.string())})


def digests(docs: DataFrame, path: str, spread: int = SPREAD, part: int = PART) -> DataFrame:
    """Every document's number of ids, their digest and that of the text that they decode to."""
    return encoded(docs, path, _digests, DIGESTS, spread, part)
