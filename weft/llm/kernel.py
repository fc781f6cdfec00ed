"""Vectorised word and n-gram arithmetic on Arrow text batches.

A block joins whole documents, never cutting one, so memory follows the block limit or the longest
text, whichever is larger. Words are found on UTF-8 bytes (separators are ASCII). Words, lines and
pieces are identified by a 64-bit hash of their bytes and length: eight bytes at a time go through a
bijective mixer, and spans over LONG_SPAN bytes are hashed by XXH64. Two different spans meet with a
chance near 2**-64, unless someone searched for a pair that collides; identities are not compared further.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

BLOCK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
LONG_SPAN = 128  # bytes


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def span_hashes(units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit identities of spans of bytes or code points, by their bytes."""
    data = np.concatenate([np.ascontiguousarray(units).view(np.uint8), np.zeros(8, np.uint8)])
    eights = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))  # the eight bytes from each place on
    at, left = starts * units.itemsize, (ends - starts) * units.itemsize
    out = mix(left.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(_BASE))
    long = np.flatnonzero(left > LONG_SPAN)
    raw = memoryview(data)
    for k in long.tolist():
        out[k] = xxhash.xxh64_intdigest(raw[at[k] : at[k] + left[k]], LONG_SPAN)
    rest = np.flatnonzero((left > 0) & (left <= LONG_SPAN))
    at, left = at[rest], left[rest]
    while len(rest):
        chunk = eights[at] & _KEPT[np.minimum(left, 8)]
        out[rest] = mix((out[rest] ^ chunk) * np.uint64(_BASE))
        more = left > 8
        rest, at, left = rest[more], at[more] + 8, left[more] - 8
    return out


#: Masks of the first 0 to 8 bytes of a little-endian number.
_KEPT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class Block:
    """Words of some whole documents. starts/ends: byte bounds of words; first: index of each document's first word."""

    def __init__(self, docs: list[bytes], lower: bool = False):
        self.docs = docs
        self.n = len(docs)
        self.raw = b"\n".join(docs) + b"\n"
        data = np.frombuffer(self.raw, np.uint8)
        self.data = _LOWER[data] if lower else data
        lengths = np.fromiter(map(len, docs), np.int64, self.n)
        self.doc_end = np.cumsum(lengths + 1) - 1
        self.doc_start = self.doc_end - lengths
        self.space = _SPACE[self.data]
        edges = np.flatnonzero(self.space[1:] != self.space[:-1]) + 1
        if not self.space[0]:
            edges = np.concatenate(([0], edges))
        self.starts, self.ends = edges[0::2], edges[1::2]
        self.first = np.searchsorted(self.starts, np.append(self.doc_start, len(data)))
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.n), self.counts)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit identities of the byte spans."""
        return span_hashes(self.data, starts, ends)

    def word_hashes(self) -> np.ndarray:
        return self.spans(self.starts, self.ends)

    def per_doc(self, mask: np.ndarray) -> np.ndarray:
        """Sum of a value per byte over each document."""
        total = np.zeros(len(mask) + 1, np.int64 if mask.dtype.kind in "bui" else np.float64)
        np.cumsum(mask, out=total[1:])
        return total[self.doc_end] - total[self.doc_start]

    def per_words(self, value: np.ndarray) -> np.ndarray:
        """Sum of a value per word over each document."""
        total = np.zeros(len(value) + 1, np.int64 if value.dtype.kind in "bui" else np.float64)
        np.cumsum(value, out=total[1:])
        return total[self.first[1:]] - total[self.first[:-1]]

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r"""Bounds of the \n-split lines that have a word, and their documents."""
        stops = np.flatnonzero(self.data == 10)
        begins = np.concatenate(([0], stops[:-1] + 1))
        held = np.searchsorted(self.starts, stops) > np.searchsorted(self.starts, begins)
        begins, stops = begins[held], stops[held]
        return begins, stops, np.searchsorted(self.doc_start, begins, "right") - 1


def blocks(texts: pa.Array, lower: bool = False, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Block]]:
    """(low, high, block) over a string column; nulls count as empty."""
    low, held, size = 0, [], 0
    for k, text in enumerate(texts.cast(pa.large_binary())):
        value = text.as_py() or b""
        if held and size + len(value) > limit:
            yield low, k, Block(held, lower)
            low, held, size = k, [], 0
        held.append(value)
        size += len(value) + 1
    if held:
        yield low, low + len(held), Block(held, lower)


def repeats(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs twice or more."""
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def grams(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Identities of n-word windows inside one document, and their first words' positions."""
    m = max(len(h) - n + 1, 0)
    at = np.flatnonzero(doc[:m] == doc[n - 1 :]) if m else np.zeros(0, np.int64)
    key = np.zeros(len(at), np.uint64)
    for k in range(n):
        key = mix(key * np.uint64(_BASE) + h[at + k])
    return key, at


def text_facts(b: Block) -> dict[str, np.ndarray]:
    """The rule counts of each document of a block."""
    head = (b.data & 0xC0) != 0x80
    symbol = np.zeros(256, bool)
    symbol[list(b"#*$%&|<>")] = True
    h = b.word_hashes()
    key, at = grams(h, b.doc, 3)
    seen = np.zeros(len(h) + 2, bool)
    again = at[repeats(mix(key + b.doc[at].astype(np.uint64) * np.uint64(_BASE)))]
    for k in range(3):
        seen[again + k] = True
    begins, stops, doc = b.lines()
    line = mix(b.spans(begins, stops) + doc.astype(np.uint64) * np.uint64(_BASE))
    distinct = doc[np.unique(line, return_index=True)[1]]
    return {
        "n_words": b.counts.astype(np.int64),
        "word_chars": b.per_doc(head & ~b.space),
        "n_symbols": b.per_doc(symbol[b.data]),
        "n_dup_lines": np.bincount(doc, minlength=b.n) - np.bincount(distinct, minlength=b.n),
        "n_repeat_words": b.per_words(seen[: len(h)]),
        "hashes": h,
    }


def _points(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code points of a block (their bytes as one number), and each document's first one and its end among them."""
    head = np.flatnonzero((b.data & 0xC0) != 0x80)
    point = b.data[head].astype(np.uint32)
    wide = np.flatnonzero(point >= 0xC0)
    lead, at = point[wide], head[wide]
    for k, least in ((1, 0xC0), (2, 0xE0), (3, 0xF0)):
        has = lead >= least
        point[wide[has]] = point[wide[has]] << np.uint32(8) | b.data[at[has] + k]
    ends = np.searchsorted(head, b.doc_end)
    return point, np.concatenate(([0], ends[:-1] + 1)), ends


def _finish(key: np.ndarray) -> np.ndarray:
    key = key * np.uint32(0x9E3779B1)
    key ^= key >> np.uint32(15)
    return key


def char_grams(b: Block, *sizes: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each size (ascending): hashes of the grams of code points that lie inside one document, and their documents."""
    point, starts, ends = _points(b)
    doc = np.repeat(np.arange(b.n), ends - starts + 1)
    out, key, n = [], np.zeros(len(point), np.uint32), 0
    for size in sizes:
        for k in range(n, size):
            m = max(len(point) - k, 0)
            key = key[:m] * np.uint32(0x01000193) + point[k:]
        n = size
        inside = np.ones(len(key), bool)
        for end in ends.tolist():
            inside[max(end - n + 1, 0) : end + 1] = False
        out.append((_finish(key)[inside], doc[: len(key)][inside]))
    return out


def byte_grams(b: Block, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the byte n-grams that lie inside one document, and their first bytes' positions."""
    m = max(len(b.data) - n + 1, 0)
    key = np.zeros(m, np.uint32)
    for k in range(n):
        key = key * np.uint32(0x01000193) + b.data[k : k + m]
    key = _finish(key)
    inside = np.ones(m, bool)
    for end in b.doc_end:
        inside[max(end - n + 1, 0) : end + 1] = False
    at = np.flatnonzero(inside)
    return key[at], at
