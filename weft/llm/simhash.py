"""SimHash near-duplicates by anchor-point covering.

Fingerprints (64 bits) are cut into three parts of 21, 21 and 22 bits. Two fingerprints at 4 or fewer
differing bits differ in at most one bit of some part. The anchors of a part are the words of a linear
covering code (a shortened Hamming code; 5 check bits: covering radius 2). A part's home is its nearest
anchor, at most the covering radius away. Each fingerprint goes to its home and to every anchor within the
radius plus one that is home to a value one bit away: so any linked pair meets at the home of either. Per
anchor, homes are compared with all that came. Fewer check bits mean more anchors and smaller groups, at
more copies of each fingerprint; the code follows the number of fingerprints, from 5 check bits down to none,
so that an anchor gets about GROUP of them (see check_bits). Every code finds the same links.

Only distinct fingerprints are compared; copies share one. A task reads one partition sorted by anchor
and emits a spanning forest of the links it finds, never the pairs. An anchor with more than
SPLIT rows is cut into chunks and every pair of chunks becomes a group of its own, so no task holds more
than two chunks of one anchor; no pair is lost. Components come from repeated minimum exchange along
links (large star, small star); what a join meets is written to shared storage first, so that the engine can
split a hot key's rows.

Defined cases: a text without words (null or empty too) has fingerprint zero and links like any other;
fewer words than a shingle make one shingle; repeated rows share their component; a null doc_id counts
as a document of its own fingerprint, and is the component's id only if no other id is there; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from weft.llm.common import drop, fresh, identified, lean, materialize, octets, text_parts
from weft.llm.kernel import Block, blocks

SHINGLE_WORDS = 4
SEED = 42
MAX_DISTANCE = 4
PARTS = ((0, 21), (21, 21), (42, 22))  # (lowest bit, bits); MAX_DISTANCE < 2 * len(PARTS)
CHECK_BITS = 5  # at most
GROUP = 8192
SPLIT = 1 << 16
SHINGLES_AT_ONCE = 1 << 16


def runs(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts with about `limit` shingles, or of one text."""
    low, total = 0, 0
    for k, n in enumerate(sizes.tolist()):
        if total and total + n > limit:
            yield low, k
            low, total = k, 0
        total += n
    if len(sizes):
        yield low, len(sizes)


def _majority(joined: memoryview, starts: np.ndarray, ends: np.ndarray, b: Block, n_shingles: np.ndarray, low: int, high: int, words: int, seed: int) -> np.ndarray:
    """For each text from low to high: which of the 64 bits are set in over half of its shingles' hashes."""
    digest = xxhash.xxh64_intdigest
    counts = np.zeros((high - low, 64), np.int64)
    n = n_shingles[low:high]
    first = np.repeat(b.first[low:high] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    last = np.minimum(first + words, np.repeat(b.first[low + 1 : high + 1], n)) - 1
    text = np.repeat(np.arange(high - low), n)
    for at in range(0, len(first), SHINGLES_AT_ONCE):
        s, e, of = starts[first[at : at + SHINGLES_AT_ONCE]], ends[last[at : at + SHINGLES_AT_ONCE]], text[at : at + SHINGLES_AT_ONCE]
        h = np.fromiter((digest(joined[i:j], seed) for i, j in zip(s.tolist(), e.tolist(), strict=True)), np.uint64, len(s))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        begin = np.flatnonzero(np.diff(of, prepend=-1))
        for d, i, j in zip(of[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(s)], strict=True):
            counts[d] += bits[i:j].sum(0, dtype=np.int64)
    return counts * 2 > n[:, None]


def fingerprints(texts: pa.Array, words: int = SHINGLE_WORDS, seed: int = SEED) -> np.ndarray:
    """uint64 fingerprint of every text: a bit is set if it is set in over half of the shingles' XXH64."""
    out = []
    for _, _, b in blocks(texts, lower=True):
        keep = ~b.space
        keep[b.ends] = True
        data = b.data.copy()
        data[b.ends] = 0x20
        joined = memoryview(data[keep].tobytes())
        ends = np.cumsum(b.ends - b.starts + 1) - 1
        starts = ends - (b.ends - b.starts)
        n_shingles = np.where(b.counts > 0, np.maximum(b.counts - words + 1, 1), 0)
        over = np.zeros((b.n, 64), bool)
        for low, high in runs(n_shingles, SHINGLES_AT_ONCE):
            over[low:high] = _majority(joined, starts, ends, b, n_shingles, low, high, words, seed)
        out.append(np.packbits(over, axis=1, bitorder="little").view(np.uint64).ravel())
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _print_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            kept = {c: batch[c] for c in batch.schema.names if c != "text"}
            yield pa.record_batch(kept | {"print": pa.array(fingerprints(batch["text"]).view(np.int64))})


def document_prints(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and print of every document; kept0, kept1, ... are those columns (long) that keep names."""
    kept = [F.col(c).alias(f"kept{k}") for k, c in enumerate(keep)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *kept, F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(_print_rows), ", ".join(["doc_id long", *(f"kept{k} long" for k in range(len(keep))), "print long"]))


@lru_cache(maxsize=16)
def code(bits: int, checks: int = CHECK_BITS) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], int]:
    """The linear code of `bits` bits with `checks` check bits: syndromes of the low and of the high half's values;
    for each syndrome the flips that lead to anchors, the home's first; the covering radius.

    The others are the homes of all values one bit away: of the anchors within the radius plus one, those where
    a linked fingerprint can be at home."""
    columns = (np.arange(bits) % ((1 << checks) - 1) + 1 if checks else np.zeros(bits)).astype(np.int64)
    half = bits // 2

    def table(cols: np.ndarray) -> np.ndarray:
        out = np.zeros(1 << len(cols), np.int64)
        for k, c in enumerate(cols):
            out[1 << k : 1 << (k + 1)] = out[: 1 << k] ^ c
        return out

    leader = {0: 0}
    radius = 0
    while len(leader) < 1 << checks:  # by weight, then by lowest bits
        radius += 1
        for s, mask in list(leader.items()):
            for k, c in enumerate(columns.tolist()):
                if not mask >> k & 1:
                    leader.setdefault(s ^ c, mask | 1 << k)
    flips = [np.array(list(dict.fromkeys([leader[s], *((1 << k) ^ leader[s ^ c] for k, c in enumerate(columns.tolist()))])), np.int64) for s in range(1 << checks)]
    return table(columns[:half]), table(columns[half:]), flips, radius


def copies(checks: int) -> float:
    """How many anchors a fingerprint goes to, on average over all values."""
    return sum(np.mean([len(f) for f in code(bits, checks)[2]]) for _, bits in PARTS)


def check_bits(n: int, group: int = GROUP) -> int:
    """The most check bits, CHECK_BITS at most, with which an anchor gets about `group` of n fingerprints; one at least, so that
    there is a code at every size. Anchors beyond `group` are compared in pairs of chunks."""
    for checks in range(CHECK_BITS, 1, -1):
        if n * copies(checks) <= group * sum(1 << bits - checks for _, bits in PARTS):
            return checks
    return 1


def anchor_rows(prints: np.ndarray, checks: int = CHECK_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the fingerprint, anchor, is home) for all parts; an anchor carries its part's number above bit 24."""
    index, anchor, home = [], [], []
    for part, (shift, bits) in enumerate(PARTS):
        low, high, flips, _ = code(bits, checks)
        value = ((prints >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64)
        syndrome = low[value & ((1 << bits // 2) - 1)] ^ high[value >> (bits // 2)]
        for s, masks in enumerate(flips):
            at = np.flatnonzero(syndrome == s)
            index.append(np.repeat(at, len(masks)))
            anchor.append((value[at, None] ^ masks[None, :]).ravel() | (part << 24))
            home.append(np.tile(np.arange(len(masks)) == 0, len(at)))
    return np.concatenate(index), np.concatenate(anchor), np.concatenate(home)


def _replicate(checks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch["print"].to_numpy(zero_copy_only=False)
            for low in range(0, len(prints), 4096):
                part = prints[low : low + 4096]
                index, anchor, home = anchor_rows(part.view(np.uint64), checks)
                yield pa.record_batch({"anchor": pa.array(anchor.astype(np.int32)), "print": pa.array(part[index]), "home": pa.array(home)})

    return run


def forest(homes: np.ndarray, visitors: np.ndarray, distance: int = MAX_DISTANCE) -> list[tuple[int, int]]:
    """Links between homes and visitors (distinct uint64 each) that span all their links; at most one a value."""
    out: list[tuple[int, int]] = []
    group: dict[int, int] = {}
    of_visitor: np.ndarray | None = None
    step = max(1, (1 << 20) // max(1, len(visitors)))
    for low in range(0, len(homes), step):
        apart = np.bitwise_count(homes[low : low + step, None] ^ visitors[None, :])
        near = (apart <= distance) & (apart > 0)
        if not near.any():
            continue
        if of_visitor is None:  # a label for each visitor, moved in whole groups
            of_visitor = np.arange(len(visitors))
            place = {v: k for k, v in enumerate(visitors.tolist())}
        for a in np.flatnonzero(near.any(1)).tolist():
            home = int(homes[low + a])
            own = of_visitor[place[home]] if home in place else group.setdefault(home, -1 - len(group))
            b = np.flatnonzero(near[a])
            b = b[of_visitor[b] != own]
            if not len(b):
                continue
            labels, first = np.unique(of_visitor[b], return_index=True)
            joined = labels != own
            out += [(home, int(visitors[b[k]])) for k in first[joined].tolist()]
            if home in place:
                of_visitor[np.isin(of_visitor, labels[joined])] = own
            else:
                of_visitor[np.isin(of_visitor, labels)] = labels[0]
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (anchor, chunk pair); a group may cross batches."""

    def links(part: list[np.ndarray]) -> list[tuple[int, int]]:
        if len(part[0]) < 2:
            return []
        prints, home, a, b = part[1].view(np.uint64), part[2], part[4], part[5]
        side = part[3]
        left, right = side == a, side == b
        if a[0] == b[0]:
            return forest(prints[home], prints)
        return forest(prints[home & left], prints[right]) + forest(prints[home & right], prints[left])

    rest: list[np.ndarray] | None = None
    for batch in batches:
        columns = [batch[c].to_numpy(zero_copy_only=False) for c in ("anchor", "print", "home", "chunk", "low", "high")]
        if rest is not None:
            columns = [np.concatenate(x) for x in zip(rest, columns, strict=True)]
        if not len(columns[0]):
            continue
        new = (columns[0][1:] != columns[0][:-1]) | (columns[4][1:] != columns[4][:-1]) | (columns[5][1:] != columns[5][:-1])
        cuts = np.concatenate(([0], np.flatnonzero(new) + 1))
        out = []
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            if e - s > 1:
                out += links([c[s:e] for c in columns])
        rest = [c[cuts[-1] :] for c in columns]
        yield _edges(out)
    if rest is not None and len(rest[0]):
        yield _edges(links(rest))


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.record_batch({"a": pa.array(pairs[:, 0].copy()), "b": pa.array(pairs[:, 1].copy())})


def links(distinct: DataFrame, split: int = SPLIT, checks: int | None = None) -> DataFrame:
    """Links (a, b) that span every class of the distinct fingerprints within MAX_DISTANCE bits."""
    checks = check_bits(distinct.count()) if checks is None else checks
    rows = distinct.mapInArrow(lean(_replicate(checks)), "anchor int, print long, home boolean")
    hot = rows.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > split)
    hot = hot.select("anchor", F.ceil(F.col("n") / split).cast("int").alias("chunks"))
    marked = rows.join(hot, "anchor", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    marked = marked.withColumn("chunk", F.pmod(F.xxhash64("print", F.lit(1)), F.col("chunks")).cast("int"))
    # a row of chunk c meets every chunk k as the pair (min, max)
    paired = marked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    paired = paired.select("anchor", "print", "home", "chunk", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"))
    keys = ["anchor", "low", "high"]
    return paired.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lean(_compare), "a long, b long").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of the edges (a, b); root is the least node reachable.

    Alternating large-star and small-star rounds: neighbours are hung under the least neighbour, so the
    number of edges never grows and rounds grow with the logarithm of the longest chain."""
    now = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(max_rounds):
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.min("b").alias("m")), "least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
        large = materialize(large.where("a != b").distinct(), "large")
        small_least = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(small_least, "a")
        hung = small.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small_least.select("a", F.col("m").alias("b"))).distinct()
        after = materialize(hung, "edges")
        # stars alone: no node is both above and below another
        chained = after.select("b").distinct().join(after.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
        several = after.groupBy("a").agg(F.count("*").alias("n")).where("n > 1")
        drop(now, least, large, small_least)
        now = after
        if chained.isEmpty() and several.isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def classes(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, print, class (a fingerprint of the component) and component_id of every document, with document_prints' kept columns."""
    prints = materialize(document_prints(docs, keep), "prints")
    distinct = materialize(prints.groupBy("print").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct.select("print"))).select("root", F.col("node").alias("print"))
    members = roots.unionByName(roots.select("root", F.col("root").alias("print")).distinct())  # a root is no node of its own
    linked = materialize(members.join(distinct, "print"), "linked")
    least = materialize(linked.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = linked.join(least, "root").select("print", F.col("root").alias("class"), "component_id")
    alone = distinct.join(linked, "print", "left_anti").select("print", F.col("print").alias("class"), F.col("least").alias("component_id"))
    return prints.join(materialize(named.unionByName(alone), "named").hint("merge"), "print")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, print and component_id (least doc_id reachable over links) of every document."""
    return classes(docs).select("doc_id", "print", "component_id")


def survivors(docs: DataFrame) -> DataFrame:
    """One row of each component, all columns, whatever their names: the one of least doc_id (nulls last), of equal ones the first read."""
    file, place, of_file, of_place, size = fresh(docs, "file", "place", "of_file", "of_place", "octets")
    rows = identified(docs, file, place)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "kept0", "kept1")
    chosen = classes(rows.withColumn(size, octets(rows)), (file, place, size)).groupBy("class").agg(F.min(order).alias("least"), F.sum("kept2").alias("octets"))
    chosen = materialize(chosen.select(F.col("least.kept0").alias(of_file), F.col("least.kept1").alias(of_place), "octets"), "chosen")
    n = text_parts(chosen.agg(F.sum("octets")).first()[0])
    chosen = chosen.select(of_file, of_place).repartition(n, of_file, of_place)
    kept = rows.repartition(n, file, place).join(chosen.hint("merge"), (F.col(file) == F.col(of_file)) & (F.col(place) == F.col(of_place)))
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
