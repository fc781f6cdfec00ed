"""Words to frames, frames to runs, tokens to patches (SEQ4-SEQ7, J4, J5, W9, W10, W13, W14)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from weft.functions.numeric import bind, run_starts

TOLERANCE = 1e-3
_SPANS = ArrayType(StructType().add("low", "integer").add("high", "integer").add("ids", ArrayType(IntegerType())))
_RESULT = StructType().add("previous_end", "integer").add("spans", _SPANS).add("error", "string")
_RUNS = ArrayType(StructType().add("token", "integer").add("duration", "integer"))


def word_spans(words: Column, steps: Column, seconds: Column, frame_to_code: Column | None = None) -> Column:
    """struct(previous_end, spans, error) of words (text, start, end, ids with the end of word), in time linear in their number.

    A word starts no earlier than the one before ends, and needs a step for each id: its end is the larger of a place of
    its own and the end before plus its ids, capped at the last step. Ends of that form are running maxima of
    (own place - ids so far), so a row needs no loop. Without a map, times scale to steps; with one, to frames and then
    through the frames' runs. The first invalid word sets the error and ends the spans. Null words give null."""
    shaped = F.transform(words, lambda w: F.struct(w["text"].cast("string").alias("text"), w["start"].cast("double").alias("start"), w["end"].cast("double").alias("end"), w["ids"].cast("array<int>").alias("ids")))
    codes = F.lit(None) if frame_to_code is None else frame_to_code
    return _word_spans(shaped, steps.cast("int"), seconds.cast("double"), codes.cast("array<int>"))


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(first entry of each row and the end, row of each entry, entries) of a list column; nulls are empty."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.concatenate(([0], np.cumsum(sizes))).astype(np.int64), np.repeat(np.arange(len(sizes)), sizes), pc.list_flatten(lists)


def _along(values: np.ndarray, row: np.ndarray, f: np.ufunc) -> np.ndarray:
    """Running maxima within each row; the rows' ranges are moved apart."""
    width = int(values.max() - values.min()) + 1 if len(values) else 1
    return f.accumulate(values + row * width) - row * width


def _before(values: np.ndarray, first: np.ndarray, row: np.ndarray, start: int) -> np.ndarray:
    """Each entry's predecessor within its row, `start` for the first."""
    out = np.concatenate((values[:1], values[:-1]))
    out[first[row] == np.arange(len(values))] = start
    return out


@F.arrow_udf(_RESULT)
def _word_spans(words: pa.Array, steps: pa.Array, seconds: pa.Array, codes: pa.Array) -> pa.Array:
    first, row, flat = _flat(words)
    field = lambda name: pc.struct_field(flat, name)
    number = lambda name: pc.fill_null(field(name), np.nan).to_numpy(zero_copy_only=False)
    begin, end = number("start"), number("end")
    text = pc.equal(pc.utf8_trim(pc.fill_null(field("text"), ""), " "), "").to_numpy(zero_copy_only=False)
    ids = pc.fill_null(pc.list_value_length(field("ids")), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    total = pc.fill_null(steps, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    length = pc.fill_null(seconds, 0.0).to_numpy(zero_copy_only=False)
    at, span = total[row], length[row]
    bad = text | np.isnan(begin) | np.isnan(end) | ~(end > begin)
    outside = ~bad & ((begin < 0) | (end > span + TOLERANCE))
    whole = lambda x: np.where(np.isfinite(x), x, 0).clip(-(2**40), 2**40).astype(np.int64)
    with np.errstate(all="ignore"):
        low, high = (begin / span, end / span)
    map_first, _, map_flat = _flat(codes)
    if codes.null_count < len(codes):
        frames = np.diff(map_first)[row] - 1
        code = map_flat.to_numpy(zero_copy_only=False).astype(np.int64)
        place = lambda k: code[(map_first[:-1][row] + k).clip(0, max(len(code) - 1, 0))]
        own = place(np.maximum(0, np.minimum(frames - 1, whole(np.floor(low * frames)))))
        reach = np.minimum(at - 1, place(np.maximum(1, np.minimum(frames, whole(np.ceil(high * frames)))) - 1) + 1)
    else:
        own = np.minimum(at - 1, whole(np.rint(low * at)))
        reach = np.minimum(at, np.maximum(own + 1, whole(np.rint(high * at))))
    need = np.maximum(ids, 0)
    so_far = np.cumsum(need)
    so_far -= (so_far - need)[first[:-1].clip(max=max(len(need) - 1, 0))][row] if len(need) else 0
    ends = np.minimum(at, np.maximum(_along(np.maximum(reach, own + need) - so_far, row, np.maximum) + so_far, so_far))
    lows = np.maximum(_before(ends, first, row, 0), own)
    why = np.select([bad, outside, (lows >= at) | (reach <= lows), ends - lows < ids], [1, 2, 3, 4], 0)
    wrong = np.flatnonzero(why)
    kept, error = np.diff(first).copy(), np.zeros(len(total), np.int64)
    error[(kept == 0) | (length <= 0)] = 5
    kept[error == 5] = 0
    of_row, at_first = np.unique(row[wrong], return_index=True)
    of_row, at_first = (x[error[of_row] == 0] for x in (of_row, wrong[at_first]))
    error[of_row], kept[of_row] = why[at_first], at_first - first[of_row]
    use = np.arange(len(row)) < (first[:-1] + kept)[row]
    last = np.zeros(len(total), np.int32)
    some = kept > 0
    last[some] = ends[(first[:-1] + kept - 1)[some]]
    entries = pa.StructArray.from_arrays([pa.array(lows[use].astype(np.int32)), pa.array(ends[use].astype(np.int32)), field("ids").filter(pa.array(use))], ["low", "high", "ids"])
    spans = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(kept))), pa.int32()), entries)
    none = pc.is_null(words)
    told = pa.array([None, "invalid timestamp", "outside the audio", "outside usable steps", "too few steps for its tokens", "no words or no audio"]).take(pa.array(error))
    return pa.StructArray.from_arrays([pa.array(last), spans, told], ["previous_end", "spans", "error"], mask=none)


def runs_from_spans(spans: Column, steps: Column, pad: int) -> Column:
    """array<struct(token, duration)> over all steps, in linear time: spans spread over their ids (linspace's whole points), gaps
    padded, equal neighbours merged. Null spans give null."""
    return _runs(spans, steps.cast("int"), F.lit(pad))


@F.arrow_udf(_RUNS)
def _runs(spans: pa.Array, steps: pa.Array, pad: pa.Array) -> pa.Array:
    first, row, flat = _flat(spans)
    low, high = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("low", "high"))
    id_first, of_span, ids = _flat(flat.field("ids"))
    ids, n = ids.to_numpy(zero_copy_only=False).astype(np.int64), np.diff(id_first)[of_span]
    place = np.arange(len(ids)) - id_first[of_span]
    point = lambda k: np.where(k == n, high[of_span], np.floor(k * ((high - low)[of_span] / n) + low[of_span])).astype(np.int64)
    begins, ends, of_row = point(place), point(place + 1), row[of_span]
    held = ends > begins
    token, begins, ends, of_row = ids[held], begins[held], ends[held], of_row[held]
    total = pc.fill_null(steps, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    fill = pad[0].as_py() if len(pad) else 0
    piece_first = np.searchsorted(of_row, np.arange(len(total) + 1))
    before = _before(ends, piece_first, of_row, 0)
    done = np.zeros(len(total), np.int64)
    some = np.diff(piece_first) > 0
    done[some] = ends[piece_first[1:][some] - 1]
    # the gap before a piece, the piece, and each row's gap at the end
    rows = np.concatenate((np.repeat(of_row, 2), np.arange(len(total))))
    tokens = np.concatenate((np.stack((np.full(len(token), fill), token), 1).ravel(), np.full(len(total), fill)))
    sizes = np.concatenate((np.stack((begins - before, ends - begins), 1).ravel(), total - done))
    order = np.argsort(rows, kind="stable")
    order = order[sizes[order] > 0]
    rows, tokens, sizes = rows[order], tokens[order], sizes[order]
    new = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]) | (tokens[1:] != tokens[:-1])))[: len(rows)])
    merged = np.add.reduceat(sizes, new) if len(new) else sizes
    entries = pa.StructArray.from_arrays([pa.array(tokens[new].astype(np.int32)), pa.array(merged.astype(np.int32))], ["token", "duration"])
    out = pa.ListArray.from_arrays(pa.array(np.searchsorted(rows[new], np.arange(len(total) + 1)), pa.int32()), entries)
    return pc.if_else(pc.is_null(spans), pa.scalar(None, out.type), out)


def frame_starts(words: Column, frames: Column, seconds: Column) -> Column:
    """SEQ5 spans: [start frame, next start) of each word (start, ids without the end of word); no carried state."""
    first = lambda w: F.least(frames - 1, F.rint(w["start"] / seconds * frames).cast("int"))
    return bind(words, lambda ws: F.transform(ws, lambda w, i: bind(F.get(ws, i + 1), lambda after: F.struct(first(w).alias("low"), F.when(after.isNull(), frames).otherwise(first(after)).alias("high"), w["ids"].alias("ids")))))


def frame_alignment_error(spans: Column) -> Column:
    return F.exists(spans, lambda p: (F.size(p["ids"]) == 0) | (p["high"] - p["low"] < F.size(p["ids"]) + 1))


def frame_tokens(spans: Column, frames: Column, pad: int, end_of_word: int) -> Column:
    """One token a frame: ids at the start, the end of word in the last frame before the next word, else padding."""
    parts = F.transform(spans, lambda p: F.concat(p["ids"], F.array_repeat(F.lit(pad), p["high"] - p["low"] - F.size(p["ids"]) - 1), F.array(F.lit(end_of_word))))
    lead = F.array_repeat(F.lit(pad), F.try_element_at(spans, F.lit(1))["low"])
    return F.concat(lead, F.flatten(parts), F.array(F.lit(pad)))


def run_length(tokens: Column) -> Column:
    """array<struct(token, duration)> of an array's runs (AGG6)."""
    return bind(tokens, lambda ts: bind(run_starts(ts), lambda at: F.transform(at, lambda s, k: F.struct(F.get(ts, s).alias("token"), (F.coalesce(F.get(at, k + 1), F.size(ts)) - s).alias("duration")))))


def tokens_to_words(tokens: DataFrame, words: DataFrame, keys: list[str]) -> DataFrame:
    """Each token's first overlapping word (J4): tokens (token_index, start, end) and words (word, start, end) in
    characters, words in order and apart. Tokens without one drop out.

    The first word that ends after a token's start is the only candidate: its number is how many words end before. So
    both sides are counted in one sorted pass and meet by an equal number; no pair beyond that is made."""
    by = Window.partitionBy(*keys)
    ends = words.select(*keys, F.col("end").alias("__at"), F.lit(0).alias("__kind"), F.lit(None).cast("long").alias("token_index"), F.lit(None).cast("long").alias("__stop"))
    begins = tokens.select(*keys, F.col("start").alias("__at"), F.lit(1).alias("__kind"), F.col("token_index").cast("long"), F.col("end").cast("long").alias("__stop"))
    counted = ends.unionByName(begins).withColumn("__rank", F.sum(1 - F.col("__kind")).over(by.orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)))
    ranked = words.withColumn("__rank", F.row_number().over(by.orderBy("end", "word")).cast("long") - 1)
    met = counted.where("__kind = 1").join(ranked.select(*keys, "__rank", "word", F.col("start").alias("__from")), [*keys, "__rank"])
    return met.where("__from < __stop").select(*keys, F.col("token_index").cast(tokens.schema["token_index"].dataType).alias("token_index"), "word")


def patch_writes(words: DataFrame, keys: list[str]) -> DataFrame:
    """SEQ6 writes (keys, patch, write, token): words has word, start, end, next_start, length and tokens.

    marker: the patch before the word (its first at 0) gets the end of word; tokens follow while they fit before the
    word's end, the next word and the last patch. Later writes win; the caller keeps the last of each patch."""
    usable = F.col("length") - 1
    marker = F.when(F.col("start") == 0, 0).otherwise(F.col("start") - 1)
    first = F.greatest(F.col("start"), marker + 1)
    limit = F.least(F.col("end"), F.coalesce("next_start", usable), usable)
    placed = F.filter(F.transform("tokens", lambda t, i: F.struct((first + i).alias("patch"), (i + 1).alias("write"), t.alias("token"))), lambda x: x["patch"] < limit)
    mark = F.when(marker < usable, F.array(F.struct(marker.alias("patch"), F.lit(0).alias("write"), F.lit(None).cast("int").alias("token"))))
    every = F.concat(F.coalesce(mark, F.array().cast("array<struct<patch:int,write:int,token:int>>")), placed)
    return words.select(*keys, "word", F.explode(every).alias("x")).select(*keys, "word", "x.patch", "x.write", "x.token")


def aligned_patches(words: DataFrame, keys: list[str], end_of_word: int) -> DataFrame:
    """keys, patch and the token that remains (end of word where the mark does); patches without a write are padding."""
    writes = patch_writes(words, keys)
    last = writes.groupBy(*keys, "patch").agg(F.max(F.struct("word", "write", F.coalesce("token", F.lit(end_of_word)).alias("token"))).alias("x"))
    return last.select(*keys, "patch", "x.token")


def patch_array(words: Column, length: Column, end_of_word: int) -> Column:
    """aligned_patches within a row: array<struct(patch, token)> of words (start, end, tokens) on `length` patches.

    Words stand in order of start, so a word's writes end before the next start and only the next word's mark, one patch
    before that start, can win over one of them."""
    usable = length - 1
    mark_of = lambda start: F.when(start == 0, 0).otherwise(start - 1)
    one = lambda patch, token: F.struct(patch.cast("int").alias("patch"), token.cast("int").alias("token"))

    def writes(w: Column, after: Column) -> Column:
        first = F.greatest(w["start"], mark_of(w["start"]) + 1)
        limit = F.least(w["end"], F.coalesce(after["start"], usable), usable)
        fitting = F.slice(w["tokens"], 1, F.greatest(limit - first, F.lit(0)).cast("int"))
        every = F.concat(F.array(one(mark_of(w["start"]), F.lit(end_of_word))), F.transform(fitting, lambda t, k: one(first + k, t)))
        return bind(mark_of(after["start"]), lambda m: F.filter(every, lambda x: (x["patch"] < usable) & (m.isNull() | (m >= usable) | (x["patch"] != m))))

    return bind(words, lambda ws: F.flatten(F.transform(ws, lambda w, i: bind(F.get(ws, i + 1), lambda after: writes(w, after)))))


def monotone_starts(spans: DataFrame, keys: list[str], order: str) -> DataFrame:
    """A start is no earlier than the end before it (W13)."""
    at = Window.partitionBy(*keys).orderBy(order)
    return spans.withColumn("start", F.greatest(F.coalesce(F.lag("end").over(at), F.col("start")), F.col("start")))


def segment_offsets(segments: DataFrame, keys: list[str], order: str, seconds: str) -> DataFrame:
    """Time at which each synthesised segment begins (W14)."""
    at = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return segments.withColumn("begin", F.coalesce(F.sum(seconds).over(at), F.lit(0.0)))
