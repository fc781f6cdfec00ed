"""Arithmetic with the reference semantics (MTH1-9, ARR1-3, special-token algebra)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, LongType


def to_unit(x: Column, vocab: int) -> Column:
    """x / (V - 1); x itself for V <= 1."""
    return x.cast("double") / (vocab - 1) if vocab > 1 else x.cast("double")


def binarize(x: Column, vocab: int) -> Column:
    return x > (0.5 * (vocab - 1) if vocab > 1 else 0.5)


def dequantize(x: Column, vocab: int) -> Column:
    """Clamp to [0, 1], scale to V - 1, round half to even."""
    return F.rint(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)) * max(vocab - 1, 1)).cast("int")


def patches(pixels: Column, patch: int = 16) -> Column:
    return F.ceil(pixels / patch).cast("int")


def spread(low: Column, high: Column, n: Column) -> Column:
    """Integer points of linspace(low, high, n + 1): doubles rounded down, the last one exact."""
    step = (high - low) / n.cast("double")
    return F.transform(F.sequence(F.lit(0), n), lambda i: F.when(i == n, high).otherwise(F.floor(i * step + low)).cast("int"))


def expand_runs(values: Column, times: Column) -> Column:
    """Run-length decoding."""
    return F.flatten(F.zip_with(values, times, lambda v, n: F.array_repeat(v, n)))


def pad_to(values: Column, size: Column | int, fill: Column) -> Column:
    return F.concat(values, F.array_repeat(fill, F.greatest(F.lit(0), (F.lit(size) if isinstance(size, int) else size) - F.size(values))))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_sums(values: Column) -> Column:
    """Sums of an array's entries up to each one (longs; null entries count as 0), in linear time. A null array gives null."""
    return _running_sums(values.cast("array<bigint>"))


@F.arrow_udf(ArrayType(LongType()))
def _running_sums(values: pa.Array) -> pa.Array:
    sizes = pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    total = np.concatenate(([0], np.cumsum(pc.fill_null(values.flatten(), 0).to_numpy(zero_copy_only=False).astype(np.int64))))
    inside = total[1:] - np.repeat(total[ends - sizes], sizes)
    out = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(inside))
    return pc.if_else(pc.is_null(values), pa.scalar(None, out.type), out)


def run_starts(values: Column) -> Column:
    """Places at which a run of equal entries begins; values should be bound, since each entry looks at the one before."""
    return F.filter(F.transform(values, lambda x, i: F.when((i == 0) | (x != F.get(values, i - 1)), i)), lambda i: i.isNotNull())


def log_sum_exp(x: Column) -> Column:
    """log of the sum of exponentials of an array of doubles; nulls are left out."""
    kept = F.filter(x, lambda v: v.isNotNull())
    return bind(F.array_max(kept), lambda top: top + F.log(F.aggregate(kept, F.lit(0.0), lambda a, v: a + F.exp(v - top))))


def masked(logits: Column, allowed: Column | None = None) -> Column:
    """Logits as doubles; entries that are not allowed are null (probability 0)."""
    if allowed is None:
        return F.transform(logits, lambda x: x.cast("double"))
    return F.zip_with(logits, allowed, lambda x, ok: F.when(ok, x.cast("double")))


def log_softmax(logits: Column, allowed: Column | None = None) -> Column:
    """Log probabilities of an array; entries that are not allowed get null."""
    return bind(masked(logits, allowed), lambda x: bind(log_sum_exp(x), lambda total: F.transform(x, lambda v: v - total)))


def schedule(step: Column, peak: float, floor: float, warmup: int, total: int, warmdown: int) -> Column:
    """Linear warm-up from (step + 1) / warmup, hold, linear warm-down; the floor exactly at the end."""
    ratio = (step - (total - warmdown) + 1) / F.lit(float(max(warmdown, 1)))
    down = F.when(ratio >= 1, F.lit(float(floor))).otherwise(F.lit(float(peak)) + (floor - peak) * ratio)
    up = F.lit(float(peak)) * (step + 1) / F.lit(float(max(warmup, 1)))
    return F.when(step < warmup, up).when(step < total - warmdown, F.lit(float(peak))).otherwise(down)


def special_tokens(vocab: int, paired: bool, frame_synchronous: bool = False, other_modality: bool = False) -> dict[str, int | None]:
    """Ids of padding, end of word, switch and the size of the text vocabulary.

    Paired streams reserve padding V, end of word V + 1 and switch V + 2; frame-synchronous ones never switch."""
    pad, end_of_word, special = vocab, vocab + 1, vocab + 2
    if paired and frame_synchronous:
        return {"pad": pad, "end_of_word": end_of_word, "switch": None, "vocab": special}
    if paired:
        return {"pad": pad, "end_of_word": end_of_word, "switch": special, "vocab": special + 1}
    return {"pad": pad, "end_of_word": None, "switch": None, "vocab": vocab + 1 if other_modality else vocab}
