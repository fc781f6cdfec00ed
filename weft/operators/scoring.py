"""Losses and choices over given logits (MTH6, AGG10-AGG18, TOP1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from weft.functions.hashing import uniform
from weft.functions.numeric import bind, log_sum_exp, masked


def cross_entropy(logits: Column, target: Column, allowed: Column | None = None) -> Column:
    """-log p(target); infinite where the target is not allowed."""
    return bind(masked(logits, allowed), lambda x: F.coalesce(log_sum_exp(x) - F.get(x, target), F.lit(float("inf"))))


def text_loss(rows: DataFrame, pad: int, pad_weight: float | None) -> DataFrame:
    """AGG10: with a pad weight sum(w ce) / max(sum w, 1), else the mean over targets that are no padding."""
    w = F.when(F.col("target") == pad, F.lit(pad_weight if pad_weight is not None else 0.0)).otherwise(1.0)
    weighed = rows.where(F.lit(pad_weight is not None) | (F.col("target") != pad))
    return weighed.agg((F.coalesce(F.sum(w * F.col("ce")), F.lit(0.0)) / F.greatest(F.coalesce(F.sum(w), F.lit(0.0)), F.lit(1.0))).alias("loss"))


def codebook_loss(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """AGG11: rows (sample, pos, k, ce, mask, weight): per position a weighted mean over codebooks, then the mean over positions."""
    keys = keys or []
    wm = F.col("weight") * F.col("mask").cast("double")
    by_pos = rows.groupBy(*keys, *(k for k in ("sample", "pos") if k not in keys)).agg((F.sum(wm * F.col("ce")) / F.greatest(F.sum(wm), F.lit(1e-8))).alias("loss"), F.max(F.col("mask").cast("int")).alias("held"))
    return by_pos.groupBy(*keys).agg((F.sum(F.col("loss") * F.col("held")) / F.greatest(F.sum("held"), F.lit(1))).alias("loss"), F.sum("held").cast("long").alias("positions"))


def per_codebook_loss(rows: DataFrame) -> DataFrame:
    m = F.col("mask").cast("double")
    return rows.groupBy("k").agg((F.sum(m * F.col("ce")) / F.greatest(F.sum(m), F.lit(1.0))).alias("loss"))


def bernoulli(x: Column, y: Column) -> Column:
    """Binary cross entropy of a logit."""
    return F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))


def flow_error(velocity: Column, noise: Column, clean: Column) -> Column:
    return (velocity - (noise - clean)) * (velocity - (noise - clean))


def log_likelihood(parts: DataFrame, text_weight: float) -> DataFrame:
    """AGG16: -(w text + image + audio) of per-sample means: parts (sample, modality, nll)."""
    w = F.when(F.col("modality") == "text", F.lit(text_weight)).otherwise(1.0)
    return parts.groupBy("sample").agg((-F.sum(w * F.coalesce("nll", F.lit(0.0)))).alias("log_likelihood"))


def total_loss(parts: DataFrame, entropy_weight: float, entropy: Column) -> DataFrame:
    """AGG17: count-weighted mean of the modalities' losses less the weighted entropy: parts (loss, n)."""
    return parts.agg((F.sum(F.col("loss") * F.col("n")) / F.greatest(F.sum("n"), F.lit(1)) - entropy_weight * F.max(entropy)).alias("loss"))


def entropy(p: Column) -> Column:
    return -F.aggregate(p, F.lit(0.0), lambda a, x: a + x * F.log(x + 1e-12))


def top_k_mask(logits: Column, k: int) -> Column:
    """Logits strictly below the k-th become null; ties with it stay."""
    limit = F.get(F.sort_array(logits, asc=False), F.least(F.lit(k), F.size(logits)) - 1)
    return bind(limit, lambda low: F.transform(logits, lambda x: F.when(x >= low, x)))


def greedy(logits: Column) -> Column:
    """First index of the largest logit."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def sample(logits: Column, temperature: float, k: int | None, *key: Column | str | int) -> Column:
    """Index drawn from the softmax (temperature 0: greedy) by inverse distribution on a counter-based uniform."""
    if temperature < 0:
        raise ValueError("temperature must not be negative")
    if temperature == 0:
        return greedy(logits)
    scaled = F.transform(logits, lambda x: x.cast("double") / temperature)

    def draw(kept: Column) -> Column:
        return bind(F.array_max(kept), lambda top: bind(F.transform(kept, lambda x: F.coalesce(F.exp(x - top), F.lit(0.0))), lambda p: walk(kept, p)))

    def walk(kept: Column, p: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("at"), F.lit(0).alias("i"))
        total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
        step = lambda u: lambda s, x: F.struct((s["sum"] + x).alias("sum"), F.when((s["at"] < 0) & (s["sum"] + x > u), s["i"]).otherwise(s["at"]).alias("at"), (s["i"] + 1).alias("i"))
        at = bind(uniform(*key) * total, lambda u: F.aggregate(p, start, step(u), lambda s: s["at"]))
        return F.when(at >= 0, at).otherwise(greedy(kept)).cast("int")

    return bind(top_k_mask(scaled, k) if k else scaled, draw)


def ranks(long: DataFrame, keys: list[str], logit: str) -> DataFrame:
    """Rank of each entry within its key, ties equal."""
    return long.withColumn("rank", F.rank().over(Window.partitionBy(*keys).orderBy(F.col(logit).desc())))
