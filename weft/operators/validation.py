"""Validation as predicate columns and dead-letter splits (V1-V6, V8, V10-V17, SET1-SET6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

RESERVED = ("id", "audio_steps", "text_tokens", "prepared_audio")


def first_failure(*rules: tuple[str, Column]) -> Column:
    """The first failing rule's name; null where all hold. A rule that is null fails."""
    out = F.lit(None).cast("string")
    for name, ok in reversed(rules):
        out = F.when(~F.coalesce(ok, F.lit(False)), name).otherwise(out)
    return out


def manifest_reason() -> Column:
    """Why a manifest record is invalid."""
    return first_failure(
        ("empty id", F.coalesce("id", F.lit("")) != ""),
        ("empty dataset", F.coalesce("dataset", F.lit("")) != ""),
        ("empty split", F.coalesce("split", F.lit("")) != ""),
        ("negative offset", F.col("offset") >= 0),
        ("bad duration", F.col("duration").isNull() | (F.col("duration") > 0)),
        ("bad sample rate", F.col("sample_rate").isNull() | (F.col("sample_rate") > 0)),
    )


def sample_reason(vocab: int, aligned: bool = True, max_code: int = 32767) -> Column:
    """Why a sample (codes array<array>, text array, dur array, metadata map) cannot go into a shard."""
    rules = [
        ("no codes", F.size("codes") > 0),
        ("ragged codes", F.forall("codes", lambda c: F.size(c) == F.size(F.element_at("codes", 1)))),
        ("code out of range", F.forall(F.flatten("codes"), lambda x: (x >= 0) & (x <= max_code) & (x < vocab))),
        ("reserved metadata key", ~F.arrays_overlap(F.coalesce(F.map_keys("metadata"), F.array().cast("array<string>")), F.array(*map(F.lit, RESERVED)))),
    ]
    if aligned:
        rules += [
            ("text without durations", F.size("text") == F.size("dur")),
            ("duration not positive", F.forall("dur", lambda d: d > 0)),
            ("durations do not cover the codes", F.aggregate("dur", F.lit(0), lambda a, d: a + d) == F.size("codes")),
        ]
    return first_failure(*rules)


def split(df: DataFrame, reason: Column, ident: str = "id") -> tuple[DataFrame, DataFrame]:
    """(valid rows, dead letters as id and reason)."""
    marked = df.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null").select(ident, "reason")


def shard_problems(samples: DataFrame, meta: DataFrame, vocab_column: str = "vocab_size") -> DataFrame:
    """shard and its first failing rule: samples (shard, id, n_codes, max_code, min_code, n_text, n_dur, dur_sum) against
    meta (shard, schema_version, num_samples, num_audio_steps, num_text_tokens, vocab_size)."""
    told = samples.groupBy("shard").agg(
        F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.count_if(F.coalesce("id", F.lit("")) == "").alias("no_id"), F.count_if(F.col("n_codes") <= 0).alias("short"),
        F.sum("n_codes").alias("steps"), F.min("min_code").alias("low"), F.max("max_code").alias("high"), F.sum("n_text").alias("texts"), F.count_if(F.col("n_text") != F.col("n_dur")).alias("unpaired"), F.count_if(F.col("dur_sum") != F.col("n_codes")).alias("uncovered"),
    )
    rules = first_failure(
        ("schema version", F.col("schema_version") == 1),
        ("sample count", F.col("n") == F.col("num_samples")),
        ("empty sample", F.col("short") == 0),
        ("audio size", F.col("steps") == F.col("num_audio_steps")),
        ("code range", (F.col("low") >= 0) & (F.col("high") < F.col(vocab_column))),
        ("sample ids", (F.col("no_id") == 0) & (F.col("ids") == F.col("n"))),
        ("text size", F.col("texts") == F.col("num_text_tokens")),
        ("text and durations", F.col("unpaired") == 0),
        ("duration sums", F.col("uncovered") == 0),
    )
    return meta.join(told, "shard", "left").select("shard", rules.alias("problem"))


def metadata_differences(left: Column, right: Column) -> Column:
    """Sorted keys whose values differ between two maps, missing ones included (V10, V11, SET2, SET5)."""
    keys = F.array_union(F.map_keys(left), F.map_keys(right))
    return F.array_sort(F.filter(keys, lambda k: ~F.element_at(left, k).eqNullSafe(F.element_at(right, k))))


def missing_keys(required: list[str], m: Column) -> Column:
    return F.array_sort(F.array_except(F.array(*map(F.lit, required)), F.map_keys(m)))


def valid_codes(codes: Column, vocab: int) -> Column:
    return F.filter(codes, lambda x: (x >= 0) & (x < vocab))


def generation_problem() -> Column:
    """Why a generation request (prompt_length, temperature, top_k, modalities, max_new, block_size) is refused (V17)."""
    return first_failure(
        ("empty prompt", F.col("prompt_length") > 0),
        ("bad temperature", (F.col("temperature") >= 0) & ~F.isnan("temperature") & (F.col("temperature") < float("inf"))),
        ("bad top_k", F.col("top_k").isNull() | (F.col("top_k") >= 1)),
        ("not one modality", F.col("modalities") == 1),
        ("too long", F.col("prompt_length") + F.col("max_new") <= F.col("block_size") + 1),
    )
