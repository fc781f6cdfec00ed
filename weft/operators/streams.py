"""Streams of a mixture: which shards a strategy reads, their metadata and their weights (SRC7, SET1, V5-V7, J11, SEQ20, SEQ21, UDF3)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from weft.functions.text import tokenizer_base
from weft.operators import mixture
from weft.operators.validation import first_failure
from weft.sources.benchmarks import STRATEGIES, MixtureConfig
from weft.sources.manifests import require

#: Kinds of shards by strategy; a pair's codes are those of its other modality.
KIND = {"txt": "text", "img": "rendered-text", "aud": "speech", "imgtxt": "rendered-text", "audtxt": "speech"}
PAIRS = ("imgtxt", "audtxt")
#: Columns of a shard table: what a shard's own metadata tells.
SHARD = "dataset string, split string, shard string, kind string, schema_version int, profile string, has_text boolean, tokens long, n_codebooks int, vocab_size int, pad_id int, eos_id int"


def shard_problem(strategy: str, vocabulary: dict[str, int]) -> Column:
    """Why a shard cannot serve a strategy; vocabulary: n_codebooks, vocab_size, pad_id and eos_id that the model expects."""
    same = [(f"{name} mismatch", F.col(name) == F.lit(value)) for name, value in vocabulary.items()]
    paired = [("units-only, but aligned data is required", F.col("profile") == "aligned")] if strategy == "audtxt" else []
    return first_failure(("unsupported schema", F.col("schema_version") == 1), *same, *paired)


def select_streams(shards: DataFrame, config: MixtureConfig, vocabularies: dict[str, dict[str, int]] | None = None) -> DataFrame:
    """(strategy, dataset, split, shard, tokens, weight) of every enabled strategy.

    A strategy reads the shards of its kind in its datasets and the configured splits. Unimodal shards shorter than a
    block and pairs without text are left out (V5, V6); a shard that contradicts the model's vocabulary is an error, as is
    a strategy without shards. Weights sum to one, or to the datasets' probabilities, within a strategy."""
    parts = []
    for strategy, enabled in zip(STRATEGIES, config.weights, strict=True):
        if not enabled:
            continue
        names = config.datasets[strategy]
        held = shards.where(F.col("dataset").isin(names) & F.col("split").isin(config.splits) & (F.col("kind") == KIND[strategy]))
        problem = shard_problem(strategy, (vocabularies or {}).get(strategy, {}))
        held = require(held.withColumn("__problem", problem), F.col("__problem").isNull(), F.concat_ws(": ", "shard", "__problem")).drop("__problem")
        held = held.where(F.coalesce("has_text", F.lit(False))) if strategy in PAIRS else held.where(F.col("tokens") >= config.block_size)
        if odds := config.probabilities.get(strategy):
            given = shards.sparkSession.createDataFrame(list(zip(names, map(float, odds), strict=True)), "dataset string, probability double")
            held = mixture.shard_weights(held, given)
        else:
            held = mixture.shard_weights(held)
        parts.append(held.select(F.lit(strategy).alias("strategy"), "dataset", "split", "shard", "tokens", "weight"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def require_all_strategies(streams: DataFrame, config: MixtureConfig) -> DataFrame:
    """streams, raising an error where an enabled strategy has no shard."""
    wanted = [s for s, w in zip(STRATEGIES, config.weights, strict=True) if w]
    found = streams.agg(F.array_except(F.array(*map(F.lit, wanted)), F.collect_set("strategy")).alias("__missing"))  # one row
    return require(streams.join(F.broadcast(found), F.lit(True), "right"), F.size("__missing") == 0, F.concat(F.lit("no data found for "), F.array_join("__missing", ", "))).drop("__missing")


#: Text metadata: equal everywhere, then equal where two sources both have it and filled from the others.
EQUAL, FILLED = ("base_vocab_size", "eos_id"), ("pad_id", "epad_id", "special_vocab_size")


def reconcile_text_metadata(meta: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row a key: the first source's metadata, its gaps filled, and the first problem (null where the sources agree).

    meta: place, source, tokenizer_id, tokenizer_alias, base_vocab_size, eos_id, pad_id, epad_id, special_vocab_size.
    Tokenizers may differ only after the last `-` of their name; an alias counts only where both have one."""
    by = keys or []
    order = Window.partitionBy(*by).orderBy("place") if by else Window.partitionBy(F.lit(0)).orderBy("place")  # one row a dataset
    first = lambda c, skip=False: F.first(c, ignorenulls=skip).over(order)
    both = lambda c, ref: F.col(c).isNull() | ref.isNull() | (F.col(c) == ref)
    problem = first_failure(
        ("tokenizer_id", tokenizer_base(F.col("tokenizer_id")) == tokenizer_base(first("tokenizer_id"))),
        ("tokenizer_alias", both("tokenizer_alias", first("tokenizer_alias"))),
        *((c, F.col(c) == first(c)) for c in EQUAL),
        *((c, both(c, first(c, True))) for c in FILLED),
    )
    judged = meta.select(*meta.columns, problem.alias("problem"))
    row = lambda c: F.min_by(c, "place").alias(c)
    filled = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("place"))).alias(c)
    wrong = F.col("problem").isNotNull()
    found = F.min_by(F.concat_ws(": ", "source", "problem"), F.when(wrong, F.col("place"))).alias("problem")
    columns = [row(c) for c in ("tokenizer_id", "tokenizer_alias", *EQUAL)] + [filled(c) for c in FILLED] + [found]
    return judged.groupBy(*by).agg(*columns) if by else judged.agg(*columns)


Layout = Callable[..., DataFrame]
#: Layouts by the name that a configuration gives them: runs of the drawn sources to rows of a sample.
SAMPLERS: dict[str, Layout] = {
    "interleaved": mixture.interleave,
    "aligned": lambda runs, size, end_of_word, pad, switch, seed: mixture.aligned_layout(runs, size, pad),  # noqa: ARG005
}


def sample_layout(name: str, runs: DataFrame, size: int, end_of_word: int, pad: int, switch: int, seed: int) -> DataFrame:
    """The layout of that name; an unknown name is an error."""
    if name not in SAMPLERS:
        raise ValueError(f"unknown layout {name}; known: {sorted(SAMPLERS)}")
    return SAMPLERS[name](runs, size, end_of_word, pad, switch, seed)
