"""Training analytics (AGG19, AGG21, AGG22, STM6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Promised FLOP/s by device.
PEAK = {"A100": 312e12, "H100": 989e12}
ADAPTER_SHARE = 0.25


def batch_sizes(batch: Column, accumulation: Column, context: Column, world: Column) -> Column:
    """struct(sequences, per_rank_accumulation, tokens): the accumulation is shared by the ranks."""
    return F.struct((batch * accumulation).alias("sequences"), F.floor(accumulation / world).alias("per_rank_accumulation"), (batch * accumulation * context).alias("tokens"))


def utilization(parameters: Column, layers: Column, heads: Column, dim: Column, context: Column, passes: Column, seconds: Column, adapter_attention: Column, device: str = "A100") -> Column:
    """Achieved over promised FLOP/s: 6 N, attention, a quarter of the adapters' attention."""
    per_token = 6.0 * parameters + 12.0 * layers * heads * F.floor(dim / heads) * context + ADAPTER_SHARE * adapter_attention
    return per_token * context * passes / seconds / PEAK[device]


def depth_flops(parameters: Column, codebooks: Column, layers: Column, heads: Column, dim: Column) -> Column:
    """FLOPs a token of a transformer over the codebooks: its parameters for each codebook but the first, and its attention."""
    return 6.0 * parameters * (codebooks - 1) + 12.0 * layers * heads * F.floor(dim / heads) * codebooks * codebooks


def utilization_with_depth(utilized: Column, depth: Column, context: Column, passes: Column, seconds: Column, device: str = "A100") -> Column:
    """utilization() with the FLOPs a token of depth transformers (the sum of depth_flops) added."""
    return utilized + depth * context * passes / seconds / PEAK[device]


def write_metrics(steps: DataFrame, path: str) -> None:
    """Step metrics as JSON lines in step order (SNK11); every column of steps is a metric."""
    line = F.to_json(F.struct(*sorted(steps.columns)), {"ignoreNullFields": "false"})
    steps.repartitionByRange("step").sortWithinPartitions("step").select(line.alias("value")).write.mode("errorifexists").text(path)


def validation_mean(losses: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of losses over sum of counts: partial sums per task, then one mean."""
    return losses.groupBy(*keys).agg((F.sum("loss") / F.count("loss")).alias("loss"), F.count("loss").alias("batches"))


def accumulate(steps: DataFrame, every: int) -> DataFrame:
    """Tumbling windows of micro-steps: window, micro-steps and mean loss."""
    return steps.groupBy(F.floor(F.col("micro_step") / every).cast("long").alias("window")).agg(F.count("*").alias("micro_steps"), F.avg("loss").alias("loss"))
