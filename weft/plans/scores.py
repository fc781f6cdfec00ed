"""Losses and choices over logits. Embeddings times ten stand for logits of 64 classes, labels for targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weft.functions import numeric
from weft.functions.hashing import uniform_sql
from weft.operators import scoring, training
from weft.plans.registry import load, query

PAD = 3
PAD_WEIGHT = 0.25
SPECIAL = 60
BOOKS = (1.0, 0.5, 0.5, 0.25)

_LSE = "(ln(list_sum(list_transform(range({lo}, {hi}), lambda i: exp(embedding[i + 1]::double * 10)))))"
_CE = f"({_LSE.format(lo=0, hi=SPECIAL)} - embedding[label + 1]::double * 10)"


def _logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double") * 10).alias("logits"))


def _entropies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross entropy with the special classes at the end masked out."""
    allowed = F.transform("logits", lambda _, i: i < SPECIAL)
    return _logits(spark, sf_dir).select("vec_id", F.col("label").alias("target"), scoring.cross_entropy(F.col("logits"), F.col("label"), allowed).alias("ce"))


@query(f"select vec_id, label as target, round({_CE}, 6) as ce from embeddings")
def cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entropies(spark, sf_dir).select("vec_id", "target", F.round("ce", 6).alias("ce"))


@query(
    f"""with c as (select label, {_CE} as ce, case when label = {PAD} then {PAD_WEIGHT} else 1.0 end::double as w from embeddings)
    select round(sum(w * ce) / greatest(sum(w), 1), 6) as weighted, round(sum(ce) filter (label <> {PAD}) / greatest(count(*) filter (label <> {PAD}), 1), 6) as plain from c"""
)
def text_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _entropies(spark, sf_dir)
    weighted = scoring.text_loss(rows, PAD, PAD_WEIGHT).select(F.lit(0).alias("k"), F.round("loss", 6).alias("weighted"))
    plain = scoring.text_loss(rows, PAD, None).select(F.lit(0).alias("k"), F.round("loss", 6).alias("plain"))
    return weighted.join(plain, "k").drop("k")


_BOOK = " union all ".join(f"select vec_id // 4 as sample, vec_id % 4 as pos, {k} as k, {_LSE.format(lo=16 * k, hi=16 * k + 16)} - embedding[{16 * k} + label + 1]::double * 10 as ce, (vec_id + {k}) % 5 <> 0 as mask, {w}::double as weight from embeddings" for k, w in enumerate(BOOKS))


def _books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four codebooks of 16 classes for each position; some entries are masked."""
    rows = _logits(spark, sf_dir).select("vec_id", "label", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.slice("logits", k * 16 + 1, F.lit(16)))).alias("k", "part"))
    weight = F.get(F.array(*map(F.lit, BOOKS)), F.col("k"))
    return rows.select(F.floor(F.col("vec_id") / 4).alias("sample"), (F.col("vec_id") % 4).alias("pos"), "k", scoring.cross_entropy(F.col("part"), F.col("label")).alias("ce"), ((F.col("vec_id") + F.col("k")) % 5 != 0).alias("mask"), weight.alias("weight"))


@query(
    f"""with b as ({_BOOK}), p as (select sample, pos, sum(weight * mask::int * ce) / greatest(sum(weight * mask::int), 1e-8) as loss, max(mask::int) as held from b group by 1, 2)
    select round(sum(loss * held) / greatest(sum(held), 1), 6) as loss, sum(held)::bigint as positions from p"""
)
def codebook_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.codebook_loss(_books(spark, sf_dir)).select(F.round("loss", 6).alias("loss"), "positions")


@query(f"with b as ({_BOOK}) select k, round(sum(mask::int * ce) / greatest(sum(mask::int), 1), 6) as loss from b group by 1")
def per_codebook_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.per_codebook_loss(_books(spark, sf_dir)).select("k", F.round("loss", 6).alias("loss"))


@query(
    f"""with b as ({_BOOK}), p as (select sample, pos, sum(weight * mask::int * ce) / greatest(sum(weight * mask::int), 1e-8) as loss, max(mask::int) as held from b group by 1, 2),
    a as (select sample, sum(loss * held) / greatest(sum(held), 1) as nll from p group by 1), t as (select vec_id // 4 as sample, avg({_CE}) as nll from embeddings group by 1)
    select sample, round(-(0.5 * t.nll + a.nll), 6) as log_likelihood from a join t using (sample)"""
)
def log_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minus the weighted sum of a sample's mean losses, text at half weight."""
    audio = scoring.codebook_loss(_books(spark, sf_dir), ["sample"]).select("sample", F.lit("audio").alias("modality"), F.col("loss").alias("nll"))
    text = _entropies(spark, sf_dir).groupBy(F.floor(F.col("vec_id") / 4).alias("sample")).agg(F.avg("ce").alias("nll")).select("sample", F.lit("text").alias("modality"), "nll")
    return scoring.log_likelihood(audio.unionByName(text), 0.5).select("sample", F.round("log_likelihood", 6).alias("log_likelihood"))


@query(
    f"""with b as ({_BOOK}), l as (select sum(weight * mask::int * ce) / sum(weight * mask::int) as loss, count(*)::double as n from b union all select avg({_CE}), count(*) from embeddings)
    select round(sum(loss * n) / sum(n) - 0.01::double * ln(4), 6) as loss from l"""
)
def total_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count-weighted mean of two losses, less the entropy of an even mix of four layers."""
    w = F.col("weight") * F.col("mask").cast("int")
    audio = _books(spark, sf_dir).agg((F.sum(w * F.col("ce")) / F.sum(w)).alias("loss"), F.count("*").cast("double").alias("n"))
    text = _entropies(spark, sf_dir).agg(F.avg("ce").alias("loss"), F.count("*").cast("double").alias("n"))
    even = scoring.entropy(F.array(*[F.lit(0.25)] * 4))
    return scoring.total_loss(audio.unionByName(text), 0.01, even).select(F.round("loss", 6).alias("loss"))


@query(
    """with x as (select vec_id, unnest(range(64)) as i, embedding from embeddings), v as (select vec_id, i, embedding[i + 1]::double * 10 as x, case when embedding[(i + 1) % 64 + 1] > 0 then 1.0 else 0.0 end::double as y from x)
    select vec_id, round(avg(greatest(x, 0) - x * y + ln(1 + exp(-abs(x)))), 6) as bernoulli, round(avg((x - (y - 0.5)) * (x - (y - 0.5))), 6) as flow from v group by 1"""
)
def head_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over all values of the binary cross entropy and of the squared velocity error."""
    rows = _logits(spark, sf_dir)
    y = lambda i: F.when(F.get("logits", (i + 1) % 64) > 0, 1.0).otherwise(0.0)
    mean = lambda f: F.aggregate(F.transform("logits", f), F.lit(0.0), lambda a, x: a + x) / F.size("logits")
    return rows.select("vec_id", F.round(mean(lambda x, i: scoring.bernoulli(x, y(i))), 6).alias("bernoulli"), F.round(mean(lambda x, i: scoring.flow_error(x, y(i), F.lit(0.5))), 6).alias("flow"))


@query(
    """with x as (select vec_id, unnest(range(64)) as i, unnest(embedding)::double as x from embeddings), r as (select *, rank() over (partition by vec_id order by x desc) as rk from x)
    select vec_id, count(*) filter (rk <= 5) as kept, round(min(x) filter (rk <= 5) * 10, 6) as lowest, arg_min(i, rk * 100 + i)::int as best from r group by 1"""
)
def topk_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries no lower than the fifth largest, and the greedy choice."""
    masked = _logits(spark, sf_dir).withColumn("kept", F.filter(scoring.top_k_mask(F.col("logits"), 5), lambda x: x.isNotNull()))
    return masked.select("vec_id", F.size("kept").cast("long").alias("kept"), F.round(F.array_min("kept"), 6).alias("lowest"), scoring.greedy(F.col("logits")).alias("best"))


@query(
    f"""with x as (select vec_id, unnest(range(64)) as i, unnest(embedding)::double * 10 / 0.8::double as x from embeddings), r as (select *, rank() over (partition by vec_id order by x desc) as rk, max(x) over (partition by vec_id) as top from x),
    p as (select vec_id, i, rk, case when rk <= 5 then exp(x - top) else 0.0 end as p from r), c as (select *, sum(p) over (partition by vec_id order by i) as upto, sum(p) over (partition by vec_id) as total from p)
    select vec_id, coalesce(min(i) filter (upto > {uniform_sql('7', 'vec_id', "'choice'")} * total), min(i) filter (rk = 1))::int as choice from c group by 1"""
)
def sampled_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A draw from the five best at temperature 0.8, by the vector's own uniform."""
    return _logits(spark, sf_dir).select("vec_id", scoring.sample(F.col("logits"), 0.8, 5, 7, F.col("vec_id"), "choice").alias("choice"))


@query(
    """with n as (select count(*) as total, count(*) // 20 as warm, count(*) // 4 as down from events), s as (select event_id as step, total, warm, down, total - down as hold from events, n)
    select step, round(case when step < warm then 2e-4 * (step + 1) / warm::double when step < hold then 2e-4 when step - hold + 1 >= down then 2e-5 else 2e-4 + (2e-5 - 2e-4) * ((step - hold + 1) / down::double) end, 12) as rate from s"""
)
def lr_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate of each step (an event), with a twentieth of all steps to warm up and a quarter to cool down."""
    steps = load(spark, sf_dir, "events").select(F.col("event_id").alias("step"))
    total = steps.count()
    return steps.select("step", F.round(numeric.schedule(F.col("step"), 2e-4, 2e-5, total // 20, total, total // 4), 12).alias("rate"))


@query(
    """select event_id, batch, accumulation, world, batch * accumulation as sequences, accumulation // world as per_rank, batch * accumulation * 2048 as tokens
    from (select event_id, 1 + user_id % 40 as batch, 8 * (1 + event_id % 4) as accumulation, 1 << (event_id % 3)::int as world from (select event_id::bigint as event_id, user_id::bigint as user_id from events))"""
)
def batch_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch sizes of each step (an event)."""
    i = F.col("event_id")
    grid = load(spark, sf_dir, "events").select("event_id", (1 + F.col("user_id") % 40).alias("batch"), (8 * (1 + i % 4)).alias("accumulation"), F.element_at(F.array(F.lit(1), F.lit(2), F.lit(4)), (i % 3 + 1).cast("int")).cast("long").alias("world"))
    sizes = training.batch_sizes(F.col("batch"), F.col("accumulation"), F.lit(2048), F.col("world"))
    return grid.select("event_id", "batch", "accumulation", "world", sizes["sequences"].alias("sequences"), sizes["per_rank_accumulation"].alias("per_rank"), sizes["tokens"].alias("tokens"))


@query(
    """select event_id, layers, round((6.0 * 150000000 + 12.0 * layers * 12 * 64 * 2048 + 0.25 * 12.0 * 2 * 8 * 64 * 2048) * 2048 * 480 / seconds / 312e12, 9) as mfu
    from (select event_id, 6 + event_id % 43 as layers, 2.0::double + abs(value) as seconds from events)"""
)
def mfu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utilisation of each step (an event) by its layers and its seconds."""
    steps = load(spark, sf_dir, "events").select("event_id", (6 + F.col("event_id") % 43).alias("layers"), (2.0 + F.abs("value")).alias("seconds"))
    share = training.utilization(F.lit(150e6), F.col("layers"), F.lit(12), F.lit(768), F.lit(2048), F.lit(480), F.col("seconds"), F.lit(12.0 * 2 * 8 * 64 * 2048))
    return steps.select("event_id", "layers", F.round(share, 9).alias("mfu"))


@query(
    """select event_id // 16 as "window", count(*) as micro_steps, round(avg(value), 6) as loss from events group by 1"""
)
def accumulation_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows of 16 micro-steps."""
    steps = load(spark, sf_dir, "events").select(F.col("event_id").alias("micro_step"), F.col("value").alias("loss"))
    return training.accumulate(steps, 16).select("window", "micro_steps", F.round("loss", 6).alias("loss"))


@query("""select event_type, round(sum(value) / count(value), 6) as loss, count(value) as batches from events group by 1""")
def validation_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").select("event_type", F.col("value").alias("loss"))
    return training.validation_mean(rows, ["event_type"]).select("event_type", F.round("loss", 6).alias("loss"), "batches")
