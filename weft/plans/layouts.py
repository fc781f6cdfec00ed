"""Mixture weights, seeded sampling and sample layouts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from weft.functions.hashing import uniform, uniform_sql
from weft.operators import mixture
from weft.operators.ordering import running
from weft.plans.frames import _EVENTS, timeline
from weft.plans.registry import load, query
from weft.storage import materialize, scratch
from weft.streaming import samples

SEED, RANK = 1234, 3
SIZE, LONG_SIZE = 256, 2048
#: Draws of the SQL, which has no rounds: more than a sample of SIZE or LONG_SIZE positions needs on the given tables.
SQL_DRAWS, LONG_SQL_DRAWS = 64, 320
PAD, END_OF_WORD, SWITCH = 200, 201, 202

_WEIGHTS = """sh as (select lang, source, sum(n_chars)::bigint as tokens from documents group by 1, 2),
    pr as (select lang, (length(lang) + ascii(lang) % 3)::double as probability from documents group by 1),
    wt as (select lang, source, probability * tokens / sum(tokens) over (partition by lang) as weight from sh join pr using (lang))"""


def _weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    shards = docs.groupBy(F.col("lang").alias("dataset"), "source").agg(F.sum("n_chars").alias("tokens"))
    odds = docs.groupBy(F.col("lang").alias("dataset")).agg(F.first(F.length("lang") + F.ascii("lang") % 3).cast("double").alias("probability"))
    return mixture.shard_weights(shards, odds)


@query(f"with {_WEIGHTS} select lang as dataset, source, round(weight, 9) as weight from wt")
def mixture_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weights(spark, sf_dir).select("dataset", "source", F.round("weight", 9).alias("weight"))


_SEEDS = f"idx as (select doc_id as sample_index, ({SEED} + 1000003::bigint * {RANK} + 97409::bigint * doc_id) % 4294967296 as seed from documents)"
_CHOICES = """(select {key}, (sum(weight) over (order by {key}) - weight) / sum(weight) over () as low,
      case when row_number() over (order by {key} desc) = 1 then 1.0 else sum(weight) over (order by {key}) / sum(weight) over () end as high from {table})"""
_STRATEGIES = "st as (select * from (values ('aud', 0.2::double), ('audtxt', 0.4), ('imgtxt', 0.1), ('txt', 0.3)) t(strategy, weight))"


@query(
    f"""with {_SEEDS}, {_STRATEGIES}, sw as (select source as shard, sum(n_chars)::double as weight from documents group by 1),
    d as (select *, {uniform_sql('seed', "'strategy'")} as us, {uniform_sql('seed', "'shard'")} as ud from idx)
    select sample_index, seed, s.strategy, h.shard from d
      join {_CHOICES.format(key='strategy', table='st')} s on us >= s.low and us < s.high
      join {_CHOICES.format(key='shard', table='sw')} h on ud >= h.low and ud < h.high"""
)
def mixture_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seed, strategy and shard of a sample for each document's index."""
    docs = load(spark, sf_dir, "documents")
    strategies = spark.createDataFrame([("aud", 0.2), ("audtxt", 0.4), ("imgtxt", 0.1), ("txt", 0.3)], "strategy string, weight double")
    shards = docs.groupBy(F.col("source").alias("shard")).agg(F.sum("n_chars").cast("double").alias("weight"))
    return mixture.sample_plan(docs.select(F.col("doc_id").alias("sample_index")), SEED, RANK, strategies, shards)


#: As many samples as there are sources.
_INDICES = "(select unnest(range((select count(distinct user_id) from events))) as sample_index)"


def _indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = load(spark, sf_dir, "events").agg(F.countDistinct("user_id").alias("n"))  # one row
    return n.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("sample_index"))


@query(
    f"""with fl as (select row_number() over (order by ts, event_id) - 1 as position, (floor(abs(value))::bigint % 97)::int as token from events), n as (select count(*) as total from events),
    ix as (select sample_index, floor({uniform_sql(str(SEED), 'sample_index', "'window'")} * (total - {SIZE} + 1))::bigint as start from {_INDICES}, n)
    select sample_index, position - start as pos, token from ix join fl on position >= start and position < start + {SIZE}"""
)
def window_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of the flat stream, across sample borders."""
    events = load(spark, sf_dir, "events")
    total = events.count()
    flat = running(events.select("ts", "event_id", "value"), ["ts", "event_id"]).select(F.col("number").alias("position"), (F.floor(F.abs("value")) % 97).cast("int").alias("token"))
    return mixture.windows(_indices(spark, sf_dir), SEED, mixture.token_blocks(flat, SIZE), SIZE, F.lit(total), SIZE)


def _drawn_sql(duration: str = "(1 + event_id % 3)::bigint", draws: int = SQL_DRAWS) -> str:
    return f"""{_EVENTS}, rn as (select user_id as source, pos as place, (case when pos % 3 = 2 then {END_OF_WORD} when code = 3 then {PAD} else 97 + code end)::int as token, {duration} as duration from ev),
    ra as (select *, (sum(duration) over (partition by source order by place) - duration)::bigint as audio from rn),
    us as (select user_id, row_number() over (order by user_id) - 1 as i, count(*) over () as users from (select distinct user_id from events)),
    pk as (select sample_index, draw, user_id as source from {_INDICES}, (select unnest(range({draws})) as draw), us
      where i = floor({uniform_sql(str(SEED), 'sample_index', 'draw', "'source'")} * users)),
    dr as (select sample_index, p.source, token, duration, audio, row_number() over (partition by sample_index order by draw, place) - 1 as place from pk p join ra on ra.source = p.source)"""


_DRAWN = _drawn_sql()


def interleaved(runs: DataFrame) -> DataFrame:
    return mixture.emissions(runs, END_OF_WORD, PAD, SEED).groupBy("sample_index").agg(F.sum("emitted").alias("n"))


def aligned(runs: DataFrame) -> DataFrame:
    return runs.groupBy("sample_index").agg(F.sum("duration").alias("n"))


def _source_runs(spark: SparkSession, sf_dir: str, duration: Column | None = None) -> DataFrame:
    t = timeline(spark, sf_dir)
    token = F.when(F.col("pos") % 3 == 2, END_OF_WORD).when(F.col("code") == 3, PAD).otherwise(97 + F.col("code"))
    runs = t.select(F.col("user_id").alias("source"), F.col("pos").alias("place"), token.alias("token"), (1 + F.col("event_id") % 3 if duration is None else duration).alias("duration"))
    return runs.withColumn("audio", F.sum("duration").over(Window.partitionBy("source").orderBy("place")) - F.col("duration"))


def drawn(spark: SparkSession, sf_dir: str, indices: DataFrame | None = None, duration: Column | None = None, emitted: Callable[[DataFrame], DataFrame] = interleaved, size: int = SIZE) -> DataFrame:
    """Runs of the sources drawn with replacement for the samples of `indices` (sample_index; by default as many as there are
    sources), until each has `size` positions. The first round's draws follow the sources' mean duration."""
    runs = materialize(_source_runs(spark, sf_dir, duration), "sources")
    seats = running(runs.select("source").distinct(), ["source"]).withColumnRenamed("number", "seat")
    told = runs.agg(F.countDistinct("source").alias("sources"), F.sum("duration").alias("frames")).first()

    def draw(numbers: DataFrame) -> DataFrame:
        seat = F.floor(uniform(SEED, F.col("sample_index"), F.col("draw"), "source") * told["sources"]).cast("long")
        return mixture.draw_runs(numbers.withColumn("seat", seat).join(seats.hint("merge"), "seat").select("sample_index", "draw", "source"), runs)

    first = 1 + int(2 * size * told["sources"] / max(told["frames"] or 0, 1))
    return mixture.draw_until_full(_indices(spark, sf_dir) if indices is None else indices, draw, emitted, size, first)


def drawn_interleaved(spark: SparkSession, sf_dir: str, size: int = SIZE) -> Callable[[DataFrame], DataFrame]:
    """The interleaved layout of samples (sample_index) of `size` positions. The sources are read, packed and seated here, once,
    however many batches of samples are laid out."""
    packs = materialize(mixture.pack_runs(_source_runs(spark, sf_dir)), "packs")
    seats = running(packs.where("pack = 0").select("source"), ["source"]).withColumnRenamed("number", "seat")
    told = packs.agg(F.count(F.when(F.col("pack") == 0, 1)).alias("sources"), F.sum("runs").alias("runs"), F.sum("frames").alias("frames")).first()
    packs = materialize(packs.join(seats.hint("merge"), "source").select("seat", "source", "pack", "token", "duration", "audio"), "seated")

    def seat(sample: Column, draw: Column) -> Column:
        return F.floor(uniform(SEED, sample, draw, "source") * told["sources"]).cast("long")

    # of a source's frames, text gives fewer positions: with these draws few samples are short
    first = 1 + int(2.5 * size * told["sources"] / max(told["frames"] or 0, 1))
    runs = (told["runs"] or 0) / max(told["sources"], 1)
    return lambda indices: mixture.interleave_drawn(indices, packs, seat, runs, size, END_OF_WORD, PAD, SWITCH, SEED, first)


def interleave_sql(duration: str = "(1 + event_id % 3)::bigint", size: int = SIZE, draws: int = SQL_DRAWS) -> str:
    return f"""with {_drawn_sql(duration, draws)},
    wd as (select *, coalesce(sum(case when token = {END_OF_WORD} then 1 else 0 end) over (partition by sample_index order by place rows between unbounded preceding and 1 preceding), 0)::bigint as word from dr),
    wc as (select sample_index, max(word) + 1 as words from wd group by 1),
    ch as (select sample_index, unnest(range(words // 5 + 1)) as chunk from wc),
    ct as (select *, (chunk + case when {uniform_sql(str(SEED), 'sample_index', "'first'")} >= 0.5 then 1 else 0 end) % 2 = 0 as is_text from ch),
    cn as (select *, case when is_text then 10 + floor({uniform_sql(str(SEED), 'sample_index', 'chunk', "'chunk'")} * 21) else 5 + floor({uniform_sql(str(SEED), 'sample_index', 'chunk', "'chunk'")} * 11) end::bigint as n from ct),
    cb as (select *, sum(n) over (partition by sample_index order by chunk) as high from cn),
    jn as (select wd.*, chunk, is_text from wd join cb on wd.sample_index = cb.sample_index and word >= high - n and word < high),
    sx as (select *, chunk > 0 and coalesce(lag(chunk) over (partition by sample_index order by place), -1) <> chunk as sw, case when is_text then case when token in ({PAD}, {END_OF_WORD}) then 0 else 1 end else duration end as own from jn),
    em as (select *, sum(own + sw::int) over (partition by sample_index order by place) - own - sw::int as begin from sx),
    ex as (select *, unnest(range((own + sw::int)::bigint)) as k from em where begin < {size})
    select sample_index, (begin + k)::bigint as pos, source, (case when sw and k = 0 then {SWITCH} when is_text then token else {PAD} end)::int as text,
      case when not (sw and k = 0) and not is_text then audio + k - sw::int end::bigint as frame, (sw and k = 0) or is_text as txt_in, not (sw and k = 0) and not is_text as other_in,
      not (sw and k = 0) and is_text as txt_pred, not (sw and k = 0) and not is_text as other_pred
    from ex where begin + k < {size}"""


@query(interleave_sql())
def interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alternating text and frame chunks of drawn sources, samples of 256 positions."""
    return mixture.interleave(drawn(spark, sf_dir), SIZE, END_OF_WORD, PAD, SWITCH, SEED)


@query(interleave_sql(size=LONG_SIZE, draws=LONG_SQL_DRAWS))
def interleave_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of 2,048 positions."""
    return drawn_interleaved(spark, sf_dir, LONG_SIZE)(_indices(spark, sf_dir))


@query(
    f"""with {_DRAWN}, bg as (select *, (sum(duration) over (partition by sample_index order by place) - duration)::bigint as begin from dr),
    ex as (select *, unnest(range(duration)) as k from bg where begin < {SIZE})
    select sample_index, begin + k as pos, source, token as text, audio + k as frame, token <> {PAD} as txt_in, true as other_in, true as txt_pred, true as other_pred from ex where begin + k < {SIZE}"""
)
def aligned_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame-synchronous text and codes."""
    return mixture.aligned_layout(drawn(spark, sf_dir, emitted=aligned), SIZE, PAD)


@query(interleave_sql())
def stream_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interleaved samples by the streaming source: stopped in the middle, resumed from its checkpoint; equal to one run."""
    folder, layout = scratch(spark, "stream"), drawn_interleaved(spark, sf_dir)
    total = _indices(spark, sf_dir).count()
    for stop in (total // 2, total):
        numbers = samples.sample_stream(spark, stop=stop, samplesPerTrigger=max(1, -(-total // 4)))
        run = samples.write_samples(numbers, layout, f"{folder}/out", f"{folder}/check")
        run.processAllAvailable()
        run.stop()
    return spark.read.parquet(f"{folder}/out").drop("batch")
