"""Frame timelines: run-length collapse, alignment, delays, masks, quantisation. Events are each user's frames."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from weft.functions import numeric
from weft.operators import alignment, quantize, sequences, validation
from weft.plans.registry import load, query

END = 4
DELAYS = (0, 2, 5)
FILL = 999
CENTROIDS = 16

_EVENTS = """ev as (select user_id, row_number() over (partition by user_id order by ts, event_id) - 1 as pos, event_id, event_type, value,
      (floor(abs(value))::bigint % 4)::int as code, count(*) over (partition by user_id) as n from events)"""


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = Window.partitionBy("user_id").orderBy("ts", "event_id")
    code = (F.floor(F.abs("value")) % 4).cast("int")
    return load(spark, sf_dir, "events").select("user_id", (F.row_number().over(at) - 1).cast("long").alias("pos"), "event_id", "event_type", "value", code.alias("code"), F.count("*").over(Window.partitionBy("user_id")).alias("n"))


_RUNS = f"""{_EVENTS}, f as (select user_id, pos, code from ev union all select user_id, max(pos) + 1, {END} from ev group by 1),
    c as (select user_id, pos, code, case when lag(code) over w is distinct from code or pos = 0 then 1 else 0 end as new from f window w as (partition by user_id order by pos)),
    r as (select user_id, pos as frame, code, (sum(new) over (partition by user_id order by pos) - 1)::bigint as run from c)"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = sequences.with_end(timeline(spark, sf_dir).select("user_id", "pos", "code"), ["user_id"], "pos", "code", END)
    return sequences.frame_runs(frames, ["user_id"], ["pos"], "code")


@query(f"with {_RUNS} select user_id, run, min(code) as code, count(*) as n from r group by 1, 2")
def rle_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.run_lengths(_runs(spark, sf_dir), ["user_id"], "code")


@query(f"with {_RUNS} select user_id, frame::bigint as frame, code from r")
def expand_runs_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames of each user's runs, by the table function in SQL."""
    sequences.register_functions(spark)
    view = f"runs_{uuid.uuid4().hex}"
    rle_collapse(spark, sf_dir).select("user_id", "run", "code", F.col("n").alias("duration")).createOrReplaceTempView(view)
    return spark.sql(f"select user_id, frame, code from expand_runs(table({view}) partition by user_id order by run)")


@query(f"with {_RUNS} select user_id, frame, run from r")
def frame_to_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).select("user_id", "frame", "run")


def _arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id and its codes in order."""
    rows = timeline(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("pos", "code"))).alias("x"))
    return rows.select("user_id", F.transform("x", lambda x: x["code"]).alias("codes"))


@query(
    f"""with {_RUNS}, k as (select user_id, count(distinct run) as runs from r group by 1)
    select user_id, k.runs, true as equal, md5(string_agg(code::varchar, ',' order by frame)) as digest from r join k using (user_id) group by 1, 2"""
)
def rle_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Array form: collapsing and expanding by run lengths gives the frames back."""
    c = _arrays(spark, sf_dir).withColumn("c", sequences.collapse(F.col("codes"), F.lit(END)))
    lengths = F.transform(alignment.run_length(F.col("c.frame_to_code")), lambda r: r["duration"])
    back = numeric.expand_runs(F.col("c.codes"), lengths)
    whole = F.concat("codes", F.array(F.lit(END)))
    return c.select("user_id", F.size("c.codes").cast("long").alias("runs"), (back == whole).alias("equal"), F.md5(F.array_join(back, ",")).alias("digest"))


_WORDS = f"""{_EVENTS}, w as (select user_id, pos, n, n * 0.5::double as seconds, (case when user_id % 5 = 0 then n else 4 * n end)::int as steps,
      pos * 0.5::double as s, pos * 0.5::double + case when event_id % 2 = 0 then 0.3::double else 0.4::double end as e from ev)"""


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each user: an event every half second, two ids a word (a token and the end of word 101)."""
    t = timeline(spark, sf_dir)
    start = F.col("pos") * 0.5
    end = start + F.when(F.col("event_id") % 2 == 0, 0.3).otherwise(0.4)
    word = F.struct("pos", F.col("event_type").alias("text"), start.alias("start"), end.alias("end"), F.array(F.length("event_type"), F.lit(101)).alias("ids"))
    rows = t.groupBy("user_id", "n").agg(F.array_sort(F.collect_list(word)).alias("words"))
    return rows.select("user_id", "words", (F.col("n") * 0.5).alias("seconds"), F.when(F.col("user_id") % 5 == 0, F.col("n")).otherwise(4 * F.col("n")).cast("int").alias("steps"))


align_words_sql = f"""with recursive {_WORDS},
    b as (select *, least(steps - 1, round_even(s / seconds * steps, 0)::int) as lo0 from w),
    c as (select *, least(steps, greatest(lo0 + 1, round_even(e / seconds * steps, 0)::int)) as hi0 from b),
    f as (select user_id, -1::bigint as pos, 0::int as previous_end, null::varchar as error, null::int as lo, null::int as hi from (select distinct user_id from c)
      union all
      select c.user_id, c.pos,
        case when f.error is null and not (greatest(f.previous_end, lo0) >= steps or hi0 <= greatest(f.previous_end, lo0)) and least(steps, greatest(hi0, greatest(f.previous_end, lo0) + 2)) - greatest(f.previous_end, lo0) >= 2
          then least(steps, greatest(hi0, greatest(f.previous_end, lo0) + 2)) else f.previous_end end,
        case when f.error is not null then f.error when greatest(f.previous_end, lo0) >= steps or hi0 <= greatest(f.previous_end, lo0) then 'outside usable steps'
          when least(steps, greatest(hi0, greatest(f.previous_end, lo0) + 2)) - greatest(f.previous_end, lo0) < 2 then 'too few steps for its tokens' end,
        greatest(f.previous_end, lo0), least(steps, greatest(hi0, greatest(f.previous_end, lo0) + 2))
      from f join c on c.user_id = f.user_id and c.pos = f.pos + 1)
    select user_id, coalesce(arg_max(error, pos), 'none') as error, arg_max(previous_end, pos) as previous_end, count(*) filter (pos >= 0 and error is null) as words,
      coalesce(md5(string_agg(lo::varchar || '-' || hi::varchar, ',' order by pos) filter (pos >= 0 and error is null)), md5('')) as digest
    from f group by 1"""


@query(align_words_sql)
def align_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _words(spark, sf_dir).withColumn("a", alignment.word_spans(F.col("words"), F.col("steps"), F.col("seconds")))
    text = F.transform("a.spans", lambda p: F.concat_ws("-", p["low"].cast("string"), p["high"].cast("string")))
    return a.select("user_id", F.coalesce("a.error", F.lit("none")).alias("error"), F.col("a.previous_end").alias("previous_end"), F.size("a.spans").cast("long").alias("words"), F.md5(F.array_join(text, ",")).alias("digest"))


@query(
    f"""with {_WORDS}, g as (select user_id, pos, n, steps * 2 as steps, s, seconds, (steps * 2 - 1) as frames from w),
    b as (select user_id, pos, frames, steps, least(frames - 1, round_even(s / seconds * frames, 0)::int) as lo from g),
    p as (select *, coalesce(lead(lo) over (partition by user_id order by pos), frames) as hi from b)
    select user_id, steps::int as steps, bool_or(hi - lo < 2) as failed, sum(hi - lo)::bigint as covered, count(*) as words from p group by 1, 2"""
)
def align_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame-synchronous placement: one id at a word's start, its end of word in the last frame before the next."""
    w = _words(spark, sf_dir).withColumn("steps", F.col("steps") * 2)
    words = F.transform("words", lambda x: F.struct(x["start"].alias("start"), F.slice(x["ids"], 1, 1).alias("ids")))
    placed = w.withColumn("p", alignment.frame_starts(words, F.col("steps") - 1, F.col("seconds")))
    covered = F.aggregate("p", F.lit(0), lambda a, x: a + x["high"] - x["low"])
    return placed.select("user_id", "steps", alignment.frame_alignment_error(F.col("p")).alias("failed"), covered.cast("long").alias("covered"), F.size("p").cast("long").alias("words"))


_LAID = r"""words as (select doc_id, unnest(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) as word, generate_subscripts(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''), 1) - 1 as i from documents),
    laid as (select doc_id, i, word, (length(word)::bigint + 1) // 2 as patches,
      coalesce(sum((length(word)::bigint + 1) // 2 + 1) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0)::bigint as s from words),
    spans as (select doc_id, i, s, s + patches as e, lead(s) over (partition by doc_id order by i) as nx, (sum(patches + 1) over (partition by doc_id))::bigint as length, [length(word)::bigint, length(word)::bigint % 7] as tokens from laid)"""


def _laid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit glyph widths: a bigram a patch, a blank patch between words, the end in the last."""
    docs = load(spark, sf_dir, "documents").select("doc_id", F.filter(F.split("text", r"\s+"), lambda x: x != "").alias("held"))
    width = lambda w: numeric.patches(F.length(w), 2)
    summed = docs.withColumn("sums", numeric.running_sums(F.transform("held", lambda w: width(w) + 1)))
    end = lambda i: (F.get("sums", i) - 1).cast("int")
    words = F.transform("held", lambda w, i: F.struct(i.alias("word"), (end(i) - width(w)).alias("start"), end(i).alias("end"), F.array(F.length(w), F.length(w) % 7).alias("tokens")))
    return summed.select("doc_id", words.alias("words"), F.coalesce(F.try_element_at("sums", F.lit(-1)), F.lit(0)).cast("int").alias("length"))


@query(
    f"""with {_LAID},
    marks as (select doc_id, i, 0 as k, greatest(s - 1, 0) as patch, 101::bigint as token from spans where greatest(s - 1, 0) < length - 1),
    placed as (select doc_id, i, k, greatest(s, greatest(s - 1, 0) + 1) + k - 1 as patch, tokens[k] as token, least(e, coalesce(nx, length - 1), length - 1) as stop from spans, (select unnest([1, 2]) as k)),
    writes as (select * from marks union all select doc_id, i, k, patch, token from placed where patch < stop),
    last as (select doc_id, patch, arg_max(token, i * 10 + k) as token from writes group by 1, 2)
    select doc_id, count(*) as written, sum(token)::bigint as tokens, sum(patch * token % 1009)::bigint as checksum from last group by 1"""
)
def align_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = _laid(spark, sf_dir).select("doc_id", alignment.patch_array(F.col("words"), F.col("length"), 101).alias("last"))
    total = lambda f: F.aggregate("last", F.lit(0).cast("long"), lambda a, x: a + f(x))
    return last.select("doc_id", F.size("last").cast("long").alias("written"), total(lambda x: x["token"]).alias("tokens"), total(lambda x: x["patch"].cast("long") * x["token"] % 1009).alias("checksum")).where("written > 0")


@query(
    r"""with t as (select doc_id, unnest(string_split_regex(text, '\s+')) as word from documents),
    w as (select doc_id, sum(ceil(length(word) * 8 / 16.0))::bigint as patches, count(*) as words from t where word <> '' group by 1)
    select doc_id, words, patches, (patches > 512) as truncated from w"""
)
def patch_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches of 16 pixels that 8-pixel glyphs need, and whether a page of 512 patches cuts the text."""
    docs = load(spark, sf_dir, "documents")
    words = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    patches = F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + numeric.patches(F.length(w) * 8))
    return docs.select("doc_id", F.size(words).cast("long").alias("words"), patches.alias("patches")).where("words > 0").withColumn("truncated", F.col("patches") > 512)


_SAMPLES = f"""{_EVENTS}, s as (select (user_id % 8)::int as shard, case when user_id % 31 = 7 then '' else user_id::varchar end as id, count(*) as n_codes, min(code) as low, max(code) as high, sum(1 + (case when user_id % 29 = 3 and pos = 0 then 1 else 0 end)) as dur from ev group by 1, 2, user_id)"""


@query(
    f"""with {_SAMPLES}, m as (select shard, count(*) + case when shard = 2 then 1 else 0 end as num, sum(n_codes) as steps from s group by 1),
    t as (select shard, count(*) as n, count(distinct id) as ids, count(*) filter (id = '') as no_id, max(high) as high, count(*) filter (dur <> n_codes) as bad from s group by 1)
    select shard, case when shard = 5 then 'schema version' when n <> num then 'sample count' when high >= 4 then 'code range' when no_id > 0 or ids <> n then 'sample ids' when bad > 0 then 'duration sums' end as problem from m join t using (shard)"""
)
def validate_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first failing rule of each shard: a wrong version, a wrong count, blank ids and bad durations are planted."""
    t = timeline(spark, sf_dir)
    extra = F.when((F.col("user_id") % 29 == 3) & (F.col("pos") == 0), 1).otherwise(0)
    s = t.groupBy("user_id").agg(F.count("*").alias("n_codes"), F.min("code").alias("min_code"), F.max("code").alias("max_code"), F.sum(1 + extra).alias("dur_sum"))
    s = s.select((F.col("user_id") % 8).cast("int").alias("shard"), F.when(F.col("user_id") % 31 == 7, "").otherwise(F.col("user_id").cast("string")).alias("id"), "n_codes", "min_code", "max_code", F.col("n_codes").alias("n_text"), F.col("n_codes").alias("n_dur"), "dur_sum")
    meta = s.groupBy("shard").agg((F.count("*") + F.when(F.col("shard") == 2, 1).otherwise(0)).alias("num_samples"), F.sum("n_codes").alias("num_audio_steps"), F.sum("n_text").alias("num_text_tokens"))
    meta = meta.withColumn("schema_version", F.when(F.col("shard") == 5, 2).otherwise(1)).withColumn("vocab_size", F.lit(4))
    return validation.shard_problems(s, meta)


def _books(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = timeline(spark, sf_dir)
    return t.select("user_id", "pos", *(((F.floor(F.abs("value")) + 7 * k) % 5).cast("int").alias(f"c{k}") for k in range(3)))


_BOOKS = f"""{_EVENTS}, bk as (select user_id, pos, (floor(abs(value))::bigint % 5)::int as c0, ((floor(abs(value))::bigint + 7) % 5)::int as c1, ((floor(abs(value))::bigint + 14) % 5)::int as c2 from ev)"""


def _delayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _books(spark, sf_dir).select("user_id", "pos", *(sequences.delay(F.col(f"c{k}"), d, F.lit(FILL), ["user_id"], "pos").alias(f"c{k}") for k, d in enumerate(DELAYS)))


@query(f"with {_BOOKS} select user_id, pos, c0, lag(c1, 2, {FILL}) over w as c1, lag(c2, 5, {FILL}) over w as c2 from bk window w as (partition by user_id order by pos)")
def delay_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _delayed(spark, sf_dir)


@query(f"with {_BOOKS}, n as (select user_id, count(*) as n from bk group by 1) select user_id, pos, c0, c1, c2 from bk join n using (user_id) where pos < n - 5")
def undelay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codebooks moved back, without the last max(delay) rows."""
    d = _delayed(spark, sf_dir).withColumn("n", F.count("*").over(Window.partitionBy("user_id")))
    back = d.select("user_id", "pos", "n", *(sequences.undelay(F.col(f"c{k}"), s, ["user_id"], "pos").alias(f"c{k}") for k, s in enumerate(DELAYS)))
    return back.where(F.col("pos") < F.col("n") - max(DELAYS)).drop("n")


_SEGMENTS = f"""{_EVENTS}, m as (select user_id, pos, code >= 2 as inside from ev),
    t as (select *, case when inside and not coalesce(lag(inside) over (partition by user_id order by pos), false) then 1 else 0 end as st from m),
    sg as (select user_id, pos, case when inside then (sum(st) over (partition by user_id order by pos) - 1)::bigint else -1 end as segment from t)"""


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = timeline(spark, sf_dir).select("user_id", "pos", (F.col("code") >= 2).alias("inside"))
    return sequences.segment_ids(m, "inside", ["user_id"], "pos").select("user_id", "pos", "segment")


@query(f"with {_SEGMENTS} select user_id, pos, segment from sg")
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir)


@query(f"with {_SEGMENTS} select a.user_id, a.pos, a.segment, count(*) as visible from sg a join sg b on a.user_id = b.user_id and a.segment = b.segment and b.pos <= a.pos group by 1, 2, 3")
def causal_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many positions each row sees; positions outside all segments see each other."""
    return sequences.causal_pairs(_segments(spark, sf_dir), ["user_id"], "pos")


@query(
    f"""with {_EVENTS}, m as (select user_id, pos, code, lead(code) over w as t, lead(code > 1) over w as p, lead(pos) over w as nx from ev window w as (partition by user_id order by pos))
    select user_id, pos, code, t as target_code, p as next_predicted from m where nx is not null"""
)
def pred_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shift by one: the target and its prediction mask; the last position has none."""
    t = timeline(spark, sf_dir).select("user_id", "pos", "code", (F.col("code") > 1).alias("predicted"))
    return sequences.masks_to_targets(t, ["user_id"], "pos", ["code"], ["predicted"]).drop("predicted")


@query("select event_id, (floor(abs(value))::bigint % 256)::double / 255 as unit, (floor(abs(value))::bigint % 256) > 127.5 as binary, round_even(greatest(0.0, least(1.0, value / 100)) * 255, 0)::int as code from events")
def unit_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit scaling, binarisation and dequantisation of 256 levels."""
    x = F.floor(F.abs("value")) % 256
    return load(spark, sf_dir, "events").select("event_id", numeric.to_unit(x, 256).alias("unit"), numeric.binarize(x, 256).alias("binary"), numeric.dequantize(F.col("value") / 100, 256).alias("code"))


_DISTANCE = "round(list_sum(list_transform(range({lo}, {hi}), lambda i: (e.embedding[i + 1]::double - c.embedding[i + 1]::double) * (e.embedding[i + 1]::double - c.embedding[i + 1]::double))), 6)"


def _assigned(spark: SparkSession, sf_dir: str, parts: int) -> DataFrame:
    e = load(spark, sf_dir, "embeddings")
    table = quantize.centroid_table(e.where(F.col("vec_id") < CENTROIDS), "vec_id", "embedding")
    return quantize.assign(e, "vec_id", "embedding", table, parts)


@query(
    f"""select e.vec_id, arg_min(c.vec_id, ({_DISTANCE.format(lo=0, hi=64)} * 1e6)::bigint * 100 + c.vec_id)::int as code from embeddings e join embeddings c on c.vec_id < {CENTROIDS} group by 1"""
)
def kmeans_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest of the first 16 vectors."""
    return _assigned(spark, sf_dir, 1).select("vec_id", F.get("codes", F.lit(0)).alias("code"))


@query(
    f"""with d as (select e.vec_id, c.vec_id as c, {', '.join(f'({_DISTANCE.format(lo=16 * k, hi=16 * k + 16)} * 1e6)::bigint * 100 + c.vec_id as d{k}' for k in range(4))} from embeddings e join embeddings c on c.vec_id < {CENTROIDS})
    select vec_id, {', '.join(f'arg_min(c, d{k})::int as code{k}' for k in range(4))} from d group by 1"""
)
def kmeans_multi_codebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four codebooks, one a quarter of the vector."""
    return _assigned(spark, sf_dir, 4).select("vec_id", *(F.get("codes", F.lit(k)).alias(f"code{k}") for k in range(4)))


@query(
    f"""with {_EVENTS}, t as (select user_id, floor(sum(abs(value)) * 4000)::bigint as samples from ev group by 1)
    select user_id, samples, samples // 480000 + case when samples % 480000 >= 720 then 1 else 0 end as chunks, case when samples % 480000 < 720 then samples % 480000 else 0 end as dropped from t"""
)
def audio_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 30 s at 16 kHz; a tail below 720 samples is dropped.

    Doubles are added in the events' order, whatever the partitions: a running sum, whose last value is its largest."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    sums = load(spark, sf_dir, "events").select("user_id", F.sum(F.abs("value")).over(order).alias("sum"))
    t = sums.groupBy("user_id").agg(F.floor(F.max("sum") * 4000).alias("samples"))
    tail = F.col("samples") % 480_000
    return t.select("user_id", "samples", (F.floor(F.col("samples") / 480_000) + (tail >= 720).cast("long")).alias("chunks"), F.when(tail < 720, tail).otherwise(0).cast("long").alias("dropped"))


@query(
    f"""with {_EVENTS} select user_id, pos, greatest(coalesce(lag(pos * 0.5::double + code * 0.25) over w, pos * 0.5::double), pos * 0.5::double) as start,
      round(coalesce(sum(code * 0.25::double) over (partition by user_id order by pos rows between unbounded preceding and 1 preceding), 0), 6) as begin from ev window w as (partition by user_id order by pos)"""
)
def segment_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts no earlier than the end before, and the offset of each synthesised segment."""
    t = timeline(spark, sf_dir).select("user_id", "pos", (F.col("pos") * 0.5).alias("start"), (F.col("pos") * 0.5 + F.col("code") * 0.25).alias("end"), (F.col("code") * 0.25).alias("seconds"))
    timed = alignment.segment_offsets(alignment.monotone_starts(t, ["user_id"], "pos"), ["user_id"], "pos", "seconds")
    return timed.select("user_id", "pos", "start", F.round("begin", 6).alias("begin"))


def codes_in(codes: Column, vocab: int) -> Column:
    return F.size(validation.valid_codes(codes, vocab))


@query(f"with {_EVENTS} select user_id, count(*) filter (floor(abs(value))::bigint - 2 between 0 and 49) as valid, count(*) as n from ev group by 1")
def valid_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes inside the vocabulary, as a vocoder takes them."""
    rows = timeline(spark, sf_dir).groupBy("user_id").agg(F.collect_list(F.floor(F.abs("value")) - 2).alias("codes"), F.count("*").alias("n"))
    return rows.select("user_id", codes_in(F.col("codes"), 50).cast("long").alias("valid"), "n")
