"""Benchmark preparation: story triples, prompts, few-shot pools, variants and accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from weft.functions import text
from weft.functions.hashing import uniform_sql
from weft.operators import evaluation, sequences
from weft.operators.ordering import next_in_order
from weft.plans.registry import load, query

SEED = 11
SHOTS = 3

_STORY = """t as (select conv_id, min(text) filter (turn = 0) as prompt, min(text) filter (turn = 1) as chosen from conversations group by 1),
    st as (select conv_id as pair_id, prompt, chosen, lead(chosen, 1, first_chosen) over (order by conv_id) as rejected from (select *, first_value(chosen) over (order by conv_id) as first_chosen from t) where prompt is not null and chosen is not null)"""
_NORM = r"replace(lower(trim(regexp_replace(regexp_replace(trim({c}, E' \t\n\r\f\x0b'), '[.!?]+$', ''), '\s+', ' ', 'g'))), 'ß', 'ss')"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """place, pair_id, text, type, correctness: turn 0 prompts, turn 1 fits, the next conversation's turn 1 does not."""
    c = load(spark, sf_dir, "conversations")
    t = c.groupBy("conv_id").agg(F.min(F.when(F.col("turn") == 0, F.col("text"))).alias("prompt"), F.min(F.when(F.col("turn") == 1, F.col("text"))).alias("chosen"))
    t = next_in_order(t.where("prompt is not null and chosen is not null"), "conv_id", "chosen").withColumnRenamed("next_chosen", "next")
    row = lambda kind, right, x: F.struct(F.lit(kind).alias("type"), F.lit(right).alias("correctness"), F.col(x).alias("text"))
    return t.select((F.col("conv_id") * 3).alias("base"), F.col("conv_id").alias("pair_id"), F.posexplode(F.array(row("prompt", "-", "prompt"), row("continuation", "correct", "chosen"), row("continuation", "incorrect", "next"))).alias("k", "x")).select((F.col("base") + F.col("k")).alias("place"), "pair_id", "x.text", "x.type", "x.correctness")


def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.story_pivot(_rows(spark, sf_dir)).where("problem is null")


@query(f"with {_STORY} select pair_id, md5(prompt) as prompt, md5(chosen) as chosen, md5(rejected) as rejected, 'none' as problem from st")
def story_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = evaluation.story_pivot(_rows(spark, sf_dir))
    return s.select("pair_id", *(F.md5(c).alias(c) for c in ("prompt", "chosen", "rejected")), F.coalesce("problem", F.lit("none")).alias("problem"))


@query(f"select doc_id, md5({_NORM.format(c='text')}) as digest, length({_NORM.format(c='text')})::bigint as chars from documents")
def story_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = text.normalize_story(F.col("text"))
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(n).alias("digest"), F.length(n).cast("long").alias("chars"))


_ITEMS = r"""it as (select item_id, list_filter(string_split_regex(text, '\.\s*'), lambda x: x <> '') as s, case when item_id % 4 = 0 then '' else 'high_school_' || (item_id % 5)::varchar end as subject from benchmark),
    q as (select item_id as "index", s[1] as question, [coalesce(s[2], 'none'), coalesce(s[3], 'none'), coalesce(s[4], 'none'), coalesce(s[5], 'none')] as options, subject, (item_id % 4)::int as gold from it),
    qq as (select *, replace(coalesce(nullif(subject, ''), 'general'), '_', ' ') as topic from q)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as questions: the first sentence asks, the next four are the options."""
    s = F.filter(F.split("text", r"\.\s*"), lambda x: x != "")
    b = load(spark, sf_dir, "benchmark").select("item_id", s.alias("s"), F.when(F.col("item_id") % 4 == 0, "").otherwise(F.concat(F.lit("high_school_"), (F.col("item_id") % 5).cast("string"))).alias("subject"))
    at = lambda k: F.coalesce(F.get("s", F.lit(k)), F.lit("none"))
    return b.select(F.col("item_id").alias("index"), F.get("s", F.lit(0)).alias("question"), F.array(*(at(k) for k in range(1, 5))).alias("options"), "subject", (F.col("item_id") % 4).cast("int").alias("gold"))


_MC = "'The following are multiple choice questions (with answers) about ' || topic || E'.\\n\\nQuestion: ' || question || E'\\nA. ' || options[1] || E'\\nB. ' || options[2] || E'\\nC. ' || options[3] || E'\\nD. ' || options[4]"
_CLOZE = "'The following are questions about ' || topic || E'.\\nQuestion: ' || question"


@query(f"with {_ITEMS} select \"index\", {_MC} as prompt, E'\\nAnswer: ' || substr('ABCD', gold + 1, 1) || '.' as answer from qq")
def mc_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    letter = F.get(F.array(*map(F.lit, evaluation.LETTERS)), F.col("gold"))
    return items(spark, sf_dir).select("index", evaluation.choice_prompt(F.col("question"), F.col("options"), F.col("subject")).alias("prompt"), evaluation.letter_answer(letter).alias("answer"))


@query(f"with {_ITEMS} select \"index\", (k - 1)::int as opt, {_CLOZE} as prompt, E'\\nAnswer: ' || options[k] as answer from qq, (select unnest([1, 2, 3, 4]) as k)")
def cloze_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluation.explode_options(items(spark, sf_dir))
    return rows.select("index", "opt", evaluation.cloze_prompt(F.col("question"), F.col("subject")).alias("prompt"), evaluation.text_answer(F.col("option")).alias("answer"))


_SHOTS = f"""rg as (select "index" as other, row_number() over (order by {uniform_sql(str(SEED), '"index"', "'ring'")}, "index") - 1 as seat, count(*) over () as pool from q),
    se as (select q."index", step, (floor({uniform_sql(str(SEED), '"index"', "'seat'")} * pool)::bigint + step) % pool as seat from q, (select unnest(range({SHOTS} + 1)) as step), (select max(pool) as pool from rg) where step < pool),
    sh as (select "index", other, row_number() over (partition by "index" order by step) as shot from se join rg using (seat) where "index" <> other)"""


def _shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = items(spark, sf_dir)
    return evaluation.pick_shots(q, q, SHOTS, SEED)


@query(
    f"""with {_ITEMS}, {_SHOTS}, so as (select "index" as other, {_CLOZE} || E'\\nAnswer: ' || options[gold + 1] as solved from qq)
    select qq."index", max(n) as shots, md5(max(joined) || {_CLOZE}) as digest from qq join (select "index", count(*) as n, string_agg(solved || E'\\n\\n', '' order by shot) as joined from sh join so using (other) where shot <= {SHOTS} group by 1) j using ("index") group by qq."index", topic, question"""
)
def few_shot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three solved questions before each prompt, never the question itself."""
    q = items(spark, sf_dir)
    prompt = evaluation.cloze_prompt(F.col("question"), F.col("subject"))
    solved = q.select(F.col("index").alias("other"), F.concat(prompt, evaluation.text_answer(F.get("options", F.col("gold")))).alias("solved"))
    shots = _shots(spark, sf_dir)
    n = shots.groupBy("index").agg(F.count("*").alias("shots"))
    return evaluation.shot_prompts(q.select("index", prompt.alias("prompt")), shots, solved).join(n, "index").select("index", "shots", F.md5("prompt").alias("digest"))


@query(f"""select doc_id as "index" from documents order by {uniform_sql(str(SEED), 'doc_id', "'subset'")}, doc_id limit (select greatest(1, round_even(0.15 * count(*), 0)::bigint) from documents)""")
def eval_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("index"))
    return evaluation.eval_subset(docs, 0.15, docs.count(), SEED)


@query(
    f"""with {_STORY}, v as (select pair_id, length(prompt)::bigint % 37 as tp, length(chosen)::bigint % 23 + 1 as tc from st),
    r as (select pair_id, tp, tc, unnest(range(tp + 1 + tc)) as pos from v)
    select pair_id, pos::int as pos, (case when pos < tp then 10 + pos % 7 when pos = tp then 52 else 50 end)::int as text, (case when pos > tp then 20 + (pos - tp - 1) % 5 else 99 end)::int as audio, pos <= tp as txt_in, pos > tp as aud_in, false as txt_pred, pos >= tp and pos < tp + tc as aud_pred from r"""
)
def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text prompt, switch, audio continuation of each story as rows with masks."""
    s = stories(spark, sf_dir).select("pair_id", (F.length("prompt") % 37).alias("tp"), (F.length("chosen") % 23 + 1).alias("tc"))
    upto = lambda n, f: F.when(F.col(n) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.col(n) - 1, F.lit(0))), f))
    s = s.select("pair_id", upto("tp", lambda i: 10 + i % 7).alias("prompt"), upto("tc", lambda i: 20 + i % 5).alias("continuation"))
    rows = evaluation.variant(F.col("prompt"), F.col("continuation"), True, False, 50, 52, 99)
    return s.select("pair_id", F.posexplode(rows).alias("pos", "r")).select("pair_id", "pos", "r.*")


@query(
    f"""with {_STORY}, v as (select pair_id, length(prompt)::bigint % 37 + 2 + length(chosen)::bigint % 23 as n from st)
    select pair_id, n, (max(n) over ())::bigint as padded from v"""
)
def collate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of each variant and after padding to the longest of the batch."""
    from weft.functions.numeric import pad_to

    s = stories(spark, sf_dir).select("pair_id", F.array_repeat(F.lit(1), F.length("prompt") % 37 + 2 + F.length("chosen") % 23).alias("tokens"))
    longest = s.agg(F.max(F.size("tokens")).alias("longest"))
    padded = s.join(F.broadcast(longest)).withColumn("padded", pad_to(F.col("tokens"), F.col("longest"), F.lit(0)))
    return padded.select("pair_id", F.size("tokens").cast("long").alias("n"), F.size("padded").cast("long").alias("padded"))


@query(
    r"""with w as (select conv_id, turn, string_split_regex(lower(text), '\s+') as w from conversations), p as (select *, lag(w) over (partition by conv_id order by turn) as before from w)
    select conv_id, turn, len(w)::bigint - case when before[-1] = w[1] then 1 else 0 end as kept from p where before is not null"""
)
def boundary_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn loses its first word where it repeats the last word of the turn before."""
    words = F.split(F.lower("text"), r"\s+")
    w = load(spark, sf_dir, "conversations").select("conv_id", "turn", words.alias("w"))
    p = w.withColumn("before", F.lag("w").over(Window.partitionBy("conv_id").orderBy("turn"))).where("before is not null")
    return p.select("conv_id", "turn", F.size(sequences.collapse_boundary(F.col("before"), F.col("w"))).cast("long").alias("kept"))


_SCORES = """sc as (select l.doc_id as "index", o as opt, case when (l.doc_id + o) % 11 = 0 then 'nan'::double when (l.doc_id + o) % 13 = 0 then -1e31 else -((l.doc_id * 7 + o * 5) % 17)::double end as logprob, l.quality as gold from labels l, (select unnest(range(2)) as o))"""


@query(
    f"""with {_SCORES}, b as (select "index", gold, min(opt) filter (logprob = best) as pred from (select *, max(logprob) filter (not isnan(logprob) and logprob > -1e30) over (partition by "index") as best from sc) group by 1, 2)
    select count(*) as kept, coalesce(sum(case when pred = gold then 1 else 0 end), 0)::bigint as correct, round(avg(case when pred = gold then 1.0 else 0.0 end), 9) as accuracy from b"""
)
def choice_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First best option of each example against gold; NaN and vanishing scores never win."""
    labels = load(spark, sf_dir, "labels")
    s = labels.select(F.col("doc_id").alias("index"), F.explode(F.array(F.lit(0), F.lit(1))).alias("opt"))
    k = F.col("index") + F.col("opt")
    s = s.withColumn("logprob", F.when(k % 11 == 0, float("nan")).when(k % 13 == 0, -1e31).otherwise(-((F.col("index") * 7 + F.col("opt") * 5) % 17).cast("double")))
    rows = evaluation.best_options(s).join(labels.select(F.col("doc_id").alias("index"), F.col("quality").alias("gold")), "index")
    return evaluation.accuracy(rows).select("kept", "correct", F.round("accuracy", 9).alias("accuracy"))
