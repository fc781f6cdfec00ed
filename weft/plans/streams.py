"""Adapters, token ids, stream selection, metadata, alignments in full and generation: each query beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weft.functions import hashing, numeric, text
from weft.functions.hashing import uniform_sql
from weft.operators import alignment, evaluation, mixture, modalities, scoring, sequences, streams, training, validation
from weft.plans import corpus, frames, layouts
from weft.plans import evaluation as benchmark
from weft.plans.registry import load, query
from weft.sources import manifests
from weft.sources.benchmarks import MixtureConfig

# adapters


@query(
    """select doc_id as record_index, 'd:train:' || substr(sha1(source || '/' || doc_id::varchar || '.wav:' || (n_chars + 1)::varchar), 1, 16) as id, '/audio/' || source || '/' || doc_id::varchar || '.wav' as audio, round((n_chars + 1) / 16000.0::double, 9) as duration from documents"""
)
def fairseq_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fairseq lines: an id is a digest of name and frames."""
    docs = load(spark, sf_dir, "documents")
    name = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".wav"))
    lines = docs.select((F.col("doc_id") + 1).alias("line"), F.concat(name, F.lit("\t"), (F.col("n_chars") + 1).cast("string")).alias("value"))
    m = manifests.fairseq_records(lines, F.lit("/audio"), "d", "train", 16000)
    return m.select("record_index", "id", "audio", F.round("duration", 9).alias("duration"))


@query(
    """with r as (select doc_id, source, lang, case when doc_id % 5 = 0 then null else source || '.wav' end as audio, case when doc_id % 4 = 0 then '0' when doc_id % 4 = 1 then '2.5' else '7' end as off from documents)
    select doc_id as record_index, case when doc_id % 7 = 0 then 'own-' || doc_id::varchar else source || ':' || lang || ':' || substr(sha1(coalesce(audio, 'None') || ':' || off || ':' || doc_id::varchar), 1, 16) end as id, source as dataset, lang as split, off::double as "offset" from r"""
)
def json_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON records with their own dataset, split and, some of them, id."""
    docs = load(spark, sf_dir, "documents")
    i = F.col("doc_id")
    offset = F.when(i % 4 == 0, F.lit(None)).when(i % 4 == 1, F.lit(', "offset": 2.5')).otherwise(F.lit(', "offset": 7'))
    audio = F.when(i % 5 == 0, F.lit(None)).otherwise(F.concat(F.lit(', "audio_path": "'), "source", F.lit('.wav"')))
    own = F.when(i % 7 == 0, F.concat(F.lit(', "id": "own-'), i.cast("string"), F.lit('"')))
    value = F.concat(F.lit('{"dataset": "'), "source", F.lit('", "split": "'), "lang", F.lit('"'), *(F.coalesce(x, F.lit("")) for x in (offset, audio, own)), F.lit("}"))
    m = manifests.from_json(docs.select(i.alias("line"), value.alias("value")), None, None)
    return m.select("record_index", "id", "dataset", "split", "offset")


@query("""select doc_id as record_index, 'tinystories:train:' || lpad(doc_id::varchar, 8, '0') as id, length(trim(text, E' \\t\\n\\r\\f\\x0b'))::bigint as chars, doc_id::varchar as source_index from documents""")
def story_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stories as records: the adapter without its limit."""
    rows = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_index"), "text")
    m = manifests.tinystories(rows, "train")
    return m.select("record_index", "id", F.length("transcript").cast("long").alias("chars"), F.element_at("extra", "source_index").alias("source_index"))


# token ids


@query(
    f"""with t as (select token, count(*) as n from (select unnest(regexp_extract_all(text, '{corpus.TOKEN}')) as token from documents) group by 1 order by n desc, token limit {corpus.VOCABULARY}),
    v as (select token, (row_number() over (order by n desc, token) + 1)::int as id from t),
    k as (select doc_id, unnest(regexp_extract_all(text, '{corpus.TOKEN}')) as token, generate_subscripts(regexp_extract_all(text, '{corpus.TOKEN}'), 1) as i from documents),
    s as (select doc_id, count(*) as n, string_agg(coalesce(id, 0)::varchar, ',' order by i) as ids from k left join v using (token) group by 1)
    select doc_id, coalesce(n, 0)::bigint + 1 as n, md5(case when n is null then '1' else ids || ',1' end) as digest from documents left join s using (doc_id)"""
)
def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of each document's tokens by the vocabulary table, the end id last."""
    ids = text.token_ids(load(spark, sf_dir, "documents").select("doc_id", "text"), "text", corpus.vocab_build(spark, sf_dir))
    return ids.select("doc_id", F.size("ids").cast("long").alias("n"), F.md5(F.array_join(F.transform("ids", lambda x: x.cast("string")), ",")).alias("digest"))


# streams

_CONFIG = MixtureConfig(weights=[0.4, 0.0, 0.2, 0.0, 0.4], datasets={"txt": ["en", "fr"], "aud": ["de", "en"], "audtxt": ["en", "de", "es"]}, probabilities={"audtxt": [0.5, 0.25, 0.25]}, splits=["train", "extra"], block_size=2048)
_KINDS = "case when sum(doc_id) % 3 = 0 then 'text' else 'speech' end"
_SHARDS = f"""sh as (select lang as dataset, case when doc_id % 4 = 3 then 'held' when doc_id % 4 = 2 then 'extra' else 'train' end as split, source as shard, sum(n_chars)::bigint as tokens, {_KINDS} as kind, sum(doc_id) % 5 <> 1 as has_text from documents group by 1, 2, 3)"""


def shard_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a language, split and source as one shard's metadata."""
    i = F.col("doc_id")
    split = F.when(i % 4 == 3, "held").when(i % 4 == 2, "extra").otherwise("train")
    grouped = load(spark, sf_dir, "documents").groupBy(F.col("lang").alias("dataset"), split.alias("split"), F.col("source").alias("shard"))
    told = grouped.agg(F.sum("n_chars").cast("long").alias("tokens"), F.when(F.sum("doc_id") % 3 == 0, "text").otherwise("speech").alias("kind"), (F.sum("doc_id") % 5 != 1).alias("has_text"))
    fixed = {"schema_version": 1, "profile": "aligned", "n_codebooks": 1, "vocab_size": 500, "pad_id": 501, "eos_id": 500}
    return told.withColumns({k: F.lit(v) for k, v in fixed.items()})


@query(
    f"""with {_SHARDS}, k as (select * from sh where split in ('train', 'extra')),
    txt as (select 'txt' as strategy, *, tokens / sum(tokens) over () as weight from k where kind = 'text' and dataset in ('en', 'fr') and tokens >= 2048),
    aud as (select 'aud' as strategy, *, tokens / sum(tokens) over () as weight from k where kind = 'speech' and dataset in ('de', 'en') and tokens >= 2048),
    paired as (select 'audtxt' as strategy, *, case dataset when 'en' then 0.5::double else 0.25 end * (tokens / sum(tokens) over (partition by dataset)) as weight from k where kind = 'speech' and has_text and dataset in ('en', 'de', 'es'))
    select strategy, dataset, split, shard, tokens, round(weight, 9) as weight from (select * from txt union all select * from aud union all select * from paired)"""
)
def stream_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards that each enabled strategy reads, with their weights."""
    expected = {"n_codebooks": 1, "vocab_size": 500, "pad_id": 501, "eos_id": 500}
    picked = streams.select_streams(shard_table(spark, sf_dir), _CONFIG, {"aud": expected, "audtxt": expected})
    return streams.require_all_strategies(picked, _CONFIG).withColumn("weight", F.round("weight", 9))


_META = """m as (select source as k, doc_id as place, 'doc' || doc_id::varchar as source, lang || '/base' || (doc_id % 40 // 39)::varchar || '-' || doc_id::varchar as tokenizer_id,
      case when doc_id % 3 = 0 then null else 'alias' || (doc_id % 50 // 49)::varchar end as tokenizer_alias, 100 + (doc_id % 60 // 59) as base_vocab_size, 7 as eos_id,
      case when doc_id % 4 = 0 then null else 100 end as pad_id, case when doc_id % 5 < 4 then null else 101 + (doc_id % 70 // 69) end as epad_id, null::bigint as special_vocab_size from documents)"""


@query(
    f"""with {_META}, f as (select *, first_value(tokenizer_id) over w as t0, first_value(tokenizer_alias) over w as a0, first_value(base_vocab_size) over w as b0,
      first_value(pad_id ignore nulls) over w as p0, first_value(epad_id ignore nulls) over w as e0 from m window w as (partition by k order by place)),
    j as (select *, case when regexp_replace(tokenizer_id, '-[^-]*$', '') <> regexp_replace(t0, '-[^-]*$', '') then 'tokenizer_id' when tokenizer_alias is not null and a0 is not null and tokenizer_alias <> a0 then 'tokenizer_alias'
      when base_vocab_size <> b0 then 'base_vocab_size' when pad_id is not null and p0 is not null and pad_id <> p0 then 'pad_id' when epad_id is not null and e0 is not null and epad_id <> e0 then 'epad_id' end as problem from f)
    select k, arg_min(tokenizer_id, place) as tokenizer_id, arg_min(base_vocab_size, place) as base_vocab_size, arg_min(pad_id, place) filter (pad_id is not null) as pad_id, arg_min(epad_id, place) filter (epad_id is not null) as epad_id,
      coalesce(arg_min(source || ': ' || problem, place) filter (problem is not null), 'none') as problem from j group by 1"""
)
def text_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text metadata of the documents of each source, reconciled: the first one's, gaps filled, first contradiction."""
    i = F.col("doc_id")
    odd = lambda n: (F.floor(i % n / (n - 1))).cast("long")
    rows = load(spark, sf_dir, "documents").select(
        F.col("source").alias("k"), i.alias("place"), F.concat(F.lit("doc"), i.cast("string")).alias("source"), F.concat("lang", F.lit("/base"), odd(40).cast("string"), F.lit("-"), i.cast("string")).alias("tokenizer_id"),
        F.when(i % 3 != 0, F.concat(F.lit("alias"), odd(50).cast("string"))).alias("tokenizer_alias"), (100 + odd(60)).alias("base_vocab_size"), F.lit(7).alias("eos_id"),
        F.when(i % 4 != 0, 100).alias("pad_id"), F.when(i % 5 == 4, 101 + odd(70)).alias("epad_id"), F.lit(None).cast("long").alias("special_vocab_size"),
    )
    out = streams.reconcile_text_metadata(rows, ["k"])
    return out.select("k", "tokenizer_id", "base_vocab_size", "pad_id", "epad_id", F.coalesce("problem", F.lit("none")).alias("problem"))


@query(
    """with f as (select lang || '/' || doc_id::varchar || '/meta.json' as path, sha256(text) as content from documents
      union select lang || '/' || doc_id::varchar || '/meta.json', sha256(text) from documents where doc_id % 4 = 0),
    g as (select split_part(path, '/', 1) as dataset, string_agg(path || content, '' order by path) as body, count(*) as files from f group by 1)
    select dataset, files, sha256('{"block_size": 2048, "splits": ["train"]}' || body) as digest from g"""
)
def dataset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of a configuration and of the union of two sets of metadata files, one a dataset."""
    docs = load(spark, sf_dir, "documents")
    files = lambda n: docs.where(F.col("doc_id") % n == 0).select(F.concat_ws("/", "lang", F.col("doc_id").cast("string"), F.lit("meta.json")).alias("path"), F.sha2("text", 256).alias("content"))
    return manifests.dataset_fingerprint(manifests.path_union(files(1), files(4)), {"splits": ["train"], "block_size": 2048})


# alignments in full


@query(
    r"""with w as (select item_id as doc, unnest(string_split(text, ' ')) as w, generate_subscripts(string_split(text, ' '), 1) - 1 as word from benchmark),
    p as (select doc, word, (sum(length(w) + 1) over (partition by doc order by word) - length(w) - 1)::bigint as s, (sum(length(w) + 1) over (partition by doc order by word) - 1)::bigint as e from w where w <> ''),
    t as (select item_id as doc, unnest(range((length(text)::bigint + 2) // 3)) as token_index, length(text)::bigint as n from benchmark)
    select t.doc, token_index, min(word)::bigint as word from t join p on t.doc = p.doc and token_index * 3 < e and least(token_index * 3 + 3, n) > s group by 1, 2"""
)
def token_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first word that each stretch of three characters overlaps."""
    items = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc"), "text")
    words = items.select("doc", F.posexplode(F.split("text", " ")).alias("word", "w"))
    ends = F.sum(F.length("w") + F.when(F.col("w") == "", 0).otherwise(1)).over(frames.Window.partitionBy("doc").orderBy("word")) - 1
    words = words.where("w <> ''").withColumn("end", ends).select("doc", F.col("word").cast("long").alias("word"), (F.col("end") - F.length("w")).alias("start"), "end")
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.length("text") + 2) / 3) - 1)).alias("token_index")
    tokens = items.where("length(text) > 0").select("doc", F.length("text").alias("n"), k)
    tokens = tokens.select("doc", "token_index", (F.col("token_index") * 3).alias("start"), F.least(F.col("token_index") * 3 + 3, F.col("n")).alias("end"))
    return alignment.tokens_to_words(tokens, words, ["doc"])


@query(
    f"""with {frames._RUNS}, {frames._WORDS.partition('from events), ')[2]},
    k as (select user_id, count(distinct run) as steps from r group by 1),
    pl as (select w.user_id, w.pos, steps::bigint as steps, w.n as frames, w.s, w.e, greatest(0, least(w.n - 1, floor(w.s / w.seconds * w.n)::bigint)) as f, greatest(1, least(w.n, ceil(w.e / w.seconds * w.n)::bigint)) as l from (select user_id, pos, n, s, e, seconds from w) w join k using (user_id)),
    sp as (select pl.*, x.run as start, least(y.run + 1, pl.steps - 1) as stop from pl join r x on x.user_id = pl.user_id and x.frame = pl.f join r y on y.user_id = pl.user_id and y.frame = pl.l - 1),
    d as (select user_id, count(*) as words, sum(start * 7 + stop) as checksum from sp where l > f and start < steps - 1 and stop > start group by 1)
    select user_id, coalesce(words, 0) as words, coalesce(checksum, 0)::bigint as checksum from k left join d using (user_id)"""
)
def evaluator_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in collapsed steps, as the evaluation places them."""
    codes = frames._arrays(spark, sf_dir).withColumn("c", sequences.collapse(F.col("codes"), F.lit(frames.END)))
    both = frames._words(spark, sf_dir).drop("steps").join(codes, "user_id")
    spans = modalities.evaluator_spans(F.col("words"), F.size("c.codes"), F.size("codes"), F.col("seconds"), F.col("c.frame_to_code"))
    total = F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["start"] * 7 + s["end"])
    return both.select("user_id", F.size(spans).cast("long").alias("words"), total.alias("checksum"))


_ALIGNED = """fs as (select user_id, pos, steps * 2 - 1 as frames, least(steps * 2 - 2, round_even(s / seconds * (steps * 2 - 1), 0)::int) as lo, word_length from wl),
    sp as (select *, coalesce(lead(lo) over (partition by user_id order by pos), frames) as hi from fs),
    bad as (select user_id, bool_or(hi - lo < 2) as failed, min(lo) as first from sp group by 1)"""


@query(
    f"""with {frames._WORDS}, wl as (select w.*, length(ev.event_type)::int as word_length from w join ev using (user_id, pos)), {_ALIGNED},
    ex as (select user_id, unnest(range(lo, hi)) as k, lo, hi, word_length from sp),
    tk as (select user_id, k, case when k = lo then word_length when k = hi - 1 then 101 else 100 end as token from ex
      union all select user_id, unnest(range(0, first)), 100 from bad union all select user_id, max(frames), 100 from sp group by 1)
    select user_id, count(*) as frames, md5(string_agg(token::varchar, ',' order by k)) as digest from tk join bad using (user_id) where not failed group by 1"""
)
def frame_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One token a frame of the frame-synchronous layout, padding in front, between and at the end."""
    w = frames._words(spark, sf_dir).withColumn("frames", F.col("steps") * 2 - 1)
    words = F.transform("words", lambda x: F.struct(x["start"].alias("start"), F.slice(x["ids"], 1, 1).alias("ids")))
    placed = w.withColumn("p", alignment.frame_starts(words, F.col("frames"), F.col("seconds"))).where(~alignment.frame_alignment_error(F.col("p")))
    tokens = alignment.frame_tokens(F.col("p"), F.col("frames"), 100, 101)
    return placed.select("user_id", F.size(tokens).cast("long").alias("frames"), F.md5(F.array_join(F.transform(tokens, lambda t: t.cast("string")), ",")).alias("digest"))


_FOLD = frames.align_words_sql.partition("select user_id, coalesce(arg_max(error, pos)")[0]


@query(
    f"""{_FOLD}, ok as (select user_id, max(steps) as steps from f join c using (user_id) group by 1 having max(error) is null),
    pieces as (select f.user_id, lo, (lo + (hi - lo) // 2)::int as mid, hi, length(ev.event_type)::int as a from f join ok using (user_id) join ev on ev.user_id = f.user_id and ev.pos = f.pos where f.pos >= 0),
    ps as (select user_id, lo, mid as hi, a as token from pieces union all select user_id, mid, hi, 101 from pieces),
    gaps as (select user_id, coalesce(lag(hi) over (partition by user_id order by lo, hi), 0) as lo, lo as hi, 100 as token from ps
      union all select user_id, max(hi), max(steps), 100 from ps join ok using (user_id) group by 1),
    every as (select * from ps where hi > lo union all select * from gaps where hi > lo),
    marked as (select *, case when lag(token) over (partition by user_id order by lo) is distinct from token then 1 else 0 end as new from every)
    select user_id, sum(new)::bigint as runs, sum(hi - lo)::bigint as steps, sum((hi - lo) * token)::bigint as mass from marked group by 1"""
)
def span_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs (token, duration) of the aligned words over all steps: spread over their ids, gaps padded, equal neighbours merged."""
    a = frames._words(spark, sf_dir).withColumn("a", alignment.word_spans(F.col("words"), F.col("steps"), F.col("seconds"))).where("a.error is null")
    a = a.select("user_id", alignment.runs_from_spans(F.col("a.spans"), F.col("steps"), 100).alias("runs"))
    total = lambda f: F.aggregate("runs", F.lit(0).cast("long"), lambda s, r: s + f(r))
    return a.select("user_id", F.size("runs").cast("long").alias("runs"), total(lambda r: r["duration"]).alias("steps"), total(lambda r: r["duration"] * r["token"]).alias("mass"))


@query(
    f"""with {frames._EVENTS}, x as (select user_id, pos, code as lo, (code + pos % 40)::bigint as hi, (1 + pos % 7)::bigint as n from ev), y as (select *, unnest(range(n + 1)) as i from x)
    select user_id, pos, sum((i + 1) * case when i = n then hi else floor(i * ((hi - lo) / n::double) + lo)::bigint end)::bigint as checksum from y group by 1, 2"""
)
def spread_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integer points of evenly spaced edges, the last one exact."""
    t = frames.timeline(spark, sf_dir).select("user_id", "pos", "code", (F.col("code") + F.col("pos") % 40).alias("high"), (1 + F.col("pos") % 7).alias("n"))
    edges = numeric.spread(F.col("code"), F.col("high"), F.col("n"))
    return t.select("user_id", "pos", F.aggregate(F.transform(edges, lambda e, i: e * (i + 1)), F.lit(0).cast("long"), lambda a, x: a + x).alias("checksum"))


# text


_WORDS_OF = r"select doc_id, unnest(list_distinct(regexp_extract_all(text, '[^\s]+'))) as w from documents"


@query(
    rf"""with w as ({_WORDS_OF}), t as (select doc_id, w, case when doc_id % 2 = 0 then translate(lower(w), 'abcdefghijklmnopqrstuvwxyz', 'אבגדהוזחטיכלמנסעפצקרשתאבגד') else w end as word from w),
    c as (select *, regexp_replace(regexp_replace(word, '^[\s[:punct:]0-9]+', ''), '[\s[:punct:]0-9]+$', '') as core from t),
    s as (select *, (regexp_matches(substr(core, 1, 1), '^[֐-ࣿיִ-﷿ﹰ-﻿]$'))::int + (regexp_matches(substr(core, greatest(length(core), 1), 1), '^[֐-ࣿיִ-﷿ﹰ-﻿]$'))::int + (regexp_matches(substr(core, length(core) // 2 + 1, 1), '^[֐-ࣿיִ-﷿ﹰ-﻿]$'))::int as score from c)
    select doc_id, count(*) filter (score >= 2) as rtl, count(*) filter (regexp_matches(word, '[\p{{L}}\p{{N}}]')) as speech, count(*) as words from s group by 1"""
)
def word_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that write from right to left (half of the documents are put in Hebrew letters) and words with a letter or digit."""
    words = load(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[^\s]+"), F.lit(0)))).alias("w"))
    hebrew = F.translate(F.lower("w"), "abcdefghijklmnopqrstuvwxyz", "אבגדהוזחטיכלמנסעפצקרשתאבגד")
    words = words.select("doc_id", F.when(F.col("doc_id") % 2 == 0, hebrew).otherwise(F.col("w")).alias("word"))
    return words.groupBy("doc_id").agg(F.count_if(text.is_rtl(F.col("word"))).alias("rtl"), F.count_if(text.is_speech(F.col("word"))).alias("speech"), F.count("*").alias("words"))


@query(r"""select doc_id, md5(trim(E'\x1c \n' || text || E' \t\x1f', E' \t\n\r\f\x0b\x1c\x1d\x1e\x1f')) as digest from documents""")
def stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without the white space around them, separators of Unicode and of ASCII."""
    framed = F.concat(F.lit("\x1c \n"), "text", F.lit(" \t\x1f"))
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(text.strip(framed)).alias("digest"))


@query(f"select doc_id, ({layouts.SEED}::bigint + 1000003::bigint * doc_id) % 4294967296 as seed from documents")
def record_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", hashing.record_seed(layouts.SEED, F.col("doc_id")).alias("seed"))


# benchmarks


@query(
    f"""with {benchmark._ITEMS}, t as (select *, case "index" % 3 when 0 then 'mmlu' when 1 then 'hellaswag' else 'sstorycloze' end as task from qq),
    o as (select *, unnest(range(case when task = 'sstorycloze' then 2 else 4 end)) as opt from t)
    select "index", opt::int as opt, md5(case task when 'mmlu' then {benchmark._CLOZE} when 'hellaswag' then question else {benchmark._NORM.format(c='question')} end) as prompt,
      md5(case task when 'mmlu' then E'\\nAnswer: ' || options[opt + 1] when 'hellaswag' then options[opt + 1] else {benchmark._NORM.format(c='options[opt + 1]')} end) as continuation from o"""
)
def task_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt and continuations by task: questions, contexts and stories."""
    q = benchmark.items(spark, sf_dir)
    k = F.col("index") % 3
    task = F.when(k == 0, "mmlu").when(k == 1, "hellaswag").otherwise("sstorycloze")
    built = q.select("index", evaluation.task_prompt(task, F.struct("question", "options", "subject")).alias("p"))
    rows = built.select("index", F.md5("p.prompt").alias("prompt"), F.posexplode("p.continuations").alias("opt", "c"))
    return rows.select("index", "opt", "prompt", F.md5("c").alias("continuation"))


_SEED, _SHOTS = benchmark.SEED, benchmark.SHOTS


def _draw(j: int, taken: list[str]) -> str:
    """SQL of the j-th draw, moved past the entries taken before in ascending order."""
    x = f"""floor({uniform_sql(str(_SEED), '"index"', str(j), "'draw'")} * (pool - {j}))::bigint"""
    for k in range(len(taken)):
        x = f"(select x + case when x >= t[{k + 1}] then 1 else 0 end from (select {x} as x, list_sort([{', '.join(taken)}]) as t))"
    return x


@query(
    f"""with {benchmark._ITEMS}, se as (select "index", row_number() over (order by "index") - 1 as seat, count(*) over () as pool from q),
    d1 as (select *, {_draw(1, ['seat'])} as a from se), d2 as (select *, {_draw(2, ['seat', 'a'])} as b from d1), d3 as (select *, {_draw(3, ['seat', 'a', 'b'])} as c from d2),
    dr as (select "index", 1 as shot, a as seat from d1 where pool > 1 union all select "index", 2, b from d2 where pool > 2 union all select "index", 3, c from d3 where pool > 3)
    select dr."index", shot::int as shot, se."index" as other from dr join se on dr.seat = se.seat"""
)
def shot_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three different other questions for each question, drawn independently."""
    return evaluation.draw_shots(benchmark.items(spark, sf_dir), _SHOTS, _SEED).select("index", "shot", "other")


@query(
    """with x as (select vec_id, unnest(range(64)) as i, unnest(embedding)::double * 10 as x from embeddings), e as (select vec_id, x, max(x) over (partition by vec_id) as top from x), z as (select vec_id, exp(x - top) as p, sum(exp(x - top)) over (partition by vec_id) as total from e)
    select vec_id, round(-sum(p / total * ln(p / total + 1e-12)), 6) as entropy from z group by 1"""
)
def residual_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy of softmax weights, as of a mix of layers."""
    logits = F.transform("embedding", lambda x: x.cast("double") * 10)
    weights = F.transform(numeric.log_softmax(logits), lambda v: F.exp(v))
    return load(spark, sf_dir, "embeddings").select("vec_id", F.round(scoring.entropy(weights), 6).alias("entropy"))


@query(
    """select event_id, layers, books, round(((6.0 * 150000000 + 12.0 * layers * 12 * 64 * 2048 + 0.25 * 12.0 * 2 * 8 * 64 * 2048) + 6.0 * 20000000 * (books - 1) + 12.0 * 4 * 8 * 64 * books * books) * 2048 * 480 / 5.0 / 312e12, 9) as mfu
    from (select event_id, 6 + event_id % 43 as layers, 2 + event_id % 7 as books from events)"""
)
def mfu_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utilisation with a transformer over the codebooks: its parameters and its attention count for each codebook. An event is a step."""
    i = F.col("event_id")
    grid = load(spark, sf_dir, "events").select("event_id", (6 + i % 43).alias("layers"), (2 + i % 7).alias("books"))
    flat = training.utilization(F.lit(150e6), F.col("layers"), F.lit(12), F.lit(768), F.lit(2048), F.lit(480), F.lit(5.0), F.lit(12.0 * 2 * 8 * 64 * 2048))
    depth = training.depth_flops(F.lit(20e6), F.col("books"), F.lit(4), F.lit(8), F.lit(512))
    return grid.select("event_id", "layers", "books", F.round(training.utilization_with_depth(flat, depth, F.lit(2048), F.lit(480), F.lit(5.0)), 9).alias("mfu"))


# generation

_REQUESTS = """rq as (select doc_id, (n_chars % 9)::int as prompt_length, case when doc_id % 7 = 0 then -0.5 when doc_id % 11 = 0 then 'nan'::double when doc_id % 12 = 0 then 'inf'::double else 0.8 end as temperature,
      case when doc_id % 3 = 0 then null when doc_id % 10 = 0 then 0 else 5 end as top_k, (1 + (doc_id % 17 = 0)::int) as modalities, (n_chars % 700)::int as max_new, 512 as block_size from documents)"""


@query(
    f"""with {_REQUESTS} select coalesce(case when not prompt_length > 0 then 'empty prompt' when not (temperature >= 0 and not isnan(temperature) and temperature < 'inf'::double) then 'bad temperature'
      when not (top_k is null or top_k >= 1) then 'bad top_k' when modalities <> 1 then 'not one modality' when not (prompt_length + max_new <= block_size + 1) then 'too long' end, 'valid') as problem, count(*) as n from rq group by 1"""
)
def generation_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why requests are refused."""
    i, n = F.col("doc_id"), F.col("n_chars")
    heat = F.when(i % 7 == 0, -0.5).when(i % 11 == 0, float("nan")).when(i % 12 == 0, float("inf")).otherwise(0.8)
    rows = load(spark, sf_dir, "documents").select((n % 9).alias("prompt_length"), heat.alias("temperature"), F.when(i % 3 == 0, None).when(i % 10 == 0, 0).otherwise(5).alias("top_k"), (1 + (i % 17 == 0).cast("int")).alias("modalities"), (n % 700).alias("max_new"), F.lit(512).alias("block_size"))
    return rows.groupBy(F.coalesce(validation.generation_problem(), F.lit("valid")).alias("problem")).agg(F.count("*").alias("n"))


@query(
    f"""with {frames._EVENTS} select user_id, count(*) as rows, count(*) * 4 as cells, sum(code + 900 + 2 * 901)::bigint as total, greatest(count(*) - 4, 0) as generated, coalesce(sum(2 * 901) filter (pos >= 4), 0)::bigint as codes from ev group by 1"""
)
def generation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a text prompt with the other modalities padded, and the audio columns after three rows and a switch."""
    arrays = frames._arrays(spark, sf_dir).withColumn("rows", modalities.text_prompt(F.col("codes"), 900, 1, 901, 2))
    made = modalities.generated_codes(F.col("rows"), F.lit(3), 2)
    total = lambda x: F.aggregate(F.flatten(x), F.lit(0).cast("long"), lambda a, v: a + v)
    return arrays.select("user_id", F.size("rows").cast("long").alias("rows"), F.size(F.flatten("rows")).cast("long").alias("cells"), total(F.col("rows")).alias("total"), F.size(made).cast("long").alias("generated"), total(made).alias("codes"))


_RUNS_OF = f"""{frames._EVENTS}, rn as (select user_id as source, pos as place, (case when pos % 3 = 2 then 201 when code = 3 then 200 else 97 + code end)::int as token, (1 + event_id % 3)::bigint as duration from ev),
    en as (select *, sum(duration) over (partition by source order by place) as stop, (sum((token = 201)::int) over (partition by source order by place) - (token = 201)::int)::bigint as word from rn),
    wr as (select source, word, coalesce(string_agg(token::varchar, ',' order by place) filter (token not in (200, 201)), '') as tokens, count(*) filter (token not in (200, 201)) as n, min(stop - duration)::bigint as start, max(stop)::bigint as stop, max((token = 201)::int) as closed from en group by 1, 2),
    wk as (select * from wr where closed = 1 and n > 0)"""


def _spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = frames.timeline(spark, sf_dir)
    token = F.when(F.col("pos") % 3 == 2, 201).when(F.col("code") == 3, 200).otherwise(97 + F.col("code"))
    runs = t.select(F.col("user_id").alias("source"), F.col("pos").alias("place"), token.alias("token"), (1 + F.col("event_id") % 3).alias("duration"))
    return modalities.words_of_runs(runs, ["source"], 201, [200])


@query(f"""with {_RUNS_OF} select source, word, tokens, start, stop as "end" from wk""")
def run_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of runs: up to and with each end of word."""
    return _spoken(spark, sf_dir).select("source", "word", F.array_join(F.transform("tokens", lambda t: t.cast("string")), ",").alias("tokens"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query(
    f"""with {_RUNS_OF}, nr as (select *, row_number() over (partition by source order by word) - 1 as i from wk), ch as (select source, (i // 16) * 2 + (i % 16 >= 10)::int as chunk, sum(n) as tokens, max(stop) - min(start) as frames from nr group by 1, 2)
    select source, chunk::bigint as chunk, case when chunk % 2 = 0 then 'text' else 'speech' end as modality, (case when chunk % 2 = 0 then tokens else frames end + (chunk > 0)::int)::bigint as positions from ch"""
)
def spoken_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alternating chunks of ten text and six speech words."""
    return modalities.chunk_labels(_spoken(spark, sf_dir), ["source"])


@query(layouts.interleave_sql(duration="1::bigint"))
def interleave_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense form: a token for every frame, so each run lasts one frame."""
    runs = layouts.drawn(spark, sf_dir, duration=F.lit(1).cast("long"))
    return streams.sample_layout("interleaved", runs, layouts.SIZE, layouts.END_OF_WORD, layouts.PAD, layouts.SWITCH, layouts.SEED)


@query(
    f"""with {benchmark._STORY}, u as (select pair_id, list_transform(range(1, length(prompt)::bigint + 1), lambda i: unicode(substr(prompt, i::bigint, 1))) as p, list_transform(range(1, length(chosen)::bigint + 1), lambda i: unicode(substr(chosen, i::bigint, 1))) as c from st),
    k as (select pair_id, p, case when len(p) > 0 and len(c) > 0 and p[-1] = c[1] then c[2:] else c end || [7] as c from u)
    select pair_id, (len(p) + len(c))::bigint as rows, (list_sum(p || [0]) + list_sum(c))::bigint as total, len(c)::bigint as predicted from k"""
)
def unit_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt and continuation as units of one modality: the prompt loses its end, the continuation keeps it, a repeated unit at the border goes."""
    s = benchmark.stories(spark, sf_dir)
    ends = lambda c: F.concat(F.transform(modalities.ENCODERS["characters"](F.col(c)), lambda x: F.element_at(x, 1)), F.array(F.lit(7)))
    rows = evaluation.unit_variant(ends("prompt"), ends("chosen"), 99, 98)
    v = s.select("pair_id", rows.alias("r"))
    return v.select("pair_id", F.size("r").cast("long").alias("rows"), F.aggregate("r", F.lit(0).cast("long"), lambda a, x: a + x["audio"]).alias("total"), F.size(F.filter("r", lambda x: x["aud_pred"])).cast("long").alias("predicted"))


# mixture weights without probabilities


@query("select source as shard, round(sum(n_chars) / (select sum(n_chars) from documents), 9) as weight from documents group by 1")
def shard_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of all tokens, where datasets have no probabilities."""
    shards = load(spark, sf_dir, "documents").groupBy(F.col("source").alias("shard")).agg(F.sum("n_chars").alias("tokens"))
    return mixture.shard_weights(shards).select("shard", F.round("weight", 9).alias("weight"))
