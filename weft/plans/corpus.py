"""Manifests, plans, tokens and text shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from weft.functions import hashing, text
from weft.functions.hashing import uniform_sql
from weft.operators import digests, planning, sequences, validation
from weft.operators.ordering import running
from weft.plans.registry import load, query
from weft.sources import manifests

SHARDS = 8
TOKEN, PIECE = text.TOKEN.replace("'", "''"), text.PIECE.replace("'", "''")
VOCABULARY = 5000


@query(
    """select doc_id as record_index, 'documents:train:' || substr(sha1(concat_ws(':', source, '0', doc_id::varchar)), 1, 16) as id,
    source as speaker, round(n_chars * (1.0::double / 15), 6) as duration, length(text)::bigint as chars from documents"""
)
def manifest_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = manifests.from_documents(load(spark, sf_dir, "documents"))
    return m.select("record_index", "id", "speaker", "duration", F.length("transcript").cast("long").alias("chars"))


@query(
    """with m as (select case when doc_id % 19 = 0 then '' else 'x' end as id, case when doc_id % 23 = 0 then -1.0 else 0.0 end as off,
      case when doc_id % 17 = 0 then 0.0 when doc_id % 5 = 0 then null else n_chars / 15.0 end as dur, case when doc_id % 13 = 0 then 0 else 16000 end as rate from documents)
    select coalesce(case when id = '' then 'empty id' when off < 0 then 'negative offset' when dur <= 0 then 'bad duration' when rate <= 0 then 'bad sample rate' end, 'valid') as reason,
      count(*) as n from m group by 1"""
)
def manifest_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = manifests.from_documents(load(spark, sf_dir, "documents"))
    i = F.col("record_index")
    faulty = m.withColumns({
        "id": F.when(i % 19 == 0, "").otherwise(F.col("id")), "offset": F.when(i % 23 == 0, -1.0).otherwise(F.col("offset")),
        "duration": F.when(i % 17 == 0, 0.0).when(i % 5 == 0, None).otherwise(F.col("duration")), "sample_rate": F.when(i % 13 == 0, 0).otherwise(16000),
    })
    return faulty.groupBy(F.coalesce(validation.manifest_reason(), F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


@query(
    r"""select sha1(lower(trim(regexp_replace(text, '[\s]+', ' ', 'g')))) as digest, count(*) as n, min(doc_id) as first_id from documents group by 1 having count(*) > 1"""
)
def manifest_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    digest = F.sha1(F.lower(F.trim(F.regexp_replace("text", r"[\s]+", " "))))
    return docs.groupBy(digest.alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


_TOTAL = "(select count(*) from documents)"
_SHARD = f"(((doc_id + 1) * {SHARDS} - 1) // {_TOTAL})"


def _sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    total = docs.agg(F.count("*").alias("total"))  # one row
    return docs.join(F.broadcast(total)).withColumn("shard", planning.range_shard(F.col("doc_id"), F.col("total"), SHARDS))


@query(
    f"""with k as (select unnest(range({SHARDS})) as shard, {_TOTAL} as total)
    select shard::int as shard, total * shard // {SHARDS} as low, total * (shard + 1) // {SHARDS} as high,
      (select count(*) from documents where doc_id >= total * shard // {SHARDS} and doc_id < total * (shard + 1) // {SHARDS}) as documents from k"""
)
def shard_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _sharded(spark, sf_dir).groupBy("shard", "total").agg(F.count("*").alias("documents"))
    low, high = planning.range_bounds(F.col("total"), F.col("shard"), SHARDS)
    return held.select("shard", low.alias("low"), high.alias("high"), "documents")


_PLAN = f"""with recursive sorted as (
      select doc_id, row_number() over (order by n_chars desc, id) as i, n_chars::double as load from
        (select doc_id, n_chars, 'documents:train:' || substr(sha1(concat_ws(':', source, '0', doc_id::varchar)), 1, 16) as id from documents)),
    steps(i, shard, loads) as (
      select 0::bigint, -1::bigint, list_transform(range({SHARDS}), lambda x: 0.0::double)
      union all
      select s.i, list_position(p.loads, list_min(p.loads)) - 1,
        list_transform(p.loads, lambda x, k: case when k = list_position(p.loads, list_min(p.loads)) then x + s.load else x end)
      from steps p join sorted s on s.i = p.i + 1),
    plan as (select steps.shard::int as shard_index, sorted.doc_id as record_index, sorted.load from steps join sorted using (i) where steps.i > 0)"""


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = manifests.from_documents(load(spark, sf_dir, "documents"), seconds_per_char=1.0)
    return planning.balanced_plan(m.select("record_index", "id", planning.weight(F.col("duration"), F.col("transcript")).alias("load")), SHARDS)


@query(f"{_PLAN} select shard_index, record_index, load from plan")
def shard_plan_lpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir)


@query(
    f"""{_PLAN} select shard_index, count(*) as records, sum(load) as load,
    sha256('[' || string_agg(record_index::varchar, ',' order by record_index) || ']') as digest from plan group by 1"""
)
def plan_load_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.plan_loads(_plan(spark, sf_dir))


GROUPS = 4
_EACH = SHARDS // GROUPS


@query(
    f"""with recursive ids as (select doc_id, n_chars, 'documents:train:' || substr(sha1(concat_ws(':', source, '0', doc_id::varchar)), 1, 16) as id from documents),
    parts as (select *, floor({uniform_sql('id', "'plan'")} * {GROUPS})::int as part from ids),
    sorted as (select doc_id, part, n_chars::double as load, row_number() over (partition by part order by n_chars desc, id) as i from parts),
    steps(part, i, shard, loads) as (
      select part, 0::bigint, -1::bigint, list_transform(range({_EACH}), lambda x: 0.0::double) from (select distinct part from sorted)
      union all
      select p.part, s.i, list_position(p.loads, list_min(p.loads)) - 1,
        list_transform(p.loads, lambda x, k: case when k = list_position(p.loads, list_min(p.loads)) then x + s.load else x end)
      from steps p join sorted s on s.part = p.part and s.i = p.i + 1)
    select (steps.part * {_EACH} + shard)::int as shard_index, doc_id as record_index, load from steps join sorted using (part, i)"""
)
def shard_plan_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan of a large manifest: longest first within each of four parts, side by side."""
    m = manifests.from_documents(load(spark, sf_dir, "documents"), seconds_per_char=1.0)
    return planning.plan_groups(m.select("record_index", "id", planning.weight(F.col("duration"), F.col("transcript")).alias("load")), SHARDS, GROUPS)


@query(f"select doc_id, len(regexp_extract_all(text, '{TOKEN}'))::bigint as tokens from documents")
def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", text.token_count(F.col("text")).alias("tokens"))


@query(
    f"""with t as (select token, count(*) as n from (select unnest(regexp_extract_all(text, '{TOKEN}')) as token from documents) group by 1 order by n desc, token limit {VOCABULARY})
    select token, n, (row_number() over (order by n desc, token) + 1)::int as id from t"""
)
def vocab_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent tokens; ids 0 and 1 are the unknown token and the end."""
    docs = load(spark, sf_dir, "documents")
    counts = docs.select(F.explode(text.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "token").limit(VOCABULARY)
    return top.select("token", "n", (F.row_number().over(Window.orderBy(F.desc("n"), "token")) + 1).alias("id"))


_PIECES = f"""vc as (select token, (row_number() over (order by n desc, token) + 256)::int as id from
      (select token, count(*) as n from (select unnest(regexp_extract_all(text, '{TOKEN}')) as token from documents) group by 1 order by n desc, token limit {VOCABULARY})),
    pc as (select doc_id, unnest(regexp_extract_all(text, '{PIECE}')) as token, generate_subscripts(regexp_extract_all(text, '{PIECE}'), 1) as i from documents),
    bt as (select token, list_transform(range(1, length(hex(token)) + 1, 2), lambda i: ('0x' || substr(hex(token), i, 2))::int) as b from (select distinct token from pc)),
    sp as (select token, case when id is null then array_to_string(b, ',') else id::varchar end as ids, case when id is null then len(b) else 1 end as n from bt left join vc using (token))"""


@query(
    f"""with {_PIECES}, ds as (select doc_id, sum(n)::bigint + 1 as n, md5(string_agg(ids, ',' order by i) || ',256') as digest from pc join sp using (token) group by 1)
    select doc_id, coalesce(n, 1) as n, coalesce(digest, md5('256')) as digest, true as equal from documents left join ds using (doc_id)"""
)
def lossless_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of whole texts without an unknown one: frequent tokens by the vocabulary, everything else byte by byte; they decode to
    the texts."""
    vocabulary = vocab_build(spark, sf_dir).select("token", (F.col("id") + 255).alias("id"))
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    ids = text.piece_ids(docs, "text", vocabulary)
    back = text.text_of_ids(ids, "ids", vocabulary, "back")
    return back.select("doc_id", F.size("ids").cast("long").alias("n"), F.md5(F.array_join("ids", ",")).alias("digest"), (F.col("back") == F.coalesce("text", F.lit(""))).alias("equal"))


_LENGTHS = f"select doc_id, {_SHARD}::int as shard, len(regexp_extract_all(text, '{TOKEN}'))::bigint + 1 as n from documents"


def _lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and the end token of each document; fewer than two are skipped."""
    return _sharded(spark, sf_dir).select("doc_id", "shard", (text.token_count(F.col("text")) + 1).alias("n"))


@query(
    f"""select shard, count(*) filter (n >= 2) as num_samples, coalesce(sum(n) filter (n >= 2), 0)::bigint as num_tokens, count(*) filter (n < 2) as num_skipped from ({_LENGTHS}) group by 1"""
)
def text_shard_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.col("n") >= 2
    return _lengths(spark, sf_dir).groupBy("shard").agg(F.count_if(kept).alias("num_samples"), F.coalesce(F.sum(F.when(kept, F.col("n"))), F.lit(0)).alias("num_tokens"), F.count_if(~kept).alias("num_skipped"))


@query(
    f"""select shard, doc_id, n as length, (coalesce(sum(n) over (partition by shard order by doc_id rows between unbounded preceding and 1 preceding), 0))::bigint as "offset" from ({_LENGTHS}) where n >= 2"""
)
def text_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = _lengths(spark, sf_dir).where("n >= 2").select("shard", "doc_id", F.col("n").alias("length"))
    return sequences.offsets(lengths, ["shard"], "doc_id", "length")


@query(
    """select doc_id, source || ' / ' || lang || '.wav' as name, regexp_replace(source || ' / ' || lang || '.wav', '[^A-Za-z0-9_.-]+', '_', 'g') || '-' || substr(sha1(source || ' / ' || lang || '.wav'), 1, 10) || '.flac' as file from documents"""
)
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("source", F.lit(" / "), "lang", F.lit(".wav"))
    return load(spark, sf_dir, "documents").select("doc_id", name.alias("name"), hashing.safe_name(name).alias("file"))


@query(
    r"""select doc_id, len(w)::bigint as words, md5(array_to_string(w, ' ')) as digest from
    (select doc_id, list_filter(string_split(regexp_replace(replace(lower(text), '’', ''''), '[^a-z'' ]+', ' ', 'g'), ' '), lambda x: x <> '') as w from documents)"""
)
def alignment_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = text.alignment_words(F.col("text"))
    return load(spark, sf_dir, "documents").select("doc_id", F.size(words).cast("long").alias("words"), F.md5(F.array_join(words, " ")).alias("digest"))


@query(
    r"""with w as (select doc_id, unnest(list_distinct(regexp_extract_all(text, '[\p{L}]+'))) as word from documents),
    b as (select doc_id, word, list_transform(range(1, length(word)::bigint + 1, 2), lambda i: substr(word, i::bigint, 2)) as parts from w)
    select doc_id, sum(len(parts))::bigint as patches, md5(string_agg(array_to_string(parts, '|'), ',' order by word)) as digest from b group by 1"""
)
def word_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two characters a patch; the corpus has left-to-right scripts only."""
    docs = load(spark, sf_dir, "documents")
    words = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[\p{L}]+"), F.lit(0)))).alias("word"))
    parts = words.withColumn("parts", text.bigrams(F.col("word")))
    joined = F.transform(F.array_sort(F.collect_list(F.struct("word", F.array_join("parts", "|").alias("s")))), lambda x: x["s"])
    return parts.groupBy("doc_id").agg(F.sum(F.size("parts")).alias("patches"), F.md5(F.array_join(joined, ",")).alias("digest"))


@query(
    """select source, lang || '/' || source || '-' || lang as tokenizer, lang || '/' || source as base, count(*) as n from documents group by all"""
)
def tokenizer_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    name = F.concat("lang", F.lit("/"), "source", F.lit("-"), "lang")
    return docs.groupBy("source", name.alias("tokenizer")).agg(F.count("*").alias("n")).select("source", "tokenizer", text.tokenizer_base(F.col("tokenizer")).alias("base"), "n")


@query(
    f"""with f as (select {_SHARD}::int as shard, 'documents/' || doc_id::varchar as path, length(text) as size, sha256(text) as digest from documents)
    select shard, count(*) as files, sha256(string_agg(path || ':' || size::varchar || ':' || digest, ';' order by path)) as fingerprint from f group by 1"""
)
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of sorted (path, size, digest), one a shard."""
    path = F.concat(F.lit("documents/"), F.col("doc_id").cast("string"))
    line = F.concat_ws(":", path, F.length("text").cast("string"), F.sha2("text", 256))
    told = digests.ordered_digest(_sharded(spark, sf_dir).select("shard", path.alias("path"), line.alias("line")), ["shard"], ["path"], F.col("line"), ";")
    return told.select("shard", F.col("rows").alias("files"), F.col("digest").alias("fingerprint"))


@query(
    """with recursive i as (select source, doc_id, n_chars, row_number() over (partition by source order by doc_id) as r from documents),
    s as (select source, doc_id, r, n_chars, 0 as bin, n_chars as used from i where r = 1
      union all
      select i.source, i.doc_id, i.r, i.n_chars, case when s.used > 0 and s.used + i.n_chars > 50000 then s.bin + 1 else s.bin end,
        case when s.used > 0 and s.used + i.n_chars > 50000 then i.n_chars else s.used + i.n_chars end
      from s join i on i.source = s.source and i.r = s.r + 1)
    select source, bin::int as bin, count(*) as items, sum(n_chars)::bigint as size from s group by 1, 2"""
)
def bounded_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size-bounded bins of each source's documents in id order."""
    items = load(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("place"), F.col("n_chars").alias("size"))
    packed = planning.bounded_fill(items, 50_000, ["source"])
    return packed.groupBy("source", "bin").agg(F.count("*").alias("items"), F.sum("size").alias("size"))


@query(
    """select row_number() over (order by c.conv_id, c.turn) - 1 as place, d.doc_id as record_index, d.source as speaker from conversations c join documents d on d.doc_id = (c.conv_id * 7 + c.turn) % (select count(*) from documents)"""
)
def read_requested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random access in requested order: a join on the record index, then the request's order."""
    m = manifests.from_documents(load(spark, sf_dir, "documents"))
    total = m.agg(F.count("*").alias("total"))  # one row
    asked = running(load(spark, sf_dir, "conversations").select("conv_id", "turn"), ["conv_id", "turn"]).join(F.broadcast(total))
    wanted = asked.select(F.col("number").alias("place"), ((F.col("conv_id") * 7 + F.col("turn")) % F.col("total")).alias("record_index"))
    return manifests.read_rows(m, wanted).select("place", "record_index", "speaker")


@query(
    """with m as (select 'src' || (doc_id % 20)::varchar as source, lang, case when doc_id % 3 = 0 then 'v1' when doc_id % 3 = 1 then 'v2' end as revision from documents),
    t as (select source, count(distinct lang) as langs, count(distinct revision) as revisions, min(revision) as revision, count(*) filter (revision is null) as filled from m group by 1)
    select source, langs, revisions, revision, filled, langs = 1 and revisions <= 1 as consistent from t"""
)
def metadata_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams of one source must agree where both say something; missing values are filled from the others."""
    docs = load(spark, sf_dir, "documents")
    m = docs.select(F.concat(F.lit("src"), (F.col("doc_id") % 20).cast("string")).alias("source"), "lang", F.when(F.col("doc_id") % 3 == 0, "v1").when(F.col("doc_id") % 3 == 1, "v2").alias("revision"))
    t = m.groupBy("source").agg(F.countDistinct("lang").alias("langs"), F.countDistinct("revision").alias("revisions"), F.min("revision").alias("revision"), F.count_if(F.col("revision").isNull()).alias("filled"))
    return t.withColumn("consistent", (F.col("langs") == 1) & (F.col("revisions") <= 1))


@query(
    """with a as (select source, max(case when lang = 'en' then n_chars end) as en, max(case when lang = 'fr' then n_chars end) as fr, max(case when lang = 'de' then n_chars end) as de from documents group by 1),
    b as (select source, max(case when lang = 'en' then n_chars end) as en, max(case when lang = 'fr' then n_chars + doc_id % 2 end) as fr, min(case when lang = 'de' then n_chars end) as de from documents group by 1)
    select a.source, array_to_string(list_filter([case when a.de is distinct from b.de then 'de' end, case when a.en is distinct from b.en then 'en' end, case when a.fr is distinct from b.fr then 'fr' end], lambda x: x is not null), ',') as differing from a join b using (source)"""
)
def settings_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields whose values differ between two records (resume and validation checks), nulls equal."""
    docs = load(spark, sf_dir, "documents")
    pick = lambda f, lang, x: f(F.when(F.col("lang") == lang, x))
    n = F.col("n_chars")
    both = docs.groupBy("source").agg(F.create_map(F.lit("en"), pick(F.max, "en", n), F.lit("fr"), pick(F.max, "fr", n), F.lit("de"), pick(F.max, "de", n)).alias("a"), F.create_map(F.lit("en"), pick(F.max, "en", n), F.lit("fr"), pick(F.max, "fr", n + F.col("doc_id") % 2), F.lit("de"), pick(F.min, "de", n)).alias("b"))
    return both.select("source", F.array_join(validation.metadata_differences(F.col("a"), F.col("b")), ",").alias("differing"))
