"""The queries of the training-data operators, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from weft.llm import audit, bpe, chat, lm, media, mixing, packing, quality_rules, ranking, resampling, sharding, simhash, url_filters
from weft.llm.common import documents, table

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(documents(spark, sf_dir))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path())


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


#: The conversation that the chat query adds: its texts look like the template's control strings.
TRICKY = "\\### Assistant: </turn> ok"


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    more = spark.createDataFrame([Row(conv_id=-7, turn=0, role="user", text=TRICKY), Row(conv_id=-7, turn=1, role="assistant", text=TRICKY)], rows.schema)
    chosen = chat.paths(chat.conversation_nodes(rows.unionByName(more)))
    out = chat.digests(chat.format_paths(chosen))
    return out.select(F.when(F.col("tree") != "null", F.col("tree")).cast("long").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.language_scores(documents(spark, sf_dir))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shards(documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ranking.quality_scores(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % ranking.FOLDS == ranking.HELD_FOLD, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op11_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op12_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_filters, op2_media_columns, op3_quality_rules, op4_best_fit_packing, op5_mixing, op6_chat_formatting, op7_lm_scoring, op8_sharding, op9_quality_classifier, op10_simhash_near_dedup, op11_filter_interaction_audit, op12_bpe_encoding, op13_importance_resampling)}


def _op1_sql() -> str:
    hosts = ", ".join(f"({len(r.text)}, '{r.text}', '{r.action}', '{r.text.partition('/')[0]}', '/{r.text.partition('/')[2]}')" for r in url_filters.RULES if r.host_rule)
    any_of = lambda action: " or ".join(f"regexp_matches(lower(coalesce(url, '')), '{r.regex}')" for r in url_filters.RULES if not r.host_rule and r.action == action)
    return f"""
with rules(len, rule, action, host, path) as (values {hosts}),
parts as (
  select page_id, url, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
urls as (
  select page_id, url, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path from parts)
select page_id, host, path, r.rule as rule,
       coalesce(r.action, case when ({any_of('block')}) and not ({any_of('allow')}) then 'block' else 'allow' end) as verdict
from urls u left join lateral (
  select rule, action from rules r
  where (u.host = r.host or ends_with(u.host, '.' || r.host)) and starts_with(u.path, r.path) order by len desc limit 1) r on true
"""


_OP11 = """
with texts as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, doc_id > min(doc_id) over (partition by coalesce(text, '')) as copy from documents),
words as (select *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as w from texts),
failed as (
  select doc_id, part, (case when len(w) < 50 then 1 else 0 end) + (case when 100 * len(list_distinct(w)) < 65 * len(w) then 2 else 0 end)
    + (case when 100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t) then 4 else 0 end) + (case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end) + (case when copy then 16 else 0 end) as mask
  from words),
told as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by 1),
hist as (select part, mask, count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic from failed left join told using (doc_id) group by 1, 2),
letter as (select unnest(range(5)) as bit, unnest(string_split('ABCDE', '')) as l),
orders as (
  select a.l || b.l || c.l || d.l || e.l as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
  from letter a, letter b, letter c, letter d, letter e where len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps as (
  select filter_order, step, 1 << bits[step] as own, list_sum(list_transform(bits[:step], lambda x: 1 << x))::bigint - (1 << bits[step]) as earlier
  from orders, (select unnest(range(1, 6)) as step)),
counted as (
  select part, filter_order, step::int as step, own,
    sum(case when mask & (own | earlier) = 0 then n else 0 end)::bigint as kept,
    sum(case when mask & own > 0 and mask & earlier = 0 then n else 0 end)::bigint as removed,
    sum(case when mask & own > 0 and mask & earlier > 0 then n else 0 end)::bigint as redundant,
    sum(case when mask = own then n else 0 end)::bigint as unique_fails,
    sum(case when mask & own > 0 and mask & earlier = 0 then good else 0 end)::bigint as good_lost,
    sum(case when mask & own > 0 and mask & earlier = 0 then toxic else 0 end)::bigint as toxic_lost
  from hist, steps group by all)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) over (partition by part, own)::bigint as shapley from counted
"""


_OP13 = """
with crc as (
  select list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
texts as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w, true as ours
  from documents
  union all
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), false
  from benchmark),
occurrences as (select doc_id, ours, word, count(*) as n from (select doc_id, ours, unnest(w) as word from texts) group by all),
bytes as (select word, list_transform(range(1, length(hex(word)) + 1, 2), lambda i: ('0x' || substr(hex(word), i, 2))::bigint) as b from (select distinct word from occurrences)),
hashed as (
  select word, xor(list_reduce(list_prepend(4294967295::bigint, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 as bucket
  from bytes, crc),
counts as (select bucket, sum(case when ours then n else 0 end) as s, sum(case when ours then 0 else n end) as t from occurrences join hashed using (word) group by 1),
totals as (select coalesce(sum(s), 0) as ss, coalesce(sum(t), 0) as tt from counts),
gains as (
  select bucket, floor(1000 * ln(((t + 1)::double * (ss + 10000)::double) / ((s + 1)::double * (tt + 10000)::double)))::bigint as gain from counts, totals),
weights as (select doc_id, sum(n * gain)::bigint as weight from occurrences join hashed using (word) join gains using (bucket) where ours group by 1),
scored as (
  select doc_id, len(w)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id::varchar), 1, 8))::bigint::double + 0.5) / 4294967296))))::bigint as score
  from texts left join weights using (doc_id) where ours),
ranked as (select doc_id, row_number() over (order by score desc, doc_id) as rank from scored where n_features >= 20)
select doc_id, n_features, weight, score, rank
from scored left join (select * from ranked where rank <= (select 10 * count(*) // 100 from ranked)) using (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filters": _op1_sql(), "op11_filter_interaction_audit": _OP11, "op13_importance_resampling": _OP13}
