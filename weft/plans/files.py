"""Files written, indexed and read again: manifests with byte offsets, packed shards by ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weft.operators.ordering import running
from weft.plans.registry import load, query
from weft.sources import indexed, manifests, shards
from weft.storage import scratch

_LINES = "ln as (select doc_id as record_index, concat_ws(chr(9), doc_id, source, lang, n_chars, md5(text)) as value from documents)"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("record_index"), F.concat_ws("\t", F.col("doc_id").cast("string"), "source", "lang", F.col("n_chars").cast("string"), F.md5("text")).alias("value"))


def _written(spark: SparkSession, sf_dir: str) -> str:
    path = f"{scratch(spark, 'lines')}/lines.tsv"
    indexed.write_lines(_lines(spark, sf_dir), path)
    return path


@query(
    f"""with {_LINES}, l as (select *, strlen(value) + 1 as size from ln)
    select row_number() over (order by record_index) - 1 as record_index, (sum(size) over (order by record_index) - size)::bigint as "offset", size::bigint as length from l"""
)
def line_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offset and length of each line, by the written index."""
    return indexed.index_table(spark, _written(spark, sf_dir))


@query(f"""with {_LINES} select row_number() over (order by record_index) - 1 as record_index, md5(value) as digest from ln""")
def indexed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A written file read back by byte ranges."""
    return indexed.read_lines(spark, _written(spark, sf_dir), 1 << 16).select("record_index", F.md5("value").alias("digest"))


@query(
    f"""with {_LINES}, nr as (select *, row_number() over (order by record_index) - 1 as i from ln)
    select i as record_index, md5(value) as digest from nr where i % 7 = 3"""
)
def rebuilt_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh line by the index that is built of the file alone."""
    path = _written(spark, sf_dir)
    n = indexed.build_index(spark, path, 1 << 14)
    wanted = spark.range(3, n, 7).select(F.col("id").alias("place"), F.col("id").alias("record_index"))
    return indexed.seek_lines(spark, path, wanted).select("record_index", F.md5("value").alias("digest"))


@query(f"""with {_LINES} select sha256(string_agg(value || chr(10), '' order by record_index)) as sha256, sum(strlen(value) + 1)::bigint as length from ln""")
def file_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest and length of a written file, read in chunks."""
    return indexed.file_digests(spark, [_written(spark, sf_dir)], 1 << 12).select("sha256", "length")


@query(f"""with {_LINES} select row_number() over (order by record_index) - 1 as line, md5(value) as digest from ln""")
def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers of a text file that Spark may split."""
    return indexed.number_lines(spark, _written(spark, sf_dir)).select("line", F.md5("value").alias("digest"))


@query(
    """select row_number() over (order by c.conv_id, c.turn) - 1 as place, d.doc_id as record_index, d.source as speaker, md5(d.text) as digest
    from conversations c join documents d on d.doc_id = (c.conv_id * 7 + c.turn) % (select count(*) from documents)"""
)
def manifest_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a written manifest in requested order, read by seeking to their bytes."""
    docs = load(spark, sf_dir, "documents")
    m = manifests.as_manifest(docs.select(F.col("doc_id").alias("record_index"), F.concat(F.lit("documents:"), F.col("doc_id").cast("string")).alias("id"), F.lit("documents").alias("dataset"), F.lit("train").alias("split"), F.col("text").alias("transcript"), F.col("source").alias("speaker")))
    path = f"{scratch(spark, 'manifest')}/manifest.jsonl"
    manifests.write_manifest(m, path)
    total = docs.count()
    asked = running(load(spark, sf_dir, "conversations").select("conv_id", "turn"), ["conv_id", "turn"])
    wanted = asked.select(F.col("number").alias("place"), ((F.col("conv_id") * 7 + F.col("turn")) % total).alias("record_index"))
    return manifests.seek_rows(spark, path, wanted).select("place", "record_index", "speaker", F.md5("transcript").alias("digest"))


_CODES = """ev as (select user_id, row_number() over (partition by user_id order by ts, event_id) - 1 as pos, (floor(abs(value))::bigint % 500)::int as code from events),
    us as (select user_id, (user_id % 8)::int as shard, count(*) as steps, md5(string_agg(code::varchar, ',' order by pos)) as digest from ev group by 1)"""


def _shards(spark: SparkSession, sf_dir: str) -> str:
    """Each user's codes as a sample of one of eight shards."""
    at = F.struct("ts", "event_id", (F.floor(F.abs("value")) % 500).cast("int").alias("code"))
    users = load(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(at)).alias("x"))
    root = scratch(spark, "shards")
    samples = users.select(F.format_string("shard-%05d", F.col("user_id") % 8).alias("shard"), F.col("user_id").cast("long").alias("place"), F.col("user_id").cast("string").alias("id"), F.transform("x", lambda x: F.array(x["code"])).alias("codes"), F.lit("{}").alias("metadata"))
    shards.write_shards(samples, root)
    return root


@query(f"""with {_CODES} select shard, row_number() over (partition by shard order by user_id) - 1 as place, user_id::varchar as id, steps, digest from us""")
def shard_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed shards read back by ranges of samples."""
    rows = shards.read_samples(spark, _shards(spark, sf_dir), ("id", "codes"), 1 << 10)
    return rows.select(F.substring("shard", -5, 5).cast("int").alias("shard"), F.col("place").cast("long").alias("place"), "id", F.size("codes").cast("long").alias("steps"), F.md5(F.array_join(F.flatten("codes").cast("array<string>"), ",")).alias("digest"))


@query(f"""with {_CODES}, n as (select *, row_number() over (partition by shard order by user_id) - 1 as place from us) select shard, steps, digest from n where place = 1""")
def shard_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second sample of every shard: the place reaches the files, ids stay closed."""
    rows = shards.read_samples(spark, _shards(spark, sf_dir), ("codes",)).where("place = 1")
    return rows.select(F.substring("shard", -5, 5).cast("int").alias("shard"), F.size("codes").cast("long").alias("steps"), F.md5(F.array_join(F.flatten("codes").cast("array<string>"), ",")).alias("digest"))
