"""Manifest adapters (SRC1-SRC5, SRC9, SNK1) and joins of transcripts (J1-J3).

A manifest has one row an utterance: MANIFEST columns plus record_index, since order is part of the data.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from weft.functions.hashing import stable_id
from weft.functions.text import padded_id, strip
from weft.operators.digests import ordered_digest
from weft.operators.ordering import running
from weft.sources import indexed

MANIFEST = "record_index long, id string, dataset string, split string, audio string, sample_rate int, duration double, offset double, transcript string, speaker string, source_revision string, words array<struct<text:string,start:double,end:double>>, extra map<string,string>"
COLUMNS = [c.split()[0] for c in "record_index, id, dataset, split, audio, sample_rate, duration, offset, transcript, speaker, source_revision, words, extra".split(", ")]
DIGEST_ROWS = 10_000
#: A record's own keys; all others go to extra.
KNOWN_KEYS = ("id", "dataset", "split", "audio", "audio_path", "path", "sample_rate", "duration", "offset", "transcript", "text", "speaker", "source_revision", "words")
_WORDS = "array<struct<text:string,start:double,end:double>>"


def as_manifest(df: DataFrame) -> DataFrame:
    """All manifest columns, missing ones null (offset 0, extra empty)."""
    kinds = dict(x.strip().split(" ", 1) for x in "record_index long; id string; dataset string; split string; audio string; sample_rate int; duration double; offset double; transcript string; speaker string; source_revision string; extra map<string,string>".split(";"))
    kinds["words"] = _WORDS
    default = {"offset": F.lit(0.0), "extra": F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))}
    return df.select(*((F.col(c) if c in df.columns else default.get(c, F.lit(None))).cast(kinds[c]).alias(c) for c in COLUMNS))


def require(df: DataFrame, ok: Column, message: Column | str) -> DataFrame:
    """df, raising an error when a row fails; the check is part of the plan."""
    message = F.lit(message) if isinstance(message, str) else message
    return df.where(F.when(ok, True).otherwise(F.raise_error(message).cast("boolean")))


def librispeech(spark: SparkSession, root: str, dataset: str, split: str, revision: str | None = None) -> DataFrame:
    """Transcripts (*.trans.txt) joined with flac and wav files by utterance; order by utterance."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.trans.txt").text(root).where(F.trim("value") != "")
    parts = F.split("value", r"\s+", 2)
    said = lines.select(parts[0].alias("utt"), strip(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).alias("transcript"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{flac,wav}").load(root).select("path")
    sound = files.select(F.regexp_extract("path", r"([^/]+)\.(?:flac|wav)$", 1).alias("utt"), F.col("path").alias("audio"))
    said = unique(said, "utt", "duplicate utterance")
    sound = unique(sound, "utt", "duplicate audio")
    joined = require(said.join(sound, "utt", "left"), F.col("audio").isNotNull(), F.concat(F.lit("missing audio for "), F.col("utt")))
    ranked = running(joined, ["utt"]).withColumnRenamed("number", "record_index")
    return as_manifest(ranked.select("*", F.concat_ws(":", F.lit(dataset), F.lit(split), "utt").alias("id"), F.lit(dataset).alias("dataset"), F.lit(split).alias("split"), F.substring_index("utt", "-", 1).alias("speaker"), F.lit(revision).alias("source_revision")))


def unique(df: DataFrame, key: str, message: str) -> DataFrame:
    """df, raising an error where the key repeats (AGG4)."""
    counted = df.withColumn("__n", F.count("*").over(Window.partitionBy(key)))
    return require(counted, F.col("__n") == 1, F.concat(F.lit(f"{message} "), F.col(key))).drop("__n")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of a text file in file order; the file may be split."""
    return indexed.number_lines(spark, path)


def fairseq_tsv(spark: SparkSession, path: str, dataset: str, split: str, sample_rate: int, transcripts: str | None = None, revision: str | None = None) -> DataFrame:
    """A fairseq file: line 0 is the root (relative to the manifest's folder), the others as in fairseq_records."""
    lines = text_lines(spark, path)
    root = lines.where("line = 0").select(F.trim("value").alias("root"))
    parent = path.rsplit("/", 1)[0] if "/" in path else "."
    folder = F.when(F.col("root").startswith("/"), F.col("root")).otherwise(F.concat(F.lit(parent + "/"), F.col("root")))
    rows = lines.where("line > 0 and trim(value) <> ''").join(F.broadcast(root))  # one row
    said = text_lines(spark, transcripts).select(F.col("line").alias("record_index"), F.trim("value").alias("transcript")) if transcripts else None
    return fairseq_records(rows, folder, dataset, split, sample_rate, said, revision)


def fairseq_records(lines: DataFrame, folder: Column, dataset: str, split: str, sample_rate: int, transcripts: DataFrame | None = None, revision: str | None = None) -> DataFrame:
    r"""lines: line (from 1) and value `name\tframes`, cut at the last tab. The id is a digest of name:frames, as written.

    transcripts: record_index and transcript, as many as there are lines."""
    at = lambda k: F.regexp_extract("value", r"(?s)^(.*)\t([^\t]*)$", k)
    rows = lines.select((F.col("line") - 1).alias("record_index"), at(1).alias("name"), at(2).alias("written"), folder.alias("folder"))
    rows = rows.withColumn("frames", F.expr("try_cast(trim(written) as bigint)"))
    rows = require(rows, F.coalesce(F.col("frames") > 0, F.lit(False)), F.concat(F.lit("bad frame count for "), F.col("name")))
    rows = rows.withColumn("audio", F.concat("folder", F.lit("/"), "name")).withColumn("duration", F.col("frames") / float(sample_rate))
    if transcripts is not None:
        both = rows.join(transcripts, "record_index", "full")
        rows = require(both, F.col("name").isNotNull() & F.col("transcript").isNotNull(), "transcripts and manifest have different counts")
    ident = stable_id(F.lit(dataset), F.lit(split), F.concat_ws(":", "name", "written"))
    return as_manifest(rows.select("*", ident.alias("id"), F.lit(dataset).alias("dataset"), F.lit(split).alias("split"), F.lit(sample_rate).alias("sample_rate"), F.lit(revision).alias("source_revision")))


def from_json(lines: DataFrame, dataset: str | None, split: str | None, revision: str | None = None) -> DataFrame:
    """JSON lines (line, value) as a manifest: the first truthy of audio, audio_path and path; the transcript, or
    the text only where that key is absent; unknown keys go to extra; an id, or a stable one of audio:offset:index.

    In that key the offset stands as the record writes it (0 where it has none, None where it is null) and a missing
    audio as the last of the three keys' value or None. Dataset and split are the arguments or else the record's own;
    a record without either is an error."""
    m = F.from_json("value", "map<string,string>")
    rows = lines.where("trim(value) <> ''").select(F.col("line").alias("record_index"), m.alias("m"))
    truthy = lambda k: F.nullif(F.element_at("m", k), F.lit(""))
    audio = F.coalesce(truthy("audio"), truthy("audio_path"), truthy("path"))
    offset = F.coalesce(F.element_at("m", "offset").cast("double"), F.lit(0.0))
    transcript = F.when(F.map_contains_key("m", "transcript"), F.element_at("m", "transcript")).otherwise(F.element_at("m", "text"))
    extra = F.map_filter("m", lambda k, _: ~k.isin(*KNOWN_KEYS))
    own = lambda given, k: F.lit(given) if given else F.nullif(F.element_at("m", k), F.lit(""))
    rows = rows.select("record_index", "m", audio.alias("audio"), offset.alias("offset"), transcript.alias("transcript"), extra.alias("extra"), own(dataset, "dataset").alias("dataset"), own(split, "split").alias("split"))
    rows = require(rows, F.col("dataset").isNotNull() & F.col("split").isNotNull(), "a record needs a dataset and a split")
    written = F.when(F.map_contains_key("m", "offset"), F.coalesce(F.element_at("m", "offset"), F.lit("None"))).otherwise("0")
    key = F.concat_ws(":", F.coalesce("audio", F.element_at("m", "path"), F.lit("None")), written, F.col("record_index").cast("string"))
    ident = F.coalesce(F.nullif(F.element_at("m", "id"), F.lit("")), stable_id(F.col("dataset"), F.col("split"), key))
    words = F.from_json(F.element_at("m", "words"), _WORDS)
    return as_manifest(rows.select("record_index", ident.alias("id"), "dataset", "split", "audio", "offset", "transcript", "extra", F.element_at("m", "sample_rate").cast("int").alias("sample_rate"), F.element_at("m", "duration").cast("double").alias("duration"), F.element_at("m", "speaker").alias("speaker"), F.coalesce(F.lit(revision), F.element_at("m", "source_revision")).alias("source_revision"), words.alias("words")))


def tinystories(rows: DataFrame, split: str, limit: int | None = None, dataset: str = "tinystories") -> DataFrame:
    """rows: source_index and text. The first `limit` rows by index."""
    rows = rows.where(F.col("source_index") < limit) if limit is not None else rows
    extra = F.create_map(F.lit("source_dataset"), F.lit(dataset), F.lit("source_index"), F.col("source_index").cast("string"))
    return as_manifest(rows.select(F.col("source_index").alias("record_index"), padded_id(f"tinystories:{split}:", F.col("source_index")).alias("id"), F.lit(dataset).alias("dataset"), F.lit(split).alias("split"), strip(F.col("text")).alias("transcript"), extra.alias("extra")))


def from_documents(docs: DataFrame, dataset: str = "documents", split: str = "train", seconds_per_char: float = 1 / 15) -> DataFrame:
    """A corpus table as a manifest: sources are speakers, lengths stand for durations."""
    key = F.concat_ws(":", F.coalesce("source", F.lit("")), F.lit("0"), F.col("doc_id").cast("string"))
    return as_manifest(docs.select(F.col("doc_id").alias("record_index"), stable_id(F.lit(dataset), F.lit(split), key).alias("id"), F.lit(dataset).alias("dataset"), F.lit(split).alias("split"), F.round(F.col("n_chars") * seconds_per_char, 6).alias("duration"), F.col("text").alias("transcript"), F.col("source").alias("speaker")))


def read_rows(manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """Records in requested order: wanted has (place, record_index). An index that is not there raises an error."""
    found = wanted.join(manifest, "record_index", "left")
    return require(found, F.col("id").isNotNull(), F.concat(F.lit("record index out of range: "), F.col("record_index").cast("string"))).orderBy("place")


def to_json_lines(manifest: DataFrame) -> DataFrame:
    """One line a record with sorted keys, nulls kept; for `text` sinks, in record order."""
    keys = sorted(set(COLUMNS) - {"record_index"})
    return manifest.select("record_index", F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("value"))


def write_manifest(manifest: DataFrame, path: str) -> None:
    """Validate, refuse repeated ids and write JSON lines in record order: a file with its index where tasks can open the folder,
    else a folder of parts in order."""
    from weft.operators.validation import manifest_reason

    checked = require(unique(manifest, "id", "duplicate id"), manifest_reason().isNull(), F.concat(F.lit("invalid record "), F.col("id")))
    lines = to_json_lines(checked)
    if indexed.mounted(path) is not None:
        return indexed.write_lines(lines, path)
    lines.repartitionByRange("record_index").sortWithinPartitions("record_index").select("value").write.mode("errorifexists").text(path)


def seek_rows(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Records of a written manifest in requested order, read by their offsets: wanted has (place, record_index)."""
    found = indexed.seek_lines(spark, path, wanted)
    m = from_json(found.select(F.col("place").alias("line"), "value"), None, None)
    return m.withColumnRenamed("record_index", "place").join(wanted.select(F.col("place").cast("long").alias("place"), F.col("record_index").cast("long").alias("record_index")), "place").orderBy("place")


def fingerprint(spark: SparkSession, *paths: str) -> DataFrame:
    """path, sha256 and length of files (V9, AGG24)."""
    return indexed.file_digests(spark, list(paths))


def path_union(*files: DataFrame) -> DataFrame:
    """(path, content) of all, each path once (SET6)."""
    out = files[0].select("path", "content")
    for more in files[1:]:
        out = out.unionByName(more.select("path", "content"))
    return out.distinct()


def dataset_fingerprint(files: DataFrame, config: dict) -> DataFrame:
    """dataset, files and the SHA-256 of the configuration as JSON with sorted keys and then of each path and content, in order
    of path, without separators (AGG23, LIM2); a dataset is the first part of a path."""
    piece = F.concat(F.col("path").cast("binary"), F.coalesce(F.col("content").cast("binary"), F.lit(b"")))
    told = files.select(F.substring_index("path", "/", 1).alias("dataset"), "path", piece.alias("piece"))
    return ordered_digest(told, ["dataset"], ["path"], F.col("piece"), prefix=json.dumps(config, sort_keys=True)).withColumnRenamed("rows", "files")


def manifest_digest(manifest: DataFrame) -> str:
    """SHA-256 over a manifest's lines in record order, in two levels: of stretches of DIGEST_ROWS records, then of their digests."""
    lines = to_json_lines(manifest).select(F.floor(F.col("record_index") / DIGEST_ROWS).alias("stretch"), "record_index", F.sha2("value", 256).alias("line"))
    ordered = lambda key, value: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: x[value]), ",")
    parts = lines.groupBy("stretch").agg(F.sha2(ordered("record_index", "line"), 256).alias("digest"))
    return parts.agg(F.sha2(ordered("stretch", "digest"), 256)).first()[0]
