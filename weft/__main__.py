"""Commands (UDF6): python -m weft tinystories|jsonl|librispeech|fairseq|plan|encode|text|validate ..."""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from weft.functions import text
from weft.operators import modalities, planning
from weft.session import session
from weft.sources import indexed, manifests, shards


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weft")
    commands = p.add_subparsers(dest="command", required=True)
    for name in ("librispeech", "fairseq", "jsonl"):
        c = commands.add_parser(name, help="source to manifest")
        c.add_argument("source")
        c.add_argument("output")
        c.add_argument("--dataset", required=name != "jsonl")
        c.add_argument("--split", default=None if name == "jsonl" else "train")
        c.add_argument("--revision")
        c.add_argument("--sample-rate", type=int, default=16000)
        c.add_argument("--transcripts")
    c = commands.add_parser("tinystories", help="stories (Parquet with a text column) to manifest")
    c.add_argument("source")
    c.add_argument("output")
    c.add_argument("--split", default="train")
    c.add_argument("--max-samples", type=int)
    c = commands.add_parser("plan", help="balanced shard plan of a manifest")
    c.add_argument("manifest")
    c.add_argument("output")
    c.add_argument("--shards", type=int, required=True)
    c = commands.add_parser("encode", help="encode the transcripts of one planned shard into a packed shard")
    c.add_argument("manifest")
    c.add_argument("plan")
    c.add_argument("output")
    c.add_argument("--shard", type=int, required=True)
    c.add_argument("--encoder", choices=sorted(modalities.ENCODERS), default="characters")
    c = commands.add_parser("text", help="texts (Parquet) to text shards by a vocabulary (Parquet: token, id); finished shards stay")
    c.add_argument("source")
    c.add_argument("output")
    c.add_argument("--vocabulary", required=True)
    c.add_argument("--alias", required=True, help="the vocabulary's name in meta_txt.json")
    c.add_argument("--split", default="train")
    c.add_argument("--column", default="text")
    c.add_argument("--shards", type=int, required=True)
    c.add_argument("--max-samples", type=int)
    c = commands.add_parser("validate", help="read packed shards and check them")
    c.add_argument("root")
    return p


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A written manifest; records carry their dataset and split, files stand in record order."""
    if (at := indexed.mounted(path)) and os.path.isfile(at):
        return manifests.from_json(indexed.number_lines(spark, path), None, None)
    lines = manifests.running(spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row")), ["file", "row"])
    return manifests.from_json(lines.select(F.col("number").alias("line"), "value"), None, None)


def prepare_texts(a: argparse.Namespace, spark: SparkSession) -> None:
    """Text shards of a source's rows in their order; the ids hold the texts whole."""
    vocabulary = spark.read.parquet(a.vocabulary)
    size = vocabulary.agg(F.count("*"), F.max("id")).first()
    shards.claim_metadata(a.output, "txt", a.alias, {"tokens": size[0], "vocab_size": max(text.END_ID, size[1] or 0) + 1, "eos_id": text.END_ID})
    rows = spark.read.parquet(a.source).select(F.col(a.column).alias("text"), F.monotonically_increasing_id().alias("row"))
    rows = manifests.running(rows, ["row"]).select(F.col("number").alias("source_index"), "text")
    if a.max_samples is not None:
        rows = rows.where(F.col("source_index") < a.max_samples)
    ids = text.piece_ids(rows, "text", vocabulary).select("source_index", F.format_string(f"{a.split}:%08d", "source_index").alias("id"), "ids")
    request = {"source": a.source, "column": a.column, "split": a.split, "vocabulary": a.alias, "max_samples": a.max_samples}
    shards.write_text_shards(ids, os.path.join(a.output, a.split), request, a.shards)


def run(a: argparse.Namespace, spark: SparkSession) -> DataFrame | None:
    """The command's result, where it has one to show."""
    if a.command == "validate":
        return shards.decode_shards(spark, a.root).groupBy("shard").agg(F.count("*").alias("samples"))
    if a.command == "text":
        return prepare_texts(a, spark)
    if a.command == "plan":
        m = read_manifest(spark, a.manifest)
        loads = m.select("record_index", "id", planning.weight(F.col("duration"), F.col("transcript")).alias("load"))
        planning.write_plan(planning.balanced_plan(loads, a.shards), a.output, a.manifest, manifests.manifest_digest(m), m.count())
    elif a.command == "encode":
        m = read_manifest(spark, a.manifest)
        wanted = planning.planned_records(spark, a.plan, a.manifest, manifests.manifest_digest(m), a.shard)
        rows = m.join(wanted, "record_index")
        told = F.to_json(F.struct("dataset", "split", "speaker"))
        codes = modalities.ENCODERS[a.encoder](F.coalesce("transcript", F.lit("")))
        samples = rows.select(F.lit(shards.shard_name(a.shard)).alias("shard"), F.col("record_index").alias("place"), "id", codes.alias("codes"), told.alias("metadata"))
        shards.write_shards(samples, a.output, "units-only", 1, {"encoder": a.encoder, "num_assigned_records": wanted.count()})
    else:
        if a.command == "librispeech":
            m = manifests.librispeech(spark, a.source, a.dataset, a.split, a.revision)
        elif a.command == "fairseq":
            m = manifests.fairseq_tsv(spark, a.source, a.dataset, a.split, a.sample_rate, a.transcripts, a.revision)
        elif a.command == "tinystories":
            rows = manifests.running(spark.read.parquet(a.source).select("text", F.monotonically_increasing_id().alias("row")), ["row"])
            m = manifests.tinystories(rows.select(F.col("number").alias("source_index"), "text"), a.split, a.max_samples)
        else:
            m = manifests.from_json(manifests.text_lines(spark, a.source), a.dataset, a.split, a.revision)
        manifests.write_manifest(m, a.output)
    return None


def main(args: list[str] | None = None) -> None:
    shown = run(parser().parse_args(args), session())
    for row in shown.toLocalIterator() if shown is not None else ():
        print(json.dumps(row.asDict()))


if __name__ == "__main__":
    main()
