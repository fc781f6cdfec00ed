"""What Python workers hold after their tasks: it counts against the executor while it sorts and joins."""

import os
import subprocess
import sys
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa

from weft.llm import common, mixing, quality_rules, ranking, simhash
from weft.llm.common import PIECE_BYTES, kept_rows

ROOT = Path(__file__).resolve().parents[2]

PROGRAM = r"""
import re, sys
import pyarrow as pa
from pyspark.sql import SparkSession, functions as F
from weft.llm import quality_rules, simhash

spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()

def held(batches):
    for _ in batches:
        with open("/proc/self/smaps_rollup") as f:
            kb = sum(map(int, re.findall(r"\nPrivate_Dirty:\s+(\d+)", f.read())))
        yield pa.record_batch({"worked": pa.array(["weft.llm.simhash" in sys.modules]), "mb": pa.array([kb // 1024])})

def probe():
    return spark.range(1).coalesce(1).mapInArrow(held, "worked boolean, mb long").first()

docs = spark.range(0, 10000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("w"), F.col("id").cast("string"), F.lit(" some words of a line ")), 120).alias("text"))
before = probe()
for result in (simhash.document_prints(docs), quality_rules.passing(docs, None)):
    result.write.format("noop").mode("overwrite").save()
after = probe()
print("HELD", after["worked"], after["mb"] - before["mb"])
"""


def test_workers_give_memory_back_after_a_task(tmp_path):
    env = os.environ | {"PYTHONPATH": os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])}
    said = subprocess.run([sys.executable, "-c", PROGRAM], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=240)
    assert "HELD True" in said.stdout, said.stderr[-2000:]
    assert int(said.stdout.split("HELD True")[1]) < 80


def test_filters_return_their_rows_in_pieces():
    texts = [" ".join(f"w{k}n{n}" for n in range(40 + k % 60)) for k in range(10000)]
    batch = pa.record_batch({"doc_id": pa.array(range(len(texts))), "text": pa.array(texts)})
    assert batch.nbytes > 4 * PIECE_BYTES
    for passing in (quality_rules._passing(None), ranking._passing(None)):
        pieces = list(passing(iter([batch])))
        assert max(p.nbytes for p in pieces) < 1.5 * PIECE_BYTES
        got = pa.Table.from_batches(pieces).combine_chunks()
        kept = np.array([len(t.split()) >= quality_rules.MIN_WORDS for t in texts]) if passing.__module__ == quality_rules.__name__ else np.ones(len(texts), bool)
        assert got.equals(pa.table(batch).filter(pa.array(kept)).combine_chunks())


def test_pieces_hold_the_marked_rows_once_in_order():
    batch = pa.record_batch({"text": pa.array([None, "a" * 50, "", "b" * 7, None, "c", "d" * 300, "", "e"]), "row": pa.array(range(9))})
    for limit in (1, 8, 60, 1000):
        for keep in (np.ones(9, bool), np.zeros(9, bool), np.arange(9) % 2 == 0):
            rows = [r for p in kept_rows(batch, keep, limit) for r in p["row"].to_pylist()]
            assert rows == np.flatnonzero(keep).tolist()
    assert not list(kept_rows(batch.slice(0, 0), np.zeros(0, bool)))


def test_the_fit_holds_no_whole_temporaries_of_its_sample():
    rng = np.random.default_rng(5)
    length = np.full(500, quality_rules.BUCKETS)
    index = np.concatenate([rng.permutation(quality_rules.BUCKETS).astype(np.uint16) for _ in length])
    value = rng.random(len(index), np.float32)
    tracemalloc.start()
    run = quality_rules.sums_of_runs(index, value, length)
    found = run(np.arange(quality_rules.BUCKETS))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24e6 < 4 * len(index)
    products = value * np.arange(quality_rules.BUCKETS, dtype=np.float32)[index]
    assert np.array_equal(found, np.add.reduceat(products, np.cumsum(length) - length).astype(float))


def test_values_are_turned_by_bucket_as_a_stable_sort_does():
    rng = np.random.default_rng(6)
    length = np.array([0, 3000, 1, 0, 5000, 700])
    index, value = rng.integers(0, 9000, length.sum()).astype(np.uint16), rng.random(length.sum(), np.float32)
    row, turned, sizes = quality_rules.by_bucket(index, value, length)
    turn = np.argsort(index, kind="stable")
    assert np.array_equal(row, np.repeat(np.arange(6), length)[turn]) and np.array_equal(turned, value[turn])
    assert np.array_equal(sizes, np.bincount(index, minlength=quality_rules.BUCKETS))
    x = rng.random(6)
    for limit in (1, 64, 1 << 20):
        assert np.array_equal(quality_rules.sums_of_runs(row, turned, sizes, limit)(x), quality_rules.sums_of_runs(row, turned, sizes)(x))


def test_tasks_that_sort_and_write_texts_follow_their_bytes(spark, corpus, monkeypatch):
    """Not the session's four partitions, nor its cores, however large the texts are; and no row is lost."""
    whole = corpus.selectExpr("sum(octet_length(text))").first()[0]
    monkeypatch.setattr(common, "SPLIT_BYTES", whole // 40)
    for made, ids in ((simhash.survivors(corpus), simhash.near_duplicates(corpus).select("component_id")), (mixing.mixed_documents(corpus), mixing.mixture(corpus).where("copies > 0").select("doc_id"))):
        assert 30 < made.rdd.getNumPartitions() < 200
        assert {r[0] for r in made.select("doc_id").collect()} == {r[0] for r in ids.collect()}


def test_stages_read_in_small_pieces(spark, sf):
    """Smaller settings of the session's own stay."""
    import corpus_pipeline

    own = spark.newSession()
    own.conf.set("spark.sql.parquet.columnarReaderBatchSize", "100")
    for name, stage in corpus_pipeline.STAGES[:2]:
        own.conf.unset("spark.sql.files.maxPartitionBytes")
        stage(own, own.read.parquet(f"{sf}/documents.parquet"), sf)
        assert own.conf.get("spark.sql.files.maxPartitionBytes") == str(common.SPLIT_BYTES), name
    assert own.conf.get("spark.sql.parquet.columnarReaderBatchSize") == "100"
    own.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    common.small_reads(own)
    assert own.conf.get("spark.sql.files.maxPartitionBytes") == "1m"
