"""Adapters, packed shards, benchmark files, configurations and the sample stream."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weft.sources import benchmarks, manifests, shards
from weft.streaming import samples


def test_librispeech(spark, tmp_path):
    d = tmp_path / "1/2"
    d.mkdir(parents=True)
    (d / "1-2.trans.txt").write_text("1-2-3 HELLO\n1-2-4 WORLD\n")
    (d / "1-2-3.flac").write_bytes(b"x")
    (d / "1-2-4.wav").write_bytes(b"y")
    m = manifests.librispeech(spark, str(tmp_path), "librispeech", "train").orderBy("record_index").collect()
    assert [r["id"] for r in m] == ["librispeech:train:1-2-3", "librispeech:train:1-2-4"]
    assert [r["transcript"] for r in m] == ["HELLO", "WORLD"] and {r["speaker"] for r in m} == {"1"}
    (d / "1-2-3.wav").write_bytes(b"z")
    with pytest.raises(Exception, match="duplicate audio"):
        manifests.librispeech(spark, str(tmp_path), "librispeech", "train").collect()


def test_fairseq(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("../audio\nexample.flac\t32000\n")
    (tmp_path / "m.txt").write_text("HELLO\n")
    r = manifests.fairseq_tsv(spark, str(tmp_path / "m.tsv"), "d", "train", 16000, str(tmp_path / "m.txt")).first()
    assert r["duration"] == 2.0 and r["audio"].endswith("/../audio/example.flac") and r["transcript"] == "HELLO"
    (tmp_path / "m.txt").write_text("HELLO\nMORE\n")
    with pytest.raises(Exception, match="different counts"):
        manifests.fairseq_tsv(spark, str(tmp_path / "m.tsv"), "d", "train", 16000, str(tmp_path / "m.txt")).collect()


def test_json_lines_and_round_trip(spark, tmp_path):
    lines = [{"path": "a.wav", "text": "hi", "note": "kept"}, {"audio": "", "audio_path": "b.wav", "transcript": None, "text": "no"}, {"id": "own", "duration": 3.5}]
    (tmp_path / "m.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n")
    m = manifests.from_json(manifests.text_lines(spark, str(tmp_path / "m.jsonl")), "d", "train")
    r = m.orderBy("record_index").collect()
    assert [x["audio"] for x in r] == ["a.wav", "b.wav", None] and [x["transcript"] for x in r] == ["hi", None, None]
    assert r[0]["extra"] == {"note": "kept"} and r[2]["id"] == "own" and r[2]["duration"] == 3.5
    manifests.write_manifest(m, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 3


def test_read_rows_keeps_the_request_order(spark):
    m = manifests.from_documents(spark.createDataFrame([(i, "t", "en", "s", 3) for i in range(9)], "doc_id long, text string, lang string, source string, n_chars long"))
    wanted = spark.createDataFrame([(0, 8), (1, 0), (2, 3)], "place long, record_index long")
    assert [r["record_index"] for r in manifests.read_rows(m, wanted).collect()] == [8, 0, 3]
    with pytest.raises(Exception, match="out of range"):
        manifests.read_rows(m, spark.createDataFrame([(0, 9)], "place long, record_index long")).collect()


def make(tmp_path, n=3):
    codes = np.arange(20 * n).reshape(n, 10, 2) % 30
    frame = pd.DataFrame({"shard": "s0", "id": [f"u{i}" for i in range(n)], "codes": [c.tolist() for c in codes], "text": [[1, 2, 3]] * n, "dur": [[3, 3, 4]] * n, "metadata": ['{"a": 1}'] * n})
    return frame, codes


def test_packed_shard_round_trip_and_corruption(spark, tmp_path):
    frame, codes = make(tmp_path)
    df = spark.createDataFrame(frame, "shard string, id string, codes array<array<smallint>>, text array<int>, dur array<int>, metadata string")
    root = str(tmp_path / "root")
    shards.write_shards(df, root, "aligned", 2, {"v": 1})
    shards.write_shards(df, root, "aligned", 2, {"v": 1})  # complete already: nothing changes
    with pytest.raises(Exception, match="different parameters"):
        shards.write_shards(df, root, "aligned", 2, {"v": 2})
    for got in (shards.decode_shards(spark, root), spark.read.format("packed_shard").option("path", root).load()):
        rows = got.orderBy("place").collect()
        assert [r["codes"] for r in rows] == codes.tolist()
        assert all(r["dur"] == [3, 3, 4] and json.loads(r["metadata"]) == {"a": 1} for r in rows)
    with open(f"{root}/s0/audio.bin", "ab") as f:
        f.write(b"\0")
    with pytest.raises(Exception, match="audio size"):
        shards.decode_shards(spark, root).collect()


def test_encode_refuses_empty_and_decode_finds_faults():
    frame, _ = make(None)
    with pytest.raises(ValueError, match="empty shard"):
        shards.encode(frame.iloc[:0], "aligned", 2, {}, [])
    files = shards.encode(frame, "aligned", 2, {}, [{"id": "x", "reason": "r", "detail": ""}])
    assert json.loads(files["meta.json"])["num_skipped"] == 1
    with pytest.raises(ValueError, match="metadata count"):
        shards.decode("s", files | {"samples.jsonl": b""})


def test_parts_keep_wide_numbers(spark, tmp_path):
    np.array([3], "<i8").tofile(tmp_path / "p.len")
    np.array([7, 40000, 49151], "<i4").tofile(tmp_path / "p.bin")
    assert shards.decode_parts(spark, str(tmp_path), "p", 1, number="<i4").first()["codes"] == [[7], [40000], [49151]]


def test_story_manifest(spark, tmp_path):
    (tmp_path / "s.csv").write_text("pair_id,text,type,correctness\nq1,P,prompt,-\nq1,R,continuation,correct\nq1,W,continuation,incorrect\n")
    m = benchmarks.story_manifest(spark, str(tmp_path / "s.csv"), 1)
    benchmarks.write_story_manifest(m, str(tmp_path / "m"), "v1")
    assert benchmarks.read_story_manifest(spark, str(tmp_path / "m"), "v1", 1).first()["chosen"] == "R"
    with pytest.raises(ValueError, match="revision"):
        benchmarks.read_story_manifest(spark, str(tmp_path / "m"), "v2", 1)
    with pytest.raises(ValueError, match="number of examples"):
        benchmarks.read_story_manifest(spark, str(tmp_path / "m"), "v1")


@pytest.mark.parametrize("bad", [{"weights": [1, 0]}, {"weights": [0] * 5}, {"weights": [1, 0, 0, 0, 0]}, {"weights": [1, 0, 0, 0, 0], "datasets": {"txt": ["a", "b"]}, "probabilities": {"txt": [1.0]}}, {"weights": [0, 0, 0, 1, 0], "datasets": {"imgtxt": ["a"]}, "aligned": True}, {"weights": [1, 0, 0, 0, 0], "colour": 1}])
def test_bad_configurations(bad):
    with pytest.raises(ValueError):
        benchmarks.load_config(json.dumps(bad))


def test_sample_stream_resumes(spark, tmp_path):
    double = lambda b: b.select("sample_index", (F.col("sample_index") * 2).alias("x"))
    for stop in (20, 40):
        q = samples.write_samples(samples.sample_stream(spark, stop=stop, samplesPerTrigger=10), double, str(tmp_path / "out"), str(tmp_path / "check"), processingTime="0 seconds")
        q.processAllAvailable()
        q.stop()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["sample_index"] for r in got.collect()) == list(range(40))
    assert got.select("batch").distinct().count() == 4
