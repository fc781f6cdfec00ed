"""Line files with an index: seeks, ranges, numbers and digests."""

import hashlib
import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.sources import indexed, manifests, shards


@pytest.fixture
def bodies():
    rng = random.Random(1)
    return ["".join(rng.choice("abé中 ") for _ in range(rng.choice([0, 1, 5, 60, 3000]))).rstrip("\r") for _ in range(400)]


@pytest.fixture
def written(spark, tmp_path, bodies):
    path = str(tmp_path / "folder/lines.txt")
    df = spark.createDataFrame([(k * 3, b) for k, b in enumerate(bodies)], "record_index long, value string").repartition(5)
    indexed.write_lines(df, path)
    return path


def test_index_holds_every_offset(written, bodies, tmp_path):
    whole = "".join(f"{b}\n" for b in bodies).encode()
    assert open(written, "rb").read() == whole
    sizes = [len(b.encode()) + 1 for b in bodies]
    assert np.fromfile(written + ".idx", "<u8").tolist() == [0, *np.cumsum(sizes)[:-1].tolist()]
    assert sorted(os.listdir(os.path.dirname(written))) == ["lines.txt", "lines.txt.idx"]


def test_seeks_read_the_wanted_bytes_only(spark, written, bodies):
    rng = random.Random(2)
    asked = [8, 0, 3, 3, 399, *rng.sample(range(400), 30)]
    wanted = spark.createDataFrame(list(enumerate(asked)), "place long, record_index long").repartition(3)
    got = {r["place"]: r["value"] for r in indexed.seek_lines(spark, written, wanted).collect()}
    assert [got[k] for k in range(len(asked))] == [bodies[k] for k in asked]
    lines = indexed.Lines(written)
    assert dict(lines.read(lines.runs(asked))) == {k: bodies[k] for k in asked}
    assert lines.read_bytes == sum(len(bodies[k].encode()) + 1 for k in set(asked))
    with pytest.raises(Exception, match="out of range: 400"):
        indexed.seek_lines(spark, written, spark.createDataFrame([(0, 400)], "place long, record_index long")).collect()
    with pytest.raises(IndexError):
        lines.runs([-1])


def test_ranges_and_pushed_filters(spark, written, bodies):
    lines = indexed.read_lines(spark, written, 5000)
    assert lines.rdd.getNumPartitions() > 20
    assert {r["record_index"]: r["value"] for r in lines.collect()} == dict(enumerate(bodies))
    for condition, want in (("record_index in (5, 7, 300)", [5, 7, 300]), ("record_index = 9", [9]), ("record_index > 395", range(396, 400)), ("record_index >= 10 and record_index < 13", [10, 11, 12]), ("record_index <= 1 and length(value) >= 0", [0, 1]), ("record_index = 1 and record_index = 2", [])):
        assert sorted(r["record_index"] for r in lines.where(condition).collect()) == list(want), condition
    reader = indexed._Reader({"path": written, "rangeBytes": "5000"})
    assert list(reader.pushFilters([indexed.In(("record_index",), (5, 7, 8)), indexed.EqualTo(("value",), "x")])) == [indexed.EqualTo(("value",), "x")]
    assert [p.runs for p in reader.partitions()] == [[(5, 5), (7, 8)]]


@pytest.mark.parametrize("step", [1, 7, 1000, 1 << 20])
def test_an_index_built_of_the_file(spark, written, step):
    index = open(written + ".idx", "rb").read()
    if step == 1:  # a short file without a last line end
        open(written, "wb").write(b"a\n\nbc")
        index = np.array([0, 2, 3], "<u8").tobytes()
    assert indexed.build_index(spark, written, step) == len(index) // 8
    assert open(written + ".idx", "rb").read() == index
    assert [r["offset"] for r in indexed.index_table(spark, written, 3).orderBy("record_index").collect()] == np.frombuffer(index, "<u8").tolist()


def test_numbers_of_a_file_in_many_splits(spark, tmp_path):
    body = "".join(f"line {k} {'x' * (k % 90)}\r\n" if k % 3 else f"line {k}\n" for k in range(3000))
    (tmp_path / "f.txt").write_text(body, newline="")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        lines = indexed.number_lines(spark, str(tmp_path / "f.txt"))
        assert spark.read.text(str(tmp_path / "f.txt")).rdd.getNumPartitions() > 20
        got = sorted(map(tuple, lines.collect()))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == [(k, x) for k, x in enumerate(body.splitlines())]
    (tmp_path / "empty.txt").write_text("")
    assert indexed.number_lines(spark, str(tmp_path / "empty.txt")).isEmpty()


@pytest.mark.parametrize("chunk", [1, 1000, 8 << 20])
def test_digests_in_chunks(spark, written, tmp_path, chunk):
    (tmp_path / "b").write_bytes(b"xyz")
    got = {r["path"].rsplit("/", 1)[1]: (r["sha256"], r["length"]) for r in indexed.file_digests(spark, [written, str(tmp_path / "b")], chunk).collect()}
    sha = lambda *paths: hashlib.sha256(b"".join(open(p, "rb").read() for p in paths)).hexdigest()
    assert got == {"lines.txt": (sha(written), os.path.getsize(written)), "b": (sha(tmp_path / "b"), 3)}
    assert indexed.indexed_digest(spark, written, chunk) == sha(written, written + ".idx")
    assert indexed.indexed_digest(spark, str(tmp_path / "b"), chunk) == sha(tmp_path / "b")


def test_a_manifest_is_read_by_its_index(spark, tmp_path):
    rows = spark.range(9).select(F.col("id").alias("record_index"), F.format_string("d:train:%d", "id").alias("id"), F.lit("d").alias("dataset"), F.lit("train").alias("split"), F.format_string("%d.wav", "id").alias("audio"), (F.col("id") + 1).cast("double").alias("duration"))
    path = str(tmp_path / "manifest.jsonl")
    manifests.write_manifest(manifests.as_manifest(rows).repartition(4), path)
    assert [json.loads(x)["id"] for x in open(path)] == [f"d:train:{k}" for k in range(9)]
    wanted = spark.createDataFrame([(0, 8), (1, 0), (2, 3)], "place long, record_index long")
    got = manifests.seek_rows(spark, path, wanted).collect()
    assert [(r["record_index"], r["id"], r["duration"]) for r in got] == [(8, "d:train:8", 9.0), (0, "d:train:0", 1.0), (3, "d:train:3", 4.0)]
    before = indexed.indexed_digest(spark, path)
    open(path, "a").write("\n")
    assert before != indexed.indexed_digest(spark, path)
    with pytest.raises(FileExistsError):
        manifests.write_manifest(manifests.as_manifest(rows), path)
    with pytest.raises(Exception, match="duplicate id"):
        manifests.write_manifest(manifests.as_manifest(rows.withColumn("id", F.lit("same"))), str(tmp_path / "other"))
    assert not (tmp_path / "other").exists()


def test_no_lines(spark, tmp_path):
    path = str(tmp_path / "none")
    indexed.write_lines(spark.createDataFrame([], "record_index long, value string"), path)
    assert os.path.getsize(path) == os.path.getsize(path + ".idx") == 0
    assert indexed.read_lines(spark, path).isEmpty() and indexed.build_index(spark, path) == 0


# packed shards by ranges


@pytest.fixture(scope="module", params=["units-only", "aligned", "text", "rendered"])
def packed(spark, tmp_path_factory, request):
    rng, root, rows = random.Random(5), str(tmp_path_factory.mktemp("packed")), []
    for shard in range(2):
        for k in range(20):
            n = rng.randint(2, 9)
            codes = [[rng.randint(0, 99), rng.randint(0, 99)] for _ in range(n)]
            text = [rng.randint(0, 99) for _ in range(n if request.param in ("text", "rendered") else max(1, n // 2))]
            rows.append((f"s{shard}", k, f"id{k:02d}é", codes, text, [1] * (len(text) - 1) + [n - len(text) + 1], json.dumps({"k": k})))
    df = spark.createDataFrame(rows, "shard string, place long, id string, codes array<array<int>>, text array<int>, dur array<int>, metadata string")
    shards.write_shards(df, root, request.param, 2)
    return root, request.param, rows


def test_slices_equal_whole_shards(spark, packed):
    root, profile, rows = packed
    order = ["shard", "place"]
    whole = spark.read.format("packed_shard").option("path", root).load().orderBy(*order).collect()
    for limit in (1, 60, 1 << 20):
        sliced = shards.read_samples(spark, root, slice_bytes=limit)
        assert sliced.orderBy(*order).collect() == whole
        assert sliced.rdd.getNumPartitions() == {1: 40, 1 << 20: 2}.get(limit, sliced.rdd.getNumPartitions())
    some = shards.read_samples(spark, root).where(f"shard = '{root}/s1' and place in (3, 17)").orderBy(*order).collect()
    assert some == [r for r in whole if r["shard"].endswith("s1") and r["place"] in (3, 17)]
    assert [r["place"] for r in shards.read_samples(spark, root).where("place >= 18 and place < 30").orderBy(*order).collect()] == [18, 19] * 2
    narrow = shards.read_samples(spark, root, ["text" if profile == "text" else "codes"]).orderBy(*order).collect()
    assert all(r["id"] is None and r["metadata"] is None for r in narrow) and [r["codes"] for r in narrow] == [r["codes"] for r in whole]


def test_a_sample_reads_its_own_bytes(packed):
    root, profile, rows = packed
    shard = shards.Packed(f"{root}/s0")
    got, want = shard.sample(7), rows[7]
    assert "codes" not in got or got["codes"].tolist() == want[3]
    assert "text" not in got or got["text"].tolist() == want[4]
    assert "dur" not in got or got["dur"].tolist() == want[5]
    sizes = {"codes": 4 * len(want[3]), "text": 4 * len(want[4]), "dur": 4 * len(want[5])}
    assert shard.read_bytes == {shard.columns[c][0]: sizes[c] for c in shard.columns}
    with pytest.raises(IndexError):
        shard.sample(20)
    kept = shards.Packed(f"{root}/s0")
    list(kept.rows(3, 5, ["text" if profile == "text" else "codes"]))
    assert len(kept.read_bytes) == 1 and shards.SAMPLES not in kept.read_bytes


def test_parts_by_ranges(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k, [[rng.randint(0, 99), k] for _ in range(n)], [k] * n) for k, n in enumerate([3, 1, 7, 2, 5, 4])]
    df = spark.createDataFrame(rows, "place int, codes array<array<int>>, text array<int>")
    shards.write_part(df, str(tmp_path), "p", "bpe")
    for limit in (1, 20, 1 << 20):
        assert sorted(map(tuple, shards.decode_parts(spark, str(tmp_path), "p", 2, "bpe", slice_bytes=limit).collect())) == rows
    with open(tmp_path / "p.bin", "ab") as f:
        f.write(b"x")
    with pytest.raises(ValueError, match="size"):
        shards.decode_parts(spark, str(tmp_path), "p", 2, "bpe")
