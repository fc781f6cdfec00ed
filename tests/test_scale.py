"""Operators whose work is divided: results equal a plain loop, however the rows are dealt out."""

import datetime
import hashlib
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft import storage
from weft.functions import hashing, numeric, text
from weft.operators import digests, evaluation, mixture, ordering, planning, quantize, sequences
from weft.plans import frames, layouts
from weft.sources import audio
from weft.streaming import samples


@pytest.fixture
def many_ranges(spark):
    """Ranges stay apart, as on a cluster with much data."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def loop_fill(sizes, limit, used=0):
    """(bins begun, size of the open bin, bin of each size)."""
    number, out = 0, []
    for size in sizes:
        if used > 0 and used + size > limit:
            number, used = number + 1, 0
        used += size
        out.append(number)
    return number, used, out


@pytest.mark.parametrize("seed", range(3))
def test_chains_answer_for_every_entering_size(seed):
    rng = random.Random(seed)
    for _ in range(150):
        limit = rng.choice([1, 5, 20])
        sizes = [rng.choice([0, 0, 1, 2, 5, 9, 30]) for _ in range(rng.randint(1, 40))]
        chain = planning.chain_of_bins(np.array(sizes, np.int64), limit)
        assert len(chain) <= limit + 2 and chain == sorted(chain)
        for entering in range(3 * limit + 40):
            _, used, bins = [x for x in chain if x[0] <= entering][-1]
            assert (bins, used if bins else used + entering) == loop_fill(sizes, limit, entering)[:2], (sizes, limit, entering)


@pytest.mark.parametrize("keys", [1, 2, 40])
def test_fill_of_a_key_over_many_ranges_equals_the_loop(many_ranges, keys):
    rng = random.Random(keys)
    rows = [(None if k == 1 else f"k{k}", place, rng.choice([0, 1, 5, 9, 30])) for place in range(6000) for k in [min(int(rng.random() ** 3 * keys), keys - 1)]]
    df = many_ranges.createDataFrame(rows, "k string, place long, size long").repartition(5)
    got = {r["place"]: r["bin"] for r in planning.bounded_fill(df, 50, ["k"]).collect()}
    for key in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == key]
        assert [got[p] for _, p, _ in own] == loop_fill([s for *_, s in own], 50)[2]
    assert planning.bounded_fill(df.limit(0), 50, ["k"]).isEmpty()
    whole = {r["place"]: r["bin"] for r in planning.bounded_fill(df.drop("k"), 50).collect()}
    assert [whole[p] for p in range(6000)] == loop_fill([r[2] for r in rows], 50)[2]


def test_offsets_of_a_key_over_many_ranges(many_ranges):
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.9 else "cold", k, rng.randint(0, 5)) for k in range(3000)]
    got = {r["i"]: r["offset"] for r in sequences.offsets(many_ranges.createDataFrame(rows, "k string, i long, n long").repartition(6), ["k"], "i", "n").collect()}
    sums = {"hot": 0, "cold": 0}
    for key, k, n in rows:
        assert got[k] == sums[key]
        sums[key] += n


def test_order_over_many_ranges(many_ranges):
    df = many_ranges.range(2000).select(((F.col("id") * 7919) % 2003).alias("k"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("v"), (F.lit(1 << 60) + F.col("id") % 3).alias("big"))
    got = ordering.running(df, ["k"], {"total": F.col("big") - F.lit(1 << 60), "mass": F.col("k") / 2}).orderBy("number").collect()
    order = sorted(df.collect())
    assert [r["k"] for r in got] == [r["k"] for r in order] and [r["number"] for r in got] == list(range(2000))
    assert [r["total"] for r in got] == [0, *np.cumsum([r["big"] - (1 << 60) for r in order])[:-1].tolist()]
    assert np.allclose([r["mass"] for r in got], [0, *np.cumsum([r["k"] / 2 for r in order])[:-1]])
    ring = {r["k"]: r["next_v"] for r in ordering.next_in_order(df, "k", "v").collect()}
    assert all(ring[a["k"]] == b["v"] for a, b in zip(order, order[1:] + order[:1], strict=True))
    assert ordering.next_in_order(df.limit(0), "k", "v").isEmpty() and ordering.next_in_order(df.limit(1), "k", "v").count() == 1


@pytest.mark.parametrize("cells, small", [(2, 1), (16, 5), (4096, 10_000)])
def test_subset_equals_the_sorted_first_rows(spark, cells, small):
    rows = spark.range(300).select((F.col("id") % 200).alias("index"), F.col("id").alias("other"))
    want = sorted(rows.withColumn("u", hashing.uniform(9, F.col("index"), "subset")).collect(), key=lambda r: (r["u"], r["index"]))
    for fraction in (0.0, 0.15, 0.5, 1.0):
        n = max(1, round(fraction * 300))
        got = evaluation.eval_subset(rows, fraction, 300, 9, cells, small).collect()
        assert sorted(r["index"] for r in got) == sorted(r["index"] for r in want[:n])
    assert evaluation.eval_subset(rows.limit(0), 0.5, 0, 9).isEmpty()


def test_digests_of_ordered_rows(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), k, None if k % 50 == 0 else f"é{k}") for k in range(30_000)]
    df = spark.createDataFrame(rows, "k string, i long, s string").repartition(5)
    got = {r["k"]: (r["rows"], r["digest"]) for r in digests.ordered_digest(df, ["k"], ["i"], F.col("s"), ",", "[", "]").collect()}
    for key in ("a", "b", None):
        own = [s or "" for k, _, s in rows if k == key]
        assert got[key] == (len(own), hashlib.sha256(("[" + ",".join(own) + "]").encode()).hexdigest())
    assert digests.ordered_digest(df.limit(0), ["k"], ["i"], F.col("s")).isEmpty()


def test_ids_hold_texts_whole(spark):
    texts = ["known words, known!", "", None, "  new\tline\n\n", "naïve 中文 👍🏽 \u0085 ", "known" * 3, "\x00\x0b<known>"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "i int, s string").repartition(3)
    vocabulary = spark.createDataFrame([("known", 257), (",", 300), ("中文", 258)], "token string, id int")
    ids = text.piece_ids(docs, "s", vocabulary)
    by = {r["i"]: r for r in text.text_of_ids(ids, "ids", vocabulary, "back").collect()}
    assert [by[k]["back"] for k in range(len(texts))] == [t or "" for t in texts]
    assert by[0]["ids"] == [257, 32, *b"words", 300, 32, 257, *b"!", 256] and by[2]["ids"] == [256]
    assert text.piece_ids(docs, "s", vocabulary, end=None).where("i = 1").first()["ids"] == []
    with pytest.raises(Exception, match="outside the vocabulary"):
        text.text_of_ids(spark.createDataFrame([([999],)], "ids array<int>"), "ids", vocabulary).collect()
    assert text.text_of_ids(spark.createDataFrame([(None,)], "ids array<int>"), "ids", vocabulary).first()["text"] is None


def test_running_sums_of_arrays(spark):
    rows = [[3, None, 2], [], None, [1 << 40, -5], [7]]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(rows)], "i int, x array<long>").repartition(2)
    got = {r["i"]: r["s"] for r in df.select("i", numeric.running_sums(F.col("x")).alias("s")).collect()}
    assert [got[k] for k in range(5)] == [[3, 3, 5], [], None, [1 << 40, (1 << 40) - 5], [7]]


def test_patches_are_laid_out_without_a_shuffle(spark, sf):
    plan = frames.align_patches(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def test_the_table_function_expands_runs(spark):
    sequences.register_functions(spark)
    rows = [("a", 0, 5, 2), ("a", 1, 6, 0), ("a", 2, 5, 3), ("b", 0, 1, 1), ("b", 1, 9, None)]
    spark.createDataFrame(rows, "k string, place int, token int, duration long").repartition(3).createOrReplaceTempView("some_runs")
    got = spark.sql("select k, frame, token from expand_runs(table(some_runs) partition by k order by place) order by k, frame").collect()
    assert [tuple(r) for r in got] == [("a", 0, 5), ("a", 1, 5), ("a", 2, 5), ("a", 3, 5), ("a", 4, 5), ("b", 0, 1)]
    with pytest.raises(Exception, match="needs a table with a column duration"):
        spark.sql("select * from expand_runs(table(select 1 as x))")
    with pytest.raises(Exception, match="must not be negative"):
        spark.sql("select * from expand_runs(table(select -1 as duration))").collect()


@pytest.mark.parametrize("first, then", [(3, 3), (3, 5), (1, 4)])
def test_workers_of_a_stream_share_the_samples(spark, tmp_path, first, then):
    def run(stop, workers):
        stream = samples.sample_stream(spark, start=2, stop=stop, samplesPerTrigger=7, workers=workers)
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).start()
        q.processAllAvailable()
        q.stop()

    run(20, first)
    run(45, then)
    assert sorted(r["sample_index"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(2, 45))


def test_a_worker_takes_every_so_manieth_sample():
    def numbers(low, high, **options):
        return [list(range(*r)) for r in samples.SampleReader({"start": "2", **options})._ranges(low, high)]

    assert numbers(2, 12, workers="3") == [[2, 5, 8, 11], [3, 6, 9], [4, 7, 10]]
    assert numbers(9, 12, workers="3", worker="1") == [[9]] and numbers(10, 12, workers="3", worker="1") == []
    assert sorted(x for w in range(4) for part in numbers(5, 30, workers="4", worker=str(w)) for x in part) == list(range(5, 30))
    with pytest.raises(ValueError):
        samples.SampleReader({"workers": "2", "worker": "2"})


def test_case_folding_of_every_code_point(spark):
    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    rows = [(k, "x".join(points[k : k + 500])) for k in range(0, len(points), 500)] + [(-1, "ﬁne ΣΑΣ ŉ ς Straße"), (-2, ""), (-3, None)]
    df = spark.createDataFrame(rows, "k int, s string").repartition(4)
    wrong = [r["k"] for r in df.select("k", "s", text.casefold(F.col("s")).alias("f")).collect() if r["f"] != (None if r["s"] is None else r["s"].casefold())]
    assert wrong == []


def wave(x, rate, kind, bits, before=b""):
    """A WAVE file of samples in [-1, 1], frames x channels, as whole numbers or floats."""
    if kind == audio.FLOAT:
        body = x.astype(f"<f{bits // 8}").tobytes()
    elif bits == 24:
        body = b"".join(int(v).to_bytes(3, "little", signed=True) for v in (x * 2**23).ravel())
    else:
        body = (x * 128 + 128).astype(np.uint8).tobytes() if bits == 8 else (x * 2.0 ** (bits - 1)).astype(f"<i{bits // 8}").tobytes()
    chunk = lambda name, data: struct.pack("<4sI", name, len(data)) + data + b"\0" * (len(data) % 2)
    told = struct.pack("<HHIIHH", kind, x.shape[1], rate, rate * x.shape[1] * bits // 8, x.shape[1] * bits // 8, bits)
    inside = b"WAVE" + before + chunk(b"fmt ", told) + chunk(b"LIST", b"odd") + chunk(b"data", body)
    return struct.pack("<4sI", b"RIFF", len(inside)) + inside


@pytest.mark.parametrize("kind, bits", [(1, 8), (1, 16), (1, 24), (1, 32), (3, 32), (3, 64)])
def test_segments_of_wave_files(spark, tmp_path, kind, bits):
    x = np.round(np.random.default_rng(bits).uniform(-0.9, 0.9, (1000, 2)) * 64) / 64  # whole in every format
    (tmp_path / "a.wav").write_bytes(wave(x, 100, kind, bits))
    (tmp_path / "junk.wav").write_bytes(b"RIFFjunk")
    at = str(tmp_path / "a.wav")
    rows = [(0, at, 0.0, None), (1, at, 2.5, 3.0), (2, f"file:{at}", 9.0, 5.0), (3, at, 0.005, 0.015), (4, str(tmp_path / "junk.wav"), 0.0, None), (5, None, 0.0, None), (6, str(tmp_path / "gone.wav"), 0.0, 1.0), (7, at, 0.0, -1.0)]
    df = spark.createDataFrame(rows, "k int, audio string, offset double, duration double").repartition(3)
    got = {r["k"]: r for r in audio.audio_segments(df, 100).collect()}
    mean = x.mean(axis=1)
    for k, want in ((0, mean), (1, mean[250:550]), (2, mean[900:]), (3, mean[0:2])):
        assert got[k]["problem"] is None and np.allclose(got[k]["samples"], want)
    assert all(got[k]["samples"] is None and got[k]["problem"] for k in (4, 5, 6, 7))
    assert {r["problem"] for r in audio.audio_segments(df.where("k < 2"), 16000).collect()} == {"ValueError: the rate is 100, not 16000"}
    assert audio.audio_segments(df.limit(0)).isEmpty()


def test_near_distances_tie_to_the_lowest_centroid(spark):
    """Distances that round to the same 6 decimals are equal, as in the SQL; others are told apart, whatever the vectors' size."""
    table = np.array([[1 + 2e-8, 0], [1, 0], [1 - 2e-6, 0], [5e4, 3], [5e4, 3 + 1e-5]])
    rows = [(0, [0.0, 0.0]), (1, [2.0, 0.0]), (2, [5e4, 4.0]), (3, [5e4, 2.0])]
    df = spark.createDataFrame(rows, "i long, x array<double>")
    got = {r["i"]: r["codes"] for r in quantize.assign(df, "i", "x", table).collect()}
    assert got == {0: [2], 1: [0], 2: [4], 3: [3]}
    first = {r["i"]: r["codes"] for r in quantize.assign(df, "i", "x", table[:2]).collect()}
    assert first[0] == [0]


def test_samples_of_audio_are_added_in_order(spark, tmp_path):
    """A sum of doubles follows the events' order, not the files'."""
    begin, kind = datetime.datetime(2024, 1, 1), "event_id long, ts timestamp, user_id long, value double"
    rows = [(k, begin + datetime.timedelta(seconds=k), 1, v) for k, v in enumerate([2.0**41, 0.0002, -0.0002])]
    for part in (rows[1:], rows[:1]):
        spark.createDataFrame(part, kind).withColumn("event_type", F.lit("view")).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    assert frames.audio_chunks(spark, str(tmp_path)).first()["samples"] == 2**41 * 4000


def drawn_plans(spark, monkeypatch, sf, **options):
    """Joins that broadcast one side, in the plans of drawn samples; a table of one row a range (stretch) may be."""
    plans = []
    monkeypatch.setattr(mixture, "materialize", lambda df, label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or storage.materialize(df, label))
    layouts.drawn(spark, sf, **options)
    return [line for plan in plans for line in plan.split("\n") if "BroadcastHashJoin" in line and "stretch" not in line]


def test_streamed_samples_broadcast_no_growing_table(spark, monkeypatch, sf):
    assert not drawn_plans(spark, monkeypatch, sf, indices=spark.range(3).select(F.col("id").alias("sample_index")))


def test_long_samples_broadcast_no_growing_table(spark, monkeypatch, sf):
    assert not drawn_plans(spark, monkeypatch, sf, size=layouts.LONG_SIZE)


def test_a_stream_prepares_its_sources_once(spark, monkeypatch, sf):
    """The driver plans the sources once, not for each micro-batch: its memory does not grow with the batches."""
    made = []
    monkeypatch.setattr(layouts, "timeline", lambda *a: made.append(a) or frames.timeline(*a))
    assert layouts.stream_samples(spark, sf).count() > 0
    assert len(made) == 1


def test_long_samples_are_dealt_out_by_their_runs(spark, monkeypatch, sf):
    """Tasks follow the runs, not the session's four partitions; runs themselves are never written."""
    written = []
    monkeypatch.setattr(mixture, "materialize", lambda df, label: written.append(label) or storage.materialize(df, label))
    monkeypatch.setattr(mixture, "TASK_RUNS", 2000)
    n = layouts.load(spark, sf, "events").agg(F.countDistinct("user_id")).first()[0]
    assert layouts.interleave_long(spark, sf).rdd.getNumPartitions() > n / 2
    assert "runs" not in written
