"""Golden vectors and properties of the operators."""

import random

import pytest
from pyspark.sql import Row, functions as F

from weft.functions import hashing, numeric, text
from weft.operators import alignment, evaluation, mixture, planning, scoring, sequences, validation

PAD, END_OF_WORD = 100, 101


def one(df):
    return df.first()


def test_collapse_golden(spark):
    df = spark.createDataFrame([Row(codes=[1, 1, 1, 2, 3, 3, 3, 4, 5, 5])])
    got = one(df.select(sequences.collapse(F.col("codes"), F.lit(6).cast("long")).alias("c")))["c"]
    assert got["codes"] == [1, 2, 3, 4, 5, 6]
    assert got["frame_to_code"] == [0, 0, 0, 1, 2, 2, 2, 3, 4, 4, 5]


def test_collapse_merges_a_trailing_end(spark):
    df = spark.createDataFrame([Row(codes=[7, 6, 6])])
    got = one(df.select(sequences.collapse(F.col("codes"), F.lit(6).cast("long")).alias("c")))["c"]
    assert got["codes"] == [7, 6] and got["frame_to_code"] == [0, 1, 1, 1]


WORD = "text string, start double, end double, ids array<int>"


def spans(spark, words, steps, seconds, mapping=None):
    schema = f"words array<struct<{WORD.replace(' string', ':string').replace(' double', ':double').replace(' array', ':array')}>>, steps int, seconds double, map array<int>"
    df = spark.createDataFrame([(words, steps, seconds, mapping)], schema)
    s = alignment.word_spans(F.col("words"), F.col("steps"), F.col("seconds"), F.col("map") if mapping else None)
    df = df.withColumn("s", s).withColumn("runs", alignment.runs_from_spans(F.col("s.spans"), F.col("steps"), PAD))
    return one(df.select("s", "runs"))


def dense(runs):
    return [r["token"] for r in runs for _ in range(r["duration"])]


def test_align_with_map_golden(spark):
    got = spans(spark, [("a", 0.0, 0.4, [97, 101]), ("b", 0.4, 0.8, [98, 101])], 6, 1.0, [0, 0, 0, 1, 2, 2, 2, 3, 4, 4, 5])
    assert got["s"]["error"] is None
    assert dense(got["runs"]) == [97, 101, 98, 101, 100, 100]


def test_align_short_word_golden(spark):
    assert dense(spans(spark, [("a", 0.0, 0.1, [97, 101])], 4, 1.0)["runs"]) == [97, 101, 100, 100]


def test_align_errors(spark):
    assert spans(spark, [("", 0.0, 0.1, [97, 101])], 4, 1.0)["s"]["error"] == "invalid timestamp"
    assert spans(spark, [("a", 0.0, 2.0, [97, 101])], 4, 1.0)["s"]["error"] == "outside the audio"
    assert spans(spark, [("a", 0.0, 0.5, [97] * 9)], 4, 1.0)["s"]["error"] == "too few steps for its tokens"


def test_runs_cover_all_steps(spark):
    rng = random.Random(5)
    for _ in range(6):
        n = rng.randint(1, 6)
        words = [(chr(97 + i), i * 1.0, i + 0.3 + rng.random() * 0.7, [97 + i] * rng.randint(1, 3) + [101]) for i in range(n)]
        got = spans(spark, words, n * 5, float(n))
        assert got["s"]["error"] is None
        assert sum(r["duration"] for r in got["runs"]) == n * 5
        assert all(a["token"] != b["token"] for a, b in zip(got["runs"], got["runs"][1:]))


def test_frame_synchronous_golden(spark):
    df = spark.createDataFrame([([("a", 0.0, 0.1, [97]), ("b", 0.5, 0.6, [98])], 8, 1.0)], "words array<struct<text:string,start:double,end:double,ids:array<int>>>, frames int, seconds double")
    df = df.withColumn("p", alignment.frame_starts(F.col("words"), F.col("frames"), F.col("seconds")))
    tokens = one(df.select(alignment.frame_tokens(F.col("p"), F.col("frames"), PAD, END_OF_WORD).alias("t"), alignment.frame_alignment_error(F.col("p")).alias("bad")))
    assert tokens["t"] == [97, 100, 100, 101, 98, 100, 100, 101, 100] and not tokens["bad"]


def test_tokens_to_words(spark):
    tokens = spark.createDataFrame([(1, 0, 0, 2), (1, 1, 2, 5), (1, 2, 3, 6)], "doc int, token_index int, start int, end int")
    words = spark.createDataFrame([(1, 0, 0, 3), (1, 1, 4, 7)], "doc int, word int, start int, end int")
    got = {r["token_index"]: r["word"] for r in alignment.tokens_to_words(tokens, words, ["doc"]).collect()}
    assert got == {0: 0, 1: 0, 2: 1}


def test_plan_golden(spark):
    rows = spark.createDataFrame([(i, f"d:train:{i}", i + 1.0) for i in range(9)], "record_index long, id string, load double")
    plan = planning.balanced_plan(rows, 3)
    shards = {k: sorted(r["record_index"] for r in plan.collect() if r["shard_index"] == k) for k in range(3)}
    assert list(shards.values()) == [[2, 3, 8], [1, 4, 7], [0, 5, 6]]
    assert {r["shard_index"]: r["load"] for r in planning.plan_loads(plan).collect()} == {0: 16.0, 1: 15.0, 2: 14.0}
    assert {r["record_index"] for r in planning.plan_groups(rows, 4, 2).collect()} == set(range(9))


def test_plan_needs_enough_records(spark):
    rows = spark.createDataFrame([(0, "a", 1.0)], "record_index long, id string, load double")
    with pytest.raises(Exception, match="cannot exceed"):
        planning.balanced_plan(rows, 2).collect()


def test_delay_golden(spark):
    rows = [(s, p, 3 * (34 * s + p), 3 * (34 * s + p) + 1, 3 * (34 * s + p) + 2) for s in range(2) for p in range(34)]
    df = spark.createDataFrame(rows, "s int, p int, k0 int, k1 int, k2 int")
    got = df.select("s", "p", *(sequences.delay(F.col(f"k{k}"), d, F.lit(999), ["s"], "p").alias(f"k{k}") for k, d in enumerate((0, 18, 40)))).orderBy("s", "p").collect()
    for s in range(2):
        part = [r for r in got if r["s"] == s]
        assert [r["k0"] for r in part] == [x[2] for x in rows if x[0] == s]
        assert [r["k1"] for r in part] == [999] * 18 + [x[3] for x in rows if x[0] == s][:16]
        assert {r["k2"] for r in part} == {999}


def test_numeric_goldens(spark):
    df = spark.createDataFrame([Row(step=6), Row(step=9), Row(step=0)])
    assert [r[0] for r in df.select(numeric.schedule(F.col("step"), 2e-4, 2e-5, 2, 10, 3)).collect()] == [2e-4, 2e-5, 1e-4]
    edges = one(spark.range(1).select(numeric.spread(F.lit(0), F.lit(30), F.lit(22)).alias("e")))["e"]
    assert edges == [int(i * (30 / 22)) for i in range(22)] + [30]
    logits = spark.createDataFrame([Row(x=[0.5, 3.0, 1.0])])
    assert one(logits.select(scoring.greedy(F.col("x")).alias("i")))["i"] == 1
    assert one(logits.select(scoring.sample(F.col("x"), 0.0, None, 1).alias("i")))["i"] == 1
    assert abs(sum(2.718281828459045**v for v in one(logits.select(numeric.log_softmax(F.col("x")).alias("p")))["p"]) - 1) < 1e-9
    assert one(logits.select(scoring.top_k_mask(F.array(F.lit(2.0), F.lit(2.0), F.lit(1.0)), 1).alias("m")))["m"] == [2.0, 2.0, None]


def test_sampling_follows_the_softmax(spark):
    df = spark.range(4000).select("id", F.array(F.lit(0.0), F.lit(1.0), F.lit(-1.0)).alias("x"))
    got = {r["c"]: r["count"] for r in df.select(scoring.sample(F.col("x"), 1.0, None, 3, F.col("id")).alias("c")).groupBy("c").count().collect()}
    assert abs(got[1] / 4000 - 0.665) < 0.03 and abs(got[0] / 4000 - 0.245) < 0.03


def test_text_goldens(spark):
    df = spark.createDataFrame([("A four-sentence story.",), ("The fitting ending.",), ("An  unrelated ending!",), (" a . ",)], "t string")
    assert [r[0] for r in df.select(text.normalize_story(F.col("t"))).collect()] == ["a four-sentence story", "the fitting ending", "an unrelated ending", "a"]
    words = spark.createDataFrame([("abcde",), ("שלום",), ("",)], "w string")
    assert [r[0] for r in words.select(text.bigrams(F.col("w"))).collect()] == [["ab", "cd", "e"], ["םו", "לש"], []]
    assert one(words.select(text.tokenizer_base(F.lit("org/name-base-v2")).alias("b")))["b"] == "org/name-base"


def test_boundary(spark):
    df = spark.createDataFrame([([1, 2], [2, 3]), ([1], [2]), ([], [2]), ([1], []), ([5], [5])], "p array<int>, c array<int>")
    assert [r[0] for r in df.select(sequences.collapse_boundary(F.col("p"), F.col("c"))).collect()] == [[3], [2], [2], [], []]


def test_validation_of_samples(spark):
    schema = "id string, codes array<array<int>>, text array<int>, dur array<int>, metadata map<string,string>"
    rows = [("ok", [[1], [2], [3], [4]], [1, 2], [2, 2], {"a": "b"}), ("dur", [[1], [2], [3], [4]], [1, 2], [1, 1], {}), ("key", [[1]], [1], [1], {"id": "x"}), ("range", [[99]], [1], [1], {}), ("none", [], [], [], {})]
    good, bad = validation.split(spark.createDataFrame(rows, schema), validation.sample_reason(32))
    assert [r["id"] for r in good.collect()] == ["ok"]
    assert {r["id"]: r["reason"] for r in bad.collect()} == {"dur": "durations do not cover the codes", "key": "reserved metadata key", "range": "code out of range", "none": "no codes"}


def test_best_options_ignore_nan_and_take_the_first(spark):
    rows = [(0, 0, float("nan")), (0, 1, -2.0), (1, 0, -1.0), (1, 1, -1.0), (2, 0, float("nan")), (2, 1, -1e31)]
    got = {r["index"]: r["pred"] for r in evaluation.best_options(spark.createDataFrame(rows, "index int, opt int, logprob double")).collect()}
    assert got == {0: 1, 1: 0, 2: None}


def test_story_problems(spark):
    rows = [(0, "a", "p", "prompt", "-"), (1, "a", "c", "continuation", "correct"), (2, "a", "r", "continuation", "incorrect"), (3, "b", "p", "prompt", "-"), (4, "b", "p", "prompt", "-")]
    df = spark.createDataFrame(rows, "place long, pair_id string, text string, type string, correctness string")
    assert {r["pair_id"]: r["problem"] for r in evaluation.story_pivot(df).collect()} == {"a": None, "b": "duplicate label"}
    with pytest.raises(Exception, match="expected 1871"):
        evaluation.story_pivot(df, 1871).collect()


def test_special_tokens():
    assert numeric.special_tokens(100, True) == {"pad": 100, "end_of_word": 101, "switch": 102, "vocab": 103}
    assert numeric.special_tokens(100, True, frame_synchronous=True)["vocab"] == 102
    assert numeric.special_tokens(100, False)["vocab"] == 100 and numeric.special_tokens(100, False, other_modality=True)["vocab"] == 101


def sequential_interleave(runs, size, first_text, lengths):
    """An independent sequential model of one interleaved sample."""
    out, words, is_text, k = [], 0, first_text, 0
    for token, duration, audio in runs:
        if words == lengths[k]:
            out.append(("switch", None))
            words, is_text, k = 0, not is_text, k + 1
        if is_text:
            if token not in (PAD, END_OF_WORD):
                out.append(("text", token))
        else:
            out += [("frame", audio + i) for i in range(duration)]
        words += token == END_OF_WORD
    return out[:size]


def test_interleave_equals_a_sequential_model(spark):
    rng = random.Random(9)
    rows, expected, seed, size = [], {}, 77, 120
    for s in range(12):
        audio, runs = 0, []
        for p in range(160):
            token, duration = rng.choice([97, 98, PAD, END_OF_WORD]), rng.randint(1, 3)
            runs.append((token, duration, audio))
            rows.append((s, p, token, duration, audio, 0))
            audio += duration
        expected[s] = runs
    df = spark.createDataFrame(rows, "sample_index long, place long, token int, duration int, audio long, source int")
    got = mixture.interleave(df, size, END_OF_WORD, PAD, 102, seed).orderBy("sample_index", "pos").collect()
    draw = spark.range(12).select("id", (hashing.uniform(seed, F.col("id"), "first")).alias("u"), F.array(*(hashing.uniform(seed, F.col("id"), k, "chunk") for k in range(40))).alias("c"))
    for r in draw.collect():
        first = r["u"] < 0.5
        lengths = [(10 + int(u * 21)) if (first == (k % 2 == 0)) else (5 + int(u * 11)) for k, u in enumerate(r["c"])]
        want = sequential_interleave(expected[r["id"]], size, first, lengths)
        have = [("switch", None) if x["text"] == 102 else ("text", x["text"]) if x["txt_pred"] else ("frame", x["frame"]) for x in got if x["sample_index"] == r["id"]]
        assert have == want
        assert all((not x["txt_pred"] or x["txt_in"]) and (not x["other_pred"] or x["other_in"]) for x in got)


def test_interleave_does_not_depend_on_partitions(spark):
    rows = [(s, p, 97 + p % 3 if p % 4 else END_OF_WORD, 1 + p % 2, p * 2, 0) for s in range(4) for p in range(80)]
    df = spark.createDataFrame(rows, "sample_index long, place long, token int, duration int, audio long, source int")
    a = mixture.interleave(df, 64, END_OF_WORD, PAD, 102, 5)
    b = mixture.interleave(df.repartition(7, "place"), 64, END_OF_WORD, PAD, 102, 5)
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


def test_samples_draw_until_they_are_full(spark):
    indices = spark.range(9).select(F.col("id").alias("sample_index"))
    asked = []

    def draw(numbers):  # a source of one run of one frame; sample 3's sources give none before the draw 40
        asked.append(numbers.agg(F.max("draw")).first()[0] + 1)
        picks = numbers.where("sample_index <> 3 or draw >= 40").select("sample_index", "draw", F.lit(0).alias("source"))
        return mixture.draw_runs(picks, spark.createDataFrame([(0, 0, 7, 1, 5)], "source int, place long, token int, duration long, audio long"))

    runs = mixture.draw_until_full(indices, draw, lambda r: r.groupBy("sample_index").agg(F.sum("duration").alias("n")), 2048, 8)
    out = mixture.aligned_layout(runs, 2048, PAD)
    assert {r["sample_index"]: (r["count"], r["last"]) for r in out.groupBy("sample_index").agg(F.count("*").alias("count"), F.max("pos").alias("last")).collect()} == dict.fromkeys(range(9), (2048, 2047))
    assert asked == [8 << k for k in range(10)]
    with pytest.raises(ValueError, match="no position"):
        mixture.draw_until_full(indices, lambda numbers: draw(numbers).where("false"), lambda r: r.groupBy("sample_index").agg(F.sum("duration").alias("n")), 4, 2048)


def test_drawn_samples_are_joined_by_sorting(spark):
    """No table of draws, runs or samples is broadcast, however small the planner takes it to be."""
    indices = spark.range(9).select(F.col("id").alias("sample_index"))
    sources = spark.createDataFrame([(k, 0, 7, 1, 5) for k in range(2)], "source long, place long, token int, duration long, audio long")
    drawn = []

    def draw(numbers):
        drawn.append(mixture.draw_runs(numbers.withColumn("source", F.col("sample_index") % 2), sources))
        return drawn[-1]

    out = mixture.draw_until_full(indices, draw, lambda r: r.groupBy("sample_index").agg(F.sum("duration").alias("n")), 16, 8)
    for df in (*drawn, out):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_packed_samples_equal_those_of_rows(spark, monkeypatch):
    """Packs, pieces and rounds leave no trace: sources of 1 to 700 runs, padding, unknown tokens, one source without positions."""
    rng = random.Random(5)
    rows = []
    for s, n in enumerate((700, 1, 40, 257, 3, 90)):
        audio = 0
        for p in range(n):
            duration = rng.randint(1, 3)
            rows.append((s, p, PAD if s == 4 else rng.choice([97, 98, PAD, END_OF_WORD, END_OF_WORD]), duration, audio))
            audio += duration
    sources = spark.createDataFrame(rows, "source long, place long, token int, duration long, audio long")
    indices = spark.range(40).select(F.col("id").alias("sample_index"))
    seat = lambda s, d: F.floor(hashing.uniform(7, s, d, "source") * 6).cast("long")
    runs = mixture.draw_until_full(indices, lambda numbers: mixture.draw_runs(numbers.withColumn("source", seat(F.col("sample_index"), F.col("draw"))), sources), lambda r: mixture.emissions(r, END_OF_WORD, PAD, 7).groupBy("sample_index").agg(F.sum("emitted").alias("n")), 300, 2)
    want = mixture.interleave(runs, 300, END_OF_WORD, PAD, 102, 7)
    packs = mixture.pack_runs(sources).withColumn("seat", F.col("source"))
    assert packs.groupBy().agg(F.max("runs"), F.sum("runs")).first()[:] == (mixture.PACK, len(rows))
    for rows_at_once, task in ((512, 1 << 19), (1, 400)):
        monkeypatch.setattr(mixture, "ROWS", rows_at_once)
        monkeypatch.setattr(mixture, "TASK_RUNS", task)
        got = mixture.interleave_drawn(indices, packs, seat, len(rows) / 6, 300, END_OF_WORD, PAD, 102, 7, 1)
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    blank = packs.where("source = 4").withColumn("duration", F.transform("duration", lambda x: x * 0))
    with pytest.raises(ValueError, match="no position"):
        mixture.interleave_drawn(indices.limit(1), blank, lambda s, d: F.lit(4).cast("long"), 3, 300, END_OF_WORD, PAD, 102, 7, 4096)


def test_unknown_tokens_and_durations_of_packs(spark):
    """As in the SQL: an unknown token is a text position, a run without a duration gives no frame."""
    rows = [(0, p, None if p % 3 == 0 else END_OF_WORD, None if p % 4 == 0 else 2, 0) for p in range(60)]
    packs = mixture.pack_runs(spark.createDataFrame(rows, "source long, place long, token int, duration long, audio long")).withColumn("seat", F.col("source"))
    got = mixture.interleave_drawn(spark.range(20).select(F.col("id").alias("sample_index")), packs, lambda s, d: F.lit(0).cast("long"), 60, 40, END_OF_WORD, PAD, 102, 7).collect()
    assert len(got) == 20 * 40
    assert {r["text"] for r in got if r["txt_pred"]} == {None}
    assert all(r["frame"] is not None for r in got if r["other_pred"])


def test_windows_and_variants(spark):
    flat = spark.range(50).select(F.col("id").alias("position"), (F.col("id") * 2).alias("token"))
    got = mixture.windows(spark.range(5).select(F.col("id").alias("sample_index")), 3, mixture.token_blocks(flat, 8), 8, F.lit(50), 8).collect()
    assert len(got) == 40 and all(0 <= r["pos"] < 8 for r in got)
    small = mixture.windows(spark.range(5).select(F.col("id").alias("sample_index")), 3, mixture.token_blocks(flat, 3), 3, F.lit(50), 8).collect()
    assert sorted(small) == sorted(got)  # any length of block
    v = one(spark.range(1).select(evaluation.variant(F.array(F.lit(1), F.lit(2)), F.array(F.lit(7)), True, False, 50, 52, 99).alias("v")))["v"]
    assert [r["text"] for r in v] == [1, 2, 52, 50] and [r["audio"] for r in v] == [99, 99, 99, 7]
    assert [r["aud_pred"] for r in v] == [False, False, True, False] and not any(r["txt_pred"] for r in v)
