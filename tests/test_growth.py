"""Array functions and folds whose time grows with a row's length, not with its square."""

import itertools
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from weft.functions import numeric
from weft.operators import alignment, evaluation, planning, sequences


def words(n):
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct((i * 0.5).alias("start"), F.array(i.cast("int")).alias("ids")))


def numbers(n):
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: ((i * 7919) % 5).cast("int"))


def timed(n):
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(F.lit("a").alias("text"), (i * 0.5).alias("start"), (i * 0.5 + 0.4).alias("end"), F.array(i.cast("int"), F.lit(101)).alias("ids")))


def placed(n):
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct((i * 4 + 1).cast("int").alias("low"), (i * 4 + 3).cast("int").alias("high"), F.array(i.cast("int"), F.lit(101)).alias("ids")))


CASES = {
    "word_spans": lambda n: F.size(alignment.word_spans(timed(n), F.lit(4 * n), F.lit(n * 0.5))["spans"]),
    "word_spans_by_runs": lambda n: F.size(alignment.word_spans(timed(n), F.lit(4 * n), F.lit(n * 0.5), F.sequence(F.lit(0), F.lit(4 * n)))["spans"]),
    "runs_from_spans": lambda n: F.size(alignment.runs_from_spans(placed(n), F.lit(4 * n), 100)),
    "running_sums": lambda n: F.size(numeric.running_sums(numbers(n))),
    "frame_starts": lambda n: F.size(alignment.frame_starts(words(n), F.lit(4 * n), F.lit(n * 0.5))),
    "run_length": lambda n: F.size(alignment.run_length(numbers(n))),
    "collapse": lambda n: F.size(sequences.collapse(numbers(n), F.lit(9))["frame_to_code"]),
    "variant": lambda n: F.size(evaluation.variant(numbers(n), numbers(n), True, False, 50, 52, 99)),
    "patch_array": lambda n: F.size(alignment.patch_array(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct((i * 3).cast("int").alias("start"), (i * 3 + 2).cast("int").alias("end"), F.array(i.cast("int"), i.cast("int")).alias("tokens"))), F.lit(3 * n), 7)),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_time_grows_with_the_length(spark, name):
    def seconds(n):
        df = spark.range(1).select(CASES[name](n).alias("x"))
        began = time.perf_counter()
        assert df.first()["x"] > 0
        return time.perf_counter() - began

    seconds(1000)  # compiles
    small = min(seconds(10_000) for _ in range(3))
    large = min(seconds(40_000) for _ in range(3))
    assert large < 8 * small + 0.3  # four times the length; a square would be 16 times


def test_array_forms_equal_plain_loops(spark):
    rng = random.Random(2)
    rows = [[rng.choice([1, 1, 2, 3]) for _ in range(n)] for n in (1, 2, 7, 40)] + [[]]
    df = spark.createDataFrame([(x,) for x in rows], "x array<int>")
    for r in df.select("x", sequences.collapse(F.col("x"), F.lit(3)).alias("c"), alignment.run_length(F.col("x")).alias("r")).collect():
        whole, codes, places = [*r["x"], 3], [], []
        for v in whole:
            if not codes or codes[-1] != v:
                codes.append(v)
            places.append(len(codes) - 1)
        assert (r["c"]["codes"], r["c"]["frame_to_code"]) == (codes, places)
        assert [x["token"] for x in r["r"] for _ in range(x["duration"])] == r["x"]


def loop_spans(words, steps, seconds, mapping):
    """The alignment rule, word after word."""
    if not words or seconds <= 0:
        return 0, [], "no words or no audio"
    previous, out = 0, []
    for text, start, end, ids in words:
        if not (text or "").strip(" ") or start is None or end is None or end <= start:
            return previous, out, "invalid timestamp"
        if start < 0 or end > seconds + alignment.TOLERANCE:
            return previous, out, "outside the audio"
        if mapping is None:
            low = min(steps - 1, round(start / seconds * steps))
            high = min(steps, max(low + 1, round(end / seconds * steps)))
        else:
            frames = len(mapping) - 1
            low = mapping[max(0, min(frames - 1, math.floor(start / seconds * frames)))]
            high = min(steps - 1, mapping[max(1, min(frames, math.ceil(end / seconds * frames))) - 1] + 1)
        low = max(previous, low)
        if low >= steps or high <= low:
            return previous, out, "outside usable steps"
        high = min(steps, max(high, low + len(ids)))
        if high - low < len(ids):
            return previous, out, "too few steps for its tokens"
        out.append((low, high, ids))
        previous = high
    return previous, out, None


def loop_runs(spans, steps, pad):
    frames = [pad] * steps
    for low, high, ids in spans:
        edges = [math.floor(k * ((high - low) / len(ids)) + low) for k in range(len(ids))] + [high]
        for token, a, b in zip(ids, edges, edges[1:]):
            frames[a:b] = [token] * (b - a)
    return [(t, len(list(g))) for t, g in itertools.groupby(frames)]


@pytest.mark.parametrize("mapped", [False, True])
def test_alignment_equals_the_loop(spark, mapped):
    rng, rows = random.Random(3 + mapped), []
    for k in range(300):
        n, at, words = rng.choice([0, 1, 2, 5, 12]), 0.0, []
        seconds = float(rng.choice([1, n or 1, 3]))
        for _ in range(n):
            gap = rng.random() * seconds / n * 1.2
            odd = rng.random()
            words.append((" ", at, at + 0.2, [1]) if odd < 0.03 else ("x", None, at, [1]) if odd < 0.05 else ("w", at, at + gap, [rng.randint(1, 4) for _ in range(rng.randint(0, 3))] + [101]))
            at += gap
        mapping = None
        if mapped:
            mapping = [0]
            for _ in range(rng.randint(1, 3 * n + 2)):
                mapping.append(mapping[-1] + (rng.random() < 0.7))
        rows.append((k, words, mapping[-1] if mapped else rng.choice([n * 4 + 1, n * 2 + 2, 5]), seconds, mapping))
    df = spark.createDataFrame(rows, "k int, words array<struct<text:string,start:double,end:double,ids:array<int>>>, steps int, seconds double, map array<int>").repartition(3)
    found = df.withColumn("s", alignment.word_spans(F.col("words"), F.col("steps"), F.col("seconds"), F.col("map") if mapped else None))
    for r in found.withColumn("r", alignment.runs_from_spans(F.col("s.spans"), F.col("steps"), 100)).collect():
        words, steps, seconds, mapping = rows[r["k"]][1:]
        previous, spans, error = loop_spans(words, steps, seconds, mapping)
        assert (r["s"]["previous_end"], [(p["low"], p["high"], p["ids"]) for p in r["s"]["spans"]], r["s"]["error"]) == (previous, spans, error)
        assert [tuple(x) for x in r["r"]] == loop_runs(spans, steps, 100)
    assert {r["s"]["error"] for r in found.collect()} > {None, "outside usable steps", "too few steps for its tokens", "invalid timestamp"}


def test_patches_in_a_row_equal_patches_of_rows(spark):
    rng = random.Random(6)
    rows = []
    for doc in range(30):
        at, placed = rng.choice([0, 0, 1, 2]), []
        for word in range(rng.randint(1, 9)):
            n = rng.randint(1, 4)
            placed.append((word, at, at + n, [rng.randint(1, 90) for _ in range(rng.randint(0, 5))]))
            at += n + rng.choice([0, 1, 1, 2])
        rows.append((doc, placed, at + 1 + rng.choice([-1, 0, 1])))
    df = spark.createDataFrame(rows, "doc int, words array<struct<word:int,start:int,end:int,tokens:array<int>>>, length int")
    inside = df.select("doc", F.explode(alignment.patch_array(F.col("words"), F.col("length"), 101)).alias("x")).select("doc", "x.*")
    flat = df.select("doc", "length", F.posexplode("words").alias("i", "w"), F.col("words")).select("doc", "length", "w.*", F.get("words", F.col("i") + 1)["start"].alias("next_start"))
    outside = alignment.aligned_patches(flat, ["doc"], 101)
    assert sorted(map(tuple, inside.collect())) == sorted(map(tuple, outside.collect()))


@pytest.mark.parametrize("by", [None, ["k"]])
def test_bounded_fill_equals_a_loop(spark, by):
    rng = random.Random(3)
    rows = [(rng.choice("abc"), p, rng.choice([0, 1, 5, 9, 30])) for p in range(500)]
    df = spark.createDataFrame(rows, "k string, place long, size long").repartition(5)
    want = {}
    for key in sorted({r[0] for r in rows}) if by else [None]:
        number, used = 0, 0
        for k, p, s in rows:
            if by and k != key:
                continue
            if used > 0 and used + s > 20:
                number, used = number + 1, 0
            used += s
            want[p] = number
    assert {r["place"]: r["bin"] for r in planning.bounded_fill(df, 20, by).collect()} == want


def test_drawn_shots_are_different_others(spark):
    pool = spark.range(50).select((F.col("id") * 3).alias("index"))
    got = evaluation.draw_shots(pool, 4, 9).collect()
    by = {}
    for r in got:
        by.setdefault(r["index"], {})[r["shot"]] = r["other"]
    assert len(by) == 50 and all(sorted(x) == [1, 2, 3, 4] and len({*x.values(), k}) == 5 for k, x in by.items())
    assert len({tuple(x.values()) for x in by.values()}) > 45  # drawn for each one anew
    few = evaluation.draw_shots(pool.limit(3), 4, 9).groupBy("index").count().collect()
    assert {r["count"] for r in few} == {2}
    assert evaluation.draw_shots(pool.limit(1), 4, 9).count() == 0
