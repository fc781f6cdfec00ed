"""Encoders, page layout, word reconstruction, metadata."""

import pytest
from pyspark.sql import functions as F

from weft.operators import modalities as m


def test_encoders_and_memo(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "é"), (3, ""), (4, None), (5, "ab")], "k int, t string")
    got = {r["k"]: r["codes"] for r in m.encode(df, "t", "bytes").collect()}
    assert got == {1: [[97], [98]], 2: [[0xC3], [0xA9]], 3: [], 4: None, 5: [[97], [98]]}
    assert {r["k"]: r["codes"] for r in m.encode(df, "t", "characters").collect()}[1] == [[97], [98]]


def test_mono_segment_and_patches(spark):
    row = spark.range(1).select(
        m.mono_segment(F.array(*(F.array(F.lit(float(i)), F.lit(float(i + 2))) for i in range(6))), F.lit(2), F.lit(0.5), F.lit(1.0)).alias("s"),
        m.image_patches(F.array(*(F.array(*(F.lit(10 * r + c) for c in range(4))) for r in range(2))), 2).alias("p"),
    ).first()
    assert row["s"] == [2.0, 3.0] and row["p"] == [[0, 1, 10, 11], [2, 3, 12, 13]]


def test_evaluator_spans(spark):
    df = spark.createDataFrame([([("a", 0.0, 0.4), ("bad", 0.5, 0.4), ("b", 0.4, 0.8), ("late", 0.95, 1.0)], [0, 0, 0, 1, 2, 2, 2, 3, 4, 4, 5])], "w array<struct<text:string,start:double,end:double>>, runs array<int>")
    got = df.select(m.evaluator_spans(F.col("w"), F.lit(6), F.lit(10), F.lit(1.0), F.col("runs")).alias("s")).first()["s"]
    assert [tuple(x) for x in got] == [("a", 0, 2), ("b", 2, 4), ("late", 4, 5)]


def test_page_layout(spark):
    words = F.array(F.lit("abc"), F.lit("de"), F.lit("f"))
    width = lambda b: F.length(b) * 8
    full, short = (spark.range(1).select(m.page_layout(words, width, n).alias("p")).first()["p"] for n in (64, 4))
    assert full["starts"] == [0, 2, 3, 4] and full["length"] == 5 and full["words"] == ["abc", "de", "f"]
    assert short["words"] == ["abc", "de"] and short["length"] == 4


def test_words_and_chunks(spark):
    rows = [(1, i, t, d) for i, (t, d) in enumerate([(97, 2), (101, 1), (100, 3), (98, 1), (99, 1), (101, 2), (97, 5)])]
    words = m.words_of_runs(spark.createDataFrame(rows, "k int, place int, token int, duration int"), ["k"], 101, [100])
    assert [tuple(r)[1:] for r in words.orderBy("word").collect()] == [(0, [97], 0, 3), (1, [98, 99], 3, 10)]
    many = spark.range(18).select(F.lit(1).alias("k"), F.col("id").alias("word"), F.array(F.lit(5)).alias("tokens"), (F.col("id") * 4).alias("start"), (F.col("id") * 4 + 4).alias("end"))
    assert [(r["modality"], r["positions"]) for r in m.chunk_labels(many, ["k"]).orderBy("chunk").collect()] == [("text", 10), ("speech", 25), ("text", 3)]


def test_prompts_and_metadata(spark):
    row = spark.range(1).select(m.text_prompt(F.array(F.lit(7), F.lit(8)), 1, 2, 3, 1).alias("p"), m.generated_codes(F.array(*(F.array(F.lit(i), F.lit(10 + i)) for i in range(5))), F.lit(2), 1).alias("g"), m.merge_parts(F.array(F.lit("b")), F.array(F.lit("a"), F.lit("b"))).alias("n")).first()
    assert row["p"] == [[7, 1, 1, 3], [8, 1, 1, 3]] and row["g"] == [[13], [14]] and row["n"] == ["a", "b"]
    table = spark.createDataFrame([("x", "1")], "name string, content string")
    assert m.add_metadata(table, spark.createDataFrame([("x", "1"), ("y", "2")], table.schema)).count() == 2
    with pytest.raises(Exception, match="metadata conflict"):
        m.add_metadata(table, spark.createDataFrame([("x", "9")], table.schema)).collect()
