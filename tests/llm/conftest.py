import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, label int, score double, key string, row long, block long, x double, stretch int, held boolean, print long, a long, b long"


def build(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), 1, 0, 0.5, "k", 9, 9, 0.1, 2, True, 5, 1, 2) for i, t, s in rows], SCHEMA)


TEXTS = [
    "the cat sat on the mat and the cat sat on the mat again, said the cat",
    "The Cat sat on the mat and the cat sat on the mat again, said the cat",
    "",
    None,
    " \n\t ",
    "one",
    "Ünïcode straße été 中文 text with emoji 👍🏽 and \u0085 odd\u00a0space",
    "line one\nline two\nline one\n\nline two\nlast",
    "it's 12 o'clock; don't panic <|endoftext|> ok",
    "word " * 3000,
    "x" * 20000,
    "#hash *star* $dollar% &and| <tag>",
]


@pytest.fixture(scope="session")
def edge_rows():
    rows = [(k, t, f"src{k % 3}" if k % 5 else None) for k, t in enumerate(TEXTS)]
    return rows + [(0, TEXTS[0], None), (None, TEXTS[0], "src1"), (None, None, None), (40, TEXTS[5], ""), (41, TEXTS[5], "src9")]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return build(spark, edge_rows).repartition(3)


@pytest.fixture(scope="session")
def empty_docs(spark):
    return build(spark, [])


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(k, int(k % 2 == 0), 0, "z") for k in range(12)] + [(None, 1, 0, "z"), (3, None, 0, "z"), (5, 7, 0, "z")], "doc_id long, quality int, toxic int, text string")


@pytest.fixture(scope="session")
def corpus(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def corpus_labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")
