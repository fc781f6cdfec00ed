"""Crafted cases of the training-data operators: colliding strings, odd code points, malformed images, hot keys, clashing names."""

import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_training_data import TRICKS, brute_components, brute_facts, brute_targets, brute_verdict, words

from weft.llm import chat, common, kernel, lm, media, mixing, packing, quality_rules, queries, simhash, url_filters


def thue_morse(n):
    """The first n signs of the sequence and their complement: equal under any polynomial modulo a power of two."""
    signs = ["ab"[k.bit_count() % 2] for k in range(n)]
    return "".join(signs), "".join(signs).translate(str.maketrans("ab", "ba"))


# kernel


@pytest.mark.parametrize("n", [8, 64, 1024, 4096])
def test_identities_tell_thue_morse_strings_apart(n):
    a, b = thue_morse(n)
    h = kernel.Block([f"{a} {b} {a}".encode()]).word_hashes()
    assert h[0] == h[2] != h[1]
    text = f"{a}\n{b}\n{a}\n{b} {a} {b} {a}"
    facts = kernel.text_facts(kernel.Block([text.encode()]))
    assert tuple(int(facts[k][0]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute_facts(text)[:5]


def test_identities_depend_on_bytes_alone():
    rng = random.Random(1)
    names = ["".join(rng.choice("aé中👍") for _ in range(rng.randint(1, 40))) for _ in range(300)] + ["x" * n for n in (1, 7, 8, 9, 16, 127, 128, 129, 600)]
    h = kernel.Block([" ".join(names).encode()]).word_hashes()
    again = kernel.Block([b"zz " + n.encode() for n in names])
    assert h.tolist() == again.word_hashes()[1::2].tolist()
    assert len(set(h.tolist())) == len(set(names))
    assert kernel.span_hashes(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)).tolist() == []


def test_character_grams_are_whole_code_points():
    docs = ["aé中", "", "x", "👍b👍b👍"]
    b = kernel.Block([d.encode() for d in docs])
    for n, (key, doc) in zip((1, 3, 4), kernel.char_grams(b, 1, 3, 4), strict=True):
        want = [(d, t[i : i + n]) for d, t in enumerate(docs) for i in range(len(t) - n + 1)]
        assert doc.tolist() == [d for d, _ in want]
        names = {}
        assert all(names.setdefault(g, k) == k for (_, g), k in zip(want, key.tolist(), strict=True)) and len(set(names.values())) == len(names)


# 1 url filters


def test_many_rules_are_fetched_by_a_join(spark):
    rules = (*url_filters.RULES, *(url_filters.Rule("block", f"^bad{k}^", False) for k in range(600)))
    urls = [f"https://www.h{k % 7}.org/x/bad{k}/" for k in range(0, 700, 7)] + ["http://example.com/en/", "https://www.a.com/", None, ""]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for r in url_filters.judge(pages, rules).collect():
        url = urls[r["page_id"]]
        want = brute_verdict(url)
        if want[2] is None and url and any(f"/bad{k}/" in url for k in range(600)):
            want = (*want[:3], "block")
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == want
    plan = url_filters.judge(pages, rules)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan  # a frequent token gathers no rows
    with pytest.raises(ValueError, match="longer"):
        url_filters.judge(pages, (url_filters.Rule("block", "x" * 3000, False),))


# 2 media

MALFORMED = [b"P5 99999999999 99999999999 255\n", b"P5 999999999 999999999 255\n\0", b"P2 1 1 255 " + b"3" * 25, b"P2 1 1 255 300", b"P2 1 1 255 -5", b"P1 2 1 3 7", b"P5 2 1 15\n\x10\x01", b"P6", b"P5 4 4 255\nab", b"BM", b"BM" + bytes(60)]


def test_malformed_images_are_errors(spark):
    rows = [(k, x) for k, x in enumerate(MALFORMED)]
    for r in media.media_columns(spark.createDataFrame(rows, "k int, image binary")).collect():
        assert r["error"] and r["tile"] is None and r["dhash"] is None
    rng = np.random.default_rng(2)
    good = [media.encode_bmp(rng.integers(0, 256, (5, 7, 3), np.uint8)), media.encode_pgm(bytes(48), 24), b"P2\n3 2\n9\n1 2 3 4 5 6"]
    broken = []
    for k in range(600):
        x = bytearray(good[k % 3])
        for _ in range(3):
            x[rng.integers(0, len(x))] = rng.integers(0, 256)
        broken.append((k, bytes(x[: rng.integers(1, len(x))] if k % 4 == 0 else x)))
    assert media.media_columns(spark.createDataFrame(broken, "k int, image binary")).where("(error is null) = (tile is null)").count() == 0


def test_samples_are_scaled_to_the_full_range():
    assert media.decode(b"P5 2 1 15\n\x0f\x01").tolist() == [[255, 17]]
    assert media.decode(b"P2\n2 1\n3\n3 1").tolist() == [[255, 85]]
    assert media.decode(b"P2\n2 1\n1023\n1023 0").tolist() == [[65535, 0]]


def test_stripes_do_not_change_the_resize(monkeypatch):
    rng = np.random.default_rng(5)
    for shape in ((997, 24), (3, 1201), (400, 50, 3)):
        image = rng.integers(0, 256, shape, np.uint8)
        whole = media.area_resize(image, 8, 9)
        monkeypatch.setattr(media, "STRIPE", 101)
        assert np.allclose(media.area_resize(image, 8, 9), whole)
        monkeypatch.undo()
        exact = image.astype(float).mean((0, 1))
        assert np.allclose(media.area_resize(image, 1, 1)[0, 0], exact)


def test_features_of_real_payloads(corpus):
    """Tile and difference hash of the stored form, computed anew from the payload's own means."""
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in corpus.collect()}
    for r in media.text_media(corpus).collect():
        image = np.frombuffer(media.payload(texts[r["doc_id"]]), np.uint8).reshape(-1, media.SIDE).astype(float)
        small = np.round(area_means(image, 8, 9), 6)
        assert r["feature"] == np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def area_means(image, height, width):
    """Weighted means by overlap matrices."""

    def overlaps(size, n):
        edge = np.arange(n + 1) * size / n
        low, high = edge[:-1, None], edge[1:, None]
        at = np.arange(size)[None, :]
        return np.clip(np.minimum(high, at + 1) - np.maximum(low, at), 0, 1) * n / size

    return overlaps(image.shape[0], height) @ image @ overlaps(image.shape[1], width).T


# 3 quality rules


def test_base_counts_of_crafted_lines(spark, labels):
    a, b = thue_morse(2048)
    texts = [f"{a}\n{b}\n", f"{a} {b} {a} {b}", "é è\né è\nè é", f"x{a}\nx{b}\nx{a}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs, labels).collect()}
    for k, t in enumerate(texts):
        assert (got[k]["n_words"], got[k]["word_chars"], got[k]["n_symbols"], got[k]["n_dup_lines"], got[k]["n_repeat_words"], got[k]["base_failed"]) == brute_facts(t)


# 4 packing


def test_every_code_point_is_encoded_as_by_the_tokenizer():
    encoder = packing.TokenEncoder(queries.tokenizer_path())
    points = [*range(1, 0xD800), *range(0xE000, 0x32400), *range(0xE0000, 0xE0200), *range(0xF0000, 0xF0010), 0x10FFFD, 0x10FFFF]
    wrong = []
    for low in range(0, len(points), 20000):
        part = points[low : low + 20000]
        texts = [f"a{chr(c)}b {chr(c)}1 x{chr(c)}" for c in part]
        whole = encoder.whole.encode_batch_fast(texts, add_special_tokens=False)
        wrong += [hex(c) for c, mine, theirs in zip(part, encoder.encode(texts), whole, strict=True) if mine.tolist() != theirs.ids]
    assert not wrong


def test_long_pieces_keep_their_own_ids():
    encoder = packing.TokenEncoder(queries.tokenizer_path())
    a, b = thue_morse(2048)
    for mine, theirs in zip(encoder.encode([f"{a} {b}", b, a]), encoder.whole.encode_batch_fast([f"{a} {b}", b, a], add_special_tokens=False), strict=True):
        assert mine.tolist() == theirs.ids


def test_the_index_fills_gaps_exactly_where_that_is_possible():
    rng = random.Random(4)
    for _ in range(60):
        capacity = rng.choice([12, 40])
        counts = Counter(rng.randint(1, capacity) for _ in range(rng.randint(1, 60)))
        left = np.zeros(capacity + 1, np.int64)
        for k, n in counts.items():
            left[k] = n
        top = max(counts)
        gap, taken, sums = capacity - top, Counter((top,)), packing.Sums(left)
        free = sorted((counts - taken).elements(), reverse=True)
        pairs = {(x, y) for i, x in enumerate(free) for y in free[i + 1 :] if x + y == gap}
        triples = {(x, y, z) for i, x in enumerate(free) for j, y in enumerate(free[i + 1 :], i + 1) for z in free[j + 1 :] if x + y + z == gap}
        if gap:
            assert sums.single(gap, taken) == ((gap,) if gap in free else None)
            assert sums.pair(gap, taken) == max(pairs, default=None)
            assert sums.triple(gap, taken) == max(triples, default=None)


# 5 mixing


def test_equal_rows_spread_over_many_blocks(spark):
    docs = spark.range(20_000, numPartitions=6).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one two three").alias("text"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"))
    sizes = docs.select(F.xxhash64("source").alias("h"), F.monotonically_increasing_id().alias("row"), F.spark_partition_id().alias("task"))
    numbers = mixing.equals_number(common.materialize(sizes, "test")).toPandas()
    assert Counter(numbers["equal"]) == Counter([*range(6667), *range(13333)])
    got = mixing.mixture(docs).toPandas()
    target = brute_targets({"a": 6667 * 3, "b": 13333 * 3})
    assert got.groupby("source_size")["taken"].sum().to_dict() == pytest.approx({6667 * 3: target["a"], 13333 * 3: target["b"]}, abs=3)
    assert (got["taken"] <= 9).all()


def test_blocks_of_equal_rows_are_small(spark, monkeypatch):
    seen = []
    fold = mixing._fold

    def spy(rows, keys, step):
        seen.append(rows.groupBy(*keys).count().agg(F.max("count")).first()[0])
        return fold(rows, keys, step)

    monkeypatch.setattr(mixing, "_fold", spy)
    docs = spark.range(20_000, numPartitions=4).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one two three").alias("text"), (F.col("id") % 2).cast("string").alias("source"))
    mixing.mixture(docs).count()
    assert seen and max(seen[:-1]) < 4 * mixing.BLOCK


@pytest.mark.parametrize("seed", range(4))
def test_targets_of_many_sources(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{k:03d}": rng.choice([0, 1, 5, 50, 5000]) for k in range(rng.choice([1, 2, 40]))}
    df = spark.createDataFrame([(f"0{n}", s) for n, s in sizes.items()], "name string, size long").repartition(5)
    got = {r["name"][1:]: r["target"] for r in mixing.source_targets(df).collect()}
    want = brute_targets(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0.0)
    assert got == pytest.approx(want, rel=1e-9)


CLASHING = ("__key", "__copies", "__rows", "__number", "__copy", "file", "place", "copies", "copy", "of_file", "of_place", "row", "class", "h", "kept0", "kept1", "task", "number", "print", "root", "least")


def clashing(docs):
    return docs.select("*", *(F.concat(F.lit(f"{c}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in CLASHING if c not in docs.columns))


@pytest.mark.parametrize("stored", [False, True])
def test_names_of_columns_do_not_matter(spark, edge_docs, tmp_path, stored):
    docs = clashing(edge_docs)
    if stored:
        docs.write.parquet(str(tmp_path / "docs"))
        docs = spark.read.parquet(str(tmp_path / "docs"))
    plain = docs.select(*edge_docs.columns)
    for operator in (simhash.survivors, mixing.mixed_documents):
        wide, narrow = operator(docs), operator(plain)
        assert wide.columns == docs.columns
        assert wide.exceptAll(docs.crossJoin(spark.range(3)).drop("id")).isEmpty()
        assert Counter(map(str, wide.select(*edge_docs.columns).collect())) == Counter(map(str, narrow.collect()))


def test_stored_and_unstored_rows_are_identified_alike(spark, corpus, tmp_path):
    corpus.repartition(3).write.parquet(str(tmp_path / "docs"))
    stored = spark.read.parquet(str(tmp_path / "docs"))
    a, b = common.identified(stored, "f", "r"), common.identified(stored.where("doc_id is not null"), "f", "r")
    assert a.select("f", "r").distinct().count() == b.select("f", "r").distinct().count() == corpus.count()
    assert a.where("length(text) > 100").select("f", "r", "doc_id").exceptAll(a.select("f", "r", "doc_id")).isEmpty()


# 6 chat

HASHES = [*TRICKS, "#", "##", "####", "#####", "\\####", "#\\##", "</turn", "<</turn>", "<\\/turn>", "</turn>\\", "a ### b: c", "\\### Assistant: </turn> ok"]


def test_no_control_string_stands_inside_a_text(spark):
    rows = [("t", i + 1, i or None, ("user", "assistant", "r###o</turn>le:")[i % 3], t, 0.0) for i, t in enumerate(HASHES)]
    nodes = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    formatted = chat.format_paths(chat.paths(nodes)).first()["formatted"]
    assert [x[:2] for x in chat.read_back(formatted)] == [(x[3], x[4]) for x in rows]
    assert formatted.count("###") == formatted.count("</turn>") == len(rows)  # the template's own
    for _, _, s, e in chat.read_back(formatted):
        assert "###" not in formatted[s:e] and "</turn>" not in formatted[s:e]


# 7 language model


def test_score_of_a_text_is_class_part_and_word_part(spark):
    """With one state the score is a product of class shares and shares within the class."""
    texts = [(k, " ".join(random.Random(k).choices("a b c d e é".split(), k=k))) for k in range(40)] + [(40, None), (41, "unseen words here")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % lm.FOLDS == lm.HELD_FOLD
    h = {w: int(kernel.Block([w.encode()]).word_hashes()[0]) for _, t in texts for w in words(t)}
    kind = lambda w: lm.CLASSES if w is None else h[w] % lm.CLASSES
    count = Counter(w for i, t in texts if not held(i) for w in [*words(t), None])
    tokens, mass = Counter(), defaultdict(lambda: 1)
    for w, n in count.items():
        tokens[kind(w)] += n
        mass[kind(w)] += n + 1
    total, everything = sum(count.values()), sum(mass.values()) + lm.CLASSES + 1 - len(mass)
    share = lambda k: (tokens[k] + lm.PRIOR * mass[k] / everything) / (total + lm.PRIOR)
    inside = lambda w: 1.0 if w is None else (count[w] + 1) / mass[kind(w)]
    for r in lm.language_scores(docs, states=1).collect():
        ws = [*words(texts[r["doc_id"]][1]), None]
        assert r["score"] == pytest.approx(sum(np.log10(share(kind(w)) * inside(w)) for w in ws), abs=1e-3)


def test_eight_states_beat_one_on_held_out_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet")
    gain = [lm.language_scores(docs, states=k).where("held_out").agg(F.sum("score") / F.sum("n_tokens")).first()[0] for k in (1, 8)]
    assert gain[1] > gain[0] + 0.15  # log10 a token


# 10 SimHash


@pytest.mark.parametrize("checks", range(6))
def test_every_code_finds_all_links(spark, checks):
    rng = random.Random(checks)
    prints = set()
    for _ in range(20):
        base = rng.getrandbits(64)
        for _ in range(12):
            x = base
            for k in rng.sample(range(64), rng.randint(0, 6)):
                x ^= 1 << k
            prints.add(x)
    df = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in prints], "print long")
    root = {r["node"] % 2**64: r["root"] % 2**64 for r in simhash.components(simhash.links(df, checks=checks)).collect()}
    want = brute_components({(p, 0): p for p in prints})
    have = defaultdict(set)
    for p in prints:
        have[root.get(p, p)].add(p)
    groups = defaultdict(set)
    for (p, _), k in want.items():
        groups[k].add(p)
    assert sorted(map(sorted, have.values())) == sorted(map(sorted, groups.values()))


def test_the_code_follows_the_number_of_fingerprints():
    chosen = [simhash.check_bits(10**k) for k in range(4, 12)]
    assert chosen[0] == simhash.CHECK_BITS and chosen[-1] == 1 and chosen == sorted(chosen, reverse=True)
    for n in (10**5, 10**7, 10**8):
        checks = simhash.check_bits(n)
        anchors = sum(1 << bits - checks for _, bits in simhash.PARTS)
        assert n * simhash.copies(checks) / anchors <= simhash.GROUP
    prints = np.random.default_rng(3).integers(0, 2**63, 50_000).astype(np.uint64)
    for checks in (0, 3, 5):
        assert len(simhash.anchor_rows(prints, checks)[0]) / len(prints) == pytest.approx(simhash.copies(checks), rel=0.02)


def test_long_texts_are_fingerprinted_in_pieces(monkeypatch):
    texts = pa.array(["w " * 50 + " ".join(f"x{k % 97}" for k in range(700)), "", None, "one two", " ".join(f"y{k}" for k in range(90))])
    whole = simhash.fingerprints(texts)
    monkeypatch.setattr(simhash, "SHINGLES_AT_ONCE", 64)
    assert simhash.fingerprints(texts).tolist() == whole.tolist()


def test_one_fingerprint_may_hold_most_rows(spark):
    docs = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, F.lit("")).otherwise(F.concat_ws(" ", *(F.md5(F.concat((F.col("id") % 500).cast("string"), F.lit(k))) for k in "abcdef"))).alias("text"))
    got = simhash.near_duplicates(docs.withColumnRenamed("id", "doc_id")).toPandas()
    assert len(got) == 6000 and (got[got["doc_id"] % 3 == 0]["component_id"] == 0).all()
    assert simhash.survivors(docs.withColumnRenamed("id", "doc_id")).count() == got["component_id"].nunique()


# SQL for the parts that it can express

WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
PARTS = {
    "op3_quality_rules": rf"select doc_id, len({WORDS_SQL}) as n_words, list_sum(list_transform({WORDS_SQL} || [''], lambda w: length(w))) as word_chars, len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) as n_symbols from documents",
    "op5_mixing": f"with s as (select doc_id, source, len({WORDS_SQL}) as size from documents) select doc_id, size, (sum(size) over (partition by source))::bigint as source_size from s",
    "op7_lm_scoring": f"select doc_id, len({WORDS_SQL}) + 1 as n_tokens from documents",
    "op8_sharding": """with s as (select doc_id, strlen(coalesce(text, '')) + 16 as size from documents), p as (select *, (sum(size) over (order by doc_id))::bigint - size as begin, (sum(size) over ())::bigint as total from s),
      c as (select doc_id, size, least((2 * begin + size) * 40 // (2 * total), 39)::int as shard from p) select *, row_number() over (partition by shard order by doc_id) - 1 as slot from c""",
}


@pytest.mark.parametrize("name", sorted(PARTS))
def test_parts_equal_sql(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    theirs = con.sql(PARTS[name]).df()
    ours = queries.queries()[name](spark, sf).select(*theirs.columns).toPandas()
    order = ["doc_id"]
    pd.testing.assert_frame_equal(ours.sort_values(order).reset_index(drop=True), theirs.sort_values(order).reset_index(drop=True), check_dtype=False)


# pipeline


def test_pipeline_stages_on_edge_rows(spark, sf, edge_docs, edge_rows):
    """What each stage does with null, empty, repeated and very long texts."""
    pipeline = pytest.importorskip("corpus_pipeline")
    stages = dict(pipeline.STAGES)
    for name in ("quality classifier", "quality rules"):
        out = stages[name](spark, edge_docs, sf)
        assert out.columns == edge_docs.columns and out.exceptAll(edge_docs).isEmpty()
    assert stages["quality rules"](spark, edge_docs, sf).where("text is null or length(text) < 50").isEmpty()
    rows = stages["near duplicates"](spark, edge_docs, sf).collect()
    prints = {(i, k): simhash.fingerprints(pa.array([t]))[0] for k, (i, t, _) in enumerate(edge_rows)}
    assert len(rows) == len(set(brute_components({(k, 0): int(p) for (_, k), p in prints.items()}).values()))
    mixed = stages["mixing"](spark, edge_docs, sf)
    assert mixed.columns == edge_docs.columns and mixed.where("text is null").count() <= edge_docs.where("text is null").count()
    assert mixed.where(F.regexp_count("text", F.lit(common.WORD)) > 0).count() == sum(r["copies"] for r in mixing.mixture(edge_docs).collect() if r["size"])
    packed = stages["packing"](spark, edge_docs, sf)
    assert packed.select("doc_id", "piece", "ids_crc32").count() >= len(edge_rows) and packed.where("length < 1 or length > 2048").isEmpty()
