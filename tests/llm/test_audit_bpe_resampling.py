"""The filter audit, byte-level encoding and importance resampling against SQL and brute-force versions, with the edge cases."""

import hashlib
import itertools
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weft.llm import audit, bpe, kernel, quality_rules, queries, ranking, resampling
from weft.llm.common import materialize

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
FEATURES = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("name", ["op11_filter_interaction_audit", "op13_importance_resampling"])
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for file in os.listdir(sf):
        con.execute(f"create view {file.removesuffix('.parquet')} as select * from '{sf}/{file}'")
    theirs, ours = con.sql(queries.oracle_sql()[name]).df(), queries.queries()[name](spark, sf).toPandas()
    columns = sorted(theirs.columns)
    assert sorted(ours.columns) == columns
    frames = [f[columns].sort_values(columns).reset_index(drop=True) for f in (ours, theirs)]
    pd.testing.assert_frame_equal(*frames, check_dtype=False)


# filter audit


def brute_audit(rows, told):
    """rows: (doc_id, text, source); told: doc_id to (good, toxic). One loop over every order of the filters."""
    smallest = {}
    for i, t, _ in rows:
        if i is not None:
            smallest[t or ""] = min(i, smallest.get(t or "", i))
    failed = []
    for i, t, s in rows:
        t = t or ""
        w = WORDS.findall(t)
        f = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > smallest[t]}
        failed.append((s or "", {k for k, v in f.items() if v}, *told.get(i, (False, False))))
    out, shares = {}, Counter()
    for order in itertools.permutations("ABCDE"):
        for part in {f[0] for f in failed}:
            for step, letter in enumerate(order, 1):
                here = [f for f in failed if f[0] == part]
                gone = [f for f in here if letter in f[1] and not f[1] & set(order[: step - 1])]
                out[part, "".join(order), step] = (
                    sum(not f[1] & set(order[:step]) for f in here), len(gone), sum(letter in f[1] and bool(f[1] & set(order[: step - 1])) for f in here),
                    sum(f[1] == {letter} for f in here), sum(f[2] for f in gone), sum(f[3] for f in gone),
                )
                shares[part, letter] += len(gone)
    return {k: (*v, shares[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def told_of(labels):
    out = defaultdict(lambda: (False, False))
    for r in labels.collect():
        good, toxic = out[r["doc_id"]]
        out[r["doc_id"]] = (good or r["quality"] == 1, toxic or r["toxic"] == 1)
    out.pop(None, None)
    return out


def test_audit_of_edge_rows_equals_brute_force(spark, edge_docs, edge_rows, labels, empty_docs):
    rows = edge_rows + [(90 + k, "A B c $ " * 20, "src1") for k in range(3)] + [(91, "A B c $ " * 20, None)]
    docs = edge_docs.unionByName(spark.createDataFrame([(i, t, s) for i, t, s in rows[len(edge_rows) :]], "doc_id long, text string, source string"), allowMissingColumns=True)
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in audit.filter_audit(docs, labels).collect()}
    assert got == brute_audit(rows, told_of(labels))
    assert audit.filter_audit(empty_docs, labels).isEmpty()
    nothing = audit.filter_audit(edge_docs, labels.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost"), F.count("*")).first()
    assert tuple(nothing) == (0, 0, 600 * len({s or "" for _, _, s in edge_rows}))


def test_outcomes_add_up():
    m = audit.matrices("ABCDE")
    assert all(m[k].shape == (32, 600) for k in ("kept", "removed", "redundant", "unique"))
    step = np.tile(np.arange(5), 120)
    assert (m["kept"][:, step == 4].sum(axis=1) == np.array([120] + [0] * 31)).all()
    assert ((m["removed"].reshape(32, 120, 5).sum(axis=2) + m["kept"].reshape(32, 120, 5)[:, :, 4]) == 1).all()
    assert (m["removed"] @ m["shares"])[31].tolist() == [24] * 5  # a document that fails all is shared equally


def test_one_text_may_hold_most_rows(spark):
    rows = spark.range(3000).select((F.col("id") % 1000).alias("doc_id"), F.lit("same words $").alias("text"), F.when(F.col("id") % 2 == 0, "a").alias("source"))
    out = audit.filter_audit(rows, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    got = {r["part"]: (r["removed"], r["kept"]) for r in out.where("filter_order = 'EABCD' and step = 1").collect()}
    assert got == {"a": (1497, 3), "": (1500, 0)}  # three rows have the smallest id


# byte-level encoding


@pytest.fixture(scope="module")
def vocabulary():
    return queries.tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def whole(vocabulary):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary)


def plain(ids):
    return (ids & ~bpe.MARK).tolist()


ALPHABETS = ["a", "ab", "a ", " '", "'s re've'll x", "   a\n", "\n \t x", "é中 a", "1234 a", "!?.'\"", "　 \u0085a ", "abcdefgh etaoin", "😀a👍🏽"]


@pytest.mark.parametrize("seed", range(4))
def test_trees_and_joins_equal_the_tokenizer(vocabulary, whole, seed):
    rng, small = random.Random(seed), bpe.ByteBpe(vocabulary, leaf=8)
    for _ in range(250):
        letters = "".join(rng.sample(ALPHABETS, rng.choice([1, 1, 2])))
        pool = [*letters, *rng.choice([[], [], ["<|endoftext|>", "<|endof"]])]
        text = "".join(rng.choice(pool) for _ in range(rng.choice([1, 5, 20, 60, 200])))
        want = whole.encode(text, add_special_tokens=False).ids
        tree = small.tree(text.encode())
        assert plain(tree) == want, repr(text)
        assert (tree == small.plain([text.encode()])[0]).all(), repr(text)
        assert [plain(x) for x in small.encode([text.encode(), b"", text.encode()])] == [want, [], want]
        assert small.decode(tree) == text
        if len(text) <= 20 and "<|" not in text:
            for k in range(1, len(text)):
                assert plain(small.join(*small.plain([text[:k].encode(), text[k:].encode()]))) == want, (text, k)


@pytest.mark.parametrize("text", ["x" * 40_000, "ab" * 20_001, "\n" * 20_001 + "x", "中文字" * 9000, "!?" * 9000 + "'s", "aé" * 9000 + "<|endoftext|>" + "b" * 9000], ids=range(6))
def test_unsplit_text_of_many_leaves(vocabulary, whole, text):
    assert plain(bpe.ByteBpe(vocabulary, leaf=1024).tree(text.encode())) == whole.encode(text, add_special_tokens=False).ids


def test_every_code_point_is_encoded_as_by_the_tokenizer(vocabulary, whole):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    coder = bpe.ByteBpe(vocabulary)
    for form in ("{0} {0}", "a{0}\n{0}'s"):
        texts = ["".join(form.format(c) for c in points[k : k + 997]) for k in range(0, len(points), 997)]
        assert [plain(x) for x in coder.encode([t.encode() for t in texts])] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("spread, part", [(1 << 20, 1 << 18), (40, 16)])
def test_digests_equal_the_tokenizer(edge_docs, edge_rows, empty_docs, corpus, vocabulary, whole, spread, part):
    def want(i, text):
        ids = whole.encode(text or "", add_special_tokens=False).ids
        return i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(whole.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    order = lambda rows: sorted(rows, key=str)
    assert order(map(tuple, bpe.digests(edge_docs, vocabulary, spread, part).collect())) == order(want(i, t) for i, t, _ in edge_rows)
    assert bpe.digests(empty_docs, vocabulary, spread, part).isEmpty()
    some = corpus.where("doc_id < 60")
    assert order(map(tuple, bpe.digests(some, vocabulary, spread, part).collect())) == order(want(r["doc_id"], r["text"]) for r in some.collect())


def test_ids_decode_to_the_texts(spark, edge_docs, edge_rows, vocabulary):
    back = bpe.decode(bpe.encode(edge_docs, vocabulary), vocabulary).collect()
    assert sorted(map(str, back)) == sorted(f"Row(doc_id={i}, text={(t or '')!r})" for i, t, _ in edge_rows)
    broken = spark.createDataFrame([(1, [0x1F600 % 50000]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] is None for r in bpe.decode(broken, vocabulary).collect()} == {1: False, 2: True, 3: False}
    odd = spark.sql("select 1L as doc_id, cast(X'61FF62' as string) as text")
    assert bpe.decode(bpe.encode(odd, vocabulary), vocabulary).first()["text"] == "a�b"


def test_tables_of_pieces_are_bounded(vocabulary, whole):
    coder, rng = bpe.ByteBpe(vocabulary, table=50), random.Random(4)
    for _ in range(30):
        text = " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(20))
        assert plain(coder.encode([text.encode()])[0]) == whole.encode(text, add_special_tokens=False).ids
        assert len(coder.slot) <= 50


# importance resampling


def brute_resample(rows, target, longest, least, percent, seed=2024, buckets=10_000):
    def features(text):
        w = FEATURES.findall(lower(text))
        return len(w), [zlib.crc32(" ".join(w[k : k + n]).encode()) % buckets for n in range(1, longest + 1) for k in range(len(w) - n + 1)]

    held = [(i, *features(t)) for i, t in rows]
    s, t = Counter(b for _, _, f in held for b in f), Counter(b for x in target for b in features(x)[1])
    ss, tt = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((float(t[b] + 1) * (ss + buckets)) / (float(s[b] + 1) * (tt + buckets)))) for b in s}
    out = []
    for i, words, f in held:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words >= least))
    ranked = sorted((x for x in out if x[4]), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1], x[2]))
    cut = percent * len(ranked) // 100
    rest = [x for x in out if not x[4]] + ranked[cut:]
    return sorted([(*x[:4], k) for k, x in enumerate(ranked[:cut], 1)] + [(*x[:4], None) for x in rest], key=str)


@pytest.mark.parametrize("longest, least, percent", [(1, 20, 10), (1, 0, 100), (2, 1, 50), (3, 1, 0)])
def test_resampling_of_edge_rows_equals_brute_force(spark, edge_docs, edge_rows, empty_docs, longest, least, percent):
    target = spark.createDataFrame([("the cat and the hat 中文",), (None,), ("",)], "text string")
    got = resampling.resample(edge_docs, target, longest=longest, least=least, percent=percent)
    assert sorted(map(tuple, got.collect()), key=str) == brute_resample([(i, t) for i, t, _ in edge_rows], [r["text"] for r in target.collect()], longest, least, percent)
    assert resampling.resample(empty_docs, target).isEmpty()
    none = resampling.resample(edge_docs, target.limit(0), least=1, percent=50)
    assert sorted(map(tuple, none.collect()), key=str) == brute_resample([(i, t) for i, t, _ in edge_rows], [], 1, 1, 50)


@pytest.mark.parametrize("seed", range(3))
def test_merged_runs_equal_one_sort(seed):
    rng = random.Random(seed)
    for _ in range(150):
        blocks, every = [], []
        for run in range(rng.randint(1, 9)):
            rows = [(*x, n) for x, n in sorted(Counter((rng.randint(-3, 3), rng.random() < 0.1, rng.randint(0, 3), 1, 2) for _ in range(rng.randint(0, 30))).items())]
            every += [x[:5] for x in rows for _ in range(x[5])]
            while rows:
                n = rng.randint(1, 4)
                blocks.append((run, rows[:n]))
                rows = rows[n:]
        draws, first = rng.randint(0, 60), rng.randint(1, 5)
        got = list(resampling.merged(iter(sorted(blocks, key=lambda b: b[1][0][:5])), first, draws))
        n = max(0, min(len(every), draws - first + 1))
        assert [x[:5] for x, rank in got if rank] == sorted(every)[:n]
        assert [rank for _, rank in got if rank] == list(range(first, first + n)) and sorted(x[:5] for x, _ in got) == sorted(every)


@pytest.mark.parametrize("range_rows", [1 << 20, 7])
def test_ranks_of_many_ranges_ties_and_a_hot_id(spark, monkeypatch, range_rows):
    monkeypatch.setattr(resampling, "RUN_BLOCK", 5)
    rng = random.Random(8)
    rows = [(rng.choice([7, 7, None, rng.randint(0, 500)]), rng.choice([3, 20, 21]), rng.choice([20, 21]), 5, rng.randint(0, 40)) for _ in range(3000)]
    rows = [(i, w, f, g, 11 if i == 7 else s) for i, w, f, g, s in rows]
    scored = materialize(spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long, score long").repartition(7), "scored")
    got = [tuple(r) for r in resampling.drawn(scored, 20, 30, range_rows).collect()]
    ranked = sorted(((i, f, g, s) for i, w, f, g, s in rows if w >= 20), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1], x[2]))
    cut = 30 * len(ranked) // 100
    rest = ranked[cut:] + [(i, f, g, s) for i, w, f, g, s in rows if w < 20]
    assert sorted(got, key=str) == sorted([(*x, k) for k, x in enumerate(ranked[:cut], 1)] + [(*x, None) for x in rest], key=str)


def test_hashes_of_words_of_any_length():
    texts = [b"a", b"", b"x" * 63 + b" " + b"x" * 64 + b" " + b"x" * 65 + b" " + b"x" * 5000, "É é 中文-字".encode()]
    _, ((bucket, doc),) = resampling.features(texts)
    want = [(zlib.crc32(w.encode()) % 10_000, d) for d, t in enumerate(texts) for w in FEATURES.findall(lower(t.decode()))]
    assert list(zip(bucket.tolist(), doc.tolist(), strict=True)) == want


@pytest.mark.parametrize("name", ["audit", "bpe", "resampling"])
def test_clashing_names_do_not_matter(spark, edge_docs, vocabulary, labels, name):
    more = edge_docs.select("*", *(F.lit(1).alias(c) for c in ("digest", "mask", "part", "good", "n_words", "rank", "score_", "task", "ids", "rows", "range", "weight")))
    run = {"audit": lambda d: audit.filter_audit(d, labels), "bpe": lambda d: bpe.digests(d, vocabulary, 40, 16), "resampling": lambda d: resampling.resample(d, d, least=1, percent=50)}[name]
    assert sorted(map(str, run(more).collect())) == sorted(map(str, run(edge_docs).collect()))


# models of earlier operators, against plain Python


def _mix(h):
    """The finaliser of 64-bit values, on whole numbers."""
    m = (1 << 64) - 1
    h ^= h >> 33
    h = h * 0xFF51AFD7ED558CCD & m
    h ^= h >> 29
    h = h * 0xC4CEB9FE1A85EC53 & m
    return h ^ h >> 32


def _hash32(numbers):
    key = 0
    for x in numbers:
        key = (key * 0x01000193 + x) & 0xFFFFFFFF
    key = key * 0x9E3779B1 & 0xFFFFFFFF
    return key ^ key >> 15


def _word_hash(word):
    return int(kernel.Block([word.encode()]).word_hashes()[0])


def plain_probability(model, text):
    w, h = WORDS.findall(text), [_word_hash(x) for x in WORDS.findall(text)]
    base, m = 0x9E3779B97F4A7C15, (1 << 64) - 1
    pairs = [_mix((_mix(a) * base + b) & m) for a, b in zip(h, h[1:])]
    points = [int.from_bytes(c.encode(), "big") for c in text]
    kinds = [h, pairs, *([_hash32(points[k : k + n]) for k in range(len(points) - n + 1)] for n in (3, 4))]
    quarter = quality_rules.BUCKETS // 4
    s = model.bias + sum(sum(float(model.weights[x % quarter + k * quarter]) for x in kind) / max(len(kind), 1) for k, kind in enumerate(kinds))
    assert len(h) == len(w)
    return 1 / (1 + math.exp(-max(-40, min(40, model.slope * s + model.offset))))


def test_quality_probability_equals_plain_python(spark, corpus, corpus_labels, edge_docs, edge_rows):
    model = quality_rules.fit(corpus, corpus_labels)
    docs = edge_docs.select("doc_id", "text").unionByName(corpus.where("doc_id < 40").select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    got = sorted((str(r["doc_id"]), r["probability"]) for r in docs.select("doc_id", "text").mapInArrow(quality_rules._apply(model), quality_rules.SCHEMA).collect())
    want = sorted((str(r["doc_id"]), plain_probability(model, r["text"] or "")) for r in docs.collect())
    assert [x[0] for x in got] == [x[0] for x in want] and np.allclose([x[1] for x in got], [x[1] for x in want], atol=2e-5)


def plain_features(text):
    raw, w = text.encode(), WORDS.findall(text)
    n, size = max(len(w), 1), max(len(raw), 1)
    windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    again = {k + j for k, x in enumerate(windows) if windows.count(x) > 1 for j in range(3)} if len(windows) < 500 else {k + j for k, x in enumerate(windows) if Counter(windows)[x] > 1 for j in range(3)} if len(set(windows)) > 1 else set(range(len(w)))
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    classes = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "stop": b".!?", "comma": b",;:", "symbol": b"#*$%&|<>", "other": b"@/\\_=+~^{}[]()-\"'`"}
    shape = [sum(raw.count(bytes([b])) for b in set(members)) / size for members in classes.values()]
    shape += [len(set(w)) / n / math.sqrt(1 + math.log(n)), sum(a == b for a, b in zip(w, w[1:])) / n, len(again) / n, (len(lines) - len(set(lines))) / max(len(lines), 1)]
    shape += [sum(map(len, w)) / n / 10, sum(text.count(c) for c in "#*$%&|<>") / n, len(lines) / n, math.log1p(len(w)) / 10, sum(x[-1] in "!%&*#$|" for x in w) / n]
    grams = Counter(_hash32(raw[k : k + 3]) % ranking.BUCKETS for k in range(len(raw) - 2))
    total = sum(grams.values())
    return np.array(shape + [math.sqrt(grams[b] / max(total, 1)) for b in range(ranking.BUCKETS)] + [total / (total + ranking.SHORT)])


def test_ranking_scores_equal_plain_python(spark, corpus, corpus_labels, edge_docs):
    model = ranking.fit(corpus, corpus_labels)
    docs = edge_docs.select("doc_id", "text").unionByName(corpus.where("doc_id < 40").select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    got = sorted((str(r["doc_id"]), r["score"]) for r in docs.mapInArrow(ranking._apply(model), ranking.SCHEMA).collect())

    def score(text):
        x = plain_features(text)
        z = [max(-ranking.CLIP, min(ranking.CLIP, (a - float(b)) / float(c))) for a, b, c in zip(x[:-1], model.mean, model.spread)]
        z = [v * (x[-1] if k >= len(z) - ranking.BUCKETS else 1) for k, v in enumerate(z)]
        s = sum(v * float(u) for v, u in zip(z, model.weights))
        return 1 / (1 + math.exp(-max(-30, min(30, model.slope * (s - model.threshold)))))

    want = sorted((str(r["doc_id"]), score(r["text"] or "")) for r in docs.collect())
    assert [x[0] for x in got] == [x[0] for x in want] and np.allclose([x[1] for x in got], [x[1] for x in want], atol=2e-3)


def test_ranking_learns_the_preferences(corpus, corpus_labels):
    """Of all pairs of a good and a bad training row, the fitted strengths order more than the untrained ones, and lose less."""
    fitted, short = ranking.fit(corpus, corpus_labels), ranking.fit(corpus, corpus_labels, epochs=1)
    known = corpus_labels.where("quality in (0, 1)").where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    rows = corpus.join(known.select("doc_id", "quality"), "doc_id").collect()
    x = {q: np.array([plain_features(r["text"] or "") for r in rows if r["quality"] == q]) for q in (0, 1)}

    def loss(model):
        s = {q: ranking.standardize(v, model.mean, model.spread) @ model.weights for q, v in x.items()}
        return np.mean([math.log1p(math.exp(-max(-40, min(40, a - b)))) for a in s[1] for b in s[0]])

    assert loss(fitted) < 0.5 * loss(short) and loss(fitted) < 0.2 < math.log(2)
