"""Each operator against a brute-force version, a round trip or held-out accuracy, with the edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from weft.llm import chat, kernel, lm, media, mixing, packing, quality_rules, queries, ranking, sharding, simhash, url_filters

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return SPLIT.findall(text or "")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# kernel


def test_word_hashes_tell_words_apart():
    docs = [b"a b a ab", b"", b"b  a\n", b"\xc3\xa9 a"]
    b = kernel.Block(docs)
    h = b.word_hashes()
    names = [w for d in docs for w in re.findall(rb"[^\x20\x09-\x0D]+", d)]
    assert b.counts.tolist() == [4, 0, 2, 2]
    for i, x in enumerate(names):
        for j, y in enumerate(names):
            assert (h[i] == h[j]) == (x == y)


# 1 url filters

URLS = ["http://www.example.com/en/1", "http://example.com/en/x", "http://m.Example.COM/en/", "https://a.net/es/9?q=/en/", "https://xnet/es/", "http://b.net/fr", "ftp://c.org", "no scheme", None, "http://d.com", "http://d.com/", "http://x.org/ads/1", "http://x.org/press/ads/1", "http://www.ads-track.example.org/z#a", "://?", "http://example.com:80/en/", ""]


def brute_verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = lower(re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
    best = None
    for r in url_filters.RULES:
        h, _, p = r.text.partition("/")
        if r.host_rule and (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(r.text) > len(best.text)):
            best = r
    fits = {r.action for r in url_filters.RULES if not r.host_rule and re.search(r.regex.replace("(?s:.*)", "[\\s\\S]*"), (url or "").lower())}
    return host, path, best.text if best else None, best.action if best else "block" if fits == {"block"} else "allow"


def test_url_filters_equal_brute_force(spark):
    pages = spark.createDataFrame([(k, u, "host", "rule") for k, u in enumerate(URLS)] + [(None, URLS[0], "x", "y")], "page_id long, url string, host string, rule string")
    got = url_filters.judge(pages).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute_verdict(URLS[r["page_id"] or 0])
    key = lambda rows: sorted(map(tuple, rows), key=str)
    assert key(url_filters.judge(pages, inline=0).collect()) == key(got)
    assert url_filters.judge(pages.limit(0)).count() == 0


def test_url_rules_are_filed_under_their_rarest_token(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    counts = url_filters.token_counts(pages, url_filters.RULES)
    by_token, always = url_filters.index(url_filters.RULES, counts)
    assert not always and all(min(r.tokens, key=lambda t: (counts.get(t, 0), t)) == k for k, rs in by_token.items() for r in rs)
    assert url_filters.Rule("block", "track*pixel^", False).tokens == []  # open ends
    assert url_filters.judge(pages, (url_filters.Rule("block", "e*e", False),)).where("verdict = 'block'").count() > 0


def test_url_query_equals_sql(spark, sf):
    ours = queries.op1_url_filters(spark, sf).toPandas().sort_values("page_id").reset_index(drop=True)
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    theirs = con.sql(queries.oracle_sql()["op1_url_filters"]).df().sort_values("page_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(ours.fillna("-"), theirs[ours.columns].fillna("-"), check_dtype=False)


# 2 media


def test_text_media_round_trip(edge_docs, edge_rows, empty_docs):
    got = media.text_media(edge_docs).collect()
    texts = defaultdict(list)
    for i, t, _ in edge_rows:
        texts[i].append((t or "").encode())
    assert len(got) == len(edge_rows)
    for r in got:
        raw = next(t for t in texts[r["doc_id"]] if len(t) == r["n_bytes"])
        kept = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(kept), hashlib.sha256(kept).hexdigest(), zlib.crc32(kept[-32:]))
        stored = media.encode_pgm(kept, 24)
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert media.text_media(empty_docs).count() == 0


def test_image_formats_decode():
    rng = np.random.default_rng(1)
    g, c = rng.integers(0, 256, (5, 7), np.uint8), rng.integers(0, 256, (4, 6, 3), np.uint8)
    assert (media.decode(media.encode_bmp(g)) == g).all() and (media.decode(media.encode_bmp(c)) == c).all()
    assert (media.decode(b"P6 # x\n6 4\n255\n" + c.tobytes()) == c).all()
    assert (media.decode(b"P2\n7 5\n255\n" + " ".join(map(str, g.ravel())).encode()) == g).all()
    assert media.decode(b"P1\n3 1\n1 0 1").tolist() == [[0, 255, 0]]
    assert media.decode(b"P4\n3 1\n\xa0").tolist() == [[0, 255, 0]]
    assert media.decode(b"P5\n2 1\n65535\n\x01\x02\x03\x04").tolist() == [[258, 772]]


def test_area_resize_is_exact():
    a = np.arange(48, dtype=np.uint8).reshape(6, 8)
    assert np.allclose(media.area_resize(a, 3, 4), a.reshape(3, 2, 4, 2).mean((1, 3)))
    fine = np.repeat(np.repeat(a, 5, 0), 3, 1)
    assert np.allclose(media.area_resize(a, 5, 3), media.area_resize(fine, 5, 3))


def test_media_columns(spark):
    g = np.arange(100, dtype=np.uint8).reshape(10, 10)
    df = spark.createDataFrame([(1, media.encode_bmp(g)), (2, b"junk"), (3, None)], "k int, image binary")
    got = {r["k"]: r for r in media.media_columns(df).collect()}
    assert got[1]["width"] == 10 and np.load(__import__("io").BytesIO(got[1]["tile"])).shape == (32, 32) and got[1]["dhash"] == "ff" * 8
    assert got[2]["error"] and got[3]["error"]
    more = media.media_columns(df.withColumns({"Width": F.lit(-1), "tile": F.lit("mine")})).where("k = 1").first()
    assert (more["Width"], more["_width"], more["tile"], more["_tile"], more["dhash"]) == (-1, 10, "mine", got[1]["tile"], got[1]["dhash"])


# 3 quality rules


def brute_facts(text):
    text = text or ""
    w = words(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    seen = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(3)}
    earlier, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in earlier
            earlier.add(line)
    failed = len(w) < 50 or 100 * len(seen) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(seen), failed


def test_quality_facts_equal_brute_force(edge_docs, edge_rows, labels, empty_docs):
    got = quality_rules.quality_rules(edge_docs, labels).collect()
    assert len(got) == len(edge_rows)
    want = Counter((i, *brute_facts(t)) for i, t, _ in edge_rows)
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == want
    assert not any(r["kept"] and r["base_failed"] for r in got)
    assert quality_rules.quality_rules(empty_docs, labels).count() == 0
    assert quality_rules.quality_rules(edge_docs, labels.limit(0)).count() == len(edge_rows)


def test_quality_facts_on_the_corpus(corpus, corpus_labels):
    got = quality_rules.quality_rules(corpus, corpus_labels).collect()
    texts = {r["doc_id"]: r["text"] for r in corpus.collect()}
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute_facts(texts[r["doc_id"]])


def test_quality_model_tells_junk_apart(spark, sf):
    docs, known = (spark.read.parquet(f"{sf}/../sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality_rules.fit(docs, known.where("crc32(cast(doc_id as string)) % 2 = 0"))
    rows = docs.join(known.where("crc32(cast(doc_id as string)) % 2 = 1"), "doc_id").select("doc_id", "text", "quality").toPandas()
    out = pa.Table.from_batches(list(quality_rules._apply(model)([pa.record_batch({"doc_id": pa.array(rows["doc_id"]), "text": pa.array(rows["text"])})])))
    good = np.array(out["probability"])[rows["quality"] == 1]
    bad = np.array(out["probability"])[rows["quality"] == 0]
    assert (good >= 0.5).mean() > 0.97 and (bad < 0.5).mean() > 0.8


# 4 packing


def test_token_pieces_equal_the_tokenizer(corpus, edge_rows):
    encoder = packing.TokenEncoder(queries.tokenizer_path())
    texts = [r["text"] for r in corpus.collect()] + [t or "" for _, t, _ in edge_rows] + ["''s 'S don't", "ΑΣ σ Σ", "١٢ ²½Ⅷ", "a\u0301e\u0301", "İ ẞ ǅ", "a\x1cb\u2028c"]
    whole = encoder.whole.encode_batch_fast(texts, add_special_tokens=False)
    small = packing.TokenEncoder(queries.tokenizer_path(), table=50)  # overflows all the time
    for a, b, c in zip(encoder.encode(texts), whole, small.encode(texts), strict=True):
        assert a.tolist() == b.ids == c.tolist()


def check_packing(docs, pieces, encoder, capacity=2048):
    ids = defaultdict(list)
    for i, t in docs:
        ids[i].append([*encoder.whole.encode(t or "", add_special_tokens=False).ids, 0])
    by_doc = Counter((p["doc_id"], p["piece"], p["start"], p["length"], p["ids_crc32"]) for p in pieces)
    want = Counter((i, k, s, len(x[s : s + capacity]), zlib.crc32(np.array(x[s : s + capacity], "<u4").tobytes())) for i, xs in ids.items() for x in xs for k, s in enumerate(range(0, len(x), capacity)))
    assert by_doc == want
    bins = defaultdict(list)
    for p in pieces:
        bins[p["sequence_id"]].append((p["offset"], p["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), sum(p["length"] for p in pieces) / capacity


def test_packing(corpus, edge_docs, edge_rows, empty_docs):
    encoder = packing.TokenEncoder(queries.tokenizer_path())
    path = queries.tokenizer_path()
    check_packing([(i, t) for i, t, _ in edge_rows], packing.pack(edge_docs, path).collect(), encoder)
    n, least = check_packing([(r["doc_id"], r["text"]) for r in corpus.collect()], packing.pack(corpus, path).collect(), encoder)
    assert n <= least + 2
    assert packing.pack(empty_docs, path).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece_once(seed):
    rng = random.Random(seed)
    counts = Counter(min(64, int(rng.paretovariate(0.8))) for _ in range(rng.randint(1, 400)))
    plan = packing.plan(dict(counts), 64)
    used = Counter()
    for items, n in plan:
        assert sum(items) <= 64 and n > 0
        for x in items:
            used[x] += n
    assert used == counts
    assert packing.plan({40: 3, 24: 1, 12: 2, 8: 3}, 64) == [((40, 24), 1), ((40, 12, 12), 1), ((40, 8, 8, 8), 1)]


# 5 mixing


def brute_targets(sizes):
    names = sorted(sizes, key=lambda n: (n is None, (n or "").encode()))
    weight = {n: k % 3 + 1 for k, n in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[n] for n in full)
        open_weight = sum(weight[n] for n in names if n not in full)
        target = {n: 3 * sizes[n] if n in full else left * weight[n] / open_weight for n in names}
        more = {n for n in names if n not in full and target[n] > 3 * sizes[n]}
        if not more:
            return target
        full |= more


@pytest.mark.parametrize("which", ["edge_docs", "corpus"])
def test_mixture(request, which):
    docs = request.getfixturevalue(which)
    got = mixing.mixture(docs).toPandas()
    rows = docs.select("doc_id", "text", "source").toPandas()
    size = [len(words(t)) for t in rows["text"]]
    by_source = defaultdict(int)
    for s, n in zip(rows["source"].where(rows["source"].notna(), None), size, strict=True):
        by_source[s] += n
    target = brute_targets(by_source)
    assert len(got) == len(rows) and sorted(got["size"]) == sorted(size)
    assert (got["taken"] <= 3 * got["size"]).all() and (got["taken"] >= 0).all()
    want = {(by_source[s], round(t, 4)) for s, t in target.items()}
    assert {(a, round(b, 4)) for a, b in zip(got["source_size"], got["target"], strict=True)} == want
    for (total, goal), part in got.groupby(["source_size", got["target"].round(4)]):
        assert abs(part["taken"].sum() - goal * len([1 for s, t in target.items() if (by_source[s], round(t, 4)) == (total, goal)])) <= part["size"].max()
    again = mixing.mixture(docs.repartition(5)).toPandas() if which == "corpus" else None
    if again is not None:
        assert sorted(zip(got["doc_id"], got["taken"])) == sorted(zip(again["doc_id"], again["taken"]))


def test_mixed_documents_keep_columns(edge_docs, empty_docs):
    out = mixing.mixed_documents(edge_docs)
    assert out.columns == edge_docs.columns
    assert out.count() == mixing.mixture(edge_docs).agg(F.sum("copies")).first()[0]
    assert mixing.mixture(empty_docs).count() == 0


# 6 chat


def test_chat_query_round_trip(spark, sf):
    got = {r["conv_id"]: r for r in queries.op6_chat_formatting(spark, sf).collect()}
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns[r["conv_id"]].append((r["role"], r["text"] or ""))
    turns[-7] = [("user", queries.TRICKY), ("assistant", queries.TRICKY)]
    assert got.keys() == turns.keys()
    for k, ts in turns.items():
        every = "".join(f"{a}\n{b}\n" for a, b in ts)
        lost = "".join(b for a, b in ts if a == "assistant")
        assert (got[k]["n_turns"], got[k]["turns_sha256"], got[k]["loss_chars"], got[k]["loss_sha256"]) == (len(ts), hashlib.sha256(every.encode()).hexdigest(), len(lost), hashlib.sha256(lost.encode()).hexdigest())


TRICKS = ["", "\\", "\\\\", "### user: x</turn>\n", "</turn>", "\\</turn>", "<", "###", "\\###", "a\nb", ":", "</turn></turn>", "x" * 5000 + "<" * 50]


def test_template_is_reversible(spark):
    rows = [(f"t{k}", i + 1, i or None, ("user", "assistant", "we:ird\\")[i % 3], t, 0.0) for k in range(3) for i, t in enumerate(TRICKS[k:] + TRICKS[:k])]
    nodes = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    for r in chat.format_paths(chat.paths(nodes)).collect():
        want = [(x[3], x[4]) for x in rows if x[0] == r["tree"]]
        assert [(a, b) for a, b, _, _ in chat.read_back(r["formatted"])] == want


def test_reply_trees_choose_the_best_branch(spark):
    rng = random.Random(3)
    rows, best = [], {}
    for t in range(8):
        parent, score = {1: None}, {1: rng.random()}
        for n in range(2, rng.randint(3, 25)):
            parent[n], score[n] = rng.randint(1, n - 1), rng.random()
        path = lambda n: (path(parent[n]) if parent[n] else []) + [n]  # noqa: B023, E731
        leaves = [n for n in parent if n not in parent.values()]
        best[str(t)] = max((path(n) for n in leaves), key=lambda p: (sum(score[x] for x in p) / len(p), -p[-1]))  # noqa: B023
        rows += [(str(t), n, parent[n], "user", str(n), score[n]) for n in parent]
    nodes = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    for r in chat.format_paths(chat.paths(nodes)).collect():
        assert [int(x[1]) for x in chat.read_back(r["formatted"])] == best[r["tree"]]
    cycle = spark.createDataFrame([("c", 1, 2, "u", "", 0.0), ("c", 2, 1, "u", "", 0.0)], nodes.schema)
    with pytest.raises(ValueError, match="cycle"):
        chat.paths(cycle)


def test_conversations_with_nulls_and_ties(spark):
    df = spark.createDataFrame([(None, 0, "user", "a"), (1, 0, None, None), (1, 0, "user", "b"), (1, 0, "user", "b"), (1, None, "user", "first")], "conv_id long, turn long, role string, text string")
    got = {r["tree"]: chat.read_back(r["formatted"]) for r in chat.format_paths(chat.paths(chat.conversation_nodes(df))).collect()}
    assert [x[:2] for x in got["1"]] == [("user", "first"), ("", ""), ("user", "b"), ("user", "b")] and len(got["null"]) == 1
    assert chat.format_paths(chat.paths(chat.conversation_nodes(df.limit(0)))).count() == 0


# 7 language model


def test_scaled_forward_equals_enumeration():
    rng = np.random.default_rng(4)
    k = 3
    model = lm.Hmm(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(lm.CLASSES + 1), k).T)
    obs, n = rng.integers(0, lm.CLASSES, 9).astype(np.int32), np.array([4, 1, 4])
    got, at = model.score(obs, n), 0
    for d, m in enumerate(n):
        total = 0.0
        for path in np.ndindex(*[k] * m):
            p = model.start[path[0]] * model.emit[obs[at], path[0]]
            for t in range(1, m):
                p *= model.move[path[t - 1], path[t]] * model.emit[obs[at + t], path[t]]
            total += float(p)
        assert abs(got[d] - np.log(total)) < 1e-4
        at += m


def test_baum_welch_counts_equal_enumeration_and_raise_the_likelihood():
    rng = np.random.default_rng(5)
    k = 8
    model = lm.Hmm(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(lm.CLASSES + 1), k).T)
    obs, n = rng.integers(0, 40, 300).astype(np.int32), np.array([120, 3, 1, 176])
    sums = lm.zero_sums()
    model.expect(obs, n, sums)
    assert abs(sums["emit"].sum() - 300) < 1e-2 and abs(sums["move"].sum() - (300 - 4)) < 1e-2 and abs(sums["start"].sum() - 4) < 1e-3
    share = np.full(lm.CLASSES + 1, 1 / (lm.CLASSES + 1))
    after = lm.Hmm.from_counts(sums["start"], sums["move"], sums["emit"], share, 1e-3)
    assert after.score(obs, n).sum() > model.score(obs, n).sum()


def test_language_scores(corpus, edge_docs, edge_rows, empty_docs):
    for docs in (corpus, edge_docs):
        texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
        held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
        count = Counter(w for i, t in texts if not held(i) for w in [*words(lower(t)), None])
        total, kinds = sum(count.values()), len(count)
        want = defaultdict(list)
        for i, t in texts:
            ws = [*words(lower(t)), None]
            want[i].append((held(i), len(ws), sum(w in count for w in ws), total, round(sum(np.log10((count[w] + 1) / (total + kinds + 1)) for w in ws), 4)))
        got = defaultdict(list)
        rows = lm.language_scores(docs).collect()
        for r in rows:
            got[r["doc_id"]].append((r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)))
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
        assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in rows)
        if docs is corpus:
            assert sum(r["score"] - r["base_score"] for r in rows if r["held_out"]) > 0
    assert lm.language_scores(empty_docs).count() == 0


def test_language_model_starts_alike_from_any_order_and_with_all_states(spark, corpus):
    def trained(docs):
        encoded = docs.select("doc_id", F.lit(False).alias("held"), "text").coalesce(1).mapInArrow(lm._encode, lm.ENCODED).cache()
        share = np.ones(lm.CLASSES + 1)
        for r in encoded.select("words", "counts").collect():
            share += np.bincount(lm.classes_of(np.array(r["words"], np.int64).view(np.uint64)), r["counts"], minlength=lm.CLASSES + 1)
        return lm.train(encoded, share / share.sum(), 1)

    few = corpus.where("doc_id < 60")
    a, b = (trained(few.orderBy(x)) for x in (F.asc("doc_id"), F.desc("doc_id")))
    assert np.allclose(a.emit, b.emit, rtol=1e-2, atol=1e-6) and np.allclose(a.move, b.move, atol=1e-3)
    lone = trained(corpus.where("doc_id < 3")).emit  # fewer texts than states
    assert all(np.abs(lone[:, i] / lone[:, k] - 1).max() > 0.01 for i in range(lm.STATES) for k in range(i))


def test_numbers_survive_packing():
    x = np.array([0, 1, 255, 256, 2**32 - 1, 7], np.uint32)
    assert (lm.unpack_numbers(lm.pack_numbers(x)) == x).all()


# 8 sharding


@pytest.mark.parametrize("which", ["edge_docs", "corpus"])
def test_shards(request, which):
    docs = request.getfixturevalue(which)
    got = sharding.shards(docs).toPandas()
    rows = docs.select("doc_id", "text").toPandas()
    want = Counter((i if i == i else None, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in zip(rows["doc_id"], rows["text"], strict=True))
    assert Counter((i if i == i else None, s, c) for i, s, c in zip(got["doc_id"], got["size"], got["text_crc32"], strict=True)) == want
    assert got["shard"].between(0, 39).all()
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    order = got.sort_values(["shard", "slot"])
    ids = [-1 if i != i else i for i in order["doc_id"]]
    assert ids == sorted(ids)
    sums = got.groupby("shard")["size"].sum().reindex(range(40), fill_value=0)
    assert (sums - got["size"].sum() / 40).abs().max() <= got["size"].max()


def test_shards_of_nothing_and_of_one_id(spark, empty_docs):
    assert sharding.shards(empty_docs).count() == 0
    same = spark.range(500).select(F.lit(7).cast("long").alias("doc_id"), F.lit("abc").alias("text"))
    assert sharding.shards(same).groupBy("shard").count().agg(F.min("count"), F.max("count")).first()[:] == (12, 13)


# 9 quality classifier


def test_ranking(spark, sf, edge_docs, edge_rows, labels, empty_docs):
    docs, known = (spark.read.parquet(f"{sf}/../sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = queries.op9_quality_classifier(spark, f"{sf}/../sf0.01").join(known, "doc_id").toPandas()
    held = got[got["held_out"]]
    assert (held["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    good, bad = held[held["quality"] == 1]["score"], held[held["quality"] == 0]["score"]
    auc = np.mean([(good > b).mean() + 0.5 * (good == b).mean() for b in bad])
    assert auc > 0.97 and (good >= 0.5).mean() > 0.95 and (bad < 0.5).mean() > 0.85
    rows = ranking.quality_scores(edge_docs, labels).collect()
    assert len(rows) == len(edge_rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert ranking.quality_scores(empty_docs, labels).count() == 0
    assert {r["score"] for r in ranking.quality_scores(edge_docs, labels.limit(0)).collect()} == {1.0}


def test_ranking_ignores_held_out_labels(spark, corpus, corpus_labels):
    flipped = corpus_labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (ranking.fit(corpus, x) for x in (corpus_labels, flipped))
    assert (a.weights == b.weights).all() and a.threshold == b.threshold


# 10 SimHash


def brute_print(text):
    w = words(lower(text))
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(prints):
    items = sorted(set(prints.values()))
    root = {p: p for p in items}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, a in enumerate(items):
        for b in items[:i]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for (i, _), p in prints.items():
        if i is not None:
            least[find(p)] = min(i, least.get(find(p), i))
    return {k: least.get(find(p)) for k, p in prints.items()}


@pytest.mark.parametrize("which", ["edge_docs", "corpus"])
def test_near_duplicates_equal_brute_force(request, which):
    docs = request.getfixturevalue(which)
    rows = docs.select("doc_id", "text").collect()
    prints = {(r["doc_id"], k): brute_print(r["text"]) for k, r in enumerate(rows)}
    ids = brute_components(prints)
    want = Counter((i, prints[i, k], ids[i, k]) for i, k in prints)
    got = simhash.near_duplicates(docs).collect()
    assert Counter((r["doc_id"], r["print"] % 2**64, r["component_id"]) for r in got) == want


def test_no_documents_have_no_components(empty_docs):
    assert simhash.near_duplicates(empty_docs).count() == 0


def test_links_span_all_classes_with_split_anchors(spark):
    rng = random.Random(8)
    prints = set()
    for _ in range(40):
        base = rng.getrandbits(64)
        for _ in range(20):
            x = base
            for k in rng.sample(range(64), rng.randint(0, 6)):
                x ^= 1 << k
            prints.add(x)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "print long")
    for split in (simhash.SPLIT, 3):
        got = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, split)).collect()}
        have, want = defaultdict(set), defaultdict(set)
        for p in signed:
            have[got.get(p, p)].add(p % 2**64)
        for k, v in brute_components({(p, 0): p for p in prints}).items():
            want[v].add(k[0])
        assert sorted(map(sorted, have.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["root"] for r in simhash.components(edges).collect()} == {0}


# pipeline


def test_pipeline(spark, sf):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs
    for k, (_, stage) in enumerate(pipeline.STAGES):
        after = stage(spark, before, sf).cache()
        if k < 3:
            assert after.columns == columns and 0 < after.count() <= before.count()
            assert after.exceptAll(before).isEmpty()
        before = after
    assert before.where("length > 2048 or length < 1").isEmpty() and before.count() > 0
    alone = simhash.near_duplicates(pipeline.dedup(spark, docs, sf)).groupBy("component_id").count().where("count > 1")
    assert alone.isEmpty()


def test_pipeline_stages_take_edge_rows(spark, sf, edge_docs):
    pipeline = pytest.importorskip("corpus_pipeline")
    for _, stage in pipeline.STAGES:
        assert stage(spark, edge_docs, sf).count() >= 0
        assert stage(spark, edge_docs.limit(0), sf).count() == 0


def test_pipeline_rules_judge_as_op3(spark, sf):
    pipeline = pytest.importorskip("corpus_pipeline")
    path = f"{sf}/../sf0.01"
    docs, known = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    left = docs.join(known.where("quality = 0"), "doc_id", "left_anti").select(docs.columns)  # as after a perfect classifier
    judged = queries.op3_quality_rules(spark, path).join(left.select("doc_id"), "doc_id").collect()
    assert any(not r["kept"] and not r["base_failed"] for r in judged)  # the model decides some
    assert Counter(r["doc_id"] for r in pipeline.apply_rules(spark, left, path).select("doc_id").collect()) == Counter(r["doc_id"] for r in judged if r["kept"])
