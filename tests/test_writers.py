"""Writers and their guards: packed, text and rendered shards, parts, plans, results, configurations, commands."""

import hashlib
import json
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weft import __main__ as commands
from weft import storage
from weft.functions import text
from weft.operators import evaluation, modalities, ordering, planning, streams, training
from weft.sources import benchmarks, manifests, shards

SAMPLE = "shard string, place long, id string, codes array<array<int>>, text array<int>, dur array<int>, metadata string, skip string, detail string"


def rows(*samples):
    """(place, id, codes, text, dur, metadata[, skip]) of shard s."""
    return [("s", *x[:6], *((x[6], "why") if len(x) > 6 else (None, None))) for x in samples]


GOOD = [[1], [2], [3], [4]]

# ids of the adapters


def test_ids_are_the_published_ones(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("/root\na/b.wav\t32000\n")
    r = manifests.fairseq_tsv(spark, str(tmp_path / "m.tsv"), "d", "train", 16000).first()
    assert r["id"] == "d:train:" + hashlib.sha1(b"a/b.wav:32000").hexdigest()[:16]
    assert r["id"].startswith("d:train:d8246569")
    lines = [{"path": "x.wav"}, {"audio": "x.wav", "offset": 1.5}, {"text": "no audio"}, {"path": "x.wav", "dataset": "own", "split": "test"}]
    (tmp_path / "m.jsonl").write_text("\n".join(map(json.dumps, lines)))
    got = manifests.from_json(manifests.text_lines(spark, str(tmp_path / "m.jsonl")), "d", "train").orderBy("record_index").collect()
    want = ["x.wav:0:0", "x.wav:1.5:1", "None:0:2", "x.wav:0:3"]
    assert [x["id"] for x in got] == [f"d:train:{hashlib.sha1(k.encode()).hexdigest()[:16]}" for k in want]
    own = manifests.from_json(manifests.text_lines(spark, str(tmp_path / "m.jsonl")).where("line = 3"), None, None).first()
    assert (own["dataset"], own["split"]) == ("own", "test")
    with pytest.raises(Exception, match="needs a dataset"):
        manifests.from_json(manifests.text_lines(spark, str(tmp_path / "m.jsonl")), None, "train").collect()


# packed shards


@pytest.mark.parametrize(
    ("sample", "why"),
    [
        (("x", [], [1], [1], None), "invalid code shape"), (("x", [[1], [2, 3]], [1], [2], None), "invalid code shape"), (("x", [[40000]], [1], [1], None), "codes outside the int16 range"), (("x", [[-1]], [1], [1], None), "codes outside the int16 range"),
        (("x", GOOD, None, None, None), "the aligned profile needs text and durations"), (("x", GOOD, [1, 2], [4], None), "invalid alignment"), (("x", GOOD, [1, 2], [4, 0], None), "invalid alignment"), (("x", GOOD, [1, 2], [1, 2], None), "the alignment does not cover all steps"),
        (("x", GOOD, [1], [4], '{"audio_steps": 9}'), "metadata uses reserved fields: ['audio_steps']"),
    ],
)
def test_a_rejected_sample_does_not_harm_its_shard(spark, tmp_path, sample, why):
    df = spark.createDataFrame(rows((3, "a", GOOD, [7], [4], '{"k": 1}'), (2, *sample), (1, "z", GOOD, [8, 9], [2, 2], None), (0, "late", None, None, None, None, "TooShort")), SAMPLE)
    shards.write_shards(df, str(tmp_path), "aligned")
    got = shards.decode_shards(spark, str(tmp_path)).orderBy("place").collect()
    assert [(r["id"], r["text"], r["dur"]) for r in got] == [("z", [8, 9], [2, 2]), ("a", [7], [4])]  # in order of place
    skips = [json.loads(x) for x in (tmp_path / "s/skips.jsonl").read_text().splitlines()]
    assert {x["id"]: (x["reason"], x["detail"]) for x in skips} == {"late": ("TooShort", "why"), "x": ("ValueError", why)}
    meta = json.loads((tmp_path / "s/meta.json").read_text())
    assert (meta["num_samples"], meta["num_skipped"], meta["num_audio_steps"], meta["num_text_tokens"], meta["keep_audio"]) == (2, 2, 8, 3, False)


def test_an_empty_shard_leaves_diagnostics(spark, tmp_path):
    bad = spark.createDataFrame(rows((0, "x", [[-1]], None, None, None), (1, "y", None, None, None, None, "Broken")), SAMPLE)
    with pytest.raises(Exception, match="refusing to publish an empty shard"):
        shards.write_shards(bad, str(tmp_path), preprocessing={"num_assigned_records": 2})
    assert not (tmp_path / "s").exists() and not [d for d in os.listdir(tmp_path) if d.startswith(".tmp")]
    told = json.loads((tmp_path / "s.failed.json").read_text())
    lines = (tmp_path / "s.failed.skips.jsonl").read_bytes()
    assert (told["num_assigned_records"], told["num_skipped"], told["skips_sha256"]) == (2, 2, hashlib.sha256(lines).hexdigest())
    assert {json.loads(x)["id"] for x in lines.splitlines()} == {"x", "y"}
    good = spark.createDataFrame(rows((0, "x", GOOD, None, None, None)), SAMPLE)
    shards.write_shards(good, str(tmp_path), preprocessing={"num_assigned_records": 2})
    assert (tmp_path / "s/meta.json").exists() and not list(tmp_path.glob("s.failed*"))


def test_profiles_and_codebooks_are_checked():
    frame = pd.DataFrame({"id": ["a"], "codes": [GOOD], "text": [None], "dur": [None], "metadata": [None]})
    for profile, books in (("other", 1), ("units-only", 0)):
        with pytest.raises(ValueError, match="must be"):
            shards.encode(frame, profile, books, {}, [])


def test_waveforms_need_their_library(monkeypatch):
    frame = pd.DataFrame({"id": ["a"], "codes": [GOOD], "text": [None], "dur": [None], "metadata": [None], "waveform": [[0.0, 0.5]], "sample_rate": [16000]})
    monkeypatch.setitem(__import__("sys").modules, "soundfile", None)
    with pytest.raises(ImportError, match="soundfile"):
        shards.encode(frame, "units-only", 1, {}, [], keep_audio=True)
    assert "meta.json" in shards.encode(frame, "units-only", 1, {}, [])


# text and rendered shards, parts


def test_text_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["b a a", "", "a zz", "a b c", None, "c"])], "source_index long, text string")
    vocabulary = spark.createDataFrame([("a", 2), ("b", 3), ("c", 4)], "token string, id int")
    ids = text.token_ids(docs, "text", vocabulary)
    assert {r["source_index"]: r["ids"] for r in ids.collect()} == {0: [3, 2, 2, 1], 1: [1], 2: [2, 0, 1], 3: [2, 3, 4, 1], 4: [1], 5: [4, 1]}
    assert {r["source_index"]: r["ids"] for r in text.token_ids(docs, "text", vocabulary, end=None).collect()}[1] == []
    named = ids.select("source_index", F.concat(F.lit("d:train:"), F.col("source_index").cast("string")).alias("id"), "ids")
    request = {"dataset": "d", "split": "train", "tokenizer_id": "words"}
    for _ in range(2):  # the second time nothing changes
        shards.write_text_shards(named, str(tmp_path), request, 2)
    got = shards.decode_shards(spark, str(tmp_path)).orderBy("shard", "place").collect()
    assert [(r["id"], r["text"], json.loads(r["metadata"])["source_index"]) for r in got] == [("d:train:0", [3, 2, 2, 1], 0), ("d:train:2", [2, 0, 1], 2), ("d:train:3", [2, 3, 4, 1], 3), ("d:train:5", [4, 1], 5)]
    meta = json.loads((tmp_path / "shard-00000/meta.json").read_text())
    assert (meta["modality"], meta["num_samples"], meta["num_tokens"], meta["num_skipped"], meta["request"]) == ("text", 2, 7, 1, request | {"num_shards": 2})
    with pytest.raises(Exception, match="different parameters"):
        shards.write_text_shards(named, str(tmp_path), request | {"split": "test"}, 2)
    with open(tmp_path / "shard-00001/text.bin", "ab") as f:
        f.write(b"\0\0\0\0")
    with pytest.raises(Exception, match="text size"):
        shards.decode_shards(spark, str(tmp_path)).collect()


def test_rendered_shards(spark, tmp_path):
    samples = spark.createDataFrame([("s", 0, "a", [[1, 2], [3, 4]], [5, 6]), ("s", 1, "b", [[7, 8]], [9]), ("s", 2, "c", [[7, 8]], [9, 9])], "shard string, place long, id string, codes array<array<int>>, text array<int>")
    shards.write_shards(samples, str(tmp_path), "rendered", 2, {"font": "f"})
    got = shards.decode_shards(spark, str(tmp_path)).orderBy("place").collect()
    assert [(r["id"], r["codes"], r["text"]) for r in got] == [("a", [[1, 2], [3, 4]], [5, 6]), ("b", [[7, 8]], [9])]
    meta = json.loads((tmp_path / "s/meta.json").read_text())
    assert (meta["modality"], meta["num_steps"], meta["num_skipped"]) == ("rendered-text", 3, 1)
    files = {p.name: p.read_bytes() for p in (tmp_path / "s").iterdir()}
    for name, why in (("image.bin", "image size"), ("text.bin", "text size"), ("samples.jsonl", "metadata count")):
        with pytest.raises(ValueError, match=why):
            shards.decode("s", files | {name: files[name][:-4] if name != "samples.jsonl" else b""})
    with pytest.raises(ValueError, match="checksums"):
        shards.decode("s", files | {"image.bin": bytes(len(files["image.bin"]))})


def test_parts_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, [[7], [40000]], [1, 2]), (0, [[5]], [3]), (2, [], [])], "place long, codes array<array<int>>, text array<int>").repartition(3)
    shards.write_part(df, str(tmp_path), "p", "words", "<i4")
    got = shards.decode_parts(spark, str(tmp_path), "p", 1, "words", "<i4").orderBy("place").collect()
    assert [(r["codes"], r["text"]) for r in got] == [([[5]], [3]), ([[7], [40000]], [1, 2]), ([], [])]
    lengths = (tmp_path / "p.len").read_bytes()
    assert shards.part_problem(lengths, 3) is None and shards.part_problem(lengths, 4) == "entries missing" and shards.part_problem(None, 0) == "no lengths"
    assert sorted(os.listdir(tmp_path)) == ["p.bin", "p.len", "p_words.bin"]


# plans, results, metrics


def test_a_plan_guards_its_manifest(spark, tmp_path):
    docs = spark.createDataFrame([(i, "t" * i, "en", "s", i + 1) for i in range(9)], "doc_id long, text string, lang string, source string, n_chars long")
    m = manifests.from_documents(docs)
    digest = manifests.manifest_digest(m)
    assert digest == manifests.manifest_digest(m.repartition(3)) != manifests.manifest_digest(m.where("record_index < 8"))
    plan = planning.balanced_plan(m.select("record_index", "id", F.col("duration").alias("load")), 3)
    planning.write_plan(plan, str(tmp_path / "plan"), "m", digest, 9)
    held = [sorted(r[0] for r in planning.planned_records(spark, str(tmp_path / "plan"), "m", digest, k).collect()) for k in range(3)]
    assert sorted(sum(held, [])) == list(range(9))
    for manifest, told, shard, why in (("n", digest, 0, "different manifest"), ("m", "x", 0, "has changed"), ("m", digest, 3, "outside the plan")):
        with pytest.raises(ValueError, match=why):
            planning.planned_records(spark, str(tmp_path / "plan"), manifest, told, shard)


def test_results_and_metrics(spark, tmp_path):
    scored = spark.createDataFrame([(2, 1, 1), (0, 0, 1), (1, 1, 1)], "index long, gold int, pred int")
    out = evaluation.write_results(scored, str(tmp_path / "r.json"), {"task": "t"})
    assert out["accuracy"] == pytest.approx(2 / 3) and out["num_examples"] == 3 and json.loads(spark.read.text(str(tmp_path / "r.json")).first()[0]) == out
    assert [json.loads(r[0])["index"] for r in spark.read.text(str(tmp_path / "r.json.rows")).collect()] == [0, 1, 2]
    other = evaluation.write_results(scored.withColumn("pred", F.lit(0)), str(tmp_path / "q.json"), {"task": "t"})
    assert other["rows_file"]["sha256"] != out["rows_file"]["sha256"]
    with pytest.raises(Exception, match="already exists"):
        evaluation.write_results(scored, str(tmp_path / "r.json"), {})
    training.write_metrics(spark.createDataFrame([(1, 0.5), (0, None)], "step long, loss double"), str(tmp_path / "metrics"))
    assert [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "metrics")).collect()] == [{"loss": None, "step": 0}, {"loss": 0.5, "step": 1}]


# streams


def shard(dataset, split, name, kind, tokens, **more):
    return (dataset, split, name, kind, more.get("version", 1), more.get("profile", "aligned"), more.get("text", True), tokens, more.get("books", 1), 500, 501, 500)


def test_stream_selection(spark):
    table = [shard("a", "train", "s0", "speech", 3000), shard("a", "train", "s1", "speech", 1000), shard("a", "held", "s2", "speech", 9000), shard("b", "train", "s3", "speech", 1000, text=False), shard("b", "train", "s4", "speech", 500), shard("c", "train", "s5", "text", 10)]
    df = spark.createDataFrame(table, streams.SHARD)
    config = benchmarks.MixtureConfig(weights=[0, 0, 1, 0, 1], datasets={"aud": ["a"], "audtxt": ["a", "b"]}, probabilities={"audtxt": [0.75, 0.25]}, block_size=2048)
    got = {(r["strategy"], r["shard"]): r["weight"] for r in streams.select_streams(df, config).collect()}
    assert got == {("aud", "s0"): 1.0, ("audtxt", "s0"): pytest.approx(0.5625), ("audtxt", "s1"): pytest.approx(0.1875), ("audtxt", "s4"): 0.25}
    short = benchmarks.MixtureConfig(weights=[1, 0, 0, 0, 0], datasets={"txt": ["c"]}, block_size=2048)
    with pytest.raises(Exception, match="no data found for txt"):
        streams.require_all_strategies(streams.select_streams(df, short), short).collect()
    for bad, why in ((shard("a", "train", "x", "speech", 9000, version=2), "unsupported schema"), (shard("a", "train", "x", "speech", 9000, books=8), "n_codebooks mismatch"), (shard("a", "train", "x", "speech", 9000, profile="units-only"), "units-only")):
        with pytest.raises(Exception, match=why):
            streams.select_streams(spark.createDataFrame([*table, bad], streams.SHARD), config, {"aud": {"n_codebooks": 1}}).collect()
    with pytest.raises(ValueError, match="unknown layout"):
        streams.sample_layout("x", df, 1, 1, 1, 1, 1)


META = "place long, source string, tokenizer_id string, tokenizer_alias string, base_vocab_size long, eos_id long, pad_id long, epad_id long, special_vocab_size long"


@pytest.mark.parametrize(
    ("second", "problem"),
    [((1, "b", "o/m-2", "x", 10, 1, 10, 11, None), None), ((1, "b", "o/n-1", "x", 10, 1, None, None, None), "tokenizer_id"), ((1, "b", "o/m-1", "y", 10, 1, None, None, None), "tokenizer_alias"), ((1, "b", "o/m-1", None, 11, 1, None, None, None), "base_vocab_size"), ((1, "b", "o/m-1", None, 10, 2, None, None, None), "eos_id"), ((1, "b", "o/m-1", None, 10, 1, 9, None, None), "pad_id")],
)
def test_text_metadata_is_reconciled(spark, second, problem):
    first = (0, "a", "o/m-1", "x", 10, 1, 10, None, None)
    got = streams.reconcile_text_metadata(spark.createDataFrame([first, second, (2, "c", "o/m-1", None, 10, 1, None, None, 12)], META)).first()
    assert got["problem"] == (f"b: {problem}" if problem else None)
    assert (got["tokenizer_id"], got["pad_id"], got["epad_id"], got["special_vocab_size"]) == ("o/m-1", 10, second[7], 12)


# configurations


@pytest.mark.parametrize("bad", [{"audio_codebooks": 2, "audio_pad": 1, "text_pad": 0, "audio_codebook_weights": [1.0]}, {"audio_codebooks": 1, "audio_pad": 1, "text_pad": 0, "audio_codebook_weights": [0.0]}, {"audio_codebooks": 2, "audio_pad": 1, "text_pad": 0, "audio_delays": [0]}, {"audio_codebooks": 1, "audio_pad": 1, "text_pad": 0, "audio_delays": [-1]}, {"text_pad_loss_weight": 0}, {"audio_codebooks": 1, "text_pad": 0}, {"audio_codebooks": 1, "audio_pad": 1}, {"audio_text_prefix": True}])
def test_bad_models_are_refused(bad):
    with pytest.raises(ValueError):
        benchmarks.ModelConfig(**bad)


def test_training_and_renderer_configurations(spark, tmp_path):
    mixture = {"weights": [1, 0, 0, 0, 0], "datasets": {"txt": ["a"]}}
    train, _, model, settings = benchmarks.load_training_config(json.dumps({"train": mixture, "validation": mixture | {"splits": ["test"]}, "model": {"audio_codebooks": 3, "audio_pad": 9, "text_pad": 8}, "settings": {"lr": 1}}))
    assert train.datasets == {"txt": ["a"]} and model.audio_delays == [0, 1, 2] and settings == {"lr": 1}
    for broken in ({"train": mixture}, {"train": mixture, "validation": mixture, "model": {}, "x": 1}, {"train": mixture, "validation": mixture, "model": {"x": 1}}):
        with pytest.raises(ValueError):
            benchmarks.load_training_config(json.dumps(broken))
    (tmp_path / "text_renderer_config.json").write_text(json.dumps({"font_file": "f.ttf", "dpi": 120}))
    assert benchmarks.load_renderer_config(spark, str(tmp_path), dpi=90) == {"font_file": f"{tmp_path}/f.ttf", "dpi": 90}


# speech tokenizers


def test_speech_tokenizers(spark):
    df = spark.createDataFrame([([[1, 1], [1, 1], [2, 1], [2, 1], [1, 1]],)], "frames array<array<int>>")
    two = modalities.build_speech_tokenizer("hubert", vocab=5, codebooks=2)
    got = df.select(two.encode_with_mapping(F.col("frames")).alias("e"), two.frames_problem(F.col("frames")).alias("p")).first()
    assert got["e"]["codes"] == [[1, 1], [2, 1], [1, 1], [5, 5]] and got["e"]["frame_to_code"] == [0, 0, 1, 1, 2, 3] and got["p"] is None
    mimi = modalities.build_speech_tokenizer("mimi")
    frames = spark.createDataFrame([([[k] * 8 for k in (3, 3, 4)],), ([[1] * 7],), ([[2048] * 8],), ([],)], "frames array<array<int>>")
    coded = frames.select(mimi.encode_with_mapping(F.col("frames")).alias("e"), mimi.frames_problem(F.col("frames")).alias("p")).collect()
    assert coded[0]["e"]["codes"] == [[3] * 8, [3] * 8, [4] * 8, [2048] * 8] and coded[0]["e"]["frame_to_code"] == [0, 1, 2, 3]
    assert [r["p"] for r in coded] == [None, "invalid code shape", "codes outside the vocabulary", "no frames"]
    assert mimi.metadata()["collapsed"] is False and two.metadata()["eos_token"] == 5
    with pytest.raises(ValueError, match="unknown speech tokenizer"):
        modalities.build_speech_tokenizer("x")
    with pytest.raises(ValueError, match="16 bits"):
        modalities.build_speech_tokenizer("hubert", vocab=40000)


# order


def test_running_numbers_every_row_once(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1009).alias("k"), (F.col("id") % 3).alias("v")).repartition(7)
    got = ordering.running(df, ["k"], {"total": F.col("v")}).orderBy("number").collect()
    assert [r["number"] for r in got] == list(range(1000)) and [r["k"] for r in got] == sorted(r["k"] for r in got)
    assert [r["total"] for r in got] == np.concatenate(([0], np.cumsum([r["v"] for r in got])[:-1])).tolist()
    assert ordering.running(df.limit(0), ["k"]).count() == 0
    ring = {r["k"]: r["next_v"] for r in ordering.next_in_order(df, "k", "v").collect()}
    order = sorted(df.collect())
    assert all(ring[a["k"]] == b["v"] for a, b in zip(order, order[1:] + order[:1], strict=True))


def test_stored_tables_can_be_dropped(spark):
    table = storage.materialize(spark.range(3), "test")
    assert table.count() == 3 and os.path.exists(table.stored_at)
    storage.drop(table)
    assert not os.path.exists(table.stored_at)


# commands


def test_commands_from_source_to_shard(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(commands, "session", lambda: spark)
    spark.createDataFrame([("one two",), ("three",), ("four five six",)], "text string").coalesce(1).write.parquet(str(tmp_path / "stories"))
    at = lambda name: str(tmp_path / name)
    commands.main(["tinystories", at("stories"), at("m"), "--max-samples", "2"])
    assert [r["transcript"] for r in commands.read_manifest(spark, at("m")).orderBy("record_index").collect()] == ["one two", "three"]
    commands.main(["plan", at("m"), at("plan"), "--shards", "2"])
    for k in range(2):
        commands.main(["encode", at("m"), at("plan"), at("out"), "--shard", str(k), "--encoder", "bytes"])
    commands.main(["validate", at("out")])
    shown = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert sorted(x["samples"] for x in shown) == [1, 1]
    assert sorted(bytes(c[0] for c in r["codes"]).decode() for r in shards.decode_shards(spark, at("out")).collect()) == ["one two", "three"]
    (tmp_path / "r.jsonl").write_text(json.dumps({"dataset": "d", "split": "s", "audio": "a.wav"}) + "\n")
    commands.main(["jsonl", at("r.jsonl"), at("n")])
    assert commands.read_manifest(spark, at("n")).first()["dataset"] == "d"
    with pytest.raises(SystemExit):
        commands.main(["unknown"])


def test_text_command_resumes_and_refuses_other_settings(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commands, "session", lambda: spark)
    at = lambda name: str(tmp_path / name)
    stories = ["one two", "", "drei\nvier", None, "one"]
    spark.createDataFrame([(s,) for s in stories], "text string").coalesce(1).write.parquet(at("stories"))
    spark.createDataFrame([("one", 257), ("two", 258)], "token string, id int").coalesce(1).write.parquet(at("words"))
    asked = ["text", at("stories"), at("out"), "--vocabulary", at("words"), "--alias", "small", "--shards", "2"]
    commands.main(asked)
    assert json.loads((tmp_path / "out/meta_txt.json").read_text()) == {"small": {"tokens": 2, "vocab_size": 259, "eos_id": 256}}
    rows = shards.decode_shards(spark, at("out/train")).orderBy("shard", "place").collect()
    assert [(r["id"], r["text"]) for r in rows] == [("train:00000000", [257, 32, 258, 256]), ("train:00000002", [*b"drei\nvier", 256]), ("train:00000004", [257, 256])]
    back = text.text_of_ids(shards.read_samples(spark, at("out/train"), ("id", "text")), "text", spark.read.parquet(at("words")), "back")
    assert sorted(r["back"] for r in back.collect()) == ["drei\nvier", "one", "one two"]
    before = {p: os.stat(p).st_mtime_ns for p in map(str, (tmp_path / "out").rglob("*.bin"))}
    os.rename(at("out/train/shard-00001"), at("lost"))
    commands.main(asked)  # the lost shard is made anew, the other one stays
    after = {p: os.stat(p).st_mtime_ns for p in map(str, (tmp_path / "out").rglob("*.bin"))}
    assert set(before) == set(after) and [p for p in before if before[p] == after[p]] == [p for p in before if "shard-00000" in p]
    with pytest.raises(Exception, match="different parameters"):
        commands.main([*asked, "--max-samples", "4"])
    spark.createDataFrame([("one", 300)], "token string, id int").coalesce(1).write.parquet(at("others"))
    with pytest.raises(ValueError, match="other metadata of small"):
        commands.main([*asked[:3], "--vocabulary", at("others"), *asked[5:]])
    assert sorted(os.listdir(at("out"))) == ["meta_txt.json", "train"]
    assert shards.claim_metadata(at("out"), "txt", "small", {"tokens": 2, "vocab_size": 259, "eos_id": 256}) is False
