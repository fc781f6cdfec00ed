"""Benchmark files (SRC10, SRC11, SNK6, SNK9) and configurations (SRC13, SRC15, V7, V16)."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession, functions as F

from weft.operators.evaluation import story_pivot
from weft.sources.manifests import require, unique

STORY_COLUMNS = ("pair_id", "text", "type", "correctness")
#: Fixed value: questions of the published story benchmark.
STORY_QUESTIONS = 1871
STRATEGIES = ("txt", "img", "aud", "imgtxt", "audtxt")


def story_csv(spark: SparkSession, path: str) -> DataFrame:
    """place and the four columns of a header CSV, in file order."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    if missing := [c for c in STORY_COLUMNS if c not in rows.columns]:
        raise ValueError(f"missing columns: {missing}")
    return rows.select(F.monotonically_increasing_id().alias("place"), *STORY_COLUMNS)


def story_manifest(spark: SparkSession, path: str, expected: int | None = STORY_QUESTIONS) -> DataFrame:
    """id, prompt, chosen and rejected of each question in first-seen order."""
    s = story_pivot(story_csv(spark, path), expected)
    s = require(s, F.col("problem").isNull(), F.concat(F.col("pair_id"), F.lit(": "), F.col("problem")))
    return s.orderBy("first").select(F.col("pair_id").alias("id"), "prompt", "chosen", "rejected")


def write_story_manifest(manifest: DataFrame, path: str, revision: str) -> None:
    """JSON lines beside a metadata file; an existing target is refused."""
    manifest.write.mode("errorifexists").json(path)
    told = manifest.agg(F.lit(revision).alias("revision"), F.count("*").alias("num_examples"), digest_of(manifest).alias("manifest_sha256"))
    told.write.mode("errorifexists").json(f"{path}.meta")


def digest_of(manifest: DataFrame):
    """Order-independent digest: SHA-256 over the sorted digests of the rows (a bounded benchmark)."""
    row = F.sha2(F.to_json(F.struct("id", "prompt", "chosen", "rejected")), 256)
    return F.sha2(F.array_join(F.array_sort(F.collect_list(row)), ","), 256)


def read_story_manifest(spark: SparkSession, path: str, revision: str, expected: int | None = STORY_QUESTIONS) -> DataFrame:
    """The written manifest, checked against its metadata: revision, digest, count, ids and blank texts."""
    rows = spark.read.schema("id string, prompt string, chosen string, rejected string").json(path)
    told = spark.read.json(f"{path}.meta").first()
    now = rows.agg(F.count("*").alias("n"), digest_of(rows).alias("digest")).first()
    if told["revision"] != revision:
        raise ValueError("revision mismatch")
    if told["manifest_sha256"] != now["digest"]:
        raise ValueError("checksum mismatch")
    if told["num_examples"] != now["n"] or (expected is not None and now["n"] != expected):
        raise ValueError("unexpected number of examples")
    filled = require(rows, F.forall(F.array("id", "prompt", "chosen", "rejected"), lambda x: F.coalesce(F.trim(x), F.lit("")) != ""), "blank field")
    return unique(filled, "id", "duplicate id")


@dataclass
class MixtureConfig:
    """Streams to mix: five strategy weights, datasets by strategy with optional probabilities, layout settings."""

    weights: list[float]
    datasets: dict[str, list[str]] = field(default_factory=dict)
    probabilities: dict[str, list[float]] = field(default_factory=dict)
    splits: list[str] = field(default_factory=lambda: ["train"])
    block_size: int = 2048
    aligned: bool = False
    seed: int = 0

    def __post_init__(self) -> None:
        if len(self.weights) != len(STRATEGIES) or any(not math.isfinite(w) or w < 0 for w in self.weights) or not any(self.weights):
            raise ValueError("five finite weights, not negative and not all zero, are needed")
        if not self.splits:
            raise ValueError("a split is needed")
        for name, w in zip(STRATEGIES, self.weights, strict=True):
            if w and not self.datasets.get(name):
                raise ValueError(f"{name} is enabled without datasets")
            odds = self.probabilities.get(name)
            if odds is not None and (len(odds) != len(self.datasets.get(name, [])) or any(not math.isfinite(p) or p < 0 for p in odds) or not any(odds)):
                raise ValueError(f"{name}: one probability a dataset, finite and not all zero")
        if self.aligned and self.weights[STRATEGIES.index("imgtxt")]:
            raise ValueError("the frame-synchronous layout has no image strategy")


def load_config(text: str) -> MixtureConfig:
    """A JSON configuration; unknown keys are refused."""
    found = json.loads(text)
    if unknown := sorted(set(found) - {f.name for f in fields(MixtureConfig)}):
        raise ValueError(f"unknown keys: {unknown}")
    return MixtureConfig(**found)


@dataclass
class ModelConfig:
    """What a model's configuration must keep (V16); counts of codebooks are 0 where a modality is absent."""

    text: bool = True
    image_codebooks: int = 0
    audio_codebooks: int = 0
    image_codebook_weights: list[float] | None = None
    audio_codebook_weights: list[float] | None = None
    image_delays: list[int] | None = None
    audio_delays: list[int] | None = None
    text_pad_loss_weight: float = 1.0
    text_pad: int | None = None
    image_pad: int | None = None
    audio_pad: int | None = None
    audio_head: str = "categorical"
    audio_codebook_layers: int = 0
    audio_text_prefix: bool = False

    def __post_init__(self) -> None:
        for name, count in (("image", self.image_codebooks), ("audio", self.audio_codebooks)):
            weights, delays = getattr(self, f"{name}_codebook_weights"), getattr(self, f"{name}_delays")
            if weights is not None and (len(weights) != count or any(w <= 0 for w in weights)):
                raise ValueError(f"{name}: one positive weight for each codebook")
            if delays is None:
                setattr(self, f"{name}_delays", list(range(count)))
            elif len(delays) != count or any(not isinstance(d, int) or d < 0 for d in delays):
                raise ValueError(f"{name}: one delay for each codebook, an integer of 0 or more")
            if count and getattr(self, f"{name}_pad") is None:
                raise ValueError(f"{name}: a padding id is needed")
        if self.text and (self.image_codebooks or self.audio_codebooks) and self.text_pad is None:
            raise ValueError("text beside another modality needs a padding id")
        if self.text_pad_loss_weight <= 0:
            raise ValueError("the padding's loss weight must be positive")
        if self.audio_text_prefix and not (self.text and self.audio_codebooks and self.audio_head == "categorical" and self.audio_codebook_layers > 0):
            raise ValueError("a text prefix in the codebook transformer needs text, categorical audio and its layers")


def load_training_config(text: str) -> tuple[MixtureConfig, MixtureConfig, ModelConfig, dict]:
    """Training and validation mixtures, the model and the remaining settings of one JSON configuration (SRC13).

    Keys: train, validation, model and settings; an unknown key at the top, in a mixture or in the model is refused."""
    found = json.loads(text)
    if unknown := sorted(set(found) - {"train", "validation", "model", "settings"}):
        raise ValueError(f"unknown keys: {unknown}")
    if missing := sorted({"train", "validation", "model"} - set(found)):
        raise ValueError(f"missing keys: {missing}")
    if unknown := sorted(set(found["model"]) - {f.name for f in fields(ModelConfig)}):
        raise ValueError(f"unknown model keys: {unknown}")
    train, validation = (load_config(json.dumps(found[k])) for k in ("train", "validation"))
    return train, validation, ModelConfig(**found["model"]), found.get("settings", {})


def load_renderer_config(spark: SparkSession, folder: str, **overrides: object) -> dict:
    """A renderer's settings (SRC15): text_renderer_config.json of the folder, its font's relative path resolved against the
    folder, then the overrides."""
    body = spark.read.text(f"{folder.rstrip('/')}/text_renderer_config.json", wholetext=True).first()["value"]
    config = json.loads(body)
    if not config["font_file"].startswith("/"):
        config["font_file"] = f"{folder.rstrip('/')}/{config['font_file']}"
    return config | overrides
