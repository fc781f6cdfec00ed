"""Shard directories (SRC6-SRC8, SNK2-SNK4, SNK7, V2-V4, V9, V12): binary columns, lengths, JSON sidecars, checksums.

Kinds of shards: `units-only` and `aligned` (speech units), `text` (token ids) and `rendered` (image codes with one
token a step). decode_shards() reads all of them through Spark's own file reader, so any store that Spark reads
will do. The data source `packed_shard` writes (and reads) folders that all executors mount: tasks write aside,
the commit publishes by renaming, an abort removes what was written.

A sample is checked before a byte of it is written; one that fails goes to skips.jsonl with its reason, and so do rows
that come with a `skip` reason. A shard without any sample is an error that leaves NAME.failed.json and
NAME.failed.skips.jsonl, which the next successful attempt removes. Samples stand in order of `place` where the rows have
one, else of id.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from weft.operators.validation import RESERVED
from weft.sources import indexed

#: The format's file names and number types.
VERSION = 1
CODES, STEPS, TEXT, TEXT_COUNTS, DURATIONS = "audio.bin", "audio.len", "text.bin", "text.len", "dur.bin"
IMAGE, IMAGE_STEPS = "image.bin", "image.len"
CODE, COUNT, WORD = "<i2", "<i8", "<i4"
SAMPLES, SKIPS, META = "samples.jsonl", "skips.jsonl", "meta.json"
SLICE_BYTES = 64 << 20
MODALITY = {"text": "text", "rendered": "rendered-text"}
PROFILES = ("units-only", "aligned", "text", "rendered")

SCHEMA = "shard string, place int, id string, codes array<array<smallint>>, text array<int>, dur array<int>, metadata string"
WRITTEN = ("shard", "place", "id", "codes", "text", "dur", "metadata", "skip", "detail", "waveform", "sample_rate")


def cut(flat: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    return np.split(flat, np.cumsum(lengths)[:-1]) if len(lengths) else []


def _listed(x: object) -> list | None:
    return None if x is None or (isinstance(x, float) and np.isnan(x)) else list(x)


def sample_problem(sample: dict, profile: str, books: int) -> str | None:
    """Why a sample (id, codes, text, dur, metadata) cannot be written; null where it can."""
    codes, text, dur = (_listed(sample.get(k)) for k in ("codes", "text", "dur"))
    own = set(json.loads(sample.get("metadata") or "{}")) & set(RESERVED)
    if profile != "text":
        widths = {len(c) if isinstance(c, (list, tuple, np.ndarray)) else 1 for c in codes or []}
        if widths != {books}:
            return "invalid code shape"
        flat = np.array([np.ravel(c) for c in codes], np.int64)
        if flat.min() < 0 or flat.max() > np.iinfo(np.int16).max:
            return "codes outside the int16 range"
    if own:
        return f"metadata uses reserved fields: {sorted(own)}"
    if profile == "aligned":
        if text is None or dur is None:
            return "the aligned profile needs text and durations"
        if not text or len(text) != len(dur) or min(dur) <= 0:
            return "invalid alignment"
        if sum(dur) != len(codes):
            return "the alignment does not cover all steps"
    if profile == "rendered" and len(text or []) != len(codes):
        return "not one token for each step"
    if profile == "text" and len(text or []) < 2:
        return "empty tokenized document"
    return None


def _line(rows: list[dict]) -> bytes:
    return "".join(json.dumps(x, ensure_ascii=False, sort_keys=True) + "\n" for x in rows).encode()


def _json(x: dict) -> bytes:
    return (json.dumps(x, indent=2, sort_keys=True) + "\n").encode()


def encode(samples: pd.DataFrame, profile: str, books: int, preprocessing: dict, skips: list[dict], keep_audio: bool = False) -> dict[str, bytes]:
    """All files of one shard. Samples that cannot be written join the skips; raises EmptyShard if none is left."""
    if profile not in PROFILES:
        raise ValueError(f"profile must be one of {PROFILES}")
    if books < 1:
        raise ValueError("the number of codebooks must be positive")
    kept, skips = [], list(skips)
    for row in samples.to_dict("records"):
        why = sample_problem(row, profile, books)
        if why is None:
            kept.append(row)
        else:
            skips.append({"id": row["id"], "reason": "ValueError", "detail": why})
    if not kept:
        raise EmptyShard(profile, preprocessing, skips)
    as_array = lambda row, k, kind: np.array([np.ravel(x) for x in row[k]], kind) if k == "codes" else np.array(list(row[k]), kind)
    column = lambda k, kind: [as_array(r, k, kind) for r in kept]
    join = lambda xs: b"".join(x.tobytes() for x in xs)
    counts = lambda xs: np.array([len(x) for x in xs], COUNT).tobytes()
    codes = column("codes", CODE) if profile != "text" else []
    text = column("text", WORD) if profile != "units-only" else []
    files, waveforms = {}, {}
    rows = [json.loads(r["metadata"] or "{}") | {"id": r["id"]} for r in kept]
    if profile in ("units-only", "aligned"):
        files |= {CODES: join(codes), STEPS: counts(codes)}
        for row, c in zip(rows, codes, strict=True):
            row["audio_steps"] = len(c)
        if keep_audio:
            waveforms = {name: data for row, r in zip(rows, kept, strict=True) for name, data in _waveform(row, r)}
    if profile == "aligned":
        files |= {TEXT: join(text), TEXT_COUNTS: counts(text), DURATIONS: join(column("dur", WORD))}
        for row, t in zip(rows, text, strict=True):
            row["text_tokens"] = len(t)
    elif profile == "text":
        files |= {TEXT: join(text), TEXT_COUNTS: counts(text)}
        for row, t in zip(rows, text, strict=True):
            row["tokens"] = len(t)
    elif profile == "rendered":
        files |= {IMAGE: join(codes), IMAGE_STEPS: counts(codes), TEXT: join(text)}
        for row, c in zip(rows, codes, strict=True):
            row["steps"] = len(c)
    files |= {SAMPLES: _line(rows), SKIPS: _line(skips)} | waveforms
    steps, tokens = sum(map(len, codes)), sum(map(len, text))
    told = {"num_samples": len(kept), "num_skipped": len(skips), "schema_version": VERSION, "checksums": {k: hashlib.sha256(v).hexdigest() for k, v in sorted(files.items())}}
    if profile == "text":
        told |= {"modality": MODALITY[profile], "num_tokens": tokens, "request": preprocessing}
    elif profile == "rendered":
        told |= {"modality": MODALITY[profile], "num_steps": steps, "n_codebooks": books, "request": preprocessing}
    else:
        told |= {"profile": profile, "n_codebooks": books, "num_audio_steps": steps, "num_text_tokens": tokens, "keep_audio": keep_audio, "preprocessing": preprocessing}
    return files | {META: _json(told)}


class EmptyShard(ValueError):
    """No sample is left; holds the diagnostics' files by their suffix."""

    def __init__(self, profile: str, preprocessing: dict, skips: list[dict]):
        super().__init__("refusing to publish an empty shard")
        lines = _line(skips)
        told = {"schema_version": VERSION, "profile": profile, "num_assigned_records": preprocessing.get("num_assigned_records"), "num_skipped": len(skips), "skips_sha256": hashlib.sha256(lines).hexdigest()}
        self.files = {".failed.skips.jsonl": lines, ".failed.json": _json(told)}


def _waveform(row: dict, sample: dict) -> Iterator[tuple[str, bytes]]:
    """The file of a kept waveform; its name joins the sample's row."""
    if (wave := _listed(sample.get("waveform"))) is None:
        return
    import io

    try:
        import soundfile
    except ImportError as e:
        raise ImportError("soundfile is needed to keep audio") from e
    safe = re.sub(r"[^A-Za-z0-9_.-]+", "_", sample["id"])
    row["prepared_audio"] = f"waveforms/{safe}-{hashlib.sha1(sample['id'].encode(), usedforsecurity=False).hexdigest()[:10]}.flac"
    out = io.BytesIO()
    soundfile.write(out, np.array(wave, np.float32), int(sample.get("sample_rate") or 16000), format="FLAC")
    yield row["prepared_audio"], out.getvalue()


def same_request(meta: dict, profile: str, books: int, preprocessing: dict, keep_audio: bool) -> bool:
    """Whether a finished shard was prepared with these parameters."""
    if profile in MODALITY:
        return (meta.get("modality"), meta.get("request"), meta.get("n_codebooks", books)) == (MODALITY[profile], preprocessing, books)
    return (meta.get("profile"), meta.get("n_codebooks"), meta.get("preprocessing"), bool(meta.get("keep_audio"))) == (profile, books, preprocessing, keep_audio)


def decode(shard: str, files: dict[str, bytes], verify: bool = True) -> pd.DataFrame:
    """Samples of one shard of any kind; raises ValueError with the first broken rule."""
    if META not in files:
        raise ValueError(f"{shard}: no meta.json")
    meta = json.loads(files[META])
    if meta.get("schema_version") != VERSION:
        raise ValueError(f"{shard}: schema version")
    rows = [json.loads(x) for x in files.get(SAMPLES, b"").decode().splitlines() if x.strip()]
    kinds = {v: k for k, v in MODALITY.items()}
    profile = kinds[meta["modality"]] if "modality" in meta else meta["profile"]
    lengths = {"text": TEXT_COUNTS, "rendered": IMAGE_STEPS}.get(profile, STEPS)
    steps, books = np.frombuffer(files[lengths], COUNT), int(meta.get("n_codebooks", 1))
    total = int(steps.sum())
    checks = [("sample count", len(steps) == meta["num_samples"]), ("lengths", (steps > 0).all())]
    if profile == "text":
        checks += [("token count", total == meta["num_tokens"]), ("text size", len(files[TEXT]) == total * 4)]
    elif profile == "rendered":
        checks += [("step count", total == meta["num_steps"]), ("image size", len(files[IMAGE]) == total * books * 2), ("text size", len(files[TEXT]) == total * 4)]
    else:
        checks += [("audio steps", total == meta["num_audio_steps"]), ("audio size", len(files[CODES]) == total * books * 2)]
    checks += [("metadata count", len(rows) == len(steps)), ("sample ids", all(r.get("id") for r in rows) and len({r["id"] for r in rows}) == len(rows))]
    counts = np.frombuffer(files[TEXT_COUNTS], COUNT) if profile == "aligned" else steps
    if profile == "aligned":
        checks += [("text counts", len(counts) == len(steps)), ("text size", len(files[TEXT]) == int(counts.sum()) * 4 and len(files[DURATIONS]) == int(counts.sum()) * 4)]
    checks += [("checksums", all(hashlib.sha256(files.get(k, b"")).hexdigest() == v for k, v in meta["checksums"].items() if not k.startswith("waveforms/")))] if verify else []
    for name, ok in checks:
        if not ok:
            raise ValueError(f"{shard}: {name}")
    none = [None] * len(steps)
    lists = lambda name, kind, sizes, width=None: [x.tolist() for x in cut(np.frombuffer(files[name], kind).reshape(-1, width) if width else np.frombuffer(files[name], kind), sizes)]
    codes = none if profile == "text" else lists(IMAGE if profile == "rendered" else CODES, CODE, steps, books)
    text = none if profile == "units-only" else lists(TEXT, WORD, counts)
    dur = lists(DURATIONS, WORD, counts) if profile == "aligned" else none
    if profile == "aligned" and any(sum(d) != n or min(d, default=0) <= 0 for d, n in zip(dur, steps, strict=True)):
        raise ValueError(f"{shard}: duration sums")
    own = ("id", "audio_steps", "text_tokens", "tokens", "steps")
    told = [json.dumps({k: v for k, v in r.items() if k not in own}, sort_keys=True) for r in rows]
    return pd.DataFrame({"shard": shard, "place": np.arange(len(steps), dtype=np.int32), "id": [r["id"] for r in rows], "codes": codes, "text": text, "dur": dur, "metadata": told})


def decode_shards(spark: SparkSession, root: str, verify: bool = True) -> DataFrame:
    """Samples of all shards below root; one group a shard, whose size the shard plan bounds."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "{*.bin,*.len,*.jsonl,meta.json}").load(root)
    named = files.select(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("shard"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "content")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        return decode(part["shard"].iloc[0], dict(zip(part["file"], part["content"], strict=True)), verify)

    return named.groupBy("shard").applyInPandas(run, SCHEMA)


def decode_parts(spark: SparkSession, root: str, part: str, books: int, alias: str | None = None, number: str = CODE, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(place, codes, text) of a ragged part of a mounted folder: `part`.bin, `part`.len and, with an alias, `part`_`alias`.bin.

    Entries are dealt out in ranges at prefix sums of their lengths; a task reads its own bytes of each file."""
    root = indexed.mounted(root) or root
    steps = np.fromfile(os.path.join(root, f"{part}.len"), COUNT)
    starts = np.concatenate(([0], np.cumsum(steps)))
    unit = books * np.dtype(number).itemsize
    names = [(f"{part}.bin", number, unit)] + ([(f"{part}_{alias}.bin", WORD, np.dtype(WORD).itemsize)] if alias else [])
    for name, _, width in names:
        if os.path.getsize(os.path.join(root, name)) != int(starts[-1]) * width:
            raise ValueError(f"{name}: size")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first, last, low, body in batch.itertuples(index=False):
                sizes = np.frombuffer(body, COUNT)
                parts = []
                for name, kind, width in names:
                    with open(os.path.join(root, name), "rb") as f:
                        f.seek(low * width)
                        parts.append(np.frombuffer(f.read(int(sizes.sum()) * width), kind))
                codes = [x.tolist() for x in cut(parts[0].reshape(-1, books), sizes)]
                text = [x.tolist() for x in cut(parts[1], sizes)] if alias else [None] * len(sizes)
                yield pd.DataFrame({"place": np.arange(first, last, dtype=np.int32), "codes": codes, "text": text})

    ranges = [(a, b, int(starts[a]), steps[a:b].tobytes()) for a, b in slices(steps * unit, slice_bytes)]
    rows = spark.createDataFrame(ranges, "first long, last long, low long, sizes binary").repartition(max(1, len(ranges)))
    return rows.mapInPandas(run, "place int, codes array<array<int>>, text array<int>")


def part_problem(lengths: bytes | None, expected: int) -> str | None:
    """Why a prepared part is not complete (V12): no lengths, or not as many as there should be."""
    if lengths is None:
        return "no lengths"
    return None if len(lengths) == expected * np.dtype(COUNT).itemsize else "entries missing"


def write_part(rows: DataFrame, root: str, part: str, alias: str | None = None, number: str = CODE) -> None:
    """A ragged part (SNK7) of rows (place, codes, text) in order of place: bin, len and, with an alias, the text beside.

    A part is one unit: its rows meet in one task, which appends them batch by batch to files aside and renames them."""
    names = {f"{part}.bin": "codes", f"{part}.len": None} | ({f"{part}_{alias}.bin": "text"} if alias else {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(root, exist_ok=True)
        aside = {name: os.path.join(root, f".{name}.{uuid.uuid4().hex}") for name in names}
        n = 0
        streams = {name: open(path, "wb") for name, path in aside.items()}  # noqa: SIM115
        try:
            for batch in batches:
                for row in batch.to_dict("records"):
                    codes = np.array([np.ravel(c) for c in row["codes"]], number)
                    streams[f"{part}.bin"].write(codes.tobytes())
                    streams[f"{part}.len"].write(np.array([len(codes)], COUNT).tobytes())
                    if alias:
                        streams[f"{part}_{alias}.bin"].write(np.array(list(row["text"]), WORD).tobytes())
                    n += 1
        finally:
            for stream in streams.values():
                stream.close()
        for name, path in aside.items():
            os.replace(path, os.path.join(root, name))
        yield pd.DataFrame({"n": [n]})

    rows.select("place", "codes", *(["text"] if alias else [])).repartition(1).sortWithinPartitions("place").mapInPandas(run, "n long").collect()


class Packed:
    """One shard's folder, opened for reads of ranges of samples; `read_bytes` counts what was read of each file.

    Opening reads meta.json and the lengths only and checks them against the files' sizes. A range reads its own bytes of the
    columns asked for; samples.jsonl, whose lines differ in length, is opened for id and metadata alone, up to the range's end."""

    def __init__(self, path: str):
        with open(os.path.join(path, META)) as f:
            self.meta = json.load(f)
        if self.meta.get("schema_version") != VERSION:
            raise ValueError(f"{path}: schema version")
        kinds = {v: k for k, v in MODALITY.items()}
        self.path, self.read_bytes = path, {}
        self.profile = kinds[self.meta["modality"]] if "modality" in self.meta else self.meta["profile"]
        books = int(self.meta.get("n_codebooks", 1))
        steps = {"text": TEXT_COUNTS, "rendered": IMAGE_STEPS}.get(self.profile, STEPS)
        #: column to (file, number type, numbers a step, first step of each sample and the end)
        self.columns: dict[str, tuple[str, str, int, np.ndarray]] = {}
        at = self._starts(steps)
        if self.profile != "text":
            self.columns["codes"] = (IMAGE if self.profile == "rendered" else CODES, CODE, books, at)
        if self.profile != "units-only":
            words = self._starts(TEXT_COUNTS) if self.profile == "aligned" else at
            self.columns["text"] = (TEXT, WORD, 1, words)
            if self.profile == "aligned":
                self.columns["dur"] = (DURATIONS, WORD, 1, words)
        for name, kind, width, starts in self.columns.values():
            if len(starts) - 1 != self.meta["num_samples"]:
                raise ValueError(f"{path}: sample count")
            if os.path.getsize(os.path.join(path, name)) != int(starts[-1]) * width * np.dtype(kind).itemsize:
                raise ValueError(f"{path}: size of {name}")

    def __len__(self) -> int:
        return int(self.meta["num_samples"])

    def _starts(self, name: str) -> np.ndarray:
        lengths = np.fromfile(os.path.join(self.path, name), COUNT)
        if len(lengths) and lengths.min() <= 0:
            raise ValueError(f"{self.path}: lengths")
        return np.concatenate(([0], np.cumsum(lengths)))

    def weights(self) -> np.ndarray:
        """Bytes of each sample in all columns."""
        return sum((np.diff(starts) * width * np.dtype(kind).itemsize for _, kind, width, starts in self.columns.values()), np.zeros(len(self), np.int64))

    def column(self, column: str, first: int, last: int) -> list[np.ndarray]:
        """One column of the samples from first up to last."""
        name, kind, width, starts = self.columns[column]
        unit = width * np.dtype(kind).itemsize
        low, high = int(starts[first]), int(starts[last])
        with open(os.path.join(self.path, name), "rb") as f:
            f.seek(low * unit)
            body = f.read((high - low) * unit)
        self.read_bytes[name] = self.read_bytes.get(name, 0) + len(body)
        flat = np.frombuffer(body, kind)
        return np.split(flat.reshape(-1, width) if column == "codes" else flat, (starts[first + 1 : last] - low).tolist())

    def told(self, first: int, last: int) -> list[dict]:
        """The samples' lines."""
        out = []
        with open(os.path.join(self.path, SAMPLES), encoding="utf-8") as f:
            for k, line in enumerate(x for x in f if x.strip()):
                if k >= last:
                    break
                self.read_bytes[SAMPLES] = self.read_bytes.get(SAMPLES, 0) + len(line.encode())
                if k >= first:
                    out.append(json.loads(line))
        return out

    def sample(self, index: int) -> dict[str, np.ndarray]:
        if not 0 <= index < len(self):
            raise IndexError(index)
        return {c: self.column(c, index, index + 1)[0] for c in self.columns}

    def rows(self, first: int, last: int, wanted: Iterable[str]) -> Iterator[tuple]:
        """SCHEMA's rows; columns that are not wanted are null and not opened."""
        none = [None] * (last - first)
        lists = [[x.tolist() for x in self.column(c, first, last)] if c in wanted and c in self.columns else none for c in ("codes", "text", "dur")]
        told = self.told(first, last) if {"id", "metadata"} & set(wanted) else none
        own = ("id", "audio_steps", "text_tokens", "tokens", "steps")
        for k in range(last - first):
            line = told[k] or {}
            metadata = json.dumps({a: b for a, b in line.items() if a not in own}, sort_keys=True) if "metadata" in wanted else None
            yield self.path, first + k, line.get("id") if "id" in wanted else None, *(x[k] for x in lists), metadata


def slices(weights: np.ndarray, limit: int, first: int = 0, last: int | None = None) -> list[tuple[int, int]]:
    """[first, last) cut into ranges of about `limit` bytes, one sample at least, at prefix sums of the samples' bytes."""
    last = len(weights) if last is None else min(last, len(weights))
    sums, out = np.concatenate(([0], np.cumsum(weights))), []
    while first < last:
        stop = max(first + 1, min(last, int(np.searchsorted(sums, sums[first] + limit, "right")) - 1))
        out.append((first, stop))
        first = stop
    return out


class _Shard(InputPartition):
    def __init__(self, path: str, first: int = 0, last: int = 0):
        self.path, self.first, self.last = path, first, last


class _Reader(DataSourceReader):
    """Whole shards, one a task, with their checksums."""

    def __init__(self, options: dict[str, str]):
        self.root, self.verify = options["path"], options.get("verify", "true") == "true"

    def shards(self) -> list[str]:
        return [d for d, _, names in sorted(os.walk(self.root)) if META in names and "/.tmp-" not in d]

    def partitions(self) -> list[_Shard]:
        return [_Shard(d) for d in self.shards()]

    def read(self, partition: _Shard) -> Iterator[tuple]:
        files = {}
        for name in os.listdir(partition.path):
            if os.path.isfile(at := os.path.join(partition.path, name)):
                with open(at, "rb") as f:
                    files[name] = f.read()
        for row in decode(partition.path, files, self.verify).itertuples(index=False):
            yield tuple(row)


class _SliceReader(_Reader):
    """Ranges of samples: several partitions a shard, the wanted columns' bytes only, filters on shard and place applied first."""

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.wanted = [c for c in options.get("columns", "id,codes,text,dur,metadata").split(",") if c]
        self.limit = int(options.get("slicebytes", options.get("sliceBytes", SLICE_BYTES)))
        self.low, self.high, self.chosen = 0, None, {"place": None, "shard": None}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name, value = getattr(f, "attribute", (None,))[0], getattr(f, "value", None)
            if name not in self.chosen or value is None or (isinstance(f, In) and None in value):
                yield f
            elif isinstance(f, (EqualTo, In)):
                named = set(value) if isinstance(f, In) else {value}
                self.chosen[name] = named if self.chosen[name] is None else self.chosen[name] & named
            elif name == "place" and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, value + isinstance(f, GreaterThan))
            elif name == "place" and isinstance(f, (LessThan, LessThanOrEqual)):
                end = value + isinstance(f, LessThanOrEqual)
                self.high = end if self.high is None else min(self.high, end)
            else:
                yield f

    def partitions(self) -> list[_Shard]:
        out, places = [], self.chosen["place"]
        for d in self.shards():
            if self.chosen["shard"] is not None and d not in self.chosen["shard"]:
                continue
            weights = Packed(d).weights()
            high = len(weights) if self.high is None else min(self.high, len(weights))
            ranges = [(self.low, high)] if places is None else [(k, k + 1) for k in sorted(places) if self.low <= k < high]
            out += [_Shard(d, a, b) for low, end in ranges for a, b in slices(weights, self.limit, low, end)]
        return out or [_Shard("", 0, 0)]

    def read(self, partition: _Shard) -> Iterator[tuple]:
        if partition.first < partition.last:
            yield from Packed(partition.path).rows(partition.first, partition.last, self.wanted)


class _Written(WriterCommitMessage):
    def __init__(self, shards: list[str]):
        self.shards = shards


class _Writer(DataSourceWriter):
    """Rows (WRITTEN's columns) clustered by shard and in order. Shards that stand with equal settings stay."""

    def __init__(self, options: dict[str, str]):
        self.root, self.profile, self.books = options["path"], options.get("profile", "units-only"), int(options.get("codebooks", "1"))
        self.preprocessing, self.keep_audio = json.loads(options.get("preprocessing", "{}")), options.get("keepAudio", "false") == "true"
        self.stage = os.path.join(self.root, f".tmp-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator) -> _Written:
        shards, rows = [], []
        for row in iterator:  # one shard after another
            if rows and rows[-1]["shard"] != row["shard"]:
                shards.append(self._put(rows))
                rows = []
            rows.append(row.asDict())
        return _Written([*shards, self._put(rows)] if rows else shards)

    def _put(self, rows: list[dict]) -> str:
        shard = rows[0]["shard"]
        final = os.path.join(self.root, shard, META)
        if os.path.exists(final):
            with open(final) as f:
                if not same_request(json.load(f), self.profile, self.books, self.preprocessing, self.keep_audio):
                    raise ValueError(f"completed shard {shard} was prepared with different parameters")
            return shard
        skips = [{"id": r["id"], "reason": r["skip"], "detail": r["detail"] or ""} for r in rows if r["skip"] is not None]
        samples = pd.DataFrame([r for r in rows if r["skip"] is None], columns=list(WRITTEN)).astype(object)
        try:
            files = encode(samples, self.profile, self.books, self.preprocessing, skips, self.keep_audio)
        except EmptyShard as e:
            for suffix, content in e.files.items():
                _store(os.path.join(self.root, shard + suffix), content)
            raise
        folder = os.path.join(self.stage, shard)
        shutil.rmtree(folder, ignore_errors=True)
        for name, content in files.items():
            _store(os.path.join(folder, name), content)
        return shard

    def commit(self, messages: list[_Written | None]) -> None:
        for shard in sorted({s for m in messages if m for s in m.shards}):
            if os.path.isdir(staged := os.path.join(self.stage, shard)):
                os.rename(staged, os.path.join(self.root, shard))
                for suffix in (".failed.json", ".failed.skips.jsonl"):
                    if os.path.exists(old := os.path.join(self.root, shard + suffix)):
                        os.unlink(old)
        shutil.rmtree(self.stage, ignore_errors=True)

    def abort(self, messages: list[_Written | None]) -> None:
        shutil.rmtree(self.stage, ignore_errors=True)


def _store(path: str, content: bytes) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(content)
        f.flush()
        os.fsync(f.fileno())


class PackedShardSource(DataSource):
    """Format `packed_shard`: options path, verify, or slices, columns and sliceBytes (read_samples); for writing profile, codebooks, preprocessing (JSON)."""

    @classmethod
    def name(cls) -> str:
        return "packed_shard"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SliceReader(self.options) if self.options.get("slices") == "true" else _Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options)


def write_shards(samples: DataFrame, root: str, profile: str = "units-only", codebooks: int = 1, preprocessing: dict | None = None, keep_audio: bool = False) -> None:
    """One folder a shard; a shard's rows meet in one task, as its folder is one unit. Columns of WRITTEN that are missing are null."""
    samples.sparkSession.dataSource.register(PackedShardSource)
    os.makedirs(root, exist_ok=True)
    kinds = {"place": "long", "codes": "array<array<int>>", "text": "array<int>", "dur": "array<int>", "waveform": "array<float>", "sample_rate": "int"}
    rows = samples.select(*((F.col(c) if c in samples.columns else F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in WRITTEN))
    rows = rows.repartition("shard").sortWithinPartitions("shard", "place", "id")
    options = {"path": root, "profile": profile, "codebooks": str(codebooks), "preprocessing": json.dumps(preprocessing or {}), "keepAudio": str(keep_audio).lower()}
    rows.write.format("packed_shard").options(**options).mode("append").save()


def read_samples(spark: SparkSession, root: str, columns: Iterable[str] = ("id", "codes", "text", "dur", "metadata"), slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """SCHEMA's rows of all shards below a mounted root, read by ranges of samples; filters on shard and place reach the files.
    Columns that are not asked for are null and their files stay closed. Sizes are checked, checksums are not."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PackedShardSource)
    reader = spark.read.format("packed_shard").option("path", root).option("slices", "true")
    return reader.option("columns", ",".join(columns)).option("sliceBytes", slice_bytes).load()


def claim_metadata(root: str, kind: str, name: str, entry: dict) -> bool:
    """Settle what root's meta_KIND.json says of a name (SNK5): the first writer's file stays, an equal entry is fine, another one
    or none of that name is an error. Returns whether this call wrote it. A whole file appears at once or not at all."""
    path = os.path.join(root, f"meta_{kind}.json")
    os.makedirs(root, exist_ok=True)
    aside = f"{path}.{uuid.uuid4().hex}"
    _store(aside, _json({name: entry}))
    try:
        os.link(aside, path)  # fails where the path is taken
        return True
    except FileExistsError:
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        if held.get(name) != json.loads(json.dumps(entry)):
            raise ValueError(f"{path} holds other metadata of {name}") from None
        return False
    finally:
        os.unlink(aside)


def shard_name(index: int) -> str:
    return f"shard-{index:05d}"


def write_text_shards(texts: DataFrame, root: str, request: dict, shards: int) -> None:
    """Text shards (SNK3): texts (source_index, id, ids with the end id), a contiguous stretch of indices in each shard."""
    from weft.operators.planning import range_shard

    total = texts.agg(F.max("source_index")).first()[0]
    name = F.format_string("shard-%05d", range_shard(F.col("source_index"), (total or 0) + 1, shards))
    told = F.to_json(F.struct("source_index"))
    write_shards(texts.select(name.alias("shard"), F.col("source_index").alias("place"), "id", F.col("ids").alias("text"), told.alias("metadata")), root, "text", 1, request | {"num_shards": shards})
