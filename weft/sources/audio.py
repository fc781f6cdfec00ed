"""Segments of RIFF/WAVE files as mono samples (SRC12): integer PCM of 8 to 32 bits and floats, read by seeking."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType, StructField, StructType

from weft.sources.indexed import mounted

#: The format's codes.
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE


def wave_format(f: BinaryIO) -> tuple[int, int, int, int, int, int]:
    """(kind, channels, rate, bits a sample, place of the samples, their bytes); chunks may stand in any order."""
    head = f.read(12)
    if len(head) < 12 or head[:4] != b"RIFF" or head[8:] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    told = place = None
    while len(head := f.read(8)) == 8:
        name, size = struct.unpack("<4sI", head)
        at = f.tell()
        if name == b"fmt ":
            body = f.read(size)
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
            if kind == EXTENSIBLE and len(body) >= 26:
                (kind,) = struct.unpack("<H", body[24:26])
            told = kind, channels, rate, bits
        elif name == b"data":
            place = at, size
        if told and place:
            break
        f.seek(at + size + size % 2)
    if not told or not place or not told[1] or not told[2]:
        raise ValueError("no format or no samples")
    if (told[0], told[3]) not in {(PCM, 8), (PCM, 16), (PCM, 24), (PCM, 32), (FLOAT, 32), (FLOAT, 64)}:
        raise ValueError(f"unsupported samples: kind {told[0]}, {told[3]} bits")
    return *told, *place


def wave_segment(f: BinaryIO, offset: float = 0.0, seconds: float | None = None, target_rate: int | None = None) -> np.ndarray:
    """The mean over channels of a segment, as float32 in [-1, 1]; its own bytes alone are read. Places are rounded half to even, the
    segment ends where the file does. A rate other than target_rate is an error, as there is no resampler."""
    kind, channels, rate, bits, place, size = wave_format(f)
    if target_rate is not None and rate != target_rate:
        raise ValueError(f"the rate is {rate}, not {target_rate}")
    unit = channels * bits // 8
    first = min(round(offset * rate), size // unit)
    wanted = size // unit - first if seconds is None else min(round(seconds * rate), size // unit - first)
    if first < 0 or wanted < 0:
        raise ValueError("a segment must not begin or end before the file")
    f.seek(place + first * unit)
    body = f.read(wanted * unit)
    body = body[: len(body) // unit * unit]
    if kind == FLOAT:
        x = np.frombuffer(body, f"<f{bits // 8}").astype(np.float64)
    elif bits == 24:
        raw = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(np.int32)
        x = (raw[:, 0] << 8 | raw[:, 1] << 16 | raw[:, 2] << 24) / 2.0**31
    elif bits == 8:
        x = (np.frombuffer(body, np.uint8) - 128.0) / 128
    else:
        x = np.frombuffer(body, f"<i{bits // 8}") / 2.0 ** (bits - 1)
    return x.reshape(-1, channels).mean(axis=1).astype(np.float32)


def audio_segments(manifest: DataFrame, target_rate: int | None = None, out: str = "samples", problem: str = "problem") -> DataFrame:
    """manifest (audio, offset, duration, ...) with its segments' samples, or the reason why there are none.

    Tasks open files of mounted folders and seek. Files of other stores come through Spark's reader, whole, joined by path."""
    spark, names = manifest.sparkSession, manifest.columns
    shape = StructType([*manifest.schema.fields, StructField(out, ArrayType(FloatType())), StructField(problem, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents = batch["__content"] if "__content" in batch.schema.names else [None] * batch.num_rows
            for k, content in enumerate(contents):
                row, samples, why = batch.slice(k, 1), None, None
                path, offset, seconds = (row[c][0].as_py() for c in ("audio", "offset", "duration"))
                body = content.as_py() if content is not None else None
                try:
                    if path is None or (body is None and (at := mounted(path)) is None):
                        raise ValueError("no audio")
                    with io.BytesIO(body) if body is not None else open(at, "rb") as f:
                        samples = wave_segment(f, offset or 0.0, seconds, target_rate)
                except (ValueError, OSError, struct.error) as e:
                    why = f"{type(e).__name__}: {e}"
                value = pa.array([samples], pa.list_(pa.float32()))
                yield pa.record_batch([*(row[c] for c in names), value, pa.array([why], pa.string())], names=shape.names)

    near = F.coalesce(~F.col("audio").contains("://"), F.lit(True)) | F.col("audio").startswith("file:")
    opened = manifest.where(near).mapInArrow(run, shape)
    far = [r["audio"] for r in manifest.where(~near).select(F.regexp_extract("audio", r"^(.*)/[^/]*$", 1).alias("audio")).distinct().limit(10_001).collect()]
    if not far:
        return opened
    if len(far) > 10_000:
        raise ValueError("audio lies in more than 10,000 folders; read it by parts")
    files = spark.read.format("binaryFile").load(far).select(F.col("path").alias("audio"), F.col("content").alias("__content"))
    return opened.unionByName(manifest.where(~near).join(files, "audio", "left").select(*names, "__content").mapInArrow(run, shape))
