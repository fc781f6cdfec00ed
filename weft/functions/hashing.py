"""Stable ids, digests and counter-based random numbers (HSH1, STR3, STR5, SMP3, SMP4)."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, functions as F

#: The multipliers of a sample's rank and index in its seed.
RANK_STEP, INDEX_STEP = 1_000_003, 97_409
_DIGITS = 13  # 52 bits: exact in a double
#: How many values uniform() can take: a multiple of its steps.
HASH_CELLS = 16**_DIGITS


def stable_id(dataset: Column, split: Column, key: Column) -> Column:
    """dataset:split: and the first 16 hex digits of the key's SHA-1."""
    return F.concat_ws(":", dataset, split, F.substring(F.sha1(key), 1, 16))


def uniform(*parts: Column | str | int) -> Column:
    """A number in [0, 1) that depends on the parts' text alone, so on no partitioning or order."""
    text = F.concat_ws(":", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, _DIGITS), 16, 10).cast("long") / F.lit(float(16**_DIGITS))


def uniform_of(*parts: str | int) -> float:
    """The same number in Python."""
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:_DIGITS], 16) / float(16**_DIGITS)


def uniform_sql(*parts: str) -> str:
    """The same number in DuckDB."""
    return f"(('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, {_DIGITS}))::bigint / {float(16**_DIGITS)!r})"


def sample_seed(seed: int, rank: Column, index: Column) -> Column:
    return (F.lit(seed).cast("long") + F.lit(RANK_STEP).cast("long") * rank + F.lit(INDEX_STEP).cast("long") * index) % F.lit(1 << 32)


def record_seed(seed: int, index: Column) -> Column:
    return (F.lit(seed).cast("long") + F.lit(RANK_STEP).cast("long") * index) % F.lit(1 << 32)


def safe_name(name: Column, suffix: str = ".flac") -> Column:
    """A file name: runs of other characters become _, then 10 digits of the name's SHA-1."""
    return F.concat(F.regexp_replace(name, r"[^A-Za-z0-9_.-]+", "_"), F.lit("-"), F.substring(F.sha1(name), 1, 10), F.lit(suffix))
