"""SHA-256 over ordered rows (AGG23, AGG26, LIM2): sorted rows pass by batch by batch, no list is ever built."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def ordered_digest(rows: DataFrame, keys: list[str], order: list[Column | str], piece: Column, separator: str = "", prefix: str = "", suffix: str = "") -> DataFrame:
    """keys, rows and the digest of prefix, pieces (strings or bytes; null ones are empty) in order and suffix, one row a key.

    A digest is sequential by definition, so one task takes a key's rows; it holds a batch of them, however many there are."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    told = rows.select(*keys, *(F.col(o) if isinstance(o, str) else o for o in order), F.coalesce(piece.cast("binary"), F.lit(b"")).alias("__piece"))
    places = told.columns[len(keys) : -1]
    ordered = told.repartition(*keys).sortWithinPartitions(*keys, *places).select(*keys, "__piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, state = None, 0, hashlib.sha256()

        def done() -> pa.RecordBatch:
            state.update(suffix.encode())
            return pa.record_batch([*(pa.array([v], batch.schema.field(k).type) for k, v in zip(keys, key, strict=True)), pa.array([n], pa.int64()), pa.array([state.hexdigest()])], names=[*keys, "rows", "digest"])

        batch = None
        for batch in batches:
            names = zip(*(batch[k].to_pylist() for k in keys), strict=True)
            for name, body in zip(names, batch["__piece"], strict=True):
                if name != key:
                    if key is not None:
                        yield done()
                    key, n, state = name, 0, hashlib.sha256(prefix.encode())
                elif separator:
                    state.update(separator.encode())
                state.update(body.as_py())
                n += 1
        if key is not None:
            yield done()

    return ordered.mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "rows long, digest string"]))
