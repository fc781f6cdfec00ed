"""Media columns: Netpbm and BMP images as numpy arrays, NPY tiles and difference hashes.

decode() reads P1 to P6 (8 and 16 bits a sample, comments allowed) and uncompressed BMP (1, 4, 8, 24 and 32
bits). Samples of a maximum other than 255 or 65535 are scaled to 255 (up to 255) or 65535. Images are shrunk or
enlarged by area: an integral image, linear between its nodes, gives each target cell's exact mean; of the
integral image only the nodes that the target needs are kept, stripe by stripe. A tile is written as NPY; the
difference hash compares neighbours of a 9 x 8 area resize of the grey image.

Defined cases: a null or undecodable image (an unknown format, numbers out of range, more samples claimed than
there are, samples above the maximum, digits other than 0 and 1 in P1) has null results and the reason in `error`;
an empty text is one block of padding, a very long one is kept whole; repeated rows get equal results; an empty table gives
an empty result; extra columns stay as they are, whatever their names.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weft.llm.common import fresh

#: A text's payload is a whole number of 24 x 24 squares.
SIDE = 24
SQUARE = SIDE * SIDE
TILE = 32
STRIPE = 1 << 16  # samples that are summed at once
_TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)")


def decode(data: bytes) -> np.ndarray:
    """Height x width (grey) or height x width x 3, uint8 or uint16."""
    if data[:2] == b"BM":
        return _bmp(data)
    if len(data) > 2 and data[:1] == b"P" and data[1:2] in b"123456":
        return _netpbm(data)
    raise ValueError("unknown image format")


def _number(token: bytes) -> int:
    if not token.isdigit() or len(token) > 9:
        raise ValueError("not a number of 1 to 9 digits")
    return int(token)


def _netpbm(data: bytes) -> np.ndarray:
    kind, at, numbers = data[1] - 48, 2, []
    while len(numbers) < (2 if kind in (1, 4) else 3):
        found = _TOKEN.match(data, at)
        if not found:
            raise ValueError("netpbm header ends early")
        numbers.append(_number(found[1]))
        at = found.end()
    width, height = numbers[:2]
    top = numbers[2] if len(numbers) > 2 else 1
    if width < 1 or height < 1 or not 0 < top < 65536:
        raise ValueError("netpbm header out of range")
    depth = 3 if kind in (3, 6) else 1
    n = width * height * depth
    bits = {1: 8, 2: 8, 3: 8, 4: 1, 5: 16 if top > 255 else 8, 6: 16 if top > 255 else 8}[kind]  # a sample's least size
    if n * bits > 8 * (len(data) - at):
        raise ValueError("netpbm samples end early")
    if kind == 1:
        digits = np.frombuffer(re.sub(rb"#[^\n]*|\s", b"", data[at:])[:n], np.uint8)
        if not np.isin(digits, (48, 49)).all():
            raise ValueError("netpbm bits other than 0 and 1")
        values = 1 - (digits - 48)
    elif kind in (2, 3):
        values = np.array([_number(x) for x in re.sub(rb"#[^\n]*", b"", data[at:]).split(maxsplit=n)[:n]], np.int64)
    elif kind == 4:
        row = (width + 7) // 8
        packed = np.frombuffer(data, np.uint8, row * height, at + 1).reshape(height, row)
        values = 1 - np.unpackbits(packed, axis=1)[:, :width].ravel()
    else:
        values = np.frombuffer(data, ">u2" if top > 255 else np.uint8, n, at + 1)
    if len(values) != n:
        raise ValueError("netpbm samples end early")
    full = 65535 if top > 255 else 255
    if top != full:
        if values.max() > top:
            raise ValueError("netpbm sample above the maximum")
        values = (values.astype(np.int64) * full + top // 2) // top
    elif kind in (2, 3) and values.max() > top:
        raise ValueError("netpbm sample above the maximum")
    values = values.astype(np.uint16 if top > 255 else np.uint8)
    return values.reshape((height, width, 3) if depth == 3 else (height, width))


def _bmp(data: bytes) -> np.ndarray:
    start, = struct.unpack_from("<I", data, 10)
    head, width, height, _, bits, packing = struct.unpack_from("<IiiHHI", data, 14)
    if packing not in (0, 3) or bits not in (1, 4, 8, 24, 32) or width < 1 or height == 0:
        raise ValueError("unsupported BMP")
    row = (width * bits + 31) // 32 * 4
    if start + row * abs(height) > len(data):
        raise ValueError("BMP pixels end early")
    pixels = np.frombuffer(data, np.uint8, row * abs(height), start).reshape(abs(height), row)
    if bits >= 24:
        image = pixels[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[:, :, 2::-1]
    else:
        shifts = np.arange(8 - bits, -1, -bits, dtype=np.uint8)
        index = (pixels[:, :, None] >> shifts & (1 << bits) - 1).reshape(abs(height), -1)[:, :width]
        used = struct.unpack_from("<I", data, 46)[0] or 1 << bits
        palette = np.frombuffer(data, np.uint8, used * 4, 14 + head).reshape(-1, 4)[:, 2::-1]
        image = palette[index]
    image = image[::-1] if height > 0 else image
    grey = (image[..., 0] == image[..., 1]).all() and (image[..., 1] == image[..., 2]).all()
    return np.ascontiguousarray(image[..., 0] if grey else image)


def encode_pgm(samples: bytes, width: int) -> bytes:
    return b"P5\n%d %d\n255\n" % (width, len(samples) // width) + samples


def encode_bmp(image: np.ndarray) -> bytes:
    """8-bit grey or 24-bit colour, bottom row first."""
    height, width = image.shape[:2]
    depth = 1 if image.ndim == 2 else 3
    row = (width * depth + 3) // 4 * 4
    body = np.zeros((height, row), np.uint8)
    body[:, : width * depth] = (image if depth == 1 else image[:, :, ::-1].reshape(height, -1))[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(-1, 4) * np.array([1, 1, 1, 0], np.uint8) if depth == 1 else np.zeros((0, 4), np.uint8)
    start = 54 + palette.size
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", start + body.size, 0, 0, start, 40, width, height, 1, 8 * depth, 0, body.size, 2835, 2835, len(palette), 0) + palette.tobytes() + body.tobytes()


def _nodes(image: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of the rows before each given one: nodes of the integral image along the first axis."""
    stripe = max(1, STRIPE * len(image) // image.size)
    if len(image) <= stripe:
        total = np.zeros((len(image) + 1, *image.shape[1:]))
        np.cumsum(image, 0, out=total[1:])
        return total[rows]
    wanted, at = np.unique(rows, return_inverse=True)
    out = np.zeros((len(wanted), *image.shape[1:]))
    before = 0
    for low in range(0, len(image), stripe):
        total = np.cumsum(image[low : low + stripe], 0, np.float64)
        first, last = np.searchsorted(wanted, (low + 1, low + len(total) + 1))
        out[first:last] = total[wanted[first:last] - low - 1] + before
        before = before + total[-1]
    return out[at]


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Exact area means (float) by an integral image, linear between its nodes; the axis that shrinks most goes first."""
    grid = image
    for axis, n in sorted(((0, height), (1, width)), key=lambda x: x[1] / image.shape[x[0]]):
        size = image.shape[axis]
        edge = np.arange(n + 1) * (size / n)
        low = np.minimum(edge.astype(np.int64), size - 1)
        part = (edge - low).reshape(-1, *[1] * (grid.ndim - 1))
        total = _nodes(grid.swapaxes(axis, 0), np.concatenate([low, low + 1]))
        at = total[: n + 1] * (1 - part) + total[n + 1 :] * part
        grid = (np.diff(at, axis=0) * (n / size)).swapaxes(axis, 0)
    return grid


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])


def difference_hash(image: np.ndarray) -> str:
    small = np.round(grey(area_resize(image, 8, 9)), 6)  # grey is linear, so the order does not matter
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy_tile(image: np.ndarray, side: int = TILE) -> bytes:
    top = np.iinfo(image.dtype).max
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(image, side, side)), 0, top).astype(image.dtype))
    return out.getvalue()


def payload(text: bytes) -> bytes:
    """The bytes and a filling of 255 up to a positive multiple of SQUARE."""
    return text + b"\xff" * (max(SQUARE, -(-len(text) // SQUARE) * SQUARE) - len(text))


IMAGES = "width int, height int, channels int, tile binary, dhash string, error string"


def media_columns(df: DataFrame, image: str = "image", side: int = TILE) -> DataFrame:
    """The columns of df with width, height, channels, an NPY tile, its difference hash and an error.

    Where df has a column of such a name, in any case, it is kept and the new one has an underscore in front."""
    names = fresh(df, *(x.split()[0] for x in IMAGES.split(", ")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch[image].to_pylist():
                try:
                    a = decode(x or b"")
                    rows.append((a.shape[1], a.shape[0], a.shape[2] if a.ndim == 3 else 1, npy_tile(a, side), difference_hash(a), None))
                except (ValueError, struct.error, IndexError, OverflowError) as e:
                    rows.append((None, None, None, None, None, str(e)[:200]))
            if rows:
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string())
                yield pa.record_batch([*batch.columns, *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names=[*batch.schema.names, *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, ", ".join([schema, *(f"`{name}` {x.split()[1]}" for name, x in zip(names, IMAGES.split(", "), strict=True))]))


STORED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_sha256 string"


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch["text"].cast(pa.large_binary()):
            raw = text.as_py() or b""
            media = encode_pgm(payload(raw), SIDE)
            image = decode(media)
            back = image.tobytes()
            rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(image), hashlib.sha256(npy_tile(image)).hexdigest()))
        if rows:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.record_batch([batch["doc_id"], *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names=[x.split()[0] for x in STORED.split(", ")])


def text_media(docs: DataFrame) -> DataFrame:
    """Every text kept as an 8-bit PGM of 24 columns, read back: lengths, digests, difference hash and tile digest."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_store, STORED)
