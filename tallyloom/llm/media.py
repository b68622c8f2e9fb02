"""Media columns: images as bytes in a table, decoded to arrays, resized by area, hashed and tiled.

Decoders for Netpbm (P1 to P6) and uncompressed BMP give numpy arrays. Resizing averages areas
exactly: sums come from an integral image, interpolated at fractional edges. A difference hash
compares neighbours of a 9 x 8 resize; the resize itself is kept as an NPY tile.

The text operator stores each text as a binary graymap of 64 columns in a table of the shared
folder, reads it back and stores the tile and the hash in a second table; each row is on its own, so nothing
is shuffled or gathered.

Defined results: null or empty text is 64 zero samples; equal texts give equal values; images
without samples are refused by the decoders with ValueError; a very long text is one tall image; an empty table
gives empty tables. Both tables stay in the shared folder: they are what the operator writes.
"""

from __future__ import annotations

import hashlib
import io
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import batch_of, bytes_of, fresh_path, struct

WIDTH = 64
NUMBER = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)")


def encode_pgm(samples: np.ndarray) -> bytes:
    """A binary graymap of 8-bit samples."""
    return b"P5\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + np.ascontiguousarray(samples, np.uint8).tobytes()


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as an array of height x width (x 3); 16 bits where the greatest value needs them; a set bit is 0 as ink is black."""
    if not re.match(rb"P[1-6]", data):
        raise ValueError("not a Netpbm image")
    kind, at, fields = data[1] - 48, 2, []
    for _ in range(2 if kind in (1, 4) else 3):
        m = NUMBER.match(data, at)
        if not m:
            raise ValueError("cut short in the header")
        fields.append(int(m[1]))
        at = m.end()
    width, height, most = (*fields, 1)[:3]
    depth = 3 if kind in (3, 6) else 1
    n = width * height * depth
    if not n or not 0 < most < 65536:
        raise ValueError("no samples")
    if kind == 1:
        bits = re.findall(rb"[01]", re.sub(rb"#[^\n]*", b"", data[at:]))[:n]
        values = 1 - np.array(bits, dtype="S1").astype(np.uint8)
    elif kind in (2, 3):
        values = np.array(re.sub(rb"#[^\n]*", b"", data[at:]).split()[:n]).astype(np.int64)
    elif kind == 4:
        row = -(-width // 8)
        packed = np.frombuffer(data, np.uint8, offset=at + 1, count=min(row * height, len(data) - at - 1))
        if len(packed) < row * height:
            raise ValueError("cut short")
        values = 1 - np.unpackbits(packed.reshape(height, row), axis=1)[:, :width].ravel()
    else:
        sample = np.dtype(np.uint8 if most < 256 else ">u2")
        values = np.frombuffer(data, sample, offset=at + 1, count=min(n, (len(data) - at - 1) // sample.itemsize))
    if len(values) < n:
        raise ValueError("cut short")
    values = values.astype(np.uint8 if most < 256 else np.uint16)
    return values.reshape((height, width, 3) if depth == 3 else (height, width))


def encode_bmp(samples: np.ndarray) -> bytes:
    """A BMP of 8-bit gray or 24-bit colour, rows from the bottom."""
    height, width = samples.shape[:2]
    depth = 3 if samples.ndim == 3 else 1
    palette = b"" if depth == 3 else b"".join(bytes((i, i, i, 0)) for i in range(256))
    row = -(-width * depth // 4) * 4
    pixels = np.zeros((height, row), np.uint8)
    body = samples[::-1, :, ::-1] if depth == 3 else samples[::-1]
    pixels[:, : width * depth] = body.reshape(height, -1)
    at = 54 + len(palette)
    whole = at + pixels.size
    head = b"BM" + b"".join(x.to_bytes(4, "little") for x in (whole, 0, at, 40, width, height))
    head += (1).to_bytes(2, "little") + (8 * depth).to_bytes(2, "little") + b"".join(x.to_bytes(4, "little") for x in (0, pixels.size, 2835, 2835, len(palette) // 4, 0))
    return head + palette + pixels.tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits as an array of height x width (x 3)."""
    number = lambda a, n=4: int.from_bytes(data[a : a + n], "little", signed=n == 4)
    if data[:2] != b"BM" or number(14) < 40 or number(30) not in (0, 3):
        raise ValueError("not an uncompressed BMP")
    at, width, height, depth = number(10), number(18), number(22), number(28, 2)
    if width <= 0 or not height or depth not in (1, 4, 8, 24, 32):
        raise ValueError("no samples")
    row = -(-width * depth // 32) * 4
    if len(data) < at + row * abs(height):
        raise ValueError("cut short")
    rows = np.frombuffer(data, np.uint8, row * abs(height), at).reshape(abs(height), row)
    rows = rows[::-1] if height > 0 else rows
    if depth >= 24:
        return rows[:, : width * depth // 8].reshape(abs(height), width, depth // 8)[:, :, 2::-1].copy()
    if depth == 8:
        index = rows[:, :width]
    else:
        bits = np.unpackbits(rows, axis=1).reshape(abs(height), -1, depth)[:, :width]
        index = (bits * (1 << np.arange(depth)[::-1])).sum(axis=2).astype(np.uint8)
    start = 14 + number(14)
    used = number(46) or 1 << depth
    palette = np.frombuffer(data, np.uint8, used * 4, start).reshape(-1, 4)[:, 2::-1]
    colours = palette[np.minimum(index, used - 1)]
    return colours[:, :, 0].copy() if (palette == palette[:, :1]).all() else colours.copy()


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def gray(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means of the areas that each of height x width pixels covers, through an integral image."""
    total = np.zeros((image.shape[0] + 1, image.shape[1] + 1))
    total[1:, 1:] = np.cumsum(np.cumsum(image, axis=0, dtype=np.float64), axis=1)
    for axis, n in ((0, height), (1, width)):
        size = image.shape[axis]
        edge = np.arange(n + 1) * size / n
        low = np.minimum(edge.astype(np.int64), size - 1)
        part = (edge - low).reshape((-1, 1) if axis == 0 else (1, -1))
        at = np.take(total, low, axis=axis)
        total = at + (np.take(total, low + 1, axis=axis) - at) * part
    sums = np.diff(np.diff(total, axis=0), axis=1)
    return sums / (image.shape[0] / height * image.shape[1] / width)


def difference_hash(image: np.ndarray) -> tuple[str, np.ndarray]:
    """64 bits, each set if a pixel of the 9 x 8 resize is darker than its right neighbour; and that resize."""
    tile = np.round(area_resize(gray(image), 8, 9), 6)
    bits = np.packbits((tile[:, :-1] < tile[:, 1:]).ravel())
    return bits.tobytes().hex(), tile


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def payload_of(text: bytes) -> bytes:
    size = max(1, -(-len(text) // WIDTH)) * WIDTH
    return text.ljust(size, b"\0")


def write_media(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """A table of id, n_bytes and the stored graymap of each text."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = struct((id_col, kind), ("n_bytes", "long"), ("media", "binary"))

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            media = [encode_pgm(np.frombuffer(payload_of(t), np.uint8).reshape(-1, WIDTH)) for t in texts]
            yield batch_of({id_col: batch.column(0), "n_bytes": [len(t) for t in texts], "media": media}, schema)

    docs.select(F.col(f"`{id_col}`"), bytes_of(text_col)).mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)


def features(media: DataFrame, id_col: str = "doc_id", column: str = "media") -> DataFrame:
    """For each stored image: what was in it (digests), its difference hash and its tile; n_bytes passes through."""
    kind = media.schema[id_col].dataType.simpleString()
    schema = struct((id_col, kind), ("n_bytes", "long"), ("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string"), ("tile", "binary"))

    def run(batches):
        for batch in batches:
            out = {f.name: [] for f in schema}
            for data in batch.column(2).to_pylist():
                image = decode(data)
                payload = image.tobytes()
                mark, tile = difference_hash(image)
                for name, value in (("payload_bytes", len(payload)), ("payload_sha256", hashlib.sha256(payload).hexdigest()), ("tail_crc32", zlib.crc32(payload[-WIDTH:])), ("media_bytes", len(data)), ("media_sha256", hashlib.sha256(data).hexdigest()), ("feature", mark), ("tile", npy(tile.astype(np.float32)))):
                    out[name].append(value)
            yield batch_of(out | {id_col: batch.column(0), "n_bytes": batch.column(1)}, schema)

    return media.select(F.col(f"`{id_col}`"), "n_bytes", F.col(f"`{column}`")).mapInArrow(run, schema)


def stored_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores all texts as images in the shared folder, and their features and NPY tiles beside them; returns what the second table holds."""
    spark, path = docs.sparkSession, fresh_path(docs.sparkSession, "media")
    write_media(docs, f"{path}/images", id_col, text_col)
    features(spark.read.parquet(f"{path}/images"), id_col).write.option("compression", "zstd").parquet(f"{path}/tiles")
    return spark.read.parquet(f"{path}/tiles")
