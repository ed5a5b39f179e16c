"""Media columns: Netpbm and BMP decoded to numpy arrays, area-resized by integral images, written as NPY tiles with difference hashes.

Decoders: Netpbm P1 to P6 (comments, any maxval up to 65535) and uncompressed BMP of 1, 4, 8, 24 or 32 bits. Bytes that are no such image give null features and the reason in `error`. Null media counts as empty bytes, null texts as empty ones; texts of any length are stored whole; a repeated row (or doc_id) gets a row each, equal texts equal values. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import discard, documents, map_arrow, materialize, spread, text_bytes

WIDTH = 64
TILE = 16


def _netpbm_tokens(data: bytes, n: int) -> tuple[list[int], int]:
    """The n numbers after the magic, and where the raster starts."""
    at, out = 2, []
    while len(out) < n:
        while at < len(data) and (data[at] in b" \t\n\r\x0b\x0c" or data[at] == 35):
            at = data.find(b"\n", at) + 1 or len(data) if data[at] == 35 else at + 1
        end = at
        while end < len(data) and 48 <= data[end] <= 57:
            end += 1
        if end == at:
            raise ValueError("Netpbm header is cut short")
        out.append(int(data[at:end]))
        at = end
    return out, at + 1


def decode_netpbm(data: bytes) -> np.ndarray:
    """(height, width) or (height, width, 3) samples; bitmaps give 0 for black and 1 for white."""
    kind = data[1] - 48
    if data[:1] != b"P" or not 1 <= kind <= 6:
        raise ValueError("not a Netpbm image")
    bitmap, planes = kind in (1, 4), 3 if kind in (3, 6) else 1
    head, at = _netpbm_tokens(data, 2 if bitmap else 3)
    w, h, top = head[0], head[1], 1 if bitmap else head[2]
    if not 0 < top < 65536:
        raise ValueError("Netpbm maxval out of range")
    if kind == 4:
        row = (w + 7) // 8
        raw = np.frombuffer(data, np.uint8, row * h, at).reshape(h, row)
        return 1 - np.unpackbits(raw, axis=1)[:, :w]
    if kind in (1, 2, 3):
        body = b"\n".join(x.split(b"#")[0] for x in data[at - 1 :].split(b"\n"))
        values = np.array([int(x) for x in (bytes(body).replace(b"", b" ").split() if kind == 1 else body.split())], np.int64)
        out = values[: w * h * planes].astype(np.uint8 if top < 256 else np.uint16)
        out = 1 - out if kind == 1 else out
    else:
        out = np.frombuffer(data, np.uint8 if top < 256 else ">u2", w * h * planes, at)
    return out.reshape((h, w, 3) if planes == 3 else (h, w))


def decode_bmp(data: bytes) -> np.ndarray:
    """(height, width) of palette greys, or (height, width, 3) in red, green, blue order."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP image")
    at, head = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    w, h, _, bits, packing = struct.unpack_from("<iiHHI", data, 18)
    if packing not in (0, 3) or bits not in (1, 4, 8, 24, 32):
        raise ValueError(f"BMP of {bits} bits with packing {packing} isn't supported")
    row = (w * bits + 31) // 32 * 4
    raw = np.frombuffer(data, np.uint8, row * abs(h), at).reshape(abs(h), row)
    raw = raw[::-1] if h > 0 else raw
    if bits >= 24:
        return raw[:, : w * bits // 8].reshape(abs(h), w, bits // 8)[:, :, 2::-1]
    if bits < 8:
        raw = np.unpackbits(raw, axis=1).reshape(abs(h), -1, bits) @ (1 << np.arange(bits - 1, -1, -1)).astype(np.uint8)
    colours = struct.unpack_from("<I", data, 46)[0] or 1 << bits
    palette = np.frombuffer(data, np.uint8, 4 * colours, 14 + head).reshape(-1, 4)[:, 2::-1]
    pixels = raw[:, :w]
    if (palette == palette[:, :1]).all():
        return palette[:, 0][pixels]
    return palette[pixels]


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def encode_pgm(payload: bytes, width: int = WIDTH) -> bytes:
    """8-bit greys, `width` to a row; the payload's length must be a multiple of it."""
    return b"P5\n%d %d\n255\n" % (width, len(payload) // width) + payload


def encode_bmp(payload: bytes, width: int = WIDTH) -> bytes:
    """The same as an 8-bit BMP with a grey palette, rows from the bottom; width must be a multiple of 4."""
    h = len(payload) // width
    palette = b"".join(bytes((i, i, i, 0)) for i in range(256))
    head = b"BM" + struct.pack("<IHHI", 1078 + len(payload), 0, 0, 1078) + struct.pack("<IiiHHIIiiII", 40, width, h, 1, 8, 0, len(payload), 2835, 2835, 256, 256)
    return head + palette + np.frombuffer(payload, np.uint8).reshape(h, width)[::-1].tobytes()


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the image over each target cell, cells with fractional edges, from one integral image."""
    h, w = image.shape
    if not h or not w:
        raise ValueError("an image without pixels can't be resized")
    total = np.zeros((h + 1, w + 1))
    np.cumsum(np.cumsum(image, 0, dtype=np.float64), 1, out=total[1:, 1:])

    def at(edges: np.ndarray, size: int, table: np.ndarray) -> np.ndarray:
        low = np.minimum(edges.astype(np.int64), size - 1)
        part = (edges - low)[:, None]
        return table[low] * (1 - part) + table[low + 1] * part

    rows, cols = np.arange(height + 1) * (h / height), np.arange(width + 1) * (w / width)
    corner = at(cols, w, at(rows, h, total).T).T
    return np.diff(np.diff(corner, axis=0), axis=1) / ((h / height) * (w / width))


def difference_hash(image: np.ndarray) -> str:
    """64 bits in hex: whether each of 8 x 8 cells is darker than the one to its right."""
    cells = area_resize(image, 8, 9)
    return np.packbits(cells[:, :-1] < cells[:, 1:] - 1e-9).tobytes().hex()


def npy_tile(image: np.ndarray, size: int = TILE) -> bytes:
    """An NPY file of the image resized to size x size, rounded to 8 bits."""
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(image, size, size)), 0, 255).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


def media_features(df: DataFrame, column: str = "media", tile: int = TILE) -> DataFrame:
    """doc_id with the decoded image's height, width, payload (its samples as bytes), NPY tile and difference hash."""

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for data in text_bytes(batch.column(column)):
            try:
                image = decode(data)
                g = grey(image)
                rows.append((*g.shape, np.ascontiguousarray(image).tobytes(), npy_tile(g, tile), difference_hash(g), None))
            except (ValueError, IndexError, struct.error) as e:
                rows.append((None, None, None, None, None, str(e)))
        cols = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column(column), *(pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.string()), strict=True))], ["doc_id", "media", "height", "width", "payload", "tile", "feature", "error"])

    return map_arrow(df.select("doc_id", column), one, "doc_id long, media binary, height int, width int, payload binary, tile binary, feature string, error string")


def text_media(df: DataFrame) -> DataFrame:
    """doc_id, n_bytes and a media column that holds each text's UTF-8 bytes, filled with zeros to a positive multiple of 64, as 8-bit samples: a PGM, or a BMP where the payload's CRC is odd."""

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts, media = text_bytes(batch.column("text")), []
        for t in texts:
            payload = t + bytes(-len(t) % WIDTH or (0 if t else WIDTH))
            media.append((encode_bmp if zlib.crc32(payload) & 1 else encode_pgm)(payload))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return map_arrow(df.select("doc_id", "text"), one, "doc_id long, n_bytes long, media binary")


def media_tiles(df: DataFrame) -> DataFrame:
    """From doc_id, n_bytes and stored media: sizes and checksums of the stored form and of the payload decoded from it, difference hash, and the NPY tile."""

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for data in text_bytes(batch.column("media")):
            image = decode(data)
            payload = np.ascontiguousarray(image).tobytes()
            out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), difference_hash(image), npy_tile(image)))
        cols = list(zip(*out, strict=True))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile"])

    return map_arrow(df, one, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary")


def with_tile_digest(df: DataFrame) -> DataFrame:
    """Replaces the column tile by tile_mean and tile_sha256 of the NPY file in it, as numpy loads it."""

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        means, shas = [], []
        for data in batch.column("tile").to_pylist():
            means.append(float(np.load(io.BytesIO(data), allow_pickle=False).mean()))
            shas.append(hashlib.sha256(data).hexdigest())
        rest = batch.drop_columns(["tile"])
        yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(means), pa.array(shas)], [*rest.schema.names, "tile_mean", "tile_sha256"])

    return map_arrow(df, one, ", ".join(f"{c} {t}" for c, t in df.drop("tile").dtypes) + ", tile_mean double, tile_sha256 string")


def stored(docs: DataFrame) -> DataFrame:
    """Texts written as media, read again for their features and tiles, which are written and read in turn. No shuffle; a batch in memory at a time."""
    media = materialize(text_media(docs))
    tiles = materialize(media_tiles(media))
    discard(media)
    return with_tile_digest(tiles)


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spread(documents(spark, sf_dir, "doc_id", "text")))
