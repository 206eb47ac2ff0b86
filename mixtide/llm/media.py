"""Media columns: Netpbm and BMP to numpy, area resize by integral images, NPY tiles, difference hashes (operator 1)."""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixtide.llm._common import documents
from mixtide.llm._text import blocks, string_buffers

UNIT = 64
#: Bytes of text whose media go into one batch; a longer text goes alone.
STORED = 4 << 20
TILE = 8


def encode_pgm(image: np.ndarray) -> bytes:
    """Binary graymap of 8-bit samples."""
    height, width = image.shape
    return b"P5\n%d %d\n255\n" % (width, height) + np.ascontiguousarray(image, dtype=np.uint8).tobytes()


def _header(data: bytes, at: int, n: int) -> tuple[list[int], int]:
    """n numbers of a Netpbm header, comments skipped, and the place behind the single white space that ends it."""
    out: list[int] = []
    while len(out) < n:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        out.append(int(data[at:end]))
        at = end
    return out, at + 1


def _plain(data: bytes, at: int) -> bytes:
    return b"\n".join(line.split(b"#")[0] for line in data[at - 1 :].split(b"\n"))


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as (height, width) or (height, width, 3); 8-bit samples, 16-bit where the maximum is above 255. Bits: ink is 0."""
    kind = int(data[1:2])
    fields, at = _header(data, 2, 2 if kind in (1, 4) else 3)
    width, height = fields[:2]
    if kind == 1:
        bits = np.array([c - 48 for c in _plain(data, at) if c in (48, 49)], dtype=np.uint8)[: width * height]
        return (1 - bits.reshape(height, width)) * np.uint8(255)
    if kind == 4:
        rows = np.frombuffer(data, dtype=np.uint8, count=height * -(-width // 8), offset=at).reshape(height, -1)
        return (1 - np.unpackbits(rows, axis=1)[:, :width]) * np.uint8(255)
    deep = np.dtype(">u2") if fields[2] > 255 else np.dtype(np.uint8)
    shape = (height, width, 3) if kind in (3, 6) else (height, width)
    if kind in (2, 3):
        return np.array(_plain(data, at).split()[: int(np.prod(shape))], dtype=np.int64).astype(deep.newbyteorder("=")).reshape(shape)
    return np.frombuffer(data, dtype=deep, count=int(np.prod(shape)), offset=at).reshape(shape).astype(deep.newbyteorder("="))


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits as (height, width) if its palette is gray, else (height, width, 3)."""
    start, size, width, height, _, bits, packed = struct.unpack_from("<I I i i H H I", data, 10)
    if width <= 0:
        raise ValueError("no width")
    if packed not in (0, 3) or bits not in (1, 4, 8, 24, 32):
        raise ValueError("compressed BMP")
    step = (width * bits + 31) // 32 * 4
    rows = np.frombuffer(data, dtype=np.uint8, count=step * abs(height), offset=start).reshape(abs(height), step)
    rows = rows if height < 0 else rows[::-1]
    if bits >= 24:
        return rows[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[:, :, 2::-1].copy()
    if bits < 8:
        each = np.unpackbits(rows, axis=1).reshape(abs(height), -1, bits)
        rows = each @ (1 << np.arange(bits - 1, -1, -1, dtype=np.uint8))
    used = struct.unpack_from("<I", data, 46)[0] or 1 << bits
    palette = np.frombuffer(data, dtype=np.uint8, count=4 * used, offset=14 + size).reshape(-1, 4)[:, 2::-1]
    image = palette[rows[:, :width]]
    return image[:, :, 0].copy() if (palette == palette[:, :1]).all() else image


def decode(data: bytes) -> np.ndarray:
    if data[:1] == b"P" and data[1:2] in b"123456" and len(data) > 2:
        return decode_netpbm(data)
    if data[:2] == b"BM":
        return decode_bmp(data)
    raise ValueError("neither Netpbm nor BMP")


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over equal areas, from an integral image read at fractional edges (linear in between, which is exact)."""
    sums = image.astype(np.float64)
    for axis, n in ((0, height), (1, width)):
        total = np.concatenate([np.zeros_like(sums.take([0], axis)), np.cumsum(sums, axis=axis)], axis=axis)
        edge = np.linspace(0, sums.shape[axis], n + 1)
        low = np.minimum(edge.astype(int), sums.shape[axis] - 1)
        part = (edge - low).reshape((-1, 1) if axis == 0 else (1, -1))
        part = part[..., None] if sums.ndim == 3 else part
        at = total.take(low, axis) + part * (total.take(low + 1, axis) - total.take(low, axis))
        sums = np.diff(at, axis=axis) / (edge[1] - edge[0])
    return sums


def gray(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])


def difference_hash(tile: np.ndarray) -> str:
    """64 bits: is each of 8 x 8 cells of an 8 x 9 gray tile darker than its right neighbour."""
    return np.packbits(tile[:, :-1] < tile[:, 1:]).tobytes().hex()


def npy(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, np.rint(tile).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column("doc_id").cast(pa.int64()), batch.column("text")
        _, offsets = string_buffers(texts)
        for k, end in blocks(offsets, STORED):  # whole texts of about so many bytes at once
            raw = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in texts[k:end]]
            media = [encode_pgm(np.frombuffer(x + b"\0" * (-len(x) % UNIT if x else UNIT), dtype=np.uint8).reshape(-1, UNIT)) for x in raw]
            yield pa.RecordBatch.from_arrays([ids.slice(k, end - k), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, n_bytes, media: the text's UTF-8, zero-padded to a positive multiple of 64, as a graymap 64 wide.

    Null text is empty. Repeated rows and null doc_ids pass through. Other columns are ignored.
    """
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_store, "doc_id long, n_bytes long, media binary")


_FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, height int, width int, tile binary, feature string"


def _features(keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part, rows = batch.slice(k, 500), []
                for x in part.column("media"):
                    data = x.as_py()
                    try:
                        image = decode(data) if data is not None else None
                    except (ValueError, IndexError, OverflowError, MemoryError, struct.error):
                        image = None
                    if image is None or 0 in image.shape:
                        rows.append((None, None, None, None if data is None else len(data), None if data is None else hashlib.sha256(data).hexdigest(), None, None, None, None))
                        continue
                    payload = image.tobytes()
                    tile = area_resize(gray(image), TILE, TILE + 1)
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), image.shape[0], image.shape[1], npy(tile), difference_hash(tile)))
                kinds = [f.split() for f in _FEATURES.split(", ")]
                types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keys), *(pa.array(columns[i], types[t]) for i, (_, t) in enumerate(kinds))], names=[*keys, *(n for n, _ in kinds)])

    return run


def media_features(media: DataFrame, keys: list[str]) -> DataFrame:
    """keys and what the decoded media column gives: size and digests of samples and file, height, width, NPY tile, difference hash.

    Null media, or bytes that are neither Netpbm nor uncompressed BMP or that break off: null features. Equal
    media give equal features. Columns that are not keys are dropped.
    """
    kept = media.select(*keys, F.col("media").cast("binary").alias("media"))
    schema = ", ".join([*(f"`{c}` {t}" for c, t in kept.dtypes if c in keys), _FEATURES])
    return kept.mapInArrow(_features(keys), schema)


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text as a stored graymap, read back; nulls and repeats as in store_texts and media_features."""
    stored = store_texts(documents(spark, sf_dir))
    return media_features(stored, ["doc_id", "n_bytes"]).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "height", "width", F.sha2("tile", 256).alias("tile_sha256"))
