"""Media columns: bytes as PNG in a binary column, written and read chunk by chunk, and low-frequency cosine-transform hashes.

A payload becomes the 8-bit grey samples of an image 64 wide. The reader checks the signature, the order and checksum of each chunk
and the length of the image data, and undoes all five row filters with numpy, which the writer chooses row by row; it reads any 8-bit grey, grey-alpha, RGB or RGBA
image that is not interlaced.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 64
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
_ROWS = 1 << 12  # rows that are filtered at once
_TOGETHER = 1 << 20  # samples that are unfiltered at once, or one image


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def _filtered(image: np.ndarray, adaptive: bool) -> np.ndarray:
    """Rows with their filter byte: 0, or that of the filter (0 to 4) with the least sum of absolute differences."""
    height, width = image.shape
    out = np.zeros((height, width + 1), np.uint8)
    out[:, 1:] = image
    for low in range(0, height if adaptive else 0, _ROWS):
        rows = image[low : low + _ROWS]
        a, b, c = (np.zeros(rows.shape, np.int16) for _ in range(3))
        a[:, 1:], b[1:], c[1:, 1:] = rows[:, :-1], rows[:-1], rows[:-1, :-1]
        if low:
            b[0], c[0, 1:] = image[low - 1], image[low - 1, :-1]
        kinds = np.stack([rows, *((rows - guess).astype(np.uint8) for guess in (a, b, (a + b) >> 1, _paeth(a, b, c)))])
        best = np.abs(kinds.view(np.int8).astype(np.int16)).sum(2, dtype=np.int64).argmin(0)
        out[low : low + _ROWS, 0], out[low : low + _ROWS, 1:] = best, kinds[best, np.arange(len(rows))]
    return out


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of left, up and up-left the one nearest to left + up - up-left."""
    near_a, near_b = np.abs(b - c), np.abs(a - c)
    near_c = np.abs(a + b - c - c)
    return np.where((near_a <= near_b) & (near_a <= near_c), a, np.where(near_b <= near_c, b, c))


def encode_png(payload: bytes, level: int = 1, adaptive: bool = True) -> bytes:
    """payload: a positive multiple of 64 bytes."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    header = struct.pack(">IIBBBBB", WIDTH, len(image), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(_filtered(image, adaptive).tobytes(), level)) + _chunk(b"IEND", b"")


def unfiltered(images: list[np.ndarray], step: int) -> list[np.ndarray]:
    """The samples of images of one width, each given as rows with their filter byte; step: samples a pixel.

    A pixel needs its left, upper and upper left neighbours, so all pixels of an anti-diagonal, of all images, are worked out at
    once. Images go together while they take few bytes with the diagonals' ends filled up."""
    for rows in images:
        if (rows[:, 0] > 4).any():
            raise ValueError(f"PNG: unknown row filter {rows[:, 0].max()}")
    out: list = [None] * len(images)
    order = sorted(range(len(images)), key=lambda i: -len(images[i]))
    while order:
        width = (images[order[0]].shape[1] - 1) // step
        together = max(1, _TOGETHER // ((len(images[order[0]]) + width) * width * step))
        some, order = order[:together], order[together:]
        for i, samples in zip(some, _diagonals([images[i] for i in some], width, step), strict=True):
            out[i] = samples
    return out


def _diagonals(images: list[np.ndarray], width: int, step: int) -> list[np.ndarray]:
    """images: the highest first. Diagonal d of an image holds at place x the pixel of row d - x."""
    heights = np.array([len(r) for r in images])
    if not any(r[:, 0].any() for r in images):
        return [r[:, 1:] for r in images]
    last = int(heights[0]) + width - 1
    raw = np.zeros((last, len(images), width, step), np.int16)
    kind = np.zeros((last, len(images), width, 1), np.int8)
    x = np.arange(width)
    for i, rows in enumerate(images):
        at = np.arange(len(rows))[:, None] + x
        raw[at, i, x] = rows[:, 1:].reshape(len(rows), width, step)
        kind[at, i, x] = rows[:, :1, None].view(np.int8)
    done = np.zeros((last + 2, len(images), width + 1, step), np.int16)  # two diagonals and a place of zeros come first
    open_ = np.searchsorted(-(heights + width - 1), -np.arange(last), "left")  # how many images have diagonal d
    for d in range(last):
        n = open_[d]
        a, b, c, k = done[d + 1, :n, :-1], done[d + 1, :n, 1:], done[d, :n, :-1], kind[d, :n]
        guess = np.where(k == 4, _paeth(a, b, c), np.where(k == 3, (a + b) >> 1, np.where(k == 2, b, np.where(k == 1, a, 0))))
        own = (raw[d, :n] + guess) & 255
        if d < width - 1:  # places before the image's first row stay 0
            own[:, d + 1 :] = 0
        done[d + 2, :n, 1:] = own
    out = []
    for i, h in enumerate(heights):
        at = np.arange(h)[:, None] + x
        out.append(done[at + 2, i, x + 1].astype(np.uint8).reshape(h, width * step))
    return out


def read_chunks(data: bytes) -> tuple[np.ndarray, int]:
    """The image's rows with their filter bytes, and the samples a pixel, after all checks."""
    if data[:8] != _SIGNATURE:
        raise ValueError("PNG: no signature")
    at, header, parts, ended = 8, None, [], False
    while at < len(data):
        if at + 12 > len(data):
            raise ValueError("PNG: cut off")
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if len(body) < n or at + 12 + n > len(data):
            raise ValueError("PNG: cut off")
        if struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("PNG: checksum")
        if (header is None) != (kind == b"IHDR"):
            raise ValueError("PNG: order of chunks")
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        elif kind == b"IEND":
            ended = True
            break
        elif not kind[0] & 0x20:
            raise ValueError(f"PNG: chunk {kind!r}")
        at += 12 + n
    if header is None or not ended:
        raise ValueError("PNG: cut off")
    width, height, depth, colour, *rest = header
    if depth != 8 or colour not in _CHANNELS or any(rest):
        raise ValueError("PNG: kind of image")
    step = _CHANNELS[colour]
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8)
    except zlib.error as e:
        raise ValueError(f"PNG: {e}") from None
    if len(raw) != height * (width * step + 1):
        raise ValueError("PNG: length of the image data")
    return raw.reshape(height, width * step + 1), step


def decode_pngs(media: list[bytes]) -> list[np.ndarray]:
    """The samples of each, height by width or by width by channels. ValueError for anything that is damaged or not supported."""
    read = [read_chunks(x) for x in media]
    out: list = [None] * len(media)
    for kind in {(rows.shape[1], step) for rows, step in read}:
        alike = [i for i, (rows, step) in enumerate(read) if (rows.shape[1], step) == kind]
        for i, samples in zip(alike, unfiltered([read[i][0] for i in alike], kind[1]), strict=True):
            out[i] = samples if kind[1] == 1 else samples.reshape(len(samples), -1, kind[1])
    return out


def decode_png(data: bytes) -> np.ndarray:
    return decode_pngs([data])[0]


@lru_cache(1)
def _cosines(n: int = 32, low: int = 8) -> np.ndarray:
    k, x = np.arange(1, low + 1)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * n))


def cosine_hash(image: np.ndarray) -> str:
    """64 bits: the signs against their median of 8 by 8 low frequencies of the image, averaged to 32 by 32."""
    grey = image if image.ndim == 2 else image.mean(2)
    for axis in (0, 1):
        n = grey.shape[axis]
        if n != 32:
            cuts = np.arange(32) * n // 32
            ends = np.maximum(np.arange(1, 33) * n // 32, cuts + 1)
            sums = np.concatenate([np.zeros_like(grey.take([0], axis), np.float64), np.cumsum(grey, axis=axis, dtype=np.float64)], axis)
            shape = (-1, 1) if axis == 0 else (1, -1)
            grey = (sums.take(ends, axis) - sums.take(cuts, axis)) / (ends - cuts).reshape(shape)
    low = np.round(_cosines() @ grey @ _cosines().T, 6).ravel()
    return np.packbits(low > np.median(low)).tobytes().hex()


def payload_of(text: str | None) -> bytes:
    data = (text or "").encode()
    return data + bytes((-len(data)) % WIDTH or (0 if data else WIDTH))


def _encoded(level: int, adaptive: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                texts = part.column("text").to_pylist()
                media = [encode_png(payload_of(t), level, adaptive) for t in texts]
                sizes = [len((t or "").encode()) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return run


def text_media(docs: DataFrame, level: int = 1, adaptive: bool = True) -> DataFrame:
    """Per row of docs (doc_id, text): n_bytes and media, the PNG of the text's UTF-8 bytes, zeros appended up to a positive
    multiple of 64. Null texts are empty ones; equal texts and repeated rows have equal media; an empty table gives none; other
    columns, whatever their names, are ignored."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_encoded(level, adaptive), "doc_id bigint, n_bytes bigint, media binary")


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, 256):
            part = batch.slice(low, 256)
            held = [x.as_py() for x in part.column("media")]
            images = iter(decode_pngs([x for x in held if x is not None]))
            images = [None if x is None else next(images) for x in held]
            payloads, found = ([None if i is None else f(i) for i in images] for f in (np.ndarray.tobytes, cosine_hash))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(payloads, pa.binary()), pa.array(found, pa.string())], [*part.schema.names, "payload", "feature"])


def read_media(media: DataFrame) -> DataFrame:
    """Rows of text_media with payload, the samples read from the media bytes, and feature, their cosine hash (16 hexadecimal
    digits). Null media give nulls; damaged media are an error."""
    media = media.select("doc_id", "n_bytes", "media")
    return media.mapInArrow(_decoded, "doc_id bigint, n_bytes bigint, media binary, payload binary, feature string")
