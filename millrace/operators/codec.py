"""Whole images to the compressed container and back, and the container's binary layout.

Little endian: seven 32-bit words (width, height, padded palette bytes, sizes of the four coded streams), four tables
of 256 16-bit frequencies that sum to 2048, then the streams: luma planes, chroma planes, selector palette, palette
number deltas. Sides are multiples of 128 and the stream lengths multiples of 8192.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bits import little_endian
from ..functions.transforms import forward_tiles, inverse_tiles
from . import blocks as B
from .entropy import GROUP, decode_stream, encode_stream

TILE, HEADER, TABLE_BYTES, BIAS = 32, 28, 512, 128
FIELDS = ("width", "height", "palette_bytes", "luma_size", "chroma_size", "palette_size", "delta_size")

RADII = (0, 1, 2, 4, 8, 16, 32, 64, 128)


class Unfit(ValueError):
    """An image that the 8-bit container cannot hold."""


def blocks_of(rgb: np.ndarray) -> np.ndarray:
    """(height, width, 3) to (blocks, 16, 3) in raster order of the blocks."""
    h, w, _ = rgb.shape
    return rgb.reshape(h // 4, 4, w // 4, 4, 3).transpose(0, 2, 1, 3, 4).reshape(-1, 16, 3)


def image_of(px: np.ndarray, width: int, height: int) -> np.ndarray:
    return px.reshape(height // 4, width // 4, 4, 4, 3).transpose(0, 2, 1, 3, 4).reshape(height, width, 3)


def planes_of(word: np.ndarray) -> list[np.ndarray]:
    """Luma and two chroma planes of 565 colours, reversible."""
    r, g, b = word >> 11, (word >> 5) & 63, word & 31
    t = r + b + (b >> 4)
    cg = g - t
    return [t + np.trunc(cg / 2).astype(np.int64), r - b, cg]


def word_of_planes(y: np.ndarray, co: np.ndarray, cg: np.ndarray) -> np.ndarray:
    t = y - np.trunc(cg / 2).astype(np.int64)
    b = np.trunc((t - co) / 2).astype(np.int64)
    return ((b + co) << 11) | ((cg + t) << 5) | b


def coefficient_bytes(plane: np.ndarray) -> np.ndarray:
    """Tiles of wavelet coefficients as biased bytes, tile after tile."""
    h, w = plane.shape
    tiles = plane.reshape(h // TILE, TILE, w // TILE, TILE).transpose(0, 2, 1, 3).reshape(-1, TILE, TILE)
    out = forward_tiles(tiles) + BIAS
    if out.min() < 0 or out.max() > 255:
        raise Unfit("a wavelet coefficient does not fit a byte; only smooth images go into the 8-bit container")
    return out.astype(np.uint8).reshape(-1)


def plane_of(data: np.ndarray, w: int, h: int) -> np.ndarray:
    tiles = inverse_tiles(data.reshape(-1, TILE, TILE).astype(np.int64) - BIAS)
    return tiles.reshape(h // TILE, w // TILE, TILE, TILE).transpose(0, 2, 1, 3).reshape(h, w)


def encode_image(rgb: np.ndarray) -> bytes:
    h, w, _ = rgb.shape
    if w % 128 or h % 128 or (w * h // 16) % GROUP:
        raise ValueError("sides must be multiples of 128 and the blocks a multiple of 8192")
    px = blocks_of(rgb.astype(np.int64))
    ep1, ep2, known, number = B.dictionary_pass(px, *B.compress(px))
    return encode_blocks(w, h, ep1, ep2, known, number)


def smoothed(rgb: np.ndarray, radius: int) -> np.ndarray:
    """Rounded means over squares of 2 * radius + 1 pixels; the image wraps round at its sides."""
    size = 2 * radius + 1
    for axis in (0, 1):
        n = rgb.shape[axis]
        sums = np.cumsum(np.take(rgb, np.arange(-radius - 1, n + radius) % n, axis=axis), axis=axis)
        rgb = (np.take(sums, np.arange(size, n + size), axis=axis) - np.take(sums, np.arange(n), axis=axis) + size // 2) // size
    return rgb


def encode_fitting(rgb: np.ndarray):
    """Radius, pixel blocks, ep1, ep2, words, numbers and container: the image itself, smoothed only if it is refused."""
    h, w, _ = rgb.shape
    for radius in RADII:
        px = blocks_of(smoothed(rgb.astype(np.int64), radius) if radius else rgb.astype(np.int64))
        coded = B.dictionary_pass(px, *B.compress(px))
        try:
            return radius, px, *coded, encode_blocks(w, h, *coded)
        except Unfit:
            if radius == RADII[-1]:
                raise


def encode_blocks(w: int, h: int, ep1: np.ndarray, ep2: np.ndarray, known: np.ndarray, number: np.ndarray) -> bytes:
    shape = (h // 4, w // 4)
    one, two = planes_of(ep1.reshape(shape)), planes_of(ep2.reshape(shape))
    luma = np.concatenate([coefficient_bytes(one[0]), coefficient_bytes(two[0])])
    chroma = np.concatenate([coefficient_bytes(p) for p in (one[1], one[2], two[1], two[2])])
    words = known.astype("<u4").view(np.uint8)
    palette = np.zeros(-(-len(words) // GROUP) * GROUP, np.uint8)
    palette[: len(words)] = words
    delta = np.diff(number, prepend=0) + BIAS
    coded = [encode_stream(x) for x in (luma, chroma, palette, delta.astype(np.uint8))]
    head = np.array([w, h, len(palette), *(len(raw) for _, raw in coded)], "<u4").tobytes()
    return head + b"".join(f.astype("<u2").tobytes() for f, _ in coded) + b"".join(raw for _, raw in coded)


def decode_blocks(raw: bytes) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
    """Width, height, endpoints and selector words."""
    w, h, padded, *sizes = np.frombuffer(raw, "<u4", 7).tolist()
    n, at = w * h // 16, HEADER + 4 * TABLE_BYTES
    streams = []
    for k, (size, length) in enumerate(zip(sizes, (2 * n, 4 * n, padded, n))):
        freq = np.frombuffer(raw, "<u2", 256, HEADER + k * TABLE_BYTES).astype(np.int64)
        streams.append(decode_stream(freq, raw[at : at + size], length))
        at += size
    luma, chroma, palette, delta = streams
    bw, bh = w // 4, h // 4
    y = [plane_of(x, bw, bh) for x in np.split(luma, 2)]
    c = [plane_of(x, bw, bh) for x in np.split(chroma, 4)]
    ep1, ep2 = word_of_planes(y[0], c[0], c[1]).reshape(-1), word_of_planes(y[1], c[2], c[3]).reshape(-1)
    number = np.cumsum(delta.astype(np.int64) - BIAS)
    return w, h, ep1, ep2, palette.view("<u4").astype(np.int64)[number]


def dxt_bytes(ep1: np.ndarray, ep2: np.ndarray, word: np.ndarray) -> bytes:
    """8 bytes a block: two endpoints, then the selectors."""
    out = np.zeros(len(ep1), np.dtype([("a", "<u2"), ("b", "<u2"), ("s", "<u4")]))
    out["a"], out["b"], out["s"] = ep1, ep2, word
    return out.tobytes()


def dxt_blocks(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.frombuffer(raw, np.dtype([("a", "<u2"), ("b", "<u2"), ("s", "<u4")]))
    return tuple(x[c].astype(np.int64) for c in ("a", "b", "s"))


def encode_images(images: DataFrame) -> DataFrame:
    """image_id, container of (image_id, width, height, rgb binary): an image is one fold, images are independent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, w, h, raw in zip(*(b[c].to_pylist() for c in ("image_id", "width", "height", "rgb"))):
                out = encode_image(np.frombuffer(raw, np.uint8).reshape(h, w, 3))
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.string()), pa.array([out], pa.binary())], ["image_id", "container"])

    return images.select(F.col("image_id").cast("string"), "width", "height", "rgb").mapInArrow(run, "image_id string, container binary")


def encode_pairs(images: DataFrame) -> DataFrame:
    """image_id, container of (image_id, width, height, rgb, dxt): the blocks are given, the pixels judge the dictionary.

    dxt holds 8-byte blocks in rows; an image whose blocks or pixels do not fill its sides ends the query.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, w, h, raw, dxt in zip(*(b[c].to_pylist() for c in ("image_id", "width", "height", "rgb", "dxt"))):
                if w % 128 or h % 128 or (w * h // 16) % GROUP or len(raw) != 3 * w * h or len(dxt) != w * h // 2:
                    raise ValueError(f"{i}: sides, pixels and blocks do not agree, or are no whole groups")
                px = blocks_of(np.frombuffer(raw, np.uint8).reshape(h, w, 3).astype(np.int64))
                out = encode_blocks(w, h, *B.dictionary_pass(px, *dxt_blocks(dxt)))
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.string()), pa.array([out], pa.binary())], ["image_id", "container"])

    return images.select(F.col("image_id").cast("string"), "width", "height", "rgb", "dxt").mapInArrow(run, "image_id string, container binary")


def decode_images(containers: DataFrame, mode: str = "rgb") -> DataFrame:
    """image_id, width, height and data of (image_id, container): RGB bytes, or the 8-byte blocks for mode dxt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, raw in zip(b["image_id"].to_pylist(), b["container"].to_pylist()):
                w, h, *blocks = decode_blocks(raw)
                data = dxt_bytes(*blocks) if mode == "dxt" else image_of(B.decode(*blocks), w, h).astype(np.uint8).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.string()), pa.array([w], pa.int32()), pa.array([h], pa.int32()), pa.array([data], pa.binary())], ["image_id", "width", "height", "data"])

    return containers.select(F.col("image_id").cast("string"), "container").mapInArrow(run, "image_id string, width int, height int, data binary")


def encode_files(images: DataFrame, folder: str, blocks: DataFrame | None = None) -> DataFrame:
    """Raster images (image_id a path) to one container file each, named after the image; path and bytes of the files.

    With `blocks` (path, content), an image is coded by the block file of its name, without regard to the endings.
    """
    from ..sources.writers import write_files

    stem = lambda c: F.regexp_extract(c, r"([^/]+?)(\.[^./]*)?$", 1)
    named = images.withColumn("image_id", stem("image_id"))
    if blocks is None:
        coded = encode_images(named)
    else:
        coded = encode_pairs(named.join(blocks.select(stem("path").alias("image_id"), F.col("content").alias("dxt")), "image_id"))
    return write_files(coded.select(F.concat("image_id", F.lit(".mrc")).alias("name"), F.col("container").alias("data")), folder)


def header(containers: DataFrame, column: str = "container") -> DataFrame:
    """The header's fields as columns, by expressions on the first 28 bytes."""
    fields = [little_endian(F.col(column), 4 * k, 4).alias(name) for k, name in enumerate(FIELDS)]
    return containers.select(*(c for c in containers.columns if c != column), *fields)


def psnr(mse, peak: float = 255.0):
    """Column: decibels of a mean squared error summed over three channels; null without error."""
    return F.when(mse > 0, 10 * F.log10(3 * peak * peak / mse))


def rasters(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """image_id, width, height, rgb of long pixels (image_id, x, y, r, g, b); missing pixels are black."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        out = np.zeros((height, width, 3), np.uint8)
        x, y = t["x"].to_numpy(), t["y"].to_numpy()
        for k, c in enumerate("rgb"):
            out[y, x, k] = t[c].to_numpy()
        return pa.table({"image_id": pa.array([key[0].as_py()], pa.string()), "width": pa.array([width], pa.int32()), "height": pa.array([height], pa.int32()), "rgb": pa.array([out.tobytes()], pa.binary())})

    return pixels.withColumn("image_id", F.col("image_id").cast("string")).groupBy("image_id").applyInArrow(run, "image_id string, width int, height int, rgb binary")
