"""Readers of image and texture files, and PNG bytes.

Containers, DDS and KTX headers are parsed by column expressions over Spark's binaryFile source, so a directory is
listed and split by Spark. Raster images come from Spark's image source.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bits import little_endian

# Magic numbers and field offsets of the public DDS and KTX 1 formats.
DDS_MAGIC, KTX_MAGIC = "44445320", "AB4B5458203131BB0D0A1A0A"
DDS_OFFSETS = {"height": 12, "width": 16, "depth": 24, "mips": 28}
KTX_OFFSETS = {"gl_type": 16, "gl_internal_format": 28, "width": 36, "height": 40, "depth": 44, "layers": 48, "faces": 52, "mips": 56, "metadata_bytes": 60}
BLOCK_BYTES = {"DXT1": 8, "DXT3": 16, "DXT5": 16}


def binary_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length and content of a directory's files; Spark's source has no rows for empty ones."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length", "content")


def texture_format(content) -> object:
    """Format by the first bytes: dds, ktx, crn, png, jpeg, bmp, or null."""
    head = F.hex(F.substring(content, F.lit(1), F.lit(12)))
    out = F.lit(None).cast("string")
    for magic, name in ((DDS_MAGIC, "dds"), (KTX_MAGIC, "ktx"), ("4878", "crn"), ("89504E470D0A1A0A", "png"), ("FFD8FF", "jpeg"), ("424D", "bmp")):
        out = F.when(head.startswith(magic), F.lit(name)).otherwise(out)
    return out


def dds_headers(files: DataFrame) -> DataFrame:
    """path, width, height, depth, mips, fourcc, cube of the DDS files among (path, content)."""
    c = F.col("content")
    rows = files.where(texture_format(c) == "dds")
    cube = little_endian(c, 112, 4).bitwiseAND(0x200) != 0
    fourcc = F.decode(F.substring(c, F.lit(85), F.lit(4)), "ISO-8859-1")
    return rows.select("path", *(little_endian(c, at, 4).alias(n) for n, at in DDS_OFFSETS.items()), fourcc.alias("fourcc"), cube.alias("cube"))


def ktx_headers(files: DataFrame) -> DataFrame:
    """path and the header fields of the KTX files among (path, content), of either byte order."""
    c = F.col("content")
    swapped = little_endian(c, 12, 4) == 0x01020304

    def word(at: int):
        big = sum((little_endian(c, at + k, 1) * (1 << (24 - 8 * k)) for k in range(4)), F.lit(0))
        return F.when(swapped, big).otherwise(little_endian(c, at, 4))

    return files.where(texture_format(c) == "ktx").select("path", *(word(at).alias(n) for n, at in KTX_OFFSETS.items()))


def mip_levels(headers: DataFrame) -> DataFrame:
    """A row per level with its sides and bytes, of DDS headers with a block format."""
    level = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("mips"), F.lit(1)) - 1)).alias("level")
    rows = headers.select("path", "width", "height", "fourcc", level)
    side = lambda c: F.greatest(F.lit(1), F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("level")))).cast("long")
    block = F.create_map(*[F.lit(x) for item in BLOCK_BYTES.items() for x in item])
    rows = rows.withColumn("width", side("width")).withColumn("height", side("height"))
    size = F.ceil(F.col("width") / 4) * F.ceil(F.col("height") / 4) * block[F.col("fourcc")]
    return rows.withColumn("bytes", size.cast("long"))


def dxt_records(files: DataFrame) -> DataFrame:
    """path, block, ep1, ep2, sel of raw files of 8-byte blocks."""
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.octet_length("content") / 8) - 1)).alias("block")
    rows = files.where(F.octet_length("content") >= 8).select("path", "content", block)
    eight = F.substring(F.col("content"), (F.col("block") * 8 + 1).cast("int"), F.lit(8))
    rows = rows.select("path", "block", eight.alias("b"))
    return rows.select("path", "block", *(little_endian(F.col("b"), at, n).alias(c) for c, at, n in (("ep1", 0, 2), ("ep2", 2, 2), ("sel", 4, 4))))


def raster_images(spark: SparkSession, path: str) -> DataFrame:
    """image_id, width, height and RGB bytes of PNG, JPEG, BMP and GIF files; Spark's image source has them as BGR.

    A file that cannot be decoded keeps its row, with no bytes and sides of -1.
    """
    images = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for raw, n in zip(b["data"].to_pylist(), b["nChannels"].to_pylist()):
                if n <= 0:
                    out.append(None)
                    continue
                px = np.frombuffer(raw, np.uint8).reshape(-1, n)
                out.append((px[:, [2, 1, 0]] if n >= 3 else np.repeat(px, 3, axis=1)).tobytes())
            yield pa.RecordBatch.from_arrays([b["origin"], b["width"], b["height"], pa.array(out, pa.binary())], ["image_id", "width", "height", "rgb"])

    return images.mapInArrow(run, "image_id string, width int, height int, rgb binary")


def png_bytes(px: np.ndarray) -> bytes:
    """A PNG file of (height, width) gray or (height, width, 3) pixels."""
    h, w = px.shape[:2]
    kind = 0 if px.ndim == 2 else 2
    rows = b"".join(b"\0" + px[y].astype(np.uint8).tobytes() for y in range(h))
    chunk = lambda tag, body: struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def stretched(plane: np.ndarray) -> np.ndarray:
    """Values rescaled so that the least becomes 0 and the greatest 255."""
    low, high = plane.min(), plane.max()
    return np.floor((plane - low) * (255.0 / max(high - low, 1)) + 0.5).astype(np.uint8)
