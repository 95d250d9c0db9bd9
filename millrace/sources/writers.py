"""Sinks: image files of several kinds, containers, and a tap that writes a table and passes it on.

Files are written by the tasks, each under a name of its row, first beside their place and then moved there, so a task
that runs again leaves the same file. Paths are those of the cluster's file system, as pyarrow opens them.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .textures import png_bytes


def bmp_bytes(px: np.ndarray) -> bytes:
    """A 24-bit BMP of (height, width, 3) pixels."""
    h, w, _ = px.shape
    rows = np.zeros((h, -(-3 * w // 4) * 4), np.uint8)
    rows[:, : 3 * w] = px[::-1, :, ::-1].reshape(h, 3 * w)
    return b"BM" + struct.pack("<IHHI", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def tga_bytes(px: np.ndarray) -> bytes:
    """An uncompressed TGA of (height, width), (height, width, 3) or (height, width, 4) pixels, the top row first."""
    channels = 1 if px.ndim == 2 else px.shape[2]
    h, w = px.shape[:2]
    head = struct.pack("<BBBHHBHHHHBB", 0, 0, 3 if channels == 1 else 2, 0, 0, 0, 0, 0, w, h, 8 * channels, 0x20 | (8 if channels == 4 else 0))
    swapped = px if channels == 1 else px[:, :, [2, 1, 0, 3][:channels]]
    return head + np.ascontiguousarray(swapped, dtype=np.uint8).tobytes()


def hdr_bytes(px: np.ndarray) -> bytes:
    """A Radiance file of (height, width, 3) floats, pixels as four bytes without run lengths."""
    h, w, _ = px.shape
    top = px.max(axis=2)
    mantissa, exponent = np.frexp(top)
    scale = np.where(top > 1e-32, mantissa * 256.0 / np.where(top > 0, top, 1), 0)
    rgbe = np.concatenate([np.floor(px * scale[:, :, None]), np.where(top > 1e-32, exponent + 128, 0)[:, :, None]], axis=2)
    return f"#?RADIANCE\nFORMAT=32-bit_rle_rgbe\n\n-Y {h} +X {w}\n".encode() + rgbe.astype(np.uint8).tobytes()


KINDS: dict[str, Callable[[np.ndarray], bytes]] = {"png": png_bytes, "bmp": bmp_bytes, "tga": tga_bytes, "hdr": lambda px: hdr_bytes(px / 255.0)}


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """Writes (name, data) as folder/name; path and bytes of each, when the result is run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        for b in batches:
            paths, sizes = [], []
            for name, data in zip(b["name"].to_pylist(), b["data"].to_pylist()):
                if not name or "/" in name or name in (".", ".."):
                    raise ValueError(f"{name!r} is no file name")
                before = f"{root}/.{name}-{uuid.uuid4().hex}"
                with system.open_output_stream(before) as f:
                    f.write(data or b"")
                system.move(before, f"{root}/{name}")
                paths.append(f"{folder.rstrip('/')}/{name}")
                sizes.append(len(data or b""))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], ["path", "bytes"])

    return rows.select(F.col("name").cast("string"), "data").mapInArrow(run, "path string, bytes long")


def image_files(images: DataFrame, kind: str = "png") -> DataFrame:
    """name, data: files of (image_id, width, height, rgb); images without bytes have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, w, h, raw in zip(*(b[c].to_pylist() for c in ("image_id", "width", "height", "rgb"))):
                data = KINDS[kind](np.frombuffer(raw, np.uint8).reshape(h, w, 3))
                yield pa.RecordBatch.from_arrays([pa.array([f"{i}.{kind}"], pa.string()), pa.array([data], pa.binary())], ["name", "data"])

    if kind not in KINDS:
        raise ValueError(f"one of {sorted(KINDS)}, not {kind!r}")
    rows = images.where("rgb is not null").select(F.col("image_id").cast("string"), "width", "height", "rgb")
    return rows.mapInArrow(run, "name string, data binary")


def tap(df: DataFrame, path: str, **options: object) -> DataFrame:
    """Writes the table as Parquet and passes on what is written."""
    df.write.mode("overwrite").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def watched(df: DataFrame, name: str, *counts: Column) -> tuple[DataFrame, Observation]:
    """The table with an observation of its number of rows and of the given aggregates, filled by the next action."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *counts), seen


def chain(*steps: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """One step out of several, in order; without any, the table itself."""

    def run(df: DataFrame) -> DataFrame:
        for step in steps:
            df = df.transform(step)
        return df

    return run
