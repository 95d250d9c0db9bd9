"""Raster files that Spark's image source does not read: PNM and TGA, to the same columns."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: One field of a PNM header, with the space and comments before it.
_FIELD = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)")


def pnm_pixels(raw: bytes) -> np.ndarray:
    """(height, width, 3) of a gray or colour PNM file, as text (P2, P3) or bytes (P5, P6), with up to 255 levels."""
    kind, at, fields = raw[:2], 2, []
    if kind not in (b"P2", b"P3", b"P5", b"P6"):
        raise ValueError("no PNM file of pixels")
    for _ in range(3):
        found = _FIELD.match(raw, at)
        if not found:
            raise ValueError("the header is cut")
        fields.append(int(found.group(1)))
        at = found.end()
    w, h, most = fields
    channels = 3 if kind in (b"P3", b"P6") else 1
    if not 0 < most < 256:
        raise ValueError(f"{most} levels are not read")
    n = w * h * channels
    values = np.frombuffer(raw, np.uint8, n, at + 1) if kind in (b"P5", b"P6") else np.array(raw[at:].split()[:n], dtype=np.int64)
    if len(values) < n:
        raise ValueError("the file is shorter than its header says")
    px = (values.astype(np.int64) * 255 // most).astype(np.uint8).reshape(h, w, channels)
    return np.repeat(px, 3, axis=2) if channels == 1 else px


def tga_pixels(raw: bytes) -> np.ndarray:
    """(height, width, 3) of a TGA file of 8, 24 or 32 bits a pixel without palette, plain or in run lengths; alpha is dropped."""
    if len(raw) < 18:
        raise ValueError("the header is cut")
    kind, w, h, bits, flags = raw[2], *np.frombuffer(raw, "<u2", 2, 12).tolist(), raw[16], raw[17]
    if raw[1] or kind not in (2, 3, 10, 11) or bits not in (8, 24, 32):
        raise ValueError(f"kind {kind} with {bits} bits is not read")
    size, at, n = bits // 8, 18 + raw[0], w * h
    if kind < 8:
        body = raw[at : at + n * size]
    else:
        parts, left = [], n
        while left > 0 and at < len(raw):
            many = min((raw[at] & 127) + 1, left)
            packed = raw[at] >> 7
            one = raw[at + 1 : at + 1 + (size if packed else many * size)]
            parts.append(one * many if packed else one)
            at += 1 + len(one)
            left -= many
        body = b"".join(parts)
    if len(body) < n * size:
        raise ValueError("the file is shorter than its header says")
    px = np.frombuffer(body, np.uint8).reshape(h, w, size)
    px = np.repeat(px, 3, axis=2) if size == 1 else px[:, :, [2, 1, 0]]
    px = px if flags & 0x20 else px[::-1]
    return px[:, ::-1] if flags & 0x10 else px


READERS = {"pnm": pnm_pixels, "ppm": pnm_pixels, "pgm": pnm_pixels, "tga": tga_pixels}


def decode_rasters(files: DataFrame) -> DataFrame:
    """image_id, width, height and RGB bytes of the PNM and TGA files among (path, content), by their endings.

    A file that cannot be decoded keeps its row, with no bytes and sides of -1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, kind, raw in zip(*(b[c].to_pylist() for c in ("path", "kind", "content"))):
                try:
                    px = READERS[kind](raw or b"")
                    out.append((path, px.shape[1], px.shape[0], np.ascontiguousarray(px).tobytes()))
                except ValueError:
                    out.append((path, -1, -1, None))
            columns = zip(*out) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.binary()))], ["image_id", "width", "height", "rgb"])

    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    rows = files.select("path", kind.alias("kind"), "content").where(F.col("kind").isin(*READERS))
    return rows.mapInArrow(run, "image_id string, width int, height int, rgb binary")
