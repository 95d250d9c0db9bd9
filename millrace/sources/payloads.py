"""Payloads of texture files: the levels of DDS and KTX 1 files as bytes, headers and checksums of CRN files, frames.

A file is one row of (path, content), as Spark's binaryFile source gives it; a level is one row out.
"""

from __future__ import annotations

import binascii
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textures import BLOCK_BYTES, KTX_MAGIC, binary_files, texture_format

# Fixed values of the public formats: DDS caps and pixel flags, and the magic numbers.
DDS_CUBE, DDS_FACE_BITS, DDS_VOLUME = 0x200, 0xFC00, 0x200000
DDS_FOURCC = 0x4
CRN_FORMATS = ("DXT1", "DXT3", "DXT5", "DXT5_CCxY", "DXT5_xGxR", "DXT5_xGBR", "DXT5_AGBR", "DXN_XY", "DXN_YX", "DXT5A", "ETC1")
CRN_LEAST = 62

LEVELS = pa.schema([("path", pa.string()), ("format", pa.string()), ("layer", pa.int32()), ("face", pa.int32()), ("level", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("depth", pa.int32()), ("offset", pa.int64()), ("data", pa.binary())])


def _side(n: int, level: int) -> int:
    return max(1, n >> level)


def _masks(bits: int, masks: tuple[int, ...]) -> str:
    """A name for uncompressed pixels: the channels from the lowest bits up with their widths, as b8g8r8."""
    shifts = sorted(((m & -m).bit_length() - 1, c, bin(m).count("1")) for c, m in zip("rgba", masks) if m)
    return "".join(f"{c}{n}" for _, c, n in shifts) or f"l{bits}"


def dds_layout(raw: bytes) -> list[tuple]:
    """(format, layer, face, level, width, height, depth, offset, size) of every level of a DDS file, face after face.

    Volume levels have their slices together. Kinds: blocks of DXT1, DXT3 and DXT5, and pixels of whole bytes.
    """
    if len(raw) < 128 or raw[:4] != b"DDS ":
        raise ValueError("no DDS header")
    height, width, _, depth, mips = struct.unpack_from("<5I", raw, 12)
    flags, fourcc, bits, *masks = struct.unpack_from("<I4s5I", raw, 80)
    caps = struct.unpack_from("<I", raw, 112)[0]
    faces = [k for k in range(6) if caps >> (10 + k) & 1] if caps & DDS_CUBE else [0]
    depth = max(1, depth) if caps & DDS_VOLUME else 1
    if flags & DDS_FOURCC:
        kind = fourcc.decode("ascii", "replace")
        if kind not in BLOCK_BYTES:
            raise ValueError(f"kind {kind!r} is not read")
        size = lambda w, h: -(-w // 4) * -(-h // 4) * BLOCK_BYTES[kind]
    else:
        if not bits or bits % 8:
            raise ValueError(f"pixels of {bits} bits are not read")
        kind = _masks(bits, tuple(masks))
        size = lambda w, h: w * h * (bits // 8)
    out, at = [], 128
    for face in faces:
        for level in range(max(1, mips)):
            w, h, d = (_side(n, level) for n in (width, height, depth))
            out.append((kind, 0, face, level, w, h, d, at, size(w, h) * d))
            at += out[-1][-1]
    if at > len(raw):
        raise ValueError("the file is shorter than its header says")
    return out


def ktx_layout(raw: bytes) -> list[tuple]:
    """The same of a KTX 1 file of either byte order: levels in order, in each its layers with their faces."""
    if len(raw) < 64 or raw[:12] != bytes.fromhex(KTX_MAGIC):
        raise ValueError("no KTX header")
    order = "<" if raw[12:16] == b"\x01\x02\x03\x04" else ">"
    gl_type, _, _, internal, _, width, height, depth, layers, faces, mips, meta = struct.unpack_from(order + "12I", raw, 16)
    kind, at, out = f"gl:{internal:#x}:{gl_type:#x}", 64 + meta, []
    layers_of, faces = max(1, layers), max(1, faces)
    for level in range(max(1, mips)):
        size = struct.unpack_from(order + "I", raw, at)[0]
        at += 4
        w, h, d = (_side(max(1, n), level) for n in (width, height, depth))
        single = faces == 6 and not layers  # then the size is that of one face, each padded to four bytes
        for layer in range(layers_of):
            for face in range(faces):
                part = size if single else size // (layers_of * faces)
                out.append((kind, layer, face, level, w, h, d, at, part))
                at += -(-part // 4) * 4 if single else part
        at = -(-at // 4) * 4
    if out[-1][-2] + out[-1][-1] > len(raw):
        raise ValueError("the file is shorter than its header says")
    return out


def texture_levels(files: DataFrame) -> DataFrame:
    """A row per level of the DDS and KTX files among (path, content), with its bytes; other files have no rows.

    A file whose header or length is wrong ends the query with its path.
    """
    kind = texture_format(F.col("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, raw, how in zip(*(b[c].to_pylist() for c in ("path", "content", "kind"))):
                try:
                    found = dds_layout(raw) if how == "dds" else ktx_layout(raw)
                except (ValueError, struct.error) as e:
                    raise ValueError(f"{path}: {e}") from e
                for *fields, at, size in found:
                    yield pa.RecordBatch.from_pylist([dict(zip(LEVELS.names, (path, *fields, at, raw[at : at + size])))], schema=LEVELS)

    rows = files.select("path", "content", kind.alias("kind")).where(F.col("kind").isin("dds", "ktx"))
    return rows.mapInArrow(run, "path string, format string, layer int, face int, level int, width int, height int, depth int, offset long, data binary")


def crn_headers(files: DataFrame) -> DataFrame:
    """path, width, height, levels, faces, format, userdata0, userdata1, data_size and valid of the CRN files.

    valid: the sizes agree with the file, and both checksums (CRC-16 with all bits set before and turned after) hold.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, raw in zip(b["path"].to_pylist(), b["content"].to_pylist()):
                raw = raw.ljust(33, b"\0")
                header, header_crc, size, data_crc, width, height, levels, faces, kind, _, _, one, two = struct.unpack_from(">HHIHHHBBBHIII", raw, 2)
                crc = lambda x: binascii.crc_hqx(x, 0xFFFF) ^ 0xFFFF
                valid = CRN_LEAST <= header <= size <= len(raw) and crc(raw[6:header]) == header_crc and crc(raw[header:size]) == data_crc
                name = CRN_FORMATS[kind] if kind < len(CRN_FORMATS) else None
                out.append({"path": path, "width": width, "height": height, "levels": levels, "faces": faces, "format": name, "userdata0": one, "userdata1": two, "data_size": size, "valid": valid})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    ints = ("width", "height", "levels", "faces")
    schema = pa.schema([("path", pa.string()), *((c, pa.int32()) for c in ints), ("format", pa.string()), *((c, pa.int64()) for c in ("userdata0", "userdata1", "data_size")), ("valid", pa.bool_())])
    rows = files.where(texture_format(F.col("content")) == "crn").select("path", "content")
    return rows.mapInArrow(run, "path string, width int, height int, levels int, faces int, format string, userdata0 long, userdata1 long, data_size long, valid boolean")


def frames(spark: SparkSession, path: str, extension: str = "*", wrap: int = 2000) -> DataFrame:
    """frame (from 1), place in the loop (from 0, after `wrap` frames from 0 again), path and content of frameNNNN files."""
    files = binary_files(spark, path, f"frame*.{extension}")
    rows = files.withColumn("frame", F.regexp_extract("path", r"frame(\d+)\.[^/]*$", 1)).where("frame <> ''")
    return rows.select(F.col("frame").cast("long").alias("frame"), "path", "content").withColumn("place", (F.col("frame") - 1) % wrap)
