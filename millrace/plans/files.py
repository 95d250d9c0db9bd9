"""Queries on texture files that are built as binary columns, a raster line or a pixel each, and read again."""

from __future__ import annotations

import binascii
import struct

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import bits
from ..sources import payloads, textures
from . import carriers as C
from .catalogue import query

LINE = "line as (select y, string_agg(lpad(to_hex(w & 255), 2, '0'), '' order by x) as h from px group by y)"


def _lines(spark, sf):
    """y, line: the low bytes of each raster line."""
    rows = C.pixels(spark, sf, 1).groupBy("y").agg(F.array_sort(F.collect_list(F.struct("x", (F.col("w") % 256).alias("b")))).alias("a"))
    return rows.select("y", F.unhex(F.array_join(F.transform("a", lambda s: F.lpad(F.hex(s["b"]), 2, "0")), "")).alias("line"))


def _level_rows(files):
    return payloads.texture_levels(files).select("path", "format", "level", "width", "height", F.hex("data").alias("bytes"))


def _word(x):
    return bits.to_little_endian(F.lit(x), 4)


@query("px:1", LINE + "; select 't' || y as path, 'r8' as format, l::int as level, (64 >> l)::int as width, 1 as height, upper(substr(h, 1, (128 >> l)::int)) as bytes from line, range(2) r(l)")
def dds_levels(spark, sf):
    """DDS files of one byte a pixel with two levels: every raster line, and its first half."""
    zero = _word(0)
    head = [F.lit(b"DDS "), _word(124), _word(0x1007), _word(1), _word(C.WIDTH), zero, zero, _word(2), *[zero] * 11, _word(32), _word(0x20000), zero, _word(8), _word(0xFF), *[zero] * 8]
    half = F.substring("line", 1, C.WIDTH // 2)
    return _level_rows(_lines(spark, sf).select(F.concat(F.lit("t"), F.col("y")).alias("path"), F.concat(*head, F.col("line"), half).alias("content")))


@query("px:1", LINE + "; select 't' || y as path, 'gl:0x8229:0x1401' as format, l::int as level, (64 >> l)::int as width, 1 as height, upper(substr(h, 1, (128 >> l)::int)) as bytes from line, range(2) r(l)")
def ktx_levels(spark, sf):
    """The same as KTX files: unsigned bytes of one channel."""
    head = [F.unhex(F.lit(textures.KTX_MAGIC)), *map(_word, (0x04030201, 0x1401, 1, 0x1903, 0x8229, 0x1903, C.WIDTH, 1, 0, 0, 1, 2, 0))]
    half = F.substring("line", 1, C.WIDTH // 2)
    content = F.concat(*head, _word(C.WIDTH), F.col("line"), _word(C.WIDTH // 2), half)
    return _level_rows(_lines(spark, sf).select(F.concat(F.lit("t"), F.col("y")).alias("path"), content.alias("content")))


@query("px", "select 't' || p as path, (w % 4096)::int as width, (w // 16)::int as height, 1 as levels, 6 as faces, case when p % 3 = 0 then 'DXT1' when p % 3 = 1 then 'DXT3' else 'DXT5' end as format, p::bigint as userdata0, p % 2 = 0 as valid from px")
def crn_info(spark, sf):
    """CRN headers of every pixel, every other one with a byte changed behind its checksum."""

    def build(batches):
        crc = lambda x: binascii.crc_hqx(x, 0xFFFF) ^ 0xFFFF
        for b in batches:
            out = []
            for p, w in zip(b["p"].to_pylist(), b["w"].to_pylist()):
                data = struct.pack(">I", w)
                rest = struct.pack(">HHHBBBHIII", crc(data), w % 4096, w // 16, 1, 6, p % 3, 0, 0, p, 0) + b"\0" * 41
                rest = struct.pack(">I", 10 + len(rest) + len(data)) + rest
                raw = b"Hx" + struct.pack(">HH", 6 + len(rest), crc(rest)) + rest + data
                out.append(raw if p % 2 == 0 else raw[:-1] + bytes([raw[-1] ^ 1]))
            yield pa.RecordBatch.from_arrays([pa.array([f"t{p}" for p in b["p"].to_pylist()], pa.string()), pa.array(out, pa.binary())], ["path", "content"])

    files = C.pixels(spark, sf).select("p", "w").mapInArrow(build, "path string, content binary")
    return payloads.crn_headers(files).select("path", "width", "height", "levels", "faces", "format", "userdata0", "valid")
