"""Texture payloads, checksums, frames, file sinks and pairs, on files made here."""

import binascii
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import transforms
from millrace.operators import blocks as B
from millrace.operators import codec
from millrace.sources import payloads, textures, writers


def dds(width, height, mips, pixel, caps=0, depth=0, body=b""):
    return b"DDS " + struct.pack("<7I", 124, 0x1007, height, width, 0, depth, mips) + b"\0" * 44 + pixel + struct.pack("<5I", 0x1000, caps, 0, 0, 0) + body


def pixel(fourcc=b"\0" * 4, bits=0, masks=(0, 0, 0, 0)):
    return struct.pack("<2I4s5I", 32, 4 if fourcc.strip(b"\0") else 0x40, fourcc, bits, *masks)


def test_dds_levels_are_the_files_bytes(spark, tmp_path):
    rng = np.random.default_rng(1)
    body = rng.integers(0, 256, 4096 * 8, dtype=np.uint8).tobytes()
    files = {
        "a.dds": dds(10, 6, 3, pixel(b"DXT1"), body=body[: 3 * 2 * 8 + 2 * 8 + 8]),
        "b.dds": dds(4, 4, 1, pixel(b"DXT5"), caps=0x200 | 0xFC00, body=body[: 6 * 16]),
        "c.dds": dds(3, 2, 2, pixel(bits=24, masks=(0xFF0000, 0xFF00, 0xFF, 0)), body=body[: 18 + 3]),
        "d.dds": dds(4, 4, 2, pixel(bits=32, masks=(0xFF0000, 0xFF00, 0xFF, 0xFF000000)), caps=0x200000, depth=2, body=body[: 2 * 64 + 16]),
        "e.dds": dds(2, 2, 1, pixel(bits=8, masks=(0xFF, 0, 0, 0)), body=body[:4]),
    }
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)
    (tmp_path / "other.bin").write_bytes(b"x")
    rows = payloads.texture_levels(textures.binary_files(spark, str(tmp_path))).collect()
    got: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r.path, r.offset)):
        got.setdefault(r.path[-5:], []).append(r)
    assert {n: b"".join(bytes(r.data) for r in v) for n, v in got.items()} == {n: raw[128:] for n, raw in files.items()}
    assert [(r.format, r.width, r.height, len(r.data)) for r in got["a.dds"]] == [("DXT1", 10, 6, 48), ("DXT1", 5, 3, 16), ("DXT1", 2, 1, 8)]
    assert [r.face for r in got["b.dds"]] == list(range(6))
    assert [(r.format, r.depth, r.level) for r in got["d.dds"]] == [("b8g8r8a8", 2, 0), ("b8g8r8a8", 1, 1)]
    assert got["c.dds"][0].format == "b8g8r8"


@pytest.mark.parametrize("order", "<>")
def test_ktx_levels(order):
    def head(width, height, layers, faces, mips, meta=0):
        return bytes.fromhex(textures.KTX_MAGIC) + struct.pack(order + "13I", 0x04030201, 0, 1, 0, 0x83F0, 0, width, height, 0, layers, faces, mips, meta) + b"m" * meta

    size = lambda n: struct.pack(order + "I", n)
    plain = head(8, 8, 0, 1, 2, 4) + size(32) + b"a" * 32 + size(8) + b"b" * 8
    assert [(r[3], r[4], plain[r[-2] : r[-2] + r[-1]]) for r in payloads.ktx_layout(plain)] == [(0, 8, b"a" * 32), (1, 4, b"b" * 8)]
    cube = head(1, 1, 0, 6, 1) + size(3) + b"".join(bytes([65 + k]) * 3 + b"\0" for k in range(6))
    assert [cube[r[-2] : r[-2] + r[-1]] for r in payloads.ktx_layout(cube)] == [bytes([65 + k]) * 3 for k in range(6)]
    array = head(4, 4, 2, 1, 1) + size(16) + b"x" * 8 + b"y" * 8
    assert [(r[1], array[r[-2] : r[-2] + r[-1]]) for r in payloads.ktx_layout(array)] == [(0, b"x" * 8), (1, b"y" * 8)]
    with pytest.raises(ValueError):
        payloads.ktx_layout(plain[:-1])


def test_short_or_unknown_files_end_with_an_error():
    for raw in (b"DDS ", dds(8, 8, 1, pixel(b"DXT1"), body=b"1234567"), dds(8, 8, 1, pixel(b"DX10")), dds(8, 8, 1, pixel(bits=0))):
        with pytest.raises(ValueError):
            payloads.dds_layout(raw)


def test_crn_headers_and_checksums(spark):
    crc = lambda x: binascii.crc_hqx(x, 0xFFFF) ^ 0xFFFF
    data = b"levels and tables"
    rest = struct.pack(">HHHBBBHIII", crc(data), 64, 32, 7, 1, 0, 0, 0, 5, 6) + b"\0" * 41
    rest = struct.pack(">I", 6 + 4 + len(rest) + len(data)) + rest
    raw = b"Hx" + struct.pack(">HH", 6 + len(rest), crc(rest)) + rest + data
    bad = raw[:-1] + b"?"
    df = spark.createDataFrame([("good", raw), ("bad", bad), ("cut", raw[:40]), ("other", b"PNG"), ("none", None)], "path string, content binary")
    got = {r.path: r for r in payloads.crn_headers(df).collect()}
    assert {k: r.valid for k, r in got.items()} == {"good": True, "bad": False, "cut": False}
    r = got["good"]
    assert (r.width, r.height, r.levels, r.faces, r.format, r.userdata0, r.userdata1) == (64, 32, 7, 1, "DXT1", 5, 6)


def test_frames_wrap(spark, tmp_path):
    for n in (1, 2, 3, 12):
        (tmp_path / f"frame{n:04d}.png").write_bytes(bytes([n]))
    (tmp_path / "frame.png").write_bytes(b"")
    got = [(r.frame, r.place, bytes(r.content)) for r in payloads.frames(spark, str(tmp_path), "png", wrap=3).orderBy("frame").collect()]
    assert got == [(1, 0, b"\1"), (2, 1, b"\2"), (3, 2, b"\3"), (12, 2, b"\x0c")]


def test_image_files_are_read_back(spark, tmp_path):
    px = np.random.default_rng(2).integers(0, 256, (5, 7, 3), dtype=np.uint8)
    images = spark.createDataFrame([("one", 7, 5, px.tobytes()), ("lost", -1, -1, None)], "image_id string, width int, height int, rgb binary")
    for kind in writers.KINDS:
        written = writers.write_files(writers.image_files(images, kind), f"file://{tmp_path}/{kind}").collect()
        assert [r.path.rsplit("/", 1)[1] for r in written] == [f"one.{kind}"]
    for kind in ("png", "bmp"):  # Spark's image source reads these
        back = textures.raster_images(spark, f"{tmp_path}/{kind}").first()
        assert np.frombuffer(back.rgb, np.uint8).reshape(5, 7, 3).tolist() == px.tolist()
    tga = (tmp_path / "tga/one.tga").read_bytes()
    assert len(tga) == 18 + px.size and np.frombuffer(tga[18:], np.uint8).reshape(5, 7, 3)[:, :, ::-1].tolist() == px.tolist()
    hdr = (tmp_path / "hdr/one.hdr").read_bytes()
    e = np.frombuffer(hdr[hdr.index(b"+X 7\n") + 5 :], np.uint8).reshape(5, 7, 4).astype(float)
    assert np.abs((e[:, :, :3] + 0.5) * 2.0 ** (e[:, :, 3:] - 136) - px / 255).max() < 1 / 128
    with pytest.raises(ValueError):
        writers.image_files(images, "gif")


def test_names_stay_in_the_folder(spark, tmp_path):
    with pytest.raises(Exception, match="no file name"):
        writers.write_files(spark.createDataFrame([("../x", b"")], "name string, data binary"), f"file://{tmp_path}").collect()


def test_pairs_and_files_of_containers(spark, tmp_path):
    y, x = np.mgrid[0:256, 0:512]
    rgb = np.stack([x // 4, y // 2, (x + y) // 6], axis=2).astype(np.uint8)
    px = codec.blocks_of(rgb.astype(np.int64))
    ep1, ep2, word = B.compress(px)
    dxt = codec.dxt_bytes(ep1, ep2, word)
    images = spark.createDataFrame([("x/ramp.png", 512, 256, rgb.tobytes())], "image_id string, width int, height int, rgb binary")
    plain = bytes(codec.encode_images(images).first().container)
    paired = images.withColumn("dxt", F.lit(dxt))
    assert bytes(codec.encode_pairs(paired).first().container) == plain
    # Given blocks are used: other selectors give another container
    other = images.withColumn("dxt", F.lit(codec.dxt_bytes(ep1, ep2, np.zeros_like(word))))
    assert bytes(codec.encode_pairs(other).first().container) != plain
    with pytest.raises(Exception, match="do not agree"):
        codec.encode_pairs(images.withColumn("dxt", F.lit(dxt[:-8]))).collect()
    blocks = spark.createDataFrame([("y/ramp.dxt", dxt)], "path string, content binary")
    for k, given in enumerate((None, blocks)):
        done = codec.encode_files(images, f"file://{tmp_path}/{k}", given).collect()
        assert [(r.path[-9:], r.bytes) for r in done] == [("/ramp.mrc", len(plain))]
        assert (tmp_path / f"{k}/ramp.mrc").read_bytes() == plain


def test_tap_watch_and_chain(spark, tmp_path):
    df = spark.range(5)
    steps = writers.chain(lambda d: d.where("id > 1"), lambda d: writers.tap(d, f"{tmp_path}/t"), lambda d: d.withColumn("twice", F.col("id") * 2))
    assert sorted(r.twice for r in steps(df).collect()) == [4, 6, 8]
    assert spark.read.parquet(f"{tmp_path}/t").count() == 3
    assert writers.chain()(df) is df
    seen, what = writers.watched(df, "seen", F.max("id").alias("most"))
    assert seen.count() == 5 and what.get == {"rows": 5, "most": 4}


def test_bytes_of_tiles_are_held_in_range():
    tiles = np.zeros((2, 8, 8))
    tiles[0, 0, 0], tiles[1, 0, 0] = 8 * 300, -8 * 5
    assert (transforms.byte_tiles(tiles)[0] == 255).all() and (transforms.byte_tiles(tiles)[1] == 0).all()
    given = np.random.default_rng(5).integers(0, 256, (3, 8, 8))
    assert (transforms.byte_tiles(transforms.dct_tiles(given)) == given).all()


def test_container_source(spark, tmp_path):
    from millrace.sources import containers

    containers.register(spark)
    folder = f"file://{tmp_path}/c"
    df = spark.createDataFrame([(f"i{k}", bytes([k]) * k) for k in range(6)], "image_id string, container binary")
    for _ in range(2):  # the same again leaves the same files
        df.select("container", "image_id").write.format("millrace_container").mode("append").save(folder)
    (tmp_path / "c/other.txt").write_bytes(b"")
    back = spark.read.format("millrace_container").option("partition_bytes", 4).load(folder)
    assert back.rdd.getNumPartitions() > 1
    assert sorted((r.image_id, bytes(r.container)) for r in back.collect()) == [(f"i{k}", bytes([k]) * k) for k in range(6)]
    (tmp_path / "none").mkdir()
    assert spark.read.format("millrace_container").load(f"file://{tmp_path}/none").count() == 0


def test_pnm_and_tga_files(spark, tmp_path):
    from millrace.sources import rasters

    px = np.random.default_rng(6).integers(0, 256, (3, 4, 3), dtype=np.uint8)
    gray = px[:, :, 0]
    packed = np.repeat(np.array([[[9, 8, 7]]], np.uint8), 12, axis=0).reshape(3, 4, 3)
    rle = bytearray(writers.tga_bytes(packed))
    rle[2] = 10
    head = writers.tga_bytes(px)[:18]
    files = {
        "a.ppm": (b"P6\n# made here\n4 3\n255\n" + px.tobytes(), px),
        "b.pgm": (b"P5 4 3 255 " + gray.tobytes(), np.repeat(gray[:, :, None], 3, axis=2)),
        "c.ppm": (b"P3\n4 3\n255\n" + " ".join(map(str, px.ravel())).encode(), px),
        "d.tga": (writers.tga_bytes(px), px),
        "e.TGA": (writers.tga_bytes(np.dstack([px, gray])), px),
        "f.tga": (bytes(rle[:18]) + bytes([0x80 | 8, 7, 8, 9, 2]) + bytes([7, 8, 9] * 3), packed),
        "g.tga": (head[:17] + b"\0" + writers.tga_bytes(px[::-1])[18:], px),
        "h.tga": (head + b"short", None),
        "i.ppm": (b"P6 4 3 65535 ", None),
        "j.pgm": (b"P5", None),  # the binaryFile source has no rows for empty files
    }
    for name, (raw, _) in files.items():
        (tmp_path / name).write_bytes(raw)
    (tmp_path / "k.txt").write_bytes(b"P6")
    got = {r.image_id[-5:]: None if r.rgb is None else np.frombuffer(r.rgb, np.uint8).reshape(r.height, r.width, 3).tolist() for r in rasters.decode_rasters(textures.binary_files(spark, str(tmp_path))).collect()}
    assert got == {name: None if want is None else want.tolist() for name, (_, want) in files.items()}
