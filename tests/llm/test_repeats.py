"""Repeated bytes against brute force over every string of 50 bytes."""

import hashlib
import random

from millrace.llm import repeats

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, block string, n_bytes string"


def brute(rows, width=50):
    first = {}
    for doc, text in rows:
        raw = (text or "").encode()
        for i in range(len(raw) - width + 1):
            s = raw[i : i + width]
            if doc is not None and first.get(s, doc) >= doc:
                first[s] = doc
    out = []
    for doc, text in rows:
        raw = (text or "").encode()
        gone = [False] * len(raw)
        at = 0
        for i in range(len(raw) - width + 1):
            if doc is not None and first[raw[i : i + width]] < doc:
                for j in range(max(i, at), i + width):
                    gone[j] = True
                at = i + width
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((doc, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def result(df, **how):
    return sorted(map(tuple, repeats.cut_repeats(df, **how).collect()), key=str)


def test_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want = sorted(brute(rows), key=str)
    assert sum(r[2] for r in want) > 0
    assert result(df) == want
    assert result(df, block_bytes=1 << 14, bucket_bytes=1 << 14) == want
    assert result(df, block_bytes=1 << 14, bucket_bytes=1 << 14, hot_runs=3) == want


def test_awkward_rows(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcé ") for _ in range(rnd.randint(20, 90)))
    parts = [word() for _ in range(12)] + ["ab" * 60, "x" * 130, "\x00" * 70, "Thhaen " * 30]
    rows = [(k // 2 if k < 8 else k, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 6)))) for k in range(80)]
    rows += [(None, parts[0] * 3), (None, None), (5, None), (6, ""), (200, parts[12] * 40), (200, parts[12] * 40), (201, rows[9][1]), (201, rows[9][1]), (-7, rows[20][1]), (10**12, rows[21][1])]
    df = spark.createDataFrame([(*r, "b", "n") for r in rows], SCHEMA)
    want = sorted(brute(rows), key=str)
    assert result(df) == want
    assert result(df, block_bytes=300, bucket_bytes=2000) == want
    for hot in (0, 2, 10):
        assert result(df, block_bytes=300, bucket_bytes=2000, hot_runs=hot) == want
    assert result(df.limit(0)) == []


def test_ids_at_both_ends_and_blocks_of_like_size(spark):
    rnd = random.Random(8)
    text = lambda: "".join(rnd.choice("abcdefgh ") for _ in range(400))
    shared = text()[:120]
    ids = [-(2**63), 2**63 - 1, 10**12, *range(0, 4000, 7)]
    rows = [(i, shared + text() if i % 3 == 0 else text()) for i in ids]
    df = spark.createDataFrame([(*r, "b", "n") for r in rows], SCHEMA)
    want = sorted(brute(rows), key=str)
    assert result(df, block_bytes=10_000, bucket_bytes=20_000) == want
    assert result(df, block_bytes=10_000, bucket_bytes=20_000, hot_runs=5) == want
    starts, total = repeats.block_starts(df, 10_000)
    assert total == sum(len(t) for _, t in rows) and list(starts) == sorted(set(starts))
    size = [0] * len(starts)
    for i, t in rows:
        size[sum(int(x) <= i for x in starts) - 1] += len(t)
    assert max(size) < 20_000 and len(starts) <= total / 10_000 + 9


def test_long_runs_that_differ_in_the_middle(spark):
    cells = [c * 2 + " " for c in "0-=|"] + ["0 ", "- ", "_", "|  |", "spam "]
    rows = []
    for cell in cells:
        rows += [(len(rows) + k, cell * (180 // len(cell)) + c + cell * (180 // len(cell))) for k, c in enumerate("123456789abc")]
    df = spark.createDataFrame([(*r, "b", "n") for r in rows], SCHEMA)
    want = sorted(brute(rows), key=str)
    assert result(df) == want
    assert result(df, block_bytes=1000, bucket_bytes=2000) == want


def test_kept_text(spark):
    same = "the quick brown fox jumps over the lazy dog, again and again and again"
    df = spark.createDataFrame([(1, same + " one", "", ""), (2, "two " + same, "", "")], SCHEMA)
    kept = {r.doc_id: bytes(r.kept).decode() for r in repeats.cut_repeats(df, keep_text=True).collect()}
    assert kept == {1: same + " one", 2: "two "}
