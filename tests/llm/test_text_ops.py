"""Secret scans, token output, packing and mixing against brute force, and on awkward rows."""

import hashlib
import random
import re
import subprocess
import sys
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import mixing, packing, queries, secrets, token_store, tokens

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part int, ids string, size string"


def awkward(spark):
    rnd = random.Random(3)
    long = " ".join(rnd.choice(["alpha", "beta,", "gamma.\n", "naïve", "x!"]) for _ in range(6000))
    rows = [
        (1, None, "en", "a", None), (2, "", "en", None, 0), (3, "   \n\t ", "en", "a", 5), (4, long, "en", "b", len(long)),
        (5, "password=hunter22 tokensecret: 'abcdefg' api_key=x", "en", "b", 1), (5, "password=hunter22 tokensecret: 'abcdefg' api_key=x", "en", "b", 1),
        (6, "AKIA" + "A" * 16 + " é " + "0123456789abcdef" * 2 + " PASSWD = \"Zm9vYmFy\" K toKen:abcdef", None, "é", 9),
        (7, "don't  do\n\nit 'tis 日本 語 a b <|endoftext|>", "en", "c", 3), (None, "null id token=abcdefghij", "en", "c", 3),
    ]
    return spark.createDataFrame([(*r, 0, "x", "y") for r in rows], SCHEMA), rows


def brute_spans(text):
    text, out = text or "", []
    kinds = [
        ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ]
    for k, (kind, pattern, good) in enumerate(kinds):
        out += [(m.start(), k, m.end(), kind) for m in re.finditer(pattern, text, re.A) if good(m)]
    return sorted(out)


def test_secrets_match_brute_force(spark):
    docs, rows = awkward(spark)
    for frame, texts in ((docs, [(r[0], r[1]) for r in rows]), (spark.read.parquet(f"{SF}/documents.parquet"), None)):
        texts = texts or [(r.doc_id, r.text) for r in frame.collect()]
        want = []
        for doc, text in texts:
            s = brute_spans(text)
            said = ",".join(f"{k}:{a}:{b}" for a, _, b, k in s)
            want.append((doc, *(sum(x[3] == k for x in s) for k in ("assign", "access", "hex")), hashlib.sha256(said.encode()).hexdigest()))
        got = [tuple(r)[:4] + (r.base_sha256,) for r in secrets.scan(frame).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_hex_at_every_offset_and_random_texts():
    rnd = random.Random(5)
    for lead in range(30):
        for n in (23, 24, 25, 40):
            text = "é" * (lead % 3) + "g" * lead + "a1" * (n // 2) + "b" * (n % 2) + "-"
            assert [x[:3] for x in secrets.find_spans(text)] == [x[:3] for x in brute_spans(text)]
    parts = ["password", "=", ": ", "'", '"', "token", "secret", "api_key", "APIkey", "AKIA", "ABCDEFGH", "0a1b2c", " ", "é", "x"]
    for _ in range(3000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25)))
        assert [x[:3] for x in secrets.find_spans(text)] == [x[:3] for x in brute_spans(text)], text


def test_checksum_spans_and_redaction(spark):
    body = "a" * 30
    n, tail = zlib.crc32(body.encode()), ""
    while n:
        n, d = divmod(n, 62)
        tail = secrets.BASE62[d] + tail
    good = f"ghp_{body}{tail.rjust(6, '0')}"
    assert secrets.find_spans(f"x {good} y") == [(2, 3, 2 + len(good)), (6, 2, 37)]
    assert [x for x in secrets.find_spans(f"x {good[:-1]}! y") if x[1] == 3] == []
    assert secrets.redacted(f"x {good} y password=abcdefg") == "x [REDACTED] y [REDACTED]"
    docs, rows = awkward(spark)
    out = secrets.redact(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    assert all(not brute_spans(r.text) for r in out.collect())


def reference_ids(texts, end):
    t = tokens.encoder(tokens.public_vocabulary()).tokenizer
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, end], "<u4") for x in texts]


def test_encoder_equals_the_library():
    rnd = random.Random(1)
    signs = [" ", "\n", "\t", "'", "s", "re", "a", "B", "é", "1", "!", "-", "  ", "\r", "_", "ll", "’", "½", "\x0b", "\x1c", "\x00", "α"]
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 14))) for _ in range(4000)]
    got = tokens.Encoder(tokens.public_vocabulary())(texts)
    assert [x.tolist() for x in got] == [x[:-1].tolist() for x in reference_ids(texts, 0)]


MEMORY = """
import random, re
from millrace.llm import tokens

def mb():
    return sum(map(int, re.findall(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) >> 10

rnd, before = random.Random(2), mb()
e, most = tokens.Encoder(tokens.public_vocabulary()), 0
for _ in range(8):
    e([" ".join("".join(rnd.choices("abcdefgh", k=8)) for _ in range(1000)) for _ in range(100)])
    most = max(most, mb() - before)
print(most)
"""


def test_encoder_takes_little_memory():
    root = Path(tokens.__file__).parents[2]
    got = subprocess.run([sys.executable, "-c", MEMORY], cwd=root, capture_output=True, text=True, check=True)
    assert int(got.stdout) < 200, got.stdout


def test_encoder_bounds_its_calls_and_forgets(monkeypatch):
    monkeypatch.setattr(tokens, "CALL_PIECES", 50)
    monkeypatch.setattr(tokens, "KEPT_ENTRIES", 300)
    encoder, rnd, calls = tokens.Encoder(tokens.public_vocabulary()), random.Random(4), []
    pieces = encoder._pieces
    monkeypatch.setattr(encoder, "_pieces", lambda p: calls.append(len(p)) or pieces(p))
    for n in (400, 5, 400, 2000, 5, 1):
        texts = [" ".join("".join(rnd.choices("abé1!", k=rnd.randint(1, 9))) for _ in range(n)) for _ in range(3)] + ["x <|endoftext|> y", None]
        assert [x.tolist() for x in encoder(texts)] == [x[:-1].tolist() for x in reference_ids(texts, 0)]
        kept = len(encoder.start)
    assert max(calls) == 50 and kept < 2000  # a long text's arrays don't stay


def test_token_files_round_trip(spark, tmp_path):
    docs, rows = awkward(spark)
    token_store.write_tokens(docs, str(tmp_path / "t"), tokens.public_vocabulary(), page_rows=2)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    ids, at, want = reference_ids([r[1] for r in order], 0), 0, []
    for r, x in zip(order, ids):
        want.append((r[0], at, len(x), zlib.crc32(x.tobytes())))
        at += len(x)
    assert sorted(map(tuple, token_store.summaries(spark, str(tmp_path / "t")).collect()), key=str) == sorted(want, key=str)
    some = {r.doc_id: r.ids for r in token_store.read_tokens(spark, str(tmp_path / "t"), 4, 6).collect()}
    assert sorted(some) == [4, 5, 6] and some[4] == next(x.tolist() for r, x in zip(order, ids) if r[0] == 4)


def test_token_files_of_an_empty_table(spark, tmp_path):
    docs, _ = awkward(spark)
    token_store.write_tokens(docs.limit(0), str(tmp_path / "t"), tokens.public_vocabulary())
    assert token_store.summaries(spark, str(tmp_path / "t")).count() == 0


def test_op3_whole_table(spark):
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op3_token_output(spark, SF).collect()}
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    at = 0
    for (doc, _), x in zip(docs, reference_ids([t for _, t in docs], 0)):
        assert got[doc] == (at, len(x), zlib.crc32(x.tobytes()))
        at += len(x)


def check_packing(rows, docs, capacity=1024):
    ids = dict()
    for (doc, _), x in zip(docs, reference_ids([t for _, t in docs], 2)):
        ids.setdefault(doc, []).append(x)
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_bin.setdefault(r.sequence_id, []).append(r)
        whole = ids[r.doc_id][0]
        assert zlib.crc32(whole[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    for doc, parts in by_doc.items():
        n, copies = len(ids[doc][0]), len(ids[doc])
        assert sum(p.length for p in parts) == n * copies
        assert sorted(p.piece for p in parts) == sorted(list(range(-(-n // capacity))) * copies)
        assert all(p.length == capacity or p.piece == 0 for p in parts)
    for parts in by_bin.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
    return len(by_bin), -(-sum(len(x) for c in ids.values() for x in c) // capacity)


def test_packing(spark):
    rows = queries.op8_best_fit_packing(spark, SF).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    used, bound = check_packing(rows, docs)
    assert used <= 1.02 * bound + 1
    frame, awk = awkward(spark)
    check_packing(packing.pack(frame, tokens.public_vocabulary()).collect(), [(r[0], r[1]) for r in awk])
    check_packing(packing.pack(spark.read.parquet(f"{SF}/documents.parquet"), tokens.public_vocabulary(), shard_items=40).collect(), docs)
    assert packing.pack(frame.limit(0), tokens.public_vocabulary()).count() == 0


def test_genetic_moves_keep_every_item_once():
    rnd = random.Random(2)
    size = [rnd.randint(1, 900) for _ in range(300)]
    first, second = [], []
    packing.best_fit(list(range(300)), size, first, [], 1024)
    packing.best_fit(sorted(range(300), key=lambda i: -size[i]), size, second, [], 1024)
    for bins in (packing.crossover(first, second, size, 1024, rnd), packing.mutate(first, size, 1024, rnd), packing.evolve(size, [first], 1)):
        assert sorted(i for b in bins for i in b) == list(range(300))
        assert all(sum(size[i] for i in b) <= 1024 for b in bins)
    assert packing.lower_bound(size, 1024) <= len(packing.evolve(size, [], 1)) <= len(second)


def test_swaps_fill_bins():
    size = [600, 500, 300, 124, 424, 700]
    bins, room = [[0, 2], [1]], [124, 524]
    loose = packing.swap_in([4, 5, 3], size, bins, room)
    assert bins == [[0, 4], [5]] and room == [0, 324] and sorted(loose) == [1, 2, 3]


def test_generations_lower_the_number_of_bins():
    """Triples that fill bins exactly, which best fit does not find."""
    rnd, size = random.Random(12), []
    for _ in range(60):
        a, b = rnd.randint(260, 400), rnd.randint(260, 360)
        size += [a, b, 1024 - a - b]
    size.sort(reverse=True)
    first = []
    packing.best_fit(list(range(180)), size, first, [], 1024)
    best = packing.evolve(size, [first], 3, generations=60)
    assert packing.lower_bound(size, 1024) == 60 <= len(best) < len(first)


def test_lower_bound_by_brute_force():
    rnd = random.Random(5)
    for _ in range(200):
        size = [rnd.randint(1, 20) for _ in range(rnd.randint(1, 7))]

        def fits(rest, bins):
            if not rest:
                return True
            tried = set()
            for k, room in enumerate(bins):
                if room >= rest[0] and room not in tried:
                    tried.add(room)
                    if fits(rest[1:], [*bins[:k], room - rest[0], *bins[k + 1 :]]):
                        return True
            return False

        least = next(n for n in range(1, 8) if fits(sorted(size, reverse=True), [20] * n))
        assert -(-sum(size) // 20) <= packing.lower_bound(size, 20) <= least


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_mixing_equals_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = sorted(con.sql(queries.ORACLE["op10_source_mix"]).fetchall())
    got = sorted(map(tuple, queries.op10_source_mix(spark, sf).collect()))
    assert [(*x[:3], x[4]) for x in got] == [(*x[:3], x[4]) for x in want]
    assert np.allclose([x[3] for x in got], [x[3] for x in want], rtol=1e-12)


def test_mixing_targets_and_awkward_rows(spark):
    docs, rows = awkward(spark)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(re.findall(r"[^\x20\x09-\x0d]+", r[1] or ""))
    level = {s: 0.0 for s in sizes}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    left, free = 1.5 * sum(sizes.values()), set(sizes)
    while left > 1e-9 and free:
        share = left / sum(weight[s] for s in free)
        left = 0.0
        for s in sorted(free, key=str):
            level[s] += share * weight[s]
            if level[s] >= 2 * sizes[s]:
                left += level[s] - 2 * sizes[s]
                level[s] = 2.0 * sizes[s]
                free.discard(s)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - level[r.source]) < 1e-6
        assert r.taken <= 2 * r.size
    assert mixing.mix(docs.limit(0)).count() == 0
    copies = spark.createDataFrame([(i, "a b c", "s", "en", 5) for i in range(50)], "doc_id long, text string, source string, lang string, n_chars long")
    docs = copies.unionByName(copies.withColumn("source", F.lit("t")))
    assert sum(r.taken for r in mixing.mix(docs).collect()) == pytest.approx(450, abs=6)


def test_resampled_rows(spark):
    docs, rows = awkward(spark)
    out = mixing.resample(docs.withColumn("mix_words", F.lit(1)))
    assert out.columns == [*docs.columns, "mix_words"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r.doc_id: r.copies for r in mixing.mix(docs).collect() if r.copies}
    got = {r.doc_id: r["count"] for r in mixing.resample(docs).groupBy("doc_id").count().collect()}
    assert got == want


def test_hex_runs_in_long_texts_beyond_ascii():
    import time

    from millrace.llm import secrets

    text = "é" + "0123456789abcdef" * 100_000 + "é " + ("ab12" * 7 + "ä") * 20_000
    began = time.perf_counter()
    found = [x for x in secrets.find_spans(text) if secrets.KINDS[x[1]] == "hex"]
    assert time.perf_counter() - began < 5
    assert found[0] == (1, 2, 1_600_001) and len(found) == 20_001
    assert all(len(text[a:b]) >= 24 and set(text[a:b]) <= set("0123456789abcdef") for a, _, b in found)
