"""Texts made to defeat polynomial hashes: Thue-Morse words and their complements."""

import zlib

import numpy as np
import pytest

from millrace.llm import bytehash, near_duplicates, packing, token_store, tokens


def thue_morse(n, letters):
    bits = [0]
    while len(bits) < n:
        bits += [1 - x for x in bits]
    return "".join(letters[x] for x in bits[:n])


WORDS = [thue_morse(n, letters) for n in (8, 64, 255, 256, 257, 1024, 2048, 4096) for letters in ("ab", "ba", "xy")]


def test_stretches_keep_their_hash_wherever_they_lie():
    draw = np.random.default_rng(3)
    data = draw.integers(0, 256, 5000, dtype=np.uint8)
    starts = draw.integers(0, 4900, 400)
    ends = starts + draw.integers(0, 100, 400)
    one = bytehash.stretch_hashes(data, starts, ends)
    other = np.array([bytehash.stretch_hashes(np.concatenate([[7], data[i:j], [9]]).astype(np.uint8), np.array([1]), np.array([1 + j - i]))[0] for i, j in zip(starts, ends)])
    assert (one == other).all()
    distinct = {data[i:j].tobytes() for i, j in zip(starts, ends)}
    assert len(np.unique(one)) == len(distinct)


def test_complements_differ():
    data = np.frombuffer(" ".join(WORDS).encode(), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in WORDS]) - 1
    starts = ends - [len(w) for w in WORDS]
    assert len(np.unique(bytehash.stretch_hashes(data, starts, ends))) == len(WORDS)


@pytest.mark.parametrize("rounds", [1, 2])
def test_encoder_against_the_library(rounds):
    encode = tokens.Encoder(tokens.public_vocabulary())
    texts = [*WORDS, *(f"{w} the {w[::-1]} of" for w in WORDS), " ".join(WORDS)]
    for _ in range(rounds):
        got = encode(texts)
    for own, whole in zip(got, encode._direct(texts)):
        assert np.array_equal(own, whole)


def test_a_full_table_stays_exact(monkeypatch):
    monkeypatch.setattr(tokens, "SLOT_BITS", 4)
    encode = tokens.Encoder(tokens.public_vocabulary())
    texts = ["one two three four five six seven eight nine ten " + w for w in WORDS[:6]] * 3
    for own, whole in zip(encode(texts), encode._direct(texts)):
        assert np.array_equal(own, whole)


def test_pieces_and_stored_tokens(spark, tmp_path):
    rows = [(k, w) for k, w in enumerate(WORDS)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    whole = tokens.Encoder(tokens.public_vocabulary())._direct(WORDS)
    got = {r["doc_id"]: r["ids_crc32"] for r in packing.pieces(df, tokens.public_vocabulary(), end_id=2, capacity=1 << 20).collect()}
    assert got == {k: zlib.crc32(np.append(ids, 2).astype("<u4").tobytes()) for k, ids in enumerate(whole)}
    path = str(tmp_path / "tokens")
    token_store.write_tokens(df, path, tokens.public_vocabulary(), end_id=0)
    stored = {r["doc_id"]: r["ids_crc32"] for r in token_store.summaries(spark, path).collect()}
    assert stored == {k: zlib.crc32(np.append(ids, 0).astype("<u4").tobytes()) for k, ids in enumerate(whole)}


def test_different_long_words_do_not_link(spark):
    a, b = thue_morse(2048, "ab"), thue_morse(2048, "ba")
    df = spark.createDataFrame([(1, f"{a} one"), (2, f"{b} one"), (3, f"{a} one")], "doc_id long, text string")
    assert sorted(map(tuple, near_duplicates.groups(df).collect())) == [(1, 1, 1), (2, 1, 2), (3, 1, 1)]
