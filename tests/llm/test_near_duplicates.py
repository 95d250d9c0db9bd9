"""The Jaccard join and the components against brute force over all pairs."""

import random
import re

import numpy as np
import pytest

from millrace.llm import components, near_duplicates

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, block string, n long"


def sets(rows):
    out = []
    for doc, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0d]+", low)
        out.append((doc, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    return out


def brute(rows):
    own = sets(rows)
    up = {d: d for d, _ in own if d is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (d, s) in enumerate(own):
        for e, t in own[:i]:
            if d is not None and e is not None and s and t and 100 * len(s & t) >= 80 * len(s | t):
                a, b = sorted((root(d), root(e)))
                up[b] = a
    return sorted(((d, len(s), None if d is None else root(d)) for d, s in own), key=str)


def result(df, **how):
    return sorted(map(tuple, near_duplicates.groups(df, **how).collect()), key=str)


@pytest.fixture(scope="module")
def chains():
    """Chains of edits, so that components are longer than links, and passages that many documents share."""
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("aeiounrst") for _ in range(rnd.randint(2, 6)))
    passage = [word() for _ in range(40)]
    rows, n = [], 0
    for _ in range(25):
        text = [word() for _ in range(rnd.choice([6, 12, 40, 120]))]
        if rnd.random() < 0.4:
            text = passage[: rnd.randint(20, 40)] + text
        for _ in range(rnd.randint(1, 9)):
            rows.append((n, " ".join(text)))
            n += 1
            for _ in range(rnd.choice([0, 1, 1, 2])):
                text[rnd.randrange(len(text))] = word()
    rnd.shuffle(rows)
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    return rows


def test_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in df.collect()])
    assert any(d != c for d, _, c in want)
    assert result(df) == want


@pytest.mark.parametrize("how", [{}, {"block_bytes": 500, "bucket_bytes": 900}, {"block_bytes": 2000, "region_rows": 3}])
def test_chains(spark, chains, how):
    assert result(spark.createDataFrame([(*r, "x", 1) for r in chains], SCHEMA), **how) == brute(chains)


def clustered(rnd, n, words=60):
    """Sets around a few centres, with edits of every size, so that cells divide them."""
    centres = [[f"c{c}w{k}" for k in range(words)] for c in range(4)]
    rows = []
    for k in range(n):
        text = list(rnd.choice(centres))
        for _ in range(rnd.choice([0, 1, 1, 2, 3, 8, 20])):
            text[rnd.randrange(words)] = f"e{rnd.randrange(10**6)}"
        rows.append((k, "the same rare words begin every text " + " ".join(text)))
    return rows


def test_cells_in_a_task(monkeypatch):
    """Links of one region by recursion into small cells, against all pairs; labels that are given count as links."""
    monkeypatch.setattr(near_duplicates, "LEAF_ROWS", 6)
    rnd, divided = random.Random(2), 0
    for trial in range(6):
        rows = clustered(rnd, 150)
        sets_of = near_duplicates.shingle_sets([t.encode() for _, t in rows])
        region = near_duplicates.Region(np.arange(len(rows)), sets_of, 80)
        calls = []
        compare = region.compare
        region.compare = lambda some, others: (calls.append(len(some)), compare(some, others))
        region.solve()
        divided += len(calls) > 1
        got = dict(zip(*(x.tolist() for x in region.stars())))
        assert [(d, got.get(d, d)) for d, _ in rows] == [(d, c) for d, _, c in sorted(brute(rows))]
    assert divided >= 4


@pytest.mark.parametrize("rows_in_a_region", [30, 7])
def test_cells_as_tables(spark, rows_in_a_region):
    rows = clustered(random.Random(rows_in_a_region), 120)
    rows += [(1000 + k, rows[0][1] + f" x{k}") for k in range(60)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    assert result(df, region_rows=rows_in_a_region) == brute(rows)


def test_windows_keep_all_pairs():
    draw = np.random.default_rng(5)
    points = draw.random((400, 2))
    d = np.abs(points[:, None] - points[None, :]).max(axis=2)
    cells = near_duplicates.in_cells(d[:9], 0.05)
    near = d <= 0.05
    assert (np.einsum("ki,kj->ij", cells.astype(int), cells.astype(int))[near] > 0).all()
    assert cells.sum() < 9 * 400 / 2


def test_awkward_rows(spark):
    long = " ".join(f"w{k}" for k in range(30000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one TWO"), (6, "one two three"), (7, long), (8, long + " x"), (9, "É a b c d e"), (10, "é a b c d e"),
            (None, "one two"), (11, "a b c d e f g h i j k"), (11, "one two"), (12, "a b c d e f g h i j k"), (12, "a b c d e f g h i j k"), (13, "a\x0bb\x0cc d e f g h i j k"), (14, "x\xa0y")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    want = brute(rows)
    by = {d: c for d, _, c in want}
    assert by[11] == 4 and by[12] == 4 and by[13] == 4 and by[8] == 7
    assert result(df) == want
    assert result(df.limit(0)) == []
    kept = sorted(str(r.doc_id) for r in near_duplicates.keep_one(df).collect())
    assert kept == sorted(str(d) for d, _ in rows if d is None or by[d] == d)


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(1000 + k, 1001 + k) for k in range(40)] + [(5000, 6000 + k) for k in range(50)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for u, v in edges:
        a, b = sorted((root(u), root(v)))
        up[b] = a
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for x in up if any(x in e and e[0] != e[1] for e in edges)}


def test_hashes_do_not_depend_on_place():
    texts = [b"A b c d e f", b"", b"x  a B c D e f\n", b"a b"]
    s = near_duplicates.shingle_sets(texts)
    assert [len(x) for x in s] == [2, 0, 3, 1]
    assert len(np.intersect1d(s[0], s[2])) == 2
    assert near_duplicates.shingle_sets(texts[2:3])[0].tolist() == s[2].tolist()
