"""The pipeline's stages against brute force, each on what its predecessor kept."""

import re

import corpus_pipeline as pipeline
import pytest
from pyspark.sql import functions as F
from test_near_duplicates import brute as brute_groups
from test_text_ops import brute_spans, check_packing

from millrace.llm import mixing, near_duplicates, quality, secrets
from millrace.session import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = table(spark, SF, "documents"), []
    for _, stage in pipeline.STAGES:
        after = stage(spark, docs, SF)
        out.append((docs.collect(), after.collect(), after.columns))
        docs = spark.createDataFrame(out[-1][1], after.schema)
    return out


def test_stage_names():
    assert [n for n, _ in pipeline.STAGES] == ["quality_filter", "near_duplicate_groups", "secret_scan", "source_mix", "best_fit_packing"]


def test_columns_stay(spark, steps):
    assert all(c == table(spark, SF, "documents").columns for _, _, c in steps[:-1])


def test_quality_stage(spark, steps):
    before, after, _ = steps[0]
    scores = {r.doc_id: r.predicted for r in quality.score(table(spark, SF, "documents"), table(spark, SF, "labels")).collect()}
    assert sorted(after) == sorted(r for r in before if scores[r.doc_id])
    assert 0 < len(after) < len(before)


def test_near_duplicate_stage(steps):
    before, after, _ = steps[1]
    keep = {d for d, _, c in brute_groups([(r.doc_id, r.text) for r in before]) if d == c}
    assert sorted(after) == sorted(r for r in before if r.doc_id in keep) and len(after) < len(before)


def test_secret_stage(steps):
    before, after, _ = steps[2]
    old = {r.doc_id: r for r in before}
    assert len(after) == len(before)
    for r in after:
        assert not brute_spans(r.text)
        assert r.text == secrets.redacted(old[r.doc_id].text) and (r.n_chars == old[r.doc_id].n_chars or r.n_chars == len(r.text))


def test_mix_stage(steps):
    before, after, _ = steps[3]
    words = lambda rows: {s: sum(len(re.findall(r"[^\x20\x09-\x0d]+", r.text)) for r in rows if r.source == s) for s in {x.source for x in before}}
    size, taken = words(before), words(after)
    assert all(taken[s] <= 2 * size[s] for s in size)
    assert abs(sum(taken.values()) / sum(size.values()) - 1.5) < 0.15
    times = {}
    for r in after:
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert set(times.values()) <= {1, 2} and {r for r in after} <= {r for r in before}


def test_packing_stage(steps):
    before, after, _ = steps[4]
    used, bound = check_packing(after, [(r.doc_id, r.text) for r in before])
    assert used <= 1.02 * bound + 1


def test_run(spark, steps):
    got = pipeline.run(spark, SF)
    assert sorted(got.columns) == sorted(steps[4][2])
    assert sum(r.length for r in got.collect()) == sum(r.length for r in steps[4][1])


def test_stages_survive_awkward_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "word " * 9000, "en", None, 45000), (3, "password=abcdefghi", "en", "a", 18)]
    docs = spark.createDataFrame(rows, table(spark, SF, "documents").schema)
    for frame, n in ((docs, 5), (docs.limit(0), 0)):
        given = [tuple(r) for r in frame.collect()]
        got = {name: stage(spark, frame, SF).collect() for name, stage in pipeline.STAGES}
        assert len(got["near_duplicate_groups"]) == len(got["secret_scan"]) == n
        assert {tuple(r) for name in ("quality_filter", "near_duplicate_groups", "source_mix") for r in got[name]} <= set(given)
        assert all(got["source_mix"].count(r) <= 2 * given.count(tuple(r)) for r in got["source_mix"])
        assert {r.text for r in got["secret_scan"]} == ({None, "", "word " * 9000, "[REDACTED]"} if n else set())
        assert {r.doc_id for r in got["best_fit_packing"]} == {r[0] for r in given}
        assert all(r.offset + r.length <= 1024 for r in got["best_fit_packing"])
    assert near_duplicates.keep_one(docs).count() == 5 and secrets.redact(docs).count() == 5
    assert mixing.resample(docs).where(F.col("source") == "a").count() >= 1
