"""Held-out accuracy of the quality rules, their compiled form, and awkward rows."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import quality, queries

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in queries.op4_quality_rules(spark, SF).collect()}
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for d, r in rows.items())
    labels = [r for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if rows[r.doc_id].held_out]
    right = np.mean([rows[r.doc_id].predicted == r.quality for r in labels])
    good = np.mean([r.quality for r in labels])
    assert right > 0.9 and 1 - right < (1 - max(good, 1 - good)) / 4  # a quarter of the errors of the constant answer
    scores = np.array([rows[r.doc_id].score for r in labels])
    kind = np.array([r.quality for r in labels]) == 1
    assert (scores[kind][:, None] > scores[~kind][None, :]).mean() > 0.95


def test_compiled_column_equals_the_model(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    stats = quality.statistics(docs["text"])
    wide = docs.select(*(stats[c].cast("double").alias(c) for c in quality.NAMES))
    got = wide.select(*quality.NAMES, model.column({c: F.col(c) for c in quality.NAMES}).alias("p")).toPandas()
    assert model.rules and np.allclose(got["p"], model.predict(got[list(quality.NAMES)].to_numpy()))


def test_awkward_rows(spark):
    rows = [(None, None, "x", 1), (1, None, "x", 1), (2, "", "x", 1), (3, " \n ", "x", 1), (3, " \n ", "x", 1), (4, "word " * 50000, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, _id long")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (4, 0), (4, 1)], "doc_id long, quality int")
    for known in (labels, labels.limit(0)):
        got = quality.score(docs, known).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
        assert [r.held_out for r in got if r.doc_id is None] == [False]
    assert quality.score(docs.limit(0), labels).count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_separable_statistics():
    draw = np.random.default_rng(1)
    x = draw.random((2000, len(quality.NAMES)))
    y = ((x[:, 1] > 0.4) & (x[:, 3] <= 0.7)).astype(float)
    model = quality.fit(x, y)
    assert np.mean((model.predict(x) >= 0.5) == y) > 0.97
    assert len(model.rules) < 200
