"""Every registered query: SQL's rows where there is SQL, else rows whose own check holds."""

import pytest
from compare import differences

from millrace.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_equals_sql(spark, name):
    assert differences(registry.QUERIES[name](spark, SF), SF, registry.ORACLE[name]) == []


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(spark, name):
    rows = registry.QUERIES[name](spark, SF).collect()
    assert rows
    assert not any(r.bad for r in rows if "bad" in r)
    if "ok" in rows[0]:
        assert all(r.ok for r in rows)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["stream", "slot", "sym", "freq", "cum"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_blocks_hold_every_pixel(spark):
    """No edge is cut: as many blocks and tiles as cover all events."""
    n = spark.read.parquet(f"{SF}/events.parquet").count()
    lines = -(-n // 64)
    assert registry.QUERIES["compress_dxt"](spark, SF).count() == -(-lines // 4) * 16
    assert registry.QUERIES["wavelet2d_tile"](spark, SF).count() == -(-lines // 8) * 8 * 64
    assert registry.QUERIES["dct8_rows"](spark, SF).count() == lines * 64
    assert registry.QUERIES["knn_radius"](spark, SF).count() > 0
