"""Helpers of the operators."""

import pytest

from weftlink.llm import common


@pytest.mark.parametrize(("hot", "most"), [(3, 200_000), (1, 5), (1000, 200_000)])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_join(spark, monkeypatch, hot, most, how):
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    monkeypatch.setattr(common, "BROADCAST_ROWS", most)
    rows = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i % 7}") for i in range(60)] + [(100, "none"), (101, None)], "i int, k string")
    side = rows.filter("k IS NOT NULL AND k <> 'none'").groupBy("k").count().withColumnRenamed("count", "n")
    got = common.hot_join(rows, side, ["k"], "n", how)
    want = rows.join(side, "k", how)
    plain = lambda df: sorted(map(str, (tuple(r[c] for c in ("i", "k", "n")) for r in df.collect())))
    assert plain(got) == plain(want)
    assert common.hot_join(rows.limit(0), side.limit(0), ["k"], "n", how).count() == 0


@pytest.mark.parametrize(("setting", "size"), [("64MB", 64 << 20), ("8388608", 8 << 20), ("2g", 2 << 30), ("10k", 10 << 10), ("5b", 5), ("-1", 1 << 62)])
def test_sizes(setting, size):
    assert common.bytes_of(setting) == size


def test_limit_with_a_unit_is_lowered(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    for setting, want in (("64MB", str(common.BATCH_BYTES)), ("1MB", "1MB")):
        spark.conf.set(key, setting)
        common.small_batches(spark.range(1))
        assert spark.conf.get(key) == want
    spark.conf.set(key, before)
