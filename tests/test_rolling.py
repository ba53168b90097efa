"""Rolling volume of a stream equals the batch operator after every batch."""

from datetime import datetime, timedelta

import pytest

from mailroom.operators.dashboard import daily_volume
from mailroom.session import scratch_path
from mailroom.streaming import jobs as J
from mailroom.streaming import rolling as R

NOON = datetime(2024, 3, 10, 12, 30)
HOUR = timedelta(hours=1)
# in order of arrival: late rows, ties, an instant just inside and one just outside the window
BATCHES = [
    [NOON, NOON, None, NOON - timedelta(days=2)],
    [NOON - timedelta(days=7), NOON - timedelta(days=7) + timedelta(microseconds=1), NOON - timedelta(days=7) - HOUR, NOON - 3 * HOUR],
    [NOON + timedelta(days=3, minutes=7), NOON - timedelta(days=5), NOON - timedelta(days=4) + timedelta(minutes=7)],
    [None],
    [NOON - timedelta(days=1), NOON + timedelta(days=3, minutes=7) - timedelta(days=7) + timedelta(seconds=1)],
]


def rows(spark, instants):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(instants)], "id string, received_at timestamp_ntz")


def counts(df):
    return sorted((r["day"], r["c"]) for r in df.collect())


def test_every_boundary_and_replays(spark):
    base = scratch_path(spark, "t-rolling-add")
    seen = []
    for k, batch in enumerate(BATCHES):
        R.add_batch(rows(spark, batch), base, k)
        R.add_batch(rows(spark, batch), base, k)  # a replay replaces its own counts
        seen += batch
        for as_of in (max(t for t in seen if t), NOON + timedelta(days=1), NOON + timedelta(minutes=30)):
            assert counts(R.rolling_volume(spark, base, as_of, k)) == counts(daily_volume(rows(spark, seen), as_of))
    assert counts(R.rolling_volume(spark, base, NOON, 0)) == counts(daily_volume(rows(spark, BATCHES[0]), NOON))


def test_stream_emits_after_each_batch_and_restarts(spark):
    base, src = scratch_path(spark, "t-rolling"), scratch_path(spark, "t-rolling-src")
    seen, schema = [], rows(spark, [None]).schema
    for k, batch in enumerate(BATCHES):
        rows(spark, batch).coalesce(1).write.mode("append").parquet(src)
        query = R.stream_rolling_volume(J.file_stream(spark, src, schema), base, f"{base}/ckpt")
        query.awaitTermination()
        seen += batch
        got = spark.read.schema(R.EMITTED).parquet(f"{base}/emitted").where(f"batch_id = {k}")
        as_of = max(t for t in seen if t)
        assert {r["as_of"] for r in got.collect()} == {as_of}
        assert counts(got) == counts(daily_volume(rows(spark, seen), as_of))


def test_only_the_window_is_read(spark):
    base = scratch_path(spark, "t-rolling-plan")
    R.add_batch(rows(spark, [NOON - timedelta(days=d) for d in range(30)]), base, 0)
    plan = R.rolling_volume(spark, base, NOON, 0)._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "2024-03-03" in plan


@pytest.mark.parametrize("batch", [[], [None, None]])
def test_nothing_to_count(spark, batch):
    base = scratch_path(spark, "t-rolling-none")
    R.add_batch(rows(spark, batch), base, 0)
    assert R.rolling_volume(spark, base, NOON, 0).count() == 0
