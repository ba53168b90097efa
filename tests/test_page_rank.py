"""Pages by rank equal the sorted list, and read only their own ranges."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from mailroom.operators import listing as L
from mailroom.operators import page_rank as R
from mailroom.session import scratch_path

T0 = dt.datetime(2024, 5, 1)


def rows_of(rng, n):
    """A bulk import at one instant, scattered times, ties, rows without a time or an id."""
    rows = [(f"bulk-{k:04d}", T0, "sent") for k in range(n // 3)]
    rows += [(f"m{rng.randint(0, 10 ** 6)}", T0 + dt.timedelta(microseconds=rng.randint(-10 ** 13, 10 ** 13)), rng.choice(("sent", "new"))) for _ in range(n)]
    rows += [(f"n{k}", None, "sent") for k in range(n // 8)] + [(None, T0, "sent"), (None, None, "new"), ("", T0, "sent")]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def emails(spark):
    path = scratch_path(spark, "ranked")
    spark.createDataFrame(rows_of(random.Random(4), 300), "id string, received_at timestamp_ntz, status string").write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("enough", [1, 7, R.ENOUGH])
def test_every_kind_of_page_equals_the_sorted_list(emails, enough):
    for filters in ({}, {"status": "sent"}):
        whole = [tuple(r) for r in L.list_filter(emails, **filters).orderBy(F.col("received_at").desc(), F.col("id").asc()).collect()]
        pages = -(-len(whole) // 40)
        for page in {1, pages // 2, pages - 1, pages} if enough > 1 else {pages // 2, pages}:
            got = [tuple(r) for r in R.list_page_ranked(emails, page=page, limit=40, enough=enough, **filters).collect()]
            assert got == whole[(page - 1) * 40:page * 40]
        assert R.list_page_ranked(emails, page=pages + 1, limit=40, enough=enough, **filters).count() == 0


def test_a_page_reads_its_own_range(spark, emails):
    df = R.list_page_ranked(emails, page=3, limit=10, enough=20)
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    p = df._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "LessThanOrEqual(received_at" in p and "GreaterThanOrEqual(received_at" in p
    first = R._locate(emails, 20, R._bounds(emails), 20)
    assert first.before <= 20 < first.before + 20 + 1
    assert emails.where(R._from(first)).count() == emails.count() - first.before


def test_pages_of_nothing(emails):
    assert R.list_page_ranked(emails.limit(0)).count() == 0
    assert R.list_page_ranked(emails.where("received_at is null"), page=1, limit=5, enough=2).count() == 5
