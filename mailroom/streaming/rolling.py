"""Rolling daily volume (A10) of a stream, at the end of every micro-batch.

``stream_rolling_volume`` keeps mergeable partial counts: one row for each
hour, and one for each instant within it. The counts of the last ``days`` x 24
hours add up whole hours after the instant ``as_of - days``, and, of the one hour
that holds this instant, the instants after it. So the result equals
``daily_volume`` over all rows received so far, at any ``as_of``, and reads only
the days of the window and one hour of instants. Both tables are partitioned by
day and batch: a replayed batch replaces its own partitions, and days that have
left the window are never read again (their files are not deleted).

``as_of`` follows the data: the newest ``received_at`` so far, which late rows do
not turn back. Rows without ``received_at`` are not counted; until a row has one,
nothing is emitted.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.dashboard import WINDOW_DAYS
from .jobs import _start, _write_batch, read_or_empty

HOURS = "hour timestamp_ntz, c bigint, day date, batch_id bigint"
INSTANTS = "hour timestamp_ntz, received_at timestamp_ntz, c bigint, day date, batch_id bigint"
EMITTED = "as_of timestamp_ntz, day date, c bigint, batch_id bigint"


def _write_days(df: DataFrame, path: str, batch_id: int) -> None:
    (df.withColumn("batch_id", F.lit(batch_id).cast("long")).write
     .option("partitionOverwriteMode", "dynamic").mode("overwrite")
     .partitionBy("day", "batch_id").parquet(path))


def add_batch(rows: DataFrame, base: str, batch_id: int) -> None:
    """Partial counts of one batch of rows with ``received_at``."""
    at = F.col("received_at").cast("timestamp_ntz")
    instants = (rows.select(at.alias("received_at")).where("received_at IS NOT NULL")
                .groupBy("received_at").agg(F.count(F.lit(1)).alias("c"))
                .select(F.date_trunc("hour", "received_at").cast("timestamp_ntz").alias("hour"), "received_at", "c",
                        F.to_date("received_at").alias("day")))
    _write_days(instants, f"{base}/instants", batch_id)
    own = read_or_empty(rows.sparkSession, f"{base}/instants", INSTANTS).where(F.col("batch_id") == batch_id)
    _write_days(own.groupBy("hour", "day").agg(F.sum("c").alias("c")).select("hour", "c", "day"), f"{base}/hours", batch_id)


def rolling_volume(spark: SparkSession, base: str, as_of: datetime, upto: int, days: int = WINDOW_DAYS) -> DataFrame:
    """(day, c) of the rows received after ``as_of - days`` in batches up to ``upto``."""
    since = as_of - timedelta(days=days)
    edge = since.replace(minute=0, second=0, microsecond=0)
    known = F.col("batch_id") <= upto
    whole = read_or_empty(spark, f"{base}/hours", HOURS).where(
        known & (F.col("day") >= F.lit(edge.date())) & (F.col("hour") > F.lit(edge).cast("timestamp_ntz")))
    part = read_or_empty(spark, f"{base}/instants", INSTANTS).where(
        known & (F.col("day") == F.lit(edge.date())) & (F.col("hour") == F.lit(edge).cast("timestamp_ntz"))
        & (F.col("received_at") > F.lit(since).cast("timestamp_ntz")))
    return whole.select("day", "c").unionByName(part.select("day", "c")).groupBy("day").agg(F.sum("c").alias("c"))


def stream_rolling_volume(stream: DataFrame, base: str, checkpoint: str, days: int = WINDOW_DAYS,
                          available_now: bool = True, interval: str | None = "60 seconds") -> StreamingQuery:
    """After each batch, (as_of, day, c) of the last ``days`` x 24 hours go to
    ``base``/emitted, by batch_id."""
    spark = stream.sparkSession

    def fn(batch: DataFrame, batch_id: int) -> None:
        add_batch(batch, base, batch_id)
        before = read_or_empty(spark, f"{base}/emitted", EMITTED).where(F.col("batch_id") < batch_id)
        own = read_or_empty(spark, f"{base}/instants", INSTANTS).where(F.col("batch_id") == batch_id)
        as_of = before.select("as_of").unionByName(own.select(F.col("received_at").alias("as_of"))).agg(F.max("as_of")).first()[0]
        if as_of is not None:
            now = rolling_volume(spark, base, as_of, batch_id, days)
            _write_batch(now.select(F.lit(as_of).cast("timestamp_ntz").alias("as_of"), "day", "c"), f"{base}/emitted", batch_id)

    return _start(stream, fn, checkpoint, available_now, interval)
