"""Dashboard aggregates over the message table (A1-A11, A15) and the recent
activity feed (J1).

At scale the message table is the big fact; every metric here is a single
pass with partial (map-side) aggregation, and ``dashboard_stats`` computes
all grouped counts in one scan with GROUPING SETS instead of one scan per
metric.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOP_INTENTS = 8          # fixed: intents shown on the dashboard
RECENT_ACTIVITY = 10     # fixed: rows in the activity feed
WINDOW_DAYS = 7          # fixed: daily volume covers the last 7 x 24 h


def _ts_literal(as_of) -> F.Column:
    if isinstance(as_of, dt.datetime):
        as_of = as_of.strftime("%Y-%m-%d %H:%M:%S")
    return F.lit(as_of).cast("timestamp_ntz")


def total_emails(emails: DataFrame) -> DataFrame:
    return emails.agg(F.count(F.lit(1)).alias("total_emails"))


def count_by(emails: DataFrame, column: str, keep_null: bool = False) -> DataFrame:
    df = emails if keep_null else emails.filter(F.col(column).isNotNull())
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("c"))


def by_status(emails: DataFrame) -> DataFrame:
    return count_by(emails, "status", keep_null=True)


def auto_send_rate(emails: DataFrame) -> DataFrame:
    agg = emails.agg(F.count(F.lit(1)).alias("total"),
                     F.count_if(F.col("auto_sent") == 1).alias("auto_sent"))
    rate = F.round(F.col("auto_sent").cast("double") / F.greatest(F.col("total"), F.lit(1)) * 100.0, 1)
    return agg.select("auto_sent", rate.alias("auto_send_rate"))


def by_intent_top(emails: DataFrame, n: int = TOP_INTENTS) -> DataFrame:
    return (count_by(emails, "intent")
            .orderBy(F.col("c").desc(), F.col("intent").asc())
            .limit(n))


def pending_count(emails: DataFrame) -> DataFrame:
    return emails.agg(F.count_if(F.col("status") == "pending_approval").alias("pending_approval"))


def avg_confidence(emails: DataFrame) -> DataFrame:
    a = F.avg(F.when(F.col("confidence_score") > 0, F.col("confidence_score")))
    return emails.agg(F.round(F.coalesce(a, F.lit(0.0)) * 100.0, 1).alias("avg_confidence"))


def recent_window(emails: DataFrame, as_of, days: int = WINDOW_DAYS) -> DataFrame:
    """Messages received strictly after ``as_of - days`` (a rolling instant)."""
    since = _ts_literal(as_of) - F.expr(f"INTERVAL {int(days)} DAYS")
    return emails.filter(F.col("received_at") > since)


def daily_volume(emails: DataFrame, as_of, days: int = WINDOW_DAYS) -> DataFrame:
    return (recent_window(emails, as_of, days)
            .groupBy(F.to_date("received_at").alias("day"))
            .agg(F.count(F.lit(1)).alias("c")))


def kb_doc_count(kb: DataFrame) -> DataFrame:
    return kb.agg(F.count_distinct("name").alias("kb_documents"))


def recent_activity(activity: DataFrame, emails: DataFrame, n: int = RECENT_ACTIVITY) -> DataFrame:
    """Newest ``n`` activity rows with the message's subject and sender.

    The limit is taken before the join: the message side is unique by id, so
    a left join cannot add or drop activity rows. The at most ``n`` ids are
    broadcast to the messages (a left join cannot build on its left side, a
    semi join can), so the message table is read and filtered where it lies.
    """
    top = activity.orderBy(F.col("created_at").desc(), F.col("id").asc()).limit(n)
    ids = top.select(F.col("email_id").alias("_mid")).distinct()
    msg = emails.select(F.col("id").alias("_mid"), "subject", "sender_email").join(F.broadcast(ids), "_mid", "left_semi")
    return top.join(F.broadcast(msg), top["email_id"] == msg["_mid"], "left").drop("_mid")


def dashboard_stats(emails: DataFrame, kb: DataFrame, as_of) -> DataFrame:
    """Every dashboard number as tidy rows ``(metric, key, value)``.

    One scan of the message table: GROUPING SETS over status, department,
    intent, sentiment, urgency, the day (NULL outside the 7-day window) and
    the grand total, with all counters as conditional aggregates. Each
    grouped row is exploded into its metric rows in one projection (no
    per-metric filter, which Catalyst would push below the aggregate and so
    plan one scan per metric); a window over the few grouped rows keeps the
    top intents. The KB count is the only other (small) scan.
    """
    since = _ts_literal(as_of) - F.expr(f"INTERVAL {WINDOW_DAYS} DAYS")
    dims = ["status", "department", "intent", "sentiment", "urgency", "_day"]
    e = (emails.select("status", "department", "intent", "sentiment", "urgency", "auto_sent",
                       F.when(F.col("confidence_score") > 0, F.col("confidence_score")).alias("_ok"),
                       F.when(F.col("received_at") > since, F.to_date("received_at").cast("string")).alias("_day")))
    grouped = (e.groupingSets([[d] for d in dims] + [[]], *dims)
               .agg(F.grouping_id().alias("gid"),
                    F.count(F.lit(1)).alias("n"),
                    F.count_if(F.col("auto_sent") == 1).alias("n_auto"),
                    F.count_if(F.col("status") == "pending_approval").alias("n_pending"),
                    F.avg("_ok").alias("avg_ok")))
    # grouping_id: one bit per dimension, the first dimension most significant
    full = (1 << len(dims)) - 1
    gid_of = {d: full ^ (1 << (len(dims) - 1 - i)) for i, d in enumerate(dims)}
    names = {"status": "by_status", "department": "by_department", "intent": "by_intent",
             "sentiment": "by_sentiment", "urgency": "by_urgency", "_day": "daily_volume"}
    gid = F.col("gid")
    metric, key = F.lit(None).cast("string"), F.lit(None).cast("string")
    for d in dims:
        metric = F.when(gid == gid_of[d], F.lit(names[d])).otherwise(metric)
        key = F.when(gid == gid_of[d], F.col(d)).otherwise(key)

    def row(m, k, v):
        return F.struct(m.alias("metric"), k.alias("key"), v.cast("double").alias("value"))

    none = F.lit(None).cast("string")
    scalars = F.array(
        row(F.lit("total_emails"), none, F.col("n")),
        row(F.lit("auto_sent"), none, F.col("n_auto")),
        row(F.lit("auto_send_rate"), none,
            F.round(F.col("n_auto").cast("double") / F.greatest(F.col("n"), F.lit(1)) * 100.0, 1)),
        row(F.lit("pending_approval"), none, F.col("n_pending")),
        row(F.lit("avg_confidence"), none, F.round(F.coalesce(F.col("avg_ok"), F.lit(0.0)) * 100.0, 1)))
    rows = (grouped.select("gid", F.explode(F.when(gid == full, scalars)
                                            .otherwise(F.array(row(metric, key, F.col("n"))))).alias("r"))
            .select("gid", "r.*")
            .filter((gid == full) | (gid == gid_of["status"]) | F.col("key").isNotNull()))
    w = Window.partitionBy("gid").orderBy(F.col("value").desc(), F.col("key").asc())
    rows = (rows.withColumn("_rn", F.row_number().over(w))
            .filter((gid != gid_of["intent"]) | (F.col("_rn") <= TOP_INTENTS))
            .select("metric", "key", "value"))
    kbc = kb_doc_count(kb).select(F.lit("kb_documents").alias("metric"),
                                  F.lit(None).cast("string").alias("key"),
                                  F.col("kb_documents").cast("double").alias("value"))
    return rows.unionByName(kbc)


def status_filters(emails: DataFrame) -> DataFrame:
    """The dashboard's row predicates, each counted once in one pass:
    auto-sent, pending approval, scored (confidence > 0), and the non-null
    class columns."""
    return emails.agg(
        F.count_if(F.col("auto_sent") == 1).alias("auto_sent"),
        F.count_if(F.col("status") == "pending_approval").alias("pending_approval"),
        F.count_if(F.col("confidence_score") > 0).alias("scored"),
        *[F.count(c).alias(f"with_{c}") for c in ("department", "intent", "sentiment", "urgency")])
