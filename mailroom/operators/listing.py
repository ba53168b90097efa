"""Message list, search, paging and detail (P1-P3, L1, L2, A13, J2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import sql_like_literal

PAGE_SIZE = 20  # fixed default page size


def list_filter(emails: DataFrame, status: str | None = None, department: str | None = None,
                urgency: str | None = None, search: str | None = None) -> DataFrame:
    """Conjunction of the set filters; an empty or missing value is no filter.
    Equality filters reach the Parquet scan as pushed filters."""
    df = emails
    for column, value in (("status", status), ("department", department), ("urgency", urgency)):
        if value:
            df = df.filter(F.col(column) == F.lit(value))
    if search:
        pat = sql_like_literal(search)
        df = df.filter(F.col("subject").ilike(pat) | F.col("sender_email").ilike(pat)
                       | F.col("sender_name").ilike(pat))
    return df


def list_page(emails: DataFrame, page: int = 1, limit: int = PAGE_SIZE, **filters) -> DataFrame:
    """One page, newest first (ties by id). A top-(page*limit) sort: each
    task keeps only that many rows before the single final merge."""
    page = max(int(page), 1)
    df = list_filter(emails, **filters)
    return (df.orderBy(F.col("received_at").desc(), F.col("id").asc())
            .offset((page - 1) * limit).limit(limit))


def list_page_after(emails: DataFrame, after_received_at, after_id: str,
                    limit: int = PAGE_SIZE, **filters) -> DataFrame:
    """Keyset form for deep pages: rows strictly after the last row shown."""
    df = list_filter(emails, **filters)
    ts = F.lit(after_received_at).cast("timestamp_ntz")
    after = (F.col("received_at") < ts) | ((F.col("received_at") == ts) & (F.col("id") > after_id))
    return df.filter(after).orderBy(F.col("received_at").desc(), F.col("id").asc()).limit(limit)


def list_total_pages(emails: DataFrame, limit: int = PAGE_SIZE, **filters) -> DataFrame:
    total = F.count(F.lit(1))
    return list_filter(emails, **filters).agg(
        total.alias("total"),
        ((total + F.lit(limit - 1)) / F.lit(limit)).cast("bigint").alias("pages"))


def point_lookup(emails: DataFrame, email_id: str) -> DataFrame:
    return emails.filter(F.col("id") == F.lit(email_id))


def email_detail(emails: DataFrame, activity: DataFrame) -> DataFrame:
    """Every message with its activity rows (flat), a message's rows together
    and in order of time inside each partition. A plain equi-join: a message
    with very many activity rows is split by AQE's skew handling, never gathered
    into one row, and no global sort follows."""
    a = activity.select(F.col("email_id").alias("_eid"), F.col("id").alias("act_id"),
                        F.col("action").alias("act_action"), F.col("actor").alias("act_actor"),
                        F.col("details").alias("act_details"),
                        F.col("created_at").cast("timestamp_ntz").alias("act_created_at"))
    m = emails.select("id", "subject", "sender_email", "status")
    return (m.join(a, m["id"] == a["_eid"], "left").drop("_eid")
            .sortWithinPartitions("id", "act_created_at", "act_id"))


def activity_sorted(activity: DataFrame, email_id: str) -> DataFrame:
    return (activity.filter(F.col("email_id") == F.lit(email_id))
            .orderBy(F.col("created_at").asc(), F.col("id").asc()))
