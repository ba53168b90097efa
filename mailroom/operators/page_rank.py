"""A page of the message list by rank, without sorting what comes before it (L1).

``list_page`` sorts with an offset: each task keeps page x limit rows. Here the
page's borders are located by counting. Rows are counted in at most ``BUCKETS``
equal ranges of ``received_at``, the range that holds the wanted rank is counted
again in finer ranges, and so on until it has ``ENOUGH`` rows or fewer. If a single
instant still has more (a bulk import), its ids are counted by their next
character in the same way. The counts read only the filters' columns, the time and
(for such an instant) the id; each is at most ``BUCKETS`` rows, or one for each
character in use. The page is then sorted from the ranges of its first and last row
and what lies between: at most 2 x ENOUGH + limit rows, whatever the page.

Defined cases: rows without a time come last (as in ``list_page``), ordered by id;
a page beyond the end is empty; rows equal in time and id are in any order among
themselves, and more than ENOUGH of them are sorted together.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .listing import PAGE_SIZE, list_filter

BUCKETS = 1024
ENOUGH = 100_000

_MICROS = "unix_micros(CAST(received_at AS TIMESTAMP))"


@dataclass
class _Place:
    """The range that holds a rank: times (microseconds, newest first; None: no
    time), the ids' prefix if one time was not enough, and the rows before it."""

    newest: int | None
    oldest: int | None
    before: int
    prefix: str = ""


def _pick(counts: list, rank: int):
    """The row of ``counts`` (key, n; in order) that holds ``rank``, and the rows before it."""
    before = 0
    for r in counts:
        if rank < before + r.n:
            return r, before
        before += r.n
    raise AssertionError("a rank beyond the rows counted: the table changed meanwhile")


def _time(micros: int | None):
    return F.timestamp_micros(F.lit(micros)).cast("timestamp_ntz")


def _within(df: DataFrame, place: _Place) -> DataFrame:
    """Rows of a place's times: bounds on the column itself, for the scan."""
    if place.newest is None:
        return df.where("received_at is null")
    return df.where((F.col("received_at") <= _time(place.newest)) & (F.col("received_at") >= _time(place.oldest)))


def _bounds(df: DataFrame):
    """Rows with a time, the oldest and the newest time, all rows."""
    times = F.expr(_MICROS)
    return df.agg(F.count("received_at"), F.min(times), F.max(times), F.count("*")).first()


def _locate(df: DataFrame, rank: int, bounds, enough: int) -> _Place:
    timed, low, high, n = bounds
    at = _Place(high, low, 0) if rank < timed else _Place(None, None, timed)
    size = timed if rank < timed else n - timed
    while size > enough and at.newest is not None and at.newest > at.oldest:
        width = (at.newest - at.oldest) // BUCKETS + 1
        newest = at.newest
        part = F.expr(f"({newest}L - {_MICROS}) DIV {width}L").alias("k")
        counts = _within(df, at).groupBy(part).agg(F.count("*").alias("n")).orderBy("k").collect()
        r, before = _pick(counts, rank - at.before)
        at = _Place(newest - r.k * width, max(at.oldest, newest - (r.k + 1) * width + 1), at.before + before)
        size = r.n
    while size > enough:
        k = len(at.prefix)
        ids = _within(df, at).where(F.substring("id", 1, k) == at.prefix if k else F.lit(True))
        counts = ids.groupBy(F.substring("id", k + 1, 1).alias("k")).agg(F.count("*").alias("n")).orderBy(F.col("k").asc_nulls_first()).collect()
        r, before = _pick(counts, rank - at.before)
        if not r.k:  # ids that end here, or have none: they are all equal
            break
        at = _Place(at.newest, at.oldest, at.before + before, at.prefix + r.k)
        size = r.n
    return at


def _from(place: _Place):
    """Rows of a place or after it."""
    ids = F.substring("id", 1, len(place.prefix)) >= place.prefix
    if place.newest is None:
        return F.col("received_at").isNull() & (ids if place.prefix else F.lit(True))
    if not place.prefix:
        return (F.col("received_at") <= _time(place.newest)) | F.col("received_at").isNull()
    t = _time(place.newest)
    return (F.col("received_at") < t) | ((F.col("received_at") == t) & ids) | F.col("received_at").isNull()


def _to(place: _Place):
    """Rows of a place or before it."""
    ids = F.col("id").isNull() | (F.substring("id", 1, len(place.prefix)) <= place.prefix)
    if place.newest is None:
        return F.col("received_at").isNotNull() | (ids if place.prefix else F.lit(True))
    if not place.prefix:
        return F.col("received_at") >= _time(place.oldest)
    t = _time(place.oldest)
    return (F.col("received_at") > t) | ((F.col("received_at") == t) & ids)


def list_page_ranked(emails: DataFrame, page: int = 1, limit: int = PAGE_SIZE, enough: int = ENOUGH, **filters) -> DataFrame:
    """The rows of ``list_page``, whatever the page, from the ranges of that page.
    Planning runs the counting jobs; the result is a plan over ``emails``."""
    df = list_filter(emails, **filters)
    bounds = _bounds(df)
    n = bounds[3]
    offset = (max(int(page), 1) - 1) * limit
    if offset >= n or limit < 1:
        return df.limit(0)
    first = _locate(df, offset, bounds, enough)
    last = _locate(df, min(offset + limit, n) - 1, bounds, enough)
    rows = df.where(_from(first) & _to(last))
    if first.newest is not None and last.newest is not None:  # plain bounds too, which a scan can use
        rows = rows.where((F.col("received_at") <= _time(first.newest)) & (F.col("received_at") >= _time(last.oldest)))
    return (rows.orderBy(F.col("received_at").desc(), F.col("id").asc())
            .offset(offset - first.before).limit(limit))
