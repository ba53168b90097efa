"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import stored


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, component): the smallest node that ``edges`` (a, b: long, not
    null) connect it to. Nodes without an edge are not returned.

    Each round replaces every edge by a link from its larger end to the
    smallest neighbour seen from either end (large star, then small star), so
    paths shorten geometrically. A hot node's links are combined before the
    shuffle (``min`` is a partial aggregate) and joined back under AQE's skew
    handling; no neighbourhood is ever collected. Each round's edges are
    written to the shared folder. Raises if ``rounds`` do not suffice.
    """
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    print_of = lambda d: d.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
    before = print_of(e)
    for _ in range(rounds):
        large = _star(e.union(e.select("v", "u")), large=True)
        e = stored(_star(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), large=False), "cc")
        if (now := print_of(e)) == before:
            break
        before = now
    else:
        raise RuntimeError(f"components: not settled after {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select("v", "v").distinct())


def _star(e: DataFrame, large: bool) -> DataFrame:
    """Large star: every neighbour above u points to the smallest of u's
    neighbours and u. Small star: every neighbour of u, and u, point there."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    j = e.join(least, "u")
    if large:
        m = F.least("m", "u")
        out = j.where("v > u").select(F.col("v").alias("u"), m.alias("v"))
    else:
        out = j.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()
