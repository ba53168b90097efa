"""Partition counts from the size of what a plan reads."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

# Input bytes (as the scans report them) for one partition of a fan-out.
FANOUT_BYTES = 32 << 20
# The same for a step that sorts or aggregates the words of texts: a task holds
# many times the bytes that a scan reports.
TERM_BYTES = 8 << 20


def input_bytes(df: DataFrame) -> int:
    """Bytes that the scans of a plan read, from their statistics: no job runs.
    Leaves without statistics (rows of a micro-batch) report the largest number
    there is and count as nothing; a cached table counts as what it was made
    from, since its own size is a guess until it is filled."""
    return _scanned(df._jdf.queryExecution().optimizedPlan())


def _scanned(plan) -> int:
    leaves, total = plan.collectLeaves(), 0
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "InMemoryRelation":
            total += _scanned(leaf.cacheBuilder().logicalPlan())
        else:
            size = int(str(leaf.stats().sizeInBytes()))
            total += size if size < 1 << 60 else 0
    return total


def fanout_partitions(df: DataFrame, each: int = FANOUT_BYTES) -> int:
    """Partition count for a step whose output is many times its input (terms
    of texts, scoring). AQE sizes partitions by input bytes and would merge
    them, so the count is explicit. It grows with the input; small inputs get
    two tasks for each core."""
    floor = 2 * df.sparkSession.sparkContext.defaultParallelism
    return max(floor, math.ceil(input_bytes(df) / each))
