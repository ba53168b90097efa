"""Small helpers of the operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare, scratch_path

# Copies of the small side of a join whose other side may have one hot key.
SALTS = 16

# Keys that hold more than one in HOT of all counted rows: fewer than HOT of them exist.
HOT = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Rows that Python workers get at a time: texts are long, memory is not.
ARROW_ROWS = 1000


def ready(spark: SparkSession) -> None:
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends
    there, and a lost executor costs nothing that was written."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def salt_of(*cols: str, salts: int = SALTS):
    """Salt of a row, from columns that tell rows of one key apart."""
    return F.pmod(F.xxhash64(*cols), F.lit(salts)).cast("int")


def salted(df: DataFrame, salts: int = SALTS, name: str = "_salt") -> DataFrame:
    """Each row once for every salt: for the side with one row for each key."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def meet(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` joined to ``groups``, a stored table with one row for each key
    and ``n``, the number of rows that have it (dropped). Keys with over 1/HOT of
    the sum of n are fewer than HOT, whatever the input, so they are broadcast and
    their rows stay where they are; no key that is shuffled has more than 1/HOT."""
    total = groups.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") > F.lit(total / HOT)
    few = groups.where(hot).drop("n")
    cold = rows.join(F.broadcast(few.select(keys)), keys, "left_anti").join(groups.where(~hot).drop("n"), keys)
    return rows.join(F.broadcast(few), keys).unionByName(cold)


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of consecutive rows with equal keys, across batch borders, from
    a partition sorted by the keys. One group is held at a time."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for b in batches:
        if b.num_rows == 0:
            continue
        cols = [b.column(k).to_pylist() for k in keys]
        start = 0
        for i, key in enumerate(zip(*cols, strict=True)):
            if key != last:
                if i > start:
                    held.append(b.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], i, key
        held.append(b.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def batched(rows: Iterable[tuple], schema: pa.Schema, size: int = 4096, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``size`` rows, and fewer once their strings
    and bytes reach ``most``."""
    buf: list[tuple] = []
    weight = 0
    for r in rows:
        buf.append(r)
        weight += sum(len(v) for v in r if isinstance(v, (str, bytes)))
        if len(buf) >= size or weight >= most:
            yield _batch(buf, schema)
            buf, weight = [], 0
    if buf:
        yield _batch(buf, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)
