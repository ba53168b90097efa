"""Spark session settings and scratch locations.

Everything here is ordinary session configuration. Library functions call
``prepare(spark)`` so a query behaves the same whatever session it is given:
UTC wall-clock timestamps and a shared, reliable checkpoint folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Session settings every job relies on (values chosen for this engine).
SQL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # JSON objects with a repeated key keep the last value, like Python's json.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "mailroom", extra: dict | None = None) -> SparkSession:
    """Session for tests, tools and the bench. On a cluster, use the
    cluster's own session and call ``prepare`` instead."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(SQL_CONF)
    conf.update({
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": os.environ.get("MAILROOM_DRIVER_MEMORY", "16g"),
        "spark.sql.shuffle.partitions": str(shuffle_partitions or 8),
    })
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers (the MIME parser,
    the top-k kernel and the decode UDF run there): zip the package on the
    driver and hand it to Spark, which distributes it like ``--py-files``.
    Once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    zpath = os.path.join(tempfile.mkdtemp(prefix="mailroom-py-"), "mailroom.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    _SHIPPED.add(sc.applicationId)


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings the operators depend on. A cluster's own
    choice about adaptive execution stays as it is."""
    for k, v in SQL_CONF.items():
        if k.startswith("spark.sql.adaptive.") and spark.conf.get(k, None) is not None:
            continue
        spark.conf.set(k, v)
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    Reads ``spark.checkpoint.dir`` (or the context's directory). Where neither is
    set a folder is made here, but on a local master only: on a cluster every
    executor would write to a disk of its own, so that is an error.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if not d:
        d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not d:
            d = private_folder(sc.master)
        sc.setCheckpointDir(d)
        d = sc.getCheckpointDir() or d
    return d


def private_folder(master: str) -> str:
    """A new folder of this machine, for a session that runs nowhere else."""
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="mailroom-ckpt-")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder (for stream
    sources, stream checkpoints and written intermediate tables)."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/mailroom-{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df``, written to the shared checkpoint folder and read back: steps after
    it do not repeat it, and a lost executor loses nothing of it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
