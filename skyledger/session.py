"""Session settings and the shared scratch folder.

Every operator is a plain ``DataFrame -> DataFrame`` function, so the session
only has to fix semantics (UTC) and switch on adaptive execution, which sizes
partitions, turns small measured sides into broadcasts and splits skewed joins.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.parquet.aggregatePushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on to a session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(app_name: str = "skyledger", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Create a session; leave ``master`` unset on a cluster."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = (
            builder.master(master)
            .config("spark.driver.memory", "8g")
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
        )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return configure(builder.getOrCreate())


@contextmanager
def short_methods(spark: SparkSession):
    """While it lasts, generated code that makes methods of over 8,000 bytes, which JVMs only interpret, gives way to shorter methods."""
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    spark.conf.set(key, "8000")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def is_local(master: str) -> bool:
    """Whether driver and executors are one process (``local-cluster`` is not)."""
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir`` of the session.

    Only a local session may go without one: it gets a temporary folder. Elsewhere such a folder would
    be another one on each machine, so a cluster that names none is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm_dir.isDefined():
            return jvm_dir.get()
        master = spark.sparkContext.master
        if not is_local(master):
            raise ValueError(f"spark.checkpoint.dir names no folder that all executors of {master} share")
        named = tempfile.mkdtemp(prefix="skyledger-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table or stream checkpoint in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df, name: str = "step"):
    """Write a frame to the shared folder and read it back.

    Cuts the lineage of iterative work; unlike executor-local storage the copy
    survives lost executors.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)
