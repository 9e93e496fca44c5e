"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SCRATCH_CONF = "corpusmill.scratch.dir"
_CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: str = "*", app: str = "corpusmill", **conf: str) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession, package: str = "corpusmill") -> None:
    """Give Python workers a package of this repository, wherever they start;
    the same as submitting it with --py-files.  Done once per application."""
    context = spark.sparkContext
    shipped = context.__dict__.setdefault("_corpusmill_shipped", set())
    if package not in shipped:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        target = os.path.join(tempfile.mkdtemp(prefix="corpusmill-"), package)
        context.addPyFile(shutil.make_archive(target, "zip", root, package))
        shipped.add(package)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may go without the setting; it then gets a temporary
    folder, remembered for the session.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_SCRATCH_CONF, None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="corpusmill-")
    spark.conf.set(_SCRATCH_CONF, folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/corpusmill/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage, survives the loss of executors, and gives the optimizer
    real sizes, so it broadcasts the result only while it is under
    ``spark.sql.autoBroadcastJoinThreshold``.  Its shuffle files are removed as soon
    as it is written, since nothing reads them again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_CLEANUP_CONF, "false")
    spark.conf.set(_CLEANUP_CONF, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP_CONF, before)
    return spark.read.schema(df.schema).parquet(path)


def join_bounded(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join with ``small`` written first, so that Spark knows its bytes and
    broadcasts it only while it is under ``spark.sql.autoBroadcastJoinThreshold``."""
    return big.join(materialize(small, "lookup"), on, how)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Spread rows over the cores before CPU-heavy work, but only when the input
    has fewer files than there are cores; large inputs stay where they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *columns) if len(df.inputFiles()) < cores else df
