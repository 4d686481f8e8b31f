"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def local_session(cores: int = 8, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tessera")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", conf.pop("driver_memory", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    session = builder.getOrCreate()
    ship_package(session)
    return session


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to Spark's Python workers where they couldn't import
    it: it is neither on PYTHONPATH nor below the working folder, nor installed."""
    package = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(package)
    known = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root in known or root == os.getcwd() or os.path.basename(root) in ("site-packages", "dist-packages"):
        return
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="tessera-code-")  # the driver serves it to all
    staged = os.path.join(folder, "staged")
    shutil.copytree(package, os.path.join(staged, "tessera"), ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(os.path.join(folder, "tessera_package"), "zip", staged))
    _shipped.add(context.applicationId)


_local: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """A new folder all executors share.

    The cluster names its folder in ``spark.checkpoint.dir``. Where that is
    unset a temporary folder is made if all runs on this machine, and removed
    when the process ends; on a cluster it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a shared folder on {master}")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="tessera-"))
            atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
        base = _local[0]
    return os.path.join(base, "tessera", uuid.uuid4().hex)


def materialise(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` under ``path`` and read it back, which cuts its lineage."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def once(df: DataFrame, *keys: str) -> DataFrame:
    """Each record once, however often its row comes: one row per key. A row
    with a null in its key names no record; such rows are told apart by content."""
    nameless = F.greatest(*[F.col(k).isNull().cast("int") for k in keys], F.lit(0)) > 0
    content = F.when(nameless, F.xxhash64(*df.columns))
    return df.withColumn("_content", content).dropDuplicates([*keys, "_content"]).drop("_content")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system API, wherever it lives."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
