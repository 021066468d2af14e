"""Session helpers: tables, shared storage and worker import path."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def prepare(spark: SparkSession) -> SparkSession:
    """Make Python workers able to import this package from its installed place.

    Setting the worker environment is idempotent and costs no job; on a cluster the
    package is expected at the same path or shipped with ``--py-files``.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if PACKAGE_ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([PACKAGE_ROOT, *paths])
    # long texts: bound what one Arrow batch holds, unless the user has chosen a size
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not spark._jsparkSession.sessionState().conf().contains(key):
        spark.conf.set(key, "2000")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of the data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """This application's own folder below the one all executors share, named by ``spark.checkpoint.dir``.

    It is deleted when the application ends. Only on a single machine may the setting be missing; then a local folder takes its place.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            if not re.match(r"local(\[|$)", sc.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            configured = "file://" + tempfile.mkdtemp(prefix="skeinery-checkpoint-")
        sc.setCheckpointDir(configured)
        path = sc._jvm.org.apache.hadoop.fs.Path(sc.getCheckpointDir())
        path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
    return sc.getCheckpointDir()


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Materialize ``df`` in the shared folder and drop its lineage; survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager)


def stage(df: DataFrame) -> DataFrame:
    """Like ``cut``, but as a compressed table with columns that can be read alone: smaller where rows are wide or read in part."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
