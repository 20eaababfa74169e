"""Session-level helpers shared by all operators."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.  Where none is configured, a local session gets a temporary one; on a cluster,
    whose executors don't share the driver's disk, that is an error."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured and not re.match(r"local(\[[^\]]*\])?$", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="loomlog-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that later passes neither recompute it nor
    depend on any single executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded(df: DataFrame, max_rows: int) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows (reads no more than that many plus one)."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_bounded(df: DataFrame, max_rows: int = 50_000) -> DataFrame:
    """A broadcast hint for sides whose row count was checked; larger ones keep Catalyst's own choice
    (a shuffled join, which AQE splits where keys are skewed)."""
    return F.broadcast(df) if bounded(df, max_rows) else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each Spark application, so that executors need no
    installation of it."""
    import os
    import shutil

    sc = spark.sparkContext
    if getattr(sc, "_loomlog_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    base = os.path.join(tempfile.mkdtemp(prefix="loomlog-package-"), "loomlog_package")
    sc.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(here), os.path.basename(here)))
    sc._loomlog_shipped = True
