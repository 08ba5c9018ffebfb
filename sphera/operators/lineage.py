"""Cutting lineage of iterative plans, and the shared folder for what is kept between stages."""

from __future__ import annotations

import functools
import tempfile

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="sphera-checkpoint-")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors see. Only a session in one process may do without: it gets a local one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
    return _own_folder()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder, so that lost executors cost no recomputation beyond it."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
