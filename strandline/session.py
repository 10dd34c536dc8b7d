"""Session helpers shared by every job: the shared folder and fresh column names."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Where neither the setting nor the context names a folder, a local session gets a temporary one; on a cluster that
    would be lost with its machine, and a RuntimeError asks for the setting.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="strandline-"))
    return named or context.getCheckpointDir()


def cut(frame: DataFrame) -> DataFrame:
    """Materialise a frame in the shared folder, so that later steps don't depend on any executor's disk."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


def fresh(frame: DataFrame, name: str) -> str:
    """A column name beginning with ``name`` that the frame doesn't have yet (names compare without case)."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name
