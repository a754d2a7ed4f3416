"""Cutting lineage so that jobs survive lost executors."""

from __future__ import annotations

import itertools
import tempfile

from pyspark.sql import DataFrame, SparkSession

_CUTS = itertools.count(1)
_COLLECT_EVERY = 6


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as `spark.checkpoint.dir` or the context names it.

    Where neither does, a folder of this machine is set if everything runs on it;
    on a cluster that would lose data, so it is refused.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="pactum-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder.

    Spark removes the shuffle files (and, if so configured, checkpoints) of
    tables that nothing refers to any more once the driver's JVM collects
    garbage; loops of many small tables ask for that now and then.
    """
    shared_folder(df.sparkSession)
    out = df.checkpoint(eager=True)
    if next(_CUTS) % _COLLECT_EVERY == 0:
        df.sparkSession.sparkContext._jvm.System.gc()
    return out
