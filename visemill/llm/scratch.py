"""Cutting lineage through the shared folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the session's ``spark.checkpoint.dir``. Where it is unset, a local master (as in tests) gets a temporary folder;
    executors elsewhere could not read the driver's, so there it is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="visemill-checkpoint-"))


def remove_folder(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder; later reads survive the loss of any executor.

    Spark removes the files when the returned DataFrame is garbage.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
