"""Session helpers: lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point checkpoints at the folder named in ``spark.checkpoint.dir``.

    The setting is honoured as it stands. Only a local session without one gets a
    temporary folder; on a cluster a machine-local folder would be lost with its
    executor, so a missing setting is an error there.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lanewise-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder and return a plan that reads it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
