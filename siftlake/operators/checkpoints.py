"""Where iterative operators cut their lineage and queries put tables that they read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the checkpoint folder set by the caller. In local mode, where all share the machine, one in the warehouse; elsewhere a warehouse of local files raises."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found is None:
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/siftlake-checkpoints"
        if found.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
