"""Tables that are made once and read several times, kept where driver and executors see them."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder, so that numbers given to its rows stay and its lineage ends there.  The folder is the one
    that spark.checkpoint.dir names; only a session on one machine gets a temporary one where none is set."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        d = spark.conf.get("spark.checkpoint.dir", None)
        if not d:
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            d = tempfile.mkdtemp(prefix="tracelake-")
        spark.sparkContext.setCheckpointDir(d)
    return df.checkpoint()
