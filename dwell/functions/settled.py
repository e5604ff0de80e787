"""Written tables between the rounds of iterative jobs."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder and read back, so that rounds don't pile up and survive lost executors.

    The folder is the session's (spark.checkpoint.dir); where none is set, a session on one
    machine takes a temporary one, and any other has to name one that its machines share.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        where = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if where is None:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            where = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(where)
    return df.checkpoint()
