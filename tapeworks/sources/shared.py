"""Cuts of long lineages, in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame


def cut(frame: DataFrame) -> DataFrame:
    """``frame``, computed once and kept in spark.checkpoint.dir: what follows neither plans nor
    computes it again, and it outlives executors."""
    spark = frame.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
        if not folder:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder)
    return frame.checkpoint()
