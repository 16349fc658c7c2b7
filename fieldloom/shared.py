"""The folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the cluster's own; where none is set, a temporary one of a local session, and an error on a cluster."""
    sc = spark.sparkContext
    have = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if have is None:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        have = tempfile.mkdtemp(prefix="fieldloom-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(have)
    return have
