"""Session defaults and the places a job may write to."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster.

    ``spark.checkpoint.dir`` is read from the session. Where it is unset, a session on this machine
    alone (tests, a laptop) gets a folder of this machine; on a cluster that is an error, for its
    executors would each write to a disk of their own.
    """
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="groundwork-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back: its lineage ends there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables; a plain parquet scan, so filters and columns are pushed down."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
