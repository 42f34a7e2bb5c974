"""Helpers that keep a plan safe on a cluster: checkpoints, checked broadcasts, stable hashes."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side is broadcast.  Counted before the hint is given.
BROADCAST_ROWS = 100_000


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the session's setting; one of this machine only where the session is local (tests).

    On a cluster without a shared folder this raises: executors would each write to a disk of their own.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        path = os.path.join(tempfile.gettempdir(), "tamnan-checkpoints")
    sc.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder once and go on from the files."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting; beyond ``rows`` the join shuffles and AQE splits skewed keys."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files make less than half as many tasks (one small file); larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 < cores else df


def columns(df: DataFrame) -> dict:
    """The columns of a result of proven size as numpy arrays, carried by Arrow."""
    table = df.toArrow()
    return {name: table[name].to_numpy() for name in table.column_names}
