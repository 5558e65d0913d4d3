"""Small helpers that several training-data operators share."""

from __future__ import annotations

import gc
import tempfile
import time

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a temporary one only where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if folder:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(folder)
        return folder
    own = sc.getCheckpointDir()
    if own is None and not sc.master.startswith("local"):
        raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
    if own is None:
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-ckpt-"))
        own = sc.getCheckpointDir()
    return own


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read from the shared folder: lineage ends here and survives a lost executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Asks for the shuffle files of lineage that a checkpoint has cut to go now: Spark removes them once the driver's
    JVM happens to collect its garbage, and until then they fill the executors' disks.  Python lets go of JVM objects
    about a second after its own collection, and what the JVM's first collection frees lets go of the rest."""
    gc.collect()
    time.sleep(1.5)
    for _ in range(2):
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def least_reachable(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least row of the component of each of n rows under links (a, b)."""
    low = np.arange(n)
    while True:
        best = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, a, best)
        np.minimum.at(new, b, best)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id written as text, modulo n: the fold rule of the held-out contracts."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(n))
