"""Session helpers: the shared checkpoint folder and table loading."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the one the cluster names, else (tests, one machine) a temporary one.

    On a cluster ``spark.checkpoint.dir`` names a folder that all executors share. Only where it is
    unset and the master is local does a machine-local folder serve.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = os.path.join(tempfile.gettempdir(), f"claimloom-checkpoint-{os.getpid()}")
    sc.setCheckpointDir(folder)
    return folder


@contextmanager
def _tidied(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of queries planned and run in the block go at each one's end."""
    before = spark.conf.get(TIDY, None)
    spark.conf.set(TIDY, "true")
    try:
        yield
    finally:
        spark.conf.set(TIDY, before) if before is not None else spark.conf.unset(TIDY)


def cut(df: DataFrame, eager: bool = True, tidy: bool = False) -> DataFrame:
    """Cut lineage through the shared checkpoint folder, so a lost executor costs no recomputation.

    ``tidy``: the shuffle files that led to it go at once; else they stay until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    if not tidy:
        return df.checkpoint(eager)
    with _tidied(spark):
        return df.select("*").checkpoint(True)  # the setting counts when a query is planned


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` for the time of the block, computed once: compressed columns beside the checkpoints, deleted at the block's end.

    The shuffle files that led to it go at once. What the block gives away must be computed in it.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    path = f"{ensure_checkpoint_dir(spark)}/kept-{uuid.uuid4().hex}"
    try:
        with _tidied(spark):
            df.select("*").write.option("compression", "zstd").parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
