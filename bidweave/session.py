"""Session, table and stage helpers shared by all operators."""

from __future__ import annotations

import re
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The context's folder for written stages, below the one the session names in ``spark.checkpoint.dir``.

    Only a session on one machine (tests) gets a temporary folder where none is named; on a cluster that is an error.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="bidweave-"))
    return context._jsc.sc().getCheckpointDir().get()


def stage(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` through the shared folder; the files survive the loss of executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def write_out(df: DataFrame) -> DataFrame:
    """Like ``stage``, as a compressed table in the shared folder: for wide rows that several passes read. It stays until the folder is cleared."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Keys that come again are broadcast up to this number (some 30 MB), beyond it joined by a shuffle.
BROADCAST_KEYS = 500_000


def unique(df: DataFrame, key: str) -> DataFrame:
    """One row of each key, null included. Keys are counted first, so that only rows whose key comes again are shuffled."""
    again = stage(df.groupBy(F.col(key).alias("__key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__key"))
    n = again.count()
    if not n:
        return df
    side = F.broadcast(again) if n <= BROADCAST_KEYS else again
    same = F.col(key).eqNullSafe(F.col("__key"))
    return df.join(side, same, "left_anti").unionByName(df.join(side, same, "left_semi").dropDuplicates([key]))


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out anew if the scan gives fewer than half as many tasks as there are cores (one small file, say)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() * 2 >= cores else df.repartition(cores)


def strip_all(column):
    """Outer white space of every kind removed."""
    return F.regexp_replace(column, r"(?U)^\s+|\s+$", "")


def folded(column):
    """Lower case without outer white space."""
    return F.lower(strip_all(column))
