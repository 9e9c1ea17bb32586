"""Helpers shared by the operators: table access, lineage cuts and key ranges."""

from __future__ import annotations

import atexit
import math
import os
import tempfile
import uuid

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What one Arrow batch between the JVM and Python may hold.
ARROW_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark so that any file system it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` written to the shared checkpoint folder and read back, lineage cut.

    The folder is the session's ``spark.checkpoint.dir``; only where that is unset (tests on one
    machine) is a folder of our own used. Lost executors lose nothing: the files are on shared storage.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        given = sc.getConf().get("spark.checkpoint.dir")
        if not given and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(given or os.path.join(tempfile.gettempdir(), "lodeseam-checkpoints"))
    return sc.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """Like checkpointed(), as a Parquet table: smaller, and read column by column. Deleted when Python ends.

    The driver then collects its garbage, so that memory, broadcasts and shuffles of earlier steps are given back.
    """
    spark = df.sparkSession
    path = fresh_folder(spark)
    df.write.parquet(path)
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def fresh_folder(spark: SparkSession) -> str:
    """A new path in the shared folder, deleted when Python ends."""
    path = f"{shared_folder(spark)}/lodeseam-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is not None:
        place = sc._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)


def in_arrow(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """df.mapInArrow(run, schema) in batches of at most ARROW_BYTES, or one row, so that long texts make no large batches.

    The bound is a setting of the session, which keeps it.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return df.mapInArrow(run, schema)


def whole_text(column: str = "text") -> Column:
    """The text, a null one as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def pieces(rows: int, each: int, least: int = 1) -> int:
    """How many buckets of about `each` rows hold `rows` rows."""
    return max(least, math.ceil(rows / max(1, each)))


def unit_hash(*columns: Column | str, seed: int = 0) -> Column:
    """A seeded hash of the columns in 0 .. 2^62 - 1, uniform, the same in every run."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 2)
