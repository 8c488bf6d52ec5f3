"""Tables written to the folder that all executors share.

Iterative operators cut their lineage by writing each round's rows as a
Parquet table under ``spark.checkpoint.dir``.  A lost executor then costs only
the tasks it was running: finished rounds are read again from the folder.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SWEPT: set[str] = set()
#: Trimmed from both ends of ids and categories (Spark's trim knows the blank only).
BLANKS = " \t\n\r\x0b\x0c ​﻿"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only where none is set and all runs on this machine (tests).

    RuntimeError on a cluster without one: a folder of the driver's machine would
    not be seen by the executors.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="foliomill-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def _own(spark: SparkSession) -> str:
    """This application's part of the shared folder; ``sweep`` is set to run when Python ends."""
    place = f"{shared_dir(spark)}/foliomill/{spark.sparkContext.applicationId}"
    if place not in _SWEPT:
        _SWEPT.add(place)
        atexit.register(sweep, spark)
    return place


def sweep(spark: SparkSession) -> None:
    """Delete every table this application has written to the shared folder.

    Results of operators read from these tables until they are written elsewhere,
    so this is for the end of a job.
    """
    if spark.sparkContext._jsc is None:
        return
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/foliomill/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Shelf:
    """Holds the intermediate tables of one operator call in the shared folder."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{_own(spark)}/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and return the written table; its schema is kept, not inferred."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def many(self, names: list[str], like: DataFrame) -> DataFrame:
        """Several written tables of one schema in a single scan, which packs small files together."""
        return self.spark.read.schema(like.schema).parquet(*map(self.path, names))

    def size(self, name: str) -> int:
        """Bytes on disk, for checks of a side before it is broadcast."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return fs.getContentSummary(path).getLength() if fs.exists(path) else 0

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
