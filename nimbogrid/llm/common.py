"""What the operators share: where intermediate tables go, and row identity."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: spark.checkpoint.dir, shared by all executors.

    Only where that setting is absent and the master is a single local JVM (tests) a temporary folder is made and set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="nimbogrid-")
    spark.sparkContext.setCheckpointDir(root)
    return root


class Scratch:
    """Intermediate tables of one run, as Parquet below :func:`work_root`.

    A saved table cuts the lineage and survives the loss of any executor. ``drop`` deletes one that no
    later step reads; the others must stay as long as the returned (lazy) result is read, and lie in one
    folder per run, ``<spark.checkpoint.dir>/nimbogrid-<id>``, for the caller to delete.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{work_root(spark)}/nimbogrid-{uuid.uuid4().hex}"
        self._n = 0

    def save(self, df: DataFrame, compression: str = "snappy") -> DataFrame:
        self._n += 1
        path = f"{self.root}/t{self._n}"
        df.write.parquet(path, compression=compression)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def numbered(self, df: DataFrame, name: str = "uid") -> DataFrame:
        """df, saved, with a number of its own for every row, equal rows too.

        The numbers are stored, not made again on each read: how a table is split into tasks, and so what
        monotonically_increasing_id gives, depends on how many cores there are at the time.
        """
        return self.save(df.withColumn(name, F.monotonically_increasing_id()), "zstd")

    def drop(self, *tables: DataFrame) -> None:
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(table._scratch_path)
            path.getFileSystem(conf).delete(path, True)


def unused(df: DataFrame, name: str) -> str:
    """name, with as many _ after it as it takes to be none of df's columns, in any case."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def groups_for(spark: SparkSession, size: int, most: int) -> int:
    """Into how many groups to deal data of ``size`` bytes, so that one holds about ``most``; the shuffle partitions at least."""
    return max(partitions(spark), -(-size // most))
