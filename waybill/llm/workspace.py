"""Intermediate tables of iterative operators, in the folder that driver and executors share.

A written table cuts the lineage like ``checkpoint()`` and survives lost
executors.  Unlike a checkpoint it is read again with its true size; the size
that Spark estimates for a checkpoint is the product over all joins behind it,
which grows beyond all bounds in a loop.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The session's checkpoint directory; where none is set, a folder of the warehouse becomes it."""
    root = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_intermediate"
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path under the session's checkpoint directory."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(rows: DataFrame) -> DataFrame:
    """``rows.checkpoint()``, for which a directory is there."""
    shared_root(rows.sparkSession)
    return rows.checkpoint()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class Workspace:
    """Tables of one run, in one folder; those no longer needed can be dropped."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root, self.count = spark, shared_folder(spark, name), 0
        self.paths: dict[int, str] = {}

    def save(self, rows: DataFrame) -> DataFrame:
        """``rows``, written and read again."""
        path = f"{self.root}/{self.count}"
        self.count += 1
        rows.write.parquet(path)
        saved = self.spark.read.schema(rows.schema).parquet(path)
        self.paths[id(saved)] = path
        return saved

    def drop(self, *tables: DataFrame) -> None:
        """Delete saved tables that nothing reads any more."""
        for table in tables:
            if path := self.paths.pop(id(table), None):
                remove(self.spark, path)
