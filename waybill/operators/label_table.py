"""The stored labels as a table of key buckets, of which an upsert rewrites only those it touches.

Rows are dealt into directories by a hash of their key.  An upsert reads the
directories that the new keys fall into, replaces or adds rows there, and overwrites
these directories alone (dynamic partition overwrite), so its cost follows the new
rows, not the table.  Parts written under older schemas stay as they are; reading
merges the schemas and adds what none of them has.

New rows are written aside first: they may come from a model or a clock, and are
read more than once.  Spark moves the new directories into place when all tasks have
ended; a run that is lost before leaves the table as it was, and one that is repeated
writes the same rows again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill import schema as S
from waybill.operators import store

BUCKET = "bucket"


def save_images(rows: DataFrame, folder: str, key: str = "label_id") -> DataFrame:
    """``rows`` with their ``image`` bytes as files ``<folder>/<key>.jpg``: ``image_path``, and ``store_error`` where that failed.

    A file appears whole or not at all, and a repeated task writes the same file.
    Rows without an image have no path.
    """

    @F.pandas_udf("image_path string, store_error string")
    def saved(keys: pd.Series, images: pd.Series) -> pd.DataFrame:
        out = []
        for name, image in zip(keys, images, strict=True):
            if image is None or not len(image):
                out.append((None, None))
                continue
            try:
                where, path = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
                where.create_dir(path, recursive=True)
                final, part = f"{path}/{name}.jpg", f"{path}/.{name}.{uuid.uuid4().hex}"
                with where.open_output_stream(part) as f:
                    f.write(bytes(image))
                where.move(part, final)
                out.append((f"{folder}/{name}.jpg", None))
            except Exception as problem:  # noqa: BLE001  a label whose image cannot be kept is stored without it
                out.append((None, f"{type(problem).__name__}: {problem}"[:200]))
        return pd.DataFrame(out, columns=["image_path", "store_error"], dtype=object)

    kept = [c for c in rows.columns if c not in ("image", "image_path", "store_error")]
    once = saved.asNondeterministic()(F.col(key).cast("string"), "image")
    return rows.select(*kept, once.alias("_saved")).select(*kept, "_saved.*")


class LabelTable:
    """A folder of labels in ``buckets`` directories by key; the number of buckets is fixed when the table is begun."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 256, key: str = "label_id") -> None:
        self.spark, self.path, self.buckets, self.key = spark, path.rstrip("/"), buckets, key

    def _place(self, name: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _is_there(self) -> bool:
        files, place = self._place("")
        return files.exists(place) and any(s.getPath().getName().startswith(f"{BUCKET}=") for s in files.listStatus(place))

    def _parts(self) -> DataFrame:
        return self.spark.read.option("mergeSchema", "true").parquet(self.path)

    def read(self) -> DataFrame:
        """All labels; parts of older schemas have nulls for what they lack."""
        if not self._is_there():
            return S.evolve(self.spark.createDataFrame([], f"{self.key} string"), S.labels_schema_without_id())
        return S.evolve(self._parts().drop(BUCKET), S.labels_schema_without_id())

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(BUCKET, F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int"))

    def _rewrite(self, rows: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """Overwrite the buckets of the rows' keys with ``change(old, rows)``; how many rows came."""
        aside = f"_aside/{uuid.uuid4().hex}"
        self._dealt(rows).write.parquet(f"{self.path}/{aside}")
        try:
            new = self.spark.read.parquet(f"{self.path}/{aside}")
            counts = new.groupBy(BUCKET).count().collect()  # at most one row for each bucket
            touched = [r[BUCKET] for r in counts]
            if touched:
                plain = new.drop(BUCKET)
                old = self._parts().where(F.col(BUCKET).isin(touched)).drop(BUCKET) if self._is_there() else plain.limit(0)
                merged = self._dealt(change(old, plain))
                merged.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)
            return sum(r["count"] for r in counts)
        finally:
            files, place = self._place(aside)
            files.delete(place, True)

    def upsert(self, rows: DataFrame) -> int:
        """Store rows under their keys; a row that replaces another takes neither its annotation nor anything else of it."""

        def change(old: DataFrame, new: DataFrame) -> DataFrame:
            whole = S.evolve(old, old.limit(0).unionByName(new.limit(0), allowMissingColumns=True).schema)
            return store.upsert(whole, new, self.key)

        return self._rewrite(rows, change)

    def annotate(self, updates: DataFrame) -> int:
        """Store annotations (key, ground_truth) of labels that are there."""
        if not self._is_there():
            return 0

        def change(old: DataFrame, new: DataFrame) -> DataFrame:
            whole = old if "ground_truth" in old.columns else old.withColumn("ground_truth", F.lit(None).cast("map<string,string>"))
            return store.annotate(whole, new, self.key)

        return self._rewrite(updates, change)

    def was_applied(self, stream: str, batch: int) -> bool:
        files, mark = self._place(f"_applied/{stream}/{batch}")
        return files.exists(mark)

    def apply_batch(self, rows: DataFrame, stream: str, batch: int, images: str | None = None) -> bool:
        """Store a batch of a stream once; False if it was applied before.

        The mark is made after the rows are stored: a batch that was lost between
        the two is stored again, with the same keys and so the same result.
        """
        if self.was_applied(stream, batch):
            return False
        run_and_store(self, rows, images)
        files, mark = self._place(f"_applied/{stream}/{batch}")
        files.create(mark, True).close()
        return True


def run_and_store(table: LabelTable, rows: DataFrame, images: str | None = None) -> int:
    """Store scanned labels, with their images as files below ``images``; how many.

    ``rows`` are stored labels (``selection.stored``), with ``image`` bytes where there
    are any.  A label whose image cannot be kept is stored all the same, and its
    ``store_error`` says why.
    """
    if images is not None and "image" in rows.columns:
        rows = save_images(rows, images, table.key)
    return table.upsert(rows.drop("image"))
