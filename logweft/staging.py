"""Written intermediate tables in the folder all executors share."""

from __future__ import annotations

import itertools
import uuid

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir, or name a folder that all executors share")
    return folder.rstrip("/")


class Staging:
    """One run's intermediate tables; leaving the ``with`` block deletes them.

    A staged table cuts the lineage, is column-pruned by later readers and
    survives the loss of the executors that wrote it.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = f"{folder or shared_folder(spark)}/logweft-{uuid.uuid4().hex}"
        self._number = itertools.count(1)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{next(self._number):03d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def write_all(self, **tables: DataFrame) -> dict[str, DataFrame]:
        """Write tables that do not need each other as concurrent jobs."""
        threads = [InheritableThread(target=self._write_into, args=(tables, name)) for name in tables]
        for thread in threads:
            thread.start()
        for thread in threads:
            thread.join()
        for written in tables.values():
            if isinstance(written, Exception):
                raise written
        return tables

    def _write_into(self, tables: dict, name: str) -> None:
        try:
            tables[name] = self.write(tables[name], name)
        except Exception as error:  # raised again in the calling thread
            tables[name] = error

    def __enter__(self) -> Staging:
        return self

    def __exit__(self, *_) -> None:
        path, system = self._place()
        system.delete(path, True)

    def keep_until_exit(self) -> Staging:
        """Without a ``with`` block: the tables go when the application ends."""
        path, system = self._place()
        system.mkdirs(path)
        system.deleteOnExit(path)
        return self

    def _place(self):
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path, path.getFileSystem(context._jsc.hadoopConfiguration())
