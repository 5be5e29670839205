"""Written intermediate tables of the operators in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Where that is unset, an error, but on a local master a folder of our own, one for each application.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = tempfile.mkdtemp(prefix="llm-")
    return _own[context.applicationId]


def _file_system(spark: SparkSession, path: str):
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(context._jsc.hadoopConfiguration())


def written(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet: lineage is cut, readers prune columns, lost executors cost nothing.

    The table goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    place, system = _file_system(spark, path)
    system.deleteOnExit(place)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_at = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more."""
    for table in tables:
        place, system = _file_system(table.sparkSession, table.written_at)
        system.delete(place, True)


def unused(df: DataFrame, name: str) -> str:
    """``name``, longer if ``df`` has such a column."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
