"""Log files as lines."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from logweft.functions.text import is_blank, lenient_utf8
from logweft.sources.hidden import read_hidden

LINES_PER_BLOCK = 65_536


def log_name(path: Column) -> Column:
    """The log a path belongs to: the file, or the ``.log`` folder it is a part of."""
    name = F.substring_index(path, "/", -1)
    folder = F.substring_index(F.substring_index(F.substring_index(path, "/", -2), "/", 1), "=", -1)
    chosen = F.when(name.endswith(".log"), name).otherwise(folder)
    decoded = F.url_decode(F.replace(chosen, F.lit("+"), F.lit("%2B")))
    return F.when(chosen.contains("%"), decoded).otherwise(chosen)


def scan_log_dir(spark: SparkSession, directory: str) -> DataFrame:
    """The lines of the ``.log`` files of a directory, as Spark splits them.

    A sub-directory whose name ends in ``.log`` is one log written by Spark in
    several part files; ``filename=app.log`` counts as ``app.log``. ``path`` and
    ``start`` name the block a line was read from, ``pos`` orders the lines of a
    block. Spark reads no files whose names start with ``.`` or ``_``; such logs come from a
    reader of their own.
    """
    try:
        text = spark.read.text(f"{_no_glob(directory.rstrip('/'))}/*.log")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        # No such log: an empty result, or an error when the directory is missing.
        text = spark.read.option("pathGlobFilter", "*.log").text(directory)
    hidden = hidden_logs(spark, directory)
    return _scanned(text).unionByName(_scanned_hidden(spark, hidden)) if hidden else _scanned(text)


def hidden_logs(spark: SparkSession, directory: str) -> list[tuple[str, int]]:
    """The logs in a directory that Spark's readers leave out: uri and bytes. Folders they do read."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(f"{_no_glob(directory.rstrip('/'))}/[._]*.log")
    found = path.getFileSystem(context._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted((s.getPath().toUri().toString(), s.getLen()) for s in found if s.isFile())


def _scanned_hidden(spark: SparkSession, files: list[tuple[str, int]]) -> DataFrame:
    value = lenient_utf8(F.col("value").cast("string")).alias("value")
    return read_hidden(spark, files).select("path", "start", "pos", value)


def _no_glob(path: str) -> str:
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def _scanned(text: DataFrame) -> DataFrame:
    return text.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("pos"),
        lenient_utf8(F.col("value")).alias("value"),
    )


def as_scan(lines: DataFrame) -> DataFrame:
    """Lines that are numbered already, cut into blocks of bounded size."""
    return lines.select(
        "filename",
        F.floor(F.col("line_num") / LINES_PER_BLOCK).alias("start"),
        F.col("line_num").alias("pos"),
        "line_num",
        "value",
    )


def block_columns(scanned: DataFrame) -> list[str]:
    """The columns that name a block: ``path, start`` or ``filename, start``."""
    return [name for name in ("filename", "path", "start") if name in scanned.columns]


def sample_lines(lines: DataFrame, limit: int = 50) -> DataFrame:
    """The first non-blank lines over the files in name order (a top-k)."""
    if "filename" not in lines.columns:
        lines = lines.withColumn("filename", log_name(F.col("path")))
    order = [c for c in ("filename", "path", "start", "pos", "line_num") if c in lines.columns]
    return lines.where(~is_blank(F.col("value"))).orderBy(*order).limit(limit)


def sample_log_dir(spark: SparkSession, directory: str, limit: int = 50) -> DataFrame:
    """``sample_lines`` of a directory, reading no more of it than it needs.

    The first block of the first log nearly always has enough lines, and a task that has
    found them stops. If not, the first log is read, then twice as many logs, and so on; the
    driver holds the names of those only.
    """
    schema, path = "filename string, value string", F.col("_metadata.file_path")
    try:
        files = spark.read.format("binaryFile").load(f"{_no_glob(directory.rstrip('/'))}/*.log")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    whole = F.substring_index(path, "/", -1).endswith(".log")
    log = F.when(whole, path).otherwise(F.regexp_replace(path, "/[^/]*$", ""))
    files = files.select(log_name(path).alias("filename"), log.alias("log"), path.alias("path"))
    logs = files.groupBy("filename", "log").agg(F.min("path").alias("head")).orderBy("filename", "log")
    hidden = hidden_logs(spark, directory)
    if hidden:
        return _sample_with_hidden(spark, logs, hidden, limit)
    taken = 1
    while True:
        some = logs.limit(taken + 1).collect()
        rows = _head(spark, unquote(some[0]["head"]), limit) if some and taken == 1 else []
        if some and len(rows) < limit:
            scanned = _scanned(spark.read.text([_no_glob(unquote(row["log"])) for row in some[:taken]]))
            rows = sample_lines(scanned, limit).select("filename", "value").collect()
        if len(rows) == limit or len(some) <= taken:
            return spark.createDataFrame(rows, schema)
        taken *= 2


def _sample_with_hidden(spark: SparkSession, logs: DataFrame, hidden: list[tuple[str, int]], limit: int) -> DataFrame:
    """The first lines over visible and hidden logs: as many logs as are needed, in name order."""
    ours = spark.createDataFrame([(uri,) for uri, _ in hidden], "path string")
    ours = {r["path"]: r["filename"] for r in ours.select("path", log_name(F.col("path")).alias("filename")).collect()}
    taken = 1
    while True:
        some = logs.limit(taken).collect()
        names = sorted({*ours.values(), *[r["filename"] for r in some]})[:taken]
        rows = _scanned_hidden(spark, [f for f in hidden if ours[f[0]] in names])
        if some:
            rows = rows.unionByName(_scanned(spark.read.text([_no_glob(unquote(r["log"])) for r in some])))
        rows = rows.withColumn("filename", log_name(F.col("path"))).where(F.col("filename").isin(names))
        rows = sample_lines(rows, limit).select("filename", "value").collect()
        if len(rows) == limit or taken > len(ours) + len(some):
            return spark.createDataFrame(rows, "filename string, value string")
        taken *= 2


def _head(spark: SparkSession, file: str, limit: int) -> list[Row]:
    """The first non-blank lines of the first block of a file: only one task has such rows, in order."""
    scanned = _scanned(spark.read.text(_no_glob(file))).where((F.col("start") == 0) & ~is_blank(F.col("value")))
    rows = scanned.select(log_name(F.col("path")).alias("filename"), "pos", "value").limit(limit).collect()
    return [Row(filename=row["filename"], value=row["value"]) for row in sorted(rows, key=lambda row: row["pos"])]
