"""Layout candidates out of logging configuration files."""

from __future__ import annotations

import os
import xml.etree.ElementTree as ET
from collections.abc import Iterable, Iterator
from fnmatch import fnmatchcase
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweft.functions.text import lenient_utf8

# The names of configuration files.
CONFIG_NAME = r"(?i)\Alogback.*\.xml\z"
CONFIG_GLOB = "[Ll][Oo][Gg][Bb][Aa][Cc][Kk]*.[Xx][Mm][Ll]"
#: Names of files in one batch.
NAMES = 8192
CANDIDATE_SCHEMA = "config string, ordinal int, name string, pattern string, source string, error string"
CANDIDATE = ["config", "ordinal", "name", "pattern", "source"]


def is_config_name(name: Column) -> Column:
    return name.rlike(CONFIG_NAME)


def discover_configs(spark: SparkSession, directory: str) -> DataFrame:
    """The configuration files beside the logs, whole: ``config, xml`` (bytes).

    Spark's readers hold the state of every file of a directory on the driver. A local or mounted one is
    listed by a task instead, name by name, and files are opened only if contents are asked for.
    """
    folders = _local_folders(spark, directory)
    if not folders:
        return _whole_files(spark.read.option("pathGlobFilter", CONFIG_GLOB), directory)

    def listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column(0).to_pylist():
                for names in _listed(os.fsencode(folders[number])):
                    yield pa.RecordBatch.from_pydict({"folder": [number] * len(names), "name": names})

    def content(number: int, name: bytes) -> bytes:
        with open(os.path.join(os.fsencode(folders[number]), name), "rb") as file:
            return file.read()

    names = spark.range(0, len(folders), 1, len(folders)).mapInArrow(listed, "folder long, name binary")
    # The task that lists opens no file; the names are dealt to others.
    names = names.repartition("folder", "name")
    # Rows go to Python a few at a time, so that a task holds few contents.
    read = F.udf(content, "binary", useArrow=False)
    config = lenient_utf8(F.col("name").cast("string"))
    return names.select(config.alias("config"), read("folder", "name").alias("xml"))


def _local_folders(spark: SparkSession, directory: str) -> list[str]:
    """The paths of a directory, or of all that fit a pattern; none if one is no folder of a local file system."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(directory)
    found = path.getFileSystem(context._jsc.hadoopConfiguration()).globStatus(path) or []
    if not all(s.isDirectory() and s.getPath().toUri().getScheme() == "file" for s in found):
        return []
    return [s.getPath().toUri().getPath() for s in found]


def _listed(folder: bytes) -> Iterator[list[bytes]]:
    """The names of the configuration files in a folder, some at a time."""
    with os.scandir(folder) as entries:
        found = (e.name for e in entries if fnmatchcase(e.name, CONFIG_GLOB.encode()) and e.is_file())
        while names := list(islice(found, NAMES)):
            yield names


def read_config(spark: SparkSession, path: str) -> DataFrame:
    return _whole_files(spark.read, path)


def _whole_files(reader, path: str) -> DataFrame:
    # Binary, since a file may declare its own encoding.
    name = F.replace("_metadata.file_name", F.lit("+"), F.lit("%2B"))
    return reader.format("binaryFile").load(path).select(
        F.url_decode(name).alias("config"), F.col("content").alias("xml")
    )


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _patterns(xml: bytes) -> Iterator[tuple[str, str, str]]:
    """Name, pattern and source of every candidate, in document order.

    A property is one if its name speaks of a pattern and its value holds a
    conversion; so is a ``pattern`` element, named after the outermost appender
    around it.
    """
    waiting: list[tuple[ET.Element, str | None]] = [(ET.fromstring(xml), None)]
    while waiting:
        element, owner = waiting.pop()
        tag = _local(element.tag) if isinstance(element.tag, str) else ""
        if tag == "appender":
            owner = element.get("name", "").strip() if owner is None else owner
        elif tag == "property":
            name, value = element.get("name", "").strip(), element.get("value", "").strip()
            if "PATTERN" in name.upper() and "%" in value:
                yield name, value, "property"
        elif tag.lower() == "pattern":
            text = "".join(element.itertext()).strip()
            if "%" in text:
                yield f"{owner or ''} Pattern".strip(), text, "encoder"
        waiting += [(child, owner) for child in reversed(element)]


def _rows(config: str, xml: bytes) -> list[tuple]:
    try:
        return [(config, ordinal, *found, None) for ordinal, found in enumerate(_patterns(xml))]
    except ET.ParseError as error:
        return [(config, -1, None, None, None, str(error))]


def extract_candidates(configs: DataFrame) -> DataFrame:
    """Layout candidates of configuration files in document order, repeats included.

    A file that is no XML gives one row with its ``error`` and no pattern.
    """

    def extract(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [row for config, xml in zip(batch["config"], batch["xml"]) for row in _rows(config, xml)]
            yield pd.DataFrame(rows, columns=[*CANDIDATE, "error"])

    return configs.select("config", "xml").mapInPandas(extract, CANDIDATE_SCHEMA)


def broken_configs(candidates: DataFrame) -> DataFrame:
    """The files that could not be read: ``config, error``."""
    return candidates.where(F.col("error").isNotNull()).select("config", "error")


def dedup_candidates(candidates: DataFrame) -> DataFrame:
    """The first candidate of every distinct pattern of a configuration."""
    same = Window.partitionBy("config", "pattern").orderBy("ordinal")
    found = candidates.where(F.col("pattern").isNotNull()).select(*CANDIDATE)
    return found.withColumn("_nth", F.row_number().over(same)).where("_nth = 1").drop("_nth")


def load_candidates(configs: DataFrame) -> DataFrame:
    return dedup_candidates(extract_candidates(configs))
