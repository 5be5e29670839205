"""Logs whose names start with ``.`` or ``_``, which Spark's readers leave out.

A data source of its own reads them, in byte ranges: a line belongs to the range that its first
byte is in or right behind, as with Spark's text reader.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SOURCE = "logweft_hidden_logs"
_SCHEMA = pa.schema([("path", pa.string()), ("start", pa.int64()), ("pos", pa.int64()), ("value", pa.binary())])
_BLOCK, _ROWS = 1 << 20, 8192
_LINE_END = re.compile(rb"\r\n|\n|\r")
_MARK = b"\xef\xbb\xbf"


def lines_between(stream, start: int, end: int, block: int = _BLOCK) -> Iterator[bytes]:
    """The lines that begin in ``start`` to ``end`` of a file, the one at ``start`` only if that is 0."""
    stream.seek(start)
    held, begin, skip, mark = b"" if start else stream.read(len(_MARK)), start, start > 0, 0
    if held == _MARK:
        held, mark = b"", len(_MARK)
    while begin <= end or skip:
        more = stream.read(block)
        held += more
        # The last line waits for its end, and a carriage return for what follows it.
        at, last = 0, not more
        for cut in _LINE_END.finditer(held):
            if cut.end() == len(held) and cut[0] == b"\r" and not last:
                break
            if skip:
                skip = False
            elif begin > end:
                return
            else:
                yield held[at : cut.start()]
            begin, at, mark = begin + mark + cut.end() - at, cut.end(), 0
        held = held[at:]
        if last:
            if held and not skip and begin <= end:
                yield held
            return


class HiddenLogsReader(DataSourceReader):
    def __init__(self, files: list[list], split: int):
        self.files, self.split = files, split

    def partitions(self) -> list[InputPartition]:
        ranges = [(path, at, min(at + self.split, size)) for path, size in self.files for at in range(0, size, self.split)]
        return [InputPartition(r) for r in ranges] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        path, start, end = partition.value
        store, place = _store(path)
        with store.open_input_file(place) as stream:
            held, pos = [], 0
            for line in lines_between(stream, start, end):
                held.append(line)
                if len(held) == _ROWS:
                    yield _batch(path, start, pos, held)
                    held, pos = [], pos + _ROWS
            if held:
                yield _batch(path, start, pos, held)


class HiddenLogs(DataSource):
    @classmethod
    def name(cls) -> str:
        return SOURCE

    def schema(self) -> str:
        return "path string, start long, pos long, value binary"

    def reader(self, schema) -> HiddenLogsReader:
        return HiddenLogsReader(json.loads(self.options["files"]), int(self.options["split"]))


def read_hidden(spark: SparkSession, files: list[tuple[str, int]]) -> DataFrame:
    """``path, start, pos, value`` of files given as (uri, bytes), in ranges of the size of Spark's own splits."""
    spark.dataSource.register(HiddenLogs)
    split = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
        spark.conf.get("spark.sql.files.maxPartitionBytes")
    )
    return spark.read.format(SOURCE).option("files", json.dumps(files)).option("split", str(split)).load()


def _batch(path: str, start: int, pos: int, lines: list[bytes]) -> pa.RecordBatch:
    count = len(lines)
    columns = [[path] * count, [start] * count, range(pos, pos + count), lines]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + unquote(uri.removeprefix("file:")).lstrip("/")
    return fs.FileSystem.from_uri(uri)
