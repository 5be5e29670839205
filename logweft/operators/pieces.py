"""Files written from pieces of text in order, without anything between them.

Spark's text writer ends every row with a line end, which a piece of a long line must
not have. So this is a data source of its own: each task streams its pieces to files under a
temporary folder and hands in their names. When all tasks have, the commit puts
the files in their place, many at a time; if one fails for good, the abort removes
what there is and the output stays as it was. Attempts that failed or ran twice hand in
nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

ORDER = ["file", "section", "pos", "piece"]
SOURCE = "logweft_pieces"
#: Files moved at a time.
MOVERS = 32


@dataclass
class WrittenParts(WriterCommitMessage):
    """What a task has written: report file, number of the part, name under the temporary folder."""

    parts: list[tuple[str, int, str]]


class PiecesWriter(DataSourceArrowWriter):
    """Rows (file, text), those of a file in a row, to ``folder/file=<file>/part-<number>``."""

    def __init__(self, folder: str):
        self.folder, self.temporary = folder, f"{folder}/_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WrittenParts:
        context = TaskContext.get()
        store, base = _store(self.temporary)
        store.create_dir(base, recursive=True)
        parts: list[tuple[str, int, str]] = []
        current, out = None, None
        for batch in iterator:
            for file, text in zip(batch.column("file").to_pylist(), batch.column("text"), strict=True):
                if file != current:
                    if out is not None:
                        out.close()
                    name = f"{context.taskAttemptId()}-{len(parts)}"
                    current, out = file, store.open_output_stream(f"{base}/{name}")
                    parts.append((file, context.partitionId(), name))
                out.write(text.as_buffer())
        if out is not None:
            out.close()
        return WrittenParts(parts)

    def commit(self, messages: list[WrittenParts | None]) -> None:
        store, base = _store(self.folder)
        _, temporary = _store(self.temporary)
        parts = [part for message in messages if message for part in message.parts]

        def cleared(file: str) -> None:
            if store.get_file_info(f"{base}/file={file}").type != fs.FileType.NotFound:
                store.delete_dir(f"{base}/file={file}")
            store.create_dir(f"{base}/file={file}", recursive=True)

        def moved(part: tuple[str, int, str]) -> None:
            file, number, name = part
            store.move(f"{temporary}/{name}", f"{base}/file={file}/part-{number:05d}")

        with ThreadPoolExecutor(MOVERS) as pool:
            list(pool.map(cleared, sorted({file for file, _, _ in parts})))
            list(pool.map(moved, parts))
        self._cleaned()

    def abort(self, messages: list[WrittenParts | None]) -> None:
        self._cleaned()

    def _cleaned(self) -> None:
        store, base = _store(self.temporary)
        if store.get_file_info(base).type != fs.FileType.NotFound:
            store.delete_dir(base)


class PiecesSource(DataSource):
    """``df.write.format("logweft_pieces").mode("append").option("folder", uri).save()``"""

    @classmethod
    def name(cls) -> str:
        return SOURCE

    def writer(self, schema, overwrite: bool) -> PiecesWriter:
        return PiecesWriter(self.options["folder"])


def write_pieces(pieces: DataFrame, folder: str, whole_files: bool) -> None:
    """Write ``file, section, pos, piece, text`` as folders ``file=<file>``, replacing such folders.

    A file is written by one task, or by several in order unless ``whole_files``. What the commit
    gets is one name per file and task.
    """
    spark = pieces.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    spark.dataSource.register(PiecesSource)
    placed = pieces.repartition("file") if whole_files else pieces.repartitionByRange(*ORDER)
    ordered = placed.sortWithinPartitions(*ORDER).select("file", "text")
    ordered.write.format(SOURCE).mode("append").option("folder", system.makeQualified(path).toString()).save()


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)
