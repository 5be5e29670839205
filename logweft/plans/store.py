"""Analyses saved for later runs, so that yesterday's groups merge with today's logs.

A saved run is a folder of Parquet tables. What counts as saved is said by the manifest: a small
file that lists the runs in order, written under a new number when the tables are complete.
A writer that dies leaves a folder that no manifest names; two that save at once cannot take the same
number, so none loses the other's run.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from logweft.operators import groups as G
from logweft.staging import Staging

TABLES = ("groups", "chunks", "counts")
_MANIFEST, _TRIES = "manifest-", 20


@dataclass(frozen=True)
class Results:
    """Groups, line number chunks and level counts of one run, or of ``batches`` merged ones."""

    groups: DataFrame
    chunks: DataFrame
    counts: DataFrame
    batches: int = 1


def merge_results(staging: Staging, *results) -> Results:
    """Successive analyses or saved results as those of one, earlier ones first; staged."""
    sizes = [getattr(r, "batches", 1) for r in results]
    groups, chunks = G.merge_groups(*[(r.groups, r.chunks) for r in results], sizes=sizes)
    counts = G.merge_counts(*[r.counts for r in results], sizes=sizes)
    return Results(**staging.write_all(groups=groups, chunks=chunks, counts=counts), batches=sum(sizes))


class SavedAnalyses:
    """The analyses saved in a folder that all executors share. Any session can open it again."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._system = self._path().getFileSystem(self._conf)

    def runs(self) -> list[dict]:
        """The saved runs in the order in which they merge: ``id``, ``batches`` and ``note``."""
        return self._manifest()[1]

    def append(self, results, note: str = "") -> str:
        """Save an analysis, or merged results, as the latest run; its id."""
        run = self._written(results, note)
        self._publish(lambda runs: [*runs, run])
        return run["id"]

    def load(self, run: str | None = None) -> list[Results]:
        """The results of all runs, or of one, read where they were saved."""
        known = [r for r in self.runs() if run in (None, r["id"])]
        if run and not known:
            raise ValueError(f"no saved run {run} in {self.folder}")
        return [Results(*[self.spark.read.parquet(f"{self.folder}/{r['id']}/{t}") for t in TABLES], r["batches"]) for r in known]

    def merge(self, staging: Staging, *later) -> Results:
        """The saved runs, and after them ``later`` analyses, as one."""
        found = [*self.load(), *later]
        if not found:
            raise ValueError(f"nothing is saved in {self.folder}")
        return merge_results(staging, *found)

    def compact(self, staging: Staging) -> str:
        """Replace the saved runs by one that holds their merged results; its id.

        Runs that others append meanwhile stay, after it. Replaced folders are left to readers until ``vacuum``.
        """
        old = {r["id"] for r in self.runs()}
        run = self._written(self.merge(staging), f"{len(old)} runs")

        def replaced(runs: list[dict]) -> list[dict]:
            if not old <= {r["id"] for r in runs}:
                raise RuntimeError("the saved runs were replaced meanwhile")
            return [run, *[r for r in runs if r["id"] not in old]]

        self._publish(replaced)
        return run["id"]

    def vacuum(self) -> int:
        """Delete folders that no run uses any more, and old manifests; how many. Not while others read or save."""
        number, runs = self._manifest()
        used = {r["id"] for r in runs} | {_name(number)}
        names = [status.getPath() for status in self._listed()]
        unused = [path for path in names if path.getName() not in used]
        return sum(self._system.delete(path, True) for path in unused)

    def _path(self, name: str = ""):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _listed(self):
        return self._system.listStatus(self._path()) if self._system.exists(self._path()) else []

    def _written(self, results, note: str) -> dict:
        run = {"id": f"run-{uuid.uuid4().hex}", "batches": getattr(results, "batches", 1), "note": note}
        for table in TABLES:
            getattr(results, table).write.parquet(f"{self.folder}/{run['id']}/{table}")
        return run

    def _manifest(self) -> tuple[int, list[dict]]:
        names = [status.getPath().getName() for status in self._listed()]
        number = max((int(n.removeprefix(_MANIFEST)) for n in names if n.startswith(_MANIFEST)), default=0)
        if not number:
            return 0, []
        stream = self._system.open(self._path(_name(number)))
        try:
            return number, json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, change) -> None:
        """Put the changed list of runs under the next number; if another writer took it, change theirs."""
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._system.getUri(), self._conf)
        rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        none = self.spark.sparkContext._gateway.new_array(rename, 0)
        for _ in range(_TRIES):
            number, runs = self._manifest()
            content = json.dumps(change(runs)).encode()
            draft = self._path(f"draft-{uuid.uuid4().hex}")
            stream = self._system.create(draft, False)
            stream.write(content)
            stream.close()
            try:
                files.rename(self._system.makeQualified(draft), self._system.makeQualified(self._path(_name(number + 1))), none)
                return
            except Py4JJavaError as error:
                self._system.delete(draft, False)
                if "FileAlreadyExists" not in str(error.java_exception.toString()):
                    raise
        raise RuntimeError(f"other runs kept saving in {self.folder}")


def _name(number: int) -> str:
    return f"{_MANIFEST}{number:09d}"
