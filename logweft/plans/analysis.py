"""The whole analysis: logs in, entries, counts and groups, reports out."""

from __future__ import annotations

import os
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from logweft.functions.layout import compile_layout
from logweft.functions.levels import DEFAULT_LEVELS
from logweft.functions.times import local_bound
from logweft.operators import entries as E
from logweft.operators import groups as G
from logweft.operators import layouts, summaries
from logweft.operators.filters import Selection, filter_keyword
from logweft.operators.reports import MAX_PART_BYTES, ReportOptions, write_report
from logweft.sources.configs import (
    broken_configs,
    dedup_candidates,
    discover_configs,
    extract_candidates,
    read_config,
)
from logweft.sources.logs import sample_log_dir, scan_log_dir
from logweft.staging import Staging


@dataclass(frozen=True)
class AnalysisOptions:
    """What to analyse. ``levels=None`` selects every level."""

    path: str
    start: datetime | None = None
    end: datetime | None = None
    keyword: str | None = None
    ignore_case: bool = False
    layout: str | None = None
    sort_by: str = "time"
    levels: tuple[str, ...] | None = None

    def __post_init__(self):
        if self.sort_by not in ("time", "level"):
            raise ValueError(f"sort_by is time or level, not {self.sort_by}")

    def selection(self, spark: SparkSession) -> Selection:
        return Selection(
            local_bound(spark, self.start),
            local_bound(spark, self.end),
            self.levels,
            self.keyword,
            self.ignore_case,
        )


@dataclass(frozen=True)
class RunOptions(AnalysisOptions):
    """An analysis and its report; the three usual levels unless told otherwise.

    ``output_path`` names the report as a file would be named; its folder
    receives one sub-folder per report file.
    """

    output_path: str = "report.csv"
    fmt: str = "csv"
    levels: tuple[str, ...] | None = DEFAULT_LEVELS
    max_bytes: int | None = None
    split_by_level: bool = False

    def __post_init__(self):
        super().__post_init__()
        if self.fmt.lower() not in ("csv", "json", "md"):
            raise ValueError(f"fmt is csv, json or md, not {self.fmt}")
        if self.max_bytes is not None and self.max_bytes <= 0:
            raise ValueError("max_bytes is a positive number of bytes, or None for the usual one")

    @property
    def folder(self) -> str:
        return os.path.dirname(self.output_path) or "."

    def report(self) -> ReportOptions:
        stem, suffix = os.path.splitext(os.path.basename(self.output_path))
        return ReportOptions(
            self.fmt.lower(), stem, suffix, self.max_bytes or MAX_PART_BYTES, self.split_by_level, self.sort_by
        )


@dataclass(frozen=True)
class Analysis:
    """Staged results of one analysis, valid while its ``Staging`` is open."""

    entries: DataFrame
    counts: DataFrame
    groups: DataFrame
    chunks: DataFrame
    options: AnalysisOptions

    def sorted_groups(self) -> DataFrame:
        """The groups in report order; ``chunks`` has their line numbers by ``gid``."""
        return G.sort_groups(self.groups, self.options.sort_by).select("gid", *G.GROUP_FIELDS)

    def totals(self) -> DataFrame:
        return G.totals(self.counts, self.groups)

    def dashboard(self) -> DataFrame:
        return summaries.sort_summary(summaries.dashboard(self.groups))


@dataclass(frozen=True)
class RunResult:
    options: RunOptions
    analysis: Analysis
    files: DataFrame
    total_logs: int
    matched_groups: int
    matched_occurrences: int


def iter_entries(
    staging: Staging,
    path: str,
    layout: str | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
    levels: tuple[str, ...] | None = None,
) -> DataFrame:
    """The entries of a log directory inside a time range, in no order: sort by filename and line_num where that matters."""
    spark = staging.spark
    selection = Selection(local_bound(spark, start), local_bound(spark, end), levels)
    compiled = compile_layout(layout)
    scanned = scan_log_dir(spark, path)
    blocks, tasks = E.staged_block_table(staging, scanned, compiled, selection)
    assigned = E.assign_entries(scanned, blocks, compiled, selection, tasks)
    return E.build_entries(E.gather(assigned), compiled)


def analyze(staging: Staging, options: AnalysisOptions) -> Analysis:
    """Counts and groups of a log directory. The logs are assembled once and staged."""
    selection = options.selection(staging.spark)
    found = iter_entries(
        staging, options.path, options.layout, selection.start, selection.end, options.levels
    )
    kept = filter_keyword(found, options.keyword, options.ignore_case)
    entries = staging.write(G.with_group_id(kept).drop("full_text", "entry_time"), "entries")
    staged = staging.write_all(
        counts=G.level_counts(entries), groups=G.dedup_groups(entries), chunks=G.line_chunks(entries)
    )
    return Analysis(entries, options=options, **staged)


def merge(staging: Staging, *analyses: Analysis) -> tuple[DataFrame, DataFrame]:
    """The groups and line numbers of successive analyses as those of one, earlier ones first."""
    merged, chunks = G.merge_groups(*[(a.groups, a.chunks) for a in analyses])
    staged = staging.write_all(merged=merged, chunks=chunks)
    return staged["merged"], staged["chunks"]


def detect_layout(staging: Staging, log_dir: str, config: str | None = None) -> DataFrame:
    """The best candidate of one configuration, or of all beside the logs.

    Configurations that are no XML are left out, and so is one without a pattern; if
    ``config`` names such a one, that is an error.
    """
    spark = staging.spark
    configs = read_config(spark, config) if config else discover_configs(spark, log_dir)
    found = staging.write(extract_candidates(configs), "candidates")
    candidates = dedup_candidates(found)
    if config and candidates.isEmpty():
        broken = broken_configs(found).first()
        raise ValueError(f"{config}: {broken['error'] if broken else 'no layout pattern'}")
    scored = layouts.score_patterns(candidates, sample_log_dir(spark, log_dir))
    return layouts.best_pattern(staging.write(scored, "scores"))


def run(staging: Staging, options: RunOptions) -> RunResult:
    """Analyse, write the report and tell what was found; finding nothing is an error."""
    analysis = analyze(staging, options)
    total = analysis.totals().first()
    if total["matched_groups"] == 0:
        raise ValueError("no log entry fits: check the directory, the keyword and the data")
    files = write_report(
        staging, analysis.groups, analysis.chunks, analysis.counts, options.folder, options.report()
    )
    return RunResult(options, analysis, files, *total)
