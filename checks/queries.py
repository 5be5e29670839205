"""One query per operator, over the whole derived logs or whole given tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.derived import config_dir, derive_configs, log_dir, log_lines, staging, table
from logweft.functions import levels, text, times
from logweft.functions.layout import Layout, compile_layout, is_header
from logweft.operators import entries as E
from logweft.operators import filters, layouts, reports, summaries
from logweft.operators import groups as G
from logweft.operators.filters import Selection
from logweft.plans import analysis as A
from logweft.plans.store import Results, SavedAnalyses
from logweft.sources import configs, logs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

DEFAULT = compile_layout()
# The bracketed layout of the derived logs, with other words for the same fields.
CUSTOM_LAYOUT = "%d{ISO8601} [%t] %highlight(%-5p){x} ${LOGGER:-%c{36}} - %m%n%wEx"
START, END = datetime(2024, 1, 5, 6, 0, 0), datetime(2024, 1, 20, 18, 30, 0)
LEVELS = ("error", " WARN ")
KEYWORD = "IllegalStateException: bad"
FOLDED_KEYWORD = "TIMEOUTexception"
SPLIT_BYTES = 150_000
# Few rows in a chunk, so that chunks are composed over two levels.
CHUNK_ROWS = 16


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# --- steps shared by the queries -----------------------------------------------------


def _scan(spark, sf_dir) -> DataFrame:
    return logs.as_scan(log_lines(spark, sf_dir))


def _assigned(spark, sf_dir, selection=Selection(), layout: Layout = DEFAULT) -> DataFrame:
    scanned = _scan(spark, sf_dir)
    # These lines are in no order, so the block table carries no decision of the selection.
    blocks, tasks = E.staged_block_table(staging(spark), scanned, layout)
    return E.assign_entries(scanned, blocks, layout, selection, tasks)


def _entries(spark, sf_dir, selection=Selection(), layout: Layout = DEFAULT) -> DataFrame:
    return E.build_entries(E.gather(_assigned(spark, sf_dir, selection, layout)), layout)


def _headers(spark, sf_dir) -> DataFrame:
    return E.header_entries(_scan(spark, sf_dir), DEFAULT)


def _groups(spark, sf_dir) -> DataFrame:
    return G.dedup_groups(_identified(spark, sf_dir))


def _counts(spark, sf_dir) -> DataFrame:
    return G.level_counts(_headers(spark, sf_dir))


def _identified(spark, sf_dir) -> DataFrame:
    """Entries with their group, staged as an analysis does: two aggregations read them."""
    entries = G.with_group_id(_entries(spark, sf_dir)).drop("full_text")
    return staging(spark).write(entries, "entries")


def _staged(spark, sf_dir) -> dict[str, DataFrame]:
    identified = _identified(spark, sf_dir)
    return staging(spark).write_all(
        groups=G.dedup_groups(identified), chunks=G.line_chunks(identified), counts=_counts(spark, sf_dir)
    )


def _fields(groups: DataFrame) -> DataFrame:
    return groups.select(*G.GROUP_FIELDS)


def _numbered(chunks: DataFrame, groups: DataFrame) -> DataFrame:
    """The line numbers of every chunk as text, beside the fields of the group's first entry."""
    found = G.join_chunks(chunks, groups)
    numbers = F.array_join(F.col("lines").cast("array<string>"), ",").alias("line_numbers")
    names = ["filename", "first_line", "count", "batch", "chunk_file", "chunk_no", "n"]
    return found.select(*names, numbers)


def _report(spark, sf_dir, **options) -> reports.Report:
    tables = _staged(spark, sf_dir)
    options = reports.ReportOptions(chunk_rows=CHUNK_ROWS, **options)
    return reports.build_report(staging(spark), tables["groups"], tables["chunks"], tables["counts"], options)


def _lines(report: reports.Report, line_end: str) -> DataFrame:
    """The pieces of a report put together to lines, without line end and byte order mark."""
    parts = F.sort_array(F.collect_list(F.struct("piece", "text")))
    text = F.array_join(F.transform(parts, lambda x: x["text"]), "")
    lines = report.pieces.groupBy("file", "section", "pos").agg(text.alias("text"))
    bare = F.expr(f"substring(text, 1, length(text) - {len(line_end)})")
    return lines.select("file", "section", "pos", F.regexp_replace(bare, f"^{reports.BOM}", "").alias("text"))


# --- sources -------------------------------------------------------------------------


@query
def scan_log_dir(spark, sf_dir):
    scanned = logs.scan_log_dir(spark, log_dir(spark, sf_dir))
    return scanned.select(logs.log_name(F.col("path")).alias("filename"), "value")


@query
def number_lines(spark, sf_dir):
    scanned = logs.scan_log_dir(spark, log_dir(spark, sf_dir))
    return E.number_lines(scanned, E.block_table(scanned, DEFAULT))


@query
def lenient_utf8(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    broken = F.concat(
        F.unhex(F.lit("FFC3")), F.encode("text", "utf-8"), F.unhex(F.lit("E282")), F.encode(F.lit("�."), "utf-8")
    )
    return documents.select("doc_id", text.lenient_utf8(broken.cast("string")).alias("text"))


@query
def sample_lines(spark, sf_dir):
    return logs.sample_lines(log_lines(spark, sf_dir)).select("filename", "line_num", "value")


@query
def scan_layout_configs(spark, sf_dir):
    return configs.extract_candidates(derive_configs(spark, sf_dir)).select(*configs.CANDIDATE)


@query
def dedup_candidates(spark, sf_dir):
    return configs.load_candidates(derive_configs(spark, sf_dir))


@query
def discover_layout_configs(spark, sf_dir):
    return configs.discover_configs(spark, config_dir(spark, sf_dir)).select("config")


# --- headers -------------------------------------------------------------------------


def _parsed(spark, sf_dir, layout: Layout = DEFAULT) -> DataFrame:
    return log_lines(spark, sf_dir).withColumn("parsed", layout.parse(F.col("value")))


@query
def parse_header_default(spark, sf_dir):
    header = F.when(is_header(F.col("parsed")), F.col("parsed"))
    fields = {name: F.nullif(field, F.lit("")) for name, field in DEFAULT.fields(header).items()}
    lines = _parsed(spark, sf_dir).withColumn("is_header", is_header(F.col("parsed")))
    return lines.withColumns(fields).drop("value", "parsed")


@query
def parse_header_custom(spark, sf_dir):
    layout = compile_layout(CUSTOM_LAYOUT)
    headers = _parsed(spark, sf_dir, layout).where(is_header(F.col("parsed")))
    return headers.withColumns(layout.fields(F.col("parsed"))).drop("value", "parsed")


@query
def extract_fields(spark, sf_dir):
    headers = _parsed(spark, sf_dir).where(is_header(F.col("parsed")))
    return headers.withColumns(DEFAULT.fields(F.col("parsed"))).drop("value", "parsed")


# --- entries -------------------------------------------------------------------------


@query
def assign_entries(spark, sf_dir):
    opens = F.col("header").isNotNull().alias("is_header")
    return _assigned(spark, sf_dir).select("filename", "line_num", "entry_line", opens)


@query
def drop_orphans(spark, sf_dir):
    selection = Selection(start=START, end=END)
    kept = _assigned(spark, sf_dir, selection).select("filename", "line_num")
    return kept.join(log_lines(spark, sf_dir), ["filename", "line_num"])


@query
def classify_stacktrace(spark, sf_dir):
    return E.classify_lines(E.gather(_assigned(spark, sf_dir)))


@query
def build_message_body(spark, sf_dir):
    return _entries(spark, sf_dir).select("filename", "line_num", "message_body")


@query
def build_stacktrace(spark, sf_dir):
    return _entries(spark, sf_dir).select("filename", "line_num", "stacktrace")


@query
def build_full_text(spark, sf_dir):
    return _entries(spark, sf_dir).select("filename", "line_num", "full_text")


# --- filters -------------------------------------------------------------------------

_PLACE = ["filename", "line_num", "timestamp", "level"]


@query
def filter_time_range(spark, sf_dir):
    return filters.filter_time_range(_entries(spark, sf_dir), START, END).select(*_PLACE)


@query
def drop_bad_timestamps(spark, sf_dir):
    headers = _parsed(spark, sf_dir).where(is_header(F.col("parsed")))
    return filters.drop_bad_timestamps(headers.withColumns(DEFAULT.fields(F.col("parsed")))).select(*_PLACE)


@query
def filter_level(spark, sf_dir):
    return filters.filter_level(_entries(spark, sf_dir), LEVELS).select(*_PLACE)


@query
def filter_keyword(spark, sf_dir):
    text = F.col("full_text")
    found = F.array_compact(F.array(
        F.when(filters.has_keyword(text, KEYWORD), "exact"),
        F.when(filters.has_keyword(text, FOLDED_KEYWORD, ignore_case=True), "folded"),
    ))
    return _entries(spark, sf_dir).select(*_PLACE, F.explode(found).alias("match"))


@query
def parse_datetime_text(spark, sf_dir):
    stamp = F.col("ts").cast("string")
    date, clock = F.substring(stamp, 1, 10), F.substring(stamp, 12, 8)
    digits = F.regexp_replace(F.substring(stamp, 1, 19), "[^0-9]", "")
    shape = F.col("event_id") % 11
    shaped = (
        F.when(shape == 0, date)
        .when(shape == 1, F.substring(digits, 1, 8))
        .when(shape == 2, F.substring(digits, 1, 12))
        .when(shape == 3, digits)
        .when(shape == 4, F.concat(F.lit(" "), date, F.lit(" "), F.substring(clock, 1, 5)))
        .when(shape == 5, F.concat(date, F.lit("  "), clock))
        .when(shape == 6, F.concat(F.substring(digits, 1, 8), F.lit(" "), F.substring(digits, 9, 4)))
        .when(shape == 7, F.concat(F.substring(digits, 1, 8), F.lit(" "), F.substring(digits, 9, 6)))
        .when(shape == 8, F.concat(F.substring(stamp, 1, 7), F.lit("-30 "), clock))
        .when(shape == 9, F.concat(F.lit("2024-02-31 "), clock))
        .otherwise(F.concat(date, F.lit("T"), clock))
    )
    return table(spark, sf_dir, "events").select(
        "event_id",
        times.parse_datetime_text(shaped).cast("string").alias("start_at"),
        times.parse_datetime_text(shaped, end_of_day=True).cast("string").alias("end_at"),
    )


@query
def normalize_timezone(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    moved = F.substring(times.to_wall_clock(F.col("ts"), "+08:00", "UTC").cast("string"), 1, 19)
    return events.select("event_id", moved.alias("local_time"))


# --- aggregations --------------------------------------------------------------------


@query
def level_counts(spark, sf_dir):
    return _counts(spark, sf_dir).select("level", "n")


@query
def dedup_groups(spark, sf_dir):
    return _fields(_groups(spark, sf_dir))


@query
def collect_line_numbers(spark, sf_dir):
    identified = _identified(spark, sf_dir)
    return _numbered(G.line_chunks(identified), G.dedup_groups(identified))


@query
def first_last_seen(spark, sf_dir):
    return _groups(spark, sf_dir).select(*G.GROUP_KEY, "timestamp", "last_timestamp", "first_line")


@query
def merge_groups(spark, sf_dir):
    """The first half of January and the rest, grouped apart and merged."""
    middle = "2024-01-15 12:00:00"
    identified = _identified(spark, sf_dir)
    moment = F.col("entry_time")
    first = identified.where(moment < F.lit(middle).cast("timestamp_ntz"))
    rest = identified.where(moment >= F.lit(middle).cast("timestamp_ntz"))
    batches = [(G.dedup_groups(half), G.line_chunks(half)) for half in (first, rest)]
    groups, chunks = G.merge_groups(*batches)
    lines = chunks.groupBy("gid").agg(F.count("*").alias("n_chunks"), F.sum("n").alias("n_lines"),
                                      F.sum(F.aggregate("lines", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("line_sum"))
    return groups.join(lines, "gid").select(*G.GROUP_FIELDS, "first_batch", "n_chunks", "n_lines", "line_sum")


@query
def merge_saved_groups(spark, sf_dir):
    """The first half of January saved by another session, and merged with the rest."""
    middle = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    identified, shared = _identified(spark, sf_dir), staging(spark)
    halves = [identified.where(part) for part in (F.col("entry_time") < middle, F.col("entry_time") >= middle)]
    first, rest = (Results(G.dedup_groups(half), G.line_chunks(half), G.level_counts(half)) for half in halves)
    SavedAnalyses(spark, f"{shared.folder}/saved").append(first)
    merged = SavedAnalyses(spark.newSession(), f"{shared.folder}/saved").merge(shared, rest)
    lines = merged.chunks.groupBy("gid").agg(F.count("*").alias("n_chunks"), F.sum("n").alias("n_lines"),
                                             F.sum(F.aggregate("lines", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("line_sum"))
    return merged.groups.join(lines, "gid").select(*G.GROUP_FIELDS, "first_batch", "n_chunks", "n_lines", "line_sum")


@query
def totals(spark, sf_dir):
    return G.totals(_counts(spark, sf_dir), _groups(spark, sf_dir))


@query
def level_summary(spark, sf_dir):
    return G.level_summary(_counts(spark, sf_dir))


@query
def level_bars(spark, sf_dir):
    return summaries.level_bars(_counts(spark, sf_dir))


def _dimension(name: str) -> Query:
    def run(spark, sf_dir):
        return summaries.sort_summary(summaries.dashboard(_groups(spark, sf_dir), name)).drop("dimension")

    return run


QUERIES["exception_summary"] = _dimension("exception")
QUERIES["time_hotspots"] = _dimension("time")
QUERIES["logger_distribution"] = _dimension("logger")
QUERIES["thread_distribution"] = _dimension("thread")


@query
def dashboard(spark, sf_dir):
    return summaries.dashboard(_groups(spark, sf_dir))


@query
def distinct_counts(spark, sf_dir):
    return summaries.distinct_counts(summaries.dashboard(_groups(spark, sf_dir)))


def _scored(spark, sf_dir) -> DataFrame:
    candidates = staging(spark).write(configs.load_candidates(derive_configs(spark, sf_dir)), "candidates")
    return layouts.score_patterns(candidates, log_lines(spark, sf_dir))


@query
def score_patterns(spark, sf_dir):
    return _scored(spark, sf_dir)


@query
def best_pattern(spark, sf_dir):
    return layouts.best_per_config(_scored(spark, sf_dir))


@query
def best_config(spark, sf_dir):
    scored = _scored(spark, sf_dir).where(configs.is_config_name(F.col("config")))
    return layouts.best_pattern(scored)


# --- scalar functions ----------------------------------------------------------------


@query
def exception_signature(spark, sf_dir):
    signature = text.exception_signature(F.col("stacktrace"), F.col("message_body"), F.col("message"))
    return _entries(spark, sf_dir).select("filename", "line_num", signature.alias("signature"))


@query
def time_bucket(spark, sf_dir):
    return _headers(spark, sf_dir).select(
        "filename", "line_num", times.time_bucket(F.col("timestamp")).alias("bucket")
    )


@query
def level_rank(spark, sf_dir):
    return _headers(spark, sf_dir).select(
        "filename", "line_num", levels.level_rank(F.col("level")).alias("level_rank")
    )


@query
def safe_filename_part(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", text.safe_file_part(F.col("url")).alias("part"))


@query
def rendered_size(spark, sf_dir):
    identified = _identified(spark, sf_dir)
    groups, chunks = G.dedup_groups(identified), G.line_chunks(identified)
    csv, md = (
        groups.join(reports.numbers_size(chunks, fmt), "gid").select(
            "gid", "filename", "first_line", reports.item_size(fmt, F.lit("1")).cast("bigint").alias(f"{fmt}_size")
        )
        for fmt in ("csv", "md")
    )
    return csv.join(md.select("gid", "md_size"), "gid").drop("gid")


# --- order ---------------------------------------------------------------------------


@query
def sort_time(spark, sf_dir):
    return _fields(G.sort_groups(_groups(spark, sf_dir), "time"))


@query
def sort_level(spark, sf_dir):
    ranked = levels.level_rank(F.col("level")).alias("level_rank")
    return G.sort_groups(_groups(spark, sf_dir), "level").select(
        ranked, "timestamp", "filename", "first_line", "level", "count"
    )


@query
def sort_summary(spark, sf_dir):
    return summaries.sort_summary(summaries.dashboard(_groups(spark, sf_dir)))


@query
def top5_summary(spark, sf_dir):
    top = summaries.top_summary(summaries.dashboard(_groups(spark, sf_dir)))
    return top.withColumn("rank", F.col("rank").cast("bigint"))


# --- reports -------------------------------------------------------------------------


def _whole_report(fmt: str) -> Query:
    def run(spark, sf_dir):
        return _lines(_report(spark, sf_dir, fmt=fmt, max_bytes=1 << 50), reports.LINE_END[fmt])

    return run


for _fmt in ("csv", "json", "md"):
    QUERIES[f"report_{_fmt}"] = _whole_report(_fmt)


@query
def report_summary(spark, sf_dir):
    lines = _lines(_report(spark, sf_dir, split_by_level=True), "\r\n")
    return lines.where(F.col("file") == "report_summary.csv").select("section", "pos", "text")


@query
def split_by_size(spark, sf_dir):
    return _lines(_report(spark, sf_dir, max_bytes=SPLIT_BYTES), "\r\n")


@query
def split_by_level(spark, sf_dir):
    return _lines(_report(spark, sf_dir, split_by_level=True, max_bytes=1 << 50), "\r\n")


@query
def split_by_level_and_size(spark, sf_dir):
    return _lines(_report(spark, sf_dir, fmt="md", split_by_level=True, max_bytes=SPLIT_BYTES), "\n")


@query
def output_manifest(spark, sf_dir):
    return _report(spark, sf_dir, split_by_level=True, max_bytes=SPLIT_BYTES).manifest


# --- whole analyses ------------------------------------------------------------------


@query
def iter_entries(spark, sf_dir):
    found = A.iter_entries(staging(spark), log_dir(spark, sf_dir), start=START, end=END)
    return found.withColumn("entry_time", F.col("entry_time").cast("string"))


@query
def parse_directory(spark, sf_dir):
    options = A.AnalysisOptions(log_dir(spark, sf_dir), keyword=FOLDED_KEYWORD, ignore_case=True, sort_by="level")
    return A.analyze(staging(spark), options).sorted_groups().drop("gid")


@query
def run_analysis(spark, sf_dir):
    tables = staging(spark)
    options = A.RunOptions(
        log_dir(spark, sf_dir), start=START, output_path=f"{tables.folder}/out/report.md", fmt="md",
        max_bytes=SPLIT_BYTES, split_by_level=True,
    )
    result = A.run(tables, options)
    return result.files.select(
        "*",
        F.lit(result.total_logs).cast("bigint").alias("total_logs"),
        F.lit(result.matched_groups).cast("bigint").alias("matched_groups"),
        F.lit(result.matched_occurrences).cast("bigint").alias("matched_occurrences"),
    )
