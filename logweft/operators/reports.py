"""Reports as rows of text: CSV, JSON or Markdown, split by size and level.

Rendering, packing into parts and writing all work on rows. A group is one item of
a report, but its line numbers may be many, so its text is written as pieces: what
comes before the numbers, the numbers of each chunk, what comes after. A report file
``report_ERROR_part001.csv`` is the folder ``file=report_ERROR_part001.csv``; its part
files in name order are its content.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweft.functions.text import rstrip, safe_file_part, strip
from logweft.operators.groups import CHUNK, GROUP_FIELDS, first_chunk, join_chunks, report_order
from logweft.operators.packing import CHUNK_ROWS, pack_parts
from logweft.operators.pieces import write_pieces
from logweft.staging import Staging

# Sizes, and the words and layout of the reports.
MAX_PART_BYTES = 50 * 1024 * 1024
BOM = "﻿"
CSV_BLOCK_EXTRA = 3  # every CSV block counts the bytes of a byte order mark
JSON_SEPARATOR = 2  # ",\n" before every item but the first
CSV_COUNTS_TITLE = "--- 統計摘要 ---"
CSV_COUNTS_HEADER = "日誌等級 (Level),出現次數 (Count)"
CSV_ROWS_TITLE = "--- 詳細日誌內容 (已合併重複項) ---"
CSV_ROWS_HEADER = (
    "出現次數,出現行號,第一次時間,最後一次時間,等級,線程,Logger,來源檔案,訊息內容,延伸訊息,堆疊追蹤 (含行號)"
)
CSV_SPLIT_TITLE = "--- 詳細日誌已分割 ---"
CSV_SPLIT_HEADER = "請參考下列檔案"
MD_TITLE = "# Java Log 分析報告"
MD_COUNTS_TITLE = "## 統計摘要"
MD_COUNTS_HEADER = "| 日誌等級 | 數量 |\n| --- | --- |"
MD_ROWS_TITLE = "## 符合條件的詳細日誌"
MD_SPLIT_TITLE = "## 詳細日誌已分割\n請參考下列檔案："
MD_LINES = "- **出現行號**"
MD_TIME_RANGE, MD_TIME_RANGE_TO = "- **時間範圍**", "～"
MD_TIME = "- **出現時間**"
MD_THREAD = "- **線程**"
MD_LOGGER = "- **Logger**"
MD_FILE = "- **來源檔案**"
MD_BODY_TITLE = "#### 延伸訊息:"
MD_TRACE_TITLE = "#### 內容/堆疊追蹤 (含原始行號):"
MD_NO_MATCH = "無符合條件的記錄"
ONE_TASK_BYTES = 1 << 30  # a report file up to this size is written by one task
LINE_END = {"csv": "\r\n", "json": "\n", "md": "\n"}
JSON_ESCAPES = {"\\": "\\\\", '"': '\\"', "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}


@dataclass(frozen=True)
class ReportOptions:
    fmt: str = "csv"
    stem: str = "report"
    suffix: str = ""
    max_bytes: int = MAX_PART_BYTES
    split_by_level: bool = False
    sort_by: str = "time"
    chunk_rows: int = CHUNK_ROWS

    @property
    def extension(self) -> str:
        return self.suffix or f".{self.fmt}"


#: What stands between two line numbers.
NUMBER_SEPARATOR = {"csv": ", ", "json": ",\n" + " " * 16, "md": ", "}


# --- one group as text ---------------------------------------------------------------


def chunk_text(fmt: str) -> Column:
    """The line numbers of one chunk."""
    return F.array_join(F.col("lines").cast("array<string>"), NUMBER_SEPARATOR[fmt])


def _csv_field(text: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[",\r\n]'), quoted).otherwise(text)


def csv_text() -> tuple[Column, Column]:
    fields = F.array(
        *[F.col(name) for name in GROUP_FIELDS[1:8]],
        strip(F.col("message_body")),
        strip(F.col("stacktrace")),
    )
    # Several numbers hold commas and are quoted.
    quote = F.when(F.col("count") > 1, '"').otherwise("")
    before = F.concat(F.col("count").cast("string"), F.lit(","), quote)
    return before, F.concat(quote, F.lit(","), F.array_join(F.transform(fields, _csv_field), ","))


def _json_string(text: Column) -> Column:
    plain = text
    for char, escape in JSON_ESCAPES.items():
        text = F.replace(text, F.lit(char), F.lit(escape))
    rare = text
    for code in sorted(set(range(0x20)) - {ord(char) for char in JSON_ESCAPES}):
        rare = F.replace(rare, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    # Asked of the plain text, so that the usual escapes are made once.
    escaped = F.when(plain.rlike(r"[\x00-\x07\x0b\x0e-\x1f]"), rare).otherwise(text)
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def json_text() -> tuple[Column, Column]:
    """A group as an indented JSON object inside the results list."""
    names = GROUP_FIELDS[1:]
    values = F.transform(F.array(*[F.col(name) for name in names]), _json_string)
    pad, inner = " " * 12, " " * 16
    before = F.concat(
        F.lit(f'        {{\n{pad}"count": '), F.col("count").cast("string"), F.lit(f',\n{pad}"line_numbers": [\n{inner}')
    )
    members = [F.concat(F.lit(f'{pad}"{name}": '), F.get(values, F.lit(i))) for i, name in enumerate(names)]
    return before, F.concat(F.lit(f"\n{pad}],\n"), F.concat_ws(",\n", *members), F.lit("\n        }"))


def md_text(index: Column) -> tuple[Column, Column]:
    def code(title: str, text: Column) -> Column:
        return F.concat(F.lit(f"{title}: `"), text, F.lit("`"))

    def block(title: str, language: str, text: Column) -> Column:
        fenced = F.concat(F.lit(f"{title}\n```{language}\n"), text, F.lit("\n```"))
        return fenced

    once = code(MD_TIME, F.col("timestamp"))
    span = code(
        MD_TIME_RANGE,
        F.concat_ws(f"` {MD_TIME_RANGE_TO} `", F.col("timestamp"), F.col("last_timestamp")),
    )
    body, trace = F.col("message_body"), F.col("stacktrace")
    title = F.concat(F.lit("### "), index, F.lit(". ["), F.col("level"), F.lit("] "), F.col("message"))
    after = F.concat_ws(
        "\n",
        F.lit("`"),
        F.when(F.col("count") > 1, span).otherwise(once),
        code(MD_THREAD, F.col("thread")),
        code(MD_LOGGER, F.col("logger")),
        code(MD_FILE, F.col("filename")),
        F.when(body != "", block(MD_BODY_TITLE, "text", rstrip(body))),
        F.when(trace != "", block(MD_TRACE_TITLE, "java", strip(trace))),
        F.lit("\n---"),
    )
    return F.concat(title, F.lit(f"\n{MD_LINES}: `")), after


def item_text(fmt: str, index: Column) -> tuple[Column, Column]:
    """What a report says of a group before and after its line numbers, without the line end."""
    return {"csv": csv_text, "json": json_text}[fmt]() if fmt != "md" else md_text(index)


def numbers_size(chunks: DataFrame, fmt: str) -> DataFrame:
    """Bytes of all line numbers of every group: ``gid, numbers``.

    The numbers of a chunk are sorted, so where the first has as many digits as the last all have.
    """
    between, many = len(NUMBER_SEPARATOR[fmt]), F.size("lines")
    first, last = (F.length(F.element_at("lines", at).cast("string")) for at in (1, -1))
    digits = F.when(first == last, many * first).otherwise(F.length(F.array_join(F.col("lines").cast("array<string>"), "")))
    size = F.sum((digits + many * between).cast("bigint")) - between
    return chunks.groupBy("gid").agg(size.alias("numbers"))


def rendered_size(text: Column, fmt: str) -> Column:
    """UTF-8 bytes of a block; every CSV block counts a byte order mark."""
    return F.octet_length(text) + (CSV_BLOCK_EXTRA if fmt == "csv" else 0)


def item_size(fmt: str, index: Column) -> Column:
    """UTF-8 bytes of a group's block with ``numbers`` bytes of line numbers, line end included."""
    before, after = item_text(fmt, index)
    line_end = 0 if fmt == "json" else len(LINE_END[fmt])
    return rendered_size(F.concat(before, after), fmt) + F.col("numbers") + line_end


# --- headers and footers -------------------------------------------------------------


def _count_lines(fmt: str) -> Column:
    level, n = F.col("level"), F.col("n").cast("string")
    if fmt == "json":
        return F.concat(_json_string(level), F.lit(": "), n)
    if fmt == "md":
        return F.concat(F.lit("| "), level, F.lit(" | "), n, F.lit(" |"))
    return F.concat_ws(",", _csv_field(level), n)


def _with_counts(fmt: str, counts: Column) -> Column:
    """The text above the rows of a report file, without its last line end."""
    if fmt == "json":
        return F.concat(F.lit('{\n    "summary": {'), counts, F.lit('},\n    "results": ['))
    if fmt == "md":
        return F.concat_ws(
            "\n", F.lit(f"{MD_TITLE}\n\n{MD_COUNTS_TITLE}\n{MD_COUNTS_HEADER}"), counts,
            F.lit(f"\n{MD_ROWS_TITLE}"),
        )
    return F.concat_ws(
        "\r\n", F.lit(f"{CSV_COUNTS_TITLE}\r\n{CSV_COUNTS_HEADER}"), counts,
        F.lit(f"\r\n{CSV_ROWS_TITLE}\r\n{CSV_ROWS_HEADER}"),
    )


def all_counts(counts: DataFrame, fmt: str) -> DataFrame:
    """The level counts as one text (one line per level): JSON as met, others by name."""
    order = F.col("first_seen") if fmt == "json" else F.col("level")
    separator = ", " if fmt == "json" else LINE_END[fmt]
    lines = F.sort_array(F.collect_list(F.struct(order.alias("at"), _count_lines(fmt).alias("text"))))
    joined = F.array_join(F.transform(lines, lambda x: x["text"]), separator)
    return counts.where("n > 0").agg(F.nullif(joined, F.lit("")).alias("counts"))


def report_units(counts: DataFrame, options: ReportOptions, by_level: bool) -> DataFrame:
    """The outputs that are split by size on their own: one, or one per level."""
    fmt = options.fmt
    if by_level:
        units = counts.where("n > 0").select(
            F.col("level").alias("unit"),
            F.col("first_seen").alias("met"),
            F.concat(F.lit(f"{options.stem}_"), safe_file_part(F.col("level"))).alias("stem"),
            _count_lines(fmt).alias("counts"),
        )
    else:
        units = all_counts(counts, fmt).select(
            F.lit("").alias("unit"), F.lit(0).alias("met"), F.lit(options.stem).alias("stem"), "counts"
        )
    head = _with_counts(fmt, F.coalesce("counts", F.lit("")) if fmt == "json" else F.col("counts"))
    size = rendered_size(F.concat(head, F.lit(LINE_END[fmt])), fmt)
    return units.select("unit", "met", "stem", head.alias("head"), size.cast("bigint").alias("opening"))


# --- the report --------------------------------------------------------------------


def report_sizes(groups: DataFrame, chunks: DataFrame, options: ReportOptions, by_level: bool) -> DataFrame:
    """What places a group in a report: its sort columns and rendered size, not its text."""
    # Measured where the text is, so that no text moves to the sizes of the numbers.
    measured = groups.withColumn("numbers", F.lit(0).cast("bigint")).select(
        (F.col("level") if by_level else F.lit("")).alias("unit"),
        "gid",
        "level",
        "timestamp",
        "filename",
        "first_line",
        item_size(options.fmt, F.lit("")).cast("bigint").alias("own"),
    )
    size = (F.col("own") + F.col("numbers")).alias("size")
    return measured.join(numbers_size(chunks, options.fmt), "gid").select(*measured.columns[:-1], size)


def report_positions(sizes: DataFrame, options: ReportOptions) -> DataFrame:
    """The sizes in report order. To be staged: ``pos`` holds the task that wrote a row."""
    ordered = sizes.orderBy("unit", *report_order(options.sort_by))
    return ordered.select("unit", F.monotonically_increasing_id().alias("pos"), "gid", "size")


def assign_parts(staging: Staging, sizes: DataFrame, units: DataFrame, options: ReportOptions) -> DataFrame:
    """The part every group belongs to, and its index in that part."""
    fmt = options.fmt
    separator = JSON_SEPARATOR if fmt == "json" else 0
    # One row per level.
    measured = sizes.join(F.broadcast(units.select("unit", "opening")), "unit").drop("gid")
    parts = pack_parts(staging, measured, options.max_bytes, separator, fmt == "md", options.chunk_rows)
    return sizes.join(parts, ["unit", "pos"]).select("unit", "part_no", "idx", "gid")


def report_files(placed: DataFrame, units: DataFrame, options: ReportOptions) -> DataFrame:
    """One row per report file: its name, its part number and its number of rows."""
    parts = placed.groupBy("unit", "part_no").agg(F.count("*").alias("n_rows"))
    split = placed.groupBy("unit").agg(F.max("part_no").alias("n_parts"))
    numbered = F.when(
        F.col("n_parts") > 1, F.concat(F.lit("_part"), F.format_string("%03d", F.col("part_no")))
    ).otherwise("")
    return (
        units.join(split, "unit", "left")
        .join(parts, "unit", "left")
        .select(
            "unit",
            "met",
            F.coalesce("part_no", F.lit(1)).alias("part_no"),
            F.coalesce("n_parts", F.lit(1)).alias("n_parts"),
            F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
            F.concat(F.col("stem"), numbered, F.lit(options.extension)).alias("file"),
            "head",
        )
    )


def output_manifest(files: DataFrame, options: ReportOptions, with_summary: bool) -> DataFrame:
    """The written files in order: the summary first, then parts as levels were met."""
    # Rows are numbered per output, then shifted by what earlier outputs hold.
    units = files.groupBy("unit", "met").agg(F.count("*").alias("held"))
    earlier = Window.orderBy("met").rowsBetween(Window.unboundedPreceding, -1)
    shifted = units.select("unit", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("shift"))
    listed = files.join(shifted, "unit").select(
        (F.col("shift") + F.col("part_no") - (0 if with_summary else 1)).alias("ordinal"),
        F.col("unit").alias("level"),
        F.col("part_no").cast("bigint").alias("part_no"),
        "file",
    )
    if not with_summary:
        return listed
    summary = files.sparkSession.range(1).select(
        F.lit(0).cast("bigint").alias("ordinal"),
        F.lit("").alias("level"),
        F.lit(0).cast("bigint").alias("part_no"),
        F.lit(f"{options.stem}_summary{options.extension}").alias("file"),
    )
    return summary.unionByName(listed)


def summary_lines(
    counts: DataFrame, manifest: DataFrame, options: ReportOptions, folder: str = ""
) -> DataFrame:
    """The summary file: the counts and the list of the other files."""
    fmt = options.fmt
    name = F.concat(F.lit(f"{folder.rstrip('/')}/" if folder else ""), F.col("file"))
    listed = manifest.where("ordinal > 0")
    if fmt == "json":
        inner = " " * 8
        items = F.regexp_replace(F.col("counts"), ", (?=\")", f",\n{inner}")
        head = F.concat(
            F.lit(f'{{\n    "summary": {{\n{inner}'), items,
            F.lit('\n    },\n    "results": [],\n    "split": {\n        "enabled": true,\n        "files": ['),
        )
        last = manifest.agg(F.max("ordinal")).scalar()
        line = F.concat(
            F.lit(" " * 12), _json_string(name), F.when(F.col("ordinal") < last, ",").otherwise("")
        )
        foot = "        ]\n    }\n}"
    elif fmt == "md":
        head = F.concat_ws(
            "\n", F.lit(f"{MD_TITLE}\n\n{MD_COUNTS_TITLE}\n{MD_COUNTS_HEADER}"), F.col("counts"),
            F.lit(f"\n{MD_SPLIT_TITLE}"),
        )
        line, foot = F.concat(F.lit("- `"), name, F.lit("`")), None
    else:
        head = F.concat_ws(
            "\r\n", F.lit(f"{CSV_COUNTS_TITLE}\r\n{CSV_COUNTS_HEADER}"), F.col("counts"),
            F.lit(f"\r\n{CSV_SPLIT_TITLE}\r\n{CSV_SPLIT_HEADER}"),
        )
        line, foot = _csv_field(name), None
    file = F.lit(f"{options.stem}_summary{options.extension}")
    lines = all_counts(counts, fmt).select(*_line(options, file, 0, F.lit(0), head))
    lines = lines.unionByName(listed.select(*_line(options, file, 1, F.col("ordinal"), line)))
    if foot:
        lines = lines.unionByName(counts.sparkSession.range(1).select(*_line(options, file, 2, F.lit(0), F.lit(foot))))
    return lines


def _line(options: ReportOptions, file: Column, section: int, pos: Column, text: Column) -> list[Column]:
    """A whole line of a report file as a piece."""
    text = F.concat(text, F.lit(LINE_END[options.fmt]))
    if options.fmt == "csv" and section == 0:
        text = F.concat(F.lit(BOM), text)
    return _piece(file, section, pos, text, F.lit(0))


def _piece(file: Column, section: int, pos: Column, text: Column, kind: Column, chunk: Column | None = None) -> list[Column]:
    place = chunk if chunk is not None else F.lit(None).cast("struct<batch:int,chunk_file:string,chunk_no:bigint>")
    return [
        file.alias("file"), F.lit(section).alias("section"), pos.cast("bigint").alias("pos"),
        F.struct(kind.alias("kind"), place.alias("chunk")).alias("piece"), text.alias("text"),
    ]


def report_pieces(
    groups: DataFrame, chunks: DataFrame, placed: DataFrame, files: DataFrame, options: ReportOptions
) -> DataFrame:
    """Every report file as pieces of text: its header, its groups, its end.

    The texts in the order of ``file, section, pos, piece`` are the files' contents.
    """
    fmt = options.fmt
    before, after = item_text(fmt, F.col("idx").cast("string"))
    if fmt == "json":
        after = F.concat(after, F.when(F.col("idx") < F.col("n_rows"), ",").otherwise(""))
    after = F.concat(after, F.lit(LINE_END[fmt]))
    named = placed.join(files.select("unit", "part_no", "file", "n_rows"), ["unit", "part_no"])
    items = groups.join(named.drop("unit", "part_no"), "gid")
    both = F.explode(F.array(F.struct(F.lit(0).alias("kind"), before.alias("text")), F.struct(F.lit(2).alias("kind"), after.alias("text"))))
    rows = items.select(F.col("file"), "idx", both.alias("part"))
    pieces = rows.select(*_piece(F.col("file"), 1, F.col("idx"), F.col("part.text"), F.col("part.kind")))
    where = groups.select("gid", "count", "filename", "first_line", "first_batch").join(named.select("gid", "file", "idx"), "gid")
    numbers = F.concat(F.when(first_chunk(), "").otherwise(NUMBER_SEPARATOR[fmt]), chunk_text(fmt))
    pieces = pieces.unionByName(
        join_chunks(chunks, where).select(*_piece(F.col("file"), 1, F.col("idx"), numbers, F.lit(1), F.struct(*CHUNK)))
    )
    pieces = pieces.unionByName(files.select(*_line(options, F.col("file"), 0, F.lit(0), F.col("head"))))
    if fmt == "json":
        end = F.when(F.col("n_rows") == 0, "\n    ]\n}").otherwise("    ]\n}")
        pieces = pieces.unionByName(files.select(*_line(options, F.col("file"), 2, F.lit(0), end)))
    if fmt == "md":
        nothing = files.where("n_rows = 0").select(*_line(options, F.col("file"), 1, F.lit(0), F.lit(MD_NO_MATCH)))
        pieces = pieces.unionByName(nothing)
    return pieces


@dataclass(frozen=True)
class Report:
    """A report before it is written; all tables are staged."""

    pieces: DataFrame
    manifest: DataFrame


def build_report(
    staging: Staging,
    groups: DataFrame,
    chunks: DataFrame,
    counts: DataFrame,
    options: ReportOptions,
    folder: str = "",
) -> Report:
    """All pieces of all files of a report, and the list of the files.

    ``groups`` come from ``groups.dedup_groups`` and ``chunks`` from ``groups.line_chunks``,
    or both from ``groups.merge_groups``; ``counts`` from ``groups.level_counts``. They are read
    more than once and should be staged. Only sizes are sorted and packed; the texts move to
    their file when they are written, and not before.
    """
    by_level = options.split_by_level and counts.where("n > 0").count() > 1
    units = report_units(counts, options, by_level)
    # Staged before sorting, since finding the ranges of a sort reads its input twice.
    sizes = staging.write(report_sizes(groups, chunks, options, by_level), f"sizes-{options.fmt}")
    sizes = staging.write(report_positions(sizes, options), f"positions-{options.fmt}")
    placed = staging.write(assign_parts(staging, sizes, units, options), f"placed-{options.fmt}")
    files = staging.write(report_files(placed, units, options), f"files-{options.fmt}")
    with_summary = by_level or files.count() > 1
    manifest = output_manifest(files, options, with_summary)
    pieces = report_pieces(groups, chunks, placed, files, options)
    if with_summary:
        pieces = pieces.unionByName(summary_lines(counts, manifest, options, folder))
    return Report(pieces, manifest)


def write_report(
    staging: Staging,
    groups: DataFrame,
    chunks: DataFrame,
    counts: DataFrame,
    folder: str,
    options: ReportOptions,
) -> DataFrame:
    """Write a report and return the list of its files; files of the same names are replaced."""
    report = build_report(staging, groups, chunks, counts, options, folder)
    write_pieces(report.pieces, folder, options.max_bytes <= ONE_TASK_BYTES)
    return staging.write(report.manifest, f"manifest-{options.fmt}")
