"""Lines to entries: a header line and the lines that continue it.

A file may hold a third of all lines, so no step works on a whole file. Lines
are handled per block (a file split, or a bounded run of numbered lines). One
small row per block says how many lines it has and where its first header is;
from these rows come the line offsets and, for the lines before the first
header of a block, the earlier block that owns them. The lines then move once,
to the block that owns their entry, where the entry is put together. If a selection
rejects headers, the rows also say whether the entry that is open at a block's start was
selected, so every line is known to go or stay while its block is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweft.functions.layout import Layout, is_header
from logweft.functions.text import starts_trace, strip
from logweft.functions.times import entry_time
from logweft.operators.filters import Selection, header_selected
from logweft.sources.logs import block_columns, log_name
from logweft.staging import Staging

# A block table of up to this many bytes is broadcast; a row has this many beside its names.
BROADCAST_BYTES, ROW_BYTES = 64 << 20, 96
# Bytes of lines that one task puts together, at most.
TASK_BYTES = 512 << 20
CHANGED = "the file blocks changed between two scans"


def block_table(scanned: DataFrame, layout: Layout, selection: Selection | None = None) -> DataFrame:
    """One row per block: line offset, first header, owner of the lines before it.

    With a selection also ``carried``: whether it selects the entry that these lines belong to.
    """
    block = block_columns(scanned)
    header_pos, last_open = F.when(layout.matches(F.col("value")), F.col("pos")), []
    if selection:
        parsed = F.col("parsed")
        scanned = scanned.withColumn("parsed", F.explode(F.array(layout.parse(F.col("value")))))
        header_pos = F.when(is_header(parsed), F.col("pos"))
        # The last header's mark as one number: its place, and in the lowest bit the decision.
        mark = header_pos * 2 + header_selected(layout, parsed, selection).cast("int")
        last_open = [F.max(mark).alias("last_open")]
    found = scanned.groupBy(*block).agg(
        F.min("pos").alias("first_pos"),
        F.count("*").alias("n_lines"),
        F.sum(F.octet_length("value")).alias("n_bytes"),
        F.min(header_pos).alias("first_header"),
        *last_open,
    )
    if "filename" not in block:
        found = found.withColumn("filename", log_name(F.col("path")))
    order = [name for name in block if name != "filename"]
    in_file = Window.partitionBy("filename").orderBy(*order)
    earlier = in_file.rowsBetween(Window.unboundedPreceding, -1)
    with_header = F.when(F.col("first_header").isNotNull(), F.col("block"))
    if selection:
        carried = F.last("last_open", ignorenulls=True).over(earlier) % 2 == 1
        found = found.withColumn("carried", F.coalesce(carried, F.lit(False))).drop("last_open")
    return (
        found.withColumn("block", F.row_number().over(in_file))
        .withColumn("line_offset", F.coalesce(F.sum("n_lines").over(earlier), F.lit(0)))
        .withColumn("owner", F.last(with_header, ignorenulls=True).over(earlier))
    )


def staged_block_table(
    staging: Staging, scanned: DataFrame, layout: Layout, selection: Selection = Selection()
) -> tuple[DataFrame, int | None]:
    """The block table written once, and how many tasks should assemble the lines.

    It is broadcast to the lines if it is small; only then do lines stay in read order, so that
    what a selection rejects can be dropped while reading. The session's number of shuffle
    partitions is kept (``None``) unless a task would get too many bytes.
    """
    blocks = staging.write(block_table(scanned, layout, selection if selection.by_header else None), "blocks")
    names = sum((F.octet_length(c) for c in block_columns(blocks) if c != "start"), F.lit(ROW_BYTES))
    held, n_bytes = blocks.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in (names, F.col("n_bytes"))]).first()
    tasks = -(-n_bytes // TASK_BYTES)
    usual = int(staging.spark.conf.get("spark.sql.shuffle.partitions"))
    table = F.broadcast(blocks) if held <= BROADCAST_BYTES else blocks.drop("carried")
    return table, (tasks if tasks > usual else None)


def number_lines(scanned: DataFrame, blocks: DataFrame) -> DataFrame:
    """Number the lines of every file from 1 without sorting them."""
    return scanned.join(blocks, block_columns(scanned), "left").select(
        "filename", line_number(scanned).alias("line_num"), "value"
    )


def line_number(scanned: DataFrame) -> Column:
    if "line_num" in scanned.columns:
        return F.col("line_num")
    rank = F.col("pos") - F.col("first_pos")
    seen = F.coalesce((rank >= 0) & (rank < F.col("n_lines")), F.lit(False))
    return F.when(seen, F.col("line_offset") + rank + 1).otherwise(
        F.raise_error(F.lit(CHANGED)).cast("bigint")
    )


def assign_entries(
    scanned: DataFrame,
    blocks: DataFrame,
    layout: Layout,
    selection: Selection = Selection(),
    tasks: int | None = None,
) -> DataFrame:
    """Give every line the line number of the header it belongs to.

    Lines before the first header of a file go, and so do the lines of entries
    whose header the selection rejects. What can be told from the header is
    decided here, before any text is moved for it. If ``blocks`` say what is carried into
    them, lines of rejected entries are not moved at all.
    """
    value, parsed = F.col("value"), F.col("parsed")
    opened = F.when(
        F.col("is_header"), F.when(F.col("selected"), F.col("line_num")).otherwise(F.lit(-1))
    )
    in_block = Window.partitionBy("filename", "owner").orderBy("line_num")
    up_to_here = in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owner = (
        F.when(F.col("n_lines").isNull(), F.raise_error(F.lit(CHANGED)).cast("int"))
        .when(F.col("pos") >= F.col("first_header"), F.col("block"))
        .otherwise(F.col("owner"))
    )
    lines = (
        scanned.join(blocks, block_columns(scanned), "left")
        .select(
            "filename",
            owner.alias("owner"),
            line_number(scanned).alias("line_num"),
            value,
            layout.parse(value).alias("parsed"),
            *[c for c in ("block", "carried") if "carried" in blocks.columns],
        )
        .where(F.col("owner").isNotNull())
        .withColumn("is_header", is_header(parsed))
        .withColumn("selected", F.col("is_header") & header_selected(layout, parsed, selection))
        # A header moves as its fields, a rejected one as a mere mark.
        .withColumn("header", F.when(F.col("selected"), parsed))
        .withColumn("value", F.when(~F.col("is_header"), value))
    )
    columns = [F.col(c) for c in ("filename", "owner", "line_num")] + [opened.alias("opened"), F.col("header"), F.col("value")]
    if "carried" in blocks.columns:
        lines = _selected_lines(lines.select(*columns, "block", "carried"))
    else:
        lines = lines.select(*columns)
    if tasks:
        lines = lines.repartition(tasks, "filename", "owner")
    return (
        lines.withColumn("entry_line", F.last("opened", ignorenulls=True).over(up_to_here))
        .where(F.col("entry_line") > 0)
        .select("filename", "owner", "entry_line", "line_num", "header", "value")
    )


def _selected_lines(lines: DataFrame) -> DataFrame:
    """The lines of selected entries, decided line by line in the order in which blocks are read."""
    kept = lines.drop("block", "carried").schema

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last = False, (None, None, 0)  # of the line before: whether it stays, its log, block and number
        for batch in batches:
            if not batch.num_rows:
                continue
            name, block, number = (batch.column(c) for c in ("filename", "block", "line_num"))
            block, number = block.to_numpy(), number.to_numpy()
            fresh = np.ones(len(block), bool)
            fresh[0] = (name[0].as_py(), block[0]) != last[:2]
            fresh[1:] = (block[1:] != block[:-1]) | pc.not_equal(name[1:], name[:-1]).to_numpy(zero_copy_only=False)
            if (np.diff(number, prepend=last[2]) <= 0)[~fresh].any():
                raise RuntimeError(CHANGED)
            opened = batch.column("opened")
            header = opened.is_valid().to_numpy(zero_copy_only=False)
            said = pc.greater(opened.fill_null(0), 0).to_numpy(zero_copy_only=False)
            said = np.where(fresh & ~header, batch.column("carried").to_numpy(zero_copy_only=False), said)
            # Each line takes what the last line that says something said.
            tells = np.maximum.accumulate(np.where(fresh | header, np.arange(len(said)), -1))
            stays = np.where(tells < 0, state, said[tells])
            state, last = bool(stays[-1]), (name[-1].as_py(), block[-1], number[-1])
            yield batch.filter(pa.array(stays)).select(kept.names)

    return lines.mapInArrow(select, kept)


def gather(assigned: DataFrame) -> DataFrame:
    """One row per entry: its header, its continuation lines, where its trace starts.

    Runs inside the partitions of ``assign_entries``. A line is part of the
    trace if it or an earlier line of the entry starts one, so the smallest such
    line number is all there is to know.
    """
    continued = F.col("header").isNull()
    return assigned.groupBy("filename", "owner", "entry_line").agg(
        F.first("header", ignorenulls=True).alias("header"),
        F.min(F.when(continued & starts_trace(F.col("value")), F.col("line_num"))).alias("trace_from"),
        F.sort_array(F.collect_list(F.when(continued, F.struct("line_num", "value")))).alias("rest"),
    )


def classify_lines(gathered: DataFrame) -> DataFrame:
    """Every continuation line as part of the body or of the trace."""
    line = F.col("line.line_num")
    return gathered.select(
        "filename", "entry_line", "trace_from", F.explode("rest").alias("line")
    ).select(
        "filename",
        "entry_line",
        line.alias("line_num"),
        F.when(line >= F.col("trace_from"), F.lit("trace")).otherwise("body").alias("kind"),
    )


def _joined(lines: Column, text) -> Column:
    return F.array_join(F.transform(lines, text), "\n")


def message_body() -> Column:
    """Body lines joined; empty lines before the first other one vanish."""
    lines = F.filter(
        "rest", lambda x: F.col("trace_from").isNull() | (x["line_num"] < F.col("trace_from"))
    )
    return F.ltrim(_joined(lines, lambda x: x["value"]), F.lit("\n"))


def stacktrace() -> Column:
    """Trace lines with their line numbers, joined, blanks at both ends dropped."""
    lines = F.filter("rest", lambda x: x["line_num"] >= F.col("trace_from"))
    return strip(_joined(lines, lambda x: F.format_string("%5d: %s", x["line_num"], x["value"])))


def build_entries(gathered: DataFrame, layout: Layout) -> DataFrame:
    """Entries with every field, from gathered lines."""
    all_lines = F.transform("rest", lambda x: x["value"])
    fields = layout.fields(F.col("header"))
    return (
        gathered.withColumns(fields)
        .withColumns(
            {
                "entry_time": entry_time(F.col("timestamp")),
                "message_body": message_body(),
                "stacktrace": stacktrace(),
                "full_text": F.concat_ws("\n", F.col("message"), all_lines),
            }
        )
        .select(
            "filename",
            F.col("entry_line").alias("line_num"),
            "timestamp",
            "entry_time",
            "thread",
            "level",
            "logger",
            "message",
            "message_body",
            "stacktrace",
            "full_text",
        )
    )


def header_entries(scanned: DataFrame, layout: Layout, selection: Selection = Selection()) -> DataFrame:
    """The selected headers alone, for what needs no continuation line: no shuffle."""
    parsed = F.col("parsed")
    # Exploding a single value keeps the filter from repeating the regex.
    once = F.explode(F.array(layout.parse(F.col("value")))).alias("parsed")
    return (
        scanned.select("*", once)
        .where(is_header(parsed) & header_selected(layout, parsed, selection))
        .withColumns(layout.fields(parsed))
        .drop("value", "parsed")
    )
