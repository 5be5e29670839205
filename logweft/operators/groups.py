"""Entries that say the same, merged and counted.

A group may hold a third of all entries. Counts and first/last values are
aggregated before the shuffle, so they never meet as rows. A group is always one
row. Its line numbers are the rows of a child table, one per bounded run of lines
of a file (a chunk), so no value grows with the group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweft.functions.levels import level_rank
from logweft.sources.logs import LINES_PER_BLOCK, block_columns, log_name

GROUP_KEY = ["level", "logger", "message", "message_body", "stacktrace"]
GROUP_FIELDS = [
    "count",
    "timestamp",
    "last_timestamp",
    "level",
    "thread",
    "logger",
    "filename",
    "message",
    "message_body",
    "stacktrace",
]
CHUNK = ["batch", "chunk_file", "chunk_no"]
# A share of all entries that few groups can hold: at most so many do.
LARGE_GROUPS = 1_000
# Bits of an encounter number that hold the line; the others hold the rank of the log's name.
LINE_BITS = 40
# Lines that the bits of one number stand for.
WORD = 64


def group_id() -> Column:
    """A 256-bit digest of the group key: short to shuffle, sort and join on."""
    parts = [F.concat(F.length(name).cast("string"), F.lit(":"), F.col(name)) for name in GROUP_KEY]
    digest = F.unhex(F.sha2(F.concat(*parts), 256))
    # Never NULL, and known to be, so that joins on it need no filter of their own.
    return F.coalesce(digest, F.lit(bytearray()))


def with_group_id(entries: DataFrame) -> DataFrame:
    return entries.withColumn("gid", group_id())


def level_counts(entries: DataFrame) -> DataFrame:
    """Entries per level as written, and where each level was met first."""
    if "pos" in entries.columns:
        place, line = block_columns(entries), "pos"
    else:
        place, line = ["filename"], "line_num"
    # Counting per place first keeps the large aggregation on plain numbers.
    counted = entries.groupBy("level", *place).agg(F.count("*").alias("n"), F.min(line).alias("line"))
    if "filename" not in place:
        counted = counted.withColumn("filename", log_name(F.col("path")))
        place = ["filename", *place]
    return counted.groupBy("level").agg(
        F.sum("n").alias("n"), F.min(F.struct(*place, "line")).alias("first_seen")
    )


def level_summary(counts: DataFrame) -> DataFrame:
    return counts.where("n > 0").select("level", "n").orderBy("level")


def with_encounter(identified: DataFrame) -> DataFrame:
    """Entries with ``encounter``: one number that orders them by log name and line.

    So first and last encounters are plain minima and maxima, which hash. The logs' names are
    ranked in a table of their own, a row for each log, and broadcast: dealt by name, the entries
    of a log would meet in one task.
    """
    names = identified.groupBy("filename").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.orderBy("filename")).cast("bigint")
    names = names.select("filename", rank.alias("log_no"))
    line = F.when(F.col("line_num") < 1 << LINE_BITS, F.col("line_num")).otherwise(
        F.raise_error(F.lit("a log has too many lines to number its entries")).cast("bigint")
    )
    numbered = F.shiftleft("log_no", LINE_BITS).bitwiseOR(line)
    return identified.join(F.broadcast(names), "filename").withColumn("encounter", numbered).drop("log_no")


def dedup_groups(identified: DataFrame) -> DataFrame:
    """One row per group: count, first and last encounter.

    Counted and found on numbers alone; the texts come from the one entry that a group was met
    first in. ``identified`` is read three times and should be staged.
    """
    numbered = with_encounter(identified)
    met = numbered.groupBy("gid").agg(
        F.count("*").alias("count"), F.min("encounter").alias("encounter"), F.max("encounter").alias("last")
    )
    last = numbered.select(F.col("encounter").alias("last"), F.col("timestamp").alias("last_timestamp"))
    last = last.join(met.where("count > 1").select("last"), "last")
    # The texts move once, when all that is known of a group besides them is known. They are merged even
    # where the groups could be broadcast: else a task reads all that one task before it has moved.
    return numbered.drop("gid").join(met.join(last, "last", "left").hint("merge"), "encounter").select(
        "gid",
        "count",
        "timestamp",
        F.coalesce("last_timestamp", "timestamp").alias("last_timestamp"),
        "level",
        "thread",
        "logger",
        "filename",
        "message",
        "message_body",
        "stacktrace",
        F.col("line_num").alias("first_line"),
        F.lit(0).alias("first_batch"),
    )


def line_chunks(identified: DataFrame, batch: int = 0) -> DataFrame:
    """The line numbers of a group inside one bounded run of lines of one file.

    Lines are gathered as bits first, 64 in one number: a hash aggregate that shrinks hot groups before
    they are shuffled. At most a thousand such numbers make a chunk; none reaches over the end of a chunk.
    """
    width, line = min(WORD, LINES_PER_BLOCK), F.col("line_num")
    bit = F.expr(f"shiftleft(1L, CAST(line_num % {width} AS INT))")
    words = identified.groupBy("gid", "filename", F.floor(line / width).alias("word")).agg(F.bit_or(bit).alias("bits"))
    runs = words.groupBy(
        "gid",
        F.lit(batch).alias("batch"),
        F.col("filename").alias("chunk_file"),
        F.floor(F.col("word") * width / LINES_PER_BLOCK).alias("chunk_no"),
    ).agg(
        F.sum(F.bit_count("bits")).alias("n"), F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words")
    )
    return runs.withColumn("lines", F.flatten(F.transform("words", lambda run: _lines_of(run, width)))).drop("words")


def _lines_of(run: Column, width: int) -> Column:
    """The line numbers that a word's bits stand for, in order."""
    first, bits = run["word"] * width, run["bits"]
    alone = F.array(first + F.length(F.bin(bits)) - 1)
    several = F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.bit_get(bits, i) == 1)
    return F.when(F.bit_count(bits) == 1, alone).otherwise(F.transform(several, lambda i: first + i))


def merge_groups(*batches: tuple[DataFrame, DataFrame], sizes: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Merge (groups, line chunks) of successive runs, earlier ones first.

    A batch that was merged before counts as the ``sizes`` batches it was merged from, one unless said.
    """
    union, lines, before = None, None, 0
    for number, (groups, chunks) in enumerate(batches):
        numbered = groups.withColumn("first_batch", F.col("first_batch") + before)
        chunks = chunks.withColumn("batch", F.col("batch") + before)
        union = numbered if union is None else union.unionByName(numbered)
        lines = chunks if lines is None else lines.unionByName(chunks)
        before += sizes[number] if sizes else 1
    columns = batches[0][0].columns
    met = union.groupBy("gid").agg(
        F.sum("count").alias("count"), F.min("first_batch").alias("first_batch"), F.max("first_batch").alias("last_batch")
    )
    # A group is in a batch once, so these are its first and its last row.
    first = union.drop("count").join(met, ["gid", "first_batch"])
    last = union.select("gid", F.col("first_batch").alias("last_batch"), F.col("last_timestamp").alias("latest"))
    last = last.join(met.where("last_batch > first_batch").select("gid", "last_batch"), ["gid", "last_batch"])
    merged = first.join(last.select("gid", "latest"), "gid", "left")
    return merged.withColumn("last_timestamp", F.coalesce("latest", "last_timestamp")).select(*columns), lines


def merge_counts(*batches: DataFrame, sizes: list[int] | None = None) -> DataFrame:
    """The level counts of successive runs as those of one; levels in the order they were met, earlier runs first."""
    union, before = None, 0
    for number, counts in enumerate(batches):
        fields = [field.name for field in counts.schema["first_seen"].dataType.fields]
        batch = (F.col("first_seen.batch") if "batch" in fields else F.lit(0)) + before
        place = [F.col(f"first_seen.{name}") for name in fields if name != "batch"]
        numbered = counts.select("level", "n", F.struct(batch.alias("batch"), *place).alias("first_seen"))
        union = numbered if union is None else union.unionByName(numbered)
        before += sizes[number] if sizes else 1
    return union.groupBy("level").agg(F.sum("n").alias("n"), F.min("first_seen").alias("first_seen"))


def first_chunk() -> Column:
    """Whether a chunk is the one that its group was met first in."""
    return (
        (F.col("batch") == F.col("first_batch"))
        & (F.col("chunk_file") == F.col("filename"))
        & (F.col("chunk_no") == F.floor(F.col("first_line") / LINES_PER_BLOCK))
    )


def join_chunks(chunks: DataFrame, groups: DataFrame) -> DataFrame:
    """Chunks with what ``groups`` (gid, count, ...) say about their group.

    Groups that hold a thousandth of all entries or more are at most a thousand rows, and
    are broadcast. So the chunks of a hot group stay where they are, and none of the others
    is large.
    """
    total = groups.agg(F.coalesce(F.sum("count"), F.lit(0))).scalar()
    large = F.broadcast(groups.where(F.col("count") * LARGE_GROUPS >= total))
    rest = chunks.join(large.select("gid"), "gid", "left_anti")
    return chunks.join(large, "gid").unionByName(rest.join(groups, "gid"))


def totals(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """One row: entries, groups, entries in groups."""
    matched = groups.agg(
        F.count("*").alias("matched_groups"),
        F.coalesce(F.sum("count"), F.lit(0)).alias("matched_occurrences"),
    )
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_logs"))
    return matched.select(total.scalar().alias("total_logs"), "*")


def report_order(sort_by: str = "time") -> list[Column]:
    """Sort columns: the timestamp text, or the level rank before it; then first met."""
    order = [F.col(c) for c in ("timestamp", "filename", "first_line")]
    return [level_rank(F.col("level")), *order] if sort_by == "level" else order


def sort_groups(groups: DataFrame, sort_by: str = "time") -> DataFrame:
    return groups.orderBy(*report_order(sort_by))
