"""Which entries count: by time, level and keyword."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweft.functions.layout import Layout
from logweft.functions.levels import level_selected
from logweft.functions.times import entry_time, in_range


@dataclass(frozen=True)
class Selection:
    """Bounds are wall-clock times; ``levels=None`` selects every level."""

    start: datetime | None = None
    end: datetime | None = None
    levels: tuple[str, ...] | None = None
    keyword: str | None = None
    ignore_case: bool = False

    @property
    def by_header(self) -> bool:
        """Whether headers with a real date may be rejected."""
        return any(x is not None for x in (self.start, self.end, self.levels))


def header_selected(layout: Layout, parsed: Column, selection: Selection) -> Column:
    """What the header alone decides: a real date, the time range, the level."""
    moment = entry_time(layout.field(parsed, "timestamp"))
    chosen = in_range(moment, selection.start, selection.end)
    if selection.levels is not None:
        chosen = chosen & level_selected(layout.field(parsed, "level"), selection.levels)
    return chosen


def filter_time_range(
    entries: DataFrame, start: datetime | None = None, end: datetime | None = None
) -> DataFrame:
    """Entries inside the range; one without a real date is in no range, even an open one."""
    return entries.where(in_range(entry_time(F.col("timestamp")), start, end))


def drop_bad_timestamps(entries: DataFrame) -> DataFrame:
    return filter_time_range(entries)


def filter_level(entries: DataFrame, levels: tuple[str, ...] | None) -> DataFrame:
    return entries.where(level_selected(F.col("level"), levels))


def has_keyword(text: Column, keyword: str, ignore_case: bool = False) -> Column:
    wanted = F.lit(keyword)
    return F.contains(F.lower(text), F.lower(wanted)) if ignore_case else F.contains(text, wanted)


def filter_keyword(entries: DataFrame, keyword: str | None, ignore_case: bool = False) -> DataFrame:
    """Entries whose message or continuation lines contain the keyword as written."""
    return entries.where(has_keyword(F.col("full_text"), keyword, ignore_case)) if keyword else entries
