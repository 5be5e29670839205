"""Log levels: selection, rank and the bar of the level table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
ALL_LEVELS = ("ERROR", "WARN", "INFO", "DEBUG", "TRACE")
DEFAULT_LEVELS = ("ERROR", "WARN", "INFO")
LEVEL_RANK = {"ERROR": 0, "WARN": 1, "WARNING": 1, "INFO": 2, "DEBUG": 3, "TRACE": 4}
OTHER_RANK = 99
BAR_WIDTH = 18
BAR_FULL, BAR_EMPTY = "█", "░"


def resolve_levels(chosen: Iterable[str] | None) -> tuple[str, ...]:
    """The levels a user's choice stands for; no choice means the default three."""
    names = [name.strip().upper() for name in chosen or ()]
    if not names:
        return DEFAULT_LEVELS
    if "ALL" in names:
        return ALL_LEVELS
    return tuple(dict.fromkeys(name for name in names if name))


def level_selected(level: Column, levels: Iterable[str] | None) -> Column:
    """``None`` selects every level, an empty selection none."""
    if levels is None:
        return F.lit(True)
    wanted = sorted({str(name).strip().upper() for name in levels} - {""})
    return F.upper(level).isin(wanted) if wanted else F.lit(False)


def level_rank(level: Column) -> Column:
    ranks = F.create_map(*[F.lit(item) for pair in LEVEL_RANK.items() for item in pair])
    return F.coalesce(F.try_element_at(ranks, level), F.lit(OTHER_RANK))


def level_bar(count: Column, maximum: Column) -> Column:
    cells = F.bround(count / maximum * BAR_WIDTH, 0).cast("int")
    cells = F.least(F.greatest(cells, F.lit(1)), F.lit(BAR_WIDTH))
    return F.concat(
        F.repeat(F.lit(BAR_FULL), cells), F.repeat(F.lit(BAR_EMPTY), F.lit(BAR_WIDTH) - cells)
    )
