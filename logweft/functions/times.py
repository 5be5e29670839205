"""Log times. All of them are wall-clock times, so TIMESTAMP_NTZ throughout."""

from __future__ import annotations

import re
from datetime import datetime, time
from zoneinfo import ZoneInfo

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from logweft.functions.text import DIGIT, SPACE, strip


def entry_time(timestamp: Column) -> Column:
    """The second of a raw log timestamp; NULL when there is no such date."""
    second = F.substring(timestamp, 1, 19)
    return F.when(~second.startswith("0000"), second.try_cast("timestamp_ntz"))


def time_bucket(timestamp: Column) -> Column:
    """The hour a raw log timestamp falls in, or the empty string."""
    text = strip(timestamp)
    return F.when(
        F.length(text) >= 13, F.concat(F.substring(text, 1, 13), F.lit(":00"))
    ).otherwise("")


def in_range(moment: Column, start: datetime | None, end: datetime | None) -> Column:
    """Both bounds belong to the range, a missing one leaves it open."""
    inside = moment.isNotNull()
    if start is not None:
        inside = inside & (moment >= F.lit(start.isoformat(" ")).cast("timestamp_ntz"))
    if end is not None:
        inside = inside & (moment <= F.lit(end.isoformat(" ")).cast("timestamp_ntz"))
    return inside


def to_wall_clock(moment: Column, source_zone: str, local_zone: str | None = None) -> Column:
    """Wall-clock time of one zone as wall-clock time of the local one."""
    target = F.lit(local_zone) if local_zone else F.current_timezone()
    return F.convert_timezone(F.lit(source_zone), target, moment)


def local_bound(spark: SparkSession, bound: datetime | None) -> datetime | None:
    """A bound without a zone is local already, one with a zone is moved there."""
    if bound is None or bound.tzinfo is None:
        return bound
    zone = ZoneInfo(spark.conf.get("spark.sql.session.timeZone"))
    return bound.astimezone(zone).replace(tzinfo=None)


def parse_datetime_text(text: Column, end_of_day: bool = False) -> Column:
    """Read a date with an optional time in any of the accepted shapes.

    Digits only: ``yyyyMMdd``, ``yyyyMMddHHmm``, ``yyyyMMddHHmmss``. Otherwise a
    date (``yyyy-MM-dd`` or ``yyyyMMdd``), blanks, and a time (``HH:mm``,
    ``HH:mm:ss``, ``HHmm``, ``HHmmss``). Anything else is NULL.
    """
    clean, d = strip(text), DIGIT
    rewrites = [
        (rf"\A({d}{{8}})({d}{{4}}(?:{d}{{2}})?)\z", "$1 $2"),
        (rf"\A({d}{{4}})({d}{{2}})({d}{{2}})(?!{d})", "$1-$2-$3"),
        (rf"({SPACE}{d}{{2}})({d}{{2}})({d}{{2}})\z", "$1:$2:$3"),
        (rf"({SPACE}{d}{{2}})({d}{{2}})\z", "$1:$2"),
    ]
    spaced = clean
    for regex, replacement in rewrites:
        spaced = F.regexp_replace(spaced, regex, replacement)
    day = rf"\A{d}{{4}}-{d}{{2}}-{d}{{2}}\z"
    day_and_time = (
        rf"\A(?=.* ){d}{{4}}-{d}{{1,2}}-{d}{{1,2}}{SPACE}+{d}{{1,2}}:{d}{{1,2}}(?::{d}{{1,2}})?\z"
    )
    shaped = F.when(
        spaced.rlike(day), F.concat(spaced, F.lit(" 23:59:59" if end_of_day else " 00:00:00"))
    ).when(spaced.rlike(day_and_time), F.regexp_replace(spaced, rf"{SPACE}+", " "))
    return F.when(~shaped.startswith("0000"), shaped.try_cast("timestamp_ntz"))


_DATE = re.compile(r"(\d{4})(\d{2})(\d{2})|(\d{4})-(\d{1,2})-(\d{1,2})")
_WHOLE_DAY = re.compile(r"\d{4}-\d{2}-\d{2}|\d{8}")
_CLOCK = re.compile(r"(\d{2})(\d{2})(\d{2})?|(\d{1,2}):(\d{1,2})(?::(\d{1,2}))?")


def parse_bound(date_text: str, time_text: str = "", end_of_day: bool = False) -> datetime | None:
    """One bound of a range from a date field and a time field (an option, not data)."""
    date_text, time_text = date_text.strip(), time_text.strip()
    if not date_text:
        if time_text:
            raise ValueError("a time needs a date")
        return None
    date = _DATE.fullmatch(date_text)
    clock = _CLOCK.fullmatch(time_text)
    if date is None or (time_text and clock is None):
        raise ValueError(f"not a date and time: {date_text} {time_text}".rstrip())
    day = datetime(*[int(part) for part in date.groups() if part])
    if clock is None:
        return datetime.combine(day, time(23, 59, 59)) if end_of_day else day
    return datetime.combine(day, time(*[int(part) for part in clock.groups() if part]))


def parse_bound_text(text: str | None, end_of_day: bool = False) -> datetime | None:
    """One bound written as a single text, in the shapes of ``parse_datetime_text``."""
    clean = (text or "").strip()
    if clean.isdecimal() and len(clean) in (12, 14):
        return parse_bound(clean[:8], clean[8:])
    date_text, _, time_text = clean.partition(" ")
    if date_text and not time_text and not _WHOLE_DAY.fullmatch(date_text):
        raise ValueError(f"not a date: {date_text}")
    return parse_bound(date_text, time_text, end_of_day)


def parse_range(
    start_date: str = "", start_time: str = "", end_date: str = "", end_time: str = ""
) -> tuple[datetime | None, datetime | None]:
    """A range from four text fields; an end date alone runs to its last second."""
    start = parse_bound(start_date, start_time)
    end = parse_bound(end_date, end_time, end_of_day=True)
    if start is not None and end is not None and start > end:
        raise ValueError("the range starts after it ends")
    return start, end
