from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from logweft.functions import levels, text, times


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


SHAPES = {
    "2024-02-29": datetime(2024, 2, 29),
    " 20240229 ": datetime(2024, 2, 29),
    "202402291530": datetime(2024, 2, 29, 15, 30),
    "20240229153059": datetime(2024, 2, 29, 15, 30, 59),
    "2024-02-29 15:30": datetime(2024, 2, 29, 15, 30),
    "2024-2-9   5:3:1": datetime(2024, 2, 9, 5, 3, 1),
    "20240229 1530": datetime(2024, 2, 29, 15, 30),
    "2024-02-29 153059": datetime(2024, 2, 29, 15, 30, 59),
}
NOT_TIMES = ["2023-02-29", "2024-2-9", "2024-02-29T10:00", "2024-02-29 25:00", "10:00", "2024022915", "x", "2024-0105", "202401-05", "2024-0105 10:00"]


@pytest.mark.parametrize("written, moment", SHAPES.items())
def test_datetime_text(spark, written, moment):
    assert one(spark, times.parse_datetime_text(F.lit(written))) == moment
    assert times.parse_bound_text(written) == moment


@pytest.mark.parametrize("written", NOT_TIMES)
def test_not_a_datetime(spark, written):
    assert one(spark, times.parse_datetime_text(F.lit(written))) is None
    with pytest.raises(ValueError):
        times.parse_bound_text(written)


def test_end_of_day(spark):
    last = datetime(2024, 2, 29, 23, 59, 59)
    for written in ("2024-02-29", "20240229"):
        assert one(spark, times.parse_datetime_text(F.lit(written), end_of_day=True)) == last
        assert times.parse_bound_text(written, end_of_day=True) == last
    assert times.parse_bound_text("20240229 1000", end_of_day=True) == datetime(2024, 2, 29, 10)


def test_range_of_four_fields():
    assert times.parse_range() == (None, None)
    assert times.parse_range("20240101", "0830", "2024-01-02") == (
        datetime(2024, 1, 1, 8, 30),
        datetime(2024, 1, 2, 23, 59, 59),
    )
    for wrong in (("", "10:00"), ("", "", "", "10:00"), ("2024-01-02", "", "2024-01-01"), ("2024-13-01",), ("2024-0105",), ("202401-05", "10:00")):
        with pytest.raises(ValueError):
            times.parse_range(*wrong)


def test_zones(spark):
    aware = datetime(2024, 1, 1, 8, tzinfo=timezone(timedelta(hours=8)))
    assert times.local_bound(spark, aware) == datetime(2024, 1, 1)
    assert times.local_bound(spark, datetime(2024, 1, 1, 8)) == datetime(2024, 1, 1, 8)
    naive = F.lit("2024-01-01 08:00:00").cast("timestamp_ntz")
    assert one(spark, times.to_wall_clock(naive, "+08:00")) == datetime(2024, 1, 1)


@pytest.mark.parametrize(
    "stamp, moment, bucket",
    [
        ("2024-01-01 10:20:30,999", datetime(2024, 1, 1, 10, 20, 30), "2024-01-01 10:00"),
        ("2024-02-30 10:20:30", None, "2024-02-30 10:00"),
        ("2024-01-01 24:00:00", None, "2024-01-01 24:00"),
        ("0000-01-01 10:00:00", None, "0000-01-01 10:00"),
        ("soon", None, ""),
    ],
)
def test_entry_time(spark, stamp, moment, bucket):
    assert one(spark, times.entry_time(F.lit(stamp))) == moment
    assert one(spark, times.time_bucket(F.lit(stamp))) == bucket


def test_resolve_levels():
    assert levels.resolve_levels(None) == ("ERROR", "WARN", "INFO")
    assert levels.resolve_levels([" warn", "ERROR", "Warn", ""]) == ("WARN", "ERROR")
    assert levels.resolve_levels(["warn", "all"]) == ("ERROR", "WARN", "INFO", "DEBUG", "TRACE")


@pytest.mark.parametrize(
    "level, wanted, selected, rank",
    [
        ("error", ("ERROR",), True, 99),
        ("WARNING", ("WARN",), False, 1),
        ("DEBUG", None, True, 3),
        ("TRACE", (), False, 4),
        ("INFO", (" info ",), True, 2),
    ],
)
def test_levels(spark, level, wanted, selected, rank):
    assert one(spark, levels.level_selected(F.lit(level), wanted)) is selected
    assert one(spark, levels.level_rank(F.lit(level))) == rank


@pytest.mark.parametrize("n, peak, cells", [(1, 1000, 1), (1000, 1000, 18), (5, 36, 2), (7, 36, 4), (1, 4, 4)])
def test_level_bar(spark, n, peak, cells):
    bar = one(spark, levels.level_bar(F.lit(n), F.lit(peak)))
    assert bar == "█" * cells + "░" * (18 - cells)


@pytest.mark.parametrize(
    "raw, kept",
    [
        (b"plain", "plain"),
        (b"a\xffb\xc3\xa9\xe2\x82", "abé"),
        ("mark � kept".encode(), "mark � kept"),
        ("\ufdd0".encode() + b"\xffA", "\ufdd0A"),
        ("\ufdd00\ufdd01�".encode() + b"\xff\xef\xb7", "\ufdd00\ufdd01�"),
        ("mark � kept ".encode() + b"\xfe.", "mark � kept ."),
    ],
)
def test_lenient_utf8(spark, raw, kept):
    df = spark.createDataFrame([(bytearray(raw),)], "raw binary").select(F.col("raw").cast("string").alias("t"))
    assert df.select(text.lenient_utf8(F.col("t"))).first()[0] == kept == raw.decode(errors="ignore")


@pytest.mark.parametrize("value", ["  a b\t\n", "\u3000x\x1f", "\x0b", "", "q"])
def test_strip_like_python(spark, value):
    assert one(spark, text.strip(F.lit(value))) == value.strip()
    assert one(spark, text.rstrip(F.lit(value))) == value.rstrip()
    assert one(spark, text.is_blank(F.lit(value))) is (not value.strip())


@pytest.mark.parametrize(
    "line, starts",
    [
        ("\tat a.B.c(D.java:1)", True),
        ("at ", False),
        ("Caused by: x", True),
        ("  Suppressed: y", True),
        ("... 12 more", True),
        ("...", False),
        ("a.b.MyException", True),
        ("a.b.MyError: why", True),
        ("a.b.MyException  ", True),
        ("an Exception", False),
        ("Exceptional", False),
        ("", False),
        ("   ", False),
    ],
)
def test_trace_start(spark, line, starts):
    assert one(spark, text.starts_trace(F.lit(line))) is starts


@pytest.mark.parametrize(
    "trace, body, message, signature",
    [
        ("   12: a.BException: no\n   13: at x", "CError", "m", "a.BException: no"),
        ("3:", " one\n two Error here \nthree", "m", "two Error here"),
        ("", "Caused by: it", "Error", "Caused by: it"),
        ("", "fine", " an Exception\u2028more", "an Exception"),
        ("", "", "fine", ""),
    ],
)
def test_exception_signature(spark, trace, body, message, signature):
    column = text.exception_signature(F.lit(trace), F.lit(body), F.lit(message))
    assert one(spark, column) == signature


@pytest.mark.parametrize("level, part", [("ERROR", "ERROR"), (" a.b/c-d_é ", "a_b_c-d_é"), ("", "UNKNOWN")])
def test_safe_file_part(spark, level, part):
    assert one(spark, text.safe_file_part(F.lit(level))) == part
