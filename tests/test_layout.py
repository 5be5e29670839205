import pytest
from pyspark.sql import functions as F

from logweft.functions.layout import DEFAULT_LAYOUT, UnsupportedLayoutError, compile_layout, is_header

CASES = [
    (None, "2024-03-01 08:00:00.123 [main] INFO  app.Main - up", ("2024-03-01 08:00:00.123", "main", "INFO", "app.Main", "up")),
    (DEFAULT_LAYOUT, "2024-03-01 08:00:00.123 [w-1] WARN  app.Db - slow", ("2024-03-01 08:00:00.123", "w-1", "WARN", "app.Db", "slow")),
    (
        "%d %6p [%t] %c{40} %file#%L - %m%n",
        "2024-03-01 08:00:00,500 ERROR [w-1] app.Db Db.java#77 - broken",
        ("2024-03-01 08:00:00,500", "w-1", "ERROR", "app.Db", "broken"),
    ),
    (
        "%date %5le (%t) %lo{2}: %message%n",
        "2024-03-01 08:00:00,500 INFO  (w-1) Db: ready: yes",
        ("2024-03-01 08:00:00,500", "w-1", "INFO", "Db", "ready: yes"),
    ),
    (
        "${FILE_PATTERN:-%d{${DATE:-yyyy-MM-dd HH:mm:ss.SSS}} ${LEVEL:-%5p} --- [%t] %-40.40logger{39} : %m%n${EX:-%wEx}}",
        "2024-03-01 08:00:00.001  WARN --- [pool 1] app.Job                                  : later",
        ("2024-03-01 08:00:00.001", "pool 1", "WARN", "app.Job", "later"),
    ),
    (
        "<%d> <%p> <%t> %c.%M:%L - %m",
        "<2024-03-01 08:00:00> <INFO> <main> app.web.Page.show:12 - done",
        ("2024-03-01 08:00:00", "main", "INFO", "app.web.Page", "done"),
    ),
    (
        "%highlight(%d) %boldBlue(%replace([%t]){'a','b'}) %-5highlight(%level) %cyan(%c){x} - %m%n",
        "2024-03-01 08:00:00 [t(1)] DEBUG a.B - (x)",
        ("2024-03-01 08:00:00", "t(1)", "DEBUG", "a.B", "(x)"),
    ),
    (
        "%date [%t] %le %lo{5} %X{user} %marker - %message%ex",
        "2024-03-01 08:00:00 [t] info l.Long u1 mk - text here",
        ("2024-03-01 08:00:00", "t", "info", "l.Long", "text here"),
    ),
    ("%d [%t] %p %.-10logger - %m%", "2024-03-01 08:00:00 [t] INFO app.Db - m%", ("2024-03-01 08:00:00", "t", "INFO", "app.Db", "m")),
    ("%d [%t] %p %class %pid - %m", "2024-03-01 08:00:00 [t] INFO a.C 77 - m", ("2024-03-01 08:00:00", "t", "INFO", "a.C", "m")),
    (None, "2024-03-01 08:00:00 [a\x01b] INFO c - \x01", ("2024-03-01 08:00:00", "a\x01b", "INFO", "c", "\x01")),
    (None, "2024-03-01 08:00:00 [] INFO  - ", ("2024-03-01 08:00:00", "", "INFO", "", "")),
]


@pytest.mark.parametrize("pattern, line, expected", CASES)
def test_fields(spark, pattern, line, expected):
    layout = compile_layout(pattern)
    value = F.col("value")
    row = (
        spark.createDataFrame([(line,)], "value string")
        .where(layout.matches(value))
        .select(layout.parse(value).alias("parsed"))
        .where(is_header(F.col("parsed")))
        .select(*[column.alias(name) for name, column in layout.fields(F.col("parsed")).items()])
        .first()
    )
    assert tuple(row) == expected


@pytest.mark.parametrize(
    "line, expected",
    [
        ("2024-03-01 08:00:00.123 [main] INFO a.B -", True),
        ("2024-03-01 08:00:00.123 [main] INFO a.B - ", True),
        ("2024-03-01 08:00:00.123 [main] INFO a.B", False),
        (" 2024-03-01 08:00:00.123 [main] INFO a.B - x", False),
        ("2024-03-01 08:00:00.1 [main] INFO a.B - x", False),
        ("2024-03-01 08:00:00.123 [m\u2028n] ÄRGER a.B -\u3000x\u2028y", True),
        ("2024-03-01 08:00:00 [m\x01n] INFO a.B - x\x01\x01", True),
        ("no\x01header\x01\x01\x01\x01", False),
        ("", False),
    ],
)
def test_header_lines(spark, line, expected):
    df = spark.createDataFrame([(line,)], "value string")
    layout = compile_layout("  ")
    found = df.select(layout.matches(F.col("value")), is_header(layout.parse(F.col("value")))).first()
    assert tuple(found) == (expected, expected)


@pytest.mark.parametrize(
    "pattern, named",
    [
        ("%d [%thread] %level %logger - %clr(%msg)%n", "clr"),
        ("%d [%thread] %level %msg%n", "logger"),
        ("%d %d [%thread] %level %logger - %msg%n", "timestamp"),
        ("plain text", "message"),
    ],
)
def test_unsupported(pattern, named):
    with pytest.raises(UnsupportedLayoutError, match=named):
        compile_layout(pattern)
