import re
from datetime import datetime

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from logweft import analyze, compile_layout, iter_entries
from logweft.operators import entries as E
from logweft.plans.analysis import AnalysisOptions
from logweft.sources.logs import as_scan, sample_lines, sample_log_dir, scan_log_dir

MIXED = """\
lost line
2024-05-01 10:00:00.000 [main] INFO a.Boot - starting

  first
second

2024-05-01 10:00:01.000 [w1] ERROR a.Db - failed
   
a.b.DbException: down
\tat a.b.Db.go(Db.java:3)

plain after
2024-02-30 10:00:02.000 [w1] ERROR a.Db - never
at nowhere
2024-05-01 10:00:03.000 [w2] warn a.Db -
"""


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def found(staging, folder, *columns, **options):
    return rows(iter_entries(staging, folder, **options).orderBy("filename", "line_num"), *columns)


def test_multi_line_entries(staging, logs):
    folder = logs({"a.log": MIXED})
    assert found(staging, folder, "line_num", "level", "message", "message_body", "stacktrace") == [
        (2, "INFO", "starting", "  first\nsecond\n", ""),
        (
            7, "ERROR", "failed", "   ",
            "9: a.b.DbException: down\n   10: \tat a.b.Db.go(Db.java:3)\n   11: \n   12: plain after",
        ),
        (15, "warn", "", "", ""),
    ]
    assert found(staging, folder, "full_text")[1][0].startswith("failed\n   \na.b.DbException: down\n\tat")


def test_time_range_is_closed_and_drops_continuations(staging, logs):
    folder = logs({"a.log": MIXED})
    at = datetime(2024, 5, 1, 10, 0, 1)
    assert found(staging, folder, "line_num", start=at) == [(7,), (15,)]
    assert found(staging, folder, "line_num", end=at) == [(2,), (7,)]
    assert found(staging, folder, "message", start=at, end=at) == [("failed",)]


def test_line_ends_bytes_and_names(staging, logs):
    line = "2024-05-01 10:00:00 [t] INFO a.B - "
    folder = logs(
        {
            "b c+d.log": f"{line}one\r\n more\r{line}two",
            "a.log": line.encode() + b"bad\xff byte\n",
            "c.LOG": f"{line}skipped",
            "d.txt": f"{line}skipped",
        }
    )
    assert found(staging, folder, "filename", "line_num", "full_text") == [
        ("a.log", 1, "bad byte"),
        ("b c+d.log", 1, "one\n more"),
        ("b c+d.log", 3, "two"),
    ]


def test_missing_directory_and_no_logs(spark, staging, logs):
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        scan_log_dir(spark, "/tmp/no/such/place")
    assert found(staging, logs({"x.txt": "nothing"}), "line_num") == []


def by_hand(content, regex):
    """Entries of one file, line by line."""
    entries, current = {}, None
    for number, line in enumerate(content.split("\n")[:-1], 1):
        if re.match(regex, line):
            current = number
            entries[current] = [line]
        elif current:
            entries[current].append(line)
    return entries


@pytest.mark.parametrize("block_bytes", [100, 700])
def test_files_cut_into_many_blocks(spark, staging, logs, block_bytes):
    """Entries that cross blocks, blocks without a header, lines before the first one."""
    parts = ["orphan\n" * 7]
    for i in range(60):
        parts.append(f"2024-05-01 10:{i:02d}:00 [t] INFO a.B - entry {i}\n")
        parts.append(f"more {i}\n" * (i % 5 if i % 30 else 60))
    content = "".join(parts)
    folder = logs({"a.log": content, "b.log": content[100:], "c.log": "only\n" * 50})
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(block_bytes))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        scanned = scan_log_dir(spark, folder)
        blocks, _ = E.staged_block_table(staging, scanned, compile_layout())
        assert blocks.count() > 10
        numbered = E.number_lines(scanned, blocks).where("filename = 'a.log'").orderBy("line_num")
        assert [r["value"] for r in numbered.collect()] == content.split("\n")[:-1]
        got = iter_entries(staging, folder).collect()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    regex = r"2024-\d\d-\d\d \d\d:\d\d:\d\d \["
    for name, text in (("a.log", content), ("b.log", content[100:])):
        expected = {n: "\n".join(e).partition(" - ")[2] for n, e in by_hand(text, regex).items()}
        assert {r["line_num"]: r["full_text"] for r in got if r["filename"] == name} == expected


def test_many_bytes_get_more_tasks(staging, logs, monkeypatch):
    folder = logs({"a.log": MIXED, "b.log": MIXED})
    usual = found(staging, folder, "filename", "line_num", "full_text")
    monkeypatch.setattr(E, "TASK_BYTES", 50)
    layout, scanned = compile_layout(), scan_log_dir(staging.spark, folder)
    blocks, tasks = E.staged_block_table(staging, scanned, layout)
    assert tasks > 4
    assigned = E.assign_entries(scanned, blocks, layout, tasks=tasks)
    assert "REPARTITION" in assigned._jdf.queryExecution().toString()
    assert found(staging, folder, "filename", "line_num", "full_text") == usual


def test_changed_blocks_fail(spark, staging, logs):
    layout = compile_layout()
    scanned = scan_log_dir(spark, logs({"a.log": MIXED * 20}))
    blocks, _ = E.staged_block_table(staging, scanned, layout)
    for wrong in (blocks.withColumn("start", F.col("start") + 1), blocks.withColumn("first_pos", F.lit(10**6))):
        with pytest.raises(Exception, match="changed between two scans"):
            E.assign_entries(scanned, wrong, layout).count()
        with pytest.raises(Exception, match="changed between two scans"):
            E.number_lines(scanned, wrong).collect()


def test_log_written_by_spark_in_parts(spark, staging, tmp_path):
    lines = [f"2024-05-01 10:00:00 [t] INFO a.B - {i}" if i % 3 else f"more {i}" for i in range(200)]
    df = spark.createDataFrame([("x.log", i, v) for i, v in enumerate(lines)], "filename string, i int, value string")
    folder = str(tmp_path / "parted")
    sorted_lines = df.repartitionByRange(5, "i").sortWithinPartitions("i")
    sorted_lines.select("filename", "value").write.partitionBy("filename").text(folder)
    scanned = scan_log_dir(spark, folder)
    numbered = E.number_lines(scanned, E.block_table(scanned, compile_layout()))
    assert rows(numbered.orderBy("line_num"), "filename", "value") == [("x.log", v) for v in lines]


def test_numbered_lines_without_files(spark):
    lines = spark.createDataFrame(
        [("f", 1, "2024-05-01 10:00:00 [t] INFO a.B - x"), ("f", 70_000, "tail"), ("f", 140_000, "end")],
        "filename string, line_num long, value string",
    )
    scanned, layout = as_scan(lines), compile_layout()
    assigned = E.assign_entries(scanned, E.block_table(scanned, layout), layout)
    entries = E.build_entries(E.gather(assigned), layout)
    assert rows(entries, "line_num", "full_text") == [(1, "x\ntail\nend")]


def test_sample_lines(spark, logs):
    folder = logs({"b.log": "b1\nb2\n", "a.log": "\n  \na1\n\u3000\na2\n"})
    for limit in (1, 3, 9):
        expected = [("a1",), ("a2",), ("b1",), ("b2",)][:limit]
        assert rows(sample_lines(scan_log_dir(spark, folder), limit), "value") == expected
        assert sorted(rows(sample_log_dir(spark, folder, limit), "value")) == expected


def test_keyword(staging, logs):
    folder = logs({"a.log": MIXED})

    def messages(keyword, ignore_case=False):
        analysis = analyze(staging, AnalysisOptions(folder, keyword=keyword, ignore_case=ignore_case))
        return {r["message"] for r in analysis.groups.collect()}

    assert messages("DbException") == {"failed"}
    assert messages("dbexception") == set()
    assert messages("DBEXCEPTION", True) == {"failed"}
    assert messages("first\nsecond") == {"starting"}
    assert messages("a.Db") == set()
    assert messages("") == {"starting", "failed", ""}


def test_keyword_folds_other_scripts(spark):
    from logweft.operators.filters import filter_keyword

    df = spark.createDataFrame([("Ärger über ÉTÉ",), ("ok",)], "full_text string")
    assert filter_keyword(df, "ÜBER été", True).count() == 1
    assert df.where(F.col("full_text") == "ok").count() == 1


def shuffled_bytes(spark, action):
    """Bytes that the stages of an action write to shuffles."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    empty = gateway.jvm.java.util.ArrayList()

    def stages():
        found = store.stageList(empty, False, False, gateway.new_array(gateway.jvm.double, 0), empty)
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteBytes() for i in range(found.size())}

    before = set(stages())
    action()
    return sum(n for stage, n in stages().items() if stage not in before)


@pytest.fixture
def in_splits(spark, logs):
    """Two logs of long entries in splits that begin anywhere, with few errors."""
    name = "spark.sql.files.maxPartitionBytes"
    usual = spark.conf.get(name)
    spark.conf.set(name, "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    levels = ["INFO", "DEBUG", "INFO", "ERROR", "error", "WARN", "INFO", "TRACE"]
    text = "lost\n" + "".join(
        f"2024-05-{1 + i % 28 if i % 11 else 31:02d} 10:{i % 60:02d}:00.000 [t{i}] {levels[i * i % 8]} a.B - {i}\n" + f"line {i} {'x' * (i % 90)}\n" * (i % 40) for i in range(400)
    )
    yield logs({"a.log": text, "b.log": text.replace("ERROR", "INFO", 5), "c.log": "x\n" * 500 + text[:2000]})
    spark.conf.set(name, usual)
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize(
    "options",
    [{"levels": ("error",)}, {"levels": ("INFO", "trace"), "start": datetime(2024, 5, 9)}, {"end": datetime(2024, 5, 3)}, {"levels": ()}],
    ids=["level", "both", "time", "none"],
)
def test_rejected_entries_go_while_reading(spark, staging, in_splits, options, monkeypatch):
    columns = ("filename", "line_num", "timestamp", "level", "message", "message_body")
    early = found(staging, in_splits, *columns, **options)
    monkeypatch.setattr(E, "BROADCAST_BYTES", -1)
    late = found(staging, in_splits, *columns, **options)
    assert early == late and (early or options == {"levels": ()})
    assert scan_log_dir(spark, in_splits).select("path", "start").distinct().count() > 20


def test_shuffle_holds_selected_entries_only(spark, staging, in_splits, monkeypatch):
    def read():
        iter_entries(staging, in_splits, levels=("ERROR",)).write.format("noop").mode("overwrite").save()

    early = shuffled_bytes(spark, read)
    everything = shuffled_bytes(spark, lambda: iter_entries(staging, in_splits).write.format("noop").mode("overwrite").save())
    monkeypatch.setattr(E, "BROADCAST_BYTES", -1)
    late = shuffled_bytes(spark, read)
    assert early < 0.4 * late and early < 0.4 * everything


def test_lines_out_of_order_are_noticed(spark):
    rows = [("a.log", 0, 2, None, None, "x", 1, True), ("a.log", 0, 1, None, None, "y", 1, True)]
    lines = spark.createDataFrame(rows, "filename string, owner int, line_num long, opened long, header string, value string, block int, carried boolean")
    with pytest.raises(Exception, match="changed between two scans"):
        E._selected_lines(lines.coalesce(1)).collect()
