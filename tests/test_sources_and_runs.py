import io
import os
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from logweft import AnalysisOptions, RunOptions, Staging, analyze, detect_layout, iter_entries, run
from logweft.operators import layouts
from logweft.sources import configs, logs
from logweft.sources.hidden import lines_between
from logweft.sources.logs import log_name, sample_log_dir, scan_log_dir
from logweft.staging import shared_folder

CONFIG = """<?xml version="1.0" encoding="UTF-8"?>
<configuration xmlns="http://example.org/ns">
  <property name="CONSOLE_PATTERN" value=" %d [%t] %6p %c - %m%n "/>
  <property name="log.pattern" value="none"/>
  <property name="DIR" value="%tmp"/>
  <property value="%x" />
  <appender name="OUTER"><appender name="INNER"><encoder>
    <Pattern><![CDATA[%d %p [%t] %c{1}: %m%n]]><!-- c --> </Pattern>
  </encoder></appender></appender>
  <appender name="SAME"><layout><pattern>%d [%t] %6p %c - %m%n</pattern></layout></appender>
  <x:pattern xmlns:x="http://example.org/x">%d %clr(%m)</x:pattern>
  <pattern>plain</pattern>
</configuration>
"""
LINES = "".join(f"2024-05-01 10:00:{i:02d},000 INFO [t] Db: m{i}\n\n" for i in range(40))


def test_candidates(spark, logs):
    folder = logs({"LOGBACK-test.Xml": CONFIG, "other.xml": CONFIG, "logback.txt": CONFIG})
    found = configs.load_candidates(configs.discover_configs(spark, folder)).orderBy("ordinal").collect()
    assert [(r["config"], r["name"], r["pattern"], r["source"]) for r in found] == [
        ("LOGBACK-test.Xml", "CONSOLE_PATTERN", "%d [%t] %6p %c - %m%n", "property"),
        ("LOGBACK-test.Xml", "OUTER Pattern", "%d %p [%t] %c{1}: %m%n", "encoder"),
        ("LOGBACK-test.Xml", "Pattern", "%d %clr(%m)", "encoder"),
    ]


def test_configurations_are_listed_by_a_task(spark, logs, tmp_path):
    """The driver holds no file of the directory, however many there are."""
    folder = logs({f"{'Ll'[i % 2]}ogback-{i}.xM{'Ll'[i % 2]}": f"<a>{i}</a>" for i in range(300)})
    found = configs.discover_configs(spark, f"file://{folder}")
    assert found.inputFiles() == []
    assert {(r.config, bytes(r.xml)) for r in found.collect()} == {(f"{'Ll'[i % 2]}ogback-{i}.xM{'Ll'[i % 2]}", f"<a>{i}</a>".encode()) for i in range(300)}
    names = found.select("config")
    assert names.count() == names.distinct().count() == 300
    assert "BatchEvalPython" not in names._jdf.queryExecution().optimizedPlan().toString()


def test_odd_names_of_configurations(spark, logs, tmp_path):
    folder = logs({"logback a+%20é.xml": "<b/>", "logback.xml": "<c/>", "xlogback.xml": "", "logback.xml.bak": "", ".logback.xml": ""})
    with open(os.path.join(folder.encode(), b"logback-\xff.xml"), "wb") as file:
        file.write(b"<d/>")
    for name in ("logback-dir.xml", "sub", "filename=a.log"):  # one with part files of a log is no reason to skip others
        os.mkdir(os.path.join(folder, name))
        for inside in ("logback-in.xml", "part-0"):
            with open(os.path.join(folder, name, inside), "w") as file:
                file.write("<in/>")
    os.symlink(os.path.join(folder, "logback.xml"), os.path.join(folder, "logback-link.xml"))
    os.symlink(os.path.join(folder, "none"), os.path.join(folder, "logback-broken.xml"))
    expected = [("logback a+%20é.xml", b"<b/>"), ("logback-.xml", b"<d/>"), ("logback-link.xml", b"<c/>"), ("logback.xml", b"<c/>")]
    got = [(r.config, bytes(r.xml)) for r in configs.discover_configs(spark, folder).collect()]
    assert sorted(got) == sorted(expected)
    other = tmp_path / "logs2"
    other.mkdir()
    (other / "logback-o.xml").write_text("<o/>")
    both = configs.discover_configs(spark, f"{tmp_path}/logs*").select("config").collect()
    assert sorted(r.config for r in both) == sorted([*[name for name, _ in expected], "logback-o.xml"])
    assert configs.discover_configs(spark, f"{folder}/sub").count() == 1
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        configs.discover_configs(spark, f"{folder}/none")


def test_best_layout(spark, staging, logs):
    folder = logs({"logback-a.xml": CONFIG, "logback-b.xml": CONFIG, "a.log": LINES + "tail\n" * 30})
    best = detect_layout(staging, folder).first()
    assert (best["config"], best["name"], best["matches"], best["checked"]) == ("logback-a.xml", "OUTER Pattern", 40, 50)
    assert best["score"] == 0.8
    one = detect_layout(staging, folder, os.path.join(folder, "logback-b.xml")).first()
    assert one["config"] == "logback-b.xml"
    assert detect_layout(staging, folder, os.path.join(folder, "logback-b.xml")).count() == 1


def test_scores_without_lines(spark, tmp_path):
    (tmp_path / "logback.xml").write_text(CONFIG)
    folder = str(tmp_path)
    candidates = configs.load_candidates(configs.discover_configs(spark, folder))
    scored = layouts.score_patterns(candidates, logs.sample_lines(logs.scan_log_dir(spark, folder)))
    assert {(r["matches"], r["checked"], r["score"]) for r in scored.collect()} == {(0, 0, 0.0)}
    assert layouts.best_pattern(scored).first()["name"] == "CONSOLE_PATTERN"


def test_custom_layout(staging, logs):
    folder = logs({"a.log": LINES})
    options = AnalysisOptions(folder, layout="%d %p [%t] %c{1}: %m%n")
    first = analyze(staging, options).sorted_groups().first()
    assert (first["timestamp"], first["logger"], first["message"]) == ("2024-05-01 10:00:00,000", "Db", "m0")


def test_run(staging, logs, tmp_path):
    line = "2024-05-01 10:00:00 [t] {} a.B - {}\n"
    folder = logs({"a.log": line.format("ERROR", "x") * 3 + line.format("INFO", "y") + line.format("DEBUG", "z")})
    out = tmp_path / "out" / "found.csv"
    result = run(staging, RunOptions(folder, output_path=str(out), split_by_level=True))
    assert (result.total_logs, result.matched_groups, result.matched_occurrences) == (4, 2, 4)
    files = [r["file"] for r in result.files.orderBy("ordinal").collect()]
    assert files == ["found_summary.csv", "found_ERROR.csv", "found_INFO.csv"]
    assert sorted(d for d in os.listdir(out.parent) if d.startswith("file=")) == sorted(f"file={f}" for f in files)


def test_run_that_finds_nothing(staging, logs, tmp_path):
    folder = logs({"a.log": "no header\n"})
    with pytest.raises(ValueError):
        run(staging, RunOptions(folder, output_path=str(tmp_path / "none.csv")))


def test_a_broken_configuration_is_named_and_others_count(staging, logs):
    folder = logs({"logback-a.xml": CONFIG[:300], "logback-b.xml": CONFIG, "logback-c.xml": "<a/>", "a.log": LINES})
    assert detect_layout(staging, folder).first()["config"] == "logback-b.xml"
    found = configs.extract_candidates(configs.discover_configs(staging.spark, folder))
    assert [r["config"] for r in configs.broken_configs(found).collect()] == ["logback-a.xml"]
    for name, message in (("logback-a.xml", "logback-a.xml: "), ("logback-c.xml", "no layout pattern")):
        with pytest.raises(ValueError, match=message):
            detect_layout(staging, folder, os.path.join(folder, name))


def test_hidden_logs_are_read(spark, staging, logs, tmp_path):
    entry = "2024-05-01 10:00:0{}.000 [t] INFO a.B - m {}\nmore\n"
    folder = logs({"a.log": "x\n", "_c.log": b"\xef\xbb\xbf" + "".join(entry.format(i, i) for i in range(5)).encode(), ".d e%.log": "z\r\ny\xff"[:-1].encode() + b"\xff\n", "_empty.log": ""})
    part = tmp_path / "logs" / "_e.log"
    part.mkdir()
    (part / "part-0").write_text("p\n")
    (part / "_SUCCESS").write_text("no\n")
    found = scan_log_dir(spark, folder).select(log_name(F.col("path")).alias("filename"), "value").collect()
    by_log = {}
    for r in found:
        by_log.setdefault(r.filename, []).append(r.value)
    lines = [line for i in range(5) for line in entry.format(i, i).splitlines()]
    assert {k: sorted(v) for k, v in by_log.items()} == {"a.log": ["x"], "_c.log": sorted(lines), ".d e%.log": ["y", "z"], "_e.log": ["p"]}
    entries = iter_entries(staging, folder).orderBy("line_num").collect()
    assert [(r.filename, r.line_num, r.message, r.message_body) for r in entries] == [("_c.log", 2 * i + 1, f"m {i}", "more") for i in range(5)]
    rows = sample_log_dir(spark, folder, 4).collect()
    assert [(r.filename, r.value) for r in rows] == [(".d e%.log", "z"), (".d e%.log", "y"), ("_c.log", lines[0]), ("_c.log", lines[1])]


def test_large_hidden_logs_are_split(spark, staging, logs):
    text = "".join(f"2024-05-01 10:00:00.000 [t] INFO a.B - {i}\n" + "more\n" * (i % 9) for i in range(900))
    folder = logs({"_big.log": text})
    usual = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        scanned = scan_log_dir(spark, folder)
        assert scanned.select("start").distinct().count() > 5
        found = iter_entries(staging, folder).orderBy("line_num").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", usual)
    assert [(r.message, r.message_body.count("more")) for r in found] == [(str(i), i % 9) for i in range(900)]
    numbers = [n for n, line in enumerate(text.split("\n"), 1) if "INFO" in line]
    assert [r.line_num for r in found] == numbers


@settings(max_examples=300, deadline=None)
@given(data=st.lists(st.sampled_from([b"a", b"bc", b"\n", b"\r", b"\r\n", b"\xef\xbb\xbf"]), max_size=30), split=st.integers(1, 9), block=st.integers(1, 6))
def test_ranges_of_a_file_have_its_lines(data, split, block):
    whole = b"".join(data)
    ranges = [(at, min(at + split, len(whole))) for at in range(0, len(whole), split)]
    got = [line for start, end in ranges for line in lines_between(io.BytesIO(whole), start, end, block)]
    expected = re.split(rb"\r\n|\n|\r", whole.removeprefix(b"\xef\xbb\xbf"))
    assert got == (expected[:-1] if not expected[-1] else expected)


def test_sample_of_several_logs(spark, logs):
    folder = logs({"b.log": "b1\n\nb2\n", "a.log": "a1\n", "c.log": "c\n" * 60, "empty.log": ""})
    rows = sample_log_dir(spark, folder, 4).collect()
    assert [(r["filename"], r["value"]) for r in rows] == [("a.log", "a1"), ("b.log", "b1"), ("b.log", "b2"), ("c.log", "c")]
    assert sample_log_dir(spark, folder).count() == 50
    assert sample_log_dir(spark, logs({}) + "/none").count() == 0


def test_sample_of_a_log_in_several_blocks(spark, logs, tmp_path):
    text = "".join(f"{i} {'x' * 500}\n\n" for i in range(400))
    folder = logs({"a b.log": text, "c.log": "c\n"})
    (tmp_path / "logs" / "0.log").mkdir()
    for part in (1, 2):
        (tmp_path / "logs" / "0.log" / f"part-{part}").write_text(f"first {part}\n" * 30)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        rows = sample_log_dir(spark, folder, 30).collect()
        assert [(r["filename"], r["value"]) for r in rows] == [("0.log", "first 1")] * 30
        rows = sample_log_dir(spark, folder, 50).collect()
        assert [r["value"] for r in rows] == ["first 1"] * 30 + ["first 2"] * 20
        for part in (1, 2):
            (tmp_path / "logs" / "0.log" / f"part-{part}").write_text("\n")
        (tmp_path / "logs" / "0.log").rename(tmp_path / "logs" / "z.log")
        rows = sample_log_dir(spark, folder).collect()
        assert [(r["filename"], r["value"].split()[0]) for r in rows] == [("a b.log", str(i)) for i in range(50)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("wrong", [{"fmt": "xml"}, {"sort_by": "name"}, {"max_bytes": 0}])
def test_options_are_checked_before_any_job(wrong):
    with pytest.raises(ValueError):
        RunOptions("logs", **wrong)


def test_usual_part_size():
    assert RunOptions("logs").report().max_bytes == RunOptions("logs", max_bytes=None).report().max_bytes == 50 * 1024 * 1024


def test_staging_needs_a_folder(spark, tmp_path):
    assert Staging(spark, str(tmp_path)).folder.startswith(str(tmp_path))


def test_staging_folder_is_shared_and_removed(spark):
    with Staging(spark) as staging:
        staging.write(spark.range(3), "numbers")
        assert staging.folder.startswith(shared_folder(spark) + "/")
        assert os.path.isdir(staging.folder)
    assert not os.path.exists(staging.folder)
