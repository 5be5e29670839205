"""Reports against the csv and json modules and a plain rendering."""

import csv
import io
import json
import os

import pytest
from pyspark.sql import functions as F

from logweft.operators import groups as G
from logweft.operators import reports as R
from logweft.operators.pieces import write_pieces

COLUMNS = (
    "count long, line_numbers array<long>, timestamp string, last_timestamp string, level string, "
    "thread string, logger string, filename string, message string, message_body string, stacktrace string"
)
NAMES = [column.split()[0] for column in COLUMNS.split(", ")]
GROUPS = [
    (2, [3, 9], "2024-05-01 10:00:00", "2024-05-01 10:00:09", "ERROR", "t,1", "a.B", "a.log", 'say "no"', "  x\n y \n", "9: at q\n  10: é"),
    (1, [1], "2024-05-01 10:00:01", "2024-05-01 10:00:01", "WARN", "t", "a.B", "b.log", "tab\there \\ \x0b\x1f 日誌", "", ""),
    (3, [4, 5, 6], "2024-05-01 10:00:02", "2024-05-01 10:00:05", "ERROR", "t", "", "a.log", "", "\n", ""),
]


def tables(spark, groups):
    """Groups and their line numbers."""
    df = spark.createDataFrame(groups, COLUMNS)
    gid = F.encode(F.concat("timestamp", "level", "message"), "utf-8").alias("gid")
    first = F.get("line_numbers", F.lit(0)).alias("first_line")
    rows = df.select(gid, *[n for n in NAMES if n != "line_numbers"], first, F.lit(0).alias("first_batch"))
    each = df.select(gid, "filename", F.explode("line_numbers").alias("line"))
    chunks = each.groupBy("gid", F.lit(0).alias("batch"), F.col("filename").alias("chunk_file"),
                          F.floor(F.col("line") / G.LINES_PER_BLOCK).alias("chunk_no"))
    return rows, chunks.agg(F.count("*").alias("n"), F.sort_array(F.collect_list("line")).alias("lines"))


def counts(spark, groups):
    n, met = {}, {}
    for at, group in enumerate(groups):
        n[group[4]] = n.get(group[4], 0) + group[0]
        met.setdefault(group[4], at)
    return spark.createDataFrame(
        [(level, total, met[level]) for level, total in n.items()], "level string, n long, first_seen int"
    )


def write(spark, staging, folder, groups, **options):
    """Write a report and read its files back: name -> bytes, plus the list of files."""
    options = R.ReportOptions(**options)
    rows, chunks = (staging.write(t, "input") for t in tables(spark, groups))
    files = R.write_report(staging, rows, chunks, counts(spark, groups), str(folder), options).orderBy("ordinal").collect()
    content = {}
    for name in sorted(os.listdir(folder)):
        if name.startswith("file="):
            parts = sorted(p for p in os.listdir(folder / name) if p.startswith("part-"))
            content[name.removeprefix("file=")] = b"".join((folder / name / p).read_bytes() for p in parts)
    assert {f["file"] for f in files} == set(content)
    return content, [f["file"] for f in files]


def csv_rows(rows):
    out = io.StringIO()
    csv.writer(out).writerows(rows)
    return out.getvalue()


def level_rows(groups):
    n = {}
    for group in groups:
        n[group[4]] = n.get(group[4], 0) + group[0]
    return n


def csv_record(group):
    g = dict(zip(NAMES, group))
    numbers = ", ".join(map(str, g["line_numbers"]))
    middle = [g[name] for name in NAMES[2:9]]
    return csv_rows([[g["count"], numbers, *middle, g["message_body"].strip(), g["stacktrace"].strip()]])


def csv_head(groups):
    head = csv_rows([["--- 統計摘要 ---"], ["日誌等級 (Level)", "出現次數 (Count)"], *sorted(level_rows(groups).items()), []])
    titles = "出現次數 出現行號 第一次時間 最後一次時間 等級 線程 Logger 來源檔案 訊息內容 延伸訊息".split()
    return head + csv_rows([["--- 詳細日誌內容 (已合併重複項) ---"], [*titles, "堆疊追蹤 (含行號)"]])


@pytest.mark.parametrize("fmt", ["csv", "json", "md"])
def test_chunks_of_line_numbers_do_not_show(spark, staging, tmp_path, fmt, monkeypatch):
    groups = [(*g[:1], list(range(1, 40)), *g[2:]) if i == 0 else g for i, g in enumerate(GROUPS)]
    whole, _ = write(spark, staging, tmp_path / "a", groups, fmt=fmt, max_bytes=700)
    monkeypatch.setattr(G, "LINES_PER_BLOCK", 2)
    pieces, _ = write(spark, staging, tmp_path / "b", groups, fmt=fmt, max_bytes=700)
    assert {n: t for n, t in whole.items() if "summary" not in n} == {n: t for n, t in pieces.items() if "summary" not in n}
    assert len(whole) > 2


@pytest.mark.parametrize("options", [{}, {"split_by_level": True}, {"max_bytes": 900}, {"max_bytes": R.ONE_TASK_BYTES * 2}])
@pytest.mark.parametrize("fmt", ["csv", "json", "md"])
def test_a_rerun_replaces_the_report(spark, staging, tmp_path, fmt, options):
    first = write(spark, staging, tmp_path, GROUPS, fmt=fmt, **options)
    assert write(spark, staging, tmp_path, GROUPS, fmt=fmt, **options) == first
    assert not [name for name in os.listdir(tmp_path) if not name.startswith("file=")]


def test_a_failed_run_leaves_the_report(spark, staging, tmp_path):
    first, _ = write(spark, staging, tmp_path, GROUPS)
    pieces = spark.createDataFrame([("report.csv", 0, 0, 0, "x")], "file string, section int, pos long, piece int, text string")
    failing = pieces.withColumn("text", F.raise_error(F.lit("stop")).cast("string"))
    with pytest.raises(Exception, match="stop"):
        write_pieces(failing, str(tmp_path), True)
    parts = sorted((tmp_path / "file=report.csv").glob("part-*"))
    assert b"".join(p.read_bytes() for p in parts) == first["report.csv"]
    assert os.listdir(tmp_path) == ["file=report.csv"]


def test_csv(spark, staging, tmp_path):
    content, files = write(spark, staging, tmp_path, GROUPS, fmt="csv")
    assert files == ["report.csv"]
    expected = csv_head(GROUPS) + "".join(map(csv_record, GROUPS))
    assert content["report.csv"].decode("utf-8-sig") == expected
    assert content["report.csv"].startswith(b"\xef\xbb\xbf")


def json_item(group):
    text = json.dumps(dict(zip(NAMES, group)), indent=4, ensure_ascii=False)
    return "\n".join(" " * 8 + line for line in text.split("\n"))


def json_head(groups):
    return '{\n    "summary": ' + json.dumps(level_rows(groups)) + ',\n    "results": [\n'


def test_json(spark, staging, tmp_path):
    content, _ = write(spark, staging, tmp_path, GROUPS, fmt="json", stem="out")
    expected = json_head(GROUPS) + ",\n".join(map(json_item, GROUPS)) + "\n    ]\n}\n"
    assert content["out.json"].decode() == expected


def md_section(index, group):
    g = dict(zip(NAMES, group))
    time = (
        f"- **時間範圍**: `{g['timestamp']}` ～ `{g['last_timestamp']}`"
        if g["count"] > 1
        else f"- **出現時間**: `{g['timestamp']}`"
    )
    lines = [
        f"### {index}. [{g['level']}] {g['message']}",
        f"- **出現行號**: `{', '.join(map(str, g['line_numbers']))}`",
        time,
        f"- **線程**: `{g['thread']}`",
        f"- **Logger**: `{g['logger']}`",
        f"- **來源檔案**: `{g['filename']}`",
    ]
    if g["message_body"]:
        lines += ["#### 延伸訊息:", "```text", g["message_body"].rstrip(), "```"]
    if g["stacktrace"]:
        lines += ["#### 內容/堆疊追蹤 (含原始行號):", "```java", g["stacktrace"].strip(), "```"]
    return "\n".join([*lines, "", "---", ""])


def md_counts(groups):
    lines = ["# Java Log 分析報告", "", "## 統計摘要", "| 日誌等級 | 數量 |", "| --- | --- |"]
    return lines + [f"| {level} | {n} |" for level, n in sorted(level_rows(groups).items())]


def md_head(groups):
    return "\n".join([*md_counts(groups), "", "## 符合條件的詳細日誌", ""])


def test_md(spark, staging, tmp_path):
    content, _ = write(spark, staging, tmp_path, GROUPS, fmt="md")
    expected = md_head(GROUPS) + "".join(md_section(i, g) for i, g in enumerate(GROUPS, 1))
    assert content["report.md"].decode() == expected


@pytest.mark.parametrize(
    "fmt, expected",
    [
        ("md", "# Java Log 分析報告\n\n## 統計摘要\n| 日誌等級 | 數量 |\n| --- | --- |\n\n## 符合條件的詳細日誌\n無符合條件的記錄\n"),
        ("json", '{\n    "summary": {},\n    "results": [\n\n    ]\n}\n'),
    ],
)
def test_nothing_to_report(spark, staging, tmp_path, fmt, expected):
    content, files = write(spark, staging, tmp_path, [], fmt=fmt)
    assert files == [f"report.{fmt}"]
    assert content[files[0]].decode() == expected


def many(n, level="ERROR", size=900, start=0):
    return [
        (1, [i], f"2024-05-01 10:{i // 60:02d}:{i % 60:02d}", f"2024-05-01 10:{i // 60:02d}:{i % 60:02d}", level,
         "t", "a.B", "a.log", f"m{i} " + "é" * (size // 2 + i % 7), "", "")
        for i in range(start, start + n)
    ]


def pack_by_loop(groups, fmt, limit, head):
    """The parts as lists of blocks, rendered one after the other."""
    parts, used, extra = [[]], 0, 3 if fmt == "csv" else 0
    opening = len(head(groups).encode()) + extra
    used = opening
    for group in groups:
        while True:
            at = len(parts[-1])
            if fmt == "json":
                block = (",\n" if at else "") + json_item(group)
            else:
                block = md_section(at + 1, group) if fmt == "md" else csv_record(group)
            size = len(block.encode()) + extra
            if at and used + size > limit:
                parts.append([])
                used = opening
                continue
            parts[-1].append(block)
            used += size
            break
    return parts


HEADS = {"csv": csv_head, "json": json_head, "md": md_head}
FOOT = {"csv": "", "json": "\n    ]\n}\n", "md": ""}


def text_of(data, fmt):
    return data.decode("utf-8-sig" if fmt == "csv" else "utf-8")


@pytest.mark.parametrize("fmt", ["csv", "json", "md"])
def test_split_by_size(spark, staging, tmp_path, fmt):
    groups = many(30) + many(4, size=9000, start=30) + many(26, size=60, start=34)
    content, files = write(spark, staging, tmp_path, groups, fmt=fmt, max_bytes=5000, chunk_rows=8)
    parts = pack_by_loop(groups, fmt, 5000, HEADS[fmt])
    names = [f"report_part{i:03d}.{fmt}" for i in range(1, len(parts) + 1)]
    assert files == [f"report_summary.{fmt}", *names]
    for name, blocks in zip(names, parts):
        assert text_of(content[name], fmt) == HEADS[fmt](groups) + "".join(blocks) + FOOT[fmt]
    summary = text_of(content[files[0]], fmt)
    listed = [os.path.join(str(tmp_path), name) for name in names]
    if fmt == "json":
        assert json.loads(summary) == {"summary": {"ERROR": 60}, "results": [], "split": {"enabled": True, "files": listed}}
        assert summary == json.dumps(json.loads(summary), indent=4) + "\n"
    elif fmt == "md":
        assert summary == "\n".join([*md_counts(groups), "", "## 詳細日誌已分割", "請參考下列檔案："]) + "\n" + "".join(
            f"- `{name}`\n" for name in listed
        )
    else:
        counts = [["--- 統計摘要 ---"], ["日誌等級 (Level)", "出現次數 (Count)"], ["ERROR", 60], []]
        assert summary == csv_rows([*counts, ["--- 詳細日誌已分割 ---"], ["請參考下列檔案"], *[[n] for n in listed]])


@pytest.mark.parametrize("fmt", ["csv", "json", "md"])
def test_split_by_level_and_size(spark, staging, tmp_path, fmt):
    groups = many(3, size=2000) + many(1, "WARN", 80, 3) + many(2, size=2000, start=4)
    content, files = write(spark, staging, tmp_path, groups, fmt=fmt, max_bytes=5000, split_by_level=True)
    errors, warns = [g for g in groups if g[4] == "ERROR"], [g for g in groups if g[4] == "WARN"]
    parts = pack_by_loop(errors, fmt, 5000, HEADS[fmt])
    names = [f"report_ERROR_part{i:03d}.{fmt}" for i in range(1, len(parts) + 1)]
    assert len(names) > 1
    assert files == [f"report_summary.{fmt}", *names, f"report_WARN.{fmt}"]
    for name, blocks in zip(names, parts):
        assert text_of(content[name], fmt) == HEADS[fmt](errors) + "".join(blocks) + FOOT[fmt]
    whole = pack_by_loop(warns, fmt, 5000, HEADS[fmt])
    assert text_of(content[files[-1]], fmt) == HEADS[fmt](warns) + "".join(whole[0]) + FOOT[fmt]


def test_one_level_is_not_split(spark, staging, tmp_path):
    _, files = write(spark, staging, tmp_path, many(3), split_by_level=True, suffix=".txt")
    assert files == ["report.txt"]


def test_many_parts_replace_old_ones_and_nothing_else_is_left(spark, tmp_path):
    """One part for each of two thousand files; those that are not written again stay."""
    (tmp_path / "file=0.txt").mkdir()
    (tmp_path / "file=0.txt" / "part-00009").write_text("old")
    (tmp_path / "file=kept.txt").mkdir()
    (tmp_path / "file=kept.txt" / "part-00000").write_text("kept")
    rows = spark.range(2000).selectExpr("concat(id, '.txt') AS file", "1 AS section", "id AS pos", "0 AS piece", "repeat(string(id), 3) AS text")
    write_pieces(rows.repartition(8), str(tmp_path), True)
    names = sorted(p.name for p in tmp_path.iterdir())
    assert len(names) == 2001 and not [n for n in names if n.startswith("_")]
    for name in ("0", "17", "1999", "kept"):
        parts = list((tmp_path / f"file={name}.txt").glob("part-*"))
        assert [p.read_text() for p in parts] == [name if name == "kept" else name * 3]


def test_a_task_that_dies_leaves_the_old_report(spark, tmp_path):
    (tmp_path / "file=a.txt").mkdir()
    (tmp_path / "file=a.txt" / "part-00000").write_text("old")
    rows = spark.range(0, 4000, 1, 4).selectExpr("'a.txt' AS file", "1 AS section", "id AS pos", "0 AS piece", "IF(id = 3900, raise_error('killed'), 'x') AS text")
    with pytest.raises(Exception, match="killed"):
        write_pieces(rows, str(tmp_path), False)
    assert [p.name for p in tmp_path.iterdir()] == ["file=a.txt"]
    assert (tmp_path / "file=a.txt" / "part-00000").read_text() == "old"
