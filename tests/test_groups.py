import pytest
from pyspark.sql import functions as F

from logweft import Analysis, AnalysisOptions, analyze, merge
from logweft.operators import groups as G
from logweft.operators import summaries


def line(second, level="INFO", message="same", thread="t", logger="a.B"):
    return f"2024-05-01 10:00:{second:02d}.000 [{thread}] {level} {logger} - {message}\n"


def test_same_entries_merge_over_files(staging, logs):
    folder = logs(
        {
            "b.log": line(1, thread="t3") + line(9, level="ERROR", message="x"),
            "a.log": line(5, thread="t1") + "\n" + line(4, message="other") + line(7, thread="t2"),
        }
    )
    analysis = analyze(staging, AnalysisOptions(folder))
    assert [tuple(r)[1:] for r in analysis.sorted_groups().collect()] == [
        (1, "2024-05-01 10:00:04.000", "2024-05-01 10:00:04.000", "INFO", "t", "a.B", "a.log", "other", "", ""),
        (3, "2024-05-01 10:00:05.000", "2024-05-01 10:00:01.000", "INFO", "t1", "a.B", "a.log", "same", "", ""),
        (1, "2024-05-01 10:00:09.000", "2024-05-01 10:00:09.000", "ERROR", "t", "a.B", "b.log", "x", "", ""),
    ]
    messages = analysis.groups.select("gid", "message")
    lines = analysis.chunks.join(messages, "gid").orderBy("message", "chunk_file").collect()
    assert [(r["message"], r["chunk_file"], r["lines"]) for r in lines] == [
        ("other", "a.log", [3]), ("same", "a.log", [1, 4]), ("same", "b.log", [1]), ("x", "b.log", [2]),
    ]
    assert tuple(analysis.totals().first()) == (5, 3, 5)
    assert [tuple(r) for r in G.level_summary(analysis.counts).collect()] == [("ERROR", 1), ("INFO", 4)]


def test_equal_traces_on_other_lines_stay_apart(staging, logs):
    trace = line(1, "ERROR", "boom") + "a.BException: no\n"
    analysis = analyze(staging, AnalysisOptions(logs({"a.log": trace * 2})))
    assert [r["stacktrace"] for r in analysis.sorted_groups().collect()] == ["2: a.BException: no", "4: a.BException: no"]


def test_fields_are_not_confused_in_the_key(spark):
    rows = [("a", "bc"), ("ab", "c"), ("a", "bc")]
    df = spark.createDataFrame(rows, "logger string, message string")
    for name in ("level", "message_body", "stacktrace"):
        df = df.withColumn(name, F.lit(""))
    assert G.with_group_id(df).select("gid").distinct().count() == 2


def test_level_order(staging, logs):
    levels = ["DEBUG", "error", "INFO", "WARNING", "ERROR", "WARN", "ERROR"]
    folder = logs({"a.log": "".join(line(i, level, str(i)) for i, level in enumerate(levels))})
    analysis = analyze(staging, AnalysisOptions(folder, sort_by="level"))
    assert [r["level"] for r in analysis.sorted_groups().collect()] == [
        "ERROR", "ERROR", "WARNING", "WARN", "INFO", "DEBUG", "error",
    ]


def test_levels_option(staging, logs):
    folder = logs({"a.log": line(1, "error") + "tail\n" + line(2, "WARN") + line(3, "INFO")})
    analysis = analyze(staging, AnalysisOptions(folder, levels=(" Error ", "warn")))
    assert {r["level"]: r["n"] for r in analysis.counts.collect()} == {"error": 1, "WARN": 1}
    assert analyze(staging, AnalysisOptions(folder, levels=())).groups.count() == 0


def many_entries(spark, n):
    """One group holds a third of all entries, over two files."""
    return spark.range(n).select(
        F.concat(F.lit("f"), (F.col("id") % 2).cast("string")).alias("filename"),
        (F.floor(F.col("id") / 2) + 1).alias("line_num"),
        F.col("id").cast("string").alias("timestamp"),
        F.lit("t").alias("thread"),
        *[F.lit(name).alias(name) for name in ("level", "logger", "message_body", "stacktrace")],
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("m"), F.col("id") % 150)).alias("message"),
    )


@pytest.mark.parametrize("chunk", [2, 64, 65_536])
def test_a_group_is_one_row_whatever_its_size(spark, chunk, monkeypatch):
    monkeypatch.setattr(G, "LINES_PER_BLOCK", chunk)
    n = 900
    identified = G.with_group_id(many_entries(spark, n))
    groups, chunks = G.dedup_groups(identified), G.line_chunks(identified)
    assert groups.count() == 101
    hot = groups.where("message = 'hot'")
    assert [r["count"] for r in hot.collect()] == [n // 3]
    rows = chunks.join(hot.select("gid"), "gid").orderBy("batch", "chunk_file", "chunk_no").collect()
    assert [x for r in rows for x in r["lines"]] == [i // 2 + 1 for f in (0, 1) for i in range(n) if i % 2 == f and i % 3 == 0]
    assert all(len(r["lines"]) == r["n"] <= chunk for r in rows)


def test_texts_of_a_log_do_not_meet_in_a_task(staging, spark):
    """Entries are not dealt by the name of their log, even where nothing is known to be small."""
    identified = staging.write(G.with_group_id(many_entries(spark, 900)), "entries")
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = G.dedup_groups(identified)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    assert "BroadcastHashJoin [filename" in plan and "SortMergeJoin [filename" not in plan


def test_texts_are_dealt_evenly_even_where_groups_are_few(staging, spark):
    """Not broadcast to, as a task would read all that one task before it has moved."""
    identified = staging.write(G.with_group_id(many_entries(spark, 900)), "entries")
    groups = G.dedup_groups(identified)
    assert sum(r["count"] for r in groups.collect()) == 900
    plan = groups._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [encounter" in plan and "BroadcastHashJoin [encounter" not in plan


@pytest.mark.parametrize("share", [1, 1_000])
def test_chunks_of_large_groups_are_joined_apart(spark, share, monkeypatch):
    monkeypatch.setattr(G, "LARGE_GROUPS", share)
    monkeypatch.setattr(G, "LINES_PER_BLOCK", 64)
    identified = G.with_group_id(many_entries(spark, 900))
    groups, chunks = G.dedup_groups(identified), G.line_chunks(identified)
    joined = G.join_chunks(chunks, groups.select("gid", "count", "filename", "first_line", "first_batch"))
    assert joined.count() == chunks.count()
    assert joined.where(G.first_chunk()).count() == groups.count()


def test_a_group_in_many_small_logs_is_one_row(staging, logs):
    analysis = analyze(staging, AnalysisOptions(logs({f"{i:03d}.log": line(1) for i in range(60)})))
    assert [(r["count"], r["filename"]) for r in analysis.groups.collect()] == [(60, "000.log")]
    assert analysis.chunks.count() == 60


def test_merge_of_two_runs(staging, logs):
    first = analyze(staging, AnalysisOptions(logs({"a.log": line(1) + line(2) + line(3, message="once")})))
    entries = first.entries.withColumn("filename", F.lit("0.log")).withColumn("timestamp", F.lit("later"))
    later = entries.where("message = 'same'")
    later = Analysis(later, first.counts, G.dedup_groups(later), G.line_chunks(later), first.options)
    groups, chunks = merge(staging, first, later)
    got = {r["message"]: r for r in groups.collect()}
    same = got["same"]
    assert (same["count"], same["first_batch"]) == (4, 0)
    assert (same["timestamp"], same["last_timestamp"], same["filename"]) == ("2024-05-01 10:00:01.000", "later", "a.log")
    assert got["once"]["count"] == 1
    lines = chunks.where(F.col("gid") == F.lit(same["gid"])).orderBy("batch", "chunk_file", "chunk_no").collect()
    assert [(r["batch"], r["lines"]) for r in lines] == [(0, [1, 2]), (1, [1, 2])]
    again, _ = G.merge_groups((groups, chunks))
    assert again.columns == groups.columns


@pytest.mark.parametrize("block", [64, 65_536])
def test_line_numbers_as_bits(spark, monkeypatch, block):
    """A group that holds a third of all lines, others that hold one here and there, and the first and last bits of words."""
    monkeypatch.setattr(G, "LINES_PER_BLOCK", block)
    rows = spark.range(1, 200_001, 1, 7).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 64 == 63, "last").when(F.col("id") % 64 == 0, "first")
        .otherwise(F.concat(F.lit("g"), (F.col("id") % 5000).cast("string"))).alias("gid"),
        F.when(F.col("id") % 2 == 0, "a.log").otherwise("b.log").alias("filename"),
        F.col("id").alias("line_num"),
    )
    chunks = G.line_chunks(rows)
    assert chunks.columns == ["gid", "batch", "chunk_file", "chunk_no", "n", "lines"]
    found = chunks.select("gid", F.col("chunk_file").alias("filename"), "chunk_no", F.explode("lines").alias("line_num"))
    assert found.where("chunk_no <> floor(line_num / {})".format(block)).count() == 0
    found = found.drop("chunk_no")
    assert found.exceptAll(rows).count() == 0 and rows.exceptAll(found).count() == 0
    assert chunks.where("n <> size(lines) OR NOT lines <=> sort_array(lines)").count() == 0
    plan = chunks._jdf.queryExecution().executedPlan().toString()
    assert "bit_or" in plan and "SortAggregate" not in plan


def test_dashboard(spark):
    columns = "count long, timestamp string, logger string, thread string, message string, message_body string, stacktrace string"
    groups = spark.createDataFrame(
        [
            (3, "2024-05-01 10:15:00", "a", "t1", "m", "", "  9: x.AException: a\n 10: at y"),
            (2, "2024-05-01 10:59:00,1", "a", "t2", "m", "", "20: x.AException: a"),
            (5, "2024-05-01 11:00:00", " b ", "t1", "see Error 7", "", ""),
            (2, "2024-05-01 11:00:00", "", "", "m", "fine\n Caused by: z", ""),
        ],
        columns,
    )
    summary = summaries.dashboard(groups)
    got = {}
    for r in summaries.sort_summary(summary).collect():
        got.setdefault(r["dimension"], []).append((r["value"], r["group_count"], r["occurrence_count"]))
    assert got == {
        "exception": [("x.AException: a", 2, 5), ("see Error 7", 1, 5), ("Caused by: z", 1, 2)],
        "time": [("2024-05-01 11:00", 2, 7), ("2024-05-01 10:00", 2, 5)],
        "logger": [("a", 2, 5), ("b", 1, 5)],
        "thread": [("t1", 2, 8), ("t2", 1, 2)],
    }
    assert {r["dimension"]: r["distinct_values"] for r in summaries.distinct_counts(summary).collect()} == {
        "exception": 3, "time": 2, "logger": 2, "thread": 2,
    }
    top = summaries.top_summary(summary, 1).collect()
    assert sorted(r["value"] for r in top) == ["2024-05-01 11:00", "a", "t1", "x.AException: a"]
