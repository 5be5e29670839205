"""Analyses saved by one session and merged by another."""

import os

import pytest
from pyspark.sql import functions as F

from logweft import AnalysisOptions, SavedAnalyses, Staging, analyze, merge_results
from logweft.operators.reports import ReportOptions, build_report

DAYS = ["a.log", "b.log", "c.log"]


def day(number):
    lines = [f"2024-05-0{number + 1} 10:00:{i:02d}.000 [t{number}] {'ERROR' if i % 3 else 'INFO'} a.B - message {i % (4 + number)}" for i in range(20)]
    return "\n".join(lines + [f"java.lang.IllegalStateException: {number}", f"2024-05-0{number + 1} 11:00:00.000 [t] WARN a.B - day {number}"]) + "\n"


@pytest.fixture
def days(staging, tmp_path):
    """An analysis of each day, and one of all days."""
    for number, name in enumerate(DAYS):
        for folder in (f"day{number}", "all"):
            (tmp_path / folder).mkdir(exist_ok=True)
            (tmp_path / folder / name).write_text(day(number))
    each = [analyze(staging, AnalysisOptions(str(tmp_path / f"day{i}"))) for i in range(len(DAYS))]
    return each, analyze(staging, AnalysisOptions(str(tmp_path / "all")))


def found(results):
    groups = results.groups.drop("first_batch").collect()
    chunks = results.chunks.drop("batch").collect()
    counts = results.counts.select("level", "n").collect()
    return [sorted(map(repr, rows)) for rows in (groups, chunks, counts)]


def test_saved_runs_merge_as_one_run(spark, staging, days, tmp_path):
    each, whole = days
    store = SavedAnalyses(spark, str(tmp_path / "saved"))
    assert store.runs() == []
    with pytest.raises(ValueError, match="nothing is saved"):
        store.merge(staging)
    for number in (0, 1):
        store.append(each[number], f"day {number}")
    other = spark.newSession()
    with Staging(other, str(tmp_path / "other")) as opened:
        again = SavedAnalyses(other, str(tmp_path / "saved"))
        assert [r["note"] for r in again.runs()] == ["day 0", "day 1"]
        merged = again.merge(opened, each[2])
        assert found(merged) == found(whole) and merged.batches == 3
        assert merged.groups.schema == whole.groups.schema
        lines = [build_report(opened, r.groups, r.chunks, r.counts, ReportOptions("json")).pieces for r in (merged, whole)]
        texts = ["".join(p.text for p in piece.orderBy("file", "section", "pos", "piece").collect()) for piece in lines]
        assert texts[0] == texts[1] and "message 3" in texts[0]


def test_compacted_runs_stay_apart_by_batch(spark, staging, days, tmp_path):
    each, _ = days
    store = SavedAnalyses(spark, str(tmp_path / "saved"))
    for number in (0, 0, 1):  # the same logs twice: equal names and lines in two batches
        store.append(each[number])
    plain = store.merge(staging, each[2])
    store.compact(staging)
    assert [r["batches"] for r in store.runs()] == [3]
    merged = store.merge(staging, each[2])
    assert found(merged) == found(plain) and merged.batches == plain.batches == 4
    key = ["gid", "batch", "chunk_file", "chunk_no"]
    assert merged.chunks.select(*key).distinct().count() == merged.chunks.count() == plain.chunks.count()
    assert merged.groups.agg(F.sum("count")).first()[0] == 4 * 21
    assert len(os.listdir(tmp_path / "saved")) > 4
    assert store.vacuum() > 0
    assert sorted(n.split("-")[0] for n in os.listdir(tmp_path / "saved") if not n.startswith(".")) == ["manifest", "run"]
    assert found(store.merge(staging, each[2])) == found(plain)


def test_two_that_save_at_once_and_one_that_dies(spark, staging, days, tmp_path, monkeypatch):
    each, _ = days
    one, two = (SavedAnalyses(spark, str(tmp_path / "saved")) for _ in range(2))
    one.append(each[0], "first")
    read = one._manifest
    seen = []

    def late():
        """The other one saves after this one has read the manifest."""
        state = read()
        if not seen:
            seen.append(two.append(each[1], "between"))
        return state

    monkeypatch.setattr(one, "_manifest", late)
    one.append(each[2], "last")
    assert [r["note"] for r in two.runs()] == ["first", "between", "last"]
    monkeypatch.setattr(two, "_publish", lambda change: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        two.append(each[0], "dead")
    assert [r["note"] for r in one.runs()] == ["first", "between", "last"]
    assert len(one.load(seen[0])) == 1
    with pytest.raises(ValueError, match="no saved run"):
        one.load("run-0")


def test_merge_counts_in_the_order_met(staging, days):
    each, _ = days
    levels = merge_results(staging, each[1], each[0]).counts.orderBy("first_seen").collect()
    assert [(r.level, r.n, r.first_seen.batch) for r in levels] == [("INFO", 14, 0), ("ERROR", 26, 0), ("WARN", 2, 0)]


def test_no_texts_in_sort_aggregates(spark, staging, days):
    """Groups, and merged groups, are hash aggregates of numbers."""
    from logweft.operators import groups as G

    entries = days[0][0].entries
    groups = G.dedup_groups(entries)
    merged, _ = G.merge_groups(*[(d.groups, d.chunks) for d in days[0]])
    for df in (groups, merged):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" in plan and "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
