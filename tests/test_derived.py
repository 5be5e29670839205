import pytest
from pyspark.sql import functions as F

from checks import derived as D


def plain_lines(spark, folder):
    """The parts of every record, put together in one step."""
    records = D.derive_records(spark, folder)
    text = F.concat_ws("\n", F.when(F.col("head_lines") > 0, F.col("head")), "text")
    documents = D.table(spark, folder, "documents").select("doc_id", "text")
    whole = records.join(documents, F.col("doc_id") == F.col("event_id"), "left").where("event_id IS NOT NULL")
    return whole.select("filename", "event_id", F.split(text, "\n").alias("parts"))


@pytest.fixture
def folder(spark, tmp_path):
    """Repeated and null ids, null and empty texts, documents without an event."""
    events = "event_id long, ts timestamp, user_id long, event_type string, props string"
    rows = spark.range(60).selectExpr(
        "id AS event_id", "timestamp'2024-01-05 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id) AS ts", "id % 9 AS user_id",
        "element_at(array('error', 'purchase', 'signup', 'view'), cast(id % 4 + 1 AS int)) AS event_type", "concat('p', id) AS props",
    )
    odd = spark.createDataFrame([(None, None, 1, "view", "x"), (8, None, None, None, None), (8, None, None, None, None)], events)
    rows.unionByName(odd).write.parquet(f"{tmp_path}/events.parquet")
    texts = [(i, f"one {i}\n\ntwo") for i in range(0, 60, 3)] + [(8, None), (8, "a\nb"), (8, "c"), (12, ""), (15, "a\nb"), (None, "n"), (99, "z")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_lines_are_numbered_without_gaps_and_records_stay_whole(spark, folder):
    lines = D.derive_lines(spark, folder).collect()
    logs = {}
    for row in sorted(lines, key=lambda r: (r["filename"], r["line_num"])):
        logs.setdefault(row["filename"], []).append(row)
    for rows in logs.values():
        assert [r["line_num"] for r in rows] == list(range(1, len(rows) + 1))
    records = plain_lines(spark, folder).collect()
    assert sum(len(r["parts"]) for r in records) == len(lines)
    for name, rows in logs.items():
        values, at = [r["value"] for r in rows], 0
        wanted = {}
        for r in records:
            if r["filename"] == name:
                wanted.setdefault(r["event_id"], []).append(r["parts"])
        for event_id in sorted(wanted):
            left = wanted[event_id]
            while left:  # records of one number stand in any order
                parts = next(p for p in sorted(left, key=len, reverse=True) if values[at : at + len(p)] == p)
                left.remove(parts)
                at += len(parts)


def test_lines_are_counted_without_their_texts(spark, folder):
    """What the windows and joins of the counts carry is no array of lines."""
    plan = D.derive_lines(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("posexplode") == 1 and "size(parts" not in plan
