"""The queries against their SQL over whole tables, and the pipeline stage by stage against brute force."""

import os

import duckdb
import pytest
from test_decontaminate import brute as contaminated
from test_neardup import brute as classes
from test_substrings import brute as kept_words

import corpus_pipeline
from logweft.llm import language, mixing, neardup
from logweft.llm.oracle import ORACLE
from logweft.llm.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in ("documents", "benchmark", "pages", "labels"):
        connection.execute(f"create view {name} as select * from '{SF_DIR}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", ORACLE)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = sorted((tuple(row[c] for c in columns) for row in df.collect()), key=repr)
    result = duck.execute(ORACLE[name])
    names = [column[0] for column in result.description]
    assert sorted(names) == columns
    expected = [tuple(row[names.index(c)] for c in columns) for row in result.fetchall()]
    assert got == sorted(expected, key=repr)
    assert got


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_a_row_for_each_row(spark, name):
    table, each = {"op2_url_filter": ("pages", 1), "op12_embedding_whitening": ("embeddings", 32)}.get(name, ("documents", 1))
    assert QUERIES[name](spark, SF_DIR).count() == each * spark.read.parquet(f"{SF_DIR}/{table}.parquet").count()


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    inputs = []
    for name, stage in corpus_pipeline.STAGES:
        inputs.append(docs.collect())
        stage(spark, docs, SF_DIR).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    start, spoken, single, cut, clean = inputs
    result = docs.collect()

    # Language: what is left was predicted to be a known language.
    whole = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    network = language.train(whole)
    found = language.predict(whole, network).collect()
    length = {r.doc_id: len((r.text or "").encode()) for r in start}
    accepted = {r.doc_id for r in found if r.lang_pred != "und" and r.score >= language.least_score(len(network.languages), length[r.doc_id])}
    assert {r.doc_id for r in spoken} == accepted and len(accepted) >= 0.97 * len(start)
    # Near copies: one of each class, the least id.
    rows = spark.createDataFrame([(r.doc_id, r.text) for r in spoken], "doc_id long, text string")
    expected = classes([(r.doc_id, r.text) for r in spoken], neardup.rarity(*neardup.frequencies(rows)))
    assert {r.doc_id for r in single} == {class_id for _, class_id, _ in expected}
    assert sorted(map(tuple, single)) == sorted(tuple(r) for r in spoken if r.doc_id in {x.doc_id for x in single})
    # Repeated passages.
    texts = {}
    for r, (words, kept) in zip(single, kept_words([r.text for r in single]), strict=True):
        if kept:
            texts[r.doc_id] = r.text if len(words) == len(kept) else b" ".join(kept).decode()
    assert {r.doc_id: r.text for r in cut} == texts and all(r.n_chars == len(r.text) for r in cut)
    # Benchmark windows.
    items = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {r[0] for r in contaminated([(r.doc_id, r.text) for r in cut], items) if r[5]}
    assert {r.doc_id for r in clean} == {r.doc_id for r in cut} - bad
    # The mix, in order.
    frame = spark.createDataFrame(clean, whole.schema)
    taken = {r.doc_id: r.taken for r in mixing.mix(frame).collect() if r.taken}
    assert {r.doc_id: r.taken for r in result} == taken
    assert [r.position for r in docs.orderBy("position").collect()] == sorted(r.position for r in result)


def test_run_gives_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, SF_DIR)
    assert rows.columns[-3:] == ["taken", "position", "again"] and rows.count() > 100
