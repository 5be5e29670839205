import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logweft.llm import skew
from logweft.llm import words as W

texts = st.lists(st.one_of(st.none(), st.text(alphabet="ab \t\nÉ中.9", max_size=20)), min_size=1, max_size=6)


@given(texts)
def test_spans_are_the_words_of_each_row(rows):
    for first, end, data, offsets in W.slices(pa.array(rows, pa.string()), 16):
        starts, ends, of = W.spans(data, offsets, W.SPACE)
        found = [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
        expected = [(t or "").encode().split() for t in rows[first:end]]
        assert [found[a:b] for a, b in zip(of[:-1], of[1:], strict=True)] == expected


@given(texts)
def test_equal_words_have_equal_hashes_and_others_do_not(rows):
    data, offsets = W.flat(pa.array(rows, pa.string()))
    starts, ends, _ = W.spans(data, offsets, W.SPACE)
    found = [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    hashes = W.hashes(data, starts, ends).tolist()
    assert len(set(zip(found, hashes, strict=True))) == len(set(found)) == len(set(hashes))


def test_slices_take_each_row_once_and_a_long_one_alone():
    column = pa.array(["aa", "b" * 100, "", None, "c"]).slice(0, 5)
    got = [(a, b) for a, b, _, _ in W.slices(column, 10)]
    assert got[0] == (0, 1) and [b for _, b in got][-1] == 5
    assert all(x[1] == y[0] for x, y in zip(got, got[1:], strict=False))


def test_shingles_depend_on_order():
    a = W.shingles(np.array([1, 2, 3, 4, 5], np.uint64), 5)[0]
    assert a != W.shingles(np.array([2, 1, 3, 4, 5], np.uint64), 5)[0]


@pytest.mark.parametrize("size", [5, 8])
@pytest.mark.parametrize("many", range(10))
def test_fewer_words_than_a_shingle(many, size):
    words = np.arange(1, many + 1, dtype=np.uint64)
    got = W.shingles(words, size)
    assert len(got) == many
    # The last runs are those of the words with zeros behind them.
    assert got.tolist() == W.shingles(np.append(words, np.zeros(size, np.uint64)), size)[:many].tolist()


@pytest.mark.parametrize("large", [1, 10, 4096])
def test_common_keys_are_joined_apart(spark, monkeypatch, large):
    """Rows of common and other keys, at any limit; keys without a counted row go."""
    monkeypatch.setattr(skew, "LARGE", large)
    rows = spark.range(2000).selectExpr("IF(id % 3 = 0, 7, id % 50) AS k", "id")
    table = rows.groupBy("k").count().where("k <> 9").withColumnRenamed("count", "n").withColumn("more", F.col("k") * 2)
    got = skew.join_counted(rows, table, "k", "n", 2000).select("k", "id", "n", "more").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, rows.join(table, "k").select("k", "id", "n", "more").collect()))
    assert len(got) == 2000 - rows.where("k = 9").count()
