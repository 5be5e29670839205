"""Chunked packing against a plain loop over the rows."""

import random
import time

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logweft.operators import packing
from logweft.operators.packing import _joined, _Packer, _walked, pack_parts


def by_loop(sizes, opening, limit, separator, numbered):
    part, idx, used, placed = 1, 0, opening, []
    for size in sizes:

        def cost():
            return size + (separator if idx else 0) + (len(str(idx + 1)) if numbered else 0)

        if idx and used + cost() > limit:
            part, idx, used = part + 1, 0, opening
        used += cost()
        idx += 1
        placed.append((part, idx))
    return placed


def by_chunks(sizes, opening, limit, separator, numbered, chunk, fan):
    """Composed in a tree of ``fan`` neighbours, and down again."""
    opening -= separator
    packers = [
        _Packer(np.array(sizes[i : i + chunk], dtype=np.int64) + separator, opening, limit, numbered)
        for i in range(0, len(sizes), chunk)
    ]

    def table(steps, node):
        return steps.assign(unit="", node=node, step=np.arange(len(steps)), opening=opening)

    levels = [[table(p.steps(), i) for i, p in enumerate(packers)]]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([_joined(pd.concat(last[i : i + fan]), limit, numbered, fan) for i in range(0, len(last), fan)])
    states = {0: (opening, 0, 0)}
    for level in reversed(levels):
        below = {}
        for parent in {t["node"].iloc[0] // fan for t in level} if len(level) > 1 else {0}:
            children = [t for t in level if len(level) == 1 or t["node"].iloc[0] // fan == parent]
            used, rows, part_no = states[parent]
            walked = _walked(pd.concat(children).assign(used=used, rows=rows, part_no=part_no), limit, numbered)
            below |= {int(e.node): (int(e.used), int(e.rows), int(e.part_no)) for e in walked.itertuples()}
        states = below
    placed = []
    for i, packer in enumerate(packers):
        part_no, idx = packer.pack(*states[i])
        placed += zip(part_no.tolist(), idx.tolist())
    return placed


def test_a_composed_function_is_no_longer_than_a_part():
    """Many equal rows: the steps of the root are those of one part."""
    sizes = np.full(4096, 10, dtype=np.int64)
    tables = [
        _Packer(sizes[i : i + 64], 0, 1000, False).steps().assign(unit="", node=i // 64, opening=0) for i in range(0, 4096, 64)
    ]
    tables = [t.assign(step=np.arange(len(t))) for t in tables]
    while len(tables) > 1:
        tables = [_joined(pd.concat(tables[i : i + 8]), 1000, False, 8) for i in range(0, len(tables), 8)]
        assert max(map(len, tables)) <= 102


def test_many_small_parts_are_quick():
    started = time.perf_counter()
    packer = _Packer(np.full(131_072, 900, dtype=np.int64), 0, 5000, False)
    assert len(packer.steps()) <= 7
    part_no, _ = packer.pack(0, 0, 0)
    assert part_no.max() == -(-131_072 // 5)
    assert time.perf_counter() - started < 4


@settings(max_examples=400, deadline=None)
@given(
    sizes=st.lists(st.one_of(st.integers(1, 12), st.integers(1, 90)), min_size=1, max_size=120),
    opening=st.integers(0, 30),
    limit=st.integers(1, 80),
    separator=st.sampled_from([0, 2]),
    numbered=st.booleans(),
    chunk=st.integers(1, 40),
    fan=st.integers(2, 5),
)
def test_like_a_plain_loop(sizes, opening, limit, separator, numbered, chunk, fan):
    expected = by_loop(sizes, opening, limit, separator, numbered)
    assert by_chunks(sizes, opening, limit, separator, numbered, chunk, fan) == expected


@pytest.mark.parametrize("separator, numbered", [(0, False), (2, False), (0, True)])
def test_on_spark(spark, staging, separator, numbered, monkeypatch):
    monkeypatch.setattr(packing, "FAN_IN", 3)
    rng = random.Random(7)
    units = {"A": (900, 50), "B": (1, 10), "C": (400, 7)}
    rows = [(u, i, rng.choice([5, 30, 400]), o) for u, (n, o) in units.items() for i in range(n)]
    df = spark.createDataFrame(rows, "unit string, i long, size long, opening long")
    df = df.repartitionByRange(6, "unit", "i").sortWithinPartitions("unit", "i")
    df = df.withColumn("pos", F.monotonically_increasing_id())
    placed = pack_parts(staging, df.drop("i"), 1000, separator, numbered, chunk_rows=64).join(
        df.select("unit", "pos", "i"), ["unit", "pos"]
    )
    got = {(r["unit"], r["i"]): (r["part_no"], r["idx"]) for r in placed.collect()}
    for unit, (n, opening) in units.items():
        sizes = [size for u, _, size, _ in rows if u == unit]
        expected = by_loop(sizes, opening, 1000, separator, numbered)
        assert [got[unit, i] for i in range(n)] == expected


@pytest.mark.parametrize("steps", [1, 40, packing.TASK_STEPS])
def test_two_staged_tables_for_any_number_of_chunks(spark, staging, steps, monkeypatch):
    """Chunks of sixteen rows and one of all rows give the same parts; the tree is never staged."""
    monkeypatch.setattr(packing, "TASK_STEPS", steps)
    written, write = [], staging.write
    monkeypatch.setattr(staging, "write", lambda df, name: written.append(name) or write(df, name))
    df = spark.range(3000).select(
        F.lit("u").alias("unit"), F.col("id").alias("pos"), (F.pmod(F.xxhash64("id"), F.lit(90)) + 1).alias("size"), F.lit(20).cast("long").alias("opening")
    )
    small, whole = (pack_parts(staging, df, 700, 2, True, chunk_rows=n) for n in (16, 1 << 21))
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, whole.collect()))
    assert written == ["ranked", "steps"] * 2
