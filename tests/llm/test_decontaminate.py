import hashlib
import re

import numpy as np
import pytest
from helpers_llm import frame, words

from logweft.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def cut(text):
    return WORD.findall((text or "").translate(FOLD))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = cut(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).update({item} - {None})
    out = []
    for doc_id, text in docs:
        w, hit, found = cut(text), set(), set()
        for i in range(len(w)):
            for n in range(1, min(10, len(w) - i) + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        ids = ",".join(sorted(map(str, found)))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.fixture
def benchmark(spark):
    items = [(1, words(6, 30)), (2, "One!"), (12, words(900, 12, 5000).upper()), (3, None), (4, "..."), (None, "one"),
             (5, words(6, 30)), (6, "«été» 中文"), (7, "«ÉTÉ» 中文")]
    return spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string"), items


@pytest.mark.parametrize("shard", [D.SHARD_BYTES, 100])
def test_against_brute_force(messy, benchmark, shard, monkeypatch):
    table, items = benchmark
    docs = [(r.doc_id, r.text) for r in messy.collect()]
    monkeypatch.setattr(D.find, "__defaults__", (D.WINDOW, shard, "found"))
    plan = D.digest(messy, table)._jdf.queryExecution().executedPlan().toString()
    assert (plan.count("MapInArrow") == 1) == (shard == D.SHARD_BYTES) and "Exchange" not in plan.replace("Exchange RoundRobin", "")
    got = [tuple(r) for r in D.digest(messy, table).collect()]
    assert sorted(got, key=str) == brute(docs, items)


def test_places_in_the_original_text(spark, benchmark):
    rows = [(1, "🙂 -- One, two; «ÉTÉ» 中文! two -one", "en", "a")]
    found = D.find(frame(spark, rows), benchmark[0]).first().found
    assert [rows[0][1][s.start : s.end] for s in found.spans] == ["One", "«ÉTÉ» 中文", "one"]


def test_clean_keeps_the_rest(messy, benchmark, nothing):
    kept = D.clean(messy, benchmark[0])
    assert kept.columns == messy.columns
    rows = brute([(r.doc_id, r.text) for r in messy.collect()], benchmark[1])
    assert 0 < kept.count() == sum(not r[5] for r in rows) < len(rows)
    assert D.digest(nothing, benchmark[0]).count() == 0
    assert D.digest(messy, benchmark[0].limit(0)).where("contaminated").count() == 0


def test_items_without_an_id(spark):
    """Their copies are found and go; only the list of items leaves them out."""
    lone = words(77, 30, 5000)
    table = spark.createDataFrame([(None, lone), (1, words(78, 30, 5000))], "item_id long, text string")
    docs = frame(spark, [(1, "a " + lone + " b", "en", "a"), (2, "c d e", "en", "a")])
    found = {r.doc_id: r.found for r in D.find(docs, table).collect()}
    assert (len(found[1].hit_words), found[1]["items"], len(found[1].spans)) == (30, [], 1)
    assert [r.doc_id for r in D.clean(docs, table).collect()] == [2]
    assert {r.doc_id: (r.contaminated, r.n_hit, r.n_items) for r in D.digest(docs, table).collect()} == {1: (True, 30, 0), 2: (False, 0, 0)}


def test_windows_share_hashes_but_not_words(spark, monkeypatch):
    """Candidates that only share hashes are no hits: the automaton decides."""
    monkeypatch.setattr(D, "hashes", lambda data, starts, ends: np.full(len(starts), 7, np.uint64))
    windows = D.Windows([(1, b"a b c"), (2, b"x " * 12), (None, b"d"), (4, b"")], 10)
    texts = [b"a b d", b"A, b! c?", b"q", b"x " * 11, b"", b"c a b"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    found = D._found(windows, data, np.cumsum([0, *map(len, texts)]), [None] * len(texts))
    assert [f["hit_words"] for f in found] == [[2], [0, 1, 2], [], list(range(11)), [], []]
    assert [f["items"] for f in found] == [[], [1], [], [2], [], []]
