import hashlib
from collections import Counter

import pytest
from helpers_llm import frame, words

from logweft.llm import substrings as S


def brute(texts):
    """(words, words kept) of each text."""
    split = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + 35]) for w in split for i in range(len(w) - 34))
    out = []
    for w in split:
        keep = [True] * len(w)
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                keep[i : i + 35] = [False] * 35
        out.append((w, [x for x, k in zip(w, keep, strict=True) if k]))
    return out


@pytest.fixture(scope="module")
def tangled(spark, messy):
    """Passages that overlap, repeat inside one text, follow each other, and one that many texts share."""
    a, b, c = words(20, 80, 5000), words(21, 45, 5000), words(22, 34, 5000)
    parts = a.split()
    rows = [
        (100, f"x1 {a} {b}", "en", "a"), (101, f"x2 {b} {a} x3", "en", "a"), (102, " ".join(parts[10:60]), "en", "a"),
        (103, f"{c} y1", "en", "a"), (104, f"{c} y2", "en", "a"), (105, f"{c} {parts[0]} z {c}", "en", "a"),
        (106, "same " * 80, "en", "a"), (107, "same " * 34, "en", "a"), (108, " ".join(parts[40:] + parts[:45]), "en", "a"),
    ]
    rows += [(200 + i, f"{words(300 + i, 20)} {b} {words(600 + i, 20)}", "en", "b") for i in range(40)]
    return frame(spark, rows).unionByName(messy).repartition(4)


@pytest.mark.parametrize("hot", [S.HOT, 5, 0])
def test_against_brute_force(tangled, hot):
    docs = tangled.select("doc_id", "text").collect()
    expected = [
        (d.doc_id, len(w), len(w) - len(k), hashlib.sha256(b" ".join(k)).hexdigest())
        for d, (w, k) in zip(docs, brute([d.text for d in docs]), strict=True)
    ]
    got = [tuple(r) for r in S.report(tangled, hot).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)


@pytest.mark.parametrize("many", [2, 3, 6])
def test_short_texts_alone_in_a_slice(spark, many):
    text = words(30, many)
    expected = (1, many, 0, hashlib.sha256(text.encode()).hexdigest())
    assert [tuple(r) for r in S.report(frame(spark, [(1, text, "en", "a")])).collect()] == [expected]
    docs = frame(spark, [(1, text, "en", "a"), (2, "long " * 300_000, "en", "a")]).coalesce(1)
    found = sorted(tuple(r)[:3] for r in S.report(docs).collect())
    assert found == [expected[:3], (2, 300_000, 300_000)]


def test_small_automata_find_the_same(tangled, monkeypatch):
    monkeypatch.setattr(S, "SHARD_BYTES", 100)
    expected = S.located({t: 2 for t in [words(1, 60).encode()]})
    assert list(expected.values()) == [[(0, 60)]]
    assert S.located({words(1, 60).encode(): 1, words(2, 60).encode(): 1}) == {}


def test_cleaned_texts(tangled, nothing):
    docs = tangled.collect()
    got = S.cleaned(tangled)
    assert got.columns == tangled.columns
    expected = []
    for d, (w, k) in zip(docs, brute([d.text for d in docs]), strict=True):
        if len(w) == len(k):
            expected.append((d.doc_id, d.text, None if d.text is None else len(d.text), d.ranges))
        elif k:
            text = b" ".join(k).decode()
            expected.append((d.doc_id, text, len(text), d.ranges))
    assert sorted(map(str, [tuple(r) for r in got.select("doc_id", "text", "n_chars", "ranges").collect()])) == sorted(map(str, expected))
    assert S.report(nothing).count() == 0 and S.cleaned(nothing).count() == 0
