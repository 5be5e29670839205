"""The audit against sums over all kept terms, and its SQL on rows with defects."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers_llm import frame, words

from logweft.llm import source_divergence as sd


def brute(rows, least_docs, top):
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        own = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        counts[lang or "", source or ""].update(own)
        docs[lang or ""].update(set(own))
    out = []
    for lang in {lang for lang, _ in counts}:
        kept = [t for t, n in docs[lang].items() if n >= least_docs]
        sources = [s for other, s in counts if other == lang]
        whole = sum((counts[lang, s] for s in sources), Counter())

        def shares(count, kept=kept):
            total = sum(count[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (count[t] + 5) // total for t in kept}

        p, q = {s: shares(counts[lang, s]) for s in sources}, shares(whole)
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            more = [(p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", more)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(found, 1) if part == "pair" or k <= top]
    return sorted(out)


def corpus():
    rows = []
    for i in range(240):
        text = words(i, 30 + i % 50, 60) + " É中 x" * (i % 3) + " W1A " * (i % 5) + f" only{i}"
        rows.append((i, text, ("en", "de", None)[i % 3], f"s{i % 7}" if i % 4 else "hot"))
    rows += [(300, None, "en", "empty"), (301, "", "en", "empty"), (302, "a b", "xx", "one"), (303, "c", "xx", None), (304, "c", "yy", "alone")]
    return rows + [(7, rows[7][1], "en", "hot")] * 12


def table(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in df.collect())


@pytest.mark.parametrize("least, top", [(30, 50), (2, 3), (1, 1000)])
def test_equals_sums_over_all_terms(spark, least, top):
    docs = frame(spark, corpus()).repartition(5)
    assert table(sd.report(docs, least, top)) == brute(corpus(), least, top)


def test_in_blocks_of_rows_and_shards(spark, monkeypatch):
    monkeypatch.setattr(sd, "CELLS", 9)
    monkeypatch.setattr(sd, "SHARD_POSTINGS", 2)
    monkeypatch.setattr(sd, "LEAST_SHARDS", 3)
    assert table(sd.report(frame(spark, corpus()), 3, 5)) == brute(corpus(), 3, 5)


def test_defects(spark, messy, nothing):
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in messy.collect()]
    assert table(sd.report(messy, 2)) == brute(rows, 2, 50)
    assert sd.report(nothing).collect() == []


def test_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(sd, "PIECE", 7)
    text = "Abc dé\x00f g--h " * 50 + "end"
    expected = [t.lower() for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]
    assert [t.decode() for piece in sd.terms(text.encode()) for t in piece] == expected


def test_counts_passed_on_early(spark, monkeypatch):
    monkeypatch.setattr(sd, "HELD", 20)
    assert table(sd.report(frame(spark, corpus()), 30)) == brute(corpus(), 30, 50)


def test_shares_of_large_counts():
    counts = np.array([0, 5, 10**12, 3 * 10**14])
    total = 10**15 + 7
    assert sd.share(counts, total).tolist() == [1 + 10**9 * (int(c) + 5) // total for c in counts]
