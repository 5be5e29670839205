"""Quality rules against plain Python, on whole rows with defects."""

import re

from helpers_llm import frame, words

from logweft.llm import quality_rules

SPACE = r"[^\x20\x09-\x0D]+"


def brute(text):
    text = text or ""
    own = re.findall(SPACE, text)
    lines = [line for line in text.split("\n") if re.search(SPACE, line)]
    windows = [tuple(own[i : i + 3]) for i in range(len(own) - 2)]
    twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 5000 else repeated(windows)
    hit = {i + k for i, w in enumerate(windows) if w in twice for k in range(3)}
    return {
        "n_words": len(own),
        "word_chars": sum(map(len, own)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(hit),
        "base_failed": len(own) < 50 or 100 * len(hit) > 50 * len(own),
    }


def repeated(windows):
    seen, twice = set(), set()
    for w in windows:
        (twice if w in seen else seen).add(w)
    return twice


def test_counts_equal_plain_ones(spark, messy):
    more = [
        (20, "a b c a b c", "en", "a"),
        (21, "a a a a", "en", "a"),
        (22, "a b", "en", "a"),
        (23, "same line\n same line\nsame line\n\n \t\nsame line", "en", "a"),
        (24, "#*$ 🙂🙂   x\u0085y %&|<>\x0b\x0cé", "en", "a"),
        (25, "x y z " * 40_000 + "end", "en", "a"),
    ]
    docs = messy.unionByName(frame(spark, more))
    given = sorted(((r.doc_id, r.text) for r in docs.collect()), key=repr)
    found = sorted(((r.doc_id, r) for r in quality_rules.report(docs).collect()), key=lambda x: repr((x[0], x[1])))
    expected = sorted(((i, brute(t)) for i, t in given), key=repr)
    got = sorted(((i, {k: r[k] for k in brute(None)}) for i, r in found), key=repr)
    assert got == expected


def prose(seed, count=80):
    own = words(seed, count).split()
    own[::7] = ["The"] * len(own[::7])
    return " ".join(own)


def test_each_rule_decides(spark):
    good = prose(1)
    rows = {
        1: (good, ""),
        2: (prose(2, 30), "words"),
        3: ("the w1 w2 w3 " * 20, "repeated words"),
        4: (" ".join(f"the {i % 10} {i // 10}" for i in range(60)), "word length"),
        5: (prose(3) + " $$$ ### %%% ***", "symbols"),
        6: (words(4, 80), "stop words"),
        7: (good + "\nx" * 4, "repeated lines"),
        8: ("\n".join("- " + prose(i, 9) for i in range(9)), "bullets"),
        9: ("\n".join(prose(i, 9) + "..." for i in range(9)), "cut lines"),
        10: (None, "words"),
        11: ("", "words"),
    }
    docs = frame(spark, [(i, t, None, None) for i, (t, _) in rows.items()])
    found = {r.doc_id: r for r in quality_rules.report(docs).collect()}
    for i, (_, rule) in rows.items():
        assert rule in found[i].failed and found[i].kept == (rule == ""), (i, found[i])
        assert not (found[i].base_failed and found[i].kept)
    assert {r.doc_id for r in quality_rules.kept(docs).collect()} == {1}
    assert quality_rules.kept(docs).columns == docs.columns


def test_own_table(spark):
    docs = frame(spark, [(1, "a b c", None, None), (2, "a b", None, None)])
    rules = [quality_rules.Rule("long", "n_words", "one", most=2_000)]
    assert [(r.doc_id, r.failed) for r in quality_rules.report(docs, rules).orderBy("doc_id").collect()] == [(1, "words, long"), (2, "words")]


def test_one_projection_without_python(spark, messy, nothing):
    plan = quality_rules.report(messy)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Python|Arrow|Pandas|Generate|Aggregate", plan.replace("Exchange RoundRobin", ""))
    assert quality_rules.report(nothing).count() == 0
