"""URL filter, fingerprints, token counts and fixity."""

import hashlib
import math
import re

import numpy as np
import pytest
from helpers_llm import frame, words
from pyspark.sql import functions as F

from logweft.llm import fingerprints as P
from logweft.llm import fixity as X
from logweft.llm import token_counts as T
from logweft.llm import url_filter as U

# --- URL filter ------------------------------------------------------------------------

URLS = [
    "http://example.com/en/1", "https://WWW.Example.com/en/1?x=1&y=2", "http://a.example.com/en/", "http://example.com",
    "http://example.com?q=/en/", "http://b.net/es/9", "http://b.net/ES/9", "http://net/fr/", "http://notnet/fr/", "http://c.org/en/1#/x",
    "ftp://x//y", "no scheme com/", "://", "", None, "http://com/", "http://example.com:80/en/1", "x://a.com/en/://b.net/es/", "http://É.com/é\n#",
]


def parted(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def ruled(host, path):
    fits = [(own + start, said) for own, start, said in U.RULES if (host == own or host.endswith("." + own)) and path.startswith(start)]
    return max(fits, key=lambda f: len(f[0]), default=(None, None))


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, u, "h", "x") for i, u in enumerate(URLS)] + [(None, URLS[0], None, "x"), (0, URLS[0], "h", "x")]
    rows += [(100 + i, f"http://s{i % 50}.example.{'com' if i % 3 else 'net'}/{['en', 'es', 'fr'][i % 7 % 3]}/{i}", "h", "x") for i in range(1500)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, top string")


def test_rules_and_parts(pages):
    got = U.judge(pages).collect()
    urls = {r.page_id: r.url for r in pages.collect()}
    assert len(got) == pages.count()
    for r in got:
        assert (r.host, r.path) == parted(urls[r.page_id])
        rule, said = ruled(r.host, r.path)
        assert r.rule == rule
        assert r.verdict == (said or ("block" if r.score >= 0.5 else "allow"))
        assert 0 <= r.score <= 1


def test_trees_learn_what_rules_say(pages):
    """Trained on four fifths of the labelled urls, they judge the last fifth."""
    rows = U.prepared(pages).where("said is not null").withColumn("last", F.pmod(F.crc32(F.col("url").cast("binary")), F.lit(5)) == 0)
    model, known, rate = U.train(rows.where("not last"))
    test = U.with_rates(rows.where("last"), known, rate).toArrow()
    x = U.described(test)
    right = (model.score(x) >= 0.5) == (test["blocked"].to_numpy() == 1)
    assert len(right) > 100 and right.mean() > 0.97


def test_suffixes_are_counted_by_themselves(spark):
    """Each site has its own rate, however many there are, and a row to learn from is left out of its own."""
    urls = [f"http://s{i}.{'com' if i % 3 else 'net'}/{'es' if i % 2 else 'en'}/{k}" for i in range(3000) for k in range(3)]
    urls += ["http://x.org/" + "a" * (1 << 20) + f"b{k}/c" for k in range(2)]
    rows = U.prepared(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string"))
    labelled = rows.where("said is not null")
    known = U.statistics(labelled)
    assert known["site"].count() == labelled.select("site").distinct().count() > 2000
    found = U.with_rates(rows, known, 0.25).collect()
    told = {(r.site, r.said) for r in found if r.said}
    for r in found:
        if ("org" in r.host) or (r.site, "block") not in told and (r.site, "allow") not in told:
            assert r.site_rate == 0.25
        elif r.top == "com":
            assert r.site_rate == pytest.approx((0 + 4 * 0.25) / (3 + 4))
    assert len({r["head"] for r in found if r.top == "org"}) == 2
    alone = U.with_rates(labelled, known, 0.25, True).where("top = 'com'").select("site", "fold", "site_rate").collect()
    by_fold = {}
    for r in alone:
        by_fold.setdefault(r.site, []).append(r.fold)
    for r in alone:
        others = sum(f != r.fold for f in by_fold[r.site])
        assert r.site_rate == pytest.approx(1 / (others + 4))


def test_urls_without_labels(spark, pages):
    got = U.judge(spark.createDataFrame([(1, "http://c.org/x"), (2, None)], "page_id long, url string")).collect()
    assert {(r.page_id, r.verdict, r.score) for r in got} == {(1, "allow", 0.0), (2, "allow", 0.0)}
    assert U.judge(pages.limit(0)).count() == 0


def test_features_of_a_url():
    import pyarrow as pa

    row = U.features(pa.array(["http://a-b.c/d/12?e=1&f=2"]), pa.array(["/d/12"]))[0]
    text = "http://a-b.c/d/12?e=1&f=2"
    entropy = -sum(text.count(c) / len(text) * math.log2(text.count(c) / len(text)) for c in set(text))
    assert row == pytest.approx([25, 4 / 25, entropy, 3, 1, 1, 2, 5, 2 / 5])


# --- fingerprints ----------------------------------------------------------------------


def edited(rows):
    """(doc_id, n_chars, edited text) in the order of falling ids, nulls last, then of texts."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    out = []
    for i, (doc_id, text) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        half = len(text) // 2
        out.append((doc_id, len(text), text[: len(text) - half] + after[:half]))
    return out


@pytest.mark.parametrize("rows_per_bucket", [1, 4, 1000])
def test_edited_texts(messy, rows_per_bucket, monkeypatch):
    monkeypatch.setattr(P, "BUCKET_ROWS", rows_per_bucket)
    rows = [(r.doc_id, r.text or "") for r in messy.collect()]
    expected = [(d, n, hashlib.sha256(t.encode()).hexdigest()) for d, n, t in edited(rows)]
    got = P.compare(messy)
    found = [tuple(r) for r in got.select("doc_id", "n_chars", "edited_sha256").collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)
    for r in got.collect():
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1


def test_more_buckets_than_256(spark, monkeypatch):
    monkeypatch.setattr(P, "BUCKET_ROWS", 1)
    rows = [(i * 7 % 601, f"t{i} a b c d e f {i % 5}") for i in range(600)]
    docs = frame(spark, [(*r, "en", "a") for r in rows])
    assert P.bucketed(docs.select("doc_id")).select("bucket").distinct().count() > 256
    found = [tuple(r) for r in P.compare(docs).select("doc_id", "n_chars", "edited_sha256").collect()]
    assert sorted(found) == sorted((d, n, hashlib.sha256(t.encode()).hexdigest()) for d, n, t in edited(rows))


def test_ids_that_are_all_null_and_single_documents(spark, nothing):
    one = P.compare(frame(spark, [(7, "a b c d e f g h", "en", "a")])).first()
    assert one.near_next == 1 and one.edited_sha256 == hashlib.sha256(b"a b c d a b c d"[:8] + b"a b c d").hexdigest()
    rows = [(None, "x y z " * 9, "en", "a"), (None, "b", "en", "a")]
    got = P.compare(frame(spark, rows)).select("n_chars", "edited_sha256").collect()
    expected = [(n, hashlib.sha256(t.encode()).hexdigest()) for _, n, t in edited([r[:2] for r in rows])]
    assert sorted(map(tuple, got)) == sorted(expected)
    assert P.compare(nothing).count() == 0


def test_sketches(spark):
    a, b = words(1, 4000, 9000), words(2, 200, 9000)
    rows = spark.createDataFrame([(a, b, f"{a} {b}", a.replace(" ", "\n\t")), ("", "x", None, "x y")], "a string, b string, c string, d string")
    s = {n: F.col(n) for n in "abcd"}
    rows = rows.select(*[P.sketch(s[n]).alias(n) for n in "abcd"])
    got = rows.select("*", P.containment(s["b"], s["c"]).alias("small"), P.containment(s["a"], s["b"]).alias("none"), P.merged(s["a"], s["b"]).alias("both")).collect()
    big, small = got
    assert big.a == big.d and big.small == 1 and big.none < 0.02 and len(big.b) > P.FEW
    assert abs(len(big.a) / 3996 * P.SCALE - 1) < 0.1
    assert set(big.both) == set(big.a) | set(big.b) and len(set(big.c) - set(big.both)) <= 4
    assert (small.a, small.c, len(small.b), len(small.d)) == ([], [], 1, 1)
    assert small.none == 0


def test_containment_estimates(spark):
    """Half of a document is found in a text that begins with it and goes on otherwise."""
    texts = [(words(i, 600, 9000), words(i, 300, 9000) + " " + words(i + 500, 2000, 9000)) for i in range(40)]
    rows = spark.createDataFrame(texts, "a string, b string")
    share = rows.select(F.avg(P.containment(P.sketch(F.col("a")), P.sketch(F.col("b"))))).first()[0]
    assert abs(share - 0.5) < 0.03


def likeness(own, other):
    """What two fingerprints say, from their texts alone."""
    limit = (1 << 64) // P.SCALE
    mine, its = ({(int(h, 16) + (1 << 63)) % (1 << 64) for h in x.split(",") if h} for x in (own, other))
    if not mine:
        return float(not its)
    if not (max(mine) >= limit and max(its, default=0) >= limit):
        mine = {h for h in mine if h < limit}
    return len(mine & its) / len(mine) if mine else 0.0


def test_likeness_follows_from_the_fingerprints(spark, messy):
    rows = [(r.doc_id, r.text, "en", "a") for r in messy.collect()]
    rows += [(100 + i, words(i % 40, 1 + 7 * i % 300, 900), "en", "a") for i in range(120)]
    given = {}
    for i, (doc_id, text, *_) in enumerate(rows):  # one of each id, so that the next one is known
        given.setdefault(doc_id, (doc_id, text, "en", f"{i}"))
    got = {r.doc_id: r for r in P.compare(frame(spark, list(given.values()))).collect()}
    order = sorted(given, key=lambda d: (d is None, -(d or 0)))
    for i, doc_id in enumerate(order):
        r, after = got[doc_id], got[order[(i + 1) % len(order)]]
        assert r.near_edited == pytest.approx(likeness(r.fingerprint, r.edited_fingerprint))
        assert r.near_next == pytest.approx(likeness(r.fingerprint, after.fingerprint))


def test_short_texts_in_long_ones(spark):
    """A document that the next one holds whole has likeness 1 if any of its hashes is below the limit."""
    rows = []
    for i in range(120):
        short = words(i, 5 + i % 20, 9000)
        rows += [(2 * i + 1, short, "en", "a"), (2 * i, f"{words(i + 500, 400, 9000)} {short} {words(i + 700, 40, 9000)}", "en", "a")]
    got = {r.doc_id: r for r in P.compare(frame(spark, rows)).collect()}
    found = {d: r.near_next for d, r in got.items() if d % 2}
    assert set(found.values()) <= {0, 1}
    assert all(found[2 * i + 1] == 1 for i in range(120) if i % 20 >= 10) and sum(found.values()) > 100


def test_whole_and_cut_sketches(spark):
    limit = -(1 << 63) + (1 << 64) // P.SCALE
    low, high = [limit - 9 - i for i in range(4)][::-1], [limit + 5 + i for i in range(4)]
    cases = [
        (high[:1], high[:1], 1, [high[0]]),
        (high[:1], high[1:2], 0, high[:2]),
        (high[:1], low[:1], 0, low[:1]),
        (low[:2] + high[:2], low[:1] + high[:1], 0.5, low[:2] + high[:2]),
        (low[:2] + high[:2], low[:2], 1, low[:2]),
        (low[:2], low[:1] + high, 0.5, low[:2]),
        ([], [], 1, []),
        ([], low, 0, low),
        (low, [], 0, low),
        (high, [], 0, []),
    ]
    rows = spark.createDataFrame([(a, b) for a, b, _, _ in cases], "a array<bigint>, b array<bigint>")
    got = rows.select(P.containment(F.col("a"), F.col("b")), P.merged(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(share, both) for _, _, share, both in cases]


# --- token counts ----------------------------------------------------------------------


def test_tokens_of_sections(messy, nothing):
    with open(T.VOCABULARY, "rb") as file:
        own, _ = T.encoder(file.read())
    expected = []
    for r in messy.collect():
        head = f"{r.source or ''}\n{r.lang or ''}\n"
        record = (head + (r.text or "")).encode()
        names, sections, at = ["source", "lang"], [], 0
        for i, line in enumerate(record.split(b"\n")):
            sections.append([names[i] if i < 2 else "text", at, at + len(line), 0, 0])
            at += len(line) + 1
        at = outside = total = 0
        for token in own.encode_ordinary(record.decode()):
            end, inside = at + len(own.decode_single_token_bytes(token)), False
            for s in sections:
                if s[1] <= at < s[2]:
                    s[3], inside = s[3] + 1, True
                    s[4] |= end > s[2]
            outside, total, at = outside + (not inside), total + 1, end
        assert at == len(record)
        points = [(n, len(record[:a].decode()), len(record[:b].decode()), t, int(c)) for n, a, b, t, c in sections]
        expected.append((r.doc_id, len(record.decode()), total, outside, points))
    got = [(*r[:4], [tuple(s) for s in r.sections]) for r in T.attribute(messy).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert T.attribute(nothing).count() == 0


def test_long_runs_of_one_kind():
    with open(T.VOCABULARY, "rb") as file:
        own, lengths = coding = T.encoder(file.read())
    random = np.random.default_rng(5)
    blanks = [" ", "\n", "\t", "\r", "\x85", "\xa0", "\u3000", "\x1c"]
    for count in (4095, 4096, 4097, 5000):
        for run in [b * count for b in blanks] + ["".join(random.choice(blanks, count)) for _ in range(3)]:
            for before, after in (("", ""), ("a", "b"), ("x ", "'s"), ("!", "\n"), ("3", "7"), ("é", "中"), (" ", run + "z")):
                text = before + run + after
                assert T.token_ends(text, coding).tolist() == np.cumsum(lengths[own.encode_ordinary(text)]).tolist()
    for text in (" " * 3_000_000, "\n" * 3_000_000 + "x", "\n \t" * 1_000_000, "a" * 3_000_000, "!" * 3_000_000):
        ends = T.token_ends(text, coding)
        assert ends[-1] == len(text) and (np.diff(ends) > 0).all()


def test_a_token_over_a_boundary_counts_where_it_starts():
    tokens, over, outside = T.allocate(np.array([3, 5, 9, 10]), np.array([0, 4, 9]), np.array([4, 6, 9]))
    assert (tokens.tolist(), over.tolist(), outside) == ([2, 1, 0], [True, True, False], 1)
    # Tokens start at 0, 3, 5 and 9; the sections are 0-4, 4-6 and an empty one.
    assert tokens.tolist() == [2, 1, 0] and over.tolist() == [True, True, False] and outside == 1


# --- fixity ----------------------------------------------------------------------------


def test_only_damaged_records_are_found(spark):
    rows = [(f"f{i % 3}", i * 5000, bytes([i % 251]) * (i % 97)) for i in range(600)]
    left = spark.createDataFrame([(*r, "x") for r in rows], "file string, offset long, payload binary, leaf string")
    bad = dict([(("f1", 5000), b"other"), (("f0", 0), None), (("f2", 599 * 5000), b"zz")])
    other = [(f, o, bad.get((f, o), p), "x") for f, o, p in rows if (f, o) != ("f1", 100 * 5000)] + [("f9", 7, b"new", "x"), ("f0", 3, b"more", "x")]
    right = spark.createDataFrame(other, left.schema)
    got = {(r.file, r.offset): r.state for r in X.audit(left, right).collect()}
    assert got == {("f1", 5000): "changed", ("f2", 599 * 5000): "changed", ("f1", 100 * 5000): "right", ("f9", 7): "left", ("f0", 3): "left"}
    assert X.audit(left, left.orderBy(F.rand(3))).count() == 0
    assert X.audit(left.limit(0), left.limit(0)).count() == 0


def test_odd_records(spark):
    rows = [(None, None, None), ("a", None, b"1"), ("a", None, b"2"), ("a", 5, b"1"), ("a", 5, b"1")]
    left = spark.createDataFrame(rows, "file string, offset long, payload binary")
    assert X.audit(left, left).count() == 0
    once = spark.createDataFrame(rows[:4], left.schema)
    assert [(r.file, r.offset, r.state) for r in X.audit(left, once).collect()] == [("a", 5, "changed")]
    swapped = spark.createDataFrame([rows[2], rows[1], *rows[3:], rows[0]], left.schema)
    assert X.audit(left, swapped).count() == 0


def test_archive_offsets_follow_the_payloads(pages):
    rows = X.archive(pages).collect()
    by_file = {}
    for r in sorted(rows, key=lambda r: (r.file, r.offset)):
        assert r.offset == by_file.get(r.file, 0)
        by_file[r.file] = r.offset + len(r.payload.encode())
    assert len(rows) == pages.count()
    assert X.audit(X.archive(pages), X.damaged(X.archive(pages))).count() > 0
