import numpy as np
import pyarrow as pa
import pytest
from helpers_llm import frame, words
from pyspark.sql import functions as F

import corpus_pipeline
from logweft.llm import neardup as N
from logweft.llm.components import components
from logweft.llm.words import flat


def sets(texts, idf):
    hash_, weight, counts = N.weighted(*flat(pa.array([t or "" for t in texts])), idf)
    ends = np.cumsum(counts)
    return [(hash_[e - c : e], weight[e - c : e]) for e, c in zip(ends, counts, strict=True)]


def brute(docs, idf):
    """Class id of each document, from all pairs."""
    one, root = sets([t for _, t in docs], idf), list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (docs[i][1] or "") == (docs[j][1] or "") or N.jaccard(one[i], one[j]) >= N.SIMILARITY:
                root[find(i)] = find(j)
    members = {}
    for i, (doc_id, _) in enumerate(docs):
        members.setdefault(find(i), []).append(doc_id)
    lead = {r: min((d for d in ds if d is not None), default=None) for r, ds in members.items()}
    return sorted(((d, lead[find(i)], len(members[find(i)])) for i, (d, _) in enumerate(docs)), key=str)


@pytest.fixture(scope="module")
def copies(spark, messy):
    """A chain in which neighbours are alike and its ends are not, a star, and texts that are close but not enough."""
    base = words(50, 300, 3000).split()
    rows = []
    for i in range(6):
        changed = [w if not (j // 12 < i and j % 12 == 0) else f"c{j}" for j, w in enumerate(base)]
        rows.append((1000 + i, " ".join(changed), "en", "a"))
    for i in range(60):
        w = words(51, 250, 3000).split()
        w[(i * 4) % 250] = f"n{i}"
        rows.append((2000 + i, " ".join(w), "en", "b"))
    for i in range(8):
        w = words(52, 120, 3000).split()
        for j in range(6 + i):
            w[(j * 17 + i) % 120] = f"m{i}x{j}"
        rows.append((3000 + i, " ".join(w), "de", "b"))
    for i in range(60):
        w = words(53, 140, 3000).split()
        for j in range(5):
            w[(j * 28 + i % 20) % 140] = f"p{i // 3 if j < 4 else i}x{j}"
        rows.append((5000 + i, " ".join(w), "de", "b"))
    rows += [(4000 + i, t, "en", "c") for i, t in enumerate(["a b", "a b", "a b c", "b a", "one"])]
    return frame(spark, rows).unionByName(messy).repartition(4)


def test_against_all_pairs(copies):
    docs = [(r.doc_id, r.text) for r in copies.select("doc_id", "text").collect()]
    idf = N.rarity(*N.frequencies(copies))
    assert sorted([tuple(r) for r in N.report(copies).collect()], key=str) == brute(docs, idf)


def test_exact_against_all_pairs(copies):
    docs = [(r.doc_id, r.text) for r in copies.select("doc_id", "text").collect()]
    found = N.classes(copies, exact=True)
    rows = copies.select("doc_id", N.text_key().alias("key")).join(found, "key").select("doc_id", "class_id", "class_size")
    assert sorted([tuple(r) for r in rows.collect()], key=str) == brute(docs, N.rarity(*N.frequencies(copies)))


def edited(base, times, seed, new):
    own = list(base)
    random = np.random.default_rng(seed)
    for k, at in enumerate(random.choice(len(own), times, replace=False)):
        own[at] = new(k, random)
    return own


def test_compared_pairs_grow_with_the_texts(spark, monkeypatch):
    """Two families of near misses, with common and with own words at the same places, and others: few pairs for each text."""
    compared, pairs = N.compared, []
    monkeypatch.setattr(N, "compared", lambda rows, *rest: pairs.append(rows.count()) or compared(rows, *rest))
    new = lambda k, r: f"common{r.integers(50)}", lambda k, r: f"own{r.integers(1 << 40)}"
    each = []
    for size in (300, 600, 1200):
        bases = [words(70 + i, 60, 5000).split() for i in (0, 1)]
        texts = [" ".join(edited(bases[i % 2], 3, i, new[i % 2])) for i in range(2 * size)] + [words(9000 + i, 60, 5000) for i in range(500)]
        pairs.clear()
        N.classes(frame(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]).repartition(4))
        each.append(sum(pairs) / (2 * size))
    assert max(each) < 40 and each[2] < 1.6 * each[1] < 3 * each[0] + 3, each


def test_links_away_from_every_lead(spark):
    """Twins of similarity 0.8 to 0.9 inside families whose texts are like neither the base nor each other."""
    rows, twins = [], []
    for family in range(12):
        base = words(700 + family, 100, 5000).split()
        for i in range(50):
            one = edited(base, 4 + i % 12, 100 * family + i, lambda k, r: f"n{r.integers(1 << 40)}")
            two = edited(one, 2, 7, lambda k, r: f"m{r.integers(1 << 40)}")
            twins.append((len(rows), len(rows) + 1))
            rows += [" ".join(one), " ".join(two)]
    docs = frame(spark, [(i, t, "en", "a") for i, t in enumerate(rows)]).repartition(4)
    one = sets(rows, N.rarity(*N.frequencies(docs)))
    linked = [(i, j) for i, j in twins if 0.8 <= N.jaccard(one[i], one[j]) < 0.9]
    found = {r.doc_id: r.class_id for r in N.report(docs).collect()}
    assert len(linked) > 300
    assert sum(found[i] == found[j] for i, j in linked) >= 0.99 * len(linked)


def test_no_link_away_from_the_leads_is_left_out(spark):
    """Twins inside large families of near misses: all that share a bucket are in one class, whatever its lead."""
    rows = []
    for family in range(4):
        base = words(650 + family, 100, 5000).split()
        for i in range(300):
            one = edited(base, 4 + i % 12, 1000 * family + i, lambda k, r: f"n{r.integers(1 << 40)}")
            rows += [" ".join(one), " ".join(edited(one, 4, 7 + i, lambda k, r: f"m{r.integers(1 << 40)}"))]
    docs = frame(spark, [(i, t, "en", "a") for i, t in enumerate(rows)]).repartition(4)
    idf = N.rarity(*N.frequencies(docs))
    one, bands = sets(rows, idf), N.signatures(*N.weighted(*flat(pa.array(rows)), idf))
    twins = [i for i in range(0, len(rows), 2) if N.jaccard(one[i], one[i + 1]) >= 0.6 and (bands[i] == bands[i + 1]).any()]
    found = {r.doc_id: r.class_id for r in N.report(docs, 0.6).collect()}
    assert len(twins) > 200 and [i for i in twins if found[i] != found[i + 1]] == []


def test_the_pipeline_keeps_one_of_two_linked_texts(spark, monkeypatch):
    """Its stage finds the links that are away from every lead, too: twins that share a bucket do not both stay."""
    monkeypatch.setattr(N.kept, "__defaults__", (0.6,))
    rows = []
    for family in range(4):
        base = words(650 + family, 100, 5000).split()
        for i in range(300):
            one = edited(base, 4 + i % 12, 1000 * family + i, lambda k, r: f"n{r.integers(1 << 40)}")
            rows += [" ".join(one), " ".join(edited(one, 4, 7 + i, lambda k, r: f"m{r.integers(1 << 40)}"))]
    docs = frame(spark, [(i, t, "en", "a") for i, t in enumerate(rows)]).repartition(4)
    idf = N.rarity(*N.frequencies(docs))
    one, bands = sets(rows, idf), N.signatures(*N.weighted(*flat(pa.array(rows)), idf))
    twins = [i for i in range(0, len(rows), 2) if N.jaccard(one[i], one[i + 1]) >= 0.6 and (bands[i] == bands[i + 1]).any()]
    stays = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").select("doc_id").collect()}
    assert len(twins) > 200 and [i for i in twins if {i, i + 1} <= stays] == []


@pytest.mark.parametrize("blocks", [1, 3])
def test_links_of_a_bucket_against_all_pairs(spark, blocks, monkeypatch):
    """The cells of a bucket connect what all its links connect, links at the threshold itself too."""
    monkeypatch.setattr(N, "BLOCK_TEXTS", -(-90 // blocks))
    base, idf = words(640, 44, 5000).split(), np.ones(N.FREQUENCIES, np.float32)
    texts = [" ".join(base), " ".join(base[:-4] + ["x"])] + ["one two three four five six seven", "one two"]
    texts += [" ".join(edited(base, i % 3, i // 3, lambda k, r: f"n{r.integers(9)}")) for i in range(86)]
    rows = spark.createDataFrame(list(enumerate(texts)), "number long, text string")
    members = rows.selectExpr("7L AS band", "number", "CASE WHEN number % 9 = 0 THEN 0L ELSE number END AS root")
    assert N.cells(members, rows).select("one", "other").distinct().count() == blocks * (blocks + 1) // 2
    got = [(r.a, r.b) for r in N.linked(members, rows, idf, 0.8).collect()]
    one, all_ = sets(texts, idf), [(i, 0) for i in range(0, 90, 9)]
    links = [(i, j) for i in range(90) for j in range(i) if N.jaccard(one[i], one[j]) >= 0.8]
    assert all((max(p), min(p)) in links for p in got) and len(got) <= 89 * blocks * (blocks + 1) // 2

    def classes(pairs):
        label = list(range(90))
        for a, b in pairs:
            label = [label[a] if x == label[b] else x for x in label]
        return {frozenset(i for i in range(90) if label[i] == x) for x in label}

    assert classes(got + all_) == classes(links + all_)


def test_one_of_each_class_stays(copies, nothing):
    kept = N.kept(copies)
    assert kept.columns == copies.columns
    report = N.report(copies)
    ids = [r.class_id for r in report.select("class_id").distinct().collect()]
    assert sorted([r.doc_id for r in kept.where("doc_id <> 9").collect()], key=str) == sorted([i for i in ids if i not in (9, None)], key=str)
    # The texts with the id 9 that are in different classes both stay.
    assert kept.where("doc_id = 9").count() == 2
    assert N.report(nothing).count() == 0 and N.kept(nothing).count() == 0


@pytest.mark.parametrize("text", ["Page found", "Page not found", "one two three four five six"])
def test_short_texts_alone_and_with_other_white_space(spark, text):
    alone = frame(spark, [(1, text, "en", "a")])
    assert [tuple(r) for r in N.report(alone).collect()] == [(1, 1, 1)]
    docs = frame(spark, [(1, text, "en", "a"), (2, text + "\n", "en", "a"), (3, text.replace(" ", "\t"), "en", "a")])
    assert sorted(tuple(r) for r in N.report(docs).collect()) == [(1, 1, 3), (2, 1, 3), (3, 1, 3)]
    assert [r.doc_id for r in N.kept(docs).collect()] == [1]


def test_differences_from_a_lead():
    """Alike texts, one of them not like the lead, overlap in their differences at least as said."""
    random = np.random.default_rng(4)
    seen = 0
    for _ in range(3000):
        lead = {int(h) * 2: 1.0 + h % 3 for h in random.choice(80, 40, replace=False)}

        def edit(text, times):
            text = dict(text)
            for h in random.choice(list(text), times, replace=False):
                del text[int(h)]
                text[int(random.integers(100, 130)) * 2] = float(random.integers(1, 4))
            return text

        left = edit(lead, random.integers(0, 9))
        right = edit(left if random.random() < 0.7 else lead, random.integers(0, 7))
        own = [(np.array(sorted(t), np.uint64), np.array([t[h] for h in sorted(t)])) for t in (left, right, lead)]
        if N.jaccard(own[0], own[1]) < 0.8 or N.jaccard(own[1], own[2]) >= 0.8:
            continue
        seen += 1
        (h0, w0, need, _), (h1, w1, _, any_) = (N.difference(own[i], own[2], 0.8) for i in (0, 1))
        _, i, j = np.intersect1d(h0, h1, return_indices=True)
        overlap = np.minimum(w0[i], w1[j]).sum()
        assert overlap >= need - 1e-9 and overlap >= any_ - 1e-9
    assert seen > 50


def test_document_frequencies(spark):
    counts, documents = N.frequencies(frame(spark, [(1, "a a b", "", ""), (2, "a", "", ""), (3, None, "", "")]))
    assert documents == 3 and sorted(counts[counts > 0]) == [1, 2]


def test_samples_agree_as_often_as_texts_are_alike():
    """The share of equal bands of four samples against the similarity to the power four."""
    idf = np.ones(N.FREQUENCIES, np.float32)
    alike, equal = [], []
    for seed in range(60):
        left = words(seed, 200, 5000).split()
        right = [w if j % 40 else f"k{j}" for j, w in enumerate(left)]
        hash_, weight, counts = N.weighted(*flat(pa.array([" ".join(left), " ".join(right)])), idf)
        bands = N.signatures(hash_, weight, counts)
        one, other = sets([" ".join(left), " ".join(right)], idf)
        alike.append(N.jaccard(one, other) ** N.ROWS)
        equal.append((bands[0] == bands[1]).mean())
    assert abs(np.mean(alike) - np.mean(equal)) < 0.06


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(200, 100), (150, 100)], "a long, b long")
    got = {r.id: r.root for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 150: 100, 200: 100}
    assert components(links.limit(0)).count() == 0


def test_links_without_a_common_bucket(spark, monkeypatch):
    """The pipeline's stage keeps one of two texts that are alike, even where no band of samples says so."""
    monkeypatch.setattr(N.kept, "__defaults__", (0.6,))
    rows = []
    for i in range(400):
        one = words(20_000 + i, 60 + i % 50, 5000).split()
        rows += [" ".join(one), " ".join(edited(one, 2 + i % 3, i, lambda k, r: f"m{r.integers(1 << 40)}"))]
    docs = frame(spark, [(i, t, "en", "a") for i, t in enumerate(rows)]).repartition(4)
    idf = N.rarity(*N.frequencies(docs))
    one, bands = sets(rows, idf), N.signatures(*N.weighted(*flat(pa.array(rows)), idf))
    alone = [i for i in range(0, len(rows), 2) if N.jaccard(one[i], one[i + 1]) >= 0.6 and not (bands[i] == bands[i + 1]).any()]
    stays = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").select("doc_id").collect()}
    assert len(alone) > 10 and [i for i in alone if {i, i + 1} <= stays] == []


def test_texts_that_are_alike_share_a_shingle_of_their_prefixes():
    """Whatever is common: of two texts at the threshold or above, both begin with one, and have enough weight left there."""
    texts = []
    for i in range(120):
        one = words(31_000 + i, 20 + i, 3000).split()
        texts += [" ".join(one), " ".join(edited(one, 1 + i % 4, i, lambda k, r: f"m{r.integers(1 << 40)}"))]
    idf, seen = np.random.default_rng(3).uniform(1, 9, N.FREQUENCIES).astype(np.float32), 0
    shingles = N.weighted(*flat(pa.array(texts)), idf)
    one = sets(texts, idf)
    for common in (shingles[0][:0], np.sort(shingles[0][::3]), np.unique(shingles[0])):
        row, hash_, weight, rest = N.prefixes(*shingles, common, 0.7)
        of = [{h: (w, r) for h, w, r in zip(hash_[row == i], weight[row == i], rest[row == i], strict=True)} for i in range(len(texts))]
        full = [own[1].sum() for own in one]
        for i in range(0, len(texts), 2):
            if N.jaccard(one[i], one[i + 1]) >= 0.7:
                seen += 1
                need = 0.7 / 1.7 * (full[i] + full[i + 1]) * (1 - N.ROUNDED)
                both = [(of[i][h], of[i + 1][h]) for h in of[i].keys() & of[i + 1].keys()]
                assert max(min(x[1], y[1]) for x, y in both) >= need
                assert sum(min(x[0], y[0]) for x, y in both) + 0.7 * max(full[i], full[i + 1]) >= need
    assert seen > 100


def test_a_class_meets_its_near_misses_in_one_bucket(spark):
    """Each near miss shares a shingle of its own with all texts of a class: these are not dealt out once for each."""
    size, misses = 200, 40
    shared = [(1000 * (j + 1), i, 95.0) for j in range(misses) for i in (*range(size), size + j)]
    shared += [(9, size, 95.0), (9, size + 1, 95.0), (9, size + misses, 50.0), (9, size + misses + 1, 95.0)]
    known = [(i, i, 100.0, 0 if i < size else i) for i in range(size + misses + 1)] + [(size + misses + 1, size + misses + 1, 70.0, size + misses + 1)]
    shared = spark.createDataFrame(shared, "hash long, own long, rest float").withColumn("weight", F.lit(50).cast("float"))
    known = spark.createDataFrame(known, "own long, number long, whole double, root long")
    near = [(r.band, r.number) for r in N.neighbours(shared, known, 0.8).collect()]
    assert len(near) == len(set(near)) == size + misses + 2
    buckets = {}
    for band, number in near:
        buckets.setdefault(band, set()).add(number)
    assert sorted(map(sorted, buckets.values())) == [list(range(size + misses)), [size, size + 1]]
