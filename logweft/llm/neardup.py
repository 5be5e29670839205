"""MinHash near-dedup by improved consistent weighted sampling over TF-IDF shingles.

A text is a weighted set: its runs of five words, weighed by their count in the text times the mean
inverse document frequency of their words. Consistent weighted samples of two texts agree
with the probability of their weighted Jaccard similarity. Texts that agree in a band of
samples are candidates, verified by that similarity itself.

Candidates are first compared with the lead of their bucket; texts that this links form classes. Only
buckets that then hold texts of different classes are left, each set of texts once. In these every
two texts of different classes are compared, exactly: what tells a text from a base is
short, the overlap of two such differences gives the similarity of the texts, and it is summed along
postings. Texts of the largest class need not be compared with each other, and links found on the way
make further pairs needless. So no link between texts that share a bucket is left out, whatever their
lead is like. The work on a bucket of near misses is quadratic by nature; it is cut into cells of
two blocks of bounded size, so that neither a task nor a table holds a bucket's pairs, and a cell gives
no more links than it takes to connect its texts.

A pair of similarity 0.8 shares a bucket with probability 0.9996, 6.6 of twenty on average; a pair of 0.9 with
1 - 2e-8. The rest is found by prefixes, exactly: with the shingles of all texts in one order, two texts
that are alike share some of those that make up the first fifth of each text's weight. Classes that share one after
which the remaining weight may suffice meet in a bucket, and their texts are compared
like the others. The order only decides how many pairs there are: shingles that are common in a sample come last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweft.llm.components import components
from logweft.llm.stage import release, unused, written
from logweft.llm.substrings import text_key
from logweft.llm.words import SPACE, hashes, lists, mix, shingles, slices, spans

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 5
#: Texts and bytes of texts to a block of a bucket, about; two blocks are compared in one go.
BLOCK_TEXTS, BLOCK_BYTES = 2048, 4 << 20
#: Similarities this close to the threshold are computed anew, from both whole texts.
CLOSE = 1e-6
#: Documents in the sample that tells common shingles, about, or their least share; how many of them hold one; how many are known.
COMMON_SAMPLE, COMMON_SHARE, COMMON_TIMES, COMMON = 20_000, 0.01, 3, 1 << 19
#: Bounds on weights that have been rounded are taken this much wider.
ROUNDED = 1e-5
#: Buckets of words for document frequencies; the table has this size for any corpus.
FREQUENCIES = 1 << 16
#: Entries of the table of random variates; a sample takes the one its hash of the shingle says.
VARIATES = 1 << 16

_UP = np.uint64(48)


def _variates() -> tuple[np.ndarray, ...]:
    """Of each entry: 1 / r, beta, r, and ln c - r, with r and c from Gamma(2, 1) and beta uniform."""
    random = np.random.default_rng(2010)
    r, c = random.gamma(2, 1, VARIATES), random.gamma(2, 1, VARIATES)
    return tuple(x.astype(np.float32) for x in (1 / r, random.random(VARIATES), r, np.log(c) - r))


def _multipliers(count: int) -> np.ndarray:
    return np.random.default_rng(2009).integers(1, 1 << 62, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, their frequency buckets, and the number of the first word of each row."""
    starts, ends, first = spans(data, offsets, SPACE)
    words = hashes(data, starts, ends)
    return words, (words >> _UP).astype(np.int64), first


def frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold a word of each bucket, and all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(FREQUENCIES, np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for _, _, data, offsets in slices(batch.column(0)):
                _, bucket, first = word_buckets(data, offsets)
                row = np.repeat(np.arange(len(first) - 1), np.diff(first))
                total += np.bincount(np.unique(row * FREQUENCIES + bucket) % FREQUENCIES, minlength=FREQUENCIES)
        some = np.flatnonzero(total)
        buckets, counts = np.append(some, FREQUENCIES), np.append(total[some], rows)
        yield pa.RecordBatch.from_arrays([pa.array(buckets), pa.array(counts)], names=["bucket", "n"])

    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counted = texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    rows = counted.toArrow()  # a row for each bucket at most
    table = np.zeros(FREQUENCIES + 1, np.int64)
    table[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return table[:-1], int(table[-1])


def rarity(counts: np.ndarray, documents: int) -> np.ndarray:
    return (1 + np.log((1 + documents) / (1 + counts))).astype(np.float32)


def weighted(data: np.ndarray, offsets: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of the rows in order of row and hash, their weights, and the number of each row's.

    A row of fewer than five words has one shingle of all of them; one without words has none.
    """
    words, bucket, first = word_buckets(data, offsets)
    rows, many = len(first) - 1, np.diff(first)
    grams = shingles(words, SHINGLE)
    rare = np.concatenate([[0.0], np.cumsum(idf[bucket], dtype=np.float64)])
    counts = np.where(many >= SHINGLE, many - SHINGLE + 1, (many > 0).astype(many.dtype))
    row = np.repeat(np.arange(rows), counts)
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + first[:-1][row]
    width = np.minimum(many, SHINGLE)[row]
    own = grams[at]
    short = np.flatnonzero(width < SHINGLE)
    for i in short:
        padded = np.zeros(SHINGLE, np.uint64)
        padded[: width[i]] = words[at[i] : at[i] + width[i]]
        own[i] = shingles(padded, SHINGLE)[0]
    weight = (rare[at + width] - rare[at]) / width
    key = row.astype(np.uint64) << _UP | own >> np.uint64(16)
    order = np.argsort(key)
    key = key[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    begin = np.flatnonzero(fresh)
    times = np.diff(np.append(begin, len(key)))
    return key[begin] << np.uint64(16), weight[order][begin] * times, np.bincount(row[order][begin], minlength=rows)


def signatures(hash_: np.ndarray, weight: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Band hashes of the rows that have shingles: improved consistent weighted samples, some to a band."""
    shrink, beta, r, rest = _variates()
    starts = np.cumsum(counts) - counts
    log = np.log(weight).astype(np.float32)
    out = np.empty((len(counts), BANDS), np.uint64)
    own = mix(hash_)
    for k, multiplier in enumerate(_multipliers(BANDS * ROWS)):
        entry = ((own * multiplier) >> _UP).astype(np.int64)
        shift = beta[entry]
        level = np.floor(log * shrink[entry] + shift)
        value = rest[entry] - r[entry] * (level - shift)
        least = np.flatnonzero(value == np.repeat(np.minimum.reduceat(value, starts), counts))
        place = least[np.searchsorted(least, starts)]
        sample = own[place] + level[place].astype(np.int64).view(np.uint64) * multiplier
        band = out[:, k // ROWS]
        if k % ROWS == 0:
            band[:] = np.uint64(k // ROWS)
        band[:] = mix(band ^ sample)
    return out


def _signed(rows: DataFrame, idf: np.ndarray) -> DataFrame:
    """The rows with ``bands``, those of texts without words empty, and ``whole``, their weight, in place of their ``text``."""
    shared = rows.sparkSession.sparkContext.broadcast(idf)
    own = [c for c in rows.columns if c != "text"]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in slices(batch.column("text")):
                hash_, weight, counts = weighted(data, offsets, shared.value)
                some = counts > 0
                bands = np.zeros((len(counts), BANDS), np.uint64)
                if some.any():
                    bands[some] = signatures(hash_, weight, counts[some])
                part = batch.slice(first, end - first)
                values = lists(bands[some].ravel().view(np.int64), np.where(some, BANDS, 0), pa.int64())
                whole = pa.array(np.bincount(np.repeat(np.arange(len(counts)), counts), weight, len(counts)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in own), values, whole], names=[*own, "bands", "whole"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in own)
    return rows.mapInArrow(sign, f"{kinds}, bands array<bigint>, whole double")


def common_shingles(docs: DataFrame, idf: np.ndarray, documents: int) -> np.ndarray:
    """Sorted hashes of shingles that several documents of a sample hold, the most frequent first if they are many."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)
    share = min(1.0, max(COMMON_SHARE, COMMON_SAMPLE / max(documents, 1)))
    texts = docs.select(text_key().alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    drawn = F.pmod(F.xxhash64("key", F.lit(3)), F.lit(1 << 20)) < int(share * (1 << 20))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                hash_ = weighted(data, offsets, shared.value)[0]
                yield pa.RecordBatch.from_arrays([pa.array(hash_.view(np.int64))], names=["hash"])

    counted = texts.where(drawn).select("text").mapInArrow(own, "hash long").groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    often = counted.where(F.col("n") >= COMMON_TIMES).orderBy(F.desc("n"), "hash").limit(COMMON).select("hash").toArrow()
    return np.sort(often["hash"].to_numpy().view(np.uint64))


def prefixes(
    hash_: np.ndarray, weight: np.ndarray, counts: np.ndarray, common: np.ndarray, similarity: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the shingles that each row begins with: row, hash, weight, and the row's weight from there on.

    The order is the same in all texts: common shingles last, else by hash. What follows a prefix weighs less than
    ``similarity`` of the text, so it cannot hold all that the text has in common with one that is like it.
    """
    row = np.repeat(np.arange(len(counts)), counts)
    late = np.isin(hash_, common)
    order = np.argsort(row * 2 + late, kind="stable")
    hash_, weight = hash_[order], weight[order]
    whole = np.bincount(row, weight, len(counts))[row]
    total = np.concatenate([[0.0], np.cumsum(weight)])
    before = total[:-1] - np.repeat(total[np.cumsum(counts) - counts], counts)
    some = before <= (1 - similarity + CLOSE) * whole
    return row[some], hash_[some], weight[some], (whole - before)[some]


def heads(rows: DataFrame, idf: np.ndarray, common: np.ndarray, similarity: float) -> DataFrame:
    """(hash, own, rest): the prefixes of the texts ``rows`` (own, text); a text that a task meets again counts once."""
    shared = rows.sparkSession.sparkContext.broadcast((idf, common))

    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            fresh = [own not in seen and not seen.add(own) for own in batch.column("own").to_pylist()]
            batch = batch.filter(pa.array(fresh, pa.bool_()))
            own = batch.column("own").to_numpy()
            for first, _, data, offsets in slices(batch.column("text")):
                row, hash_, _, rest = prefixes(*weighted(data, offsets, shared.value[0]), shared.value[1], similarity)
                columns = [hash_.view(np.int64), own[first + row], rest.astype(np.float32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["hash", "own", "rest"])

    return rows.mapInArrow(head, "hash long, own long, rest float")


def _several(rows: DataFrame, name: str) -> DataFrame:
    """The rows whose ``hash`` occurs with different values of the column ``name``."""
    same = Window.partitionBy("hash")
    rows = rows.repartition("hash").withColumns({"least": F.min(name).over(same), "most": F.max(name).over(same)})
    return rows.where("least <> most").drop("least", "most")


def neighbours(shared: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """(band, number): texts of different classes that may be alike by what their prefixes share, in buckets.

    ``shared`` are rows of ``heads``, ``known`` (own, number, whole, root). At the first shingle that two texts share,
    neither has more weight left than they can have in common. Classes are paired, not texts: of a class at a shingle
    its bounds are known, the largest weight that a text like one of its texts can have, and the weights of these.
    A pair with a class of several texts goes to the bucket of the larger class, so that holds its texts once.
    """
    rows = written(_several(shared.join(known, "own").drop("own").dropDuplicates(["hash", "number"]), "root"))
    members = written(rows.select("root", "number").distinct())
    reach = F.col("rest") * ((1 + similarity) / similarity * (1 + ROUNDED)) - F.col("whole")
    bounds = rows.groupBy("hash", "root").agg(F.max(reach).alias("reach"), F.min("whole").alias("least"), F.max("whole").alias("most"))
    one, other = bounds.alias("one"), bounds.alias("other")
    pair = (F.col("one.hash") == F.col("other.hash")) & (F.col("one.root") < F.col("other.root"))
    for this, that in (("one", "other"), ("other", "one")):
        pair &= F.col(f"{this}.reach") >= F.col(f"{that}.least")
        pair &= F.col(f"{this}.most") >= similarity * (1 - ROUNDED) * F.col(f"{that}.least")
    met = one.join(other, pair).groupBy(F.col("one.root").alias("a"), F.col("other.root").alias("b")).agg(F.min("one.hash").alias("band"))
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    for name in ("a", "b"):
        met = met.join(sizes.select(F.col("root").alias(name), F.col("n").alias(f"n_{name}")), name)
    larger = F.when(F.col("n_a") >= F.col("n_b"), F.col("a")).otherwise(F.col("b"))
    # Hashes are even, so no class has the number of a shingle.
    band = F.when(F.greatest("n_a", "n_b") > 1, larger * 2 + 1).otherwise(F.col("band"))
    classes_ = met.select(band.alias("band"), F.explode(F.array("a", "b")).alias("root")).distinct()
    found = written(classes_.join(members, "root").select("band", "number"))
    release(rows, members)
    return found


def mixed(buckets: DataFrame, roots: DataFrame, least: int = 3) -> DataFrame:
    """(band, number, root): the members of buckets of ``least`` texts or more that hold texts of different classes.

    Of buckets with the same texts only one is given. Buckets of bands that are smaller were compared with their lead.
    """
    rows = buckets.select("band", "number").join(roots.withColumnRenamed("id", "number"), "number", "left")
    rows = rows.withColumn("root", F.coalesce("root", "number"))
    same = [F.bit_xor(F.xxhash64("number", F.lit(seed))).alias(f"same{seed}") for seed in (0, 1)]
    several = rows.groupBy("band").agg(
        F.count(F.lit(1)).alias("n"), F.min("root").alias("least"), F.max("root").alias("most"), *same
    )
    once = several.where(F.col("n") >= least).where("least <> most").groupBy("n", "least", "most", "same0", "same1").agg(F.min("band").alias("band"))
    return rows.join(once.select("band"), "band")


def cells(members: DataFrame, texts: DataFrame) -> DataFrame:
    """(band, one, other, side, number, root, text): buckets cut into blocks, a cell for every two blocks of one.

    Rows of block ``one`` have side 0, those of block ``other`` side 1. A bucket of one block is one
    cell. ``texts`` are (number, text).
    """
    sized = members.join(texts.select("number", F.octet_length("text").alias("bytes")), "number")
    held = sized.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK_TEXTS, F.col("bytes") / BLOCK_BYTES)).cast("int")
    held = held.select("band", F.greatest(blocks, F.lit(1)).alias("blocks"))
    rows = members.join(held, "band").withColumn("own", F.pmod(F.xxhash64("number", F.lit(2)), "blocks").cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(
        "band", F.least("own", "with").alias("one"), F.greatest("own", "with").alias("other"),
        (F.col("own") > F.col("with")).cast("int").alias("side"), "number", "root",
    )
    return rows.join(texts.select("number", "text"), "number")


def common_part(sets: list) -> tuple[np.ndarray, np.ndarray]:
    """What half of the sets hold or more: no set is far from it if they are alike, and it is short if they are."""
    hashes_, weights = (np.concatenate([own[i] for own in sets]) for i in (0, 1))
    hashes_, first, times = np.unique(hashes_, return_index=True, return_counts=True)
    often = 2 * times >= len(sets)
    return hashes_[often], weights[first[often]]


def links_between(sets: list, sides: np.ndarray, roots: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links that connect the texts ``sets`` as all links between texts of different classes do.

    ``sets`` are sorted hashes with weights. If there are two sides, only texts of different sides are
    compared. With d the difference of a text from a base, negative weights apart, the common weight
    of two texts is the base's, less the negative parts of both, and the overlap of their
    differences; so postings of differences are all there is to sum.
    """
    size, label = len(sets), np.unique(roots, return_inverse=True)[1]
    often = np.bincount(label)
    if len(often) < 2:
        return []
    apart = sides.min() != sides.max()
    base = common_part(sets)
    found = [difference(own, base, similarity)[:2] for own in sets]
    counts = np.array([len(hash_) for hash_, _ in found])
    hashes_, weights = (np.concatenate([f[i] for f in found]) for i in (0, 1))
    row = np.repeat(np.arange(size), counts)
    less = np.bincount(row, np.where(hashes_ & np.uint64(1), weights, 0), size)
    whole = np.array([own[1].sum() for own in sets])
    order = np.lexsort((row, hashes_))
    hashes_, weights, row = hashes_[order], weights[order], row[order]
    fresh = np.ones(len(hashes_), bool)
    fresh[1:] = hashes_[1:] != hashes_[:-1]
    starts = np.flatnonzero(fresh)
    many = np.diff(np.append(starts, len(hashes_)))
    item = np.cumsum(fresh) - 1
    # Rows of the elements that others have too, in order of the text: where an element's postings are.
    mine = np.flatnonzero(many[item] > 1)
    mine = mine[np.argsort(row[mine], kind="stable")]
    ends = np.cumsum(np.bincount(row[mine], minlength=size))
    links = []
    for i in np.flatnonzero(label != often.argmax()):
        own = mine[ends[i - 1] if i else 0 : ends[i]]
        times = many[item[own]]
        at = np.repeat(starts[item[own]] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        overlap = np.bincount(row[at], np.minimum(weights[at], np.repeat(weights[own], times)), size)
        common = base[1].sum() - less[i] - less + overlap
        alike = common / (whole[i] + whole - common)
        near = (alike >= similarity - CLOSE) & (label != label[i])
        if apart:
            near &= sides != sides[i]
        for j in np.flatnonzero(near):
            if label[j] == label[i]:
                continue
            if alike[j] < similarity + CLOSE and jaccard(sets[i], sets[j]) < similarity:
                continue
            links.append((int(i), int(j)))
            label[label == label[j]] = label[i]
    return links


def linked(members: DataFrame, texts: DataFrame, idf: np.ndarray, similarity: float) -> DataFrame:
    """Links (a, b) that connect the members (band, number, root) of each bucket as all its links do."""
    shared = members.sparkSession.sparkContext.broadcast(idf)
    place = ["band", "one", "other"]

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, rows = None, []

        def done() -> pa.RecordBatch:
            numbers, roots, sides = (np.array([r[i] for r in rows], np.int64) for i in range(3))
            pairs = np.array(links_between([r[3] for r in rows], sides, roots, similarity), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(numbers[pairs[:, 0]]), pa.array(numbers[pairs[:, 1]])], names=["a", "b"])

        for batch in batches:
            for first, end, data, offsets in slices(batch.column("text")):
                hash_, weight, counts = weighted(data, offsets, shared.value)
                ends = np.cumsum(counts)
                part = batch.slice(first, end - first)
                where = zip(*(part.column(c).to_pylist() for c in (*place, "number", "root", "side")), strict=True)
                for k, (band, one, other, number, root, side) in enumerate(where):
                    if (band, one, other) != cell:
                        if rows:
                            yield done()
                        cell, rows = (band, one, other), []
                    own = slice(ends[k] - counts[k], ends[k])
                    rows.append((number, root, side, (hash_[own].copy(), weight[own].copy())))
        if rows:
            yield done()

    rows = cells(members, texts).repartition(*place).sortWithinPartitions(*place, "number")
    return rows.mapInArrow(link, "a long, b long")


def _beside(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs`` (number, lead, ...) with the texts of both, in order of the lead within a task."""
    rows = pairs.join(texts.select("number", F.col("text").alias("left")), "number")
    return rows.join(texts.select(F.col("number").alias("lead"), F.col("text").alias("right")), "lead")


def _both(batch: pa.RecordBatch, idf: np.ndarray):
    """Weighted shingles of both texts of each row; those of a lead are made once for rows in a row."""
    last, right = None, None
    for first, end, data, offsets in slices(batch.column("left")):
        hash_, weight, counts = weighted(data, offsets, idf)
        ends = np.cumsum(counts)
        for i in range(first, end):
            number = batch.column("lead")[i].as_py()
            if number != last:
                (piece,) = slices(batch.column("right").slice(i, 1))
                last, right = number, weighted(*piece[2:], idf)[:2]
            stop = ends[i - first]
            own = slice(stop - counts[i - first], stop)
            yield (hash_[own], weight[own]), right


def compared(pairs: DataFrame, texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """The pairs (number, lead) with their weighted Jaccard ``similarity``; texts are (number, text)."""
    shared = pairs.sparkSession.sparkContext.broadcast(idf)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = pa.array([jaccard(*both) for both in _both(batch, shared.value)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("number"), batch.column("lead"), alike], names=["number", "lead", "similarity"])

    return _beside(pairs, texts).select("number", "lead", "left", "right").mapInArrow(compare, "number long, lead long, similarity double")


def jaccard(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sorted sets of hashes with weights."""
    _, i, j = np.intersect1d(left[0], right[0], assume_unique=True, return_indices=True)
    least = np.minimum(left[1][i], right[1][j]).sum()
    total = left[1].sum() + right[1].sum() - least
    return float(least / total) if total > 0 else 0.0


def difference(own: tuple, lead: tuple, similarity: float) -> tuple[np.ndarray, np.ndarray, float, float]:
    """What tells a text from its lead, as hashes (odd where the lead has more) with weights, and the
    overlap of differences that a link needs: with a text that is not like the lead, and with any."""
    hashes_ = np.union1d(own[0], lead[0])
    more = np.zeros(len(hashes_))
    more[np.searchsorted(hashes_, own[0])] += own[1]
    more[np.searchsorted(hashes_, lead[0])] -= lead[1]
    some = np.abs(more) > 1e-9
    hashes_, more = hashes_[some] | (more[some] < 0).astype(np.uint64), np.abs(more[some])
    share = (1 - similarity) / (1 + similarity)
    total, mine, its = more.sum(), own[1].sum(), lead[1].sum()
    return hashes_, more, (total + share * (its - mine)) / 2, (total - share * (its + mine)) / 2


def _texts(rows: DataFrame, signed: DataFrame, numbers: DataFrame) -> DataFrame:
    """(number, text) of these numbers: the text of one document of each, rows that repeat it are dropped."""
    wanted = signed.join(numbers, "number").select("number", "key", "doc_id")
    texts = rows.withColumn("known", F.col("doc_id").isNull()).withColumn("doc_id", F.coalesce("doc_id", F.lit(0)))
    wanted = wanted.withColumn("known", F.col("doc_id").isNull()).withColumn("doc_id", F.coalesce("doc_id", F.lit(0)))
    return written(texts.join(wanted, ["key", "doc_id", "known"]).select("number", "text").dropDuplicates(["number"]))


def classes(docs: DataFrame, similarity: float = SIMILARITY, exact: bool = True) -> DataFrame:
    """(key, class_id, class_size, stays): the class of each distinct text by its digest.

    A class is connected by links of at least ``similarity``; its id is the least doc_id in it (null if
    all are null), its size the documents in it. ``stays`` marks the text of that document, of several
    the one with the least digest. Equal texts share a class; null is the empty text.
    Texts without words are linked with nothing but their copies. Without ``exact`` texts are compared
    with the leads of their buckets only, and links between texts that are like no lead are missing.
    """
    rows = docs.select(text_key().alias("key"), "doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counts, documents = frequencies(docs)
    idf = rarity(counts, documents)
    signed = _signed(rows, idf).groupBy("key").agg(
        F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"), F.first("whole").alias("whole")
    )
    signed = written(signed.select(F.monotonically_increasing_id().alias("number"), "*"))
    bands = signed.select("number", F.explode("bands").alias("band"))
    bands = bands.join(bands.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "band")
    # The lead of a bucket is the text that shares most buckets with others: the middle of its family.
    met = bands.groupBy("number").agg(F.sum("n").alias("met"))
    buckets = written(bands.select("band", "number").join(met, "number"))
    lead = buckets.groupBy("band").agg(F.min(F.struct(-F.col("met"), F.col("number"))).alias("lead"))
    pairs = buckets.join(lead.select("band", F.col("lead.number").alias("lead")), "band").where("number <> lead")
    pairs = written(pairs.select("number", "lead").distinct())
    texts = _texts(rows, signed, buckets.select("number").distinct())
    met = written(compared(pairs, texts, idf).distinct())
    alike = F.col("similarity") >= similarity
    links = met.where(alike).select(F.col("number").alias("a"), F.col("lead").alias("b"))
    found = components(links)
    used = []
    if exact:
        members = written(mixed(buckets, found))
        more = written(linked(members, texts, idf, similarity))
        if not more.isEmpty():
            found = components(links.union(more))
        known = signed.select(F.xxhash64("key").alias("own"), "number", "whole").join(found.withColumnRenamed("id", "number"), "number", "left")
        known = known.withColumn("root", F.coalesce("root", "number"))
        first = heads(rows.select(F.xxhash64("key").alias("own"), "text"), idf, common_shingles(docs, idf, documents), similarity)
        shared = written(_several(first, "own"))
        near = neighbours(shared, known, similarity)
        used = [members, more, shared, near]
        if not near.isEmpty():
            members = written(mixed(near, found, 2))
            left = _texts(rows, signed, members.select("number").distinct())
            rest = written(linked(members, left, idf, similarity))
            used += [members, left, rest]
            if not rest.isEmpty():
                found = components(links.union(more).union(rest))
    result = signed.join(found.withColumnRenamed("id", "number"), "number", "left").withColumn("root", F.coalesce("root", "number"))
    lead = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("key"))).alias("lead")
    whole = result.groupBy("root").agg(lead, F.sum("copies").alias("class_size"))
    result = result.select("key", "root").join(whole, "root")
    stays = F.col("key") == F.col("lead.key")
    result = written(result.select("key", F.col("lead.doc_id").alias("class_id"), "class_size", stays.alias("stays")))
    release(buckets, pairs, texts, met, *used)
    return result


def report(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id and class_size of every document; other columns are dropped.

    Rows that repeat, and documents with equal ids, are counted and reported each for itself. A
    class without any doc_id has the id null. An empty table gives no rows.
    """
    found = classes(docs, similarity)
    return docs.select("doc_id", text_key().alias("key")).join(found, "key").select("doc_id", "class_id", "class_size")


def kept(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` with one document of each class: the one whose doc_id is the class id.

    Of rows with that id and equal texts, one stays; which, depends on a hash of their columns.
    """
    key, id_, text, n = (unused(docs, name) for name in ("__key", "__id", "__text", "__n"))
    chosen = classes(docs, similarity).where("stays").select(F.col("key").alias(key), F.col("class_id").alias(id_))
    rows = docs.withColumn(text, text_key())
    same = (F.col(text) == F.col(key)) & F.col("doc_id").eqNullSafe(F.col(id_))
    columns = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map" not in kind]
    order = Window.partitionBy(key, id_).orderBy(F.xxhash64(*columns))
    return rows.join(chosen, same).withColumn(n, F.row_number().over(order)).where(F.col(n) == 1).select(*docs.columns)
