"""Substring dedup: repeated passages located by sharded Aho-Corasick automata.

A window is 35 consecutive words; a word goes if a window over it occurs anywhere else.

1. Anchors. Of the 28 runs of eight words in a window the one with the least hash is the
   window's anchor. Equal windows have equal anchors, so only windows whose anchor recurs can
   recur, and about one run in fifteen is an anchor.
2. Candidates. The stretch of words under the windows of one recurring anchor goes to the
   shard of the anchor's hash, with all other stretches that could hold the same windows.
3. Confirmation and location. In each shard the windows are counted as texts, the recurring
   ones are joined to passages, an automaton is compiled from the passages, and it is run
   over the shard's stretches to find every occurrence.

Anchors in more texts than ``HOT`` are confirmed and located by digests of their windows,
with sums made before the shuffle, so no task meets all the texts of a very common phrase.
All windows of a stretch are tried as one first, then eight in a row at the same places
before the anchor, then four, two and each; what occurs more than once is not taken apart
to be located, so a passage of many documents is found in a few rows of each.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweft.llm.skew import join_counted
from logweft.llm.stage import release, unused, written
from logweft.llm.words import SPACE, flat, hashes, lists, shingles, slices, spans

#: Words of a window and of an anchor.
WINDOW, ANCHOR = 35, 8
#: Stretches of one anchor beyond which its windows are counted by digest.
HOT = 4096
#: Windows of the pieces that a stretch of a hot anchor is taken apart to, one after the other.
PIECES = (8, 4, 2, 1)
#: Bytes of distinct stretches compiled into one automaton.
SHARD_BYTES = 1 << 19


def text_key(text: str = "text") -> Column:
    """Digest of a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")))


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.lit(""))


def anchors_of(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, size: int = ANCHOR):
    """For all rows: anchor hashes, first windows, numbers of windows, the anchors' places, and the number of anchors of each row."""
    starts, ends, first = spans(data, offsets, SPACE)
    grams = shingles(hashes(data, starts, ends), size)
    # The least hash of each window; the place below the hash tells ties apart, leftmost first.
    places = np.arange(len(grams), dtype=np.uint64)
    least = (grams >> np.uint64(24) << np.uint64(24)) | (places & np.uint64((1 << 24) - 1))
    width, done = window - size + 1, 1
    while done < width:
        step = min(done, width - done)
        least = np.minimum(least[: len(least) - step], least[step:]) if len(least) > step else least[:0]
        done += step
    words = np.diff(first)
    windows = np.maximum(words - window + 1, 0)
    row = np.repeat(np.arange(len(words)), windows)
    own = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    begin = first[:-1][row] + own
    chosen = begin + (((least[begin] & np.uint64((1 << 24) - 1)).astype(np.int64) - begin) & ((1 << 24) - 1))
    fresh = np.ones(len(chosen), bool)
    fresh[1:] = (chosen[1:] != chosen[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(fresh)
    return (
        grams[chosen[at]].view(np.int64),
        own[at].astype(np.int32),
        np.diff(np.append(at, len(chosen))).astype(np.int32),
        (chosen[at] - first[:-1][row[at]]).astype(np.int32),
        np.bincount(row[at], minlength=len(words)),
    )


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in slices(batch.column("text")):
            found, begin, count, place, counts = anchors_of(data, offsets)
            part = batch.slice(first, end - first)
            columns = [lists(found, counts, pa.int64()), *(lists(c, counts, pa.int32()) for c in (begin, count, place))]
            names = ["key", "id", "hash", "begin", "count", "place"]
            rows = pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names=names)
            yield rows.filter(pa.array(counts > 0))


def anchors(docs: DataFrame) -> DataFrame:
    """One row per distinct text with a window: number, key, id of a document, copies, and its anchors as lists."""
    texts = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(text_key().alias("key"), _id().alias("id"), texts.alias("text"))
    rows = rows.mapInArrow(_anchored, "key binary, id string, hash array<bigint>, begin array<int>, count array<int>, place array<int>")
    lists_ = F.first(F.struct("hash", "begin", "count", "place"))
    rows = rows.groupBy("key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), lists_.alias("all"))
    return rows.select(F.monotonically_increasing_id().alias("number"), "key", "id", "copies", "all.*")


def stretches(docs: DataFrame, anchored: DataFrame, hot: int = HOT) -> DataFrame:
    """Texts with a recurring anchor: key, copies, text, hits (begin, count, place, hash, hot)."""
    each = anchored.select("number", "copies", F.explode(F.arrays_zip("hash", "begin", "count", "place")).alias("a"))
    each = each.select("number", "copies", "a.*")
    recurring = each.groupBy("hash").agg(F.sum("copies").alias("times"), F.count(F.lit(1)).alias("texts"))
    recurring = written(recurring.where("times > 1").select("hash", "texts", (F.col("texts") > hot).alias("hot")))
    total = anchored.agg(F.coalesce(F.sum(F.size("hash")), F.lit(0))).first()[0]
    hits = join_counted(each.drop("copies"), recurring, "hash", "texts", total)
    hits = hits.groupBy("number").agg(F.collect_list(F.struct("begin", "count", "place", "hash", "hot")).alias("hits"))
    hits = hits.join(anchored.select("number", "key", "id", "copies"), "number").drop("number")
    texts = docs.select(text_key().alias("key"), _id().alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(hits, ["key", "id"]).select("key", "copies", "text", "hits")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of words, one row per text and stretch, with all the places it begins in the text;
    digests of its windows instead of the stretch where the anchor is hot."""
    for batch in batches:
        data, offsets = flat(batch.column("text"))
        raw = data.tobytes()
        found: list[tuple] = []
        size = 0
        keys, copies, hits = (batch.column(n).to_pylist() for n in ("key", "copies", "hits"))
        for i in range(batch.num_rows):
            line, at = _line(raw[offsets[i] : offsets[i + 1]].split())
            places: dict[tuple, list[int]] = {}
            for hit in hits[i]:
                first, last = hit["begin"], hit["begin"] + hit["count"]
                text = line[at[first] : at[last + WINDOW - 1] - 1]
                places.setdefault((hit["hash"], text, hit["place"] - first, hit["count"], hit["hot"]), []).append(first)
            for (hash_, text, lead, count, hot), begins in places.items():
                windows = None
                if hot:
                    w = begins[0]
                    windows = [hashlib.md5(line[at[j] : at[j + WINDOW] - 1]).digest() for j in range(w, w + count)]
                found.append((hash_, keys[i], begins, copies[i], lead, None if hot else text, windows))
                size += 4 * len(begins) + (80 * count if hot else len(text))
            if size > 1 << 22:
                yield _rows(found)
                found, size = [], 0
        if found:
            yield _rows(found)


def _line(words: list[bytes]) -> tuple[bytes, list[int]]:
    """Words joined by a blank, and the offset of each word, with one more for the end."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    return b" ".join(words), np.concatenate([[0], np.cumsum(lengths)]).tolist()


_CUT = pa.schema([
    ("hash", pa.int64()), ("key", pa.binary()), ("begins", pa.list_(pa.int32())), ("copies", pa.int64()),
    ("lead", pa.int32()), ("stretch", pa.binary()), ("windows", pa.list_(pa.binary())),
])
_MARKS = pa.schema([("key", pa.binary()), ("ranges", pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())])))])


def _rows(found: list[tuple], schema: pa.Schema = _CUT) -> pa.RecordBatch:
    columns = zip(*found, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def passages(counted: dict[bytes, int]) -> tuple[set[bytes], int]:
    """Maximal passages made of windows that recur among the stretches, given with their copies."""
    lines = {text: _line(text.split(b" ")) for text in counted}
    windows: Counter[bytes] = Counter()
    for text, (line, at) in lines.items():
        for w in range(len(at) - WINDOW):
            windows[line[at[w] : at[w + WINDOW] - 1]] += counted[text]
    found = set()
    for line, at in lines.values():
        begin = None
        for w in range(len(at) - WINDOW + 1):
            if w < len(at) - WINDOW and windows[line[at[w] : at[w + WINDOW] - 1]] > 1:
                begin = w if begin is None else begin
            elif begin is not None:
                found.add(line[at[begin] : at[w - 1 + WINDOW] - 1])
                begin = None
    return found, len(windows)


def located(counted: dict[bytes, int]) -> dict[bytes, list[tuple[int, int]]]:
    """Word ranges (first, end) of each stretch that recurring passages cover."""
    found, _ = passages(counted)
    if not found:
        return {}
    machine = ahocorasick.Automaton()
    for passage in found:
        machine.add_word(f" {passage.decode('latin-1')} ", passage.count(b" ") + 1)
    machine.make_automaton()
    out = {}
    for text in counted:
        line = f" {text.decode('latin-1')} "
        places = [(line.count(" ", 0, end + 1) - 1, length) for end, length in machine.iter(line)]
        merged: list[tuple[int, int]] = []
        for first, end in sorted((end - length, end) for end, length in places):
            if merged and first <= merged[-1][1]:
                merged[-1] = merged[-1][0], max(end, merged[-1][1])
            else:
                merged.append((first, end))
        if merged:
            out[text] = merged
    return out


def _sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (hash, key, begins, copies, stretch) in order of hash to marks (key, ranges)."""
    last, size = None, 0
    counted: Counter[bytes] = Counter()
    places: dict[bytes, list[tuple[bytes, list[int]]]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        marks: list[tuple] = []
        for text, covered in located(counted).items():
            for key, begins in places[text]:
                marks.append((key, [(b + first, b + end) for b in begins for first, end in covered]))
            if len(marks) > 50_000:
                yield _rows(marks, _MARKS)
                marks = []
        if marks:
            yield _rows(marks, _MARKS)

    for batch in batches:
        for hash_, key, begins, copies, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if size > SHARD_BYTES and hash_ != last:
                yield from flush()
                size = 0
                counted.clear(), places.clear()
            last = hash_
            if text not in counted:
                size += len(text)
            size += 32
            counted[text] += copies * len(begins)
            places.setdefault(text, []).append((key, begins))
    yield from flush()


def marks(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(key, ranges): the word ranges to remove from each distinct text that has some, by text digest."""
    anchored = written(anchors(docs))
    found = stretches(docs, anchored, hot)
    kinds = "hash long, key binary, begins array<int>, copies long, lead int, stretch binary, windows array<binary>"
    cut = written(found.mapInArrow(_cut, kinds))
    release(anchored)
    usual = cut.where("stretch is not null").select("hash", "key", "begins", "copies", "stretch")
    usual = usual.repartition("hash").sortWithinPartitions("hash")
    result = usual.mapInArrow(_sharded, "key binary, ranges array<struct<first:int,end:int>>")
    common = cut.where("windows is not null")
    if not common.isEmpty():
        result = result.union(_by_digest(common))
    result = written(result.groupBy("key").agg(F.sort_array(F.flatten(F.collect_list("ranges"))).alias("ranges")))
    release(cut)
    return result


def _by_digest(stretches_: DataFrame) -> DataFrame:
    """Marks (key, ranges) of the recurring windows of stretches (key, begins, lead, copies, windows)."""
    times = (F.col("copies") * F.size("begins")).alias("times")
    rows = stretches_.select("key", "begins", "lead", "windows", times, F.lit(True).alias("open"))
    out = None
    for pieces in (0, *PIECES):
        # What recurs is marked and taken apart once more for the count alone, what does not is still open.
        rows = written(_taken_apart(rows, pieces))
        one = F.min(F.struct("key", "begins", "lead", "windows")).alias("one")
        each = rows.groupBy("digest").agg(F.sum("times").alias("n"), F.max("open").alias("open"), one)
        each = written(each.select("digest", "n", "open", "one.*"))
        found = rows.where("open").select("digest", "key", "begins", F.size("windows").alias("size"))
        found = found.join(each.where("n > 1").select("digest"), "digest")
        end = F.col("size") + WINDOW - 1
        ranges = F.transform("begins", lambda b: F.struct(b.alias("first"), (b + end).alias("end")))
        found = found.select("key", ranges.alias("ranges"))
        out = found if out is None else out.union(found)
        still = (F.col("open") & (F.col("n") == 1)).alias("open")
        rows = each.select("key", "begins", "lead", "windows", F.col("n").alias("times"), still)
    return out


def _taken_apart(rows: DataFrame, piece: int) -> DataFrame:
    """Rows cut into pieces of so many windows (0: as they are), with a digest of each.

    ``lead`` is the distance of the anchor's place from the first window.
    """
    size = F.size("windows")
    starts = F.sequence(F.lit(0), size - 1)
    if piece:
        starts = F.filter(starts, lambda i: (i == 0) | (F.pmod(F.col("lead") - i, F.lit(piece)) == piece - 1))
    else:
        starts = F.array(F.lit(0))
    parts = rows.withColumn("starts", starts).select("*", F.posexplode("starts").alias("nth", "at"))
    after = F.coalesce(F.get("starts", F.col("nth") + 1), size)
    parts = parts.withColumn("windows", F.slice("windows", F.col("at") + 1, after - F.col("at")))
    digest = F.md5(F.array_join(F.transform("windows", lambda w: F.hex(w)), "").cast("binary"))
    begins = F.transform("begins", lambda b: b + F.col("at"))
    lead = (F.col("lead") - F.col("at")).alias("lead")
    return parts.select("key", begins.alias("begins"), lead, "windows", "times", "open", digest.alias("digest"))


def _kept(words: list[bytes], ranges: list[dict] | None) -> list[bytes]:
    if not ranges:
        return words
    keep = np.ones(len(words), bool)
    for span in ranges:
        keep[span["first"] : span["end"]] = False
    return [words[i] for i in np.flatnonzero(keep)]


def with_marks(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """``docs`` and, as their last column, the ranges of ``marks``; null where nothing is removed."""
    key, ranges = unused(docs, "__key"), unused(docs, "__ranges")
    found = marks(docs, hot).withColumnsRenamed({"key": key, "ranges": ranges})
    return docs.withColumn(key, text_key()).join(found, key, "left").drop(key)


def report(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document.

    Null and empty texts have no words. Repeated rows count as other occurrences, so copies of
    35 words or more lose all of them. Windows are judged on the input. Other columns are
    dropped; an empty table gives no rows.
    """
    rows = with_marks(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), hot)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, ranges in zip(batch.column("text"), batch.column(2).to_pylist(), strict=True):
                words = text.as_buffer().to_pybytes().split()
                kept = _kept(words, ranges)
                out.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            arrays = [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return rows.mapInArrow(digest, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def cleaned(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``.

    A text that loses words is its kept words joined by one blank; other texts stay as they
    are. Rows that lose all their words go. ``n_chars``, if there, counts the new text.
    """
    rows = with_marks(docs, hot)
    schema = docs.schema
    for field in schema.fields:
        field.nullable = True
    place = docs.columns.index("text")
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranges = batch.column(batch.num_columns - 1).to_pylist()
            texts = batch.column(place).to_pylist()
            new = [b" ".join(_kept(t.encode().split(), r)).decode() if r else t for t, r in zip(texts, ranges, strict=True)]
            columns = [*batch.columns[:-1]]
            columns[place] = pa.array(new, batch.schema.field(place).type)
            rows_ = pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])
            yield rows_.filter(pa.array([not r or t != "" for t, r in zip(new, ranges, strict=True)], pa.bool_()))

    out = rows.mapInArrow(cut, schema)
    return out.withColumn("n_chars", F.char_length("text").cast(schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
