"""Benchmark decontamination: one Aho-Corasick automaton over the normalised benchmark.

A window is ten consecutive words of a benchmark item, or the whole item if it has
fewer. Every document is read once: hashes of its runs of words say which windows may occur in
a batch of texts, and the automaton of these windows finds where they do. So no automaton grows with
the benchmark, and texts without a candidate are not scanned. Places are given as words and as code point
offsets in the original text.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweft.llm.stage import unused
from logweft.llm.words import PUNCTUATION, flat, hashes, ranges, shingles, slices, spans

WINDOW = 10
#: Bytes of benchmark texts that are broadcast at once; a larger benchmark takes further steps in the same pass.
SHARD_BYTES = 64 << 20

_FOLD = bytes(32 if PUNCTUATION[b | 32 if 65 <= b <= 90 else b] else b | 32 if 65 <= b <= 90 else b for b in range(256))
_BLANK = np.arange(256) == 32
_FOUND = "n_words long, hit_words array<int>, items array<bigint>, spans array<struct<start:int,end:int>>"


def normal_words(text: bytes) -> list[bytes]:
    """Words of a text: A-Z lower-cased, cut at ASCII characters that are no letter or digit."""
    return text.translate(_FOLD).split()


class Windows:
    """The windows of benchmark items, by the hashes of their words."""

    def __init__(self, items: list[tuple[int | None, bytes]], size: int):
        self.ids = [i for i, _ in items]
        texts = [b" ".join(normal_words(text)) for _, text in items]
        self.text = b" ".join(texts)
        lengths = np.array([len(t) for t in texts], np.int64)
        begins = np.cumsum(lengths + 1) - lengths - 1
        data = np.frombuffer(self.text, np.uint8)
        self.starts, self.ends, _ = spans(data, np.array([0, len(data)]), _BLANK)
        first = np.searchsorted(self.starts, np.append(begins, len(data) + 1))
        counts = np.diff(first)
        own = hashes(data, self.starts, self.ends) if len(data) else np.zeros(0, np.uint64)
        #: By length of windows: sorted hashes, and the item and the first word of each.
        self.known: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in sorted(set(np.minimum(counts[counts > 0], size).tolist())):
            some = np.flatnonzero(counts == n if n < size else counts >= n)
            many = counts[some] - n + 1
            word, item = ranges(first[:-1][some], many), np.repeat(some, many)
            grams = shingles(own, n)[word]
            order = np.argsort(grams, kind="stable")
            self.known[n] = grams[order], item[order], word[order]

    def candidates(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """Rows, given by the hashes of their words, that may hold windows, and the hashes of these by length."""
        rows, found = np.zeros(len(first) - 1, bool), {}
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        left = first[1:][row] - np.arange(len(words))
        for n, (known, _, _) in self.known.items():
            grams = shingles(words, n)
            at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
            hit = (known[at] == grams) & (left >= n)
            rows[row[hit]] = True
            found[n] = np.unique(grams[hit])
        return rows, found

    def automaton(self, found: dict[int, np.ndarray]) -> ahocorasick.Automaton:
        """Of the windows with these hashes: their number of words and their items' ids."""
        windows: dict[bytes, tuple[int, set[int]]] = {}
        for n, grams in found.items():
            known, item, word = self.known[n]
            low, high = np.searchsorted(known, grams), np.searchsorted(known, grams, side="right")
            for at in ranges(low, high - low).tolist():
                text = self.text[self.starts[word[at]] : self.ends[word[at] + n - 1]]
                ids = windows.setdefault(text, (n, set()))[1]
                if self.ids[item[at]] is not None:
                    ids.add(self.ids[item[at]])
        machine = ahocorasick.Automaton()
        for text, (n, ids) in windows.items():
            machine.add_word(f" {text.decode('latin-1')} ", (n, tuple(ids)))
        machine.make_automaton()
        return machine


def _code_points(text: bytes, places: np.ndarray) -> np.ndarray:
    """Byte offsets of a text as code point offsets."""
    leads = np.zeros(len(text) + 1, np.int64)
    np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80, out=leads[1:])
    return leads[places]


def _scan(text: bytes, machine: ahocorasick.Automaton, hits: set[int], items: set[int]) -> None:
    line = b" " + b" ".join(normal_words(text)) + b" "
    blanks = None
    for end, (length, ids) in machine.iter(line.decode("latin-1")):
        if blanks is None:
            blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        last = int(np.searchsorted(blanks, end)) - 1
        hits.update(range(last - length + 1, last + 1))
        items.update(ids)


def _places(text: bytes, hits: list[int]) -> list[dict]:
    """Code point ranges of runs of hit words in the original text."""
    if not hits:
        return []
    data = np.frombuffer(text, np.uint8)
    starts, ends, _ = spans(data, np.array([0, len(data)]), PUNCTUATION)
    marked = np.array(hits)
    cuts = np.flatnonzero(np.diff(marked) > 1)
    first, last = marked[np.r_[0, cuts + 1]], marked[np.r_[cuts, len(marked) - 1]]
    both = zip(_code_points(text, starts[first]), _code_points(text, ends[last]), strict=True)
    return [{"start": int(a), "end": int(b)} for a, b in both]


def find(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, shard_bytes: int = SHARD_BYTES,
         name: str = "found") -> DataFrame:
    """All columns of ``docs`` and a struct ``found``, or as named: n_words, hit_words, items, spans.

    ``hit_words`` are the word numbers inside any occurrence, ``items`` the ids whose windows
    occur, ``spans`` code point ranges in the text. A null or empty text has no words. Items
    without words have no windows, those without an id are found but not in ``items``; equal
    windows of several items count for each. An empty benchmark finds nothing. A column of ``docs`` with that
    name is replaced. ``shard_bytes`` of benchmark texts are broadcast at once; of a larger benchmark
    each shard is one more step over the same rows, and nothing is written between.
    """
    texts = benchmark.select(F.col("item_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_bytes))
    shard = F.pmod(F.xxhash64("text"), F.lit(shards))
    found = docs.drop(name).withColumn(name, F.lit(None).cast(f"struct<{_struct()}>"))
    for number in range(shards):
        items = [(r.item_id, r.text.encode()) for r in texts.where(shard == number).collect()]
        found = _step(found, items, size)
    return found


def _struct() -> str:
    return ",".join(part.strip().replace(" ", ":", 1) for part in _FOUND.split(", "))


def _step(docs: DataFrame, items: list[tuple[int | None, bytes]], size: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)
    place = docs.columns.index("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(shared.value, size)
        for batch in batches:
            out = []
            for first, end, data, offsets in slices(batch.column(place)):
                out += _found(windows, data, offsets, batch.column(batch.num_columns - 1).slice(first, end - first).to_pylist())
            kind = batch.schema.field(batch.num_columns - 1).type
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, kind)], schema=batch.schema)

    return docs.mapInArrow(scan, docs.schema)


def _found(windows: Windows, data: np.ndarray, offsets: np.ndarray, before: list[dict | None]) -> list[dict]:
    """What is found in the texts of a slice, with what earlier steps found."""
    raw = data.tobytes()
    folded = np.frombuffer(raw.translate(_FOLD), np.uint8)
    starts, ends, first = spans(folded, offsets, _BLANK)
    rows, wanted = windows.candidates(hashes(folded, starts, ends) if len(starts) else np.zeros(0, np.uint64), first)
    machine, out = windows.automaton(wanted) if rows.any() else None, []
    for i, seen in enumerate(before):
        hits, items = (set(seen["hit_words"]), set(seen["items"])) if seen else (set(), set())
        text = raw[offsets[i] : offsets[i + 1]] if rows[i] or hits else b""
        if rows[i]:
            _scan(text, machine, hits, items)
        words = sorted(hits)
        out.append({"n_words": int(first[i + 1] - first[i]), "hit_words": words, "items": sorted(items), "spans": _places(text, words)})
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that contain a window of the benchmark."""
    name = unused(docs, "__found")
    return find(docs, benchmark, name=name).where(F.size(f"{name}.hit_words") == 0).drop(name)


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: counts of words, hit words and items, and a digest of the items.

    Copies of items without an id count as hits; ``n_items`` and the digest have items with an id.
    """
    ids = F.array_sort(F.transform("found.items", lambda x: x.cast("string")))
    return find(docs.select("doc_id", "text"), benchmark).select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        F.size("found.hit_words").cast("long").alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("found.hit_words") > 0).alias("contaminated"),
    )
