"""Source divergence audit: how far the vocabularies of a language's sources lie apart.

A group is a (lang, source). The sparse matrix of groups by terms is multiplied with its transpose
after Gustavson: a group's row walks its own terms, looks each up in the term-major index and
scatters what it finds there into one dense accumulator, a cell for each peer. Postings never
meet as emitted pairs; a shard of terms gives a row of sums for each group.

Divergence is no product: a term that only one of two groups has, or neither, counts as well.
With p the share of a term and b the share that a group gives a term it lacks,
``|p_g - p_h|`` over all kept terms is ::

    V |b_g - b_h|                                              neither has it
    + sum over g's terms of |p_g - b_h| - |b_g - b_h|          by prefix sums, for all h at once
    + sum over h's terms of |b_g - p_h| - |b_g - b_h|          the same from h's row
    + sum over common terms of what then is counted wrong      by scattering

Everything is in whole numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweft.llm.stage import written
from logweft.llm.words import ranges

#: Documents of the language that a kept term is in, the count added to every one, and ranks of terms.
LEAST_DOCS, SMOOTH, TOP = 30, 5, 50
SCALE = 1_000_000_000
#: Postings of a shard of terms; cells of the accumulators of a task, beyond which rows are split.
SHARD_POSTINGS, LEAST_SHARDS, CELLS = 1 << 18, 8, 1 << 21
#: Languages whose table, a few dozen bytes each, is broadcast.
MOST_LANGS = 100_000
#: Distinct terms that a task holds before it passes their counts on; bytes of text worked on at once.
HELD, PIECE = 500_000, 1 << 20

_FOLD = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in pieces: runs of ASCII letters and of anything beyond ASCII, only A-Z lower-cased."""
    folded, at = text.translate(_FOLD), 0
    while at < len(folded):
        end = folded.find(b" ", at + PIECE)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def passed() -> Iterator[pa.RecordBatch]:
        for (lang, source), (counts, docs) in held.items():
            if counts:
                n, own = len(counts), pa.array(list(counts), pa.binary()).cast(pa.string())
                names = pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string())
                numbers = pa.array(list(counts.values()), pa.int64()), pa.array([docs[t] for t in counts], pa.int64())
                yield pa.RecordBatch.from_arrays([*names, own, *numbers], names=["lang", "source", "term", "n", "docs"])
        held.clear()

    size = 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
            counts, docs = held.setdefault((lang, source), (Counter(), Counter()))
            size -= len(counts)
            seen: set[bytes] = set()
            for piece in terms(text):
                counts.update(piece)
                seen.update(piece)
            docs.update(seen)
            size += len(counts)
            if size > HELD:
                yield from passed()
                size = 0
    yield from passed()


def index(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, postings): each kept term with its count in each source, an array of (source, n)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = _named(docs).withColumn("text", text)
    counted = rows.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    # Dealt by term once: the counts of a source, then the term's row, need no further shuffle.
    counted = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    rows = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("postings"))
    return rows.where(F.col("docs") >= least_docs).drop("docs")


def _named(docs: DataFrame) -> DataFrame:
    lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))
    return docs.select(lang, source, "text")


def groups(docs: DataFrame, terms_: DataFrame) -> DataFrame:
    """(lang, source, place, total, kept): each group's number in its language, its terms, and the kept terms V."""
    own = _named(docs).select("lang", "source").groupBy("lang", "source").agg(F.lit(1).alias("one")).drop("one")
    totals = terms_.select("lang", F.explode("postings").alias("p")).groupBy("lang", "p.source").agg(F.sum("p.n").alias("total"))
    kept = terms_.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    own = own.join(totals, ["lang", "source"], "left").join(kept, "lang", "left").fillna(0, ["total", "kept"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    return own.withColumn("place", place.cast("long"))


def share(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """``1 + floor(SCALE * (count + SMOOTH) / total)``, by long division in steps of a thousand."""
    quotient, rest = np.zeros_like(count), count + SMOOTH
    for _ in range(3):
        rest = rest * 1000
        quotient, rest = quotient * 1000 + rest // total, rest % total
    return quotient + 1


def scattered(term_of: np.ndarray, place: np.ndarray, p: np.ndarray, base: np.ndarray, chosen: np.ndarray):
    """For each of the ``chosen`` groups its number and two dense accumulators over all groups.

    ``term_of``, ``place`` and ``p`` are postings in order of their terms. The first accumulator has
    what the group's row gives its peers, the second what it has without the common terms, which
    every peer needs for its own row too.
    """
    starts = np.searchsorted(term_of, np.arange(term_of[-1] + 2 if len(term_of) else 1))
    by_group = np.argsort(place, kind="stable")
    first = np.searchsorted(place[by_group], np.arange(len(base) + 1))
    for g in chosen.tolist():
        mine = by_group[first[g] : first[g + 1]]
        apart = np.abs(base[g] - base)
        order = np.sort(p[mine])
        before = np.concatenate([[0], np.cumsum(order)])
        k = np.searchsorted(order, base)
        alone = base * (2 * k - len(order)) + before[-1] - 2 * before[k] - len(order) * apart
        counts = starts[term_of[mine] + 1] - starts[term_of[mine]]
        met = ranges(starts[term_of[mine]], counts)
        own, peer, other = np.repeat(p[mine], counts), place[met], p[met]
        row = alone.copy()
        np.add.at(row, peer, np.abs(own - other) - np.abs(own - base[peer]) - np.abs(base[g] - other) + apart[peer])
        yield g, row, alone


def _audit(top: int):
    columns = ["lang", "place", "other", "term", "value"]

    def rows(key, places, others, own, values) -> pa.Table:
        n = len(places)
        arrays = [pa.array([key] * n, pa.string()), pa.array(places, pa.int64()), pa.array(others, pa.int64()), pa.array(own, pa.string())]
        return pa.table([*arrays, pa.array(values, pa.int64())], names=columns)

    def audit(key, left: pa.Table, right: pa.Table) -> pa.Table:
        lang, shard, block = key[0].as_py(), key[1].as_py(), key[2].as_py()
        right = right.sort_by("place")
        many, blocks = right.num_rows, right["blocks"][0].as_py()
        kept = right["kept"][0].as_py()
        if not kept:
            if shard:
                return rows(lang, [], [], [], [])
            chosen = np.arange(block, many, blocks)
            g, h = np.repeat(chosen, many), np.tile(np.arange(many), len(chosen))
            return rows(lang, g[g != h], h[g != h], [None] * int((g != h).sum()), np.zeros((g != h).sum(), np.int64))
        totals = right["total"].to_numpy().astype(np.int64) + SMOOTH * kept
        base = share(np.zeros(many, np.int64), totals)
        left = left.combine_chunks()
        lists = left["postings"].combine_chunks() if left.num_rows else pa.array([], left.schema.field("postings").type)
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        flat = lists.flatten()
        place = pc.index_in(flat.field("source"), right["source"].combine_chunks()).to_numpy(zero_copy_only=False).astype(np.int64)
        n = flat.field("n").to_numpy().astype(np.int64)
        term_of = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()) if len(lists) else [])
        p = share(n, totals[place])
        out = []
        for g, row, alone in scattered(term_of, place, p, base, np.arange(block, many, blocks)):
            value = row + (kept * np.abs(base[g] - base) if shard == 0 else 0)
            peers = np.flatnonzero(np.arange(many) != g)
            out.append((np.full(len(peers), g), peers, value[peers]))
            out.append((peers, np.full(len(peers), g), alone[peers]))
        pairs = [np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64) for i in range(3)]
        table = rows(lang, pairs[0], pairs[1], [None] * len(pairs[0]), pairs[2])
        if block or not len(p):
            return table
        # Terms that a group has more of than its language: the first ``top`` of each group here.
        whole = np.bincount(term_of, n, len(lists)).astype(np.int64) if n.sum() < 1 << 53 else _sums(term_of, n, len(lists))
        more = p - share(whole, int(totals.sum()) - SMOOTH * kept * (many - 1))[term_of]
        some = np.flatnonzero(more > 0)
        names = left["term"].cast(pa.binary()).to_pylist()
        place_of = np.empty(len(names), np.int64)
        place_of[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
        order = some[np.lexsort((place_of[term_of[some]], -more[some], place[some]))]
        rank = np.arange(len(order)) - np.searchsorted(place[order], place[order])
        order = order[rank < top]
        own = [names[t].decode() for t in term_of[order]]
        return pa.concat_tables([table, rows(lang, place[order], [None] * len(order), own, more[order])])

    return audit


def _sums(where: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    total = np.zeros(size, np.int64)
    np.add.at(total, where, values)
    return total


def report(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value and rank: what the audit says of every group.

    Part ``pair`` has every other source of the language with the sum of the differences of
    shares over all kept terms, part ``term`` the ``top`` terms that the group has more of
    than its language. Null text, lang and source are ''; documents without terms make a group
    too; rows that repeat count each for itself; ties go by the item's bytes. A language without a
    kept term has pairs of value 0. Texts are counted whole, in pieces of a megabyte. An empty
    table gives no rows; other columns are dropped.
    """
    terms_ = written(index(docs, least_docs))
    known = written(groups(docs, terms_))
    # A shard for so many postings, and blocks of rows so that a task's accumulators stay small.
    sizes = terms_.groupBy("lang").agg(F.sum(F.size("postings")).alias("postings"))
    langs = known.groupBy("lang").agg(F.count(F.lit(1)).alias("many")).join(sizes, "lang", "left")
    shards = F.greatest(F.ceil(F.coalesce("postings", F.lit(0)) / SHARD_POSTINGS), F.lit(LEAST_SHARDS)).cast("long")
    blocks = F.ceil(F.col("many") * F.col("many") / CELLS).cast("long")
    langs = written(langs.select("lang", shards.alias("shards"), blocks.alias("blocks")))
    # Joined with by its only row, a language's index would meet in one task.
    langs = F.broadcast(langs) if langs.count() <= MOST_LANGS else langs
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")
    left = terms_.join(langs, "lang").withColumn("shard", F.pmod(F.xxhash64("term"), F.col("shards")))
    left = left.select("lang", "shard", each, "term", "postings")
    right = known.join(langs, "lang").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
    right = right.select("lang", "shard", each, "source", "place", "total", "kept", "blocks")
    keys = ["lang", "shard", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        _audit(top), "lang string, place long, other long, term string, value long"
    )
    found = found.groupBy("lang", "place", "other", "term").agg(F.sum("value").alias("value"))
    peers = known.select("lang", F.col("place").alias("other"), F.col("source").alias("peer"))
    found = found.join(known.select("lang", "place", "source"), ["lang", "place"]).join(peers, ["lang", "other"], "left")
    part = F.when(F.col("other").isNull(), "term").otherwise("pair").alias("part")
    found = found.select("lang", "source", part, F.coalesce("term", "peer").alias("item"), "value")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    found = found.withColumn("rank", F.row_number().over(order))
    return found.where((F.col("part") == "pair") | (F.col("rank") <= top))


SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), each AS (
  SELECT r, lang, source, unnest(w) AS term FROM docs
), counted AS (
  SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS d FROM each GROUP BY ALL
), kept AS (
  SELECT lang, term, CAST(sum(n) AS BIGINT) AS n FROM counted GROUP BY ALL HAVING sum(d) >= {LEAST_DOCS}
), counts AS (
  SELECT lang, source, term, n FROM counted SEMI JOIN kept USING (lang, term)
), langs AS (
  SELECT lang, count(*) AS v, CAST(sum(n) AS BIGINT) AS total FROM kept GROUP BY ALL
), known AS (
  SELECT lang, source, CAST(coalesce(total, 0) AS BIGINT) AS total
  FROM (SELECT DISTINCT lang, source FROM docs)
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL) USING (lang, source)
), shares AS (
  SELECT k.lang, k.source, t.term, coalesce(c.n, 0) AS n,
    1 + ({SCALE} * (coalesce(c.n, 0) + {SMOOTH})) // (k.total + {SMOOTH} * l.v) AS p,
    1 + ({SCALE} * (t.n + {SMOOTH})) // (l.total + {SMOOTH} * l.v) AS q
  FROM known k JOIN langs l USING (lang) JOIN kept t USING (lang)
  LEFT JOIN counts c ON c.lang = k.lang AND c.source = k.source AND c.term = t.term
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(sum(abs(x.p - y.p)), 0) AS BIGINT) AS value
  FROM known a JOIN known b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM found
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
