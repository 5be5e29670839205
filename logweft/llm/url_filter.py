"""URL filters: rules by host and path, and gradient-boosted trees for the rest.

The urls that a rule judges are the labelled ones. Trees learn from lexical features:
length, depth, digit ratio, entropy, parameter counts, and how often urls with the same
host suffixes and first path part were blocked.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweft.llm.stage import written
from logweft.llm.words import slices

#: (host, path, verdict): a rule fits its host and all subdomains if the path starts with its own.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Labelled urls the trees are fitted on at most, the first in md5 order.
SAMPLE = 20_000
#: A row to learn from is described by the statistics of the other folds.
FOLDS = 5
TREES, DEPTH, RATE, BINS, LEAST = 40, 4, 0.2, 32, 5
SMOOTH = 4.0

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GROUPS = ("top", "site", "head")


def parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a url; both empty where it is null or has no ``://``."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def judged(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for own, start, said in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        rule = F.when(fits, F.lit(own + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def groups(host: Column, path: Column) -> dict[str, Column]:
    """The host's last part, its last two parts, and the first part of the path."""
    return {
        "top": F.substring_index(host, ".", -1),
        "site": F.substring_index(host, ".", -2),
        "head": F.substring_index(F.substring(path, F.lit(2), F.length(path)), "/", 1),
    }


def features(urls: pa.Array, paths: pa.Array) -> np.ndarray:
    """Length, digit ratio, entropy of bytes, parameters, dots, hyphens, depth, path length, path's digit ratio."""
    out = [_lexical(*piece[2:]) for piece in slices(urls)]
    own = [_lexical(*piece[2:]) for piece in slices(paths)]
    if not out:
        return np.zeros((0, 9))
    url, path = np.concatenate(out), np.concatenate(own)
    return np.column_stack([url[:, :6], path[:, 6], path[:, 0], path[:, 1]])


def _lexical(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    lengths = np.diff(offsets)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    least = np.maximum(lengths, 1)

    def share(which: np.ndarray) -> np.ndarray:
        return np.bincount(rows[which], minlength=len(lengths)).astype(float)

    pairs, counts = np.unique(rows * 256 + data, return_counts=True)
    p = counts / least[pairs // 256]
    entropy = np.bincount(pairs // 256, weights=-p * np.log2(p), minlength=len(lengths))
    digits = share((data >= 48) & (data <= 57))
    return np.column_stack(
        [lengths, digits / least, entropy, share((data == 61) | (data == 38)), share(data == 46), share(data == 45), share(data == 47)]
    )


@dataclass
class Trees:
    """Boosted trees of one depth: node ``i`` has the children ``2i+1`` and ``2i+2``."""

    cuts: np.ndarray
    prior: float
    column: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability that a row is blocked."""
        binned = _binned(x, self.cuts)
        total = np.full(len(x), self.prior)
        every = np.arange(len(x))
        for column, cut, value in zip(self.column, self.cut, self.value, strict=True):
            node = np.zeros(len(x), int)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (binned[every, column[node]] > cut[node])
            total += value[node]
        return 1 / (1 + np.exp(-total))


def _binned(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    return np.column_stack([np.searchsorted(cuts[i], x[:, i]) for i in range(x.shape[1])]).astype(np.int64)


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Histogram trees with logistic loss and second-order leaf values; nothing is drawn at random."""
    size, n = x.shape[1], 2 ** (DEPTH + 1) - 1
    cuts = np.array([np.quantile(x[:, i], np.linspace(0, 1, BINS + 1)[1:-1]) for i in range(size)])
    rate = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    trees = Trees(cuts, float(np.log(rate / (1 - rate))), np.zeros((0, n), int), np.zeros((0, n), int), np.zeros((0, n)))
    binned, total = _binned(x, cuts), np.full(len(x), trees.prior)
    columns, limits, values = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        gradient, curve = y - p, p * (1 - p)
        column, cut, value = np.zeros(n, int), np.full(n, BINS), np.zeros(n)
        node = np.zeros(len(x), int)
        for level in range(DEPTH):
            first = 2**level - 1
            best = np.zeros(2**level)
            for i in range(size):
                at = (node - first) * BINS + binned[:, i]
                g, h, c = (np.bincount(at, w, 2**level * BINS).reshape(-1, BINS).cumsum(1) for w in (gradient, curve, None))
                gain = _gain(g, h) + _gain(g[:, -1:] - g, h[:, -1:] - h) - _gain(g[:, -1:], h[:, -1:])
                gain[(c < LEAST) | (c[:, -1:] - c < LEAST)] = 0
                most, place = gain.max(1), gain.argmax(1)
                better = most > best + 1e-9
                best = np.where(better, most, best)
                column[first : first + 2**level] = np.where(better, i, column[first : first + 2**level])
                cut[first : first + 2**level] = np.where(better, place, cut[first : first + 2**level])
            node = 2 * node + 1 + (binned[np.arange(len(x)), column[node]] > cut[node])
        leaf = np.bincount(node, gradient, n) / (np.bincount(node, curve, n) + 1)
        value = RATE * leaf
        total += value[node]
        columns.append(column), limits.append(cut), values.append(value)
    return Trees(cuts, trees.prior, np.array(columns), np.array(limits), np.array(values))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1)


def statistics(labelled: DataFrame) -> dict[str, DataFrame]:
    """Of each kind of group a table with a row for each suffix: labelled and blocked urls by fold, as arrays."""

    def by_fold(name: str, value: Column) -> Column:
        return F.array(*[F.sum(F.when(F.col("fold") == i, value).otherwise(0)) for i in range(FOLDS)]).alias(name)

    return {
        name: written(labelled.groupBy(name).agg(by_fold(f"{name}_n", F.lit(1)), by_fold(f"{name}_b", F.col("blocked"))))
        for name in _GROUPS
    }


def with_rates(rows: DataFrame, known: dict[str, DataFrame], rate: float, learned: bool = False) -> DataFrame:
    """``rows`` with the smoothed share of blocked urls in each of their groups; without a row's own fold if it is learned from.

    A suffix that no labelled url has gives the share of all. Joins on a hot suffix can be split,
    as the other side has one row for it.
    """
    for name, table in known.items():
        rows = rows.join(table, name, "left")
        counts = []
        for part in ("n", "b"):
            own = F.coalesce(F.col(f"{name}_{part}"), F.array_repeat(F.lit(0).cast("long"), FOLDS))
            total = F.aggregate(own, F.lit(0).cast("long"), lambda x, y: x + y)
            counts.append(total - F.get(own, F.col("fold")) if learned else total)
        share = (counts[1] + SMOOTH * rate) / (counts[0] + SMOOTH)
        rows = rows.withColumn(f"{name}_rate", share).drop(f"{name}_n", f"{name}_b")
    return rows


def prepared(pages: DataFrame, rules=RULES) -> DataFrame:
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = judged(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "said": verdict, **groups(F.col("host"), F.col("path"))})
    rows = rows.withColumn("fold", F.pmod(F.xxhash64("url", F.lit(1)), F.lit(FOLDS)).cast("int"))
    return rows.withColumn("blocked", (F.col("said") == "block").cast("int"))


def train(labelled: DataFrame, sample: int = SAMPLE) -> tuple[Trees | None, dict[str, DataFrame], float]:
    """Trees, statistics by suffix and share of blocked urls, from rows of ``prepared`` with a verdict.

    The statistics cover all labelled rows; the trees are fitted on at most ``sample`` of them.
    Without both verdicts among them there are no trees.
    """
    known = statistics(labelled)
    total, blocked = labelled.agg(F.count(F.lit(1)), F.coalesce(F.sum("blocked"), F.lit(0))).first()
    rate = float(blocked / total) if total else 0.0
    if blocked in (0, total):
        return None, known, rate
    rows = labelled.select("url", "path", "blocked", "fold", *_GROUPS, F.md5("url").alias("place"))
    rows = with_rates(rows.orderBy("place", "url").limit(sample), known, rate, True).toArrow().combine_chunks()
    rows = rows.sort_by([("place", "ascending"), ("url", "ascending")])
    return fit(described(rows), rows["blocked"].to_numpy().astype(float)), known, rate


def described(rows) -> np.ndarray:
    """Features of Arrow rows that ``with_rates`` gave."""
    columns = [rows.column(name) for name in ("url", "path")]
    own = features(*[c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns])
    rates = [np.asarray(rows.column(f"{name}_rate")) for name in _GROUPS]
    return np.column_stack([own, *rates])


def judge(pages: DataFrame, rules=RULES, sample: int = SAMPLE) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score.

    The longest rule that fits decides; else the trees block at a score of 0.5 or more. ``score``
    is their probability of ``block`` for every url, also where a rule decides. A null or empty
    url is a text of no bytes. Without labelled urls of both kinds the score is the share of
    blocked ones (0 without any). Repeated rows are judged alike; further columns are dropped.
    """
    rows = prepared(pages, rules)
    trees, known, rate = train(rows.where(F.col("said").isNotNull()), sample)
    plain = trees and (trees.cuts, trees.prior, trees.column, trees.cut, trees.value)
    model = pages.sparkSession.sparkContext.broadcast((plain, rate))
    kept = ["page_id", "host", "path", "rule", "said"]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, share = model.value
        own = plain and Trees(*plain)
        for batch in batches:
            score = own.score(described(batch)) if own else np.full(batch.num_rows, share)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(score)], names=[*kept, "score"])

    kind = rows.schema["page_id"].dataType.simpleString()
    rows = with_rates(rows.drop("blocked"), known, rate).select(*kept, "url", *[f"{name}_rate" for name in _GROUPS])
    out = rows.mapInArrow(scored, f"page_id {kind}, host string, path string, rule string, said string, score double")
    method = F.when(F.col("score") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("said", method).alias("verdict"), "score")
