"""Quality scores by a factorisation machine over hashed words and structure statistics.

The score is ``bias + <w, x> + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i (v_if x_i)^2)``: all
pairwise interactions in time linear in the number of features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweft.llm.stage import written
from logweft.llm.words import SPACE, hashes, lists, slices, spans

#: Buckets for words, structure statistics after them, and rank of the interactions.
BUCKETS, STATISTICS, RANK = 1 << 14, 10, 8
#: Labelled documents the model is fitted on at most, the first in md5 order.
SAMPLE = 8000
EPOCHS, RATE, PENALTY, BATCH = 12, 0.05, 2e-5, 64
#: Scores of at least so much are predicted as 1.
THRESHOLD = 0.3


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers and values of the rows, one after the other, and the number of features of each row.

    Words count by log frequency over the length of the row's vector; the statistics are shares
    in 0 to 1, or logarithms brought to about that.
    """
    rows = len(offsets) - 1
    starts, ends, first = spans(data, offsets, SPACE)
    words = np.diff(first)
    of = np.repeat(np.arange(rows), words)
    buckets = (hashes(data, starts, ends) >> np.uint64(50)).astype(np.int64)
    pairs, times = np.unique(of * BUCKETS + buckets, return_counts=True)
    owner = pairs // BUCKETS
    value = 1 + np.log(times)
    norm = np.sqrt(np.bincount(owner, value * value, rows))
    value /= norm[owner]
    stats = _statistics(data, offsets, starts, ends, of, words, np.bincount(owner, minlength=rows))
    counts = np.bincount(owner, minlength=rows) + STATISTICS
    numbers = np.empty(counts.sum(), np.int64)
    values = np.empty(counts.sum(), np.float32)
    begin = np.cumsum(counts) - counts
    own = (begin[:, None] + np.arange(STATISTICS)).ravel()
    numbers[own] = np.tile(np.arange(BUCKETS, BUCKETS + STATISTICS), rows)
    values[own] = stats.ravel()
    rest = np.ones(len(numbers), bool)
    rest[own] = False
    numbers[rest], values[rest] = pairs % BUCKETS, value
    return numbers, values, counts


def _statistics(data, offsets, starts, ends, of, words, distinct) -> np.ndarray:
    rows, lengths = len(offsets) - 1, np.diff(offsets)
    at = np.repeat(np.arange(rows), lengths)
    size, many = np.maximum(lengths, 1), np.maximum(words, 1)

    def share(which: np.ndarray) -> np.ndarray:
        return np.bincount(at[which], minlength=rows) / size

    letters = share(((data | 32) >= 97) & ((data | 32) <= 122) | (data >= 128))
    ends_in = data[ends - 1] if len(ends) else data[:0]
    marked = ~(((ends_in | 32) >= 97) & ((ends_in | 32) <= 122) | (ends_in >= 128))
    return np.column_stack([
        np.log1p(lengths) / 10,
        np.log1p(words) / 10,
        (lengths / many).clip(0, 50) / 10,
        distinct / many,
        share((data >= 65) & (data <= 90)) / np.maximum(letters, 0.01),
        share((data >= 48) & (data <= 57)),
        1 - letters - share(SPACE[data]) - share((data >= 48) & (data <= 57)),
        share(data == 10) * 20,
        np.bincount(of[marked], minlength=rows) / many,
        np.bincount(of[(ends - starts) == 1], minlength=rows) / many,
    ])


@dataclass
class Machine:
    bias: float
    weight: np.ndarray
    factors: np.ndarray

    def raw(self, numbers: np.ndarray, values: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Log odds of each row, by the sum-of-squares identity."""
        starts = np.cumsum(counts) - counts
        linear = np.add.reduceat(self.weight[numbers] * values, starts)
        parts = self.factors[numbers] * values[:, None]
        total = np.add.reduceat(parts, starts)
        squares = np.add.reduceat(parts * parts, starts)
        return self.bias + linear + 0.5 * (total * total - squares).sum(1)

    def score(self, numbers: np.ndarray, values: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(numbers, values, counts).clip(-30, 30)))


def fit(numbers: np.ndarray, values: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> Machine:
    """Adagrad on the logistic loss, with a fixed seed."""
    random = np.random.default_rng(7)
    size = BUCKETS + STATISTICS
    rate = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    model = Machine(
        float(np.log(rate / (1 - rate))), np.zeros(size, np.float32), random.normal(0, 0.05, (size, RANK)).astype(np.float32)
    )
    squares = [np.full(1, 1e-6), np.full(size, 1e-6, np.float32), np.full((size, RANK), 1e-6, np.float32)]
    starts = np.cumsum(counts) - counts
    for _ in range(EPOCHS):
        order = random.permutation(len(counts))
        for first in range(0, len(order), BATCH):
            rows = order[first : first + BATCH]
            n = counts[rows]
            at = np.repeat(starts[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            num, val = numbers[at], values[at]
            own = np.repeat(np.arange(len(rows)), n)
            error = (model.score(num, val, n) - labels[rows]) / len(rows)
            total = np.add.reduceat(model.factors[num] * val[:, None], np.cumsum(n) - n)
            slope = error[own] * val
            used, place = np.unique(num, return_inverse=True)
            by_w = np.bincount(place, slope, len(used)) + PENALTY * model.weight[used]
            each = slope[:, None] * (total[own] - model.factors[num] * val[:, None])
            by_v = np.zeros((len(used), RANK))
            np.add.at(by_v, place, each)
            by_v += PENALTY * model.factors[used]
            squares[0] += error.sum() ** 2
            model.bias -= RATE * float(error.sum() / np.sqrt(squares[0][0]))
            squares[1][used] += by_w**2
            model.weight[used] -= RATE * by_w / np.sqrt(squares[1][used])
            squares[2][used] += by_v**2
            model.factors[used] -= RATE * by_v / np.sqrt(squares[2][used])
    return model


def held_out(share: int = 5):
    """Rows that are never learned from: crc32 of the id as text divisible by ``share``."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(share)) == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine | None:
    """A model from at most ``sample`` labelled documents outside of the held-out fold; None without any.

    Null labels are left out; a document with several labels takes their majority, 1 on a tie.
    """
    chosen = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    chosen = chosen.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    chosen = written(chosen.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(sample))
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")  # at most ``sample`` small rows

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in slices(batch.column("text")):
                numbers, values, counts = features(data, offsets)
                part = batch.slice(first, end - first)
                columns = [part.column(0), part.column(1), lists(numbers, counts, pa.int32()), lists(values, counts, pa.float32())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "label", "numbers", "values"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = rows.mapInArrow(compute, f"doc_id {kind}, label int, numbers array<int>, values array<float>")
    rows = rows.dropDuplicates().orderBy("doc_id", "numbers", "values").limit(2 * sample).toArrow()
    if not rows.num_rows:
        return None
    numbers, values = (rows[name].combine_chunks() for name in ("numbers", "values"))
    counts = np.diff(numbers.offsets.to_numpy())
    flat = numbers.flatten().to_numpy().astype(np.int64), values.flatten().to_numpy()
    return fit(*flat, counts, rows["label"].to_numpy().astype(float))


def score(docs: DataFrame, model: Machine | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every document.

    A null text is scored as an empty one, by the statistics alone. Without a model every score
    is 0.5. Only the text is an input of the score; further columns are dropped. Rows that repeat and
    equal ids are scored each for itself, equal texts alike; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model and (model.bias, model.weight, model.factors))
    rows = docs.select("doc_id", held_out().alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value and Machine(*shared.value)
        for batch in batches:
            found = [own.score(*features(*piece[2:])) if own else np.full(len(piece[3]) - 1, 0.5) for piece in slices(batch.column(2))]
            values = np.concatenate(found) if found else np.zeros(0)
            columns = [batch.column(0), batch.column(1), pa.array(values, pa.float64()), pa.array(values >= threshold).cast(pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scored, f"doc_id {kind}, held_out boolean, score double, predicted int")
