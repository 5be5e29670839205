"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained here, in numpy, by backpropagation through time. It labels every
byte of a text; a document's probabilities are the means over its positions. Gates use
``clip(a, 0, 1)`` and states ``c / (1 + |c|)``, which are trained as they are used.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweft.llm.stage import unused
from logweft.llm.words import slices

#: Units of each direction, bytes of a segment (states start anew there), segments worked on at once.
UNITS, SEGMENT, BLOCK = 8, 64, 2048
#: Labelled documents the network is fitted on, dealt evenly to the languages, and documents of each at least; the
#: first of a language in md5 order. Languages with fewer documents give all of them.
SAMPLE, LEAST_DOCS = 4000, 250
#: Pieces of ``SEGMENT`` characters taken of a document, spread over it; more, up to the second number, where
#: the language has fewer documents than its part.
SEGMENTS, MOST_SEGMENTS = 2, 64
#: Leading hexadecimal digits of the md5 key by which documents of a language are counted.
DIGITS = 3
EPOCHS, RATE, BATCH = 10, 0.02, 256
#: Documents are rejected by ``accepted`` below this part of the way from an even guess to certainty.
LEAST_SHARE = 0.3
#: Bytes of a text from which on its score counts in full.
ENOUGH = 256
UNKNOWN = "und"


@dataclass
class Network:
    languages: list[str]
    #: Of each direction: what each byte adds to the update gate, reset gate and state; the same for the last state.
    inputs: list[list[np.ndarray]]
    states: list[list[np.ndarray]]
    out: np.ndarray
    bias: np.ndarray

    def tensors(self) -> list[np.ndarray]:
        return [*self.inputs[0], *self.inputs[1], *self.states[0], *self.states[1], self.out, self.bias]


def started(languages: list[str], seed: int = 11) -> Network:
    random = np.random.default_rng(seed)

    def table(*shape: int, at: float = 0.0, spread: float = 0.3) -> np.ndarray:
        return (at + spread * random.standard_normal(shape)).astype(np.float32)

    inputs = [[table(256, UNITS, at=0.3), table(256, UNITS, at=0.5), table(256, UNITS)] for _ in range(2)]
    states = [[table(UNITS, UNITS, spread=0.1) for _ in range(3)] for _ in range(2)]
    network = Network(languages, inputs, states, table(2 * UNITS, len(languages)), np.zeros(len(languages), np.float32))
    _pad(network)
    return network


def _pad(network: Network) -> None:
    """Byte 0, with which segments are filled up, leaves the state as it is."""
    for tables in network.inputs:
        tables[0][0] = -1e6


def _run(tables, weights, codes: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States after each of the (time, segment) codes."""
    (tz, tr, tn), (uz, ur, un) = tables, weights
    steps, rows = codes.shape
    out = np.empty((steps, rows, UNITS), np.float32)
    state = np.zeros((rows, UNITS), np.float32)
    for t in range(steps):
        code = codes[t]
        z, r, c, q = tz[code], tr[code], tn[code], state @ un
        z += state @ uz
        r += state @ ur
        if keep is not None:
            inside = ((z > 0) & (z < 1), (r > 0) & (r < 1))
        np.clip(z, 0, 1, out=z)
        np.clip(r, 0, 1, out=r)
        c += r * q
        n = c / (1 + np.abs(c))
        if keep is not None:
            keep.append((state, z, r, c, q, n, inside))
        state = state + z * (n - state)
        out[t] = state
    return out


def _back(tables, weights, codes: np.ndarray, kept: list, slope: np.ndarray) -> tuple[list, list]:
    """Gradients by the byte tables and the state weights; ``slope`` is by the states."""
    uz, ur, un = weights
    by_state = [np.zeros_like(w) for w in weights]
    parts = [np.empty(slope.shape, np.float32) for _ in range(3)]
    carried = np.zeros(slope.shape[1:], np.float32)
    for t in range(len(codes) - 1, -1, -1):
        state, z, r, c, q, n, inside = kept[t]
        d = carried + slope[t]
        dz = d * (n - state) * inside[0]
        dc = d * z / np.square(1 + np.abs(c))
        dr = dc * q * inside[1]
        dq = dc * r
        carried = d * (1 - z) + dz @ uz.T + dr @ ur.T + dq @ un.T
        for grad, part in zip(by_state, (dz, dr, dq), strict=True):
            grad += state.T @ part
        parts[0][t], parts[1][t], parts[2][t] = dz, dr, dc
    hot = np.zeros((256, codes.size), np.float32)
    hot[codes.ravel(), np.arange(codes.size)] = 1
    return [hot @ p.reshape(-1, UNITS) for p in parts], by_state


def _odds(network: Network, codes: np.ndarray, keep: tuple[list, list] | None = None):
    ahead = _run(network.inputs[0], network.states[0], codes, keep and keep[0])
    behind = _run(network.inputs[1], network.states[1], codes[::-1], keep and keep[1])[::-1]
    odds = ahead.reshape(-1, UNITS) @ network.out[:UNITS] + behind.reshape(-1, UNITS) @ network.out[UNITS:]
    odds += network.bias
    np.exp(odds - odds.max(1, keepdims=True), out=odds)
    odds /= odds.sum(1, keepdims=True)
    return odds, ahead, behind


def fit(codes: np.ndarray, labels: np.ndarray, languages: list[str]) -> Network:
    """Train on segments (time, segment) with a label each: cross entropy of every position, Adam, a fixed seed.

    Languages count alike, however many segments they have.
    """
    network = started(languages)
    random = np.random.default_rng(5)
    weight = 1 / np.maximum(np.bincount(labels, minlength=len(languages)), 1)
    weight = (weight / weight[labels].mean()).astype(np.float32)
    tensors = network.tensors()
    first, second = [np.zeros_like(t) for t in tensors], [np.zeros_like(t) for t in tensors]
    step, total = 0, EPOCHS * -(-codes.shape[1] // BATCH)
    for _ in range(EPOCHS):
        order = random.permutation(codes.shape[1])
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            grads = _gradients(network, codes[:, chosen], labels[chosen], weight[labels[chosen]])
            step += 1
            rate = RATE * (1 - step / (total + 1))
            for tensor, grad, m, v in zip(tensors, grads, first, second, strict=True):
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                tensor -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
            _pad(network)
    return network


def _gradients(network: Network, codes: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    keep: tuple[list, list] = ([], [])
    odds, ahead, behind = _odds(network, codes, keep)
    steps, rows = codes.shape
    slope = odds
    slope[np.arange(slope.shape[0]), np.tile(labels, steps)] -= 1
    slope *= (np.tile(weight, steps) * (codes.ravel() > 0) / codes.size)[:, None].astype(np.float32)
    states = (ahead.reshape(-1, UNITS), behind.reshape(-1, UNITS))
    by_out = np.concatenate([s.T @ slope for s in states])
    by_ahead = (slope @ network.out[:UNITS].T).reshape(steps, rows, UNITS)
    by_behind = (slope @ network.out[UNITS:].T).reshape(steps, rows, UNITS)[::-1]
    tables0, states0 = _back(network.inputs[0], network.states[0], codes, keep[0], by_ahead)
    tables1, states1 = _back(network.inputs[1], network.states[1], codes[::-1], keep[1], by_behind)
    return [*tables0, *tables1, *states0, *states1, by_out, slope.sum(0)]


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the rows as (segment, time) codes, filled up with 0, and the number of segments of each row."""
    lengths = np.diff(offsets)
    counts = -(-lengths // SEGMENT)
    row = np.repeat(np.arange(len(lengths)), counts)
    number = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    start = offsets[:-1][row] + number * SEGMENT
    place = start[:, None] + np.arange(SEGMENT)
    codes = np.take(data, place, mode="clip") if len(data) else np.zeros(place.shape, np.uint8)
    codes[place >= offsets[1:][row][:, None]] = 0
    return codes, counts


def pooled(network: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean probabilities of each row over all of its positions; 0 for a row of no bytes."""
    codes, counts = segments(data, offsets)
    sums = np.zeros((len(codes), len(network.languages)))
    for first in range(0, len(codes), BLOCK):
        block = np.ascontiguousarray(codes[first : first + BLOCK].T)
        odds, _, _ = _odds(network, block)
        odds *= (block.ravel() > 0)[:, None]
        sums[first : first + BLOCK] = odds.reshape(SEGMENT, block.shape[1], -1).sum(0)
    owner = np.repeat(np.arange(len(counts)), counts)
    total = np.column_stack([np.bincount(owner, sums[:, i], len(counts)) for i in range(sums.shape[1])])
    return total / np.maximum(total.sum(1, keepdims=True), 1e-9)


def held_out(share: int = 4, rest: int = 2):
    """Rows that are never learned from, by crc32 of the id as text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(share)) == rest


def _lettered(docs: DataFrame) -> DataFrame:
    """lang, text and md5 key of the documents that may be learned from."""
    texts = F.col("text").cast("string")
    rows = docs.where(F.col("lang").isNotNull() & ~held_out() & texts.rlike(r"\p{L}"))
    key = F.md5(F.concat_ws(" ", F.col("doc_id").cast("string"), F.lit("language")).cast("binary"))
    return rows.select(F.col("lang").cast("string").alias("lang"), texts.alias("text"), key.alias("key"))


def learned_from(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], DataFrame | None]:
    """All languages that documents outside of the held-out fold have, and pieces (lang, text, key, i) of some of each."""
    rows = _lettered(docs)
    digits = F.substring("key", 1, DIGITS)
    counted = rows.groupBy("lang", digits.alias("digits")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    counted = counted.sort_by([("lang", "ascending"), ("digits", "ascending")]).to_pylist()
    languages = sorted({r["lang"] for r in counted})
    if not languages:
        return [], None
    most = max(sample // len(languages), LEAST_DOCS)
    # The digits up to which a language has enough documents; where it has fewer, each gives more pieces.
    last, sizes = {}, dict.fromkeys(languages, 0)
    for r in counted:
        if sizes[r["lang"]] < most:
            last[r["lang"]] = r["digits"]
        sizes[r["lang"]] += r["n"]
    wanted = {lang: min(max(-(-SEGMENTS * most // n), SEGMENTS), MOST_SEGMENTS) for lang, n in sizes.items()}
    rows = rows.where(digits <= _looked_up(last, "string")).select("lang", "key", _pieces(_looked_up(wanted, "int")).alias("pieces"))
    order = Window.partitionBy("lang").orderBy("key", "pieces")
    rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return languages, rows.select("lang", "key", F.posexplode("pieces").alias("i", "text"))


def _looked_up(values: dict, kind: str):
    return F.try_element_at(F.from_json(F.lit(json.dumps(values)), f"map<string, {kind}>"), F.col("lang"))


def _pieces(wanted):
    """Pieces of ``SEGMENT`` characters, one from each of so many equal parts of the text; where in its part depends on the document's hash."""
    size = F.char_length("text").cast("long")
    number = F.least(wanted, F.ceil(size / SEGMENT)).cast("int")

    def piece(i):
        low, high = (F.floor(size * (i + k) / number) for k in (0, 1))
        slack = F.greatest(high - low - SEGMENT, F.lit(0)) + 1
        # A part of a short text is shorter than a piece.
        length = F.least(high - low, F.lit(SEGMENT)).cast("int")
        return F.substring(F.col("text"), (low + F.pmod(F.xxhash64("key", size, i), slack) + 1).cast("int"), length)

    return F.transform(F.sequence(F.lit(0), number - 1), piece)


def train(docs: DataFrame, sample: int = SAMPLE) -> Network | None:
    """A network of all languages of the documents outside of the held-out fold; None without any.

    Learned from ``sample`` documents in even parts, or ``LEAST_DOCS`` of each language if that is more.
    """
    languages, pieces = learned_from(docs, sample)
    if not languages:
        return None
    rows = pieces.toArrow().combine_chunks().sort_by([(name, "ascending") for name in ("key", "lang", "text", "i")])
    number = {name: i for i, name in enumerate(languages)}
    labels = np.array([number[name] for name in rows["lang"].to_pylist()])
    parts = [(codes, np.repeat(labels[first:end], counts)) for first, end, data, offsets in slices(rows["text"].combine_chunks())
             for codes, counts in [segments(data, offsets)]]
    codes, own = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    return fit(np.ascontiguousarray(codes.T), own, languages)


def predict(docs: DataFrame, network: Network | None, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns of ``docs`` with the columns ``lang_pred`` and ``score``, or as named, added or replaced.

    A null text and one without a letter is ``und`` with score 0, as is every text if there was
    nothing to learn from. Else ``score`` is the mean probability of the predicted language over
    all bytes; NUL bytes count as padding. Only the text is an input; equal texts get equal results.
    """
    plain = network and (network.languages, network.inputs, network.states, network.out, network.bias)
    shared = docs.sparkSession.sparkContext.broadcast(plain)
    texts = F.col("text").cast("string")
    lettered = F.coalesce(texts.rlike(r"\p{L}"), F.lit(False))
    rows = docs.drop(lang, score).withColumn(lang, F.when(lettered, texts)).withColumn(score, F.lit(0.0))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value and Network(*shared.value)
        names = np.array([*own.languages, UNKNOWN], object) if own else None
        for batch in batches:
            column = batch.column(batch.num_columns - 2)
            if own is None:
                langs, scores = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            else:
                found = [pooled(own, *piece[2:]) for piece in slices(column)]
                means = np.concatenate(found) if found else np.zeros((0, len(own.languages)))
                known = column.is_valid().to_numpy(zero_copy_only=False)
                langs = names[np.where(known, means.argmax(1), len(own.languages))]
                scores = np.where(known, means.max(1), 0.0)
            new = [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *new], schema=batch.schema)

    return rows.mapInArrow(label, _nullable(rows))


def _nullable(rows: DataFrame):
    schema = rows.schema
    for field in schema.fields:
        field.nullable = True
    return schema


def accepted(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` whose text is in a language that was learned, with a score of ``least_score`` or more.

    Texts without letters go, and texts that the network takes for a mixture of languages.
    """
    network = train(docs, sample)
    lang, score = unused(docs, "__lang"), unused(docs, "__score")
    found = predict(docs, network, lang, score)
    least = least_score(len(network.languages) if network else 1, F.octet_length(F.col("text").cast("string")))
    return found.where((F.col(lang) != UNKNOWN) & (F.col(score) >= least)).drop(lang, score)


def least_score(languages: int, length):
    """The score below which ``accepted`` rejects a text of so many bytes, a number or a column.

    ``LEAST_SHARE`` of the way from an even guess to certainty, less for texts of fewer than ``ENOUGH`` bytes, whose
    scores say little: in proportion. With one language none is told apart.
    """
    if languages < 2:
        return length * 0.0
    part = F.least(F.lit(1.0), length / ENOUGH) if isinstance(length, Column) else min(1.0, length / ENOUGH)
    return 1 / languages + part * LEAST_SHARE * (1 - 1 / languages)


def report(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return predict(rows, train(docs, sample)).select("doc_id", "held_out", "lang_pred", "score")
