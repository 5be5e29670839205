"""Token counts by section: a document is encoded once, its tokens go to the sections they touch.

Byte-level tokens are slices of the text, so running sums of their lengths are their
spans. A token belongs to the section in which it starts; a token that runs over the
section's end is counted there as crossing. Text outside all sections is reported too.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweft.llm.words import flat

#: Fixed value: how the vocabulary's byte pairs were cut before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: What ``\s`` of the pattern means, in runs of more characters than the encoder's stack should see.
_LONG_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_RESULT = "n_chars long, n_tokens long, outside long, sections array<struct<name:string,start:int,end:int,tokens:int,crossing:int>>"


@lru_cache(maxsize=2)
def encoder(ranks: bytes) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoder and the bytes of each token, from the contents of a vocabulary file."""
    pairs = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
    lengths = np.zeros(max(pairs.values()) + 1, np.int64)
    for token, rank in pairs.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=pairs, special_tokens={}), lengths


def token_ends(text: str, coding: tuple[tiktoken.Encoding, np.ndarray]) -> np.ndarray:
    """The byte offsets at which the tokens of a text end.

    The pattern makes one piece of a run of white space: all of it at the end of the text, else
    all but its last character, which may belong to what follows. Long runs are cut out as such
    pieces here, since the pattern's look ahead takes stack for every character of a run.
    """
    own, lengths = coding
    tokens, at = [], 0
    for run in _LONG_RUN.finditer(text):
        end = run.end() - (run.end() < len(text))
        tokens += own.encode_ordinary(text[at : run.start()])
        tokens += own._encode_single_piece(text[run.start() : end])
        at = end
    tokens += own.encode_ordinary(text[at:])
    return np.cumsum(lengths[np.array(tokens, np.int64)])


def allocate(ends: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Interval join of tokens with sections, all in bytes: tokens of each section, whether its
    last one runs over the end, and the tokens that start in no section."""
    begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    low, high = np.searchsorted(begins, starts), np.searchsorted(begins, stops)
    tokens = np.maximum(high - low, 0)
    over = np.zeros(len(starts), bool)
    some = tokens > 0
    over[some] = ends[high[some] - 1] > stops[some]
    depth = np.zeros(len(ends) + 1, np.int64)
    np.add.at(depth, low[some], 1)
    np.add.at(depth, high[some], -1)
    return tokens, over, int((np.cumsum(depth[:-1]) == 0).sum())


def attribute(docs: DataFrame, fields: tuple[str, ...] = ("source", "lang"), vocabulary: str = VOCABULARY) -> DataFrame:
    """Tokens of each document by field and line.

    A document is encoded as one record: the fields and the text, one line each, null as
    empty, line ends in fields as blanks. Sections are the fields and every line of the text, without the line ends, so the
    tokens between sections count as ``outside`` if they start there. Returns doc_id, n_chars and
    n_tokens of the record, outside, and the sections in order: name, start and end (code points of the
    record), tokens, crossing. An empty line is a section of no tokens. Extra columns are dropped;
    repeated rows are counted alike; an empty table gives no rows. Runs of one kind of character may be
    of any length.
    """
    with open(vocabulary, "rb") as file:
        ranks = docs.sparkSession.sparkContext.broadcast(file.read())
    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = [F.translate(F.coalesce(F.col(name).cast("string"), F.lit("")), "\n", " ") for name in fields]
    rows = docs.select("doc_id", F.concat_ws("\n", *columns, F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coding = encoder(ranks.value)
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                yield _counted(part, coding, fields)

    return rows.mapInArrow(count, f"doc_id {kind}, {_RESULT}")


def _counted(batch: pa.RecordBatch, coding, fields: tuple[str, ...]) -> pa.RecordBatch:
    data, offsets = flat(batch.column(1))
    raw = data.tobytes()
    totals, parts = [], []
    for low, high in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        text, own = raw[low:high], data[low:high]
        ends = token_ends(text.decode(), coding)
        cuts = np.flatnonzero(own == 10)
        starts, stops = np.concatenate([[0], cuts + 1]), np.concatenate([cuts, [len(text)]])
        tokens, over, outside = allocate(ends, starts, stops)
        points = np.zeros(len(text) + 1, np.int64)
        np.cumsum((own & 0xC0) != 0x80, out=points[1:])
        totals.append((points[-1], len(ends), outside))
        parts.append((points[starts], points[stops], tokens, over))
    counts = np.array([len(p[0]) for p in parts])
    columns = [np.concatenate([p[i] for p in parts]).astype(np.int32) for i in range(4)]
    names = np.full(int(counts.sum()), len(fields), np.int32)
    starts = np.cumsum(counts) - counts
    for i in range(len(fields)):
        names[starts + i] = i
    names = pa.DictionaryArray.from_arrays(pa.array(names), pa.array([*fields, "text"])).cast(pa.string())
    struct = pa.StructArray.from_arrays([names, *map(pa.array, columns)], ["name", "start", "end", "tokens", "crossing"])
    bounds = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    long = [pa.array([t[i] for t in totals], pa.int64()) for i in range(3)]
    sections = pa.ListArray.from_arrays(bounds, struct)
    names = ["doc_id", "n_chars", "n_tokens", "outside", "sections"]
    return pa.RecordBatch.from_arrays([batch.column(0), *long, sections], names=names)
