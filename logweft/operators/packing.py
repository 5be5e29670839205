"""Report rows into parts by size: a row opens a new part when it would not fit.

Where a part starts depends on every row before it, so the rule is sequential.
It is computed without a sequential pass over the rows. Rows are cut into chunks
of bounded length. For one chunk, how full the current part is on entry decides
where the first cut falls, and from there on the chunk alone decides the rest:
a chunk is a step function from the state on entry to the state on exit. The
functions are computed in parallel, written once, and composed in a tree, as many
neighbours at a time as their measured steps allow. A composed function has no more
steps than rows fit in one part, since the first cut comes before more. From the root
the entry states go down again, and the rows of each chunk are packed in parallel from
theirs. The tree is one plan, whatever its height: a level is a shuffle of small tables.

State: ``used`` bytes (header and rows so far) and ``rows`` in the current part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweft.operators.numbering import running_before
from logweft.staging import Staging

CHUNK_ROWS = 1 << 21
#: Neighbours composed in one task, and their steps together.
FAN_IN, TASK_STEPS = 256, 1 << 22
#: Rows of small chunks that are handed to Python in one piece.
BATCH_ROWS = 1 << 14
_STEPS = ["skip_rows", "skip_bytes", "exit_used", "exit_rows", "cuts"]
_STEP_SCHEMA = "unit string, node long, step int, opening long, " + ", ".join(f"{c} long" for c in _STEPS)
_ENTRY_SCHEMA = "unit string, node long, used long, rows long, part_no long"
_PACKED_SCHEMA = "unit string, pos long, part_no long, idx long"


def _digits(count: np.ndarray) -> np.ndarray:
    """Digits needed to write 1, 2, ..., count."""
    total = np.zeros_like(count)
    power = 1
    while power <= count.max(initial=0):
        total += np.maximum(count - power + 1, 0)
        power *= 10
    return total


class _Packer:
    """The packing rule over the rows of one chunk.

    ``opening`` is the size of a part without rows (less what only later rows
    carry); ``numbered`` adds the digits of each row's index in its part.
    """

    def __init__(self, sizes: np.ndarray, opening: int, limit: int, numbered: bool):
        self.n = len(sizes)
        self.before = np.concatenate([[0], np.cumsum(sizes)])
        self.opening, self.limit, self.numbered = opening, limit, numbered

    def overflows(self, used, rows, upto):
        """Whether a part with this state is too large once it holds rows up to ``upto``."""
        total = used + self.before[upto]
        if self.numbered:
            total = total + _digits(rows + upto)
        return total > self.limit

    def first_cut(self, used: np.ndarray, rows: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The first row, from ``low`` on, that does not fit; ``n`` if all do."""
        low = np.minimum(low, self.n)
        high = np.full_like(low, self.n)
        while (low < high).any():
            middle = (low + high) // 2
            over = self.overflows(used, rows, np.minimum(middle + 1, self.n))
            open_ = low < high
            high = np.where(open_ & over, middle, high)
            low = np.where(open_ & ~over, middle + 1, low)
        return low

    def next_part(self, start: np.ndarray) -> np.ndarray:
        return self.first_cut(self.opening - self.before[start], -start, start + 1)

    def steps(self) -> pd.DataFrame:
        """The chunk as a step function: which first cut leads to which exit."""
        fresh = np.array([self.opening])
        last = int(self.first_cut(fresh, np.array([0]), np.array([1]))[0])
        cut = np.arange(min(last, self.n - 1) + 1)
        # Where the part that starts at a row is followed by another, jump there, then twice as far.
        row = np.arange(self.n)
        following = self.next_part(row)
        inside = following < self.n
        start, cuts = np.where(inside, following, row), inside.astype(np.int64)
        while (start[start] != start).any():
            cuts = cuts + cuts[start]
            start = start[start]
        table = pd.DataFrame(
            {
                "skip_rows": cut,
                "skip_bytes": self.before[cut],
                "exit_used": self.opening + self.before[self.n] - self.before[start[cut]],
                "exit_rows": self.n - start[cut],
                "cuts": cuts[cut] + 1,
            }
        )
        whole = pd.DataFrame([[self.n, self.before[self.n], -1, -1, 0]], columns=_STEPS)
        return _shortened(pd.concat([table, whole], ignore_index=True), self.opening, self.limit, self.numbered)

    def pack(self, used: int, rows: int, part_no: int) -> tuple[np.ndarray, np.ndarray]:
        """Part number and index in the part of every row, from the entry state."""
        start = 0 if rows == 0 else int(self.first_cut(np.array([used]), np.array([rows]), np.array([0]))[0])
        starts, following = [], self.next_part(np.arange(self.n)).tolist()
        while start < self.n:
            starts.append(start)
            start = following[start]
        starts = np.array(starts, dtype=np.int64)
        row = np.arange(self.n)
        nth = np.searchsorted(starts, row, side="right")
        own_start = np.where(nth > 0, starts[np.maximum(nth - 1, 0)] if len(starts) else 0, -rows)
        return part_no + nth, row - own_start + 1


def _shortened(table: pd.DataFrame, opening: int, limit: int, numbered: bool) -> pd.DataFrame:
    """Without steps that no state reaches, and without those that lead to the exit of the one before."""
    filled = opening + table["skip_bytes"].to_numpy()
    if numbered:
        filled = filled + _digits(table["skip_rows"].to_numpy())
    table = table[(filled <= limit) | (table["skip_rows"] == 0)]
    exits = table[["exit_used", "exit_rows", "cuts"]].to_numpy()
    changed = np.ones(len(table), dtype=bool)
    changed[1:] = (exits[1:] != exits[:-1]).any(axis=1)
    return table[changed].reset_index(drop=True)


class _Steps:
    """A step function over states (arrays of ``used`` and ``rows``)."""

    def __init__(self, table: pd.DataFrame, limit: int, numbered: bool):
        self.columns = [table[name].to_numpy() for name in _STEPS]
        self.limit, self.numbered = limit, numbered

    def apply(self, used: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Exit states, and how many parts begin."""
        skip_rows, skip_bytes, exit_used, exit_rows, cuts = self.columns
        # The last step whose rows before it still fit; the first needs none.
        low, high = np.zeros(len(used), np.int64), np.full(len(used), len(cuts) - 1)
        while (low < high).any():
            middle = (low + high + 1) // 2
            filled = used + skip_bytes[middle]
            if self.numbered:
                filled = filled + _digits(rows + skip_rows[middle])
            fits = (filled <= self.limit) & (rows > 0)
            low, high = np.where(fits, middle, low), np.where(fits, high, middle - 1)
        whole = cuts[low] == 0
        used = np.where(whole, used + skip_bytes[low], exit_used[low])
        return used, np.where(whole, rows + skip_rows[low], exit_rows[low]), cuts[low]


def _composed(first: pd.DataFrame, second: pd.DataFrame, opening: int, limit: int, numbered: bool) -> pd.DataFrame:
    """The step function of two neighbours; ``second`` must follow a chunk with rows."""
    cut = first[first["cuts"] > 0].copy()
    used, rows, cuts = _Steps(second, limit, numbered).apply(cut["exit_used"].to_numpy(), cut["exit_rows"].to_numpy())
    cut["exit_used"], cut["exit_rows"], cut["cuts"] = used, rows, cut["cuts"].to_numpy() + cuts
    whole = first[first["cuts"] == 0]
    if len(whole):  # no cut in the first: the cuts of the second come after all its rows
        shifted = second.copy()
        shifted["skip_rows"] += int(whole["skip_rows"].iloc[0])
        shifted["skip_bytes"] += int(whole["skip_bytes"].iloc[0])
        cut = pd.concat([cut, shifted], ignore_index=True)
    return _shortened(cut, opening, limit, numbered)


def _tables(steps: pd.DataFrame) -> list[tuple[int, pd.DataFrame]]:
    """The step functions of neighbours in order."""
    ordered = steps.sort_values(["node", "step"])
    return [(int(node), table[_STEPS]) for node, table in ordered.groupby("node", sort=True)]


def _joined(steps: pd.DataFrame, limit: int, numbered: bool, fan_in: int) -> pd.DataFrame:
    """The step functions of up to ``fan_in`` neighbours as one."""
    opening = int(steps["opening"].iloc[0])
    (first, table), *more = _tables(steps)
    for _, following in more:
        table = _composed(table, following, opening, limit, numbered)
    return table.assign(
        unit=steps["unit"].iloc[0], node=first // fan_in, step=np.arange(len(table)), opening=opening
    )


def _walked(steps: pd.DataFrame, limit: int, numbered: bool) -> pd.DataFrame:
    """The entry states of neighbours, from the state on entry to the first of them."""
    used, rows, part_no = (int(steps[name].iloc[0]) for name in ("used", "rows", "part_no"))
    entries = []
    for node, table in _tables(steps):
        entries.append((node, used, rows, part_no))
        after = _Steps(table, limit, numbered).apply(np.array([used]), np.array([rows]))
        used, rows, part_no = int(after[0][0]), int(after[1][0]), part_no + int(after[2][0])
    return pd.DataFrame(entries, columns=["node", "used", "rows", "part_no"]).assign(unit=steps["unit"].iloc[0])


def _all_fit(sizes: DataFrame, limit: int, separator: int, numbered: bool) -> bool:
    """Whether no output needs a second part, indexes counted at their full width."""
    n = F.count("*")
    index = F.length(n.cast("string")) if numbered else F.lit(0)
    used = F.max("opening") + F.sum("size") + n * (index + separator)
    return sizes.groupBy("unit").agg(used.alias("used")).where(F.col("used") > limit).isEmpty()


def pack_parts(
    staging: Staging,
    sizes: DataFrame,
    limit: int,
    separator: int = 0,
    numbered: bool = False,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Part number and index in the part for every report row.

    ``sizes``: ``unit, pos, size, opening``; ``pos`` holds the writing task in its
    high bits (``monotonically_increasing_id`` of a sorted table), ``opening`` is
    the size of the unit's file header. ``separator`` bytes precede every row but
    the first of a part.
    """
    ranked = running_before(
        sizes.withColumn("task", F.shiftright("pos", 33)), ["unit"], "task", ["pos"], F.lit(1), "rank"
    )
    if _all_fit(sizes, limit, separator, numbered):
        return ranked.select(
            "unit", "pos", F.lit(1).cast("bigint").alias("part_no"), (F.col("rank") + 1).alias("idx")
        )
    ranked = ranked.select(
        "unit",
        "pos",
        (F.col("size") + separator).alias("size"),
        (F.col("opening") - separator).alias("opening"),
        F.floor(F.col("rank") / chunk_rows).alias("node"),
    )
    ranked = staging.write(ranked, "ranked")

    def packer(rows: pd.DataFrame) -> _Packer:
        return _Packer(rows["size"].to_numpy(), int(rows["opening"].iloc[0]), limit, numbered)

    def chunks_of(rows: pd.DataFrame) -> list[pd.DataFrame]:
        return [chunk for _, chunk in rows.sort_values("pos").groupby("node", sort=True)]

    def steps_of(rows: pd.DataFrame) -> pd.DataFrame:
        tables = []
        for chunk in chunks_of(rows):
            table = packer(chunk).steps()
            tables.append(table.assign(node=chunk["node"].iloc[0], step=np.arange(len(table))))
        return pd.concat(tables).assign(unit=rows["unit"].iloc[0], opening=rows["opening"].iloc[0])

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        tables = []
        for chunk in chunks_of(rows):
            entry = chunk.iloc[0]
            part_no, idx = packer(chunk).pack(int(entry["used"]), int(entry["rows"]), int(entry["part_no"]))
            tables.append(pd.DataFrame({"unit": chunk["unit"], "pos": chunk["pos"], "part_no": part_no, "idx": idx}))
        return pd.concat(tables)

    batch = F.floor(F.col("node") / max(1, BATCH_ROWS // chunk_rows)).alias("batch")
    steps = staging.write(ranked.groupBy("unit", batch).applyInPandas(steps_of, _STEP_SCHEMA), "steps")
    last, n_steps = steps.agg(F.max("node"), F.count("*")).first()
    fan_in = max(2, min(FAN_IN, TASK_STEPS * (last + 1) // n_steps))
    parent = F.floor(F.col("node") / fan_in).alias("parent")
    levels = [steps]
    while last >= fan_in:
        last //= fan_in
        levels.append(
            levels[-1].groupBy("unit", parent).applyInPandas(
                lambda steps: _joined(steps, limit, numbered, fan_in), _STEP_SCHEMA
            )
        )
    roots = ranked.groupBy("unit").agg(F.min("opening").alias("used"))
    entries = roots.select("unit", F.lit(0).cast("bigint").alias("parent"), "used", F.lit(0).cast("bigint").alias("rows"),
                           F.lit(0).cast("bigint").alias("part_no"))
    for steps in reversed(levels):
        known = steps.withColumn("parent", parent).join(entries, ["unit", "parent"])
        entries = known.groupBy("unit", "parent").applyInPandas(lambda rows: _walked(rows, limit, numbered), _ENTRY_SCHEMA)
        entries = entries.withColumnRenamed("node", "parent")
    entries = entries.withColumnRenamed("parent", "node")
    return (
        ranked.join(entries, ["unit", "node"])
        .groupBy("unit", batch)
        .applyInPandas(pack, _PACKED_SCHEMA)
    )
