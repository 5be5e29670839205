"""Mixing sources to target weights along a curriculum that changes over time.

Each source has a schedule: its weight as a piecewise linear function of training time
0 to 1. The integral of the schedule is the source's weight in the whole mix. A source
hands out its documents in a fixed random order, again from the start when all are used,
and a document's place in training is the time at which the source's cumulative demand
reaches it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweft.llm.stage import unused, written

Knots = Sequence[tuple[float, float]]

#: Schedules of the sources in code point order, repeating: integrals 5, 2 and 1.
SCHEDULES: tuple[Knots, ...] = (
    ((0.0, 6.0), (1.0, 4.0)),
    ((0.0, 2.0), (1.0, 2.0)),
    ((0.0, 0.5), (1.0, 1.5)),
)
#: Words of the mix for each word of the corpus, and times a document is used at most.
SHARE, REPEATS = 1.5, 2

_WORD = r"[^\x20\x09-\x0D]+"


def _pieces(knots: Knots) -> list[tuple[float, float, float, float, float]]:
    """Start, length, weight at the start, slope and integral before each piece."""
    out, done = [], 0.0
    for (t, w), (end, last) in zip(knots, knots[1:], strict=False):
        out.append((t, end - t, w, (last - w) / (end - t), done))
        done += (w + last) / 2 * (end - t)
    return out


def integral(knots: Knots) -> float:
    return sum((a + b) / 2 * (t - s) for (s, a), (t, b) in zip(knots, knots[1:], strict=False))


def time_of(demand: Column, knots: Knots) -> Column:
    """Time at which the share ``demand`` (0 to 1) of a schedule's integral is reached."""
    goal = demand * F.lit(integral(knots))
    out: Column = F.lit(None).cast("double")
    for start, _, weight, slope, before in _pieces(knots):
        left = goal - F.lit(before)
        if slope:
            own = (F.sqrt(F.greatest(F.lit(weight * weight) + F.lit(2.0 * slope) * left, F.lit(0.0))) - weight) / slope
        else:
            own = left / weight if weight else F.lit(0.0)
        out = F.when(goal >= before, F.lit(start) + own).otherwise(out)
    return F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0))


def targets(sizes: DataFrame, schedules: Sequence[Knots] = SCHEDULES, share: float = SHARE,
            repeats: int = REPEATS) -> DataFrame:
    """Of (source, size): (source, source_size, kind, target), one row per source.

    The words of the mix go to the sources by weight; no target is over ``repeats`` times its
    source, and what is over goes to the others. With the sources in order of size by weight,
    those before some place are full and the rest share by weight: the level is the largest
    that any place gives. The window sees one row per source.
    """
    kinds = len(schedules)
    weight = F.element_at(F.array(*[F.lit(integral(k)) for k in schedules]), F.col("kind") + 1)
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rows = rows.withColumn("kind", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % kinds)
    rows = rows.withColumn("weight", weight).withColumn("most", F.col("source_size") * repeats)
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(every) * F.lit(share) - before) / rest
    rows = rows.withColumn("level", level).withColumn("level", F.max("level").over(every))
    target = F.least(F.col("most").cast("double"), F.col("weight") * F.col("level"))
    return rows.select("source", "source_size", "kind", target.alias("target"))


def mix(docs: DataFrame, schedules: Sequence[Knots] = SCHEDULES, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """One row per document: doc_id, digest, size, source_size, target, taken, position, again.

    ``size`` counts words (null or empty text: 0), ``taken`` those the mix takes: whole documents
    in md5 order of doc_id, then from the start again, up to ``repeats`` times, until the whole
    words of the target are reached; the document at that point is taken in part. ``position`` is the time at the middle of the
    first use, ``again`` that of the second; null where there is none. A null source is a source
    of its own, the last; a null doc_id counts as the empty text in the order. Repeated rows and
    equal doc_ids are ordered by size and text, so a rerun agrees. An empty table gives no rows.
    """
    texts = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = written(docs.select(
        F.col("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.regexp_count(texts, F.lit(_WORD)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("place"),
        F.md5(texts.cast("binary")).alias("digest"),
    ))
    goals = written(targets(narrow, schedules, share, repeats))
    # Running sums within a source: 4,096 buckets of the order first, then within each.
    bucket = F.substring("place", 1, 3)
    kept = narrow.withColumn("bucket", bucket).withColumn("known", F.col("source").isNotNull())
    kept = kept.withColumn("source", F.coalesce("source", F.lit("")))
    keys = ["known", "source", "bucket"]
    sums = kept.groupBy(*keys).agg(F.sum("size").alias("bucket_size"))
    earlier = Window.partitionBy("known", "source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("earlier", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0))).drop("bucket_size")
    goals = goals.withColumn("known", F.col("source").isNotNull()).withColumn("source", F.coalesce("source", F.lit("")))
    sums = sums.join(goals, ["known", "source"])
    own = Window.partitionBy(*keys).orderBy("place", "doc_id", "size", "digest").rowsBetween(Window.unboundedPreceding, -1)
    kept = kept.withColumn("own", F.coalesce(F.sum("size").over(own), F.lit(0))).join(sums, keys)
    start = F.col("earlier") + F.col("own")
    goal = F.floor("target")
    kept = kept.withColumn("start", start)
    used = [
        F.least(F.greatest(goal - F.col("source_size") * i - F.col("start"), F.lit(0)), F.col("size")) for i in range(repeats)
    ]
    kept = kept.withColumns({f"use_{i}": u for i, u in enumerate(used)})

    def position(i: int) -> Column:
        middle = F.col("source_size") * i + F.col("start") + F.col(f"use_{i}") / 2
        demand = middle / goal
        when = F.lit(None).cast("double")
        for kind, knots in enumerate(schedules):
            when = F.when(F.col("kind") == kind, time_of(demand, knots)).otherwise(when)
        return F.when(F.col(f"use_{i}") > 0, F.round(when, 9))

    return kept.select(
        "doc_id", "digest", F.when(F.col("known"), F.col("source")).alias("source"), "size", "source_size", "target",
        sum((F.col(f"use_{i}") for i in range(1, repeats)), F.col("use_0")).alias("taken"),
        position(0).alias("position"),
        (position(1) if repeats > 1 else F.lit(None).cast("double")).alias("again"),
    )


def curriculum(docs: DataFrame) -> DataFrame:
    """The mix's report in training order: documents that are not taken come last."""
    rows = mix(docs).drop("digest", "source")
    return rows.orderBy(F.col("position").asc_nulls_last(), "doc_id", "size")


def _row_key(digest: str) -> Column:
    parts = [F.col(c).isNull().cast("string") for c in ("doc_id", "source")]
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "source", digest)]
    return F.md5(F.concat_ws("|", *parts, *texts).cast("binary"))


def mixed(docs: DataFrame) -> DataFrame:
    """The documents that the mix takes, range-sorted by the time of their first use.

    Adds ``taken``, ``position`` and ``again`` to the columns of ``docs``, replacing such columns.
    Repeated rows are taken one by one, in the order of a hash of their columns.
    """
    added = ["taken", "position", "again"]
    rows = docs.drop(*added)
    digest = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    order = F.xxhash64(*[F.col(f"`{c}`") for c, kind in rows.dtypes if "map" not in kind])
    first, text, key, n = (unused(docs, name) for name in ("__order", "__digest", "__key", "__n"))
    rows = rows.withColumn(first, order).withColumn(text, digest).withColumn(key, _row_key(text))
    number = Window.partitionBy(key)
    places = mix(docs).withColumnRenamed("digest", text).withColumn(key, _row_key(text))
    places = places.withColumn(n, F.row_number().over(number.orderBy(F.col("position").asc_nulls_last(), "taken")))
    places = places.where("taken > 0").select(key, n, *added)
    rows = rows.withColumn(n, F.row_number().over(number.orderBy(first)))
    kept = rows.join(places, [key, n])
    return kept.select(*[c for c in docs.columns if c not in added], *added).orderBy("position", "doc_id")
