"""Document fingerprints: threshold-scaled sketches of word shingles, in DataFrame functions only.

A sketch keeps every shingle hash below a fixed fraction of the hash range. So the sketch
of two documents together is the union of theirs, and containment can be estimated
between a page and a book. A text of few shingles keeps all of them; a sketch with a hash
beyond the limit is a whole one. Two whole sketches are compared by all hashes, others by
those below the limit, so the likeness of two texts follows from their sketches alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHINGLE = 5
#: One hash in so many is kept, and all of a text of so few distinct shingles.
SCALE, FEW = 2, 64
#: Documents in one bucket of the order by id, and buckets at most (beyond it they grow).
BUCKET_ROWS, MOST_BUCKETS = 1024, 16_384


def sketch(text: Column, scale: int = SCALE, size: int = SHINGLE) -> Column:
    """Sorted distinct hashes (array<bigint>) of a text's shingles: those below ``2^64 / scale``, or all if they are few.

    Words are cut at white space; a text of fewer than five words has one shingle, a null or blank one
    none. Hashes count upwards from the least bigint.
    """
    return F.when(text.isNull(), F.array().cast("array<bigint>")).otherwise(_let(_hashes(text, size), lambda all_: _cut(all_, scale)))


def _limit(scale: int) -> Column:
    return F.lit(-(1 << 63) + (1 << 64) // scale)


def _hashes(text: Column, size: int = SHINGLE) -> Column:
    """Hashes of all shingles of a text, equal ones as often as they occur."""
    words = F.transform(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), ""), lambda w: F.xxhash64(w))

    def shingled(w: Column) -> Column:
        many = F.greatest(F.size(w) - (size - 1), F.least(F.size(w), F.lit(1)))
        return F.transform(F.slice(w, 1, many), lambda _, i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))

    # Each step takes the one before as the single element of an array, so that it is computed once.
    return _let(words, shingled)


def _cut(all_: Column, scale: int) -> Column:
    return F.array_sort(_let(F.array_distinct(all_), lambda own: F.when(F.size(own) <= FEW, own).otherwise(_below(own, scale))))


def _below(own: Column, scale: int) -> Column:
    return F.filter(own, lambda h: h < _limit(scale))


def _whole(own: Column, scale: int) -> Column:
    return F.exists(own, lambda h: h >= _limit(scale))


def _let(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def merged(left: Column, right: Column, scale: int = SCALE) -> Column:
    """Sketch of the two documents' shingles together: whole if both are, else cut at the limit."""
    both = F.array_sort(F.array_union(left, right))
    return F.when(_whole(left, scale) & _whole(right, scale), both).otherwise(_below(both, scale))


def containment(own: Column, other: Column, scale: int = SCALE) -> Column:
    """Share of one document's shingles that the other has: 1 for two empty sketches, 0 for one.

    Exact for two whole sketches, else estimated below the limit. With n shingles the estimate's
    deviation is about ``sqrt(p (1 - p) (scale - 1) / n)``. A whole sketch without a hash below
    the limit shares nothing with a cut one that could be seen: 0.
    """

    def share(mine: Column) -> Column:
        return F.when(F.size(mine) > 0, F.size(F.array_intersect(mine, other)) / F.size(mine)).otherwise(((F.size(own) == 0) & (F.size(other) == 0)).cast("double"))

    exact = _whole(own, scale) & _whole(other, scale)
    return _let(F.when(exact, own).otherwise(_below(own, scale)), share)


def as_text(own: Column) -> Column:
    """A sketch as hexadecimal numbers joined by commas."""
    return F.array_join(F.transform(own, lambda h: F.lower(F.hex(h))), ",")


def bucketed(docs: DataFrame) -> DataFrame:
    """``docs`` in buckets of the order by falling doc_id, each followed by the head of the next.

    Adds ``bucket`` and ``ghost``. Bucket limits are ids of the table itself, so the documents
    with such an id go to their own bucket and, as ghosts, to the end of the one before; the
    largest id follows the last bucket. Null ids come last.
    """
    stats = docs.agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top")).first()
    buckets = min(MOST_BUCKETS, stats["n"] // BUCKET_ROWS + 1)
    bounds = [] if stats["top"] is None else [stats["top"]]
    if buckets > 1 and bounds:
        # Spelled as one literal: the shares must be constant, and an expression for each is slow if they are many.
        shares = F.split(F.lit(",".join(str(i / buckets) for i in range(1, buckets))), ",").cast("array<double>")
        inner = docs.agg(F.percentile_approx("doc_id", shares, 10 * buckets)).first()[0]
        bounds += sorted(set(inner) - set(bounds), reverse=True)
    if not bounds:
        flags = F.lit(0).alias("bucket"), F.lit(False).alias("ghost")
        return docs.select("*", *flags)
    # Two steps of lookup: blocks of limits first, then the limits of the block.
    width = max(1, int(len(bounds) ** 0.5))
    blocks = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    spelled = F.from_json(F.lit(str(blocks)), "array<array<bigint>>")
    id_ = F.col("doc_id").cast("long")
    block = F.greatest(F.size(F.filter(spelled, lambda b: F.get(b, F.lit(0)) >= id_)), F.lit(1)) - 1
    inside = F.size(F.filter(F.get(spelled, block), lambda b: b >= id_)) - 1
    bucket = F.when(id_.isNull(), F.lit(len(bounds) - 1)).otherwise(block * width + inside)
    head = F.array_contains(F.get(spelled, block), id_)
    before = F.pmod(F.col("bucket") + len(bounds) - 1, F.lit(len(bounds)))
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("ghost"))
    copy = F.struct(before.alias("bucket"), F.lit(True).alias("ghost"))
    rows = docs.withColumn("head", F.coalesce(head, F.lit(False))).withColumn("bucket", bucket)
    rows = rows.withColumn("at", F.explode(F.when(F.col("head"), F.array(own, copy)).otherwise(F.array(own))))
    return rows.drop("head", "bucket").select("*", "at.bucket", "at.ghost").drop("at")


def compare(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """Fingerprints of each document and of its edited text, and their likeness.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many, or
    all, of the next document by falling doc_id; the first follows the last. Null texts are
    empty. Documents with equal ids follow each other in the order of their texts, null ids come
    last; a single document follows itself. ``near_edited`` and ``near_next`` are the containment
    of the document's sketch in that of the other text, and follow from the two sketches alone. Returns
    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next; other
    columns are dropped, an empty table gives no rows.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = bucketed(rows).repartition("bucket")
    rows = rows.withColumn("own", sketch(F.col("text"), scale))
    order = Window.partitionBy("bucket").orderBy("ghost", F.col("doc_id").desc_nulls_last(), "text")
    following = F.lead(F.struct("text", "own")).over(order)
    first = F.first(F.struct("text", "own")).over(order)  # without any id there is one bucket and no ghost
    rows = rows.withColumn("following", F.coalesce(following, first)).where(~F.col("ghost"))
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    kept = F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int"))
    rows = rows.withColumn("edited", F.concat(kept, F.substring("following.text", F.lit(1), half)))
    rows = rows.withColumn("edited_own", sketch(F.col("edited"), scale))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("edited_own")).alias("edited_fingerprint"),
        containment(F.col("own"), F.col("edited_own"), scale).alias("near_edited"),
        containment(F.col("own"), F.col("following.own"), scale).alias("near_next"),
    )
