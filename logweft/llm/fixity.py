"""Fixity of WARC replicas by Merkle trees over records and ordered offset ranges.

A record's leaf is the SHA-256 of its bytes. The records whose offsets fall in one range
of a file form a node, whose hash covers the ordered (offset, leaf) pairs; sixteen ranges
form the next one, up to one root per file. Two replicas are compared at their roots, and
only children of nodes that differ are looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweft.llm.stage import written

#: Bytes of a file in a lowest range, and ranges in a node above it.
RANGE_BYTES, FAN, LEVELS = 1 << 16, 16, 4
#: Pages in one file of the archive that ``archive`` lays out.
PAGES_PER_FILE = 256
#: Where the parts of a digest begin that are summed up for records at one place: 64 digits in all.
_PARTS = (1, 14, 27, 40, 53)


def leaves(records: DataFrame) -> DataFrame:
    """(file, offset, length, leaf) of records with columns file, offset and payload.

    A null payload is a record of no bytes; a null file or offset is a place like any other
    (file "", offset -1). Records at the same place are hashed together in hash order.
    """
    payload = F.coalesce(F.col("payload").cast("binary"), F.lit("").cast("binary"))
    return records.select(
        F.coalesce(F.col("file").cast("string"), F.lit("")).alias("file"),
        F.coalesce(F.col("offset").cast("long"), F.lit(-1)).alias("offset"),
        F.octet_length(payload).cast("long").alias("length"),
        F.sha2(payload, 256).alias("leaf"),
    )


def _node(order: str, hash_: str) -> Column:
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(hash_).alias("h"))))
    text = F.transform(pairs, lambda x: F.concat_ws(":", x["o"].cast("string"), x["h"]))
    return F.sha2(F.array_join(text, ";").cast("binary"), 256)


def tree(rows: DataFrame) -> list[DataFrame]:
    """Tables (file, place, hash) from the lowest ranges up to one root per file, each written.

    After ``LEVELS`` steps a place covers 4 GiB; the root covers all places of a file.
    """
    nodes = rows.groupBy("file", F.floor(F.col("offset") / RANGE_BYTES).alias("place"))
    out = [written(nodes.agg(_node("offset", "leaf").alias("hash")))]
    for _ in range(LEVELS):
        nodes = out[-1].groupBy("file", F.floor(F.col("place") / FAN).alias("up")).agg(_node("place", "hash").alias("hash"))
        out.append(written(nodes.withColumnRenamed("up", "place")))
    return [*out, written(out[-1].groupBy("file").agg(_node("place", "hash").alias("hash")))]


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """Records that differ between two replicas, and the roots of their files.

    Columns: file, offset, left_length, right_length, left_leaf, right_leaf, left_root,
    right_root, state. ``state`` is ``changed``, or the replica that lacks the record, ``left``
    or ``right``. Equal replicas, and two empty ones, give no rows. Further columns of the
    records are not looked at. Several records at one place count as one, whose leaf depends on
    all of them but not on their order.
    """
    sides = {"left": written(_merged(leaves(left))), "right": written(_merged(leaves(right)))}
    trees = {name: tree(side) for name, side in sides.items()}
    roots = written(_differing(trees["left"][-1], trees["right"][-1], ["file"]))
    wrong, parents = roots, ["file"]
    for depth in range(LEVELS, -1, -1):
        below = []
        for name in sides:
            nodes = trees[name][depth]
            if depth < LEVELS:
                nodes = nodes.withColumn("up", F.floor(F.col("place") / FAN))
            below.append(nodes.join(wrong.select(*parents), parents, "left_semi").select("file", "place", "hash"))
        differing = written(_differing(*below, ["file", "place"]))
        wrong, parents = differing.select("file", F.col("place").alias("up")), ["file", "up"]
    found = []
    for name, side in sides.items():
        rows = side.withColumn("place", F.floor(F.col("offset") / RANGE_BYTES))
        rows = rows.join(differing.select("file", "place"), ["file", "place"], "left_semi")
        found.append(rows.select("file", "offset", F.col("length").alias(f"{name}_length"), F.col("leaf").alias(f"{name}_leaf")))
    state = (
        F.when(F.col("left_leaf").isNull(), F.lit("left"))
        .when(F.col("right_leaf").isNull(), F.lit("right"))
        .otherwise(F.lit("changed"))
    )
    rows = found[0].join(found[1], ["file", "offset"], "full").where(~F.col("left_leaf").eqNullSafe(F.col("right_leaf")))
    roots = roots.select("file", F.col("left").alias("left_root"), F.col("right").alias("right_root"))
    return rows.withColumn("state", state).join(roots, "file")


def _differing(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    both = left.withColumnRenamed("hash", "left").join(right.withColumnRenamed("hash", "right"), keys, "full")
    return both.where(~F.col("left").eqNullSafe(F.col("right")))


def _merged(rows: DataFrame) -> DataFrame:
    """One row per place. Several records at a place are summed up in parts, so that any number can meet there."""
    parts = [F.sum(F.conv(F.substring("leaf", at, 13), 16, 10).cast("decimal(20,0)")).alias(f"p{at}") for at in _PARTS]
    merged = rows.groupBy("file", "offset").agg(
        F.sum("length").alias("length"), F.count(F.lit(1)).alias("n"), F.min("leaf").alias("leaf"), *parts
    )
    joined = F.sha2(F.concat_ws(";", "n", *[f"p{at}" for at in _PARTS]).cast("binary"), 256)
    return merged.select("file", "offset", "length", F.when(F.col("n") == 1, F.col("leaf")).otherwise(joined).alias("leaf"))


def archive(pages: DataFrame) -> DataFrame:
    """Pages as WARC response records with the columns page_id, file, offset and payload.

    A file holds the pages whose ids have the same quotient by 256, in order of id, url and html;
    offsets count bytes. A null url or html is empty; null ids share the file ``null.warc``.
    """
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), url,
        F.lit("\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"),
    )
    file = F.coalesce(F.concat(F.floor(F.col("page_id") / PAGES_PER_FILE).cast("string"), F.lit(".warc")), F.lit("null.warc"))
    rows = pages.select("page_id", file.alias("file"), F.concat(head, html, F.lit("\r\n\r\n")).alias("payload"))
    order = Window.partitionBy("file").orderBy("page_id", "payload").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.octet_length("payload").cast("long")).over(order), F.lit(0))
    return rows.withColumn("offset", offset).select("page_id", "file", "offset", "payload")


def damaged(records: DataFrame) -> DataFrame:
    """A replica of ``archive`` in which some records are cut short, changed or lost, by md5 of the page id."""
    key = F.substring(F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit("")).cast("binary")), 1, 2)
    cut = F.expr("substring(payload, 1, length(payload) - 1)")
    payload = F.when(key == "00", cut).when(key == "01", F.concat(F.col("payload"), F.lit("#"))).otherwise(F.col("payload"))
    return records.where(key != "02").withColumn("payload", payload)
