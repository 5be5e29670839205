"""Log lines derived from the given tables, the input of most queries.

Every event is one log record; it carries the whole document of the same number at its
end, if there is one. Some records get a damaged date, another timestamp form, a
lower-case level, an empty message, a trace or a body, and the first record of
each file has no header.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweft.operators.numbering import running_before
from logweft.staging import Staging

EVENTS_PER_BUCKET = 16_384
_staged: dict[tuple[str, str, str], object] = {}


def staging(spark: SparkSession) -> Staging:
    """Tables that live as long as the session, since queries return frames that read them.

    A session without a shared folder can only be a local one here; it gets a temporary one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.master.startswith("local["):
        folder = _once(spark, "", "folder", lambda: tempfile.mkdtemp(prefix="checks-"))
    return Staging(spark, folder).keep_until_exit()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derive_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``filename, event_id, head``: the lines of every event but those of its document, joined."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props")
    event_id, kind, props = F.col("event_id"), F.col("event_type"), F.col("props")

    def every(step: int, offset: int):
        return event_id % step == offset

    stamp = F.col("ts").cast("string")
    second = F.substring(stamp, 1, 19)
    millis = F.rpad(F.substring(stamp, 21, 3), 3, "0")
    second = F.when(every(97, 13), F.concat(F.lit("2024-02-30"), F.substring(second, 11, 9))).otherwise(second)
    timestamp = (
        F.when(every(17, 6), second)
        .when(every(13, 5), F.concat(second, F.lit(","), millis))
        .otherwise(F.concat(second, F.lit("."), millis))
    )
    level = (
        F.when(kind == "error", "ERROR")
        .when((kind == "signup") & every(7, 2), "WARNING")
        .when(kind == "signup", "WARN")
        .when(kind == "purchase", "INFO")
        .when(kind == "click", "DEBUG")
        .otherwise("TRACE")
    )
    level = F.when(every(11, 3), F.lower(level)).otherwise(level)
    message = (
        F.when(every(19, 7), "")
        .when((kind == "view") & every(2, 1), " heartbeat")
        .when((kind == "purchase") & every(23, 4), F.concat(F.lit(" payment Error for "), props))
        .otherwise(F.concat(F.lit(" props "), props))
    )
    header = F.concat(
        timestamp, F.lit(" [http-"), (F.col("user_id") % 8).cast("string"), F.lit("] "), level,
        F.lit(" com.acme."), kind, F.lit(" -"), message,
    )
    header = F.when(event_id < 4, F.concat(F.lit("no header for "), props)).otherwise(header)
    more = (
        F.when(
            (kind == "error") & every(5, 0),
            F.concat(
                F.lit("java.lang.IllegalStateException: bad "), props,
                F.lit("\n    at com.acme.Handler.run(Handler.java:"), F.col("user_id").cast("string"),
                F.lit(")\nCaused by: java.io.IOException: closed"),
            ),
        )
        .when(
            (kind == "purchase") & every(3, 0),
            F.concat(F.lit("\n    payload="), props, F.lit("\n  \ntail")),
        )
        .when((kind == "signup") & every(5, 1), "  nested TimeoutException: slow")
    )
    return events.select(
        F.concat(F.lit("app-"), (event_id % 4).cast("string"), F.lit(".log")).alias("filename"),
        "event_id",
        F.array_join(F.array(header, more), "\n").alias("head"),
        (F.coalesce(_count(header), F.lit(0)) + F.coalesce(_count(more), F.lit(0))).alias("head_lines"),
    )


def _count(text: Column) -> Column:
    """Lines of a text that is split at line feeds."""
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("bigint")


def derive_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``filename, line_num, value``: the records as numbered lines of four files.

    An event has a record for every document of its number, one without a document at least. Lines are
    counted before the texts meet, so that the documents move once, to the records that carry them.
    """
    counted = table(spark, sf_dir, "documents").select("doc_id", _count(F.col("text")).alias("n"))
    # A record has a line even if all of its texts are null.
    sums = counted.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("docs"), F.sum(F.coalesce("n", F.lit(0))).alias("lines"), F.sum(F.coalesce("n", F.lit(1))).alias("least")
    )
    held = F.when(F.col("docs").isNull(), F.greatest("head_lines", F.lit(1))).otherwise(
        F.when(F.col("head_lines") > 0, F.col("head_lines") * F.col("docs") + F.col("lines")).otherwise(F.col("least"))
    )
    records = derive_records(spark, sf_dir).join(sums, F.col("doc_id") == F.col("event_id"), "left")
    records = records.withColumn("held", held).drop("doc_id", "docs", "lines", "least")
    records = records.withColumn("bucket", F.floor(F.col("event_id") / EVENTS_PER_BUCKET))
    records = running_before(records, ["filename"], "bucket", ["event_id"], F.col("held"), "earlier")
    # Documents of the same number follow each other.
    before = Window.partitionBy("doc_id").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", F.monotonically_increasing_id().alias("nth"))
    documents = documents.where("doc_id IS NOT NULL").withColumns(
        {
            "docs": F.count(F.lit(1)).over(before),
            "lines": F.coalesce(F.sum(F.coalesce(_count(F.col("text")), F.lit(0))).over(before), F.lit(0)),
            "least": F.coalesce(F.sum(F.coalesce(_count(F.col("text")), F.lit(1))).over(before), F.lit(0)),
        }
    )
    first = F.when(F.col("doc_id").isNull(), 0).otherwise(
        F.when(F.col("head_lines") > 0, F.col("head_lines") * F.col("docs") + F.col("lines")).otherwise(F.col("least"))
    )
    head = F.when(F.col("head_lines") > 0, F.col("head"))
    whole = records.join(documents, F.col("doc_id") == F.col("event_id"), "left").select(
        "filename", (F.col("earlier") + first).alias("earlier"), F.split(F.concat_ws("\n", head, "text"), "\n").alias("parts")
    )
    return whole.select("filename", "earlier", F.posexplode("parts").alias("at", "value")).select(
        "filename", (F.col("earlier") + F.col("at") + 1).alias("line_num"), "value"
    )


def _once(spark: SparkSession, sf_dir: str, what: str, build):
    key = (spark.sparkContext.applicationId, sf_dir, what)
    if key not in _staged:
        _staged[key] = build()
    return _staged[key]


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived lines, written once per session as the logs to analyse."""
    return _once(
        spark, sf_dir, "lines", lambda: staging(spark).write(derive_lines(spark, sf_dir), "lines")
    )


def log_dir(spark: SparkSession, sf_dir: str) -> str:
    """A directory of text logs with the derived lines, written once per session."""

    def build() -> str:
        folder = f"{staging(spark).folder}/logs"
        order = ["filename", "line_num"]
        (
            log_lines(spark, sf_dir)
            .repartitionByRange(*order)
            .sortWithinPartitions(*order)
            .select("filename", "value")
            .write.partitionBy("filename")
            .text(folder)
        )
        return folder

    return _once(spark, sf_dir, "dir", build)


def derive_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``config, xml``: one logging configuration per customer.

    Every one has a property with a layout, an appender whose layout depends on
    the customer, a copy of one of them, and a pattern outside of any appender.
    """
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    key = F.col("c_custkey")
    layout = (
        F.when(key % 4 == 0, "%d [%t] %-5p %c{36} - %m%n")
        .when(key % 4 == 1, "%d{HH:mm} %-5level [%thread] %logger{0}: %msg%n")
        .when(key % 4 == 2, "%d %clr(%level) [%t] %c - %m%n")
        .otherwise("%highlight(%d) [%thread] %level ${L:-%logger} - %msg%n")
    )
    return customer.select(
        F.concat(
            F.when(key % 3 == 0, "Logback-").otherwise("logback-"), F.lpad(key.cast("string"), 9, "0"),
            F.when(key % 5 == 0, ".XML").when(key % 7 == 0, ".txt").otherwise(".xml"),
        ).alias("config"),
        F.encode(F.concat(
            F.lit('<configuration><property name="FILE_LOG_PATTERN" value="'), F.col("c_mktsegment"),
            F.lit(' %m%n"/><property name="APP" value="%x"/><property name="x_pattern" value="none"/>'
                  '<appender name="'), F.col("c_name"),
            F.lit('"><encoder><Pattern>\n  '), layout, F.lit("\n</Pattern></encoder></appender>"),
            F.lit("<appender name='copy'><encoder><pattern>"), layout,
            F.lit("</pattern></encoder></appender><pattern><![CDATA[%m "),
            F.col("c_nationkey").cast("string"), F.lit("]]></pattern></configuration>"),
        ), "utf-8").alias("xml"),
    )


def config_dir(spark: SparkSession, sf_dir: str) -> str:
    """A directory with the derived configurations as files, written once per session."""

    def build() -> str:
        folder = f"{staging(spark).folder}/configs".removeprefix("file:")

        def save(rows) -> None:
            os.makedirs(folder, exist_ok=True)
            for row in rows:
                with open(os.path.join(folder, row["config"]), "wb") as file:
                    file.write(row["xml"])

        # The table is small beside its files: as many tasks as there are cores write them.
        tasks = spark.sparkContext.defaultParallelism
        derive_configs(spark, sf_dir).repartition(tasks).foreachPartition(save)
        return folder

    return _once(spark, sf_dir, "configs", build)
