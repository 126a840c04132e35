"""Streams around the assistant: webhook messages, the interaction log and crawled pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.config import DEFAULT
from tidewell.operators import records, service
from tidewell.sources.files import webhook_messages

# fixed values: messages that are commands
HELP, CLEAR = ["help", "/help"], ["clear", "reset", "/clear", "/reset"]


def command(body: Column) -> Column:
    """``help`` or ``clear`` for a command, else null."""
    said = F.lower(F.regexp_replace(F.coalesce(body, F.lit("")), r"^\s+|\s+$", ""))
    return F.when(said.isin(HELP), "help").when(said.isin(CLEAR), "clear")


def webhook_feed(payloads: DataFrame, tenants: DataFrame) -> DataFrame:
    """Envelopes (a table or a stream) as messages of enabled tenants, commands told apart: ``(client_slug, sender, message_id, body, command)``."""
    routed = service.route(webhook_messages(payloads), tenants)
    return routed.select("client_slug", "sender", "message_id", "body", command(F.col("body")).alias("command"))


def interaction_log(turns: DataFrame, path: str, checkpoint: str):
    """A stream of turns appended to the log with its weak flags; one run over what is there, to be started again."""
    return records.weak_flags(turns).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def crawl_sink(pages: DataFrame, path: str, checkpoint: str):
    """A stream of ``pages(url, ...)`` into a table that holds every address once: pages that are there already are passed over.

    A batch that is written again replaces its own rows only.
    """
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(["url"])
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            had = spark.read.parquet(path).where(F.col("batch") != number).select("url")
            fresh = fresh.join(had, "url", "left_anti")
        fresh.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def active_sessions(events: DataFrame, at: Column, *, key: str = "user_id", minutes: int = DEFAULT.session_minutes) -> DataFrame:
    """``(n_active)``: keys with an event in the last ``minutes`` before ``at``."""
    when = F.col("ts").cast("timestamp")
    return events.where((when <= at) & (when > at - F.expr(f"INTERVAL {minutes} MINUTES"))).agg(F.count_distinct(key).alias("n_active"))


def active_by(events: DataFrame, at: str, *, key: str = "user_id", minutes: int = DEFAULT.session_minutes) -> DataFrame:
    """``(<at>, n_active)``: the same for many moments in one pass; each event names the moment that it may count for in ``at``."""
    when = F.col("ts").cast("timestamp")
    return events.where((when <= F.col(at)) & (when > F.col(at) - F.expr(f"INTERVAL {minutes} MINUTES"))).groupBy(at).agg(F.count_distinct(key).alias("n_active"))
