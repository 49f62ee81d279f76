"""Hourly web traffic as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sediment.functions.weblog import is_bot, status_between
from sediment.sources.versioned import VersionedTable, by_day
from sediment.streaming.landing import run_batches

LATENESS = "3 days"  # fixed value: how long late rows still count, as in the daily recomputation


def hourly_counts(log: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Requests per hour and server; in append mode each hour is given out once rows that late can no longer come.

    Distinct addresses need the exact recomputation of :func:`sediment.plans.web.refresh`.
    """
    code, one = F.col("code"), F.lit(1)
    return (
        log.withWatermark("ts", lateness)
        .groupBy(F.window("ts", "1 hour").alias("_hour"), "server")
        .agg(
            F.count(F.lit(1)).alias("requests"),
            status_between(code, 200, 299, one).alias("ok_2xx"),
            status_between(code, 300, 399, one).alias("redirect_3xx"),
            status_between(code, 400, 499, one).alias("client_error_4xx"),
            F.sum(F.when(code >= 500, 1).otherwise(0)).alias("server_error_5xx"),
            F.sum(F.coalesce("size", F.lit(0))).alias("bytes"),
            F.sum(F.when(is_bot(F.col("agent")), 1).otherwise(0)).alias("bot_requests"),
        )
        .select(F.col("_hour.start").alias("hour"), "server", "requests", "ok_2xx", "redirect_3xx", "client_error_4xx", "server_error_5xx", "bytes", "bot_requests")
    )


def land_hours(log: DataFrame, table: VersionedTable, checkpoint: str, lateness: str = LATENESS, interval: str | None = None) -> StreamingQuery:
    """Every change of an hour's counts as it comes, open hours too; :func:`newest_hours` has the last of each.

    The state holds the hours that late rows can still reach.  Rows later than that are not in the stream's counts:
    :func:`late_rows` says how many there were, and the daily recomputation has them.
    """

    def work(batch: DataFrame, name: tuple[str, int]) -> None:
        head = table.head()
        # batch numbers begin again with a new checkpoint, the table's versions do not
        table.append(batch.withColumn("_batch", F.lit(head.version + 1 if head else 0).cast("long")), by_day("hour"), name)

    return run_batches(hourly_counts(log, lateness), checkpoint, work, interval, "update")


def newest_hours(landed: DataFrame) -> DataFrame:
    """The last counts of each hour and server, in the order in which they were committed.

    A stream that starts anew with a new checkpoint counts what it reads from the start; its counts of an hour replace
    those of the stream before, and hours that it does not see stay. Until it has read all, its hours may be too low.
    """
    counts = [c for c in landed.columns if c not in ("hour", "server", "_batch")]
    return landed.groupBy("hour", "server").agg(F.max_by(F.struct(*counts), "_batch").alias("_last")).select("hour", "server", "_last.*")


def hourly_distinct(log: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Different addresses per hour and server, given out once an hour is closed; null addresses are not counted.

    Two stateful steps in a row: the first lets each address of an hour and server through once, the second counts
    what comes through. The first forgets an address ``lateness`` after it came; with an hour at least, nothing that still
    counts for its hour can come later than that. Its state is spread by address, so a busy server is no hot key.
    """
    hour = F.timestamp_seconds(F.floor(F.unix_seconds("ts") / 3600) * 3600)
    once = log.select("ts", "server", "remote", hour.alias("_hour")).withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["_hour", "server", "remote"])
    counted = once.groupBy(F.window("ts", "1 hour").alias("_window"), "server").agg(F.count("remote").alias("distinct_ip"))
    return counted.select(F.col("_window.start").alias("hour"), "server", "distinct_ip")


def land_distinct(log: DataFrame, table: VersionedTable, checkpoint: str, lateness: str = LATENESS, interval: str | None = None) -> StreamingQuery:
    """The closed hours of :func:`hourly_distinct`, each once; it goes on after a restart where it stopped.

    An hour is closed when a row later than its end plus ``lateness`` has come from anywhere, so a feed that may fall silent
    needs a row now and then that only tells the time.
    """
    return run_batches(hourly_distinct(log, lateness), checkpoint, lambda batch, name: table.append(batch, by_day("hour"), name), interval)


def late_rows(query: StreamingQuery) -> int:
    """Rows that came too late for the counts, over the query's kept progress reports."""
    return sum(int(s["numRowsDroppedByWatermark"]) for p in query.recentProgress for s in p["stateOperators"])
