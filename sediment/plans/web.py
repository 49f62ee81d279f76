"""Web traffic reports over the parsed access log."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.functions.weblog import is_bot, normal_page, status_between
from sediment.session import scratch_dir
from sediment.sources import filesystem as files
from sediment.sources.tables import overwrite_partitions

REPORT_ZONE = "Europe/Istanbul"  # fixed value: the zone whose days and hours the reports use
DAYS_BACK = 3


def day_start(day: date, zone: str = REPORT_ZONE) -> datetime:
    """The instant a local day begins."""
    return datetime(day.year, day.month, day.day, tzinfo=ZoneInfo(zone))


def recent_days(log: DataFrame, as_of: date, days_back: int = DAYS_BACK, zone: str = REPORT_ZONE, column: str = "ts") -> DataFrame:
    """Rows of the last ``days_back`` local days, ``as_of`` included.

    The bound is an instant worked out beforehand, so the predicate is on the stored column and reaches the scan.
    """
    return log.where(F.col(column) >= F.lit(day_start(as_of - timedelta(days=days_back - 1), zone)))


def requests(log: DataFrame, zone: str = REPORT_ZONE) -> DataFrame:
    """The columns the reports need, one row per request with weight ``n`` = 1."""
    local = F.convert_timezone(None, F.lit(zone), "ts")
    return log.select(
        local.cast("date").alias("day"),
        F.date_trunc("HOUR", local).cast("timestamp_ntz").alias("hour"),
        "server",
        F.col("remote").alias("ip"),
        normal_page(F.col("path")).alias("page"),
        "code",
        is_bot(F.col("agent")).alias("bot"),
        F.lit(1).cast("bigint").alias("n"),
        F.coalesce("size", F.lit(0)).cast("bigint").alias("bytes"),
        F.col("ts").alias("first_seen"),
        F.col("ts").alias("last_seen"),
    )


_GRAIN = ["day", "hour", "server", "ip", "page", "code", "bot"]


def request_groups(rows: DataFrame) -> DataFrame:
    """Requests that are alike, with their number: the input of all three reports when they run together.

    One pass over the log; the reports then read this much smaller table.
    """
    return rows.groupBy(*_GRAIN).agg(
        F.sum("n").alias("n"),
        F.sum("bytes").alias("bytes"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    )


def _errors() -> list:
    code, n = F.col("code"), F.col("n")
    return [
        status_between(code, 400, 499, n).alias("client_error_4xx"),
        F.sum(F.when(code >= 500, n).otherwise(0)).alias("server_error_5xx"),
    ]


def hourly(rows: DataFrame) -> DataFrame:
    """Per day, hour and server.  The distinct count is split by address before it is summed, so a busy server
    is spread over many tasks."""
    code, n = F.col("code"), F.col("n")
    return rows.groupBy("day", "hour", "server").agg(
        F.sum("n").alias("requests"),
        status_between(code, 200, 299, n).alias("ok_2xx"),
        status_between(code, 300, 399, n).alias("redirect_3xx"),
        *_errors(),
        F.count_distinct("ip").alias("distinct_ip"),
        F.sum("bytes").alias("bytes"),
        F.sum(F.when(F.col("bot"), n).otherwise(0)).alias("bot_requests"),
    )


def ip_daily(rows: DataFrame) -> DataFrame:
    """Per day and address: for finding scans and password guessing.

    The distinct counts are split by page and by server before they are summed, so one address with a third of
    all requests is spread over many tasks.
    """
    code, n = F.col("code"), F.col("n")
    return rows.groupBy("day", "ip").agg(
        F.sum("n").alias("requests"),
        *_errors(),
        *(F.sum(F.when(code == c, n).otherwise(0)).alias(name) for name, c in _WATCHED.items()),
        F.count_distinct("page").alias("distinct_pages"),
        F.count_distinct("server").alias("servers"),
        F.max("bot").alias("bot"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    )


_WATCHED = {"failed_login_401": 401, "forbidden_403": 403, "not_found_404": 404}


def page_daily(rows: DataFrame) -> DataFrame:
    """Per day and page."""
    return rows.groupBy("day", "page").agg(
        F.sum("n").alias("requests"),
        *_errors(),
        F.count_distinct("ip").alias("distinct_ip"),
        F.sum("bytes").alias("bytes"),
    )


REPORTS = {"web_hourly": hourly, "web_ip_daily": ip_daily, "web_page_daily": page_daily}


def refresh(
    spark: SparkSession,
    log: DataFrame,
    root: str,
    as_of: date,
    days_back: int = DAYS_BACK,
    zone: str = REPORT_ZONE,
    computed_at: datetime | None = None,
) -> Mapping[str, str]:
    """Bring the three report tables under ``root`` up to date; returns their folders.

    When all three exist the last days are computed again, late rows included, and only their partitions are
    replaced.  Otherwise the whole log is computed.  ``computed_at``, by default now, is a column of each.  The log is read and grouped once, into a table in the
    shared folder that all three reports are made from.
    """
    folders = {name: f"{root.rstrip('/')}/{name}" for name in REPORTS}
    complete = all(files.names(spark, f) for f in folders.values())
    rows = recent_days(log, as_of, days_back, zone) if complete else log
    at = computed_at or datetime.now(timezone.utc)
    staged = scratch_dir(spark, "requests")
    try:
        request_groups(requests(rows, zone)).write.parquet(staged)
        groups = spark.read.parquet(staged)
        for name, report in REPORTS.items():
            overwrite_partitions(report(groups).withColumn("computed_at", F.lit(at)), folders[name], ["day"])
    finally:
        files.delete(spark, staged)
    return folders


def error_share(by_hour: DataFrame) -> DataFrame:
    """Total requests and the share of 4xx and 5xx, over the hourly report."""
    bad = F.sum(F.col("client_error_4xx") + F.col("server_error_5xx"))
    return by_hour.agg(F.sum("requests").alias("requests"), bad.alias("errors")).withColumn(
        "error_share", F.col("errors") / F.nullif(F.col("requests"), F.lit(0))
    )


def by_status_class(by_hour: DataFrame) -> DataFrame:
    """Requests per hour and status class."""
    classes = ("ok_2xx", "redirect_3xx", "client_error_4xx", "server_error_5xx")
    return by_hour.groupBy("hour").agg(*(F.sum(c).alias(c) for c in classes))


def by_server(by_hour: DataFrame) -> DataFrame:
    """Requests per hour and server."""
    return by_hour.groupBy("hour", "server").agg(F.sum("requests").alias("requests"))


def suspicious_ips(by_ip: DataFrame, n: int = 10) -> DataFrame:
    """The addresses with most client errors; equal ones in order of address."""
    return (
        by_ip.groupBy("ip")
        .agg(F.sum("client_error_4xx").alias("client_error_4xx"), F.sum("not_found_404").alias("not_found_404"), F.sum("failed_login_401").alias("failed_login_401"))
        .orderBy(F.col("client_error_4xx").desc(), "ip")
        .limit(n)
    )


#: Addresses that the summary of :func:`suspicious_ips_fast` tracks; an untracked one has at most 3.5 times that share of errors.
TRACKED, TRACKED_ERROR = 10_000, 3.5


def suspicious_ips_fast(rows: DataFrame, n: int = 10, tracked: int = TRACKED) -> DataFrame:
    """:func:`suspicious_ips` of requests without a group for every address.

    A summary of bounded size, merged from those of the tasks, names ten times as many addresses as are wanted, those
    with most client errors by its estimates. These are counted exactly in a second pass. An address that it does
    not name has at most as many errors as the last estimate, or as the summary's error bound; only if the last exact
    count is above both, the answer is complete. Otherwise, a tie at the end among them, all addresses are counted.
    """
    bad = rows.where(F.col("code").between(400, 499))
    named = min(n * 10, tracked)
    found = bad.agg(F.count(F.lit(1)).alias("total"), F.expr(f"approx_top_k(ip, {named}, {tracked})").alias("top")).first()
    top = [(x[0], x[1]) for x in found["top"] or []]
    bound = max(TRACKED_ERROR * found["total"] / tracked, top[-1][1] if len(top) == named else 0)
    candidates = rows.where(F.col("ip").isin([ip for ip, _ in top if ip is not None]) | F.col("ip").isNull())
    exact = suspicious_ips(ip_daily(candidates), n)
    counts = [r["client_error_4xx"] for r in exact.select("client_error_4xx").collect()]
    return exact if len(counts) == n and min(counts) > bound else suspicious_ips(ip_daily(rows), n)


def error_pages(by_page: DataFrame, n: int = 10) -> DataFrame:
    """The pages with most errors; equal ones in order of name."""
    return (
        by_page.groupBy("page")
        .agg(F.sum(F.col("client_error_4xx") + F.col("server_error_5xx")).alias("errors"), F.sum("requests").alias("requests"))
        .orderBy(F.col("errors").desc(), "page")
        .limit(n)
    )


def lines_by_server(log: DataFrame) -> DataFrame:
    """Log rows per server."""
    return log.groupBy("server").count()
