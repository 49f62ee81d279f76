"""The traffic reports kept as sums that new requests are folded into, in place of computing days again.

Counts, bytes and times add up; numbers of different addresses do not. Every address therefore has a number of its own,
given once, and the addresses of an hour or of a page are bits in words of 64, which are joined by *or*: exact, whatever
is folded in what order. Words without a bit are not kept, so there is never more than a row for each address of an hour or
a page, however few of all the addresses it has. What an address asked for is a small set, so its pages and servers are kept as rows.

Each table is laid out by day, and a fold replaces the days that the new requests are of, in one commit that names the
increment: an increment that comes again changes nothing. Late requests fold into their own day. Nothing but the new
requests and the sums of their days is read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sediment.plans.web import REPORT_ZONE, hourly, ip_daily, page_daily, request_groups, requests
from sediment.session import scratch_dir
from sediment.sources import filesystem
from sediment.sources.tables import for_each
from sediment.sources.versioned import Layout, VersionedTable, by_day

Batch = tuple[str, int]

HOUR, PAGE, ADDRESS = ("day", "hour", "server"), ("day", "page"), ("day", "ip")


class FoldedReports:
    """The tables under a folder, and the three reports over them."""

    def __init__(self, spark: SparkSession, root: str, zone: str = REPORT_ZONE):
        self.spark, self.root, self.zone = spark, root.rstrip("/"), zone

    def table(self, name: str) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.root}/{name}")

    # ---- folding --------------------------------------------------------------------------------------------

    def fold(self, log: DataFrame, batch: Batch) -> None:
        """Adds the requests of an increment; ``batch`` names it as (feed, number), numbers ascending in a feed."""
        staged = scratch_dir(self.spark, "requests")
        try:
            request_groups(requests(log, self.zone)).write.parquet(staged)
            groups = self.spark.read.parquet(staged)
            # days only: as many as the increment has
            days = {r[0] for r in groups.select("day").distinct().collect()}
            numbers = self._numbered(groups.select("ip"), batch)

            def bits(keys: Sequence[str]) -> DataFrame:
                pairs = groups.select(*keys, "ip").distinct().join(numbers, "ip")
                bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("number") % 64).cast("int"))
                return pairs.groupBy(*keys, F.shiftright("number", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))

            joined = F.bit_or("bits").alias("bits")
            parts = {
                "hour_sums": (hourly(groups).drop("distinct_ip"), _added(HOUR)),
                "hour_bits": (bits(HOUR), lambda df: df.groupBy(*HOUR, "word").agg(joined)),
                "page_sums": (page_daily(groups).drop("distinct_ip"), _added(PAGE)),
                "page_bits": (bits(PAGE), lambda df: df.groupBy(*PAGE, "word").agg(joined)),
                "ip_sums": (ip_daily(groups).drop("distinct_pages", "servers"), _added(ADDRESS)),
                "ip_pages": (groups.select(*ADDRESS, "page").distinct(), DataFrame.distinct),
                "ip_servers": (groups.select(*ADDRESS, "server").distinct(), DataFrame.distinct),
            }
            failures = for_each(list(parts), lambda name: self._folded(name, *parts[name], days, batch), 4)
            if failures:
                raise RuntimeError("; ".join(f"{name}: {error}" for name, error in failures))
        finally:
            filesystem.delete(self.spark, staged)

    def _folded(self, name: str, rows: DataFrame, merge: Callable[[DataFrame], DataFrame], days: set, batch: Batch) -> None:
        table = self.table(name)
        head = table.head() or table.create(rows.schema, by_day("day"))
        if head.batches.get(batch[0], -1) >= batch[1]:
            return
        old = [u for u in head.units if u.day in days]
        table.replace_units(old, merge(table.scan(old, head.struct, head.layout).unionByName(rows)), "fold", batch=batch)

    def _numbered(self, addresses: DataFrame, batch: Batch) -> DataFrame:
        """The addresses' numbers; new ones get the numbers after the last, without gaps, so that words are full."""
        table = self.table("addresses")
        head = table.head() or table.create(addresses.withColumn("number", F.lit(0).cast("bigint")).schema, Layout())
        known = table.scan(head.units, head.struct, head.layout)
        if head.batches.get(batch[0], -1) >= batch[1]:
            return known
        staged = scratch_dir(self.spark, "addresses")
        new = addresses.where(F.col("ip").isNotNull()).distinct().join(known, "ip", "left_anti")
        new.withColumn("at", F.monotonically_increasing_id()).write.parquet(staged)
        placed = self.spark.read.parquet(staged).withColumn("task", F.shiftright("at", 33))
        # a row for each task that wrote
        counts = placed.groupBy("task").agg(F.count(F.lit(1)).alias("n"))
        before = F.coalesce(F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        bases = counts.select("task", (before + sum(u.records for u in head.units)).alias("base"))
        table.append(placed.join(bases, "task").select("ip", (F.col("base") + F.col("at") - F.shiftleft(F.col("task"), 33)).alias("number")), batch=batch)
        filesystem.delete(self.spark, staged)
        head = table.head()
        return table.scan(head.units, head.struct, head.layout)

    # ---- reports --------------------------------------------------------------------------------------------

    def hourly(self) -> DataFrame:
        return self._counted("hour_sums", HOUR, distinct_ip=("hour_bits", F.sum(F.bit_count("bits"))))

    def page_daily(self) -> DataFrame:
        return self._counted("page_sums", PAGE, distinct_ip=("page_bits", F.sum(F.bit_count("bits"))))

    def ip_daily(self) -> DataFrame:
        return self._counted("ip_sums", ADDRESS, distinct_pages=("ip_pages", F.count("page")), servers=("ip_servers", F.count("server")))

    def _counted(self, sums: str, keys: Sequence[str], **counted: tuple[str, Column]) -> DataFrame:
        """The sums with numbers of different values; keys may be null, and then match too."""
        out = self.table(sums).read()
        for name, (table, count) in counted.items():
            found = self.table(table).read().groupBy(*keys).agg(count.alias(name)).select(*(F.col(k).alias(f"_{k}") for k in keys), name)
            same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
            out = out.join(found, same, "left").drop(*(f"_{k}" for k in keys)).withColumn(name, F.coalesce(name, F.lit(0).cast("bigint")))
        return out


def _added(keys: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    """Two sets of sums as one: numbers are added, times and marks keep their bounds."""
    bounds = {"first_seen": F.min, "last_seen": F.max, "bot": F.max}

    def merge(df: DataFrame) -> DataFrame:
        return df.groupBy(*keys).agg(*(bounds.get(c, F.sum)(c).alias(c) for c in df.columns if c not in keys))

    return merge
