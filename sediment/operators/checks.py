"""Assertions over tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.session import scratch_dir
from sediment.sources.versioned import VersionedTable


@dataclass(frozen=True)
class Contains:
    """The text a field's text has to contain."""

    text: str


@dataclass(frozen=True)
class TableCheck:
    """Row count and row conditions of one table.

    A condition maps fields to the text they must equal, or to :class:`Contains`.  All parts of a ``must``
    condition have to hold in one row; no row may satisfy a ``must_not``.
    """

    rows: int
    exact: bool = False
    must: Sequence[Mapping[str, str | Contains]] = ()
    must_not: Sequence[Mapping[str, str | Contains]] = ()


def _holds(condition: Mapping[str, str | Contains]) -> Column:
    def part(name: str, wanted: str | Contains) -> Column:
        text = F.col(name).cast("string")
        return F.contains(text, F.lit(wanted.text)) if isinstance(wanted, Contains) else text == wanted

    return F.coalesce(reduce(and_, (part(n, w) for n, w in condition.items())), F.lit(False))


def check_table(df: DataFrame, check: TableCheck) -> DataFrame:
    """One row per assertion: ``assertion``, ``expected``, ``actual``, ``ok``; a single pass over the table."""
    counted = [F.count(F.lit(1)).alias("n")]
    counted += [F.count_if(_holds(c)).alias(f"must_{i}") for i, c in enumerate(check.must)]
    counted += [F.count_if(_holds(c)).alias(f"not_{i}") for i, c in enumerate(check.must_not)]
    seen = df.agg(*counted)

    def row(name: str, expected: str, actual: str, ok: Column) -> Column:
        return F.struct(
            F.lit(name).alias("assertion"), F.lit(expected).alias("expected"), F.col(actual).alias("actual"), ok.alias("ok")
        )

    n = F.col("n")
    results = [
        row("rows", f"= {check.rows}" if check.exact else f">= {check.rows}", "n", n == check.rows if check.exact else n >= check.rows)
    ]
    results += [row(f"must_{i}", ">= 1", f"must_{i}", F.col(f"must_{i}") > 0) for i in range(len(check.must))]
    results += [row(f"must_not_{i}", "= 0", f"not_{i}", F.col(f"not_{i}") == 0) for i in range(len(check.must_not))]
    return seen.select(F.inline(F.array(*results)))


def first_readable(*reads: Callable[[], DataFrame]) -> tuple[DataFrame, int]:
    """The first of several reads that can be planned and gives a row or none, with its place among them.

    A read is lazy and fails late; asking for one row makes its plan, opens its files and costs no more than that. An
    error of the last one is raised.
    """
    for i, read in enumerate(reads):
        try:
            df = read()
            df.limit(1).count()
            return df, i
        except (PySparkException, Py4JJavaError, LookupError):
            if i + 1 == len(reads):
                raise
    raise ValueError("nothing to read")


def previous_rows(table: VersionedTable) -> int:
    """Rows of the version before the present one: still readable, and what time travel is checked with."""
    return table.read(version=table.resolve().parent).count()


def key_counts(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Rows and distinct keys of one table, to compare raw table, state and source."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(F.struct(*keys)).alias("keys")).select(
        F.lit(label).alias("table"), "rows", "keys"
    )


def reconcile(tables: Mapping[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """:func:`key_counts` of several tables side by side."""
    return reduce(DataFrame.unionByName, (key_counts(df, keys, label) for label, df in tables.items()))


#: Bits that a level adds to the ranges, and rows of the ranges that differ from which on they are not cut further.
LEVEL_BITS, FETCHED_ROWS = 10, 100_000
_HASH, _PRINT = "_key_hash", "_print"


def _marked_hash(columns: Sequence[Column]) -> Column:
    """64 bits of some values; which of them are null counts too."""
    nulls = [c.isNull().cast("tinyint") for c in columns]
    return F.xxhash64(*columns, *nulls)


def _printed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys, their hash, and a hash of the whole row, columns in the order of their names."""
    named = [F.col(f"`{c}`") for c in sorted(df.columns)]
    own = [F.col(f"`{k}`") for k in keys]
    return df.select(*own, _marked_hash(own).alias(_HASH), _marked_hash(named).alias(_PRINT))


_SUMS = ("_n", "_x", "_low", "_high")


def _sums() -> list[Column]:
    """What rows in any order add up to. The two halves of the hashes are summed too, since equal rows cancel in a xor."""
    whole = F.col(_PRINT)
    halves = whole.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(whole, 32)
    sums = [F.count(F.lit(1)), F.bit_xor(whole), *(F.sum(half.cast("decimal(20,0)")) for half in halves)]
    return [value.alias(name) for value, name in zip(sums, _SUMS)]


def _range(bits: int) -> Column:
    return F.shiftrightunsigned(F.col(_HASH), 64 - bits)


def _unequal(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Groups whose sums differ: ``by``, and the numbers of rows ``left_n`` and ``right_n``."""
    other = right.select(*(F.col(f"`{k}`").alias(f"_r{i}") for i, k in enumerate(by)), *(F.col(name).alias(f"_r{name}") for name in _SUMS))
    same = reduce(and_, (F.col(f"`{k}`").eqNullSafe(F.col(f"_r{i}")) for i, k in enumerate(by)))
    joined = left.withColumn("_l", F.lit(True)).join(other, same, "full_outer")
    equal = reduce(and_, (F.col(name).eqNullSafe(F.col(f"_r{name}")) for name in _SUMS))
    value = [F.when(F.col("_l"), F.col(f"`{k}`")).otherwise(F.col(f"_r{i}")).alias(k) for i, k in enumerate(by)]
    zero = F.lit(0).cast("bigint")
    return joined.where(~equal).select(*value, F.coalesce("_n", zero).alias("left_n"), F.coalesce("_r_n", zero).alias("right_n"))


def reconcile_ranges(spark: SparkSession, left: DataFrame, right: DataFrame, keys: Sequence[str], fetched_rows: int = FETCHED_ROWS) -> DataFrame:
    """The keys in which two tables differ: keys, rows on each side, and ``difference``: missing (no row on the right),
    extra (none on the left) or changed.

    Keys are cut into ranges of their hash. Each level adds up the rows of a range without regard to their order and
    compares the two sums, a row for each range and task, and only ranges that differ are cut further, until those
    hold ``fetched_rows`` or fewer on each side or a range is a single key. Then the rows left are compared key by key. So what
    is shuffled grows with the ranges and with what differs, not with the tables. Both sides need the same columns;
    repeated keys and null keys are compared as groups of rows. Values are told by 64-bit hashes.
    """
    if set(left.columns) != set(right.columns):
        raise ValueError(f"columns differ: {sorted(set(left.columns) ^ set(right.columns))}")
    right = right.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in left.schema.fields))
    sides, bits = [_printed(df, keys) for df in (left, right)], 0
    while True:
        bits += LEVEL_BITS
        ranged = [side.withColumn("_range", _range(bits)) for side in sides]
        sums = [side.groupBy("_range").agg(*_sums()) for side in ranged]
        where = scratch_dir(spark, "ranges")
        _unequal(*sums, ["_range"]).write.parquet(where)
        ranges = spark.read.parquet(where)
        found = ranges.agg(F.count(F.lit(1)).alias("n"), F.sum("left_n").alias("a"), F.sum("right_n").alias("b")).first()
        sides = [side.join(ranges.select("_range"), "_range", "left_semi").drop("_range") for side in ranged]
        if not found.n or max(found.a, found.b) <= fetched_rows or bits + LEVEL_BITS > 60:
            break
    rest = _unequal(*(side.groupBy(*keys).agg(*_sums()) for side in sides), keys)
    kind = F.when(F.col("right_n") == 0, "missing").when(F.col("left_n") == 0, "extra").otherwise("changed")
    return rest.withColumn("difference", kind)
