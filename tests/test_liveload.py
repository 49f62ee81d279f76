"""Loading key ranges beside the feed."""

import pytest
from pyspark.sql import functions as F

from sediment.operators.latest import current_state
from sediment.sources import liveload
from sediment.sources.liveload import Mark, Progress, chunk_changes, load_live
from sediment.sources.versioned import VersionedTable, by_day
from tests.conftest import rows
from tests.helpers import log, utc

LOAD = utc(2026, 1, 10)


def feed(spark, *changes):
    """(id, status, op, day, offset)"""
    return log(spark, [(i, s, "1", op, f"2026-01-{day:02d} 00:00:00", offset) for i, s, op, day, offset in changes]).drop("amount")


def source(spark, *data):
    return spark.createDataFrame(list(data), "id long, status string")


def test_rows_whose_key_changed_between_the_marks_are_dropped(spark):
    changes = feed(spark, (1, "old", "U", 1, 10), (2, "low", "U", 1, 11), (3, "in", "U", 1, 12), (4, "high", "U", 1, 20), (5, "after", "U", 1, 21), (None, "x", "U", 1, 15))
    copied = source(spark, *((i, "copied") for i in (1, 2, 3, 4, 5, 6, None)))
    out = chunk_changes(copied, changes, ["id"], Mark.at(11, LOAD), Mark.at(20, LOAD), "s", "t")
    assert sorted(r.id for r in out.collect()) == [1, 2, 5, 6]
    assert {(r._cdc.op, r._cdc.ts, r._cdc.offset, r._cdc.source, r._cdc.target) for r in out.collect()} == {("I", LOAD.replace(tzinfo=None), 11, "s", "t")}
    # the log's keys and the marks reach the scan as they are; nothing is compared pair by pair
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_older_event_times_win_over_the_load(spark, path):
    table = VersionedTable(spark, path + "/raw")
    data = source(spark, *((i, "copied") for i in range(20)))
    placed = [100]

    def mark():
        placed[0] += 100
        if placed[0] == 300:  # between the first range's marks: event times older than the load's
            table.append(feed(spark, (3, "live", "U", 2, 250), (4, "gone", "D", 2, 251)), by_day("_cdc.ts"))
        return Mark.at(placed[0], LOAD)

    ranges = [(None, "9"), ("9", None)]
    read = lambda b: data.where((F.col("id") <= 9) if b[0] is None else (F.col("id") > 9))
    go = lambda: load_live(table, read, ranges, ["id"], mark, "one", "s", "t")
    # the feed is not past the high mark yet
    assert go() == Progress(0, 2) and table.read().count() == 2
    assert go() == Progress(0, 2) and placed == [300]  # what was read is not read again
    table.append(feed(spark, (5, "later", "U", 11, 300)), by_day("_cdc.ts"))
    assert go() == Progress(1, 1)
    table.append(feed(spark, (15, "later", "U", 11, 900)), by_day("_cdc.ts"))
    assert go() == Progress(1, 0) and go() == Progress(0, 0)
    state = dict(rows(current_state(table.read(), ["id"]), "id", "status"))
    assert state == {i: "copied" for i in range(20) if i != 4} | {3: "live", 5: "later", 15: "later"}
    # another load copies the ranges again
    assert load_live(table, read, ranges, ["id"], lambda: Mark.at(500, LOAD), "two", "s", "t") == Progress(2, 0)


def test_a_load_that_was_cut_short_goes_on(spark, path, monkeypatch):
    table = VersionedTable(spark, path + "/raw")
    table.append(feed(spark, (0, "x", "U", 1, 10_000)), by_day("_cdc.ts"))
    reads, marks = [], []

    def read(bounds):
        reads.append(bounds)
        if len(reads) == 2:
            raise RuntimeError("lost")
        return source(spark, (len(reads), "copied"))

    def mark():
        marks.append(1)
        return Mark.at(len(marks), LOAD)

    ranges = [(None, "1"), ("1", "2"), ("2", None)]
    with pytest.raises(RuntimeError):
        load_live(table, read, ranges, ["id"], mark, "one", "s", "t")
    assert load_live(table, read, ranges, ["id"], mark, "one", "s", "t") == Progress(2, 0)
    assert reads == [ranges[0], ranges[1], ranges[1], ranges[2]]
    assert sorted(r.id for r in table.read().collect()) == [0, 1, 3, 4]
    # the copies that were read are gone, their notes stay
    left = liveload.filesystem.names(spark, f"{table.path}/_loads/" + liveload.filesystem.names(spark, f"{table.path}/_loads")[0])
    assert sorted(n for n in left if n.endswith(".json")) == ["0.json", "1.json", "2.json"]


def test_nothing_to_load(spark, path):
    table = VersionedTable(spark, path + "/raw")
    assert load_live(table, lambda b: source(spark), [], ["id"], lambda: Mark.at(1, LOAD), "one", "s", "t") == Progress(0, 0)
    assert load_live(table, lambda b: source(spark), [(None, None)], ["id"], lambda: Mark.at(1, LOAD), "one", "s", "t") == Progress(0, 1)
    assert not liveload.reached(table, 0)
