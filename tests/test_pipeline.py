import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sediment.model import KAFKA_SCHEMA, Pipeline
from sediment.operators import upkeep
from sediment.operators.checks import Contains, TableCheck, check_table
from sediment.operators.schema import SchemaConflict
from sediment.sources import kafka
from sediment.sources.versioned import PENDING, VersionedTable, by_day
from sediment.streaming import landing, silver
from sediment.streaming import web as web_stream
from sediment.streaming.silver import PipelinesFailed, run_all, run_pipeline
from tests.conftest import rows
from tests.helpers import log, utc

DAY = by_day("_cdc.ts")
MODES = ["merge-on-read", "copy-on-write"]


def holds(df, check):
    return all(r["ok"] for r in check_table(df, check).collect())


def tables(spark, path):
    return VersionedTable(spark, path + "/bronze"), VersionedTable(spark, path + "/silver")


@pytest.mark.parametrize("mode", MODES)
def test_relational_scenario(spark, path, mode):
    """Three rows; an update and a delete; upkeep; an insert."""
    bronze, state = tables(spark, path)
    p = Pipeline("shop_raw.orders", ("id",), mode, 4)
    assert run_pipeline(p, bronze, state).mode == "skipped"
    at = "2026-11-08 20:07:05.04"
    bronze.append(log(spark, [(1, "new", "10.50", "I", at + "0", 1), (2, "paid", "99.99", "I", at + "1", 2), (3, "new", "3.00", "I", at + "2", 3)]), DAY)
    first = run_pipeline(p, bronze, state)
    assert (first.mode, first.keys) == ("full", 3)
    assert holds(state.read(), TableCheck(3, True, must=[{"id": "1", "status": "new", "amount": Contains("10.50")}]))
    bronze.append(log(spark, [(1, "shipped", "10.50", "U", "2026-11-08 20:29:32.762", 4), (2, None, "0", "D", "2026-11-08 20:29:32.764", 5)]), DAY)
    second = run_pipeline(p, bronze, state)
    assert (second.mode, second.keys) == ("incremental", 2)
    assert holds(state.read(), TableCheck(2, True, must=[{"id": "1", "status": "shipped"}], must_not=[{"id": "2"}]))
    assert state.read(version=first.version).count() == 3
    assert run_pipeline(p, bronze, state).mode == "current"
    upkeep.fold(state)
    upkeep.compact(bronze, min_files=2)
    assert state.read().count() == 2 and not state.head().of(PENDING)
    assert run_pipeline(p, bronze, state).keys == 0
    bronze.append(log(spark, [(4, "new", "1.00", "I", "2026-11-08 20:42:10.469", 6)]), DAY)
    third = run_pipeline(p, bronze, state)
    assert (third.mode, third.keys, state.read().count(), bronze.read().count()) == ("incremental", 1, 3, 6)
    assert state.head().newest.isoformat() == "2026-11-08T20:42:10.469000+00:00"


@pytest.mark.parametrize("mode", MODES)
def test_replay_and_fallback_give_the_same_state(spark, path, mode):
    bronze, state = tables(spark, path)
    p = Pipeline("shop_raw.orders", ("id",), mode, 2)
    for n in range(3):
        bronze.append(log(spark, [(n, f"v{n}", "1", "I", f"2026-01-0{n + 1} 00:00:00", n), (0, f"w{n}", "1", "U", f"2026-01-0{n + 1} 01:00:00", n + 10)]), DAY)
        run_pipeline(p, bronze, state)
    before = rows(state.read())
    bronze.append(bronze.read(), DAY)
    assert run_pipeline(p, bronze, state).mode == "incremental" and rows(state.read()) == before
    bronze.append(log(spark, [(7, "x", "1", "I", "2026-01-03 02:00:00", 99)]), DAY)
    # an event of long ago that arrives now is seen although the commit records are gone
    bronze.append(log(spark, [(8, "old", "1", "I", "2025-06-01 00:00:00", 100)]), DAY)
    upkeep.expire(bronze, utc(2100, 1, 1), 1)
    assert run_pipeline(p, bronze, state).mode == "listed" and rows(state.read().where("id = 8"), "status") == [("old",)]
    bronze.append(log(spark, [(8, None, "1", "D", "2026-01-03 03:00:00", 101)]), DAY)
    upkeep.expire(bronze, utc(2100, 1, 1), 1)
    assert run_pipeline(p, bronze, state, bounded=True).mode in ("listed", "bounded")
    assert [r for r in rows(state.read()) if r[0] != 7] == before and state.read().count() == len(before) + 1


@pytest.mark.parametrize("mode", MODES)
def test_late_change_of_a_later_increment_wins(spark, path, mode):
    bronze, state = tables(spark, path)
    p = Pipeline("shop_raw.orders", ("id",), mode, 2)
    for status, ts in (("first", "2026-01-01"), ("newer", "2026-01-05"), ("late", "2026-01-02")):
        bronze.append(log(spark, [(1, status, "1", "U", f"{ts} 00:00:00", 1)]), DAY)
        run_pipeline(p, bronze, state)
    assert rows(state.read(), "status") == [("late",)]
    assert state.head().newest.date().isoformat() == "2026-01-05"


@pytest.mark.parametrize("mode", MODES)
def test_schema_evolution(spark, path, mode):
    bronze, state = tables(spark, path)
    p = Pipeline("shop_raw.orders", ("id",), mode, 2, {"status": "timestamp"})
    bronze.append(log(spark, [(1, "2026-01-01 10:00:00", "1", "I", "2026-01-01 00:00:00", 1), (2, "2026-01-01 11:00:00", "2", "I", "2026-01-01 00:00:00", 2)]), DAY)
    run_pipeline(p, bronze, state)
    assert state.read().schema["status"].dataType == T.TimestampType()
    wider = log(spark, [(1, "2026-01-02 10:00:00", "12345678901.5", "U", "2026-01-02 00:00:00", 3)], "decimal(38,2)").withColumn("note", F.lit("n"))
    bronze.append(wider, DAY)
    run_pipeline(p, bronze, state)
    assert rows(state.read(), "id", F.col("amount").cast("string"), "note") == [(1, "12345678901.50", "n"), (2, "2.00", None)]
    upkeep.fold(state)
    assert state.read().schema["amount"].dataType == T.DecimalType(38, 2)
    with pytest.raises(SchemaConflict):
        run_pipeline(Pipeline("shop_raw.orders", ("id",), mode, 2, {"status": "date"}), bronze, state)


@pytest.mark.parametrize("mode", MODES)
def test_keys_made_equal_by_a_cast(spark, path, mode):
    bronze, state = tables(spark, path)
    p = Pipeline("shop_raw.orders", ("status",), mode, 2, {"status": "int"})
    bronze.append(log(spark, [(1, "1", "1", "I", "2026-01-01 00:00:00", 1)]), DAY)
    run_pipeline(p, bronze, state)
    bronze.append(log(spark, [(2, "2", "1", "I", "2026-01-02 00:00:00", 2), (3, "02", "1", "I", "2026-01-02 00:00:00", 3)]), DAY)
    run_pipeline(p, bronze, state)  # nothing stored has the key 2: both are inserted
    assert rows(state.read(), "id", "status") == [(1, 1), (2, 2), (3, 2)]
    bronze.append(log(spark, [(4, "1", "1", "U", "2026-01-03 00:00:00", 4), (5, "01", "1", "U", "2026-01-03 00:00:00", 5)]), DAY)
    with pytest.raises(Exception, match="several changes match"):
        run_pipeline(p, bronze, state)
    assert rows(state.read(), "id", "status") == [(1, 1), (2, 2), (3, 2)]


def test_mark_does_not_depend_on_the_session_zone(spark, path):
    bronze, state = tables(spark, path)
    bronze.append(log(spark, [(1, "a", "1", "I", "2026-01-01 23:30:00", 1)]), DAY)
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        run_pipeline(Pipeline("shop_raw.orders", ("id",)), bronze, state)
        bronze.append(bronze.read(), DAY)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert state.head().newest == utc(2026, 1, 1, 23, 30)
    assert {u.part for u in bronze.head().units} == {"2026-01-01"}


def test_only_touched_buckets_are_rewritten(spark, path):
    bronze, state = tables(spark, path)
    p = Pipeline("shop_raw.orders", ("id",), "copy-on-write", 8)
    bronze.append(log(spark, [(n, "a", "1", "I", "2026-01-01 00:00:00", n) for n in range(100)]), DAY)
    run_pipeline(p, bronze, state)
    before = set(state.head().units)
    bronze.append(log(spark, [(5, "b", "1", "U", "2026-01-02 00:00:00", 1000)]), DAY)
    run_pipeline(p, bronze, state)
    assert len(before) == 8 and len(before & set(state.head().units)) == 7
    assert state.read().count() == 100 and rows(state.read().where("id = 5"), "status") == [("b",)]


def test_one_failing_pipeline_does_not_stop_the_others(spark, path):
    good, bad = Pipeline("a_raw.t", ("id",)), Pipeline("b_raw.t", ("nope",))
    for p in (good, bad):
        VersionedTable(spark, f"{path}/{p.bronze}").append(log(spark, [(1, "x", "1", "I", "2026-01-01 00:00:00", 1)]), DAY)

    def at(name):
        return lambda p: VersionedTable(spark, f"{path}/{getattr(p, name)}")

    with pytest.raises(PipelinesFailed, match="b_raw.t"):
        run_all([bad, good], at("bronze"), at("target"))
    assert VersionedTable(spark, path + "/a.t").read().count() == 1
    assert [o.mode for o in run_all([good], at("bronze"), at("target"))] == ["current"]


# ---- streams


def finish(query):
    query.awaitTermination()
    assert query.exception() is None


def deliver(spark, folder, values, first=0, topic="crm.crm.customers"):
    data = [(k, v, topic, 0, first + i, utc(2026, 9, 11)) for i, (k, v) in enumerate(values)]
    spark.createDataFrame(data, KAFKA_SCHEMA).write.mode("append").parquet(folder)


def document(n, op, doc=None):
    key = json.dumps({"id": json.dumps({"$oid": f"{n:024d}"})})
    return key, json.dumps({"op": op, "ts_ms": 1757600000000 + n, "after": json.dumps(doc) if doc else None, "before": None})


def test_document_scenario(spark, path):
    """Three documents; an update, a delete, an insert and a tombstone; state of three."""
    bronze, state = tables(spark, path)
    quarantine = VersionedTable(spark, path + "/quarantine")

    def land():
        finish(landing.land_documents(kafka.file_stream(spark, path + "/topic"), bronze, quarantine, "crm_raw.customers", path + "/checkpoint"))

    p = Pipeline("crm_raw.customers", ("_id",))
    deliver(spark, path + "/topic", [document(1, "c", {"name": "Ada"}), document(2, "c", {"name": "Bob"}), document(3, "r", {"name": "Cem"})])
    land()
    run_pipeline(p, bronze, state)
    assert state.read().count() == 3
    deliver(spark, path + "/topic", [document(1, "u", {"name": "Ada L"}), document(2, "d"), (document(2, "d")[0], None), document(4, "c", {"nested": {"deep": {"v": 1}}})], 3)
    land()
    run_pipeline(p, bronze, state)
    assert (bronze.read().count(), state.read().count(), quarantine.read().count()) == (6, 3, 0)
    assert holds(state.read(), TableCheck(3, True, must=[{"_id": f"{1:024d}", "_doc": Contains("Ada L")}], must_not=[{"_id": f"{2:024d}"}]))
    deliver(spark, path + "/topic", [(None, document(5, "c", {"a": 1})[1]), document(6, "u")], 7)
    land()
    assert rows(quarantine.read(), "reason", "offset") == [("after-null", 8), ("no-key", 7)]


def test_only_deletes(spark, path):
    bronze, quarantine = VersionedTable(spark, path + "/b"), VersionedTable(spark, path + "/q")
    deliver(spark, path + "/topic", [document(1, "d"), document(2, "d")])
    finish(landing.land_documents(kafka.file_stream(spark, path + "/topic"), bronze, quarantine, "crm_raw.c", path + "/cp"))
    assert bronze.read().schema["_doc"].dataType == T.StringType() and bronze.read().count() == 2


def land_topic(spark, path, checkpoint, bronze, quarantine):
    finish(landing.land_documents(kafka.file_stream(spark, path + "/topic"), bronze, quarantine, "crm_raw.c", f"{path}/{checkpoint}"))


def test_a_new_checkpoint_loses_nothing(spark, path):
    bronze, quarantine = VersionedTable(spark, path + "/b"), VersionedTable(spark, path + "/q")
    deliver(spark, path + "/topic", [document(1, "c", {"a": 1})])
    land_topic(spark, path, "one", bronze, quarantine)
    deliver(spark, path + "/topic", [document(2, "c", {"a": 2})], 1)
    land_topic(spark, path, "two", bronze, quarantine)
    # what is read again lands again; the state is the same
    assert sorted(r._id[-1] for r in bronze.read().collect()) == ["1", "1", "2"]
    state = VersionedTable(spark, path + "/s")
    run_pipeline(Pipeline("crm_raw.c", ("_id",)), bronze, state)
    assert state.read().count() == 2


def test_a_batch_that_comes_again_is_written_once(spark, path):
    bronze, quarantine = VersionedTable(spark, path + "/b"), VersionedTable(spark, path + "/q")
    deliver(spark, path + "/topic", [document(1, "c", {"a": 1})])
    land_topic(spark, path, "cp", bronze, quarantine)
    # as after a crash between the write and the checkpoint
    for name in os.listdir(path + "/cp/commits"):
        os.remove(f"{path}/cp/commits/{name}")
    land_topic(spark, path, "cp", bronze, quarantine)
    assert bronze.read().count() == 1


def test_two_streams_into_one_table(spark, path):
    table = VersionedTable(spark, path + "/log")
    for n in range(2):
        spark.createDataFrame([(f"line {n}-{i}", f"web{n}") for i in range(10)], "value string, server string").write.parquet(f"{path}/in{n}")
        lines = spark.readStream.schema("value string, server string").parquet(f"{path}/in{n}")
        finish(landing.land_access_log(lines, table, f"{path}/cp{n}"))
    assert rows(table.read().groupBy("server").count()) == [("web0", 10), ("web1", 10)]


def test_json_stream_evolves_and_sets_aside(spark, path):
    good, dead = VersionedTable(spark, path + "/g"), VersionedTable(spark, path + "/d")

    def land():
        finish(landing.land_json(kafka.file_stream(spark, path + "/topic"), good, dead, {"t": "float64"}, path + "/cp"))

    deliver(spark, path + "/topic", [(None, '{"t":"19.75","b":{"x":1}}'), (None, "nope"), (None, '{"t":"warm"}')])
    land()
    deliver(spark, path + "/topic", [(None, '{"t":20,"b":{"x":2,"y":"z"},"new":true}')], 3)
    land()
    assert rows(good.read(), "t", "b.x", "b.y", "new") == [(19.75, 1, None, None), (20.0, 2, "z", True)]
    assert rows(dead.read(), "reason") == [("contract",), ("not-json",)]
    deliver(spark, path + "/topic", [(None, '{"t":1,"b":{"x":"text"}}')], 4)
    with pytest.raises(Exception, match="do not fit one column"):
        land()
    assert good.read().count() == 2


def test_change_stream_lands_every_table(spark, path):
    from sediment.sources.catalog import TableRoot

    root, dead = TableRoot(spark, path + "/raw"), VersionedTable(spark, path + "/dead")

    def send(table, first, *after):
        bodies = [{"op": "c", "ts_ms": 1757600000000, "before": None, "after": a, "source": {"schema": "public", "table": table}} for a in after]
        deliver(spark, path + "/topic", [('{"id":1}', json.dumps(b)) for b in bodies] + [('{"id":1}', "garbage"), ('{"id":1}', None)], first, f"shop.public.{table}")

    def land():
        stream = kafka.source_topics(kafka.file_stream(spark, path + "/topic"), "shop")
        declared = {"shop_raw.orders": T.StructType().add("amount", "decimal(10,2)")}
        finish(landing.land_changes(stream, root.table, dead, "shop_raw.{table}", path + "/cp", declared))

    send("orders", 0, {"id": 1, "status": "a", "amount": 1.5}, {"id": 2, "status": "b", "amount": "abc"})
    send("items", 10, {"id": 1, "n": 5})
    land()
    send("items", 20, {"id": 2, "n": 6, "extra": {"x": True}}, {"id": "oops", "n": 1})
    send("later", 30, {"id": 1})
    land()
    assert root.tables() == ["shop_raw.items", "shop_raw.later", "shop_raw.orders"]
    orders, items = (root.table(f"shop_raw.{n}").read() for n in ("orders", "items"))
    assert orders.schema["amount"].dataType == T.DecimalType(10, 2) and rows(orders, "id", "status", "_cdc.key.id") == [(1, "a", 1)]
    assert rows(items, "id", "n", "extra.x") == [(1, 5, None), (2, 6, True)]
    assert rows(dead.read().groupBy("reason").count()) == [("bad-envelope", 4), ("bad-value", 2)]
    assert root.table("shop_raw.orders").head().version == 1  # no records, no version


def test_stream_merge_resumes(spark, path):
    state = VersionedTable(spark, path + "/silver")
    p = Pipeline("shop_raw.orders", ("id",), "copy-on-write", 2)
    for n, status in enumerate(("a", "b", "c")):
        df = log(spark, [(1, status, "1", "U", f"2026-01-0{n + 1} 00:00:00", n), (n + 10, status, "1", "I", "2026-01-01 00:00:00", n)])
        df.write.mode("append").parquet(path + "/log")
        stream = spark.readStream.schema(df.schema).parquet(path + "/log")
        finish(silver.stream_merge(p, stream, state, path + "/cp"))
    assert rows(state.read(), "id", "status") == [(1, "c"), (10, "a"), (11, "b"), (12, "c")]
    assert list(state.head().batches.values()) == [2]


def test_hourly_stream_agrees_with_the_batch(spark, path):
    schema = "ts timestamp, server string, code int, size long, agent string"
    df = spark.createDataFrame([(utc(2026, 1, 1 + i // 24, i % 24, 30), f"w{i % 2}", 200 + i % 400, i, "curl") for i in range(24 * 6)], schema)
    df.write.parquet(path + "/log")
    stream = spark.readStream.schema(df.schema).parquet(path + "/log")
    table = VersionedTable(spark, path + "/hours")
    query = web_stream.land_hours(stream, table, path + "/cp")
    finish(query)
    # the last hours are there too, though late rows may still change them
    assert rows(web_stream.newest_hours(table.read())) == rows(web_stream.hourly_counts(df)) and web_stream.late_rows(query) == 0


def test_rows_too_late_for_the_stream_are_counted(spark, path):
    schema, table = "ts timestamp, server string, code int, size long, agent string", VersionedTable(spark, path + "/hours")
    for when in (utc(2026, 1, 10), utc(2026, 1, 11), utc(2026, 1, 1)):
        spark.createDataFrame([(when, "w", 200, 1, "curl")], schema).coalesce(1).write.mode("append").parquet(path + "/log")
        query = web_stream.land_hours(spark.readStream.schema(schema).parquet(path + "/log"), table, path + "/cp")
        finish(query)
    assert web_stream.late_rows(query) == 1 and web_stream.newest_hours(table.read()).count() == 2


def test_guarded_pipeline(spark, path):
    bronze, state = tables(spark, path)
    p = Pipeline("shop_raw.orders", ("id",), "copy-on-write", 2, guard_ts="amount")
    for n, amount in ((0, "5"), (1, "3"), (2, "7")):
        bronze.append(log(spark, [(1, f"v{n}", amount, "U", f"2026-01-0{n + 1} 00:00:00", n)]), DAY)
        run_pipeline(p, bronze, state)
        assert rows(state.read(), "status") == [("v0",)] if n < 2 else [("v2",)]
    with pytest.raises(ValueError, match="copy-on-write"):
        Pipeline("shop_raw.orders", ("id",), guard_ts="amount")


def test_open_ended_objects_stay_one_column(spark, path):
    good, dead = VersionedTable(spark, path + "/g"), VersionedTable(spark, path + "/d")
    deliver(spark, path + "/topic", [(None, '{"a":1,"by_id":{"x7":{"n":1},"x9":2}}'), (None, '{"a":2,"by_id":[1]}'), (None, '{"a":3}')])
    finish(landing.land_json(kafka.file_stream(spark, path + "/topic"), good, dead, None, path + "/cp", whole=["by_id"]))
    assert rows(good.read(), "a", "by_id") == [(1, '{"x7":{"n":1},"x9":2}'), (2, "[1]"), (3, None)]


def test_a_stream_that_starts_anew_replaces_the_hours_it_counts_again(spark, path):
    schema, table = "ts timestamp, server string, code int, size long, agent string", VersionedTable(spark, path + "/hours")
    one = [(utc(2026, 1, 1, 10, m), "w", 200, 1, "curl") for m in (1, 2, 3)]

    def run(name):
        finish(web_stream.land_hours(spark.readStream.schema(schema).parquet(path + "/log"), table, f"{path}/{name}"))
        return rows(web_stream.newest_hours(table.read()), "hour", "requests")

    # the first stream needs three batches for two requests and an hour of its own
    for k, part in enumerate((one[:1], one[1:2], [(utc(2026, 1, 1, 12), "w", 200, 1, "curl")])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path + "/log")
        run("first")
    spark.createDataFrame(one[2:], schema).coalesce(1).write.mode("append").parquet(path + "/log")
    assert [n for _, n in run("second")] == [3, 1]
    assert [n for _, n in run("first")] == [3, 1]


def test_distinct_addresses_of_closed_hours(spark, path):
    schema, table = "ts timestamp, server string, remote string", VersionedTable(spark, path + "/hours")
    parts = [
        [(utc(2026, 1, 1, 0, 5), "w", "a"), (utc(2026, 1, 1, 0, 50), "w", "a"), (utc(2026, 1, 1, 0, 50), "v", "a"), (utc(2026, 1, 1, 0, 51), "w", None)],
        [(utc(2026, 1, 1, 0, 10), "w", "a"), (utc(2026, 1, 1, 0, 59), "w", "b"), (utc(2026, 1, 1, 1, 0), "w", "a"), (utc(2026, 1, 1, 3), "u", None)],
        [(utc(2026, 1, 1, 9), "w", "a")],
        [(utc(2026, 1, 1, 0, 20), "w", "c"), (utc(2026, 1, 1, 20), None, None)],
    ]
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path + "/log")
        finish(web_stream.land_distinct(spark.readStream.schema(schema).parquet(path + "/log"), table, path + "/cp", "2 hours"))
    got = [(str(h), s, n) for h, s, n in rows(table.read(), "hour", "server", "distinct_ip")]
    # a request that is too late for its closed hour is not counted any more
    assert sorted(got) == [("2026-01-01 00:00:00", "v", 1), ("2026-01-01 00:00:00", "w", 2), ("2026-01-01 01:00:00", "w", 1), ("2026-01-01 03:00:00", "u", 0), ("2026-01-01 09:00:00", "w", 1)]


def test_newest_changes_in_the_state_of_a_stream(spark, path):
    from sediment.operators.latest import current_state
    from sediment.streaming.latest import land_newest

    table, keys = VersionedTable(spark, path + "/newest"), ["id"]
    parts = [
        [(1, "a", "1", "I", "2026-01-01 00:00:00", 0), (2, "b", "1", "I", "2026-01-01 01:00:00", 1), (1, "c", "1", "U", "2026-01-01 02:00:00", 2), (None, "n", "1", "I", "2026-01-01 02:00:00", 3)],
        # a late change of the same day, one of a later day, a delete
        [(1, "late", "1", "U", "2026-01-01 01:30:00", 9), (2, None, "1", "D", "2026-01-02 00:00:00", 5), (3, "d", "1", "I", "2026-01-02 00:00:00", 6)],
        [(1, "e", "1", "U", "2026-01-20 00:00:00", 7)],
        # too late to count
        [(3, "lost", "1", "U", "2026-01-03 00:00:00", 8)],
    ]
    for part in parts:
        df = log(spark, part)
        df.coalesce(1).write.mode("append").parquet(path + "/log")
        query = land_newest(spark.readStream.schema(df.schema).parquet(path + "/log"), keys, table, path + "/cp")
        finish(query)
    assert rows(current_state(table.read(), keys), "id", "status") == [(1, "e"), (3, "d"), (None, "n")]
    # the second batch gives the first day's newest once more
    assert web_stream.late_rows(query) == 1 and table.read().where("id = 1").count() == 3
