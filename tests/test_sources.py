import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sediment.functions.contract import contract_types
from sediment.model import KAFKA_SCHEMA
from sediment.operators.schema import SchemaConflict
from sediment.sources import accesslog, backfill, envelopes, files, jsonstream, kafka, tables
from sediment.sources.versioned import VersionedTable
from tests.conftest import rows
from tests.helpers import utc

RECORD = "key string, value string, topic string, partition int, offset long, timestamp timestamp"


def records(spark, values, topic="shop.public.orders", key=None):
    return spark.createDataFrame([(key, v, topic, 0, i, utc(2026, 9, 11)) for i, v in enumerate(values)], RECORD)


# ---- topics and envelopes


def test_topics(spark):
    names = ["shop.public.orders", "shop.dlq", "shop.public.signal", "shopping.public.x", "shop.public.dlq", "xshop.public.a"]
    df = spark.createDataFrame([(None, None, n, 0, 0, None) for n in names], RECORD)
    assert rows(kafka.source_topics(df, "shop", "public.signal"), "topic") == [("shop.public.dlq",), ("shop.public.orders",)]


ROW = T.StructType().add("id", "long").add("status", "string").add("amount", T.DecimalType(10, 2))


def envelope(op, before=None, after=None, **more):
    return {"op": op, "ts_ms": 1757600000123, "before": before, "after": after, "source": {"schema": "public", "db": "shop", "table": "orders"}, **more}


def test_flatten(spark):
    row = {"id": 1, "status": "new", "amount": 10.5}
    values = [
        envelope("c", after=row),
        envelope("r", after=row),
        {"schema": {"x": 1}, "payload": envelope("u", before=row, after={**row, "status": "shipped"})},
        envelope("d", before={"id": 1, "status": None, "amount": 0}),
        envelope("u"),
    ]
    df = records(spark, [json.dumps(v) for v in values] + [None, "garbage", "{}"], key='{"id": 1}')
    events = envelopes.read_envelopes(df, ROW, ["id"], "shop_raw.{table}")
    out = envelopes.flatten(events)
    assert [tuple(r) for r in out.select("_cdc.op", "status", F.col("amount").cast("double"), "_cdc.offset").orderBy("offset").collect()] == [
        ("I", "new", 10.5, 0), ("I", "new", 10.5, 1), ("U", "shipped", 10.5, 2), ("D", None, 0.0, 3),
    ]
    assert rows(out, "_cdc.source", "_cdc.target", "_cdc.key.id")[0] == ("public.orders", "shop_raw.orders", 1)
    assert out.first()["_cdc"]["ts"].microsecond == 123000
    assert rows(envelopes.dead_letters(events), "_value", "reason") == [("garbage", "bad-envelope"), ("{}", "bad-envelope")]
    assert rows(envelopes.route_counts(events)) == [("shop_raw.orders", "D", 1), ("shop_raw.orders", "I", 2), ("shop_raw.orders", "U", 1)]


def test_values_that_do_not_fit_are_set_aside(spark):
    row = {"id": 1, "status": "new", "amount": "abc"}
    values = [envelope("c", after=row), envelope("c", after={**row, "id": "oops", "amount": 1}), envelope("c", after={**row, "amount": None}), {"op": "c", "after": row}, {**envelope("c"), "after": "text"}]
    events = envelopes.read_envelopes(records(spark, [json.dumps(v) for v in values], key='{"id": 1}'), ROW, ["id"], "shop_raw.{table}")
    assert rows(envelopes.dead_letters(events), "offset", "reason") == [(0, "bad-value"), (1, "bad-value"), (3, "no-table"), (4, "bad-row")]
    assert rows(envelopes.flatten(events), "id", "amount") == [(1, None)]


# ---- JSON streams

SENSOR = {"device_id": "d1", "temperature_c": 21.5, "humidity_pct": 40, "battery": {"level_pct": 80, "charging": True}}
CONTRACT = {"temperature_c": "float64", "humidity_pct": "int64"}


def sensor(**more):
    return json.dumps({**SENSOR, **more})


def test_contract(spark):
    df = records(spark, [sensor(), sensor(temperature_c="19.75"), sensor(temperature_c="warm"), "no json", sensor(humidity_pct=None), sensor(humidity_pct=40.9), "[1]"])
    schema = jsonstream.infer_schema(df, CONTRACT)
    assert schema.simpleString() == "struct<battery:struct<charging:boolean,level_pct:bigint>,device_id:string>"
    read = jsonstream.read_json(df, schema, CONTRACT)
    assert rows(jsonstream.good_rows(read), "temperature_c", "humidity_pct", "battery.level_pct") == [
        (19.75, 40, 80), (21.5, 40, 80), (21.5, 40, 80), (21.5, None, 80),
    ]
    assert rows(jsonstream.dead_letters(read), "offset", "reason") == [(2, "contract"), (3, "not-json"), (6, "not-json")]
    assert "_kafka_ts" in jsonstream.good_rows(read).columns


def test_undeclared_field_of_another_type_fails(spark):
    schema = T.StructType().add("a", "long")
    with pytest.raises(Exception, match="MALFORMED_RECORD|FAILFAST|malformed"):
        jsonstream.good_rows(jsonstream.read_json(records(spark, ['{"a":"x"}']), schema)).collect()
    with pytest.raises(SchemaConflict):
        jsonstream.evolve("t", schema, jsonstream.infer_schema(records(spark, ['{"a":"x"}'])))


def test_new_fields_become_columns(spark):
    old = jsonstream.infer_schema(records(spark, ['{"a":1,"s":{"x":1}}']))
    new = jsonstream.infer_schema(records(spark, ['{"b":"t","s":{"y":2.5},"n":null,"l":[1,2]}']))
    assert jsonstream.evolve("t", old, new).simpleString() == "struct<a:bigint,s:struct<x:bigint,y:double>,b:string,l:array<bigint>>"
    assert jsonstream.infer_schema(records(spark, ["nope"])).fields == []


def test_epoch_milliseconds_become_timestamps(spark):
    df = records(spark, ['{"ts":1757600000123,"remote":"1.1.1.1"}', '{"ts":"soon"}'])
    schema = jsonstream.infer_schema(df, millis=["ts"])
    read = jsonstream.read_json(df, schema, millis=["ts"])
    assert rows(jsonstream.good_rows(read), F.col("ts").cast("string"), "remote") == [("2025-09-11 14:13:20.123", "1.1.1.1")]
    assert rows(jsonstream.dead_letters(read), "reason") == [("contract",)]


def test_contract_types():
    assert contract_types({"a": "int32", "b": "boolean"}) == {"a": "int", "b": "boolean"}
    with pytest.raises(ValueError, match="decimal"):
        contract_types({"a": "decimal"})


# ---- access log

LINES = [
    '10.0.0.1 - - [11/Sep/2026:13:52:24 +0000] "GET /index.html HTTP/1.1" 200 512 "-" "curl/8.0"',
    '10.0.0.2 - bob [11/Sep/2026:16:52:25 +0300] "POST /api/orders HTTP/1.1" 201 87 "-" "Mozilla/5.0"',
    '10.0.0.3 - - [11/Sep/2026:13:52:26 +0000] "GET /missing HTTP/1.1" 404 - "" "curl/8.0"',
    '10.0.0.4 - - [11/Sep/2026:13:52:27 +0000] "GET /main-format HTTP/1.1" 200 5000000000 "-" "curl/8.0" "-"',
    '10.0.0.5 - - [11/Sep/2026:13:52:28 +0000] "GET /short" 200 1',
    '10.0.0.6 - - [11/Sep/2026:13:52:29 +0000] "GET /odd\u001fpath HTTP/1.1" 200 1 "-" "a\u001fb"',
    "something else",
]


def test_access_lines(spark):
    df = spark.createDataFrame([(line,) for line in LINES], "value string")
    out = accesslog.parse_lines(df, "web01", F.lit(utc(2026, 9, 12)))
    got = {r["remote"]: r for r in out.collect()}
    assert len(got) == 7 and {r["server"] for r in got.values()} == {"web01"}
    assert str(got["10.0.0.1"]["ts"]) == "2026-09-11 13:52:24" and str(got["10.0.0.2"]["ts"]) == "2026-09-11 13:52:25"
    assert (got["10.0.0.2"]["user"], got["10.0.0.2"]["method"], got["10.0.0.2"]["path"], got["10.0.0.2"]["code"]) == ("bob", "POST", "/api/orders", 201)
    assert (got["10.0.0.3"]["size"], got["10.0.0.3"]["referer"], got["10.0.0.3"]["agent"]) == (None, None, "curl/8.0")
    assert got["10.0.0.4"]["size"] == 5_000_000_000 and got["10.0.0.4"]["agent"] == "curl/8.0"
    assert (got["10.0.0.5"]["path"], got["10.0.0.5"]["agent"]) == ("/short", None)
    assert (got["10.0.0.6"]["path"], got["10.0.0.6"]["agent"]) == ("/odd\u001fpath", "a\u001fb")
    assert (got[None]["log"], got[None]["code"], str(got[None]["ts"])) == ("something else", None, "2026-09-12 00:00:00")
    assert all(r["log"] is None for k, r in got.items() if k)
    assert rows(accesslog.unparsed(out), "log") == [("something else",)]


def test_log_files(spark, path):
    spark.createDataFrame([(LINES[0],)], "value string").write.text(path + "/logs")
    assert rows(accesslog.read_log(spark, path + "/logs", "w"), "remote", "code", "server") == [("10.0.0.1", 200, "w")]


# ---- files, tables, first load


def test_read_files(spark, path):
    spark.createDataFrame([(1, "a")], "id int, v string").write.option("header", "true").csv(path + "/c")
    spark.createDataFrame([(1, "a")], "id int, v string").write.parquet(path + "/p")
    assert files.read_files(spark, path + "/c", "csv").dtypes == [("id", "string"), ("v", "string")]
    assert files.read_files(spark, path + "/p", "parquet").dtypes == [("id", "int"), ("v", "string")]
    with pytest.raises(ValueError, match="orc"):
        files.read_files(spark, path, "orc")


@pytest.fixture
def namespace(spark, path):
    name = "n" + str(abs(hash(path)))[:12]
    spark.sql(f"CREATE NAMESPACE {name} LOCATION '{path}/warehouse'")
    return name


def test_catalog_tables(spark, path, namespace):
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string").write.parquet(path + "/p")
    assert files.register(spark, path + "/p", "parquet", f"{namespace}.t") == 2
    assert files.register(spark, path + "/p", "parquet", f"{namespace}.t") == 2
    df = spark.table(f"{namespace}.t")
    tables.create_as(df.where("id = 1"), f"{namespace}.u")
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        tables.create_as(df, f"{namespace}.u")
    tables.append(df.where("id = 2"), f"{namespace}.u")
    tables.create_view(spark, f"{namespace}.w", f"SELECT id FROM {namespace}.t")
    assert spark.table(f"{namespace}.u").count() == 2 and spark.table(f"{namespace}.w").count() == 2
    assert tables.tables_in(spark, namespace) == [f"{namespace}.{n}" for n in "tuw"]
    assert tables.all_tables(spark, [namespace, "absent"], ["x_raw.y"]) == [f"{namespace}.t", f"{namespace}.u", f"{namespace}.w", "x_raw.y"]
    assert f"{namespace}.t" in tables.all_tables(spark)
    assert tables.table_or_none(spark, f"{namespace}.absent") is None
    with pytest.raises(Exception, match="PARSE"):
        tables.table_or_none(spark, "a b")
    tables.drop_with_data(spark, f"{namespace}.t")
    assert tables.table_or_none(spark, f"{namespace}.t") is None
    tables.drop_with_data(spark, f"{namespace}.t")


def test_partition_overwrite(spark, path):
    tables.overwrite_partitions(spark.createDataFrame([("a", 1), ("b", 2)], "day string, n int"), path + "/t", ["day"])
    tables.overwrite_partitions(spark.createDataFrame([("b", 3), ("c", 4)], "day string, n int"), path + "/t", ["day"])
    assert rows(spark.read.parquet(path + "/t"), "day", "n") == [("a", 1), ("b", 3), ("c", 4)]


def test_unknown_tables(spark):
    def named(*names):
        return spark.createDataFrame([(n,) for n in names], "table string")

    assert rows(tables.unknown_tables(named("a", "b", "c"), named("a"), named("c"))) == [("b",)]


def test_chunks_cover_everything_once(spark):
    df = spark.range(1000).withColumn("id", F.when(F.col("id") % 100 == 0, None).otherwise(F.col("id")))
    ranges = backfill.key_ranges(df, "id", 7)
    parts = [backfill.chunk(df, "id", *b) for b in ranges]
    assert len(ranges) == 7 and sum(p.count() for p in parts) == 1000
    assert backfill.key_ranges(df, "id", 1) == [(None, None)]


def test_cut_short_load_goes_on(spark, path, monkeypatch):
    table = VersionedTable(spark, path + "/t")
    df = spark.range(100).withColumn("v", F.lit("x"))
    write, calls = table.write_units, []

    def failing(*args, **kwargs):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return write(*args, **kwargs)

    monkeypatch.setattr(table, "write_units", failing)
    with pytest.raises(RuntimeError):
        backfill.load_in_chunks(table, df, ["id"], 4, utc(2026, 1, 1), "s", "t")
    # rows that arrived since then belong to the last range, which was still open
    more = df.unionByName(spark.range(100, 110).withColumn("v", F.lit("x")))
    assert backfill.load_in_chunks(table, more, ["id"], 4, utc(2026, 1, 1), "s", "t") == 2
    assert table.read().count() == 110 and table.read().select("id").distinct().count() == 110


def test_a_load_can_be_asked_for_again(spark, path):
    table, day = VersionedTable(spark, path + "/t"), utc(2026, 1, 1)
    for kind in ("decimal(20,3)", "date", "string", "timestamp"):
        at = VersionedTable(spark, f"{path}/{kind[:4]}")
        df = spark.range(1, 60).select((F.expr("date_add(date'2026-01-01', cast(id as int))") if kind in ("date", "timestamp") else F.col("id")).cast(kind).alias("id"))
        assert backfill.load_in_chunks(at, df, ["id"], 3, day, "s", "t") == 3
        assert backfill.load_in_chunks(at, df, ["id"], 3, day, "s", "t") == 0
        assert at.read().count() == 59 and at.read().select("id").distinct().count() == 59
    df = spark.range(40).withColumn("v", F.lit("x"))
    assert backfill.load_in_chunks(table, df, ["id"], 2, day, "s", "t") == 2
    more = spark.range(70).withColumn("v", F.lit("y"))
    assert backfill.load_in_chunks(table, more, ["id"], 2, utc(2026, 2, 1), "s", "t") == 2
    assert table.read().count() == 110 and table.read().where("v = 'y'").count() == 70


def test_copied_rows_yield_to_live_changes(spark):
    from sediment.operators.latest import current_state
    from tests.helpers import log

    live = log(spark, [(1, "live", "1", "U", "2026-01-01 00:00:00", 0)])
    copied = backfill.as_changes(live.drop("_cdc").withColumn("status", F.lit("copied")), ["id"], utc(2026, 1, 1), "s", "t")
    both = copied.unionByName(copied).unionByName(live)
    assert rows(current_state(both, ["id"]), "status") == [("live",)]


def test_kafka_schema_of_file_stream(spark, path):
    spark.createDataFrame([], KAFKA_SCHEMA).write.parquet(path + "/k")
    assert kafka.file_stream(spark, path + "/k", 1).schema == KAFKA_SCHEMA
    with pytest.raises(ValueError):
        kafka.kafka_stream(spark)
