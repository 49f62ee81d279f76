import json

import pytest

from sediment.sources.documents import bronze_rows, classify, quarantine_rows
from tests.conftest import rows

OID = json.dumps({"id": json.dumps({"$oid": "000000000000000000000001"})})
AFTER = json.dumps({"_id": {"$oid": "000000000000000000000001"}, "name": "Ada", "tags": ["a", "b"]})
MS = 1757600000000


def event(op="c", after=AFTER, before=None, ts=MS, **more):
    return json.dumps({"op": op, "ts_ms": ts, "after": after, "before": before, "source": {"db": "crm"}, **more})


def run(spark, key, value):
    records = spark.createDataFrame(
        [(key, value, "crm.crm.customers", 0, 7, None)], "key string, value string, topic string, partition int, offset long, timestamp timestamp"
    )
    return classify(records).first()


@pytest.mark.parametrize(
    "key,expected",
    [
        (OID, "000000000000000000000001"),
        (json.dumps({"id": json.dumps("cust-42")}), "cust-42"),
        (json.dumps({"id": json.dumps(7)}), "7"),
        (json.dumps({"id": 7}), "7"),
        (json.dumps({"id": "4.5"}), "4.5"),
        (json.dumps({"id": "1.0"}), "1.0"),
        (json.dumps({"id": "12345678901234567890"}), "12345678901234567890"),
        (json.dumps({"id": "true"}), "True"),
        (json.dumps({"id": {"$oid": "ab"}}), "ab"),
        (json.dumps({"id": json.dumps({"b": 1, "a": 2})}), '{"a":2,"b":1}'),
    ],
)
def test_ids(spark, key, expected):
    r = run(spark, key, event())
    assert (r["kind"], r["_id"]) == ("bronze", expected)


@pytest.mark.parametrize("key", [None, "not json", "[1]", "{}", '{"id":null}', '{"id":"null"}', '{"id":"not json"}', "7"])
def test_no_key(spark, key):
    r = run(spark, key, event())
    assert (r["kind"], r["reason"]) == ("quarantine", "no-key")


@pytest.mark.parametrize(
    "value",
    ["garbage", "", "{}", "[]", "7", "null", '{"op":null}', event(op="x"), event(op="t"), "[" + event() + "]", event() + " tail", event() + event(), event()[:-1]],
)
def test_bad_envelope(spark, value):
    r = run(spark, OID, value)
    assert (r["kind"], r["reason"]) == ("quarantine", "bad-envelope")


@pytest.mark.parametrize("ts", [None, "1757600000000", 1.5, [1], {"a": 1}])
def test_no_ts(spark, ts):
    r = run(spark, OID, event(ts=ts))
    assert (r["kind"], r["reason"]) == ("quarantine", "no-ts")


def test_order_of_reasons(spark):
    assert run(spark, None, "garbage")["reason"] == "bad-envelope"
    assert run(spark, None, event(ts=None))["reason"] == "no-key"
    assert run(spark, OID, event("u", after=None, ts=None))["reason"] == "no-ts"
    assert run(spark, OID, event("u", after=None))["reason"] == "after-null"


def test_tombstone_is_dropped(spark):
    assert run(spark, OID, None)["kind"] == "drop"
    assert run(spark, None, None)["kind"] == "drop"


@pytest.mark.parametrize("code,op", [("c", "I"), ("r", "I"), ("u", "U")])
def test_writes(spark, code, op):
    r = run(spark, OID, event(code))
    assert (r["kind"], r["op"], r["_doc"], r["ts_ms"]) == ("bronze", op, AFTER, MS)


def test_deletes(spark):
    assert tuple(run(spark, OID, event("d", after=None)))[-3:] == (None, "D", MS)
    assert run(spark, OID, event("d", after=None, before=AFTER))["_doc"] == AFTER
    assert run(spark, OID, event("u", after=""))["_doc"] == ""


def test_last_of_two_equal_members_counts(spark):
    assert run(spark, OID, '{"op":"x","op":"u","ts_ms":1,"after":"{}"}')["op"] == "U"


def test_tables(spark):
    records = spark.createDataFrame(
        [(OID, event(), "t", 0, 1, None), (OID, "garbage", "t", 1, 2, None), (OID, None, "t", 0, 3, None)],
        "key string, value string, topic string, partition int, offset long, timestamp timestamp",
    )
    classified = classify(records)
    out = bronze_rows(classified, "crm_raw.customers")
    assert out.schema["_cdc"].dataType.simpleString() == (
        "struct<op:string,ts:timestamp,offset:bigint,source:string,target:string,key:struct<_id:string>>"
    )
    assert rows(out, "_cdc.source", "_cdc.target", "_cdc.key._id", "_cdc.offset") == [("t", "crm_raw.customers", "000000000000000000000001", 1)]
    assert rows(quarantine_rows(classified), "_value", "reason", "partition", "offset") == [("garbage", "bad-envelope", 1, 2)]


def test_text_is_parsed_once(spark):
    records = spark.createDataFrame([(OID, event(), "t", 0, 1, None)], "key string, value string, topic string, partition int, offset long, timestamp timestamp")
    plan = quarantine_rows(classify(records))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json") == 2
