import pytest
from pyspark.sql import types as T

from sediment.operators.schema import SchemaConflict, cast_columns, conform, merge_schemas, plan_changes, state_schema, widens
from tests.helpers import log


def struct(ddl):
    return T.StructType.fromDDL(ddl)


def kind(ddl):
    return struct(f"c {ddl}")["c"].dataType


@pytest.mark.parametrize(
    "old,new,safe",
    [
        ("int", "bigint", True), ("smallint", "int", True), ("tinyint", "bigint", True), ("float", "double", True),
        ("decimal(10,2)", "decimal(38,2)", True), ("string", "string", True),
        ("bigint", "int", False), ("decimal(10,2)", "decimal(10,3)", False), ("decimal(10,2)", "decimal(9,2)", False),
        ("string", "timestamp", False), ("int", "double", False), ("int", "decimal(20,0)", False), ("int", "string", False),
        ("double", "float", False),
    ],
)
def test_widening(spark, old, new, safe):
    assert widens(kind(old), kind(new)) is safe


def test_plan(spark):
    stored = struct("id bigint, status string, amount decimal(10,2)")
    wanted = struct("id bigint, status string, amount decimal(38,2), note string")
    plan = plan_changes("shop.orders", stored, wanted)
    assert [f.name for f in plan.added] == ["note"] and [f.name for f in plan.widened] == ["amount"]
    assert plan.applied_to(stored).simpleString() == "struct<id:bigint,status:string,amount:decimal(38,2),note:string>"
    assert not plan_changes("s", struct("id bigint, legacy string"), struct("id bigint"))
    with pytest.raises(SchemaConflict, match="id"):
        plan_changes("s", struct("id bigint"), struct("id string"))


def test_state_schema_drops_meta_and_casts(spark):
    df = log(spark, [(1, "2026-01-01 00:00:00", "1", "I", "2026-01-01 00:00:00", 1)])
    assert state_schema(df, {"status": "timestamp"}).simpleString() == "struct<id:bigint,status:timestamp,amount:decimal(10,2)>"
    with pytest.raises(ValueError, match="nope"):
        cast_columns(df.schema, {"nope": "int"})


def test_bad_cast_fails_the_job(spark):
    df = log(spark, [(1, "no time", "1", "I", "2026-01-01 00:00:00", 1)])
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        df.select(*cast_columns(df.schema, {"status": "timestamp"})).collect()


def test_conform(spark):
    df = spark.createDataFrame([(1, 1.5)], "id int, x float")
    out = conform(df, struct("id bigint, x double, note string"))
    assert out.schema.simpleString() == "struct<id:bigint,x:double,note:string>"
    assert [tuple(r) for r in out.collect()] == [(1, 1.5, None)]


def test_merge_nested(spark):
    merged = merge_schemas("t", [struct("a int, s struct<x: bigint>"), struct("s struct<y: string, x: bigint>, a bigint")])
    assert merged.simpleString() == "struct<a:bigint,s:struct<x:bigint,y:string>>"
    with pytest.raises(SchemaConflict, match=r"t\.s\.x"):
        merge_schemas("t", [struct("s struct<x: bigint>"), struct("s struct<x: string>")])
