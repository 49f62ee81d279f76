"""Schemaless JSON event streams with an optional contract for some of their fields."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sediment.functions import jsonvalues as J
from sediment.functions.contract import contract_types
from sediment.functions.rows import computed
from sediment.operators.schema import merge_schemas

ARRIVAL = "_kafka_ts"


def infer_schema(
    records: DataFrame, contract: Mapping[str, str] | None = None, millis: Sequence[str] = (), whole: Sequence[str] = ()
) -> T.StructType:
    """Schema of the undeclared fields seen in ``records``; one aggregate, one row to the driver.

    Nested objects become structs, whole numbers bigint, other numbers double.  A field that was only ever
    null has no type yet and is left out.
    """
    seen = computed(records.select("value"), v=J.variant(F.col("value"))).where(J.is_object(F.col("v")))
    text = seen.agg(F.schema_of_variant_agg("v").alias("s")).first()["s"]
    if text in (None, "VOID") or not text.startswith("OBJECT<"):
        return T.StructType([])
    found = T.DataType.fromDDL(text.replace("OBJECT<", "STRUCT<"))
    declared = {*contract_types(contract), *millis, *whole}
    return T.StructType([T.StructField(f.name, _column_type(f.dataType), True) for f in _typed(found) if f.name not in declared])


def _typed(schema: T.StructType) -> list[T.StructField]:
    return [f for f in schema.fields if not isinstance(f.dataType, T.NullType)]


def _column_type(dtype: T.DataType) -> T.DataType:
    if isinstance(dtype, T.StructType):
        return T.StructType([T.StructField(f.name, _column_type(f.dataType), True) for f in _typed(dtype)])
    if isinstance(dtype, T.ArrayType):
        inner = dtype.elementType
        return T.ArrayType(T.StringType() if isinstance(inner, T.NullType) else _column_type(inner))
    if isinstance(dtype, T.DecimalType):
        return T.DoubleType()
    return T.StringType() if isinstance(dtype, T.VariantType) else dtype


def evolve(table: str, stored: T.StructType, batch: T.StructType) -> T.StructType:
    """Stored schema widened by name; a field whose type changed otherwise raises ``SchemaConflict``."""
    return merge_schemas(table, [stored, batch])


def read_json(
    records: DataFrame,
    schema: T.StructType,
    contract: Mapping[str, str] | None = None,
    millis: Sequence[str] = (),
    whole: Sequence[str] = (),
) -> DataFrame:
    """Kafka-shaped records with ``reason``, the event's columns in ``_row`` and its arrival time.

    A declared field is converted (``"19.75"`` to 19.75); when its value does not convert, the record's reason
    is ``contract`` and the flow goes on.  A text that is no JSON object is ``not-json``.  Undeclared fields are
    read strictly by ``schema``: a value of another type fails the batch, because nobody said what it means.
    Fields in ``millis`` hold epoch milliseconds and become timestamps.  Fields in ``whole`` become their JSON text.
    """
    declared = {**contract_types(contract), **dict.fromkeys(millis, "bigint")}
    undeclared = T.StructType([f for f in schema.fields if f.name not in declared and f.name not in whole])
    opened = computed(records, _v=J.variant(F.col("value")))
    fields = computed(
        opened,
        _is_event=J.is_object(F.col("_v")),
        _given=F.struct(F.lit(0), *(J.json_type(J.member(F.col("_v"), n)).alias(n) for n in declared)),
        _typed=F.struct(F.lit(0), *(J.member(F.col("_v"), n, kind).alias(n) for n, kind in declared.items())),
        _whole=F.struct(F.lit(0), *(F.to_json(J.member(F.col("_v"), n)).alias(n) for n in whole)),
    )
    broken = F.lit(False)
    for name in declared:
        given = F.coalesce(F.col(f"_given.`{name}`") != "VOID", F.lit(False))
        broken = broken | (given & F.col(f"_typed.`{name}`").isNull())
    judged = fields.withColumn("reason", F.when(~F.col("_is_event"), "not-json").when(broken, "contract"))
    columns = [
        (F.timestamp_millis(F.col(f"_typed.`{n}`")) if n in millis else F.col(f"_typed.`{n}`")).alias(n) for n in declared
    ]
    if undeclared.fields:
        body = F.from_json("value", undeclared, {"mode": "FAILFAST"})
        judged = computed(judged, _body=F.when(F.col("reason").isNull(), body))
        columns += [F.col(f"_body.`{f.name}`").alias(f.name) for f in undeclared.fields]
    columns += [F.col(f"_whole.`{n}`").alias(n) for n in whole]
    columns.append(F.col("timestamp").alias(ARRIVAL))
    return judged.select("key", "value", "topic", "partition", "offset", "timestamp", "reason", F.struct(*columns).alias("_row"))


def good_rows(read: DataFrame) -> DataFrame:
    """Rows of the stream's table."""
    return read.where(F.col("reason").isNull()).select("_row.*")


def dead_letters(read: DataFrame) -> DataFrame:
    """Records that broke the contract or are no JSON."""
    return read.where(F.col("reason").isNotNull()).select("topic", "partition", "offset", "timestamp", "key", "value", "reason")
