"""Relational change events: Kafka records with an ``op/before/after/source/ts_ms`` envelope."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sediment.functions import jsonvalues as J
from sediment.functions.rows import computed
from sediment.model import DELETE, INSERT, META, UPDATE
from sediment.operators.schema import SchemaConflict, merge_schemas


def open_envelopes(records: DataFrame, target: str) -> DataFrame:
    """Each record with its parsed ``_event``, its row and key as JSON text, and the ``reason`` it cannot be used, if any.

    ``target`` is the name pattern, e.g. ``shop_raw.{table}``, or ``shop_raw.{schema}_{table}`` where two schemas have
    tables of one name.  The envelope may be wrapped in ``{"schema": …, "payload": …}``.  ``reason`` is null for usable records; ``tombstone`` records carry nothing to
    store.  No table or column needs to be known.
    """
    envelope = T.StructType(
        [
            T.StructField("op", T.StringType()),
            T.StructField("ts_ms", T.LongType()),
            T.StructField("before", T.StringType()),
            T.StructField("after", T.StringType()),
            T.StructField("source", J.text_members("db", "schema", "table")),
        ]
    )
    opened = computed(
        records, _values=J.objects(F.col("value"), _wrapped(envelope)), _keys=J.objects(F.col("key"), J.text_members("payload"))
    )
    event = _payload(J.the_object(F.col("_values")), envelope)
    events = computed(opened, _event=event, _key_text=F.coalesce(J.the_object(F.col("_keys"))["payload"], F.col("key")))
    row = F.when(F.col("_event.op") == "d", F.col("_event.before")).otherwise(F.col("_event.after"))
    events = events.withColumn("_row_text", row).drop("_values", "_keys")
    reason = (
        F.when(F.col("value").isNull(), "tombstone")
        .when(F.col("_event.op").isNull(), "bad-envelope")
        .when(F.col("_row_text").isNull(), "tombstone")
        .when(F.col("_event.source.table").isNull(), "no-table")
        .when(~J.is_object(J.variant(F.col("_row_text"))), "bad-row")
    )
    source = F.col("_event.source")
    named = F.replace(F.lit(target), F.lit("{table}"), source["table"])
    if "{schema}" in target:
        named = F.replace(named, F.lit("{schema}"), F.coalesce(source["schema"], source["db"], F.lit("")))
    return events.withColumn("reason", reason).withColumn("_target", named)


def typed_rows(events: DataFrame, row: T.StructType, keys: Sequence[str]) -> DataFrame:
    """Opened events with ``_row`` and ``_key`` read by a table's schema.

    A value that does not fit its column makes the record's reason ``bad-value``; it is never turned into a null.
    """
    key = T.StructType([f for f in row.fields if f.name in keys])
    texts = J.text_members(*row.fieldNames())
    read = computed(
        events,
        _row=J.the_object(J.objects(F.col("_row_text"), row)),
        _given=J.the_object(J.objects(F.col("_row_text"), texts)),
        _key=J.the_object(J.objects(F.col("_key_text"), key)),
    )
    lost = F.lit(False)
    for name in row.fieldNames():
        lost = lost | (F.col(f"_given.`{name}`").isNotNull() & F.col(f"_row.`{name}`").isNull())
    return read.withColumn("reason", F.coalesce("reason", F.when(lost | F.col("_row").isNull(), "bad-value")))


def read_envelopes(records: DataFrame, row: T.StructType, keys: Sequence[str], target: str) -> DataFrame:
    """The events of one table whose schema is known: :func:`open_envelopes` and :func:`typed_rows`."""
    return typed_rows(open_envelopes(records, target), row, keys)


def row_schema(table: str, declared: T.StructType, stored: T.StructType, seen: T.StructType) -> T.StructType:
    """The columns of a table's rows: declared ones as they are, stored ones widened where what was seen allows, new ones.

    A stored column keeps its type where that does not hold what was seen; the values that do not fit are set aside.
    """
    known = merge_schemas(table, [declared, T.StructType([f for f in stored.fields if f.name not in declared.fieldNames()])])
    columns = {f.name: f for f in known.fields}
    for f in seen.fields:
        if f.name in declared.fieldNames():
            continue
        try:
            columns[f.name] = merge_schemas(table, [T.StructType([columns[f.name]] if f.name in columns else []), T.StructType([f])])[f.name]
        except SchemaConflict:
            continue
    return T.StructType(list(columns.values()))


def _wrapped(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("payload", schema)])


def _payload(read: Column, schema: T.StructType) -> Column:
    """The wrapped object when there is one, else the outer one."""
    outer = F.struct(*(read[f.name].alias(f.name) for f in schema.fields))
    return F.coalesce(read["payload"], F.when(read.isNotNull(), outer))


def flatten(events: DataFrame) -> DataFrame:
    """Raw-table rows of the usable events of :func:`read_envelopes`: business columns and ``_cdc``.

    Created and read rows are inserts.  A delete carries the ``before`` image as delivered, usually the key
    with the other columns null.
    """
    op = F.col("_event.op")
    source = F.concat_ws(".", F.coalesce(F.col("_event.source.schema"), F.col("_event.source.db")), F.col("_event.source.table"))
    meta = F.struct(
        F.when(op == "u", UPDATE).when(op == "d", DELETE).otherwise(INSERT).alias("op"),
        F.timestamp_millis("_event.ts_ms").alias("ts"),
        F.col("offset"),
        source.alias("source"),
        F.col("_target").alias("target"),
        F.col("_key").alias("key"),
    )
    return events.where(F.col("reason").isNull()).select("_row.*", meta.alias(META))


def dead_letters(events: DataFrame) -> DataFrame:
    """Records set aside: everything with a reason but the tombstones."""
    return events.where(F.col("reason").isNotNull() & (F.col("reason") != "tombstone")).select(
        F.col("key").alias("_key"), F.col("value").alias("_value"), "reason", F.col("timestamp").alias("ts"), "partition", "offset"
    )


def route_counts(events: DataFrame) -> DataFrame:
    """Usable events per target table and operation."""
    return flatten(events).groupBy(F.col(f"{META}.target").alias("target"), F.col(f"{META}.op").alias("op")).count()
