"""Inputs of the registered queries, derived by Spark from the given tables.

Every function reads a whole table.  Each has a counterpart of the same name among the SQL texts in
``workload/oracle.py``.  Remainders of ``event_id`` decide which rows carry a fault or which delivery they came
with; they never leave rows out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.model import DELETE, INSERT, META, UPDATE
from sediment.sources.accesslog import parse_lines


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def by_type(**values) -> Column:
    """A value per event type."""
    return F.coalesce(*(F.when(F.col("event_type") == t, F.lit(v)) for t, v in values.items()))


def every(n: int) -> Column:
    return F.col("event_id") % n == 0


def text(column: str) -> Column:
    return F.col(column).cast("string")


# ---- change log -----------------------------------------------------------------------------------------


def changes(spark: SparkSession, sf: str) -> DataFrame:
    """Raw-table rows keyed by user."""
    op = F.when(F.col("event_type") == "signup", INSERT).when(F.col("event_type") == "error", DELETE).otherwise(UPDATE)
    return table(spark, sf, "events").select(
        F.col("user_id").alias("id"),
        F.col("event_type").alias("status"),
        F.col("value").cast("decimal(18,2)").alias("amount"),
        F.struct(
            op.alias("op"),
            F.col("ts").cast("timestamp").alias("ts"),
            F.col("event_id").alias("offset"),
            F.lit("app.public.events").alias("source"),
            F.lit("app_raw.events").alias("target"),
            F.struct(F.col("user_id").alias("id")).alias("key"),
        ).alias(META),
    )


def order_line_changes(spark: SparkSession, sf: str) -> DataFrame:
    """A change log over the largest table: each line of an order replaces the order's state."""
    op = F.when(F.col("l_returnflag") == "R", DELETE).otherwise(UPDATE)
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"),
        F.col("l_linestatus").alias("status"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"),
        F.struct(
            op.alias("op"),
            F.col("l_shipdate").cast("timestamp").alias("ts"),
            (F.col("l_linenumber").cast("bigint") * 1000000000 + F.col("l_partkey")).alias("offset"),
        ).alias(META),
    )


# ---- records --------------------------------------------------------------------------------------------


def _record(key: Column, value: Column, topic: Column) -> list[Column]:
    return [
        key.alias("key"),
        value.alias("value"),
        topic.alias("topic"),
        (F.col("event_id") % 4).cast("int").alias("partition"),
        F.col("event_id").alias("offset"),
        F.col("ts").cast("timestamp").alias("timestamp"),
    ]


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Kafka-shaped records, one topic per event type."""
    topic = F.concat(F.lit("app.public."), F.col("event_type"))
    return table(spark, sf, "events").select(*_record(text("user_id"), F.col("props"), topic))


def _millis() -> Column:
    return F.unix_millis(F.col("ts").cast("timestamp")).cast("string")


def document_events(spark: SparkSession, sf: str) -> DataFrame:
    """Document change events with every kind of fault."""
    oid = F.lpad(text("user_id"), 24, "0")
    key = (
        F.when(every(23), None)
        .when(every(29), F.concat(F.lit('{"id":"'), text("user_id"), F.lit('"}')))
        .when(every(31), F.concat(F.lit('{"id":"\\"cust-'), text("user_id"), F.lit('\\""}')))
        .otherwise(F.concat(F.lit('{"id":"{\\"$oid\\":\\"'), oid, F.lit('\\"}"}')))
    )
    document = F.concat(F.lit('{"name":"'), F.col("event_type"), F.lit('","v":'), text("event_id"), F.lit("}"))
    quoted = F.concat(F.lit('"'), F.replace(document, F.lit('"'), F.lit('\\"')), F.lit('"'))
    removed = F.col("event_type") == "error"
    value = (
        F.when(every(37), None)
        .when(every(41), "garbage")
        .otherwise(
            F.concat(
                F.lit('{"op":"'),
                F.when(every(43), "x").otherwise(by_type(signup="c", view="r", purchase="u", click="u", error="d")),
                F.lit('","ts_ms":'),
                F.when(every(47), "null").otherwise(_millis()),
                F.lit(',"after":'),
                F.when(removed | every(53), "null").otherwise(quoted),
                F.lit(',"before":'),
                F.when(removed & every(2), quoted).otherwise("null"),
                F.lit("}"),
            )
        )
    )
    return table(spark, sf, "events").select(*_record(key, value, F.lit("crm.crm.customers")))


def envelopes(spark: SparkSession, sf: str) -> DataFrame:
    """Relational change events, one table per event type, some wrapped with their schema."""
    row = F.concat(
        F.lit('{"id":'), text("user_id"), F.lit(',"status":"'), F.col("event_type"), F.lit('","amount":'), text("value"), F.lit("}")
    )
    key_only = F.concat(F.lit('{"id":'), text("user_id"), F.lit(',"status":null,"amount":0}'))
    removed = F.col("event_id") % 5 == 4
    body = F.concat(
        F.lit('{"op":"'),
        F.when(removed, "d").when(every(5), "c").when(every(3), "r").otherwise("u"),
        F.lit('","ts_ms":'),
        _millis(),
        F.lit(',"before":'),
        F.when(removed, key_only).otherwise("null"),
        F.lit(',"after":'),
        F.when(removed, "null").otherwise(row),
        F.lit(',"source":{"db":"app","schema":"public","table":"'),
        F.col("event_type"),
        F.lit('"}}'),
    )
    wrapped = F.concat(F.lit('{"schema":{},"payload":'), body, F.lit("}"))
    value = F.when(every(37), None).when(every(41), "garbage").when(every(7), wrapped).otherwise(body)
    key = F.concat(F.lit('{"id":'), text("user_id"), F.lit("}"))
    return table(spark, sf, "events").select(*_record(key, value, F.concat(F.lit("app.public."), F.col("event_type"))))


def json_events(spark: SparkSession, sf: str) -> DataFrame:
    """Schemaless JSON events: numbers as numbers or text, words for numbers, and texts that are no JSON."""
    value = (
        F.when(every(97), '"twenty-two"')
        .when(every(5), F.concat(F.lit('"'), text("value"), F.lit('"')))
        .otherwise(text("value"))
    )
    body = F.concat(
        F.lit('{"user_id":'), text("user_id"), F.lit(',"value":'), value,
        F.lit(',"kind":"'), F.col("event_type"), F.lit('","props":'), F.col("props"), F.lit("}"),
    )
    topic = F.concat(F.lit("app."), F.col("event_type"), F.lit(".events"))
    return table(spark, sf, "events").select(*_record(F.lit(None).cast("string"), F.when(every(101), "not json").otherwise(body), topic))


CONTRACT = {"user_id": "int64", "value": "float64"}


# ---- access log -----------------------------------------------------------------------------------------


def access_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Log lines: combined, every 7th in the main form, every 50th broken; a size may be a dash."""
    line = F.concat(
        F.lit("10.0."), (F.col("user_id") % 256).cast("string"), F.lit("."), (F.col("event_id") % 256).cast("string"),
        F.lit(" - - ["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "'),
        F.when(every(2), "GET").otherwise("POST"),
        F.lit(" /"), F.col("event_type"), F.lit("/u"), text("user_id"), F.lit("/"), text("event_id"), F.lit("?k="), text("event_id"),
        F.lit(' HTTP/1.1" '),
        by_type(view="200", signup="201", click="404", purchase="401", error="500"),
        F.lit(" "), F.when(every(11), "-").otherwise((F.col("event_id") % 5000).cast("string")),
        F.lit(' "-" "'),
        F.when(every(3), "curl/8.0").when(F.col("event_id") % 3 == 1, "Mozilla/5.0").otherwise("Googlebot/2.1"),
        F.lit('"'), F.when(every(7), ' "-"').otherwise(""),
    )
    return table(spark, sf, "events").select(
        F.when(every(50), F.concat(F.lit("unexpected line "), text("event_id"))).otherwise(line).alias("value"),
        F.concat(F.lit("web0"), (1 + F.col("event_id") % 3).cast("string")).alias("server"),
        F.col("ts").cast("timestamp").alias("read_at"),
    )


def access_log(spark: SparkSession, sf: str) -> DataFrame:
    return parse_lines(access_lines(spark, sf), F.col("server"), F.col("read_at"))


# ---- commit logs and files ------------------------------------------------------------------------------


def commits(spark: SparkSession, sf: str) -> DataFrame:
    """A commit per table and day; one table's file count is no number."""
    named = table(spark, sf, "events").withColumn(
        "table",
        by_type(view="shop_raw.view", click="shop.click", purchase="shop.purchase", signup="sandbox.signup", error="ops.error"),
    )
    return (
        named.groupBy("table", F.to_date("ts").alias("day"))
        .agg(F.max("ts").cast("timestamp").alias("committed_at"), F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("size"))
        .select(
            "table",
            F.datediff("day", F.lit("2024-01-01")).cast("bigint").alias("version"),
            "committed_at",
            F.lit("append").alias("operation"),
            F.create_map(
                F.lit("total-records"), F.col("n").cast("string"),
                F.lit("total-data-files"), F.when(F.col("table") == "ops.error", "x").otherwise((F.col("n") % 17).cast("string")),
                F.lit("total-delete-files"), (F.col("n") % 3).cast("string"),
                F.lit("total-files-size"), F.col("size").cast("string"),
            ).alias("summary"),
        )
    )


def file_rows(spark: SparkSession, sf: str) -> DataFrame:
    """One data file per order line, in a folder per supplier."""
    return table(spark, sf, "lineitem").select(
        F.concat_ws("/", F.concat(F.lit("commit="), text("l_suppkey")), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey")).alias("path"),
        F.concat(F.lit("commit="), text("l_suppkey")).alias("folder"),
        F.col("l_shipdate").cast("timestamp").alias("modified"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("file_size_in_bytes"),
        F.col("l_quantity").cast("bigint").alias("record_count"),
        F.when(F.col("l_linestatus") == "O", "PARQUET").otherwise("ORC").alias("file_format"),
    )
