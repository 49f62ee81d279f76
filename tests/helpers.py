from datetime import datetime, timezone

from pyspark.sql import functions as F

ORDER_LOG = "id long, status string, amount string, op string, ts string, offset long"


def utc(*parts):
    return datetime(*parts, tzinfo=timezone.utc)


def log(spark, changes, amount="decimal(10,2)", schema=ORDER_LOG):
    """A change log from (id, status, amount, op, ts, offset)."""
    df = spark.createDataFrame(changes, schema)
    return df.select(
        "id",
        "status",
        F.col("amount").cast(amount).alias("amount"),
        F.struct(
            "op",
            F.to_timestamp("ts").alias("ts"),
            "offset",
            F.lit("shop.public.orders").alias("source"),
            F.lit("shop_raw.orders").alias("target"),
            F.struct("id").alias("key"),
        ).alias("_cdc"),
    )


def changes(spark, data, schema="id long, v string, _op string"):
    return spark.createDataFrame(data, schema)
