"""Change events of document collections.

The document stays one JSON text in ``_doc``; no columns are opened.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sediment.functions import jsonvalues as J
from sediment.functions.rows import computed
from sediment.model import META

# Operation codes of the envelope and the change-log codes they become.
OPERATIONS = {"c": "I", "r": "I", "u": "U", "d": "D"}

_ENVELOPE = T.StructType(
    [
        T.StructField("op", T.StringType()),
        T.StructField("ts_ms", T.LongType()),
        T.StructField("after", T.StringType()),
        T.StructField("before", T.StringType()),
    ]
)
_CARRIED = ("key", "value", "topic", "partition", "offset", "timestamp")


def classify(records: DataFrame) -> DataFrame:
    """Kafka-shaped records with ``kind`` (``drop``, ``quarantine`` or ``bronze``) and what was read from them.

    Checked in this order: a null value is a tombstone and dropped; a value that is no object or has no known
    operation is ``bad-envelope``; no usable id in the key is ``no-key``; a ``ts_ms`` that is no integer is
    ``no-ts``; a write without a document is ``after-null``.

    The id is the ``id`` member of the key, which holds JSON itself.  Keep the result persisted when it is split
    into several writes.
    """
    opened = computed(
        records.select(*_CARRIED),
        _values=J.objects(F.col("value"), _ENVELOPE),
        _keys=J.objects(F.col("key"), J.text_members("id")),
    ).select(*_CARRIED, J.the_object(F.col("_values")).alias("_event"), J.the_object(F.col("_keys"))["id"].alias("_ident"))
    identified = computed(opened, _id_json=J.variant(F.col("_ident")))
    code = F.col("_event.op")
    known = F.coalesce(code.isin(*OPERATIONS), F.lit(False))
    removed = code == "d"
    ruled = computed(
        identified,
        _id=J.identifier(F.col("_ident"), F.col("_id_json")),
        op=F.coalesce(*(F.when(code == long, short) for long, short in OPERATIONS.items())),
    )
    reason = (
        F.when(F.col("value").isNull(), None)
        .when(~known, "bad-envelope")
        .when(F.col("_id").isNull(), "no-key")
        .when(F.col("_event.ts_ms").isNull(), "no-ts")
        .when(~removed & F.col("_event.after").isNull(), "after-null")
    )
    judged = ruled.withColumn("reason", reason)
    return judged.select(
        *_CARRIED,
        F.when(F.col("value").isNull(), "drop").when(F.col("reason").isNotNull(), "quarantine").otherwise("bronze").alias("kind"),
        "reason",
        "_id",
        F.when(removed, F.col("_event.before")).otherwise(F.col("_event.after")).alias("_doc"),
        "op",
        F.col("_event.ts_ms").alias("ts_ms"),
    )


def bronze_rows(classified: DataFrame, target: str) -> DataFrame:
    """Rows of the raw collection table ``target``."""
    meta = F.struct(
        F.col("op"),
        F.timestamp_millis("ts_ms").alias("ts"),
        F.col("offset"),
        F.col("topic").alias("source"),
        F.lit(target).alias("target"),
        F.struct("_id").alias("key"),
    )
    return classified.where(F.col("kind") == "bronze").select("_id", "_doc", meta.alias(META))


def quarantine_rows(classified: DataFrame) -> DataFrame:
    """Rows of the quarantine table."""
    return classified.where(F.col("kind") == "quarantine").select(
        F.col("key").alias("_key"), F.col("value").alias("_value"), "reason", F.col("timestamp").alias("ts"), "partition", "offset"
    )
