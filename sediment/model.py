"""Table contracts and pipeline configuration."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import types as T

# The change-log contract shared by every source.
META = "_cdc"
INSERT, UPDATE, DELETE = "I", "U", "D"
MERGE_ON_READ, COPY_ON_WRITE = "merge-on-read", "copy-on-write"
WRITE_MODES = (MERGE_ON_READ, COPY_ON_WRITE)

RAW_SUFFIX = "_raw"
QUARANTINE_SUFFIX = "__quarantine"


def meta_type(key: T.StructType) -> T.StructType:
    """Type of the ``_cdc`` column for a table whose key struct is ``key``."""
    return T.StructType(
        [
            T.StructField("op", T.StringType()),
            T.StructField("ts", T.TimestampType()),
            T.StructField("offset", T.LongType()),
            T.StructField("source", T.StringType()),
            T.StructField("target", T.StringType()),
            T.StructField("key", key),
        ]
    )


# Declared rather than inferred: a batch made only of deletes has a null ``_doc`` in every row.
DOCUMENT_SCHEMA = T.StructType(
    [
        T.StructField("_id", T.StringType()),
        T.StructField("_doc", T.StringType()),
        T.StructField(META, meta_type(T.StructType([T.StructField("_id", T.StringType())]))),
    ]
)

QUARANTINE_SCHEMA = T.StructType(
    [
        T.StructField("_key", T.StringType()),
        T.StructField("_value", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
    ]
)

KAFKA_SCHEMA = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
    ]
)


def silver_name(bronze: str) -> str:
    """``shop_raw.orders`` -> ``shop.orders``."""
    namespace, dot, table = bronze.rpartition(".")
    if not dot:
        raise ValueError(f"{bronze!r} has no namespace; expected '<namespace>{RAW_SUFFIX}.<table>'")
    if not namespace.endswith(RAW_SUFFIX):
        raise ValueError(f"{bronze!r}: the namespace must end in {RAW_SUFFIX!r}, or the pipeline must name 'silver'")
    return f"{namespace.removesuffix(RAW_SUFFIX)}.{table}"


@dataclass(frozen=True)
class Pipeline:
    """One raw table reduced to its current state."""

    bronze: str
    keys: tuple[str, ...]
    write_mode: str = MERGE_ON_READ
    bucket_count: int = 16
    casts: Mapping[str, str] = field(default_factory=dict)
    silver: str = ""
    #: A column with the time of a row: a change that is older than the stored row is then ignored.
    guard_ts: str = ""

    def __post_init__(self) -> None:
        if not self.bronze:
            raise ValueError("a pipeline needs 'bronze'")
        if not self.keys:
            raise ValueError(f"{self.bronze}: 'keys' must not be empty")
        if self.write_mode not in WRITE_MODES:
            raise ValueError(f"{self.bronze}: write_mode {self.write_mode!r} is not one of {WRITE_MODES}")
        if self.guard_ts and self.write_mode != COPY_ON_WRITE:
            raise ValueError(f"{self.bronze}: guard_ts compares with stored rows, which needs write_mode {COPY_ON_WRITE!r}")
        if self.bucket_count < 1:
            raise ValueError(f"{self.bronze}: bucket_count must be positive")

    @property
    def target(self) -> str:
        return self.silver or silver_name(self.bronze)

    def check_columns(self, columns: list[str]) -> None:
        absent = [k for k in self.keys if k not in columns]
        if absent:
            raise ValueError(f"{self.bronze}: key column(s) not in the table: {absent}")


def read_pipelines(document: Mapping | None) -> list[Pipeline]:
    """Pipelines of a configuration document; keys of other jobs in it are ignored."""
    known = ("bronze", "keys", "write_mode", "bucket_count", "casts", "silver", "guard_ts")
    pipelines = []
    for entry in (document or {}).get("pipelines") or ():
        given = {name: entry[name] for name in known if entry.get(name) is not None}
        given["keys"] = tuple(given.get("keys", ()))
        given.setdefault("bronze", "")
        pipelines.append(Pipeline(**given))
    return pipelines
