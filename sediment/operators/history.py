"""What the change log says about the past."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sediment.model import DELETE, META
from sediment.operators.latest import current_state
from sediment.operators.schema import drop_meta


def record_history(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every change of every record in order: keys, operation, time, offset, business columns.

    The sort is by range of key and time, so the changes of one busy key may fill several tasks.
    """
    rest = [c for c in drop_meta(log).columns if c not in keys]
    return log.select(
        *keys, F.col(f"{META}.op").alias("op"), F.col(f"{META}.ts").alias("ts"), F.col(f"{META}.offset").alias("offset"), *rest
    ).orderBy(*keys, "ts", "offset")


def state_as_of(log: DataFrame, keys: Sequence[str], when: datetime, casts: Mapping[str, str] | None = None) -> DataFrame:
    """Rows alive at a time; right as far back as the log reaches."""
    return current_state(log.where(F.col(f"{META}.ts") <= F.lit(when)), keys, casts)


def last_changes(log: DataFrame, n: int, **paths: str) -> DataFrame:
    """The ``n`` newest changes of a document collection, with fields read from the document by JSON path."""
    fields = [F.get_json_object("_doc", path).alias(name) for name, path in paths.items()]
    return (
        log.select("_id", *fields, F.col(f"{META}.op").alias("op"), F.col(f"{META}.ts").alias("ts"), F.col(f"{META}.offset").alias("offset"))
        .orderBy(F.col("ts").desc(), F.col("offset").desc())
        .limit(n)
    )


def op_histogram(log: DataFrame) -> DataFrame:
    """Changes per operation."""
    return log.groupBy(F.col(f"{META}.op").alias("op")).count()


#: Seconds of a time bucket of :func:`validity` and :func:`as_of_join`.
BUCKET_SECONDS = 7 * 24 * 3600
VALID_FROM, VALID_TO, ALIVE = "valid_from", "valid_to", "alive"


def _bucket(ts: str | Column, seconds: int) -> Column:
    return F.floor(F.unix_seconds(ts) / seconds)


def validity(log: DataFrame, keys: Sequence[str], seconds: int = BUCKET_SECONDS) -> DataFrame:
    """The states of every key with the time they held: ``valid_from`` (inclusive) to ``valid_to`` (exclusive, null for
    the present one); ``alive`` is false where the key was deleted.

    A state ends with the next change by (``_cdc.ts``, ``_cdc.offset``); one that is replaced at its own time never
    held and is left out, as are changes without a time or a key. The next change is looked for among those of the
    key in the same bucket of time, and after the last of them among the first ones of the key's later buckets. So a key
    with a third of all changes is spread over its buckets, and only a row for each bucket meets in one place.
    """
    keys = list(keys)
    named = [F.col(f"`{k}`") for k in keys]
    ts, bucket = F.col(f"{META}.ts"), F.col("_bucket")
    rows = log.where(reduce(and_, (k.isNotNull() for k in named)) & ts.isNotNull()).withColumn("_bucket", _bucket(ts, seconds))
    by_bucket = rows.groupBy(*named, bucket).agg(F.min(ts).alias("_first"))
    following = by_bucket.select(*named, bucket, F.lead("_first").over(Window.partitionBy(*named).orderBy(bucket)).alias("_later"))
    own = Window.partitionBy(*named, bucket).orderBy(ts, F.col(f"{META}.offset"), F.col(f"{META}.op"))
    ended = rows.withColumn("_next", F.lead(ts).over(own)).join(following, [*keys, "_bucket"])
    end = F.coalesce("_next", "_later")
    kept = ended.where(end.isNull() | (end > ts))
    columns = [F.col(f"`{c}`") for c in log.columns if c != META]
    return kept.select(*columns, ts.alias(VALID_FROM), end.alias(VALID_TO), (F.col(f"{META}.op") != DELETE).alias(ALIVE))


def as_of_join(facts: DataFrame, states: DataFrame, keys: Sequence[str], at: str, seconds: int = BUCKET_SECONDS) -> DataFrame:
    """``facts`` with the state of their key at their time ``at``, from :func:`validity`; null columns where none held.

    Both sides meet by key and bucket of time. A state that holds over several buckets is cut into a piece for each, from
    the first to the last bucket that any fact is in, so choose buckets about as long as states last. A fact finds one
    piece at most. Facts without a key or time stay, with null columns. Only the bounds of the facts' buckets come to
    the driver.
    """
    keys = list(keys)
    placed = facts.withColumn("_bucket", _bucket(F.col(f"`{at}`"), seconds))
    low, high = placed.agg(F.min("_bucket"), F.max("_bucket")).first()
    if low is None:
        low, high = 1, 0
    first = F.greatest(_bucket(VALID_FROM, seconds), F.lit(low))
    last = F.least(F.coalesce(_bucket(VALID_TO, seconds), F.lit(high)), F.lit(high))
    others = [c for c in states.columns if c not in (*keys, ALIVE)]
    pieces = states.where(F.col(ALIVE) & (first <= last)).select(
        *(F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)), *(F.col(f"`{c}`") for c in others), F.explode(F.sequence(first, last)).alias("_piece")
    )
    same = reduce(and_, (F.col(f"`{k}`") == F.col(f"_k{i}") for i, k in enumerate(keys)))
    held = (F.col(f"`{at}`") >= F.col(VALID_FROM)) & (F.col(VALID_TO).isNull() | (F.col(f"`{at}`") < F.col(VALID_TO)))
    joined = placed.join(pieces, same & (F.col("_bucket") == F.col("_piece")) & held, "left")
    return joined.drop("_bucket", "_piece", *(f"_k{i}" for i in range(len(keys))))
