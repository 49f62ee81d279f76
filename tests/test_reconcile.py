"""Tables compared by sums over ranges of their keys' hashes."""

import random

import pytest
from pyspark.sql import functions as F

from sediment.operators.checks import reconcile_ranges
from tests.conftest import rows

SCHEMA = "a long, b string, v double, w string"


def by_force(left, right):
    """Rows as multisets by key."""
    out = []
    for key in {r[:2] for r in left + right}:
        one, two = (sorted((r for r in side if r[:2] == key), key=repr) for side in (left, right))
        if one != two:
            out.append((*key, len(one), len(two), "missing" if not two else "extra" if not one else "changed"))
    return sorted(out, key=repr)


@pytest.mark.parametrize("fetched", [100_000, 5, 0])
def test_differing_keys(spark, fetched):
    rng = random.Random(3)
    left = [(rng.choice([None, i % 400]), rng.choice([None, "x", "y"]), rng.choice([None, 1.5, -0.0]), rng.choice([None, "", "z"])) for i in range(900)]
    right = [r for r in left if rng.random() > 0.01]
    right += [(1000 + k, "new", None, None) for k in range(3)] + right[:2]
    k = rng.randrange(len(right))
    right[k] = (*right[k][:2], 99.0, "changed")
    swapped = next(k for k, r in enumerate(right) if r[2] is None and r[3] == "z")
    right[swapped] = (*right[swapped][:3], "")
    df = lambda data: spark.createDataFrame(data, SCHEMA).repartition(3)
    got = reconcile_ranges(spark, df(left), df(right).select("w", "b", "v", "a"), ["a", "b"], fetched)
    assert rows(got) == by_force(left, right)
    assert reconcile_ranges(spark, df(left), df(left), ["a", "b"], fetched).count() == 0
    assert reconcile_ranges(spark, df(left).limit(0), df(left).limit(0), ["a", "b"], fetched).count() == 0


def test_columns_must_agree(spark):
    with pytest.raises(ValueError, match="columns differ: .'v'"):
        reconcile_ranges(spark, spark.range(1).withColumn("v", F.lit(1)), spark.range(1), ["id"])


def shuffled_rows(spark, work):
    """Rows written to shuffles while ``work`` runs, over all jobs."""
    status, known = spark.sparkContext._jsc.sc().statusStore(), None

    def total():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = status.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    known = total()
    out = work()
    return out, total() - known


def test_only_sums_and_what_differs_is_shuffled(spark):
    n = 200_000
    left = spark.range(n).withColumn("v", F.col("id") * 3)
    right = left.withColumn("v", F.when(F.col("id").isin(17, 90_000), F.lit(0).cast("long")).otherwise(F.col("v"))).where("id <> 5")
    found, moved = shuffled_rows(spark, lambda: rows(reconcile_ranges(spark, left, right, ["id"], 50), "id", "difference"))
    assert sorted(found) == [(5, "missing"), (17, "changed"), (90_000, "changed")]
    tasks = left.rdd.getNumPartitions()
    assert 0 < moved < 2 * 1024 * tasks * 2 + 2_000 < n
