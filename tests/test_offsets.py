from pyspark.sql import functions as F

from sediment.operators.offsets import backlog, merge_offsets, next_offsets, offsets_json, starting_offsets
from tests.conftest import rows

TOPIC = "crm.crm.customers"


def saved(spark, positions, topic=TOPIC):
    return spark.createDataFrame([(topic, p, n) for p, n in positions.items()], "topic string, partition int, next_offset long")


def test_next(spark):
    seen = spark.createDataFrame([(TOPIC, 0, 4), (TOPIC, 0, 9), (TOPIC, 2, 1)], "topic string, partition int, offset long")
    assert rows(next_offsets(seen)) == [(TOPIC, 0, 10), (TOPIC, 2, 2)]


def test_merge(spark):
    merged = merge_offsets(saved(spark, {0: 3, 1: 5}), saved(spark, {0: 10, 2: 2}))
    assert rows(merged) == [(TOPIC, 0, 10), (TOPIC, 1, 5), (TOPIC, 2, 2)]
    assert offsets_json(merged).first()[0] == '{"crm.crm.customers":{"0":10,"1":5,"2":2}}'


def test_start(spark):
    partitions = spark.createDataFrame([(TOPIC, p) for p in range(3)] + [("other", 0)], "topic string, partition int")
    start = starting_offsets(saved(spark, {0: 2, 2: 1}), partitions)
    assert rows(start) == [(TOPIC, 0, 2), (TOPIC, 1, -2), (TOPIC, 2, 1), ("other", 0, None)]
    assert offsets_json(start, "starting_offset").first()[0] == '{"crm.crm.customers":{"0":2,"1":-2,"2":1}}'


def test_backlog(spark):
    committed = spark.createDataFrame([("g", TOPIC, 0, 4), ("g", TOPIC, 1, 9)], "group string, topic string, partition int, next_offset long")
    ends = saved(spark, {0: 10, 1: 10})
    assert rows(backlog(ends, committed)) == [("g", TOPIC, 7)]
    assert rows(backlog(ends, committed, 7)) == [] and rows(backlog(ends, committed, 6)) == [("g", TOPIC, 7)]


def test_partitions_without_a_position_count(spark):
    committed = spark.createDataFrame([("g", TOPIC, 0, 4)], "group string, topic string, partition int, next_offset long")
    ends = saved(spark, {0: 10, 1: 5000})
    assert rows(backlog(ends, committed)) == [("g", TOPIC, 5006)]
    assert rows(backlog(ends.withColumn("earliest", F.lit(4900)), committed)) == [("g", TOPIC, 106)]
