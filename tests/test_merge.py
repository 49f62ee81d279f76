import random

import pytest
from pyspark.sql import functions as F

from sediment.operators.latest import current_state, latest_per_key, newest_event_time
from sediment.operators.merge import fold_pending, merge_changes, merge_guarded, merged_view, next_tombstones, upsert
from tests.conftest import rows
from tests.helpers import changes, log, utc

TARGET = "id long, v string"


def target(spark, data, schema=TARGET):
    return spark.createDataFrame(data, schema)


# ---- newest change per key


def test_latest_by_time_then_offset(spark):
    df = log(
        spark,
        [
            (1, "old", "1", "I", "2026-01-01 00:00:00", 9),
            (1, "new", "2", "U", "2026-01-02 00:00:00", 1),
            (2, "first", "1", "I", "2026-01-01 00:00:00", 1),
            (2, "second", "1", "U", "2026-01-01 00:00:00", 2),
            (3, "gone", "1", "D", "2026-01-01 00:00:00", 1),
            (4, "untimed", "1", "I", None, 99),
            (4, "timed", "1", "U", "2020-01-01 00:00:00", 1),
        ],
    )
    assert rows(latest_per_key(df, ["id"]), "id", "status", "_op") == [(1, "new", "U"), (2, "second", "U"), (3, "gone", "D"), (4, "timed", "U")]
    assert rows(current_state(df, ["id"]), "id") == [(1,), (2,), (4,)]
    assert newest_event_time(df).first()[0] == utc(2026, 1, 2).replace(tzinfo=None)


def test_keys_are_compared_before_casts(spark):
    df = log(spark, [(1, "1", "1", "I", "2026-01-01 00:00:00", 1), (2, "01", "1", "I", "2026-01-01 00:00:00", 2)])
    out = latest_per_key(df, ["status"], {"status": "int"})
    assert rows(out, "status") == [(1,), (1,)]
    # both now match one stored row: MERGE refuses that
    stored = spark.createDataFrame([(9, 1, None)], "id long, status int, amount decimal(10,2)")
    with pytest.raises(Exception, match="several changes match"):
        merge_changes(stored, out, ["status"]).collect()


def test_hot_key_is_reduced_before_the_shuffle(spark):
    plan = latest_per_key(log(spark, [(1, "a", "1", "I", "2026-01-01 00:00:00", 1)]), ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


# ---- merge


def test_arms(spark):
    t = target(spark, [(1, "a"), (2, "b"), (3, "c")])
    c = changes(spark, [(1, "A", "U"), (2, None, "D"), (4, "d", "I"), (5, None, "D")])
    assert rows(merge_changes(t, c, ["id"])) == [(1, "A"), (3, "c"), (4, "d")]


def test_insert_matching_a_row_updates_it(spark):
    out = merge_changes(target(spark, [(1, "a")]), changes(spark, [(1, "A", "I")]), ["id"])
    assert rows(out) == [(1, "A")]


def test_null_keys_never_match(spark):
    t = target(spark, [(None, "x"), (1, "a")])
    c = changes(spark, [(None, "y", "I"), (None, "z", "D"), (1, None, "D")])
    assert rows(merge_changes(t, c, ["id"], unique=True)) == [(None, "x"), (None, "y")]


def test_composite_key_and_all_columns_keys(spark):
    t = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "a int, b int, v string")
    c = spark.createDataFrame([(1, 2, "B", "U"), (2, 2, "c", "I")], "a int, b int, v string, _op string")
    assert rows(merge_changes(t, c, ["a", "b"])) == [(1, 1, "a"), (1, 2, "B"), (2, 2, "c")]
    assert rows(merge_changes(t.select("a", "b"), c.drop("v"), ["a", "b"])) == [(1, 1), (1, 2), (2, 2)]


def test_target_only_columns(spark):
    t = spark.createDataFrame([(1, "a", "kept")], "id long, v string, legacy string")
    out = merge_changes(t, changes(spark, [(1, "A", "U"), (2, "b", "I")]), ["id"])
    assert rows(out) == [(1, "A", "kept"), (2, "b", None)]


def test_several_changes_for_one_row(spark):
    twice = changes(spark, [(1, "A", "U"), (1, "B", "U")])
    with pytest.raises(Exception, match="several changes match"):
        merge_changes(target(spark, [(1, "a")]), twice, ["id"]).collect()
    # without a stored row nothing is matched twice
    assert rows(merge_changes(target(spark, [(9, "x")]), twice, ["id"])) == [(1, "A"), (1, "B"), (9, "x")]


def test_null_operation(spark):
    out = merge_changes(target(spark, [(1, "a")]), changes(spark, [(1, "A", None), (2, "b", None)]), ["id"])
    assert rows(out) == [(1, "A")]


def test_upsert(spark):
    out = upsert(target(spark, [(1, "a"), (2, "b")]), target(spark, [(2, "B"), (3, "c")]), ["id"])
    assert rows(out) == [(1, "a"), (2, "B"), (3, "c")]


def test_guard_holds_back_older_changes(spark):
    t = spark.createDataFrame([(1, "a", 5)], "id long, v string, at int")
    c = spark.createDataFrame([(1, "late", 4, "U"), (2, "new", 1, "I")], "id long, v string, at int, _op string")
    assert rows(merge_changes(t, c, ["id"])) == [(1, "late", 4), (2, "new", 1)]
    assert rows(merge_guarded(t, c, ["id"], "at")) == [(1, "a", 5), (2, "new", 1)]


# ---- pending increments


def test_deleted_and_back_again_starts_from_null(spark):
    base = spark.createDataFrame([(1, "a", "kept"), (2, "b", "kept")], "id long, v string, legacy string")
    pending = spark.createDataFrame(
        [(1, None, "D", 1), (1, "again", "I", 2), (2, "B", "U", 1), (2, "BB", "U", 2), (None, "x", "I", 1), (None, "y", "I", 2), (3, "c", "I", 1), (3, None, "D", 2)],
        "id long, v string, _op string, commit int",
    )
    expected = [(1, "again", None), (2, "BB", "kept"), (None, "x", None), (None, "y", None)]
    assert rows(merged_view(base, pending, ["id"])) == expected
    assert fold_pending(pending, ["id"]).count() == 5


def brute_force(state, increments):
    """Increments applied one after another: {key: (v, legacy)} and rows without a key."""
    state, loose = dict(state), []
    for increment in increments:
        for key, v, op in increment:
            if key is None:
                loose += [(None, v, None)] if op != "D" else []
            elif op == "D":
                state.pop(key, None)
            elif key in state:
                state[key] = (v, state[key][1])
            else:
                state[key] = (v, None)
    return sorted([(k, *x) for k, x in state.items()] + loose, key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_merge_on_read_equals_merging_one_by_one(spark, seed):
    rng = random.Random(seed)
    keys = [None, *range(12)]
    increments = [
        [(k, f"{step}-{k}", rng.choice("IUUDD")) for k in rng.sample(keys, rng.randint(1, len(keys)))] for step in range(5)
    ]
    start = {k: (f"s{k}", f"legacy{k}") for k in range(0, 12, 2)}
    base = spark.createDataFrame([(k, *x) for k, x in start.items()], "id long, v string, legacy string")
    expected = brute_force(start, increments)
    pending = spark.createDataFrame([(*c, i) for i, inc in enumerate(increments) for c in inc], "id long, v string, _op string, commit int")
    assert rows(merged_view(base, pending, ["id"])) == expected
    state = base
    for inc in increments:
        state = spark.createDataFrame(merge_changes(state, changes(spark, inc), ["id"]).collect(), base.schema)
    assert rows(state) == expected


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_target_is_read_once_and_only_what_is_asked_for(spark, path):
    columns = [F.lit(c).alias(c) for c in ("a", "b", "v", "w")]
    spark.range(10).select("id", *columns).write.parquet(path + "/t")
    t = spark.read.parquet(path + "/t")
    inserted = spark.createDataFrame([(1, "a", "b", "v", "w", "U")], "id long, a string, b string, v string, w string, _op string")
    plan = executed(merge_changes(t, inserted, ["id"], unique=True).select("id", "v"))
    assert plan.count("FileScan") == 1 and "w:string" not in plan
    # columns that only the target has, and keys that may repeat: one join, the count on its own partitioning
    narrow = inserted.drop("w")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = executed(merge_changes(t, narrow, ["id"]))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 2 and plan.count("Join") == 1
    assert rows(merge_changes(t, narrow, ["id"]).where("id = 1"), "v", "w") == [("v", "w")]


@pytest.mark.parametrize("seed", range(3))
def test_splitting_an_ordered_log_does_not_matter(spark, seed):
    rng = random.Random(seed)
    data = [(rng.randrange(8), f"v{i}", "1", rng.choice("IUUD"), f"2026-01-01 00:{i:02d}:00", i) for i in range(60)]
    cuts = sorted(rng.sample(range(1, 60), 2))
    state = None
    for first, last in zip([0, *cuts], [*cuts, 60]):
        increment = latest_per_key(log(spark, data[first:last]), ["id"])
        base = spark.createDataFrame([] if state is None else state, "id long, status string, amount decimal(10,2)")
        state = merge_changes(base, increment, ["id"], unique=True).collect()
    assert sorted(map(tuple, state)) == rows(current_state(log(spark, data), ["id"]))


def test_a_key_with_a_third_of_all_rows(spark):
    """One key holds a third of the log, another third has no key at all."""
    n = 30000
    key = F.when(F.col("i") % 3 == 0, 7).when(F.col("i") % 3 == 1, None).otherwise(F.col("i"))
    hot = spark.range(n).toDF("i").select(
        key.cast("long").alias("id"),
        F.concat(F.lit("v"), "i").alias("status"),
        F.struct(F.lit("U").alias("op"), F.timestamp_seconds("i").alias("ts"), F.col("i").alias("offset")).alias("_cdc"),
    )
    increment = latest_per_key(hot, ["id"])
    stored = spark.range(n).select(F.when(F.col("id") % 3 == 2, F.col("id")).alias("id"), F.lit("old").alias("status"))
    out = merge_changes(stored, increment, ["id"], unique=True)
    # stored rows without a key stay, all others are replaced, and the log adds key 7 and one row without a key
    assert rows(out.where("id IS NULL").groupBy("status").count()) == [("old", n * 2 // 3), (f"v{n - 2}", 1)]
    assert out.where("id IS NOT NULL").count() == n // 3 + 1 and out.where("id IS NOT NULL AND status = 'old'").count() == 0
    assert rows(out.where("id = 7"), "status") == [(f"v{n - 3}",)]


def test_filter_on_the_key_reaches_the_scan(spark, path):
    spark.range(10).withColumn("v", F.lit("v")).write.parquet(path + "/t")
    out = merge_changes(spark.read.parquet(path + "/t"), changes(spark, [(5, "x", "U")]), ["id"], unique=True)
    assert rows(out.where("id = 5")) == [(5, "x")]
    assert "EqualTo(id,5)" in out.where("id = 5")._jdf.queryExecution().executedPlan().toString()


# ---- guard with tombstones

AT = "id long, v string, _op string, at timestamp"


def guarded(spark, batches, keep_from=None):
    """State and tombstones after increments of (id, v, op, hour), one change per key each."""
    state, tombs = spark.createDataFrame([], "id long, v string, at timestamp"), None
    for batch in batches:
        df = spark.createDataFrame([(i, v, op, utc(2026, 1, 1, hour)) for i, v, op, hour in batch], AT)
        gone = next_tombstones(state, df, ["id"], "at", tombs, keep_from)
        merged = merge_guarded(state, df, ["id"], "at", tombs)
        state, tombs = (spark.createDataFrame(x.collect(), x.schema) for x in (merged, gone))
    return rows(state, "id", "v"), [(i, t.hour) for i, t in rows(tombs, "id", "deleted_at")]


def test_deletes_are_remembered(spark):
    first = [(1, "a", "U", 3), (2, "b", "U", 3)]
    assert guarded(spark, [first, [(1, None, "D", 5)]]) == ([(2, "b")], [(1, 5)])
    # older or as old: stays out; younger: comes back and needs no tombstone any more
    assert guarded(spark, [first, [(1, None, "D", 5)], [(1, "x", "U", 4)]]) == ([(2, "b")], [(1, 5)])
    assert guarded(spark, [first, [(1, None, "D", 5)], [(1, "x", "I", 5)]]) == ([(2, "b")], [(1, 5)])
    assert guarded(spark, [first, [(1, None, "D", 5)], [(1, "x", "U", 6)]]) == ([(1, "x"), (2, "b")], [])
    # a delete that comes before its insert, a delete that comes too late, deletes of different ages
    assert guarded(spark, [[(7, None, "D", 5)], [(7, "x", "I", 2)]]) == ([], [(7, 5)])
    assert guarded(spark, [first, [(1, None, "D", 2)]]) == ([(1, "a"), (2, "b")], [])
    assert guarded(spark, [[(7, None, "D", 5)], [(7, None, "D", 3)], [(7, "x", "I", 4)]]) == ([], [(7, 5)])
    # the same increments again
    assert guarded(spark, [first, [(1, None, "D", 5)], first, [(1, None, "D", 5)]]) == ([(2, "b")], [(1, 5)])
    assert guarded(spark, [first, [(1, None, "D", 5)]], utc(2026, 1, 1, 6)) == ([(2, "b")], [])


@pytest.mark.parametrize("seed", range(2))
def test_order_and_splits_do_not_matter_to_the_guard(spark, seed):
    rng = random.Random(seed)
    data = [(rng.randrange(6), f"v{i}", rng.choice("UUD"), i % 24) for i in range(14)]
    newest = {}
    for c in data:
        if c[0] not in newest or c[3] > newest[c[0]][3]:
            newest[c[0]] = c
    want = sorted((i, v) for i, v, op, _ in newest.values() if op != "D"), sorted((i, h) for i, _, op, h in newest.values() if op == "D")
    shuffled = rng.sample(data, len(data))
    batches = []
    for c in shuffled + rng.sample(data, 3):
        if not batches or any(c[0] == o[0] for o in batches[-1]):
            batches.append([])
        batches[-1].append(c)
    assert guarded(spark, batches) == want
