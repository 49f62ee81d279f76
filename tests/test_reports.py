from datetime import date

import pytest
from pyspark.sql import functions as F

from sediment.functions.weblog import is_bot, normal_page
from sediment.operators import checks, health, history
from sediment.operators.access import AccessDenied, Person, catalog_access, may, owns_schema, secured_view
from sediment.plans import business, web
from sediment.sources.versioned import VersionedTable
from tests.conftest import rows
from tests.helpers import log, utc

# ---- web

LOG = "ts timestamp, server string, remote string, path string, code int, size long, agent string"


def weblog(spark, *requests):
    return spark.createDataFrame(list(requests), LOG)


def test_pages_and_bots(spark):
    df = spark.createDataFrame([("/a/123?x=/9", "Googlebot"), ("/a/12b/7", None), ("/", "Mozilla")], "p string, a string")
    assert [tuple(r) for r in df.select(normal_page(F.col("p")), is_bot(F.col("a"))).collect()] == [("/a/{id}", True), ("/a/{id}b/{id}", False), ("/", False)]


def test_hourly(spark):
    df = weblog(
        spark,
        (utc(2026, 1, 1, 22, 30), "w", "1.1.1.1", "/a", 200, 5, "curl/8"),
        (utc(2026, 1, 1, 22, 40), "w", "1.1.1.1", "/a", 302, None, "Mozilla"),
        (utc(2026, 1, 1, 22, 50), "w", "2.2.2.2", "/a", 599, 1, None),
        (utc(2026, 1, 1, 22, 59), "w", None, None, None, None, None),
    )
    (r,) = web.hourly(web.requests(df)).collect()
    # 22:30 UTC is 01:30 of the next day in the reports' zone
    assert (str(r["day"]), str(r["hour"]), r["requests"], r["ok_2xx"], r["redirect_3xx"], r["client_error_4xx"], r["server_error_5xx"]) == (
        "2026-01-02", "2026-01-02 01:00:00", 4, 1, 1, 0, 1,
    )
    assert (r["distinct_ip"], r["bytes"], r["bot_requests"]) == (2, 6, 1)
    share = web.error_share(web.hourly(web.requests(df))).first()
    assert (share["requests"], share["errors"], share["error_share"]) == (4, 1, 0.25)


def test_grouped_input_gives_the_same_reports(spark):
    df = weblog(spark, *((utc(2026, 1, 1 + i % 3, i % 24), f"w{i % 2}", f"1.1.1.{i % 4}", f"/p/{i}/x{i % 3}", 200 + 100 * (i % 4), i, "curl") for i in range(200)))
    plain, grouped = web.requests(df), web.request_groups(web.requests(df))
    for report in web.REPORTS.values():
        assert rows(report(plain)) == rows(report(grouped))


def test_recent_days_use_local_midnight_and_reach_the_scan(spark, path):
    df = weblog(spark, (utc(2026, 1, 7, 20, 59), "w", "a", "/", 200, 1, ""), (utc(2026, 1, 7, 21, 0), "w", "b", "/", 200, 1, ""))
    df.write.parquet(path + "/log")
    recent = web.recent_days(spark.read.parquet(path + "/log"), date(2026, 1, 10))
    assert rows(recent, "remote") == [("b",)]
    assert "GreaterThanOrEqual(ts" in recent._jdf.queryExecution().executedPlan().toString()


def test_refresh_replaces_only_the_last_days(spark, path):
    first = weblog(spark, (utc(2026, 1, 1, 9), "w", "a", "/", 404, 1, ""), (utc(2026, 1, 9, 9), "w", "a", "/", 200, 1, ""))
    folders = web.refresh(spark, first, path, date(2026, 1, 10))
    late = first.unionByName(weblog(spark, (utc(2026, 1, 1, 10), "w", "a", "/", 404, 1, ""), (utc(2026, 1, 9, 10), "w", "b", "/", 200, 1, "")))
    web.refresh(spark, late, path, date(2026, 1, 10))
    hourly = spark.read.parquet(folders["web_hourly"])
    assert rows(hourly.groupBy(F.col("day").cast("string")).agg(F.sum("requests"))) == [("2026-01-01", 1), ("2026-01-09", 2)]
    assert rows(web.by_server(hourly).groupBy("server").agg(F.sum("requests"))) == [("w", 3)]
    assert rows(web.suspicious_ips(spark.read.parquet(folders["web_ip_daily"]), 1), "ip", "client_error_4xx") == [("a", 1)]
    assert rows(web.error_pages(spark.read.parquet(folders["web_page_daily"]), 1), "page", "errors") == [("/", 1)]


# ---- business


def test_business_reports(spark):
    df = spark.createDataFrame([("2026-01-01 10:00:00", "new", 10.0, 1), ("2026-01-01 11:00:00", "paid", 5.5, 1), ("2026-01-02 00:00:00", "new", 1.0, 2)], "at string, status string, amount double, cust int")
    df = df.withColumn("at", F.to_timestamp("at"))
    assert rows(business.count_by(df, "status")) == [("new", 2), ("paid", 1)]
    assert rows(business.daily_totals(df, "at", "amount"), F.col("day").cast("string"), "rows", "amount") == [("2026-01-01", 2, 15.5), ("2026-01-02", 1, 1.0)]
    assert business.daily_totals(df, "at", "amount", "status").count() == 3
    assert rows(business.average_by(df, "status", "amount")) == [("new", 2, 5.5), ("paid", 1, 5.5)]
    names = spark.createDataFrame([(1, "x"), (2, "x")], "id int, unit string")
    assert rows(business.distinct_through(df, [(names, F.col("cust") == F.col("id"))], "unit", "cust")) == [("x", 2)]


# ---- health


def commits(spark, *records):
    return spark.createDataFrame(list(records), "table string, version long, committed_at timestamp, operation string, summary map<string,string>")


def test_health_takes_the_newest_commit(spark):
    mib = 1048576
    df = commits(
        spark,
        ("fin.invoices", 2, utc(2026, 11, 10, 11), "append", {"total-records": "300", "total-data-files": "4", "total-delete-files": "1", "total-files-size": str(8 * mib)}),
        ("fin.invoices", 1, utc(2026, 11, 10, 10), "append", {"total-records": "100", "total-data-files": "1", "total-files-size": str(mib)}),
        ("a.b", 1, utc(2026, 1, 1), "append", {"total-records": "x"}),
        ("a.c", 1, utc(2026, 1, 1), "append", {"total-data-files": "0", "total-files-size": "5"}),
        ("shop_raw.t", 1, utc(2026, 1, 1), "append", {}),
        ("sandbox.t", 1, utc(2026, 1, 1), "append", {}),
    )
    got = {r["table"]: r for r in health.table_health(df, ["fin", "shop"], utc(2026, 12, 1)).collect()}
    r = got["fin.invoices"]
    assert (r["layer"], r["versions"], r["records"], r["data_files"], r["delete_files"], r["size_mib"], r["avg_file_mib"]) == ("silver", 2, 300, 4, 1, 8.0, 2.0)
    assert str(r["last_change"]) == "2026-11-10 11:00:00"
    assert (got["a.b"]["records"], got["a.b"]["data_files"], got["a.b"]["avg_file_mib"], got["a.b"]["layer"]) == (None, None, None, "other")
    assert got["a.c"]["avg_file_mib"] is None and got["a.c"]["size_mib"] == 0.0
    assert (got["shop_raw.t"]["layer"], got["sandbox.t"]["layer"]) == ("bronze", "sandbox")
    assert health.table_health(df.limit(0), [], utc(2026, 1, 1)).count() == 0


def test_health_of_written_tables(spark, path):
    table = VersionedTable(spark, path + "/t")
    table.append(spark.range(10).toDF("id"))
    table.append(spark.range(5).toDF("id"))
    df = table.commits().withColumn("table", F.lit("shop.t"))
    (r,) = health.table_health(df, ["shop"], utc(2026, 1, 1)).collect()
    assert r["records"] == 15 and r["data_files"] == table.files().count() and r["versions"] == 3 and r["size_mib"] is not None
    assert health.newest_commits(df, 2).count() == 2
    (f,) = health.file_stats(table.files()).collect()
    assert (f["file_format"], f["records"]) == ("PARQUET", 15)


def test_staleness_and_dead_letters(spark):
    df = commits(spark, ("a.b", 1, utc(2026, 1, 1, 10), "append", {}), ("a.c", 1, utc(2026, 1, 1, 11, 50), "append", {}))
    assert rows(health.stale_tables(df, utc(2026, 1, 1, 12)), "table", "age_seconds") == [("a.b", 7200)]
    dead = spark.createDataFrame([("t.dlq", utc(2026, 1, 1, 11, 30)), ("t.dlq", utc(2026, 1, 1, 10)), ("u.dlq", utc(2026, 1, 1, 12, 1))], "topic string, timestamp timestamp")
    assert rows(health.recent_dead_letters(dead, utc(2026, 1, 1, 12))) == [("t.dlq", 1)]


def test_health_series(spark):
    df = spark.createDataFrame(
        [("t", "silver", utc(2026, 1, 1, 10, 5), 5, 2, 0.1), ("t", "silver", utc(2026, 1, 1, 10, 50), 7, 1, 0.3), ("u", "bronze", utc(2026, 1, 1, 10, 50), 1, 1, 0.2)],
        "table string, layer string, measured_at timestamp, records long, data_files long, avg_file_mib double",
    )
    assert [r["table"] for r in health.latest_health(df).collect()] == ["u", "t"]
    assert rows(health.health_trend(df), "table", "records", "data_files") == [("t", 7, 2), ("u", 1, 1)]
    assert rows(health.file_size_by_table(df)) == [("t", 0.3), ("u", 0.2)]


# ---- checks


def test_checks(spark):
    df = spark.createDataFrame([(1, "new", None), (2, "paid", "x y")], "id int, status string, note string")
    check = checks.TableCheck(2, True, must=[{"status": "paid", "note": checks.Contains("x ")}, {"status": "new", "id": "2"}], must_not=[{"note": "x y"}, {"status": "gone"}])
    assert rows(checks.check_table(df, check), "assertion", "actual", "ok") == [
        ("must_0", 1, True), ("must_1", 0, False), ("must_not_0", 1, False), ("must_not_1", 0, True), ("rows", 2, True),
    ]
    assert rows(checks.check_table(df, checks.TableCheck(3)), "ok") == [(False,)]
    assert rows(checks.check_table(df.limit(0), checks.TableCheck(0)), "ok") == [(True,)]


def test_reconciliation_and_history(spark):
    df = log(spark, [(1, "a", "1", "I", "2026-01-01 00:00:00", 1), (1, "b", "1", "U", "2026-01-02 00:00:00", 2), (2, "c", "0", "D", "2026-01-01 00:00:00", 3)])
    assert rows(checks.reconcile({"bronze": df, "silver": df.where("id = 2")}, ["id"])) == [("bronze", 3, 2), ("silver", 1, 1)]
    assert rows(history.op_histogram(df)) == [("D", 1), ("I", 1), ("U", 1)]
    assert [(r["id"], r["op"]) for r in history.record_history(df, ["id"]).collect()] == [(1, "I"), (1, "U"), (2, "D")]
    assert rows(history.state_as_of(df, ["id"], utc(2026, 1, 1, 12)), "id", "status") == [(1, "a")]
    assert rows(history.state_as_of(df, ["id"], utc(2026, 1, 3)), "id", "status") == [(1, "b")]


# ---- access

RULES = {
    "catalogs": [{"group": "admins|analysts", "catalog": "main|system", "allow": "all"}, {"group": "users", "catalog": "main", "allow": "read-only"}, {"user": "bi", "catalog": "main", "allow": "read-only"}],
    "schemas": [{"group": "admins", "owner": True}, {"group": "analysts", "schema": "sandbox", "owner": True}, {"owner": False}],
    "tables": [
        {"group": "admins", "privileges": ["SELECT", "INSERT", "DELETE"]},
        {"group": "analysts", "schema": "sandbox", "privileges": ["SELECT", "INSERT"]},
        {"group": "analysts", "privileges": ["SELECT"]},
        {"group": "users", "schema": "shop", "table": "orders", "privileges": ["SELECT"], "filter": "status <> 'shipped'", "columns": [{"name": "id", "mask": "0"}]},
        {"group": "users", "schema": "hidden", "privileges": []},
        {"group": "users", "privileges": ["SELECT"]},
        {"user": "bi|svc", "privileges": ["SELECT"]},
    ],
}


def test_access(spark):
    df = spark.createDataFrame([(1, "shipped"), (2, "new"), (3, None)], "id long, status string")
    analyst, user, bi, nobody = Person("a", ["analysts"]), Person("u", ["users"]), Person("bi"), Person("x", ["guests"])
    assert secured_view(df, RULES, analyst, "main", "shop", "orders").count() == 3
    seen = secured_view(df, RULES, user, "main", "shop", "orders")
    assert rows(seen) == [(0, "new")] and seen.schema["id"].dataType.simpleString() == "bigint"
    assert secured_view(df, RULES, user, "main", "shop", "items").count() == 3
    assert secured_view(df, RULES, bi, "main", "shop", "orders").count() == 3
    for person, schema in ((nobody, "shop"), (user, "hidden")):
        with pytest.raises(AccessDenied):
            secured_view(df, RULES, person, "main", schema, "orders")
    assert not may(RULES, user, "INSERT", "main", "shop", "orders") and not may(RULES, analyst, "INSERT", "main", "shop", "orders")
    assert may(RULES, analyst, "INSERT", "main", "sandbox", "t") and not may(RULES, user, "SELECT", "system", "x", "y")
    assert owns_schema(RULES, analyst, "main", "sandbox") and not owns_schema(RULES, analyst, "main", "shop")
    assert catalog_access(RULES, nobody, "main") == "none"


def test_filter_sees_unmasked_values_and_reaches_the_scan(spark, path):
    spark.createDataFrame([(1, "shipped"), (2, "new")], "id long, status string").write.parquet(path + "/o")
    rules = {"catalogs": [{"allow": "all"}], "tables": [{"privileges": ["SELECT"], "filter": "status <> 'shipped'", "columns": [{"name": "status", "mask": "'shipped'"}]}]}
    out = secured_view(spark.read.parquet(path + "/o"), rules, Person("u"), "main", "s", "t")
    assert rows(out) == [(2, "shipped")]
    assert "PushedFilters: [IsNotNull(status), Not(EqualTo(status,shipped))]" in out._jdf.queryExecution().executedPlan().toString()


# ---- folded reports


def test_folded_reports_equal_the_computed_ones(spark, path):
    import random

    from sediment.plans.folded import FoldedReports

    rng = random.Random(8)
    data = [
        (utc(2026, 1, rng.randint(1, 3), rng.randrange(24)), rng.choice(["w", "v"]), rng.choice([None, *(f"10.0.0.{k}" for k in range(30))]), rng.choice(["/a", "/b/1", "/b/2", None]), rng.choice([200, 302, 401, 404, 500, None]), rng.choice([None, 10]), rng.choice(["curl", "Mozilla", None]))
        for _ in range(200)
    ]
    reports, whole = FoldedReports(spark, path + "/folded"), web.requests(weblog(spark, *data))
    for k, part in enumerate((data[:100], [], data[100:], data[100:])):
        reports.fold(spark.createDataFrame(part, LOG), ("log", min(k, 2)))
    for folded, report in ((reports.hourly(), web.hourly), (reports.ip_daily(), web.ip_daily), (reports.page_daily(), web.page_daily)):
        assert rows(folded, *sorted(folded.columns)) == rows(report(whole), *sorted(folded.columns))
    # addresses have one number each, without gaps
    numbers = sorted(r.number for r in reports.table("addresses").read().collect())
    assert numbers == list(range(30)) and reports.table("addresses").read().select("ip").distinct().count() == 30
    # a fold replaces the days of its requests only
    before = {u for u in reports.table("hour_sums").head().units if u.part != "2026-01-02"}
    reports.fold(weblog(spark, (utc(2026, 1, 2, 5), "w", "new", "/a", 200, 1, "curl")), ("log", 3))
    assert before <= set(reports.table("hour_sums").head().units)


# ---- validity


def test_validity_and_as_of(spark):
    data = [(1, "a", "1", "I", "2026-01-01 00:00:00", 0), (1, "b", "1", "U", "2026-01-01 00:00:00", 1), (1, "c", "1", "U", "2026-01-20 00:00:00", 2), (1, None, "1", "D", "2026-03-01 00:00:00", 3), (1, "d", "1", "I", "2026-03-02 00:00:00", 4), (2, "x", "1", "I", "2026-01-05 00:00:00", 5), (None, "n", "1", "I", "2026-01-05 00:00:00", 6), (3, "t", "1", "I", None, 7)]
    states = history.validity(log(spark, data).drop("amount"), ["id"])
    got = [(i, s, str(f)[:10], t and str(t)[:10], alive) for i, s, f, t, alive in rows(states, "id", "status", "valid_from", "valid_to", "alive")]
    assert got == [(1, "b", "2026-01-01", "2026-01-20", True), (1, "c", "2026-01-20", "2026-03-01", True), (1, "d", "2026-03-02", None, True), (1, None, "2026-03-01", "2026-03-02", False), (2, "x", "2026-01-05", None, True)]
    facts = [(k, i, day and utc(*day)) for k, (i, day) in enumerate([(1, (2025, 12, 31)), (1, (2026, 1, 1)), (1, (2026, 1, 19)), (1, (2026, 1, 20)), (1, (2026, 3, 1)), (1, (2026, 3, 2)), (1, (2027, 1, 1)), (2, (2030, 1, 1)), (9, (2026, 1, 1)), (None, (2026, 1, 5)), (2, None)])]
    df = spark.createDataFrame(facts, "k int, id long, when timestamp")
    out = history.as_of_join(df, states, ["id"], "when")
    assert [s for _, s in sorted(rows(out, "k", "status"), key=lambda r: r[0])] == [None, "b", "b", "c", None, "d", "d", "x", None, None, None]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert history.as_of_join(df.limit(0), states, ["id"], "when").count() == 0
    assert rows(history.as_of_join(df, states.limit(0), ["id"], "when"), "status") == [(None,)] * len(facts)


def test_folded_addresses_take_no_more_room_than_they_are(spark, path):
    from sediment.plans.folded import FoldedReports

    data = [(utc(2026, 1, 1), "w", f"10.0.{k // 200}.{k % 200}", f"/p{k % 150}x", 200, 1, None) for k in range(300)]
    reports = FoldedReports(spark, path + "/folded")
    for k in (0, 1):
        reports.fold(weblog(spark, *data[k * 140 : k * 140 + 160]), ("log", k))
    pages = {r.page: r.distinct_ip for r in reports.page_daily().collect()}
    assert pages == {f"/p{k}x": 2 for k in range(150)} and [r.distinct_ip for r in reports.hourly().collect()] == [300]
    # a page's few addresses are a few numbers, not a map of all addresses
    kept = reports.table("page_bits").read()
    assert dict(kept.dtypes)["bits"] == "bigint" and kept.count() <= 300
    assert reports.table("hour_bits").read().count() == -(-300 // 64)


# ---- effective rights, frequent addresses, validated reads


def test_effective_rights_are_those_of_each_person(spark):
    from sediment.operators.access import effective_rights, grant_for

    rules = {
        "tables": [
            {"user": "root", "privileges": ["SELECT", "OWNERSHIP"]},
            {"group": "a|b", "schema": "s[0-9]", "table": "secret.*", "privileges": []},
            {"group": "a+", "catalog": "main", "privileges": ["SELECT"], "filter": "x = 1", "columns": [{"name": "c", "mask": "'-'"}]},
            {"user": "(?i)ANN", "table": "t\\.1", "privileges": ["INSERT"]},
            {"user": "b*ob", "schema": "s1", "privileges": ["SELECT"]},
            {"table": "", "privileges": ["SELECT"]},
            {"user": "x|yy", "privileges": ["DELETE"]},
        ]
    }
    persons = {"root": [], "ann": ["a"], "Ann": [], "bob": ["b"], "ob": ["c", "aa"], "bobby": [], "x": ["b", "c"], "yy": ["a", "b"], "": []}
    tables = [("main", "s1", "secret_1"), ("main", "s1", "t.1"), ("main", "s12", "secret"), ("other", "s1", "t.1"), ("other", "s1", "txx1"), ("main", "s2", "")]
    got = effective_rights(
        spark, rules, spark.createDataFrame(list(persons.items()), "user string, groups array<string>"), spark.createDataFrame(tables + tables[:1], "catalog string, schema string, table string")
    )
    found = {(r.user, r.catalog, r.schema, r.table): (set(r.privileges), r.row_filter, r.masks) for r in got.collect()}
    assert len(found) == got.count()
    for user, groups in persons.items():
        for t in tables:
            grant = grant_for(rules, Person(user, groups), *t)
            assert found.get((user, *t)) == ((set(grant.privileges), grant.row_filter, dict(grant.masks)) if grant.privileges else None), (user, t)
    assert effective_rights(spark, {}, spark.createDataFrame([("u", ["g"])], "user string, groups array<string>"), spark.createDataFrame(tables, "catalog string, schema string, table string")).count() == 0


def test_effective_rights_gather_no_pairs(spark):
    from sediment.operators.access import effective_rights

    rules = {"tables": [{"user": "u1", "privileges": []}, {"user": "u.", "table": "t[12]", "privileges": ["SELECT"]}, {"privileges": ["INSERT"]}]}
    persons = spark.createDataFrame([("u1", ["g"]), ("u2", ["g"]), ("u2", None), (None, ["g"])], "user string, groups array<string>")
    tables = spark.createDataFrame([("c", "s", f"t{k}") for k in range(1, 4)] + [("c", None, "t1")], "catalog string, schema string, table string")
    got = effective_rights(spark, rules, persons, tables)
    assert sorted((r.user, r.table, r.rule) for r in got.collect()) == [("u2", "t1", 1), ("u2", "t2", 1), ("u2", "t3", 2)]
    # no aggregate holds persons and tables together: its memory would grow with their product
    plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [line for line in plan if "Aggregate [" in line and "user#" in line and "table#" in line]


@pytest.mark.parametrize("tracked", [10_000, 100])
def test_frequent_addresses_are_exact(spark, tracked):
    heavy = [(utc(2026, 1, 1), "w", f"10.0.0.{k}", "/a", 404, 1, None) for k in range(12) for _ in range(60 - 4 * k)]
    light = [(utc(2026, 1, 1), "w", f"10.1.{k // 200}.{k % 200}", "/a", 403 if k % 2 else 200, 1, None) for k in range(400)]
    df = web.requests(weblog(spark, *heavy, *light, (utc(2026, 1, 1), "w", None, "/a", 401, 1, None)))
    whole = [tuple(r) for r in web.suspicious_ips(web.ip_daily(df)).collect()]
    assert [tuple(r) for r in web.suspicious_ips_fast(df, tracked=tracked).collect()] == whole
    # a tie at the end, and nothing at all
    assert [tuple(r) for r in web.suspicious_ips_fast(df, 30, tracked).collect()] == [tuple(r) for r in web.suspicious_ips(web.ip_daily(df), 30).collect()]
    assert web.suspicious_ips_fast(df.limit(0)).count() == 0


def test_the_first_readable(spark, path):
    spark.range(3).write.parquet(path + "/a")
    spark.range(5).write.parquet(path + "/b")
    lost = spark.read.parquet(path + "/a")
    from sediment.sources import filesystem

    filesystem.delete(spark, path + "/a")
    df, place = checks.first_readable(lambda: spark.read.parquet(path + "/never"), lambda: lost, lambda: spark.read.parquet(path + "/b"))
    assert (df.count(), place) == (5, 2)
    with pytest.raises(Exception, match="never"):
        checks.first_readable(lambda: lost, lambda: spark.read.parquet(path + "/never"))
    assert checks.first_readable(lambda: spark.range(0))[1] == 0
