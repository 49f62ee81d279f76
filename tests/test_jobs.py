import json
from datetime import timedelta

import pytest

from sediment import jobs
from sediment.operators.checks import previous_rows
from sediment.operators.health import HEALTH_TABLE
from sediment.plans.maintenance import COMPACT, EXPIRE, FOLD, UpkeepFailed, collect_health, maintain, scope_of
from sediment.sources.catalog import TableRoot
from sediment.sources.versioned import PENDING, by_day
from tests.conftest import rows
from tests.helpers import log, utc

CONFIG = {
    "pipelines": [{"bronze": "shop_raw.orders", "keys": ["id"], "bucket_count": 2}],
    "bronze_namespaces": ["shop_raw", "absent_raw"],
    "maintain_namespaces": ["web_raw"],
    "retention": {"web_raw.log": {"days": 10, "col": "ts"}},
}
NOW = utc(2026, 6, 1)


@pytest.fixture
def root(spark, path):
    root = TableRoot(spark, path + "/tables")
    flat = spark.createDataFrame([(1, utc(2026, 1, 1)), (2, utc(2026, 5, 31))], "id long, ts timestamp")
    for day in ("2026-01-01", "2026-05-31"):
        root.table("shop_raw.orders").append(log(spark, [(1, day, "1", "U", f"{day} 00:00:00", 1), (2, day, "1", "U", f"{day} 00:00:00", 2)]), by_day("_cdc.ts"))
        jobs.merge(root, CONFIG)
    for name in ("shop_raw.orders__quarantine", "web_raw.log", "web_raw.kept", "sandbox.report"):
        root.table(name).append(flat, by_day("ts"))
    return root


def test_scope(root):
    scope = scope_of(root, CONFIG)
    assert scope.silver == ("shop.orders",) and scope.silver_namespaces == ["shop"]
    assert scope.bronze == ("shop_raw.orders", "shop_raw.orders__quarantine")
    assert scope.extra == ("web_raw.kept", "web_raw.log") and scope.others == ("sandbox.report",)
    assert scope.of(FOLD) == scope.silver and "sandbox.report" in scope.of(EXPIRE) and "sandbox.report" not in scope.of(COMPACT)


def test_modes(root):
    scope = scope_of(root, CONFIG)
    state = root.table("shop.orders")
    assert state.head().of(PENDING) and previous_rows(state) == 2
    maintain(root, scope, FOLD, NOW)
    assert not state.head().of(PENDING) and rows(state.read(), "status") == [("2026-05-31",)] * 2
    health = root.table(HEALTH_TABLE).read()
    assert rows(health, "table", "layer", "records") == [
        ("sandbox.report", "sandbox", 2), ("shop.orders", "silver", 2), ("shop_raw.orders", "bronze", 4),
        ("shop_raw.orders__quarantine", "bronze", 2), ("web_raw.kept", "bronze", 2), ("web_raw.log", "bronze", 2),
    ]
    maintain(root, scope, COMPACT, NOW)
    maintain(root, scope, EXPIRE, NOW)
    counts = {t: root.table(t).read().count() for t in scope.of(EXPIRE)}
    assert counts == {"shop.orders": 2, "shop_raw.orders": 2, "shop_raw.orders__quarantine": 1, "web_raw.kept": 2, "web_raw.log": 1, "sandbox.report": 2}
    with pytest.raises(ValueError):
        maintain(root, scope, "nothing", NOW)


def test_old_versions_and_files_go(root):
    scope = scope_of(root, CONFIG)
    later = utc(2100, 1, 1)
    maintain(root, scope, FOLD, NOW)
    maintain(root, scope, EXPIRE, later)
    state = root.table("shop.orders")
    assert len(state.versions()) == 1 and state.read().count() == 2
    assert len({u.path for u in state.head().units}) == len(state.referenced())
    # the raw table lost the version the state was merged from; the next run still finds its way
    root.table("shop_raw.orders").append(log(root.spark, [(3, "x", "1", "I", "2026-05-31 10:00:00", 9)]), by_day("_cdc.ts"))
    jobs.merge(root, CONFIG)
    assert rows(state.read(), "id") == [(1,), (2,), (3,)]


def test_measurements_are_kept_ninety_days(root):
    collect_health(root, ["shop"], NOW - timedelta(days=100))
    collect_health(root, ["shop"], NOW)
    health = root.table(HEALTH_TABLE).read()
    assert {r["measured_at"].date().isoformat() for r in health.select("measured_at").collect()} == {"2026-06-01"}
    assert HEALTH_TABLE not in {r["table"] for r in health.collect()}


def test_a_failing_table_does_not_hold_up_the_others(root, monkeypatch):
    scope = scope_of(root, CONFIG)
    real = root.table

    def table(name):
        if name == "shop_raw.orders":
            raise RuntimeError("unreadable")
        return real(name)

    monkeypatch.setattr(root, "table", table)
    with pytest.raises(UpkeepFailed, match="shop_raw.orders: unreadable"):
        maintain(root, scope, EXPIRE, NOW)
    assert real("web_raw.log").read().count() == 1


def test_commands(spark, root, path, capsys):
    with open(path + "/pipelines.json", "w") as out:
        json.dump(CONFIG, out)
    shared = ["--config", path + "/pipelines.json", "--root", root.root]
    jobs.main(["merge", *shared])
    jobs.main(["upkeep", *shared, "--mode", "compact"])
    with pytest.raises(SystemExit):
        jobs.main(["upkeep", *shared, "--mode", "unknown"])
    spark.sql(f"CREATE NAMESPACE IF NOT EXISTS jobs_ns LOCATION '{path}/w'")
    root.table("shop.orders").read().write.option("header", "true").csv(path + "/csv")
    jobs.main(["register", "--source", path + "/csv", "--format", "csv", "--table", "jobs_ns.t"])
    assert "jobs_ns.t: 2 rows" in capsys.readouterr().out


def test_landing_and_report_commands(spark, path, capsys):
    from sediment.model import KAFKA_SCHEMA

    body = {"op": "c", "ts_ms": 1757600000000, "before": None, "after": {"id": 1, "status": "new"}, "source": {"schema": "public", "table": "orders"}}
    sent = [("{\"id\":1}", json.dumps(body), "shop.public.orders", 0, 0, NOW), (None, '{"t":"1.5"}', "sensors", 0, 0, NOW), (None, "nope", "sensors", 0, 1, NOW)]
    spark.createDataFrame(sent, KAFKA_SCHEMA).write.parquet(path + "/topic")
    line = '10.0.0.1 - - [11/Sep/2026:13:52:24 +0000] "GET /index.html HTTP/1.1" 200 512 "-" "curl/8.0"'
    spark.createDataFrame([(line, "w1")], "value string, server string").write.partitionBy("server").text(path + "/lines")
    config = {
        "changes": {"prefix": "shop", "target": "shop_raw.{table}", "dead": "shop_raw.dead"},
        "streams": [{"topic": "sensors", "table": "iot_raw.sensors", "contract": {"t": "float64"}}],
        "log": {"table": "web_raw.access_log"}, "web": {"log": "web_raw.access_log", "namespace": "gold"},
        "checks": [{"table": "shop_raw.orders", "rows": 1, "exact": True, "must": [{"status": {"contains": "ne"}}], "must_not": [{"status": "old"}]}],
    }
    with open(path + "/c.json", "w") as out:
        json.dump(config, out)
    root = TableRoot(spark, path + "/tables")
    shared = ["--config", path + "/c.json", "--root", root.root]
    jobs.main(["changes", *shared, "--files", path + "/topic"])
    jobs.main(["json", *shared, "--files", path + "/topic"])
    jobs.main(["log", *shared, "--files", path + "/lines"])
    jobs.main(["web", *shared])
    jobs.main(["check", *shared])
    jobs.main(["report", "--root", root.root, "--table", "shop_raw.orders", "--by", "status"])
    assert rows(root.table("shop_raw.orders").read(), "id", "status") == [(1, "new")]
    assert rows(root.table("iot_raw.sensors").read(), "t") == [(1.5,)] and root.table("iot_raw.sensors__dead").read().count() == 1
    assert rows(root.table("web_raw.access_log").read(), "code", "server") == [(200, "w1")]
    assert spark.read.parquet(root.root + "/gold/web_hourly").select("requests", "computed_at").count() == 1
    out = capsys.readouterr().out
    assert "shop_raw.orders: must_0 >= 1, 1: ok" in out and "new" in out
    config["checks"][0]["rows"] = 2
    with open(path + "/c.json", "w") as file:
        json.dump(config, file)
    with pytest.raises(SystemExit):
        jobs.main(["check", *shared])
