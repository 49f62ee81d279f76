"""The registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Times and days come out as text, so that two engines print them alike.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date, datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sediment.model import COPY_ON_WRITE, META, Pipeline
from sediment.operators import access, checks, health, history, offsets, schema, upkeep
from sediment.operators.access import Person, secured_view
from sediment.operators.latest import OP, current_state, latest_per_key, newest_event_time
from sediment.operators.merge import merge_changes, merge_guarded, merged_view, next_tombstones, upsert
from sediment.plans import business, maintenance, web
from sediment.plans.folded import FoldedReports
from sediment.session import scratch_dir
from sediment.sources import accesslog, backfill, documents, envelopes, files, filesystem, jsonstream, kafka, liveload, tables
from sediment.sources.catalog import TableRoot
from sediment.sources.versioned import VersionedTable, by_day
from sediment.streaming import landing, silver
from sediment.streaming import latest as latest_stream
from sediment.streaming import web as web_stream
from workload import derive

NOW = datetime(2024, 1, 31, tzinfo=timezone.utc)
HALF = datetime(2024, 1, 16, tzinfo=timezone.utc)
NOON = datetime(2024, 1, 15, 12, tzinfo=timezone.utc)
SILVER = ("shop",)

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def query(work: Query) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return work(spark, sf)

    _REGISTRY[work.__name__] = run
    return run


def registered() -> dict[str, Query]:
    return dict(_REGISTRY)


def stamp(column: str | Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def stamped(df: DataFrame) -> DataFrame:
    """Times and dates as text, decimals as double."""

    def column(f: T.StructField) -> Column:
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            return stamp(f.name).alias(f.name)
        if isinstance(f.dataType, T.DateType):
            return F.col(f.name).cast("string").alias(f.name)
        if isinstance(f.dataType, T.DecimalType):
            return F.col(f.name).cast("double").alias(f.name)
        return F.col(f.name)

    return df.select(*(column(f) for f in df.schema.fields))


def _at(moment: datetime) -> Column:
    return F.col(f"{META}.ts") < F.lit(moment)


def _halves(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    return log.where(_at(HALF)), log.where(~_at(HALF))


def _deliveries(log: DataFrame, n: int) -> list[DataFrame]:
    """The log as ``n`` increments that do not follow event time."""
    return [log.where(F.col(f"{META}.offset") % n == i) for i in range(n)]


def _merge_all(batches: list[DataFrame], keys: list[str]) -> DataFrame:
    first, *rest = batches
    return reduce(lambda state, b: merge_changes(state, latest_per_key(b, keys), keys, unique=True), rest, current_state(first, keys))


# ---- latest change, merge, history ------------------------------------------------------------------------


@query
def latest_change_per_key(spark, sf):
    return stamped(latest_per_key(derive.changes(spark, sf), ["id"]))


@query
def latest_change_composite(spark, sf):
    return stamped(latest_per_key(derive.changes(spark, sf), ["id", "status"], {"amount": "decimal(20,2)"}))


@query
def latest_order_line(spark, sf):
    return stamped(latest_per_key(derive.order_line_changes(spark, sf), ["id"]))


@query
def current_state_of_orders(spark, sf):
    return stamped(current_state(derive.order_line_changes(spark, sf), ["id"]))


@query
def cdc_merge_two_batches(spark, sf):
    return stamped(_merge_all(list(_halves(derive.changes(spark, sf))), ["id"]))


@query
def cdc_merge_late_arrival(spark, sf):
    return stamped(_merge_all(_deliveries(derive.changes(spark, sf), 2), ["id"]))


@query
def cdc_merge_order_lines(spark, sf):
    log = derive.order_line_changes(spark, sf)
    cut = F.col(f"{META}.ts") < F.lit(datetime(1997, 1, 1, tzinfo=timezone.utc))
    return stamped(_merge_all([log.where(cut), log.where(~cut)], ["id"]))


@query
def cdc_merge_ts_guard(spark, sf):
    first, second = (
        latest_per_key(b.withColumn("at", F.col(f"{META}.ts")), ["id"]) for b in _deliveries(derive.changes(spark, sf), 2)
    )
    target = first.where(F.col(OP) != "D").drop(OP)
    return stamped(merge_guarded(target, second, ["id"], "at"))


def _written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    where = scratch_dir(spark, name)
    df.write.parquet(where)
    return spark.read.schema(df.schema).parquet(where)


@query
def merge_guard_after_delete(spark, sf):
    """Three increments that do not follow event time, the last one twice: deletes are remembered."""
    log = derive.changes(spark, sf).withColumn("at", F.col(f"{META}.ts"))
    state = log.drop(META).where("false")
    tombstones = None
    parts = _deliveries(log, 3)
    for part in [*parts, parts[-1]]:
        batch = _written(spark, latest_per_key(part, ["id"]), "batch")
        gone = next_tombstones(state, batch, ["id"], "at", tombstones)
        merged = merge_guarded(state, batch, ["id"], "at", tombstones)
        state, tombstones = _written(spark, merged, "state"), _written(spark, gone, "tombstones")
    alive = state.withColumn("deleted_at", F.lit(None).cast("timestamp"))
    return stamped(alive.unionByName(tombstones, allowMissingColumns=True))


@query
def cdc_merge_replay(spark, sf):
    log = derive.changes(spark, sf)
    first, second = _halves(log)
    return stamped(_merge_all([first, second, log.unionByName(log)], ["id"]))


@query
def upsert_star(spark, sf):
    orders = derive.table(spark, sf, "orders").withColumn("amount", F.col("o_totalprice").cast("decimal(18,2)"))
    finished = F.col("o_orderstatus") == "F"
    days = [business.daily_totals(orders.where(part), "o_orderdate", "amount") for part in (finished, ~finished)]
    return stamped(upsert(days[0], days[1], ["day"]))


@query
def mor_view(spark, sf):
    first, *rest = _deliveries(derive.changes(spark, sf), 3)
    pending = reduce(
        DataFrame.unionByName,
        (latest_per_key(b, ["id"]).withColumn("commit", F.lit(i)) for i, b in enumerate(rest)),
    )
    return stamped(merged_view(current_state(first, ["id"]), pending, ["id"]))


@query
def schema_reconcile_merge(spark, sf):
    log = derive.changes(spark, sf).withColumn("amount", F.col("amount").cast("double"))
    first, second = _halves(log)
    stored = current_state(first.withColumn("amount", F.col("amount").cast("float")), ["id"])
    changes = latest_per_key(second.withColumn("note", F.concat(F.lit("n"), F.col(f"{META}.offset"))), ["id"])
    plan = schema.plan_changes("app.events", stored.schema, changes.drop(OP).schema)
    return merge_changes(schema.conform(stored, plan.applied_to(stored.schema)), changes, ["id"], unique=True)


@query
def state_as_of(spark, sf):
    return stamped(history.state_as_of(derive.changes(spark, sf), ["id"], NOON))


@query
def record_history(spark, sf):
    return stamped(history.record_history(derive.changes(spark, sf), ["id"]))


@query
def orders_as_of_event(spark, sf):
    """Each order with the state of a user at a time, by intervals of validity."""
    hour = F.timestamp_seconds(F.lit(1704067200) + (F.col("o_orderkey") % 720) * 3600)
    facts = derive.table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 200).alias("id"), hour.alias("at"))
    states = history.validity(derive.changes(spark, sf), ["id"], 86400)
    return stamped(history.as_of_join(facts, states, ["id"], "at", 86400))


@query
def newest_event(spark, sf):
    return stamped(newest_event_time(derive.changes(spark, sf)))


@query
def op_histogram(spark, sf):
    return history.op_histogram(derive.changes(spark, sf))


@query
def initial_load_state(spark, sf):
    customers = derive.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("status"), F.col("c_acctbal").cast("decimal(18,2)").alias("amount")
    )
    copied = backfill.as_changes(customers, ["id"], HALF, "app.public.customer", "app_raw.events")
    live = derive.changes(spark, sf)
    # the copied rows may come twice: a load that is cut short starts again
    log = copied.unionByName(copied).unionByName(live)
    return stamped(current_state(log, ["id"]))


# ---- documents, envelopes, JSON streams -------------------------------------------------------------------


@query
def document_bronze(spark, sf):
    rows = documents.bronze_rows(documents.classify(derive.document_events(spark, sf)), "crm_raw.customers")
    return stamped(rows.select("_id", "_doc", f"{META}.op", f"{META}.ts", f"{META}.offset", f"{META}.source", f"{META}.target", F.col(f"{META}.key._id").alias("key_id")))


@query
def document_quarantine(spark, sf):
    return stamped(documents.quarantine_rows(documents.classify(derive.document_events(spark, sf))))


@query
def document_quarantine_by_reason(spark, sf):
    return business.count_by(documents.quarantine_rows(documents.classify(derive.document_events(spark, sf))), "reason")


@query
def document_state(spark, sf):
    rows = documents.bronze_rows(documents.classify(derive.document_events(spark, sf)), "crm_raw.customers")
    return current_state(rows, ["_id"])


@query
def document_last_changes(spark, sf):
    rows = documents.bronze_rows(documents.classify(derive.document_events(spark, sf)), "crm_raw.customers")
    return stamped(history.last_changes(rows, 3, name="$.name"))


_ROW = T.StructType().add("id", "long").add("status", "string").add("amount", T.DecimalType(18, 2))


def _events(spark, sf):
    chosen = kafka.source_topics(derive.envelopes(spark, sf), "app.public")
    return envelopes.read_envelopes(chosen, _ROW, ["id"], "app_raw.{table}")


@query
def change_event_flatten(spark, sf):
    rows = envelopes.flatten(_events(spark, sf))
    return stamped(rows.select("id", "status", "amount", f"{META}.op", f"{META}.ts", f"{META}.offset", f"{META}.source", f"{META}.target", F.col(f"{META}.key.id").alias("key_id")))


@query
def change_event_dead_letters(spark, sf):
    return stamped(envelopes.dead_letters(_events(spark, sf)))


@query
def topic_route_counts(spark, sf):
    return envelopes.route_counts(_events(spark, sf))


_JSON = T.StructType().add("kind", "string").add("props", T.StructType().add("k", "long"))


@query
def json_contract_good(spark, sf):
    rows = jsonstream.good_rows(jsonstream.read_json(derive.json_events(spark, sf), _JSON, derive.CONTRACT))
    return stamped(rows.select("user_id", "value", "kind", F.col("props.k").alias("props_k"), "_kafka_ts"))


@query
def json_contract_dead_letter(spark, sf):
    return stamped(jsonstream.dead_letters(jsonstream.read_json(derive.json_events(spark, sf), _JSON, derive.CONTRACT)).drop("key"))


@query
def json_inferred(spark, sf):
    records = derive.json_events(spark, sf)
    found = jsonstream.infer_schema(records, derive.CONTRACT)
    rows = jsonstream.good_rows(jsonstream.read_json(records, found, derive.CONTRACT))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("rows"), F.sum("props.k").alias("props_k"), F.sum("user_id").alias("user_ids"))


# ---- access log and web reports ---------------------------------------------------------------------------


@query
def access_log_parse(spark, sf):
    return stamped(derive.access_log(spark, sf))


@query
def unparsed_lines(spark, sf):
    return stamped(accesslog.unparsed(derive.access_log(spark, sf)).select("ts", "server", "log"))


@query
def lines_by_server(spark, sf):
    return web.lines_by_server(derive.access_log(spark, sf))


def _requests(spark, sf):
    return web.requests(derive.access_log(spark, sf))


@query
def web_hourly(spark, sf):
    return stamped(web.hourly(_requests(spark, sf)))


@query
def web_ip_daily(spark, sf):
    return stamped(web.ip_daily(_requests(spark, sf)))


@query
def web_page_daily(spark, sf):
    return stamped(web.page_daily(_requests(spark, sf)))


@query
def web_recent_days(spark, sf):
    recent = web.recent_days(derive.access_log(spark, sf), date(2024, 1, 30))
    return stamped(web.hourly(web.requests(recent)))


@query
def web_reports_refreshed(spark, sf):
    """The report tables written once in full and once for the last days, then read back."""
    root, log = scratch_dir(spark, "web"), derive.access_log(spark, sf)
    for _ in range(2):
        folders = web.refresh(spark, log, root, date(2024, 1, 30), computed_at=NOW)
    return stamped(spark.read.parquet(folders["web_ip_daily"]).select("day", "ip", "requests", "client_error_4xx", "distinct_pages", "servers", "bot", "computed_at"))


def _folded(spark: SparkSession, sf: str) -> FoldedReports:
    """The log in two increments that do not follow its time, the second one twice."""
    reports, log = FoldedReports(spark, scratch_dir(spark, "folded")), derive.access_log(spark, sf)
    part = F.pmod(F.xxhash64("remote", "ts", "path"), F.lit(2))
    for k in (0, 1, 1):
        reports.fold(log.where(part == k), ("log", k))
    return reports


@query
def web_hourly_folded(spark, sf):
    return stamped(_folded(spark, sf).hourly())


@query
def web_ip_daily_folded(spark, sf):
    return stamped(_folded(spark, sf).ip_daily())


@query
def web_page_daily_folded(spark, sf):
    return stamped(_folded(spark, sf).page_daily())


@query
def web_error_share(spark, sf):
    return web.error_share(web.hourly(_requests(spark, sf)))


@query
def web_by_status_class(spark, sf):
    return stamped(web.by_status_class(web.hourly(_requests(spark, sf))))


@query
def web_by_server(spark, sf):
    return stamped(web.by_server(web.hourly(_requests(spark, sf))))


@query
def web_top_suspicious_ip(spark, sf):
    return web.suspicious_ips(web.ip_daily(_requests(spark, sf)))


@query
def web_top_suspicious_fast(spark, sf):
    return web.suspicious_ips_fast(web.requests(derive.access_log(spark, sf)))


@query
def web_top_error_pages(spark, sf):
    return web.error_pages(web.page_daily(_requests(spark, sf)))


# ---- business reports -------------------------------------------------------------------------------------


@query
def status_count(spark, sf):
    return business.count_by(derive.table(spark, sf, "orders"), "o_orderstatus")


@query
def orders_daily(spark, sf):
    orders = derive.table(spark, sf, "orders").withColumn("amount", F.col("o_totalprice").cast("decimal(18,2)"))
    return stamped(business.daily_totals(orders, "o_orderdate", "amount", "o_orderstatus"))


@query
def daily_summary(spark, sf):
    orders = derive.table(spark, sf, "orders").withColumn("amount", F.col("o_totalprice").cast("decimal(18,2)"))
    return stamped(business.daily_totals(orders, "o_orderdate", "amount"))


@query
def distinct_after_join(spark, sf):
    customer, nation = derive.table(spark, sf, "customer"), derive.table(spark, sf, "nation")
    orders = derive.table(spark, sf, "orders").where(F.col("o_orderstatus") == "O")
    links = [(customer, F.col("o_custkey") == F.col("c_custkey")), (nation, F.col("c_nationkey") == F.col("n_nationkey"))]
    return business.distinct_through(orders, links, "n_name", "o_custkey")


@query
def avg_by_group(spark, sf):
    events = derive.table(spark, sf, "events").withColumn("cents", F.round(F.col("value") * 100).cast("bigint"))
    return business.average_by(events, "event_type", "cents")


# ---- positions --------------------------------------------------------------------------------------------


@query
def next_offsets(spark, sf):
    return offsets.next_offsets(derive.records(spark, sf))


def _saved(records: DataFrame) -> DataFrame:
    return offsets.next_offsets(records.where(F.col("timestamp") < F.lit(HALF)))


@query
def merged_offsets(spark, sf):
    """Saved positions of every topic; the later delivery brought records of two of them."""
    records = derive.records(spark, sf)
    later = records.where((F.col("timestamp") >= F.lit(HALF)) & F.col("topic").isin("app.public.view", "app.public.click"))
    return offsets.merge_offsets(_saved(records), offsets.next_offsets(later))


@query
def starting_offsets(spark, sf):
    records = derive.records(spark, sf)
    partitions = records.select("topic").distinct().select("topic", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("partition"))
    return offsets.starting_offsets(_saved(records.where(F.col("topic") != "app.public.error")), partitions)


@query
def starting_offsets_text(spark, sf):
    return offsets.offsets_json(offsets.next_offsets(derive.records(spark, sf)))


@query
def offset_backlog(spark, sf):
    records = derive.records(spark, sf)
    # nothing was ever committed for partition 3
    committed = _saved(records).where("partition <> 3").withColumn("group", F.lit("sink-app"))
    return offsets.backlog(offsets.next_offsets(records), committed, 100)


# ---- health, versions, retention --------------------------------------------------------------------------


@query
def table_health(spark, sf):
    return stamped(health.table_health(derive.commits(spark, sf), SILVER, NOW))


def _measurements(spark, sf):
    """A measurement per table and day."""
    daily = derive.commits(spark, sf).select(
        "table",
        F.date_trunc("DAY", "committed_at").alias("measured_at"),
        health.layer_of(F.substring_index("table", ".", 1), SILVER).alias("layer"),
        F.element_at("summary", "total-records").try_cast("bigint").alias("records"),
        F.element_at("summary", "total-data-files").try_cast("bigint").alias("data_files"),
    )
    return daily.withColumn("avg_file_mib", F.bround(F.col("records") / F.nullif(F.col("data_files"), F.lit(0)), 3))


@query
def table_health_latest(spark, sf):
    return stamped(health.latest_health(_measurements(spark, sf)))


@query
def health_hourly_trend(spark, sf):
    return stamped(health.health_trend(_measurements(spark, sf)))


@query
def health_file_size(spark, sf):
    return health.file_size_by_table(_measurements(spark, sf))


@query
def newest_commits(spark, sf):
    return stamped(health.newest_commits(derive.commits(spark, sf)))


@query
def expired_versions(spark, sf):
    return stamped(upkeep.expired_versions(derive.commits(spark, sf), NOW, SILVER).select("table", "version", "committed_at"))


@query
def unreferenced_files(spark, sf):
    good = derive.table(spark, sf, "supplier").where(F.col("s_acctbal") > 0)
    referenced = good.select(F.concat(F.lit("commit="), F.col("s_suppkey").cast("string")).alias("folder"))
    listing = derive.file_rows(spark, sf).select("path", "folder", "modified")
    return stamped(upkeep.unreferenced_files(listing, referenced, datetime(1998, 1, 1, tzinfo=timezone.utc)))


@query
def small_file_partitions(spark, sf):
    return upkeep.small_file_parts(derive.file_rows(spark, sf), "folder", 64 << 20)


@query
def file_stats(spark, sf):
    stats = health.file_stats(derive.file_rows(spark, sf))
    return stats.select("file_format", "files", "records", F.round("size_mib", 3).alias("size_mib"), F.round("avg_file_mib", 3).alias("avg_file_mib"))


@query
def retention_kept_rows(spark, sf):
    return stamped(upkeep.retained(derive.changes(spark, sf), NOW, 10).select("id", "status", "amount", f"{META}.ts", f"{META}.offset"))


@query
def bounded_fallback_rows(spark, sf):
    log = derive.changes(spark, sf)
    table = VersionedTable(spark, scratch_dir(spark, "bronze"))
    head = table.append(log, by_day(f"{META}.ts"))
    recent = table.scan_from(head, datetime(2024, 1, 28, 12, tzinfo=timezone.utc))
    return stamped(recent.select("id", "status", "amount", f"{META}.ts", f"{META}.offset"))


@query
def stale_tables(spark, sf):
    return stamped(health.stale_tables(derive.commits(spark, sf), NOW, 600).drop("age_seconds"))


@query
def dead_letters_recent(spark, sf):
    dead = jsonstream.dead_letters(jsonstream.read_json(derive.json_events(spark, sf), _JSON, derive.CONTRACT))
    return health.recent_dead_letters(dead, datetime(2024, 1, 30, 18, tzinfo=timezone.utc), hours=24)


@query
def unknown_tables(spark, sf):
    catalog = derive.commits(spark, sf).select("table").distinct()
    layers = catalog.withColumn("layer", health.layer_of(F.substring_index("table", ".", 1), SILVER))
    return tables.unknown_tables(catalog, layers.where(F.col("layer") == "silver"), layers.where(F.col("layer") == "bronze"))


# ---- access rules and checks ------------------------------------------------------------------------------

RULES = {
    "catalogs": [
        {"group": "analysts", "catalog": "main", "allow": "all"},
        {"group": "users", "catalog": "main", "allow": "read-only"},
    ],
    "tables": [
        {"group": "analysts", "privileges": ["SELECT"]},
        {
            "group": "users", "schema": "shop", "table": "orders", "privileges": ["SELECT"],
            "filter": "o_orderstatus <> 'F'", "columns": [{"name": "o_custkey", "mask": "0"}],
        },
        {
            "group": "users", "schema": "web_raw", "table": "access_log", "privileges": ["SELECT"],
            "columns": [{"name": "remote", "mask": "'x.x.x.x'"}],
        },
        {"group": "users", "privileges": ["SELECT"]},
    ],
}


@query
def secured_orders(spark, sf):
    orders = derive.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return secured_view(orders, RULES, Person("u", ("users",)), "main", "shop", "orders")


@query
def analyst_orders(spark, sf):
    orders = derive.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return secured_view(orders, RULES, Person("a", ("analysts",)), "main", "shop", "orders")


@query
def masked_log(spark, sf):
    log = secured_view(derive.access_log(spark, sf), RULES, Person("u", ("users",)), "main", "web_raw", "access_log")
    return log.select("remote", "path", "code", "size", "server")


@query
def effective_rights(spark, sf):
    """Everybody's rights on every table: persons are the customers in groups by segment, tables the parts' brands by type."""
    segment = F.lower("c_mktsegment")
    groups = F.when(F.col("c_custkey") % 3 == 0, F.array(segment, F.lit("admins"))).otherwise(F.array(segment))
    persons = derive.table(spark, sf, "customer").select(F.concat(F.lit("u"), "c_custkey").alias("user"), groups.alias("groups"))
    brands = derive.table(spark, sf, "part").select(F.lower(F.translate("p_brand", "#", "_")).alias("table")).distinct()
    schema = F.when(F.col("table").rlike("[13]$"), "odd").otherwise("even")
    tables = brands.select(F.lit("main").alias("catalog"), schema.alias("schema"), "table")
    rights = access.effective_rights(spark, BRAND_RULES, persons, tables)
    return rights.select("user", "schema", "table", "rule", F.array_join("privileges", ",").alias("privileges"), "row_filter", F.size("masks").cast("long").alias("masks"))


@query
def table_assertions(spark, sf):
    check = checks.TableCheck(
        rows=100,
        must=[{"o_orderstatus": "O", "o_orderpriority": checks.Contains("URGENT")}, {"o_orderstatus": "X"}],
        must_not=[{"o_orderstatus": "X"}, {"o_orderstatus": "F", "o_orderdate": checks.Contains("1997-")}],
    )
    return checks.check_table(derive.table(spark, sf, "orders"), check)


@query
def reconcile_counts(spark, sf):
    log = derive.changes(spark, sf)
    return checks.reconcile({"bronze": log, "silver": current_state(log, ["id"]), "source": log.unionByName(log)}, ["id"])


BRAND_RULES = {
    "tables": [
        {"user": "u1[0-9]*", "schema": "odd", "privileges": []},
        {"group": "admins", "catalog": "main", "privileges": ["SELECT", "INSERT"]},
        {"group": "building|machinery", "table": "brand_[12].*", "privileges": ["SELECT"], "filter": "region = 1", "columns": [{"name": "price", "mask": "0"}]},
        {"user": "u2.*", "schema": "e.*", "privileges": ["SELECT"]},
    ]
}


@query
def validated_read(spark, sf):
    """An increment whose files are gone is noticed by asking for a row; the whole log is read in its place."""
    root = scratch_dir(spark, "probe")
    log = derive.changes(spark, sf)
    log.where(_at(HALF)).write.parquet(f"{root}/increment")
    log.write.parquet(f"{root}/log")
    increment = spark.read.schema(log.schema).parquet(f"{root}/increment")
    filesystem.delete(spark, f"{root}/increment")
    read, place = checks.first_readable(lambda: increment, lambda: spark.read.schema(log.schema).parquet(f"{root}/log"))
    return stamped(read.select("id", "status", "amount", F.lit(place).cast("long").alias("place")))


# ---- written tables and streams ---------------------------------------------------------------------------


@query
def reconcile_ranges(spark, sf):
    """Orders against a copy that lost some, changed some and has some of its own."""
    orders = derive.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    key = F.col("o_orderkey")
    status = F.when(key % 89 == 0, "X").otherwise(F.col("o_orderstatus"))
    copy = orders.where(key % 97 != 0).withColumn("o_orderstatus", status)
    own = orders.where(key % 101 == 0).withColumn("o_orderkey", -key - 1)
    return checks.reconcile_ranges(spark, orders, copy.unionByName(own), ["o_orderkey"], fetched_rows=1000)


def _pipeline(mode: str, **more) -> Pipeline:
    return Pipeline("app_raw.events", ("id",), mode, 4, **more)


def _two_runs(spark: SparkSession, sf: str, mode: str) -> VersionedTable:
    """Two raw appends, a pipeline run after each."""
    root = scratch_dir(spark, "pipeline")
    bronze, state = VersionedTable(spark, f"{root}/bronze"), VersionedTable(spark, f"{root}/silver")
    for half in _halves(derive.changes(spark, sf)):
        bronze.append(half, by_day(f"{META}.ts"))
        silver.run_pipeline(_pipeline(mode), bronze, state)
    return state


@query
def pipeline_merge_on_read(spark, sf):
    return stamped(_two_runs(spark, sf, "merge-on-read").read())


@query
def pipeline_copy_on_write(spark, sf):
    return stamped(_two_runs(spark, sf, COPY_ON_WRITE).read())


@query
def pipeline_folded(spark, sf):
    state = _two_runs(spark, sf, "merge-on-read")
    upkeep.fold(state)
    return stamped(state.read())


@query
def version_read(spark, sf):
    state = _two_runs(spark, sf, COPY_ON_WRITE)
    return stamped(state.read(version=state.versions()[-2]))


@query
def incremental_read(spark, sf):
    table = VersionedTable(spark, scratch_dir(spark, "bronze"))
    for half in _halves(derive.changes(spark, sf)):
        table.append(half, by_day(f"{META}.ts"))
    upkeep.compact(table, min_files=2)
    rows, _ = table.read_since(1, table.head())
    return stamped(rows.select("id", "status", "amount", f"{META}.op", f"{META}.ts", f"{META}.offset"))


@query
def compaction_rows(spark, sf):
    table = VersionedTable(spark, scratch_dir(spark, "bronze"))
    for part in _deliveries(derive.changes(spark, sf), 3):
        table.append(part, by_day(f"{META}.ts"))
    upkeep.compact(table, min_files=2)
    return stamped(table.read().select("id", "status", "amount", f"{META}.op", f"{META}.ts", f"{META}.offset"))


@query
def retention_drops_days(spark, sf):
    table = VersionedTable(spark, scratch_dir(spark, "bronze"))
    table.append(derive.changes(spark, sf), by_day(f"{META}.ts"))
    upkeep.apply_retention(table, NOW, 10)
    return stamped(table.read().select("id", "status", "amount", f"{META}.ts", f"{META}.offset"))


@query
def retention_flat_table(spark, sf):
    """Old rows of a table without day folders; only the appends that hold some are rewritten."""
    table = VersionedTable(spark, scratch_dir(spark, "bronze"))
    for half in _halves(derive.changes(spark, sf)):
        table.append(half)
    upkeep.apply_retention(table, NOW, 10)
    return stamped(table.read().select("id", "status", "amount", f"{META}.ts", f"{META}.offset"))


def _namespace(spark: SparkSession) -> str:
    """A new namespace of the catalog."""
    name = f"ns_{uuid.uuid4().hex}"
    spark.sql(f"CREATE NAMESPACE {name} LOCATION '{scratch_dir(spark, name)}'")
    return name


@query
def replaced_table(spark, sf):
    """A catalog table written anew, then appended to, read by name [K1, K2, S13]."""
    ns, orders = _namespace(spark), derive.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    tables.create_or_replace(orders, f"{ns}.orders")
    tables.create_or_replace(orders.where("o_orderstatus <> 'F'"), f"{ns}.orders")
    tables.append(orders.where("o_orderstatus = 'F'").select("o_orderkey", "o_orderstatus"), f"{ns}.orders")
    return tables.table_or_none(spark, f"{ns}.orders").select("o_orderkey", "o_orderstatus")


@query
def table_from_query(spark, sf):
    """A table made from a query and a view over it [K6]."""
    ns = _namespace(spark)
    tables.create_as(business.count_by(derive.table(spark, sf, "orders"), "o_orderstatus"), f"{ns}.by_status")
    tables.create_view(spark, f"{ns}.open_status", f"SELECT * FROM {ns}.by_status WHERE o_orderstatus <> 'F'")
    return spark.table(f"{ns}.open_status")


@query
def dropped_and_listed(spark, sf):
    """What a namespace lists after one of its tables was dropped with its data, and the rows of those left [K11, S13, S14]."""
    ns, orders = _namespace(spark), derive.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    for status in ("F", "O", "P"):
        tables.create_as(orders.where(F.col("o_orderstatus") == status), f"{ns}.orders_{status.lower()}")
    tables.drop_with_data(spark, f"{ns}.orders_o")
    assert tables.table_or_none(spark, f"{ns}.orders_o") is None
    listed = [n for n in tables.all_tables(spark, [ns, "no_such_namespace"])]
    rows = [spark.table(n).select(F.lit(n.split(".")[1]).alias("table"), "o_orderkey") for n in listed]
    return reduce(DataFrame.unionByName, rows)


@query
def registered_csv(spark, sf):
    folder = f"{scratch_dir(spark, 'csv')}/orders"
    derive.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.col("o_orderdate").cast("string").alias("o_orderdate")).write.option("header", "true").csv(folder)
    return files.read_files(spark, folder, "csv")


@query
def chunked_load(spark, sf):
    """A table loaded in key ranges; a second call finds nothing left to do."""
    orders = derive.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    table = VersionedTable(spark, scratch_dir(spark, "chunks"))
    for _ in range(2):
        backfill.load_in_chunks(table, orders, ["id"], 4, HALF, "app.public.orders", "app_raw.orders")
    return table.read().select("id", "status", f"{META}.op")


@query
def chunked_load_live(spark, sf):
    """A table loaded in key ranges while changes land, whose event times are older than the load's.

    Orders divisible by 11 changed before the load. Those divisible by 7 change while their own range is being read:
    every second one is deleted. Those divisible by 13 change after the load.
    """
    number = F.col("id")
    rows = derive.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    before, during = number % 11 == 0, (number % 7 == 0) & (number % 11 != 0)
    after = (number % 13 == 0) & ~before & ~during
    source = rows.withColumn("status", F.when(before, "E").otherwise(F.col("status")))
    table = VersionedTable(spark, scratch_dir(spark, "live"))
    bounds = [tuple(b if b is None else str(b) for b in pair) for pair in backfill.key_ranges(rows, "id", 4)]
    width = 1 + rows.agg(F.max("id")).first()[0]
    placed = 0

    def land(changed: Column, status: str, day: int, step: int, part: DataFrame = rows) -> None:
        op = F.when(changed & (number % 14 == 0) & during, "D").otherwise("U")
        ts = F.lit(datetime(2024, 1, day, tzinfo=timezone.utc))
        meta = F.struct(op.alias("op"), ts.alias("ts"), (number + step * width).alias("offset"), F.lit("app.public.orders").alias("source"), F.lit("app_raw.orders").alias("target"), F.struct("id").alias("key"))
        table.append(part.where(changed).select("id", F.lit(status).alias("status"), meta.alias(META)), by_day(f"{META}.ts"))

    def mark() -> liveload.Mark:
        nonlocal placed
        step, chunk = placed, placed // 2
        placed += 1
        if step % 2:  # between the marks of a range
            land(during, "L", 14, step, backfill.chunk(rows, "id", *bounds[chunk]))
        return liveload.Mark.at((step + 1) * width, HALF)

    def read(pair):
        return backfill.chunk(source, "id", *pair)

    land(before, "E", 12, -1)
    progress = liveload.Progress(0, 1)
    while progress.left:
        progress = liveload.load_live(table, read, bounds, ["id"], mark, "first", "app.public.orders", "app_raw.orders")
        land(after, "Z", 17, placed + 1)  # the feed goes on past the high mark
    return current_state(table.read(), ["id"])


def _maintained(spark: SparkSession, sf: str) -> TableRoot:
    """A raw table and its state, each half merged, then every kind of upkeep."""
    root = TableRoot(spark, scratch_dir(spark, "tables"))
    config = {"pipelines": [{"bronze": "app_raw.events", "keys": ["id"], "bucket_count": 4}], "bronze_namespaces": ["app_raw"]}
    for half in _halves(derive.changes(spark, sf)):
        root.table("app_raw.events").append(half, by_day(f"{META}.ts"))
        silver.run_pipeline(_pipeline("merge-on-read"), root.table("app_raw.events"), root.table("app.events"))
    scope = maintenance.scope_of(root, config)
    for mode in (maintenance.COMPACT, maintenance.EXPIRE, maintenance.FOLD):
        maintenance.maintain(root, scope, mode, NOW, bronze_ttl_days=10)
    return root


@query
def maintenance_state(spark, sf):
    return stamped(_maintained(spark, sf).table("app.events").read())


@query
def maintenance_health(spark, sf):
    return _maintained(spark, sf).table(health.HEALTH_TABLE).read().select("table", "layer", "records", "delete_files")


def _finish(running) -> None:
    running.awaitTermination()
    if running.exception():
        raise running.exception()


@query
def stream_merge(spark, sf):
    """The change log delivered in two steps, each merged by a run of the same stream."""
    root, log = scratch_dir(spark, "stream"), derive.changes(spark, sf)
    state = VersionedTable(spark, f"{root}/silver")
    for half in _halves(log):
        half.write.mode("append").parquet(f"{root}/log")
        stream = spark.readStream.schema(log.schema).parquet(f"{root}/log")
        _finish(silver.stream_merge(_pipeline(COPY_ON_WRITE), stream, state, f"{root}/checkpoint"))
    return stamped(state.read())


@query
def stream_documents(spark, sf):
    root, records = scratch_dir(spark, "stream"), derive.document_events(spark, sf)
    bronze, quarantine = VersionedTable(spark, f"{root}/bronze"), VersionedTable(spark, f"{root}/quarantine")
    for early in (True, False):
        half = records.where((F.col("timestamp") < F.lit(HALF)) == F.lit(early))
        half.write.mode("append").parquet(f"{root}/topic")
        _finish(landing.land_documents(kafka.file_stream(spark, f"{root}/topic"), bronze, quarantine, "crm_raw.customers", f"{root}/checkpoint"))
    kept = bronze.read().select(F.lit("bronze").alias("kind"), F.col(f"{META}.op").alias("label"))
    aside = quarantine.read().select(F.lit("quarantine").alias("kind"), F.col("reason").alias("label"))
    return business.count_by(kept.unionByName(aside), "kind", "label")


@query
def stream_changes(spark, sf):
    """No list of tables; two have declared columns and some amounts that do not fit, some rows bring a column of their own."""
    root = scratch_dir(spark, "stream")
    more = F.concat(F.lit('"note":"n'), F.col("offset").cast("string"), F.lit('","amount":'))
    misfit = (F.col("offset") % 13 == 0) & F.col("topic").rlike("(view|click)$")
    value = F.when(misfit, F.regexp_replace("value", '"amount":[0-9.]+', '"amount":"abc"')).otherwise(F.col("value"))
    value = F.when(F.col("offset") % 11 == 0, F.replace(value, F.lit('"amount":'), more)).otherwise(value)
    derive.envelopes(spark, sf).withColumn("value", value).write.parquet(f"{root}/topic")
    tables_at, dead = TableRoot(spark, f"{root}/raw"), VersionedTable(spark, f"{root}/dead")
    declared = {f"app_raw.{n}": _ROW for n in ("view", "click")}
    _finish(landing.land_changes(kafka.file_stream(spark, f"{root}/topic"), tables_at.table, dead, "app_raw.{table}", f"{root}/checkpoint", declared))
    landed = [
        tables_at.table(n).read().select(
            F.col(f"{META}.target").alias("target"), F.col(f"{META}.op").alias("op"), F.col(f"{META}.offset").alias("offset"),
            "id", "status", F.round(F.col("amount").cast("double"), 2).alias("amount"), "note",
        )
        for n in tables_at.tables()
    ]
    aside = dead.read().select(
        F.col("reason").alias("target"), F.lit("dead").alias("op"), "offset", *(F.lit(None).cast(t).alias(c) for c, t in (("id", "long"), ("status", "string"), ("amount", "double"), ("note", "string")))
    )
    return reduce(DataFrame.unionByName, [*landed, aside])


@query
def stream_two_sources(spark, sf):
    """Two servers' lines by two streams into one table."""
    root = scratch_dir(spark, "stream")
    lines = derive.access_lines(spark, sf).select("value", "server")
    table = VersionedTable(spark, f"{root}/log")
    for name, part in (("one", F.col("server") == "web01"), ("rest", F.col("server") != "web01")):
        lines.where(part).write.parquet(f"{root}/{name}")
        stream = spark.readStream.schema("value string, server string").parquet(f"{root}/{name}")
        _finish(landing.land_access_log(stream, table, f"{root}/checkpoint-{name}"))
    return table.read().groupBy("server", "code", "method").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"), F.count("log").alias("unparsed"))


@query
def stream_new_checkpoint(spark, sf):
    """The same stream after its checkpoint was renewed, over more input: the state misses nothing."""
    root, records = scratch_dir(spark, "stream"), derive.document_events(spark, sf)
    bronze, quarantine = VersionedTable(spark, f"{root}/bronze"), VersionedTable(spark, f"{root}/quarantine")
    for early in (True, False):
        records.where((F.col("timestamp") < F.lit(HALF)) == F.lit(early)).write.mode("append").parquet(f"{root}/topic")
        _finish(landing.land_documents(kafka.file_stream(spark, f"{root}/topic"), bronze, quarantine, "crm_raw.customers", f"{root}/checkpoint-{early}"))
    return current_state(bronze.read(), ["_id"])


@query
def stream_json(spark, sf):
    root = scratch_dir(spark, "stream")
    derive.json_events(spark, sf).write.parquet(f"{root}/topic")
    good, dead = VersionedTable(spark, f"{root}/good"), VersionedTable(spark, f"{root}/dead")
    _finish(landing.land_json(kafka.file_stream(spark, f"{root}/topic"), good, dead, derive.CONTRACT, f"{root}/checkpoint"))
    kept = good.read().select(F.lit("good").alias("kind"), F.col("props.k").alias("k"))
    return kept.unionByName(dead.read().select(F.col("reason").alias("kind"), F.lit(None).cast("bigint").alias("k"))).groupBy("kind").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("k").alias("k")
    )


@query
def stream_access_log(spark, sf):
    """Log lines of three servers delivered as text files, landed in one table."""
    root = scratch_dir(spark, "stream")
    derive.access_lines(spark, sf).select("value", "server").write.partitionBy("server").text(f"{root}/lines")
    lines = spark.readStream.schema("value string, server string").text(f"{root}/lines")
    table = VersionedTable(spark, f"{root}/log")
    _finish(landing.land_access_log(lines, table, f"{root}/checkpoint"))
    return table.read().groupBy("server", "code", "method").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"), F.count("log").alias("unparsed"))


@query
def stream_web_hourly(spark, sf):
    """The last counts of every hour after the whole log went through the stream, open hours too."""
    root = scratch_dir(spark, "stream")
    log = derive.access_log(spark, sf)
    log.write.parquet(f"{root}/log")
    stream = spark.readStream.schema(log.schema).parquet(f"{root}/log")
    table = VersionedTable(spark, f"{root}/hours")
    _finish(web_stream.land_hours(stream, table, f"{root}/checkpoint"))
    return stamped(web_stream.newest_hours(table.read()))


@query
def stream_hours_new_checkpoint(spark, sf):
    """A stream that has read part of the log, then one with a new checkpoint that reads all of it into the same table."""
    root = scratch_dir(spark, "stream")
    log = derive.access_log(spark, sf)
    early = F.pmod(F.xxhash64("remote", "ts"), F.lit(3)) > 0
    table = VersionedTable(spark, f"{root}/hours")
    for k, part in enumerate((early, ~early)):
        log.where(part).repartition(3).write.mode("append").parquet(f"{root}/log")
        stream = spark.readStream.schema(log.schema).parquet(f"{root}/log")
        _finish(web_stream.land_hours(stream, table, f"{root}/checkpoint-{k}"))
    return stamped(web_stream.newest_hours(table.read()))


@query
def stream_hourly_distinct(spark, sf):
    """Different addresses of every hour, counted as they come, over a restart; a last row that only tells the time closes all hours."""
    root = scratch_dir(spark, "stream")
    log = derive.access_log(spark, sf)
    table = VersionedTable(spark, f"{root}/hours")
    clock = log.agg((F.max("ts") + F.expr("INTERVAL 4 DAYS")).alias("ts"))
    parts = (F.col("ts") < F.lit(HALF), F.col("ts") >= F.lit(HALF))
    for part in (*(log.where(p) for p in parts), log.where("false").unionByName(clock, allowMissingColumns=True)):
        part.write.mode("append").parquet(f"{root}/log")
        stream = spark.readStream.schema(log.schema).parquet(f"{root}/log")
        _finish(web_stream.land_distinct(stream, table, f"{root}/checkpoint"))
    return stamped(table.read())


@query
def stream_latest_state(spark, sf):
    """The newest change per key in the stream's state, over three restarts on a log in the order of its time."""
    root = scratch_dir(spark, "stream")
    log = derive.changes(spark, sf)
    table = VersionedTable(spark, f"{root}/newest")
    cuts = [datetime(2024, 1, day, tzinfo=timezone.utc) for day in (1, 10, 20)]
    for low, high in zip(cuts, [*cuts[1:], datetime(2024, 2, 9, tzinfo=timezone.utc)]):
        at = F.col(f"{META}.ts")
        log.where((at >= F.lit(low)) & (at < F.lit(high))).write.mode("append").parquet(f"{root}/log")
        stream = spark.readStream.schema(log.schema).parquet(f"{root}/log")
        _finish(latest_stream.land_newest(stream, ["id"], table, f"{root}/checkpoint"))
    return stamped(current_state(table.read(), ["id"]))
