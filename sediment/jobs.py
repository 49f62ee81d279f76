"""The scheduled jobs as commands.

    python -m sediment.jobs merge     --config pipelines.json --root <folder>
    python -m sediment.jobs documents --config pipelines.json --root <folder> --option kafka.bootstrap.servers=…
    python -m sediment.jobs upkeep    --config pipelines.json --root <folder> --mode fold|compact|expire
    python -m sediment.jobs changes   --config pipelines.json --root <folder> --option … (or --files <folder>)
    python -m sediment.jobs json      --config pipelines.json --root <folder> --option … (or --files <folder>)
    python -m sediment.jobs log       --config pipelines.json --root <folder> --files <folder with server=… folders>
    python -m sediment.jobs web       --config pipelines.json --root <folder>
    python -m sediment.jobs report    --root <folder> --table ns.table --by column
    python -m sediment.jobs check     --config pipelines.json --root <folder>
    python -m sediment.jobs register  --source <folder> --format csv|parquet --table ns.table [--header true]

The configuration has ``pipelines`` and may have ``bronze_namespaces``, ``maintain_namespaces``, ``retention``
(table -> days, col), ``mongo`` (topic and raw table of each document collection), ``changes`` (prefix, target, dead,
signal), ``streams`` (topic, table, contract, millis, whole), ``log`` (table), ``web`` (log, namespace) and ``checks``
(table, rows, exact, must, must_not; a condition ``{"contains": text}`` asks for a part).  The landing commands read
Kafka, or files of records of the same shape.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.model import QUARANTINE_SUFFIX, read_pipelines
from sediment.operators.checks import Contains, TableCheck, check_table
from sediment.plans import web
from sediment.plans.business import count_by
from sediment.plans.maintenance import MODES, maintain, scope_of
from sediment.session import SETTINGS
from sediment.sources import files, filesystem, kafka
from sediment.sources.catalog import TableRoot
from sediment.sources.tables import for_each
from sediment.streaming import landing
from sediment.streaming.silver import run_all

DEAD_SUFFIX = "__dead"


def _session(name: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def merge(root: TableRoot, config: dict) -> None:
    """Bring every state table up to date."""
    run_all(read_pipelines(config), lambda p: root.table(p.bronze), lambda p: root.table(p.target))


def documents(root: TableRoot, config: dict, options: dict[str, str]) -> None:
    """Land what has arrived for every document collection."""

    def land(entry: dict) -> None:
        bronze = entry["bronze"]
        stream = kafka.kafka_stream(root.spark, topics=[entry["topic"]], **options)
        checkpoint = f"{root.root}/_checkpoints/{entry['topic']}"
        landing.land_documents(stream, root.table(bronze), root.table(bronze + QUARANTINE_SUFFIX), bronze, checkpoint).awaitTermination()

    failures = for_each(config.get("mongo") or (), land)
    if failures:
        raise RuntimeError("; ".join(f"{e['topic']}: {error}" for e, error in failures))


def _records(root: TableRoot, given: argparse.Namespace, **chosen) -> DataFrame:
    """The stream of a landing command."""
    if given.files:
        return kafka.file_stream(root.spark, given.files)
    return kafka.kafka_stream(root.spark, **chosen, **dict(o.split("=", 1) for o in given.option))


def land_tables(root: TableRoot, config: dict, given: argparse.Namespace) -> None:
    """Land the change events of every table of a relational source."""
    entry = config["changes"]
    pattern = kafka.topic_pattern(entry["prefix"], entry.get("signal", ""))
    stream = _records(root, given, pattern=pattern)
    chosen = kafka.source_topics(stream, entry["prefix"], entry.get("signal", ""))
    checkpoint = f"{root.root}/_checkpoints/{entry['prefix']}"
    landing.land_changes(chosen, root.table, root.table(entry["dead"]), entry["target"], checkpoint).awaitTermination()


def land_streams(root: TableRoot, config: dict, given: argparse.Namespace) -> None:
    """Land the JSON event streams."""

    def land(entry: dict) -> None:
        stream = _records(root, given, topics=[entry["topic"]]).where(F.col("topic") == entry["topic"])
        more = entry.get("contract"), f"{root.root}/_checkpoints/{entry['topic']}"
        tables = root.table(entry["table"]), root.table(entry["table"] + DEAD_SUFFIX)
        landing.land_json(stream, *tables, *more, millis=entry.get("millis", ()), whole=entry.get("whole", ())).awaitTermination()

    failures = for_each(config.get("streams") or (), land)
    if failures:
        raise RuntimeError("; ".join(f"{e['topic']}: {error}" for e, error in failures))


def land_log(root: TableRoot, config: dict, given: argparse.Namespace) -> None:
    """Land the access-log lines under ``server=…`` folders."""
    table = config["log"]["table"]
    lines = root.spark.readStream.schema("value string, server string").text(given.files)
    landing.land_access_log(lines, root.table(table), f"{root.root}/_checkpoints/{table}").awaitTermination()


def web_reports(root: TableRoot, config: dict) -> None:
    """Bring the traffic reports up to date."""
    entry, now = config["web"], datetime.now(timezone.utc)
    web.refresh(root.spark, root.table(entry["log"]).read(), f"{root.root}/{entry['namespace']}", now.date(), computed_at=now)


def check_tables(root: TableRoot, config: dict) -> bool:
    """Print every assertion; whether all hold."""

    def wanted(conditions: Sequence[dict]) -> list[dict]:
        return [{n: Contains(v["contains"]) if isinstance(v, dict) else v for n, v in c.items()} for c in conditions]

    good = True
    for entry in config.get("checks") or ():
        check = TableCheck(entry["rows"], bool(entry.get("exact")), wanted(entry.get("must", ())), wanted(entry.get("must_not", ())))
        for row in check_table(root.table(entry["table"]).read(), check).collect():
            print(f"{entry['table']}: {row['assertion']} {row['expected']}, {row['actual']}: {'ok' if row['ok'] else 'FAILED'}")
            good &= row["ok"]
    return good


def main(arguments: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="sediment.jobs")
    commands = parser.add_subparsers(dest="job", required=True)
    for job in ("merge", "documents", "upkeep", "changes", "json", "log", "web", "report", "check"):
        command = commands.add_parser(job)
        command.add_argument("--config", required=job != "report")
        command.add_argument("--root", required=True)
        if job in ("documents", "changes", "json"):
            command.add_argument("--option", action="append", default=[], metavar="NAME=VALUE")
        if job in ("changes", "json", "log"):
            command.add_argument("--files", required=job == "log")
    commands.choices["report"].add_argument("--table", required=True)
    commands.choices["report"].add_argument("--by", required=True)
    upkeep = commands.choices["upkeep"]
    upkeep.add_argument("--mode", required=True, choices=MODES)
    for flag, days in (("--version-days", 7), ("--bronze-version-days", 1), ("--orphan-days", 3), ("--bronze-ttl-days", 30)):
        upkeep.add_argument(flag, type=int, default=days)
    register = commands.add_parser("register")
    register.add_argument("--source", required=True)
    register.add_argument("--format", required=True, choices=files.FORMATS)
    register.add_argument("--table", required=True)
    register.add_argument("--header", default="true")
    given = parser.parse_args(arguments)

    spark = _session(f"sediment-{given.job}")
    if given.job == "register":
        count = files.register(spark, given.source, given.format, given.table, given.header.lower() == "true")
        print(f"{given.table}: {count} rows")
        return
    root = TableRoot(spark, given.root)
    if given.job == "report":
        count_by(root.table(given.table).read(), given.by).orderBy(given.by).show(1000, False)
        return
    config = json.loads(filesystem.read_text(spark, given.config))
    landings = {"changes": land_tables, "json": land_streams, "log": land_log}
    if given.job == "merge":
        merge(root, config)
    elif given.job in landings:
        landings[given.job](root, config, given)
    elif given.job == "web":
        web_reports(root, config)
    elif given.job == "check":
        if not check_tables(root, config):
            raise SystemExit(1)
    elif given.job == "documents":
        documents(root, config, dict(o.split("=", 1) for o in given.option))
    else:
        maintain(
            root, scope_of(root, config), given.mode, datetime.now(timezone.utc),
            version_days=given.version_days, bronze_version_days=given.bronze_version_days,
            orphan_days=given.orphan_days, bronze_ttl_days=given.bronze_ttl_days,
        )
    print(f"{given.job}: done")


if __name__ == "__main__":
    sys.exit(main())
