"""The scheduled upkeep of all tables, and the hourly health measurement."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime

from sediment.model import Pipeline, read_pipelines
from sediment.operators import health, upkeep
from sediment.sources.catalog import TableRoot
from sediment.sources.tables import for_each
from sediment.sources.versioned import Commit, by_day

FOLD, COMPACT, EXPIRE = "fold", "compact", "expire"
MODES = (FOLD, COMPACT, EXPIRE)


class UpkeepFailed(RuntimeError):
    def __init__(self, failures: Sequence[tuple[object, Exception]]):
        super().__init__("; ".join(f"{name}: {error}" for name, error in failures))
        self.failures = failures


@dataclass(frozen=True)
class Scope:
    """Which tables there are, by the care they get."""

    silver: tuple[str, ...] = ()
    bronze: tuple[str, ...] = ()
    extra: tuple[str, ...] = ()
    others: tuple[str, ...] = ()
    retention: Mapping[str, Mapping] = field(default_factory=dict)

    @property
    def silver_namespaces(self) -> list[str]:
        return sorted({t.rpartition(".")[0] for t in self.silver})

    def of(self, mode: str) -> tuple[str, ...]:
        """Pending changes exist in state tables only; tables this product does not know only lose old versions."""
        if mode == FOLD:
            return self.silver
        known = self.silver + self.bronze + self.extra
        return known if mode == COMPACT else known + self.others


def scope_of(root: TableRoot, config: Mapping) -> Scope:
    """Raw tables are found by listing, so append-only ones without a pipeline are cared for too."""
    pipelines: list[Pipeline] = read_pipelines(config)
    silver = tuple(p.target for p in pipelines)
    bronze = tuple(root.tables(config.get("bronze_namespaces") or (), [p.bronze for p in pipelines]))
    extra = tuple(root.tables(config.get("maintain_namespaces") or ()))
    known = {*silver, *bronze, *extra}
    others = tuple(t for t in root.tables() if t not in known)
    return Scope(silver, bronze, extra, others, config.get("retention") or {})


def maintain(
    root: TableRoot,
    scope: Scope,
    mode: str,
    now: datetime,
    *,
    version_days: int = upkeep.VERSION_DAYS["silver"],
    bronze_version_days: int = upkeep.VERSION_DAYS["bronze"],
    orphan_days: int = upkeep.ORPHAN_DAYS,
    bronze_ttl_days: int = upkeep.BRONZE_TTL_DAYS,
    at_once: int = 4,
) -> None:
    """One run over the tables of a mode, some at the same time; a table that fails does not hold up the others."""
    if mode not in MODES:
        raise ValueError(f"mode {mode!r} is not one of {MODES}")
    raw = {*scope.bronze, *scope.extra}

    def care(name: str) -> None:
        if not root.exists(name):
            return
        table = root.table(name)
        if mode == FOLD:
            upkeep.fold(table)
        elif mode == COMPACT:
            upkeep.compact(table)
        else:
            upkeep.expire(table, now, bronze_version_days if name in raw else version_days)
            upkeep.remove_orphans(table, now, orphan_days)
            if name in scope.bronze:
                upkeep.apply_retention(table, now, bronze_ttl_days)
            elif name in scope.retention:
                rule = scope.retention[name]
                upkeep.apply_retention(table, now, int(rule["days"]), rule["col"])

    failures = for_each(scope.of(mode), care, at_once)
    if mode == FOLD:
        failures += for_each([health.HEALTH_TABLE], lambda _: collect_health(root, scope.silver_namespaces, now))
    if failures:
        raise UpkeepFailed(failures)


def collect_health(root: TableRoot, silver_namespaces: Sequence[str], now: datetime) -> Commit | None:
    """Append a measurement of every table but the measurements' own, and drop those that are too old."""
    target = root.table(health.HEALTH_TABLE)
    measured = [t for t in root.tables() if t != health.HEALTH_TABLE]
    rows = health.table_health(root.commits(measured), silver_namespaces, now)
    commit = target.append(rows, by_day("measured_at"))
    upkeep.apply_retention(target, now, health.HEALTH_RETENTION_DAYS, "measured_at")
    return commit
