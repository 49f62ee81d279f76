"""Row filters and column masks as views, chosen by ordered rules.

Rules have three sections, ``catalogs``, ``schemas`` and ``tables``.  In each the first rule that matches the
person and the object decides; where none matches, access is denied.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Person:
    user: str
    groups: Sequence[str] = ()


@dataclass(frozen=True)
class Grant:
    """What a rule allows on one table."""

    privileges: frozenset[str] = frozenset()
    row_filter: str | None = None
    masks: Mapping[str, str] = field(default_factory=dict)

    @property
    def readable(self) -> bool:
        return "SELECT" in self.privileges


class AccessDenied(PermissionError):
    pass


def _first(section: Iterable[Mapping], person: Person, **names: str) -> Mapping | None:
    def matches(rule: Mapping) -> bool:
        values = {"user": [person.user], "group": list(person.groups), **{k: [v] for k, v in names.items()}}
        return all(any(re.fullmatch(rule[k], v) for v in values[k]) for k in values if k in rule)

    return next((rule for rule in section if matches(rule)), None)


def grant_for(rules: Mapping, person: Person, catalog: str, schema: str, table: str) -> Grant:
    """The table rule that applies; an empty grant when there is none."""
    rule = _first(rules.get("tables", ()), person, catalog=catalog, schema=schema, table=table)
    if rule is None:
        return Grant()
    masks = {c["name"]: c["mask"] for c in rule.get("columns", ()) if "mask" in c}
    return Grant(frozenset(rule.get("privileges", ())), rule.get("filter"), masks)


def catalog_access(rules: Mapping, person: Person, catalog: str) -> str:
    """``all``, ``read-only`` or ``none``."""
    rule = _first(rules.get("catalogs", ()), person, catalog=catalog)
    return rule["allow"] if rule else "none"


def owns_schema(rules: Mapping, person: Person, catalog: str, schema: str) -> bool:
    """Whether tables may be created and dropped there."""
    rule = _first(rules.get("schemas", ()), person, catalog=catalog, schema=schema)
    return bool(rule and rule.get("owner"))


def may(rules: Mapping, person: Person, privilege: str, catalog: str, schema: str, table: str) -> bool:
    """Whether a privilege holds on a table; writing also needs full access to the catalog."""
    access = catalog_access(rules, person, catalog)
    if access == "none" or (access == "read-only" and privilege != "SELECT"):
        return False
    return privilege in grant_for(rules, person, catalog, schema, table).privileges


def secured_view(df: DataFrame, rules: Mapping, person: Person, catalog: str, schema: str, table: str) -> DataFrame:
    """``df`` as the person may see it.

    The filter is a plain predicate over the stored values and reaches the scan; masks replace a column by an
    expression of its own type.
    """
    if not may(rules, person, "SELECT", catalog, schema, table):
        raise AccessDenied(f"{person.user} may not read {catalog}.{schema}.{table}")
    grant = grant_for(rules, person, catalog, schema, table)
    rows = df.where(grant.row_filter) if grant.row_filter else df
    types = {f.name: f.dataType for f in df.schema.fields}
    return rows.withColumns({c: F.expr(mask).cast(types[c]) for c, mask in grant.masks.items() if c in types})


#: Characters with a meaning in a pattern; what stands before the first of them has to be there as it is.
_SPECIAL = r"[\\^$.|?*+()\[\]{}].*$"
_ANY = "(?s).*"
#: Shares that the persons of a rule are dealt out to.
_SHARES = 32


def rule_rows(spark: SparkSession, rules: Mapping) -> DataFrame:
    """The table rules as rows: number, a pattern for each name, privileges, row filter, and masked columns."""
    fields = ("user", "group", "catalog", "schema", "table")
    rows = []
    for i, rule in enumerate(rules.get("tables", ())):
        masks = {c["name"]: c["mask"] for c in rule.get("columns", ()) if "mask" in c}
        rows.append((i, *(rule.get(f) for f in fields), sorted(rule.get("privileges", ())), rule.get("filter"), masks))
    schema = "rule int, " + ", ".join(f"{f}_pattern string" for f in fields) + ", privileges array<string>, row_filter string, masks map<string,string>"
    return spark.createDataFrame(rows, schema)


def _matched(names: DataFrame, column: str, rules: DataFrame, pattern: str) -> DataFrame:
    """(column, rule) of the names that a rule's pattern fits whole; a rule without a pattern fits all.

    Names and patterns meet by the first character that the pattern begins with literally; patterns that begin with
    none, and rules without a pattern, meet every name, in a list that is as short as the rules.
    """
    # an alternative may begin with another character
    literal = F.when(F.col(pattern).contains("|"), "").otherwise(F.regexp_replace(pattern, _SPECIAL, ""))
    begin = F.substring(F.when(F.length(literal) > 1, literal).otherwise(F.when(literal == F.col(pattern), literal).otherwise("")), 1, 1)
    told = rules.select("rule", F.coalesce(pattern, F.lit(_ANY)).alias("_pattern"), F.coalesce(begin, F.lit("")).alias("_begin"))
    keyed = names.select(column).distinct().withColumn("_begin", F.explode(F.array_distinct(F.array(F.substring(column, 1, 1), F.lit("")))))
    fits = F.regexp_like(F.col(column), F.concat(F.lit("^(?:"), F.col("_pattern"), F.lit(")\\z")))
    return keyed.join(told, "_begin").where(fits).select(column, "rule")


def _by_rule(fits: DataFrame, *names: str, rules: str) -> DataFrame:
    """A row for each rule that fits the names, with all the rules that do."""
    return fits.groupBy(*names).agg(F.collect_set("rule").alias(rules)).withColumn("rule", F.explode(rules))


def effective_rights(spark: SparkSession, rules: Mapping, persons: DataFrame, tables: DataFrame) -> DataFrame:
    """What every person may do with every table: user, catalog, schema, table, rule, privileges, row_filter, masks.

    ``persons`` are (user, groups), ``tables`` (catalog, schema, table). The rule with the smallest number among those
    that fit the user, one of the groups and all names decides, as :func:`grant_for` has it; pairs that no rule
    fits, or whose rule grants nothing, are left out. Persons and tables are matched with the rules apart and meet by
    rule, so no pair is looked at that no rule fits. Both bring all the rules that fit them, so a pair is told at once
    whether the rule it meets by is its first one, and pairs are neither gathered nor compared.
    """
    numbered = rule_rows(spark, rules)
    users = _matched(persons, "user", numbered, "user_pattern")
    groups = persons.select("user", F.explode("groups").alias("group"))
    in_group = groups.join(_matched(groups, "group", numbered, "group_pattern"), "group").select("user", "rule")
    free = numbered.where("group_pattern IS NULL").select("rule")
    who = users.join(in_group, ["user", "rule"], "left_semi").union(users.join(free, "rule", "left_semi").select("user", "rule"))
    what = tables.distinct()
    for name in ("catalog", "schema", "table"):
        own = _matched(tables, name, numbered, f"{name}_pattern")
        what = what.join(own, [name] if "rule" not in what.columns else [name, "rule"])
    names = ["user", "catalog", "schema", "table"]
    persons_of, tables_of = _by_rule(who, "user", rules="_own"), _by_rule(what, *names[1:], rules="_its")
    # rules are few: persons of one rule are dealt out to shares, in each of which its tables are
    persons_of = persons_of.withColumn("_share", F.pmod(F.xxhash64("user"), F.lit(_SHARES)))
    # what a rule grants comes with the tables: joined to the pairs it would have all pairs of a rule sorted in one task
    tables_of = tables_of.join(numbered.select("rule", "privileges", "row_filter", "masks"), "rule")
    tables_of = tables_of.withColumn("_share", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(_SHARES - 1).cast("bigint"))))
    first = persons_of.join(tables_of, ["rule", "_share"]).where(F.col("rule") == F.array_min(F.array_intersect("_own", "_its")))
    return first.where(F.size("privileges") > 0).select(*names, "rule", "privileges", "row_filter", "masks")
