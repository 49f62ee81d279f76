"""Column expressions over web access logs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted line shape ("combined", and "main" whose extra quoted fields are accepted but not
# captured), its time format, and the agents counted as automatic.
LINE = (
    r'^(?<remote>[^ ]*) (?<host>[^ ]*) (?<user>[^ ]*) \[(?<time>[^\]]*)\] '
    r'"(?<method>\S+)(?: +(?<path>[^\"]*?)(?: +\S*)?)?" (?<code>[^ ]*) (?<size>[^ ]*)'
    r'(?: "(?<referer>[^\"]*)" "(?<agent>[^\"]*)"(?: "[^\"]*")*)?$'
)
FIELDS = ("remote", "host", "user", "time", "method", "path", "code", "size", "referer", "agent")
TIME_FORMAT = "dd/MMM/yyyy:HH:mm:ss Z"
BOTS = "bot|crawler|spider|slurp|zgrab|masscan|nmap|curl|wget|python-requests|go-http-client"

_UNIT_SEPARATOR = "\u001f"


def side_by_side(line: Column) -> Column:
    """The captured fields of a log line in one text; the line itself when it has another shape.

    The expression runs once per line instead of once per field.
    """
    return F.regexp_replace(line, LINE, _UNIT_SEPARATOR.join(f"${i + 1}" for i in range(len(FIELDS))))


def line_fields(line: Column, joined: Column) -> Column:
    """The captured fields as an array, or null when the line has another shape.

    ``joined`` is :func:`side_by_side` of the line, worked out before.  Lines that contain the separator
    themselves are read field by field.
    """
    one_by_one = F.when(line.rlike(LINE), F.array(*(F.regexp_extract(line, LINE, i + 1) for i in range(len(FIELDS)))))
    return F.when(F.contains(line, F.lit(_UNIT_SEPARATOR)), one_by_one).when(
        F.contains(joined, F.lit(_UNIT_SEPARATOR)), F.split(joined, _UNIT_SEPARATOR)
    )


def normal_page(path: Column) -> Column:
    """Path without its query, digits after a slash replaced: ``/a/12?x=1`` -> ``/a/{id}``."""
    return F.regexp_replace(F.substring_index(path, "?", 1), "/[0-9]+", "/{id}")


def is_bot(agent: Column) -> Column:
    return F.lower(F.coalesce(agent, F.lit(""))).rlike(BOTS)


def status_between(code: Column, low: int, high: int, n: Column) -> Column:
    """Sum of ``n`` over rows whose status is in the range; zero, not null, when there are none."""
    return F.sum(F.when(code.between(low, high), n).otherwise(0))
