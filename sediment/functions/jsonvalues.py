"""Column expressions over JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STRICT = {"allowSingleQuotes": "false"}


def objects(text: Column, schema: T.StructType) -> Column:
    """The text read as a list of JSON objects; :func:`the_object` takes the only one.

    Reading it inside brackets makes anything after the object an error, as it is for a JSON document.  A member
    of another type than asked for is null; a text member that holds something else is its JSON text.
    """
    return F.from_json(F.concat(F.lit("["), text, F.lit("]")), T.ArrayType(schema), _STRICT)


def the_object(parsed: Column) -> Column:
    """The object of :func:`objects`; null when the text was no JSON object."""
    return F.when(F.size(parsed) == 1, F.get(parsed, F.lit(0)))


def text_members(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def variant(text: Column) -> Column:
    """VARIANT of a JSON text, which keeps JSON's own types; null when it is not JSON."""
    return F.try_parse_json(text)


def json_type(value: Column) -> Column:
    """Type name of a VARIANT: ``OBJECT<…>``, ``ARRAY<…>``, ``STRING``, ``BIGINT``, ``VOID`` …"""
    return F.schema_of_variant(value)


def is_object(value: Column) -> Column:
    """True for a JSON object, false for anything else, null included."""
    return F.coalesce(json_type(value).startswith("OBJECT<"), F.lit(False))


def member(value: Column, name: str, as_type: str = "variant") -> Column:
    """Member of a VARIANT object; null when absent or not of that type."""
    return F.try_variant_get(value, f"$['{name}']", as_type)


def identifier(text: Column, value: Column) -> Column:
    """Text of an identifier given as JSON: ``text`` and its VARIANT ``value``.

    ``{"$oid": …}`` is unwrapped; strings lose their quotes, numbers stay as written, booleans are capitalised,
    other objects and lists become JSON with sorted keys, JSON null and texts that are no JSON become null.
    """
    kind = json_type(value)
    plain = value.cast("string")
    return F.coalesce(
        member(value, "$oid", "string"),
        F.when(kind == "BOOLEAN", F.initcap(plain))
        .when(kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), F.trim(text))
        .otherwise(plain),
    )
