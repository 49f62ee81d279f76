"""Declared field types of JSON streams."""

from __future__ import annotations

from collections.abc import Mapping

# The type names a contract may use, with their Spark types.
CONTRACT_TYPES = {
    "int32": "int",
    "int64": "bigint",
    "float32": "float",
    "float64": "double",
    "boolean": "boolean",
    "string": "string",
}


def contract_types(contract: Mapping[str, str] | None) -> dict[str, str]:
    """Spark type per declared field; any other type name is rejected."""
    result = {}
    for name, kind in (contract or {}).items():
        if kind not in CONTRACT_TYPES:
            raise ValueError(f"{name}: type {kind!r} is not one of {', '.join(CONTRACT_TYPES)}")
        result[name] = CONTRACT_TYPES[kind]
    return result
