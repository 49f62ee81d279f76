"""Schema reconciliation between a raw table and its current-state table."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sediment.model import META


class SchemaConflict(ValueError):
    """A column changed to a type that stored values cannot be read as without loss."""


# Integer widths in order, and the only other safe numeric step.
_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def widens(old: T.DataType, new: T.DataType) -> bool:
    """True when every stored ``old`` value reads back unchanged as ``new``."""
    if old == new:
        return True
    if isinstance(old, T.DecimalType) and isinstance(new, T.DecimalType):
        return old.scale == new.scale and new.precision >= old.precision
    if type(old) in _INTEGERS and type(new) in _INTEGERS:
        return _INTEGERS.index(type(new)) > _INTEGERS.index(type(old))
    return isinstance(old, T.FloatType) and isinstance(new, T.DoubleType)


def drop_meta(df: DataFrame) -> DataFrame:
    """Business columns only."""
    return df.drop(META)


def cast_columns(schema: T.StructType, casts: Mapping[str, str] | None) -> list[Column]:
    """Business columns of ``schema`` with the declared casts.

    Casts are plain, so under ANSI a value that does not fit fails the job instead of turning null.
    """
    casts = dict(casts or {})
    names = [f.name for f in schema.fields if f.name != META]
    unknown = sorted(casts.keys() - set(names))
    if unknown:
        raise ValueError(f"casts for unknown column(s): {unknown}")
    return [F.col(f"`{n}`").cast(casts[n]).alias(n) if n in casts else F.col(f"`{n}`") for n in names]


def state_schema(log: DataFrame, casts: Mapping[str, str] | None = None) -> T.StructType:
    """Schema of the current-state table derived from a change log."""
    return log.select(*cast_columns(log.schema, casts)).schema


@dataclass(frozen=True)
class SchemaPlan:
    """What has to happen to a stored schema; empty when it already fits."""

    added: tuple[T.StructField, ...] = ()
    widened: tuple[T.StructField, ...] = ()

    def __bool__(self) -> bool:
        return bool(self.added or self.widened)

    def applied_to(self, stored: T.StructType) -> T.StructType:
        wider = {f.name: f.dataType for f in self.widened}
        kept = [T.StructField(f.name, wider.get(f.name, f.dataType), True) for f in stored.fields]
        return T.StructType(kept + [T.StructField(f.name, f.dataType, True) for f in self.added])


def plan_changes(table: str, stored: T.StructType, wanted: T.StructType) -> SchemaPlan:
    """Columns to add and to widen so that ``stored`` can take ``wanted`` rows.

    Columns only the stored table has are left alone.  An unsafe change raises :class:`SchemaConflict`.
    """
    present = {f.name: f.dataType for f in stored.fields}
    added, widened = [], []
    for f in wanted.fields:
        if f.name not in present:
            added.append(f)
        elif not widens(present[f.name], f.dataType):
            raise SchemaConflict(
                f"{table}.{f.name}: {present[f.name].simpleString()} -> {f.dataType.simpleString()}"
                " is not a safe widening; migrate the table by hand"
            )
        elif present[f.name] != f.dataType:
            widened.append(f)
    return SchemaPlan(tuple(added), tuple(widened))


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with exactly the columns of ``schema``: cast where the type differs, null where absent."""
    have = {f.name: f.dataType for f in df.schema.fields}

    def column(f: T.StructField) -> Column:
        if f.name not in have:
            return F.lit(None).cast(f.dataType).alias(f.name)
        value = F.col(f"`{f.name}`")
        return value if have[f.name] == f.dataType else value.cast(f.dataType).alias(f.name)

    return df.select(*(column(f) for f in schema.fields))


def merge_schemas(table: str, schemas: Iterable[T.StructType]) -> T.StructType:
    """Union of schemas by name, nested structs included; safe widening only."""
    merged = T.StructType([])
    for schema in schemas:
        merged = _merge_struct(table, merged, schema)
    return merged


def _merge_struct(path: str, old: T.StructType, new: T.StructType) -> T.StructType:
    result = {f.name: f.dataType for f in old.fields}
    for f in new.fields:
        result[f.name] = _merge_type(f"{path}.{f.name}", result[f.name], f.dataType) if f.name in result else f.dataType
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in result.items()])


def _merge_type(path: str, old: T.DataType, new: T.DataType) -> T.DataType:
    if isinstance(old, T.NullType) or isinstance(new, T.NullType):
        return new if isinstance(old, T.NullType) else old
    if isinstance(old, T.StructType) and isinstance(new, T.StructType):
        return _merge_struct(path, old, new)
    if isinstance(old, T.ArrayType) and isinstance(new, T.ArrayType):
        return T.ArrayType(_merge_type(f"{path}[]", old.elementType, new.elementType))
    if widens(old, new):
        return new
    if widens(new, old):
        return old
    raise SchemaConflict(f"{path}: {old.simpleString()} and {new.simpleString()} do not fit one column")
