"""The privacy gate: nothing that looks like a path, an address or a secret may leave.

Records without a schema are seen through: VARIANT columns, and strings that hold JSON, give all their keys and values, and so
do JSON texts inside these, ``LEVELS`` deep.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions import text as T


#: How often a string of a JSON text may itself be a JSON text.
LEVELS = 3


class PrivacyError(RuntimeError):
    """Something unsafe stood in what was to be written."""


def _strings(column: Column, kind: S.DataType) -> list[Column]:
    """Arrays of all strings in a column of any nesting, map keys included."""
    if isinstance(kind, S.StringType):
        return [F.array(column)]
    if isinstance(kind, S.VariantType):
        return [F.array(F.to_json(column))]
    if isinstance(kind, S.StructType):
        return [x for f in kind.fields for x in _strings(column[f.name], f.dataType)]
    if isinstance(kind, S.MapType):
        return _strings(F.map_keys(column), S.ArrayType(kind.keyType)) + _strings(F.map_values(column), S.ArrayType(kind.valueType))
    if isinstance(kind, S.ArrayType):
        if isinstance(kind.elementType, S.StringType):
            return [F.coalesce(column, F.array().cast("array<string>"))]
        if isinstance(kind.elementType, (S.StructType, S.MapType, S.ArrayType, S.VariantType)) and _strings(F.lit(None), kind.elementType):
            return [F.coalesce(F.flatten(F.transform(column, lambda e: F.concat(*_strings(e, kind.elementType)))), F.array().cast("array<string>"))]
    return []


def seen_through(values: Column) -> Column:
    """An array of strings, and all strings of those that are JSON texts, level by level."""
    every = inner = F.filter(values, lambda x: x.isNotNull())
    for _ in range(LEVELS):
        inner = F.flatten(F.transform(F.filter(inner, lambda x: x.rlike(r"^\s*[\[{]")), T.json_strings))
        inner = F.filter(inner, lambda x: x.isNotNull())
        every = F.concat(every, inner)
    return every


def findings(df: DataFrame, rule: Callable[[Column], Column] = T.leaks_anything, exempt: tuple[str, ...] = ()) -> DataFrame:
    """(field, value) of everything unsafe in ``df``, in any nesting."""
    parts = []
    for f in df.schema.fields:
        found = _strings(F.col(f.name), f.dataType)
        if found and f.name not in exempt:
            parts.append(F.struct(F.lit(f.name).alias("field"), seen_through(F.concat(*found)).alias("values")))
    if not parts:
        return df.sparkSession.createDataFrame([], "field string, value string")
    flat = df.select(F.explode(F.array(*parts)).alias("p")).select("p.field", F.explode("p.values").alias("value"))
    return flat.where(F.col("value").isNotNull() & rule(F.col("value")))


_MARK = "unsafe value in field "


def guarded(df: DataFrame, rule: Callable[[Column], Column] = T.leaks_anything, exempt: tuple[str, ...] = ()) -> DataFrame:
    """``df`` itself, whose rows are looked at as they pass: the first unsafe one fails its task, and so the query that writes it.

    What was audited is what is written, and it is worked out once. The message names the field, never the value.
    """
    safe = F.lit(True)
    for f in df.schema.fields:
        found = _strings(F.col(f.name), f.dataType)
        if found and f.name not in exempt:
            unsafe = F.exists(seen_through(F.concat(*found)), lambda x: F.coalesce(rule(x), F.lit(False)))
            safe = safe & F.when(unsafe, F.raise_error(F.lit(_MARK + f.name)).cast("boolean")).otherwise(True)
    return df.where(safe)


def is_refusal(error: BaseException) -> str | None:
    """The field that made a guarded query fail, if that is why it did."""
    text = str(error)
    return text.split(_MARK, 1)[1].split()[0].rstrip(".,:;") if _MARK in text else None


def gate(df: DataFrame, rule: Callable[[Column], Column] = T.leaks_anything, exempt: tuple[str, ...] = ()) -> DataFrame:
    """``df``, if it is safe; an action runs before anything is written. Says where, never what."""
    hit = findings(df, rule, exempt).select("field").limit(1).collect()
    if hit:
        raise PrivacyError(f"a value of {hit[0].field!r} looks like a path, an address or a secret")
    return df
