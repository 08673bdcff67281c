"""Constraints on single cells as boolean columns: type, maxLength, enum, const, pattern, required.

Every constraint is a narrow expression over one column; together they are one projection without a shuffle.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.columns import readable, text_kinds
from tabwright.functions.conditions import is_in
from tabwright.plans.schema import column_schema, typed_values
from tabwright.spec import ColumnSpec, SpecCollection, SpecError, java_pattern, pattern_error


@dataclass(frozen=True)
class Constraint:
    """What is violated where ``broken`` is true."""

    column: str | None
    keyword: str
    message: str
    schema: str
    parent_schema: str
    params: str
    broken: Column
    data: Column


def _data(column: Column, kind: T.DataType) -> Column:
    """The offending value as text; lists of plain values are joined, other nested values are JSON."""
    if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, (T.ArrayType, T.MapType, T.StructType)):
        return F.array_join(column.cast("array<string>"), "; ", "NA")
    return F.to_json(column) if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) else column.cast("string")


def _absent(column: Column, kind: T.DataType) -> Column:
    """Null as a validator sees it; numbers that JSON doesn't have count as null."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return column.isNull() | F.isnan(column) | (F.abs(column) == float("inf"))
    return column.isNull()


def _type_broken(spec: ColumnSpec, column: Column, kind: T.DataType, compat: str | None) -> Column:
    """Whether a value that isn't null has the wrong type; decided by the table's schema but for whole numbers."""
    stringy = isinstance(kind, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType))
    wanted = spec.json_type
    if wanted == "string":
        return F.lit(not stringy)
    if wanted == "boolean":
        return F.lit(not isinstance(kind, T.BooleanType))
    if not isinstance(kind, T.NumericType):
        return F.lit(True)
    if wanted == "integer" and not isinstance(kind, T.IntegralType):
        x = F.round(column, 4) if compat == "reference" else column
        return x != F.floor(x)
    return F.lit(False)


def column_constraints(spec: ColumnSpec, df: DataFrame, compat: str | None = None, kinds: dict[str, T.DataType] | None = None) -> list[Constraint]:
    """The constraints of one column that the table has."""
    kinds = text_kinds(df) if kinds is None else kinds
    return value_constraints(spec, F.col(f"`{spec.id}`"), df.schema[spec.id].dataType, compat, spec.id in kinds)


def value_constraints(spec: ColumnSpec, column: Column, kind: T.DataType, compat: str | None = None, from_text: bool = False) -> list[Constraint]:
    """The constraints of a value, which may also be part of another.

    Of a delimited file's column that isn't meant to be text, each value is judged by itself: text that can't be read as
    the column's type is of the wrong type.
    """
    schema = column_schema(spec)
    parent, data, unreadable = json.dumps(schema, ensure_ascii=False), _data(column, kind), None
    if from_text and spec.json_type != "string":
        value = readable(column, spec.spark_type, whole=False)
        column, kind, unreadable = value, T.DoubleType() if spec.json_type == "integer" else spec.spark_type, column.isNotNull() & value.isNull()
    absent = _absent(column, kind)
    string = isinstance(kind, T.StringType)

    def made(keyword: str, message: str, broken: Column, params: dict) -> Constraint:
        value = schema.get(keyword)
        text = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
        return Constraint(spec.id, keyword, message, text, parent, json.dumps(params, ensure_ascii=False), broken, data)

    allowed = f"{spec.json_type},null" if spec.nullable else spec.json_type
    wrong = F.when(absent, F.lit(not spec.nullable)).otherwise(_type_broken(spec, column, kind, compat))
    wrong = wrong if unreadable is None else unreadable | wrong
    out = [made("type", f"must be {allowed}", wrong, {"type": allowed})]
    if "maxLength" in schema and string:
        most = schema["maxLength"]
        out.append(made("maxLength", f"must NOT have more than {most} characters", F.coalesce(F.length(column) > most, F.lit(False)), {"limit": most}))
    if values := typed_values(spec):
        if spec.nullable and spec.json_type == "string":
            values = [*values, ""]
        if isinstance(kind, T.StringType):
            fitting = [v for v in values if isinstance(v, str)] if spec.json_type == "string" else []
        elif isinstance(kind, T.BooleanType):
            fitting = [v for v in values if isinstance(v, bool)]
        elif isinstance(kind, T.NumericType):
            fitting = [v for v in values if isinstance(v, (int, float)) and not isinstance(v, bool)]
        else:
            fitting = [v for v in values if isinstance(v, str)]
        known = is_in(column, kind, fitting) if fitting else F.lit(False)
        broken = F.when(absent, F.lit(not spec.nullable)).otherwise(~known)
        broken = broken if unreadable is None else unreadable | broken
        if "enum" in schema:
            out.append(made("enum", "must be equal to one of the allowed values", broken, {"allowedValues": schema["enum"]}))
        else:
            out.append(made("const", "must be equal to constant", broken, {"allowedValue": schema["const"]}))
    if spec.pattern is not None and string:
        if error := pattern_error(spec.pattern):
            raise SpecError(f"{spec.id}: pattern {spec.pattern!r}: {error}")
        broken = F.coalesce(~column.rlike(java_pattern(spec.pattern)), F.lit(False))
        out.append(made("pattern", f'must match pattern "{spec.pattern}"', broken, {"pattern": spec.pattern}))
    return out


def constraints(spec: SpecCollection, df: DataFrame, compat: str | None = None, kinds: dict[str, T.DataType] | None = None) -> list[Constraint]:
    """All constraints that can be broken by ``df``; a missing column breaks ``required`` in each row."""
    out, kinds = [], text_kinds(df, spec) if kinds is None else kinds
    for c in spec.columns.values():
        if c.id in df.columns:
            out += column_constraints(c, df, compat, kinds)
        else:
            message = f"must have required property '{c.id}'"
            out.append(Constraint(None, "required", message, json.dumps(spec.column_ids, ensure_ascii=False), "{}", json.dumps({"missingProperty": c.id}), F.lit(True), F.lit(None).cast("string")))
    return out
