"""Conditions of rules as boolean columns.

Comparisons with null, or NaN, are null, and a rule is broken only where its ``then`` is plainly false. Membership and
emptiness are never null: null is in no list unless the list has it, and null, "" and NaN are empty.

The literal is brought to the column's type, never the other way round, so that a table's scan stays free of casts and
ANSI mode has nothing to raise.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.spec import OPERATORS, SpecError

_COMPARE = {"equals": operator.eq, "not_equals": operator.ne, "greater": operator.gt, "less": operator.lt, "greater_equal": operator.ge, "less_equal": operator.le}


def text_of(value: Any) -> str:
    """A literal as text: whole numbers without a decimal point, booleans in capitals."""
    if isinstance(value, bool):
        return str(value).upper()
    return str(int(value)) if isinstance(value, float) and value.is_integer() else str(value)


def plain(column: Column, kind: T.DataType) -> Column:
    """The column with NaN as null."""
    return F.when(~F.isnan(column), column) if isinstance(kind, (T.FloatType, T.DoubleType)) else column


def _sides(column: Column, kind: T.DataType, value: Any) -> tuple[Column, Column]:
    """Column and literal in one type, in which they are compared."""
    if value is None:
        return column, F.lit(None).cast(kind)
    if isinstance(kind, T.NumericType) and not isinstance(value, bool):
        try:
            number = float(value)
        except (TypeError, ValueError):
            return column.cast("string"), F.lit(text_of(value))
        whole = isinstance(kind, T.IntegralType) and number.is_integer() and abs(number) < 1 << 53
        return column, F.lit(int(number) if whole else number)
    if isinstance(kind, T.BooleanType) and (isinstance(value, bool) or text_of(value).upper() in ("TRUE", "FALSE")):
        return column, F.lit(text_of(value).upper() == "TRUE")
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return column, F.lit(str(value)).try_cast(kind)
    return column.cast("string"), F.lit(text_of(value))


def is_empty(column: Column, kind: T.DataType) -> Column:
    """Null, "" or NaN."""
    test = column.isNull()
    if isinstance(kind, T.StringType):
        test = test | (column == "")
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        test = test | F.isnan(column)
    return F.coalesce(test, F.lit(True))


def is_in(column: Column, kind: T.DataType, values: list) -> Column:
    """Membership that is never null."""
    values = list(values) if isinstance(values, (list, tuple, set)) else [values]
    sides = [_sides(column, kind, v) for v in values if v is not None]
    found = F.lit(False)
    texts = [lit for left, lit in sides if left is not column]
    typed = [lit for left, lit in sides if left is column]
    for left, lits in ((column, typed), (column.cast("string"), texts)):
        if lits:
            found = found | F.coalesce(left.isin(lits), F.lit(False))
    return found | column.isNull() if any(v is None for v in values) else found


def one_condition(column: Column, kind: T.DataType, name: str, value: Any, strict: bool = False) -> Column:
    """One operator on one column. With ``strict``, greater_equal and less_equal leave the bound itself out, and NaN is both empty and not."""
    raw, column = column, plain(column, kind)
    if strict:
        name = {"greater_equal": "greater", "less_equal": "less"}.get(name, name)
    if name in _COMPARE:
        return _COMPARE[name](*_sides(column, kind, value))
    if name in ("in", "not_in"):
        found = is_in(column, kind, value)
        return found if name == "in" else ~found
    if name == "range":
        low, high = value
        return one_condition(raw, kind, "greater_equal", low) & one_condition(raw, kind, "less_equal", high)
    if name == "empty":
        if strict and not value and isinstance(kind, (T.FloatType, T.DoubleType)):
            return ~is_empty(raw, kind) | F.coalesce(F.isnan(raw), F.lit(False))
        return is_empty(raw, kind) if value else ~is_empty(raw, kind)
    raise SpecError(f"unsupported condition: {name}")


def all_conditions(df: DataFrame, conditions: Mapping[str, Mapping[str, Any]], compat: str | None = None) -> Column:
    """All conditions joined by and, in three-valued logic.

    With ``compat="reference"`` only the first operator of a column counts, bounds of *_equal are left out, and NaN is both
    empty and not empty.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    parts = []
    for name, ops in conditions.items():
        if name not in kinds:
            raise SpecError(f"a rule reads column {name}, which the table doesn't have")
        known = [o for o in OPERATORS if o in ops]
        if not known:
            raise SpecError(f"unsupported condition on {name}: {dict(ops)!r}")
        strict = compat == "reference"
        parts += [one_condition(F.col(f"`{name}`"), kinds[name], o, ops[o], strict) for o in (known[:1] if strict else known)]
    return functools.reduce(operator.and_, parts, F.lit(True))
