"""A specification as JSON Schema, for export and for the texts of errors."""

from __future__ import annotations

import json
from typing import Any

from tabwright.spec import ColumnSpec, SpecCollection


def typed_values(column: ColumnSpec) -> list:
    """Allowed values in the column's own type; those that don't fit it stay as text and match nothing."""
    out = []
    for v in column.values or ():
        try:
            if column.type == "Num":
                v = float(v)
            elif column.type == "Int":
                v = int(float(v))
            elif column.type == "Bool":
                v = v if isinstance(v, bool) else {"true": True, "false": False}[str(v).lower()]
            elif not isinstance(v, str):
                v = str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)
        except (KeyError, TypeError, ValueError):
            v = str(v)
        out.append(v)
    return out


def column_schema(column: ColumnSpec) -> dict[str, Any]:
    """type, maxLength, enum or const, and pattern, as far as the column has them."""
    made: dict[str, Any] = {"type": [column.json_type, "null"] if column.nullable else column.json_type}
    if column.length is not None:
        made["maxLength"] = int(column.length)
    if values := typed_values(column):
        if column.nullable:
            values = [*values, None, ""] if column.json_type == "string" else [*values, None]
        made |= {"enum": values} if len(values) > 1 else {"const": values[0]}
    if column.pattern is not None:
        made["pattern"] = column.pattern
    return made


def json_schema(spec: SpecCollection) -> dict[str, Any]:
    """The whole table: every specified column is required, others are allowed."""
    return {"type": "array", "items": {"type": "object", "properties": {c.id: column_schema(c) for c in spec.columns.values()}, "required": spec.column_ids}}


def json_schema_text(spec: SpecCollection, pretty: bool = False) -> str:
    return json.dumps(json_schema(spec), ensure_ascii=False, indent=2 if pretty else None)
