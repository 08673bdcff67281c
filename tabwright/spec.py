"""Specifications of tables: columns, rules, metadata, and the collection that joins them.

All objects are plain frozen data; mistakes are reported when they are made.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, fields
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import types as T

RULE_TYPES = ("check_range", "check_unique", "check_condition", "check_allowed_combinations")
#: Condition operators in the order in which one is picked where only one may count.
OPERATORS = ("equals", "not_equals", "in", "not_in", "greater", "less", "greater_equal", "less_equal", "range", "empty")
_SPARK_TYPES = {"Char": T.StringType(), "Num": T.DoubleType(), "Int": T.LongType(), "Bool": T.BooleanType()}
JSON_TYPES = {"Char": "string", "Num": "number", "Int": "integer", "Bool": "boolean"}


class SpecError(ValueError):
    """A specification that can't be used."""


def java_pattern(pattern: str) -> str:
    """A pattern whose last ``$`` stands for the very end, as it does in specifications."""
    return rf"{pattern[:-1]}\z" if pattern.endswith("$") and not pattern.endswith(r"\$") else pattern


def pattern_error(pattern: str) -> str | None:
    """What Java finds wrong with a pattern; None if nothing, or as long as there is no session to ask."""
    session = SparkSession.getActiveSession()
    jvm = getattr(session, "_jvm", None)
    if jvm is None:
        return None
    try:
        jvm.java.util.regex.Pattern.compile(java_pattern(pattern))
    except Exception as e:  # what py4j raises holds Java's own text
        return str(getattr(e, "java_exception", e)).splitlines()[0]
    return None


def _one(kind: type | tuple, name: str, value: Any) -> None:
    allowed = kind if isinstance(kind, tuple) else (kind,)
    if value is not None and (not isinstance(value, allowed) or isinstance(value, bool) and bool not in allowed):
        raise SpecError(f"{name} must be a single {' or '.join(k.__name__ for k in allowed)}, not {value!r}")


@dataclass(frozen=True)
class ColumnSpec:
    """One column: its type, whether it may be null, and what its values must be like.

    ``format`` documents the column and is never enforced; ``length`` is. ``nullable`` left open means not nullable.
    ``pattern`` is a regular expression of Java; it is compiled when it is given if a session runs, else at first use.
    """

    id: str
    label: str | None = None
    type: str | None = "Char"
    format: str | float | None = None
    length: float | None = None
    nullable: bool | None = None
    values: tuple | None = None
    pattern: str | None = None
    description: str | None = None

    def __post_init__(self) -> None:
        if not isinstance(self.id, str) or not self.id or re.search(r"\s", self.id):
            raise SpecError(f"a column's id must be a string without white space, not {self.id!r}")
        for name, kind in (("label", str), ("type", str), ("pattern", str), ("description", str), ("format", (str, int, float)), ("length", (int, float)), ("nullable", bool)):
            _one(kind, f"{self.id}: {name}", getattr(self, name))
        if self.type is None:
            raise SpecError(f"{self.id}: type is missing")
        values = self.values
        if values is not None and (not isinstance(values, (list, tuple)) or isinstance(values, str)):
            values = (values,)
        object.__setattr__(self, "values", tuple(values) if values else None)
        if self.pattern is not None and (error := pattern_error(self.pattern)):
            raise SpecError(f"{self.id}: pattern {self.pattern!r}: {error}")
        if self.type in ("Num", "Int", "Bool") and (self.pattern is not None or self.length is not None):
            warnings.warn(f"{self.id}: pattern and length have no effect on a column of type {self.type}", stacklevel=3)

    @property
    def json_type(self) -> str:
        return JSON_TYPES.get(self.type, "string")

    @property
    def spark_type(self) -> T.DataType:
        return _SPARK_TYPES.get(self.type, T.StringType())

    def to_dict(self) -> dict[str, Any]:
        return {f.name: list(v) if isinstance(v := getattr(self, f.name), tuple) else v for f in fields(self)}

    @classmethod
    def from_dict(cls, given: Mapping[str, Any]) -> ColumnSpec:
        """From a mapping; keys that a column doesn't have are ignored."""
        if "id" not in given:
            raise SpecError(f"a column has no id: {dict(given)!r}")
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in given.items() if k in known and not (k == "type" and v is None)})


@dataclass(frozen=True)
class Rule:
    """A rule over whole rows or the whole table: a range, uniqueness, an if/then condition, or allowed combinations.

    ``allowed`` lists the combinations of values that ``column`` may have, each in the order of these columns.
    """

    id: str
    type: str
    condition: Mapping[str, Mapping[str, Any]] | None = None
    then: Mapping[str, Mapping[str, Any]] | None = None
    column: tuple[str, ...] | None = None
    range: tuple | None = None
    allowed: tuple[tuple, ...] | None = None

    def __post_init__(self) -> None:
        if not isinstance(self.id, str) or not self.id:
            raise SpecError(f"a rule's id must be a string, not {self.id!r}")
        if self.type not in RULE_TYPES:
            raise SpecError(f"rule {self.id}: type {self.type!r} is none of {', '.join(RULE_TYPES)}")
        column = (self.column,) if isinstance(self.column, str) else tuple(self.column) if self.column else None
        object.__setattr__(self, "column", column)
        if self.range is not None:
            flat = tuple(x for part in self.range for x in (part if isinstance(part, (list, tuple)) else [part]))
            if len(flat) != 2:
                raise SpecError(f"rule {self.id}: range must have two values, not {len(flat)}")
            object.__setattr__(self, "range", flat)
            try:
                turned = float(flat[0]) > float(flat[1])
            except (TypeError, ValueError):
                raise SpecError(f"rule {self.id}: a range is two numbers, not {flat!r}") from None
            if turned:
                raise SpecError(f"rule {self.id}: the range's lower end {flat[0]!r} is above its upper end {flat[1]!r}")
        if self.allowed is not None:
            object.__setattr__(self, "allowed", tuple(tuple(a) if isinstance(a, (list, tuple)) else (a,) for a in self.allowed))
            if wrong := [a for a in self.allowed if len(a) != len(column or ())]:
                raise SpecError(f"rule {self.id}: {list(wrong[0])!r} doesn't have a value for each of {', '.join(column or ())}")
        needed = {"check_range": ("column", "range"), "check_unique": ("column",), "check_condition": ("condition", "then"), "check_allowed_combinations": ("column", "allowed")}[self.type]
        if missing := [n for n in needed if not getattr(self, n)]:
            raise SpecError(f"rule {self.id}: {self.type} needs {', '.join(missing)}")
        if self.type == "check_range" and len(column) != 1:
            raise SpecError(f"rule {self.id}: a range is checked on one column")
        for part in (self.condition, self.then):
            for name, ops in (part or {}).items():
                if not isinstance(ops, Mapping) or not any(o in OPERATORS for o in ops):
                    raise SpecError(f"rule {self.id}: no supported condition on {name}: {ops!r}")

    @property
    def columns(self) -> list[str]:
        """All columns that the rule reads."""
        return list(dict.fromkeys([*(self.column or ()), *(self.condition or {}), *(self.then or {})]))

    def to_dict(self) -> dict[str, Any]:
        plain = lambda p: None if p is None else {c: dict(o) for c, o in p.items()}
        column = None if self.column is None else self.column[0] if len(self.column) == 1 else list(self.column)
        return {"id": self.id, "type": self.type, "condition": plain(self.condition), "then": plain(self.then), "column": column, "range": list(self.range) if self.range else None, "allowed": [list(a) for a in self.allowed] if self.allowed else None}

    @classmethod
    def from_dict(cls, given: Mapping[str, Any]) -> Rule:
        """From a mapping, in today's shape or in one of the older flat shapes, which become conditions."""
        if "id" not in given or "type" not in given:
            raise SpecError(f"a rule needs id and type: {dict(given)!r}")
        given = lowered(given)
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in given.items() if k in known})


def lowered(given: Mapping[str, Any]) -> dict[str, Any]:
    """Older rule types in terms of conditions.

    check_equal and check_unequal: then has the value that a column must, or must not, have; check_dependency: a column
    must be filled; check_mutual_exclusive: of two columns only one is filled. Flat conditions, as
    {column: VISIT, equals: V03}, become {VISIT: {equals: V03}}. check_allowed_combinations names its ``columns``; a
    combination may also be a mapping by column.
    """
    made = dict(given)

    def nested(part: Any) -> Any:
        if isinstance(part, Mapping) and isinstance(part.get("column"), str) and not isinstance(part.get("equals"), Mapping):
            ops = {k: v for k, v in part.items() if k != "column"}
            return {part["column"]: ops or {"empty": False}}
        return part

    kind = made["type"]
    made["condition"], made["then"] = nested(made.get("condition")), nested(made.get("then"))
    if kind in ("check_equal", "check_equals"):
        made["type"] = "check_condition"
    elif kind in ("check_unequal", "check_not_equals"):
        made["type"] = "check_condition"
        made["then"] = {c: {"not_equals" if k == "equals" else k: v for k, v in ops.items()} for c, ops in (made["then"] or {}).items()}
    elif kind == "check_dependency":
        made["type"] = "check_condition"
        if isinstance(made["then"], str):
            made["then"] = {made["then"]: {"empty": False}}
    elif kind == "check_mutual_exclusive":
        first, second = made.pop("columns", None) or made.pop("column")
        made |= {"type": "check_condition", "condition": {first: {"empty": False}}, "then": {second: {"empty": True}}}
    elif kind == "check_allowed_combinations":
        columns = made.pop("columns", None) or made.get("column")
        columns = [columns] if isinstance(columns, str) else columns
        made |= {"column": columns, "allowed": [[a.get(c) for c in columns or ()] if isinstance(a, Mapping) else a for a in made.get("allowed") or ()]}
    return made


@dataclass(frozen=True)
class Metadata:
    """Version, author, and whatever else a specification says about itself."""

    version: str | None = None
    author: str | None = None
    extra: Mapping[str, Any] = field(default_factory=dict)

    @classmethod
    def from_any(cls, given: Any) -> Metadata:
        """From a mapping or a list with one mapping."""
        if isinstance(given, Metadata):
            return given
        if isinstance(given, (list, tuple)):
            given = {k: v for part in given if isinstance(part, Mapping) for k, v in part.items()}
        given = dict(given or {})
        version, author = given.pop("version", None), given.pop("author", None)
        return cls(None if version is None else str(version), author, given)

    def to_dict(self) -> dict[str, Any]:
        return {k: v for k, v in {"version": self.version, "author": self.author, **self.extra}.items() if v is not None}


@dataclass(frozen=True)
class SpecCollection:
    """Columns by id, rules, metadata. ``spec["AGE"]`` is a column."""

    columns: Mapping[str, ColumnSpec]
    rules: tuple[Rule, ...] = ()
    metadata: Metadata = field(default_factory=Metadata)

    def __post_init__(self) -> None:
        columns = self.columns.values() if isinstance(self.columns, Mapping) else self.columns
        if any(not isinstance(c, ColumnSpec) for c in columns):
            raise SpecError("every column must be a ColumnSpec")
        if any(not isinstance(r, Rule) for r in self.rules):
            raise SpecError("every rule must be a Rule")
        for what, ids in (("column", [c.id for c in columns]), ("rule", [r.id for r in self.rules])):
            if twice := sorted({i for i in ids if ids.count(i) > 1}):
                raise SpecError(f"{what} ids that stand more than once: {', '.join(twice)}")
        object.__setattr__(self, "columns", {c.id: c for c in columns})
        object.__setattr__(self, "rules", tuple(self.rules))
        object.__setattr__(self, "metadata", Metadata.from_any(self.metadata))

    def __getitem__(self, column_id: str) -> ColumnSpec:
        return self.columns[column_id]

    def get(self, column_id: str) -> ColumnSpec | None:
        return self.columns.get(column_id)

    @property
    def column_ids(self) -> list[str]:
        return list(self.columns)

    @property
    def struct_type(self) -> T.StructType:
        """Schema for scans; what a column says about itself goes into its field's metadata."""
        return T.StructType([T.StructField(c.id, c.spark_type, True, {k: v for k, v in c.to_dict().items() if v is not None and k not in ("id", "nullable")}) for c in self.columns.values()])

    def to_dict(self) -> dict[str, Any]:
        return {"columns": [c.to_dict() for c in self.columns.values()], "rules": [r.to_dict() for r in self.rules], "metadata": self.metadata.to_dict()}

    @classmethod
    def from_dicts(cls, columns: Iterable[Mapping] | Mapping[str, Mapping], rules: Iterable[Mapping] = (), metadata: Any = None) -> SpecCollection:
        """From lists of mappings; ``columns`` may also be a mapping by id."""
        if isinstance(columns, Mapping):
            columns = [{"id": name, **dict(c)} for name, c in columns.items()]
        for what, given in (("columns", columns), ("rules", rules)):
            if isinstance(given, (str, bytes)) or not isinstance(given, Iterable):
                raise SpecError(f"{what} must be a list")
        return cls([ColumnSpec.from_dict(c) for c in columns], tuple(Rule.from_dict(r) for r in rules), Metadata.from_any(metadata))
