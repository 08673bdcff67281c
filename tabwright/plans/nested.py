"""Extension: constraints on nested columns, compiled to higher-order functions.

A ``Shape`` says what a value of a nested column must be like: its parts have shapes of their own, down to plain values under
a ``ColumnSpec``. Each broken part gives an error with its place as a JSON pointer below the column, such as
``/turns/3/role``. All of a table's shapes are one projection over one scan; nothing is exploded but errors, and an array
whose elements are all sound is passed in one go.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.operators.validate import key_names
from tabwright.plans.constraints import value_constraints
from tabwright.spec import ColumnSpec, SpecError

_ERROR = "array<struct<column:string,path:string,keyword:string,message:string,data:string>>"


@dataclass(frozen=True)
class Shape:
    """What a value must be like. Of ``value``, ``items``, ``fields`` and ``values`` one says what kind of value it is.

    value: a plain value under the constraints of a column. items: an array, with ``min_items`` and ``max_items``, its elements
    all different with ``unique``. fields: a struct. values: a map, with a pattern for its ``keys``. Numbers may have a
    ``minimum`` and a ``maximum``. A null is an error unless ``nullable`` (for plain values: unless their column's is).
    """

    value: ColumnSpec | None = None
    items: Shape | None = None
    fields: Mapping[str, Shape] | None = None
    values: Shape | None = None
    keys: str | None = None
    nullable: bool = False
    min_items: int | None = None
    max_items: int | None = None
    unique: bool = False
    minimum: float | None = None
    maximum: float | None = None

    def __post_init__(self) -> None:
        if sum(x is not None for x in (self.value, self.items, self.fields, self.values)) != 1:
            raise SpecError("a shape is one of value, items, fields, values")
        for low, high in ((self.min_items, self.max_items), (self.minimum, self.maximum)):
            if low is not None and high is not None and low > high:
                raise SpecError(f"a lower bound of {low} is above an upper one of {high}")

    @classmethod
    def from_any(cls, given: object) -> Shape:
        """From mappings as YAML and JSON have them: {items: ...}, {fields: {name: ...}}, {values: ...}, or those of a column."""
        if isinstance(given, Shape):
            return given
        if not isinstance(given, Mapping):
            raise SpecError(f"not a shape: {given!r}")
        own = {k: given[k] for k in ("nullable", "min_items", "max_items", "unique", "minimum", "maximum", "keys") if k in given}
        if "items" in given:
            return cls(items=cls.from_any(given["items"]), **own)
        if "fields" in given:
            return cls(fields={name: cls.from_any(x) for name, x in given["fields"].items()}, **own)
        if "values" in given and isinstance(given["values"], Mapping):
            return cls(values=cls.from_any(given["values"]), **own)
        return cls(value=ColumnSpec.from_dict({"id": "value", "nullable": False, **given}), minimum=own.get("minimum"), maximum=own.get("maximum"))


def _none() -> Column:
    return F.array().cast(_ERROR)


def _errors(name: str, found: list[tuple[Column, str, str]], path: Column, data: Column) -> Column:
    """The broken ones of (broken, keyword, message) as an array of errors."""
    made = [F.when(F.coalesce(b, F.lit(False)), F.struct(F.lit(name).alias("column"), path.alias("path"), F.lit(k).alias("keyword"), F.lit(m).alias("message"), data.alias("data"))) for b, k, m in found]
    return F.filter(F.array(*made), lambda e: e.isNotNull()).cast(_ERROR) if made else _none()


def _plain(shape: Shape, x: Column, kind: T.DataType) -> list[tuple[Column, str, str]]:
    found = [(c.broken, c.keyword, c.message) for c in value_constraints(shape.value, x, kind)]
    if isinstance(kind, T.NumericType):
        if shape.minimum is not None:
            found.append((x < shape.minimum, "minimum", f"must be >= {shape.minimum:g}"))
        if shape.maximum is not None:
            found.append(((x > shape.maximum) & (~F.isnan(x) if isinstance(kind, (T.FloatType, T.DoubleType)) else F.lit(True)), "maximum", f"must be <= {shape.maximum:g}"))
    return found


def _wrong(name: str, x: Column, path: Column, wanted: str) -> Column:
    return F.when(x.isNotNull(), _errors(name, [(F.lit(True), "type", f"must be {wanted}")], path, F.to_json(F.struct(x.alias("value"))))).otherwise(_none())


def shape_errors(name: str, shape: Shape, x: Column, kind: T.DataType, path: Column) -> Column:
    """The errors of a value and of all its parts, as an array."""
    if shape.value is not None:
        nested = isinstance(kind, (T.ArrayType, T.MapType, T.StructType))
        return _errors(name, _plain(shape, x, kind), path, F.to_json(x) if nested else x.cast("string"))
    null = _errors(name, [(x.isNull(), "type", "must not be null")], path, F.lit(None).cast("string")) if not shape.nullable else _none()
    if shape.items is not None:
        inner = _of_array(name, shape, x, kind, path) if isinstance(kind, T.ArrayType) else _wrong(name, x, path, "array")
    elif shape.fields is not None:
        inner = _of_struct(name, shape, x, kind, path) if isinstance(kind, T.StructType) else _wrong(name, x, path, "object")
    else:
        inner = _of_map(name, shape, x, kind, path) if isinstance(kind, T.MapType) else _wrong(name, x, path, "map")
    return F.when(x.isNull(), null).otherwise(inner)


def _of_array(name: str, shape: Shape, x: Column, kind: T.ArrayType, path: Column) -> Column:
    size = F.size(x)
    own = []
    if shape.min_items is not None:
        own.append((size < shape.min_items, "minItems", f"must NOT have fewer than {shape.min_items} items"))
    if shape.max_items is not None:
        own.append((size > shape.max_items, "maxItems", f"must NOT have more than {shape.max_items} items"))
    if shape.unique:
        own.append((F.size(F.array_distinct(x)) < size, "uniqueItems", "must NOT have duplicate items"))
    each = F.flatten(F.transform(x, lambda e, i: shape_errors(name, shape.items, e, kind.elementType, F.concat(path, F.lit("/"), i.cast("string")))))
    if shape.items.value is not None:  # most arrays are sound: one look at their elements, without making anything of them
        some = lambda e: _any([b for b, _, _ in _plain(shape.items, e, kind.elementType)])
        each = F.when(F.exists(x, some), each).otherwise(_none())
    return F.concat(_errors(name, own, path, size.cast("string")), each)


def _any(found: list[Column]) -> Column:
    out = F.lit(False)
    for b in found:
        out = out | F.coalesce(b, F.lit(False))
    return out


def _pointer(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def _of_struct(name: str, shape: Shape, x: Column, kind: T.StructType, path: Column) -> Column:
    kinds = {f.name: f.dataType for f in kind.fields}
    parts = []
    for field, part in shape.fields.items():
        if field not in kinds:
            parts.append(_errors(name, [(F.lit(True), "required", f"must have required property '{field}'")], path, F.lit(None).cast("string")))
        else:
            parts.append(shape_errors(name, part, x.getField(field), kinds[field], F.concat(path, F.lit(f"/{field.replace('~', '~0').replace('/', '~1')}"))))
    return F.concat(*parts) if parts else _none()


def _of_map(name: str, shape: Shape, x: Column, kind: T.MapType, path: Column) -> Column:
    def entry(e: Column) -> Column:
        at = F.concat(path, F.lit("/"), _pointer(e["key"].cast("string")))
        made = shape_errors(name, shape.values, e["value"], kind.valueType, at)
        if shape.keys is None:
            return made
        key = ColumnSpec("key", pattern=shape.keys, nullable=False)
        return F.concat(_errors(name, [(c.broken, "propertyNames", c.message) for c in value_constraints(key, e["key"].cast("string"), T.StringType())], at, e["key"].cast("string")), made)

    return F.flatten(F.transform(F.map_entries(x), entry))


def nested_errors(df: DataFrame, shapes: Mapping[str, object], key: list[str] | str) -> DataFrame:
    """A row per broken part: the key columns, column, path, keyword, message, data; a missing column is one error for each row."""
    key, made = [key] if isinstance(key, str) else list(key), []
    compiled: Callable[[str, Shape], Column] = lambda c, s: shape_errors(c, s, F.col(f"`{c}`"), df.schema[c].dataType, F.lit(""))
    for c, given in shapes.items():
        shape = Shape.from_any(given)
        made.append(compiled(c, shape) if c in df.columns else _errors(c, [(F.lit(True), "required", f"must have required property '{c}'")], F.lit(""), F.lit(None).cast("string")))
    names = key_names(key, ("column", "path", "keyword", "message", "data"))
    return df.select(*[F.col(f"`{k}`").alias(n) for k, n in names.items()], F.inline(F.concat(*made) if made else _none()))
