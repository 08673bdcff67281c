"""Casts of columns, and checks of a whole column as one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.spec import SpecCollection, SpecError, java_pattern

#: Field metadata of the columns of a delimited file: the type that they are meant to have.
FROM_TEXT = "from_text"
_KINDS = {"character": T.StringType, "numeric": T.NumericType, "integer": T.IntegralType, "logical": T.BooleanType}
#: What readers of delimited files take as a number, and as a truth value.
NUMBER = r"^\s*(?:[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|NaN|[+-]?Inf)\s*$"
TRUTH = r"^\s*(?:T|F|TRUE|FALSE|True|False|true|false)\s*$"


def text_kinds(df: DataFrame, spec: SpecCollection | None = None, delimited: bool | None = None) -> dict[str, T.DataType]:
    """The columns that hold a delimited file's text, though they are meant to be of another type, with that type.

    ``delimited`` says whether the table is one; left open, it is if any column has its mark. A column that has lost its
    own by a projection then has its type from the specification.
    """
    texts = [f for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if delimited is None:
        delimited = any(FROM_TEXT in f.metadata for f in texts)
    if not delimited:
        return {}
    kinds = {f.name: T.DataType.fromDDL(f.metadata[FROM_TEXT]) for f in texts if FROM_TEXT in f.metadata}
    if spec is not None:
        kinds |= {f.name: spec[f.name].spark_type for f in texts if f.name in spec.columns}
    return {name: kind for name, kind in kinds.items() if not isinstance(kind, T.StringType)}


def readable(text: Column, kind: T.DataType, whole: bool = True) -> Column:
    """Text as a value of the type, null where it isn't written as one. Whole numbers may be written 2.0; unless ``whole``,
    numbers that aren't whole are given as they are."""
    if isinstance(kind, T.BooleanType):
        return F.when(text.rlike(TRUTH), text).try_cast(kind)
    text = F.when(text.rlike(NUMBER), text)
    if isinstance(kind, T.IntegralType):
        number = text.try_cast("double")
        return F.coalesce(text.try_cast(kind), F.when(number == F.floor(number), number).try_cast(kind)) if whole else number
    return text.try_cast(kind)


def typed_columns(df: DataFrame, kinds: dict[str, T.DataType]) -> list[Column]:
    return [readable(F.col(f"`{c}`"), kinds[c]).alias(c) if c in kinds else F.col(f"`{c}`") for c in df.columns]


def typed(df: DataFrame, kinds: dict[str, T.DataType] | None = None) -> DataFrame:
    """The table with every column of a delimited file in the type that it is meant to have; what can't be read is null."""
    kinds = text_kinds(df) if kinds is None else kinds
    return df.select(*typed_columns(df, kinds)) if kinds else df


def beside_typed(df: DataFrame, kinds: dict[str, T.DataType], name: str = "_given") -> DataFrame:
    """Typed columns, and the row as it was given as a struct beside them, so that no value is lost by being read."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name), *typed_columns(df, kinds))


def typed_if_clean(df: DataFrame, kinds: dict[str, T.DataType] | None = None) -> DataFrame:
    """The table as it is read where types are guessed from all values: a column with a value that can't be read as its
    type stays text, the others get their types. One pass over the file."""
    kinds = text_kinds(df) if kinds is None else kinds
    if not kinds:
        return df
    bad = [F.count_if(F.col(f"`{c}`").isNotNull() & readable(F.col(f"`{c}`"), kind).isNull()) for c, kind in kinds.items()]
    found = dict(zip(kinds, df.agg(*[b.alias(f"b{k}") for k, b in enumerate(bad)]).first(), strict=True))
    return df.select(*typed_columns(df, {c: kind for c, kind in kinds.items() if not found[c]}))


def empty_to_null(df: DataFrame) -> DataFrame:
    """Empty strings as null, in all string columns."""
    return df.select(*[F.nullif(F.col(f"`{f.name}`"), F.lit("")).alias(f.name, metadata=f.metadata) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema.fields])


def change_nas(column: Column, kind: str) -> Column:
    """Null as "" in a character column; other kinds stay as they are."""
    return F.coalesce(column, F.lit("")) if kind == "character" else column


def change_type(column: Column, kind: str) -> Column:
    """As numeric (null where that fails) or as character."""
    if kind == "numeric":
        return column.try_cast("double")
    if kind == "character":
        return column.cast("string")
    raise SpecError(f"a column can't be made {kind!r}; numeric and character are supported")


def check_format(column: Column, length: int) -> Column:
    """Aggregate: no value is longer than ``length`` code points; null counts as empty."""
    return F.coalesce(F.bool_and(F.length(F.coalesce(column.cast("string"), F.lit(""))) <= length), F.lit(True))


def check_nullable(column: Column, nullable: bool) -> Column:
    """Aggregate: no value is null or "", unless the column is nullable."""
    return F.lit(True) if nullable else F.coalesce(F.bool_and(column.isNotNull() & (column.cast("string") != "")), F.lit(True))


def check_type(df: DataFrame, name: str, kind: str) -> Column:
    """Aggregate: the column is of the kind, or has no values at all."""
    if kind not in _KINDS:
        raise SpecError(f"unknown kind {kind!r}")
    return F.lit(True) if isinstance(df.schema[name].dataType, _KINDS[kind]) else F.count(F.col(f"`{name}`")) == 0


def check_values(column: Column, values: list, nullable: bool = False) -> Column:
    """Aggregate: all values are allowed ones."""
    return F.coalesce(F.bool_and(F.coalesce(column.isin(list(values)), F.lit(False)) | (column.isNull() if nullable else F.lit(False))), F.lit(True))


def check_pattern(column: Column, pattern: str) -> Column:
    """Aggregate: the pattern is found in all values that aren't null."""
    return F.coalesce(F.bool_and(column.rlike(java_pattern(pattern))), F.lit(True))
