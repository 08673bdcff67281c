"""Validation of a table against a specification: cells first, then rules.

``errors`` has a row per violation. It is a projection with a generator over one scan; nothing is shuffled. ``summary``
groups these rows. Rules are only evaluated on a table whose cells are all right, as its specification means them for
such tables; ``rule_results`` can be asked for anyway.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.columns import beside_typed, empty_to_null, text_kinds, typed_if_clean
from tabwright.operators.positions import chunk_of_rows
from tabwright.operators.rules import RuleResult, RuleViolation, apply_rules, row_broken, rule_results
from tabwright.plans.constraints import Constraint, constraints
from tabwright.spec import SpecCollection

#: Constraints in one array expression; larger ones would outgrow what the JVM compiles as one method.
GROUP = 40
ERROR_COLUMNS = ("column", "keyword", "message", "schema", "data", "parent_schema", "params")


class StructuralErrors(Exception):
    """A table whose cells break the specification; ``summary`` has the groups of errors."""

    def __init__(self, summary: DataFrame) -> None:
        super().__init__("the table doesn't meet its specification")
        self.summary = summary


def _struct(c: Constraint):
    return F.when(c.broken, F.struct(F.lit(c.column).cast("string").alias("column"), F.lit(c.keyword).alias("keyword"), F.lit(c.message).alias("message"), F.lit(c.schema).alias("schema"), c.data.alias("data"), F.lit(c.parent_schema).alias("parent_schema"), F.lit(c.params).alias("params")))


def key_names(key: list[str], columns: tuple[str, ...] = ERROR_COLUMNS) -> dict[str, str]:
    """The names under which key columns stand beside errors: one that is called as a column of errors gets ``_key`` after it."""
    taken, names = {c.lower() for c in (*columns, *key)}, {}
    for k in key:
        name = k
        while name.lower() in columns or name != k and name.lower() in taken:
            name += "_key"
        taken.add(name.lower())
        names[k] = name
    return names


def error_rows(df: DataFrame, found: list[Constraint], key: list[str]) -> DataFrame:
    """A row per broken constraint: the key columns, then ``ERROR_COLUMNS``."""
    if not found:
        found = [Constraint(None, "", "", "", "", "", F.lit(False), F.lit(None).cast("string"))]
    parts = [F.filter(F.array(*[_struct(c) for c in found[k : k + GROUP]]), lambda e: e.isNotNull()) for k in range(0, len(found), GROUP)]
    return df.select(*[F.col(f"`{k}`").alias(name) for k, name in key_names(key).items()], F.inline(parts[0] if len(parts) == 1 else F.concat(*parts)))


def summary_of(df: DataFrame, found: list[Constraint], key: list[str]) -> DataFrame:
    """``error_summary`` of all errors of a table by its key, grouped by the constraint's number and the value alone; what is said about the
    constraint is put back afterwards, so long texts are neither compared nor shuffled."""
    parts = [F.filter(F.array(*[F.when(c.broken, F.struct(F.lit(n).alias("code"), c.data.alias("data"))) for n, c in group]), lambda e: e.isNotNull()) for group in _groups(found)]
    own = F.col(f"`{key[0]}`") if len(key) == 1 else F.struct(*[F.col(f"`{k}`") for k in key])
    coded = df.select(own.alias("own"), F.inline(parts[0] if len(parts) == 1 else F.concat(*parts)))
    merged = coded.groupBy("code", "data").agg(F.min("own").alias("first_row_affected"), F.max("own").alias("last_row_affected"), F.count(F.lit(1)).alias("n_rows_affected"))
    said = F.element_at(F.array(*[F.struct(*[F.lit(x).cast("string").alias(n) for n, x in (("column", c.column), ("keyword", c.keyword), ("message", c.message), ("schema", c.schema), ("parent_schema", c.parent_schema), ("params", c.params))]) for c in found]), F.col("code") + 1)
    merged = merged.withColumn("said", said)
    return merged.select(*[F.col(c) if c == "data" else F.col(f"said.{c}") for c in ERROR_COLUMNS], "first_row_affected", "last_row_affected", "n_rows_affected")


def _groups(found: list[Constraint]) -> list[list[tuple[int, Constraint]]]:
    return [list(enumerate(found))[k : k + GROUP] for k in range(0, len(found), GROUP)]


def first_chunk(errors: DataFrame, row: str = "row", size: int = 5000) -> DataFrame:
    """The errors of the first run of ``size`` rows that has any."""
    chunk = F.ceil(F.col(f"`{row}`") / size)
    least = errors.agg(F.min(chunk).alias("_least"))
    return errors.join(F.broadcast(least), chunk == F.col("_least")).drop("_least")  # the other side is one row


def error_summary(errors: DataFrame, row: str, columns: tuple[str, ...] = ERROR_COLUMNS) -> DataFrame:
    """Errors that are alike but for their row: first and last row and how many."""
    at = F.col(f"`{row}`")
    return errors.groupBy(*columns).agg(F.min(at).alias("first_row_affected"), F.max(at).alias("last_row_affected"), F.count(F.lit(1)).alias("n_rows_affected"))


def error_rollup(errors: DataFrame, row: str) -> DataFrame:
    """(level, column, keyword, n, first_row_affected, last_row_affected): errors by column and keyword, by column, by keyword,
    and in all, from one pass: grouping sets over the finest groups, which are few."""
    at = F.col(f"`{row}`")
    finest = errors.groupBy("column", "keyword").agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))
    sets = finest.cube("column", "keyword").agg(F.grouping_id().alias("set"), F.sum("n").alias("n"), F.min("first").alias("first_row_affected"), F.max("last").alias("last_row_affected"))
    level = F.element_at(F.array(*[F.lit(x) for x in ("both", "column", "keyword", "all")]), (F.col("set") + 1).cast("int"))
    return sets.where("n IS NOT NULL").select(level.alias("level"), "column", "keyword", "n", "first_row_affected", "last_row_affected")


def any_broken(found: list[Constraint]) -> Column:
    return functools.reduce(lambda a, b: a | b, [F.coalesce(c.broken, F.lit(False)) for c in found], F.lit(False))


@dataclass(frozen=True)
class ValidationResult:
    """What a table's validation found; all frames are lazy."""

    table: DataFrame
    spec: SpecCollection
    key: list[str]
    compat: str | None = None
    #: Columns that hold a delimited file's text, with the types that they are meant to have.
    kinds: Mapping[str, T.DataType] = field(default_factory=dict)
    #: A column with the numbers of the rows, if there is one.
    row: str | None = None

    @functools.cached_property
    def constraints(self) -> list[Constraint]:
        return constraints(self.spec, self.table, self.compat, dict(self.kinds))

    @functools.cached_property
    def errors(self) -> DataFrame:
        """With ``compat="reference"`` those of the first 5,000 rows that have any, by the rows' numbers or else in the order of the key."""
        key = list(dict.fromkeys([*self.key, self.row])) if self.row else self.key
        if self.compat != "reference" or not self.constraints:
            return error_rows(self.table, self.constraints, key)
        if self.row:
            return first_chunk(error_rows(self.table, self.constraints, key), key_names(key)[self.row])
        return error_rows(chunk_of_rows(self.table, self.key, any_broken(self.constraints), name="_row"), self.constraints, key)

    @functools.cached_property
    def summary(self) -> DataFrame:
        """Grouped errors; if columns are missing, only those errors, one per column."""
        errors = self.errors
        missing = errors.where("keyword = 'required'")
        if any(c.keyword == "required" for c in self.constraints):
            return missing.select("keyword", "message").distinct()
        if self.compat != "reference" and self.constraints:
            return summary_of(self.table, self.constraints, [self.row] if self.row else self.key)
        names = key_names(list(dict.fromkeys([*self.key, self.row])) if self.row else self.key)
        row = names[self.row] if self.row else names[self.key[0]] if len(self.key) == 1 else None
        if row is None:
            errors, row = errors.withColumn("_key", F.struct(*[F.col(f"`{k}`") for k in names.values()])), "_key"
        return error_summary(errors, row)

    def rule_results(self) -> DataFrame:
        return rule_results(self.table, self.spec.rules, self.compat, dict(self.kinds))

    @functools.cached_property
    def is_structurally_valid(self) -> bool:
        if any(c.keyword == "required" for c in self.constraints):
            return False
        return not self.constraints or self.table.where(any_broken(self.constraints)).isEmpty()

    @functools.cached_property
    def rules(self) -> list[RuleResult]:
        return apply_rules(self.table, self.spec.rules, self.compat, dict(self.kinds)) if self.spec.rules else []

    @property
    def is_valid(self) -> bool:
        return self.is_structurally_valid and all(r.valid for r in self.rules)

    def raise_on_failure(self) -> ValidationResult:
        if not self.is_structurally_valid:
            raise StructuralErrors(self.summary)
        if bad := [r for r in self.rules if not r.valid]:
            raise RuleViolation(bad)
        return self

    def flagged(self, name: str = "valid") -> DataFrame:
        """Extension: the table, its values as given, with a column that says whether a row breaks neither cells nor row rules; one scan."""
        rows = self.table.withColumn(name, ~any_broken(self.constraints))
        rules = [r for r in self.spec.rules if r.type != "check_unique"]
        if not rules:
            return rows
        seen = beside_typed(rows, dict(self.kinds)) if self.kinds else rows
        broken = functools.reduce(lambda a, b: a | b, [F.coalesce(row_broken(seen, r, self.compat), F.lit(False)) for r in rules])
        seen = seen.withColumn(name, F.col(f"`{name}`") & ~broken)
        return seen.select(*[F.col(f"_given.`{c}`") for c in self.table.columns if c != name], name) if self.kinds else seen

    def split(self) -> tuple[DataFrame, DataFrame]:
        """Extension: rows without and with broken cells or row rules, for a quarantine. Two scans if both are used;
        ``flagged`` gives both in one."""
        rows = self.flagged("_valid")
        return rows.where("_valid").drop("_valid"), rows.where("NOT _valid").drop("_valid")


def validate(
    df: DataFrame, spec: SpecCollection, key: list[str] | str, compat: str | None = None, blank_as_null: bool = True, delimited: bool | None = None, row: str | None = None
) -> ValidationResult:
    """Validate a table whose rows ``key`` tells apart; "" counts as null unless ``blank_as_null`` is off.

    In a delimited file's column each value that can't be read is an error of type; with ``compat="reference"`` one such
    value makes all of its column text, and every row an error. ``delimited`` says whether the table is such a file's; left
    open, its columns' marks do. ``row`` names a column with the rows' numbers, as ``read_delimited`` gives them.
    """
    df, key = empty_to_null(df) if blank_as_null else df, [key] if isinstance(key, str) else list(key)
    kinds = text_kinds(df, spec, delimited)
    return ValidationResult(typed_if_clean(df, kinds), spec, key, compat, {}, row) if compat == "reference" else ValidationResult(df, spec, key, compat, kinds, row)
