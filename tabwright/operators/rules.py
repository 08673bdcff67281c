"""Rules over whole tables.

All ranges, conditions and allowed combinations of a table are counted in one aggregate over one scan. Each uniqueness
rule is one grouped aggregate on its columns, combined before the shuffle, so a value that fills the table is a single
row by then; of texts longer than a digest only the digest is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.columns import beside_typed, text_kinds, typed
from tabwright.functions.conditions import all_conditions, one_condition, plain
from tabwright.spec import Rule, SpecError

RESULT_SCHEMA = "rule_id string, type string, valid boolean, n_violations bigint, message string"


@dataclass(frozen=True)
class RuleResult:
    id: str
    valid: bool
    n_violations: int
    message: str | None


class RuleViolation(Exception):
    """Rules that a table breaks; ``results`` has them."""

    def __init__(self, results: list[RuleResult]) -> None:
        super().__init__("\n".join(r.message or r.id for r in results))
        self.results = results


def _known(df: DataFrame, rule: Rule) -> None:
    if missing := [c for c in rule.columns if c not in df.columns]:
        raise SpecError(f"rule {rule.id} reads {', '.join(missing)}, which the table doesn't have")


def range_broken(df: DataFrame, rule: Rule) -> Column:
    """Outside the inclusive range; what can't be read as a number is never outside."""
    name = rule.column[0]
    number = F.col(f"`{name}`").try_cast("double")
    number = plain(number, T.DoubleType())
    low, high = (float(x) for x in rule.range)
    return ~number.between(low, high)


def condition_broken(df: DataFrame, rule: Rule, compat: str | None = None) -> Column:
    """``condition`` is true and ``then`` is false; unknown breaks nothing."""
    return all_conditions(df, rule.condition, compat) & ~all_conditions(df, rule.then, compat)


def combination_broken(df: DataFrame, columns: Iterable[str], allowed: Iterable[Iterable]) -> Column:
    """The values of the columns aren't one of the allowed combinations; a null is only allowed where one lists it."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    found = F.lit(False)
    for values in allowed:
        same = F.lit(True)
        for c, v in zip(columns, values, strict=True):
            same = same & (F.col(f"`{c}`").isNull() if v is None else F.coalesce(one_condition(F.col(f"`{c}`"), kinds[c], "equals", v), F.lit(False)))
        found = found | same
    return ~found


def row_broken(df: DataFrame, rule: Rule, compat: str | None = None) -> Column:
    """Whether a row breaks a rule that looks at single rows; null where that is unknown."""
    _known(df, rule)
    if rule.type == "check_allowed_combinations":
        return combination_broken(df, rule.column, rule.allowed)
    return range_broken(df, rule) if rule.type == "check_range" else condition_broken(df, rule, compat)


def message_of(rule: Rule) -> tuple[str, str]:
    """The text before and after the number of violations."""
    if rule.type == "check_range":
        return f"Rule '{rule.id}' violated: ", f" rows where {rule.column[0]} not in range [{rule.range[0]}, {rule.range[1]}]"
    if rule.type == "check_unique":
        return f"Rule '{rule.id}' violated: ", f" duplicate values found in column {', '.join(rule.column)}"
    if rule.type == "check_allowed_combinations":
        return f"Rule '{rule.id}' violated: ", f" rows with combinations of {', '.join(rule.column)} that aren't allowed"
    return f"Rule '{rule.id}' violated: ", " rows failed the then conditions"


def _results(counts: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per rule from one row of counts v0, v1, ..."""
    rows = []
    for k, rule in enumerate(rules):
        before, after = message_of(rule)
        n = F.col(f"v{k}")
        rows.append(F.struct(F.lit(rule.id).alias("rule_id"), F.lit(rule.type).alias("type"), (n == 0).alias("valid"), n.alias("n_violations"), F.when(n > 0, F.concat(F.lit(before), n.cast("string"), F.lit(after))).alias("message")))
    return counts.select(F.inline(F.array(*rows)))


def short_keys(df: DataFrame, columns: Iterable[str]) -> tuple[list[Column], Column | None]:
    """Columns to group by in place of ``columns``, and a check of the rows in a group.

    A text longer than the SHA-256 that stands for it can't look like one. The check is null for groups without such
    texts; where it differs within a group, two texts have one digest.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    keys, checked = [], []
    for c in columns:
        text = F.col(f"`{c}`")
        if isinstance(kinds[c], T.StringType):
            long = F.length(text) > 64
            keys.append(F.when(long, F.concat(F.lit("#"), F.sha2(text, 256))).otherwise(text))
            checked.append(F.when(long, F.xxhash64(text)))
        else:
            keys.append(text)
    return keys, F.when(F.coalesce(*checked).isNotNull(), F.xxhash64(*checked)) if checked else None


def _grouped(df: DataFrame, columns: Iterable[str], *aggregates: Column) -> DataFrame:
    """``df`` grouped by the columns (as _u0, _u1, ...), with ``n`` and the aggregates."""
    keys, check = short_keys(df, columns)
    rows = df.groupBy(*[k.alias(f"_u{i}") for i, k in enumerate(keys)])
    n = F.count(F.lit(1))
    if check is None:
        return rows.agg(n.alias("n"), *aggregates)
    unlike = F.min(check) != F.max(check)
    return rows.agg(F.when(F.coalesce(unlike, F.lit(False)), F.raise_error(F.lit("two texts have one SHA-256")).cast("long")).otherwise(n).alias("n"), *aggregates)


def duplicate_count(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """One row: occurrences after the first, nulls being equal to each other."""
    return _grouped(df, columns).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("v0"))


def rule_results(df: DataFrame, rules: Iterable[Rule], compat: str | None = None, kinds: dict[str, T.DataType] | None = None) -> DataFrame:
    """(rule_id, type, valid, n_violations, message) for each rule."""
    rules, df = list(rules), typed(df, kinds)
    by_row = [r for r in rules if r.type != "check_unique"]
    parts = []
    if by_row:
        broken = [row_broken(df, r, compat) for r in by_row]
        parts.append(_results(df.agg(*[F.count_if(b).alias(f"v{k}") for k, b in enumerate(broken)]), by_row))
    for rule in rules:
        if rule.type == "check_unique":
            _known(df, rule)
            parts.append(_results(duplicate_count(df, rule.column), [rule]))
    if not parts:
        return df.sparkSession.createDataFrame([], RESULT_SCHEMA)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def apply_rules(df: DataFrame, rules: Iterable[Rule], compat: str | None = None, kinds: dict[str, T.DataType] | None = None) -> list[RuleResult]:
    """The results on the driver, one per rule and in their order."""
    rules = list(rules)
    found = {r.rule_id: RuleResult(r.rule_id, r.valid, r.n_violations, r.message) for r in rule_results(df, rules, compat, kinds).collect()}
    return [found[r.id] for r in rules]


def validate_rules(df: DataFrame, rules: Iterable[Rule], compat: str | None = None) -> list[RuleResult]:
    """``apply_rules``, raising if any rule is broken."""
    results = apply_rules(df, rules, compat)
    if bad := [r for r in results if not r.valid]:
        raise RuleViolation(bad)
    return results


def check_rule(x: object) -> Rule:
    if not isinstance(x, Rule):
        raise SpecError(f"not a rule: {x!r}")
    return x


def violating_rows(df: DataFrame, rule: Rule, key: list[str] | None = None, compat: str | None = None, kinds: dict[str, T.DataType] | None = None) -> DataFrame:
    """The rows that break a rule, with their values as given. For uniqueness these are all but the first by ``key`` of those alike."""
    kinds = text_kinds(df) if kinds is None else kinds
    if rule.type != "check_unique":
        rows = beside_typed(df, kinds) if kinds else df
        found = rows.where(F.coalesce(row_broken(rows, rule, compat), F.lit(False)))
        return found.select("_given.*") if kinds else found
    _known(df, rule)
    if not key:
        raise SpecError(f"rule {rule.id}: which of equal rows is first needs a key")
    rows = beside_typed(df, kinds, "_row")
    order = F.struct(*[F.col(f"`{k}`") for k in key])
    firsts = _grouped(rows, rule.column, F.min(order).alias("_first")).where("n > 1")
    keys, _ = short_keys(rows, rule.column)
    rows = rows.select("_row", order.alias("_own"), *[k.alias(f"_k{i}") for i, k in enumerate(keys)])
    same = F.lit(True)
    for i in range(len(keys)):
        same = same & F.col(f"_k{i}").eqNullSafe(F.col(f"_u{i}"))
    return rows.join(firsts, same).where(~F.col("_own").eqNullSafe(F.col("_first"))).select("_row.*")


def not_in_combinations(df: DataFrame, allowed: list[dict]) -> DataFrame:
    """Rows whose combination of values isn't among the allowed ones; with none allowed, all rows."""
    if not allowed:
        return df
    names = list(allowed[0])
    return violating_rows(df, Rule("combinations", "check_allowed_combinations", column=tuple(names), allowed=tuple(tuple(a[c] for c in names) for a in allowed)))


def missing_references(df: DataFrame, columns: list[str], other: DataFrame, other_columns: list[str]) -> DataFrame:
    """Extension: rows with a reference, none of it null, that the other table doesn't have."""
    keys = other.select(*[F.col(f"`{o}`").alias(f"_r_{k}") for k, o in enumerate(other_columns)])
    same, filled = F.lit(True), F.lit(True)
    for k, c in enumerate(columns):
        same, filled = same & (F.col(f"`{c}`") == F.col(f"_r_{k}")), filled & F.col(f"`{c}`").isNotNull()
    return df.where(filled).join(keys, same, "left_anti")
