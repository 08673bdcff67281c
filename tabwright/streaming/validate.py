"""Extension: validation of a stream, with the same expressions as for tables.

Constraints on cells and row rules have no state, so they apply to a stream as they are. Uniqueness is kept within a
watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.operators.rules import row_broken
from tabwright.operators.validate import error_rows
from tabwright.plans.constraints import constraints
from tabwright.spec import Rule, SpecCollection


def stream_errors(stream: DataFrame, spec: SpecCollection, key: list[str]) -> DataFrame:
    """Errors of cells as a stream, in append mode."""
    return error_rows(stream, constraints(spec, stream), key)


def stream_rule_violations(stream: DataFrame, rules: list[Rule], key: list[str]) -> DataFrame:
    """(key..., rule_id) for each row that breaks a rule on single rows."""
    found = [F.when(row_broken(stream, r), F.lit(r.id)) for r in rules if r.type != "check_unique"]
    return stream.select(*key, F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("rule_id"))


def first_occurrences(stream: DataFrame, rule: Rule, time: str, delay: str) -> DataFrame:
    """The first row of each combination of a uniqueness rule's columns within the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(rule.column))
