"""Queries over the driver's tables, and the same in DuckDB SQL.

Rule queries give one row (rule_id, valid, n_violations); error queries give a row per violation. The tables hold no
nulls, so queries on nulls derive a column with nullif, in both languages.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.functions.columns import change_nas, change_type, check_format, check_nullable, check_pattern, check_type, check_values, empty_to_null
from tabwright.operators.rules import missing_references, not_in_combinations, rule_results, violating_rows
from tabwright.operators.shared import scratch
from tabwright.operators.validate import error_summary, validate
from tabwright.sources.word import spec_frame
from tabwright.spec import Rule, SpecCollection

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

P5 = "nullif(o_orderpriority, '5-LOW')"
#: Derived columns of ``orders``: a null, another null, NaN, and numbers as text beside text that is none.
DERIVED = {"p5": P5, "q5": "nullif(o_orderstatus, 'P')", "x5": "CASE WHEN o_orderpriority = '5-LOW' THEN {nan} ELSE o_totalprice END", "t5": "CASE WHEN o_orderpriority = '5-LOW' THEN 'low' ELSE substr(o_orderpriority, 1, 1) END"}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").withColumns({name: F.expr(e.format(nan="double('NaN')")) for name, e in DERIVED.items()})


def _query(name: str, sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _rule(name: str, table: str, given: dict, sql_from: str, broken: str, compat: str | None = None) -> None:
    """A range or condition rule, with the SQL predicate of its violations."""
    rule = Rule.from_dict({"id": name, **given})

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _orders(spark, sf_dir) if table == "orders" else _read(spark, sf_dir, table)
        return rule_results(df, [rule], compat).select("rule_id", "valid", "n_violations")

    QUERIES[name] = run
    SQL[name] = f"SELECT '{name}' AS rule_id, n = 0 AS valid, n AS n_violations FROM (SELECT count(*) FILTER (WHERE {broken}) AS n FROM {sql_from})"


def _unique(name: str, table: str, columns: list[str]) -> None:
    rule = Rule(name, "check_unique", column=tuple(columns))
    QUERIES[name] = lambda spark, sf_dir: rule_results(_read(spark, sf_dir, table), [rule]).select("rule_id", "valid", "n_violations")
    by = ", ".join(columns)
    SQL[name] = f"SELECT '{name}' AS rule_id, n = 0 AS valid, n AS n_violations FROM (SELECT coalesce(sum(k - 1), 0)::BIGINT AS n FROM (SELECT count(*) AS k FROM {table} GROUP BY {by}))"


def _when(condition: dict, then: dict) -> dict:
    return {"type": "check_condition", "condition": condition, "then": then}


_ORDERS = "(SELECT *, {} FROM orders)".format(", ".join(e.format(nan="'nan'::DOUBLE") + f" AS {name}" for name, e in DERIVED.items()))
_rule("rule_range", "lineitem", {"type": "check_range", "column": "l_quantity", "range": [5, 45]}, "lineitem", "NOT (l_quantity BETWEEN 5 AND 45)")
_rule("rule_range_negative", "customer", {"type": "check_range", "column": "c_acctbal", "range": [0, 9999]}, "customer", "NOT (c_acctbal BETWEEN 0 AND 9999)")
_unique("rule_unique_multi", "lineitem", ["l_orderkey", "l_linenumber"])
_unique("rule_unique_single", "documents", ["text"])
_unique("rule_unique_pass", "orders", ["o_orderkey"])
_rule("cond_equals", "lineitem", _when({"l_returnflag": {"equals": "R"}}, {"l_linestatus": {"equals": "F"}}), "lineitem", "l_returnflag = 'R' AND l_linestatus <> 'F'")
_rule("cond_not_equals", "orders", _when({"o_orderstatus": {"equals": "P"}}, {"o_orderpriority": {"not_equals": "1-URGENT"}}), "orders", "o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'")
_rule("cond_in", "customer", _when({"c_mktsegment": {"equals": "BUILDING"}}, {"c_nationkey": {"in": list(range(13))}}), "customer", "c_mktsegment = 'BUILDING' AND c_nationkey NOT BETWEEN 0 AND 12")
_rule("cond_in_null_fails", "orders", _when({"o_orderstatus": {"equals": "F"}}, {"p5": {"in": ["1-URGENT"]}}), _ORDERS, "o_orderstatus = 'F' AND p5 IS DISTINCT FROM '1-URGENT'")
_rule("cond_equals_null_passes", "orders", _when({"o_orderstatus": {"equals": "F"}}, {"p5": {"equals": "1-URGENT"}}), _ORDERS, "o_orderstatus = 'F' AND p5 <> '1-URGENT'")
_rule("cond_not_in", "events", _when({"event_type": {"equals": "error"}}, {"user_id": {"not_in": [1, 2, 3]}}), "events", "event_type = 'error' AND user_id IN (1, 2, 3)")
_rule("cond_greater", "lineitem", _when({"l_returnflag": {"equals": "A"}}, {"l_discount": {"greater": 0.02}}), "lineitem", "l_returnflag = 'A' AND NOT (l_discount > 0.02::DOUBLE)")
_rule("cond_less", "part", _when({"p_type": {"equals": "ECONOMY"}}, {"p_size": {"less": 25}}), "part", "p_type = 'ECONOMY' AND NOT (p_size < 25)")
_rule("cond_greater_equal", "part", _when({"p_type": {"equals": "ECONOMY"}}, {"p_size": {"greater_equal": 25}}), "part", "p_type = 'ECONOMY' AND NOT (p_size >= 25)")
_rule("cond_greater_equal_strict", "part", _when({"p_type": {"equals": "ECONOMY"}}, {"p_size": {"greater_equal": 25}}), "part", "p_type = 'ECONOMY' AND NOT (p_size > 25)", "reference")
_rule("cond_less_equal", "part", _when({"p_type": {"equals": "ECONOMY"}}, {"p_size": {"less_equal": 25}}), "part", "p_type = 'ECONOMY' AND NOT (p_size <= 25)")
_rule("cond_range", "events", _when({"event_type": {"equals": "purchase"}}, {"value": {"range": [5, 100]}}), "events", "event_type = 'purchase' AND NOT (value BETWEEN 5 AND 100)")
_rule("cond_empty_true", "orders", _when({"o_orderstatus": {"equals": "F"}}, {"p5": {"empty": True}}), _ORDERS, "o_orderstatus = 'F' AND p5 IS NOT NULL AND p5 <> ''")
_rule("cond_empty_false", "orders", _when({"o_orderstatus": {"equals": "F"}}, {"p5": {"empty": False}}), _ORDERS, "o_orderstatus = 'F' AND (p5 IS NULL OR p5 = '')")
_rule(
    "cond_multi",
    "lineitem",
    _when({"l_returnflag": {"equals": "R"}, "l_linestatus": {"equals": "O"}}, {"l_quantity": {"range": [2, 48]}, "l_discount": {"less": 0.1}, "l_tax": {"in": [k / 100 for k in range(8)]}}),
    "lineitem",
    "l_returnflag = 'R' AND l_linestatus = 'O' AND NOT (l_quantity BETWEEN 2 AND 48 AND l_discount < 0.1::DOUBLE AND l_tax IN (0::DOUBLE, 0.01::DOUBLE, 0.02::DOUBLE, 0.03::DOUBLE, 0.04::DOUBLE, 0.05::DOUBLE, 0.06::DOUBLE, 0.07::DOUBLE))",
)
_rule("sugar_equal", "lineitem", {"type": "check_equal", "condition": {"column": "l_returnflag", "equals": "N"}, "then": {"column": "l_linestatus", "equals": "O"}}, "lineitem", "l_returnflag = 'N' AND l_linestatus <> 'O'")
_rule("sugar_unequal", "orders", {"type": "check_unequal", "condition": {"column": "o_orderstatus", "equals": "P"}, "then": {"column": "o_orderpriority", "equals": "1-URGENT"}}, "orders", "o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'")
_rule("sugar_dependency", "orders", {"type": "check_dependency", "condition": {"column": "o_orderstatus", "equals": "F"}, "then": "p5"}, _ORDERS, "o_orderstatus = 'F' AND p5 IS NULL")
_rule("sugar_mutual_exclusive", "orders", {"type": "check_mutual_exclusive", "columns": ["p5", "q5"]}, _ORDERS, "p5 IS NOT NULL AND q5 IS NOT NULL")
_rule("cond_never_both", "labels", _when({"quality": {"equals": 1}}, {"toxic": {"not_equals": 1}}), "labels", "quality = 1 AND toxic = 1")
_rule("cond_empty_nan", "orders", _when({"o_orderstatus": {"equals": "P"}}, {"x5": {"empty": False}}), _ORDERS, "o_orderstatus = 'P' AND isnan(x5)")
_rule("cond_empty_nan_reference", "orders", _when({"x5": {"empty": False}}, {"o_orderstatus": {"equals": "F"}}), _ORDERS, "x5 IS NOT NULL AND o_orderstatus <> 'F'", "reference")
_rule("cond_nan_is_unknown", "orders", _when({"o_orderstatus": {"equals": "P"}}, {"x5": {"less": 100000}}), _ORDERS, "o_orderstatus = 'P' AND NOT isnan(x5) AND NOT (x5 < 100000)")
_rule("rule_range_text", "orders", {"type": "check_range", "column": "t5", "range": [2, 4]}, _ORDERS, "try_cast(t5 AS DOUBLE) NOT BETWEEN 2 AND 4")
_rule("rule_combinations", "lineitem", {"type": "check_allowed_combinations", "columns": ["l_returnflag", "l_linestatus"], "allowed": [["R", "F"], ["A", "F"], ["N", "O"]]}, "lineitem", "l_returnflag || l_linestatus NOT IN ('RF', 'AF', 'NO')")
_rule("rule_combinations_null", "orders", {"type": "check_allowed_combinations", "columns": ["o_orderstatus", "p5"], "allowed": [["F", None], ["O", "1-URGENT"], ["P", "2-HIGH"]]}, _ORDERS, "NOT coalesce((o_orderstatus = 'F' AND p5 IS NULL) OR (o_orderstatus = 'O' AND p5 = '1-URGENT') OR (o_orderstatus = 'P' AND p5 = '2-HIGH'), false)")

LINEITEM_RULES = [
    Rule("quantity", "check_range", column=("l_quantity",), range=(5, 45)),
    Rule("discount", "check_range", column=("l_discount",), range=(0, 0.08)),
    Rule("returned", "check_condition", {"l_returnflag": {"equals": "R"}}, {"l_linestatus": {"equals": "F"}}),
    Rule("taxed", "check_condition", {"l_linestatus": {"equals": "O"}}, {"l_tax": {"greater": 0.01}}),
    Rule("line", "check_unique", column=("l_orderkey", "l_linenumber")),
]


@_query(
    "rules_fused",
    """
    WITH c AS (SELECT count(*) FILTER (WHERE NOT (l_quantity BETWEEN 5 AND 45)) AS a, count(*) FILTER (WHERE NOT (l_discount BETWEEN 0 AND 0.08::DOUBLE)) AS b,
      count(*) FILTER (WHERE l_returnflag = 'R' AND l_linestatus <> 'F') AS c, count(*) FILTER (WHERE l_linestatus = 'O' AND NOT (l_tax > 0.01::DOUBLE)) AS d FROM lineitem),
    u AS (SELECT sum(k - 1)::BIGINT AS e FROM (SELECT count(*) AS k FROM lineitem GROUP BY l_orderkey, l_linenumber)),
    r AS (SELECT 'quantity' AS rule_id, a AS n_violations FROM c UNION ALL SELECT 'discount', b FROM c UNION ALL SELECT 'returned', c FROM c UNION ALL SELECT 'taxed', d FROM c UNION ALL SELECT 'line', e FROM u)
    SELECT rule_id, n_violations = 0 AS valid, n_violations FROM r
    """,
)
def rules_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_results(_read(spark, sf_dir, "lineitem"), LINEITEM_RULES).select("rule_id", "valid", "n_violations")


@_query("rule_violating_rows", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'")
def rule_violating_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = Rule("r", "check_condition", {"o_orderstatus": {"equals": "P"}}, {"o_orderpriority": {"not_equals": "1-URGENT"}})
    return violating_rows(_read(spark, sf_dir, "orders"), rule).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@_query("unique_violating_rows", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents) WHERE k > 1")
def unique_violating_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return violating_rows(_read(spark, sf_dir, "documents").select("doc_id", "text"), Rule("u", "check_unique", column=("text",)), ["doc_id"]).select("doc_id")


@_query("sugar_allowed_combinations", "SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus FROM lineitem WHERE l_returnflag || l_linestatus NOT IN ('RF', 'AF', 'NO')")
def sugar_allowed_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = [{"l_returnflag": r, "l_linestatus": s} for r, s in (("R", "F"), ("A", "F"), ("N", "O"))]
    return not_in_combinations(_read(spark, sf_dir, "lineitem"), allowed).select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")


@_query("missing_references", "SELECT o_orderkey FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)")
def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing_references(_read(spark, sf_dir, "orders"), ["o_custkey"], _read(spark, sf_dir, "customer").where("c_acctbal >= 0"), ["c_custkey"]).select("o_orderkey")


def _errors(name: str, table: str, key: str, column: dict, broken: str, data: str | None = None, keyword: str | None = None, sql_from: str | None = None) -> None:
    """The errors of one column, of one keyword where it could break several."""
    spec = SpecCollection.from_dicts([{"nullable": False, **column}])
    keyword = keyword or name.removeprefix("errors_")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _orders(spark, sf_dir) if table == "orders" else _read(spark, sf_dir, table)
        return validate(df, spec, key).errors.where(F.col("keyword") == keyword).select(key, "column", "keyword", "data")

    QUERIES[name] = run
    c = column["id"]
    SQL[name] = f"SELECT {key}, '{c}' AS \"column\", '{keyword}' AS keyword, {data or c} AS data FROM {sql_from or table} WHERE {broken}"


_errors("errors_enum", "orders", "o_orderkey", {"id": "o_orderstatus", "values": ["F", "O"]}, "o_orderstatus NOT IN ('F', 'O')")
_errors("errors_const", "region", "r_regionkey", {"id": "r_name", "values": "ASIA"}, "r_name <> 'ASIA'")
_errors("errors_pattern", "customer", "c_custkey", {"id": "c_name", "pattern": "^Customer#[0-9]*[05]$"}, "NOT regexp_matches(c_name, '^Customer#[0-9]*[05]$')")
_errors("errors_max_length", "part", "p_partkey", {"id": "p_name", "length": 9}, "length(p_name) > 9", keyword="maxLength")
_errors("errors_max_length_unicode", "documents", "doc_id", {"id": "text", "length": 5000}, "length(text) > 5000", keyword="maxLength")
_errors("errors_not_nullable", "orders", "o_orderkey", {"id": "p5"}, "p5 IS NULL", keyword="type", sql_from=_ORDERS)


@_query("errors_type_integer", "SELECT c_custkey, 'c_acctbal' AS \"column\", 'type' AS keyword FROM customer WHERE c_acctbal <> floor(c_acctbal)")
def errors_type_integer(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = SpecCollection.from_dicts([{"id": "c_acctbal", "type": "Int", "nullable": False}])
    return validate(_read(spark, sf_dir, "customer"), spec, "c_custkey").errors.select("c_custkey", "column", "keyword")


def _wrong_type(name: str, table: str, key: str, column: str, kind: str, json_type: str, nullable: bool, sql_from: str | None = None, broken: str = "true") -> None:
    """Errors of a column whose values are all, or where ``broken``, of the wrong type."""
    spec = SpecCollection.from_dicts([{"id": column, "type": kind, "nullable": nullable}])

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _orders(spark, sf_dir) if table == "orders" else _read(spark, sf_dir, table)
        return validate(df, spec, key).errors.select(key, "column", "keyword", "message", "schema")

    allowed = f"{json_type},null" if nullable else json_type
    shown = f'["{json_type}", "null"]' if nullable else json_type
    QUERIES[name] = run
    SQL[name] = f"SELECT {key}, '{column}' AS \"column\", 'type' AS keyword, 'must be {allowed}' AS message, '{shown}' AS schema FROM {sql_from or table} WHERE {broken}"


_wrong_type("errors_type_string", "customer", "c_custkey", "c_nationkey", "Char", "string", False)
_wrong_type("errors_type_number", "part", "p_partkey", "p_brand", "Num", "number", True)
_wrong_type("errors_type_boolean", "labels", "doc_id", "toxic", "Bool", "boolean", False)
_wrong_type("errors_type_nan", "orders", "o_orderkey", "x5", "Num", "number", False, _ORDERS, "isnan(x5)")
_wrong_type("errors_type_null_allowed", "orders", "o_orderkey", "p5", "Int", "integer", True, _ORDERS, "p5 IS NOT NULL")
_errors("errors_enum_integer", "part", "p_partkey", {"id": "p_size", "type": "Int", "values": ["1", "2.0", "7"]}, "p_size NOT IN (1, 2, 7)", "p_size::VARCHAR", "enum")
_errors("errors_enum_nullable", "orders", "o_orderkey", {"id": "p5", "nullable": True, "values": ["1-URGENT", "2-HIGH"]}, "p5 NOT IN ('1-URGENT', '2-HIGH')", None, "enum", _ORDERS)


@_query(
    "errors_list_cells",
    f"SELECT o_orderkey, 'cells' AS \"column\", 'must be string' AS message, o_orderstatus || '; ' || coalesce({P5}, 'NA') AS data FROM orders",
)
def errors_list_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir).select("o_orderkey", F.array("o_orderstatus", "p5").alias("cells"))
    return validate(rows, SpecCollection.from_dicts([{"id": "cells"}]), "o_orderkey").errors.select("o_orderkey", "column", "message", "data")


_REQUIRED = "SELECT 'required' AS keyword, 'must have required property ' || chr(39) || c || chr(39) AS message FROM (VALUES ('r_code'), ('r_note')) AS t(c)"


@_query("required_summary", _REQUIRED)
def required_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = SpecCollection.from_dicts([{"id": "r_name", "nullable": False, "values": "ASIA"}, {"id": "r_code"}, {"id": "r_note"}])
    return validate(_read(spark, sf_dir, "region"), spec, "r_regionkey").summary


@_query("errors_required", "SELECT r_regionkey, 'required' AS keyword, 'must have required property ''r_code''' AS message FROM region")
def errors_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = SpecCollection.from_dicts([{"id": "r_name", "nullable": False}, {"id": "r_code"}])
    return validate(_read(spark, sf_dir, "region"), spec, "r_regionkey").errors.select("r_regionkey", "keyword", "message")


PART_SPEC = SpecCollection.from_dicts(
    [{"id": "p_name", "nullable": False, "length": 9}, {"id": "p_type", "nullable": False, "values": ["ECONOMY", "STANDARD", "SMALL"]}, {"id": "p_brand", "nullable": False, "pattern": "^Brand#[0-9]$"}]
)


@_query(
    "error_summary",
    """
    WITH e AS (SELECT p_partkey, 'p_name' AS c, 'maxLength' AS keyword, p_name AS data FROM part WHERE length(p_name) > 9
      UNION ALL SELECT p_partkey, 'p_type', 'enum', p_type FROM part WHERE p_type NOT IN ('ECONOMY', 'STANDARD', 'SMALL')
      UNION ALL SELECT p_partkey, 'p_brand', 'pattern', p_brand FROM part WHERE NOT regexp_matches(p_brand, '^Brand#[0-9]$'))
    SELECT c AS "column", keyword, data, min(p_partkey) AS first_row_affected, max(p_partkey) AS last_row_affected, count(*) AS n_rows_affected FROM e GROUP BY ALL
    """,
)
def part_error_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = validate(_read(spark, sf_dir, "part"), PART_SPEC, "p_partkey").errors
    return error_summary(errors, "p_partkey", ("column", "keyword", "data"))


@_query(
    "error_first_chunk",
    """
    WITH n AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY o_orderkey) AS "row" FROM orders),
    e AS (SELECT *, ceil("row" / 5000) AS chunk FROM n WHERE o_orderstatus NOT IN ('F', 'O'))
    SELECT o_orderkey, 'o_orderstatus' AS "column", 'enum' AS keyword, o_orderstatus AS data FROM e WHERE chunk = (SELECT min(chunk) FROM e)
    """,
)
def error_first_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of the first 5,000 rows, in the order of the key, that have any."""
    spec = SpecCollection.from_dicts([{"id": "o_orderstatus", "nullable": False, "values": ["F", "O"]}])
    return validate(_read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), spec, "o_orderkey", compat="reference").errors.select("o_orderkey", "column", "keyword", "data")


@_query("empty_to_null", "SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END AS p FROM orders")
def blank_to_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    blank = F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise(F.col("o_orderpriority"))
    return empty_to_null(_read(spark, sf_dir, "orders").select("o_orderkey", blank.alias("p")))


@_query("change_nas", f"SELECT o_orderkey, coalesce({P5}, '') AS p FROM orders")
def nas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).select("o_orderkey", change_nas(F.col("p5"), "character").alias("p"))


@_query("change_type", "SELECT p_partkey, p_size::VARCHAR AS as_text, try_cast(p_size::VARCHAR AS DOUBLE) AS as_number, try_cast(p_type AS DOUBLE) AS no_number FROM part")
def types(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = change_type(F.col("p_size"), "character")
    return _read(spark, sf_dir, "part").select("p_partkey", text.alias("as_text"), change_type(text, "numeric").alias("as_number"), change_type(F.col("p_type"), "numeric").alias("no_number"))


@_query(
    "check_columns",
    f"""
    SELECT bool_and(length(o_orderstatus) <= 1) AS format_ok, bool_and(length(o_orderpriority) <= 8) AS format_bad, true AS nullable_ok,
      bool_and({P5} IS NOT NULL AND {P5} <> '') AS nullable_bad, true AS type_ok, false AS type_bad, bool_and(o_orderstatus IN ('F', 'O', 'P')) AS values_ok, bool_and(regexp_matches(o_orderpriority, '^[1-4]')) AS pattern_bad FROM orders
    """,
)
def check_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _orders(spark, sf_dir)
    return df.agg(
        check_format(F.col("o_orderstatus"), 1).alias("format_ok"), check_format(F.col("o_orderpriority"), 8).alias("format_bad"),
        check_nullable(F.col("p5"), True).alias("nullable_ok"), check_nullable(F.col("p5"), False).alias("nullable_bad"),
        check_type(df, "o_orderstatus", "character").alias("type_ok"), check_type(df, "o_orderstatus", "numeric").alias("type_bad"),
        check_values(F.col("o_orderstatus"), ["F", "O", "P"]).alias("values_ok"), check_pattern(F.col("o_orderpriority"), "^[1-4]").alias("pattern_bad"),
    )


@_query(
    "spec_table",
    """
    SELECT s.*, n_values, longest FROM (VALUES ('p_name', '', 'Char', '9', '', 'No', ''), ('p_type', '', 'Char', '', '', 'No', '#@values: ECONOMY; STANDARD; SMALL'), ('p_brand', '', 'Char', '', '', 'No', '#@pattern: ^Brand#[0-9]$'))
      AS s("Variable Name", "Variable Label", "Type", "Length", "Format", "Nullable", "Description")
    JOIN (SELECT 'p_name' AS c, count(p_name) AS n_values, max(length(p_name))::INT AS longest FROM part UNION ALL SELECT 'p_type', count(p_type), max(length(p_type))::INT FROM part UNION ALL SELECT 'p_brand', count(p_brand), max(length(p_brand))::INT FROM part)
      ON c = "Variable Name"
    """,
)
def spec_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documentation of a specification, with what ``part`` holds beside each column: values, and the longest one's length."""
    part = _read(spark, sf_dir, "part")
    held = [F.struct(F.lit(c).alias("c"), F.count(c).alias("n_values"), F.max(F.length(c)).alias("longest")) for c in PART_SPEC.column_ids]
    seen = part.agg(F.array(*held).alias("a")).select(F.inline("a"))
    docs = spec_frame(spark, PART_SPEC)
    return docs.join(seen, docs["Variable Name"] == seen["c"]).drop("c")


ORDERS_SPEC = SpecCollection.from_dicts(
    [
        {"id": "o_orderkey", "type": "Int", "nullable": False},
        {"id": "o_custkey", "type": "Int", "nullable": False},
        {"id": "o_orderstatus", "type": "Char", "nullable": False, "values": ["F", "O"], "length": 1},
        {"id": "o_totalprice", "type": "Num", "nullable": False},
        {"id": "o_orderpriority", "type": "Char", "nullable": False, "pattern": "^[1-4]-", "length": 8},
        {"id": "p5", "type": "Char", "nullable": False},
    ],
    [
        {"id": "price", "type": "check_range", "column": "o_totalprice", "range": [0, 400000]},
        {"id": "key", "type": "check_unique", "column": "o_orderkey"},
        {"id": "urgent", "type": "check_condition", "condition": {"o_orderstatus": {"equals": "P"}}, "then": {"o_orderpriority": {"not_equals": "1-URGENT"}}},
    ],
    {"version": "1.0", "author": "example"},
)


@_query(
    "orders_summary",
    f"""
    WITH e AS (SELECT o_orderkey, 'o_orderstatus' AS c, 'enum' AS keyword, o_orderstatus AS data FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
      UNION ALL SELECT o_orderkey, 'o_orderpriority', 'maxLength', o_orderpriority FROM orders WHERE length(o_orderpriority) > 8
      UNION ALL SELECT o_orderkey, 'o_orderpriority', 'pattern', o_orderpriority FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[1-4]-')
      UNION ALL SELECT o_orderkey, 'p5', 'type', {P5} FROM orders WHERE {P5} IS NULL)
    SELECT c AS "column", keyword, data, min(o_orderkey) AS first_row_affected, max(o_orderkey) AS last_row_affected, count(*) AS n_rows_affected FROM e GROUP BY ALL
    """,
)
def orders_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: all constraints of a specification over ``orders``, grouped."""
    found = validate(_orders(spark, sf_dir), ORDERS_SPEC, "o_orderkey")
    return found.summary.select("column", "keyword", "data", "first_row_affected", "last_row_affected", "n_rows_affected")


@_query("quarantine", "SELECT o_orderkey, NOT (o_orderstatus NOT IN ('F', 'O') OR length(o_orderpriority) > 8 OR NOT regexp_matches(o_orderpriority, '^[1-4]-') OR o_orderpriority = '5-LOW' OR NOT (o_totalprice BETWEEN 0 AND 400000) OR (o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')) AS good FROM orders")
def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate(_orders(spark, sf_dir), ORDERS_SPEC, "o_orderkey").flagged("good").select("o_orderkey", "good")


@_query("quarantine_split", "SELECT (o_orderstatus NOT IN ('F', 'O')) AS bad, count(*) AS n FROM orders GROUP BY 1")
def quarantine_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = SpecCollection.from_dicts([{"id": "o_orderstatus", "nullable": False, "values": ["F", "O"]}])
    parts = validate(_read(spark, sf_dir, "orders"), spec, "o_orderkey").split()
    both = parts[0].select(F.lit(False).alias("bad")).union(parts[1].select(F.lit(True)))
    return both.groupBy("bad").agg(F.count(F.lit(1)).alias("n"))


_FULL = """
    SELECT o_orderkey, 'o_orderstatus' AS "column", 'enum' AS keyword, 'must be equal to one of the allowed values' AS message, '["F", "O"]' AS schema, o_orderstatus AS data,
      '{"type": "string", "maxLength": 1, "enum": ["F", "O"]}' AS parent_schema, '{"allowedValues": ["F", "O"]}' AS params FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
    UNION ALL SELECT o_orderkey, 'o_orderpriority', 'maxLength', 'must NOT have more than 8 characters', '8', o_orderpriority,
      '{"type": "string", "maxLength": 8, "pattern": "^[1-4]-"}', '{"limit": 8}' FROM orders WHERE length(o_orderpriority) > 8
    UNION ALL SELECT o_orderkey, 'o_orderpriority', 'pattern', 'must match pattern "^[1-4]-"', '^[1-4]-', o_orderpriority,
      '{"type": "string", "maxLength": 8, "pattern": "^[1-4]-"}', '{"pattern": "^[1-4]-"}' FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[1-4]-')
    UNION ALL SELECT o_orderkey, 'p5', 'type', 'must be string', 'string', NULL, '{"type": "string"}', '{"type": "string"}' FROM orders WHERE o_orderpriority = '5-LOW'
"""


@_query("errors_all_columns", _FULL)
def errors_all_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of a whole specification with all that is said about them."""
    return validate(_orders(spark, sf_dir), ORDERS_SPEC, "o_orderkey").errors


@_query("summary_all_columns", f"WITH e AS ({_FULL}) SELECT * EXCLUDE (o_orderkey), min(o_orderkey) AS first_row_affected, max(o_orderkey) AS last_row_affected, count(*) AS n_rows_affected FROM e GROUP BY ALL")
def summary_all_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate(_orders(spark, sf_dir), ORDERS_SPEC, "o_orderkey").summary


@_query("stream_errors", SQL["errors_enum"])
def stream_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The errors of ``orders`` read as a stream."""
    from tabwright.streaming.validate import stream_errors

    spec = SpecCollection.from_dicts([{"id": "o_orderstatus", "nullable": False, "values": ["F", "O"]}])
    at = f"{sf_dir}/orders.parquet"
    schema = spark.read.parquet(at).schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/orders.parque[t]")
    out = scratch(spark, "stream")
    query = stream_errors(stream, spec, ["o_orderkey"]).writeStream.format("parquet").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start(f"{out}/rows")
    query.awaitTermination()
    return spark.read.schema(query_schema(schema)).parquet(f"{out}/rows").select("o_orderkey", "column", "keyword", "data")


@functools.cache
def _error_fields() -> str:
    return "column string, keyword string, message string, schema string, data string, parent_schema string, params string"


def query_schema(schema) -> str:
    return f"o_orderkey {schema['o_orderkey'].dataType.simpleString()}, {_error_fields()}"


def queries() -> dict[str, Query]:
    from tabwright import queries_checks, queries_files

    return dict(QUERIES) | queries_files.QUERIES | queries_checks.QUERIES


def oracle_sql() -> dict[str, str]:
    from tabwright import queries_checks, queries_files

    return dict(SQL) | queries_files.SQL | queries_checks.SQL
