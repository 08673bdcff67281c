"""Queries on specifications and tables in files, delivery, datasets and messages, and the same in DuckDB SQL.

A specification that has been through a file is held against SQL by what it then finds in a table. Files of
specifications are the driver's own; files of tables are in the folder that all machines share.
"""

from __future__ import annotations

import functools
import json
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright import queries as core
from tabwright.functions.columns import empty_to_null
from tabwright.operators.deliver import write_parts, write_table
from tabwright.operators.dataset import Agreement, ValidatedDataset, make_container
from tabwright.operators.positions import in_file_order
from tabwright.operators.rules import RuleViolation, check_rule, rule_results, validate_rules, violating_rows
from tabwright.operators.shared import scratch
from tabwright.operators.validate import validate
from tabwright.plans.schema import json_schema
from tabwright.sources.files import read_delimited, read_json, read_yaml, write_json, write_yaml, yaml_to_json
from tabwright.sources.word import read_docx_tables, read_spec_table, write_spec_table, write_value_table
from tabwright.spec import Rule, SpecCollection, SpecError

QUERIES: dict[str, core.Query] = {}
SQL: dict[str, str] = {}

_ERRORS = """
    SELECT p_partkey, 'p_name' AS "column", 'maxLength' AS keyword, p_name AS data FROM part WHERE length(p_name) > 9
    UNION ALL SELECT p_partkey, 'p_type', 'enum', p_type FROM part WHERE p_type NOT IN ('ECONOMY', 'STANDARD', 'SMALL')
    UNION ALL SELECT p_partkey, 'p_brand', 'pattern', p_brand FROM part WHERE NOT regexp_matches(p_brand, '^Brand#[0-9]$')
"""


def _query(name: str, sql: str) -> Callable[[core.Query], core.Query]:
    def add(f: core.Query) -> core.Query:
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _through(name: str, passed: Callable[[SpecCollection, Path], SpecCollection]) -> None:
    """The errors of ``part`` under a specification that was written and read again."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with tempfile.TemporaryDirectory(prefix="tabwright-spec-") as folder:
            spec = passed(core.PART_SPEC, Path(folder))
        return validate(_read(spark, sf_dir, "part"), spec, "p_partkey").errors.select("p_partkey", "column", "keyword", "data")

    QUERIES[name], SQL[name] = run, _ERRORS


def _yaml(spec: SpecCollection, at: Path) -> SpecCollection:
    write_yaml(spec, str(at / "spec.yaml"))
    return read_yaml(str(at / "spec.yaml"))


def _json(spec: SpecCollection, at: Path) -> SpecCollection:
    write_json(spec, str(at / "spec.json"), pretty=False)
    return read_json(str(at / "spec.json"))


def _yaml_to_json(spec: SpecCollection, at: Path) -> SpecCollection:
    write_yaml(spec, str(at / "spec.yaml"))
    yaml_to_json(str(at / "spec.yaml"), str(at / "spec.json"))
    return read_json(str(at / "spec.json"))


def _word(spec: SpecCollection, at: Path) -> SpecCollection:
    write_spec_table(spec, str(at / "spec.docx"))
    return read_spec_table(str(at / "spec.docx"))


_through("spec_through_yaml", _yaml)
_through("spec_through_json", _json)
_through("spec_yaml_to_json", _yaml_to_json)
_through("spec_through_word", _word)
_through("spec_through_lists", lambda spec, _: SpecCollection.from_dicts(**spec.to_dict()))


@_query("value_table_word", "SELECT p_type, count(*) AS n FROM part WHERE p_type IN ('ECONOMY', 'STANDARD', 'SMALL') GROUP BY p_type")
def value_table_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of ``part`` by the values that a Word table of allowed values lists."""
    with tempfile.TemporaryDirectory(prefix="tabwright-spec-") as folder:
        write_value_table(core.PART_SPEC, f"{folder}/values.docx", "p_type")
        title, *values = [row[0] for row in read_docx_tables(f"{folder}/values.docx")[0]]
    return _read(spark, sf_dir, "part").where(F.col(title).isin(values)).groupBy(title).agg(F.count(F.lit(1)).alias("n"))


_BROKEN = {
    ("o_orderstatus", "enum"): "o_orderstatus NOT IN ('F', 'O')",
    ("o_orderpriority", "maxLength"): "length(o_orderpriority) > 8",
    ("o_orderpriority", "pattern"): "NOT regexp_matches(o_orderpriority, '^[1-4]-')",
    ("p5", "type"): "o_orderpriority = '5-LOW'",
}


@_query(
    "json_schema_of_spec",
    """
    WITH s AS (SELECT * FROM (VALUES ('o_orderkey', 'type', '"integer"'), ('o_custkey', 'type', '"integer"'), ('o_orderstatus', 'type', '"string"'), ('o_orderstatus', 'maxLength', '1'), ('o_orderstatus', 'enum', '["F", "O"]'),
      ('o_totalprice', 'type', '"number"'), ('o_orderpriority', 'type', '"string"'), ('o_orderpriority', 'maxLength', '8'), ('o_orderpriority', 'pattern', '"^[1-4]-"'), ('p5', 'type', '"string"')) AS t("column", keyword, value)),
    """
    + "b AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{k}' AS keyword, count(*) AS n FROM orders WHERE {broken}" for (c, k), broken in _BROKEN.items())
    + ") SELECT s.*, coalesce(n, 0) AS n_broken FROM s LEFT JOIN b USING (\"column\", keyword)",
)
def json_schema_of_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each keyword of a specification's schema, and how many rows of ``orders`` break it."""
    schema = json_schema(core.ORDERS_SPEC)["items"]
    rows = [(c, k, json.dumps(v)) for c in schema["required"] for k, v in schema["properties"][c].items()]
    found = validate(core._orders(spark, sf_dir), core.ORDERS_SPEC, "o_orderkey").errors.groupBy("column", "keyword").agg(F.count(F.lit(1)).alias("n"))
    keywords = spark.createDataFrame(rows, "column string, keyword string, value string")
    return keywords.join(found, ["column", "keyword"], "left").select("column", "keyword", "value", F.coalesce("n", F.lit(0)).alias("n_broken"))


_DIRTY = "CASE WHEN o_orderkey % 11 = 0 THEN 'abc' WHEN o_orderkey % 19 = 0 THEN '12d' WHEN o_orderkey % 13 = 0 THEN '' ELSE o_custkey || '.5' END", "CASE WHEN o_orderkey % 7 = 0 THEN '2.5' WHEN o_orderkey % 17 = 0 THEN 'x' ELSE o_custkey || '' END"
_FLAG = "CASE WHEN o_orderkey % 5 = 0 THEN 'y' WHEN o_orderkey % 5 = 1 THEN 'TRUE' WHEN o_orderkey % 5 = 2 THEN '1' ELSE 'F' END"
_DIRTY_SPEC = SpecCollection.from_dicts(
    [{"id": "num", "type": "Num", "nullable": True}, {"id": "whole", "type": "Int", "nullable": True}, {"id": "flag", "type": "Bool", "nullable": False}],
    [{"id": "r", "type": "check_range", "column": "whole", "range": [10, 100]}],
)
_DIRTY_ROWS = f"(SELECT o_orderkey::VARCHAR AS o_orderkey, nullif({_DIRTY[0]}, '') AS num, {_DIRTY[1]} AS whole, {_FLAG} AS flag FROM orders)"
_BAD_NUM, _BAD_WHOLE, _BAD_FLAG = "coalesce(num IN ('abc', '12d'), false)", "whole IN ('2.5', 'x')", "flag IN ('y', '1')"
_OUT = f"(NOT {_BAD_WHOLE} AND try_cast(whole AS DOUBLE) NOT BETWEEN 10 AND 100)"


def _delimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` through a delimited file in which values of the wrong type are planted."""
    path = scratch(spark, "delimited")
    _read(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_DIRTY[0]} AS num", f"{_DIRTY[1]} AS whole", f"{_FLAG} AS flag").write.options(header=True, sep="\t").csv(path)
    return read_delimited(spark, path, _DIRTY_SPEC)


@_query(
    "delimited_bad_values",
    f"SELECT o_orderkey, 'num' AS \"column\", 'type' AS keyword, num AS data FROM {_DIRTY_ROWS} WHERE {_BAD_NUM} UNION ALL SELECT o_orderkey, 'whole', 'type', whole FROM {_DIRTY_ROWS} WHERE {_BAD_WHOLE} "
    f"UNION ALL SELECT o_orderkey, 'flag', 'type', flag FROM {_DIRTY_ROWS} WHERE {_BAD_FLAG}",
)
def delimited_bad_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that can't be read, in columns of which one has been through a projection."""
    rows = _delimited(spark, sf_dir).withColumn("num", F.trim("num"))
    return validate(rows, _DIRTY_SPEC, "o_orderkey").errors.select("o_orderkey", "column", "keyword", "data")


@_query("delimited_flagged", f"SELECT *, NOT ({_BAD_NUM} OR {_BAD_WHOLE} OR {_BAD_FLAG} OR {_OUT}) AS good FROM {_DIRTY_ROWS}")
def delimited_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows with their values as given, and whether they are sound."""
    return validate(_delimited(spark, sf_dir), _DIRTY_SPEC, "o_orderkey").flagged("good")


@_query("delimited_quarantine", f"SELECT * FROM {_DIRTY_ROWS} WHERE {_BAD_NUM} OR {_BAD_WHOLE} OR {_BAD_FLAG} OR {_OUT}")
def delimited_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate(_delimited(spark, sf_dir), _DIRTY_SPEC, "o_orderkey").split()[1]


@_query("delimited_violating_rows", f"SELECT * FROM {_DIRTY_ROWS} WHERE {_OUT}")
def delimited_violating_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that break the range, values that can't be read in other columns staying as they are."""
    return violating_rows(empty_to_null(_delimited(spark, sf_dir)), _DIRTY_SPEC.rules[0])


@_query(
    "delimited_guessed_types",
    f"""
    WITH n AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS i FROM {_DIRTY_ROWS})
    SELECT "column", count(v) AS n FROM (SELECT unnest(['num', 'whole', 'flag']) AS "column", unnest([num, whole, flag]) AS v FROM n WHERE i <= 5000) GROUP BY 1
    """,
)
def delimited_guessed_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As where types are guessed from all values: one bad value makes every value of its column an error; those of the
    first 5,000 rows in the order of the key."""
    df = validate(_delimited(spark, sf_dir), _DIRTY_SPEC, "o_orderkey", compat="reference")
    return df.errors.groupBy("column").agg(F.count(F.lit(1)).alias("n"))


@_query("delimited_rule", f"SELECT 'r' AS rule_id, n = 0 AS valid, n AS n_violations FROM (SELECT count(*) FILTER (WHERE {_OUT}) AS n FROM {_DIRTY_ROWS})")
def delimited_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate(_delimited(spark, sf_dir), _DIRTY_SPEC, "o_orderkey").rule_results().select("rule_id", "valid", "n_violations")


_CUSTOMER = "concat_ws(chr(9), c_custkey::VARCHAR, c_name, c_nationkey::VARCHAR, CASE WHEN c_acctbal = floor(c_acctbal) THEN c_acctbal::BIGINT::VARCHAR ELSE c_acctbal::VARCHAR END, c_mktsegment)"
_TITLE = "'c_custkey' || chr(9) || 'c_name' || chr(9) || 'c_nationkey' || chr(9) || 'c_acctbal' || chr(9) || 'c_mktsegment'"


def _file_lines(spark: SparkSession, path: str) -> DataFrame:
    """(row, line) of one file, the header being row 0; read by splits, a gzip file in one go."""
    rows = in_file_order(spark.read.text(path, lineSep="\n"), "row")
    return rows.where("value <> ''").select((F.col("row") - 1).alias("row"), F.col("value").alias("line"))


def _delivery(name: str, order: str, **settings) -> None:
    """The lines of a delivered file of ``customer``, with their places."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = scratch(spark, "delivered") + (".gz" if settings.get("compression") == "gzip" else "")
        return _file_lines(spark, write_table(_read(spark, sf_dir, "customer"), path, **settings).path)

    QUERIES[name] = run
    SQL[name] = f"SELECT 0::BIGINT AS \"row\", {_TITLE} AS line UNION ALL SELECT row_number() OVER (ORDER BY {order}), {_CUSTOMER} FROM customer"


_delivery("delivery_sorted", "c_custkey")
_delivery("delivery_gzip", "c_custkey", compression="gzip")
_delivery("delivery_by_columns", "c_mktsegment, c_acctbal, c_custkey", arrange_by=["c_mktsegment", "c_acctbal", "c_custkey"])
_delivery("delivery_descending", "c_mktsegment DESC, c_custkey DESC", arrange_by=["c_mktsegment", "c_custkey"], descending=True)


@_query("delivery_unsorted", f"SELECT {_CUSTOMER} AS line FROM customer")
def delivery_unsorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _file_lines(spark, write_table(_read(spark, sf_dir, "customer"), scratch(spark, "delivered"), arrange_by=None).path).where("row > 0").select("line")


@_query(
    "delivery_checksum",
    f"""
    SELECT unnest(['md5sum: ' || md5({_TITLE} || chr(10) || string_agg(line, chr(10) ORDER BY c_custkey) || chr(10)), 'Number of Columns: 5', 'Number of Rows: ' || count(*)]) AS line
    FROM (SELECT c_custkey, {_CUSTOMER} AS line FROM customer)
    """,
)
def delivery_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file beside a delivered one: its checksum and size."""
    done = write_table(_read(spark, sf_dir, "customer"), scratch(spark, "delivered"))
    return _file_lines(spark, f"{done.path}.metadata").select("line")


_DOCUMENT = "doc_id::VARCHAR || chr(9) || replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't') || chr(9) || lang || chr(9) || source || chr(9) || n_chars"


@_query(
    "delivery_parts",
    f"""
    WITH l AS (SELECT doc_id, {_DOCUMENT} AS line FROM documents), s AS (SELECT count(*) AS n_rows, (sum(octet_length(encode(line)) + 1))::BIGINT AS n_bytes FROM l)
    SELECT row_number() OVER (ORDER BY doc_id) AS place, line, n_rows, n_bytes, 5 AS n_cols FROM l, s
    """,
)
def delivery_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents``, whose texts hold line breaks, delivered in sorted parts: every line with its place, and rows, bytes
    (without headers) and columns by the manifest."""
    manifest = write_parts(_read(spark, sf_dir, "documents"), scratch(spark, "parts"), part_bytes=1 << 18)
    title = "doc_id\ttext\tlang\tsource\tn_chars"
    said = manifest.agg(F.sum("n_rows").alias("n_rows"), (F.sum("n_bytes") - F.count(F.lit(1)) * (len(title) + 1)).alias("n_bytes"), F.max("n_cols").alias("n_cols"))
    folder = manifest.select(F.regexp_replace("path", r"/part-[^/]*$", "").alias("at")).first()[0]
    rows = in_file_order(spark.read.text(folder).select(F.col("value").alias("line"), F.col("_metadata.file_name").alias("file")), "place")
    heads = manifest.select(F.regexp_extract("path", r"[^/]*$", 0).alias("file"), (F.col("part") + 1).alias("nth"))  # each part's header is a line
    placed = rows.where(F.col("line") != title).join(heads, "file")
    n_rows, n_bytes, n_cols = said.first()
    return placed.select((F.col("place") - F.col("nth")).alias("place"), "line", F.lit(n_rows).alias("n_rows"), F.lit(n_bytes).alias("n_bytes"), F.lit(n_cols).alias("n_cols"))


_VALUE = "(CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice * 1000000 / 7 WHEN o_orderkey % 5 = 1 THEN o_totalprice / 1e12 WHEN o_orderkey % 5 = 2 THEN (o_orderkey * 100000)::DOUBLE WHEN o_orderkey % 5 = 3 THEN -o_totalprice ELSE o_totalprice * 1e18 END)"


@_query(
    "delivery_numbers",
    rf"""
    WITH v AS (SELECT o_orderkey, {_VALUE} AS v FROM orders), f AS (SELECT *, printf('%.14e', abs(v)) AS t FROM v),
    p AS (SELECT *, rtrim(t[1:1] || t[3:16], '0') AS digits, t[18:]::INT AS e FROM f),
    x AS (SELECT *, CASE WHEN e < 0 THEN '0.' || repeat('0', -e - 1) || digits WHEN length(digits) > e + 1 THEN digits[1:e + 1] || '.' || digits[e + 2:] ELSE rpad(digits, e + 1, '0') END AS plain,
      digits[1:1] || CASE WHEN length(digits) > 1 THEN '.' || digits[2:] ELSE '' END || t[17:] AS short FROM p)
    SELECT o_orderkey || chr(9) || CASE WHEN v < 0 THEN '-' ELSE '' END || CASE WHEN length(plain) <= length(short) THEN plain ELSE short END AS line FROM x
    """,
)
def delivery_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with numbers of all sizes, at most 15 significant digits."""
    rows = _read(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_VALUE.replace('::DOUBLE', '').replace('(o_orderkey * 100000)', 'double(o_orderkey * 100000)').replace('1e12', '1e12D').replace('1e18', '1e18D')} AS v")
    return _file_lines(spark, write_table(rows, scratch(spark, "delivered"), arrange_by=None).path).where("row > 0").select("line")


@_query(
    "rule_messages",
    """
    WITH c AS (SELECT count(*) FILTER (WHERE NOT (l_quantity BETWEEN 5 AND 45)) AS a, count(*) FILTER (WHERE NOT (l_discount BETWEEN 0 AND 0.08::DOUBLE)) AS b,
      count(*) FILTER (WHERE l_returnflag = 'R' AND l_linestatus <> 'F') AS c, count(*) FILTER (WHERE l_linestatus = 'O' AND NOT (l_tax > 0.01::DOUBLE)) AS d FROM lineitem),
    u AS (SELECT sum(k - 1)::BIGINT AS e FROM (SELECT count(*) AS k FROM lineitem GROUP BY l_orderkey, l_linenumber))
    SELECT 'quantity' AS rule_id, 'Rule ''quantity'' violated: ' || a || ' rows where l_quantity not in range [5, 45]' AS message FROM c WHERE a > 0
    UNION ALL SELECT 'discount', 'Rule ''discount'' violated: ' || b || ' rows where l_discount not in range [0, 0.08]' FROM c WHERE b > 0
    UNION ALL SELECT 'returned', 'Rule ''returned'' violated: ' || c || ' rows failed the then conditions' FROM c WHERE c > 0
    UNION ALL SELECT 'taxed', 'Rule ''taxed'' violated: ' || d || ' rows failed the then conditions' FROM c WHERE d > 0
    UNION ALL SELECT 'line', 'Rule ''line'' violated: ' || e || ' duplicate values found in column l_orderkey, l_linenumber' FROM u WHERE e > 0
    """,
)
def rule_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the failed rules say."""
    try:
        failed = [] if validate_rules(_read(spark, sf_dir, "lineitem"), core.LINEITEM_RULES) else []
    except RuleViolation as e:
        failed = e.results
    return spark.createDataFrame([(r.id, r.message) for r in failed], "rule_id string, message string")


@_query(
    "spec_refusals",
    """
    SELECT given, refused, CASE WHEN NOT refused THEN (SELECT (count(*) - count(DISTINCT p_size))::BIGINT FROM part) ELSE -1 END AS n_violations
    FROM (VALUES ('rule of no kind', true), ('unsupported condition', true), ('not a rule', true), ('range turned round', true), ('pattern that Java refuses', true), ('column that the table lacks', true), ('sound rule', false)) AS t(given, refused)
    """,
)
def spec_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of these are refused, and how many rows of ``part`` those break that aren't (-1: none was looked at)."""
    part, sound = _read(spark, sf_dir, "part"), {"id": "x", "type": "check_unique", "column": "p_size"}
    given: dict[str, Callable[[], Rule]] = {
        "rule of no kind": lambda: Rule.from_dict({**sound, "type": "check_what"}),
        "unsupported condition": lambda: Rule.from_dict({"id": "x", "type": "check_condition", "condition": {"p_size": {"like": "b"}}, "then": {"p_size": {"equals": 1}}}),
        "not a rule": lambda: check_rule(sound),
        "range turned round": lambda: Rule.from_dict({"id": "x", "type": "check_range", "column": "p_size", "range": [2, 1]}),
        "pattern that Java refuses": lambda: SpecCollection.from_dicts([{"id": "p_name", "pattern": "(?P<x>a)"}], [sound]).rules[0],
        "column that the table lacks": lambda: Rule.from_dict({**sound, "column": "p_color"}),
        "sound rule": lambda: check_rule(Rule.from_dict(sound)),
    }

    def tried(name: str, make: Callable[[], Rule]) -> DataFrame:
        said = F.lit(name).alias("given")
        try:
            found = rule_results(part, [make()])
        except SpecError:
            return spark.range(1).select(said, F.lit(True).alias("refused"), F.lit(-1).cast("long").alias("n_violations"))
        return found.select(said, F.lit(False).alias("refused"), "n_violations")

    return functools.reduce(DataFrame.unionByName, [tried(name, make) for name, make in given.items()])


def _container(spark: SparkSession, sf_dir: str) -> ValidatedDataset:
    orders = _read(spark, sf_dir, "orders").withColumn("p5", F.expr("if(o_orderpriority = '5-LOW', '', o_orderpriority)"))
    return make_container(core.ORDERS_SPEC, {"all": orders, "open": orders.where("o_orderstatus = 'O'")}, "o_orderkey")


@_query(
    "container_tables",
    """
    SELECT 'all' AS label, 1 AS position, count(*) AS n, count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS blank FROM orders
    UNION ALL SELECT 'open', 2, count(*), count(*) FILTER (WHERE o_orderpriority = '5-LOW') FROM orders WHERE o_orderstatus = 'O'
    """,
)
def container_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables of a container by name and by position, "" being null."""
    made = _container(spark, sf_dir)
    by_name = [made.table(x).select(F.lit(x).alias("label"), "o_orderkey", "p5") for x in made.labels]
    by_place = [made.table(k).select(F.lit(k).alias("position"), "o_orderkey") for k in range(1, len(made.labels) + 1)]
    rows = by_name[0].join(by_place[0], "o_orderkey").unionByName(by_name[1].join(by_place[1], "o_orderkey"))
    return rows.groupBy("label", "position").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p5").isNull()).alias("blank"))


@_query(
    "container_errors",
    """
    SELECT label, c AS "column", count(*) AS n FROM (SELECT 'all' AS label, * FROM orders UNION ALL SELECT 'open', * FROM orders WHERE o_orderstatus = 'O') AS t,
      LATERAL (SELECT unnest(list_filter([CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'o_orderstatus' END, CASE WHEN length(o_orderpriority) > 8 THEN 'o_orderpriority' END,
        CASE WHEN NOT regexp_matches(o_orderpriority, '^[1-4]-') THEN 'o_orderpriority' END, CASE WHEN o_orderpriority = '5-LOW' THEN 'p5' END], lambda x: x IS NOT NULL)) AS c) GROUP BY ALL
    """,
)
def container_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of all tables of a container, reached through an agreement that names it."""
    deal = Agreement({"orders": _container(spark, sf_dir)}, [{"version": "3", "author": "x"}])
    held = deal.get("orders")["orders"]
    parts = [held.result(x).errors.select(F.lit(x).alias("label"), "column") for x in held.labels]
    return parts[0].union(parts[1]).groupBy("label", "column").agg(F.count(F.lit(1)).alias("n"))


@_query(
    "accessors",
    """
    SELECT * FROM (VALUES ('column ids', 'o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, p5'), ('column of the spec', 'Char 1.0 F|O'), ('column of the container', 'Num'), ('no such column', 'None'),
      ('metadata', '1.0 example'), ('rules', 'price check_range, key check_unique, urgent check_condition'), ('labels', 'all, open'), ('agreement', 'orders 3 x'), ('containers', 'orders'), ('missing container', 'KeyError'),
      ('missing table', 'KeyError'), ('table out of bounds', 'IndexError'), ('scan types', 'bigint bigint string double string string')) AS t(what, got)
    UNION ALL SELECT 'rows of all', count(*)::VARCHAR FROM orders UNION ALL SELECT 'rows of open', count(*)::VARCHAR FROM orders WHERE o_orderstatus = 'O'
    """,
)
def accessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What specifications, containers and agreements say about themselves."""
    held, spec = _container(spark, sf_dir), core.ORDERS_SPEC
    deal = Agreement({"orders": held}, [{"version": "3", "author": "x"}])

    def raised(f: Callable[[], object]) -> str:
        try:
            f()
        except Exception as e:
            return type(e).__name__
        return "nothing"

    status = spec["o_orderstatus"]
    rows = {
        "column ids": ", ".join(spec.column_ids),
        "column of the spec": f"{status.type} {float(status.length)} {'|'.join(status.values)}",
        "column of the container": held.column("o_totalprice").type,
        "no such column": str(held.column("nope")),
        "metadata": f"{held.metadata.version} {held.metadata.author}",
        "rules": ", ".join(f"{r.id} {r.type}" for r in held.rules),
        "labels": ", ".join(held.labels),
        "agreement": f"{', '.join(deal.containers)} {deal.metadata.version} {deal.metadata.author}",
        "containers": ", ".join(deal.get()),
        "missing container": raised(lambda: deal.get("b")),
        "missing table": raised(lambda: held.table("b")),
        "table out of bounds": raised(lambda: held.table(3)),
        "scan types": " ".join(f.dataType.simpleString() for f in spec.struct_type),
    }
    said = spark.createDataFrame(list(rows.items()), "what string, got string")
    counted = [held.table(x).agg(F.concat(F.lit("rows of "), F.lit(x)).alias("what"), F.count(F.lit(1)).cast("string").alias("got")) for x in deal.get("orders")["orders"].labels]
    return functools.reduce(DataFrame.unionByName, counted, said)
