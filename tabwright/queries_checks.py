"""Queries on positions of rows, nested values, streams, deliveries and rules over time, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright import queries as core
from tabwright.operators.difference import difference
from tabwright.operators.over_time import as_of, outside_limits, overlapping
from tabwright.operators.positions import numbered_by
from tabwright.operators.shared import scratch, written
from tabwright.operators.sketches import duplicates, merged, sketch
from tabwright.operators.validate import error_rollup, validate
from tabwright.plans.nested import nested_errors
from tabwright.sources.files import read_delimited
from tabwright.spec import Rule, SpecCollection
from tabwright.streaming.unique import stream_duplicates
from tabwright.streaming.windows import stream_summary, window_summary

QUERIES: dict[str, core.Query] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str) -> Callable[[core.Query], core.Query]:
    def add(f: core.Query) -> core.Query:
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _in_files(spark: SparkSession, sf_dir: str) -> str:
    """``orders`` in the order of dates and keys, in delimited files whose names are in that order too."""
    path = scratch(spark, "delimited")
    _read(spark, sf_dir, "orders").orderBy("o_orderdate", "o_orderkey").write.options(header=True, sep="\t").csv(path)
    return path


@_query("file_row_numbers", 'SELECT o_orderkey::VARCHAR AS o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS "row" FROM orders')
def file_row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of delimited files, numbered in the order of the files."""
    return read_delimited(spark, _in_files(spark, sf_dir), row="row").select("o_orderkey", "row")


@_query(
    "file_first_chunk",
    """
    WITH n AS (SELECT o_orderkey, o_orderpriority, o_totalprice, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS "row" FROM orders),
    e AS (SELECT *, ceil("row" / 5000) AS chunk FROM n WHERE o_totalprice > 400000)
    SELECT min("row") AS first_row_affected, max("row") AS last_row_affected, count(*) AS n_rows_affected, o_orderpriority AS data FROM e WHERE chunk = (SELECT min(chunk) FROM e) GROUP BY o_orderpriority
    """,
)
def file_first_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of the first 5,000 lines that have any, grouped with their first and last line."""
    rows = read_delimited(spark, _in_files(spark, sf_dir), row="row")
    rows = rows.select("o_orderkey", F.when(F.col("o_totalprice").cast("double") > 400000, F.col("o_orderpriority")).otherwise("low").alias("p"), "row")
    spec = SpecCollection.from_dicts([{"id": "p", "nullable": False, "values": ["low", "x"]}])
    return validate(rows, spec, "o_orderkey", compat="reference", row="row").summary.select("first_row_affected", "last_row_affected", "n_rows_affected", "data")


@_query("numbered_by_columns", 'SELECT l_shipdate, l_returnflag, l_status, row_number() OVER (ORDER BY l_shipdate, l_returnflag, l_status) AS "row" FROM (SELECT l_shipdate, l_returnflag, l_linestatus AS l_status FROM lineitem)')
def numbered_by_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` numbered by a date and two texts that very many rows share."""
    rows = _read(spark, sf_dir, "lineitem").select("l_shipdate", "l_returnflag", F.col("l_linestatus").alias("l_status"))
    return numbered_by(rows, ["l_shipdate", "l_returnflag", "l_status"])


@_query(
    "nested_embeddings",
    """
    WITH v AS (SELECT vec_id, embedding, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings)
    SELECT vec_id, '/' || i AS path, 'minimum' AS keyword FROM v WHERE x < (-0.3)::FLOAT UNION ALL SELECT vec_id, '/' || i, 'maximum' FROM v WHERE x > 0.3::FLOAT
    UNION ALL SELECT vec_id, '', 'maxItems' FROM embeddings WHERE len(embedding) > 63 AND vec_id % 10 = 0
    """,
)
def nested_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of vectors outside a range, by their places, and vectors that are too long."""
    vectors = _read(spark, sf_dir, "embeddings").withColumn("short", F.when(F.col("vec_id") % 10 == 0, F.col("embedding")).otherwise(F.slice("embedding", 1, 63)))
    bound = {"items": {"type": "Num", "minimum": -0.30000001192092896, "maximum": 0.30000001192092896}}
    found = nested_errors(vectors, {"embedding": bound, "short": {"items": {"type": "Num"}, "min_items": 1, "max_items": 63}}, "vec_id")
    return found.select("vec_id", "path", "keyword")


@_query(
    "nested_conversations",
    """
    WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations)
    SELECT conv_id, '/' || i || '/role' AS path, 'enum' AS keyword, role AS data FROM t WHERE role NOT IN ('user', 'assistant')
    UNION ALL SELECT conv_id, '/' || i || '/text', 'maxLength', text FROM t WHERE length(text) > 800
    UNION ALL SELECT conv_id, '', 'minItems', count(*)::VARCHAR FROM t GROUP BY conv_id HAVING count(*) < 3
    UNION ALL SELECT conv_id, '/' || i || '/size/' || role, 'maximum', length(text)::VARCHAR FROM t WHERE length(text) > 1000
    """,
)
def nested_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as arrays of turns with a map in each: roles, lengths of texts, how many turns."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    sized = F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), F.create_map(t["role"], F.length(t["text"])).alias("size")))
    rows = _read(spark, sf_dir, "conversations").groupBy("conv_id").agg(sized.alias("turns"))
    fields = {"role": {"values": ["user", "assistant"]}, "text": {"length": 800, "nullable": True}, "size": {"values": {"type": "Int", "maximum": 1000}}}
    return nested_errors(rows, {"turns": {"items": {"fields": fields}, "min_items": 3}}, "conv_id").select("conv_id", "path", "keyword", "data")


def _fed(spark: SparkSession, sf_dir: str) -> str:
    """``events`` in three files, one after the other: the first half, the second half, and what came late of the first."""
    events, path = _read(spark, sf_dir, "events"), scratch(spark, "fed")
    half = events.agg(F.floor(F.max("event_id") / 2)).first()[0]
    late = (F.col("event_id") % 50 == 0) & (F.col("event_id") <= half)
    for k, rows in enumerate((events.where((F.col("event_id") <= half) & ~late), events.where(F.col("event_id") > half), events.where(late))):
        rows.coalesce(1).write.parquet(f"{path}/{k}")
    return path


def _streamed(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(spark.read.parquet(f"{path}/0").schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


@_query("stream_duplicates", "SELECT event_id, 'once' AS rule_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events) WHERE k > 1")
def stream_duplicate_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose user and type an earlier one has, found by state over micro-batches."""
    path = _fed(spark, sf_dir)
    found = stream_duplicates(_streamed(spark, path), Rule("once", "check_unique", column=("user_id", "event_type")), ["event_id"], salts=4)
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(min(8, int(parts))))  # each partition of state has a worker of its own, as dear for few rows as for many
    try:
        query = found.writeStream.format("parquet").option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start(f"{path}-out")
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    return spark.read.schema("event_id long, rule_id string").parquet(f"{path}-out")


_EVENT_WINDOWS = """
    WITH e AS (SELECT *, (event_id % 50 = 0 AND event_id <= (SELECT max(event_id) // 2 FROM events)) AS sent_late FROM events),
    w AS (SELECT event_id, event_type, value, time_bucket(INTERVAL '1 day', ts) AS start, sent_late AND time_bucket(INTERVAL '1 day', ts) + INTERVAL '1 day' <= (SELECT max(ts) FROM e WHERE NOT sent_late) - INTERVAL '2 days' AS late FROM e),
    x AS (SELECT event_id, start, late, 'event_type' AS "column", 'enum' AS keyword FROM w WHERE event_type NOT IN ('click', 'view', 'purchase'))
"""


@_query(
    "stream_window_summary",
    _EVENT_WINDOWS + """SELECT strftime(start, '%Y-%m-%d') AS start, "column", keyword, late, count(*) AS n, min(event_id) AS first_key, max(event_id) AS last_key FROM x GROUP BY ALL""",
)
def stream_window_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of ``events`` by day of event time, those that came after the watermark apart."""
    path = _fed(spark, sf_dir)
    spec = SpecCollection.from_dicts([{"id": "event_type", "nullable": False, "values": ["click", "view", "purchase"]}])
    stream_summary(_streamed(spark, path), spec, "event_id", "ts", "1 day", "2 days", f"{path}-summary").trigger(availableNow=True).start().awaitTermination()
    return window_summary(spark, f"{path}-summary").select(F.date_format("start", "yyyy-MM-dd").alias("start"), "column", "keyword", "late", "n", "first_key", "last_key")


@_query(
    "error_rollup",
    """
    WITH e AS (SELECT p_partkey, 'p_name' AS c, 'maxLength' AS keyword FROM part WHERE length(p_name) > 9 UNION ALL SELECT p_partkey, 'p_type', 'enum' FROM part WHERE p_type NOT IN ('ECONOMY', 'STANDARD', 'SMALL')
      UNION ALL SELECT p_partkey, 'p_brand', 'pattern' FROM part WHERE NOT regexp_matches(p_brand, '^Brand#[0-9]$'))
    SELECT CASE grouping(c, keyword) WHEN 0 THEN 'both' WHEN 1 THEN 'column' WHEN 2 THEN 'keyword' ELSE 'all' END AS level, c AS "column", keyword, count(*)::BIGINT AS n, min(p_partkey) AS first_row_affected, max(p_partkey) AS last_row_affected
    FROM e GROUP BY GROUPING SETS ((c, keyword), (c), (keyword), ())
    """,
)
def part_error_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return error_rollup(validate(_read(spark, sf_dir, "part"), core.PART_SPEC, "p_partkey").errors, "p_partkey")


@_query(
    "rule_as_of",
    """
    SELECT e.event_id, v.value AS last_view FROM events e ASOF JOIN (SELECT * FROM events WHERE event_type = 'view') v ON e.user_id = v.user_id AND e.ts > v.ts
    WHERE e.event_type = 'purchase' AND e.value > v.value
    """,
)
def rule_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases of more than the value that the user last viewed before."""
    events = _read(spark, sf_dir, "events")
    views = events.where("event_type = 'view'")
    rows = as_of(events.where("event_type = 'purchase'"), views, ["user_id"], "ts", {"value": "last_view"}, chunk_rows=1000)
    return rows.where("value > last_view").select("event_id", "last_view")


@_query(
    "rule_no_overlap",
    """
    WITH i AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_shipdate AS s, l_shipdate + to_days(l_quantity::INT) AS e FROM lineitem),
    m AS (SELECT *, max(e) OVER (PARTITION BY l_suppkey ORDER BY s, l_orderkey, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM i)
    SELECT l_orderkey, l_linenumber FROM m WHERE before > s
    """,
)
def rule_no_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a supplier that are shipped before the deliveries that began earlier are over."""
    rows = _read(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate AS s", "l_shipdate + make_dt_interval(int(l_quantity)) AS e")
    return overlapping(rows, ["l_suppkey"], "s", "e", ["l_orderkey", "l_linenumber"], chunk_rows=2000).select("l_orderkey", "l_linenumber")


@_query(
    "rule_limits",
    """
    WITH b AS (SELECT p_partkey AS l_partkey, p_size % 10 AS low, 30 + p_size % 20 AS high, TIMESTAMP '1992-01-01' + to_days((p_partkey % 700)::INT) AS s, TIMESTAMP '1992-01-01' + to_days((p_partkey % 700 + p_size * p_size)::INT) AS e FROM part
      UNION ALL SELECT p_partkey, 3, 48, TIMESTAMP '1994-01-01', TIMESTAMP '2000-01-01' FROM part WHERE p_partkey % 3 = 0)
    SELECT l_orderkey, l_linenumber, low::BIGINT AS limit_low, high::BIGINT AS limit_high FROM lineitem JOIN b USING (l_partkey) WHERE l_shipdate >= s AND l_shipdate < e AND (l_quantity < low OR l_quantity > high)
    """,
)
def rule_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose quantity is outside the limits that their part has at the time."""
    part = _read(spark, sf_dir, "part")
    day = "timestamp_ntz '1992-01-01' + make_dt_interval(int({}))"
    limits = part.selectExpr("p_partkey AS l_partkey", f"{day.format('p_partkey % 700')} AS begin", f"{day.format('p_partkey % 700 + p_size * p_size')} AS end", "bigint(p_size % 10) AS low", "bigint(30 + p_size % 20) AS high")
    limits = limits.unionByName(part.where("p_partkey % 3 = 0").selectExpr("p_partkey AS l_partkey", "timestamp_ntz '1994-01-01' AS begin", "timestamp_ntz '2000-01-01' AS end", "3L AS low", "48L AS high"))
    return outside_limits(_read(spark, sf_dir, "lineitem"), limits, ["l_partkey"], "l_shipdate", "l_quantity").select("l_orderkey", "l_linenumber", "limit_low", "limit_high")


_OLD = "SELECT c_custkey AS k, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 17 <> 0"
_NEW = "SELECT c_custkey AS k, c_name, CASE WHEN c_custkey % 10 = 0 THEN c_nationkey + 1 ELSE c_nationkey END AS c_nationkey, CASE WHEN c_custkey % 15 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 13 <> 0"


@_query(
    "delivery_difference",
    f"""
    WITH o AS ({_OLD}), n AS ({_NEW} UNION ALL {_NEW} AND c_custkey % 29 = 0), oc AS (SELECT k, count(*) AS c, any_value(c_nationkey) AS x, any_value(c_acctbal) AS y FROM o GROUP BY k), nc AS (SELECT k, count(*) AS c, any_value(c_nationkey) AS x, any_value(c_acctbal) AS y FROM n GROUP BY k),
    j AS (SELECT coalesce(oc.k, nc.k) AS k, coalesce(oc.c, 0) AS n_old, coalesce(nc.c, 0) AS n_new, oc.x IS DISTINCT FROM nc.x AS dx, oc.y IS DISTINCT FROM nc.y AS dy FROM oc FULL JOIN nc ON oc.k = nc.k)
    SELECT k, CASE WHEN n_old = 0 THEN 'added' WHEN n_new = 0 THEN 'gone' ELSE 'changed' END AS change, n_old, n_new, CASE WHEN n_old = 1 AND n_new = 1 THEN concat_ws(',', CASE WHEN dx THEN 'c_nationkey' END, CASE WHEN dy THEN 'c_acctbal' END) ELSE '-' END AS columns
    FROM j WHERE n_old <> n_new OR dx OR dy
    """,
)
def delivery_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of ``customer``: rows added, gone, changed, and given twice."""
    customer = _read(spark, sf_dir, "customer")
    customer.createOrReplaceTempView("customer_delivered")
    old, new = (spark.sql(x.replace("FROM customer", "FROM customer_delivered")) for x in (_OLD, f"{_NEW} UNION ALL {_NEW} AND c_custkey % 29 = 0"))
    found = difference(old, new, "k")
    return found.select("k", "change", "n_old", "n_new", F.coalesce(F.array_join("columns", ","), F.lit("-")).alias("columns"))


@_query("duplicates_by_sketches", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents) WHERE k > 1")
def duplicates_by_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated texts over three deliveries, whose sketches are stored, read and merged; the exact pass sees suspects only."""
    docs, rule = _read(spark, sf_dir, "documents").select("doc_id", "text"), Rule("u", "check_unique", column=("text",))
    parts = [docs.where(F.col("doc_id") % 3 == k) for k in range(3)]
    stored = [written(sketch(p, rule, 24), "sketch") for p in parts]
    return duplicates(parts, rule, written(merged(stored), "sketch"), ["doc_id"], 24).select("doc_id")
