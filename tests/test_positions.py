"""Numbers of rows against DuckDB's over the same files, and by sort keys of all kinds."""

import random

import duckdb
import pytest

from tabwright.operators.positions import in_file_order, numbered_by
from tabwright.operators.validate import validate
from tabwright.sources.files import read_delimited
from tabwright.spec import SpecCollection


@pytest.fixture
def many_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_file_order(spark, tmp_path, many_splits):
    rng = random.Random(1)
    for name, n in (("b.tsv", 4000), ("a.tsv", 900), ("c.tsv", 0), ("d.tsv", 1)):
        lines = ["id\ttext", *(f"{name}{k}\t{'x' * rng.randrange(60)}" for k in range(n))]
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    df = read_delimited(spark, str(tmp_path), SpecCollection.from_dicts([{"id": "id"}]), row="row")
    assert spark.read.csv(str(tmp_path)).rdd.getNumPartitions() > 20
    got = {r.id: r.row for r in df.collect()}
    want = duckdb.sql(f"SELECT id, row_number() OVER () FROM (SELECT * FROM read_csv(['{tmp_path}/a.tsv', '{tmp_path}/b.tsv', '{tmp_path}/d.tsv'], delim = '\t', header = true, all_varchar = true))").fetchall()
    assert got == dict(want) and len(got) == 4901
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan.split("BroadcastExchange")[0]


def test_file_order_of_parquet(spark, tmp_path):
    spark.range(0, 1000, 1, 4).write.parquet(str(tmp_path / "p"))
    assert in_file_order(spark.read.parquet(str(tmp_path / "p")), "n").where("n <> id + 1").count() == 0
    assert in_file_order(spark.read.parquet(str(tmp_path / "p")).where("false"), "n").count() == 0


def test_numbered_by(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, "", "a", "b", "hot"]), rng.choice([None, 1, 2]), k % 7) for k in range(3000)] + [("hot", 2, 0)] * 3000
    df = spark.createDataFrame(rows, "s string, n int, column int").repartition(4)
    place = lambda v: (v is None, v if v is not None else 0)
    for order, at in ((["s"], [0]), (["s", "n"], [0, 1]), (["n", "column", "s"], [1, 2, 0])):
        got = numbered_by(df, order, "row", parts=9).orderBy("row").collect()
        assert [r.row for r in got] == list(range(1, 6001))
        keys = [[(x is None, x if x is not None else ("" if i == 0 else 0)) for i, x in ((i, r[i]) for i in at)] for r in got]
        assert keys == sorted(keys) and sorted(map(str, (tuple(r)[:3] for r in got))) == sorted(map(str, rows))
    back = numbered_by(df, ["n"], "row", descending=True).where("row = 1").first()
    assert back.n == 2 and place(back.s)
    assert numbered_by(df.where("false"), ["s"]).count() == 0


def test_a_hot_key_is_spread(spark):
    df = spark.range(20000).selectExpr("'one' AS s", "1 AS n")
    rows = numbered_by(df, ["s"], parts=8)
    assert rows.agg({"row": "max"}).first()[0] == 20000 and rows.select("row").distinct().count() == 20000
    sizes = [r["count"] for r in rows.groupBy((rows.row / 2500).cast("int").alias("k")).count().collect()]
    assert len(sizes) >= 8
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan.split("BroadcastExchange")[0]


def test_first_chunk_by_place(spark):
    spec = SpecCollection.from_dicts([{"id": "s", "nullable": False, "values": ["a", "b"]}])
    far = spark.createDataFrame([("S-1", "x", 10), ("S-2", "y", 90000)], "k string, s string, n int")
    assert sorted(r.k for r in validate(far, spec, "k", compat="reference").errors.collect()) == ["S-1", "S-2"]
    assert sorted(r.n for r in validate(far, spec, "n", compat="reference").errors.collect()) == [10, 90000]
    assert validate(far, spec, ["k", "n"], compat="reference").summary.count() == 2
    assert validate(far.where("false"), spec, "k", compat="reference").errors.count() == 0
    many = spark.range(1, 12001).selectExpr("concat('k', lpad(id * 3, 9, '0')) AS k", "id AS line", "if(id in (5001, 9999, 10001), 'x', 'a') AS s")
    assert sorted(r.k for r in validate(many, spec, "k", compat="reference").errors.collect()) == ["k000015003", "k000029997"]
    by_line = validate(many, spec, "k", compat="reference", row="line")
    assert sorted((r.k, r.line) for r in by_line.errors.collect()) == [("k000015003", 5001), ("k000029997", 9999)]
    assert [(r.first_row_affected, r.last_row_affected) for r in by_line.summary.collect()] == [(5001, 9999)]


def test_keys_called_as_columns_of_errors(spark):
    df = spark.createDataFrame([(1, "x", "p"), (2, "a", "q")], "column int, s string, message string")
    spec = SpecCollection.from_dicts([{"id": "s", "nullable": False, "values": ["a", "b"]}])
    result = validate(df, spec, ["column", "message"])
    assert [(r.column_key, r.message_key, r.column) for r in result.errors.collect()] == [(1, "p", "s")]
    assert [tuple(r.first_row_affected) for r in result.summary.collect()] == [(1, "p")]
    assert [r.first_row_affected for r in validate(df, spec, "column").summary.collect()] == [1]
