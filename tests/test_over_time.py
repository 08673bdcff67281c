"""Rules over time, limits of another table, differences of deliveries: against plain loops."""

import random
from datetime import date

import pytest

from tabwright.operators.difference import difference
from tabwright.operators.over_time import as_of, outside_limits, overlapping
from tabwright.operators.validate import error_rollup, validate
from tabwright.spec import SpecCollection, SpecError


def rows_of(df):
    return sorted(map(str, map(tuple, df.collect())))


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(3)
    subjects = ["hot"] * 5 + ["a", "b", None]
    rows = [(k, rng.choice(subjects), rng.choice([None, *range(60)]), rng.choice([None, 1.0, 2.0, 3.0]), "x") for k in range(400)]
    return rows, spark.createDataFrame(rows, "k int, s string, t int, v double, _row string").repartition(4)


@pytest.mark.parametrize("inclusive", [False, True])
@pytest.mark.parametrize("chunk_rows", [10, 10**6])
def test_as_of(spark, points, inclusive, chunk_rows):
    rows, df = points
    other = [(s, t, v, k) for k, s, t, v, _ in rows if k % 3 == 0]
    theirs = spark.createDataFrame(other, "s string, t int, v double, k int")
    got = as_of(df, theirs, ["s"], "t", {"v": "v0", "k": "k0"}, inclusive=inclusive, chunk_rows=chunk_rows)
    want = []
    for k, s, t, v, x in rows:
        before = [(t2, (v2 is not None, v2 or 0), k2, v2) for s2, t2, v2, k2 in other if None not in (s, s2, t, t2) and s == s2 and (t2 <= t if inclusive else t2 < t)]
        last = max(before, default=None)
        want.append((k, s, t, v, x, last and last[3], last and last[2]))
    assert rows_of(got) == sorted(map(str, want))
    assert as_of(df.where("false"), theirs, ["s"], "t", {"v": "v0"}).count() == 0 and as_of(df, theirs.where("false"), ["s"], "t", {"v": "v0"}).where("v0 IS NULL").count() == 400


@pytest.mark.parametrize("chunk_rows", [7, 10**6])
def test_overlapping(spark, chunk_rows):
    rng = random.Random(4)
    rows = [(k, rng.choice(["hot", "hot", "a", None]), s := rng.choice([None, *range(500)]), None if s is None or k % 50 == 0 else s + rng.choice([-3, 0, 1, 2, 300 if k % 40 == 0 else 4]), 1) for k in range(300)]
    df = spark.createDataFrame(rows, "k int, s string, b int, e int, _k int").repartition(3)
    want, reach = [], {}
    for r in sorted((r for r in rows if None not in r[1:4]), key=lambda r: (r[2], r[0])):
        if reach.get(r[1], -1) > r[2]:
            want.append(r)
        reach[r[1]] = max(reach.get(r[1], -1), r[3])
    assert rows_of(overlapping(df, ["s"], "b", "e", ["k"], chunk_rows)) == sorted(map(str, want)) and want
    assert overlapping(df.where("false"), ["s"], "b", "e", ["k"]).count() == 0
    days = spark.createDataFrame([(1, date(2024, 1, 1), date(2024, 1, 5)), (1, date(2024, 1, 4), date(2024, 1, 6)), (1, date(2024, 1, 6), date(2024, 1, 7))], "s int, b date, e date")
    assert [r.b.day for r in overlapping(days, ["s"], "b", "e", ["b"]).collect()] == [4]
    with pytest.raises(SpecError):
        overlapping(df, ["k"], "s", "e", ["k"])


def test_limits(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice(["g", "h", None]), rng.choice([None, *range(-100, 1000)]), rng.choice([None, *range(10)])) for k in range(500)]
    limits = [(rng.choice(["g", "h", None]), b := rng.randrange(-120, 900), b + rng.choice([0, 1, 2, 50, 1000, -5]), rng.choice([None, 2, 3]), rng.choice([None, 6, 7])) for _ in range(40)]
    df, held = spark.createDataFrame(rows, "k int, g string, at int, v int"), spark.createDataFrame(limits, "g string, begin int, end int, low int, high int")
    want = [(*r, b, e, lo, hi) for r in rows for g, b, e, lo, hi in limits if None not in (r[1], r[2], r[3], g) and g == r[1] and b <= r[2] < e and (lo is not None and r[3] < lo or hi is not None and r[3] > hi)]
    got = outside_limits(df, held, ["g"], "at", "v")
    assert rows_of(got) == sorted(map(str, want)) and len(want) > 50
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert outside_limits(df, held.where("false"), ["g"], "at", "v").count() == 0


def test_difference(spark):
    schema = "k int, a string, b double, only int"
    old = [(1, "x", 1.0, 0), (2, "x", None, 0), (3, "y", 2.0, 0), (None, "n", 1.0, 0), (4, "p", 1.0, 0), (4, "q", 1.0, 0), (5, "r", 1.0, 0), (5, "r", 1.0, 0), (7, None, None, 0)]
    new = [(1, "x", 1.0, 1), (2, "x", 0.0, 1), (6, "z", 2.0, 1), (None, "m", 2.0, 1), (4, "q", 1.0, 1), (4, "p", 1.0, 1), (5, "r", 1.0, 1), (7, "", None, 1)]
    a, b = spark.createDataFrame(old, schema).repartition(3), spark.createDataFrame(new, schema).withColumnRenamed("only", "other")
    got = {r.k: (r.change, r.columns, r.n_old, r.n_new) for r in difference(a, b, "k").collect()}
    assert got == {2: ("changed", ["b"], 1, 1), 3: ("gone", None, 1, 0), 6: ("added", None, 0, 1), None: ("changed", ["a", "b"], 1, 1), 5: ("changed", None, 2, 1), 7: ("changed", ["a"], 1, 1)}
    assert difference(a, a, ["k", "a"]).count() == 0 and difference(a.where("false"), a, "k").count() == 7
    with pytest.raises(SpecError):
        difference(a, b, "only")


def test_rollup_is_one_scan(spark, tmp_path):
    spark.createDataFrame([(1, "x", "y"), (2, "a", "y"), (3, "x", "b")], "k int, s string, u string").write.parquet(str(tmp_path / "r"))
    spec = SpecCollection.from_dicts([{"id": "s", "nullable": False, "values": ["a", "b"]}, {"id": "u", "nullable": False, "values": ["a", "b"]}])
    out = error_rollup(validate(spark.read.parquet(str(tmp_path / "r")), spec, "k").errors, "k")
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert {(r.level, r.column, r.keyword): (r.n, r.first_row_affected, r.last_row_affected) for r in out.collect()} == {
        ("both", "s", "enum"): (2, 1, 3), ("both", "u", "enum"): (2, 1, 2), ("column", "s", None): (2, 1, 3), ("column", "u", None): (2, 1, 2), ("keyword", None, "enum"): (4, 1, 3), ("all", None, None): (4, 1, 3)
    }
