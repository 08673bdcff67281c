"""Constraints on arrays, structs and maps."""

import math

import pytest

from tabwright.plans.nested import Shape, nested_errors
from tabwright.spec import SpecError


def found(df, shapes, key="k"):
    return sorted((r.k, r.column, r.path, r.keyword, r.data) for r in nested_errors(df, shapes, key).collect())


@pytest.fixture(scope="module")
def df(spark):
    rows = [
        (1, [1.0, 2.0], {"a": [1]}, [("user", 1), ("bot", None)]),
        (2, [9.0, None, math.nan, -1.0], {"a/b": [1, 5], "~": []}, [(None, 7)]),
        (3, [], {}, []),
        (4, None, None, None),
        (5, [1.0, 1.0], {"c": None}, [None]),
    ]
    return spark.createDataFrame(rows, "k int, l array<double>, m map<string,array<int>>, s array<struct<role:string,n:int>>")


def test_arrays(df):
    shape = {"l": {"items": {"type": "Num", "minimum": 0, "maximum": 5}, "min_items": 1, "unique": True, "nullable": True}}
    assert found(df, shape) == [(2, "l", "/0", "maximum", "9.0"), (2, "l", "/1", "type", None), (2, "l", "/2", "type", "NaN"), (2, "l", "/3", "minimum", "-1.0"), (3, "l", "", "minItems", "0"), (5, "l", "", "uniqueItems", "2")]
    assert found(df, {"l": {"items": {"type": "Num", "nullable": True}}}) == [(4, "l", "", "type", None)]


def test_maps_and_pointers(df):
    shape = {"m": {"values": {"items": {"type": "Int", "maximum": 4}, "min_items": 1}, "keys": "^[a-z]", "nullable": True}}
    assert found(df, shape) == [(2, "m", "/a~1b/1", "maximum", "5"), (2, "m", "/~0", "minItems", "0"), (2, "m", "/~0", "propertyNames", "~"), (5, "m", "/c", "type", None)]


def test_structs(df):
    turn = {"fields": {"role": {"values": ["user", "bot"]}, "n": {"type": "Int", "nullable": True}, "gone": {"type": "Int"}}, "nullable": True}
    got = found(df, {"s": {"items": turn, "nullable": True, "max_items": 1}, "none": {"items": turn}})
    assert [x for x in got if x[1] == "s" and x[3] != "required"] == [(1, "s", "", "maxItems", "2"), (2, "s", "/0/role", "enum", None), (2, "s", "/0/role", "type", None)]
    assert [x[:3] for x in got if x[3] == "required"] == [(1, "none", ""), (1, "s", "/0"), (1, "s", "/1"), (2, "none", ""), (2, "s", "/0"), (3, "none", ""), (4, "none", ""), (5, "none", "")]


def test_wrong_kinds(df):
    assert [x[0:1] + x[2:4] for x in found(df, {"l": {"fields": {"a": {"type": "Int"}}, "nullable": True}})] == [(1, "", "type"), (2, "", "type"), (3, "", "type"), (5, "", "type")]
    assert {x[3] for x in found(df, {"s": {"type": "Int", "nullable": True}, "k": {"items": {"type": "Int"}}})} == {"type"}
    assert found(df, {}) == [] and nested_errors(df.where("false"), {"l": {"items": {"type": "Num"}}}, "k").count() == 0
    renamed = nested_errors(df.withColumnRenamed("k", "path"), {"l": {"items": {"type": "Num"}}}, "path")
    assert renamed.columns[0] == "path_key" and renamed.count() == 3


def test_one_scan_in_the_jvm(df, spark, tmp_path):
    df.write.parquet(str(tmp_path / "n"))
    out = nested_errors(spark.read.parquet(str(tmp_path / "n")), {"l": {"items": {"type": "Num", "maximum": 5}}, "m": {"values": {"items": {"type": "Int"}}}}, "k")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and "Python" not in plan and "k#" in plan


def test_refusals():
    for given in ({"items": 3}, 3, {"items": {"type": "Num", "minimum": 2, "maximum": 1}}, {"items": {"type": "Num"}, "min_items": 2, "max_items": 1}):
        with pytest.raises(SpecError):
            Shape.from_any(given)
    with pytest.raises(SpecError):
        Shape()
