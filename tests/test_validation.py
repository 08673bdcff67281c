"""Cells: keywords by type and null, their overlaps, summaries, datasets."""

import math

import pytest

from tabwright.functions.columns import check_format, check_nullable, check_pattern, check_type
from tabwright.operators.dataset import Agreement, ValidatedDataset, make_container
from tabwright.operators.rules import RuleViolation
from tabwright.operators.validate import StructuralErrors, validate
from tabwright.plans.schema import json_schema
from tabwright.spec import ColumnSpec, Rule, SpecCollection, SpecError
from tabwright.streaming.validate import stream_errors, stream_rule_violations


def found(df, *columns, **settings):
    spec = SpecCollection.from_dicts(columns)
    rows = validate(df, spec, "k", **settings).errors.collect()
    return sorted((r.k, r.column, r.keyword, r.data) for r in rows)


@pytest.fixture(scope="module")
def df(spark):
    rows = [(1, "a", 1.0, 1, True), (2, None, None, None, None), (3, "", math.nan, 3, False), (4, "日本😀", math.inf, 4, True), (5, "ab", 2.5, 5, True)]
    return spark.createDataFrame(rows, "k int, s string, d double, i int, b boolean")


def test_types(df):
    assert found(df, {"id": "s", "nullable": True}, {"id": "d", "type": "Num", "nullable": True}, {"id": "i", "type": "Int", "nullable": True}, {"id": "b", "type": "Bool", "nullable": True}) == []
    assert [x[:3] for x in found(df, {"id": "s"})] == [(2, "s", "type"), (3, "s", "type")]
    assert [x[0] for x in found(df, {"id": "s"}, blank_as_null=False)] == [2]
    assert [x[0] for x in found(df, {"id": "d", "type": "Num"})] == [2, 3, 4]
    assert [x[0] for x in found(df, {"id": "d", "type": "Int", "nullable": True})] == [5]
    assert [x[0] for x in found(df, {"id": "s", "type": "Num", "nullable": True})] == [1, 4, 5]
    assert [x[0] for x in found(df, {"id": "i", "type": "Char", "nullable": True})] == [1, 3, 4, 5]
    assert [x[0] for x in found(df, {"id": "i", "type": "Bool", "nullable": True})] == [1, 3, 4, 5]


def test_keywords(df):
    assert [x[0] for x in found(df, {"id": "s", "nullable": True, "length": 1})] == [4, 5]
    assert [x[0] for x in found(df, {"id": "s", "nullable": True, "pattern": "^a$"})] == [4, 5]
    assert [x[0] for x in found(df, {"id": "s", "nullable": True, "pattern": "b"})] == [1, 4]
    assert [x[0] for x in found(df, {"id": "s", "nullable": True, "values": ["a", "ab"]})] == [4]
    assert [x[0] for x in found(df, {"id": "i", "type": "Int", "nullable": True, "values": [1, 3]})] == [4, 5]
    assert [x[0] for x in found(df, {"id": "b", "type": "Bool", "nullable": True, "values": [True]})] == [3]


def test_overlaps(df):
    both = found(df, {"id": "s", "nullable": False, "values": ["a"]})
    assert [x[:3] for x in both] == [(2, "s", "const"), (2, "s", "type"), (3, "s", "const"), (3, "s", "type"), (4, "s", "const"), (5, "s", "const")]
    with pytest.warns(UserWarning):
        wrong = found(df, {"id": "i", "type": "Num", "nullable": True, "length": 0, "pattern": "^x"})
    assert wrong == []
    assert [x[:3] for x in found(df, {"id": "i", "nullable": True, "values": ["1"]}) if x[0] == 1] == [(1, "i", "enum"), (1, "i", "type")]


def test_nested_values(spark):
    df = spark.createDataFrame([(1, ["a", None, "b"], [[1], []], {"x": 1}), (2, None, None, None)], "k int, l array<string>, n array<array<int>>, m map<string,int>")
    assert [x[3] for x in found(df, {"id": "l", "nullable": True}, {"id": "m", "nullable": True}, {"id": "n", "nullable": True})] == ["a; NA; b", '{"x":1}', "[[1],[]]"]


def test_required_and_summary(df):
    result = validate(df, SpecCollection.from_dicts([{"id": "s"}, {"id": "gone"}]), "k")
    assert result.errors.where("keyword = 'required'").count() == 5
    assert [(r.keyword, r.message) for r in result.summary.collect()] == [("required", "must have required property 'gone'")]
    assert not result.is_valid
    empty = validate(df.where("false"), SpecCollection.from_dicts([{"id": "gone"}]), "k")
    assert not empty.is_structurally_valid and empty.errors.count() == 0
    grouped = validate(df, SpecCollection.from_dicts([{"id": "s"}]), "k").summary.collect()
    assert [(r.data, r.first_row_affected, r.last_row_affected, r.n_rows_affected) for r in grouped] == [(None, 2, 3, 2)]


def test_many_constraints(spark):
    df = spark.range(3).selectExpr("id AS k", *[f"cast(id AS string) AS c{i}" for i in range(120)])
    errors = validate(df, SpecCollection.from_dicts([{"id": f"c{i}", "nullable": False, "pattern": "^[01]$"} for i in range(120)]), "k").errors
    assert errors.count() == 120
    plan = errors._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_first_chunk(spark):
    df = spark.range(1, 12001).selectExpr("int(id) AS k", "if(id in (5001, 9999, 10001), 'x', 'a') AS s")
    spec = SpecCollection.from_dicts([{"id": "s", "nullable": False, "values": ["a"]}])
    assert sorted(r.k for r in validate(df, spec, "k", compat="reference").errors.collect()) == [5001, 9999]


def test_results_and_dataset(df):
    spec = SpecCollection.from_dicts([{"id": "k", "type": "Int"}], [{"id": "r", "type": "check_range", "column": "k", "range": [1, 4]}], {"version": 2, "author": "x"})
    data = ValidatedDataset.of(spec, {"one": df, "two": df.where("k < 5")}, "k")
    assert data.labels == ["one", "two"] and data.table(2).count() == 4 and data.table("one").count() == 5
    assert not data.result("one").is_valid and data.result(2).is_valid
    with pytest.raises(RuleViolation):
        data.result("one").raise_on_failure()
    with pytest.raises(StructuralErrors):
        validate(df, SpecCollection.from_dicts([{"id": "s"}]), "k").raise_on_failure()
    for which, error in (("three", KeyError), (3, IndexError), (0, IndexError), (1.5, TypeError)):
        with pytest.raises(error):
            data.table(which)
    deal = Agreement({"a": data}, [{"version": "1"}])
    assert deal.metadata.version == "1" and list(deal.get()) == ["a"] and list(deal.get("a")) == ["a"]
    with pytest.raises(KeyError, match="not found"):
        deal.get("b")
    assert data.metadata.version == "2" and data.rules[0].id == "r" and data.column("k").type == "Int" and data.column("zz") is None
    assert make_container(spec, df, "k").labels == ["table1"]
    assert data.result("one").flagged("ok").where("ok").count() == 4
    good, bad = data.result("one").split()
    assert good.count() == 4 and bad.count() == 1


def test_spec_mistakes(spark):
    for given in ({"id": "a b"}, {"id": ""}, {"id": "a", "label": 1}, {"id": "a", "nullable": "Yes"}, {"id": "a", "length": "8"}, {"id": "a", "pattern": "("}, {"id": "a", "pattern": "(?P<x>a)"}, {"label": "x"}):
        with pytest.raises(SpecError):
            ColumnSpec.from_dict(given)
    with pytest.raises(SpecError, match="more than once"):
        SpecCollection.from_dicts([{"id": "a"}, {"id": "a"}])
    with pytest.raises(SpecError):
        SpecCollection([ColumnSpec("a")], ("no rule",))
    with pytest.raises(SpecError):
        SpecCollection.from_dicts("abc")


def test_patterns_are_javas(df):
    assert [x[0] for x in found(df, {"id": "s", "nullable": True, "pattern": r"^\p{L}+$"})] == [4]
    assert ColumnSpec("a", pattern=r"(?<x>a)\k<x>").pattern
    assert df.agg(check_pattern(df.s, "a$").alias("x")).first()[0] is False


def test_json_schema():
    spec = SpecCollection.from_dicts([{"id": "a", "nullable": True, "values": ["x"], "length": 3.0}, {"id": "n", "type": "Int", "nullable": False, "values": ["1"]}, {"id": "d", "type": "Date9"}])
    assert json_schema(spec)["items"] == {
        "type": "object",
        "properties": {"a": {"type": ["string", "null"], "maxLength": 3, "enum": ["x", None, ""]}, "n": {"type": "integer", "const": 1}, "d": {"type": "string"}},
        "required": ["a", "n", "d"],
    }


def test_column_checks(df):
    row = df.agg(check_format(df.s, 3).alias("a"), check_format(df.s, 2).alias("b"), check_nullable(df.s, False).alias("c"), check_nullable(df.i, True).alias("d"), check_type(df, "s", "character").alias("e"), check_type(df, "s", "numeric").alias("f")).first()
    assert tuple(row) == (True, False, False, True, True, False)
    none = df.where("false")
    assert tuple(none.agg(check_format(none.s, 0).alias("a"), check_nullable(none.s, False).alias("b"), check_type(none, "s", "numeric").alias("c")).first()) == (True, True, True)


def test_stream(spark, tmp_path, df):
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    spec = SpecCollection.from_dicts([{"id": "s"}])

    def rows(out, name):
        q = out.writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    assert sorted(r.k for r in rows(stream_errors(stream, spec, ["k"]), "e1")) == [2]
    found = rows(stream_rule_violations(stream, [Rule("r", "check_range", column=("i",), range=(1, 3))], ["k"]), "e2")
    assert sorted((r.k, r.rule_id) for r in found) == [(4, "r"), (5, "r")]
