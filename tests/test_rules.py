"""Rules and conditions: a fixed frame with known results, and random frames against a plain evaluator."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabwright.operators.rules import RuleViolation, apply_rules, not_in_combinations, rule_results, validate_rules, violating_rows
from tabwright.spec import Rule, SpecError

COLUMNS = "parcel long, stop int, state string, weight double, signed_by string, signed_on date, route string, fee double, refund double, note string"
ROWS = [
    (11, 1, "sent", 0.5, None, None, "north", 4.0, None, ""),
    (11, 2, "arrived", 0.5, "ann", "2024-05-02", "north", 4.0, None, "at the door"),
    (11, 2, "arrived", 0.5, "ann", "2024-05-02", "north", None, 4.0, None),
    (12, 1, "sent", 30.0, None, None, "south", 12.5, None, None),
    (12, 2, "lost", 30.0, "", None, "south", 12.5, 12.5, "search"),
    (13, None, "arrived", math.nan, "", "2024-05-04", "north", 0.0, None, None),
    (13, None, "arrived", 31.0, "bo", None, None, 7.0, None, "10"),
]


def when(condition, then):
    return {"type": "check_condition", "condition": condition, "then": then}


CASES = [
    (when({"state": {"equals": "arrived"}}, {"signed_by": {"empty": False}}), 1),
    (when({"state": {"equals": "arrived"}}, {"signed_on": {"empty": False}}), 1),
    ({"type": "check_range", "column": "weight", "range": [0.5, 30]}, 1),
    ({"type": "check_range", "column": "weight", "range": [0.6, 31]}, 3),
    ({"type": "check_range", "column": "note", "range": [0, 9]}, 1),
    (when({"fee": {"greater": 0}}, {"refund": {"empty": True}}), 1),
    (when({"refund": {"empty": False}}, {"state": {"in": ["lost", "sent"]}}), 1),
    ({"type": "check_unique", "column": ["parcel", "stop"]}, 2),
    ({"type": "check_unique", "column": ["parcel", "stop", "weight", "fee"]}, 0),
    ({"type": "check_unique", "column": "route"}, 4),
    (when({"route": {"equals": "north"}}, {"weight": {"less": 1}}), 0),
    (when({"route": {"not_equals": "north"}}, {"weight": {"less_equal": 30}, "fee": {"range": [12.5, 20]}}), 0),
    (when({"route": {"in": ["south", None]}}, {"weight": {"less": 31}}), 1),
    (when({"stop": {"equals": 2}}, {"state": {"not_in": ["sent"]}, "fee": {"greater_equal": 4}}), 0),
    ({"type": "check_allowed_combinations", "columns": ["stop", "state"], "allowed": [[1, "sent"], [2, "arrived"], [None, "arrived"]]}, 1),
    ({"type": "check_mutual_exclusive", "columns": ["fee", "refund"]}, 1),
]


@pytest.fixture(scope="module")
def frame(spark):
    from datetime import date

    rows = [tuple(date.fromisoformat(x) if k == 5 and x else x for k, x in enumerate(r)) for r in ROWS]
    return spark.createDataFrame(rows, COLUMNS)


def test_fixed_frame(frame):
    rules = [Rule.from_dict({"id": f"r{k}", **given}) for k, (given, _) in enumerate(CASES)]
    results = apply_rules(frame, rules)
    assert [r.n_violations for r in results] == [n for _, n in CASES]
    assert [r.valid for r in results] == [n == 0 for _, n in CASES]
    assert "3 rows" in results[3].message and results[8].message is None


def test_raise_and_rows(frame):
    rules = [Rule.from_dict({"id": "heavy", **CASES[2][0]}), Rule.from_dict({"id": "u", **CASES[7][0]}), Rule.from_dict({"id": "pairs", **CASES[14][0]})]
    with pytest.raises(RuleViolation, match="weight") as e:
        validate_rules(frame, rules)
    assert [r.id for r in e.value.results] == ["heavy", "u", "pairs"]
    assert [r.note for r in violating_rows(frame, rules[0]).collect()] == ["10"]
    assert sorted((r.parcel, r.fee) for r in violating_rows(frame, rules[1], ["fee"]).collect()) == [(11, 4.0), (13, 7.0)]
    assert [r.state for r in violating_rows(frame, rules[2]).collect()] == ["lost"]


def test_combinations(frame):
    given = {"id": "p", "type": "check_allowed_combinations", "columns": ["stop", "state"], "allowed": [{"state": "sent", "stop": 1}, {"stop": 2, "state": "lost"}]}
    rule = Rule.from_dict(given)
    assert rule.allowed == ((1, "sent"), (2, "lost")) and Rule.from_dict(rule.to_dict()) == rule
    assert apply_rules(frame, [rule])[0].n_violations == 4
    assert not_in_combinations(frame, given["allowed"]).count() == 4
    assert not_in_combinations(frame, []).count() == len(ROWS)
    for wrong in ({"allowed": []}, {"allowed": [[1]]}, {"columns": []}):
        with pytest.raises(SpecError):
            Rule.from_dict(given | wrong)


def test_long_texts_are_grouped_by_digest(spark):
    long = "x" * 65
    df = spark.createDataFrame([(1, long), (2, long), (3, long + "y"), (4, "short"), (5, "short"), (6, None), (7, None), (8, "")], "k int, t string")
    assert apply_rules(df, [Rule("u", "check_unique", column=("t",))])[0].n_violations == 3
    assert sorted(r.k for r in violating_rows(df, Rule("u", "check_unique", column=("t",)), ["k"]).collect()) == [2, 5, 7]


def test_no_rules_and_empty_table(spark, frame):
    assert rule_results(frame, []).collect() == []
    rules = [Rule.from_dict({"id": f"r{k}", **given}) for k, (given, _) in enumerate(CASES)]
    assert all(r.valid for r in apply_rules(frame.where("false"), rules))


def test_mistakes():
    for given in (
        {"id": "x", "type": "check_what"},
        {"id": "x", "type": "check_range", "column": "A"},
        {"id": "x", "type": "check_range", "column": "A", "range": [1, 2, 3]},
        {"id": "x", "type": "check_unique"},
        when({"A": {"like": 1}}, {"B": {"equals": 1}}) | {"id": "x"},
    ):
        with pytest.raises(SpecError):
            Rule.from_dict(given)


def test_missing_column(frame):
    with pytest.raises(SpecError, match="NOPE"):
        apply_rules(frame, [Rule("x", "check_range", column=("NOPE",), range=(0, 1))])


def test_literals_follow_the_column(spark):
    df = spark.createDataFrame([("9", 9, True, float("nan")), ("10", 10, False, 1.0), (None, None, None, None)], "s string, i int, b boolean, d double")

    def n(condition, then):
        return apply_rules(df, [Rule("x", "check_condition", condition, then)])[0].n_violations

    always = {"i": {"greater": 0}}
    assert n(always, {"s": {"greater": 10}}) == 1  # as text: "9" > "10", and "10" isn't
    assert n(always, {"i": {"equals": "abc"}}) == 2
    assert n(always, {"i": {"equals": "9"}}) == 1
    assert n(always, {"b": {"equals": True}}) == 1
    assert n(always, {"d": {"greater": 0.5}}) == 0  # NaN is unknown
    assert n(always, {"d": {"empty": True}}) == 1
    assert n(always, {"s": {"in": [9, None]}}) == 1
    assert n({"i": {"empty": True}}, {"s": {"not_in": ["9"]}}) == 0


def test_strict_bounds(spark):
    df = spark.createDataFrame([(5,), (6,)], "i int")
    rule = Rule("x", "check_condition", {"i": {"greater": 0}}, {"i": {"greater_equal": 5}})
    assert apply_rules(df, [rule])[0].n_violations == 0
    assert apply_rules(df, [rule], compat="reference")[0].n_violations == 1


def test_older_shapes(frame):
    given = [
        {"id": "a", "type": "check_equal", "condition": {"column": "stop", "equals": 2}, "then": {"column": "state", "equals": "arrived"}},
        {"id": "b", "type": "check_unequal", "condition": {"column": "stop", "equals": 2}, "then": {"column": "state", "equals": "arrived"}},
        {"id": "c", "type": "check_dependency", "condition": {"column": "state", "equals": "arrived"}, "then": "route"},
        {"id": "d", "type": "check_mutual_exclusive", "columns": ["note", "refund"]},
    ]
    assert [r.n_violations for r in apply_rules(frame, [Rule.from_dict(g) for g in given])] == [1, 2, 1, 1]


def test_one_scan_without_python(frame):
    rules = [Rule.from_dict({"id": f"r{k}", **given}) for k, (given, _) in enumerate(CASES) if given["type"] != "check_unique"]
    plan = rule_results(frame, rules)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1 and "Python" not in plan and "Arrow" not in plan


values = st.one_of(st.none(), st.sampled_from([0.0, 1.0, 2.5, 5.0, math.nan]))
texts = st.one_of(st.none(), st.sampled_from(["", "a", "b", "10", "9"]))
ops = st.sampled_from([("equals", 1), ("not_equals", 1), ("in", [1, 5]), ("not_in", [1, 5]), ("greater", 1), ("less", 2), ("greater_equal", 1), ("less_equal", 1), ("range", [1, 5]), ("empty", True), ("empty", False)])


def plainly(x, op, v):
    """Three-valued result of a condition on a number: True, False or None."""
    absent = x is None or math.isnan(x)
    if op == "empty":
        return absent == v
    if op in ("in", "not_in"):
        return (not absent and x in v) == (op == "in")
    if absent:
        return None
    return {"equals": lambda: x == v, "not_equals": lambda: x != v, "greater": lambda: x > v, "less": lambda: x < v, "greater_equal": lambda: x >= v, "less_equal": lambda: x <= v, "range": lambda: v[0] <= x <= v[1]}[op]()


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.tuples(values, values, texts), min_size=1, max_size=12), first=ops, second=ops)
def test_random_frames(spark, rows, first, second):
    df = spark.createDataFrame(rows, "x double, y double, t string")
    rules = [Rule("c", "check_condition", {"x": {first[0]: first[1]}}, {"y": {second[0]: second[1]}}), Rule("u", "check_unique", column=("x", "t")), Rule("r", "check_range", column=("t",), range=(0, 9.5))]
    key = lambda r: (None if r[0] is None else "nan" if math.isnan(r[0]) else r[0], r[2])
    want = [
        sum(plainly(x, *first) is True and plainly(y, *second) is False for x, y, _ in rows),
        len(rows) - len({key(r) for r in rows}),
        sum(t == "10" for _, _, t in rows),
    ]
    assert [r.n_violations for r in apply_rules(df, rules)] == want
    assert df.where(F.lit(True)).count() == len(rows)
