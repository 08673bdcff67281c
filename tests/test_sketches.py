"""Sketches of uniqueness: what they rule out, merged in any way, against the exact rule."""

import random

import pytest

from tabwright.operators.rules import violating_rows
from tabwright.operators.sketches import duplicates, merged, sketch, suspects
from tabwright.spec import Rule, SpecError


@pytest.mark.parametrize("bits", [15, 18])
def test_duplicates_equal_the_exact_rule(spark, bits):
    rng = random.Random(bits)
    rows = [(k, rng.choice([None, "hot", "hot", f"v{rng.randrange(900)}"]), rng.choice([None, 1, 2])) for k in range(1500)]
    parts = [spark.createDataFrame(rows[k::4], "k int, s string, n int") for k in range(4)]
    rule = Rule("u", "check_unique", column=("s", "n"))
    whole = merged([sketch(p, rule, bits) for p in parts])
    want = sorted(r.k for r in violating_rows(spark.createDataFrame(rows, "k int, s string, n int"), rule, ["k"]).collect())
    assert sorted(r.k for r in duplicates(parts, rule, whole, ["k"], bits).collect()) == want
    once = sketch(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]), rule, bits)
    as_bits = lambda df: sorted((r.bucket, bytes(r.some), bytes(r.more)) for r in df.collect())
    assert as_bits(whole) == as_bits(once)


def test_unlike_rows_are_ruled_out(spark):
    rule = Rule("u", "check_unique", column=("id",))
    df = spark.range(3000)
    whole = merged([sketch(df.where("id < 2000"), rule, 30), sketch(df.where("id >= 2000"), rule, 30)])
    assert suspects(df, rule, whole, 30).count() < 30
    none = df.where("false")
    assert sketch(none, rule).count() == 0 and duplicates([none, df], rule, merged([sketch(none, rule), sketch(df, rule)]), ["id"]).count() == 0


def test_refusals(spark):
    rule = Rule("u", "check_unique", column=("id",))
    for wrong in (lambda: merged([]), lambda: sketch(spark.range(3), rule, 10), lambda: sketch(spark.range(3), Rule("r", "check_range", column=("id",), range=(1, 2))), lambda: duplicates([], rule, sketch(spark.range(3), rule), ["id"])):
        with pytest.raises(SpecError):
            wrong()
