"""The as-of join against a plain one, with hot keys, ties, nulls and blocks of any width."""

import random

import pytest

from tagweft.operators import asof

KIND = "k string, t long, v string, n int"


def slow(left, right, strict):
    out = []
    for k, t, v, n in left:
        fit = [r for r in right if None not in (k, t, r[0], r[1]) and r[0] == k and (r[1] < t if strict else r[1] <= t)]
        last = max(fit, key=lambda r: (r[1], r[2] is not None, r[2] or "", r[3])) if fit else (None,) * 4
        out.append((k, t, v, n, last[2], last[3]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("width,strict", [(1, False), (7, True), (7, False), (1 << 16, True)])
def test_against_a_plain_join(spark, width, strict):
    rng = random.Random(width)
    row = lambda i: (rng.choice(["hot"] * 6 + ["a", "b", None]), rng.choice([*range(-20, 60), None]), rng.choice(["x", "y", None]), i)
    left, right = [row(i) for i in range(300)], [row(i) for i in range(80)]
    left += left[:3]
    got = asof.asof(spark.createDataFrame(left, KIND), spark.createDataFrame(right, KIND), ["k"], "t", ["v", "n"], width=width, strict=strict)
    assert got.columns == ["k", "t", "v", "n", "last_v", "last_n"]
    assert sorted(map(tuple, got.collect()), key=repr) == slow(left, right, strict)


def test_empty_sides(spark):
    one, none = spark.createDataFrame([("a", 1, "x", 1)], KIND), spark.createDataFrame([], KIND)
    assert [tuple(r) for r in asof.asof(one, none, ["k"], "t", ["v"]).collect()] == [("a", 1, "x", 1, None)]
    assert asof.asof(none, one, ["k"], "t", ["v"]).count() == 0


def test_a_hot_key_is_dealt_by_block(spark):
    rows = spark.range(10_000).selectExpr("'hot' AS k", "id AS t", "cast(id AS string) AS v", "cast(id AS int) AS n")
    found = asof.asof(rows, rows.where("t % 100 = 0"), ["k"], "t", ["n"], width=100)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k" in plan and "block" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
    assert found.where("last_n <> t - t % 100").count() == 0
