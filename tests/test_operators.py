"""Operator-level checks: median, argmin, top-k, joins and their plans, run logs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from urbanframe.operators import (
    argmin,
    cross_join_count,
    equi_join,
    extract_metric,
    lower_median,
    median_lines,
    share_of_total,
    top_k_per_group,
    union_all,
)
from urbanframe.operators.joins import JOIN_STRATEGIES, measured_bytes, with_strategy
from urbanframe.plans.inspect import plan_operators, plan_text


def lower_median_np(values):
    v = np.sort(np.asarray(values, dtype=float))
    return float(v[int(np.ceil(len(v) / 2)) - 1])


@pytest.mark.parametrize("accuracy", [10_000, 5])
def test_lower_median_matches_numpy(spark, accuracy):
    rng = np.random.default_rng(11)
    data = []
    # one hot group with a third of the rows, heavy duplicates, an outlier, negatives
    for i in range(3000):
        data.append(("hot", float(rng.integers(0, 50))))
    data.append(("hot", 1e12))
    for g in ["a", "b", "c"]:
        for _ in range(int(rng.integers(1, 400))):
            data.append((g, float(rng.normal(0, 1e3))))
    data += [("one", 7.0), (None, 3.0), (None, 1.0), ("nulls", None)]
    df = spark.createDataFrame(data, "g string, v double")
    got = {r["g"]: (r["median"], r["n"]) for r in lower_median(df, "g", "v", count_name="n", accuracy=accuracy).collect()}
    want = {}
    for g in {d[0] for d in data}:
        vals = [d[1] for d in data if d[0] == g and d[1] is not None]
        if vals:
            want[g] = (lower_median_np(vals), len(vals))
    assert got == want


def test_lower_median_equals_percentile_disc(spark):
    df = spark.range(0, 1001).select((F.col("id") % 7).alias("g"), ((F.col("id") * 7919) % 1013).cast("double").alias("v"))
    ours = {r["g"]: r["median"] for r in lower_median(df, "g", "v", accuracy=10).collect()}
    builtin = {
        r["g"]: r["m"]
        for r in df.groupBy("g").agg(F.expr("percentile_disc(0.5) within group (order by v)").alias("m")).collect()
    }
    assert ours == builtin


def test_argmin_ignores_null_values_and_breaks_ties(spark):
    df = spark.createDataFrame(
        [(1, None, "z"), (1, 2.0, "b"), (1, 2.0, "a"), (2, None, "q"), (3, 5.0, "x")], "k int, v double, lab string"
    )
    got = sorted((r["k"], r["v"], r["lab"]) for r in argmin(df, "k", "v", "lab").collect())
    assert got == [(1, 2.0, "a"), (2, None, None), (3, 5.0, "x")]


def test_top_k_keeps_ties_and_limits_before_shuffle(spark):
    df = spark.createDataFrame([("g", 5), ("g", 5), ("g", 4), ("g", 3), ("g", 1), ("h", 1)], "k string, v int")
    out = top_k_per_group(df, "k", [F.desc("v")], 2)
    assert sorted((r["k"], r["v"], r["ranking"]) for r in out.collect()) == [("g", 5, 1), ("g", 5, 1), ("h", 1, 1)]
    assert "WindowGroupLimit" in plan_operators(out)


def test_share_of_total_counts_null_key(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string")
    got = {r["k"]: r["percentage"] for r in share_of_total(df, "k").collect()}
    assert got == {"a": 50.0, "b": 25.0, None: 25.0}


EXPECTED_JOIN = {
    "broadcast": "BroadcastHashJoin",
    "merge": "SortMergeJoin",
    "shuffle_hash": "ShuffledHashJoin",
}


@pytest.mark.parametrize("strategy", sorted(EXPECTED_JOIN))
def test_join_strategy_plans(spark, strategy):
    left = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("x"))
    right = spark.range(10).select(F.col("id").alias("rk"), F.col("id").cast("string").alias("y"))
    out = equi_join(left, right, "k", "rk", strategy)
    assert EXPECTED_JOIN[strategy] in plan_operators(out)
    assert out.count() == 10


def test_all_strategies_same_rows(spark):
    left = spark.range(500).select((F.col("id") % 37).alias("k"), F.col("id").alias("x"))
    right = spark.range(40).select((F.col("id") % 20).alias("rk"), F.col("id").alias("y"))
    results = {s: sorted(tuple(r) for r in equi_join(left, right, "k", "rk", s).collect()) for s in JOIN_STRATEGIES}
    first = results["default"]
    assert all(v == first for v in results.values())
    assert len(first) > 0


def test_broadcast_falls_back_when_too_big(spark):
    right = spark.range(100).select(F.col("id").alias("rk"))
    assert measured_bytes(right) == 100 * 24
    marked = with_strategy(right, "broadcast", max_broadcast_bytes=2399)
    out = spark.range(100).join(marked, F.col("id") == F.col("rk"))
    assert "SortMergeJoin" in plan_operators(out)


def test_few_wide_rows_are_not_broadcast(spark):
    wide = spark.range(5).select(F.col("id").alias("rk"), F.repeat(F.lit("x"), F.lit(10_000)).alias("t"), F.array("id").alias("a"))
    assert 50_000 < measured_bytes(wide) < 52_000
    out = spark.range(100).join(with_strategy(wide, "broadcast", max_broadcast_bytes=40_000), F.col("id") == F.col("rk"))
    assert "BroadcastHashJoin" not in plan_operators(out)


def test_size_measure_sends_no_rows_to_one_task(spark):
    frame = spark.range(100).select(F.col("id").cast("string").alias("t"))
    # the plan behind measured_bytes: a partial sum below the only exchange
    plan = plan_text(frame.select(F.octet_length("t").alias("w")).agg(F.sum("w")))
    assert "partial_sum" in plan and "Limit" not in plan


def _median_passes(monkeypatch):
    from urbanframe.operators import quantile

    states = []
    original = quantile.materialize
    monkeypatch.setattr(quantile, "materialize", lambda df, name: states.append(name) or original(df, name))
    return states


@pytest.mark.parametrize("values", [
    [float(i) for i in range(20)] + [-1.7e308, 1.7e308],
    [10.0 ** (i % 600 - 300) for i in range(4000)],
    [5.0] * 1000,
])
def test_lower_median_ends_in_few_passes(spark, monkeypatch, values):
    states = _median_passes(monkeypatch)
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    assert lower_median(df, "g", "v").first()["median"] == lower_median_np(values)
    assert len(states) <= 5, states


def test_lower_median_keeps_the_type(spark):
    big = 9007199254740993
    longs = spark.createDataFrame([("g", big), ("g", big), ("g", big), ("h", big - 1), ("h", big), ("h", big + 1)], "g string, v long")
    assert {r["g"]: r["median"] for r in lower_median(longs, "g", "v").collect()} == {"g": big, "h": big}
    text = spark.createDataFrame([("g", "2"), ("g", "x"), ("g", "1"), ("g", None)], "g string, v string")
    assert lower_median(text, "g", "v", count_name="n").first().asDict() == {"g": "g", "median": 1.0, "n": 2}
    with pytest.raises(TypeError):
        lower_median(text.select("g", F.array("v").alias("v")), "g", "v")


def test_unknown_strategy_rejected(spark):
    with pytest.raises(ValueError):
        with_strategy(spark.range(1), "shuffle_replicate_nl")


def test_cross_join_count_without_pairs(spark):
    out = cross_join_count(spark.range(25), spark.range(100))
    assert out.first()["pairs"] == 2500
    assert not any("Join" in o or "Cartesian" in o for o in plan_operators(out))


def test_union_all_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "a int, b string")
    b = spark.createDataFrame([("y", 2)], "b string, a int")
    assert sorted(tuple(r) for r in union_all(a, b, a).collect()) == [(1, "x"), (1, "x"), (2, "y")]


def test_run_log_parsing(spark):
    lines = spark.createDataFrame(
        [("noise",), ("QUERY_ELAPSED_SECONDS=12.345",), ("q1 csv MEDIAN=3.5",), ("x QUERY_ELAPSED_SECONDS=1",)], "value string"
    )
    assert sorted(r["seconds"] for r in extract_metric(lines).collect()) == [1.0, 12.345]
    assert [tuple(r) for r in median_lines(lines).collect()] == [("q1 csv", 3.5)]


@pytest.mark.parametrize("accuracy", [2, 10_000])
def test_lower_median_orders_infinities_and_nan_like_spark(spark, accuracy):
    nan, inf = float("nan"), float("inf")
    rows = [("a", 1.0), ("a", nan), ("a", nan), ("b", -inf), ("b", 2.0), ("b", inf), ("c", nan), ("d", 1.0),
            ("d", 2.0), ("d", nan), ("e", -inf), ("e", -inf), ("e", 5.0), ("f", inf), ("f", inf), ("f", 1.0), ("f", 3.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    ours = {r["g"]: r["median"] for r in lower_median(df, "g", "v", accuracy=accuracy).collect()}
    builtin = {
        r["g"]: r["m"]
        for r in df.groupBy("g").agg(F.expr("percentile_disc(0.5) within group (order by v)").alias("m")).collect()
    }
    assert {k: repr(v) for k, v in ours.items()} == {k: repr(v) for k, v in builtin.items()}
