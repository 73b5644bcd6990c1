"""Plan shape: pushdown, pruning, early limits, no pair-materialising joins."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from urbanframe.operators import spatial
from urbanframe.plans import inputs
from urbanframe.plans.inspect import plan_operators, plan_text

SF = "/root/testdata/sf0.001"
PAIR_JOINS = {"CartesianProduct", "BroadcastNestedLoopJoin"}


def test_q1_filter_and_columns_reach_the_scan(spark):
    txt = plan_text(E.queries()["q1_share_native"](spark, SF))
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,click)]" in txt
    assert "ReadSchema: struct<event_id:bigint,event_type:string>" in txt


def test_q2_limits_ranks_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan_operators(E.queries()["q2_top_months_df"](spark, SF))
    assert "WindowGroupLimit" in plan_operators(E.queries()["q2_top_months_sql"](spark, SF))


def test_q3_aggregates_blocks_before_the_join(spark):
    txt = plan_text(E.queries()["q3_per_capita_merge"](spark, SF))
    assert "SortMergeJoin" in txt
    # partial aggregation of the blocks happens below the exchange that feeds the join
    assert txt.index("SortMergeJoin") < txt.index("HashAggregate") and "partial_sum" in txt


@pytest.mark.parametrize("strategy", ["default", "broadcast", "merge", "shuffle_hash"])
def test_nearest_site_never_pairs_everything(spark, strategy, monkeypatch):
    seen = []
    original = spatial._best_near

    def recording(*args, **kwargs):
        out = original(*args, **kwargs)
        seen.append(plan_operators(out))
        return out

    monkeypatch.setattr(spatial, "_best_near", recording)
    result = E.queries()[f"q4_nearest_{strategy}"](spark, SF)
    assert result.count() > 0
    assert seen, "no search pass ran"
    for ops in seen:
        assert not ops & PAIR_JOINS
        assert ops & {"BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin"}
    assert not plan_operators(result) & PAIR_JOINS


def test_nearest_site_broadcast_only_after_size_check(spark, monkeypatch):
    seen = []
    original = spatial._best_near

    def recording(*args, **kwargs):
        out = original(*args, **kwargs)
        seen.append(plan_operators(out))
        return out

    monkeypatch.setattr(spatial, "_best_near", recording)
    pts, st = inputs.crime_points(spark, SF), inputs.stations(spark, SF)
    spatial.nearest_site(pts, st, "DR_NO", "LAT", "LON", "DIVISION", "Y", "X", strategy="broadcast", max_broadcast_bytes=240)
    # 240 bytes cannot hold the cells' lists: the join of points and lists is merged
    assert seen and "SortMergeJoin" in seen[0] and "BroadcastHashJoin" not in seen[0]


def test_argmin_and_top_k_reduce_before_shuffle(spark):
    txt = plan_text(E.queries()["op_argmin"](spark, SF))
    # partial SortAggregate below the exchange, final above it
    assert txt.count("SortAggregate") >= 2
    assert "partial_min" in txt


def test_q4_counts_every_clean_id_once(spark):
    summary = E.queries()["q4_nearest_default"](spark, SF)
    from urbanframe.operators.spatial import clean_points

    ids = clean_points(inputs.crime_points(spark, SF), "DR_NO", "LAT", "LON").select("_id").distinct().count()
    assert sum(r["#"] for r in summary.collect()) == ids


@pytest.mark.parametrize("a, b", [("q1_share_native", "q1_share_udf"), ("q2_top_months_df", "q2_top_months_sql"),
                                  ("q3_per_capita_default", "q3_per_capita_shuffle_hash"),
                                  ("q4_nearest_default", "q4_nearest_merge")])
def test_variants_agree(spark, a, b):
    qa, qb = E.queries()[a](spark, SF), E.queries()[b](spark, SF)
    assert qa.columns == qb.columns
    assert [tuple(r) for r in qa.collect()] == [tuple(r) for r in qb.collect()]


def test_q2_sql_takes_a_quoted_format(spark):
    from urbanframe.plans.queries import top_months, top_months_sql

    crimes = spark.createDataFrame([("2020-01-05T10:00:00",), ("2020-01-06T10:00:00",), ("2020-02-01T00:00:00",)], "`d o'c` string")
    fmt = "yyyy-MM-dd'T'HH:mm:ss"
    rows = [tuple(r) for r in top_months_sql(crimes, "d o'c", 1, fmt).collect()]
    assert rows == [tuple(r) for r in top_months(crimes, "d o'c", 1, fmt).collect()] == [(2020, 1, 2, 1)]
