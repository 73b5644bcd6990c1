"""Operators for hot groups, and sinks that prove what they wrote."""

import random

import pytest
from pyspark.sql import functions as F

from urbanframe.operators import heavy_key_join, heavy_keys, joins, reproducible_avg, top_k_per_group, top_k_with_ties
from urbanframe.plans.inspect import plan_operators
from urbanframe.sources import (
    ConversionError,
    convert_verified,
    read_csv,
    read_tuple_text,
    sinks,
    write_parquet,
    write_result,
    write_tuple_text,
)
from urbanframe.sources.splits import session_settings


def rows_of(df):
    return sorted(map(repr, map(tuple, df.collect())))


@pytest.mark.parametrize("k", [1, 3, 10])
@pytest.mark.parametrize("descending", [True, False])
def test_top_k_with_ties_equals_the_window(spark, k, descending):
    rng = random.Random(k)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice([1.0, 2.0, 2.0, 3.0, None, float("nan"), -0.0, 0.0]), i) for i in range(200)]
    rows += [(9, 5.0, 1000 + i) for i in range(300)]
    df = spark.createDataFrame(rows, "g int, v double, i int")
    order = [(F.desc_nulls_last if descending else F.asc_nulls_last)("v")]
    expected = top_k_per_group(df, "g", order, k)
    got = top_k_with_ties(df, "g", "v", k, descending)
    assert got.columns == expected.columns
    assert rows_of(got) == rows_of(expected)
    assert top_k_with_ties(df.limit(0), "g", "v", k).count() == 0


def test_top_k_with_ties_never_sorts_a_whole_group(spark):
    # one group of tied rows: windows see one row for it
    df = spark.range(20_000).select(F.lit(1).alias("g"), F.lit(7).alias("v"), "id")
    seen = []
    out = top_k_with_ties(df, "g", "v", 3)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    window = plan[plan.index("Window") :]
    assert "Aggregate" in window  # below every window the rows are one per value
    seen.append(out.count())
    assert seen == [20_000]


def test_heavy_keys_and_both_ways_to_join_them(spark, monkeypatch):
    rng = random.Random(4)
    left = [(5 if i % 3 == 0 else None if i % 50 == 1 else rng.randrange(400), i) for i in range(3000)]
    right = [(k % 300, f"r{k}") for k in range(450)] + [(None, "none")]
    a = spark.createDataFrame(left, "k long, i int")
    b = spark.createDataFrame(right, "key long, name string")
    assert heavy_keys(a, "k", 0.1) == [5]
    assert heavy_keys(a.filter("k is null"), "k") == [] and heavy_keys(a.limit(0), "k") == []
    expected = rows_of(a.join(b, a.k == b.key))
    for limit in (1 << 20, 1):
        joined = heavy_key_join(a, b, "k", "key", least_share=0.1, max_broadcast_bytes=limit)
        assert joined.columns == ["k", "i", "key", "name"] and rows_of(joined) == expected
        assert ("BroadcastHashJoin" in plan_operators(joined)) == (limit > 1)
        assert "SortMergeJoin" in plan_operators(joined)
    assert rows_of(heavy_key_join(a.filter("k <> 5"), b, "k", "key", 0.1)) == rows_of(a.filter("k <> 5").join(b, a.k == b.key))
    assert joins.SALTS > 1


def test_no_task_reads_a_heavy_key_alone(spark):
    left = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 5000).alias("k"), "id").repartition(8)
    right = spark.range(5000).select(F.col("id").alias("key"))
    # small partitions stay apart, as large ones would
    with session_settings(spark, {"spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        joined = heavy_key_join(left, right, "k", "key").select(F.spark_partition_id().alias("p"))
        sizes = sorted(r["count"] for r in joined.groupBy("p").count().collect())
    assert sizes[-1] <= 2 * sizes[len(sizes) // 2]


@pytest.mark.parametrize("spread", [1, 300])
def test_averages_do_not_depend_on_partitions(spark, spread):
    rng = random.Random(spread)
    rows = [(i % 3, rng.uniform(-1, 1) * 10.0 ** rng.randint(-spread, spread)) for i in range(3000)]
    rows += [(3, None), (3, float("nan")), (4, 0.0), (4, -0.0), (5, 1e308), (5, 1e308), (6, float("inf")), (7, 5e-324), (7, 2.0**32)]
    df = spark.createDataFrame(rows, "k int, v double")
    found = set()
    for n in (1, 7, 200):
        out = reproducible_avg(df.repartition(n), "k", "v", "a", "n").orderBy("k").collect()
        found.add(tuple((r["k"], None if r["a"] is None else r["a"].hex(), r["n"]) for r in out))
    assert len(found) == 1
    from math import fsum

    got = {k: (None if a is None else float.fromhex(a), n) for k, a, n in found.pop()}
    for k in range(3):
        values = [v for key, v in rows if key == k]
        assert got[k][1] == len(values) and got[k][0] == pytest.approx(fsum(values) / len(values), rel=1e-14)
    assert 3 not in got and got[4] == (0.0, 2) and got[6][0] is None and got[7][0] == 2.0**31


LABELS = ["None", None, "it's (\"a\"), 'b')", "back\\slash\\n\\x27", "two\nlines\r", "", "label", "é\\", "('label', 'n')", "\\"]


def test_tuple_text_keeps_every_value(spark, tmp_path):
    rows = [(t, u, i) for i, t in enumerate(LABELS) for u in LABELS]
    rows.append(("label", "other", None))
    df = spark.createDataFrame(rows, "label string, other string, n int")
    # with text columns only, a row can read like the header
    for columns, quoted in ((["label", "other"], [True, True]), (["label", "n"], [True, False]), (["label"], [True])):
        out = str(tmp_path / "-".join(columns))
        write_tuple_text(df.select(*columns), out, columns, quoted)
        back = read_tuple_text(spark, out, columns, quoted)
        assert rows_of(back) == rows_of(df.select(*[F.col(c).cast("string") for c in columns]))
    spark.createDataFrame([("no tuple",)], "value string").write.text(str(tmp_path / "wrong"))
    with pytest.raises(Exception, match="not a tuple"):
        read_tuple_text(spark, str(tmp_path / "wrong"), ["a"], [True]).collect()


def test_a_verified_conversion_and_a_lost_part(spark, tmp_path, monkeypatch):
    rows = [(i % 50, None if i % 7 == 0 else f"t{i}") for i in range(1000)]
    df = spark.createDataFrame(rows, "k int, t string").repartition(4)
    n, checksum = convert_verified(df, str(tmp_path / "a"))
    again = convert_verified(df.repartition(1).orderBy("t"), str(tmp_path / "b"))
    assert (n, checksum) == again and n == 1000
    assert convert_verified(df.unionByName(df.limit(1)), str(tmp_path / "c")) != again
    assert convert_verified(df.limit(0), str(tmp_path / "d")) == (0, 0)

    def losing(frame, out):
        write_parquet(frame, out)
        next(f for f in (tmp_path / "e").glob("part-*.parquet")).unlink()

    monkeypatch.setattr(sinks, "write_parquet", losing)
    with pytest.raises(ConversionError, match="wrote 1000 rows"):
        convert_verified(df, str(tmp_path / "e"))

    def truncating(frame, out):
        write_parquet(frame, out)
        part = next(f for f in (tmp_path / "f").glob("part-*.parquet"))
        part.write_bytes(part.read_bytes()[:-20])

    monkeypatch.setattr(sinks, "write_parquet", truncating)
    with pytest.raises(Exception):
        convert_verified(df, str(tmp_path / "f"))


def test_paths_of_another_file_system(spark, tmp_path):
    hadoop = spark._jsc.hadoopConfiguration()
    hadoop.set("fs.viewfs.mounttable.urban.link./data", tmp_path.as_uri())
    base = "viewfs://urban/data"
    df = spark.createDataFrame([(1, "a\nb"), (2, None)], "k int, t string")
    write_result(df, f"{base}/csv", newlines="quote")
    back = read_csv(spark, f"{base}/csv", quoted_newlines=True)
    assert rows_of(back) == rows_of(df.select(F.col("k").cast("string"), "t"))
    assert convert_verified(df, f"{base}/parquet")[0] == 2 and (tmp_path / "parquet").exists()
