"""Window operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k_per_group(
    df: DataFrame,
    partition_by: str | Sequence[str],
    order_by: Sequence[Column],
    k: int,
    rank_name: str = "ranking",
) -> DataFrame:
    """Rows whose ``rank()`` within their group is <= k; ties are all kept.

    So a group can return more than ``k`` rows.  The ``rank <= k`` filter directly
    on the window output lets Catalyst plan a ``WindowGroupLimit`` before *and*
    after the shuffle: every map task keeps at most the top-k (plus ties) of each
    group, so even a group holding a third of the input ships only a handful of rows.
    """
    parts = [partition_by] if isinstance(partition_by, str) else list(partition_by)
    w = Window.partitionBy(*parts).orderBy(*order_by)
    return df.withColumn(rank_name, F.rank().over(w)).filter(F.col(rank_name) <= k)


def top_k_with_ties(
    df: DataFrame,
    partition_by: str | Sequence[str],
    order_by: str | Sequence[str],
    k: int,
    descending: bool = True,
    rank_name: str = "ranking",
) -> DataFrame:
    """As :func:`top_k_per_group`, ordered by the columns ``order_by``, for groups of any number of ties.

    No group is sorted or gathered: tied rows collapse to one (group, order values) row
    with their number before the first shuffle, of which the ``k`` best of a group are
    kept map-side; ranks follow from the numbers, and the rows come back by an equi-join
    on group and order values.  Its left side is an exchange that AQE splits when one
    tied value holds many rows.  NULL order values rank last, as largest or least.
    """
    parts = [partition_by] if isinstance(partition_by, str) else list(partition_by)
    by = [order_by] if isinstance(order_by, str) else list(order_by)
    keys = [*parts, *by]
    names = [f"_key{i}" for i in range(len(keys))]
    values = df.groupBy(*[F.col(f"`{c}`").alias(n) for c, n in zip(keys, names)]).agg(F.count(F.lit(1)).alias("_n"))
    order = [(F.desc_nulls_last if descending else F.asc_nulls_last)(n) for n in names[len(parts) :]]
    group = Window.partitionBy(*names[: len(parts)]).orderBy(*order)
    best = values.withColumn("_row", F.row_number().over(group)).filter(F.col("_row") <= k)
    above = F.sum("_n").over(group.rowsBetween(Window.unboundedPreceding, -1))
    ranks = best.withColumn(rank_name, (F.coalesce(above, F.lit(0)) + 1).cast("int")).filter(F.col(rank_name) <= k)
    same = [df[f"`{c}`"].eqNullSafe(F.col(n)) for c, n in zip(keys, names)]
    return df.join(ranks.select(*names, rank_name), same).drop(*names)
