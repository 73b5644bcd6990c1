"""Exact lower median (``percentile_disc(0.5)``) per group without one-task groups.

Spark's ``percentile_disc`` keeps every distinct value of a group in one task's
memory.  Here the k-th smallest value (k = ceil(n / 2), NULLs ignored) is bracketed
instead, by the same steps at every size:

* a mergeable quantile sketch of the values still in question (bounded memory per
  group and task) gives two split values just below and above rank k;
* one exact count of the values below, at, between and above the two splits tells
  where rank k lies: at a split (done) or in one of the open intervals, which is
  what remains in question.

Both are partial + final aggregations.  Every pass removes at least the least and
the greatest remaining value, so the search always ends; a pass cuts the rows in
question by a factor of hundreds whatever their distribution, and a sketch that
still holds every value ends it at once.

Infinite and NaN values are placed by count (they order as -Infinity < finite <
+Infinity < NaN, as in Spark) and never enter the search.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urbanframe.operators.joins import DEFAULT_MAX_BROADCAST_BYTES, measured_bytes
from urbanframe.session import materialize

ACCURACY = 10_000  # samples a sketch may hold
# ranks asked of a sketch: evenly spaced ones, and dense ones around the middle
_RANKS = sorted({i / 200 for i in range(201)} | {0.5 + s * d for s in (-1, 1) for d in (1e-4, 3e-4, 1e-3, 2e-3)})


def _typed(df: DataFrame, value: str) -> tuple[Column, T.DataType]:
    """The value column in its own numeric type; text is read as a double (bad text: NULL)."""
    kind = df.schema[value].dataType
    if isinstance(kind, T.NumericType):
        return F.col(value), kind
    if isinstance(kind, T.StringType):
        return F.col(value).try_cast("double"), T.DoubleType()
    raise TypeError(f"lower_median needs a numeric or text column, not {kind.simpleString()}")


def _attach(data: DataFrame, state: DataFrame, keys: list[str], small: bool) -> DataFrame:
    """Join per-group state to ``data`` (NULL-safe on the keys)."""
    s = state.withColumnsRenamed({k: f"_s_{k}" for k in keys})
    s = F.broadcast(s) if small else s
    cond = [data[k].eqNullSafe(s[f"_s_{k}"]) for k in keys]
    return data.join(s, cond, "inner").drop(*[f"_s_{k}" for k in keys])


def lower_median(
    df: DataFrame,
    keys: str | Sequence[str],
    value: str,
    name: str = "median",
    count_name: str | None = None,
    accuracy: int = ACCURACY,
    max_broadcast_bytes: int = DEFAULT_MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Per group: the discrete lower median of ``value`` (and optionally its count).

    Equals ``percentile_disc(0.5) WITHIN GROUP (ORDER BY value)``: for 1, 2, 3, 10
    it is 2, not the interpolated 2.5.  The result keeps the type of ``value``
    (text: double).  Groups whose values are all NULL are absent.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    column, kind = _typed(df, value)
    v, lo, hi, k = (F.col(c) for c in ("_v", "_lo", "_hi", "_k"))
    values = df.select(*keys, column.alias("_v")).filter(v.isNotNull())
    data, state = values, None
    middle = F.ceil(F.col("_n") / 2)
    none = F.lit(None).cast(kind)
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        infinity = F.lit(float("inf")).cast(kind)
        finite = ~F.isnan(v) & (F.abs(v) < infinity)
        data = values.filter(finite)
        stats = values.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("_n"),
            F.count_if(v == -infinity).alias("_c0"),
            F.count_if(finite).alias("_c1"),
            F.count_if(v == infinity).alias("_c2"),
        )
        c0, c1, c2 = F.col("_c0"), F.col("_c1"), F.col("_c2")
        found = (
            F.when(middle <= c0, -infinity)
            .when(middle <= c0 + c1, none)
            .when(middle <= c0 + c1 + c2, infinity)
            .otherwise(F.lit(float("nan")).cast(kind))
        )
        state = stats.select(*keys, "_n", (middle - c0).alias("_k"), none.alias("_lo"), none.alias("_hi"), found.alias("_ans"))
    else:
        stats = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        state = stats.select(*keys, "_n", middle.alias("_k"), none.alias("_lo"), none.alias("_hi"), none.alias("_ans"))
    state = materialize(state, "median-state")
    # one row a group, now and in every pass; a pass carries a sketch answer of len(_RANKS) doubles as well
    small = measured_bytes(state) * 2 * len(_RANKS) <= max_broadcast_bytes

    while True:
        open_ = state.filter(F.col("_ans").isNull())
        if open_.isEmpty():
            break
        inside = (lo.isNull() | (v > lo)) & (hi.isNull() | (v < hi))
        rows = _attach(data, open_.select(*keys, "_lo", "_hi"), keys, small).filter(inside)
        # integers and decimals are sketched relative to the interval's lower end: a
        # double then tells neighbours apart once the interval is narrow
        base = F.coalesce(lo, F.lit(0)).cast("decimal(38,0)") if not isinstance(kind, T.FractionalType) else None
        x = v if base is None else v.cast("decimal(38,0)") - base
        sketch = rows.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("_m"),
            F.min(v).alias("_min"),
            F.max(v).alias("_max"),
            F.percentile_approx(x.cast("double"), _RANKS, accuracy).alias("_q"),
        )
        sketch = _attach(sketch, open_.select(*keys, "_k", "_lo"), keys, small)

        # the last asked rank below k and the first above it
        ranks = F.array(*[F.lit(r) for r in _RANKS])
        below = F.size(F.filter(ranks, lambda r: r * F.col("_m") < k - F.col("_m") / accuracy))
        above = F.size(F.filter(ranks, lambda r: r * F.col("_m") < k + F.col("_m") / accuracy)) + 1

        def split(at: Column, up: bool) -> Column:
            q = F.element_at("_q", F.greatest(F.lit(1), F.least(at, F.lit(len(_RANKS)))))
            if base is not None:
                q = (F.ceil(q) if up else F.floor(q)).cast("decimal(38,0)") + base
            return F.greatest(F.col("_min"), F.least(F.col("_max"), q.try_cast(kind)))

        splits = sketch.select(*keys, split(below, False).alias("_a"), split(above, True).alias("_b"))
        a, b = F.col("_a"), F.col("_b")
        both = _attach(rows.drop("_lo", "_hi"), splits, keys, small)
        counts = both.groupBy(*keys, "_a", "_b").agg(
            F.count_if(v < a).alias("_c0"),
            F.count_if(v == a).alias("_c1"),
            F.count_if((v > a) & (v < b)).alias("_c2"),
            F.count_if((v == b) & (b > a)).alias("_c3"),
        )
        c = _attach(counts, open_.select(*keys, "_n", "_k", "_lo", "_hi"), keys, small)
        e0 = F.col("_c0")
        e1 = e0 + F.col("_c1")
        e2 = e1 + F.col("_c2")
        e3 = e2 + F.col("_c3")
        stepped = c.select(
            *keys,
            "_n",
            F.when(k <= e0, k).when(k <= e2, k - e1).otherwise(k - e3).alias("_k"),
            F.when(k <= e0, lo).when(k <= e2, a).otherwise(b).alias("_lo"),
            F.when(k <= e0, a).when(k <= e2, b).otherwise(hi).alias("_hi"),
            F.when((k > e0) & (k <= e1), a).when((k > e2) & (k <= e3), b).otherwise(none).alias("_ans"),
        )
        state = materialize(state.filter(F.col("_ans").isNotNull()).unionByName(stepped), "median-state")

    out = state.select(*keys, F.col("_ans").alias(name), "_n")
    return out.withColumnRenamed("_n", count_name) if count_name else out.drop("_n")
