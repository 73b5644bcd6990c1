"""Grouped aggregations: share of total, argmin, keyed sums, count filters.

All of these plan as partial (map-side) + final aggregation, so a key that holds a
large fraction of the rows is reduced to one row per map task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _names(cols: str | Sequence[str]) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def share_of_total(
    df: DataFrame,
    key: str,
    value_name: str = "percentage",
    digits: int = 2,
    keep_null_key: bool = True,
) -> DataFrame:
    """Rows per ``key`` as a percentage of all rows, rounded HALF_UP.

    One query: the group counts are a partial + final aggregation, and the grand
    total is a scalar subquery summing those counts (it reuses the same shuffle).
    No window over all groups, so a key with millions of values never meets in
    one task.  The denominator always counts every input row, including rows whose
    key is NULL; ``keep_null_key=False`` drops the NULL-key row from the output only.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    out = counts.select(
        F.col(key),
        F.round(F.col("_n") / total * F.lit(100), digits).alias(value_name),
    )
    if not keep_null_key:
        out = out.filter(F.col(key).isNotNull())
    return out


def argmin(
    df: DataFrame,
    keys: str | Sequence[str],
    value: str,
    carry: str | Sequence[str],
    struct_name: str = "_best",
) -> DataFrame:
    """Per key, the row with the smallest ``value``; ties -> smallest ``carry``.

    ``min(struct(value, carry...))`` compares field by field, so the smallest value
    wins and equal values fall back to the carried columns.  Rows whose ``value`` is
    NULL are ignored (a NULL field would otherwise sort *first* inside the struct and
    win every group).  The aggregate is partial + final, so one huge key is reduced
    map-side before the shuffle.  A key whose values are all NULL yields NULLs.
    """
    key_cols = _names(keys)
    carry_cols = _names(carry)
    packed = F.when(F.col(value).isNotNull(), F.struct(value, *carry_cols))
    return df.groupBy(*key_cols).agg(F.min(packed).alias(struct_name)).select(
        *key_cols,
        F.col(f"{struct_name}.{value}").alias(value),
        *[F.col(f"{struct_name}.{c}").alias(c) for c in carry_cols],
    )


def keyed_sums(
    df: DataFrame, keys: str | Sequence[str], sums: dict[str, Column | str]
) -> DataFrame:
    """``groupBy(keys)`` with one ``sum`` per output name (the keyed reduce)."""
    aggs = [
        F.sum(F.col(expr) if isinstance(expr, str) else expr).alias(name)
        for name, expr in sums.items()
    ]
    return df.groupBy(*_names(keys)).agg(*aggs)


def count_at_least(df: DataFrame, keys: str | Sequence[str], minimum: int, name: str = "n") -> DataFrame:
    """Group count with a HAVING ``count >= minimum`` filter."""
    return (
        df.groupBy(*_names(keys))
        .agg(F.count(F.lit(1)).alias(name))
        .filter(F.col(name) >= minimum)
    )


_BIN_BITS = 32  # exponents that share a bin
_HALF = 42  # bits of the lower part of a scaled value


def reproducible_avg(df: DataFrame, keys: str | Sequence[str], value: str, name: str, count_name: str) -> DataFrame:
    """Per key: the average of a double column, the same to the last bit however the rows are partitioned, and its count.

    A sum of doubles depends on the order of the additions.  Here every value falls into a
    bin of 32 binary exponents, in whose unit it is an integer below 2**84; two halves of
    it are summed exactly as decimals, and the bins, 66 a key at most, are added from the
    largest down.  NULL and NaN values are left out; infinite ones give NULL.
    """
    key_cols = _names(keys)
    v = F.col(f"`{value}`")
    rows = df.filter(v.isNotNull() & ~F.isnan(v))
    infinite = F.max(F.abs(v) == F.lit(float("inf")))
    finite = F.when(F.abs(v) < F.lit(float("inf")), v).otherwise(0.0)
    exponent = F.when(finite == 0, F.lit(0)).otherwise(F.floor(F.log2(F.abs(finite)))).cast("int")
    # a logarithm may round up to the next exponent; two spare bits below the bin absorb that
    bin_ = F.floor(exponent / F.lit(float(_BIN_BITS))).cast("int")
    unit = F.col("_bin") * _BIN_BITS - 54
    # powers of two in two steps, as 2**-(unit) may be beyond the range of doubles
    first = F.floor(unit / F.lit(2.0))
    scaled = finite * F.pow(F.lit(2.0), -first) * F.pow(F.lit(2.0), -(unit - first))
    high = F.floor(F.col("_scaled") / F.lit(float(1 << _HALF)))
    binned = rows.withColumn("_bin", bin_).withColumn("_scaled", scaled).withColumn("_high", high)
    low = F.col("_scaled") - F.col("_high") * F.lit(float(1 << _HALF))
    parts = binned.groupBy(*key_cols, "_bin").agg(
        F.sum(F.col("_high").cast("long").cast("decimal(38,0)")).alias("_h"),
        F.sum(low.cast("long").cast("decimal(38,0)")).alias("_l"),
        F.count(F.lit(1)).alias("_n"),
        infinite.alias("_inf"),
    )
    whole = (F.col("_h") * F.lit(1 << _HALF) + F.col("_l")).cast("double")
    bins = F.sort_array(F.collect_list(F.struct("_bin", whole.alias("whole"))), asc=False)
    gathered = parts.groupBy(*key_cols).agg(bins.alias("_bins"), F.sum("_n").alias(count_name), F.max("_inf").alias("_inf"))

    def added(total: Column, part: Column) -> Column:
        unit = part["_bin"] * _BIN_BITS - 54
        first = F.floor(unit / F.lit(2.0))
        # divided first, as the sum may be beyond the range of doubles
        return total + part["whole"] / F.col(count_name) * F.pow(F.lit(2.0), first) * F.pow(F.lit(2.0), unit - first)

    average = F.when(~F.col("_inf"), F.aggregate("_bins", F.lit(0.0), added))
    return gathered.select(*key_cols, average.alias(name), count_name)
