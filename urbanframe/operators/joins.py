"""Equi-joins with a selectable physical strategy, and cross-join cardinality.

Strategies map to Spark join hints:

=============  ==========================  ==========================================
strategy       physical operator           notes
=============  ==========================  ==========================================
default        chosen by Catalyst + AQE    broadcast when the side's size estimate
                                           (from its files) is under
                                           ``spark.sql.autoBroadcastJoinThreshold``, or
                                           when AQE measures its shuffle output under
                                           the adaptive threshold; else sort-merge
broadcast      BroadcastHashJoin           only after the right side is measured to hold
                                           at most ``max_broadcast_bytes``; otherwise
                                           ``merge`` (logged)
merge          SortMergeJoin               scales to any size; AQE splits skewed keys
shuffle_hash   ShuffledHashJoin            no sort; builds a hash table per partition
=============  ==========================  ==========================================

A replicated nested-loop (Cartesian) strategy is deliberately not offered: it
materialises every pair of rows, which does not survive large inputs.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

JOIN_STRATEGIES = ("default", "broadcast", "merge", "shuffle_hash")
DEFAULT_MAX_BROADCAST_BYTES = 64 << 20
_log = logging.getLogger(__name__)


def measured_bytes(df: DataFrame) -> int:
    """Size of ``df`` in memory, measured: rows times fixed widths plus the text and nested data.

    One partial + final aggregation over the frame; no row is moved.
    """
    fixed, varying = 16, []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType)):
            fixed += 8
        else:
            fixed += 16
            c = F.col(f"`{f.name}`")
            if not isinstance(f.dataType, (T.StringType, T.BinaryType)):
                c = F.to_json(F.struct(c))
            varying.append(F.coalesce(F.octet_length(c), F.lit(0)).cast("long"))
    width = F.lit(fixed).cast("long")
    for w in varying:
        width = width + w
    return int(df.select(width.alias("w")).agg(F.sum("w").alias("w")).first()["w"] or 0)


def checked_broadcast(df: DataFrame, max_bytes: int = DEFAULT_MAX_BROADCAST_BYTES) -> DataFrame | None:
    """``broadcast(df)`` if its measured size is at most ``max_bytes``, else ``None``."""
    return F.broadcast(df) if measured_bytes(df) <= max_bytes else None


def with_strategy(
    right: DataFrame, strategy: str, max_broadcast_bytes: int = DEFAULT_MAX_BROADCAST_BYTES
) -> DataFrame:
    """Mark the build (right) side of a join with the requested strategy.

    A side too large to broadcast is merged instead; that choice is logged.
    """
    if strategy not in JOIN_STRATEGIES:
        raise ValueError(f"unknown join strategy {strategy!r}; choose one of {JOIN_STRATEGIES}")
    if strategy == "default":
        return right
    if strategy == "broadcast":
        small = checked_broadcast(right, max_broadcast_bytes)
        if small is None:
            _log.warning("join side is larger than %d bytes: merge join instead of broadcast", max_broadcast_bytes)
            return right.hint("merge")
        return small
    return right.hint(strategy)


def equi_join(
    left: DataFrame,
    right: DataFrame,
    left_keys: str | Sequence[str],
    right_keys: str | Sequence[str],
    strategy: str = "default",
    how: str = "inner",
    max_broadcast_bytes: int = DEFAULT_MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Join on ``left_keys[i] == right_keys[i]`` (names may differ on each side).

    Duplicate keys on either side multiply, as in any relational join.
    """
    lk = [left_keys] if isinstance(left_keys, str) else list(left_keys)
    rk = [right_keys] if isinstance(right_keys, str) else list(right_keys)
    if len(lk) != len(rk):
        raise ValueError("left and right key lists differ in length")
    r = with_strategy(right, strategy, max_broadcast_bytes)
    cond = [left[a] == r[b] for a, b in zip(lk, rk)]
    return left.join(r, cond, how)


SALTS = 32


def heavy_keys(df: DataFrame, key: str, least_share: float = 0.01) -> list:
    """Values of ``key`` that hold ``least_share`` of the rows or more (NULL left out), at most ``1 / least_share``.

    One pass with a mergeable summary of frequent items: every such value is in it, and
    nothing but the summaries is shuffled.  Its counts are upper bounds, so a value
    slightly below the share may be listed too.
    """
    tracked = 1 << max(3, math.ceil(math.log2(8 / least_share)))
    listed = math.ceil(1 / least_share)
    found = df.filter(F.col(f"`{key}`").isNotNull()).agg(
        F.expr(f"approx_top_k(`{key}`, {listed}, {tracked})").alias("top"), F.count(F.lit(1)).alias("n")
    ).first()
    return [r["item"] for r in found["top"] or [] if r["count"] >= least_share * found["n"]]


def heavy_key_join(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    least_share: float = 0.01,
    max_broadcast_bytes: int = DEFAULT_MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Inner equi-join of two large sides, some of whose left keys hold a large share of the rows.

    The rows of heavy keys do not travel: their right rows are broadcast if measured to
    fit, and the left rows join where they lie.  All other rows are merge-joined.  If the
    right rows of heavy keys do not fit, both are dealt over ``SALTS`` parts of each key,
    the right rows once for each part.
    """
    heavy = heavy_keys(left, left_key, least_share)
    same = left[f"`{left_key}`"] == right[f"`{right_key}`"]
    if not heavy:
        return left.join(right.hint("merge"), same)
    few = F.col(f"`{left_key}`").isin(heavy), F.col(f"`{right_key}`").isin(heavy)
    rest = left.filter(~few[0]).join(right.filter(~few[1]).hint("merge"), same)
    heavy_right = right.filter(few[1])
    small = checked_broadcast(heavy_right, max_broadcast_bytes)
    if small is not None:
        return left.filter(few[0]).join(small, same).unionByName(rest)
    salted = left.filter(few[0]).withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    parts = heavy_right.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    both = (salted[f"`{left_key}`"] == parts[f"`{right_key}`"]) & (F.col("_salt") == F.col("_part"))
    return salted.join(parts.hint("merge"), both).drop("_salt", "_part").unionByName(rest)


def cross_join_count(left: DataFrame, right: DataFrame, name: str = "pairs") -> DataFrame:
    """Number of rows a cross join of ``left`` and ``right`` would produce.

    Computed as count(left) * count(right) in a single aggregation over a tagged
    union, so no pair is ever materialised and no join is planned.
    """
    tagged = left.select(F.lit(0).alias("_side")).unionByName(right.select(F.lit(1).alias("_side")))
    return tagged.agg(
        (F.count_if(F.col("_side") == 0) * F.count_if(F.col("_side") == 1)).alias(name)
    )
