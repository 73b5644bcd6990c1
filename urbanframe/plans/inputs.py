"""Query inputs derived by Spark from the benchmark tables.

The benchmark tables carry no crimes, stations, census blocks or incomes, so each
input is computed from a table's keys by plain arithmetic (the same arithmetic the
SQL oracle evaluates).  The derivations are projections only: every row of the
source table is used, so the work grows with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanframe.functions.scalars import format_timestamp, money_text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def crimes_with_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> ``Premis Desc`` (= event_type; ``click`` plays STREET) and ``TIME OCC`` text.

    HHMM = (event_id * 37) mod 2500, zero-padded to four digits, so the gaps between
    periods and the out-of-range values 2400-2499 all occur.
    """
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("DR_NO"),
        F.col("event_type").alias("Premis Desc"),
        F.lpad(((F.col("event_id") * 37) % 2500).cast("string"), 4, "0").alias("TIME OCC"),
    )


def crimes_with_dates(spark: SparkSession, sf_dir: str, bad_every: int | None = None) -> DataFrame:
    """orders -> ``DATE OCC`` text in the crime format (``yyyy MMM dd hh:mm:ss a``).

    With ``bad_every``, orders whose key is a multiple of it get the text ``bad``.
    """
    o = table(spark, sf_dir, "orders")
    text = format_timestamp("o_orderdate")
    if bad_every:
        text = F.when(F.col("o_orderkey") % bad_every == 0, F.lit("bad")).otherwise(text)
    return o.select(F.col("o_orderkey").alias("DR_NO"), text.alias("DATE OCC"))


def census_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer -> blocks ``ZCTA20, POP20, HOUSING20``.

    ZIP = 90000 + nation key (nation 3 has no ZIP), population = custkey mod 97,
    housing units = custkey mod 31.
    """
    c = table(spark, sf_dir, "customer")
    zip_code = F.when(F.col("c_nationkey") == 3, F.lit(None).cast("string")).otherwise(
        F.lpad((F.col("c_nationkey") + 90000).cast("string"), 5, "0")
    )
    return c.select(
        zip_code.alias("ZCTA20"),
        (F.col("c_custkey") % 97).alias("POP20"),
        (F.col("c_custkey") % 31).alias("HOUSING20"),
    )


def zip_income(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation -> income ``Zip Code, Estimated Median Income`` as money text.

    Nation 5 has ``N/A`` (unparseable), nation 6 ``$0``, others $30,000 + 1,711 x key.
    """
    n = table(spark, sf_dir, "nation")
    text = (
        F.when(F.col("n_nationkey") == 5, F.lit("N/A"))
        .when(F.col("n_nationkey") == 6, F.lit("$0"))
        .otherwise(money_text(F.col("n_nationkey") * 1711 + 30000))
    )
    return n.select(
        F.lpad((F.col("n_nationkey") + 90000).cast("string"), 5, "0").alias("Zip Code"),
        text.alias("Estimated Median Income"),
    )


def crime_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem -> crime points ``DR_NO, LAT, LON`` spread over a 72 x 48 km box.

    The id is the order key, so an order's line items share an id and the id keeps
    only its closest (point, station) pair.
    """
    li = table(spark, sf_dir, "lineitem")
    ok, ln = F.col("l_orderkey"), F.col("l_linenumber")
    lat = F.lit(33.70) + ((ok * 7919 + ln * 104729) % 10007) / F.lit(10007.0) * F.lit(0.65)
    lon = F.lit(-118.67) + ((ok * 104729 + ln * 7919) % 10009) / F.lit(10009.0) * F.lit(0.52)
    return li.select(ok.alias("DR_NO"), lat.alias("LAT"), lon.alias("LON"))


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier -> stations ``DIVISION`` (= s_name), ``Y`` (lat), ``X`` (lon); all suppliers."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    lat = F.lit(33.72) + ((k * 613) % 1009) / F.lit(1009.0) * F.lit(0.60)
    lon = F.lit(-118.60) + ((k * 977) % 1013) / F.lit(1013.0) * F.lit(0.45)
    return s.select(F.col("s_name").alias("DIVISION"), lat.alias("Y"), lon.alias("X"))


def island_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer -> ``c_custkey, LAT, LON`` with NULL and zero coordinates mixed in."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    lat = F.when(k % 11 == 0, F.lit(None).cast("double")).otherwise((k % 3).cast("double"))
    return c.select(k, lat.alias("LAT"), (k % 5).cast("double").alias("LON"))


def nation_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation -> 25 stations ``DIVISION`` (= n_name), ``Y``, ``X`` on a 25 x 25 lattice of the box."""
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    lat = F.lit(33.72) + ((k * 7) % 25) / F.lit(25.0) * F.lit(0.60)
    lon = F.lit(-118.60) + ((k * 11) % 25) / F.lit(25.0) * F.lit(0.45)
    return n.select(F.col("n_name").alias("DIVISION"), lat.alias("Y"), lon.alias("X"))


def hostile_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> crimes whose time text is over-long, signed, blank, padded or no number.

    One is padded by a no-break space, which is no blank and makes it no number.
    """
    ev = table(spark, sf_dir, "events")
    k = F.col("event_id")
    odd = {0: "3000000000", 1: "99999999999", 2: "-5", 3: "noon", 4: "", 5: "  930 ", 6: "\u00a01230"}
    text = F.lpad(((k * 37) % 2500).cast("string"), 4, "0")
    for rest, value in odd.items():
        text = F.when(k % 8 == rest, F.lit(value)).otherwise(text)
    return ev.select(F.col("event_type").alias("Premis Desc"), text.alias("TIME OCC"))


def hostile_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders -> ``key`` (NULL for every fifth), ``o_custkey`` and a ``note`` that CSV finds hard."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    odd = {0: 'a "b", c', 1: "one\ntwo\rx", 2: "  blanks  ", 3: 'back\\slash \\n, "end\\', 4: None, 5: "a\0b\\0"}
    note = F.concat("o_orderpriority", F.lit(";"), k.cast("string"))
    for rest, value in odd.items():
        note = F.when(k % 7 == rest, F.lit(value)).otherwise(note)
    return o.select(F.when(k % 5 != 0, k).alias("key"), "o_custkey", note.alias("note"))


def hostile_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders -> ``label, value``: labels that are hard to write as a Python tuple."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    odd = {0: "None", 1: None, 2: "it's (\"a\"), 'b')", 3: "back\\slash\\n\\x27", 4: "two\nlines\r", 5: ""}
    label = F.col("o_orderpriority")
    for rest, value in odd.items():
        label = F.when(k % 7 == rest, F.lit(value)).otherwise(label)
    return o.select(label.alias("label"), F.col("o_custkey").cast("double").alias("value"))


def wide_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders -> ``g``, ``v``: both ends of the doubles and powers of ten from -300 to 299."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 4
    power = F.concat(F.lit("1e"), (F.col("o_custkey") % 600 - 300).cast("string")).cast("double")
    v = F.when(k == 0, F.lit(1.7e308)).when(k == 1, F.lit(-1.7e308)).otherwise(power)
    return o.select(F.col("o_orderpriority").alias("g"), v.alias("v"))


def clustered_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier -> stations, all but every fiftieth inside a patch of 0.03 degrees."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    spread = k % 50 == 0
    lat = F.lit(33.72) + ((k * 613) % 1009) / F.lit(1009.0) * F.when(spread, F.lit(0.60)).otherwise(F.lit(0.03))
    lon = F.lit(-118.60) + ((k * 977) % 1013) / F.lit(1013.0) * F.when(spread, F.lit(0.45)).otherwise(F.lit(0.03))
    return s.select(F.col("s_name").alias("DIVISION"), lat.alias("Y"), lon.alias("X"))
