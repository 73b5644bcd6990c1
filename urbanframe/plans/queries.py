"""The four composite queries, as functions of input DataFrames.

Column names default to the crime / station / census / income datasets the
queries were written for; every one can be overridden.  Each function returns a
lazy DataFrame and performs no I/O of its own (the nearest-site query writes
its per-pass results to the shared checkpoint folder).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanframe.functions.scalars import CRIME_TS_FORMAT, parse_money, parse_timestamp, time_of_day, to_long
from urbanframe.functions.udfs import time_of_day_udf
from urbanframe.operators.aggregate import keyed_sums, share_of_total
from urbanframe.operators.joins import DEFAULT_MAX_BROADCAST_BYTES, equi_join
from urbanframe.operators.spatial import nearest_site, nearest_site_summary
from urbanframe.operators.window import top_k_per_group

# ---------------------------------------------------------------------------
# Column names of the source datasets (the queries' defaults)
#   crimes:        DR_NO, DATE OCC, TIME OCC, Premis Desc, LAT, LON
#   stations:      DIVISION, X (longitude), Y (latitude)
#   census blocks: ZCTA20, POP20, HOUSING20 (GeoJSON feature properties)
#   income:        Zip Code, Estimated Median Income
#   street premises value: STREET; months kept per year: 3
# ---------------------------------------------------------------------------
CRIME_ID, CRIME_DATE, CRIME_TIME, CRIME_PREMISES, CRIME_LAT, CRIME_LON = (
    "DR_NO", "DATE OCC", "TIME OCC", "Premis Desc", "LAT", "LON"
)
STATION_NAME, STATION_LON, STATION_LAT = "DIVISION", "X", "Y"
BLOCK_ZIP, BLOCK_POPULATION, BLOCK_HOUSING = "ZCTA20", "POP20", "HOUSING20"
INCOME_ZIP, INCOME_VALUE = "Zip Code", "Estimated Median Income"
STREET = "STREET"
TOP_MONTHS = 3


# --------------------------------------------------------------------------- Q1
def street_time_share(
    crimes: DataFrame,
    premis_col: str = CRIME_PREMISES,
    premis_value: str = STREET,
    time_col: str = CRIME_TIME,
    bucket: str = "native",
    keep_unclassified: bool = True,
) -> DataFrame:
    """Share (%) of crimes at ``premis_value`` per day period; ``day_period, percentage``.

    The premises test is an exact, case-sensitive match (pushed into the scan).
    Times in no period -- gaps such as 460-499, or malformed / missing text -- form
    a NULL ``day_period`` row; ``keep_unclassified=False`` leaves that row out, but
    the denominator always counts every matching crime.  ``bucket="udf"`` computes
    the same buckets with the Arrow-batched pandas UDF instead of the native CASE.
    """
    if bucket == "native":
        period = time_of_day(time_col)
    elif bucket == "udf":
        period = time_of_day_udf(F.col(time_col).cast("string"))
    else:
        raise ValueError("bucket must be 'native' or 'udf'")
    street = crimes.filter(F.col(premis_col) == F.lit(premis_value))
    shares = share_of_total(street.select(period.alias("day_period")), "day_period", keep_null_key=keep_unclassified)
    return shares.orderBy(F.desc("percentage"), F.asc_nulls_last("day_period"))


# --------------------------------------------------------------------------- Q2
def top_months(
    crimes: DataFrame, date_col: str = CRIME_DATE, k: int = TOP_MONTHS, fmt: str = CRIME_TS_FORMAT
) -> DataFrame:
    """Per year, the ``k`` months with most crimes (ties kept, so maybe more rows).

    Columns ``year, month, crime_total, ranking``; unparseable dates form a NULL
    year/month group.
    """
    ts = parse_timestamp(date_col, fmt)
    monthly = (
        crimes.select(F.year(ts).alias("year"), F.month(ts).alias("month"))
        .groupBy("year", "month")
        .agg(F.count(F.lit(1)).alias("crime_total"))
    )
    ranked = top_k_per_group(monthly, "year", [F.desc("crime_total")], k)
    return ranked.select("year", "month", "crime_total", "ranking").orderBy("year", "ranking", "month")


def top_months_sql(
    crimes: DataFrame, date_col: str = CRIME_DATE, k: int = TOP_MONTHS, fmt: str = CRIME_TS_FORMAT
) -> DataFrame:
    """Same result as :func:`top_months`, written as a SQL string over a temp view.

    Column name, format and ``k`` are bound parameters, and the timestamp is parsed
    once.  The keys get names of their own, so GROUP BY never binds to a same-named
    input column.
    """
    return crimes.sparkSession.sql(
        """
        WITH stamped AS (
            SELECT try_to_timestamp(IDENTIFIER(:date_col), :fmt) AS ts FROM {crimes}
        ), monthly AS (
            SELECT year(ts) AS y, month(ts) AS m, count(*) AS total FROM stamped GROUP BY ALL
        ), ranked AS (
            SELECT *, rank() OVER (PARTITION BY y ORDER BY total DESC) AS place FROM monthly
        )
        SELECT y AS year, m AS month, total AS crime_total, place AS ranking
        FROM ranked WHERE place <= :k ORDER BY y, place, m
        """,
        args={"date_col": "`" + date_col.replace("`", "``") + "`", "fmt": fmt, "k": int(k)},
        crimes=crimes,
    )


# --------------------------------------------------------------------------- Q3
def per_capita_income(
    blocks: DataFrame,
    income: DataFrame,
    strategy: str = "default",
    zip_col: str = BLOCK_ZIP,
    pop_col: str = BLOCK_POPULATION,
    housing_col: str = BLOCK_HOUSING,
    income_zip_col: str = INCOME_ZIP,
    income_col: str = INCOME_VALUE,
    min_income: float | None = None,
    max_broadcast_bytes: int = DEFAULT_MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Per ZIP: median household income x households / population, rounded to 2.

    Columns ``zipcode, per_capita_income``.  Blocks are summed per (trimmed) ZIP;
    empty ZIPs and ZIPs with population <= 0 are dropped; income text such as ``$52,806`` is
    parsed and unparseable rows dropped (``min_income`` additionally requires
    income > that value).  Duplicate ZIPs in the income table fan out.
    """
    key = F.trim(F.col(zip_col))
    people = blocks.filter(key != "").select(
        key.alias("zipcode"), to_long(pop_col).alias("people"), to_long(housing_col).alias("homes")
    )
    per_zip = keyed_sums(people, "zipcode", {"people": "people", "homes": "homes"}).filter("people > 0")
    dollars = parse_money(income_col)
    wanted = dollars.isNotNull() if min_income is None else dollars > F.lit(float(min_income))
    offers = income.filter(wanted & (F.trim(F.col(income_zip_col)) != "")).select(
        F.trim(F.col(income_zip_col)).alias("income_zip"), dollars.alias("dollars")
    )
    matched = equi_join(per_zip, offers, "zipcode", "income_zip", strategy, max_broadcast_bytes=max_broadcast_bytes)
    per_head = F.col("dollars") * F.coalesce("homes", F.lit(0)) / F.col("people")
    return matched.select("zipcode", F.round(per_head, 2).alias("per_capita_income")).orderBy("zipcode")


# --------------------------------------------------------------------------- Q4
def nearest_station_summary(
    crimes: DataFrame,
    stations: DataFrame,
    strategy: str = "default",
    crime_id: str = CRIME_ID,
    lat: str = CRIME_LAT,
    lon: str = CRIME_LON,
    division: str = STATION_NAME,
    station_lat: str = STATION_LAT,
    station_lon: str = STATION_LON,
    max_broadcast_bytes: int = DEFAULT_MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Per station division: crimes whose nearest station it is, and their mean distance.

    Columns ``division, average_distance, #`` (distance in km, rounded to 3).
    Crimes without coordinates or at exactly (0, 0) are ignored; a crime id that
    appears several times counts once, at its closest (crime, station) pair.
    """
    nearest = nearest_site(
        crimes, stations, crime_id, lat, lon, division, station_lat, station_lon,
        strategy=strategy, max_broadcast_bytes=max_broadcast_bytes,
    ).withColumnRenamed(division, "division")
    return nearest_site_summary(nearest, "division")
