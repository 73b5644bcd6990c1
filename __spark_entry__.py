"""

Every query reads the benchmark tables under ``sf_dir`` (inputs are derived from
them by arithmetic in :mod:`urbanframe.plans.inputs`) and runs over whole tables.
Each ``oracle_sql`` entry is the same computation written independently in SQL
for DuckDB; column names match the Spark result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanframe.functions.scalars import haversine_km, money_text, parse_money, parse_timestamp, time_of_day
from urbanframe.operators import (
    argmin,
    count_at_least,
    cross_join_count,
    equi_join,
    explode_array,
    extract_metric,
    heavy_key_join,
    json_fields,
    keyed_sums,
    lower_median,
    median_lines,
    reproducible_avg,
    top_k_per_group,
    top_k_with_ties,
    union_all,
)
from urbanframe.operators.spatial import clean_points
from urbanframe.plans import inputs
from urbanframe.plans.queries import (
    nearest_station_summary,
    per_capita_income,
    street_time_share,
    top_months,
    top_months_sql,
)
from urbanframe.plans.roundtrip import (
    BLOCK_PROPERTIES,
    convert_and_count,
    csv_folders,
    csv_parquet_round_trip,
    geojson_document_round_trip,
    geojson_round_trip,
    mixed_headers_round_trip,
    quoted_csv_round_trip,
    tuple_text_round_trip,
    verified_conversion,
    write_feature_collections,
)
from urbanframe.session import owned_path
from urbanframe.sources import parse_csv_lines, read_csv, read_geojson_properties, read_lines, read_table, write_result

try:  # the training-data operators are optional: everything else works without them
    import corpus_pipeline
    from urbanframe.llm import queries as llm_queries
except ImportError:  # the folder itself, or a library that only it needs, is missing
    llm_queries = None

SMOKE_DIR = "/root/testdata/sf0.001"
STRATEGIES = ("default", "broadcast", "merge", "shuffle_hash")


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: crimes per nearest station with mean distance, on sf0.001."""
    return q4_nearest(spark, SMOKE_DIR, "default")


# ------------------------------------------------------------------ the four queries
def q1_share(spark: SparkSession, sf_dir: str, bucket: str = "native", keep_unclassified: bool = True) -> DataFrame:
    # in the events table the premises column is the event type; "click" plays STREET
    crimes = inputs.crimes_with_times(spark, sf_dir)
    return street_time_share(
        crimes, premis_value="click", bucket=bucket, keep_unclassified=keep_unclassified
    )


def q1_share_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1 with CSV input: the crimes written as two CSV folders, read in one scan."""
    paths = csv_folders(spark, inputs.crimes_with_times(spark, sf_dir), "crimes-csv")
    return street_time_share(read_table(spark, paths, fmt="csv"), premis_value="click")


def q2_top_months(spark: SparkSession, sf_dir: str, form: str = "df") -> DataFrame:
    crimes = inputs.crimes_with_dates(spark, sf_dir)
    return top_months(crimes) if form == "df" else top_months_sql(crimes)


def q3_per_capita(spark: SparkSession, sf_dir: str, strategy: str = "default", min_income: float | None = None) -> DataFrame:
    return per_capita_income(
        inputs.census_blocks(spark, sf_dir), inputs.zip_income(spark, sf_dir), strategy, min_income=min_income
    )


def q3_per_capita_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q3 with income read as text lines and parsed per line (``;``-separated).

    Every part file starts with its own header line; lines equal to the header are
    dropped.  Keys are trimmed and only positive incomes are kept, as in the
    line-parsing form of the query.
    """
    folders = csv_folders(spark, inputs.zip_income(spark, sf_dir), "income-text", sep=";")
    names = ["Zip Code", "Estimated Median Income"]
    income = parse_csv_lines(read_lines(spark, folders), names, sep=";").filter(
        F.col("Zip Code").isNotNull() & (F.col("Zip Code") != F.lit(names[0]))
    )
    return per_capita_income(inputs.census_blocks(spark, sf_dir), income, min_income=0.0)


def q3_per_capita_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q3 from files, as the original job reads them: census blocks from GeoJSON
    (features exploded, properties flattened) and income from a ``;``-separated CSV."""
    blocks = read_geojson_properties(
        spark, write_feature_collections(spark, inputs.census_blocks(spark, sf_dir)), BLOCK_PROPERTIES, layout="lines"
    )
    income_csv = csv_folders(spark, inputs.zip_income(spark, sf_dir), "income-csv", sep=";")
    return per_capita_income(blocks, read_csv(spark, income_csv, sep=";"))


def q4_nearest_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q4 from CSV files: crimes from two CSV folders, stations from one; text columns
    are cast at use (``try_cast``)."""
    crimes = read_csv(spark, csv_folders(spark, inputs.crime_points(spark, sf_dir), "crimes-points"))
    stations_csv = owned_path(spark, "stations-csv")
    write_result(inputs.stations(spark, sf_dir), stations_csv)
    return nearest_station_summary(crimes, read_csv(spark, stations_csv))


def q4_nearest(spark: SparkSession, sf_dir: str, strategy: str = "default") -> DataFrame:
    return nearest_station_summary(inputs.crime_points(spark, sf_dir), inputs.stations(spark, sf_dir), strategy)


def q4_nearest_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q4 with the 25 nations as stations (the few-stations regime of the original data)."""
    return nearest_station_summary(inputs.crime_points(spark, sf_dir), inputs.nation_stations(spark, sf_dir))


# ------------------------------------------------------------------ single operators
def op_argmin(spark, sf_dir):
    o = inputs.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("orderkey")
    )
    return argmin(o, "k", "price", "orderkey")


def op_top_k_per_group(spark, sf_dir):
    o = inputs.table(spark, sf_dir, "orders")
    return top_k_per_group(o, "o_custkey", [F.desc("o_totalprice")], 3, rank_name="rk").select(
        "o_custkey", "o_orderkey", "rk"
    )


def op_equi_join(spark, sf_dir, strategy="default"):
    c = inputs.table(spark, sf_dir, "customer")
    n = inputs.table(spark, sf_dir, "nation")
    return equi_join(c, n, "c_nationkey", "n_nationkey", strategy).select("c_custkey", "n_name")


def op_cross_join_count(spark, sf_dir):
    return cross_join_count(inputs.table(spark, sf_dir, "nation"), inputs.table(spark, sf_dir, "supplier"))


def op_union_all(spark, sf_dir):
    s = inputs.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"))
    c = inputs.table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"))
    return union_all(s, c)


def op_having(spark, sf_dir):
    return count_at_least(inputs.table(spark, sf_dir, "orders"), "o_custkey", 15, "n")


def op_case_bucket(spark, sf_dir):
    ev = inputs.table(spark, sf_dir, "events")
    return (
        ev.select(time_of_day(F.date_format("ts", "HHmm")).alias("day_period"))
        .groupBy("day_period")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def op_parse_timestamp(spark, sf_dir):
    crimes = inputs.crimes_with_dates(spark, sf_dir, bad_every=50)
    ts = parse_timestamp("DATE OCC")
    return crimes.select(F.col("DR_NO").alias("o_orderkey"), F.year(ts).alias("y"), F.month(ts).alias("mo"))


def op_parse_money(spark, sf_dir):
    n = inputs.table(spark, sf_dir, "nation")
    text = F.when(F.col("n_nationkey") == 5, F.lit("N/A")).otherwise(money_text(F.col("n_nationkey") * 1711 + 30000))
    return n.select("n_nationkey", parse_money(text).alias("v"))


def op_haversine(spark, sf_dir):
    s = inputs.table(spark, sf_dir, "supplier")
    lat = F.lit(33.7) + (F.col("s_suppkey") % 100) / F.lit(200.0)
    lon = F.lit(-118.6) + (F.col("s_suppkey") % 70) / F.lit(150.0)
    km = haversine_km(lat, lon, F.lit(34.0), F.lit(-118.2))
    return s.select("s_suppkey", F.round(km, 6).alias("km"))


def op_explode_flatten(spark, sf_dir):
    ev = inputs.table(spark, sf_dir, "events")
    return json_fields(ev, "props", "k bigint", keep=["event_id"])


def op_explode_array(spark, sf_dir):
    e = inputs.table(spark, sf_dir, "embeddings")
    return explode_array(e, "embedding", keep=["label"]).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def op_keyed_reduce(spark, sf_dir):
    li = inputs.table(spark, sf_dir, "lineitem")
    return keyed_sums(li, "l_returnflag", {"q": "l_quantity", "ln": "l_linenumber"})


def op_lower_median(spark, sf_dir):
    o = inputs.table(spark, sf_dir, "orders")
    return lower_median(o, "o_orderpriority", "o_totalprice", name="median", count_name="n")


def op_null_island_filter(spark, sf_dir):
    pts = inputs.island_points(spark, sf_dir)
    return clean_points(pts, "c_custkey", "LAT", "LON").select(F.col("_id").alias("c_custkey"))


def _elapsed_lines(spark, sf_dir):
    ev = inputs.table(spark, sf_dir, "events")
    line = F.when(F.col("event_id") % 3 == 0, F.lit("noise")).otherwise(
        F.concat(F.lit("x QUERY_ELAPSED_SECONDS="), F.col("event_id").cast("string"), F.lit(".5"))
    )
    return ev.select("event_id", line.alias("value"))


def op_extract_metric(spark, sf_dir):
    return extract_metric(_elapsed_lines(spark, sf_dir), name="e").select("event_id", "e")


def op_median_lines(spark, sf_dir):
    o = inputs.table(spark, sf_dir, "orders")
    line = F.when(F.col("o_orderkey") % 4 == 0, F.lit("noise")).otherwise(
        F.concat(F.col("o_orderpriority"), F.lit(" MEDIAN="), F.col("o_totalprice").cast("string"))
    )
    return median_lines(o.select(line.alias("value")))


def op_csv_parquet_round_trip(spark, sf_dir):
    return csv_parquet_round_trip(spark, inputs.table(spark, sf_dir, "orders"))


def op_tuple_text_round_trip(spark, sf_dir):
    return tuple_text_round_trip(spark, q1_share(spark, sf_dir), "day_period", "percentage")


def op_geojson_scan(spark, sf_dir):
    return geojson_round_trip(spark, inputs.census_blocks(spark, sf_dir))


# ------------------------------------------------------------------ hostile input, derived from whole tables
def op_csv_round_trip_hostile(spark, sf_dir):
    """NULL keys, quotes, separators, blanks, backslashes and line breaks through CSV."""
    return csv_parquet_round_trip(spark, inputs.hostile_orders(spark, sf_dir))


def op_csv_quoted_newlines(spark, sf_dir):
    """The same rows with raw line breaks inside quotes, several tasks a file."""
    return quoted_csv_round_trip(spark, inputs.hostile_orders(spark, sf_dir))


def op_csv_mixed_headers(spark, sf_dir):
    """CSV files whose headers differ in order and in columns, matched by name."""
    return mixed_headers_round_trip(spark, inputs.hostile_orders(spark, sf_dir), F.col("o_custkey") % 2 == 0, "note")


def op_geojson_document(spark, sf_dir):
    """Whole GeoJSON documents, on one line and pretty-printed, several tasks a file."""
    rows = inputs.table(spark, sf_dir, "customer").count()
    return geojson_document_round_trip(spark, inputs.census_blocks(spark, sf_dir), rows)


def op_tuple_text_hostile(spark, sf_dir):
    """Labels with quotes, backslashes and line breaks, the text "None" beside NULL."""
    return tuple_text_round_trip(spark, inputs.hostile_labels(spark, sf_dir), "label", "value")


def op_convert_verified(spark, sf_dir):
    """Conversion with row count and checksum observed while writing and compared with the files."""
    o = inputs.table(spark, sf_dir, "orders")
    return verified_conversion(spark, o.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))


def op_top_k_hot_ties(spark, sf_dir):
    """Two thirds of all rows in one group and all tied."""
    hot = F.col("o_orderkey") % 3 != 0
    o = inputs.table(spark, sf_dir, "orders").select(
        F.when(hot, F.lit(-1)).otherwise(F.col("o_custkey")).cast("long").alias("g"),
        F.when(hot, F.lit(1.0)).otherwise(F.col("o_totalprice").cast("double")).alias("v"),
        "o_orderkey",
    )
    return top_k_with_ties(o, "g", "v", 3, rank_name="rk").select("g", "o_orderkey", "rk")


def op_equi_join_heavy(spark, sf_dir):
    """A third of the left rows on one key."""
    li = inputs.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_orderkey") % 3 == 0, F.lit(1)).otherwise(F.col("l_suppkey")).cast("long").alias("key"),
    )
    s = inputs.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name")
    return heavy_key_join(li, s, "key", "s_suppkey").select("l_orderkey", "l_linenumber", "s_name")


def op_reproducible_avg(spark, sf_dir):
    """Averages that no partitioning changes."""
    o = inputs.table(spark, sf_dir, "orders").select("o_orderpriority", F.col("o_totalprice").cast("double").alias("v"))
    out = reproducible_avg(o, "o_orderpriority", "v", "average", "n")
    return out.select("o_orderpriority", F.round("average", 4).alias("average"), "n")


def op_convert_count(spark, sf_dir):
    return convert_and_count(spark, inputs.table(spark, sf_dir, "orders"))


def op_lower_median_wide(spark, sf_dir):
    """Values over the whole range of doubles: a range that overflows, and log-spread inside."""
    return lower_median(inputs.wide_values(spark, sf_dir), "g", "v", name="median", count_name="n")


def op_lower_median_bigint(spark, sf_dir):
    """Integers beyond 2**53, which a double cannot tell apart."""
    o = inputs.table(spark, sf_dir, "orders")
    v = F.lit(9007199254740993) + (F.col("o_orderkey") * 7) % 1009
    return lower_median(o.select("o_orderpriority", v.alias("v")), "o_orderpriority", "v", name="median", count_name="n")


def q1_share_hostile(spark, sf_dir, bucket="udf"):
    return street_time_share(inputs.hostile_times(spark, sf_dir), premis_value="click", bucket=bucket)


def q3_per_capita_blank_zip(spark, sf_dir):
    """Blocks and incomes whose ZIP is empty or blank take no part."""
    blocks, income = inputs.census_blocks(spark, sf_dir), inputs.zip_income(spark, sf_dir)

    def blanked(df, name):
        return df.withColumn(
            name, F.when(F.col(name) == "90004", "").when(F.col(name) == "90007", "   ").otherwise(F.col(name))
        )

    return per_capita_income(blanked(blocks, "ZCTA20"), blanked(income, "Zip Code"))


def q4_nearest_far(spark, sf_dir):
    """Every crime 5 degrees north and east of the stations' area."""
    far = inputs.crime_points(spark, sf_dir).withColumn("LAT", F.col("LAT") + 5.0).withColumn("LON", F.col("LON") + 5.0)
    return nearest_station_summary(far, inputs.stations(spark, sf_dir))


def q4_nearest_clustered(spark, sf_dir):
    """Nearly all stations in one dense patch, a few spread out."""
    return nearest_station_summary(inputs.crime_points(spark, sf_dir), inputs.clustered_stations(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {
        "q1_share_native": partial(q1_share, bucket="native"),
        "q1_share_udf": partial(q1_share, bucket="udf"),
        "q1_share_classified_only": partial(q1_share, keep_unclassified=False),
        "q1_share_csv": q1_share_csv,
        "q2_top_months_df": partial(q2_top_months, form="df"),
        "q2_top_months_sql": partial(q2_top_months, form="sql"),
    }
    for s in STRATEGIES:
        out[f"q3_per_capita_{s}"] = partial(q3_per_capita, strategy=s)
    out["q3_per_capita_positive_income"] = partial(q3_per_capita, min_income=0.0)
    out["q3_per_capita_text_lines"] = q3_per_capita_text_lines
    out["q3_per_capita_geojson"] = q3_per_capita_geojson
    for s in STRATEGIES:
        out[f"q4_nearest_{s}"] = partial(q4_nearest, strategy=s)
    out["q4_nearest_nation"] = q4_nearest_nation
    out["q4_nearest_csv"] = q4_nearest_csv
    for fn in (
        op_argmin,
        op_top_k_per_group,
        op_equi_join,
        op_cross_join_count,
        op_union_all,
        op_having,
        op_case_bucket,
        op_parse_timestamp,
        op_parse_money,
        op_haversine,
        op_explode_flatten,
        op_explode_array,
        op_keyed_reduce,
        op_lower_median,
        op_null_island_filter,
        op_extract_metric,
        op_median_lines,
        op_csv_parquet_round_trip,
        op_geojson_scan,
        op_tuple_text_round_trip,
        op_csv_round_trip_hostile,
        op_csv_quoted_newlines,
        op_csv_mixed_headers,
        op_geojson_document,
        op_tuple_text_hostile,
        op_convert_count,
        op_convert_verified,
        op_top_k_hot_ties,
        op_equi_join_heavy,
        op_reproducible_avg,
        op_lower_median_wide,
        op_lower_median_bigint,
        q3_per_capita_blank_zip,
        q4_nearest_far,
        q4_nearest_clustered,
    ):
        out[fn.__name__] = fn
    for s in STRATEGIES[1:]:
        out[f"op_equi_join_{s}"] = partial(op_equi_join, strategy=s)
    out["q1_share_udf_hostile"] = q1_share_hostile
    out["q1_share_native_hostile"] = partial(q1_share_hostile, bucket="native")
    if llm_queries is not None:
        out.update(llm_queries.queries())
        out["pipeline"] = corpus_pipeline.run
    return out


# ------------------------------------------------------------------ DuckDB oracle
_PERIOD_CASE = """case when t between 500 and 1159 then 'Morning'
            when t between 1200 and 1659 then 'Afternoon'
            when t between 1700 and 2059 then 'Evening'
            when t >= 2100 or t <= 459 then 'Night' end"""

_Q1 = f"""
with c as (select try_cast(lpad(cast((event_id * 37) % 2500 as varchar), 4, '0') as integer) as t
           from events where event_type = 'click'),
p as (select {_PERIOD_CASE} as day_period from c)
select day_period, round(cast(count(*) as double) / sum(count(*)) over () * 100, 2) as percentage
from p group by day_period
"""

_FMT = "'%Y %b %d %I:%M:%S %p'"
_Q2 = f"""
select "year", "month", crime_total, cast(ranking as integer) as ranking from (
  select "year", "month", crime_total,
         rank() over (partition by "year" order by crime_total desc) as ranking
  from (select cast(year(x) as integer) as "year", cast(month(x) as integer) as "month", count(*) as crime_total
        from (select try_strptime(strftime(o_orderdate, {_FMT}), {_FMT}) as x from orders) s
        group by 1, 2) m) r
where ranking <= 3
"""

_Q3_BASE = """
with z as (select case when c_nationkey = 3 then null else lpad(cast(90000 + c_nationkey as varchar), 5, '0') end as zip,
                  sum(c_custkey % 97) as population, sum(c_custkey % 31) as households
           from customer group by 1 having sum(c_custkey % 97) > 0),
i as (select lpad(cast(90000 + n_nationkey as varchar), 5, '0') as izip,
             try_cast(regexp_replace(case when n_nationkey = 5 then 'N/A' when n_nationkey = 6 then '$0'
                      else '$' || format('{:,}', 30000 + n_nationkey * 1711) end, '[$,]', '', 'g') as double) as mi
      from nation)
select zip as zipcode, round(mi * households / population, 2) as per_capita_income
from z join i on zip = izip where mi is not null
"""

_Q4 = """
with p as (select l_orderkey as id,
                  33.70::double + ((l_orderkey * 7919 + l_linenumber * 104729) % 10007) / 10007.0::double * 0.65::double as lat,
                  -118.67::double + ((l_orderkey * 104729 + l_linenumber * 7919) % 10009) / 10009.0::double * 0.52::double as lon
           from lineitem),
s as (select s_name as division,
             33.72::double + ((s_suppkey * 613) % 1009) / 1009.0::double * 0.60::double as slat,
             -118.60::double + ((s_suppkey * 977) % 1013) / 1013.0::double * 0.45::double as slon
      from supplier),
a as (select id, division,
             pow(sin(radians(slat - lat) / 2), 2)
             + cos(radians(lat)) * cos(radians(slat)) * pow(sin(radians(slon - lon) / 2), 2) as a
      from p cross join s),
d as (select id, division, 6371.0::double * 2 * atan2(sqrt(a), sqrt(greatest(0::double, 1 - a))) as dk from a),
n as (select division, dk from (
        select *, row_number() over (partition by id order by dk, division) as rn from d) x where rn = 1)
select division, round(avg(dk), 3) as average_distance, count(*) as "#" from n group by division
"""

_Q4_NATION = _Q4.replace(
    """s as (select s_name as division,
             33.72::double + ((s_suppkey * 613) % 1009) / 1009.0::double * 0.60::double as slat,
             -118.60::double + ((s_suppkey * 977) % 1013) / 1013.0::double * 0.45::double as slon
      from supplier)""",
    """s as (select n_name as division,
             33.72::double + ((n_nationkey * 7) % 25) / 25.0::double * 0.60::double as slat,
             -118.60::double + ((n_nationkey * 11) % 25) / 25.0::double * 0.45::double as slon
      from nation)""",
)
assert _Q4_NATION != _Q4

_Q4_FAR = _Q4.replace("as lat,", "+ 5.0::double as lat,", 1).replace("as lon\n           from lineitem", "+ 5.0::double as lon\n           from lineitem")
_Q4_CLUSTERED = _Q4.replace(
    """33.72::double + ((s_suppkey * 613) % 1009) / 1009.0::double * 0.60::double as slat""",
    """33.72::double + ((s_suppkey * 613) % 1009) / 1009.0::double * case when s_suppkey % 50 = 0 then 0.60::double else 0.03::double end as slat""",
).replace(
    """-118.60::double + ((s_suppkey * 977) % 1013) / 1013.0::double * 0.45::double as slon""",
    """-118.60::double + ((s_suppkey * 977) % 1013) / 1013.0::double * case when s_suppkey % 50 = 0 then 0.45::double else 0.03::double end as slon""",
)
_Q1_HOSTILE = _Q1.replace(
    "try_cast(lpad(cast((event_id * 37) % 2500 as varchar), 4, '0') as integer)",
    """try_cast(case event_id % 8 when 0 then '3000000000' when 1 then '99999999999' when 2 then '-5' when 3 then 'noon'
                    when 4 then '' when 5 then '  930 ' when 6 then 'x1230' else lpad(cast((event_id * 37) % 2500 as varchar), 4, '0') end as integer)""",
)

_OPS = {
    "op_argmin": """
select k, price, orderkey from (
  select o_custkey as k, o_totalprice as price, o_orderkey as orderkey,
         row_number() over (partition by o_custkey order by o_totalprice, o_orderkey) as rn
  from orders) x where rn = 1""",
    "op_top_k_per_group": """
select o_custkey, o_orderkey, cast(rk as integer) as rk from (
  select o_custkey, o_orderkey, rank() over (partition by o_custkey order by o_totalprice desc) as rk
  from orders) x where rk <= 3""",
    "op_equi_join": "select c_custkey, n_name from customer join nation on c_nationkey = n_nationkey",
    "op_cross_join_count": "select count(*) as pairs from nation cross join supplier",
    "op_union_all": "select s_name as name from supplier union all select c_name as name from customer",
    "op_having": "select o_custkey, count(*) as n from orders group by o_custkey having count(*) >= 15",
    "op_case_bucket": f"""
select {_PERIOD_CASE} as day_period, count(*) as n
from (select try_cast(strftime(ts, '%H%M') as integer) as t from events) x group by 1""",
    "op_parse_timestamp": f"""
select o_orderkey, cast(year(x) as integer) as y, cast(month(x) as integer) as mo from (
  select o_orderkey, try_strptime(case when o_orderkey % 50 = 0 then 'bad'
                                       else strftime(o_orderdate, {_FMT}) end, {_FMT}) as x
  from orders) s""",
    "op_parse_money": """
select n_nationkey, try_cast(regexp_replace(case when n_nationkey = 5 then 'N/A'
       else '$' || format('{:,}', 30000 + n_nationkey * 1711) end, '[$,]', '', 'g') as double) as v
from nation""",
    "op_haversine": """
select s_suppkey, round(6371.0::double * 2 * atan2(sqrt(a), sqrt(greatest(0::double, 1 - a))), 6) as km from (
  select s_suppkey, pow(sin(radians(34.0::double - lat) / 2), 2)
         + cos(radians(lat)) * cos(radians(34.0::double)) * pow(sin(radians(-118.2::double - lon) / 2), 2) as a
  from (select s_suppkey, 33.7::double + (s_suppkey % 100) / 200.0::double as lat,
               -118.6::double + (s_suppkey % 70) / 150.0::double as lon from supplier) p) q""",
    "op_explode_flatten": "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events",
    "op_explode_array": """
select label, count(*) as n from (select label, unnest(embedding) as e from embeddings) x group by label""",
    "op_keyed_reduce": """
select l_returnflag, sum(l_quantity) as q, cast(sum(l_linenumber) as bigint) as ln from lineitem group by l_returnflag""",
    "op_lower_median": """
select o_orderpriority, quantile_disc(o_totalprice, 0.5) as median, count(o_totalprice) as n
from orders where o_totalprice is not null group by o_orderpriority""",
    "op_csv_round_trip_hostile": """
select case when o_orderkey % 5 = 0 then null else o_orderkey end as "key", o_custkey,
       case o_orderkey % 7 when 0 then 'a "b", c' when 1 then 'one' || chr(10) || 'two' || chr(13) || 'x'
            when 2 then '  blanks  ' when 3 then 'back\\slash \\n, "end\\' when 4 then null when 5 then 'a' || chr(0) || 'b\\0'
            else o_orderpriority || ';' || cast(o_orderkey as varchar) end as note
from orders""",
    "op_convert_count": "select count(*) as n from orders",
    "op_tuple_text_hostile": """
select case o_orderkey % 7 when 0 then 'None' when 1 then null when 2 then 'it''s ("a"), ''b'')'
            when 3 then 'back\\slash\\n\\x27' when 4 then 'two' || chr(10) || 'lines' || chr(13) when 5 then ''
            else o_orderpriority end as label,
       cast(o_custkey as double) as "value"
from orders""",
    "op_convert_verified": """
select count(*) as n, cast(sum(cast(('0x' || substr(md5(
         '=' || cast(o_orderkey as varchar) || chr(31) || '=' || cast(o_custkey as varchar) || chr(31)
         || coalesce('=' || o_orderstatus, '~') || chr(31) || coalesce('=' || o_orderpriority, '~')), 1, 15)) as bigint)) as varchar) as checksum
from orders""",
    "op_top_k_hot_ties": """
select g, o_orderkey, cast(rk as integer) as rk from (
  select g, o_orderkey, rank() over (partition by g order by v desc) as rk from (
    select case when o_orderkey % 3 <> 0 then -1 else o_custkey end as g, o_orderkey,
           case when o_orderkey % 3 <> 0 then 1.0::double else o_totalprice::double end as v from orders) x) y
where rk <= 3""",
    "op_equi_join_heavy": """
select l_orderkey, l_linenumber, s_name from (
  select l_orderkey, l_linenumber, case when l_orderkey % 3 = 0 then 1 else l_suppkey end as key from lineitem) l
join supplier on key = s_suppkey""",
    "op_reproducible_avg": """
select o_orderpriority, round(favg(o_totalprice::double), 4) as average, count(*) as n from orders group by 1""",
    "op_lower_median_wide": """
select o_orderpriority as g, count(v) as n, quantile_disc(v, 0.5) as median from (
  select o_orderpriority, case o_orderkey % 4 when 0 then 1.7e308::double when 1 then -1.7e308::double
         else cast('1e' || cast(o_custkey % 600 - 300 as varchar) as double) end as v from orders) x group by 1""",
    "op_lower_median_bigint": """
select o_orderpriority, count(v) as n, quantile_disc(v, 0.5) as median from (
  select o_orderpriority, 9007199254740993 + (o_orderkey * 7) % 1009 as v from orders) x group by 1""",
    "op_null_island_filter": """
select c_custkey from (
  select c_custkey, case when c_custkey % 11 = 0 then null else cast(c_custkey % 3 as double) end as lat,
         cast(c_custkey % 5 as double) as lon from customer) p
where lat is not null and lon is not null and not (lat = 0 and lon = 0)""",
    "op_extract_metric": """
select event_id, cast(regexp_extract(l, 'QUERY_ELAPSED_SECONDS=([0-9.]+)', 1) as double) as e from (
  select event_id, case when event_id % 3 = 0 then 'noise'
         else 'x QUERY_ELAPSED_SECONDS=' || cast(event_id as varchar) || '.5' end as l from events) x
where regexp_matches(l, 'QUERY_ELAPSED_SECONDS=([0-9.]+)')""",
    "op_median_lines": """
select regexp_extract(l, '^(.*) MEDIAN=([0-9.]+)$', 1) as label,
       cast(regexp_extract(l, '^(.*) MEDIAN=([0-9.]+)$', 2) as double) as median from (
  select case when o_orderkey % 4 = 0 then 'noise'
         else o_orderpriority || ' MEDIAN=' || cast(o_totalprice as varchar) end as l from orders) x
where regexp_matches(l, '^(.*) MEDIAN=([0-9.]+)$')""",
    "op_csv_parquet_round_trip": """
select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority from orders""",
    "op_geojson_scan": """
select case when c_nationkey = 3 then null else lpad(cast(90000 + c_nationkey as varchar), 5, '0') end as zipcode,
       cast(sum(c_custkey % 97) as bigint) as population, cast(sum(c_custkey % 31) as bigint) as households
from customer group by 1""",
}


def oracle_sql() -> dict[str, str]:
    out = {
        "q1_share_native": _Q1,
        "q1_share_udf": _Q1,
        "q1_share_classified_only": f"select * from ({_Q1}) q where day_period is not null",
        "q1_share_csv": _Q1,
        "q2_top_months_df": _Q2,
        "q2_top_months_sql": _Q2,
    }
    for s in STRATEGIES:
        out[f"q3_per_capita_{s}"] = _Q3_BASE
        out[f"q4_nearest_{s}"] = _Q4
    out["q3_per_capita_positive_income"] = _Q3_BASE + " and mi > 0"
    out["q4_nearest_nation"] = _Q4_NATION
    out["op_tuple_text_round_trip"] = _Q1
    out["q3_per_capita_text_lines"] = _Q3_BASE + " and mi > 0"
    out["q3_per_capita_geojson"] = _Q3_BASE
    out["q4_nearest_csv"] = _Q4
    out["op_csv_quoted_newlines"] = _OPS["op_csv_round_trip_hostile"]
    out["op_csv_mixed_headers"] = f"""
select "key", o_custkey, case when o_custkey % 2 = 0 then note end as note from ({_OPS["op_csv_round_trip_hostile"]}) x"""
    out["op_geojson_document"] = _OPS["op_geojson_scan"]
    out["q1_share_udf_hostile"] = out["q1_share_native_hostile"] = _Q1_HOSTILE
    out["q3_per_capita_blank_zip"] = _Q3_BASE + " and zip not in ('90004', '90007')"
    out["q4_nearest_far"] = _Q4_FAR
    out["q4_nearest_clustered"] = _Q4_CLUSTERED
    out.update(_OPS)
    for s in STRATEGIES[1:]:
        out[f"op_equi_join_{s}"] = _OPS["op_equi_join"]
    if llm_queries is not None:
        out.update(llm_queries.oracle_sql())
        if corpus_pipeline.ORACLE_SQL is not None:
            out["pipeline"] = corpus_pipeline.ORACLE_SQL
    return out
