"""Write-and-read-back jobs for the file sources and sinks.

All write into a fresh folder under the session's shared folder for intermediate
tables (:func:`urbanframe.session.checkpoint_dir`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urbanframe.session import materialize, owned_path
from urbanframe.sources.readers import read_csv, read_geojson_properties
from urbanframe.sources.sinks import (
    convert_csv_to_parquet,
    convert_verified,
    read_tuple_text,
    write_parquet,
    write_result,
    write_tuple_text,
)


def _halves(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two parts that hold every row of ``df`` once, whatever its values.

    The rows are computed once, with their side, and stored; a hash of the whole
    row (NULLs included) picks the side.
    """
    side = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]) % 2 == 0
    stored = materialize(df.withColumn("_first_half", side), "halves")
    return tuple(stored.filter(F.col("_first_half") == want).drop("_first_half") for want in (True, False))


def csv_parquet_round_trip(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``df`` -> two CSV folders with different column orders -> Parquet -> typed ``df``.

    Each folder is read with its own header and the two are matched by column
    *name*; reading both in one scan would bind the second by position.  The union
    is converted to Parquet and read back with the original column types.  NULLs,
    quotes, separators, blanks and line breaks survive.
    """
    cols = df.columns
    base = owned_path(spark, "csv-roundtrip")
    parts = []
    for name, half, order in zip("ab", _halves(df), (cols, cols[::-1])):
        write_result(half.select(*[F.col(f"`{c}`") for c in order]), f"{base}/{name}", newlines="escape")
        parts.append(read_csv(spark, f"{base}/{name}", columns=order, escaped_newlines=True))
    write_parquet(parts[0].unionByName(parts[1]), f"{base}/parquet")
    return _typed(spark.read.parquet(f"{base}/parquet"), df)


# so that the small tables of a test are cut into several splits a file
TEST_SPLIT_BYTES = 1 << 16


def _typed(text: DataFrame, like: DataFrame) -> DataFrame:
    return text.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in like.schema.fields])


def quoted_csv_round_trip(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``df`` -> CSV files with raw line breaks inside quotes -> typed ``df``, several tasks a file."""
    folder = owned_path(spark, "csv-quoted")
    write_result(df, folder, newlines="quote")
    return _typed(read_csv(spark, folder, quoted_newlines=True, split_bytes=TEST_SPLIT_BYTES), df)


def mixed_headers_round_trip(spark: SparkSession, df: DataFrame, whole: Column, lacking: str) -> DataFrame:
    """``df`` -> two CSV folders -> one, matched by column name.

    Rows where ``whole`` holds are written in reverse column order, the others without the
    column ``lacking`` (NULL when read).
    """
    base = owned_path(spark, "csv-mixed")
    halves = {"a": (whole, df.columns[::-1]), "b": (~whole, [c for c in df.columns if c != lacking])}
    for name, (rows, order) in halves.items():
        write_result(df.filter(rows).select(*[F.col(f"`{c}`") for c in order]), f"{base}/{name}", newlines="escape")
    back = read_csv(spark, [f"{base}/{name}" for name in halves], escaped_newlines=True)
    return _typed(back.select(*[F.col(f"`{c}`") for c in df.columns]), df)


def convert_and_count(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``df`` as CSV folders -> one Parquet table -> its row count (``n``)."""
    out = owned_path(spark, "converted")
    n = convert_csv_to_parquet(spark, csv_folders(spark, df, "convert-csv"), out)
    return spark.createDataFrame([(n,)], "n long")


BLOCK_PROPERTIES = T.StructType(
    [
        T.StructField("ZCTA20", T.StringType(), True),
        T.StructField("POP20", T.LongType(), True),
        T.StructField("HOUSING20", T.LongType(), True),
    ]
)


def write_feature_collections(spark: SparkSession, blocks: DataFrame) -> str:
    """Write blocks as GeoJSON, one small FeatureCollection per line; returns the folder.

    The lines are built with ``to_json`` alone, and a file of such lines is split
    across tasks when it is read (``layout="lines"``).
    """
    out = owned_path(spark, "geojson")
    line = F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array(_feature()).alias("features")))
    blocks.select(line.alias("value")).write.mode("overwrite").text(out)
    return out


def _feature(*more: Column) -> Column:
    place = F.struct(F.lit("Point").alias("type"), F.array(F.lit(-118.25), F.lit(34.05)).alias("coordinates"))
    properties = F.struct("ZCTA20", "POP20", "HOUSING20", *more)
    return F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), place.alias("geometry"))


DOCUMENT_FEATURES = 2_000


def geojson_document_round_trip(spark: SparkSession, blocks: DataFrame, rows: int) -> DataFrame:
    """Blocks -> GeoJSON documents of about 2,000 features -> population and housing per ZIP.

    Every other document is pretty-printed, the others stand on one line; all name a
    reference system before their features and hold text that looks like JSON.  Read
    with several tasks a file.
    """
    out = owned_path(spark, "geojson-documents")
    documents = -(-rows // DOCUMENT_FEATURES)
    number = F.pmod(F.xxhash64("ZCTA20", "POP20", "HOUSING20", F.monotonically_increasing_id()), F.lit(documents))
    note = F.lit('a "quoted" }],{ note \\').alias("note")
    crs = F.struct(F.lit("name").alias("type"), F.struct(F.lit("EPSG:4326").alias("name")).alias("properties")).alias("crs")
    gathered = blocks.select(number.alias("d"), _feature(note).alias("f")).groupBy("d").agg(F.collect_list("f").alias("features"))
    whole = F.struct(F.lit("FeatureCollection").alias("type"), crs, "features")
    text = F.when(F.col("d") % 2 == 0, F.to_json(whole, {"pretty": "true"})).otherwise(F.to_json(whole))
    gathered.select(text.alias("value")).write.mode("overwrite").text(out)
    props = read_geojson_properties(spark, out, BLOCK_PROPERTIES, split_bytes=TEST_SPLIT_BYTES)
    return _per_zip(props)


def geojson_round_trip(spark: SparkSession, blocks: DataFrame) -> DataFrame:
    """Blocks -> GeoJSON lines -> read back -> population and housing per ZIP."""
    folder = write_feature_collections(spark, blocks)
    return _per_zip(read_geojson_properties(spark, folder, BLOCK_PROPERTIES, layout="lines"))


def _per_zip(props: DataFrame) -> DataFrame:
    return props.groupBy(F.col("ZCTA20").alias("zipcode")).agg(
        F.sum("POP20").alias("population"), F.sum("HOUSING20").alias("households")
    )


def csv_folders(spark: SparkSession, df: DataFrame, name: str, sep: str = ",") -> list[str]:
    """Write ``df`` as two CSV folders with headers, like the two period files of the crime data.

    Together the folders hold every row once.  Returns the two folder paths.
    """
    base = owned_path(spark, name)
    paths = [f"{base}/a", f"{base}/b"]
    for path, half in zip(paths, _halves(df)):
        write_result(half, path, sep=sep)
    return paths


def tuple_text_round_trip(spark: SparkSession, df: DataFrame, label: str, value: str) -> DataFrame:
    """``label, value`` rows -> tuple-text files -> the same rows; ``value`` is a number, ``label`` any text or NULL."""
    out = owned_path(spark, "tuple-text")
    rows = df.select(label, value)
    write_tuple_text(rows, out, [label, value], [True, False])
    return _typed(read_tuple_text(spark, out, [label, value], [True, False]), rows)


def verified_conversion(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``df`` as Parquet, read back and compared: row count ``n`` and ``checksum``, as text."""
    n, checksum = convert_verified(df, owned_path(spark, "verified"))
    return spark.createDataFrame([(n, str(checksum))], "n long, checksum string")
