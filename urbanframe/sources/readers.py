"""Readers: Parquet, delimited text with per-file header checks, GeoJSON, text lines.

No reader infers a schema by scanning data: CSV columns are all-string (named from
the first file's header, as the workload does) and JSON takes a declared schema,
so reading never costs an extra full pass.
"""

from __future__ import annotations

import csv
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urbanframe.sources.splits import json_members, quoted_records, session_settings

CSV_OPTIONS = {
    "header": "true",
    # RFC 4180 quoting: a doubled quote inside a quoted field is one quote.
    "escape": '"',
    # Each file's header must match the schema by name: a file with other columns than
    # the catalogue said fails instead of being bound by position.
    "enforceSchema": "false",
    "mode": "PERMISSIVE",
}


# characters that a line of CSV cannot hold, as the sink writes them (backslash first)
ESCAPES = (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\0", "\\0"))


def escaped(c: Column) -> Column:
    """``c`` on one line: backslash, line feed, carriage return and NUL written with a backslash."""
    for plain, written in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(written))
    return c


def unescaped(c: Column) -> Column:
    """:func:`escaped` undone.

    Written backslashes come in pairs; between the pairs a backslash belongs to one of the others.
    """

    def restored(part: Column) -> Column:
        for plain, written in ESCAPES[1:]:
            part = F.replace(part, F.lit(written), F.lit(plain))
        return part

    return F.when(c.isNotNull(), F.array_join(F.transform(F.split(c, r"\\\\"), restored), "\\"))


def _paths(paths: str | Sequence[str]) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def string_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType(), True) for c in columns])


def csv_header(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """Column names from a CSV file's header line (reads only that line)."""
    return spark.read.options(header="true", sep=sep, escape='"').csv(path).columns


def _first_line(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of a task, if its split opens a file; nothing more is read."""
    for batch in batches:
        if batch.num_rows:
            if batch.column(2)[0].as_py() == 0:
                yield batch.slice(0, 1)
            return


def csv_headers(spark: SparkSession, paths: str | Sequence[str], sep: str = ",") -> dict[tuple[str, ...], list[str]]:
    """Header catalogue: the files under ``paths`` by their column names.

    One job reads the first line of every file, each split in a task of its own that
    stops after it.  The driver gets one path and line per file, as Spark's own file
    listing does.  Empty files have no header and are left out.
    """
    one_split_a_task = {
        "spark.sql.files.openCostInBytes": spark.conf.get("spark.sql.files.maxPartitionBytes"),
        "spark.sql.execution.arrow.maxRecordsPerBatch": "1",
    }
    with session_settings(spark, one_split_a_task):
        lines = spark.read.option("lineSep", "\n").text(_paths(paths)).select(
            "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block")
        )
        rows = lines.mapInArrow(_first_line, "value string, path string, block long").collect()
    catalogue: dict[tuple[str, ...], list[str]] = {}
    for line in sorted({r["value"] for r in rows}):
        names = tuple(next(csv.reader([line.rstrip("\r")], delimiter=sep), []))
        catalogue.setdefault(names, []).extend(r["path"] for r in rows if r["value"] == line)
    return {names: sorted(files) for names, files in catalogue.items()}


def read_csv(
    spark: SparkSession,
    paths: str | Sequence[str],
    sep: str = ",",
    columns: Sequence[str] | None = None,
    escaped_newlines: bool = False,
    quoted_newlines: bool = False,
    split_bytes: int | None = None,
) -> DataFrame:
    """Read one or more delimited files with a header into all-string columns.

    Without ``columns`` a header catalogue (:func:`csv_headers`) groups the files by
    their headers; each group is read once and the groups are joined by column *name*,
    so files may order their columns differently or lack some (NULL there).  Columns
    come in the order of their first appearance, widest header first.  With ``columns``
    every file must have exactly that header: ``enforceSchema=false`` checks it while
    the scan runs, and another one raises.  Values are kept as text; cast them at use
    sites with the ``try_*`` helpers.

    Line breaks inside values: ``quoted_newlines`` reads them raw inside quotes, from
    files that are still split among tasks (:func:`urbanframe.sources.splits.quoted_records`,
    with splits of ``split_bytes``; header lines hold none); ``escaped_newlines`` undoes the escapes of
    ``write_result(..., newlines="escape")``; with neither a line is a record.
    """
    ps = _paths(paths)
    groups = {tuple(columns): ps} if columns is not None else csv_headers(spark, ps, sep)
    if not groups:
        return spark.createDataFrame([], string_schema([]))
    parts: list[DataFrame] = []
    for names, files in sorted(groups.items(), key=lambda g: (-len(g[0]), g[0])):
        if quoted_newlines:
            rows = _parsed_records(spark, files, names, sep, split_bytes)
        else:
            rows = spark.read.schema(string_schema(names)).options(**CSV_OPTIONS).option("sep", sep).csv(files)
        parts.append(rows.select(*[unescaped(F.col(_quoted(n))).alias(n) for n in names]) if escaped_newlines else rows)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def _quoted(name: str) -> str:
    return "`{}`".format(name.replace("`", "``"))


def _parsed_records(
    spark: SparkSession, files: list[str], names: Sequence[str], sep: str, split_bytes: int | None
) -> DataFrame:
    """Delimited records that may hold line breaks, parsed without their headers.

    Spark's parser sees each record on one line (line breaks escaped) and the values are
    restored behind it.  An empty value is NULL, an empty quoted one is empty text: escaped
    text holds no lone backslash before an N, so that can stand for NULL.
    """
    records = quoted_records(spark, files, split_bytes).filter(~F.col("first"))
    line = F.regexp_replace("value", r"\r$", "")  # the carriage return of a line end, not one inside quotes
    parsed = parse_csv_lines(records.filter(line != "").select(escaped(line).alias("value")), names, sep, null_value="\\N")
    return parsed.select(*[unescaped(F.col(_quoted(n))).alias(n) for n in names])


def read_table(
    spark: SparkSession,
    paths: str | Sequence[str],
    fmt: str = "parquet",
    sep: str = ",",
) -> DataFrame:
    """Format switch: ``parquet`` (columnar, vectorised, pushdown) or ``csv``."""
    if fmt == "parquet":
        return spark.read.parquet(*_paths(paths))
    if fmt == "csv":
        return read_csv(spark, paths, sep=sep)
    raise ValueError(f"unsupported format {fmt!r}")


def geojson_schema(properties: T.StructType) -> T.StructType:
    """FeatureCollection schema keeping only ``features[].type`` and ``properties``.

    Declaring it avoids the inference pass and prunes ``geometry`` at parse time.
    """
    feature = T.StructType(
        [
            T.StructField("type", T.StringType(), True),
            T.StructField("properties", properties, True),
        ]
    )
    return T.StructType(
        [
            T.StructField("type", T.StringType(), True),
            T.StructField("features", T.ArrayType(feature, True), True),
        ]
    )


def read_geojson_properties(
    spark: SparkSession,
    paths: str | Sequence[str],
    properties: T.StructType,
    layout: str = "document",
    split_bytes: int | None = None,
) -> DataFrame:
    """One row per feature's properties, from FeatureCollection files of one ``layout``.

    * ``document``: any JSON text, on one line, pretty-printed or in between; a file is
      split among tasks (:func:`urbanframe.sources.splits.json_members`, in splits of
      ``split_bytes``) and no feature is lost at a split's border;
    * ``lines``: one FeatureCollection per line, parsed in the scan itself.

    A feature that does not parse, and a document that ends too early, raise.
    """
    if layout == "document":
        feature = geojson_schema(properties)["features"].dataType.elementType
        members = json_members(spark, _paths(paths), split_bytes)
        parsed = F.from_json("value", feature, {"mode": "FAILFAST"})
        return members.select(parsed.alias("f")).filter(F.col("f.type") == "Feature").select("f.properties.*")
    if layout != "lines":
        raise ValueError(f"unknown GeoJSON layout {layout!r}")
    reader = spark.read.schema(geojson_schema(properties)).option("mode", "FAILFAST")
    return flatten_features(reader.json(_paths(paths)))


def flatten_features(collection: DataFrame, features: str = "features") -> DataFrame:
    """``features`` array -> one row per element -> every ``properties`` field a column."""
    return collection.select(F.inline(features)).select("properties.*")


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Text files -> one row per line in column ``value``."""
    return spark.read.text(_paths(paths))


def parse_csv_lines(
    lines: DataFrame, columns: Sequence[str], sep: str = ",", value: str = "value", null_value: str = ""
) -> DataFrame:
    """Parse delimited text lines (column ``value``) into all-string columns.

    Runs in the executors with Spark's CSV parser (``from_csv``), so quoting follows
    the same rules as :func:`read_csv`; blank lines give all-NULL rows instead of
    failing the job.
    """
    ddl = ", ".join("`{}` STRING".format(c.replace("`", "``")) for c in columns)
    parsed = F.from_csv(F.col(value), ddl, {"sep": sep, "escape": '"', "nullValue": null_value})
    return lines.select(parsed.alias("_r")).select("_r.*")
