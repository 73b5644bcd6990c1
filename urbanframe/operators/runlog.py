"""Run-log parsing: metric extraction and per-label summary lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The log line formats the runners emit and scrape.
ELAPSED_PATTERN = r"QUERY_ELAPSED_SECONDS=([0-9.]+)"
MEDIAN_LINE_PATTERN = r"^(.*) MEDIAN=([0-9.]+)$"


def extract_metric(lines: DataFrame, pattern: str = ELAPSED_PATTERN, value: str = "value", name: str = "seconds") -> DataFrame:
    """Keep lines matching ``pattern`` and parse its first group as a double."""
    return lines.filter(F.col(value).rlike(pattern)).withColumn(
        name, F.regexp_extract(F.col(value), pattern, 1).try_cast("double")
    )


def median_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """``<label> MEDIAN=<v>`` lines -> columns ``label, median``."""
    return lines.filter(F.col(value).rlike(MEDIAN_LINE_PATTERN)).select(
        F.regexp_extract(F.col(value), MEDIAN_LINE_PATTERN, 1).alias("label"),
        F.regexp_extract(F.col(value), MEDIAN_LINE_PATTERN, 2).try_cast("double").alias("median"),
    )
