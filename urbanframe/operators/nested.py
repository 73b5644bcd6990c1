"""Nested data: struct flattening, array explosion, JSON text fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flatten_struct(df: DataFrame, struct_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """Every field of ``struct_col`` becomes a top-level column (plus ``keep``)."""
    return df.select(*keep, f"{struct_col}.*")


def explode_array(df: DataFrame, array_col: str, keep: Sequence[str] = (), name: str = "element") -> DataFrame:
    """One output row per array element (NULL or empty arrays give no rows)."""
    return df.select(*keep, F.explode(array_col).alias(name))


def json_fields(df: DataFrame, text_col: str, ddl_schema: str, keep: Sequence[str] = ()) -> DataFrame:
    """Parse a JSON text column with a declared schema and flatten its fields.

    Malformed JSON gives NULL fields rather than failing the job.
    """
    parsed = F.from_json(F.col(text_col), ddl_schema)
    return df.select(*keep, parsed.alias("_j")).select(*keep, "_j.*")
