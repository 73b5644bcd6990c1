"""Sinks: result files, Parquet, tuple-text, and the CSV -> Parquet conversion job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urbanframe.sources.readers import escaped, read_csv


def _one_line(df: DataFrame, newlines: str) -> DataFrame:
    """Text columns made safe for a line-based file.

    ``escape`` writes backslash, line feed and carriage return as ``\\\\``, ``\\n``
    and ``\\r`` (:func:`read_csv` restores them with ``escaped_newlines=True``); ``quote``
    leaves them to the quotes around the value (``quoted_newlines=True``); ``refuse``
    fails the job on the first line break, before it can split a row.
    """
    if newlines not in ("refuse", "escape", "quote"):
        raise ValueError("newlines must be 'refuse', 'escape' or 'quote'")
    if newlines == "quote":
        return df

    def safe(name: str) -> Column:
        c = F.col(f"`{name}`")
        if newlines == "escape":
            return escaped(c).alias(name)
        broken = F.contains(c, F.lit("\n")) | F.contains(c, F.lit("\r"))
        return F.when(broken, F.raise_error(F.lit(f"line break in column {name}"))).otherwise(c).alias(name)

    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return df.select(*[safe(n) if n in text else F.col(f"`{n}`") for n in df.columns])


def write_result(
    df: DataFrame,
    out: str,
    fmt: str = "csv",
    single_file: bool = False,
    mode: str = "overwrite",
    sep: str = ",",
    newlines: str = "refuse",
) -> None:
    """Write a query result (CSV with header by default).

    CSV keeps quotes, separators and outer blanks; see :func:`_one_line` for line
    breaks inside values.  ``single_file=True`` coalesces to one task; use it only
    for small results.
    """
    target = df.coalesce(1) if single_file else df
    if fmt == "csv":
        writer = _one_line(target, newlines).write.mode(mode).option("header", "true").option("escape", '"')
        writer = writer.option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")
        writer.option("sep", sep).csv(out)
    elif fmt == "parquet":
        target.write.mode(mode).parquet(out)
    else:
        raise ValueError(f"unsupported format {fmt!r}")


def default_output_path(spark: SparkSession, base: str, name: str) -> str:
    """``<base>/<name>_<application id>``: a fresh output folder per application."""
    return f"{base.rstrip('/')}/{name}_{spark.sparkContext.applicationId}"


def write_parquet(df: DataFrame, out: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(out)


# characters of a quoted tuple value that are written otherwise, backslash first
TUPLE_ESCAPES = (("\\", "\\\\"), ("'", "\\x27"), ("\n", "\\n"), ("\r", "\\r"))


def tuple_header(columns: Sequence[str]) -> str:
    return "(" + ", ".join(f"'{c}'" for c in columns) + ")"


def tuple_lines(df: DataFrame, columns: Sequence[str], quoted: Sequence[bool]) -> DataFrame:
    """Render rows as Python-tuple text, e.g. ``('Night', 33.33)``, in column ``value``.

    ``quoted[i]`` wraps column i in single quotes; backslashes, quotes and line breaks
    inside are escaped as Python does, and NULL is a bare ``None``.  The header line is the
    tuple of column names; a row that would read like it has its first character escaped,
    so every line can be read back (:func:`read_tuple_text`).
    """
    header = tuple_header(columns)
    fields = []
    for name, wrap in zip(columns, quoted):
        c = F.col(f"`{name}`").cast("string")
        if wrap:
            for plain, written in TUPLE_ESCAPES:
                c = F.replace(c, F.lit(plain), F.lit(written))
            c = F.concat(F.lit("'"), c, F.lit("'"))
        fields.append(F.coalesce(c, F.lit("None")))
    line = F.concat(F.lit("("), F.concat_ws(", ", *fields), F.lit(")"))
    unlike = F.lit("('" + _first_escaped(header)[1] + header[3:])
    spark = df.sparkSession
    top = spark.createDataFrame([(0, header)], "_o int, value string")
    body = df.select(F.lit(1).alias("_o"), F.when(line == F.lit(header), unlike).otherwise(line).alias("value"))
    return top.unionByName(body)


def _first_escaped(header: str) -> tuple[str, str]:
    """The first character of a header's first name, plain and escaped."""
    code = ord(header[2])
    return header[2], f"\\x{code:02x}" if code < 256 else f"\\u{code:04x}" if code < 65536 else f"\\U{code:08x}"


def write_tuple_text(df: DataFrame, out: str, columns: Sequence[str], quoted: Sequence[bool]) -> None:
    """Text sink of tuple lines with a header line first (overwrites ``out``).

    The header's partition precedes the body's in the union, so it lands in the
    first part file; the body is written in parallel, not funnelled into one task.
    """
    tuple_lines(df, columns, quoted).select("value").write.mode("overwrite").text(out)


def read_tuple_text(spark: SparkSession, path: str, columns: Sequence[str], quoted: Sequence[bool]) -> DataFrame:
    """Text columns of a folder that :func:`write_tuple_text` wrote; a line that is no such tuple raises."""
    header = tuple_header(columns)
    lines = spark.read.text(path).filter(F.col("value") != F.lit(header))
    pattern = "^\\(" + ", ".join("(None|'[^']*')" if wrap else "(.*?)" for wrap in quoted) + "\\)$"
    good = F.col("value").rlike(pattern)
    wrong = F.raise_error(F.concat(F.lit("not a tuple of these columns: "), F.col("value")))
    line = F.when(good, F.col("value")).otherwise(wrong.cast("string"))
    first = _first_escaped(header)

    def plain(i: int, wrap: bool) -> Column:
        c = F.regexp_extract(line, pattern, i + 1)
        if not wrap:
            return F.when(c != "None", c)
        inner = F.substring(c, F.lit(2), F.length(c) - 2)

        def restored(part: Column) -> Column:
            for was, written in (*TUPLE_ESCAPES[1:], *([first] if i == 0 else [])):
                part = F.replace(part, F.lit(written), F.lit(was))
            return part

        return F.when(c != "None", F.array_join(F.transform(F.split(inner, r"\\\\"), restored), "\\"))

    return lines.select(*[plain(i, wrap).alias(name) for i, (name, wrap) in enumerate(zip(columns, quoted))])


def row_checksum(df: DataFrame) -> Column:
    """Aggregate: a checksum of all rows that does not depend on their order; equal rows count each.

    It is the sum of 60 bits of the MD5 digest of every row's text, NULLs marked.
    """
    shown = [F.concat(F.lit("="), F.col(f"`{c}`").cast("string")) for c in df.columns]
    text = F.concat_ws("\x1f", *[F.coalesce(c, F.lit("~")) for c in shown])
    return F.sum(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)"))


class ConversionError(RuntimeError):
    """What was read back differs from what was written."""


def convert_verified(df: DataFrame, out: str) -> tuple[int, int]:
    """Write ``df`` as Parquet and prove that it is there: its row count and checksum.

    Both are observed while the rows are written, in the same pass, and computed again from
    the files; a difference raises :class:`ConversionError`.
    """
    written = Observation()
    measures = [F.count(F.lit(1)).alias("n"), F.coalesce(row_checksum(df), F.lit(0)).alias("checksum")]
    write_parquet(df.observe(written, *measures), out)
    before = written.get
    back = df.sparkSession.read.schema(df.schema).parquet(out).agg(*measures).first()
    if (back["n"], back["checksum"]) != (before["n"], before["checksum"]):
        raise ConversionError(f"{out}: wrote {before['n']} rows, checksum {before['checksum']}; found {back['n']}, {back['checksum']}")
    return int(back["n"]), int(back["checksum"])


def convert_csv_to_parquet(
    spark: SparkSession, csv_paths: str | Sequence[str], out: str, sep: str = ","
) -> int:
    """CSV files (headers checked per file) -> one Parquet table; returns the read-back count."""
    write_parquet(read_csv(spark, csv_paths, sep=sep), out)
    return spark.read.parquet(out).count()
