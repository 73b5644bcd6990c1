"""Records that cross lines and splits: one file read by many tasks without losing its state.

A text file is cut into pieces at a separator and into splits by Spark's own file
splitting.  What a piece means depends on everything before it in the file (whether a
quote is open, how deep the brackets are), so a file is read twice:

1. every task sums up its splits, for each state they could begin in;
2. the summaries (one small row a split) are combined along each file, which gives
   every split the state it begins in;
3. every task, knowing that state, joins the pieces of its splits to records.  What
   lies before the first and behind the last record border of a split is a fragment;
   fragments are the only text that is shuffled, grouped to the record they belong to.

The records are written once to the shared folder, so both reads see the same splits
and later readers depend on neither.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from urbanframe.session import materialize

# a split's state travels in 24 bytes or so; beyond this many splits (256 TB of 128 MB) they are not broadcast
MAX_SPLITS = 2_000_000
# up to the split's first border, all of a split without one, behind its last border, between two borders
HEAD, MIDDLE, TAIL, WHOLE = range(4)


@contextmanager
def session_settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Within the block the session has these settings."""
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _fixed_splits(spark: SparkSession, split_bytes: int | None):
    """Within the block files are cut into splits alike, whatever the number of executors just then."""
    least = spark.conf.get("spark.sql.files.minPartitionNum", None) or str(spark.sparkContext.defaultParallelism)
    settings = {"spark.sql.files.minPartitionNum": least}
    if split_bytes is not None:
        settings["spark.sql.files.maxPartitionBytes"] = str(split_bytes)
    return session_settings(spark, settings)


def _pieces(spark: SparkSession, paths: list[str], separator: str) -> DataFrame:
    """``value, file, block``: the pieces in order, by split; ``file`` is a hash of the path."""
    text = spark.read.option("lineSep", separator).text(paths)
    return text.select(
        "value",
        F.xxhash64(F.col("_metadata.file_path")).alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_path").alias("path"),
    )


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """``(file, block, rows)`` for each stretch of one split in a batch."""
    file, block = (batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("file", "block"))
    cuts = np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1
    for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
        if hi > lo:
            yield int(file[lo]), int(block[lo]), batch.slice(lo, hi - lo)


def _concatenated(parts: Column, separator: str) -> Column:
    return F.array_join(F.transform(F.array_sort(parts), lambda x: x["value"]), separator)


def joined_fragments(fragments: DataFrame, separator: str) -> DataFrame:
    """Records ``file, first, value`` from fragments: a tail, splits without a border, and the head that ends it.

    What no head ends is no record.  Each split has two fragments at most, so a file's
    window is as long as its splits are many.
    """
    along = Window.partitionBy("file").orderBy("block", "kind")
    chained = fragments.withColumn("chain", F.count_if(F.col("kind") == TAIL).over(along))
    parts = F.collect_list(F.struct("block", "kind", "value"))
    ended = F.min("kind").alias("least")
    grouped = chained.groupBy("file", "chain").agg(
        ended, F.max("first").alias("first"), _concatenated(parts, separator).alias("value")
    )
    return grouped.filter(F.col("least") == HEAD).select("file", "first", "value")


# ------------------------------------------------------------------ quoted records
def _quotes(values: pa.Array) -> np.ndarray:
    return pc.count_substring(values, '"').to_numpy(zero_copy_only=False)


def _quote_parities(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Quotes of each split, modulo 2; a split may be reported in several rows."""
    for batch in batches:
        for file, block, rows in _runs(batch):
            odd = int(_quotes(rows.column(0)).sum()) & 1
            yield pa.RecordBatch.from_pydict({"file": [file], "block": [block], "odd": [odd]})


def _quoted_records(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines joined while a quote is open, as ``_RECORD`` rows."""
    now, odd, held, kind, first = None, 0, [], WHOLE, False

    def rest() -> Iterator[pa.RecordBatch]:
        if held:
            yield _records(now, TAIL if kind == WHOLE else MIDDLE, ["\n".join(held)], first)

    for batch in batches:
        for file, block, rows in _runs(batch):
            if (file, block) != now:
                yield from rest()
                now, odd, held, first = (file, block), int(rows.column(3)[0].as_py()), [], block == 0
                kind = HEAD if odd else WHOLE
            values = rows.column(0)
            after = (odd + np.cumsum(_quotes(values))) & 1
            ends = np.flatnonzero(after == 0)  # lines that close a record
            odd = int(after[-1])
            if held or kind == HEAD or len(ends) < len(after):
                texts = values.to_pylist()
                whole, lo = [], 0
                for end in ends.tolist():
                    held.extend(texts[lo : end + 1])
                    lo = end + 1
                    if kind == HEAD:
                        yield _records(now, HEAD, ["\n".join(held)])
                        kind = WHOLE
                    else:
                        whole.append("\n".join(held))
                    held.clear()
                held.extend(texts[lo:])
                values = pa.array(whole, pa.string())
            if len(values):
                yield _records(now, WHOLE, values, first)
                first = False
    yield from rest()


def _records(split: tuple[int, int], kind: int, values: pa.Array | list[str], first: bool = False) -> pa.RecordBatch:
    """Rows of one split and kind; ``first``: the first of them opens its file."""
    n = len(values)
    flags = np.zeros(n, dtype=bool)
    flags[0] = first
    columns = [np.full(n, split[0]), np.full(n, split[1]), np.full(n, kind, np.int32), flags]
    names = ["file", "block", "kind", "first", "value"]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(values, pa.string())], names=names)


_RECORD = "file long, block long, kind int, first boolean, value string"


def quoted_records(spark: SparkSession, paths: list[str], split_bytes: int | None = None) -> DataFrame:
    """``value, first``: the records of delimited text whose quoted values may hold line breaks.

    ``first``: the record opens its file.  A quote inside a quoted
    value is doubled, so a record ends at the first line break behind an even number of
    quotes.  Raises if a file ends inside a quote, naming it.  ``split_bytes`` replaces
    ``spark.sql.files.maxPartitionBytes``.
    """
    with _fixed_splits(spark, split_bytes):
        text = _pieces(spark, paths, "\n")
        parities = text.mapInArrow(_quote_parities, "file long, block long, odd long")
        splits = parities.groupBy("file", "block").agg((F.sum("odd") % 2).cast("int").alias("odd"))
        along = Window.partitionBy("file").orderBy("block")
        before = F.coalesce(F.sum("odd").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        states = materialize(splits.withColumn("open", (before % 2).cast("int")), "split-states")
        ends = states.groupBy("file").agg((F.sum("odd") % 2).alias("odd")).filter("odd = 1").select("file")
        _refuse(text, ends, "ends inside a quote")
        placed = text.drop("path").join(_small(states.select("file", "block", "open")), ["file", "block"], "left")
        opened = F.coalesce("open", F.raise_error(F.lit("the files changed while they were read")).cast("int"))
        rows = placed.select("value", "file", "block", opened.alias("open")).mapInArrow(_quoted_records, _RECORD)
        stored = materialize(rows, "quoted-records")
    joined = joined_fragments(stored.filter(F.col("kind") != WHOLE), "\n")
    return stored.filter(F.col("kind") == WHOLE).select("value", "first").unionByName(joined.select("value", "first"))


def _small(states: DataFrame) -> DataFrame:
    n = states.count()
    if n > MAX_SPLITS:
        raise ValueError(f"{n} file splits; raise spark.sql.files.maxPartitionBytes")
    return F.broadcast(states)


def _refuse(text: DataFrame, files: DataFrame, why: str) -> None:
    """Raise if ``files`` has rows, naming up to three of their paths."""
    wrong = [r["file"] for r in files.limit(3).collect()]
    if wrong:
        named = text.select("file", "path").filter(F.col("file").isin(wrong)).distinct().collect()
        raise ValueError(f"{', '.join(sorted(r['path'] for r in named))}: {why}")


# ------------------------------------------------------------------ objects of a JSON document
def _outside(values: pa.Array, inside: np.ndarray) -> pa.Array:
    """What of each piece lies outside of strings; ``inside``: it begins in one."""
    plain = pc.replace_substring_regex(values, r'\\.', "")
    begun = pc.replace_substring_regex(plain, r'^[^"]*("|$)', "")
    return pc.replace_substring_regex(pc.if_else(pa.array(inside.astype(bool)), begun, plain), r'"[^"]*("|$)', "")


def _string_quotes(values: pa.Array) -> np.ndarray:
    """Quotes that open or close a string."""
    return _quotes(pc.replace_substring_regex(values, r'\\.', ""))


def _depths(values: pa.Array, inside: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Change of the brace and bracket depth over each piece, its closing brace included."""
    bare = _outside(values, inside)
    counts = [pc.count_substring(bare, c).to_numpy(zero_copy_only=False).astype(np.int64) for c in "{}[]"]
    return counts[0] - counts[1] - (after == 0), counts[2] - counts[3]


_SUMMARY = "file long, block long, odd int, braces0 long, brackets0 long, braces1 long, brackets1 long"


def _json_summaries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each split once: parity of its quotes, and its depth changes if it begins outside (0) or inside (1) a string."""
    now, total = None, [0] * 5
    names = [c.split()[0] for c in _SUMMARY.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 4]

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*now, *total), kinds)], names=names)

    for batch in batches:
        for file, block, rows in _runs(batch):
            if (file, block) != now:
                if now is not None:
                    yield row()
                now, total = (file, block), [0] * 5
            values = rows.column(0)
            ends = total[0] + np.cumsum(_string_quotes(values))
            begins = np.concatenate(([total[0]], ends[:-1]))
            for start in (0, 1):
                braces, brackets = _depths(values, (begins + start) & 1, (ends + start) & 1)
                total[1 + 2 * start] += int(braces.sum())
                total[2 + 2 * start] += int(brackets.sum())
            total[0] = int(ends[-1]) & 1
    if now is not None:
        yield row()


def _member_records(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces joined up to the brace that closes a member of a top-level array, as ``_RECORD`` rows."""
    now, inside, braces, brackets, held, kind = None, 0, 0, 0, [], WHOLE

    def rest() -> Iterator[pa.RecordBatch]:
        if held:
            yield _records(now, TAIL if kind == WHOLE else MIDDLE, ["".join(held)])

    for batch in batches:
        for file, block, rows in _runs(batch):
            if (file, block) != now:
                yield from rest()
                now, held = (file, block), []
                inside, braces, brackets = (int(rows.column(i)[0].as_py()) for i in (3, 4, 5))
                # pieces end with a brace, so a split that begins at these depths begins behind a member
                kind = WHOLE if block == 0 or (inside, braces, brackets) == (0, 1, 1) else HEAD
            values = rows.column(0)
            ends = inside + np.cumsum(_string_quotes(values))
            begins = np.concatenate(([inside], ends[:-1]))
            d, e = _depths(values, begins & 1, ends & 1)
            depth, width = braces + np.cumsum(d), brackets + np.cumsum(e)
            inside, braces, brackets = int(ends[-1]) & 1, int(depth[-1]), int(width[-1])
            closing = np.flatnonzero(((ends & 1) == 0) & (depth == 1) & (width == 1))
            texts, whole, lo = values.to_pylist(), [], 0
            for end in closing.tolist():
                held.extend(t + "}" for t in texts[lo : end + 1])
                lo = end + 1
                if kind == HEAD:
                    yield _records(now, HEAD, ["".join(held)])
                    kind = WHOLE
                else:
                    whole.append("".join(held))
                held.clear()
            held.extend(t + "}" for t in texts[lo:])
            if whole:
                yield _records(now, WHOLE, whole)
    yield from rest()


def last_object(text: str) -> str | None:
    """The object that ends ``text``, without what stands before it; ``None`` if none does."""
    opened: list[int] = []
    start, end, inside, skip = None, -1, False, False
    for at, c in enumerate(text):
        if skip:
            skip = False
        elif inside:
            skip, inside = c == "\\", c != '"'
        elif c == '"':
            inside = True
        elif c == "{":
            opened.append(at)
        elif c == "}":
            start, end = (opened.pop() if opened else None), at
    return text[start:] if start is not None and end == len(text) - 1 else None


def _members(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records without the text between members; the first ones of a document also lose its head."""
    for batch in batches:
        out = []
        for text in batch.column(0).to_pylist():
            bare = text.lstrip(_JSON_SPACE)
            after = bare[1:].lstrip(_JSON_SPACE) if bare.startswith(",") else ""
            found = after if after.startswith("{") else last_object(text)
            if found is not None:
                out.append(found)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])


_JSON_SPACE = " \t\r\n"


def json_members(spark: SparkSession, paths: list[str], split_bytes: int | None = None) -> DataFrame:
    """``value``: every object that is a member of an array of a document's top-level object.

    Documents may be laid out in any way, on one line or many, several in a file.  Raises
    if a file ends inside a document, naming it.  ``split_bytes`` replaces
    ``spark.sql.files.maxPartitionBytes``.
    """
    with _fixed_splits(spark, split_bytes):
        text = _pieces(spark, paths, "}")
        states = text.mapInArrow(_json_summaries, _SUMMARY)
        along = Window.partitionBy("file").orderBy("block")
        before = along.rowsBetween(Window.unboundedPreceding, -1)
        inside = (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).cast("int")
        known = states.withColumn("inside", inside)
        for name in ("braces", "brackets"):
            known = known.withColumn(name, F.when(F.col("inside") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1")))
        begun = [F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}_before") for n in ("braces", "brackets")]
        known = materialize(known.select("file", "block", "odd", "inside", "braces", "brackets", *begun), "split-states")
        total = known.groupBy("file").agg(*[F.sum(n).alias(n) for n in ("odd", "braces", "brackets")])
        # white space behind the last brace counts as one more piece
        broken = total.filter("odd % 2 <> 0 OR brackets <> 0 OR braces NOT IN (0, -1)").select("file")
        _refuse(text, broken, "ends inside a JSON document")
        starts = known.select("file", "block", "inside", "braces_before", "brackets_before")
        placed = text.drop("path").join(_small(starts), ["file", "block"], "left")
        inside = F.coalesce("inside", F.raise_error(F.lit("the files changed while they were read")).cast("int"))
        rows = placed.select("value", "file", "block", inside.alias("inside"), "braces_before", "brackets_before")
        stored = materialize(rows.mapInArrow(_member_records, _RECORD), "json-records")
    joined = joined_fragments(stored.filter(F.col("kind") != WHOLE), "")
    both = stored.filter(F.col("kind") == WHOLE).select("value").unionByName(joined.select("value"))
    return both.mapInArrow(_members, "value string")
