"""Exact removal of repeated passages by super-k-mer partitioning.

A window is ``window`` consecutive words.  Its minimiser is the leftmost of its
``m``-word grams with the least hash.  Consecutive windows with the same minimiser
(at the same place) form a super-k-mer and travel as one packed string -- their
words joined by one space -- to the bucket of that minimiser.  Equal windows have
equal minimisers at equal places, so all copies of a window meet in one bucket,
where sorting the windows counts them exactly.

Three things keep that bounded:

* a minimiser that occurs once in the corpus cannot hold a repeated window; such
  super-k-mers do not travel (the count runs over hashes alone);
* equal packed strings are counted before they are bucketed, so a thousand copies
  of a document send one string;
* a bucket with more than ``hot_strings`` different strings (a common phrase in
  many contexts) is dealt out again by the minimisers of longer grams, of which those
  that occur once stay home too; only what is hot even then is dealt out window by
  window and counted by a plain aggregation.

Words are maximal runs of bytes other than space and 09-0D.  Null text has no
words.  Repeated rows are occurrences like any other; no column needs to be unique.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanframe.llm.batches import list_array, text_slices
from urbanframe.llm.words import mixed, row_keys, word_hashes
from urbanframe.session import materialize

WINDOW = 35
GRAM = 8
HOT_STRINGS = 128
_GRAM_BASE = np.uint64(0x9E3779B97F4A7C15)


def super_kmers(hashes: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser hash, first window, number of windows) of the super-k-mers of one text."""
    n = len(hashes) - window + 1
    if n <= 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    grams = len(hashes) - gram + 1
    value = hashes[:grams].copy()
    for j in range(1, gram):
        value *= _GRAM_BASE
        value += hashes[j : j + grams]
    value = mixed(value)
    inside = np.lib.stride_tricks.sliding_window_view(value, window - gram + 1)
    place = np.arange(n) + inside.argmin(axis=1)  # argmin takes the leftmost
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    return value[place[first]].view(np.int64), first, np.diff(np.append(first, n))


def _minimisers(keyed: DataFrame, window: int, gram: int) -> DataFrame:
    """One row a text: its super-k-mers as parallel arrays."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            found = [super_kmers(word_hashes((t or "").encode("utf-8", "surrogatepass")), window, gram)
                     for t in batch.column(2).to_pylist()]
            lengths = [len(f[0]) for f in found]
            columns = [list_array(np.concatenate([f[i] for f in found]), lengths, t)
                       for i, t in enumerate((pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=["k1", "k2", "hash", "at", "n"])

    return keyed.mapInArrow(run, "k1 long, k2 long, hash array<long>, at array<long>, n array<long>")


def _pack(texts: DataFrame, window: int) -> DataFrame:
    """Packed strings of the listed super-k-mers of each text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", 4 << 20):
            rows = []
            for k1, k2, text, kept in zip(*(c.to_pylist() for c in batch.columns)):
                words = text.encode("utf-8", "surrogatepass").split()
                for s in kept:
                    packed = b" ".join(words[s["at"] : s["at"] + s["n"] + window - 1])
                    rows.append((k1, k2, s["at"], s["hash"], hashlib.md5(packed).digest(), packed))
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), _PACKED)]
            yield pa.RecordBatch.from_arrays(columns, schema=_PACKED)

    return texts.mapInArrow(run, "k1 long, k2 long, at long, hash long, digest binary, packed binary")


_PACKED = pa.schema(
    [("k1", pa.int64()), ("k2", pa.int64()), ("at", pa.int64()), ("hash", pa.int64()),
     ("digest", pa.binary()), ("packed", pa.binary())]
)


def windows_of(packed: bytes, window: int) -> list[bytes]:
    """The windows of a packed string, each as its own packed string."""
    ends, at = [], packed.find(b" ")
    while at >= 0:
        ends.append(at)
        at = packed.find(b" ", at + 1)
    ends.append(len(packed))
    starts = [0] + [e + 1 for e in ends]
    return [packed[starts[r] : ends[r + window - 1]] for r in range(len(ends) - window + 1)]


def repeated_in_bucket(strings: list[tuple[bytes, int]], window: int) -> list[list[int]]:
    """For each (packed string, occurrences): its windows that occur at least twice in the bucket."""
    if len(strings) == 1:  # windows of one string differ: each is as frequent as the string
        packed, n = strings[0]
        return [list(range(packed.count(b" ") + 2 - window)) if n > 1 else []]
    listed = [(w, i, r) for i, (packed, _) in enumerate(strings) for r, w in enumerate(windows_of(packed, window))]
    listed.sort()
    out: list[list[int]] = [[] for _ in strings]
    for _, run in groupby(listed, key=lambda x: x[0]):
        same = list(run)
        if sum(strings[i][1] for _, i, _ in same) > 1:
            for _, i, r in same:
                out[i].append(r)
    return out


def _count_buckets(strings: DataFrame, window: int) -> DataFrame:
    """``digest, windows``: the repeated windows of each string, bucket by bucket."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns))

        held: list[tuple[bytes, list[int]]] = []
        for _, bucket in groupby(rows(), key=lambda x: x[0]):
            members = list(bucket)
            found = repeated_in_bucket([(packed, n) for _, _, packed, n in members], window)
            held += [(digest, sorted(w)) for (_, digest, _, _), w in zip(members, found) if w]
            if len(held) > 20_000:
                yield _found(held)
                held = []
        if held:
            yield _found(held)

    ordered = strings.repartition("hash").sortWithinPartitions("hash")
    return ordered.mapInArrow(run, "digest binary, windows array<int>")


def _found(rows: list[tuple[bytes, list[int]]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([d for d, _ in rows], pa.binary()), pa.array([w for _, w in rows], pa.list_(pa.int32()))],
        names=["digest", "windows"],
    )


def _count_windows(strings: DataFrame, window: int) -> DataFrame:
    """The same for buckets that stay hot: single windows, summed by Spark before they are shuffled."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "packed", 1 << 20):
            rows = [
                (digest, r, w, n)
                for digest, packed, n in zip(*(c.to_pylist() for c in batch.columns))
                for r, w in enumerate(windows_of(packed, window))
            ]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.int32(), pa.binary(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["digest", "r", "window", "n"])

    single = strings.select("digest", "packed", "n").mapInArrow(run, "digest binary, r int, window binary, n long")
    often = single.groupBy("window").agg(F.sum("n").alias("_n")).filter("_n > 1").select("window")
    often = materialize(often, "repeated-hot-windows")
    return single.join(often, "window").groupBy("digest").agg(F.collect_set("r").alias("windows"))


def _parted(strings: DataFrame, window: int, gram: int) -> DataFrame:
    """The super-k-mers of packed strings by longer grams: ``owner`` is the string, ``at`` the place in it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "packed", 1 << 20):
            rows = []
            for bucket, owner, packed, n in zip(*(c.to_pylist() for c in batch.columns)):
                words = packed.split(b" ")
                found = super_kmers(word_hashes(packed), window, gram)
                hashes = mixed(found[0].view(np.uint64) ^ np.int64(bucket).view(np.uint64)).view(np.int64)
                for hashed, at, windows in zip(hashes.tolist(), found[1].tolist(), found[2].tolist()):
                    part = b" ".join(words[at : at + windows + window - 1])
                    rows.append((owner, n, at, hashed, hashlib.md5(part).digest(), part))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PART)], schema=_PART)

    listed = strings.select("hash", "digest", "packed", "n")
    return listed.mapInArrow(run, "owner binary, n long, at int, hash long, digest binary, packed binary")


_PART = pa.schema(
    [("owner", pa.binary()), ("n", pa.int64()), ("at", pa.int32()), ("hash", pa.int64()),
     ("digest", pa.binary()), ("packed", pa.binary())]
)


def _count_hot(strings: DataFrame, window: int, gram: int, hot_strings: int) -> DataFrame:
    """The same for hot buckets: dealt out again by longer grams.

    Equal windows of a bucket have equal minimisers of any length at equal places.
    """
    parts = materialize(_parted(strings, window, gram), "hot-parts")
    often = parts.groupBy("hash").agg(F.sum("n").alias("_n")).filter("_n > 1").select("hash")
    parts = materialize(parts.join(materialize(often, "repeated-hot-minimisers"), "hash"), "kept-parts")
    again = materialize(parts.groupBy("hash", "digest", "packed").agg(F.sum("n").alias("n")), "part-strings")
    plain, hot = _by_heat(again, hot_strings)
    found = materialize(_count_buckets(plain, window).unionByName(_count_windows(hot, window)), "repeated-in-parts")
    starts = F.transform("windows", lambda r: r + F.col("at"))
    placed = parts.join(found, "digest").select("owner", starts.alias("s"))
    return placed.groupBy(F.col("owner").alias("digest")).agg(F.flatten(F.collect_set("s")).alias("windows"))


def _by_heat(strings: DataFrame, hot_strings: int) -> tuple[DataFrame, DataFrame]:
    """The strings of plain buckets, and those of buckets with more than ``hot_strings``."""
    hot = strings.groupBy("hash").agg(F.count(F.lit(1)).alias("_s")).filter(F.col("_s") > hot_strings)
    hot = materialize(hot.select("hash", F.lit(True).alias("hot")), "hot-minimisers")
    plain = strings.join(hot, "hash", "left_anti").select("hash", "digest", "packed", "n")
    return plain, strings.join(hot, "hash", "left_semi")


def repeated_windows(keyed: DataFrame, window: int = WINDOW, gram: int = GRAM, hot_strings: int = HOT_STRINGS) -> DataFrame:
    """``k1, k2, starts``: per text key, the first words of its repeated windows.

    ``keyed`` holds ``k1, k2, text``; texts without a repeated window are absent.
    """
    mins = materialize(_minimisers(keyed, window, gram), "minimisers")
    each = mins.select("k1", "k2", F.explode(F.arrays_zip("hash", "at", "n")).alias("s")).select("k1", "k2", "s.*")
    often = each.groupBy("hash").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").select("hash")
    # a table of its own: both sides of the join are then plain exchanges, which Spark splits if a hash is hot
    often = materialize(often, "repeated-minimisers")
    kept = each.join(often, "hash").groupBy("k1", "k2").agg(F.collect_set(F.struct("hash", "at", "n")).alias("kept"))
    kept = materialize(kept, "kept-minimisers")
    texts = keyed.join(kept, ["k1", "k2"]).select("k1", "k2", "text", "kept")
    packed = materialize(_pack(texts, window), "super-kmers")

    strings = packed.groupBy("hash", "digest", "packed").agg(F.count(F.lit(1)).alias("n"))
    strings = materialize(strings, "strings")
    plain, hot = _by_heat(strings, hot_strings)
    longer = (gram + 3 * window) // 4  # nearly a window: parts are short, and few of them meet by a common phrase alone
    found = _count_buckets(plain, window).unionByName(_count_hot(hot, window, longer, hot_strings))
    found = materialize(found, "repeated-windows")
    starts = F.transform("windows", lambda r: r.cast("long") + F.col("at"))
    return (
        packed.select("k1", "k2", "at", "digest")
        .join(found, "digest")
        .select("k1", "k2", starts.alias("s"))
        .groupBy("k1", "k2")
        .agg(F.flatten(F.collect_set("s")).alias("starts"))
    )


def cut_words(text: str, starts: Iterable[int], window: int) -> tuple[str, int, int]:
    """(kept words joined by one space, words, removed words)."""
    words = text.encode("utf-8", "surrogatepass").split()
    starts = np.asarray(starts, dtype=np.int64)
    n, removed = len(words), 0
    if len(starts):
        edge = np.zeros(n + 1, dtype=np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + window, -1)
        gone = np.cumsum(edge[:n]) > 0
        removed = int(gone.sum())
        words = [w for w, g in zip(words, gone.tolist()) if not g]
    return b" ".join(words).decode("utf-8", "surrogatepass"), n, removed


def _cutter(window: int):
    @F.pandas_udf("kept string, n_words long, n_removed long")
    def cut(text: pd.Series, starts: pd.Series) -> pd.DataFrame:
        rows = [cut_words(t or "", () if s is None else s, window) for t, s in zip(text, starts)]
        return pd.DataFrame(rows, columns=["kept", "n_words", "n_removed"])

    return cut


def _with_starts(df: DataFrame, text: Column, id_: Column, window: int, gram: int, hot_strings: int) -> DataFrame:
    """``row`` (all columns), ``text`` and ``starts`` (null: nothing repeated)."""
    rows = df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"), *row_keys(id_, text), text.alias("text"))
    found = materialize(repeated_windows(rows.select("k1", "k2", "text"), window, gram, hot_strings), "repeated-starts")
    return rows.join(found, ["k1", "k2"], "left").select("row", "text", "starts")


def remove_repeated_passages(
    df: DataFrame, id_col: str, text_col: str, window: int = WINDOW, gram: int = GRAM, hot_strings: int = HOT_STRINGS
) -> DataFrame:
    """Per row: ``id_col, n_words, n_removed, kept`` (kept words joined by one space).

    A word goes if a window that covers it starts anywhere else too, in the same
    or another row.  Texts shorter than a window lose nothing.
    """
    slim = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = _with_starts(slim, F.col("text"), F.col("id"), window, gram, hot_strings)
    cut = found.select(F.col("row.id").alias(id_col), _cutter(window)("text", "starts").alias("c"))
    return cut.select(id_col, "c.n_words", "c.n_removed", "c.kept")


def cut_repeated_passages(
    df: DataFrame, id_col: str, text_col: str, window: int = WINDOW, gram: int = GRAM, hot_strings: int = HOT_STRINGS
) -> DataFrame:
    """All rows and columns of ``df``; only a text that loses words is changed."""
    found = _with_starts(df, F.col(text_col), F.col(id_col), window, gram, hot_strings)
    kept = F.when(F.col("starts").isNull(), F.col("text")).otherwise(_cutter(window)("text", "starts")["kept"])
    return found.withColumn("new", kept).select(
        *[F.col("new").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in df.columns]
    )
