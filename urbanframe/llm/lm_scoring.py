"""Cross-entropy difference scoring with two n-gram models.

:func:`score_by_words` scores by word bigrams.  Both models share one vocabulary
without a cap: every word of the corpus.  Texts are dealt in blocks; a block's
distinct bigrams and words with their counts, packed, go to the part of the count
table that their hash names, where the counts of all blocks are summed and sent back
to the blocks that hold the n-gram.  Parts grow in number with the corpus, a frequent
n-gram is one entry of each block, and the driver sees three sums.

The other functions hold byte trigram models of bounded size.  A target and a background trigram model are matched: the same vocabulary, order
and smoothing, and counts of the whole corpus.  The vocabulary is the most
frequent bytes of the corpus; the others share one class and a boundary class
stands before every text.  Both are therefore tables of at most
``classes ** 3`` numbers, whatever the size of the corpus.  A document's score is
the mean over its tokens of target loss minus background loss, in bits: lower is
closer to the target.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanframe.llm.batches import text_slices
from urbanframe.llm.words import mixed, word_hashes
from urbanframe.session import materialize, shuffle_cleanup

BOUNDARY, OTHER = 0, 1  # classes
CLASSES = 128
PRIOR = 64.0  # weight of the word model in the bigram model, in words
PART_BYTES = 4 << 20  # coded text whose n-grams make one part of the count table
_FOLD = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Losses:
    """Loss in bits of every trigram, indexed (first * classes + second) * classes + third."""

    class_of: np.ndarray  # 256 bytes -> class
    classes: int
    target: np.ndarray
    background: np.ndarray


def _batch_bytes(column: pa.Array, class_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all texts, two boundaries before each, and each text's byte count."""
    data = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in column.to_pylist()]
    sizes = np.array([len(d) for d in data], dtype=np.int64)
    out = np.zeros(int(sizes.sum()) + 2 * len(data), dtype=np.int32)
    inside = np.ones(len(out), dtype=bool)
    begins = np.cumsum(sizes + 2) - sizes - 2
    inside[begins] = inside[begins + 1] = False
    out[inside] = class_of[np.frombuffer(b"".join(data), dtype=np.uint8)]
    return out, sizes


def _trigrams(codes: np.ndarray, classes: int) -> np.ndarray:
    """Trigram index of every position from the third; boundary positions are not tokens."""
    index = (codes[:-2] * classes + codes[1:-1]) * classes + codes[2:]
    return index[codes[2:] != BOUNDARY]


def byte_classes(df: DataFrame, text_col: str, classes: int = CLASSES) -> np.ndarray:
    """Class of each byte, from the byte counts of the whole corpus (256 rows a task)."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, dtype=np.int64)
        for batch in text_slices(batches, "text"):
            for t in batch.column(0).to_pylist():
                if t:
                    total += np.bincount(np.frombuffer(t.encode("utf-8", "surrogatepass"), dtype=np.uint8), minlength=256)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["byte", "n"])

    rows = df.select(F.col(text_col).alias("text")).mapInArrow(count, "byte int, n long")
    found = rows.groupBy("byte").agg(F.sum("n").alias("n")).collect()
    class_of = np.full(256, OTHER, dtype=np.int32)
    for i, row in enumerate(sorted(found, key=lambda r: (-r["n"], r["byte"]))[: classes - 2]):
        class_of[row["byte"]] = 2 + i
    return class_of


def trigram_counts(df: DataFrame, text_col: str, target: Column, class_of: np.ndarray, classes: int) -> DataFrame:
    """``gram, target, background`` over all rows; each task sums its own rows first.

    Null ``target`` counts as background.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, classes**3), dtype=np.int64)
        for batch in text_slices(batches, "text"):
            flags = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for side in (0, 1):
                codes, _ = _batch_bytes(batch.column(0).filter(pa.array(flags == (side == 0))), class_of)
                if len(codes) > 2:
                    total[side] += np.bincount(_trigrams(codes, classes), minlength=classes**3)
        used = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array(total[0][used]), pa.array(total[1][used])],
            names=["gram", "target", "background"],
        )

    rows = df.select(F.col(text_col).alias("text"), F.coalesce(target, F.lit(False)).alias("target"))
    partial = rows.mapInArrow(count, "gram int, target long, background long")
    return partial.groupBy("gram").agg(F.sum("target").alias("target"), F.sum("background").alias("background"))


def loss_table(counts: np.ndarray, classes: int) -> np.ndarray:
    """Bits of loss of every trigram: Witten-Bell interpolation down to the uniform distribution."""
    three = counts.reshape(classes, classes, classes).astype(float)
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))

    def mix(level: np.ndarray, lower: np.ndarray) -> np.ndarray:
        total = level.sum(axis=-1, keepdims=True)
        kinds = (level > 0).sum(axis=-1, keepdims=True)
        weight = np.divide(total, total + kinds, out=np.zeros_like(total), where=total > 0)
        return weight * np.divide(level, total, out=np.zeros_like(level), where=total > 0) + (1 - weight) * lower

    p1 = mix(one, np.full(classes, 1.0 / classes))
    p3 = mix(three, mix(two, p1[None, :])[None, :, :])
    return -np.log2(p3).astype(np.float32).ravel()


def train_losses(
    df: DataFrame, text_col: str, target: Column, classes: int = CLASSES, corpus: DataFrame | None = None
) -> Losses:
    """Both models from the whole of ``df``; the driver sees at most ``classes ** 3`` sums.

    ``corpus`` may name the same texts in a cheaper form for the byte counts.
    """
    class_of = byte_classes(df if corpus is None else corpus, text_col, classes)
    with shuffle_cleanup(df.sparkSession):
        sums = trigram_counts(df, text_col, target, class_of, classes).toPandas()
    tables = []
    for side in ("target", "background"):
        dense = np.zeros(classes**3, dtype=np.int64)
        dense[sums["gram"].to_numpy()] = sums[side].to_numpy()
        tables.append(loss_table(dense, classes))
    return Losses(class_of, classes, *tables)


def score_documents(df: DataFrame, id_col: str, text_col: str, losses: Losses) -> DataFrame:
    """Per row: ``id_col, n_tokens, target_bits, background_bits, score``.

    Bits are means per token (byte); an empty or null text has 0 tokens and null scores.
    """
    tables = df.sparkSession.sparkContext.broadcast(losses)  # bounded by the number of classes

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tables.value
        for batch in text_slices(batches, "text", 4 << 20):
            codes, sizes = _batch_bytes(batch.column(1), model.class_of)
            grams = _trigrams(codes, model.classes) if len(codes) > 2 else np.zeros(0, dtype=np.int32)
            ends = np.concatenate(([0], np.cumsum(sizes)))
            means = []
            for table in (model.target, model.background):
                sums = np.concatenate(([0.0], np.cumsum(table[grams], dtype=np.float64)))
                total = sums[ends[1:]] - sums[ends[:-1]]
                means.append(np.divide(total, sizes, out=np.full(len(sizes), np.nan), where=sizes > 0))
            none = sizes == 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes), *(pa.array(x, mask=none) for x in (*means, means[0] - means[1]))],
                names=["id", "n_tokens", "target_bits", "background_bits", "score"],
            )

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, target_bits double, background_bits double, score double"
    return rows.mapInArrow(score, schema).withColumnRenamed("id", id_col)


# ---------------------------------------------------------------- word bigrams
def _coded(rows: DataFrame) -> DataFrame:
    """One row a block of texts: ids, sides, word counts, its distinct words, and all its words as codes.

    Code 0 is the boundary that stands before and after the words of each text.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for nth, batch in enumerate(text_slices(batches, "text", 4 << 20)):
            words = [word_hashes((t or "").encode("utf-8", "surrogatepass")) for t in batch.column(1).to_pylist()]
            vocabulary, codes = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *words]), return_inverse=True)
            sizes = np.array([len(w) for w in words], dtype="<i8")
            fields = [
                pa.array([task + nth], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0)),
                pa.array([batch.column(2).to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()], pa.binary()),
                pa.array([sizes.tobytes()], pa.binary()),
                pa.array([vocabulary.astype("<u8").tobytes()], pa.binary()),
                pa.array([(codes + 1).astype("<u4").tobytes()], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(fields, names=["block", "ids", "sides", "sizes", "vocabulary", "codes"])

    kind = rows.schema["id"].dataType.simpleString()
    schema = f"block long, ids array<{kind}>, sides binary, sizes binary, vocabulary binary, codes binary"
    return rows.mapInArrow(run, schema)


class _Block:
    """The n-grams of a block: a key of each word and each bigram, sorted, and where they occur."""

    def __init__(self, sides: bytes, sizes: bytes, vocabulary: bytes, codes: bytes):
        self.sizes = np.frombuffer(sizes, dtype="<i8")
        words = np.concatenate((np.zeros(1, dtype=np.uint64), np.frombuffer(vocabulary, dtype="<u8")))
        used = self.sizes > 0
        n = self.sizes[used]
        ends = np.cumsum(n + 1)  # each text: its words, then a boundary
        self.next = np.zeros(int((n + 1).sum()), dtype=np.int64)
        inside = np.ones(len(self.next), dtype=bool)
        inside[ends - 1] = False
        self.next[inside] = np.frombuffer(codes, dtype="<u4")
        self.inside = inside
        self.side = np.repeat(np.frombuffer(sides, dtype=np.uint8)[used], n + 1)
        self.before = np.concatenate((np.zeros(1, dtype=np.int64), self.next[:-1]))[: len(self.next)]
        pairs, self.pair = np.unique(self.before * len(words) + self.next, return_inverse=True)
        # the last bit tells words from bigrams
        one = mixed(words) | np.uint64(1)
        two = mixed(words[pairs // len(words)] * _FOLD + words[pairs % len(words)]) & ~np.uint64(1)
        self.keys, place = np.unique(np.concatenate((one, two)), return_inverse=True)
        self.word_at, self.pair_at = place[: len(words)], place[len(words) :]

    def counts(self) -> list[np.ndarray]:
        """Occurrences of every key among the background texts and among the target texts."""
        out = []
        for side in (0, 1):
            own = self.side == side
            at = np.concatenate((self.word_at[self.next[own]], self.pair_at[self.pair[own]]))
            out.append(np.bincount(at, minlength=len(self.keys)))
        return out


def _planes(values: np.ndarray) -> bytes:
    """The first byte of all values, then the second, ...: shuffle files compress the bytes that hardly differ."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def _values(planes: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(planes, dtype=np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(raw.T).view(kind).ravel()


def _part_bounds(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each part of the sorted keys begins and the last one ends."""
    part = (keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
    return np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))


def _block_counts(coded: DataFrame, parts: int) -> DataFrame:
    """``part, block, keys, background, target``: each block's counts, cut by part."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = _Block(row["sides"], row["sizes"], row["vocabulary"], row["codes"])
                columns = [block.keys.astype("<u8"), *(c.astype("<u4") for c in block.counts())]
                gaps = lambda keys: np.diff(keys, prepend=np.zeros(1, dtype="<u8"))
                bounds = _part_bounds(block.keys, parts)
                held = np.flatnonzero(np.diff(bounds))
                cut = [[c[bounds[p] : bounds[p + 1]] for p in held] for c in columns]
                cut = [[_planes(gaps(x)) for x in cut[0]], *([_planes(x) for x in c] for c in cut[1:])]
                fields = [pa.array(held, pa.int32()), pa.array([row["block"]] * len(held), pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [*fields, *(pa.array(c, pa.binary()) for c in cut)],
                    names=["part", "block", "keys", "background", "target"],
                )

    columns = coded.select("block", "sides", "sizes", "vocabulary", "codes")
    return columns.mapInArrow(run, "part int, block long, keys binary, background binary, target binary")


_TOTALS = "block long, part int, background binary, target binary, kinds long, n_background long, n_target long"


def _corpus_counts(block_counts: DataFrame) -> DataFrame:
    """The corpus' counts of each block's keys, by block and part, and one row of sums a part (null block)."""

    def run(part: pa.Table) -> pa.Table:
        rows = part.to_pylist()
        keys = [np.cumsum(_values(r["keys"], "<u8"), dtype=np.uint64) for r in rows]
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        sums = []
        for side in ("background", "target"):
            total = np.zeros(len(distinct), dtype="<i8")
            np.add.at(total, place, np.concatenate([_values(r[side], "<u4") for r in rows]))
            sums.append(total)
        ends = np.cumsum([len(k) for k in keys])[:-1]
        each = np.split(place, ends)
        word = (distinct & np.uint64(1)).astype(bool)
        none = [None] * len(rows)
        columns = [
            [*(r["block"] for r in rows), None],
            [r["part"] for r in rows[:1]] * (len(rows) + 1),
            *([*(_planes(total[at]) for at in each), None] for total in sums),
            *([*none, int(n)] for n in (word.sum(), sums[0][word].sum(), sums[1][word].sum())),
        ]
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        names = [f.split()[0] for f in _TOTALS.split(", ")]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return block_counts.groupBy("part").applyInArrow(run, _TOTALS)


def score_by_words(df: DataFrame, id_col: str, text_col: str, target: Column, prior: float = PRIOR) -> DataFrame:
    """Per row: ``id_col, n_tokens, target_bits, background_bits, score``.

    Each model gives a word the probability ``(c(before, word) + prior * p(word)) /
    (c(before) + prior)`` with ``p(word) = (c(word) + 1) / (words + kinds of words)``,
    counted over all its texts; ``kinds`` is that of both.  Null ``target`` counts as
    background.  Bits are means per token (word); a text without words has 0 tokens and
    null scores.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(target, F.lit(False)).alias("target"))
    kind = rows.schema["id"].dataType.simpleString()
    coded = materialize(_coded(rows), "coded")
    text_bytes = coded.agg(F.sum(F.length("codes") + F.length("vocabulary"))).first()[0] or 0
    counts = materialize(_corpus_counts(_block_counts(coded, 1 + text_bytes // PART_BYTES)), "corpus-counts")
    sums = counts.filter("block is null").agg(*(F.sum(c) for c in ("kinds", "n_background", "n_target"))).first()
    kinds, words = sums[0] or 0, (sums[1] or 0, sums[2] or 0)
    fields = ["id", "n_tokens", "target_bits", "background_bits", "score"]

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = sorted(right.to_pylist(), key=lambda r: r["part"])
        tables = []
        for row in left.select(["sides", "sizes", "vocabulary", "codes"]).to_pylist():
            block = _Block(row["sides"], row["sizes"], row["vocabulary"], row["codes"])
            means = []
            for side, total in (("target", words[1]), ("background", words[0])):
                of = np.concatenate([np.zeros(0, dtype="<i8"), *(_values(r[side], "<i8") for r in parts)])
                word = (of[block.word_at] + 1) / (total + kinds)
                pair = of[block.pair_at][block.pair] + prior * word[block.next]
                bits = -np.log2(pair / (of[block.word_at][block.before] + prior))[block.inside]
                ends = np.concatenate(([0], np.cumsum(block.sizes)))
                running = np.concatenate(([0.0], np.cumsum(bits)))
                means.append((running[ends[1:]] - running[ends[:-1]]) / np.maximum(block.sizes, 1))
            none = block.sizes == 0
            ids = left["ids"].combine_chunks().flatten()
            scores = (pa.array(x, pa.float64(), mask=none) for x in (*means, means[0] - means[1]))
            tables.append(pa.table([ids, pa.array(block.sizes, pa.int64()), *scores], names=fields))
        return pa.concat_tables(tables)

    schema = f"id {kind}, n_tokens long, target_bits double, background_bits double, score double"
    answers = counts.filter("block is not null").select("block", "part", "background", "target")
    found = coded.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, schema)
    return found.withColumnRenamed("id", id_col)
