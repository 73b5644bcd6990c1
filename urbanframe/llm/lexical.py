"""Ranked lexical search by exact inner products over a sparse ball tree.

A document is a sparse vector of term impacts, a query the weights of its terms, and
the score their inner product, all in 64-bit integers.  Documents pass a task in
chunks; each chunk becomes a ball tree, whose nodes are split at the median of the
line through two far documents.  A node's documents lie within a radius of its
centroid, so no score in it exceeds ``query . centroid + |query| * radius``.  Nodes
are opened best bound first, and a query leaves the tree as soon as no bound reaches
its last ranked score.  Leaves are scored exactly.

Bounds are computed in doubles.  The impacts and weights are integers below 2**53;
sums of at most 2**15 products lose less than 2**15 * 2**-53 of their size, so bounds are
widened by a relative 1e-9 of every term that enters them, and by one, and can only
be too large.  The coordinates are scaled by the root of the term's weight on both
sides, which leaves inner products alone and evens the radii.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from urbanframe.llm.batches import list_array, text_slices
from urbanframe.session import materialize

# ASCII letters and digits and all other scripts' bytes belong to terms; the rest parts them
_FOLD = bytes(
    b if b >= 0x80 else ord(chr(b).lower()) if chr(b).isalnum() else 0x20 for b in range(256)
)
CHUNK_DOCS = 4_096
CHUNK_POSTINGS = 1 << 20
LEAF_DOCS = 64
BLOCK_ITEMS = 256
BLOCK_TERMS = 1 << 15
SLACK = 1e-9
NO_ID = np.iinfo(np.int64).max  # a null id ranks last among equal scores
SALTS = 32


def terms_of(text: str | None) -> list[bytes]:
    """Terms in order, with repeats; null has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def term_vectors(docs: DataFrame, id_col: str, text_col: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """``id, n, terms, counts`` of every row: all its terms, and those of the vocabulary with their occurrences."""

    def vectors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            sizes, lengths, terms, counts = [], [], [], []
            for text in batch.column(1).to_pylist():
                words = terms_of(text)
                found = [(vocabulary[w], c) for w, c in Counter(words).items() if w in vocabulary]
                sizes.append(len(words))
                lengths.append(len(found))
                terms.extend(t for t, _ in found)
                counts.extend(c for _, c in found)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    list_array(np.array(terms, np.int32), lengths, pa.int32()),
                    list_array(np.array(counts, np.int64), lengths, pa.int64()),
                ],
                names=["id", "n", "terms", "counts"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(vectors, "id long, n long, terms array<int>, counts array<bigint>")


def term_weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def impacts(counts: np.ndarray, n: np.ndarray, documents: int, occurrences: int) -> np.ndarray:
    """Integer impact of terms with these occurrences in documents of ``n`` terms."""
    m = 10 + 90 * n * documents // occurrences
    return 1_000_000_000 * counts // (1000 * counts + 8 * m)


class BallTree:
    """Documents as rows of a sparse matrix, reordered so that every node is a range of them."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, terms: np.ndarray, values: np.ndarray, scale: np.ndarray):
        self.ids, self.sizes, self.terms, self.values = ids, sizes, terms, values
        self.scale = scale
        self.range: list[tuple[int, int]] = []
        self.children: list[tuple[int, int] | None] = []
        self.centroids: list[np.ndarray] = []
        self.radii: list[float] = []
        self.starts = np.concatenate(([0], np.cumsum(sizes)))
        self._grow(0, len(ids))
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))

    def _dots(self, lo: int, hi: int, dense: np.ndarray) -> np.ndarray:
        """Inner products of the rows ``lo..hi`` with a dense vector (every row has a term)."""
        a, b = self.starts[lo], self.starts[hi]
        return np.add.reduceat(dense[self.terms[a:b]] * self.values[a:b], self.starts[lo:hi] - a)

    def _row(self, i: int) -> np.ndarray:
        a, b = self.starts[i], self.starts[i + 1]
        out = np.zeros(len(self.scale))
        out[self.terms[a:b]] = self.values[a:b] * self.scale[self.terms[a:b]]
        return out

    def _grow(self, lo: int, hi: int) -> int:
        node, scale = len(self.range), self.scale
        a, b = self.starts[lo], self.starts[hi]
        entries = self.values[a:b] * scale[self.terms[a:b]]
        centre = np.bincount(self.terms[a:b], entries, len(scale)) / (hi - lo)
        norms = np.add.reduceat(entries * entries, self.starts[lo:hi] - a)
        own = float(centre @ centre)
        squares = norms - 2 * self._dots(lo, hi, centre * scale) + own
        widened = np.maximum(squares, 0) + SLACK * (norms + own)
        self.range.append((lo, hi))
        self.centroids.append(centre)
        self.radii.append(math.sqrt(float(widened.max())))
        self.children.append(None)
        if hi - lo > LEAF_DOCS and self.radii[node] > 0:
            far = self._row(lo + int(squares.argmax()))
            away = norms - 2 * self._dots(lo, hi, far * scale)
            along = self._dots(lo, hi, (far - self._row(lo + int(away.argmax()))) * scale)
            half = (hi - lo) // 2
            self._reorder(lo, hi, np.argpartition(along, half))
            self.children[node] = (self._grow(lo, lo + half), self._grow(lo + half, hi))
        return node

    def _reorder(self, lo: int, hi: int, order: np.ndarray) -> None:
        a, b = self.starts[lo], self.starts[hi]
        sizes, first = self.sizes[lo:hi][order], (self.starts[lo:hi] - a)[order]
        ends = np.cumsum(sizes)
        place = np.repeat(first - (ends - sizes), sizes) + np.arange(b - a)
        self.terms[a:b], self.values[a:b] = self.terms[a:b][place], self.values[a:b][place]
        self.ids[lo:hi], self.sizes[lo:hi] = self.ids[lo:hi][order], sizes
        self.starts[lo : hi + 1] = a + np.concatenate(([0], ends))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bound of every score, by node and query (columns of ``queries``)."""
        scaled = queries / self.scale[:, None]
        inner = np.stack(self.centroids) @ scaled
        reach = np.outer(self.radii, np.sqrt((scaled * scaled).sum(axis=0)))
        return (inner + reach) * (1 + SLACK) + 1

    def search(self, weights: np.ndarray, bound: list[float], best: list[tuple[int, int]], k: int) -> int:
        """Bring ``best``, a heap of (score, -id), up to date; returns the leaves scored."""
        heap, opened = [(-bound[0], 0)], 0
        while heap:
            reach, node = heapq.heappop(heap)
            if len(best) == k and -reach < best[0][0]:
                break  # equal scores may still rank by a lesser id
            pair = self.children[node]
            if pair is not None:
                for child in pair:
                    heapq.heappush(heap, (-bound[child], child))
                continue
            opened += 1
            lo, hi = self.range[node]
            scores = self._dots(lo, hi, weights)
            floor = best[0][0] if len(best) == k else 1
            for i in np.flatnonzero(scores >= max(floor, 1)):
                entry = (int(scores[i]), -int(self.ids[lo + i]))
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        return opened


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of several batches together, bounded in rows and postings."""
    held: list[pa.RecordBatch] = []
    rows = postings = 0
    for batch in batches:
        at = 0
        ends = batch.column("terms").offsets.to_numpy()
        while at < batch.num_rows:
            fit = int(np.searchsorted(ends, ends[at] + CHUNK_POSTINGS - postings, side="right")) - 1
            upto = max(min(fit, at + CHUNK_DOCS - rows, batch.num_rows), at if rows else at + 1)
            if upto > at:
                held.append(batch.slice(at, upto - at))
                rows, postings, at = rows + upto - at, postings + int(ends[upto] - ends[at]), upto
            if at < batch.num_rows or rows >= CHUNK_DOCS:
                yield pa.Table.from_batches(held)
                held, rows, postings = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def _flat(table: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.array(table[name].combine_chunks().flatten().to_numpy(zero_copy_only=False), dtype=kind)


def _item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[dict]:
    """Items with their distinct terms, in blocks of bounded size; rows of one id are one item."""
    block: dict = {}
    size = 0
    rows = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).orderBy("id")
    for row in rows.toLocalIterator():
        terms = set(terms_of(row["text"]))
        if row["id"] not in block and block and (len(block) >= BLOCK_ITEMS or size + len(terms) > BLOCK_TERMS):
            yield block
            block, size = {}, 0
        block.setdefault(row["id"], set()).update(terms)
        size += len(terms)
    if block:
        yield block


def ranked_search(
    docs: DataFrame, id_col: str, text_col: str, items: DataFrame, item_col: str, item_text_col: str, k: int = 10
) -> DataFrame:
    """``<item_col>, rank, <id_col>, score``: each item's ``k`` best documents with a score above 0.

    Terms are runs of ASCII letters and digits and of characters beyond ASCII, A-Z in
    lower case.  Statistics cover all rows of ``docs``; equal scores rank by rising id, a
    null id last.  A null or empty text holds no term, counts in no statistic and is never
    found; rows that repeat an id are documents of their own; rows of ``items`` with one id
    (null too) are one item with all their terms.  Empty tables give an empty result, and
    other columns are never read.

    Items come to the driver in blocks of at most 256 items and 32,768 terms (or one
    item); each block meets all documents.  Tasks hold one chunk of documents at a time.
    """
    spark = docs.sparkSession
    kind = items.schema[item_col].dataType
    schema = f"item {kind.simpleString()}, id long, score long"
    parts: list[DataFrame] = []
    for block in _item_blocks(items, item_col, item_text_col):
        vocabulary = {t: i for i, t in enumerate(sorted(set().union(*block.values())))}
        if vocabulary:
            vectors = materialize(term_vectors(docs, id_col, text_col, vocabulary), "term-vectors")
            parts.append(_search_block(vectors, block, vocabulary, to_arrow_type(kind), schema, k))
    if not parts:
        local = spark.createDataFrame([], schema)
    else:
        local = parts[0]
        for part in parts[1:]:
            local = local.unionByName(part)
    order = [F.desc("score"), F.asc_nulls_last("id")]
    first = F.row_number().over(Window.partitionBy("item", F.pmod(F.xxhash64("id"), F.lit(SALTS))).orderBy(*order))
    final = F.row_number().over(Window.partitionBy("item").orderBy(*order))
    some = local.withColumn("rank", first).filter(F.col("rank") <= k)
    ranked = some.withColumn("rank", final).filter(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def _search_block(
    vectors: DataFrame, block: dict, vocabulary: dict[bytes, int], kind: pa.DataType, schema: str, k: int
) -> DataFrame:
    totals = vectors.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("occurrences")).first()
    documents, occurrences = totals["documents"], totals["occurrences"] or 0
    holding = np.zeros(len(vocabulary), dtype=np.int64)
    # at most one row per term of the block
    for row in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        holding[row["t"]] = row["count"]
    weight = np.array([term_weight(documents, int(d)) for d in holding], dtype=np.int64)
    names = list(block)
    members = [np.array(sorted(vocabulary[t] for t in block[name]), dtype=np.int64) for name in names]

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = np.zeros((len(vocabulary), len(names)))
        for j, own in enumerate(members):
            queries[own, j] = weight[own]
        scale = np.sqrt(np.maximum(weight, 1).astype(np.float64))
        best: list[list[tuple[int, int]]] = [[] for _ in names]
        exact = np.zeros(len(vocabulary), dtype=np.int64)
        for chunk in _chunks(batches):
            sizes = np.diff(chunk["terms"].combine_chunks().offsets.to_numpy()).astype(np.int64)
            n = np.repeat(chunk["n"].to_numpy(), sizes)
            values = impacts(_flat(chunk, "counts", np.int64), n, documents, occurrences)
            ids = np.array(chunk["id"].fill_null(int(NO_ID)).to_numpy())
            tree = BallTree(ids, sizes, _flat(chunk, "terms", np.int64), values, scale)
            bounds = tree.bounds(queries)
            for j, own in enumerate(members):
                exact[own] = weight[own]
                tree.search(exact, bounds[:, j].tolist(), best[j], k)
                exact[own] = 0
        rows = [(names[j], None if -i == NO_ID else -i, s) for j, held in enumerate(best) for s, i in held]
        if rows:
            columns = zip(zip(*rows), (kind, pa.int64(), pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=["item", "id", "score"])

    return vectors.filter(F.size("terms") > 0).mapInArrow(search, schema)
