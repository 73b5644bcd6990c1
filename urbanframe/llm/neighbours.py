"""Approximate nearest neighbours by stable projections and kd-trees.

Largest inner product becomes smallest distance: every vector gets one more
coordinate that brings its norm to the largest norm in the table, a query gets
zero there.  Vectors are projected on a few Gaussian (2-stable) directions; the
squared projected distance over the squared true distance is then chi-square
distributed.  A kd-tree over the projections returns leaves by rising projected
distance, their vectors are verified in full, and a query stops as soon as a
vector as near as its k-th best would, with probability ``confidence``, have been
met already (chi-square test).

Vectors of one length are searched among their own.  Rows are dealt to shards of
bounded size, as large as that allows, since a query that sees more rows at once stops
sooner; every query block meets every shard, and the shards' best are merged.  Every
row is indexed.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urbanframe.session import materialize

SHARD_ROWS = 65_536  # at most, and
SHARD_BYTES = 128 << 20  # of their vectors as doubles
BLOCK_QUERIES = 8_192
LEAST_QUERIES = 256  # of a block that exists for parallelism only
DIRECTIONS = 8
LEAF_ROWS = 512  # verified at once: a product of this many rows costs little more than one of a few
MAX_LENGTHS = 100_000  # different lengths whose numbers are broadcast


def chi_square_quantile(p: float, degrees: int) -> float:
    """Quantile for an even number of degrees of freedom (closed distribution function, bisected)."""

    def cdf(x: float) -> float:
        half, term, total = x / 2, 1.0, 1.0
        for i in range(1, degrees // 2):
            term *= half / i
            total += term
        return 1 - math.exp(-half) * total

    lo, hi = 0.0, 1.0
    while cdf(hi) < p:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


class KdTree:
    """Median splits on the widest axis; nodes in heap order with their bounding boxes."""

    def __init__(self, points: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.points = points
        self.children: list[tuple[int, int] | None] = []
        self.rows: list[np.ndarray | tuple[int, int] | None] = []
        low, high = [], []

        def add(rows: np.ndarray) -> int:
            node = len(self.rows)
            box = points[rows]
            low.append(box.min(axis=0))
            high.append(box.max(axis=0))
            self.children.append(None)
            self.rows.append(rows)
            axis = int((high[-1] - low[-1]).argmax())
            if len(rows) > leaf_rows and high[-1][axis] > low[-1][axis]:
                order = rows[np.argpartition(box[:, axis], len(rows) // 2)]
                self.rows[node] = None
                half = len(rows) // 2
                self.children[node] = (add(order[:half]), add(order[half:]))
            return node

        add(np.arange(len(points)))
        self.low, self.high = np.array(low), np.array(high)

    def gather_leaves(self) -> np.ndarray:
        """The order of the points that brings each leaf's together; leaves then hold ``(from, to)`` in it."""
        order, at = [], 0
        for node, rows in enumerate(self.rows):
            if rows is not None:
                order.append(rows)
                self.rows[node] = (at, at := at + len(rows))
        return np.concatenate(order)

    def nearest_leaves(self, query: np.ndarray):
        """(squared distance to the box, from, to) of the leaves, nearest box first."""
        gap = np.maximum(0, np.maximum(self.low - query, query - self.high))
        bound = np.einsum("ij,ij->i", gap, gap).tolist()
        heap = [(bound[0], 0)]
        while heap:
            distance, node = heapq.heappop(heap)
            pair = self.children[node]
            if pair is None:
                yield distance, *self.rows[node]
            else:
                for child in pair:
                    heapq.heappush(heap, (bound[child], child))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat, dtype=np.float64).reshape(-1, dim)


def search_shard(
    ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray,
    largest: float, k: int, directions: np.ndarray, stop: float,
) -> tuple[list[int], list[int], list[float]]:
    """The ``k`` best (id, inner product) of one shard for each query, its own id left out."""
    # equal vectors are verified once; k + 1 smallest ids of each can appear in a result
    order = np.lexsort((ids, *vectors.T[::-1]))
    ids, vectors = ids[order], vectors[order]
    new = np.ones(len(ids), dtype=bool)
    new[1:] = (vectors[1:] != vectors[:-1]).any(axis=1)
    first = np.flatnonzero(new)
    last = np.minimum(np.append(first[1:], len(ids)), first + k + 1)
    distinct = vectors[first]
    norms = np.einsum("ij,ij->i", distinct, distinct)
    rest = np.sqrt(np.maximum(0, largest * largest - norms))
    tree = KdTree(np.concatenate((distinct, rest[:, None]), axis=1) @ directions)
    # the rows of a leaf lie together, so that a leaf is one slice
    order = tree.gather_leaves()
    distinct, first, last = distinct[order], first[order], last[order]
    projected = queries @ directions[:-1]
    out_q, out_id, out_score = [], [], []
    for qid, q, p in zip(query_ids.tolist(), queries, projected):
        base = largest * largest + float(q @ q)
        best: list[tuple[float, int]] = []  # a heap of (score, -id), the worst on top
        for bound, lo, hi in tree.nearest_leaves(p):
            if len(best) == k and bound >= stop * max(0.0, base - 2 * best[0][0]) and bound > 0:
                break
            scores = distinct[lo:hi] @ q
            keep = np.flatnonzero(scores >= best[0][0]) if len(best) == k else range(hi - lo)
            for j in keep:
                s, row = float(scores[j]), lo + j
                for i in ids[first[row] : last[row]].tolist():
                    if i == qid:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, (s, -i))
                    elif (s, -i) > best[0]:
                        heapq.heapreplace(best, (s, -i))
        for s, i in best:
            out_q.append(qid)
            out_id.append(-i)
            out_score.append(s)
    return out_q, out_id, out_score


def nearest_neighbours(
    df: DataFrame,
    id_col: str,
    vector_col: str,
    is_query: Column,
    k: int = 20,
    confidence: float = 0.95,
    seed: int = 5,
) -> DataFrame:
    """``query_id, rank, <id_col>, score``: each query row's ``k`` best other rows by inner product.

    Equal scores rank by smaller id.  A vector is compared with those of its own length.
    Rows without an id and vectors that are null, zero or hold null or non-finite
    components take no part; a row that occurs twice counts once.  Other columns are never
    read; an empty table gives an empty result.
    """
    finite = F.forall(
        F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    valid = (
        df.select(
            F.col(id_col).cast("long").alias("id"),
            F.col(vector_col).cast("array<double>").alias("v"),
            F.coalesce(is_query, F.lit(False)).alias("q"),
        )
        .filter(F.col("id").isNotNull() & F.col("v").isNotNull())
        .filter(finite & F.exists(F.col("v"), lambda x: x != 0.0))
        .dropDuplicates(["id", "v"])
    )
    schema = f"query_id long, rank int, {id_col} long, score double"
    norm = F.sqrt(F.aggregate(F.col("v"), F.lit(0.0), lambda a, x: a + x * x))
    stats = valid.groupBy(F.size("v").alias("dim")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("q").alias("queries"), F.max(norm).alias("largest")
    )
    # of each length: as many shards as their size asks for, and blocks to keep the cores busy
    room = F.least(F.lit(SHARD_ROWS), F.greatest(F.lit(1), F.floor(F.lit(SHARD_BYTES) / (8 * F.col("dim")))))
    shards = F.ceil(F.col("n") / room).cast("int")
    cores = F.least(F.ceil(F.lit(df.sparkSession.sparkContext.defaultParallelism) / F.col("shards")), F.ceil(F.col("queries") / LEAST_QUERIES))
    blocks = F.greatest(F.ceil(F.col("queries") / BLOCK_QUERIES), cores).cast("int")
    plan = materialize(stats.filter("queries > 0").withColumn("shards", shards).withColumn("blocks", blocks), "vector-lengths")
    if plan.isEmpty():
        return df.sparkSession.createDataFrame([], schema)
    stop = chi_square_quantile(confidence, DIRECTIONS)
    plan = plan.select("dim", "largest", "shards", "blocks")
    rows = valid.withColumn("dim", F.size("v")).join(F.broadcast(plan) if plan.count() <= MAX_LENGTHS else plan.hint("merge"), "dim")
    spread = F.xxhash64("id")

    def everywhere(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    points = rows.select("dim", "id", "v", "largest", F.pmod(spread, F.col("shards")).cast("int").alias("shard"), everywhere("blocks").alias("block"))
    queries = rows.filter("q").select(
        *[F.col(c).alias(c) for c in ("dim", "id", "v")], F.pmod(spread, F.col("blocks")).cast("int").alias("block"), everywhere("shards").alias("shard")
    )
    fields = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return fields.empty_table()
        dim = left["dim"][0].as_py()
        directions = np.random.default_rng(seed).normal(size=(dim + 1, DIRECTIONS))
        found = search_shard(
            left["id"].to_numpy(), _matrix(left["v"], dim), right["id"].to_numpy(), _matrix(right["v"], dim),
            left["largest"][0].as_py(), k, directions, stop,
        )
        return pa.table([pa.array(c, t) for c, t in zip(found, fields.types)], schema=fields)

    local = (
        points.groupBy("dim", "shard", "block")
        .cogroup(queries.groupBy("dim", "shard", "block"))
        .applyInArrow(search, "query_id long, id long, score double")
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    best = local.withColumn("rank", rank).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", F.col("id").alias(id_col), "score")
