"""Best-fit packing of token sequences by a configuration linear program.

A configuration is a multiset of piece lengths that fits one sequence.  Over the
length histogram, the covering program "fewest sequences so that every length is
covered" is solved by multiplicative weights: every length carries a weight that
shrinks as it is covered, and the next configurations are priced by a knapsack
dynamic program over those weights.  The fractional solution is rounded down to
whole counts that never cover a length more often than it occurs; what remains is
rounded up one configuration after the other, each the knapsack's best for the pieces
that are left.  All of this sees at most ``capacity`` histogram rows, whatever the
number of documents.

Pieces then find their places without gathering: every piece knows its rank among
the pieces of its length, and the plan says which sequence and offset a rank has.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urbanframe.llm.batches import text_slices
from urbanframe.llm.library_ids import REMEMBERED, encoder
from urbanframe.session import materialize

Pattern = tuple[tuple[int, int], ...]  # (length, how often), longest first

MAX_BASE_ROWS = 1_000_000  # of 24 bytes
NEIGHBOURS = 8  # tokens by which lengths differ that share their price

# ---------------------------------------------------------------- the plan (driver, histogram only)
def knapsack(lengths: np.ndarray, values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value for every capacity, and the index of an item in a best choice (-1: none).

    ``lengths`` rises strictly.
    """
    best = np.zeros(capacity + 1)
    item = np.full(capacity + 1, -1, dtype=np.int64)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        k = fits[c]
        best[c], item[c] = best[c - 1], -2  # -2: leave one token free
        if k:
            with_item = best[c - lengths[:k]] + values[:k]
            i = int(with_item.argmax())
            if with_item[i] > best[c]:
                best[c], item[c] = with_item[i], i
    return best, item


def _trace(first: int, capacity: int, lengths: np.ndarray, item: np.ndarray) -> dict[int, int]:
    chosen: dict[int, int] = defaultdict(int)
    chosen[first] += 1
    c = capacity - int(lengths[first])
    while c > 0 and item[c] != -1:
        if item[c] == -2:
            c -= 1
        else:
            chosen[int(item[c])] += 1
            c -= int(lengths[item[c]])
    return chosen


def fractional_cover(
    counts: dict[int, int], capacity: int, rounds: int = 120, per_round: int = 64, eps: float = 0.1
) -> tuple[dict[Pattern, float], float, np.ndarray]:
    """Sequences per configuration (covering every length), a lower bound of their sum, and prices by length.

    The prices are the weights of the later two thirds of the rounds on average, a dual
    solution, evened out over lengths that differ by ``NEIGHBOURS`` tokens or less.
    Each round prices by one knapsack and takes up to ``per_round`` configurations
    worth at least ``1 - eps`` of the best one, those for the least covered lengths.
    """
    lengths = np.array(sorted(counts), dtype=np.int64)
    need = np.array([counts[int(x)] for x in lengths], dtype=float)
    covered = np.zeros(len(lengths))
    taken: dict[Pattern, float] = defaultdict(float)
    weights = np.zeros(len(lengths))
    bound, rate = 0.0, np.log(max(len(lengths), 2)) / eps / 4
    for turn in range(rounds):
        low = covered.min()
        weight = np.exp(-rate * (covered - low)) / need
        best, item = knapsack(lengths, weight, capacity)
        bound = max(bound, float((weight * need).sum() / best[capacity]))
        if turn >= rounds // 3:
            weights += weight / best[capacity]
        forced = weight + best[capacity - lengths]
        good = np.flatnonzero(forced >= (1 - eps) * best[capacity])
        for first in good[np.argsort(covered[good], kind="stable")][:per_round].tolist():
            if covered[first] > low + eps:
                continue
            chosen = _trace(first, capacity, lengths, item)
            at = np.fromiter(chosen, dtype=np.int64)
            times = np.fromiter(chosen.values(), dtype=np.int64)
            step = eps * float((need[at] / times).min())
            covered[at] += step * times / need[at]
            taken[tuple((int(lengths[i]), n) for i, n in sorted(chosen.items(), reverse=True))] += step
    scale = covered.min()
    if scale <= 0:  # some length was never worth pricing: its own configuration covers it
        scale = max(float(np.median(covered)), eps)
    prices = np.zeros(capacity + 1)
    for length in lengths:
        near = np.abs(lengths - length) <= NEIGHBOURS
        prices[length] = (weights[near] * need[near]).sum() / need[near].sum()
    prices[lengths] = np.maximum.accumulate(prices[lengths])  # a longer piece takes no less room
    return {p: x / scale for p, x in taken.items()}, bound, prices


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing on counts: (configuration, number of such sequences); what plans are compared with."""
    free: dict[int, dict[Pattern, int]] = defaultdict(dict)  # room left -> open sequences
    rooms: list[int] = []

    def put(room: int, pattern: Pattern, n: int) -> None:
        if not free[room]:
            insort(rooms, room)
        free[room][pattern] = free[room].get(pattern, 0) + n

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                put(capacity, (), -(-left // (capacity // length)))
                continue
            room = rooms[at]
            pattern, n = next(iter(free[room].items()))
            each = min(room // length, left)
            used = min(n, left // each)
            free[room].pop(pattern)
            if n > used:
                free[room][pattern] = n - used
            if not free[room]:
                rooms.pop(at)
            put(room - each * length, (*pattern, (length, each)), used)
            left -= used * each
    return [(p, n) for patterns in free.values() for p, n in patterns.items() if p]


def dive(left: dict[int, int], prices: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Configurations that take every piece of ``left``, each the best one under ``prices`` for what is left.

    A configuration begins with the longest piece left and goes on as the knapsack's table
    says, at every step with the best piece that there still is; it is repeated as often
    as its pieces allow.  ``prices`` are by length.
    """
    lengths = np.array(sorted(left), dtype=np.int64)
    count = np.array([left[int(x)] for x in lengths], dtype=np.int64)
    best, _ = knapsack(lengths, prices[lengths], capacity)
    plan: list[tuple[Pattern, int]] = []
    top = len(lengths) - 1
    while top >= 0:
        if not count[top]:
            top -= 1
            continue
        chosen, room = {top: 1}, capacity - int(lengths[top])
        taken = np.zeros(len(lengths), dtype=np.int64)
        taken[top] = 1
        while room >= lengths[0]:
            fits = int(np.searchsorted(lengths, room, side="right"))
            worth = np.where(count[:fits] > taken[:fits], best[room - lengths[:fits]] + prices[lengths[:fits]], -1.0)
            at = fits - 1 - int(worth[::-1].argmax())  # the longest of equally good ones
            if worth[at] < 0:
                break
            chosen[at] = chosen.get(at, 0) + 1
            taken[at] += 1
            room -= int(lengths[at])
        n = min(int(count[at]) // times for at, times in chosen.items())
        for at, times in chosen.items():
            count[at] -= n * times
        plan.append((tuple((int(lengths[at]), times) for at, times in sorted(chosen.items(), reverse=True)), n))
    return plan


def plan_sequences(counts: dict[int, int], capacity: int) -> tuple[list[tuple[Pattern, int]], float]:
    """Configurations with whole counts that hold every piece exactly once, and a lower bound of their number.

    The program's configurations are taken as often as their whole parts say, and never
    more often than there are pieces.  The pieces left are rounded up by :func:`dive`,
    under the program's prices and under the tokens themselves (which are optimal prices
    where full sequences are possible throughout); the shorter plan counts.
    """
    tokens = sum(length * n for length, n in counts.items())
    left = {length: n for length, n in counts.items() if n}
    bound = -(-tokens // capacity)
    if not left:
        return [], bound
    fractions, lp_bound, prices = fractional_cover(left, capacity)
    plan = []
    for pattern, x in sorted(fractions.items(), key=lambda p: (-sum(a * b for a, b in p[0]), -p[1])):
        n = min([int(x), *(left[length] // times for length, times in pattern)])
        if n > 0:
            plan.append((pattern, n))
            for length, times in pattern:
                left[length] -= n * times
    left = {length: n for length, n in left.items() if n}
    if left:
        tokens_alone = np.arange(capacity + 1) / capacity
        dives = [dive(left, p, capacity) for p in (prices, tokens_alone)]
        plan += min(dives, key=lambda d: sum(n for _, n in d))
    return plan, max(bound, lp_bound)


class Places:
    """Rank among the pieces of a length -> (sequence, offset)."""

    def __init__(self, plan: list[tuple[Pattern, int]]):
        runs: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
        next_rank: dict[int, int] = defaultdict(int)
        sequence = 0
        for pattern, n in plan:
            offset = 0
            for length, times in pattern:
                runs[length].append((next_rank[length], sequence, times, offset))
                next_rank[length] += n * times
                offset += length * times
            sequence += n
        self.sequences = sequence
        self.runs = {length: np.array(r, dtype=np.int64).T for length, r in runs.items()}

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(length), dtype=np.int64), np.empty(len(length), dtype=np.int64)
        order = np.argsort(length, kind="stable")
        values, begins = np.unique(length[order], return_index=True)
        for value, rows in zip(values.tolist(), np.split(order, begins[1:])):
            first, start, times, base = self.runs[value]
            at = np.searchsorted(first, rank[rows], side="right") - 1
            inside = rank[rows] - first[at]
            sequence[rows] = start[at] + inside // times[at]
            offset[rows] = base[at] + inside % times[at] * value
        return sequence, offset


# ---------------------------------------------------------------- Spark
def token_pieces(
    df: DataFrame, id_col: str, text_col: str, tokenizer_path: str, end_id: int, capacity: int, remembered: int = REMEMBERED
) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: ``id_col, piece, start, length, ids_crc32, _block, _nth``.

    A document's ids end with ``end_id``; only a longer document is cut, its first
    piece being the shorter one.  ``_nth`` counts a task's pieces of one length.
    A worker remembers the ids of up to ``remembered`` words.
    """

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end = encoder(tokenizer_path, remembered).encode, np.uint32(end_id).tobytes()
        block, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in text_slices(batches, "text"):
            at, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = memoryview(ids_of(text or "") + end)
                n, start = len(ids) // 4, 0
                length = n % capacity or capacity
                for piece in range(-(-n // capacity)):
                    crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                    at.append(i)
                    rows.append((piece, start, length, crc, block, seen[length]))
                    seen[length] += 1
                    start, length = start + length, capacity
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *columns], names=["id", *_NAMES])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long, _block int, _nth long"
    return rows.mapInArrow(cut, schema)


_NAMES = ["piece", "start", "length", "ids_crc32", "_block", "_nth"]
_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]


def pack_sequences(
    df: DataFrame,
    id_col: str,
    text_col: str,
    tokenizer_path: str,
    end_id: int = 0,
    capacity: int = 2048,
    remembered: int = REMEMBERED,
) -> DataFrame:
    """Per piece: ``id_col, piece, start, length, ids_crc32, sequence_id, offset``.

    Null text is an empty document (its end id alone).  Equal rows are packed as
    often as they occur.  An empty table gives no rows.  Tokens are computed once:
    the pieces are written to the shared checkpoint folder.  ``remembered`` bounds the
    words whose ids a worker keeps, 200 MB of them by default; results are the same.
    """
    pieces = materialize(token_pieces(df, id_col, text_col, tokenizer_path, end_id, capacity, remembered), "pieces")
    blocks = materialize(pieces.groupBy("length", "_block").agg(F.count(F.lit(1)).alias("_n")), "piece-counts")
    histogram = blocks.groupBy("length").agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    counts = {r["length"]: r["n"] for r in histogram}
    plan, _ = plan_sequences(counts, capacity)
    places = Places(plan)
    before = Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    base = blocks.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    # a row for each length and task: broadcast only while they are few
    base = F.broadcast(base) if sum(r["rows"] for r in histogram) <= MAX_BASE_ROWS else base.hint("merge")
    ranked = pieces.join(base, ["length", "_block"]).select(
        "id", "piece", "start", "length", "ids_crc32", (F.col("_base") + F.col("_nth")).alias("_rank")
    )

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                found = places.find(b.column(3).to_numpy(), b.column(5).to_numpy())
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[:5], *map(pa.array, found)], names=[*b.schema.names[:5], "sequence_id", "offset"]
                )

    kind = pieces.schema["id"].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(place, schema).withColumnRenamed("id", id_col)
