"""Near duplicates by order MinHash, verified by banded alignment.

The k-mers of a text are its runs of ``k`` words, labelled with their occurrence
number, so that repeats count.  A sketch takes the ``picked`` labelled k-mers of
least hash and keeps them in the order in which they stand in the text: texts
agree on a sketch only if they share those k-mers in the same order, which follows
edit similarity rather than the mere set of k-mers.  ``sketches`` independent
sketches are taken, and texts that agree on one are a candidate pair.  Their number,
``k`` and ``picked`` follow from the similarity: of two long texts 0.8 similar by
scattered edits, 0.8 ** 3 of the 3-mers survive, both k-mers of a sketch agree with
probability 0.12, and one of 48 sketches does in 99.7 % of cases.  Short texts are
sketched by 2-mers, of which edits spoil fewer.

Texts with equal word sequences are one node from the start; nodes that agree on a
sketch share a bucket.  Two leaders of each bucket, the one that agrees most with
others and a random one, are compared with its members first, which brings the bulk of
a large group into one class; its other members are then compared with some of that
class.  At last every pair of a bucket that is not yet of one class is compared, unless the words of the two texts
alone, whatever their order, show that they are too far apart: each of the longer text that the other one lacks is
an edit.  They are counted from a bitmap that every text carries (``word_parity``), so that such pairs make no row.
No bucket is capped and no member dropped: a near duplicate is missed only if the
two texts agree on no sketch, never because of the other texts of a bucket.  The
price is that texts of one bucket which are no near duplicates meet pair by pair: their
bitmaps inside the join, the few that have nearly enough words in common word by word.

A candidate pair is verified by the word edit distance, computed inside a band
around the diagonal: ``1 - distance / longer length >= similarity``.  Linked nodes
form classes (connected components).
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanframe.llm.batches import list_array, text_slices
from urbanframe.llm.components import components
from urbanframe.llm.words import mixed, row_keys, word_hashes
from urbanframe.session import materialize, release

K = 3
SHORT, SHORT_K = 32, 2  # texts of fewer words, and their k-mers
SIMILARITY = 0.8
SKETCHES = 48
PICKED = 2
TURNS = 2  # leaders of a bucket
PARITY_BITS = 4, 8192  # of a text's bitmap: for each word, and at most
_FOLD = np.uint64(0x9E3779B97F4A7C15)
_CELLS = 1 << 20  # hashed k-mers held at once


def labelled_kmers(words: np.ndarray, k: int = K) -> np.ndarray:
    """Hash of every k-mer with its occurrence number, in text order.

    The number enters every hash, 0 too, so that a text that repeats a k-mer agrees with
    one that does not on all the others.  A text of fewer than ``k`` words has one k-mer: all of it.
    """
    n = max(1, len(words) - k + 1)
    value = np.zeros(n, dtype=np.uint64)
    for j in range(min(k, len(words))):
        value = value * _FOLD + words[j : j + n]
    value = mixed(value)
    order = np.argsort(value, kind="stable")
    ranked = value[order]
    new = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    first = np.flatnonzero(new)
    nth = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    label = np.empty(n, dtype=np.uint64)
    label[order] = nth.astype(np.uint64)
    return mixed(value + label * _FOLD)


def order_sketches(kmers: np.ndarray, sketches: int = SKETCHES, picked: int = PICKED, seed: int = 1) -> np.ndarray:
    """One 64-bit key per sketch: its least k-mers folded in text order, with the sketch's number."""
    seeds = mixed(np.arange(1, sketches + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(seed))
    take = min(picked, len(kmers))
    keys = np.empty(sketches, dtype=np.uint64)
    step = max(1, _CELLS // len(kmers))
    for lo in range(0, sketches, step):
        some = seeds[lo : lo + step]
        ranks = (kmers[None, :] ^ some[:, None]) * np.uint64(0xBF58476D1CE4E5B9)
        ranks ^= ranks >> np.uint64(29)
        ranks *= np.uint64(0x94D049BB133111EB)
        if take < len(kmers):
            places = np.sort(np.argpartition(ranks, take - 1, axis=1)[:, :take], axis=1)
        else:
            places = np.broadcast_to(np.arange(take), (len(some), take))
        key = some.copy()
        for j in range(take):
            key = mixed(key * _FOLD + kmers[places[:, j]])
        keys[lo : lo + step] = key
    return keys


def text_sketches(
    words: np.ndarray, k: int = K, sketches: int = SKETCHES, picked: int = PICKED, similarity: float = SIMILARITY
) -> np.ndarray:
    """The buckets of a text; a text without words has none.

    A text that may resemble both short and longer ones is sketched in both ways.
    """
    keys = [np.zeros(0, dtype=np.uint64)]
    if len(words) >= SHORT:
        keys.append(order_sketches(labelled_kmers(words, k), sketches, picked))
    if 0 < len(words) * similarity < SHORT:
        keys.append(order_sketches(labelled_kmers(words, min(k, SHORT_K)), sketches, picked, seed=2))
    return np.concatenate(keys)


def word_parity(words: np.ndarray) -> np.ndarray:
    """Bitmap of a text's words, each labelled with its occurrence number: a bit is set if an odd number hash to it.

    Two texts' bitmaps differ in no more bits than there are words in one text only, repeats
    counted.  The size is a power of two; a larger bitmap's halves, one xor the other, are the smaller bitmap.
    """
    each, most = PARITY_BITS
    bits = max(64, min(most, 1 << (each * len(words) - 1).bit_length())) if len(words) else 64
    labelled = labelled_kmers(words, 1) if len(words) else words
    odd = np.bincount((labelled % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def banded_distance(a: list[int], b: list[int], band: int) -> int | None:
    """Edit distance of two sequences if it is at most ``band``, else ``None``.

    Bit-parallel dynamic programming: one machine-independent integer holds the
    vertical differences of all cells within ``band`` of the diagonal; each step
    moves the band down by one.
    """
    n, m = len(a), len(b)
    if abs(n - m) > band:
        return None
    if not n or not m:
        return max(n, m)
    band = min(band, max(n, m))
    width = 2 * band + 1
    full = (1 << width) - 1
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | (1 << i)
    rise, fall = full ^ ((1 << band) - 1), 0
    distance = min(band, n)
    for j in range(1, m + 1):
        shift = j - band - 1
        here = places.get(b[j - 1], 0)
        match = (here >> shift if shift >= 0 else here << -shift) & full
        same = ((((match & rise) + rise) ^ rise) | match | fall) & full
        up = fall | (full & ~(same | rise))
        down = same & rise
        if j + band <= n:  # follow the lowest diagonal
            distance += 1 - (same >> (width - 1))
        else:  # then the last row
            at = n - j + band
            distance += (up >> at & 1) - (down >> at & 1)
        moved = same >> 1
        fall = moved & up
        rise = down | (full & ~(moved | up))
    return distance if distance <= band else None


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """``1 - distance / longer length >= similarity`` for two word sequences."""
    longer = max(len(a), len(b))
    if not longer:
        return True
    limit = int(longer * (1 - similarity) + 1e-9)
    if abs(len(a) - len(b)) > limit:
        return False
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    a, b = a[head:], b[head:]
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[::-1][:short] != b[::-1][:short])
    tail = int(differ[0]) if len(differ) else short
    x, y = a[: len(a) - tail].tolist(), b[: len(b) - tail].tolist()
    # words that the other text lacks must each be edited
    least = max(len(x), len(y)) - (Counter(x) & Counter(y)).total()
    if least > limit:
        return False
    small = min(limit, abs(len(x) - len(y)) + 24)
    if least <= small and banded_distance(x, y, small) is not None:
        return True
    return small < limit and banded_distance(x, y, limit) is not None


def _sketched(keyed: DataFrame, k: int, sketches: int, picked: int, similarity: float) -> DataFrame:
    """Per row: id and keys, a digest of its words (the node), the word count and its sketches."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            nodes, counts, keys = [], [], []
            for text in batch.column(3).to_pylist():
                data = (text or "").encode("utf-8", "surrogatepass")
                words = word_hashes(data)
                nodes.append(hashlib.md5(b" ".join(data.split())).digest())
                counts.append(len(words))
                keys.append(text_sketches(words, k, sketches, picked, similarity).view(np.int64))
            lists = list_array(np.concatenate([np.zeros(0, dtype=np.int64), *keys]), [len(x) for x in keys], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(nodes, pa.binary()), pa.array(counts, pa.int64()), lists],
                names=["id", "k1", "k2", "node", "n", "keys"],
            )

    kind = keyed.schema["id"].dataType.simpleString()
    return keyed.mapInArrow(run, f"id {kind}, k1 long, k2 long, node binary, n long, keys array<long>")


def _word_lists(texts: DataFrame) -> DataFrame:
    """``node, words, parity``: packed 32-bit word hashes of one row of each node, and their bitmap."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", 4 << 20):
            packed, bitmaps = [], []
            for text in batch.column(1).to_pylist():
                words = word_hashes(text.encode("utf-8", "surrogatepass"))
                packed.append((words >> np.uint64(32)).astype("<u4").tobytes())
                bitmaps.append(word_parity(words))
            parity = list_array(np.concatenate([np.zeros(0, np.int64), *bitmaps]), [len(x) for x in bitmaps], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(packed, pa.binary()), parity], names=["node", "words", "parity"]
            )

    return texts.mapInArrow(run, "node binary, words binary, parity array<long>")


def _verified(pairs: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """``a, b, linked`` for candidate pairs ``a, b``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "wa"):
            linked = [
                similar(np.frombuffer(x, dtype="<u4"), np.frombuffer(y, dtype="<u4"), similarity)
                for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(linked)], names=["a", "b", "linked"])

    wa = words.select(F.col("node").alias("a"), F.col("words").alias("wa"))
    wb = words.select(F.col("node").alias("b"), F.col("words").alias("wb"))
    return pairs.join(wa, "a").join(wb, "b").select("a", "b", "wa", "wb").mapInArrow(run, "a binary, b binary, linked boolean")


def _shared(nodes: DataFrame) -> DataFrame:
    """``bucket, node, n, standing`` of every bucket that holds two nodes or more.

    ``standing`` adds up the sizes of a node's buckets: the text that a group of copies was
    made from agrees with more of them than any copy does.
    """
    buckets = nodes.select("node", "n", F.explode("keys").alias("bucket"))
    several = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1")
    # a table of its own: both sides of the join are then plain exchanges, which Spark splits if a bucket is hot
    members = materialize(buckets.join(materialize(several, "shared-buckets"), "bucket"), "bucket-members")
    standing = members.groupBy("node").agg(F.sum("_c").alias("standing"))
    return members.drop("_c").join(materialize(standing, "standing"), "node")


def _near(similarity: float) -> Column:
    """Whether the lengths ``an, bn`` allow the similarity."""
    return F.abs(F.col("an") - F.col("bn")) <= F.greatest("an", "bn") * F.lit(1 - similarity) + F.lit(1e-9)


def _led(shared: DataFrame, similarity: float, turn: int) -> DataFrame:
    """Pairs ``a, b`` of a member and its bucket's leader.

    In the first turn a bucket is led by its node of highest standing, in others by that of
    least hash: a node leads in most of its buckets or in few, so that pairs repeat.
    """
    hashed = F.xxhash64("node", F.lit(turn))
    drawn = F.struct((-F.col("standing") if turn == 0 else hashed).alias("h"), hashed.alias("g"), "node", "n")
    leaders = shared.groupBy("bucket").agg(F.min(drawn).alias("l")).select("bucket", F.col("l.node").alias("b"), F.col("l.n").alias("bn"))
    led = shared.withColumnsRenamed({"node": "a", "n": "an"}).join(materialize(leaders, "leaders"), "bucket")
    return led.filter((F.col("a") != F.col("b")) & _near(similarity)).select("a", "b")


def _open(members: DataFrame) -> DataFrame:
    """``members`` of the buckets that hold two classes or more."""
    label = F.xxhash64("label")
    spans = members.groupBy("bucket").agg(F.min(label).alias("l"), F.max(label).alias("m"))
    return members.join(materialize(spans.filter("l <> m").select("bucket"), "open-buckets"), "bucket")


def _open_members(shared: DataFrame, links: DataFrame) -> DataFrame:
    """The members of buckets with two classes or more, and the ``label`` of their class by ``links``."""
    members = shared.join(components(links.select("a", "b")), "node", "left").withColumn("label", F.coalesce("label", "node"))
    members = materialize(members, "members")
    opened = materialize(_open(members), "open-members")
    release(members)
    return opened


def _differ(a: Column, b: Column) -> Column:
    """Bits in which two bitmaps of ``word_parity`` differ, one of twice the size folded; null for other sizes."""

    def folded(x: Column, y: Column) -> Column:
        n = F.size(y)
        halves = F.zip_with(F.slice(x, F.lit(1), n), F.slice(x, n + 1, n), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(x) <= n, x).when(F.size(x) == 2 * n, halves)

    bits = F.zip_with(folded(a, b), folded(b, a), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(bits, F.lit(0), lambda total, x: total + x)


def _untested(opened: DataFrame, parity: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``a, b`` (a < b) of a bucket that are not of one class, each once.

    A pair is listed in the least of the buckets it shares, all of which are open.  Pairs
    whose lengths or words rule the similarity out are left away at once.
    """
    keys = opened.groupBy("node").agg(F.collect_set("bucket").alias("keys"))
    members = materialize(opened.join(parity, "node").join(materialize(keys, "open-keys"), "node"), "open-texts")
    a = members.select("bucket", *(F.col(c).alias(n) for c, n in _SIDE_A))
    b = members.select("bucket", *(F.col(c).alias(n) for c, n in _SIDE_B))
    apart = (F.col("a") < F.col("b")) & (F.col("al") != F.col("bl"))
    # the longer text's words that the other one lacks, each an edit: half of all that one text has alone, and of the
    # difference in length
    limit = F.floor(F.greatest("an", "bn") * F.lit(1 - similarity) + F.lit(1e-9))
    alike = _differ(F.col("ap"), F.col("bp")) + F.abs(F.col("an") - F.col("bn")) <= 2 * limit
    once = F.array_min(F.array_intersect("ak", "bk")) == F.col("bucket")
    pairs = a.join(b.hint("merge"), "bucket").filter(apart & _near(similarity) & once & F.coalesce(alike, F.lit(True)))
    return materialize(pairs.select("a", "b"), "untested")


_SIDE_A = (("node", "a"), ("n", "an"), ("label", "al"), ("parity", "ap"), ("keys", "ak"))
_SIDE_B = (("node", "b"), ("n", "bn"), ("label", "bl"), ("parity", "bp"), ("keys", "bk"))


def _links(nodes: DataFrame, keyed: DataFrame, similarity: float) -> DataFrame:
    """Verified links ``a, b`` among ``nodes`` (``node, n, k1, k2, keys``)."""
    shared = materialize(_shared(nodes), "shared")
    words = materialize(_word_lists(_texts_of(shared, nodes, keyed)).dropDuplicates(["node"]), "word-lists")
    lists = words.select("node", "words")
    led = _led(shared, similarity, 0)
    for turn in range(1, TURNS):
        led = led.unionByName(_led(shared, similarity, turn))
    known = materialize(_verified(led.distinct(), lists, similarity), "pairs")
    # leaders alone do not settle a bucket: whatever they have not joined is compared pair by pair
    opened = _open_members(shared, known.filter("linked"))
    release(shared)
    rest = _untested(opened, words.select("node", "parity"), similarity)
    last = materialize(_verified(_fresh(rest, known), lists, similarity), "pairs-rest")
    release(words, opened, rest)
    return known.unionByName(last).filter("linked").select("a", "b")


def _fresh(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """``pairs`` that ``known`` does not hold in either order."""
    tested = known.select("a", "b").unionByName(known.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return pairs.join(tested, ["a", "b"], "left_anti")


def _texts_of(shared: DataFrame, nodes: DataFrame, keyed: DataFrame) -> DataFrame:
    """``node, text`` of the nodes that share a bucket with another one (all candidates are among them)."""
    wanted = shared.select("node").distinct()
    chosen = nodes.join(wanted, "node").select("node", "k1", "k2")
    return keyed.join(chosen, ["k1", "k2"]).select("node", "text")


def _placed(df: DataFrame, id_col: str, text_col: str, similarity: float, k: int, sketches: int, picked: int) -> DataFrame:
    """Per row: ``id, k1, k2`` and the ``label`` of its class."""
    id_, text = F.col(id_col), F.col(text_col)
    keyed = df.select(id_.alias("id"), *row_keys(id_, text), text.alias("text"))
    members = materialize(_sketched(keyed, k, sketches, picked, similarity), "sketched")
    nodes = members.groupBy("node", "n", "keys").agg(F.min(F.struct("k1", "k2")).alias("r"))
    nodes = materialize(nodes.select("node", "n", "r.k1", "r.k2", "keys"), "nodes")
    labels = components(_links(nodes, keyed.select("k1", "k2", "text"), similarity))
    placed = members.select("id", "k1", "k2", "node").join(labels, "node", "left")
    return materialize(placed.select("id", "k1", "k2", F.coalesce("label", "node").alias("label")), "placed")


def near_duplicate_classes(
    df: DataFrame,
    id_col: str,
    text_col: str,
    similarity: float = SIMILARITY,
    k: int = K,
    sketches: int = SKETCHES,
    picked: int = PICKED,
) -> DataFrame:
    """Per row: ``id_col``, ``class_id`` (least id of its class; null if all are null) and ``class_rows``.

    Texts without words (null, empty, blank) have equal word sequences and form
    one class.  Repeated rows belong to one class.
    """
    placed = _placed(df, id_col, text_col, similarity, k, sketches, picked)
    classes = placed.groupBy("label").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("class_rows"))
    return placed.join(materialize(classes, "classes"), "label").select(F.col("id").alias(id_col), "class_id", "class_rows")


def keep_one_of_each(
    df: DataFrame,
    id_col: str,
    text_col: str,
    similarity: float = SIMILARITY,
    k: int = K,
    sketches: int = SKETCHES,
    picked: int = PICKED,
) -> DataFrame:
    """One row of each class, all columns unchanged: the one with the least id (nulls last).

    Texts without words (null, empty, blank) are one class, so one of them stays; of rows
    that repeat one stays; an empty table gives an empty result.
    """
    placed = _placed(df, id_col, text_col, similarity, k, sketches, picked)
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("k1"), F.col("k2"))
    kept = materialize(placed.groupBy("label").agg(F.min(order).alias("o")).select("o.k1", "o.k2"), "kept-keys")
    row = F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row")
    rows = df.select(row, *row_keys(F.col(id_col), F.col(text_col))).join(kept, ["k1", "k2"])
    once = rows.dropDuplicates(["k1", "k2"])  # rows that repeat in full
    return once.select(*[F.col(f"row.`{c}`").alias(c) for c in df.columns])
