"""Byte-level BPE encoding and decoding with a segment tree per pre-token.

The leaves of the tree stand for the byte positions of one pre-token.  A live
position holds ``rank * size + position`` for the pair that starts there (the rank
of the token that the pair would make), every other position holds infinity, and
an inner node holds the minimum of its children.  The root is thus the leftmost
pair of least rank.  A merge changes at most three leaves -- the merged position,
its left neighbour and the position that dies -- and each change climbs to the
root in logarithmic time.

Many pre-tokens of similar length are merged side by side, one tree per row of a
numpy matrix; a pre-token longer than ``WIDE`` bytes gets a tree of its own.

Null text encodes like the empty text, to an empty list of ids.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanframe.llm.batches import list_array, text_slices
from urbanframe.llm.pretokens import compile_pattern, safe_piece

WIDE = 64  # longest pre-token, in bytes, that is merged side by side with others
MERGE_CELLS = 1 << 18  # leaves of the trees that are merged side by side, about 70 bytes each
CACHE_BYTES = 48 << 20  # pieces and ids that a worker keeps; half of them, the ones used last, survive when it is full
ENTRY_BYTES = 200  # objects and dictionary slot of a kept piece, beside its letters and ids
SLICE_BYTES = 1 << 20  # text or ids handled at once; a word of text takes a hundred bytes and more meanwhile
_NO_PAIR = np.int64(1) << 60
_SIZES = np.array([1 << max(1, (n - 1).bit_length()) for n in range(WIDE + 1)])  # leaves for so many bytes


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank from a rank file (one base64 token and its rank a line)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


class PairRanks:
    """Rank of the token made by two neighbouring tokens (ids are ranks)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.base = np.full(256, -1, dtype=np.int64)
        for b in range(256):
            self.base[b] = ranks[bytes([b])]
        self.width = max(ranks.values()) + 1
        pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.width + right] = rank
        self.table = pairs
        # open addressing, at most an eighth full: a vectorised dictionary
        self.bits = max(8, (8 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.ranks = np.full(1 << self.bits, _NO_PAIR, dtype=np.int64)
        left_over = np.array(list(pairs), dtype=np.int64)
        slot = self._slot(left_over)
        while len(left_over):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = left_over[free]
            kept = self.keys[slot] == left_over
            self.ranks[slot[kept]] = [pairs[k] for k in left_over[kept].tolist()]
            left_over, slot = left_over[~kept], (slot[~kept] + 1) & ((1 << self.bits) - 1)
        byte = np.arange(256)
        self.of_bytes = self.lookup(self.base[byte][:, None].repeat(256, 1), self.base[byte][None, :].repeat(256, 0))

    def _slot(self, key: np.ndarray) -> np.ndarray:
        mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        shape = left.shape
        key = (left * self.width + right).ravel()
        slot = self._slot(key)
        there = self.keys[slot]
        out = np.where(there == key, self.ranks[slot], _NO_PAIR)
        open_ = np.flatnonzero((there != key) & (there != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot[open_]]
            hit = there == key[open_]
            out[open_[hit]] = self.ranks[slot[open_[hit]]]
            open_ = open_[~hit & (there != -1)]
        return out.reshape(shape)


def merge_one(token_ids: list[int], pairs: PairRanks) -> list[int]:
    """Ids of one pre-token, from the ids of its bytes, by a tree of its own."""
    n = len(token_ids)
    size = 1 << max(1, (n - 1).bit_length())
    none, table, width = 1 << 62, pairs.table, pairs.width
    ids, after, before = list(token_ids), list(range(1, n + 1)), list(range(-1, n - 1))

    def value(at: int) -> int:
        if after[at] >= n:
            return none
        rank = table.get(ids[at] * width + ids[after[at]])
        return none if rank is None else rank * size + at

    tree = [none] * (2 * size)
    tree[size : size + n] = [value(i) for i in range(n)]
    for node in range(size - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])

    def put(at: int, new: int) -> None:
        node = at + size
        tree[node] = new
        node >>= 1
        while node:
            low = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == low:
                break
            tree[node] = low
            node >>= 1

    while tree[1] != none:
        rank, at = divmod(tree[1], size)
        dead = after[at]
        ids[at], after[at] = rank, after[dead]
        if after[dead] < n:
            before[after[dead]] = at
        put(dead, none)
        put(at, value(at))
        if before[at] >= 0:
            put(before[at], value(before[at]))
    out, at = [], 0
    while at < n:
        out.append(ids[at])
        at = after[at]
    return out


def merge_many(tokens: list[bytes], pairs: PairRanks) -> list[bytes]:
    """Packed little-endian 32-bit ids of many pre-tokens of at most ``WIDE`` bytes."""
    out: list[bytes] = [b""] * len(tokens)
    sizes = _SIZES[np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))]
    for size in np.unique(sizes).tolist():
        members, rows = np.flatnonzero(sizes == size).tolist(), MERGE_CELLS // size
        for lo in range(0, len(members), rows):
            chosen = members[lo : lo + rows]
            for i, ids in zip(chosen, _merge_rows([tokens[i] for i in chosen], size, pairs)):
                out[i] = ids
    return out


def _merge_rows(tokens: list[bytes], size: int, pairs: PairRanks) -> list[bytes]:
    rows = len(tokens)
    lengths = np.array([len(t) for t in tokens], dtype=np.int64)
    text = np.frombuffer(b"".join(t.ljust(size, b"\0") for t in tokens), dtype=np.uint8).reshape(rows, size)
    ids = pairs.base[text]
    place = np.arange(size)
    after = np.broadcast_to(place + 1, (rows, size)).copy()
    before = np.broadcast_to(place - 1, (rows, size)).copy()
    tree = np.full((rows, 2 * size), _NO_PAIR, dtype=np.int64)
    rank = pairs.of_bytes[text[:, :-1], text[:, 1:]]
    joined = (place[1:][None, :] < lengths[:, None]) & (rank < _NO_PAIR)
    tree[:, size : 2 * size - 1] = np.where(joined, rank * size + place[:-1], _NO_PAIR)
    half = size
    while half > 1:
        tree[:, half // 2 : half] = tree[:, half : 2 * half].reshape(rows, half // 2, 2).min(axis=2)
        half //= 2
    live = np.ones((rows, size), dtype=bool)

    def value(row: np.ndarray, at: np.ndarray) -> np.ndarray:
        right = after[row, at]
        inside = right < lengths[row]
        found = pairs.lookup(ids[row, at], ids[row, np.minimum(right, size - 1)])
        return np.where(inside & (found < _NO_PAIR), found * size + at, _NO_PAIR)

    def put(row: np.ndarray, at: np.ndarray, new: np.ndarray | np.int64) -> None:
        node = at + size
        tree[row, node] = new
        node = node >> 1
        while node[0]:  # every leaf is equally deep
            tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
            node = node >> 1

    active = np.flatnonzero(tree[:, 1] < _NO_PAIR)
    while len(active):
        best = tree[active, 1]
        at, made = best % size, best // size
        dead = after[active, at]
        beyond = after[active, dead]
        ids[active, at] = made
        after[active, at] = beyond
        live[active, dead] = False
        has = beyond < lengths[active]
        before[active[has], beyond[has]] = at[has]
        put(active, dead, _NO_PAIR)
        put(active, at, value(active, at))
        left = before[active, at]
        has = left >= 0
        if has.any():
            put(active[has], left[has], value(active[has], left[has]))
        active = active[tree[active, 1] < _NO_PAIR]
    live &= place[None, :] < lengths[:, None]
    flat = ids[live].astype("<u4").tobytes()
    ends = (np.cumsum(live.sum(axis=1)) * 4).tolist()
    return [flat[start:end] for start, end in zip([0, *ends], ends)]


class ByteBpe:
    """A rank file and a split pattern: texts to ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.whole = {token: rank.to_bytes(4, "little") for token, rank in ranks.items()}
        self.pattern = compile_pattern(pattern)
        self.pairs = PairRanks(ranks)
        self.cache: dict[str, bytes | bool] = {}  # piece -> packed ids; False: not to be cut off
        self.held = 0  # bytes of the cache, about
        self.older: dict[str, bytes | bool] = {}  # the cache before, until this one is half as large as both may be

    # ------------------------------------------------------------ encoding
    def _segments(self, segments: list[str]) -> list[bytes]:
        """Packed ids of text segments, each split by the pattern on its own."""
        # a segment of letters after at most one space is one pre-token
        split = [[s] if s[1:].isalpha() and (s[0] == " " or s[0].isalpha()) else self.pattern.findall(s) for s in segments]
        tokens = list(set(chain.from_iterable(split)))
        raw = [t.encode("utf-8", "surrogatepass") for t in tokens]
        ids = dict(zip(tokens, self._merged(raw)))
        return [ids[tokens[0]] if len(tokens) == 1 else b"".join([ids[t] for t in tokens]) for tokens in split]

    def _merged(self, raw: list[bytes]) -> list[bytes]:
        """Packed ids of pre-tokens: one id if the whole is a token, else by merging."""
        out = list(map(self.whole.get, raw))
        narrow = []
        for i, ids in enumerate(out):
            if ids is None and len(raw[i]) <= WIDE:
                narrow.append(i)
            elif ids is None:
                base = self.pairs.base[np.frombuffer(raw[i], dtype=np.uint8)].tolist()
                out[i] = np.array(merge_one(base, self.pairs), dtype="<u4").tobytes()
        for i, ids in zip(narrow, merge_many([raw[i] for i in narrow], self.pairs)):
            out[i] = ids
        return out

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """Packed little-endian 32-bit ids of each text."""
        if self.held > CACHE_BYTES // 2:
            self.older, self.cache, self.held = self.cache, {}, 0
        get, join = self.cache.get, b"".join
        out: list[bytes] = []
        open_: list[tuple[int, list[str], list]] = []
        new: set[str] = set()
        heads: set[str] = set()
        for i, text in enumerate(texts):
            pieces = text.split(" ")
            heads.add(pieces[0])
            found = list(map(get, pieces[1:]))
            try:  # a missing piece is None, a piece that must not be cut off is False
                out.append(join(found))
            except TypeError:
                out.append(b"")
                open_.append((i, pieces, found))
                new.update([p for p, ids in zip(pieces[1:], found) if ids is None])
        self.held += sum(ENTRY_BYTES + 5 * len(p) for p in new)  # a letter of its own id: 1 + 4 bytes
        known = {p: self.older[p] for p in new if p in self.older}
        new.difference_update(known)
        cuttable = [p for p in new if safe_piece(p)]
        self.cache.update(known)
        self.cache.update(dict.fromkeys(new, False))
        self.cache.update(zip(cuttable, self._segments([" " + p for p in cuttable])))
        whole = []
        for i, pieces, found in open_:
            try:
                out[i] = join([get(p) if ids is None else ids for p, ids in zip(pieces[1:], found)])
            except TypeError:
                whole.append(i)
        first = dict(zip(heads, self._segments(list(heads))))
        for i, text in enumerate(texts):
            head = text.partition(" ")[0]
            if len(head) < len(text) and not safe_piece(head):
                whole.append(i)
            else:
                out[i] = first[head] + out[i]
        whole = sorted(set(whole))
        for i, ids in zip(whole, self._segments([texts[i] for i in whole])):
            out[i] = ids
        return out


class ByteDecoder:
    """Ids of a rank file back to bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))[:-1]
        self.blob = np.zeros(int(self.sizes.sum()), dtype=np.uint8)
        for token, rank in ranks.items():
            self.blob[self.starts[rank] : self.starts[rank] + len(token)] = np.frombuffer(token, dtype=np.uint8)

    def decode_flat(self, ids: np.ndarray, counts: np.ndarray) -> tuple[bytes, np.ndarray]:
        """All bytes of consecutive id lists, and the byte length of each list."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        shift = self.starts[ids] - (ends - sizes)
        data = self.blob[np.repeat(shift, sizes) + np.arange(total)].tobytes()
        bounds = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]
        return data, np.diff(bounds)


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> ByteBpe:
    """One encoder per worker process; its tables and cache serve all its tasks."""
    return ByteBpe(load_ranks(path), pattern)


@lru_cache(maxsize=2)
def decoder(path: str) -> ByteDecoder:
    return ByteDecoder(load_ranks(path))


def byte_bpe_encode(df: DataFrame, id_col: str, text_col: str, ranks_path: str, pattern: str) -> DataFrame:
    """``id_col`` and ``ids`` (array of int) of every row's whole text.

    ``ranks_path`` must be readable on every executor.  Null text gives an empty
    list.  Rows are independent: no shuffle, repeated rows stay repeated.
    """

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(ranks_path, pattern)
        for batch in text_slices(batches, "text", SLICE_BYTES):
            packed = bpe.encode_texts([t or "" for t in batch.column(1).to_pylist()])
            ids = np.frombuffer(b"".join(packed), dtype="<u4").astype(np.int32)
            lists = list_array(ids, [len(p) // 4 for p in packed], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["id", "ids"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(encode, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def byte_bpe_decode(df: DataFrame, id_col: str, ids_col: str, ranks_path: str) -> DataFrame:
    """``id_col``, ``ids_col`` and ``decoded`` (bytes) of every row's ids (null: no bytes)."""

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = decoder(ranks_path)
        for batch in text_slices(batches, "ids", SLICE_BYTES):
            column = batch.column(1)
            counts = np.array([0 if x is None else x for x in column.value_lengths().to_pylist()], dtype=np.int64)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            data, sizes = bpe.decode_flat(flat, counts)
            offsets = np.zeros(len(sizes) + 1, dtype=np.int32)
            np.cumsum(sizes, out=offsets[1:])
            decoded = pa.Array.from_buffers(
                pa.binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)]
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), column, decoded], names=["id", "ids", "decoded"])

    rows = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(decode, f"id {kind}, ids array<int>, decoded binary")
    return out.withColumnsRenamed({"id": id_col, "ids": ids_col})
