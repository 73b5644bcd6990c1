"""Token ids in wavelet-matrix shard files.

A shard holds consecutive documents.  Its ids are stored as bit-planes, highest
bit first; each plane is the bit of every id in the order left by the planes
above it (zeros first, ones after, both stable).  With a running count of ones per
block, ``rank`` on a plane is a table entry and one popcount, and access to a
token, the count of a token in a range and the place of its k-th occurrence need
one step a plane, without unpacking the ids.

File format (little endian): magic ``WVM1``; u32 bits, u64 documents, u64 tokens;
then blocks, each a u64 length and zlib data: document ids (i64), a null flag per
document (u8), document lengths (u32), and one block per plane (packed bits).
A shard file travels as one binary value of a Parquet table, since every store
that Spark can write takes Parquet.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from urbanframe.llm.batches import text_slices
from urbanframe.llm.library_ids import encoder
from urbanframe.session import scratch_path

MAGIC = b"WVM1"
SHARD_TOKENS = 1 << 20
_WORD = 64
_ONES = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


def _narrow(bits: int) -> type:
    """The smallest type of ids of so many bits that planes are built in."""
    return np.uint16 if bits <= 16 else np.uint32


def _sides(bit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the zeros and of the ones: for mixed bits several times faster than masks."""
    return np.flatnonzero(~bit), np.flatnonzero(bit)


class Plane:
    """One bit-plane with rank and select."""

    def __init__(self, packed: np.ndarray, size: int):
        self.packed, self.size = packed, size

    @cached_property
    def before(self) -> np.ndarray:
        """Ones before each 64-bit block."""
        padded = np.zeros(-(-len(self.packed) // 8) * 8, dtype=np.uint8)
        padded[: len(self.packed)] = _ONES[self.packed]
        return np.concatenate(([0], np.cumsum(padded.reshape(-1, 8).sum(axis=1, dtype=np.int64))))

    @cached_property
    def zeros(self) -> int:
        return self.size - int(self.before[-1])

    def bit(self, at: np.ndarray) -> np.ndarray:
        return (self.packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1

    def rank1(self, at: np.ndarray) -> np.ndarray:
        """Ones among the first ``at`` bits."""
        at = np.asarray(at, dtype=np.int64)
        block, byte = at // _WORD, at >> 3
        out = self.before[block]
        for k in range(7):  # whole bytes of the block before the byte
            inside = block * 8 + k
            out = out + np.where(inside < byte, _ONES[self.packed[np.minimum(inside, len(self.packed) - 1)]], 0)
        part = self.packed[np.minimum(byte, len(self.packed) - 1)] >> (8 - (at & 7)).astype(np.uint16)
        return out + np.where(at & 7, _ONES[part & 255], 0)

    def select(self, bit: int, k: int) -> int:
        """Place of the k-th (from 0) ``bit``: a search over the block counts, then inside."""
        blocks = self.before if bit else np.arange(len(self.before)) * _WORD - self.before
        block = int(np.searchsorted(blocks, k, side="right")) - 1
        lo = block * _WORD
        bits = np.unpackbits(self.packed[lo // 8 : lo // 8 + 8])[: self.size - lo]
        return lo + int(np.flatnonzero(bits == bit)[k - int(blocks[block])])


class WaveletMatrix:
    """Access, counting and occurrence lookup over a sequence of ids."""

    def __init__(self, planes: list[Plane], size: int):
        self.planes, self.size = planes, size

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        planes, current = [], ids.astype(_narrow(bits))
        for level in range(bits - 1, -1, -1):
            bit = (current & current.dtype.type(1 << level)) != 0
            planes.append(Plane(np.packbits(bit), len(ids)))
            current = np.concatenate([current.take(places) for places in _sides(bit)])
        return cls(planes, len(ids))

    def access(self, at: np.ndarray) -> np.ndarray:
        """The ids at the given places."""
        at, out = np.array(at, dtype=np.int64), np.zeros(len(at), dtype=np.uint32)
        for plane in self.planes:
            bit = plane.bit(at).astype(bool)
            ones = plane.rank1(at)
            out = (out << np.uint32(1)) | bit
            at = np.where(bit, plane.zeros + ones, at - ones)
        return out

    def all_ids(self) -> np.ndarray:
        """Every id in order: from the last plane up, each partition is undone, reading in order."""
        below = np.zeros(self.size, dtype=_narrow(len(self.planes)))
        for level, plane in enumerate(reversed(self.planes)):
            zeros, ones = _sides(np.unpackbits(plane.packed, count=self.size).view(bool))
            out = np.empty_like(below)
            out[zeros] = below[: len(zeros)]
            out[ones] = below[len(zeros) :] | below.dtype.type(1 << level)
            below = out
        return below.astype(np.uint32)

    def _range(self, symbol: int, lo: int, hi: int) -> tuple[int, int]:
        """Places of ``symbol`` from [lo, hi), in the order below the last plane."""
        if symbol >> len(self.planes):
            return 0, 0
        for level, plane in zip(range(len(self.planes) - 1, -1, -1), self.planes):
            ones = plane.rank1(np.array([lo, hi]))
            if symbol >> level & 1:
                lo, hi = (int(x) + plane.zeros for x in ones)
            else:
                lo, hi = lo - int(ones[0]), hi - int(ones[1])
        return lo, hi

    def count(self, symbol: int, lo: int = 0, hi: int | None = None) -> int:
        """How often ``symbol`` occurs in places [lo, hi)."""
        if not self.size:
            return 0
        lo, hi = self._range(symbol, lo, self.size if hi is None else hi)
        return hi - lo

    def occurrence(self, symbol: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of ``symbol``; IndexError if there is none."""
        if not 0 <= k < self.count(symbol):
            raise IndexError(f"no occurrence {k} of {symbol}")
        at = self._range(symbol, 0, self.size)[0] + k
        for level, plane in zip(range(len(self.planes)), reversed(self.planes)):
            bit = symbol >> level & 1
            at = plane.select(bit, at - plane.zeros if bit else at)
        return at


def _deflated(block: bytes) -> bytes:
    """zlib data; planes have runs of equal bytes and little else that repeats, so only runs are looked for."""
    packer = zlib.compressobj(1, strategy=zlib.Z_RLE)
    return packer.compress(block) + packer.flush()


def write_shard(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, bits: int) -> bytes:
    matrix = WaveletMatrix.build(ids, bits)
    blocks = [
        np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(),
        bytes(d is None for d in doc_ids),
        np.array(lengths, dtype="<u4").tobytes(),
        *[p.packed.tobytes() for p in matrix.planes],
    ]
    out = [MAGIC, struct.pack("<IQQ", bits, len(doc_ids), len(ids))]
    for block in blocks:
        packed = _deflated(block)
        out += [struct.pack("<Q", len(packed)), packed]
    return b"".join(out)


class Shard:
    """One shard file, opened."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet shard")
        bits, docs, tokens = struct.unpack_from("<IQQ", data, 4)
        at, blocks = 24, []
        for _ in range(3 + bits):
            (n,) = struct.unpack_from("<Q", data, at)
            blocks.append(zlib.decompress(data[at + 8 : at + 8 + n]))
            at += 8 + n
        null = np.frombuffer(blocks[1], dtype=np.uint8).astype(bool)
        self.doc_ids = pa.array(np.frombuffer(blocks[0], dtype="<i8"), pa.int64(), mask=null)
        self.lengths = np.frombuffer(blocks[2], dtype="<u4").astype(np.int64)
        self.matrix = WaveletMatrix([Plane(np.frombuffer(b, dtype=np.uint8), tokens) for b in blocks[3:]], tokens)


def write_token_shards(
    df: DataFrame,
    id_col: str,
    text_col: str,
    tokenizer_path: str,
    end_id: int,
    path: str,
    shard_tokens: int = SHARD_TOKENS,
) -> None:
    """Write every row's ids, then ``end_id``, as shard files under ``path`` by rising ``id_col``.

    Rows are range-partitioned and sorted by id (nulls first; repeated ids stay
    side by side).  A shard closes at ``shard_tokens`` tokens; a longer document
    has a shard of its own.  Null text is an empty document.  ``id_col`` must be
    an integer column.
    """

    def shards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = encoder(tokenizer_path)
        bits = max(1, (max(library.tokenizer.get_vocab_size() - 1, end_id)).bit_length())
        end, part, number = np.uint32(end_id).tobytes(), TaskContext.get().partitionId(), 0
        docs: list[int | None] = []
        held: list[bytes] = []
        tokens = 0

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), dtype="<u4")
            data = write_shard(docs, [len(h) // 4 for h in held], ids, bits)
            return pa.RecordBatch.from_pylist(
                [{"part": part, "number": number, "documents": len(docs), "tokens": tokens, "shard": data}], _SHARD
            )

        for batch in text_slices(batches, "text"):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                packed = library.encode(text or "") + end
                if docs and tokens + len(packed) // 4 > shard_tokens:
                    yield close()
                    docs, held, tokens, number = [], [], 0, number + 1
                docs.append(doc)
                held.append(packed)
                tokens += len(packed) // 4
        if docs:
            yield close()

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "id").sortWithinPartitions("id")
    schema = "part int, number int, documents long, tokens long, shard binary"
    ordered.mapInArrow(shards, schema).write.option("compression", "none").parquet(path)


_SHARD = pa.schema(
    [("part", pa.int32()), ("number", pa.int32()), ("documents", pa.int64()), ("tokens", pa.int64()), ("shard", pa.binary())]
)


def read_token_shards(spark: SparkSession, path: str, id_col: str) -> DataFrame:
    """Per stored document: ``id_col, start, n_tokens, ids_crc32``, from the shard files.

    ``start`` counts the ids of all documents before it in the files' order.
    """
    files = spark.read.schema("part int, number int, documents long, tokens long, shard binary").parquet(path)

    def documents(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, data in zip(*(batch.column(i) for i in range(3))):
                shard = Shard(data.as_py())
                ids = memoryview(shard.matrix.all_ids().astype("<u4").tobytes())
                ends = np.cumsum(shard.lengths)
                starts = ends - shard.lengths
                crcs = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                n = len(crcs)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part.as_py()] * n, pa.int32()),
                        pa.array([number.as_py()] * n, pa.int32()),
                        shard.doc_ids,
                        pa.array(starts),
                        pa.array(shard.lengths),
                        pa.array(crcs, pa.int64()),
                    ],
                    names=["part", "number", "id", "inside", "n_tokens", "ids_crc32"],
                )

    read = files.select("part", "number", "shard").mapInArrow(
        documents, "part int, number int, id long, inside long, n_tokens long, ids_crc32 long"
    )
    # ids before a shard: those of earlier parts, and of earlier shards of its part
    sizes = files.select("part", "number", "tokens")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    parts = sizes.groupBy("part").agg(F.sum("tokens").alias("_t"))
    parts = parts.select("part", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_before_part"))
    inside = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.withColumn("_before", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(parts, "part")
    base = base.select("part", "number", (F.col("_before") + F.col("_before_part")).alias("_base"))
    return read.join(base, ["part", "number"]).select(
        F.col("id").alias(id_col), (F.col("_base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_shards(
    df: DataFrame, id_col: str, text_col: str, tokenizer_path: str, end_id: int, path: str | None = None
) -> DataFrame:
    """Write shard files (under the shared checkpoint folder by default) and read them back."""
    spark = df.sparkSession
    path = path or scratch_path(spark, "token-shards")
    write_token_shards(df, id_col, text_col, tokenizer_path, end_id, path)
    return read_token_shards(spark, path, id_col)
