"""Token-id files: one concatenated id array a block, document boundaries as an Elias-Fano sequence.

A block is ``EFT1``, six unsigned 64-bit numbers (bytes an id, documents, documents without doc_id, ids, bytes of the
boundary sequence, bytes of the doc_id sequence), the two sequences, and the ids. Blocks are rows of Parquet files in
ascending doc_id order, so that Spark's commit protocol guards them and any store that Spark writes can hold them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_path, shuffle_partitions, table
from .tokens import encoded, token_ids, tokenizer_path

MAGIC = b"EFT1"
#: Ids after which a writer closes its block.
BLOCK_IDS = 1 << 19
SAMPLE = 256


class EliasFano:
    """A non-decreasing sequence of n numbers below u + 1 in n * (2 + log2(u / n)) bits, with constant-time select.

    Low bits lie packed; high bits are unary gaps in a bit vector. Every SAMPLE-th one's place is kept as a 32-bit
    number, and select counts on from there: no table of 64-bit offsets.
    """

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        ones = np.cumsum(np.bitwise_count(high), dtype=np.uint32)
        self.samples = np.searchsorted(ones, np.arange(0, n, SAMPLE, dtype=np.uint32), side="right").astype(np.uint32)
        self.before = np.where(self.samples > 0, ones[self.samples.astype(int) - 1], 0) if n else np.zeros(0, np.uint32)

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n, most = len(v), int(v[-1]) if len(v) else 0
        bits = max(0, (most // n).bit_length() - 1) if n else 0
        low = np.zeros(0, np.uint8)
        if bits:
            low = np.packbits(((v[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        at = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        high[at] = 1
        return cls(n, bits, low, np.packbits(high, bitorder="little"))

    def dump(self) -> bytes:
        return struct.pack("<QQQ", self.n, self.low_bits, len(self.low)) + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def load(cls, data: bytes) -> EliasFano:
        n, bits, k = struct.unpack_from("<QQQ", data)
        raw = np.frombuffer(data, np.uint8, offset=24)
        return cls(n, bits, raw[:k], raw[k:])

    def _low(self, i: int) -> int:
        a = i * self.low_bits
        word = int.from_bytes(self.low[a // 8 : (a + self.low_bits + 7) // 8].tobytes(), "little")
        return word >> (a % 8) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The i-th number."""
        byte, seen = int(self.samples[i // SAMPLE]), int(self.before[i // SAMPLE])
        while seen + (ones := int(self.high[byte]).bit_count()) <= i:
            seen, byte = seen + ones, byte + 1
        word = int(self.high[byte])
        for _ in range(i - seen):
            word &= word - 1
        place = 8 * byte + (word & -word).bit_length() - 1
        return (place - i) << self.low_bits | self._low(i)


def encode_block(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """Documents in ascending doc_id order, those without a doc_id first."""
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    base = int(known[0]) if len(known) else 0
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    ends = EliasFano.encode(np.cumsum(lengths)).dump()
    names = struct.pack("<q", base) + EliasFano.encode((known - base).astype(np.uint64)).dump()
    return MAGIC + struct.pack("<6Q", width, len(doc_ids), len(doc_ids) - len(known), len(ids), len(ends), len(names)) + ends + names + ids.astype(f"<u{width}").tobytes()


class Block:
    """Reader of one block; ``document(i)`` touches that document's ids only."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token block")
        width, self.n, self.unnamed, self.n_ids, a, b = struct.unpack_from("<6Q", data, 4)
        self.ends = EliasFano.load(data[52 : 52 + a])
        self.base = struct.unpack_from("<q", data, 52 + a)[0]
        self.names = EliasFano.load(data[60 + a : 52 + a + b])
        self.ids = np.frombuffer(data, f"<u{width}", self.n_ids, 52 + a + b)

    def doc_id(self, i: int) -> int | None:
        """Documents without a doc_id come first."""
        return None if i < self.unnamed else self.base + self.names.select(i - self.unnamed)

    def offset(self, i: int) -> int:
        return self.ends.select(i - 1) if i else 0

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.offset(i) : self.offset(i + 1)]


def _write(path_of, name: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = token_ids(path_of(name), True), TaskContext.get().partitionId()
        docs, lengths, held, total, seq = [], [], [], 0, 0
        end = np.array([end_id], "<u4").tobytes()

        def block() -> pa.RecordBatch:
            data = encode_block(docs, lengths, np.frombuffer(b"".join(held), "<u4"))
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([total], pa.int64()), pa.array([data], pa.binary())], ["part", "seq", "n_ids", "block"])

        for b in batches:
            for doc, ids in encoded(b, encoder):
                ids += end
                docs.append(doc)
                lengths.append(len(ids) // 4)
                held.append(ids)
                total += len(ids) // 4
                if total >= BLOCK_IDS:
                    yield block()
                    docs, lengths, held, total, seq = [], [], [], 0, seq + 1
        if docs:
            yield block()

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part, seq, data in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            block = Block(data)
            rows, start = [], 0
            for i in range(block.n):  # a boundary is selected when its document is read
                end = block.offset(i + 1)
                rows.append((part, seq, block.doc_id(i), start, end - start, zlib.crc32(block.ids[start:end].astype("<u4").tobytes())))
                start = end
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["part", "seq", "doc_id", "own_start", "n_tokens", "ids_crc32"])


def write_tokens(docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, path_of=tokenizer_path) -> str:
    """Write the whole texts of ``docs(doc_id, text)`` as blocks in ascending doc_id order below ``path``.

    A null or empty text is the end id alone; rows without doc_id come first; rows of one doc_id lie in order of their
    texts' hashes. Rows are dealt by ranges of doc_id, hash and place in the input, so that no task holds more than its
    range, though a third of the rows have one doc_id or none; a block closes after BLOCK_IDS ids, or after the document
    that passes them.
    """
    n = shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("at"))
    rows = rows.repartitionByRange(n, "doc_id", "h", "at").sortWithinPartitions("doc_id", "h", "at").select("doc_id", "text")
    rows.mapInArrow(_write(path_of, tokenizer, end_id), "part int, seq int, n_ids long, block binary").write.mode("overwrite").parquet(path)
    return path


def read_tokens(spark, path: str) -> DataFrame:
    """Per document from the files: ``doc_id, start`` (ids of all documents before it), ``n_tokens, ids_crc32``."""
    files = spark.read.schema("part int, seq int, n_ids long, block binary").parquet(path)
    sizes = files.select("part", "seq", "n_ids")
    before = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    blocks = sizes.select("part", "seq", F.coalesce(before, F.lit(0)).alias("in_part"))
    total = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row for each writing task
    above = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = blocks.join(total.select("part", F.coalesce(above, F.lit(0)).alias("of_part")), "part")
    docs = files.select("part", "seq", "block").mapInArrow(_read, "part int, seq int, doc_id long, own_start long, n_tokens long, ids_crc32 long")
    return docs.join(base, ["part", "seq"]).select("doc_id", (F.col("own_start") + F.col("in_part") + F.col("of_part")).alias("start"), "n_tokens", "ids_crc32")


def op8_tokens(spark, sf_dir: str) -> DataFrame:
    path = write_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), shared_path(spark, "tokens"))
    return read_tokens(spark, path)
