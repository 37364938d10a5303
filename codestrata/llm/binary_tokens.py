"""Token ids in fixed-width bit-packed shards."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from codestrata.llm.storage import new_dir, ship, shuffle_parts
from codestrata.llm.tokens import vocabulary_size, word_coder

MAGIC = b"CSTB"
VERSION = 1
BLOCK_IDS = 4096  # ids of a block; blocks start on whole bytes
SHARD_IDS = 1 << 21  # a shard is closed after the document that reaches so many ids
_HEAD = struct.Struct("<4sHHIQQ")  # magic, version, bits, ids of a block, documents, ids


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Each id in `bits` bits, lowest bit first, one after the other; the last byte is filled with zeros."""
    ids = ids.astype("<u4")
    if bits == 8 or bits == 16 or bits == 32:
        return ids.astype(f"<u{bits // 8}").tobytes()
    lines = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(lines, bitorder="little").tobytes()


def unpack_bits(data, bits: int, n: int) -> np.ndarray:
    """The first n ids of packed bytes."""
    if bits == 8 or bits == 16 or bits == 32:
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    lines = np.zeros((n, 32), np.uint8)
    lines[:, :bits] = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return np.packbits(lines, axis=1, bitorder="little").reshape(-1).view("<u4")


def width(vocabulary: int) -> int:
    """The fewest bits that hold every id below `vocabulary`."""
    return max(1, (vocabulary - 1).bit_length())


def write_shard(ids: np.ndarray, doc_ends: np.ndarray, bits: int) -> bytes:
    """A shard's bytes: header; the end of each document, in ids (u64); the place of each block, in bytes
    of the body (u64); the body, blocks of BLOCK_IDS packed ids."""
    blocks = [pack_bits(ids[a : a + BLOCK_IDS], bits) for a in range(0, len(ids), BLOCK_IDS)]
    places = np.cumsum([0, *map(len, blocks)], dtype="<u8")[:-1] if blocks else np.zeros(0, "<u8")
    head = _HEAD.pack(MAGIC, VERSION, bits, BLOCK_IDS, len(doc_ends), len(ids))
    return b"".join([head, doc_ends.astype("<u8").tobytes(), places.tobytes(), *blocks])


class Shard:
    """Random access to a shard's bytes: only the blocks that a request touches are unpacked."""

    def __init__(self, data: bytes):
        magic, version, self.bits, self.block, self.n_docs, self.n_ids = _HEAD.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token shard of this version")
        at = _HEAD.size
        self.ends = np.frombuffer(data, "<u8", self.n_docs, at).astype(np.int64)
        at += 8 * self.n_docs
        self.places = np.frombuffer(data, "<u8", -(-self.n_ids // self.block), at).astype(np.int64)
        self.body = memoryview(data)[at + 8 * len(self.places) :]

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids first to last (exclusive) of the shard."""
        if first >= last:
            return np.zeros(0, np.uint32)
        a, b = first // self.block, (last - 1) // self.block
        blocks = [unpack_bits(self.body[self.places[k] :], self.bits, min(self.block, self.n_ids - k * self.block)) for k in range(a, b + 1)]
        return np.concatenate(blocks)[first - a * self.block : last - a * self.block]

    def doc(self, k: int) -> np.ndarray:
        """Ids of the k-th document."""
        return self.ids(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


def _writer(path: str, end_id: int, bits: int):
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("shard", pa.large_binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        ids, docs, sizes, held = bytearray(), [], [], 0
        end = np.array([end_id], "<u4").tobytes()

        def close():
            nonlocal seq, ids, docs, sizes, held
            data = write_shard(np.frombuffer(ids, "<u4"), np.cumsum(sizes, dtype=np.int64), bits)
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([len(docs)], pa.int64()), pa.array([held], pa.int64()),
                 pa.array([docs], pa.list_(pa.int64())), pa.array([data], pa.large_binary())], schema=schema,
            )
            seq, ids, docs, sizes, held = seq + 1, bytearray(), [], [], 0
            return row

        for batch in batches:
            coder = word_coder(path)
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                own = coder.packed(text.as_py())
                ids += own
                ids += end
                docs.append(doc)
                sizes.append(len(own) // 4 + 1)
                held += sizes[-1]
                if held >= SHARD_IDS:
                    yield close()
        if docs:
            yield close()

    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode `docs` in ascending doc_id order and write shards to `folder`.

    A shard is one row (part, seq, n_docs, n_ids, doc_ids, shard); `shard` holds the bytes described at
    `write_shard`, in the fewest bits that the vocabulary needs. Rows are range-sorted by doc_id (null
    first, rows of equal doc_id by a hash of their text, so many equal ids are spread too), and (part,
    seq) is the order of the shards. Spark writes the files, on any file system and once for each
    task that succeeds. A null text is empty: its document holds the end id alone.
    """
    ship(docs.sparkSession)
    bits = width(max(vocabulary_size(tokenizer), end_id + 1))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    sorted_docs = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(shuffle_parts(docs.sparkSession), "doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text")
    )
    shards = sorted_docs.mapInArrow(
        _writer(tokenizer, end_id, bits), "part int, seq long, n_docs long, n_ids long, doc_ids array<long>, shard binary"
    )
    shards.write.option("parquet.block.size", 32 << 20).option("compression", "none").parquet(folder)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    for batch in batches:
        for start, docs, data in zip(batch["start"].to_pylist(), batch["doc_ids"].to_pylist(), batch["shard"]):
            shard = Shard(data.as_py())
            ends = shard.ends
            firsts = np.concatenate(([0], ends[:-1]))
            for a in range(0, len(docs), 1024):
                b = min(a + 1024, len(docs))
                whole = shard.ids(int(firsts[a]), int(ends[b - 1])).astype("<u4")
                packed = [whole[x - firsts[a] : y - firsts[a]].tobytes() for x, y in zip(firsts[a:b], ends[a:b])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs[a:b], pa.int64()), pa.array(start + firsts[a:b]), pa.array(ends[a:b] - firsts[a:b]), pa.array(packed, pa.binary())],
                    schema=schema,
                )


def shard_starts(spark: SparkSession, folder: str) -> DataFrame:
    """(part, seq, start) of each shard: ids of all shards before it. Reads no shard's bytes. The shards of
    a part are added up first, so each window holds a part's shards, or one row for each part."""
    shards = spark.read.parquet(folder).select("part", "seq", "n_ids")
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return shards.join(parts, "part").select("part", "seq", (F.col("base") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).alias("start"))


def _placed(spark: SparkSession, folder: str) -> DataFrame:
    ship(spark)
    shards = spark.read.parquet(folder)
    return shards.join(shard_starts(spark, folder), ["part", "seq"]).select("start", "doc_ids", "shard")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Read shards back: doc_id, start (ids of all documents before), n_tokens, ids (little-endian u32 bytes)."""
    return _placed(spark, folder).mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids binary")


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums = pa.array([zlib.crc32(x.as_py()) for x in batch["ids"]], pa.int64())
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["start"], batch["n_tokens"], sums], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_index(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the documents read back from `folder`. The worker that reads a shard also adds up
    its checks: ids go through one process, not two."""
    return _placed(spark, folder).mapInArrow(lambda batches: _check(_reader(batches)), "doc_id long, start long, n_tokens long, ids_crc32 long")


def binary_tokens(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Write `docs` to `folder` (a new one in the shared folder by default) and read the index back."""
    spark = docs.sparkSession
    folder = folder or new_dir(spark, "tokens")
    write_tokens(docs, folder, tokenizer, end_id)
    return token_index(spark, folder)
