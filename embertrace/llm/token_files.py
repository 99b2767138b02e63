"""Token ids as files of directly addressable codes.

An id is split into chunks of eight bits. Level 0 holds the low chunk of every id, level 1 the next
chunk of those ids that have one, and so on; a bitmap per level marks the ids that continue, and a
rank directory holds the number of marks before each block of 512. Token i is read by one byte, one
bit and one rank per level, without decoding its neighbours.

A file is a Parquet table of segments in ascending doc_id order, so executors write and read it
through Spark on any store. A segment holds whole documents:

    part, segment   bigint   range of ids, and number within it
    first, size     bigint   ids of the part before this segment, ids in it
    doc_ids         binary   int64 per document, little endian
    known           binary   one byte per document, 0 where doc_id is null
    counts          binary   int64 per document
    codes           binary   the coded ids: header "DAC1", level count, then the levels
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from embertrace.llm.common import slices, texts_of
from embertrace.llm.tokens import encoder

END_ID = 2
SEGMENT_TOKENS = 1 << 18
BLOCK_BITS = 512
FILE_SCHEMA = "part bigint, segment bigint, first bigint, size bigint, doc_ids binary, known binary, counts binary, codes binary"
ROWS_SCHEMA = "doc_id bigint, part bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def pack_codes(ids: np.ndarray) -> bytes:
    """Coded form of unsigned 32-bit ids."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest >= 256
        chunks = (rest & 255).astype(np.uint8).tobytes()
        if not more.any():
            levels.append((len(rest), chunks, b"", b""))
            break
        bits = np.packbits(more, bitorder="little")
        bits = np.pad(bits, (0, -len(bits) % (BLOCK_BITS // 8)))
        ones = np.bitwise_count(bits).reshape(-1, BLOCK_BITS // 8).sum(1)
        ranks = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype("<u4")
        levels.append((len(rest), chunks, bits.tobytes(), ranks.tobytes()))
        rest = rest[more] >> 8
    head = b"DAC1" + struct.pack("<B", len(levels))
    head += b"".join(struct.pack("<3I", n, len(bits), len(ranks)) for n, _, bits, ranks in levels)
    return head + b"".join(chunks + bits + ranks for _, chunks, bits, ranks in levels)


class Codes:
    """Coded ids, read in place."""

    def __init__(self, data: bytes):
        if data[:4] != b"DAC1":
            raise ValueError("these bytes are not coded token ids")
        count, at = data[4], 5 + 12 * data[4]
        self.levels = []
        for k in range(count):
            n, bits, ranks = struct.unpack_from("<3I", data, 5 + 12 * k)
            self.levels.append((np.frombuffer(data, np.uint8, n, at), np.frombuffer(data, np.uint8, bits, at + n),
                                np.frombuffer(data, "<u4", ranks // 4, at + n + bits)))
            at += n + bits + ranks

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        """Token ``i``: constant work per level."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * k)
            if not len(bits) or not bits[i >> 3] >> (i & 7) & 1:
                return value
            block = i // BLOCK_BITS
            inside = bits[block * BLOCK_BITS // 8 : i >> 3]
            partial = int(bits[i >> 3]) & ((1 << (i & 7)) - 1)
            i = int(ranks[block]) + int(np.bitwise_count(inside).sum()) + partial.bit_count()
        return value

    def all(self) -> np.ndarray:
        ids = np.zeros(0, np.uint32)
        for chunks, bits, _ in reversed(self.levels):
            low = chunks.astype(np.uint32)
            if len(bits):
                low[np.unpackbits(bits, bitorder="little", count=len(chunks)).astype(bool)] |= ids << 8
            ids = low
        return ids


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Encode whole texts of ``docs`` (doc_id, text) and write them below ``path``, ids ascending.

    A null text is empty and gives the end id alone. Null ids come first; rows of one id stand in the
    order of their texts; an empty table writes an empty file. Memory per task: one segment.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, part = encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        docs_held: list[tuple] = []
        held, segment, first = 0, 0, 0

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(d[1] for d in docs_held), "<u4")
            values = [
                part, segment, first, len(ids), np.array([d[0] or 0 for d in docs_held], "<i8").tobytes(),
                bytes(d[0] is not None for d in docs_held),
                np.array([len(d[1]) // 4 for d in docs_held], "<i8").tobytes(), pack_codes(ids)]
            kinds = [pa.int64()] * 4 + [pa.binary()] * 4
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

        for batch in slices(batches, 250):
            for doc, ids in zip(batch.column(0).to_pylist(), coder.encode(texts_of(batch))):
                docs_held.append((doc, ids + end))
                held += len(ids) // 4 + 1
                if held >= SEGMENT_TOKENS:
                    yield close()
                    segment, first = segment + 1, first + held
                    docs_held, held = [], 0
        if docs_held:
            yield close()

    names = [c.split()[0] for c in FILE_SCHEMA.split(", ")]
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, FILE_SCHEMA).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every stored document, from the files alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = Codes(row["codes"]).all().astype("<u4")
                counts = np.frombuffer(row["counts"], "<i8")
                ends = np.cumsum(counts)
                data = memoryview(ids.tobytes())
                sums = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist())]
                known = np.frombuffer(row["known"], np.uint8) == 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(row["doc_ids"], "<i8"), pa.int64(), mask=known),
                     pa.array(np.full(len(counts), row["part"])), pa.array(row["first"] + ends - counts),
                     pa.array(counts), pa.array(sums, pa.int64())], names)

    names = [c.split()[0] for c in ROWS_SCHEMA.split(", ")]
    stored = spark.read.schema(FILE_SCHEMA).parquet(path)
    rows = stored.mapInArrow(run, ROWS_SCHEMA)
    # Where each part starts: one row a part, from the segment directories without the codes.
    last = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = stored.groupBy("part").agg(F.sum("size").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(last), F.lit(0)).alias("before"))
    return rows.join(parts, "part").select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
