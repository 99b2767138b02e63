"""Document fingerprints: bottom-k sketches of shingle hashes.

A fingerprint holds the k smallest hashes, 48 bits each, of a text's five-word shingles, as text. It
is a pure function of the shingle set, so equal texts have equal fingerprints; fingerprints of parts
merge into the fingerprint of the whole; and two of them estimate resemblance, containment and the
number of distinct shingles.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embertrace.llm.common import slices
from embertrace.llm.shingles import shingle_hashes

K = 128
SPAN = 1 << 48
ROWS = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def sketch(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest values, ascending, of sorted distinct 64-bit hashes cut to 48 bits."""
    return np.unique(hashes >> np.uint64(16))[:k]


def to_text(values: np.ndarray) -> str:
    return base64.b64encode(values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, 6)
    return np.pad(raw, ((0, 0), (2, 0))).reshape(-1).view(">u8").astype(np.uint64)


def merge(*sketches: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of all parts together."""
    return np.unique(np.concatenate(sketches))[:k]


def distinct(values: np.ndarray, k: int = K) -> float:
    """Number of distinct shingles: exact below k, else estimated from the k-th smallest hash."""
    return float(len(values)) if len(values) < k else (k - 1) / (float(values[-1]) / SPAN)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of the union's shingles that both have; 1 for two empty texts, 0 if only one is empty."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = merge(a, b, k=k)
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.searchsorted(both, union[-1], side="right")) / len(union)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of ``a``'s shingles that ``b`` has."""
    if not len(a):
        return 1.0
    shared = resemblance(a, b, k) * distinct(merge(a, b, k=k), k)
    return min(1.0, shared / distinct(a, k))


def edited(text: str, after: str) -> str:
    """``text`` with its last quarter replaced by as much of the start of ``after``."""
    n = len(text) // 4
    return text[: len(text) - n] + after[:n]


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (part, extra, doc_id, text), to be sorted in that order: within a part, each row that is
    not extra is followed by the next document. The first documents of a part are also sent, as extra,
    to the part before; those of the first part to the last."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # One small row a part: the lowest id of each range. Null ids belong to the first.
    ids = docs.select("doc_id").repartitionByRange(parts, "doc_id")
    firsts = [r["first"] for r in ids.groupBy(F.spark_partition_id().alias("p")).agg(F.min("doc_id").alias("first")).where("first is not null").collect()]
    nulls = docs.where("doc_id is null").limit(1).count()
    bounds = np.array(sorted(firsts) or [0], np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            values = ids.fill_null(0).to_numpy(zero_copy_only=False)
            part = np.where(known, np.maximum(np.searchsorted(bounds, values, side="right") - 1, 0), 0)
            leads = known & (values == bounds[part]) & ~((part == 0) & bool(nulls)) | ~known
            copies = np.flatnonzero(leads)
            text = batch.column(1)
            for rows, extra, to in ((None, 0, part), (copies, 1, (part[copies] - 1) % len(bounds))):
                chosen = pa.array(np.arange(len(part)) if rows is None else rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to.astype(np.int64)), pa.array(np.full(len(chosen), extra, np.int32)), ids.take(chosen), text.take(chosen)],
                    ["part", "extra", "doc_id", "text"])

    dealt = docs.select("doc_id", "text").mapInArrow(deal, "part bigint, extra int, doc_id bigint, text string")
    return dealt.repartition(parts, "part").sortWithinPartitions("part", "extra", "doc_id", "text")


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text), whole texts, other columns ignored.

    ``near_edited`` compares a document with its edited text, ``near_next`` with the next document in
    order of id (after the last: the first). A null text is empty; null ids come first; rows of one id
    stand in the order of their texts; a single document is its own next; an empty table gives no rows.
    Texts move once, to ranges of ids; the boundary rows of each range move twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in slices(batches, 250):
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            held += rows
            done, held = held[:-1], held[-1:]
            yield compare(done, held)
        yield compare(held, [])

    def compare(rows: list[tuple], after: list[tuple]) -> pa.RecordBatch:
        following = rows[1:] + after
        pairs = [(r, n) for r, n in zip(rows, following) if not r[1]]  # a document always has a row behind it
        texts = [r[3] or "" for r, _ in pairs]
        nexts = [n[3] or "" for _, n in pairs]
        changed = [edited(t, n) for t, n in zip(texts, nexts)]
        tail = nexts[-1:]
        # a document's next is the row behind it, so only rows not listed themselves are sketched apart
        known = {t: s for t, s in zip(texts + tail, (sketch(h, k) for h in shingle_hashes(texts + tail)))}
        apart = sorted({n for n in nexts if n not in known})
        known |= zip(apart, (sketch(h, k) for h in shingle_hashes(apart)))
        other = [sketch(h, k) for h in shingle_hashes(changed)]
        own, near = [known[t] for t in texts], [known[t] for t in nexts]
        columns = [
            pa.array([r[2] for r, _ in pairs], pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
            pa.array([to_text(s) for s in own], pa.string()), pa.array([to_text(s) for s in other], pa.string()),
            pa.array([resemblance(a, b, k) for a, b in zip(own, other)], pa.float64()),
            pa.array([resemblance(a, b, k) for a, b in zip(own, near)], pa.float64())]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in ROWS.split(", ")])

    return with_next(docs).mapInArrow(run, ROWS)
