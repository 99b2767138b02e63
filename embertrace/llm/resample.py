"""Target-distribution importance resampling over hashed n-gram buckets.

The n-grams of a text fall into buckets. A bucket that the target texts fill more often than the given
documents do has a positive gain, else a negative one; a document's weight is the mean gain of its n-grams.
Adding a Gumbel draw of the document's own and keeping the highest sums draws documents without
replacement, likelier ones more often.

N-grams are interned per batch of texts in an open-addressed table in numpy: the slot is found by the
xxhash64 of an n-gram's bytes, and the bytes are compared before an occurrence takes a slot. A slot holds
the n-gram's bucket and its count, so each distinct n-gram of a batch is hashed to its bucket once, and the
occurrences' slots gather the gains.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embertrace.llm.common import byte_slices, schema_with, texts_of, written
from embertrace.operators.tables import number_rows

LONGEST, BUCKETS = 1, 10_000
LEAST_WORDS, PERCENT = 20, 10
SEED = 2024
SLICE_BYTES = 2 << 20  # text interned at once: some sixty bytes of memory for each of its bytes

# Fixed values of xxhash64.
P1, P2, P3 = np.uint64(0x9E3779B185EBCA87), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
P4, P5 = np.uint64(0x85EBCA77C2B2AE63), np.uint64(0x27D4EB2F165667C5)

WORD_BYTE = np.ones(256, bool)
WORD_BYTE[:0x30] = WORD_BYTE[0x3A:0x61] = WORD_BYTE[0x7B:0x80] = False


def rolled(h: np.ndarray, by: int) -> np.ndarray:
    return (h << np.uint64(by)) | (h >> np.uint64(64 - by))


def masked_lanes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, at: int) -> np.ndarray:
    """Bytes ``at`` to ``at + 8`` of each piece as one number, zero behind its end. ``data`` is padded."""
    view = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    left = np.clip(sizes - at, 0, 8).astype(np.uint64)
    lanes = view[np.minimum(starts + at, len(view) - 1)]
    keep = np.where(left >= 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (np.uint64(8) * np.minimum(left, 7))) - np.uint64(1))
    return lanes & keep


def xxhash64(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """xxhash64 of pieces of ``data``, which has eight bytes of padding: those below 32 bytes all at once,
    longer ones each through the library."""
    h = P5 + sizes.astype(np.uint64)
    most = int(min(31, sizes.max(initial=0)))
    for at in range(0, most - 7, 8):
        on = np.flatnonzero(sizes >= at + 8)
        lane = masked_lanes(data, starts[on], sizes[on], at)
        h[on] = rolled(h[on] ^ rolled(lane * P2, 31) * P1, 27) * P1 + P4
    whole = sizes & ~7
    on = np.flatnonzero(sizes & 4)
    lane = masked_lanes(data, starts[on] + whole[on], np.full(len(on), 4), 0)
    h[on] = rolled(h[on] ^ lane * P1, 23) * P2 + P3
    for k in range(3):
        on = np.flatnonzero((sizes & 3) > k)
        byte = data[starts[on] + (sizes[on] & ~3) + k].astype(np.uint64)
        h[on] = rolled(h[on] ^ byte * P5, 11) * P1
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    h ^= h >> np.uint64(32)
    for i in np.flatnonzero(sizes >= 32).tolist():
        h[i] = xxhash.xxh64_intdigest(data[starts[i] : starts[i] + sizes[i]].tobytes())
    return h


@dataclass
class Words:
    """The words of a slice of texts: where they lie in ``data``, and how many each text has."""

    data: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    counts: np.ndarray


def words(texts: list[str]) -> Words:
    parts = [t.encode("utf-8", "surrogatepass").lower() for t in texts]  # bytes.lower() changes A to Z alone
    data = np.frombuffer(b" " + b" ".join(parts) + b" " * 9, np.uint8)
    inside = WORD_BYTE[data]
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[0::2] + 1, edges[1::2] + 1
    bounds = np.cumsum([len(p) + 1 for p in parts]) + 1
    return Words(data, starts, ends - starts, np.diff(np.searchsorted(starts, bounds), prepend=0))


def ngrams(found: Words, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(data, start, size, text) of each run of 1 to ``longest`` consecutive words of one text, its words
    joined by one space. Texts stand in order, and so does ``text``."""
    of = np.repeat(np.arange(len(found.counts)), found.counts)
    if longest == 1:
        return found.data, found.starts, found.sizes, of
    # The words anew with one space between them, so that a run of words is one piece of bytes.
    ends = np.cumsum(found.sizes + 1)
    starts = ends - found.sizes - 1
    data = np.full(int(ends[-1]) + 9 if len(ends) else 9, 0x20, np.uint8)
    shift = np.repeat(found.starts - starts, found.sizes)
    inside = np.repeat(starts, found.sizes) + np.arange(len(shift)) - np.repeat(np.cumsum(found.sizes) - found.sizes, found.sizes)
    data[inside] = found.data[inside + shift]
    pieces = []
    for n in range(1, longest + 1):
        at = np.flatnonzero(of[n - 1 :] == of[: len(of) - n + 1]) if len(of) >= n else np.zeros(0, np.int64)
        last = at + n - 1
        pieces.append((starts[at], starts[last] + found.sizes[last] - starts[at], of[at]))
    start, size, text = (np.concatenate(column) for column in zip(*pieces))
    order = np.argsort(text, kind="stable")
    return data, start[order], size[order], text[order]


class Interned:
    """An open-addressed table of the distinct pieces of ``data``.

    Slots are probed one after the other from the key's place on. A slot is taken by the first piece that
    finds it free, and by later ones only if hash, size and bytes agree; equal hashes of other bytes probe
    on. ``slots`` has the slot of each piece; ``bucket`` and ``count`` belong to slots.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, buckets: int, keys: np.ndarray | None = None):
        self.data, self.starts, self.sizes = data, starts, sizes
        keys = xxhash64(data, starts, sizes) if keys is None else keys
        bits = max(4, int(2 * len(keys)).bit_length())
        held = np.full(1 << bits, -1, np.int64)  # the piece that took the slot
        self.slots = ((keys * P1) >> np.uint64(64 - bits)).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            slot = self.slots[left]
            free = held[slot] < 0
            held[slot[free]] = left[free]  # of several, the last stays
            owner = held[slot]
            other = np.flatnonzero(owner != left)
            same = np.ones(len(left), bool)
            same[other] = (keys[owner[other]] == keys[left[other]]) & self._equal(owner[other], left[other])
            left = left[~same]
            self.slots[left] = (self.slots[left] + 1) & (len(held) - 1)
        self.count = np.bincount(self.slots, minlength=len(held))
        self.bucket = np.zeros(len(held), np.int64)
        taken = np.flatnonzero(held >= 0)
        raw, crc32 = data.tobytes(), zlib.crc32
        first = starts[held[taken]].tolist()
        self.bucket[taken] = [crc32(raw[a : a + n]) % buckets for a, n in zip(first, sizes[held[taken]].tolist())]

    def _equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces have the same bytes."""
        same = self.sizes[a] == self.sizes[b]
        for at in range(0, int(min(32, self.sizes[a].max(initial=0))), 8):
            on = np.flatnonzero(same & (self.sizes[a] > at))
            same[on] = masked_lanes(self.data, self.starts[a[on]], self.sizes[a[on]], at) == masked_lanes(self.data, self.starts[b[on]], self.sizes[b[on]], at)
        for i in np.flatnonzero(same & (self.sizes[a] > 32)).tolist():
            p, q, n = self.starts[a[i]], self.starts[b[i]], self.sizes[a[i]]
            same[i] = np.array_equal(self.data[p : p + n], self.data[q : q + n])
        return same


def blocks(texts: list[str], longest: int) -> Iterator[list[str]]:
    """A slice of texts as it is; a single long text of words in pieces cut at spaces."""
    if len(texts) != 1 or longest > 1:
        yield texts
        return
    text, start = texts[0], 0
    while len(text) - start > SLICE_BYTES:
        cut = text.rfind(" ", start, start + SLICE_BYTES)
        cut = cut if cut > start else text.find(" ", start + SLICE_BYTES)
        if cut < 0:
            break
        yield [text[start:cut]]
        start = cut
    yield [text[start:]]


def bucket_counts(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """How many n-grams of all ``texts`` (text) fall in each bucket. A task sends at most ``buckets`` sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for part in byte_slices(batches, SLICE_BYTES):
            for texts in blocks(texts_of(part), longest):
                data, starts, sizes, _ = ngrams(words(texts), longest)
                table = Interned(data, starts, sizes, buckets)
                total += np.bincount(table.bucket, weights=table.count, minlength=buckets).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    sums = texts.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in sums.collect():  # one row per bucket at most
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain in thousandths: the logarithm of its share among the target's n-grams over its share
    among the source's, with one added to each bucket."""
    buckets = float(len(source))
    above = (target.astype(float) + 1) * (float(source.sum()) + buckets)
    below = (source.astype(float) + 1) * (float(target.sum()) + buckets)
    return np.floor(1000 * np.log(above / below)).astype(np.int64)


def weights(docs: DataFrame, by_bucket: np.ndarray, longest: int = LONGEST, names: tuple[str, str, str] = ("n_words", "n_features", "weight")) -> DataFrame:
    """``docs`` without its text, with three columns appended: the text's words, its n-grams, and the floored
    mean of their gains (0 without n-grams). A column of such a name is refused; take other ``names``."""
    if clash := {n.lower() for n in names} & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns {sorted(clash)} exist already; pass other names")
    shared = docs.sparkSession.sparkContext.broadcast(by_bucket)  # one number per bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for part in byte_slices(batches, SLICE_BYTES):
            total = np.zeros((3, part.num_rows), np.int64)  # words, n-grams, gains
            for texts in blocks(texts_of(part), longest):
                found = words(texts)
                data, starts, sizes, of = ngrams(found, longest)
                table = Interned(data, starts, sizes, len(gain))
                n = np.bincount(of, minlength=part.num_rows)
                before = np.concatenate([[0], np.cumsum(gain[table.bucket][table.slots])])
                ends = np.cumsum(n)
                total += np.stack([found.counts, n, before[ends] - before[ends - n]])
            total[2] //= np.maximum(total[1], 1)
            rest = part.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays([*rest.columns, *map(pa.array, total)], [*rest.schema.names, *names])

    return docs.mapInArrow(run, schema_with(docs.drop("text"), ", ".join(f"`{n}` bigint" for n in names)))


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """A document's own Gumbel draw in thousandths, floored, from its id alone (null counts as empty)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("bigint")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, longest: int = LONGEST,
             buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for each row of ``docs`` (doc_id, text); ``target`` has texts.

    Of the rows with at least ``least_words`` words, ``percent`` in a hundred (floored) of the highest score
    are drawn and ranked from 1; ties go to the smaller doc_id, a null id last. Whole texts count, from every
    row. A null or empty text has no n-grams and weight 0. Rows of one id share their draw and are scored by
    their own texts; equal rows are ranked each by itself. An empty target gives every bucket the gain of an
    unseen one, empty ``docs`` no rows. Other columns are ignored.
    """
    rows = docs.select("doc_id", "text")
    by_bucket = gains(bucket_counts(rows, longest, buckets), bucket_counts(target, longest, buckets))
    scored = weights(rows, by_bucket, longest).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    scored = written(scored, "weights")
    drawn = scored.where(F.col("n_words") >= least_words).count() * percent // 100
    order = [F.col("score").desc(), F.col("doc_id").isNull(), F.col("doc_id"), F.col("weight"), F.col("n_features")]
    able = number_rows(scored.where(F.col("n_words") >= least_words), order, "place")
    rank = F.when(F.col("place") < drawn, F.col("place") + 1).cast("bigint")
    columns = ["doc_id", "n_features", "weight", "score"]
    rest = scored.where(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("bigint").alias("rank"))
    return able.select(*columns, rank.alias("rank")).unionByName(rest)
