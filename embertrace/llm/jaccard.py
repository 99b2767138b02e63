"""Exact n-gram Jaccard join by set relations: how many documents each document links with, and its class.

A document's set holds the hashes of its distinct five-word shingles; documents with equal sets are one
set from there on. Two sets link when their Jaccard similarity reaches the threshold; a class is what
links connect.

1. Screening. If two sets link, the lowest-hashed parts of both share a known number of hashes. Counting,
   by blocks of hash values, which hashes of those parts occur in a second set leaves the sets that can
   have a partner at all.
2. Index. Of these, hashes are ordered by the number of sets that have them, rare ones first. A linked
   pair must meet in the rarest quarter of both, so only hashes there that occur twice are listed, with
   set size and position.
3. Index lists are skipped by position: a pair that first meets at positions p and q of sets of n and m
   can share at most min(n - p, m - q) hashes. The block of positions up to a seventh of a set can meet
   sets of any admissible size; the block behind it can only meet smaller sets, so two entries of that
   block are never compared.
4. Answers are derived, not searched, for highly similar sets. Each set is compared with the hub of its
   index lists; sets that are near their hub form a group with it. A group has one reference set, and each
   member keeps only where it differs from it: D, what it lacks, and A, what it has besides. For members a
   and b, shared(a, b) = |reference| - |D_a or D_b| + |A_a and A_b| exactly. Members are sorted by the size
   of their difference and cut into blocks; two blocks whose sizes alone rule links out never meet, and
   where sizes alone prove them nothing is compared. Else the differences, not the sets, are counted
   against each other inside the task, which returns sums per set, never a row per pair.
5. Only entries of different groups are still compared through the index lists, all of them.

Overlaps are counted exactly, on the hashes that more than one set has. Hashes have 64 bits, those of
shingles as well as those of whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embertrace.llm.common import slices, texts_of, written
from embertrace.llm.components import components
from embertrace.llm.links import Forest
from embertrace.llm.shingles import mix, shingle_hashes
from embertrace.operators.tables import number_rows

NUMERATOR, DENOMINATOR = 3, 4  # a pair links when shared / union >= 3 / 4
SCREEN_SHARE = 0.15  # of a set's hashes, how many must be shared within the screened part
BLOCK_BYTES = 8 << 20  # hashes that one block of hash values holds, about
MOST_FILTER_BITS = 1 << 26
HUB_ROUNDS = 2
NEAR = 1, 2  # a set joins the group of a hub when shared / union >= 1 / 2
BLOCK_SETS = 512  # members of a group that are compared with each other at once
NODE = "struct<no_id:boolean,id:bigint,set_id:bigint>"


def least_shared(n: np.ndarray) -> np.ndarray:
    """Hashes that a set of ``n`` shares at least with any partner."""
    return -(-NUMERATOR * n // DENOMINATOR)


def screened(n: np.ndarray) -> np.ndarray:
    """Hashes of a set's lowest part that its screening demands to share, were all sets of its size."""
    return np.maximum(1, (SCREEN_SHARE * n).astype(np.int64))


def part_size(n: np.ndarray) -> np.ndarray:
    return n - least_shared(n) + screened(n)


def set_id(hashes: np.ndarray) -> int:
    """Hash of a set as a signed 64-bit number."""
    return int(mix(np.add.reduce(mix(hashes), keepdims=True) + np.uint64(len(hashes))).view(np.int64)[0])


def with_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, n_shingles, set_id): k1 and k2 stand for id and text of a row; set_id is null for a
    text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = shingle_hashes(texts_of(part))
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:3], pa.array([len(s) for s in sets], pa.int64()), pa.array([set_id(s) if len(s) else None for s in sets], pa.int64())],
                ["doc_id", "k1", "k2", "n_shingles", "set_id"])

    rows = docs.select("doc_id", *row_keys(), "text")
    return rows.mapInArrow(run, "doc_id bigint, k1 bigint, k2 bigint, n_shingles bigint, set_id bigint")


def row_keys() -> list[Column]:
    """128 bits of a row's id and text."""
    text = F.coalesce("text", F.lit(""))
    return [F.xxhash64(F.lit(1), F.col("doc_id").isNull(), "doc_id", text).alias("k1"), F.xxhash64(text, "doc_id", F.col("doc_id").isNull(), F.lit(2)).alias("k2")]


def _blocks(values: np.ndarray, count: int) -> np.ndarray:
    return ((values.view(np.uint64) >> np.uint64(20)) % np.uint64(count)).astype(np.int64)


def _pack(*columns: np.ndarray) -> bytes:
    return b"".join(c.astype("<i8").tobytes() for c in columns)


def _unpack(blobs: list[bytes], columns: int) -> np.ndarray:
    parts = [np.frombuffer(b, "<i8").reshape(columns, -1) for b in blobs]
    return np.concatenate(parts, axis=1) if parts else np.zeros((columns, 0), np.int64)


def _block_rows(sets: list[tuple[int, int, np.ndarray]], blocks: int) -> pa.RecordBatch:
    """Hashes of a slice of sets (id, size, hashes), one row per block of hash values: ids and sizes of the
    sets that have hashes there, how many, and the hashes."""
    hashes = np.concatenate([h for _, _, h in sets]) if sets else np.zeros(0, np.uint64)
    of = np.repeat(np.arange(len(sets)), [len(h) for _, _, h in sets]) if sets else np.zeros(0, np.int64)
    ids, sizes = np.array([s[0] for s in sets], np.int64), np.array([s[1] for s in sets], np.int64)
    block = _blocks(hashes, blocks)
    order = np.argsort(block, kind="stable")
    cuts = np.searchsorted(block[order], np.arange(blocks + 1))
    rows, heads, bodies = [], [], []
    for b in range(blocks):
        chosen = order[cuts[b] : cuts[b + 1]]
        if len(chosen):
            owners, counts = np.unique(of[chosen], return_counts=True)
            rows.append(b)
            heads.append(_pack(ids[owners], sizes[owners], counts))
            bodies.append(hashes[chosen].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(heads, pa.binary()), pa.array(bodies, pa.binary())], ["block", "head", "body"])


BLOCK_SCHEMA = "block bigint, head binary, body binary"


def _shared(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(set, size, hash, number of sets with it) of each hash of a block that two sets have at least; a set
    that was sent more than once counts once."""
    heads = _unpack(table.column("head").to_pylist(), 3)
    hashes = np.frombuffer(b"".join(table.column("body").to_pylist()), np.uint64)
    owner = np.repeat(np.arange(heads.shape[1]), heads[2])
    order = np.argsort(hashes)
    hashes, ids = hashes[order], heads[0][owner[order]]
    owner = owner[order]
    if not len(hashes):
        return ids, ids, hashes, ids
    first = np.flatnonzero(np.diff(hashes, prepend=hashes[:1] ^ np.uint64(1)))
    two = np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first)
    some = np.repeat(two, np.diff(first, append=len(hashes)))
    hashes, ids, sizes = hashes[some], ids[some], heads[1][owner[some]]
    order = np.lexsort((ids, hashes))
    hashes, ids, sizes = hashes[order], ids[order], sizes[order]
    new = np.ones(len(ids), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (ids[1:] != ids[:-1])
    hashes, ids, sizes = hashes[new], ids[new], sizes[new]
    if not len(hashes):
        return ids, sizes, hashes, ids
    first = np.flatnonzero(np.diff(hashes, prepend=hashes[:1] ^ np.uint64(1)))
    runs = np.diff(first, append=len(hashes))
    return ids, sizes, hashes, np.repeat(runs, runs)


def _deal(ids: np.ndarray, columns: list[np.ndarray], blocks: int) -> pa.Table:
    """Rows (block, body): columns of 64-bit numbers, dealt by set id."""
    block = _blocks(mix(ids.view(np.uint64)), blocks)
    order = np.argsort(block, kind="stable")
    cuts = np.searchsorted(block[order], np.arange(blocks + 1))
    some = [b for b in range(blocks) if cuts[b] < cuts[b + 1]]
    bodies = [_pack(*(c[order[cuts[b] : cuts[b + 1]]] for c in columns)) for b in some]
    return pa.table({"block": pa.array(some, pa.int64()), "body": pa.array(bodies, pa.binary())})


def survivors(docs: DataFrame, blocks: int) -> DataFrame:
    """(set_id) of the sets that pass the screening."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000):
            sets = {}
            for h in shingle_hashes(texts_of(batch)):
                if len(h):
                    sets[set_id(h)] = (len(h), h[: int(part_size(np.int64(len(h))))])
            yield _block_rows([(k, n, h) for k, (n, h) in sets.items()], blocks)

    def count(table: pa.Table) -> pa.Table:
        ids, sizes, _, _ = _shared(table)
        ids, at, counts = np.unique(ids, return_index=True, return_counts=True)
        return _deal(ids, [ids, sizes[at], counts], blocks)

    def judge(table: pa.Table) -> pa.Table:
        ids, sizes, counts = _unpack(table.column("body").to_pylist(), 3)
        ids, at, back = np.unique(ids, return_index=True, return_inverse=True)
        counts = np.bincount(back, weights=counts, minlength=len(ids))
        # a partner may be smaller by the threshold, and then demands less
        return pa.table({"set_id": pa.array(ids[counts >= screened(least_shared(sizes[at]))], pa.int64())})

    sent = docs.select("text").mapInArrow(parts, BLOCK_SCHEMA)
    counted = sent.groupBy("block").applyInArrow(count, "block bigint, body binary")
    return counted.groupBy("block").applyInArrow(judge, "set_id bigint")


def _filter_bits(ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix(ids.view(np.uint64))
    return (h % np.uint64(bits)).astype(np.int64), ((h >> np.uint64(32)) % np.uint64(bits)).astype(np.int64)


def membership(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of ``ids`` (set_id), of at most MOST_FILTER_BITS: what it lets through besides costs
    work, not correctness. Partial filters are merged by groups of 32 partitions."""
    count = ids.count()
    bits = int(min(MOST_FILTER_BITS, 1 << max(10, (16 * count).bit_length())))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(bits, bool)
        for part in batches:
            for at in _filter_bits(part.column(0).to_numpy(), bits):
                seen[at] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(seen).tobytes()], pa.binary())], ["bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(bits // 8, np.uint8)
        for part in batches:
            for row in part.column(0).to_pylist():
                seen |= np.frombuffer(row, np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([seen.tobytes()], pa.binary())], ["bits"])

    marked, parts = ids.mapInArrow(mark, "bits binary"), ids.rdd.getNumPartitions()
    while parts > 32:
        parts = -(-parts // 32)
        marked = marked.repartition(parts).mapInArrow(merge, "bits binary")
    out = np.zeros(bits // 8, np.uint8)
    for row in marked.toLocalIterator():
        out |= np.frombuffer(row[0], np.uint8)
    return out


def candidate_sets(docs: DataFrame, chosen: np.ndarray) -> DataFrame:
    """(set_id, n, hashes) of the distinct sets that the filter lets through."""
    shared = docs.sparkSession.sparkContext.broadcast(chosen)  # MOST_FILTER_BITS / 8 bytes at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passing = np.unpackbits(shared.value).astype(bool)
        sent: set[int] = set()
        for part in slices(batches):
            sets = {}
            for h in shingle_hashes(texts_of(part)):
                if len(h) and (k := set_id(h)) not in sent:
                    sets[k] = h
            ids = np.array(list(sets), np.int64)
            one, two = _filter_bits(ids, len(passing))
            kept = ids[passing[one] & passing[two]].tolist()
            sent.update(kept)
            yield pa.RecordBatch.from_arrays(
                [pa.array(kept, pa.int64()), pa.array([len(sets[k]) for k in kept], pa.int64()), pa.array([sets[k].tobytes() for k in kept], pa.binary())],
                ["set_id", "n", "hashes"])

    return docs.select("text").mapInArrow(run, "set_id bigint, n bigint, hashes binary").dropDuplicates(["set_id"])


def index(sets: DataFrame, blocks: int) -> DataFrame:
    """(set_id, n, rare, hashes, listed): for each set that may have a partner, its number of hashes that
    no other set has, its other hashes, and those of them that index lists name, the rarest first."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000):
            ids, sizes, hashes = (c.to_pylist() for c in batch.columns)
            yield _block_rows([(k, n, np.frombuffer(h, np.uint64)) for k, n, h in zip(ids, sizes, hashes)], blocks)

    def rank(table: pa.Table) -> pa.Table:
        ids, sizes, hashes, sharers = _shared(table)
        return _deal(ids, [ids, sizes, hashes.view(np.int64), sharers], blocks)

    def assemble(table: pa.Table) -> pa.Table:
        ids, sizes, hashes, sharers = _unpack(table.column("body").to_pylist(), 4)
        order = np.lexsort((hashes, sharers, ids))
        ids, sizes, hashes = ids[order], sizes[order], hashes[order]
        first = np.flatnonzero(np.diff(ids, prepend=ids[:1] ^ 1)) if len(ids) else np.zeros(0, np.int64)
        out: list[tuple] = []
        for a, b in zip(first, np.append(first[1:], len(ids))):
            n = int(sizes[a])
            rare = n - int(b - a)
            listed = n - int(least_shared(np.int64(n))) + 1 - rare
            if listed > 0:
                out.append((int(ids[a]), n, rare, np.sort(hashes[a:b].view(np.uint64)).tobytes(), hashes[a : a + listed]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
        columns = list(zip(*out)) or [[]] * 5
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["set_id", "n", "rare", "hashes", "listed"])

    sent = sets.select("set_id", "n", "hashes").mapInArrow(parts, BLOCK_SCHEMA)
    ranked = sent.groupBy("block").applyInArrow(rank, "block bigint, body binary")
    return ranked.groupBy("block").applyInArrow(assemble, "set_id bigint, n bigint, rare bigint, hashes binary, listed array<bigint>")


def linked(pairs: DataFrame, stored: DataFrame, share: tuple[int, int] = (NUMERATOR, DENOMINATOR)) -> DataFrame:
    """The rows of ``pairs`` (a, b) whose sets have a similarity of ``share`` or more, by exact overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2000):
            a, b, n, m, left, right = (c.to_pylist() for c in part.columns)
            kept = []
            for k in range(len(a)):
                both = len(np.intersect1d(np.frombuffer(left[k], np.uint64), np.frombuffer(right[k], np.uint64), assume_unique=True))
                if share[1] * both >= share[0] * (n[k] + m[k] - both):
                    kept.append(k)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(kept, pa.int64())), part.column(1).take(pa.array(kept, pa.int64()))], ["a", "b"])

    left = stored.select(F.col("set_id").alias("a"), "n", F.col("hashes").alias("ha"))
    right = stored.select(F.col("set_id").alias("b"), F.col("n").alias("m"), F.col("hashes").alias("hb"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "n", "m", "ha", "hb")
    return rows.mapInArrow(run, "a bigint, b bigint")


def _can_link(n: str, p: str, m: str, q: str) -> str:
    """SQL: sizes ``n``, ``m`` admit a link, and so do the hashes left from positions ``p`` and ``q`` on."""
    least = f"{NUMERATOR} * ({n} + {m})"
    over = NUMERATOR + DENOMINATOR
    return f"({DENOMINATOR} * {n} >= {NUMERATOR} * {m} AND {DENOMINATOR} * {m} >= {NUMERATOR} * {n} AND {over} * least({n} - {p}, {m} - {q}) >= {least})"


def differences(stored: DataFrame, groups: DataFrame, copies: DataFrame) -> DataFrame:
    """(group, set_id, no_id, id, copies, weight, most, reference, differs) of each member of a group (node,
    label): its rows and lowest id, its difference from the group's reference set (the hashes of the set of
    number ``label``), and what decides links. For members a and b that have ``o`` hashes of their
    differences in common, NUMERATOR / DENOMINATOR of the union are shared when
    weight_a + weight_b <= reference + (NUMERATOR + DENOMINATOR) * o; ``most`` is the greatest o of a member."""
    over = NUMERATOR + DENOMINATOR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 500):
            sizes, own, reference = (part.column(k).to_pylist() for k in (5, 6, 7))
            weight, most, length, differs = [], [], [], []
            for n, a, h in zip(sizes, own, reference):
                a, h = np.frombuffer(a, np.uint64), np.frombuffer(h, np.uint64)
                x = np.setxor1d(a, h, assume_unique=True)
                both = (len(a) + len(h) - len(x)) // 2
                lacks, besides = len(h) - both, n - both  # hashes that no other set has are besides, too
                weight.append((over - NUMERATOR) * lacks + NUMERATOR * besides)
                most.append(len(x))
                length.append(len(h))
                differs.append(x.tobytes())
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:5], pa.array(weight, pa.int64()), pa.array(most, pa.int64()), pa.array(length, pa.int64()), pa.array(differs, pa.binary())], names)

    names = ["group", "set_id", "no_id", "id", "copies", "weight", "most", "reference", "differs"]
    moved = groups.select(F.col("label").alias("group"), F.col("node").alias("set_id"))
    members = moved.unionByName(moved.select("group", F.col("group").alias("set_id")).distinct())
    rows = members.join(stored.select("set_id", "n", "hashes"), "set_id").join(copies, "set_id")
    reference = stored.select(F.col("set_id").alias("group"), F.col("hashes").alias("reference"))
    rows = rows.join(reference, "group").select("group", "set_id", F.col("id").isNull().alias("no_id"), "id", "copies", "n", "hashes", "reference")
    return rows.mapInArrow(run, "group bigint, set_id bigint, no_id boolean, id bigint, copies bigint, weight bigint, most bigint, reference bigint, differs binary")


def common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many numbers each of ``a`` has in common with each of ``b``; all are sorted and distinct."""
    left, right = np.concatenate(a), np.concatenate(b)
    i, j = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])
    values, code = np.unique(np.concatenate([left, right]), return_inverse=True)
    codes = code[: len(left)], code[len(left) :]
    held = [np.bincount(c, minlength=len(values)) for c in codes]
    out = np.zeros((len(a), len(b)), np.int64)
    often = (held[0] * 8 > len(a)) & (held[1] * 8 > len(b))
    frequent = np.flatnonzero(often)
    place = np.full(len(values), -1)
    for at in range(0, len(frequent), 4096):  # as products of matrices
        place[:] = -1
        place[frequent[at : at + 4096]] = np.arange(len(frequent[at : at + 4096]))
        m, n = np.zeros((len(a), 4096), np.float32), np.zeros((len(b), 4096), np.float32)
        for matrix, rows, c in ((m, i, codes[0]), (n, j, codes[1])):
            on = place[c] >= 0
            matrix[rows[on], place[c[on]]] = 1
        out += np.rint(m @ n.T).astype(np.int64)
    # The others value by value: each row of the one side with each of the other that has the value.
    seldom = ~often & (held[0] > 0) & (held[1] > 0)
    order = np.argsort(codes[1], kind="stable")
    starts = np.cumsum(held[1]) - held[1]
    on = np.flatnonzero(seldom[codes[0]])
    times = held[1][codes[0][on]]
    ends = np.cumsum(times)
    for low, high in zip(*_cuts(ends, 1 << 21)):
        t = times[low:high]
        first = np.repeat(starts[codes[0][on[low:high]]], t)
        inside = np.arange(len(first)) - np.repeat(np.cumsum(t) - t, t)
        out += np.bincount(np.repeat(i[on[low:high]], t) * len(b) + j[order[first + inside]], minlength=out.size).reshape(out.shape)
    return out


def _cuts(ends: np.ndarray, most: int) -> tuple[list[int], list[int]]:
    """Where to cut rows with running totals ``ends`` so that no stretch of more than one exceeds ``most``."""
    starts, at = [], 0
    while at < len(ends):
        starts.append(at)
        at = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
    return starts, [*starts[1:], len(ends)]


def links_within(members: DataFrame) -> DataFrame:
    """(set_id, node, partners, reached): for each block pair of a group and each set with links there, the
    rows of other sets that it links with, and a set that links reach."""
    over = NUMERATOR + DENOMINATOR
    order = [F.col("group"), F.col("weight"), F.col("set_id")]
    numbered = number_rows(members, order, "number").withColumn("block", F.call_function("div", F.col("number"), F.lit(BLOCK_SETS)))
    numbered = written(numbered.drop("number"), "members")
    sizes = numbered.groupBy("group", "block").agg(F.min("weight").alias("least"), F.max("most").alias("most"), F.max("reference").alias("reference"))
    sizes = written(sizes, "blocks")
    other = sizes.select("group", F.col("block").alias("other"), F.col("least").alias("least_"), F.col("most").alias("most_"))
    pairs = sizes.join(other, "group").where((F.col("least") + F.col("least_")) <= F.col("reference") + over * F.least("most", "most_"))
    met = numbered.join(pairs.select("group", "block", "other"), ["group", "block"])
    met = met.select(*numbered.columns, F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"))

    def meet(table: pa.Table) -> pa.Table:
        table = table.sort_by([("group", "ascending"), ("block", "ascending")])
        group, block = table.column("group").to_numpy(), table.column("block").to_numpy()
        own = table.column("left")[0].as_py(), table.column("right")[0].as_py()
        weight, rows = table.column("weight").to_numpy(), table.column("copies").to_numpy()
        reference, differs = table.column("reference").to_numpy(), table.column("differs").to_pylist()
        partners, forest = np.zeros(len(group), np.int64), Forest(len(group))
        starts = np.flatnonzero(np.diff(group, prepend=group[:1] ^ 1))
        for low, high in zip(starts, [*starts[1:], len(group)]):
            cut = low + int((block[low:high] == own[0]).sum())
            i, j = (np.arange(low, high),) * 2 if own[0] == own[1] else (np.arange(low, cut), np.arange(cut, high))
            if not len(i) or not len(j):
                continue
            room = reference[low] - weight[i][:, None] - weight[j]
            if room.min() >= 0:  # sizes alone prove all links
                on = np.ones(room.shape, bool)
            else:
                x, y = ([np.frombuffer(differs[k], np.uint64) for k in side] for side in (i, j))
                on = room + over * common(x, y) >= 0
            if own[0] == own[1]:
                np.fill_diagonal(on, False)
                partners[i] += on @ rows[i]
            else:
                partners[i] += on @ rows[j]
                partners[j] += rows[i] @ on
            forest.join_all(on, i, j)
        some = np.flatnonzero(partners)
        node = lambda t: pa.StructArray.from_arrays([t.column(c).combine_chunks() for c in ("no_id", "id", "set_id")], ["no_id", "id", "set_id"])
        own_rows, to = table.take(pa.array(some)), table.take(pa.array(forest.label[some]))
        return pa.table({"set_id": own_rows.column("set_id"), "node": node(own_rows), "partners": pa.array(partners[some]), "reached": node(to)})

    return met.groupBy("left", "right").applyInArrow(meet, f"set_id bigint, node {NODE}, partners bigint, reached {NODE}")


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links, set_class, k1, k2) for each row of ``docs`` (doc_id, text);
    other columns ignored.

    component_id is the smallest doc_id that links reach from the row, its own included. n_links is the
    number of other rows that the row links with: copies of its set, and the rows of every other set that
    links with it. Texts without words (null, empty, white space) have no set and link with nothing: their
    component_id is their own doc_id. Rows with equal sets link whatever their ids; a null doc_id links but
    is never the smallest, so it is the component_id only where no other is reached. Rows of one id with
    different texts are judged by their own texts. set_class is one number for each class, null without a
    set; k1 and k2 stand for id and text of the row. An empty table gives no rows.
    """
    spark = docs.sparkSession
    keyed = written(docs.transform(with_sets), "sets")
    total = keyed.agg(F.sum("n_shingles")).first()[0] or 0
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * total // (2 * BLOCK_BYTES))
    able = written(survivors(docs, blocks), "survivors")
    sets = candidate_sets(docs, membership(able))
    stored = written(index(written(sets, "candidates"), blocks), "index")
    lists = stored.select("set_id", "n", "rare", F.posexplode("listed").alias("at", "hash"))
    lists = lists.select("set_id", "n", (F.col("rare") + F.col("at")).alias("pos"), "hash")
    lists = written(lists, "lists")
    copies = keyed.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"))
    copies = written(copies, "copies")
    near, groups = None, None
    for turn in range(HUB_ROUNDS):
        found = written(linked(hub_pairs(with_labels(lists, groups), turn), stored, NEAR), "near")
        near = found if near is None else near.unionByName(found)
        groups = written(components(near), "groups")
    within = written(links_within(written(differences(stored, groups, copies), "differences")), "within")
    pairs = written(linked(cross_pairs(with_labels(lists, groups)), stored), "links")
    sides = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    node = F.struct(F.col("id").isNull().alias("no_id"), "id", "set_id")
    named = copies.select("set_id", "copies", node.alias("node"))
    across = sides.join(named.select(F.col("set_id").alias("b"), F.col("copies").alias("partners"), F.col("node").alias("reached")), "b")
    across = across.join(named.select(F.col("set_id").alias("a"), "node"), "a").select(F.col("a").alias("set_id"), "node", "partners", "reached")
    links = written(within.unionByName(across), "all-links")
    # The number of a set in the graph begins with its lowest doc_id, so the lowest number of a class does too.
    labels = components(links.select(F.col("node").alias("a"), F.col("reached").alias("b"))).select(F.col("node.set_id").alias("set_id"), "label")
    partners = links.groupBy("set_id").agg(F.sum("partners").alias("partners"))
    of_set = copies.join(partners, "set_id", "left").join(labels, "set_id", "left").select(
        "set_id", (F.col("copies") - 1 + F.coalesce("partners", F.lit(0))).alias("n_links"),
        F.when(F.col("label").isNull(), F.col("id")).otherwise(F.col("label.id")).alias("component_id"),
        F.coalesce("label.set_id", "set_id").alias("set_class"))
    of_set = written(of_set, "named")  # a plain join of two tables can be split where a set has very many copies
    return keyed.join(of_set, "set_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "set_class", "k1", "k2")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each class, that of the lowest doc_id (null last), all columns kept. Rows
    without words are classes by themselves; rows equal in id and text count as one row."""
    rows = classes(docs)
    first = F.min_by(F.struct("k1", "k2"), F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2")).alias("first")
    kept = rows.where("set_class is not null").groupBy("set_class").agg(first).select("first.*")
    kept = kept.unionByName(rows.where("set_class is null").select("k1", "k2").distinct())
    names = docs.columns
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), *row_keys()).join(kept, ["k1", "k2"], "left_semi")
    order = F.xxhash64(*(F.to_json(F.struct(F.col(f"row.`{c}`"))) for c in names))
    return keyed.groupBy("k1", "k2").agg(F.min_by("row", order).alias("row")).select("row.*")


def with_labels(lists: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return lists.withColumn("label", F.col("set_id"))
    named = labels.select(F.col("node").alias("set_id"), "label")
    return lists.join(named, "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))


def hub_pairs(lists: DataFrame, turn: int) -> DataFrame:
    """(a, b): each set with the hub of another class that it meets in most of its index lists. A list's
    hub is the set of the lowest hash; each round hashes anew."""
    hub = F.min(F.struct(F.xxhash64("set_id", F.lit(turn)).alias("order"), "set_id", "n", "pos", "label")).alias("hub")
    hubs = lists.groupBy("hash").agg(hub, F.count("*").alias("sets")).where("sets > 1").select(
        "hash", F.col("hub.set_id").alias("b"), F.col("hub.n").alias("m"), F.col("hub.pos").alias("q"), F.col("hub.label").alias("hub_label"))
    met = lists.join(hubs, "hash").where("label <> hub_label").where(_can_link("n", "pos", "m", "q"))
    counted = met.groupBy("set_id", "b").agg(F.count("*").alias("times"))
    best = counted.groupBy("set_id").agg(F.max(F.struct("times", "b")).alias("best"))
    return best.select(F.col("set_id").alias("a"), "best.b")


def cross_pairs(lists: DataFrame) -> DataFrame:
    """(a, b): all pairs of sets of different classes that index lists do not rule out. The smaller set's
    entry lies in the first block of positions."""
    over = NUMERATOR + DENOMINATOR
    small = lists.where(f"{over} * (n - pos) >= {2 * NUMERATOR} * n").select("hash", F.col("set_id").alias("a"), "n", "pos", F.col("label").alias("label_a"))
    large = lists.select("hash", F.col("set_id").alias("b"), F.col("n").alias("m"), F.col("pos").alias("q"), F.col("label").alias("label_b"))
    met = small.join(large, "hash").where("label_a <> label_b AND (n < m OR n = m AND a < b)").where(_can_link("n", "pos", "m", "q"))
    return met.select("a", "b").distinct()
