"""Scoring of texts by prediction by partial matching over bytes.

A model is the trie of all byte contexts of length 0 to 5 seen in the training texts, with the counts of
the bytes that follow. A byte is predicted in its longest seen context; if the context has not seen it, an
escape (estimated from the number of different bytes seen there: each leaves half an occurrence) passes on to the context shortened by a
byte, where the bytes that the longer context would have predicted are excluded. The negative code lengths
of a text's bytes add up to the logarithm of its probability. A text is its lower-cased words with single
spaces, closed by a line feed, which is also the byte before its first.

Beside it stands a unigram score over words. Both gather their counts from all training texts by Spark.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embertrace.llm.common import slices, texts_of, written
from embertrace.llm.shingles import mix, word_hashes

ORDER = 5
SYMBOLS = 256
END = b"\n"
BLOCK_NODES = 2_000_000  # trie leaves that a task holds at once; a larger trie is scored block by block
HELD_KEYS = 2_000_000  # distinct contexts that a counting task holds before it passes them on
SMOOTHING = 0.1
WORD_BLOCK_BYTES = 16 << 20  # training text for each block of word hashes
HALF = 0.5  # of one occurrence of each different byte of a context goes to its escape
TEXT_ROWS = 200


def byte_rows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(key of each byte of the texts: its five predecessors and itself, end of each text)."""
    parts = [END * ORDER + b" ".join(t.encode("utf-8", "surrogatepass").lower().split()) + END for t in texts]
    data = np.frombuffer(b"".join(parts), np.uint8)
    size = len(data) - ORDER
    keys = np.zeros(max(size, 0), np.uint64)
    for k in range(ORDER + 1):
        keys = (keys << np.uint64(8)) | data[k : k + size]
    lengths = np.array([len(p) for p in parts], np.int64)
    starts = np.cumsum(lengths) - lengths
    real = np.ones(max(size, 0), bool)
    for k in range(ORDER):  # keys whose last byte is another text's padding
        real[starts[1:] - ORDER + k] = False
    return keys[real], np.cumsum(lengths - ORDER)


def block_of(keys: np.ndarray, blocks: int) -> np.ndarray:
    """Contexts of two bytes or more that end alike share a block, so an escape never leaves it."""
    return (mix((keys >> np.uint64(8)) & np.uint64(0xFFFF)) % np.uint64(blocks)).astype(np.int64)


class Lookup:
    """Places of distinct 64-bit keys, by open addressing."""

    def __init__(self, keys: np.ndarray):
        self.bits = np.uint64(64 - max(4, int(2 * len(keys)).bit_length()))
        size = 1 << (64 - int(self.bits))
        self.keys, self.places = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        left, slot = np.arange(len(keys)), self._slots(keys)
        while len(left):
            free = self.places[slot] < 0
            self.places[slot[free]] = left[free]  # of several, the last stays
            won = self.places[slot] == left
            self.keys[slot[won]] = keys[left[won]]
            left, slot = left[~won], (slot[~won] + 1) & (size - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.bits).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 for unknown ones."""
        slot = self._slots(keys)
        out = self.places[slot]
        todo = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)
            at = slot[todo]
            out[todo] = self.places[at]
            todo = todo[(out[todo] >= 0) & (self.keys[at] != keys[todo])]
        return out


def sums_by(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, sum of the values of each)."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[:1] ^ np.uint64(1)))
    return keys[first], np.add.reduceat(values[order], first)


class Trie:
    """A block of the trie: ``leaves`` are keys of the longest contexts with their counts, ``short`` keys of
    contexts of one byte with counts over the whole corpus."""

    def __init__(self, leaves: np.ndarray, counts: np.ndarray, short: np.ndarray, short_counts: np.ndarray):
        self.nodes, self.count, self.first = [], [], []  # by order: keys' places, counts, log10 p if nothing was excluded
        self.contexts, self.start_escape, self.total, self.escape = [], [], [], []
        below = None
        for k in range(ORDER + 1):
            mask = np.uint64((1 << (8 * (k + 1))) - 1)
            keys, c = sums_by(leaves & mask, counts) if k > 1 else sums_by(short & mask, short_counts)
            contexts = keys >> np.uint64(8)
            first = np.flatnonzero(np.diff(contexts, prepend=contexts[:1] ^ np.uint64(1))) if len(keys) else np.zeros(0, np.int64)
            size = np.diff(first, append=len(keys))
            n = np.add.reduceat(c, first) if len(first) else c[:0]
            whole = n.astype(float)
            self.nodes.append(Lookup(keys))
            self.count.append(np.log10(c - HALF))
            self.first.append(np.log10((c - HALF) / np.repeat(whole, size)))
            self.contexts.append(Lookup(contexts[first]))
            self.start_escape.append(np.log10(HALF * size / whole))
            if below is None:  # behind the empty context: every byte not yet excluded alike
                left = SYMBOLS - size
                self.total.append(np.log10(np.maximum(left, 1)))
                self.escape.append(np.zeros(len(size)))
            else:
                keys_b, c_b, contexts_b, n_b, size_b = below
                shorter = np.uint64((1 << (8 * (k - 1))) - 1)
                at = np.searchsorted(contexts_b, contexts[first] & shorter)
                seen = c_b[np.searchsorted(keys_b, keys & np.uint64((1 << (8 * k)) - 1))]
                fresh = n_b[at] - np.add.reduceat(seen, first) if len(first) else n[:0]
                new = size_b[at] - size
                total = fresh
                self.total.append(np.log10(np.maximum(total, 1)))
                self.escape.append(np.where(total > 0, np.log10(HALF * np.maximum(new, 1)) - np.log10(np.maximum(total, 1)), 0.0))
            below = keys, c, contexts[first], n, size

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 of the probability of each key's last byte after its five predecessors."""
        out = np.zeros(len(keys))
        rest = np.arange(len(keys))
        began = np.zeros(len(keys), bool)  # whether some context has been left by an escape
        total, escape = np.zeros(len(keys)), np.zeros(len(keys))
        for k in range(ORDER, -1, -1):
            now = keys[rest] & np.uint64((1 << (8 * (k + 1))) - 1)
            place = self.nodes[k].find(now)
            hit = place >= 0
            at, p = rest[hit], place[hit]
            out[at] += np.where(began[at], self.count[k][p] - total[at], self.first[k][p])
            rest, now = rest[~hit], now[~hit]
            if not len(rest):
                break
            place = self.contexts[k].find(now >> np.uint64(8))
            known = place >= 0
            at, p = rest[known], place[known]
            out[at] += np.where(began[at], escape[at], self.start_escape[k][p])
            began[at] = True
            total[at], escape[at] = self.total[k][p], self.escape[k][p]
        out[rest] -= np.where(began[rest], total[rest], np.log10(SYMBOLS))
        return out


def context_counts(texts: DataFrame) -> DataFrame:
    """(key, n) of the longest contexts with the byte behind them, over all ``texts`` (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["key", "n"])

        for part in slices(batches, TEXT_ROWS * 2):
            new = np.sort(byte_rows(texts_of(part))[0])
            first = np.flatnonzero(np.diff(new, prepend=new[:1] ^ np.uint64(1)))
            keys, counts = sums_by(np.concatenate([keys, new[first]]), np.concatenate([counts, np.diff(first, append=len(new))]))
            if len(keys) > HELD_KEYS:
                yield rows()
                keys, counts = keys[:0], counts[:0]
        yield rows()

    return texts.select("text").mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def _arrays(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts, as Arrow columns all the way to the driver."""
    table = counts.select("key", "n").toArrow()
    return table.column("key").to_numpy().astype(np.int64).view(np.uint64), table.column("n").to_numpy().astype(np.int64)


_TRIES: dict[str, Trie] = {}


def trie_scores(docs: DataFrame, counts: DataFrame, block_nodes: int = BLOCK_NODES) -> DataFrame:
    """(doc_id, key, n_tokens, copies, score) for each distinct row of ``docs`` (doc_id, key, text): log10
    of the text's probability under the trie of ``counts``.

    The trie goes to the tasks in blocks of about ``block_nodes`` leaves; each block scores the bytes whose
    contexts it holds, in a pass of its own, and the passes are added up.
    """
    spark = docs.sparkSession
    blocks = max(1, -(-counts.count() // block_nodes))
    # At most 65,536 rows: contexts of one byte.
    ones = counts.groupBy(F.col("key").bitwiseAND(0xFFFF).alias("key")).agg(F.sum("n").alias("n"))
    short = spark.sparkContext.broadcast(_arrays(ones))
    ending = F.shiftright("key", 8).bitwiseAND(0xFFFF)
    passes = []
    for block in range(blocks):
        mine = counts
        if blocks > 1:
            wanted = [int(s) for s in np.flatnonzero(block_of(np.arange(1 << 16, dtype=np.uint64) << np.uint64(8), blocks) == block)]
            mine = counts.join(F.broadcast(spark.createDataFrame([(s,) for s in wanted], "ending bigint")), ending == F.col("ending")).select("key", "n")
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, *_arrays(mine)))
        passes.append(docs.mapInArrow(_scorer(shared, short, block, blocks), "doc_id bigint, key bigint, block int, n_tokens bigint, score double"))
    rows = passes[0]
    for more in passes[1:]:
        rows = rows.unionByName(more)
    once = rows.groupBy("doc_id", "key", "block").agg(F.first("n_tokens").alias("n_tokens"), F.first("score").alias("score"), F.count("*").alias("copies"))
    return once.groupBy("doc_id", "key").agg(F.first("n_tokens").alias("n_tokens"), F.first("copies").alias("copies"), F.sum("score").alias("score"))


def _scorer(shared, short, block: int, blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, leaves, counts = shared.value
        if name not in _TRIES:
            _TRIES.clear()
            _TRIES[name] = Trie(leaves, counts, *short.value)
        trie = _TRIES[name]
        for part in slices(batches, TEXT_ROWS):
            texts = texts_of(part)
            keys, ends = byte_rows(texts)
            if blocks > 1:
                mine = block_of(keys, blocks) == block
                ends = np.cumsum(mine)[ends - 1]
                keys = keys[mine]
            sums = np.concatenate([[0.0], np.cumsum(trie.log10(keys))])
            words = [len(t.encode("utf-8", "surrogatepass").split()) + 1 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(np.full(len(texts), block, np.int32)), pa.array(words, pa.int64()),
                 pa.array(np.diff(sums[ends], prepend=0.0))], ["doc_id", "key", "block", "n_tokens", "score"])

    return run


def word_scores(docs: DataFrame, blocks: int) -> DataFrame:
    """(key, known, logs) for each distinct row of ``docs`` (key, trains, text): its words that training
    rows have, and the sum over its words of log10(count + 0.1). One more row, of null key, holds the number
    of training words and of different ones.

    Words travel as hashes, one row for a block of hash values of a slice of texts; their counts are taken
    where the block is, and a text's shares come back by its key.
    """
    schema = "block bigint, head binary, body binary"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2000):
            hashes, counts = word_hashes(texts_of(part))
            of = np.repeat(np.arange(part.num_rows), counts)
            order = np.lexsort((hashes, of))
            hashes, of = hashes[order], of[order]
            new = np.flatnonzero((np.diff(hashes, prepend=np.uint64(0)) != 0) | (np.diff(of, prepend=-1) != 0))
            times = np.minimum(np.diff(new, append=len(of)), np.iinfo(np.uint32).max)
            hashes, of = hashes[new], of[new]
            keys = part.column(0).to_numpy(zero_copy_only=False)
            trains = part.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            block = ((hashes >> np.uint64(20)) % np.uint64(blocks)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            cuts = np.searchsorted(block[order], np.arange(blocks + 1))
            rows, heads, bodies = [], [], []
            for b in range(blocks):
                chosen = order[cuts[b] : cuts[b + 1]]
                if len(chosen):
                    owners, n = np.unique(of[chosen], return_counts=True)
                    rows.append(b)
                    heads.append(np.stack([keys[owners], trains[owners], n]).astype("<i8").tobytes())
                    bodies.append(hashes[chosen].tobytes() + times[chosen].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(heads, pa.binary()), pa.array(bodies, pa.binary())], ["block", "head", "body"])

    def count(table: pa.Table) -> pa.Table:
        heads = [np.frombuffer(h, "<i8").reshape(3, -1) for h in table.column("head").to_pylist()]
        bodies = table.column("body").to_pylist()
        hashes = np.concatenate([np.frombuffer(b, np.uint64, len(b) // 12) for b in bodies])
        times = np.concatenate([np.frombuffer(b, "<u4", len(b) // 12, len(b) // 12 * 8) for b in bodies]).astype(np.int64)
        head = np.concatenate(heads, axis=1)
        owner = np.repeat(np.arange(head.shape[1]), head[2])
        order = np.argsort(hashes)
        hashes, times, owner = hashes[order], times[order], owner[order]
        first = np.flatnonzero(np.diff(hashes, prepend=hashes[:1] ^ np.uint64(1)))
        c = np.add.reduceat(times * head[1][owner], first)
        each = np.repeat(c, np.diff(first, append=len(hashes)))
        logs = np.bincount(owner, weights=times * np.log10(each + SMOOTHING), minlength=head.shape[1])
        known = np.bincount(owner, weights=times * (each > 0), minlength=head.shape[1]).astype(np.int64)
        # a row that occurs twice gives its shares twice; the caller divides by the number of copies
        to = (mix(head[0].view(np.uint64)) % np.uint64(blocks)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        cuts = np.searchsorted(to[order], np.arange(blocks + 1))
        some = [b for b in range(blocks) if cuts[b] < cuts[b + 1]]
        out = [np.stack([head[0], known, logs.view(np.int64)])[:, order[cuts[b] : cuts[b + 1]]].astype("<i8").tobytes() for b in some]
        totals = np.array([[0], [int(c.sum())], [int((c > 0).sum())]], "<i8").tobytes()
        return pa.table({"block": pa.array([*some, -1], pa.int64()), "body": pa.array([*out, totals], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        rows = np.concatenate([np.frombuffer(b, "<i8").reshape(3, -1) for b in table.column("body").to_pylist()], axis=1)
        if table.column("block")[0].as_py() < 0:
            return pa.table({"key": pa.array([None], pa.int64()), "known": pa.array([rows[1].sum()]), "logs": pa.array([float(rows[2].sum())])})
        keys, back = np.unique(rows[0], return_inverse=True)
        logs = np.bincount(back, weights=np.ascontiguousarray(rows[2]).view(np.float64), minlength=len(keys))
        known = np.bincount(back, weights=rows[1], minlength=len(keys)).astype(np.int64)
        return pa.table({"key": pa.array(keys), "known": pa.array(known), "logs": pa.array(logs)})

    counted = docs.select("key", "trains", "text").mapInArrow(deal, schema).groupBy("block").applyInArrow(count, "block bigint, body binary")
    return counted.groupBy("block").applyInArrow(add, "key bigint, known bigint, logs double")


def scores(docs: DataFrame, trains: Column, block_nodes: int = BLOCK_NODES) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs`` (doc_id, text),
    whole texts; other columns ignored. ``trains`` says which rows the counts are taken from.

    ``score`` is the trie model's, ``base_score`` the unigram model's log10 probability; tokens are words and
    one end. A null text is empty: its only token is the end. Rows equal in id and text are scored alike and
    each kept. Without training rows the trie gives every byte 1/256. An empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", F.xxhash64("doc_id", text).alias("key"), F.coalesce(trains, F.lit(False)).alias("trains"), text.alias("text"))
    counts = written(context_counts(keyed.where("trains")), "contexts")
    by_trie = trie_scores(keyed.select("doc_id", "key", "text"), counts, block_nodes)
    size = counts.agg(F.sum("n")).first()[0] or 0  # bytes of training text
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // WORD_BLOCK_BYTES)
    by_word = written(word_scores(keyed, blocks), "words")
    ends = keyed.where("trains").count()
    total = by_word.where("key is null").first()
    n, kinds = (total["known"], total["logs"]) if total else (0, 0.0)
    n, kinds = n + ends, kinds + (ends > 0)
    each = float(np.log10(n + SMOOTHING * (kinds + 1)))
    end = float(np.log10(ends + SMOOTHING))
    shares = by_word.where("key is not null").withColumnRenamed("key", "of")
    joined = by_trie.join(shares, F.col("key") == F.col("of"), "left").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return joined.select(
        "doc_id", "n_tokens",
        (F.coalesce((F.col("known") / F.col("copies")).cast("bigint"), F.lit(0)) + int(ends > 0)).alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        (F.coalesce(F.col("logs") / F.col("copies"), F.lit(0.0)) + end - F.col("n_tokens") * each).alias("base_score"), "score")
