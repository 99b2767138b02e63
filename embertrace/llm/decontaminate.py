"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

A mask keeps some of a window's word positions and ignores the others. Every window of a benchmark item
and of a document is hashed under each mask; equal hashes are hits, also where a word at an ignored
position was replaced. A hit fixes an alignment of item and document. Where enough words agree for a
leak, the masks hit a known number of times at least, so alignments with fewer hits are left out; along
the others the words that agree are counted, and an item of which a large enough share agrees has leaked.
"""

from __future__ import annotations

import math
from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# (masks, window, most): 1 keeps a position, 0 ignores it. Each word beyond ``most`` that agrees within
# ``window`` words makes another hit of the masks, wherever in the window the agreeing words are. An item
# uses the first family that must hit it, so only items of very few words use the lighter ones.
FAMILIES = ((("111", "1101", "1011"), 4, 2), (("11", "101"), 3, 1), (("1",), 1, 0))
SHARE = 0.6  # of an item's words that must agree along one alignment
LEAST_AGREEING = 7  # words that must agree before a document is removed: shorter items occur by chance
NOT_WORD = r"[^\p{L}\p{N}]+"
MOST_BROADCAST_ROWS = 200_000  # of 24 bytes; beyond this the hashes are joined by shuffle


def words(text: Column) -> Column:
    """Lower-case letter and digit runs, in order."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")


def demands(item_words: int, share: float, least_agreeing: int = 1) -> tuple[tuple[str, ...], int]:
    """The masks for an item, and how often they hit it at least along an alignment where ``share`` of its
    words and ``least_agreeing`` agree: the item is cut into windows, whose agreeing words beyond ``most``
    are hits."""
    least = max(least_agreeing, math.ceil(Fraction(str(share)) * item_words))
    for masks, window, most in FAMILIES:
        hits = least - most * (item_words // window) - min(item_words % window, most)
        if hits > 0:
            break
    return masks, hits


def seeds(text: Column, masks: tuple[str, ...]) -> Column:
    """Array of a text's window hashes: entry k is mask k % len(masks) at word k div len(masks); null
    where the mask reaches beyond the text."""
    count = len(masks)

    def under(hashes: Column, k: int, at: Column) -> Column:
        kept = [F.get(hashes, at + off) for off, bit in enumerate(masks[k]) if bit == "1"]
        fits = at + len(masks[k]) <= F.size(hashes)
        return F.when(fits, F.xxhash64(F.lit(k), *kept))

    def all_windows(hashes: Column) -> Column:
        def one(n: Column) -> Column:
            at = F.call_function("div", n, F.lit(count)).cast("int")
            return reduce(lambda rest, k: F.when(n % count == k, under(hashes, k, at)).otherwise(rest), range(count), F.lit(None).cast("bigint"))

        return F.transform(F.sequence(F.lit(0), F.size(hashes) * count - 1), one)

    # The inner array is bound as a lambda's argument, so that it is made once per text.
    empty = F.array().cast("array<bigint>")
    hashed = F.transform(words(text), lambda w: F.xxhash64(w))
    return F.get(F.transform(F.array(hashed), lambda h: F.when(F.size(h) > 0, all_windows(h)).otherwise(empty)), F.lit(0))


def windows(df: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    """``df`` (id, text) as rows (id, at, mask, seed), one per window that fits; ``mask`` is a number."""
    rows = df.select("id", F.posexplode(seeds(F.col("text"), masks)).alias("n", "seed")).where("seed is not null")
    count = F.lit(len(masks))
    return rows.select("id", F.call_function("div", F.col("n"), count).cast("int").alias("at"), (F.col("n") % count).alias("mask"), "seed")


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, least_agreeing: int = 1) -> DataFrame:
    """(doc_id, version, item_id, agreeing, item_words, share, start): each document with each benchmark
    item that it holds, at the alignment where most words agree; ``start`` is the document's word where
    the item begins (below 0: its beginning is cut off).

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; other columns are ignored. Whole texts
    are searched, and no alignment where ``share`` of an item's words agree is missed, whichever words
    were replaced. Only alignments where ``least_agreeing`` words agree count, so items of fewer words are
    not looked for. Null and empty texts hold nothing and leak nowhere. Repeated rows give one row per
    item; rows of one id with other texts are told apart by ``version``, the text's hash.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    documents = docs.select(F.struct("doc_id", F.xxhash64(text).alias("version")).alias("id"), text.alias("text"))
    items = benchmark.select(F.struct("item_id", F.xxhash64(text).alias("version")).alias("id"), text.alias("text")).where(F.size(words(F.col("text"))) >= least_agreeing).distinct()
    # One row per length of an item.
    lengths = [r[0] for r in items.select(F.size(words(F.col("text"))).alias("n")).distinct().collect()]
    by_length = {n: demands(n, share, least_agreeing) for n in lengths}
    masks = tuple(m for family, _, _ in FAMILIES if any(used == family for used, _ in by_length.values()) for m in family)
    of_length = items.sparkSession.createDataFrame(
        [(n, hits, [masks.index(m) for m in used]) for n, (used, hits) in by_length.items()], "item_words int, least_hits int, masks array<int>")
    sized = items.select(F.col("id").alias("item"), words(F.col("text")).alias("of_item")).withColumn("item_words", F.size("of_item"))
    sized = sized.join(F.broadcast(of_length), "item_words")
    if not masks:
        masks = FAMILIES[0][0]
    item_seeds = windows(items, masks).select(F.col("id").alias("item"), F.col("at").alias("item_at"), "mask", "seed")
    item_seeds = item_seeds.join(sized.select("item", "masks"), "item").where(F.array_contains("masks", F.col("mask"))).select("item", "item_at", "seed")
    if item_seeds.count() <= MOST_BROADCAST_ROWS:
        item_seeds = F.broadcast(item_seeds)
    hits = windows(documents, masks).join(item_seeds, "seed").groupBy("id", "item", (F.col("at") - F.col("item_at")).alias("start")).agg(F.count("*").alias("hits"))
    aligned = hits.join(sized.select("item", "of_item", "least_hits"), "item").where("hits >= least_hits")
    aligned = aligned.join(documents, "id")  # repeated rows meet again in the grouping below
    agree = F.get(
        F.transform(F.array(words(F.col("text"))), lambda w: F.aggregate(
            F.sequence(F.lit(0), F.size("of_item") - 1), F.lit(0),
            lambda n, i: n + F.when(F.get(w, F.col("start") + i) == F.get(F.col("of_item"), i), 1).otherwise(0))), F.lit(0))
    counted = aligned.select("id", "item", "start", F.size("of_item").alias("item_words"), agree.alias("agreeing"))
    best = counted.where((F.col("agreeing") >= share * F.col("item_words")) & (F.col("agreeing") >= least_agreeing)).groupBy("id", "item").agg(
        F.max(F.struct("agreeing", -F.col("start"))).alias("best"), F.max("item_words").alias("item_words"))
    return best.select(
        "id.doc_id", "id.version", "item.item_id", F.col("best.agreeing").cast("bigint").alias("agreeing"), F.col("item_words").cast("bigint").alias("item_words"),
        (F.col("best.agreeing") / F.col("item_words")).alias("share"), (-F.col("best.col2")).cast("bigint").alias("start")).groupBy("doc_id", "version", "item_id").agg(
        *(F.max_by(c, F.struct("share", "agreeing", "item_words", "start")).alias(c) for c in ("agreeing", "item_words", "share", "start")))


def without_leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, least_agreeing: int = LEAST_AGREEING) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item of which ``share`` and ``least_agreeing`` words agree;
    all columns kept. ``leaks`` reports shorter items as well, but a row is not removed for them."""
    found = leaks(docs, benchmark, share, least_agreeing).select(F.col("doc_id").alias("_leak_id"), F.col("version").alias("_leak_version")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_leak_id")) & (F.xxhash64(F.coalesce(F.col("text"), F.lit(""))) == F.col("_leak_version"))
    return docs.join(found, same, "left_anti")
