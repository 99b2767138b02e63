"""Prefix trie of conversations by the Euler-tour technique.

A node is a distinct sequence of first turns. Every node has two arcs, one that enters it from its parent
and one that leaves it; each arc knows the next one of a tour through the whole trie, so all arcs are one
linked list. The list is ranked distributedly: some arcs are rulers, every arc jumps over arcs that are not
until it meets the next ruler, the list of rulers is ranked in the same way, and adding up gives each arc's
position and the sums of leaves and of savings from it to the end of the tour. A node's subtree lies between
its two arcs, so what it holds is the difference of their sums.

Turns travel as two hashes of role and text; texts are read once and shuffled nowhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from embertrace.llm.common import written

GROUP, PREFIXES = 5, 9  # conversation c takes the first crc32(c) % PREFIXES turns of conversation c - c % GROUP
SIBLINGS = 128  # about so many children of a node are linked to each other in one group
RULER_GAP = 64  # one of so many arcs is a ruler
RANKED_DIRECTLY = 8192  # rulers that the driver ranks; more are ranked like arcs
LEAVE = (0x5DEECE66D1B56C3A, 0x2545F4914F6CDD1D)  # tells a node's leaving arc from its entering arc
NO_TURNS = hashlib.sha256(b"").hexdigest()
VALUES = ("pos", "leaves", "saved")


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, h1, h2, bytes): turns of conversations that have an id, numbered by turn (null first),
    turns of one number in order of their hashes."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    hashed = turns.where("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.xxhash64(F.lit(1), role, text).alias("h1"), F.xxhash64(role, text, F.lit(2)).alias("h2"),
        F.octet_length(text).cast("bigint").alias("bytes"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "h1", "h2")
    return hashed.select("conv_id", F.row_number().over(order).alias("pos"), "h1", "h2", "bytes")


def rebuilt(own: DataFrame, convs: DataFrame) -> DataFrame:
    """Turns (conv_id, place, h1, h2, bytes) of the rebuilt conversations ``convs`` (conv_id, first, base):
    the first ``first`` turns of ``base``, then the conversation's own turns after its first ``first``."""
    base = own.where(F.col("pos") < PREFIXES).withColumnRenamed("conv_id", "base")
    taken = convs.join(base, "base").where("pos <= first").select("conv_id", F.struct(F.lit(0).alias("own"), "pos").alias("place"), "h1", "h2", "bytes")
    rest = own.join(convs, "conv_id").where("pos > first").select("conv_id", F.struct(F.lit(1).alias("own"), "pos").alias("place"), "h1", "h2", "bytes")
    return taken.unionByName(rest)


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, n, x1, x2, p1, p2, bytes): each turn of ``turns`` (conv_id, place, h1, h2, bytes)
    with the hash of the turns up to it and before it. A turn's depth enters its hash, so the exclusive or
    keeps the order."""
    order = Window.partitionBy("conv_id").orderBy("place")
    until = order.rowsBetween(Window.unboundedPreceding, 0)
    placed = turns.select("conv_id", "place", F.row_number().over(order).alias("depth"), F.count("*").over(Window.partitionBy("conv_id")).alias("n"), "h1", "h2", "bytes")
    mixed = placed.withColumns({"m1": F.xxhash64("depth", "h1"), "m2": F.xxhash64("h2", "depth")})
    x = mixed.withColumns({"x1": F.bit_xor("m1").over(until), "x2": F.bit_xor("m2").over(until)})
    return x.select("conv_id", "depth", "n", "x1", "x2", F.col("x1").bitwiseXOR(F.col("m1")).alias("p1"), F.col("x2").bitwiseXOR(F.col("m2")).alias("p2"), "bytes")


def digests(ends: DataFrame) -> DataFrame:
    """(x1, x2, ends_sha256) of the conversations (conv_id) that end in a node (x1, x2).

    Ids are range-sorted by node and id, so a node of very many is spread over tasks, and joined into pieces;
    the task that has a node's pieces feeds them to its digest one after the other and holds none.
    """

    def runs(part: pa.RecordBatch) -> Iterator[tuple[int, int, list]]:
        x1, x2, last = (c.to_pylist() for c in part.columns[:3])
        start = 0
        for i in range(1, len(x1) + 1):
            if i == len(x1) or x1[i] != x1[start] or x2[i] != x2[start]:
                yield x1[start], x2[start], last[start:i]
                start = i

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            rows = [(a, b, ids[0], ",".join(map(str, ids))) for a, b, ids in runs(part)]
            columns = list(zip(*rows)) or [[]] * 4
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["x1", "x2", "first", "piece"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sha = None, None
        for part in batches:
            done = []
            x1, x2, _, texts = (c.to_pylist() for c in part.columns)
            for node, piece in zip(zip(x1, x2), texts):
                if node == at:
                    sha.update(b"," + piece.encode())
                else:
                    if at is not None:
                        done.append((*at, sha.hexdigest()))
                    at, sha = node, hashlib.sha256(piece.encode())
            columns = list(zip(*done)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((*at, sha.hexdigest()), kinds)], names)

    names, kinds = ["x1", "x2", "ends_sha256"], [pa.int64(), pa.int64(), pa.string()]
    ids = ends.select("x1", "x2", F.col("conv_id").cast("bigint"))
    sorted_ids = ids.repartitionByRange("x1", "x2", "conv_id").sortWithinPartitions("x1", "x2", "conv_id")
    cut = written(sorted_ids.mapInArrow(pieces, "x1 bigint, x2 bigint, first bigint, piece string"), "pieces")
    return cut.repartition("x1", "x2").sortWithinPartitions("x1", "x2", "first").mapInArrow(digest, "x1 bigint, x2 bigint, ends_sha256 string")


def leaving(one: str, two: str) -> list[Column]:
    """Both halves of the key of the arc that leaves a node."""
    return [F.col(c).bitwiseXOR(F.lit(mark)) for c, mark in zip((one, two), LEAVE)]


def siblings(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((x1, x2, p1, p2, n1, n2): each child with its next sibling, null for the last; (p1, p2, f1, f2): each
    parent with its first child). Children of a node are linked within buckets, then bucket to bucket, so a
    node of very many children is ordered nowhere as a whole."""
    kids = nodes.where("depth > 0")
    buckets = max(1, kids.count() // SIBLINGS)
    bucketed = kids.select("x1", "x2", "p1", "p2", F.pmod(F.xxhash64("x1", "x2"), F.lit(buckets)).alias("bucket"))
    inside = Window.partitionBy("p1", "p2", "bucket").orderBy("x1", "x2")
    linked = written(bucketed.select("*", F.row_number().over(inside).alias("r"), F.lead("x1").over(inside).alias("n1"), F.lead("x2").over(inside).alias("n2")), "siblings")
    across = Window.partitionBy("p1", "p2").orderBy("bucket")
    starts = linked.where("r = 1").select(
        "p1", "p2", "bucket", F.col("x1").alias("f1"), F.col("x2").alias("f2"), F.row_number().over(across).alias("b"),
        F.lead("x1").over(across).alias("m1"), F.lead("x2").over(across).alias("m2"))
    starts = written(starts, "buckets")
    joined = linked.join(starts.select("p1", "p2", "bucket", "m1", "m2"), ["p1", "p2", "bucket"])
    following = joined.select("x1", "x2", "p1", "p2", *(F.coalesce(n, m).alias(n) for n, m in (("n1", "m1"), ("n2", "m2"))))
    return following, starts.where("b = 1").select("p1", "p2", "f1", "f2")


def tour(nodes: DataFrame) -> DataFrame:
    """Arcs (a1, a2, t1, t2, x1, x2, sign, pos, leaves, saved): key, key of the next arc (null at the end),
    node, 1 where it enters the node and -1 where it leaves it, and what the arc adds to the sums."""
    following, firsts = siblings(nodes)
    one, two = leaving("x1", "x2")
    zero = F.lit(0).cast("bigint")
    first = firsts.select(F.col("p1").alias("x1"), F.col("p2").alias("x2"), "f1", "f2")
    enters = nodes.select("x1", "x2", "n_convs", "bytes").join(first, ["x1", "x2"], "left").select(
        F.col("x1").alias("a1"), F.col("x2").alias("a2"), F.coalesce("f1", one).alias("t1"), F.coalesce("f2", two).alias("t2"), "x1", "x2", F.lit(1).alias("sign"),
        F.lit(1).cast("bigint").alias("pos"), F.when(F.col("f1").isNull(), 1).otherwise(0).cast("bigint").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    up1, up2 = leaving("p1", "p2")
    leaves = following.select(
        one.alias("a1"), two.alias("a2"), F.coalesce("n1", up1).alias("t1"), F.coalesce("n2", up2).alias("t2"), "x1", "x2", F.lit(-1).alias("sign"),
        F.lit(1).cast("bigint").alias("pos"), zero.alias("leaves"), zero.alias("saved"))
    end = nodes.where("depth = 0").select(
        one.alias("a1"), two.alias("a2"), F.lit(None).cast("bigint").alias("t1"), F.lit(None).cast("bigint").alias("t2"), "x1", "x2", F.lit(-1).alias("sign"),
        F.lit(1).cast("bigint").alias("pos"), zero.alias("leaves"), zero.alias("saved"))
    return enters.unionByName(leaves).unionByName(end)


def suffix_sums(arcs: DataFrame, level: int = 0) -> DataFrame:
    """(a1, a2, pos, leaves, saved): for each arc (a1, a2, t1, t2, pos, leaves, saved) of one linked list the
    sums from it to the end of the list, its own values included.

    An arc that points at a ruler, or at nothing, has arrived. All others jump: they take over the target of
    their target and add its sums, so the stretch that a jump covers doubles, and after a few rounds all have
    arrived. The rulers, one in RULER_GAP, then are a list of their own.
    """

    def ruler(one: str, two: str) -> Column:
        return F.pmod(F.xxhash64(one, two, F.lit(level)), F.lit(RULER_GAP)) == 0

    # The end of the list counts as arrived at where it is met: its own target is null.
    state = arcs.select("a1", "a2", "t1", "t2", *VALUES, (F.col("t1").isNull() | ruler("t1", "t2")).alias("arrived"))
    state = written(state, "arcs")
    arrived = []
    while True:
        arrived.append(state.where("arrived"))
        moving = state.where("NOT arrived")
        if moving.isEmpty():
            break
        over = reduce(DataFrame.unionByName, [*arrived, moving]).where(~ruler("a1", "a2"))
        over = over.select(F.col("a1").alias("t1"), F.col("a2").alias("t2"), F.col("t1").alias("u1"), F.col("t2").alias("u2"),
                           *(F.col(v).alias(f"{v}_") for v in VALUES), F.col("arrived").alias("there"))
        state = moving.join(over, ["t1", "t2"]).select(
            "a1", "a2", F.col("u1").alias("t1"), F.col("u2").alias("t2"), *((F.col(v) + F.col(f"{v}_")).alias(v) for v in VALUES), F.col("there").alias("arrived"))
        state = written(state, "arcs")
    stretches = reduce(DataFrame.unionByName, arrived).drop("arrived")
    rulers = written(stretches.where(ruler("a1", "a2")), "rulers")
    if rulers.count() > RANKED_DIRECTLY:
        ranked = suffix_sums(rulers, level + 1)
    else:
        ranked = F.broadcast(_ranked(rulers))
    ranked = ranked.select(F.col("a1").alias("t1"), F.col("a2").alias("t2"), *(F.col(v).alias(f"{v}_") for v in VALUES))
    return stretches.join(ranked, ["t1", "t2"], "left").select(
        "a1", "a2", *((F.col(v) + F.coalesce(f"{v}_", F.lit(0))).alias(v) for v in VALUES))


def _ranked(rulers: DataFrame) -> DataFrame:
    """``suffix_sums`` of at most RANKED_DIRECTLY arcs, followed from the end of the list."""
    rows = rulers.collect()
    before = {(r.t1, r.t2): r for r in rows}
    out, sums, at = [], (0, 0, 0), (None, None)
    while at in before:
        r = before[at]
        sums = tuple(s + r[v] for s, v in zip(sums, VALUES))
        at = (r.a1, r.a2)
        out.append((*at, *sums))
    return rulers.sparkSession.createDataFrame(out, "a1 bigint, a2 bigint, pos bigint, leaves bigint, saved bigint")


def trie(turns: DataFrame) -> DataFrame:
    """One row per node of the prefix trie of the rebuilt conversations of ``turns`` (conv_id, turn, role,
    text): conv_id (its smallest member), depth, parent_conv_id (the parent's, null for the root), n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256, n_nodes (of its subtree).

    Turns stand in order of turn, null first; turns of one number in order of their hashes, so repeated rows
    are turns of their own, one after the other. A null role or text counts as empty. Turns of a null conv_id
    belong to no conversation and are left out. A conversation of which rebuilding leaves no turn is a member
    of the root alone. No conversation gives no node. Other columns are ignored.
    """
    own = written(numbered(turns), "turns")
    convs = own.groupBy("conv_id").count().select(
        "conv_id", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % PREFIXES).alias("first"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"))
    convs = written(convs, "conversations")
    steps = written(prefixes(rebuilt(own, convs)), "prefixes")
    inner = steps.groupBy("x1", "x2", "depth").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"), F.max("p1").alias("p1"), F.max("p2").alias("p2"))
    zero = F.lit(0).cast("bigint")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        zero.alias("x1"), zero.alias("x2"), F.lit(0).alias("depth"), "conv_id", "n_convs", zero.alias("bytes"), F.lit(None).cast("bigint").alias("p1"), F.lit(None).cast("bigint").alias("p2"))
    nodes = written(inner.unionByName(root), "nodes")
    last = steps.where("depth = n").select("x1", "x2", "conv_id")
    turnless = convs.join(steps.where("depth = 1").select("conv_id"), "conv_id", "left_anti").select(zero.alias("x1"), zero.alias("x2"), "conv_id")
    sha = written(digests(last.unionByName(turnless)), "digests")

    arcs = written(tour(nodes), "tour")
    ranked = written(suffix_sums(arcs), "ranked")
    own_sums = arcs.select("a1", "a2", "x1", "x2", "sign").join(ranked, ["a1", "a2"]).select(
        "x1", "x2", *((F.col("sign") * F.col(v)).alias(v) for v in VALUES), zero.alias("children"))
    children = nodes.where("depth > 0").select(
        F.col("p1").alias("x1"), F.col("p2").alias("x2"), *(zero.alias(v) for v in VALUES), F.lit(1).cast("bigint").alias("children"))
    sums = own_sums.unionByName(children).groupBy("x1", "x2").agg(*(F.sum(v).alias(v) for v in (*VALUES, "children")))
    # A plain join of two written tables can be split where a node has very many children.
    parents = nodes.select(F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    rows = nodes.join(written(sums, "sums"), ["x1", "x2"]).join(sha, ["x1", "x2"], "left").join(parents, ["p1", "p2"], "left")
    return rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("depth").cast("bigint").alias("depth"), F.col("parent_conv_id").cast("bigint").alias("parent_conv_id"),
        "n_convs", F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NO_TURNS)).alias("ends_sha256"), F.expr("(pos + 1) div 2").alias("n_nodes"))
