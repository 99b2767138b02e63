"""Embedding near-dedup by dual traversal of cover trees.

Vectors lie on the unit sphere, where a cosine is a distance. A cover tree is a hierarchy of nested nets:
a node has a centre, which is one of its vectors, and holds the vectors within its radius; its children's
radii are half as large, and one of them has the same centre. Two trees are traversed together from their
roots. A pair of nodes is left as soon as the distance of the centres exceeds both covering radii and the
threshold; it is counted as a whole as soon as the balls around both means prove that all pairs link; else
it is opened. What is left at the leaves is compared exactly.

The upper levels are nested nets over a bounded sample. They deal the vectors to cells; a cell of more
vectors than a task should hold is cut by hash. Each part becomes a tree in one task, stored in the order of
its traversal. Two parts meet in a task unless the covering radii of their cells rule it out. A task returns
sums per vector, and for each vector one vector that links reach: never a row per pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embertrace.llm.common import slices, written
from embertrace.llm.components import components
from embertrace.llm.links import Forest

COSINE = 0.95
SAMPLE_ROWS = 4096  # vectors that the upper levels are built on, about, drawn by hash
SAMPLE_BYTES = 8 << 20  # of them at most, about
MOST_CELLS = 256  # of one dimension
PART_ROWS = 4096  # vectors of a tree, about
POINT = 1e-6  # vectors within this radius are one leaf
TILE = 1024  # nodes of either tree whose distances are taken at once
SLACK = 1e-4  # by which a bound must decide, well above the error of single precision


def halving_nets(points: np.ndarray, most: int) -> np.ndarray:
    """Rows of ``points`` that are the centres of the finest net of at most ``most``: nets of halving radii,
    each holding the one before."""
    chosen = [0] if len(points) else []
    distance = np.linalg.norm(points - points[:1], axis=1) if len(points) else np.zeros(0)
    radius = float(distance.max(initial=0.0))
    while radius > 1e-9:
        radius /= 2
        finer, near = list(chosen), distance.copy()
        while len(finer) <= most and (far := int(near.argmax())) is not None and near[far] > radius:
            finer.append(far)
            near = np.minimum(near, np.linalg.norm(points - points[far], axis=1))
        if len(finer) > most:
            break
        chosen, distance = finer, near
    return np.array(chosen, np.int64)


@dataclass
class Tree:
    """A cover tree over ``points`` in the order of its traversal. Node ``i`` holds the points from
    ``start[i]`` to ``end[i]``, the first of which is its centre, within ``radius[i]``. Nodes stand in
    preorder, so that a node's first child is the next one; a node is a leaf if its radius is 0."""

    points: np.ndarray
    start: np.ndarray
    end: np.ndarray
    radius: np.ndarray

    def __post_init__(self):
        n = len(self.start)
        after = np.searchsorted(self.start, self.end)  # the next node that is no descendant
        self.single = self.points.astype(np.float32)
        self.centre = self.single[self.start]
        self.low = self.radius.astype(np.float32)
        self.mean, self.spread = {}, {}
        self.children: dict[int, np.ndarray] = {}
        for i in np.flatnonzero(self.radius > 0).tolist():
            inside = self.points[self.start[i] : self.end[i]]
            self.mean[i] = inside.mean(axis=0)
            self.spread[i] = float(np.sqrt(((inside - self.mean[i]) ** 2).sum(axis=1).max()))
            kids, at = [i + 1], int(after[i + 1])
            while at < n and self.start[at] < self.end[i]:
                kids.append(at)
                at = int(after[at])
            self.children[i] = np.array(kids)


def _net(points: np.ndarray, rows: np.ndarray, radius: float) -> np.ndarray:
    """For each of ``rows`` the place of its centre in a greedy net of ``radius``; the first row is a centre."""
    centre = np.full(len(rows), -1, np.int64)
    own = points[rows]
    least = 1 - radius * radius / 2
    left = np.arange(len(rows))
    while len(left):
        block = left[:256]
        near = own[block] @ own[block].T >= least
        np.fill_diagonal(near, True)
        taken, picks = np.zeros(len(block), bool), []
        for k in range(len(block)):
            if not taken[k]:
                picks.append(k)
                new = near[k] & ~taken
                centre[block[new]] = block[k]
                taken |= new
        left = left[256:]
        if len(left):
            cosines = own[left] @ own[block[picks]].T
            best = cosines.argmax(axis=1)
            covered = cosines[np.arange(len(left)), best] >= least
            centre[left[covered]] = block[picks][best[covered]]
            left = left[~covered]
    return centre


def cover_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order of the points, start, end, radius of each node in preorder) of a cover tree over unit vectors."""
    order: list[int] = []
    start, end, radius = [], [], []
    if not len(points):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0),)

    def covering(rows: np.ndarray) -> float:
        d = points[rows] - points[rows[0]]
        return float(np.sqrt((d * d).sum(axis=1).max()))

    # rows, the first of which is the centre; a leaf is a single point, or points that rounding tells apart
    waiting = [np.arange(len(points))]
    while waiting:
        rows = waiting.pop()
        r = covering(rows) if len(rows) > 1 else 0.0
        start.append(len(order))
        end.append(len(order) + len(rows))
        if r <= POINT:
            radius.append(0.0)
            order.extend(rows.tolist())
            continue
        radius.append(r)
        centre = _net(points, rows, r / 2)
        by = np.argsort(centre, kind="stable")  # a centre precedes the rows that it covers
        cuts = np.flatnonzero(np.diff(centre[by], prepend=-1))
        for part in reversed(np.split(by, cuts[1:])):
            inner = part[np.argsort(part != centre[part[0]], kind="stable")]
            waiting.append(rows[inner])
    return np.array(order, np.int64), np.array(start, np.int64), np.array(end, np.int64), np.array(radius)


class Links:
    """Sums over the pairs of points that link: for each point of either side the weight of its partners,
    and a forest over the points of both sides."""

    def __init__(self, a: Tree, b: Tree, weight_a: np.ndarray, weight_b: np.ndarray, cosine: float):
        self.a, self.b, self.same, self.cosine = a, b, a is b, cosine
        self.weights = weight_a, weight_b
        self.sums = np.zeros(len(weight_a), np.int64), np.zeros(len(weight_b), np.int64)
        self.forest = Forest(len(weight_a) + (0 if self.same else len(weight_b)))
        self.shift = 0 if self.same else len(weight_a)
        self.reach = float(np.sqrt(2 - 2 * cosine))
        self._traverse()

    def union(self, i: np.ndarray, j: np.ndarray) -> None:
        """Join the components of points ``i`` of the first side and ``j`` of the second."""
        self.forest.join(i, j + self.shift)

    def whole(self, p: int, q: int) -> None:
        """All pairs of two nodes link; of two equal points that is true of itself, which the caller takes off."""
        (s, e), (t, f) = (self.a.start[p], self.a.end[p]), (self.b.start[q], self.b.end[q])
        self.sums[0][s:e] += self.weights[1][t:f].sum()
        if not self.same:
            self.sums[1][t:f] += self.weights[0][s:e].sum()
        left, right = np.arange(s, e), np.arange(t, f)
        self.union(np.concatenate([left, np.full(f - t, s)]), np.concatenate([np.full(e - s, t), right]))

    def exact(self, i: np.ndarray, j: np.ndarray) -> None:
        """Compare points ``i`` of the first side with points ``j`` of the second, one by one."""
        for at in range(0, len(i), 1 << 15):
            left, right = i[at : at + (1 << 15)], j[at : at + (1 << 15)]
            x, y = self.a.points[left], self.b.points[right]
            on = (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1)) >= self.cosine
            self.linked(left[on], right[on])

    def linked(self, i: np.ndarray, j: np.ndarray) -> None:
        self.sums[0][:] += np.bincount(i, weights=self.weights[1][j], minlength=len(self.sums[0])).astype(np.int64)
        if not self.same:
            self.sums[1][:] += np.bincount(j, weights=self.weights[0][i], minlength=len(self.sums[1])).astype(np.int64)
        self.union(i, j)

    def _traverse(self) -> None:
        a, b = self.a, self.b
        if not len(a.start) or not len(b.start):
            return
        waiting = [(np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while waiting:
            left, right = waiting.pop()
            if len(left) > TILE or len(right) > TILE:
                waiting += [(left[s : s + TILE], right[t : t + TILE]) for s in range(0, len(left), TILE) for t in range(0, len(right), TILE)]
                continue
            cosines = a.centre[left] @ b.centre[right].T
            far = self.reach + a.low[left][:, None] + b.low[right]
            p, q = np.nonzero(cosines >= 1 - far * far / 2 - SLACK)
            p, q = left[p], right[q]
            leaf = (a.radius[p] == 0) & (b.radius[q] == 0)
            self._leaves(p[leaf], q[leaf])
            for x, y in zip(p[~leaf].tolist(), q[~leaf].tolist()):
                if self._all_link(x, y):
                    self.whole(x, y)
                else:
                    waiting.append((a.children.get(x, np.array([x])), b.children.get(y, np.array([y]))))

    def _all_link(self, x: int, y: int) -> bool:
        a, b = self.a, self.b
        m, r = (a.mean[x], a.spread[x]) if x in a.mean else (a.points[a.start[x]], POINT)
        n, s = (b.mean[y], b.spread[y]) if y in b.mean else (b.points[b.start[y]], POINT)
        return float(np.sqrt(((m - n) ** 2).sum())) + r + s <= self.reach - SLACK

    def _leaves(self, p: np.ndarray, q: np.ndarray) -> None:
        a, b = self.a, self.b
        many = (a.end[p] - a.start[p] > 1) | (b.end[q] - b.start[q] > 1)
        self.exact(a.start[p[~many]], b.start[q[~many]])
        for x, y in zip(p[many].tolist(), q[many].tolist()):  # points that differ by rounding alone
            if self._all_link(x, y):
                self.whole(x, y)
                continue
            i, j = np.arange(a.start[x], a.end[x]), np.arange(b.start[y], b.end[y])
            self.exact(np.repeat(i, len(j)), np.tile(j, len(i)))


def unit_vectors(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, their unit vectors) for each length of the vectors of ``column``, which are neither null nor
    zero and hold numbers alone."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(sizes) - sizes
    out = []
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        x = values[starts[rows][:, None] + np.arange(size)]
        x = x / np.abs(x).max(axis=1, keepdims=True)  # no square overflows or vanishes
        out.append((rows, x / np.sqrt((x * x).sum(axis=1, keepdims=True))))
    return out


def has_direction() -> Column:
    """Whether ``embedding`` is a vector of numbers, not all of them 0."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~odd & F.exists("embedding", lambda x: x != 0), F.lit(False))


def _vectors(rows: DataFrame) -> DataFrame:
    """(k1, k2, id, copies, size, vector) of the distinct vectors of ``rows`` (vec_id, embedding, k1, k2): the
    lowest id and the number of rows, and the vector at unit length, eight bytes a component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                for kept, x in unit_vectors(part.column(4)):
                    own = part.take(pa.array(kept))
                    yield pa.RecordBatch.from_arrays(
                        [*own.columns[:4], pa.array(np.full(len(kept), x.shape[1], np.int32)), pa.array([v.tobytes() for v in x.astype("<f8")], pa.binary())], names)

    names = ["k1", "k2", "id", "copies", "size", "vector"]
    distinct = rows.groupBy("k1", "k2").agg(F.min("vec_id").cast("bigint").alias("id"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    return distinct.mapInArrow(run, "k1 bigint, k2 bigint, id bigint, copies bigint, size int, vector binary")


def _matrix(vectors: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), "<f8").reshape(len(vectors), -1) if vectors else np.zeros((0, 0))


def _cells(vectors: DataFrame) -> tuple[DataFrame, dict]:
    """(``vectors`` with the cell of each (its nearest centre of the upper levels) and its distance from the
    centre; each cell's vector length and centre). Vectors of a length that the sample has not seen are a
    cell of their own."""
    total, longest = vectors.agg(F.count("*"), F.max("size")).first()
    rows = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * (longest or 1))))
    share = rows / max(1, total)
    draw = F.xxhash64("k1", "k2", F.lit("upper levels"))
    sample = vectors if share >= 1 else vectors.where(draw < F.lit(int(-(1 << 63) + share * (1 << 64))).cast("bigint"))
    drawn = sample.orderBy("k1", "k2").select("size", "vector").collect()  # about ``rows`` of them
    centres, first = {}, 0
    for size in sorted({r.size for r in drawn}):
        points = _matrix([r.vector for r in drawn if r.size == size])
        net = points[halving_nets(points, MOST_CELLS)]
        centres[size] = (first, net)
        first += len(net)
    shared = vectors.sparkSession.sparkContext.broadcast(centres)  # no more than the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for part in slices(batches, 2000):
            sizes = part.column(4).to_numpy()
            cell, distance = -sizes.astype(np.int64), np.full(len(sizes), 2.0)
            for size in np.unique(sizes):
                if size in known:
                    base, net = known[size]
                    at = np.flatnonzero(sizes == size)
                    x = _matrix(part.column(5).take(pa.array(at)).to_pylist())
                    nearest = (x @ net.T).argmax(axis=1)
                    cell[at] = base + nearest
                    distance[at] = np.linalg.norm(x - net[nearest], axis=1)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell), pa.array(distance)], [*part.schema.names, "cell", "distance"])

    dealt = written(vectors.mapInArrow(run, f"{VECTOR}, cell bigint, distance double"), "cells")
    return dealt, {base + i: (size, net[i]) for size, (base, net) in centres.items() for i in range(len(net))}


VECTOR = "k1 bigint, k2 bigint, id bigint, copies bigint, size int, vector binary"
PLACED = "cell bigint, part int, place int, k1 bigint, k2 bigint, id bigint, copies bigint, vector binary, ends array<int>, radii array<double>"


def _stored_trees(parts: DataFrame) -> DataFrame:
    """The vectors of each (cell, part) with their place in the order of the part's cover tree, and the ends
    and radii of the nodes that they are the centre of, larger nodes first."""

    def build(table: pa.Table) -> pa.Table:
        points = _matrix(table.column("vector").to_pylist())
        order, start, end, radius = cover_tree(points)
        cuts = pa.array(np.searchsorted(start, np.arange(len(order) + 1)).astype(np.int32))
        table = table.take(pa.array(order))
        return pa.table({
            "cell": table.column("cell"), "part": table.column("part"), "place": pa.array(np.arange(len(order), dtype=np.int32)),
            **{c: table.column(c) for c in ("k1", "k2", "id", "copies", "vector")},
            "ends": pa.ListArray.from_arrays(cuts, pa.array(end.astype(np.int32))), "radii": pa.ListArray.from_arrays(cuts, pa.array(radius))})

    return parts.groupBy("cell", "part").applyInArrow(build, PLACED)


def _tree(table: pa.Table) -> Tree:
    """The stored tree of one part; ``table`` is in order of place."""
    held = pc.list_value_length(table.column("ends")).to_numpy()
    flat = lambda c: pc.list_flatten(table.column(c)).to_numpy()
    start = np.repeat(np.arange(table.num_rows), held)
    return Tree(_matrix(table.column("vector").to_pylist()), start, flat("ends").astype(np.int64), flat("radii"))


def _partners(spark, counted: list, centres: dict, cosine: float) -> tuple[DataFrame, DataFrame]:
    """((cell, parts), (cell, partner, partner_parts)): into how many parts a cell is cut, and the cells, itself
    included, that its covering radius does not rule out. At most MOST_CELLS cells of one length."""
    reach = float(np.sqrt(2 - 2 * cosine))
    parts = {r.cell: -(-r.n // PART_ROWS) for r in counted}
    pairs = []
    for size in {r.size for r in counted}:
        cells = [r for r in counted if r.size == size]
        for r in cells:
            if r.cell in centres:
                middle = np.stack([centres[c.cell][1] for c in cells if c.cell in centres])
                away = dict(zip([c.cell for c in cells if c.cell in centres], np.linalg.norm(middle - centres[r.cell][1], axis=1)))
            else:
                away = {}
            pairs += [(r.cell, c.cell, parts[c.cell]) for c in cells if away.get(c.cell, 0.0) <= r.radius + c.radius + reach + SLACK]
    return spark.createDataFrame(list(parts.items()), "cell bigint, parts int"), spark.createDataFrame(pairs, "cell bigint, partner bigint, partner_parts int")


def _met(trees: DataFrame, partners: DataFrame, cosine: float) -> DataFrame:
    """(k1, k2, links, node, reached): for each pair of parts that may have links, and each vector of either,
    the rows that it links with there, its own included, and a vector that links reach there."""

    def meet(table: pa.Table) -> pa.Table:
        table = table.sort_by([("cell", "ascending"), ("part", "ascending"), ("place", "ascending")])
        cell, part = table.column("cell").to_numpy(), table.column("part").to_numpy()
        cut = int(((cell == cell[0]) & (part == part[0])).sum())
        sides = [table] if cut == table.num_rows else [table.slice(0, cut), table.slice(cut)]
        diagonal = table.column("left")[0] == table.column("right")[0]
        if len(sides) == 1 and not diagonal:
            return empty  # the other part has no rows
        trees = [_tree(s) for s in sides]
        weights = [s.column("copies").to_numpy() for s in sides]
        found = Links(trees[0], trees[-1], weights[0], weights[-1], cosine)
        sums = np.concatenate(found.sums[: len(sides)])
        some = np.flatnonzero(sums)
        own, to = table.take(pa.array(some)), table.take(pa.array(found.forest.label[some]))
        node = lambda t: pa.StructArray.from_arrays(
            [pc.is_null(t.column("id").combine_chunks()), *(t.column(c).combine_chunks() for c in ("id", "k1", "k2"))], ["no_id", "id", "k1", "k2"])
        return pa.table({"k1": own.column("k1"), "k2": own.column("k2"), "links": pa.array(sums[some]), "node": node(own), "reached": node(to)})

    kind = "struct<no_id:boolean,id:bigint,k1:bigint,k2:bigint>"
    schema = f"k1 bigint, k2 bigint, links bigint, node {kind}, reached {kind}"
    node_type = pa.struct([("no_id", pa.bool_()), ("id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64())])
    empty = pa.table({"k1": pa.array([], pa.int64()), "k2": pa.array([], pa.int64()), "links": pa.array([], pa.int64()),
                      "node": pa.array([], node_type), "reached": pa.array([], node_type)})
    met = trees.join(F.broadcast(partners), "cell").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("partner_parts") - 1)))
    own = F.struct("cell", "part")
    other = F.struct(F.col("partner").alias("cell"), F.col("other").alias("part"))
    met = met.select(*trees.columns, F.least(own, other).alias("left"), F.greatest(own, other).alias("right"))
    return met.groupBy("left", "right").applyInArrow(meet, schema)


def near_duplicates(rows: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``rows`` (vec_id, embedding); others ignored.

    Two rows link when their vectors have a cosine of ``cosine`` or more (above 0) in double precision,
    whatever their lengths in space; vectors of different numbers of components never link. Vectors that are
    null, empty or zero, or hold null or non-finite components, link with nothing: their component_id is
    their vec_id. n_links counts all other rows that a row links with, copies of its vector among them.
    component_id is the smallest vec_id that links reach, a null one only where there is no other; kept says
    that it is the row's own. Rows of one id are judged by their own vectors. No rows give no rows.
    """
    valid = F.when(has_direction(), F.xxhash64("embedding", F.lit(1)))
    keyed = written(rows.select("vec_id", "embedding", valid.alias("k1"), F.when(has_direction(), F.xxhash64(F.lit(2), "embedding")).alias("k2")), "vectors")
    vectors = written(_vectors(keyed.where("k1 IS NOT NULL")), "distinct")
    dealt, centres = _cells(vectors)
    counted = dealt.groupBy("cell", "size").agg(F.count("*").alias("n"), F.max("distance").alias("radius")).collect()
    parts, partners = _partners(rows.sparkSession, counted, centres, cosine)
    cut = dealt.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("k1", "k2", F.lit("part")), F.col("parts")).cast("int"))
    trees = written(_stored_trees(cut.drop("parts", "distance", "size")), "trees")
    met = written(_met(trees, partners, cosine), "links")
    labels = components(met.select(F.col("node").alias("a"), F.col("reached").alias("b")))
    reached = labels.select(F.col("node.k1").alias("k1"), F.col("node.k2").alias("k2"), F.col("label.id").alias("reached_id"))
    links = met.groupBy("k1", "k2").agg((F.sum("links") - 1).alias("n_links"))
    named = vectors.select("k1", "k2", "id").join(links, ["k1", "k2"]).join(reached, ["k1", "k2"], "left")
    named = written(named.select("k1", "k2", "n_links", F.coalesce("reached_id", "id").alias("component_id")), "named")
    # A plain join of two written tables can be split where a vector has very many copies.
    out = keyed.select("vec_id", "k1", "k2").join(named, ["k1", "k2"], "left")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", F.col("vec_id").cast("bigint")).alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
