"""Cover trees, the prefix trie and resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from embertrace.llm import cover_tree, prefix_trie, resample


def key(doc_id):
    return (doc_id is None, doc_id or 0)


# --- cover trees ------------------------------------------------------------------------------

def clusters(seed, centres, around, dims=24, noise=0.05):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(centres):
        c = rng.normal(size=dims)
        out += [c / np.linalg.norm(c) + rng.normal(size=dims) * noise * rng.random() for _ in range(around)]
    return np.stack(out)


def test_cover_tree_covers_and_halves():
    points = clusters(1, 30, 20)
    points /= np.linalg.norm(points, axis=1)[:, None]
    order, start, end, radius = cover_tree.cover_tree(points)
    assert sorted(order.tolist()) == list(range(600)) and end[0] == 600
    tree = cover_tree.Tree(points[order], start, end, radius)
    for i, kids in tree.children.items():
        inside = tree.points[start[i] : end[i]]
        assert np.linalg.norm(inside - inside[0], axis=1).max() <= radius[i] + 1e-12
        assert start[kids[0]] == start[i] and [start[k] for k in kids[1:]] == [end[k] for k in kids[:-1]] and end[kids[-1]] == end[i]
        assert max(radius[k] for k in kids) <= radius[i] / 2 + 1e-9


@pytest.mark.parametrize("noise", [0.01, 0.08, 0.12])
def test_links_equal_all_pairs(noise):
    points = clusters(2, 12, 40, noise=noise)
    points /= np.linalg.norm(points, axis=1)[:, None]
    order, start, end, radius = cover_tree.cover_tree(points[:300])
    a = cover_tree.Tree(points[:300][order], start, end, radius)
    other, *nodes = cover_tree.cover_tree(points[300:])
    b = cover_tree.Tree(points[300:][other], *nodes)
    for x, y in ((a, a), (a, b)):
        linked = x.points @ y.points.T >= 0.95
        found = cover_tree.Links(x, y, np.ones(len(x.points), np.int64), np.full(len(y.points), 1 if x is y else 3), 0.95)
        assert found.sums[0].tolist() == (linked.sum(1) * (1 if x is y else 3)).tolist()
        assert x is y or found.sums[1].tolist() == linked.sum(0).tolist()
        for i, j in zip(*np.nonzero(linked)):
            assert found.forest.label[i] == found.forest.label[j + found.shift]


def brute_links(rows, cosine=0.95):
    unit = []
    for _, v in rows:
        ok = v and None not in v and np.isfinite(v).all() and np.any(v)
        unit.append(np.array(v) / np.abs(v).max() / np.linalg.norm(np.array(v) / np.abs(v).max()) if ok else None)
    parent, counts = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine:
                counts[i] += 1
                counts[j] += 1
                parent[find(i)] = find(j)
    out = []
    for i, (vec, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        low = min(ids) if ids else None
        out.append((key(vec), counts[i], key(low), vec == low))
    return sorted(out)


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "PART_ROWS", 60)
    monkeypatch.setattr(cover_tree, "MOST_CELLS", 5)
    rows = [(100 + i, v.tolist()) for i, v in enumerate(clusters(3, 25, 12, dims=16, noise=0.12))]
    random.Random(1).shuffle(rows)
    rows += [(i + 1000, list(v)) for i, (_, v) in enumerate(rows[:40])] + [(i + 2000, [x * 3 for x in v]) for i, (_, v) in enumerate(rows[:20])]
    rows += [(1, None), (2, []), (3, [0.0] * 16), (4, [1.0, None] + [0.0] * 14), (5, [math.nan] * 16), (6, [math.inf] + [1.0] * 15), (7, [1.0, 2.0]), (8, [2.0, 4.1]),
             (9, [1e300] * 16), (10, [1e-300] * 16), (None, [1.0] * 16), (None, [0.0]), rows[0], rows[0], (100, [5.0] * 15 + [-5.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id bigint, embedding array<double>, k1 int, cell string").repartition(4)
    got = cover_tree.near_duplicates(df).collect()
    assert sorted((key(r.vec_id), r.n_links, key(r.component_id), r.kept) for r in got) == brute_links(rows)
    assert cover_tree.near_duplicates(df.limit(0)).count() == 0
    single = spark.createDataFrame([(5, [0.5, 0.5]), (4, [1.0, 1.0]), (6, [-1.0, 0.0])], "vec_id int, embedding array<float>")
    assert sorted(map(tuple, cover_tree.near_duplicates(single).collect())) == [(4, 1, 4, True), (5, 1, 4, False), (6, 0, 6, True)]


# --- prefix trie ------------------------------------------------------------------------------

def brute_trie(turns):
    own = {}
    for conv, turn, role, text in turns:
        if conv is not None:
            own.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(v, key=lambda x: x[0])] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(math.fmod(c, 5))
        built[c] = tuple(own.get(base, [])[:h] + v[h:])
    members = {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            members.setdefault(v[:d], []).append(c)
    out = []
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        kids = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in below)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        ends = ",".join(str(c) for c in sorted(convs) if len(built[c]) == len(node))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else -1, len(convs), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest(), len(below)))
    return sorted(out)


@pytest.mark.parametrize("gap, direct", [(64, 8192), (3, 4)])
def test_trie(spark, monkeypatch, gap, direct):
    monkeypatch.setattr(prefix_trie, "RULER_GAP", gap)
    monkeypatch.setattr(prefix_trie, "RANKED_DIRECTLY", direct)
    monkeypatch.setattr(prefix_trie, "SIBLINGS", 5)
    rng, turns = random.Random(3), []
    for conv in range(-8, 50):
        turns += [(conv, k, ("user", "assistant")[k % 2], f"é {rng.randint(0, 1 + (k > 1))} {k}") for k in range(rng.randint(0, 12))]
    turns += [(60, None, None, None), (60, 3, "user", ""), (61, 1, "", None), (None, 0, "user", "lost"), (73, 2, "user", "late"), (2**62, 0, "user", "far")]
    turns += [(700 + k, 0, "user", "same first") for k in range(40)]
    df = spark.createDataFrame([(*t, "x", 1) for t in turns], "conv_id bigint, turn bigint, role string, text string, x1 string, depth int").repartition(3)
    got = [(r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, *list(r)[3:]) for r in prefix_trie.trie(df).collect()]
    want = brute_trie(turns)
    assert len(got) == len(want) and sorted(got) == want
    assert prefix_trie.trie(df.limit(0)).count() == 0
    # A turn logged twice stands twice, and a conversation can lose all its turns.
    twice = spark.createDataFrame([(5, 0, "user", "a"), (5, 0, "user", "a")], "conv_id bigint, turn bigint, role string, text string")
    assert prefix_trie.trie(twice).count() == len(brute_trie([(5, 0, "user", "a")] * 2))


# --- resampling -------------------------------------------------------------------------------

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text, longest):
    words = WORD.findall((text or "").encode().lower())
    return words, [b" ".join(words[k : k + n]) for n in range(1, longest + 1) for k in range(len(words) - n + 1)]


def brute_resample(rows, target, longest, percent=10, least=20, buckets=10_000):
    place = lambda f: zlib.crc32(f) % buckets
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(place, runs(text, longest)[1]))
    for text in target:
        t.update(map(place, runs(text, longest)[1]))
    total, aim = float(s.total()), float(t.total())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (total + buckets) / ((s[b] + 1.0) * (aim + buckets))))
    out = []
    for doc, text in rows:
        words, features = runs(text, longest)
        weight = sum(gain(place(f)) for f in features) // len(features) if features else 0
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], key(r[0]), r[2], r[1]))
    rank = {id(r): n for n, r in enumerate(able[: len(able) * percent // 100], 1)}
    return sorted((key(r[0]), *r[1:4], rank.get(id(r), 0)) for r in out)


def test_hashes_are_xxhash64():
    rng = random.Random(4)
    texts = ["".join(rng.choice("abXYZ09 ,-é你") for _ in range(rng.randint(0, 300))) for _ in range(60)] + ["a" * n for n in range(1, 70)]
    data, starts, sizes, _ = resample.ngrams(resample.words(texts), 2)
    pieces = [data[s : s + n].tobytes() for s, n in zip(starts, sizes)]
    assert resample.xxhash64(data, starts, sizes).tolist() == [xxhash.xxh64_intdigest(p) for p in pieces]
    for keys in (None, np.zeros(len(starts), np.uint64)):  # equal keys of other bytes must not share a slot
        table, held = resample.Interned(data, starts, sizes, 100, keys), {}
        for slot, piece in zip(table.slots.tolist(), pieces):
            assert held.setdefault(slot, piece) == piece
        assert len(held) == len(set(pieces)) and all(table.bucket[s] == zlib.crc32(p) % 100 for s, p in held.items())
        assert {p: int(table.count[s]) for s, p in held.items()} == Counter(pieces)


@pytest.mark.parametrize("longest", [1, 3])
def test_resample(spark, odd, none, prose, longest, monkeypatch):
    monkeypatch.setattr(resample, "SLICE_BYTES", 20_000)
    rows = [(r.doc_id, r.text) for r in odd.collect()] + [(100 + k, prose(k, 15 + k % 30)) for k in range(120)]
    target = [prose(k, 40) for k in range(0, 40, 4)] + [None, ""]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, weight string, n_words int").repartition(3)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    got = sorted((key(r.doc_id), r.n_features, r.weight, r.score, r.rank or 0) for r in resample.resample(docs, aim, longest=longest).collect())
    assert got == brute_resample(rows, target, longest)
    assert resample.resample(none, aim).count() == 0 and resample.resample(docs, aim.limit(0)).count() == len(rows)


def test_weights_refuse_clashing_names(odd):
    with pytest.raises(ValueError):
        resample.weights(odd.withColumnRenamed("words", "Weight"), np.zeros(10, np.int64))
