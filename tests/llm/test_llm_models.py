"""Language identification, quality classifier and language-model scores: held-out accuracy, exact sums."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from embertrace.llm import language, ppm, quality
from embertrace.llm.common import fold
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
ODD_IDS = [None, None, 1, 2, 3, 4, 5, 6, 7, 7, 8, 9, 10, 11, 12, 12]


def ids(df):
    return sorted((r.doc_id for r in df.select("doc_id").collect()), key=lambda i: (i is not None, i or 0))


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_language_held_out(spark, documents, odd, none):
    model = language.fit(documents, fold("doc_id", 5) != 0)
    held = language.predict(documents.where(fold("doc_id", 5) == 0), model)
    right = held.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score"), F.avg(F.col("accepted").cast("int"))).first()
    assert right[0] > 0.97 and 0 <= right[1] <= right[2] <= 1 and right[3] > 0.97
    names = ("found", "sure", "accepted")
    rows = language.predict(odd, model, names)
    assert rows.columns == [*odd.columns, *names] and ids(rows) == ODD_IDS
    with pytest.raises(ValueError):
        language.predict(odd, model)  # it has a column of that name
    for r in rows.collect():
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.found == "und") == (not letters) and (r.sure > 0) == letters
    assert language.predict(none, model, names).count() == 0
    assert language.fit(none, F.lit(True)) is None
    assert {(r.lang_pred, r.score, r.accepted) for r in language.predict(odd.drop("score"), None).collect()} == {("und", 0.0, False)}
    one = language.fit(odd, F.lit(True))
    assert one.languages == ["en"]


def test_language_rejects_what_it_has_not_learned(spark, documents):
    model = language.fit(documents, F.lit(True))
    assert model.bar > 1 / len(model.languages)
    rng = random.Random(2)
    noise = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(60))
    odd = ["Быстрая коричневая лиса прыгает", "你好世界", "γειά σου κόσμε", noise, "xqzt wkjq", "lorem ipsum dolor sit amet consectetur", "a", "12 34", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "doc_id bigint, text string")
    assert language.predict(rows, model).where("accepted").count() == 0
    one_word = spark.createDataFrame([(t.split()[0],) for t in (r.text for r in documents.where("length(text) > 2000").collect())], "text string")
    assert language.predict(one_word, model).select(F.avg(F.col("accepted").cast("int"))).first()[0] > 0.9
    assert language.predict(documents, model).where("NOT accepted").count() <= 0.01 * documents.count()


def test_language_is_the_mean_over_subwords(spark, documents):
    model = language.fit(documents, F.lit(True))
    texts = ["Été, der ñandú 12x", "the the", documents.first().text]
    rows = {r.text: r for r in language.predict(spark.createDataFrame([(t,) for t in texts], "text string"), model).collect()}
    for text in texts:
        sums, count, known = np.zeros(len(model.languages)), 0, 0
        low = "".join(c.lower() if c.isalpha() else " " for c in text)
        for word in low.split():
            marked = f" {word} "
            for n in language.LENGTHS:
                for at in range(len(marked) - n + 1):
                    h = np.array([n], np.uint64)
                    for c in marked[at : at + n]:
                        h = h * np.uint64(0x100000001B3) + np.uint64(0 if c == " " else ord(c))
                    h = language.mix(h)
                    sums += model.weights[language.buckets(h)[0]]
                    known += int(model.seen[language.seen_bits(h)[0]])
                    count += 1
        p = language.softmax(((sums / count + model.bias) / model.temperature)[None])[0]
        assert rows[text].lang_pred == model.languages[p.argmax()] and rows[text].score == pytest.approx(p.max())
        assert rows[text].accepted == (count >= language.LEAST_SUBWORDS and p.max() >= model.bar and known / count >= model.least_seen)


def test_language_sample_is_bounded(documents):
    assert documents.count() == 1000
    few = language.fit(documents, F.lit(True), sample_rows=60)
    assert set(few.languages) <= {"de", "en", "es", "fr"}


def test_quality_held_out(spark, documents, odd, none):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stats = quality.with_statistics(documents, ["doc_id"])
    model = quality.fit(quality.labelled_statistics(stats, labels, fold("doc_id", 5) != 0))
    rows = quality.scored(stats, model).join(labels, "doc_id").where(fold("doc_id", 5) == 0).collect()
    assert np.mean([(r.score >= quality.THRESHOLD) == (r.quality == 1) for r in rows]) > 0.95
    direct = {r.doc_id: r.other for r in quality.predict(documents, model, "other").collect()}
    assert all(direct[r.doc_id] == r.score and 0 <= r.score <= 1 for r in rows)
    with pytest.raises(ValueError):
        quality.predict(odd, model)
    odd, none = odd.drop("score"), none.drop("score")
    got = quality.predict(odd, model)
    assert ids(got) == ODD_IDS and all(0 <= r.score <= 1 for r in got.collect())
    assert quality.predict(none, model).count() == 0
    unlabelled = quality.fit(quality.labelled_statistics(quality.with_statistics(odd, ["doc_id"]), labels.limit(0), F.lit(True)))
    assert {r.score for r in quality.predict(odd, unlabelled).collect()} == {0.5}
    one_class = quality.fit(quality.labelled_statistics(stats, labels.where("quality = 1"), F.lit(True)))
    assert min(r.score for r in quality.predict(odd, one_class).collect()) == 1.0


def test_quality_weights_solve_the_normal_equations(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.labelled_statistics(quality.with_statistics(documents, ["doc_id"]), labels, F.lit(True))
    model = quality.fit(rows, features=40)
    got = rows.collect()
    x, y = np.stack([np.frombuffer(r.stats) for r in got]), np.array([r.label for r in got], float)
    spread = x.std(0)
    assert model.mean == pytest.approx(x.mean(0)) and model.scale == pytest.approx(np.where(spread > 1e-6, spread, 1.0), rel=1e-6)
    z = np.column_stack([model.features(x), np.ones(len(x))])
    weights = np.linalg.solve(z.T @ z + quality.RIDGE * len(x) * np.diag([1.0] * 40 + [1e-6]), z.T @ y)
    assert model.weights == pytest.approx(weights, rel=1e-6, abs=1e-8)
    assert model.score(x) == pytest.approx(np.interp(z @ weights, model.knots, model.levels), abs=1e-6)


def test_isotonic():
    assert quality.pool_adjacent([1, 0, 2], [1, 1, 1]).tolist() == [0.5, 0.5, 2]
    assert quality.pool_adjacent([3, 2, 1], [1, 2, 1]).tolist() == [2, 2, 2]
    assert quality.pool_adjacent([], []).tolist() == []


def test_sums_are_added_in_rounds(spark, documents):
    stats = quality.with_statistics(documents.repartition(70), ["doc_id"])
    total = quality._summed(stats, lambda part: quality._matrix(part).sum(0)[None], quality.STATISTICS, 1)[0]
    want = quality.statistics([r.text for r in documents.select("text").collect()]).sum(0)
    assert total == pytest.approx(want)


def brute_trie(texts):
    tree = defaultdict(Counter)
    for t in texts:
        data = ppm.END * ppm.ORDER + b" ".join(t.encode().lower().split()) + ppm.END
        for i in range(ppm.ORDER, len(data)):
            for k in range(ppm.ORDER + 1):
                tree[data[i - k : i]][data[i]] += 1
    return tree


def brute_log10(tree, text):
    data, out = ppm.END * ppm.ORDER + b" ".join(text.encode().lower().split()) + ppm.END, 0.0
    for i in range(ppm.ORDER, len(data)):
        p, excluded = 1.0, set()
        for k in range(ppm.ORDER, -1, -1):
            seen = {s: n for s, n in tree.get(data[i - k : i], {}).items() if s not in excluded}
            if not seen:
                continue
            if data[i] in seen:
                p *= (seen[data[i]] - 0.5) / sum(seen.values())
                break
            p *= len(seen) / 2 / sum(seen.values())
            excluded |= set(seen)
        else:
            p /= 256 - len(excluded)
        out += math.log10(p)
    return out


def test_trie_is_a_distribution(prose):
    keys = np.sort(ppm.byte_rows([prose(1, 200), "abc abd", ""])[0])
    keys, counts = np.unique(keys, return_counts=True)
    trie = ppm.Trie(keys, counts, *ppm.sums_by(keys & np.uint64(0xFFFF), counts))
    rng = random.Random(1)
    for _ in range(40):
        context = int(keys[rng.randrange(len(keys))]) if rng.random() < 0.6 else int.from_bytes(rng.randbytes(6), "big")
        every = (np.uint64(context >> 8) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert (10.0 ** trie.log10(every)).sum() == pytest.approx(1)


@pytest.mark.parametrize("block_nodes", [2_000_000, 300])
def test_scores(spark, odd, none, prose, block_nodes):
    rows = [(i, prose(i, 60)) for i in range(100, 130)] + [(r.doc_id, r.text) for r in odd.where("doc_id is null or doc_id <> 8").collect()]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id bigint, text string, key string")
    train = F.coalesce(F.col("doc_id") % 3 != 0, F.lit(False))
    texts = [t or "" for i, t in rows if i is not None and i % 3]
    tree, words = brute_trie(texts), Counter(w for t in texts for w in t.encode().lower().split())
    words["end", ] = len(texts)
    n, v = sum(words.values()), len(words)
    want = []
    for i, t in rows:
        own = [*(t or "").encode().lower().split(), ("end",)]
        base = sum(math.log10((words[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        want.append(((i is None, i or 0), len(own), sum(words[w] > 0 for w in own), n, base, brute_log10(tree, t or "")))
    got = ppm.scores(docs, train, block_nodes).collect()
    got = [((r.doc_id is None, r.doc_id or 0), r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got]
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:])


def test_scores_without_training_rows(spark, odd, none):
    assert ppm.scores(none, F.lit(True)).count() == 0
    rows = ppm.scores(odd.where("doc_id < 5"), F.lit(False)).collect()
    assert {(r.n_known, r.train_tokens) for r in rows} == {(0, 0)} and len(rows) == 4
    blank = next(r for r in rows if r.doc_id == 1)
    assert blank.score == pytest.approx(-math.log10(256)) and blank.base_score == pytest.approx(0)


def test_trie_beats_words_on_held_out_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = ppm.scores(docs, fold("doc_id", 10) != 0).where(fold("doc_id", 10) == 0)
    total = rows.select(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert total[0] > 1.02 * total[1]
