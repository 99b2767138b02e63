"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's subwords are the runs of two to four characters of its lower-cased letter words, each word
closed by a mark on both sides. They hash to buckets; a document is the mean of its buckets' embeddings,
and a linear softmax over that mean gives the languages. Embeddings and weights are trained by stochastic
gradient descent in numpy on a bounded sample of labelled rows, drawn from each language. A temperature
fitted on rows kept out of training calibrates the probabilities. Two rejection bars from the same rows mark
texts that look like none of the languages: one for the probability, and one for the share of a text's
subwords that training has seen, since the softmax must choose some language for a text of unseen ones too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embertrace.llm.common import byte_slices, schema_with, texts_of
from embertrace.llm.shingles import mix

BUCKETS = 1 << 16
LENGTHS = (2, 3, 4)
DIMENSIONS = 16
SAMPLE_ROWS = 5000  # labelled rows that are drawn by hash, about, each language alike
EPOCHS, BATCH, RATE = 5, 32, 40.0
LEAST_STEPS = 150  # few rows are gone through more often, until so many steps are made
CALIBRATION = 2, 5  # of five sampled rows, two are kept for calibration
REJECT_SHARE = 0.001  # of rightly labelled calibration rows, the share that either rejection bar may cost
HIGHEST_BAR = 0.5  # of the probability, unless its floor is higher
SEEN_BITS = 1 << 20  # hashes of subwords that training has seen
LOWEST_SEEN, HIGHEST_SEEN = 0.4, 0.75  # between which the bar of the share of seen subwords lies
LEAST_SUBWORDS = 4  # a single letter has three, which say nothing
UNKNOWN = "und"
TEXT_ROWS, SLICE_BYTES = 150, 1 << 20  # scored at once: some two hundred bytes for each byte of text


def _letter_table() -> np.ndarray:
    """Code point -> its lower-case letter, 0 for anything that is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


_TABLE: list[np.ndarray] = []


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points with 0 for all but letters, where each text starts); a 0 closes each text."""
    if not _TABLE:
        _TABLE.append(_letter_table())
    joined = "\n" + "".join(t + "\n" for t in texts)
    codes = _TABLE[0][np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    starts = np.cumsum([0] + [len(t) + 1 for t in texts])
    return codes, starts


def subwords(codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each subword of ``n`` characters: marks only at its ends, one letter at least."""
    size = len(codes) - n + 1
    if size <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inside = codes[1 : size + 1] != 0
    for k in range(2, n - 1):
        inside &= codes[k : k + size] != 0
    if n == 2:
        inside |= codes[:size] != 0
    at = np.flatnonzero(inside)
    h = np.full(len(at), n, np.uint64)
    for k in range(n):
        h = h * np.uint64(0x100000001B3) + codes[at + k]
    return at, mix(h)


def buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)


def seen_bits(hashes: np.ndarray) -> np.ndarray:
    return ((hashes >> np.uint64(20)) & np.uint64(SEEN_BITS - 1)).astype(np.int64)


def document_sums(texts: list[str], values: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(for each text the sum of its subwords' rows of ``values``, its number of subwords, of seen ones)."""
    codes, starts = letters(texts)
    sums, counts, known = np.zeros((len(texts), values.shape[1])), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for n in LENGTHS:
        at, hashes = subwords(codes, n)
        cut = np.searchsorted(at, starts)
        known += np.diff(np.concatenate([[0], np.cumsum(seen[seen_bits(hashes)])])[cut])
        got = values[buckets(hashes)]
        totals = np.zeros((len(at) + 1, values.shape[1]))
        np.cumsum(got, axis=0, out=totals[1:])
        sums += totals[cut[1:]] - totals[cut[:-1]]
        counts += np.diff(cut)
    return sums, counts, known


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # a bucket's embedding times the softmax weights: (BUCKETS, languages)
    bias: np.ndarray
    temperature: float
    bar: float  # below this probability a text is rejected
    seen: np.ndarray  # which subwords' bits training has set
    least_seen: float  # below this share of seen subwords a text is rejected

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sums, counts, known = document_sums(texts, self.weights, self.seen)
        return sums / np.maximum(counts, 1)[:, None] + self.bias, counts, known / np.maximum(counts, 1)

    def probabilities(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(probability of each language, number of subwords, share of them that training has seen)."""
        logits, counts, share = self.logits(texts)
        return softmax(logits / self.temperature), counts, share

    def accepts(self, best: np.ndarray, counts: np.ndarray, share: np.ndarray) -> np.ndarray:
        return (counts >= LEAST_SUBWORDS) & (best >= self.bar) & (share >= self.least_seen)


def train(texts: list[str], labels: list[str], dimensions: int = DIMENSIONS, seed: int = 7) -> LanguageModel | None:
    """None without labelled texts that have letters."""
    rng = np.random.default_rng(seed)
    some = [i for i, t in enumerate(texts) if letters([t])[0].any()]
    if not some:
        return None
    languages = sorted({labels[i] for i in some})
    held = [i for k, i in enumerate(some) if len(some) >= 2 * CALIBRATION[1] and k % CALIBRATION[1] < CALIBRATION[0]]
    bags, seen = {}, np.zeros(SEEN_BITS, bool)
    for i in sorted(set(some) - set(held)):
        codes, _ = letters([texts[i]])
        hashes = np.concatenate([subwords(codes, n)[1] for n in LENGTHS])
        seen[seen_bits(hashes)] = True
        index, n = np.unique(buckets(hashes), return_counts=True)
        bags[i] = index, (n / n.sum()).astype(np.float32)
    y = np.array([languages.index(labels[i]) if labels[i] in languages else -1 for i in range(len(texts))])
    rows = np.array(sorted(bags))
    emb = rng.normal(0, 0.1, (BUCKETS, dimensions)).astype(np.float32)
    out = np.zeros((dimensions, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    per_epoch = -(-len(rows) // BATCH)
    epochs = max(EPOCHS, -(-LEAST_STEPS // per_epoch))
    steps, step = epochs * per_epoch, 0
    for _ in range(epochs):
        order = rng.permutation(rows)
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            index = np.concatenate([bags[i][0] for i in chosen])
            share = np.concatenate([bags[i][1] for i in chosen])
            of = np.repeat(np.arange(len(chosen)), [len(bags[i][0]) for i in chosen])
            bounds = np.flatnonzero(np.diff(of, prepend=-1))
            mean = np.add.reduceat(emb[index] * share[:, None], bounds, axis=0)
            error = softmax(mean @ out + bias).astype(np.float32)
            error[np.arange(len(chosen)), y[chosen]] -= 1
            rate = np.float32(RATE * (1 - step / steps) / len(chosen))
            back = error @ out.T
            out -= rate * mean.T @ error
            bias -= rate * np.float32(0.05) * error.sum(0)
            change = (rate * back)[of] * share[:, None]
            rank = np.argsort(index, kind="stable")
            first = np.flatnonzero(np.diff(index[rank], prepend=-1))
            emb[index[rank][first]] -= np.add.reduceat(change[rank], first, axis=0)
            step += 1
    model = LanguageModel(languages, np.ascontiguousarray(emb @ out), bias, 1.0, 0.0, seen, 0.0)
    check = held or rows.tolist()
    parts = [model.logits([texts[i] for i in check[at : at + TEXT_ROWS]]) for at in range(0, len(check), TEXT_ROWS)]
    logits, share, want = np.concatenate([p[0] for p in parts]), np.concatenate([p[2] for p in parts]), y[check]
    loss = lambda t: -np.log(np.maximum(softmax(logits / t)[np.arange(len(check)), want], 1e-12)).mean()
    model.temperature = float(min(np.geomspace(0.05, 10, 60), key=loss))
    p = softmax(logits / model.temperature)
    right = p.argmax(1) == want
    low = lambda values: float(np.quantile(values, REJECT_SHARE)) if len(values) else 0.0
    floor = 1 / len(languages) + (1 - 1 / len(languages)) / 4  # well above a probability that says nothing
    model.bar = max(floor, min(HIGHEST_BAR, low(p.max(1)[right])))
    model.least_seen = max(LOWEST_SEEN, min(HIGHEST_SEEN, low(share[right])))
    return model


def fit(docs: DataFrame, usable: Column, sample_rows: int = SAMPLE_ROWS) -> LanguageModel | None:
    """Learn from the rows of ``docs`` (doc_id, text, lang) for which ``usable`` holds and that have a
    label and a text: about ``sample_rows`` of them, drawn from each language alike, or all of a language
    that has no more. A row is drawn if its hash of id and text lies below its language's bar."""
    able = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    counts = able.groupBy("lang").count().collect()  # one row per language
    top = (1 << 63) - 1
    bars = [(r[0], min(top, int(-(1 << 63) + min(1.0, sample_rows / len(counts) / r[1]) * (1 << 64)))) for r in counts]
    bars = F.broadcast(docs.sparkSession.createDataFrame(bars, "lang string, _bar bigint"))
    drawn = F.xxhash64("doc_id", "text", F.lit("language"))
    # Only chosen rows leave the tasks.
    rows = sorted(able.join(bars, "lang").where(drawn <= F.col("_bar")).select(drawn, "text", "lang").collect())
    return train([r[1] for r in rows], [r[2] for r in rows])


def predict(docs: DataFrame, model: LanguageModel | None, names: tuple[str, str, str] = ("lang_pred", "score", "accepted")) -> DataFrame:
    """``docs`` with three columns appended. A column of such a name is refused; take other ``names``.

    The text alone decides. A null text, one without letters, and any text where no model could be
    trained is ``und`` with score 0 and not accepted. Otherwise lang_pred is the likeliest language,
    score its calibrated probability, and accepted says that the score and the share of subwords that
    training has seen reach their rejection bars.
    """
    if clash := {n.lower() for n in names} & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns {sorted(clash)} exist already; pass other names")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages floats, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in byte_slices(batches, SLICE_BYTES, rows=TEXT_ROWS):
            texts = texts_of(part)
            found, scores, accepted = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
            if model is not None:
                p, counts, share = model.probabilities(texts)
                some = counts > 0
                best = p.argmax(1)
                found = [model.languages[b] if s else UNKNOWN for b, s in zip(best, some)]
                scores = np.where(some, p[np.arange(len(texts)), best], 0.0)
                accepted = some & model.accepts(scores, counts, share)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.string()), pa.array(scores), pa.array(accepted)],
                                             [*part.schema.names, *names])

    return docs.mapInArrow(run, schema_with(docs, "`{}` string, `{}` double, `{}` boolean".format(*names)))

