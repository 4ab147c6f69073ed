"""Toxicity: a convolutional text classifier in numpy, with thresholds calibrated by language.

Words are embedded by hashing (the word itself and its beginnings of 4, 5 and 6 letters), filters of several widths slide
over the whole text, each filter's maximum goes into a logistic output. The language that sets the threshold is guessed
from the text's own hashed words, so a score depends on the text alone.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgate.llm.common import crc_mod, filtered, slices

#: Labelled rows that training sees at most, by label; where there are more, those with the lowest hashes of doc_id.
SAMPLE_TOXIC, SAMPLE_CLEAN = 2400, 3600
BUCKETS, DIMS, WIDTHS, FILTERS = 1 << 15, 12, (1, 2, 3), 12
PREFIXES = (4, 5, 6)
EPOCHS, BATCH, RATE, DECAY = 6, 32, 0.02, 1e-5
#: Distinct words whose buckets a task remembers at most.
REMEMBERED = 200_000

_WORD = re.compile(r"\w+")


def _hash(word: str, salt: int) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"), salt)


class Words:
    """The buckets of a word: its own and those of its beginnings."""

    def __init__(self):
        self.known: dict[str, tuple[int, ...]] = {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = (_hash(word, 1) % BUCKETS, *(_hash(word[:n], n + 100) % BUCKETS if len(word) >= n else -1 for n in PREFIXES))
        if len(self.known) < REMEMBERED:
            self.known[word] = found
        return found

    def of(self, text: str | None) -> np.ndarray:
        """One row of buckets a word; BUCKETS stands for none."""
        known, miss = self.known, self.__missing__
        rows = [known.get(w) or miss(w) for w in _WORD.findall((text or "").lower())]
        return np.array(rows, np.int32).reshape(-1, 1 + len(PREFIXES))


class Classifier:
    def __init__(self, seed: int = 9):
        rng = np.random.default_rng(seed)
        self.table = rng.normal(scale=0.1, size=(BUCKETS + 1, DIMS)).astype(np.float32)
        self.table[BUCKETS] = 0
        self.filters = [rng.normal(scale=1 / np.sqrt(w * DIMS), size=(w, DIMS, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = rng.normal(scale=0.3, size=len(WIDTHS) * FILTERS).astype(np.float32)
        self.base = 0.0
        self.languages = np.zeros((BUCKETS, 1), np.float32)
        self.thresholds = np.array([0.5])

    def _embed(self, rows: np.ndarray) -> np.ndarray:
        e = self.table[rows[:, 0]]
        for j in range(1, rows.shape[1]):
            e = e + self.table[rows[:, j]]
        return e

    def _pool(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The maximum of each filter over the text, and where it stands; texts shorter than a filter are padded."""
        if len(e) < max(WIDTHS):
            e = np.concatenate([e, np.zeros((max(WIDTHS) - len(e), DIMS), np.float32)])
        best, at = [], []
        for width, f in zip(WIDTHS, self.filters, strict=True):
            n = len(e) - width + 1
            z = e[:n] @ f[0]
            for k in range(1, width):
                z += e[k : k + n] @ f[k]
            where = z.argmax(axis=0)
            at.append(where)
            best.append(z[where, np.arange(FILTERS)])
        return np.concatenate(best) + self.bias, np.concatenate(at)

    def raw(self, rows: np.ndarray) -> float:
        pooled, _ = self._pool(self._embed(rows))
        return float(1 / (1 + np.exp(-np.clip(np.maximum(pooled, 0) @ self.out + self.base, -30, 30))))

    def language(self, rows: np.ndarray) -> int:
        return int(self.languages[rows[:, 0]].sum(axis=0).argmax()) if len(rows) else 0

    def score(self, rows: np.ndarray) -> float:
        """The raw score, bent so that the threshold of the text's language comes to 0.5."""
        p, t = self.raw(rows), float(self.thresholds[self.language(rows)])
        return 0.5 * p / t if p < t else 0.5 + 0.5 * (p - t) / (1 - t)

    def fit(self, texts: list[np.ndarray], labels: np.ndarray, seed: int = 4) -> Classifier:
        """Adagrad on single maxima: only the words that a filter chose get a gradient."""
        rng = np.random.default_rng(seed)
        sums = [np.full(v.shape, 1e-6, np.float32) for v in (self.table, *self.filters, self.bias, self.out)]
        base_sum = 1e-6
        weight = np.where(labels == 1, len(labels) / max(1, 2 * labels.sum()), len(labels) / max(1, 2 * (1 - labels).sum()))
        for _ in range(EPOCHS):
            shuffled = rng.permutation(len(texts))
            for start in range(0, len(texts), BATCH):
                batch = shuffled[start : start + BATCH]
                grads = [None, *(np.zeros_like(f) for f in self.filters), np.zeros_like(self.bias), np.zeros_like(self.out)]
                touched, steps, base = [], [], 0.0
                for i in batch:
                    rows = texts[i]
                    e = self._embed(rows)
                    pooled, at = self._pool(e)
                    held = np.maximum(pooled, 0)
                    p = 1 / (1 + np.exp(-np.clip(held @ self.out + self.base, -30, 30)))
                    off = float((p - labels[i]) * weight[i] / len(batch))
                    grads[-1] += off * held
                    base += off
                    back = off * self.out * (pooled > 0)
                    grads[-2] += back
                    if len(e) == 0:
                        continue
                    for k, (width, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
                        part, where = back[k * FILTERS : (k + 1) * FILTERS], at[k * FILTERS : (k + 1) * FILTERS]
                        for j in range(width):
                            spot = where + j
                            inside = spot < len(e)
                            grads[1 + k][j] += np.where(inside, 1, 0) * part * e[np.minimum(spot, len(e) - 1)].T
                            touched.append(rows[spot[inside]])
                            steps.append((f[j] * part).T[inside])
                for g, v, s in zip(grads[1:], (*self.filters, self.bias, self.out), sums[1:], strict=True):
                    s += g * g
                    v -= RATE * g / np.sqrt(s)
                base_sum += base * base
                self.base -= RATE * base / np.sqrt(base_sum)
                if touched:
                    rows, g = np.concatenate(touched), np.concatenate(steps)
                    flat, g = rows.ravel(), np.repeat(g, rows.shape[1], axis=0)
                    used, inverse = np.unique(flat, return_inverse=True)
                    total = np.zeros((len(used), DIMS), np.float32)
                    np.add.at(total, inverse, g)
                    total += DECAY * self.table[used]
                    sums[0][used] += total * total
                    self.table[used] -= 2 * RATE * total / np.sqrt(sums[0][used])
                    self.table[-1] = 0
        return self

    def learn_languages(self, texts: list[np.ndarray], names: list[str | None]) -> list[str]:
        """Log shares of hashed words by language, for guessing a text's language from its words."""
        known = sorted({n for n in names if n is not None}) or [""]
        counts = np.full((BUCKETS, len(known)), 0.2)
        for rows, name in zip(texts, names, strict=True):
            if name is not None:
                np.add.at(counts[:, known.index(name)], rows[:, 0], 1)
        self.languages = np.log(counts / counts.sum(axis=0)).astype(np.float32)
        return known

    def calibrate(self, texts: list[np.ndarray], labels: np.ndarray, classes: int, least: int = 12) -> None:
        """For each language the threshold that errs least on rows kept out of the fit; few positives: the overall one."""
        raw, spoken = np.array([self.raw(r) for r in texts]), np.array([self.language(r) for r in texts], int)

        def best(chosen: np.ndarray) -> float:
            order = np.sort(np.unique(np.concatenate([raw[chosen], [0.02, 0.98]])))
            cuts = np.clip((order[1:] + order[:-1]) / 2, 0.02, 0.98)
            wrong = [((raw[chosen] >= c) != labels[chosen]).sum() + 1e-3 * abs(c - 0.5) for c in cuts]
            return float(cuts[int(np.argmin(wrong))]) if len(cuts) else 0.5

        overall = best(np.ones(len(raw), bool)) if len(raw) else 0.5
        self.thresholds = np.array([best(spoken == k) if labels[spoken == k].sum() >= least else overall for k in range(classes)])


def train(rows: list[tuple[int, str | None, str | None, int]]) -> Classifier:
    """A classifier from labelled (doc_id, text, lang, toxic); every fifth row is kept for the thresholds."""
    words = Words()
    rows = sorted(rows, key=lambda r: (_hash(str(r[0]), 5), r[1] or ""))
    texts, labels = [words.of(r[1]) for r in rows], np.array([r[3] for r in rows], np.float64)
    model = Classifier()
    names = model.learn_languages(texts, [r[2] for r in rows])
    part = np.arange(len(rows)) % 5 == 0
    fit, held = np.flatnonzero(~part), np.flatnonzero(part)
    if len(fit):
        model.fit([texts[i] for i in fit], labels[fit])
        model.calibrate([texts[i] for i in held], labels[held], len(names))
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN) -> list[tuple]:
    """(doc_id, text, lang, toxic) of at most `toxic` and `clean` labelled rows whose crc32(doc_id) mod 5 isn't 0.

    Of rows that repeat a doc_id the one with the least hash of its text is taken.
    """
    marked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    marked = marked.where(crc_mod("doc_id", 5) != 0)
    few = [
        marked.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in ((1, toxic), (0, clean))
    ]
    chosen = F.broadcast(few[0].unionByName(few[1]))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    found = docs.select("doc_id", "text", lang.alias("lang")).join(chosen, "doc_id")
    one = F.min_by(F.struct("text", "lang", "toxic"), F.struct(F.xxhash64("text"), "lang"))
    return [tuple(r) for r in found.groupBy("doc_id").agg(one.alias("r")).select("doc_id", "r.*").collect()]


def _score(shared):
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        model, words = shared.value, Words()
        for part in slices(batches):
            scores = [model.score(words.of(t)) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores, pa.float64())], schema=schema)

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame | None = None, model: Classifier | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs, from its whole text alone.

    labels (doc_id, toxic) give the rows to learn from, see labelled_sample; of several labels of a document the highest
    holds. held_out says that a row's label can't have been learned (crc32(doc_id) mod 5 is 0). Null and empty texts get
    the score of a text without words. Null labels and labels of unknown documents are left out; without any, every score
    comes from the untrained network. Repeated rows score alike; other columns are ignored. An empty table gives no rows.
    """
    model = model or train(labelled_sample(docs, labels))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = rows.mapInArrow(_score(shared), "doc_id long, score double")
    held_out = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame | None = None, model: Classifier | None = None) -> DataFrame:
    """docs, with all their columns, without the rows that score_toxicity predicts to be toxic.

    Each row is judged by its own text, so rows without doc_id and rows that repeat one are too; null and empty texts are
    judged as texts without words. An empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or train(labelled_sample(docs, labels)))

    def make():
        classifier, words = shared.value, Words()
        return lambda text: classifier.score(words.of(text)) < 0.5

    return filtered(docs, make)
