"""Language ID: nearest of several clustered centroids a language, by cosine of TF-IDF vectors of hashed character n-grams."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airgate.llm.common import crc_mod, mix, slices

#: Code points are folded to lower case, runs of non-letters to one space; n-grams of these lengths are hashed.
GRAMS, BUCKETS = (1, 2, 3), 8192
#: Labelled rows a language that the clusters are fitted on at most, and clusters a language.
SAMPLE, CLUSTERS, TURNS = 600, 4, 8
#: Share of a language's sample that lies nearer than the distance beyond which a text is rejected.
INSIDE = 0.995

_NO_LETTER = re.compile(r"[\W\d_]+")


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of a text's n-grams; none for a text without letters."""
    folded = _NO_LETTER.sub(" ", (text or "").lower()).strip()
    if not folded.replace(" ", "").isalpha():
        # Numerals such as a superscript or a fraction are word characters, but no letters.
        folded = " ".join("".join(c if c.isalpha() else " " for c in folded).split())
    if not folded:
        return np.zeros(0, np.int64), np.zeros(0)
    points = np.frombuffer(f" {folded} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    counts = np.zeros(BUCKETS, np.int64)
    rolled = np.zeros(len(points), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        m = len(points) - n + 1
        if m <= 0:
            break
        rolled = rolled[:m] * np.uint64(0x100000001B3) + points[n - 1 :] + np.uint64(n)
        if n in GRAMS:
            counts += np.bincount((mix(rolled) >> np.uint64(40)).astype(np.int64) % BUCKETS, minlength=BUCKETS)
    found = np.flatnonzero(counts)
    return found, counts[found].astype(float)


def vector(found: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weights of the buckets found: (1 + ln count) * idf, of length 1."""
    w = (1 + np.log(counts)) * idf[found]
    return w / max(1e-12, float(np.sqrt(w @ w)))


class Centroids:
    def __init__(self, languages: list[str], centres: np.ndarray, owner: np.ndarray, far: np.ndarray, idf: np.ndarray):
        self.languages, self.centres, self.owner, self.far, self.idf = languages, centres, owner, far, idf

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language (`und` without a letter), cosine with its nearest centroid, and whether that is too far away."""
        found, counts = gram_counts(text)
        if not len(found) or not len(self.languages):
            return "und", 0.0, True
        near = vector(found, counts, self.idf) @ self.centres[found]
        k = int(near.argmax())
        score = float(np.clip(near[k], 0, 1))
        return self.languages[self.owner[k]], score, 1 - score > self.far[self.owner[k]]


def fit(sample: list[tuple[str | None, str]], idf: np.ndarray, clusters: int = CLUSTERS, seed: int = 8) -> Centroids:
    """Spherical k-means in each language of (text, language)."""
    rng = np.random.default_rng(seed)
    languages = sorted({lang for _, lang in sample})
    centres, owner, far = [], [], []
    for k, lang in enumerate(languages):
        rows = np.zeros((sum(x == lang for _, x in sample), BUCKETS), np.float32)
        for row, text in zip(rows, (t for t, x in sample if x == lang), strict=True):
            found, counts = gram_counts(text)
            if len(found):
                row[found] = vector(found, counts, idf)
        rows = rows[rows.any(axis=1)]
        if not len(rows):
            far.append(1.0)
            continue
        middle = rows[rng.choice(len(rows), min(clusters, len(rows)), replace=False)]
        for _ in range(TURNS):
            nearest = (rows @ middle.T).argmax(axis=1)
            for c in range(len(middle)):
                if (nearest == c).any():
                    s = rows[nearest == c].sum(axis=0)
                    middle[c] = s / np.sqrt(s @ s)
        far.append(float(np.quantile(1 - (rows @ middle.T).max(axis=1), INSIDE)))
        centres.append(middle)
        owner += [k] * len(middle)
    stacked = np.concatenate(centres).T.copy() if centres else np.zeros((BUCKETS, 0), np.float32)
    return Centroids(languages if centres else [], stacked, np.array(owner, int), np.array(far), idf)


def _frequencies(batches):
    total, rows = np.zeros(BUCKETS, np.int64), 0
    for part in slices(batches):
        for text in part.column("text").to_pylist():
            found, _ = gram_counts(text)
            total[found] += 1
            rows += 1
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], rows))], names=["bucket", "n"])


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """ln((1 + rows) / (1 + rows with the n-gram)) + 1 of each bucket, over all rows; at most BUCKETS sums reach the driver."""
    made = docs.select("text").mapInArrow(_frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    held = {r["bucket"]: r["n"] for r in made.collect()}
    rows, counts = held.pop(-1, 0) or 0, np.zeros(BUCKETS)
    for b, n in held.items():
        counts[b] = n
    return np.log((1 + rows) / (1 + counts)) + 1


def train(docs: DataFrame, sample: int = SAMPLE, clusters: int = CLUSTERS) -> Centroids:
    """Learns from rows with lang whose crc32(doc_id) mod 3 isn't 1: frequencies from all, clusters from a sample.

    The sample is at most `sample` rows a language, those with the lowest hashes of doc_id and text, so rows that share a
    doc_id are drawn one by one; of rows equal in both one is drawn. No more than the sample reaches the driver.
    """
    learn = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.coalesce(crc_mod("doc_id", 3) != 1, F.lit(False)))
    idf = inverse_frequencies(learn)
    drawn = learn.select("lang", "text", F.xxhash64("doc_id", "text").alias("draw"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    lowest = drawn.select("lang", "draw").distinct().withColumn("place", place).where(F.col("place") <= sample)
    upto = {r["lang"]: r["upto"] for r in lowest.groupBy("lang").agg(F.max("draw").alias("upto")).collect()}
    if not upto:
        return fit([], idf, clusters)
    limit = F.element_at(F.create_map(*[F.lit(x) for pair in upto.items() for x in pair]), F.col("lang"))
    held = drawn.where(F.col("draw") <= limit).groupBy("lang", "draw").agg(F.min("text").alias("text")).collect()
    return fit([(r["text"], r["lang"]) for r in sorted(held, key=lambda r: (r["lang"], r["draw"]))], idf, clusters)


def _predict(shared):
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    def run(batches):
        model = shared.value
        for part in slices(batches):
            said = [model.predict(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64()), pa.array([s[2] for s in said], pa.bool_())],
                schema=schema,
            )

    return run


def identify_languages(docs: DataFrame, model: Centroids | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row, from its whole text alone.

    score is the cosine with the nearest centroid; rejected marks texts farther from it than nearly all of its language's
    own, whose lang_pred still names that nearest language. Null texts and texts without a letter are `und`, score 0,
    rejected. held_out marks rows that aren't learned from (crc32(doc_id) mod 3 is 1). Ties go to the language first in
    order; repeated rows are judged alike; other columns are ignored. An empty table gives no rows; with nothing to learn
    from every row is `und`.
    """
    model = model or train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    said = rows.mapInArrow(_predict(shared), "doc_id long, lang_pred string, score double, rejected boolean")
    return said.select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
