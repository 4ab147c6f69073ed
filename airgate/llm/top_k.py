"""Exact top-k by inner product over an impact-ordered index, a score at a time.

A block of vectors is indexed by dimension: its values there are quantised to LEVELS steps, and the rows of one step are a
posting segment. For a query a segment's impact is what its best value can add to the least that the dimension adds anyway.
Segments are processed by descending impact, whatever their dimension, and add their impact to the accumulators of their
rows. A row that has met m of the D dimensions can still gain at most (D - m) times the next segment's impact, so the sum is
a bound of its score. Rows whose bound is under the k-th best exact score that is known are proven not to belong to the
result. Processing stops only when the rows that are left are few enough to score exactly, or no segment is left; then all of
them are scored.

The queries are sent out in blocks of bounded size; every task indexes the vectors that it reads in blocks and keeps the best
of each query, and Spark merges these by query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airgate.llm.centroids import sound, whole
from airgate.llm.common import written

BEST, SCALE, EVERY = 5, 256, 50
#: Steps to which a dimension's values are quantised, and vectors that are indexed together.
LEVELS, BLOCK = 24, 4_096
#: Queries that are sent out at once, and rows of the first vectors that give each of them a first threshold.
QUERIES, SAMPLE = 8_192, 2_048
#: Shares of a block's postings after which the bounds are compared, and the share of rows that are few enough to be scored.
STOPS, FEW = (0.2, 0.35, 0.5, 0.65, 0.8), 0.125
#: Scores up to here are exact in every step.
LARGEST = 1 << 52


class ImpactIndex:
    """A block of whole-number vectors of one length, as posting segments by dimension and quantised value."""

    def __init__(self, vectors: np.ndarray, levels: int = LEVELS):
        self.vectors = vectors
        n, dims = vectors.shape
        self.low, high = vectors.min(0), vectors.max(0)
        self.high = high
        level = (vectors - self.low) * levels // (high - self.low + 1)
        self.rows = np.argsort(level, axis=0, kind="stable").T.ravel()  # dimension after dimension, by level
        sizes = np.stack([np.bincount(level[:, d], minlength=levels) for d in range(dims)])
        self.starts = (np.cumsum(sizes.ravel()) - sizes.ravel()).reshape(sizes.shape)
        self.sizes = sizes
        ordered = vectors.T.ravel()[self.rows + np.repeat(np.arange(dims) * n, n)]
        # The least and greatest value of each segment; empty segments are never processed.
        held = np.flatnonzero(sizes.ravel())
        self.least, self.most = np.zeros(dims * levels, np.int64), np.zeros(dims * levels, np.int64)
        if held.size:
            self.least[held] = np.minimum.reduceat(ordered, self.starts.ravel()[held])
            self.most[held] = np.maximum.reduceat(ordered, self.starts.ravel()[held])
        self.least, self.most = self.least.reshape(sizes.shape), self.most.reshape(sizes.shape)
        self.dims = np.arange(dims)

    def possible(self, query: np.ndarray, threshold: int | None, best: int) -> np.ndarray:
        """Rows that may reach the threshold, or the best by the sums so far where none is known yet."""
        n = len(self.vectors)
        up = query[:, None] >= 0
        impact = np.where(up, query[:, None] * (self.most - self.low[:, None]), query[:, None] * (self.least - self.high[:, None])).ravel()
        base = int(np.where(query >= 0, query * self.low, query * self.high).sum())
        sizes, starts = self.sizes.ravel(), self.starts.ravel()
        order = np.argsort(-impact, kind="stable")
        order = order[sizes[order] > 0]
        impact, sizes, starts = impact[order], sizes[order], starts[order]
        done = np.cumsum(sizes)
        sums, met = np.zeros(n), np.zeros(n, np.int64)
        at = 0
        for share in (*STOPS, 1.0):
            to = min(int(np.searchsorted(done, share * done[-1], "left")) + 1, len(order))
            if to > at:
                some = sizes[at:to]
                shift = np.repeat(starts[at:to] - (np.cumsum(some) - some), some)
                rows = self.rows[shift + np.arange(len(shift))]
                sums += np.bincount(rows, np.repeat(impact[at:to], some).astype(np.float64), n)
                met += np.bincount(rows, minlength=n)
                at = to
            if threshold is None:
                # The rows that lead after the first segments give a threshold, by their exact scores.
                lead = np.argpartition(-sums, min(best, n - 1))[: best + 1] if n > best else np.arange(n)
                if n <= best:
                    return lead
                exact = np.sort(self.vectors[lead] @ query)
                threshold = int(exact[-best])
            left = int(impact[at]) if at < len(order) else 0
            bound = sums + (len(query) - met) * float(left) + base
            kept = np.flatnonzero(bound >= threshold)
            if len(kept) <= FEW * n or at == len(order):
                return kept
        return kept


def _padded(columns: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(columns), width), np.int64)
    for r, c in enumerate(columns):
        out[r, : min(len(c), width)] = c[:width]
    return out


def _search(shared, best: int):
    """The best + 1 rows of this task for every query, by score, then vec_id, nulls last."""
    names = ["query", "vec_id", "score", "own"]
    none = np.iinfo(np.int64).max  # stands for a null vec_id

    def run(batches):
        queries, ids, thresholds = shared.value
        width = queries.shape[1]
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, bool))] * len(queries)
        limit = list(thresholds)
        most = int(np.abs(queries).max(initial=0))

        def process(vectors: list[np.ndarray], keys: list[int | None]) -> None:
            block = _padded(vectors, width)
            if most * int(np.abs(block).max(initial=0)) * max(width, 1) > LARGEST:
                raise ValueError(f"scores beyond {LARGEST} are not exact")
            index = ImpactIndex(block)
            nulls = np.array([k is None for k in keys])
            known = np.array([none if k is None else k for k in keys], np.int64)
            whole_length = np.array([len(v) for v in vectors])
            for q, query in enumerate(queries):
                rows = index.possible(query, limit[q], best + 1)
                if not len(rows):
                    continue
                score = block[rows] @ query
                if limit[q] is not None:
                    good = score >= limit[q]
                    rows, score = rows[good], score[good]
                key, nil = known[rows], nulls[rows]
                own = ~nil & (key == ids[q][0]) & (whole_length[rows] == ids[q][1])
                own[own] = (block[rows[own]] == query).all(1)
                old = found[q]
                score, key, nil, own = (np.concatenate(p) for p in zip(old, (score, key, nil, own), strict=True))
                order = np.lexsort((key, nil, -score))[: best + 1]
                found[q] = score[order], key[order], nil[order], own[order]
                if len(order) > best:
                    limit[q] = int(score[order[-1]])

        vectors, keys = [], []
        for batch in batches:
            offsets = batch.column(1).offsets.to_numpy()
            flat = batch.column(1).values.to_numpy(zero_copy_only=False).astype(np.int64)
            for key, a, b in zip(batch.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                vectors.append(flat[a:b])
                keys.append(key)
                if len(vectors) == BLOCK:
                    process(vectors, keys)
                    vectors, keys = [], []
        if vectors:
            process(vectors, keys)
        out = [(q, None if nil else key, s, own) for q, f in enumerate(found) for s, key, nil, own in zip(*(x.tolist() for x in f), strict=True)]
        for start in range(0, len(out), 10_000):
            columns = list(zip(*out[start : start + 10_000], strict=True))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


def top_k(queries: DataFrame, vectors: DataFrame, best: int = BEST, at_once: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: each query's `best` vectors by inner product, ties to the smaller vec_id.

    queries (query_id, vector) and vectors (vec_id, vector) hold whole-number vectors; a dimension that one of two vectors
    lacks adds nothing. One row of vectors that equals the query in id and vector is the query's own and left out. Every row
    of queries has its result, also where ids repeat or are null; vectors without vec_id come last among equal scores. With
    fewer vectors than `best` all are returned. Queries are sent out `at_once` at a time, so passes over the vectors grow with
    their number and memory doesn't. Scores beyond LARGEST raise an error. An empty table on either side gives no rows.
    """
    spark = vectors.sparkSession
    # Numbered by where they were written: only one count for each part reaches the driver.
    laid = written(queries.select(F.col("query_id").cast("long").alias("query_id"), "vector").withColumn("m", F.monotonically_increasing_id()))
    counts = {r["p"]: r["count"] for r in laid.groupBy(F.shiftright("m", 33).alias("p")).count().collect()}
    starts, total = {}, 0
    for p in sorted(counts):
        starts[p] = total
        total += counts[p]
    out = None
    for first in range(0, total, at_once):
        upto, wanted = min(first + at_once, total), []
        # Parts that hold the queries first to upto, and their share.
        for p, start in starts.items():
            a, b = max(first, start), min(upto, start + counts[p])
            if a < b:
                wanted.append(F.col("m").between((p << 33) + (a - start), (p << 33) + (b - 1 - start)))
        some = wanted[0]
        for w in wanted[1:]:
            some = some | w
        rows = laid.where(some).collect()
        width = max(1, *(len(r["vector"]) for r in rows))
        packed = _padded([np.array(r["vector"], np.int64) for r in rows], width)
        ids = [(r["query_id"], len(r["vector"])) for r in rows]
        sample = vectors.select("vector").limit(SAMPLE).collect()
        block = _padded([np.array(r["vector"], np.int64) for r in sample], width)
        # A query's own row may be in the sample: the best + 1 of it are no more than the best + 1 of all.
        limits = [int(np.partition(block @ q, -best - 1)[-best - 1]) if len(block) > best else None for q in packed]
        shared = spark.sparkContext.broadcast((packed, ids, limits))
        found = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "vector").mapInArrow(_search(shared, best), "query long, vec_id long, score long, own boolean")
        order = [F.col("score").desc(), F.col("vec_id").asc_nulls_last(), F.col("own").desc()]
        found = found.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("place") <= best + 1)
        # Of equal rows with the query's id and vector one is its own; after it all move up by one.
        own = F.min(F.when(F.col("own"), F.col("place"))).over(Window.partitionBy("query"))
        found = found.withColumn("self", own).where(F.col("self").isNull() | (F.col("place") != F.col("self")))
        rank = F.col("place") - F.when(F.col("place") > F.col("self"), 1).otherwise(0)
        id_of = F.element_at(F.array(*[F.lit(i).cast("long") for i, _ in ids]), (F.col("query") + 1).cast("int"))
        found = found.select(id_of.alias("query_id"), rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= best)
        if total > at_once:
            found = written(found)
            shared.unpersist()
        out = found if out is None else out.unionByName(found)
    if out is None:
        empty = laid.select("query_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("score"))
        return empty.where("rank > 0")
    return out


def nearest_of_set(embeddings: DataFrame, best: int = BEST, scale: int = SCALE, every: int = EVERY) -> DataFrame:
    """top_k of every row whose vec_id is divisible by `every`, against all rows; components become floor(scale * x).

    Vectors that are null or hold a null or non-finite component take no part; other columns are ignored.
    """
    vector = F.col("embedding")
    held = embeddings.where(sound(vector)).select(F.col("vec_id").cast("long").alias("vec_id"), whole(vector, scale).alias("vector"))
    queries = held.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "vector")
    return top_k(queries, held, best)


ORACLE = f"""
WITH held AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM held q JOIN held c ON q.rid <> c.rid WHERE q.vec_id % {EVERY} = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM scored
) WHERE rank <= {BEST}
"""
