"""Centroid clustering: whole-number k-means whose assignment is the threshold algorithm.

For every dimension the centroids are listed by their value there. A vector walks each list outward from its own value, a
step a dimension at a time; every centroid that it meets gets its exact distance. The squared differences at the frontiers
add up to the least distance that a centroid can have that no list has shown yet, so a vector stops when that sum is
strictly more than its best exact distance: on a tie it goes on, since a lesser number may still come.

Spark reads the vectors, assigns them in Arrow batches and adds up whole numbers; what reaches the driver is a row a cluster
and dimension. All sums are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airgate.llm.common import written

CLUSTERS, ROUNDS, SCALE, DIMENSIONS = 8, 10, 1024, 64
#: Vectors that walk together.
BATCH = 2_048
#: Components up to here have distances, and sums over a batch, that a 64-bit number holds.
LARGEST = 1 << 27


def sound(vector: Column) -> Column:
    """True where there is a vector and none of its components is null, NaN or infinite."""
    infinite = F.lit(float("inf"))
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < infinite))
    return vector.isNotNull() & F.coalesce(good, F.lit(False))


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * float(scale)).cast("long"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of arrays of `width` longs."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if flat.size and max(int(flat.max()), -int(flat.min())) > LARGEST:
        raise ValueError(f"components beyond {LARGEST} (scaled) have distances that no 64-bit number holds")
    return flat.reshape(len(column), width)


class Walk:
    """The sorted lists of the centroids, a list a dimension."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.order = np.argsort(centroids, axis=0, kind="stable").T  # dimension, place -> centroid
        self.values = np.sort(centroids, axis=0).T

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each vector the nearest centroid, on a tie that of smallest number, and its squared distance."""
        n, dims = vectors.shape
        k = len(self.centroids)
        best = np.full(n, np.iinfo(np.int64).max)
        number = np.zeros(n, np.int64)
        # The next place to the left and to the right of the vector's value in each list.
        right = (self.values[None, :, :] < vectors[:, :, None]).sum(2)
        left = right - 1
        seen = np.zeros((n, k), bool)
        active, which = np.arange(n), np.arange(dims)[None, :]
        far = np.iinfo(np.int64).max
        while active.size:
            x, lo, hi = vectors[active], left[active], right[active]
            down = np.where(lo >= 0, x - self.values[which, np.maximum(lo, 0)], far)
            up = np.where(hi < k, self.values[which, np.minimum(hi, k - 1)] - x, far)
            go_down = down <= up
            step = np.where(go_down, down, up)  # of equal lengths all lists end at once
            met = self.order[which, np.where(go_down, np.maximum(lo, 0), np.minimum(hi, k - 1))]
            new = np.zeros((len(active), k), bool)
            new[np.arange(len(active))[:, None], met] = True
            new &= ~seen[active]
            for c in range(k):
                rows = np.flatnonzero(new[:, c])
                if rows.size:
                    exact = ((x[rows] - self.centroids[c]) ** 2).sum(1)
                    at = active[rows]
                    better = (exact < best[at]) | ((exact == best[at]) & (c < number[at]))
                    best[at[better]], number[at[better]] = exact[better], c
                    seen[at, c] = True
            left[active] = np.where(go_down, lo - 1, lo)
            right[active] = np.where(go_down, hi, hi + 1)
            # What a list showed last bounds all that it has not shown.
            stop = (step**2).sum(1) > best[active]
            active = active[~stop & ~seen[active].all(1)]
        return number, best


def _sums(centroids: np.ndarray):
    """Of each cluster that a task has met: its vectors, their distances, and each component, added up."""
    k, dims = centroids.shape

    def run(batches):
        walk = Walk(centroids)
        count, inertia, total = [0] * k, [0] * k, [[0] * dims for _ in range(k)]
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                vectors = matrix(batch.column(0).slice(start, BATCH), dims)
                number, distance = walk.nearest(vectors)
                for c in np.unique(number).tolist():
                    own = number == c
                    count[c] += int(own.sum())
                    inertia[c] += sum(distance[own].tolist())
                    total[c] = [a + b for a, b in zip(total[c], vectors[own].sum(0).tolist(), strict=True)]
        met = [c for c in range(k) if count[c]]
        rows = [(c, d, str(v)) for c in met for d, v in enumerate([count[c], inertia[c], *total[c]])]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())],
            names=["cluster", "what", "amount"],
        )

    return run


def totals(vectors: DataFrame, centroids: np.ndarray) -> dict[int, list[int]]:
    """By cluster: how many vectors it has, the sum of their distances, and the sum of each component."""
    parts = vectors.select("vector").mapInArrow(_sums(centroids), "cluster int, what int, amount string")
    out: dict[int, dict[int, int]] = {}
    for r in parts.groupBy("cluster", "what").agg(F.sum(F.col("amount").cast("decimal(38,0)")).alias("amount")).collect():
        out.setdefault(r["cluster"], {})[r["what"]] = int(r["amount"])
    return {c: [v[d] for d in sorted(v)] for c, v in out.items()}


def _assign(centroids: np.ndarray):
    def run(batches):
        walk = Walk(centroids)
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                part = batch.slice(start, BATCH)
                number, distance = walk.nearest(matrix(part.column(1), centroids.shape[1]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(number, pa.int32()), pa.array(distance, pa.int64())], names=["vec_id", "cluster", "distance"])

    return run


def cluster_vectors(
    embeddings: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, dimensions: int = DIMENSIONS, salt: str = "3",
    watch: Callable[[np.ndarray], None] | None = None,
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector of `dimensions` finite components.

    Components become floor(scale * x). Centroids start as the vectors with the smallest hashes sha256(salt:vec_id), in that
    order; of rows with one vec_id that with the lesser vector comes first, and rows without vec_id come last. Each round
    assigns every vector to its nearest centroid, the smaller number on a tie, and moves every centroid that has vectors to
    floor(sum / count) of each component; after the rounds the vectors are assigned once more. Vectors that are null, of
    another length, or hold a null or non-finite component have no row. Repeated rows count as often as they stand. With
    fewer vectors than clusters there are as many clusters as vectors; an empty table gives no rows. Components beyond
    LARGEST (scaled) raise an error. Other columns are ignored. `watch` is told the centroids of each round.
    """
    vector = F.col("embedding")
    held = embeddings.where(sound(vector) & (F.size(vector) == dimensions)).select(F.col("vec_id").cast("long").alias("vec_id"), whole(vector, scale).alias("vector"))
    held = written(held)
    place = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = held.select(place.alias("place"), "vector").orderBy(F.col("place").asc_nulls_last(), "vector").limit(clusters).collect()
    if not first:
        return held.select("vec_id", *[F.lit(0).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"))], F.lit("").alias("centroid_sha256"))
    centroids = np.array([r["vector"] for r in first], np.int64)
    for _ in range(rounds):
        for c, (count, _, *sums) in totals(held, centroids).items():
            centroids[c] = [s // count for s in sums]
        if watch:
            watch(centroids.copy())
    found = totals(held, centroids)
    of = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster") + 1)
    by_cluster = [found[c][1] if c in found else 0 for c in range(len(centroids))]
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    return held.mapInArrow(_assign(centroids), "vec_id long, cluster int, distance long").select(
        "vec_id",
        "cluster",
        "distance",
        of(by_cluster, "long").alias("cluster_inertia"),
        F.lit(sum(by_cluster)).cast("long").alias("inertia"),
        of(hashes, "string").alias("centroid_sha256"),
    )


def _oracle(clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, dimensions: int = DIMENSIONS, salt: str = "3") -> str:
    """The rounds one after the other: all distances, the least of them, the floors of the means."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""near_{r} AS MATERIALIZED (
  SELECT rid, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d FROM (
    SELECT v.rid, c.cluster, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS d FROM cells v JOIN at_{r} c USING (dim) GROUP BY v.rid, c.cluster
  ) GROUP BY rid
)""")
        if r < rounds:
            steps.append(f"""at_{r + 1} AS MATERIALIZED (
  SELECT a.cluster, a.dim, coalesce(m.x, a.x) AS x FROM at_{r} a LEFT JOIN (
    SELECT n.cluster, v.dim, CASE WHEN sum(v.x) >= 0 THEN sum(v.x)::BIGINT // count(*) ELSE -((-sum(v.x)::BIGINT + count(*) - 1) // count(*)) END AS x
    FROM near_{r} n JOIN cells v USING (rid) GROUP BY n.cluster, v.dim
  ) m ON a.cluster = m.cluster AND a.dim = m.dim
)""")
    joined = ",\n".join(steps)
    return f"""
WITH held AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cells AS MATERIALIZED (
  SELECT rid, unnest(range(1, {dimensions} + 1)) AS dim, unnest(v) AS x FROM held
), firsts AS (
  SELECT rid, row_number() OVER (ORDER BY sha256('{salt}:' || vec_id) NULLS LAST, v) - 1 AS cluster FROM held
), at_0 AS MATERIALIZED (
  SELECT f.cluster, c.dim, c.x FROM firsts f JOIN cells c USING (rid) WHERE f.cluster < {clusters}
),
{joined},
told AS (
  SELECT a.cluster, sha256(string_agg(a.x::VARCHAR, ',' ORDER BY a.dim)) AS h FROM at_{rounds} a GROUP BY a.cluster
)
SELECT h.vec_id, n.cluster::INTEGER AS cluster, n.d AS distance, (sum(n.d) OVER (PARTITION BY n.cluster))::BIGINT AS cluster_inertia,
  (sum(n.d) OVER ())::BIGINT AS inertia, t.h AS centroid_sha256
FROM near_{rounds} n JOIN held h USING (rid) JOIN told t ON t.cluster = n.cluster
"""


ORACLE = _oracle()
