"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Native: DataFrame functions only. Only totals reach the driver, a few numbers for each round of the filling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airgate.llm.common import free, ranked, word_count, written

#: Weights of the sources in order of their names, repeated as often as needed.
WEIGHTS = (3, 1, 2)
#: Hex digits of a document's draw that make its bin; the bin in which a source's quota runs out is ranked exactly.
BIN_DIGITS = 3
#: Sources whose targets are sent to every task; where there are more, the join shuffles.
MOST_BROADCAST = 10_000


def draw(key: Column, seed: int) -> Column:
    """The document's place in its source's seeded order, as hex text."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))


def water_fill(sources: DataFrame, budget: float, max_epochs: float) -> DataFrame:
    """sources (weight, source_size, ...) with `target`: budget shared by weight, none above max_epochs * source_size.

    Sources above their cap stop there and what they leave is shared by weight among the rest, until none is above.
    If all are capped, the targets are the caps and the rest of the budget goes unused.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    full_caps, open_weight = 0.0, None
    level = None
    while True:
        above = F.lit(False) if level is None else cap <= F.col("weight") * F.lit(level)
        got = sources.agg(
            F.sum(F.when(above, cap).otherwise(0.0)).alias("caps"), F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("weight")
        ).first()
        now = (float(got["caps"] or 0.0), got["weight"] or 0)
        if not now[1] or now == (full_caps, open_weight):
            break
        full_caps, open_weight = now
        level = (budget - full_caps) / open_weight
    if level is None:
        return sources.withColumn("target", F.lit(0.0))
    return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, max_epochs: float = 2.0, seed: int = 7
) -> DataFrame:
    """How often each document is taken: docs' doc_id and source with size, source_size, target, taken, repeats.

    size is the number of words of the text (null: 0). Sources are ordered by code point, null last (null is a source of
    its own), and weigh `weights` in turn; together they get `share` times all sizes. A source whose target is r times its
    size takes each document floor(r) times and, in seeded order, as many documents once more as bring its words nearest
    to the target. Copies of a row are rows of their own with equal draws; ties are broken by size and then by the text,
    and rows that agree in all that are alike. Documents without words are taken floor(r) times. Other columns are ignored.
    An empty table gives no rows.
    """
    rows = written(docs.select("doc_id", "source", word_count("text").alias("size"), F.xxhash64("text").alias("tie")))
    taken = _taken(rows, _targets(rows, weights, share, max_epochs, seed), seed, F.col("size"), F.col("size") > 0)
    taken = taken.withColumn("taken", F.col("repeats") * F.col("size"))
    return taken.select("doc_id", "source", "size", "source_size", "target", "taken", "repeats")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, max_epochs: float = 2.0, seed: int = 7) -> DataFrame:
    """docs, all columns, each row as often as mix_sources takes it, with its copy (1, 2, ...) and its source's target.

    Where docs have columns of these names, the new ones get `_` behind theirs. Texts are not shuffled, but for those in
    the bins in which the sources' quotas run out.
    """
    targets = _targets(written(docs.select("doc_id", "source", word_count("text").alias("size"))), weights, share, max_epochs, seed)
    rows = docs.select("doc_id", "source", F.xxhash64("text").alias("tie"), F.struct(*docs.columns).alias("row"))
    copy = free(docs.columns, "copy")
    # Words are counted again only in the bins that are ranked.
    has_words = F.coalesce(F.col("row.text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    taken = _taken(rows, targets, seed, word_count("row.text"), has_words).where("repeats > 0").select("row", "target", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))).alias("copy"))
    target = free([*docs.columns, copy], "target")
    return taken.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], F.col("copy").alias(copy), F.col("target").alias(target))


def _bin(key: Column, seed: int) -> Column:
    return F.substring(draw(key, seed), 1, BIN_DIGITS)


def _targets(rows: DataFrame, weights: tuple[int, ...], share: float, max_epochs: float, seed: int) -> DataFrame:
    """source, source_size, target, whole (times that it takes each document), quota (words that it takes once more), and
    the bin in which the quota runs out (null: none), with the words in the bins before it."""
    bins = written(rows.groupBy("source", _bin(F.col("doc_id"), seed).alias("bin")).agg(F.sum("size").alias("bin_size")))
    sizes = bins.groupBy("source").agg(F.sum("bin_size").alias("source_size"))
    named, unnamed = sizes.where("source is not null"), sizes.where("source is null")
    named = ranked(named, "source")
    last = named.count()
    sources = named.unionByName(unnamed.withColumn("pos", F.lit(last).cast("long")))
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("pos") % len(weights) + 1).cast("int"))
    sources = written(sources.withColumn("weight", turn))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    targets = water_fill(sources, share * total, max_epochs)
    size = F.col("source_size")
    targets = targets.withColumn("whole", F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("long"))
    targets = targets.withColumn("quota", F.col("target") - F.col("whole") * size)
    targets = written(targets.select("source", "source_size", "target", "whole", "quota"))
    before = F.sum("bin_size").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    placed = bins.withColumn("before", F.coalesce(before, F.lit(0))).join(targets.select(F.col("source").alias("_source"), "quota"), F.col("source").eqNullSafe(F.col("_source")))
    ends = placed.where("before + bin_size > quota").groupBy("_source").agg(F.min(F.struct("bin", "before")).alias("end"))
    ends = ends.select("_source", F.col("end.bin").alias("end"), F.col("end.before").alias("before"))
    joined = targets.join(ends, targets.source.eqNullSafe(ends["_source"]), "left").drop("_source")
    return written(joined)


def _taken(rows: DataFrame, targets: DataFrame, seed: int, size: Column, has_words: Column) -> DataFrame:
    """rows (doc_id, source, tie, ...) with source_size, target and repeats.

    Bins before the one in which a source's quota runs out are taken once more, those after it aren't, and its own rows are
    ranked one by one.
    """
    known = targets.withColumnRenamed("source", "_source")
    if targets.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        known = F.broadcast(known)
    joined = rows.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("_draw", draw(F.col("doc_id"), seed))
    bin_, last = F.substring("_draw", 1, BIN_DIGITS), F.col("end")
    rest = joined.where(last.isNull() | (bin_ != last)).withColumn("extra", F.coalesce(bin_ < last, F.lit(False)) & has_words)
    some = joined.where(bin_ == last).withColumn("_size", size)
    order = Window.partitionBy("source").orderBy("_draw", "_size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("before") + F.coalesce(F.sum("_size").over(order), F.lit(0))
    some = some.withColumn("extra", (before + F.col("_size") / 2 <= F.col("quota")) & (F.col("_size") > 0)).drop("_size")
    return rest.unionByName(some).withColumn("repeats", F.col("whole") + F.col("extra").cast("long"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('7:' || coalesce(doc_id::VARCHAR, '')) AS draw
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][1 + ((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3] AS weight
  FROM d GROUP BY source),
c AS (SELECT *, 2.0::DOUBLE * source_size AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM s),
o AS (
  SELECT *, coalesce(sum(cap) OVER w, 0) AS caps_before, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS weight_left
  FROM c WINDOW w AS (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (
  SELECT arg_min((budget - caps_before) / weight_left, cap / weight) FILTER (WHERE cap > weight * ((budget - caps_before) / weight_left)) AS level FROM o),
t AS (SELECT source, source_size, least(cap, weight * coalesce(level, 1e300::DOUBLE)) AS target FROM c, l),
r AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY draw, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       ((whole + (before + size / 2.0::DOUBLE <= target - whole * source_size)::BIGINT) * size)::BIGINT AS taken
FROM r
"""
