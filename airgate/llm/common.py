"""What the corpus operators share: tables, written intermediate results, hashing, Arrow slices, ranks and components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airgate.operators import graph
from airgate.operators.graph import shared_folder, written  # noqa: F401  the operators take them from here

#: White space of the word rule `[^\x20\x09-\x0D]+`, for Spark's regular expressions.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(columns: list[str], name: str) -> str:
    """name, with as many `_` behind it as no column has, whatever its case."""
    held = {c.lower() for c in columns}
    while name.lower() in held:
        name += "_"
    return name


def filtered(docs: DataFrame, make) -> DataFrame:
    """The rows of docs, with all their columns, whose text passes; make() gives a task its test of a text.

    Rows are judged one by one where they are read, so nothing is joined or shuffled and ids don't matter.
    """

    def run(batches):
        passes = make()
        for part in slices(batches):
            yield part.filter(pa.array([passes(t) for t in part.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the value as text, modulo n; null stays null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def word_count(column: str) -> Column:
    """How many words `[^\x20\x09-\x0D]+` a text has; null: 0."""
    words = F.split(F.coalesce(F.col(column), F.lit("")), SPACE)
    return F.size(words).cast("long") - F.size(F.filter(F.slice(words, 1, 1), lambda w: w == "")) - F.when(
        F.size(words) > 1, (F.element_at(words, -1) == "").cast("int")
    ).otherwise(0)


def slices(batches, size: int = 256):
    """Record batches in parts of at most `size` rows, so that Python holds few texts at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            yield batch.slice(start, size)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finaliser of splitmix64)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def ranked(ids: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """ids with `pos`, the 0-based rank by `key` (nulls first), without a window over everything.

    Rows are dealt by range, numbered within each range, and each range starts where the ones before it end;
    only one count per range reaches the driver.
    """
    spark = ids.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(ids.repartitionByRange(parts, key).withColumn("_part", F.spark_partition_id()))
    sizes = {r["_part"]: r["count"] for r in dealt.groupBy("_part").count().collect()}
    starts, total = [], 0
    for p in range(parts):
        starts.append(total)
        total += sizes.get(p, 0)
    start = F.element_at(F.array(*[F.lit(x).cast("long") for x in starts]), F.col("_part") + 1)
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(F.col(key).asc_nulls_first()))
    return dealt.withColumn("pos", start + inside - 1).drop("_part")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b) that has another: root is the least node that can be reached."""
    return graph.components(edges.where("a <> b"))
