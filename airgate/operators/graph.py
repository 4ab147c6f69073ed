"""Connected components of an edge table, and the written tables that cut their lineage.

checkpoint() would keep each plan's size estimates, which multiply from round to round.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rounds and jumps; both are logarithmic in the nodes, so 64-bit ids never come near it.
MOST = 130


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session (tests) gets a
    temporary one and a cluster an error, since a machine's own folder would be seen by none of the others."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set; it must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(base)
    return base


def written(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again: lineage ends there and a lost executor costs nothing of it.

    The files go when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/airgate/{uuid.uuid4().hex}"
    df.write.parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b); root is the least node in reach.

    Each round hooks every remaining node to its least neighbour, if that is less; follows the hooks to their ends, each
    jump doubling the way; and contracts the edges to these ends, until no edge is left. A node that stays alone in a round
    has a neighbour with a lesser end, so it is hooked in the next: the nodes at least halve in two rounds, in whatever
    order their ids are.
    """
    left = written(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    roots = None
    for _ in range(MOST):
        hooks = _ends(written(left.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("root"))))
        if roots is None:
            roots = hooks
        else:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("top"))
            roots = written(roots.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root")))
        a = hooks.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = hooks.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        left = written(left.join(a, "a").join(b, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
        if not left.limit(1).count():
            return roots
    raise RuntimeError(f"components: edges are left after {MOST} rounds")


def _ends(hooks: DataFrame) -> DataFrame:
    """hooks (node, root) with root replaced by the end of its way; hooks lead to lesser nodes, so each way has an end."""
    for _ in range(MOST):
        up = hooks.select(F.col("node").alias("root"), F.col("root").alias("top"))
        after = written(hooks.join(up, "root").select("node", F.col("top").alias("new"), "root"))
        hooks = after.select("node", F.col("new").alias("root"))
        if not after.where("new <> root").limit(1).count():
            return hooks
    raise RuntimeError(f"components: hooks go on after {MOST} jumps")
