"""A table of the latest row by key that a stream keeps up, rewriting only the parts of it that a micro-batch touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airgate.streaming.jobs import _folder

PARTS = 64


class PartedTable:
    """Rows by key in `parts` parts by the key's hash; each part has versions, one for each batch that touched it.

    A batch writes the parts it touches under its own number, and then a mark that names them; a part's version is the last
    marked one. So a batch of one key rewrites one part, a batch without its mark (it was lost on the way) is none, and one
    that is run again reads what was there before it and writes the same. Of rows with one key that with the greatest `order`
    stays, whichever batch brings it; on a tie that of the later batch. Rows without a key are left out.
    """

    def __init__(self, spark: SparkSession, folder: str, schema, key: str, order: str, parts: int = PARTS):
        self.spark, self.data, self.marks = spark, f"{folder}/data", f"{folder}/marks"
        self.schema, self.key, self.order, self.parts = schema, key, order, parts

    def versions(self, before: int | None = None) -> dict[int, int]:
        """The number of the last batch that touched each part; at most `parts` rows reach the driver."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.marks)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return {}
        held = self.spark.read.schema("part int, number long").parquet(f"{self.marks}/*")
        if before is not None:
            held = held.where(F.col("number") < before)
        return {r["part"]: r["number"] for r in held.groupBy("part").agg(F.max("number").alias("number")).collect()}

    def read(self, only: set[int] | None = None, before: int | None = None) -> DataFrame:
        """The table, or the parts in `only`, as it was before a batch; other versions' files are not opened."""
        at = [f"{self.data}/number={n}/part={p}" for p, n in sorted(self.versions(before).items()) if only is None or p in only]
        return self.spark.read.schema(self.schema).parquet(*at) if at else self.spark.createDataFrame([], self.schema)

    def merge(self, batch: DataFrame, number: int) -> list[int]:
        """Takes up a batch; the parts that it touched."""
        part = F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int")
        new = batch.where(F.col(self.key).isNotNull()).select(*[f.name for f in self.schema.fields])
        touched = sorted(r["part"] for r in new.select(part.alias("part")).distinct().collect())
        if not touched:
            return []
        both = self.read(set(touched), number).withColumn("later", F.lit(0)).unionByName(new.withColumn("later", F.lit(1)))
        rest = [f.name for f in self.schema.fields if f.name != self.key]
        last = both.groupBy(self.key).agg(F.max_by(F.struct(*rest), F.struct(self.order, "later")).alias("r")).select(self.key, "r.*")
        out = last.withColumns({"number": F.lit(number).cast("long"), "part": part})
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("number", "part").parquet(self.data)
        mark = self.spark.range(1, numPartitions=1).select(F.explode(F.array(*[F.lit(p) for p in touched])).alias("part"), F.lit(number).cast("long").alias("number"))
        mark.write.mode("overwrite").parquet(f"{self.marks}/{number}")
        return touched


def kept_up(rows: DataFrame, key: str, order: str, parts: int = PARTS, folder: str | None = None) -> PartedTable:
    """The table after all input there is; with the folder of an earlier run it goes on where that ended."""
    spark, folder = rows.sparkSession, folder or _folder(rows.sparkSession)
    table = PartedTable(spark, folder, rows.schema, key, order, parts)
    query = rows.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(lambda b, n: table.merge(b, n)).start()
    query.awaitTermination()
    return table
