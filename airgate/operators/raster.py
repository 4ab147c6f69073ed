"""Ground disturbance from pixel rows: indices, zones, verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Index changes that mark a pixel as disturbed, values that mark it as built.
NDVI_DROP, BRIGHT_RISE, BUILT_BRIGHT, BUILT_NDVI = 0.15, 0.03, 0.22, 0.15
#: Squared radii, in pixels around the tile's middle, of the area of interest and of its control ring; least pixels.
AOI, RING, LEAST_PIXELS = 6.0, 18.0, 50


def tiles(vectors: DataFrame) -> DataFrame:
    """Pixel rows before and after: each two vectors in a row are one site's 8 x 8 tile of reflectances."""
    px = vectors.select(F.expr("vec_id div 2").alias("site_id"), (F.col("vec_id") % 2).alias("half"), F.posexplode("embedding").alias("pos", "v"))
    both = px.groupBy("site_id", "pos").agg(
        F.max(F.when(F.col("half") == 0, F.col("v"))).cast("double").alias("b"), F.max(F.when(F.col("half") == 1, F.col("v"))).cast("double").alias("a"), F.count("*").alias("n")
    )
    grid = both.where("n = 2").select("site_id", F.expr("pos div 8").alias("r"), (F.col("pos") % 8).cast("long").alias("c"), F.abs("b").alias("b"), F.abs("a").alias("a"))
    for half, base in (("b", 0.3), ("a", 0.2)):
        red, nir = F.col(half) * 2, F.col(half) + base
        grid = grid.withColumns({f"ndvi_{half}": (nir - red) / (nir + red), f"bright_{half}": red / 2})
    disturbed = (F.col("ndvi_b") - F.col("ndvi_a") >= NDVI_DROP) | (F.col("bright_a") - F.col("bright_b") >= BRIGHT_RISE)
    built = (F.col("bright_a") >= BUILT_BRIGHT) & (F.col("ndvi_a") <= BUILT_NDVI)
    d2 = (F.col("r") - 3.5) * (F.col("r") - 3.5) + (F.col("c") - 3.5) * (F.col("c") - 3.5)
    return grid.withColumns({"disturbed": disturbed.cast("int"), "built": built.cast("int"), "zone": F.when(d2 <= AOI, "aoi").when(d2 <= RING, "ring")})


def zone_change(pixels: DataFrame) -> DataFrame:
    """Means of each zone of each site before and after, and its shares of disturbed and built pixels."""
    held = pixels.where("zone is not null").groupBy("site_id", "zone")
    return held.agg(F.count("*").alias("pixels"), F.avg("ndvi_b").alias("ndvi_before"), F.avg("ndvi_a").alias("ndvi_after"), F.avg("disturbed").alias("disturbed"), F.avg("built").alias("built"))


def verdicts(pixels: DataFrame) -> DataFrame:
    """How much more of the area of interest is disturbed than of its ring, and what that says."""
    at = lambda zone, c: F.avg(F.when(F.col("zone") == zone, F.col(c)))
    z = pixels.where("zone is not null").groupBy("site_id").agg((at("aoi", "disturbed") - at("ring", "disturbed")).alias("excess"), at("aoi", "built").alias("built"), F.count("*").alias("n"))
    e = F.col("excess")
    said = F.when(F.col("n") < LEAST_PIXELS, "insufficient").when((e >= 0.40) & (F.col("built") >= 0.15), "structures_present").when(e >= 0.15, "earthworks").when(e >= 0.05, "possible").otherwise("none")
    return z.select("site_id", "excess", said.alias("verdict"))


def top_blocks(pixels: DataFrame, side: int, most: int) -> DataFrame:
    """The blocks of side x side pixels with most disturbed pixels, the first `most` of each site."""
    blocks = pixels.groupBy("site_id", F.expr(f"r div {side}").alias("block_row"), F.expr(f"c div {side}").alias("block_col")).agg(F.sum("disturbed").alias("disturbed"))
    place = F.row_number().over(Window.partitionBy("site_id").orderBy(F.desc("disturbed"), "block_row", "block_col"))
    return blocks.withColumn("place", place).where(F.col("place") <= most).drop("place")
