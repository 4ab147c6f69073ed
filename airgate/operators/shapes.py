"""Shapes of several rings: composite projection, crossing of the 180th meridian, clipping to boxes, holes and areas.

Vertices are rows (shape, state, ring, seq, lon, lat), not closed. A ring is gathered into one array once it is projected;
everything after that is an expression over arrays, so a ring fits a row and no ring meets another but those of its shape.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Scale and centre of the map frame.
SCALE, CENTRE = 1300.0, (487.5, 305.0)
#: By state FIPS the standard parallels, rotation, centre (lon from the rotated meridian, lat), share of the
#: scale, offset of the inset and its box, both in scales from the frame's centre. "" is all other states.
FRAMES = {
    "02": (55.0, 65.0, 154.0, (-2.0, 58.5), 0.35, (-0.307, 0.201), (-0.425, 0.120, -0.214, 0.234)),
    "15": (8.0, 18.0, 157.0, (-3.0, 19.9), 1.0, (-0.205, 0.212), (-0.214, 0.166, -0.115, 0.234)),
    "72": (8.0, 18.0, 66.0, (0.0, 18.0), 1.0, (0.330, 0.232), (0.290, 0.190, 0.380, 0.260)),
    "": (29.5, 45.5, 96.0, (-0.6, 38.7), 1.0, (0.0, 0.0), (-0.455, -0.238, 0.455, 0.238)),
}


def frame(state: str) -> dict[str, float]:
    """The numbers of a state's projection: x = dx + s rho sin(n l), y = dy - s (rho0 - rho cos(n l)), and its box."""
    low, high, turn, (clon, clat), share, (ox, oy), box = FRAMES[state]
    sin0 = math.sin(math.radians(low))
    n = (sin0 + math.sin(math.radians(high))) / 2
    c = 1 + sin0 * (2 * n - sin0)
    rho0, s = math.sqrt(c) / n, SCALE * share
    rho = math.sqrt(c - 2 * n * math.sin(math.radians(clat))) / n
    cx, cy = rho * math.sin(math.radians(clon) * n), rho0 - rho * math.cos(math.radians(clon) * n)
    at = lambda x, y: (CENTRE[0] + x * SCALE, CENTRE[1] + y * SCALE)
    (tx, ty), (x0, y0), (x1, y1) = at(ox, oy), at(*box[:2]), at(*box[2:])
    return {"turn": turn, "n": n, "c": c, "rho0": rho0, "s": s, "dx": tx - s * cx, "dy": ty + s * cy, "x0": x0, "y0": y0, "x1": x1, "y1": y1}


def of_state(name: str) -> Column:
    """A number of the frame of the row's state."""
    out = F.lit(frame("")[name])
    for state in FRAMES:
        if state:
            out = F.when(F.col("state") == state, frame(state)[name]).otherwise(out)
    return out


def projected(vertices: DataFrame) -> DataFrame:
    """vertices with x, y in the frame; meridians are counted from the state's own, so that none is crossed at 180."""
    turned = F.col("lon") + of_state("turn")
    turned = F.when(turned > 180, turned - 360).when(turned < -180, turned + 360).otherwise(turned)
    n, s = of_state("n"), of_state("s")
    rho = F.sqrt(of_state("c") - 2 * n * F.sin(F.radians("lat"))) / n
    way = F.radians(turned) * n
    return vertices.withColumns({"x": of_state("dx") + s * rho * F.sin(way), "y": of_state("dy") - s * (of_state("rho0") - rho * F.cos(way))})


def unrolled(vertices: DataFrame) -> DataFrame:
    """vertices with lon running on over the 180th meridian instead of jumping by 360 degrees."""
    order = Window.partitionBy("shape", "ring").orderBy("seq")
    jump = F.col("lon") - F.lag("lon").over(order)
    turns = F.when(jump > 180, -1).when(jump < -180, 1).otherwise(0)
    held = vertices.withColumn("turns", F.sum(F.coalesce(turns, F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return held.withColumn("lon", F.col("lon") + 360 * F.col("turns")).drop("turns")


def rings(vertices: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """shape, state, ring, p: the points (x, y) of each ring in order."""
    point = F.struct("seq", F.col(x).alias("x"), F.col(y).alias("y"))
    held = vertices.groupBy("shape", "state", "ring").agg(F.array_sort(F.collect_list(point)).alias("p"))
    return held.withColumn("p", F.transform("p", lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))))


def _edges(p: Column) -> Column:
    """(a, b) for each point and the one after it, the last with the first."""
    return F.arrays_zip(p.alias("a"), F.concat(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 1, 1)).alias("b"))


def signed_area(p: Column) -> Column:
    """Half the sum of cross products: positive for a ring that turns from x towards y; 0 for fewer than three points."""
    cross = F.transform(_edges(p), lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])
    return F.aggregate(cross, F.lit(0.0), lambda s, c: s + c) / 2


def clipped(p: Column, axis: str, limit: Column, below: bool) -> Column:
    """The part of a ring on one side of a line (Sutherland and Hodgman): points inside, and where its edges cross.

    Works edge by edge, so for any ring; parts that fall apart stay joined along the line, which changes no area.
    """
    other = "y" if axis == "x" else "x"
    inside = lambda v: (v[axis] <= limit) if below else (v[axis] >= limit)

    def cut(e: Column) -> Column:
        a, b = e["a"], e["b"]
        t = (limit - a[axis]) / (b[axis] - a[axis])
        across = F.struct(*[(limit if c == axis else a[other] + t * (b[other] - a[other])).alias(c) for c in ("x", "y")])
        none = F.slice(F.array(b), 1, 0)
        return F.concat(F.when(inside(a) != inside(b), F.array(across)).otherwise(none), F.when(inside(b), F.array(b)).otherwise(none))

    return F.flatten(F.transform(_edges(p), cut))


def boxed(held: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column) -> DataFrame:
    """rings with p clipped to a box, side after side."""
    for axis, limit, below in (("x", x0, False), ("x", x1, True), ("y", y0, False), ("y", y1, True)):
        held = held.withColumn("p", clipped(F.col("p"), axis, limit, below))
    return held


def split_at_180(vertices: DataFrame) -> DataFrame:
    """rings in degrees, cut along the 180th meridian: side 0 west of it, 1 east, with lon in -180..180 again.

    A ring that doesn't reach the meridian has one side.
    """
    held = rings(unrolled(vertices), "lon", "lat")
    # Rings may have begun on either side; the meridian lies at 180 or at -180 of the way they run.
    at = F.when(F.exists("p", lambda v: v["x"] > 180), 180.0).when(F.exists("p", lambda v: v["x"] < -180), -180.0)
    held = held.withColumn("at", at)
    west = F.when(F.col("at").isNull(), F.col("p")).otherwise(clipped(F.col("p"), "x", F.coalesce("at", F.lit(180.0)), True))
    east = F.when(F.col("at").isNotNull(), clipped(F.col("p"), "x", F.coalesce("at", F.lit(180.0)), False))
    sides = held.select("shape", "state", "ring", "at", F.posexplode(F.array(west, east)).alias("side", "p")).where("size(p) > 2")
    shift = F.when((F.col("at") == 180) & (F.col("side") == 1), -360.0).when((F.col("at") == -180) & (F.col("side") == 0), 360.0).otherwise(0.0)
    return sides.withColumn("shift", shift).withColumn("p", F.expr("transform(p, v -> struct(v.x + shift as x, v.y as y))")).drop("shift", "at")


def drawn(held: DataFrame, least_area: float) -> Column:
    """Whether a projected ring is drawn: the mean of its points lies in its state's box, and its area is large enough."""
    mean = lambda c: F.aggregate("p", F.lit(0.0), lambda s, v: s + v[c]) / F.size("p")
    inside = mean("x").between(of_state("x0"), of_state("x1")) & mean("y").between(of_state("y0"), of_state("y1"))
    return inside & ((F.size("p") <= 2) | (F.abs(signed_area(F.col("p"))) >= least_area))


def holds(p: Column, at: Column) -> Column:
    """Whether a point lies in a ring: a ray from it crosses an odd number of edges."""

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        return ((a["y"] > at["y"]) != (b["y"] > at["y"])) & (at["x"] < (b["x"] - a["x"]) * (at["y"] - a["y"]) / (b["y"] - a["y"]) + a["x"])

    return F.size(F.filter(_edges(p), crosses)) % 2 == 1


def turned(held: DataFrame) -> DataFrame:
    """rings with area and hole: whether a ring turns the other way than the largest of its shape."""
    sized = held.withColumn("signed", signed_area(F.col("p")))
    way = sized.groupBy("shape").agg(F.signum(F.max_by("signed", F.struct(F.abs("signed"), -F.col("ring")))).alias("way"))
    return sized.join(way, "shape").select("shape", "ring", "p", F.abs("signed").alias("area"), (F.signum("signed") * F.col("way") < 0).alias("hole"))


def hole_owners(sized: DataFrame) -> DataFrame:
    """shape, ring, area, outer: each hole with the smallest ring of its shape that holds its first point.

    Holes meet the rings of their own shape only; a hole that no ring holds has no row.
    """
    holes = sized.where("hole").select("shape", "ring", "area", F.col("p")[0].alias("at"))
    outer = sized.where("not hole").select("shape", F.struct(F.col("area").alias("size"), F.col("ring").alias("ring")).alias("o"), "p")
    held = holes.join(outer, "shape").where(holds(F.col("p"), F.col("at")))
    return held.groupBy("shape", "ring").agg(F.first("area").alias("area"), F.min("o").alias("o")).select("shape", "ring", "area", F.col("o.ring").alias("outer"))


def shape_areas(held: DataFrame) -> DataFrame:
    """shape, n_rings, n_holes, n_stray, gross_area, area of shapes with holes.

    Each hole takes its area from the ring that holds it; a stray one, which no ring holds, takes nothing. gross_area adds up
    all rings without regard to holes.
    """
    sized = turned(held)
    taken = hole_owners(sized).groupBy("shape").agg(F.sum("area").alias("taken"), F.count("*").alias("n_owned"))
    whole = sized.groupBy("shape").agg(
        F.count("*").alias("n_rings"), F.count_if("hole").alias("n_holes"), F.sum("area").alias("gross_area"), F.sum(F.when(~F.col("hole"), F.col("area"))).alias("outside")
    )
    stray = F.col("n_holes") - F.coalesce("n_owned", F.lit(0))
    both = whole.join(taken, "shape", "left")
    return both.select("shape", "n_rings", "n_holes", stray.alias("n_stray"), "gross_area", (F.col("outside") - F.coalesce("taken", F.lit(0.0))).alias("area"))
