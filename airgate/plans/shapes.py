"""Registered jobs on shapes of several rings, made of suppliers: a body with a hole, an island with a hole, a stray hole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgate.operators import shapes
from airgate.plans.base import registered, shown
from airgate.sources.derived import read

#: Rings as (number, offset in radii north, offset in radii east, radius in radii, way round, which suppliers have it).
_RINGS = ((0, 0.0, 0.0, 1.0, 1, 1), (1, 0.1, 0.0, 0.5, -1, 3), (2, 0.4, 2.2, 0.4, 1, 1), (3, 0.4, 2.25, 0.2, -1, 2), (4, -3.0, 0.0, 0.3, -1, 5))
_LEAST = 40.0

_PLACES = """places AS (SELECT s_suppkey AS shape, ['02', '15', '72', '06', '48', '36', '12', '08'][(s_suppkey % 8 + 1)::INT] AS state, 0.5 + s_suppkey % 3 AS r,
  CASE s_suppkey % 8 WHEN 0 THEN 57 + s_suppkey % 9 WHEN 1 THEN 20.5 WHEN 2 THEN 18.2 ELSE 28 + s_suppkey * 7 % 19 END::DOUBLE AS clat,
  CASE s_suppkey % 8 WHEN 0 THEN -160 - s_suppkey % 23 WHEN 1 THEN -157 WHEN 2 THEN -66.4 ELSE -122 + s_suppkey * 11 % 48 END::DOUBLE AS clon FROM supplier)"""
_VERTICES = f"""{_PLACES}, vertices AS (SELECT shape, state, ring, (j + 1)::INT AS seq, ((clon + east * r + size * r * cos(radians((way * 30 * j)::DOUBLE)) + 540) % 360) - 180 AS lon,
  clat + north * r + size * r * sin(radians((way * 30 * j)::DOUBLE)) AS lat FROM places, (SELECT unnest(range(0, 12)) AS j),
  (VALUES {', '.join(f"({n}, {a!r}::DOUBLE, {b!r}::DOUBLE, {s!r}::DOUBLE, {w}, {m})" for n, a, b, s, w, m in _RINGS)}) AS k(ring, north, east, size, way, every) WHERE shape % every = 0)"""


def _of(name: str) -> str:
    cases = " ".join(f"WHEN '{s}' THEN {shapes.frame(s)[name]!r}::DOUBLE" for s in shapes.FRAMES if s)
    return f"CASE state {cases} ELSE {shapes.frame('')[name]!r}::DOUBLE END"


_PROJECTED = f"""{_VERTICES}, turned AS (SELECT *, lon + {_of('turn')} AS t FROM vertices),
rho AS (SELECT *, sqrt({_of('c')} - 2 * {_of('n')} * sin(radians(lat))) / {_of('n')} AS rho, radians(CASE WHEN t > 180 THEN t - 360 WHEN t < -180 THEN t + 360 ELSE t END) * {_of('n')} AS way FROM turned),
projected AS (SELECT shape, state, ring, seq, {_of('dx')} + {_of('s')} * rho * sin(way) AS x, {_of('dy')} - {_of('s')} * ({_of('rho0')} - rho * cos(way)) AS y FROM rho)"""
_AREA = "coalesce(list_sum(list_transform(range(1, len(p) + 1), lambda i: p[i].x * p[i % len(p) + 1].y - p[i % len(p) + 1].x * p[i].y)), 0) / 2"


def _clip(source: str, name: str, axis: str, limit: str, below: bool) -> str:
    """A common table expression `name` over `source` whose rings are cut at axis = limit."""
    sign, other = "<=" if below else ">=", "y" if axis == "x" else "x"
    a, b = "p[i]", "p[i % len(p) + 1]"
    met = f"{a}.{other} + ({limit} - {a}.{axis}) / ({b}.{axis} - {a}.{axis}) * ({b}.{other} - {a}.{other})"
    across = f"{{'x': {limit}, 'y': {met}}}" if axis == "x" else f"{{'x': {met}, 'y': {limit}}}"
    return f"""{name} AS (SELECT * EXCLUDE (p), flatten(list_transform(range(1, len(p) + 1), lambda i: list_concat(
  CASE WHEN ({a}.{axis} {sign} {limit}) <> ({b}.{axis} {sign} {limit}) THEN [{across}] ELSE [] END, CASE WHEN {b}.{axis} {sign} {limit} THEN [{b}] ELSE [] END))) AS p FROM {source})"""


_RINGED = f"""{_PROJECTED}, rings AS (SELECT shape, state, ring, list({{'x': x, 'y': y}} ORDER BY seq) AS p FROM projected GROUP BY 1, 2, 3)"""


def _vertices(spark, sf_dir) -> DataFrame:
    k = F.col("s_suppkey")
    states = F.array(*[F.lit(s) for s in ("02", "15", "72", "06", "48", "36", "12", "08")])
    lat = F.when(k % 8 == 0, 57.0 + k % 9).when(k % 8 == 1, 20.5).when(k % 8 == 2, 18.2).otherwise((28 + k * 7 % 19).cast("double"))
    lon = F.when(k % 8 == 0, -160.0 - k % 23).when(k % 8 == 1, -157.0).when(k % 8 == 2, -66.4).otherwise((-122 + k * 11 % 48).cast("double"))
    places = read(spark, sf_dir, "supplier").select(k.alias("shape"), F.element_at(states, (k % 8 + 1).cast("int")).alias("state"), (0.5 + k % 3).alias("r"), lat.alias("clat"), lon.alias("clon"))
    kinds = F.array(*[F.struct(*[F.lit(x).alias(c) for c, x in zip(("ring", "north", "east", "size", "way", "every"), row, strict=True)]) for row in _RINGS])
    rows = places.select("*", F.inline(kinds)).where(F.col("shape") % F.col("every") == 0).select("*", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("j"))
    way = F.radians((F.col("way") * 30 * F.col("j")).cast("double"))
    lon = (F.col("clon") + F.col("east") * F.col("r") + F.col("size") * F.col("r") * F.cos(way) + 540) % 360 - 180
    return rows.select("shape", "state", "ring", (F.col("j") + 1).alias("seq"), lon.alias("lon"), (F.col("clat") + F.col("north") * F.col("r") + F.col("size") * F.col("r") * F.sin(way)).alias("lat"))


@registered(f"""WITH {_PROJECTED} SELECT shape, ring, seq, round(x + 1e-7::DOUBLE, 4) AS x, round(y + 1e-7::DOUBLE, 4) AS y FROM projected""")
def scl_m6_composite_points(spark, sf_dir):
    return shapes.projected(_vertices(spark, sf_dir)).select("shape", "ring", "seq", shown("x").alias("x"), shown("y").alias("y"))


@registered(f"""WITH {_RINGED}, edged AS (SELECT *, abs({_AREA}) AS area, {_of('x0')} AS x0, {_of('y0')} AS y0, {_of('x1')} AS x1, {_of('y1')} AS y1 FROM rings),
shown AS (SELECT *, list_avg(list_transform(p, lambda v: v.x)) BETWEEN x0 AND x1 AND list_avg(list_transform(p, lambda v: v.y)) BETWEEN y0 AND y1 AND area >= {_LEAST} AS drawn FROM edged),
{_clip('shown', 'c1', 'x', 'x0', False)}, {_clip('c1', 'c2', 'x', 'x1', True)}, {_clip('c2', 'c3', 'y', 'y0', False)}, {_clip('c3', 'c4', 'y', 'y1', True)}
SELECT shape, ring, drawn, round(area + 1e-7::DOUBLE, 3) AS area, round(abs({_AREA}) + 1e-7::DOUBLE, 3) AS inside FROM c4""")
def scl_m6_boxed_rings(spark, sf_dir):
    held = shapes.rings(shapes.projected(_vertices(spark, sf_dir)))
    held = held.withColumns({"drawn": shapes.drawn(held, _LEAST), "area": F.abs(shapes.signed_area(F.col("p")))})
    held = shapes.boxed(held, *[shapes.of_state(c) for c in ("x0", "y0", "x1", "y1")])
    return held.select("shape", "ring", "drawn", shown("area", 3).alias("area"), shown(F.abs(shapes.signed_area(F.col("p"))), 3).alias("inside"))


@registered(f"""WITH {_VERTICES}, jumps AS (SELECT *, lon - lag(lon) OVER (PARTITION BY shape, ring ORDER BY seq) AS jump FROM vertices),
run AS (SELECT *, lon + 360 * sum(CASE WHEN jump > 180 THEN -1 WHEN jump < -180 THEN 1 ELSE 0 END) OVER (PARTITION BY shape, ring ORDER BY seq ROWS UNBOUNDED PRECEDING) AS x FROM jumps),
rings AS (SELECT shape, ring, CASE WHEN max(x) > 180 THEN 180::DOUBLE WHEN min(x) < -180 THEN -180::DOUBLE END AS meridian, list({{'x': x, 'y': lat}} ORDER BY seq) AS p FROM run GROUP BY 1, 2),
{_clip('rings', 'west_cut', 'x', 'coalesce(meridian, 1000::DOUBLE)', True)}, {_clip('rings', 'east_cut', 'x', 'coalesce(meridian, 1000::DOUBLE)', False)},
halves AS (SELECT *, 0 AS side FROM west_cut UNION ALL SELECT *, 1 FROM east_cut WHERE meridian IS NOT NULL)
SELECT shape, ring, side::INT AS side, round(abs({_AREA}) + 1e-7::DOUBLE, 4) AS area, round(list_min(list_transform(p, lambda v: v.x)) + CASE WHEN meridian = 180 AND side = 1 THEN -360 WHEN meridian = -180 AND side = 0 THEN 360 ELSE 0 END + 1e-7::DOUBLE, 4) AS west FROM halves WHERE len(p) > 2""")
def src20_rings_at_180(spark, sf_dir):
    held = shapes.split_at_180(_vertices(spark, sf_dir))
    return held.select("shape", "ring", "side", shown(F.abs(shapes.signed_area(F.col("p")))).alias("area"), shown(F.array_min(F.transform("p", lambda v: v["x"]))).alias("west"))


@registered(f"""WITH {_RINGED}, signed AS (SELECT shape, ring, p, {_AREA} AS signed FROM rings),
ways AS (SELECT shape, sign(arg_max(signed, (abs(signed), -ring))) AS way FROM signed GROUP BY 1),
sized AS (SELECT s.*, abs(signed) AS area, sign(signed) * way < 0 AS hole FROM signed s JOIN ways USING (shape)),
sides AS (SELECT shape, ring, area, unnest(list_transform(range(1, len(p) + 1), lambda i: {{'a': p[i], 'b': p[i % len(p) + 1]}})) AS e FROM sized WHERE NOT hole),
crossed AS (SELECT h.shape, h.ring, any_value(h.area) AS area, o.ring AS outer_ring, any_value(o.area) AS outer_area, count(*) AS n FROM sized h JOIN sides o USING (shape)
  WHERE h.hole AND (o.e.a.y > h.p[1].y) <> (o.e.b.y > h.p[1].y) AND h.p[1].x < (o.e.b.x - o.e.a.x) * (h.p[1].y - o.e.a.y) / (o.e.b.y - o.e.a.y) + o.e.a.x GROUP BY h.shape, h.ring, o.ring),
owned AS (SELECT shape, ring, any_value(area) AS area, arg_min(outer_ring, (outer_area, outer_ring)) AS outer_ring FROM crossed WHERE n % 2 = 1 GROUP BY 1, 2),
taken AS (SELECT shape, sum(area) AS taken, count(*) AS n_owned FROM owned GROUP BY 1)
SELECT shape, count(*)::BIGINT AS n_rings, count(*) FILTER (WHERE hole)::BIGINT AS n_holes, (count(*) FILTER (WHERE hole) - coalesce(any_value(n_owned), 0))::BIGINT AS n_stray,
  round(sum(area) + 1e-7::DOUBLE, 3) AS gross_area, round(sum(area) FILTER (WHERE NOT hole) - coalesce(any_value(taken), 0) + 1e-7::DOUBLE, 3) AS area FROM sized LEFT JOIN taken USING (shape) GROUP BY shape""")
def agg24_shape_areas(spark, sf_dir):
    found = shapes.shape_areas(shapes.rings(shapes.projected(_vertices(spark, sf_dir))))
    return found.withColumns({"gross_area": shown("gross_area", 3), "area": shown("area", 3)})
