"""Queries of the spatial operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.spatial import assign_regions, has_place, near_pairs
from tessera.session import materialize
from tessera.sources.tables import table

#: Metres.
NEAR = 100.0
#: Degrees of longitude of the regions, and the corners (latitude, longitude from the western edge) of the hole that each has.
LUNE, HOLE = 30, ((10, 4), (12, 25), (40, 20), (55, 8))


def _places(spark: SparkSession, folder: str) -> DataFrame:
    lat, lon = F.col("latitude"), F.col("longitude")
    places = table(spark, folder, "business").where(has_place(lat, lon) & F.col("business_id").isNotNull())
    places = places.groupBy(F.col("business_id").alias("id")).agg(F.min(F.struct(lat.alias("lat"), lon.alias("lon"))).alias("at"))
    return places.select("id", "at.lat", "at.lon")


def _near(spark: SparkSession, folder: str) -> DataFrame:
    return near_pairs(_places(spark, folder), NEAR, materialize)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of businesses at most 100 m apart."""
    return _near(spark, folder).select(F.col("id_1").alias("business_id_1"), F.col("id_2").alias("business_id_2"))


def p2_neighbour_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How many other businesses each business has within 100 m; those without any are left out."""
    pairs = _near(spark, folder)
    both = pairs.select(F.explode(F.array("id_1", "id_2")).alias("business_id"))
    return both.groupBy("business_id").agg(F.count(F.lit(1)).alias("n_near"))


def _lunes(spark: SparkSession) -> DataFrame:
    """Regions that cover the globe but for their holes: between two meridians, from the equator to a pole."""
    rows = []
    for west in range(-180, 180, LUNE):
        for sign, side in ((1, "north"), (-1, "south")):
            ring = [(0.0, float(west)), (0.0, float(west + LUNE)), (90.0 * sign, float(west))]
            rows.append((f"{side} of {west}", ring, [[(float(a * sign), float(west + o)) for a, o in HOLE]]))
    ring = "array<struct<lat: double, lon: double>>"
    return spark.createDataFrame(rows, f"region_id string, ring {ring}, holes array<{ring}>")


def p2_region(spark: SparkSession, folder: str) -> DataFrame:
    """The region of each business, of regions with holes; businesses in none are left out."""
    return assign_regions(_lunes(spark), _places(spark, folder), materialize).select(F.col("id").alias("business_id"), "region_id")


QUERIES = {f.__name__: f for f in (p2_found, p2_neighbour_counts, p2_region)}

_PAIRS = """
WITH b AS (
  SELECT DISTINCT business_id, radians(latitude) AS la, radians(longitude) AS lo FROM business
  WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND NOT (latitude = 0 AND longitude = 0)
), found AS (
  SELECT a.business_id AS business_id_1, b.business_id AS business_id_2 FROM b a, b
  WHERE a.business_id < b.business_id AND abs(a.la - b.la) < 0.00002
    AND 2 * 6371000 * asin(sqrt(least(1, power(sin((a.la - b.la) / 2), 2) + cos(a.la) * cos(b.la) * power(sin((a.lo - b.lo) / 2), 2)))) <= 100
)
"""


def _vector(latitude: str, longitude: str) -> tuple[str, str, str]:
    return f"cos(radians({latitude})) * cos(radians({longitude}))", f"cos(radians({latitude})) * sin(radians({longitude}))", f"sin(radians({latitude}))"


def _left_of(one: tuple[float, float], two: tuple[float, float]) -> str:
    """Which side of the great circle through two points a place (latitude ``la``, longitude ``lo``) is on."""
    a, b, p = (_vector(*map(str, v)) for v in (one, two, ("la", "lo")))
    return " + ".join(f"({p[i]}) * (({a[j]}) * ({b[k]}) - ({a[k]}) * ({b[j]}))" for i, j, k in ((0, 1, 2), (1, 2, 0), (2, 0, 1)))


#: The hole is convex: a place is in it if it is on the same side of all of its edges.
_REGION = f"""
WITH b AS (
  SELECT DISTINCT business_id, latitude, longitude FROM business
  WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND NOT (latitude = 0 AND longitude = 0)
), p AS (
  SELECT business_id, (floor((longitude + 180) / {LUNE}) * {LUNE} - 180)::INT AS west, CASE WHEN latitude >= 0 THEN 'north' ELSE 'south' END AS side,
    abs(latitude) AS la, longitude - (floor((longitude + 180) / {LUNE}) * {LUNE} - 180) AS lo FROM b
)
SELECT business_id, side || ' of ' || west AS region_id FROM p WHERE NOT ({" AND ".join(f"{_left_of(u, v)} > 0" for u, v in zip(HOLE, (*HOLE[1:], HOLE[0]), strict=True))})"""

SQL = {
    "p2_region": _REGION,
    "p2_found": _PAIRS + "SELECT * FROM found",
    "p2_neighbour_counts": _PAIRS + "SELECT business_id, count(*) AS n_near FROM (SELECT business_id_1 AS business_id FROM found UNION ALL SELECT business_id_2 FROM found) GROUP BY 1",
}
