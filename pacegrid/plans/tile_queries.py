"""Queries that plan tiles, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pacegrid.operators import tiling
from pacegrid.plans.street_queries import HAVERSINE
from pacegrid.sources import street_tables as t

#: The longest target in miles, and metres of the band of cells that a tile owns beyond its need.
MAX_MILES, CORE = 2.0, 1500.0


def metro_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.metro_cells(t.metro_rings(spark, sf_dir)).select("metro", "row", "column")


def tile_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles, _ = tiling.plan(t.metro_rings(spark, sf_dir), MAX_MILES, CORE)
    return tiles


def uncovered_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What isn't covered where every metro's first tile is missing."""
    rings = t.metro_rings(spark, sf_dir)
    tiles, _ = tiling.plan(rings, MAX_MILES, CORE)
    return tiling.uncovered(tiling.metro_cells(rings), tiles.filter("tile > 0"), tiling.needed_radius(MAX_MILES))


QUERIES = {"til2_metro_cells": metro_cells, "til4_tile_plans": tile_plans, "til5_uncovered_cells": uncovered_cells}

_H = "(200e0 / 110540e0)"
_W = f"(200e0 / (111320e0 * cos(radians((row + 0.5e0) * {_H}))))"
_RADIUS = tiling.tile_radius(MAX_MILES, CORE)
_REACH = tiling.reach(_RADIUS, MAX_MILES)
_CELLS = f"""shaped AS (
  SELECT CAST(s_suppkey AS BIGINT) AS metro, 30e0 + s_suppkey % 40 * 0.5e0 AS y0, -120e0 + s_suppkey % 97 * 0.5e0 AS x0, 0.03e0 + s_suppkey % 5 * 0.013e0 AS w, 0.027e0 + s_suppkey % 3 * 0.017e0 AS h FROM supplier
), corners AS (SELECT metro, y0, x0, w, h, unnest([0, 1, 2, 3, 4, 5]) AS pos, unnest([0e0, 0e0, 0.5e0, 0.5e0, 1e0, 1e0]) AS up, unnest([0e0, 1e0, 1e0, 0.5e0, 0.5e0, 0e0]) AS across FROM shaped),
rings AS (SELECT metro, pos, y0 + up * h AS y, x0 + across * w AS x FROM corners),
sides AS (SELECT metro, y, x, lead(y, 1, first_y) OVER v AS y2, lead(x, 1, first_x) OVER v AS x2 FROM (SELECT *, first_value(y) OVER u AS first_y, first_value(x) OVER u AS first_x FROM rings WINDOW u AS (PARTITION BY metro ORDER BY pos)) WINDOW v AS (PARTITION BY metro ORDER BY pos)),
bounds AS (SELECT metro, min(y) AS south, max(y) AS north, min(x) AS west, max(x) AS east, {tiling.HALF_DIAGONAL * 200}e0 / (111320e0 * cos(radians(max(abs(y))))) AS grow FROM rings GROUP BY metro),
rows AS (SELECT *, unnest(generate_series(CAST(floor((south - grow) / {_H}) AS BIGINT) - 1, CAST(floor((north + grow) / {_H}) AS BIGINT) + 1)) AS row FROM bounds),
grid AS (SELECT *, unnest(generate_series(CAST(floor((west - grow) / {_W}) AS BIGINT) - 1, CAST(floor((east + grow) / {_W}) AS BIGINT) + 1)) AS col FROM rows),
placed AS (SELECT metro, row, col, grow, (row + 0.5e0) * {_H} AS lat, (col + 0.5e0) * {_W} AS lon FROM grid),
shared AS (SELECT p.*, s.*, least(1e0, greatest(0e0, ((lon - x) * (x2 - x) + (lat - y) * (y2 - y)) / ((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)))) AS share FROM placed p JOIN sides s USING (metro)),
cells AS (
  SELECT metro, row, col, any_value(lat) AS lat, any_value(lon) AS lon FROM shared GROUP BY metro, row, col
  HAVING count(*) FILTER ((least(y, y2) <= lat AND lat < greatest(y, y2)) AND lon > x + (lat - y) / (y2 - y) * (x2 - x)) % 2 = 1
    OR bool_or(sqrt(pow(lon - x - share * (x2 - x), 2) + pow(lat - y - share * (y2 - y), 2)) <= grow)
)"""
_TILES = f"""levels AS (
  SELECT *, unnest(generate_series(0, CAST(floor((north - south + 2 * {{margin}} + 1e-12) / {{up}}) AS INT))) AS i FROM bounds
), stepped AS (SELECT *, south - {{margin}} + i * {{up}} AS lat, {{spacing}} / (111320e0 * cos(radians(south - {{margin}} + i * {{up}}))) AS step FROM levels),
begun AS (SELECT *, west - step + CASE WHEN i % 2 = 1 THEN step / 2 ELSE 0e0 END AS begin FROM stepped),
points AS (SELECT *, unnest(generate_series(0, CAST(floor((east + step - begin) / step) AS INT))) AS j FROM begun),
lattice AS (SELECT metro, row_number() OVER (PARTITION BY metro ORDER BY i, j) AS place, round(lat, 6) AS t_lat, round(begin + j * step, 6) AS t_lon FROM points),
owned AS (
  SELECT metro, row, col, arg_min(place, (metres, place)) AS place FROM (SELECT c.*, place, {HAVERSINE.format("lat", "lon", "t_lat", "t_lon")} AS metres FROM cells c JOIN lattice USING (metro)) WHERE metres <= {_REACH!r}e0 GROUP BY metro, row, col
), used AS (SELECT metro, place, count(*) AS cells FROM owned GROUP BY metro, place),
tiles AS (SELECT metro, CAST(row_number() OVER (PARTITION BY metro ORDER BY place) - 1 AS INT) AS tile, t_lat AS lat, t_lon AS lon, {_RADIUS}e0 AS radius, cells FROM used JOIN lattice USING (metro, place))"""
_SPACING = 3**0.5 * _REACH * tiling.LATTICE_SAFETY
_TILES = _TILES.format(margin=f"{_SPACING / 3**0.5 / 110540!r}e0", up=f"{1.5 * (_SPACING / 3**0.5) / 110540!r}e0", spacing=f"{_SPACING!r}e0")

SQL = {
    "til2_metro_cells": f"WITH {_CELLS} SELECT metro, row, col AS \"column\" FROM cells",
    "til4_tile_plans": f"WITH {_CELLS}, {_TILES} SELECT metro, tile, lat, lon, radius, floor({_REACH!r}e0 * 10) / 10 AS reach, cells FROM tiles",
    "til5_uncovered_cells": f"""WITH {_CELLS}, {_TILES} SELECT metro, row, col AS "column" FROM cells c WHERE NOT EXISTS (
  SELECT 1 FROM tiles t WHERE t.metro = c.metro AND tile > 0 AND {HAVERSINE.format("c.lat", "c.lon", "t.lat", "t.lon")} <= radius - {tiling.HALF_DIAGONAL * 200 + tiling.needed_radius(MAX_MILES)!r}e0)""",
}
