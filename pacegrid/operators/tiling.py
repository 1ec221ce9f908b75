"""Plans of tiles that cover metros: cells that a boundary touches, lattices of discs, owners of cells,
patched gaps, and a check of coverage that doesn't rely on the plan.

A plan has a few hundred tiles a metro; cells are many. Cells meet tiles by bands of latitude and metro.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from pacegrid import scratch
from pacegrid.functions import geo

#: A cell's reach from its centre in parts of its size; the least radius of a search in
#: metres, and in parts of the longest target; metres that radii are rounded up to; how much closer
#: lattice points stand than discs would need.
HALF_DIAGONAL, LEAST_RADIUS, RADIUS_SHARE, ROUND_UP, LATTICE_SAFETY = math.sqrt(2) / 2 * 1.005, 2_000.0, 0.55, 100.0, 0.97

#: Points of boundaries that one task makes cells of.
RING_POINTS = 6_000

#: Degrees of latitude of the bands in which cells meet tiles.
BAND = 0.02


def needed_radius(max_miles: float) -> float:
    """Metres around a start that the longest served target needs."""
    return max(LEAST_RADIUS, max_miles * geo.MILE * RADIUS_SHARE)


def tile_radius(max_miles: float, core: float, cell: float = geo.CELL) -> float:
    return math.ceil((needed_radius(max_miles) + HALF_DIAGONAL * cell + core) / ROUND_UP) * ROUND_UP


def reach(radius: float, max_miles: float, cell: float = geo.CELL) -> float:
    """Metres from a tile's centre within which cells' needs lie in the tile."""
    return radius - needed_radius(max_miles) - HALF_DIAGONAL * cell


def _sides(rings: DataFrame) -> DataFrame:
    """Sides (metro, y, x, y2, x2) of closed rings (metro, ring, pos, y, x); a repeated first point adds none."""
    along = Window.partitionBy("metro", "ring").orderBy("pos")
    first = lambda c: F.first(c).over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    sides = rings.select("metro", "y", "x", F.coalesce(F.lead("y").over(along), first("y")).alias("y2"), F.coalesce(F.lead("x").over(along), first("x")).alias("x2"))
    return sides.filter("y <> y2 or x <> x2")


def metro_cells(rings: DataFrame, cell: float = geo.CELL) -> DataFrame:
    """(metro, row, column, lat, lon) of the cells whose centre lies inside a metro's boundary, grown by
    what a cell reaches from its centre. Rings are polygons' outer and inner ones alike: what an odd
    number of them holds is inside. Each row of cells is cut at the sides that pass its centre line;
    cells near a side are found from the side."""
    high = cell / geo.LATITUDE_METRES
    sides = _sides(scratch.spread(rings, RING_POINTS, "metro")).withColumn("widest", F.max(F.abs("y")).over(Window.partitionBy("metro")))
    low, top = F.least("y", "y2"), F.greatest("y", "y2")
    centre = (F.col("row") + 0.5) * high
    width = geo.column_width(F.col("row"), cell)
    passed = sides.withColumn("row", F.explode(F.sequence(F.floor(low / high) - 1, F.floor(top / high) + 1))).filter((low <= centre) & (centre < top))
    at = F.col("x") + (centre - F.col("y")) / (F.col("y2") - F.col("y")) * (F.col("x2") - F.col("x"))
    passed = passed.select("metro", "row", at.alias("x"))
    along = Window.partitionBy("metro", "row").orderBy("x")
    spans = passed.select("metro", "row", "x", F.lead("x").over(along).alias("to"), F.row_number().over(along).alias("n")).filter("n % 2 = 1")
    columns = lambda a, b: F.sequence(F.ceil(a / width - 0.5).cast("long"), F.floor(b / width - 0.5).cast("long"))
    spans = spans.filter(F.ceil(F.col("x") / width - 0.5) <= F.floor(F.col("to") / width - 0.5))
    inside = spans.select("metro", "row", F.explode(columns(F.col("x"), F.col("to"))).alias("column"))
    grow = HALF_DIAGONAL * cell / (geo.LONGITUDE_METRES * F.cos(F.radians("widest")))
    around = sides.withColumn("grow", grow).withColumn("row", F.explode(F.sequence(F.floor((low - F.col("grow")) / high), F.floor((top + F.col("grow")) / high))))
    left, right = F.least("x", "x2") - F.col("grow"), F.greatest("x", "x2") + F.col("grow")
    around = around.withColumn("column", F.explode(F.sequence(F.floor(left / width), F.floor(right / width))))
    lat, lon = centre, (F.col("column") + 0.5) * width
    de, dn = F.col("x2") - F.col("x"), F.col("y2") - F.col("y")
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((lon - F.col("x")) * de + (lat - F.col("y")) * dn) / (de * de + dn * dn)))
    near = around.filter(F.hypot(lon - F.col("x") - share * de, lat - F.col("y") - share * dn) <= F.col("grow"))
    cells = inside.unionByName(near.select("metro", "row", "column")).distinct()
    return cells.select("metro", "row", "column", lat.alias("lat"), lon.alias("lon"))


def hex_lattice(bounds: DataFrame, spacing: float) -> DataFrame:
    """(metro, place, lat, lon): points of a hexagonal lattice over bounds (metro, south, west, north, east)
    whose discs of radius spacing / sqrt(3) cover them; every second row is moved by half a step, and
    places count from south to north and west to east."""
    radius = spacing / math.sqrt(3)
    up, margin = 1.5 * radius / geo.LATITUDE_METRES, radius / geo.LATITUDE_METRES
    rows = bounds.withColumn("i", F.explode(F.sequence(F.lit(0), F.floor((F.col("north") - F.col("south") + 2 * margin + 1e-12) / up).cast("int"))))
    rows = rows.withColumn("lat", F.col("south") - margin + F.col("i") * up).withColumn("step", spacing / (geo.LONGITUDE_METRES * F.cos(F.radians("lat"))))
    begin = F.col("west") - F.col("step") + F.when(F.col("i") % 2 == 1, F.col("step") / 2).otherwise(0.0)
    rows = rows.withColumn("begin", begin).withColumn("j", F.explode(F.sequence(F.lit(0), F.floor((F.col("east") + F.col("step") - F.col("begin")) / F.col("step")).cast("int"))))
    points = rows.select("metro", "i", "j", F.round("lat", 6).alias("lat"), F.round(F.col("begin") + F.col("j") * F.col("step"), 6).alias("lon"))
    return points.select("metro", (F.row_number().over(Window.partitionBy("metro").orderBy("i", "j")) - 1).alias("place"), "lat", "lon")


def owners(cells: DataFrame, tiles: DataFrame, within: Column | str = "reach") -> DataFrame:
    """``cells`` (metro, row, column, lat, lon) with place and metres of the nearest of its metro's tiles
    (metro, place, lat, lon, ...) whose ``within`` holds its centre, the first on ties; null without any."""
    far = F.col(within) if isinstance(within, str) else within
    tiles = tiles.select("metro", "place", F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon"), far.alias("within")).filter("within >= 0")
    # A degree of latitude bounds the distance.
    edge = lambda sign: F.floor((F.col("t_lat") + sign * F.col("within") / 110_000.0) / BAND)
    banded = tiles.withColumn("band", F.explode(F.sequence(edge(-1), edge(1))))
    metres = geo.haversine(F.col("lat"), F.col("lon"), F.col("t_lat"), F.col("t_lon"))
    met = cells.withColumn("band", F.floor(F.col("lat") / BAND)).join(scratch.dealt(banded), ["metro", "band"]).withColumn("metres", metres).filter("metres <= within")
    best = met.groupBy("metro", "row", "column").agg(F.min(F.struct("metres", "place")).alias("best")).select("metro", "row", "column", "best.*")
    return cells.join(scratch.dealt(best), ["metro", "row", "column"], "left")


def plan(rings: DataFrame, max_miles: float, core: float, cell: float = geo.CELL) -> tuple[DataFrame, DataFrame]:
    """Tiles (metro, tile, lat, lon, radius, reach, cells) and owned cells (metro, row, column, tile) of
    every metro. Where lattice points leave cells out, a tile is put on each metro's first such cell,
    until none is; tiles without cells go, and the others are numbered from 0. Checkpointed."""
    scratch.checkpoints(rings.sparkSession)
    radius = tile_radius(max_miles, core, cell)
    far = reach(radius, max_miles, cell)
    if far <= 0:
        raise ValueError("the radius leaves no reach: use a larger core")
    cells = metro_cells(rings, cell).transform(scratch.kept)
    bounds = rings.groupBy("metro").agg(F.min("y").alias("south"), F.min("x").alias("west"), F.max("y").alias("north"), F.max("x").alias("east"))
    tiles = hex_lattice(bounds, math.sqrt(3) * far * LATTICE_SAFETY).withColumn("reach", F.lit(far)).transform(scratch.kept)
    owned = owners(cells, tiles).transform(scratch.kept)
    while not (bare := owned.filter("place is null")).isEmpty():
        first = bare.groupBy("metro").agg(F.min(F.struct("row", "column", "lat", "lon")).alias("cell"))
        last = tiles.groupBy("metro").agg(F.max("place").alias("last"))
        patch = first.join(last, "metro").select("metro", (F.col("last") + 1).alias("place"), F.round("cell.lat", 6).alias("lat"), F.round("cell.lon", 6).alias("lon"), F.lit(far).alias("reach"))
        tiles = tiles.unionByName(patch).transform(scratch.kept)
        owned = owners(cells, tiles).transform(scratch.kept)
    used = owned.groupBy("metro", "place").agg(F.count("*").alias("cells")).join(tiles, ["metro", "place"])
    used = used.withColumn("tile", (F.row_number().over(Window.partitionBy("metro").orderBy("place")) - 1).cast("int")).transform(scratch.kept)
    planned = used.select("metro", "tile", "lat", "lon", F.lit(radius).alias("radius"), F.lit(math.floor(far * 10) / 10).alias("reach"), "cells")
    return planned, owned.join(used.select("metro", "place", "tile"), ["metro", "place"]).select("metro", "row", "column", "tile")


def uncovered(cells: DataFrame, tiles: DataFrame, needed: float, cell: float = geo.CELL) -> DataFrame:
    """(metro, row, column) of cells with no tile (metro, tile, lat, lon, radius) whose disc holds all that
    the cell needs, from its radius alone."""
    within = F.col("radius") - HALF_DIAGONAL * cell - needed
    return owners(cells, tiles.withColumnRenamed("tile", "place"), within).filter("place is null").select("metro", "row", "column")
