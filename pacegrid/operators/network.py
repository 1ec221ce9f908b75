"""Costs, snapping and reach on a street network of nodes and directed edges."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F, types as T

from pacegrid import scratch
from pacegrid.functions import geo

#: Highways that are trails or major roads, unpaved surfaces, costs in metres.
TRAILS = ("bridleway", "footway", "path", "track")
UNPAVED = ("compacted", "dirt", "earth", "fine_gravel", "gravel", "ground", "mud", "sand", "unpaved", "woodchips")
MAJOR = ("motorway", "trunk", "primary", "secondary")
SIGNAL, SIGNAL_APART, CROSSING, MAJOR_LEAST, MAJOR_SHARE = 450.0, 40.0, 300.0, 120.0, 1.8
PAVED_SHARE, TRAIL_SHARE, CLIMB = 0.65, 0.80, 10.0


#: Spellings of a signalled crossing.
SIGNALLED = ("traffic_signals", "pedestrian_signals", "signals")


def tagged(rows: DataFrame, tag: str, names: tuple[str, ...], split: bool = False) -> Column:
    """Whether a tag of ``rows``, a string or a list of strings, has one of the names in any case; with
    ``split``, values may hold several, parted by semicolons."""

    def named(value: Column) -> Column:
        lower = F.lower(value.cast("string"))
        return F.exists(F.split(lower, ";"), lambda v: F.trim(v).isin(*names)) if split else lower.isin(*names)

    listed = isinstance(rows.schema[tag].dataType, T.ArrayType)
    return F.coalesce(F.exists(F.col(f"`{tag}`"), named) if listed else named(F.col(f"`{tag}`")), F.lit(False))


def is_trail(rows: DataFrame) -> Column:
    return tagged(rows, "highway", TRAILS) | tagged(rows, "surface", UNPAVED)


def is_major(rows: DataFrame) -> Column:
    return tagged(rows, "highway", MAJOR)


def is_signal(nodes: DataFrame) -> Column:
    """Nodes with traffic signals, or crossings that are signalled by either tag; columns that ``nodes``
    hasn't don't count."""
    said = F.lit(False)
    for tag, names in (("highway", ("traffic_signals",)), ("crossing", SIGNALLED), ("crossing:signals", ("yes",))):
        if tag in nodes.columns:
            said = said | tagged(nodes, tag, names, split=tag == "crossing")
    return said


#: Wishes that a cost is for.
SURFACES = ("road", "mixed", "trail")


def _with_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    side = lambda end: nodes.select(F.col("node_id").alias(end), F.col("signal").alias(f"{end}_signal"), F.col("elevation").alias(f"{end}_elevation"))
    both = edges.join(side("u"), "u").join(side("v"), "v")
    return both.withColumns({"major": is_major(both), "trail": is_trail(both)})


def _cost(surface: Column, flat: Column) -> Column:
    length = F.coalesce("length", F.lit(1.0))
    rise = F.col("v_elevation") - F.col("u_elevation")
    return (
        length
        + F.when(F.col("v_signal") & (~F.col("u_signal") | (length > SIGNAL_APART)), SIGNAL).otherwise(0.0)
        + F.when(F.col("major"), F.greatest(F.lit(MAJOR_LEAST), MAJOR_SHARE * length)).otherwise(0.0)
        + F.when((surface == "trail") & ~F.col("trail"), PAVED_SHARE * length).when((surface == "road") & F.col("trail"), TRAIL_SHARE * length).otherwise(0.0)
        + F.when(flat & (rise > 0), CLIMB * rise).otherwise(0.0)
    )


def edge_costs(edges: DataFrame, nodes: DataFrame, surface: str, flat: bool) -> DataFrame:
    """``edges`` with major, trail and cost for a preference: length, a new signal at the far end,
    a major road, an unwanted surface and, if ``flat``, metres climbed."""
    return _with_ends(edges, nodes).select("u", "v", "key", "length", "major", "trail", _cost(F.lit(surface), F.lit(flat)).alias("cost"))


def _entered(edges: DataFrame) -> DataFrame:
    """Edges (u, v, major, ...) with ``charge``: that for entering a node where two or more major roads meet
    by an edge that isn't one."""
    major = edges.filter("major").select("u", "v").distinct()
    ends = major.select(F.col("u").alias("v"), F.col("v").alias("other")).unionByName(major.select("v", F.col("u").alias("other")))
    met = ends.distinct().groupBy("v").agg(F.count("*").alias("roads")).filter("roads >= 2")
    return edges.join(met, "v", "left").withColumn("charge", F.when(F.col("roads").isNotNull() & ~F.col("major"), CROSSING).otherwise(0.0))


def collapse(costs: DataFrame) -> DataFrame:
    """One edge (u, v, key, cost) per pair of ends: the cheapest after the charge for entering a node
    where two or more major roads meet by an edge that isn't one; the lowest key wins ties."""
    full = (F.col("cost") + F.col("charge")).alias("cost")
    best = _entered(costs).groupBy("u", "v").agg(F.min(F.struct(full, "key")).alias("best"))
    return best.select("u", "v", "best.key", F.col("best.cost").alias("cost"))


def collapse_by_preference(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``collapse`` of the ``edge_costs`` of every surface wish, flat or not, with these as columns. Edges go
    through joins and grouping once for all wishes; only the chosen ones are listed for each."""
    wishes = [(s, f) for s in SURFACES for f in (False, True)]
    full = lambda s, f: (_cost(F.lit(s), F.lit(f)) + F.col("charge")).alias("cost")
    each = [F.min(F.struct(full(*w), "key")).alias(f"best{i}") for i, w in enumerate(wishes)]
    best = _entered(_with_ends(edges, nodes).drop("highway", "surface")).groupBy("u", "v").agg(*each)
    listed = F.array(*(F.struct(F.lit(s).alias("surface"), F.lit(f).alias("flat"), F.col(f"best{i}.key").alias("key"), F.col(f"best{i}.cost").alias("cost")) for i, (s, f) in enumerate(wishes)))
    return best.select("u", "v", F.inline(listed)).select("surface", "flat", "u", "v", "key", "cost")


#: Cell sizes of successive rounds: the last one's nine cells span the globe.
NEAREST_CELLS = (400.0, 3_200.0, 25_600.0, 204_800.0, 20_040_000.0)


def _nearest_within(points: DataFrame, nodes: DataFrame, key: str, cell: float) -> DataFrame:
    """(key, node_id, metres) of points with a node in their cell or the eight around it: each node
    stands in nine cells, and a point is looked up in its own."""
    steps = F.array(*(F.lit(i) for i in (-1, 0, 1)))
    here = points.select(key, "lat", "lon", geo.cell_row(F.col("lat"), cell).alias("row"), geo.cell_column(F.col("lat"), F.col("lon"), cell).alias("column"))
    spread = nodes.select("node_id", "y", "x", F.explode(F.transform(steps, lambda i: geo.cell_row(F.col("y"), cell) + i)).alias("row"))
    spread = spread.withColumn("column", F.explode(F.transform(steps, lambda i: F.floor(F.col("x") / geo.column_width(F.col("row"), cell)).cast("long") + i)))
    metres = F.round(geo.haversine(F.col("lat"), F.col("lon"), F.col("y"), F.col("x")), 6)
    met = here.join(scratch.dealt(spread), ["row", "column"]).groupBy(key).agg(F.min(F.struct(metres.alias("metres"), "node_id")).alias("best"))
    return met.select(key, "best.node_id", "best.metres")


def nearest_nodes(points: DataFrame, nodes: DataFrame, key: str, cells: tuple[float, ...] = NEAREST_CELLS) -> DataFrame:
    """(key, node_id, metres): each point's nearest node, the lowest on ties. Equi joins on cells: a
    round is certain about nodes within its cell size, and points without one go on to the next
    round's larger cells, which few do. Rounds are checkpointed."""
    out, left = None, points
    for place, cell in enumerate(cells):
        found = _nearest_within(left, nodes, key, cell)
        if place < len(cells) - 1:
            found = found.filter(F.col("metres") <= cell)
        found = found.transform(scratch.kept)
        out = found if out is None else out.unionByName(found)
        left = left.join(found.select(key), key, "left_anti").transform(scratch.kept)
        if left.isEmpty():
            break
    return out


def assign_tiles(cells: DataFrame, tiles: DataFrame) -> DataFrame:
    """(cell, tile, metres) of every cell: the nearest tile that reaches its centre, the lowest
    tile on ties, -1 without any. Tiles are a plan's dimension table; Spark broadcasts it where
    its size allows."""
    metres = F.round(geo.haversine(F.col("c_lat"), F.col("c_lon"), F.col("lat"), F.col("lon")), 6)
    # A degree of latitude bounds the distance, so rows are an equi join's key.
    band = 0.01
    banded = tiles.withColumn("band", F.explode(F.sequence(F.floor((F.col("lat") - F.col("reach") / 110000.0) / band), F.floor((F.col("lat") + F.col("reach") / 110000.0) / band))))
    near = cells.withColumn("band", F.floor(F.col("c_lat") / band)).join(scratch.dealt(banded), "band").filter(metres <= F.col("reach"))
    best = near.groupBy("cell").agg(F.min(F.struct(metres.alias("metres"), "tile")).alias("best"))
    return cells.select("cell").join(best, "cell", "left").select("cell", F.coalesce("best.tile", F.lit(-1).cast("long")).alias("tile"), F.col("best.metres").alias("metres"))


def bounded_reach(sources: DataFrame, edges: DataFrame, limit: float) -> DataFrame:
    """(source, node_id, metres) of all nodes within ``limit`` metres of walking. Each round
    relaxes only what the last one improved; rounds end when nothing is nearer than before."""
    links = edges.groupBy("u", "v").agg(F.min(F.coalesce("length", F.lit(1.0))).alias("step"))
    known = sources.select("source", F.col("source").alias("node_id"), F.lit(0.0).alias("metres")).transform(scratch.kept)
    fresh = known
    while not fresh.isEmpty():
        moved = fresh.join(links, fresh.node_id == links.u).select("source", F.col("v").alias("node_id"), (F.col("metres") + F.col("step")).alias("metres"))
        moved = moved.filter(F.col("metres") <= limit).groupBy("source", "node_id").agg(F.min("metres").alias("metres"))
        both = known.select("source", "node_id", "metres", F.col("metres").alias("before")).unionByName(moved.withColumn("before", F.lit(None).cast("double")))
        merged = both.groupBy("source", "node_id").agg(F.min("metres").alias("metres"), F.min("before").alias("before")).transform(scratch.kept)
        fresh = merged.filter("before is null or metres < before").select("source", "node_id", "metres")
        known = merged.select("source", "node_id", "metres")
    return known


def crop(nodes: DataFrame, edges: DataFrame, lat: float, lon: float, metres: float) -> tuple[DataFrame, DataFrame]:
    """Nodes within ``metres`` of a place and the edges between them. A box of degrees reaches the
    scan before distances are computed; both ends of an edge must stay."""
    up = metres / geo.LATITUDE_METRES * 1.01
    across = up / math.cos(math.radians(min(89.0, abs(lat) + up)))
    box = nodes.filter(F.col("y").between(lat - up, lat + up) & F.col("x").between(lon - across, lon + across))
    kept = box.filter(geo.haversine(F.lit(lat), F.lit(lon), F.col("y"), F.col("x")) <= metres)
    ends = kept.select("node_id")
    inner = edges.join(ends.withColumnRenamed("node_id", "u"), "u", "left_semi").join(ends.withColumnRenamed("node_id", "v"), "v", "left_semi")
    return kept, inner


def cell_origins(nodes: DataFrame, cell: float = geo.CELL) -> DataFrame:
    """(cell, node_id, metres) of each cell that holds nodes: the one nearest to its centre."""
    row, column = geo.cell_row(F.col("y"), cell), geo.cell_column(F.col("y"), F.col("x"), cell)
    lat, lon = geo.cell_centre(row, column, cell)
    metres = F.round(geo.haversine(F.col("y"), F.col("x"), lat, lon), 6)
    best = nodes.groupBy(geo.cell_id(F.col("y"), F.col("x"), cell).alias("cell")).agg(F.min(F.struct(metres.alias("metres"), "node_id")).alias("best"))
    return best.select("cell", "best.node_id", "best.metres")
