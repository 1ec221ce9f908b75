"""Routes as GPX and GeoJSON texts, built by column functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def _lines(points: DataFrame, item) -> DataFrame:
    """(route_id, points): a route's items in order; a route fits one row."""
    placed = points.groupBy("route_id").agg(F.sort_array(F.collect_list(F.struct("pos", item.alias("item")))).alias("items"))
    return placed.select("route_id", F.transform("items", lambda x: x["item"]).alias("points"))


def gpx(points: DataFrame) -> DataFrame:
    """(route_id, gpx) of (route_id, pos, y, x, elevation): one track of one segment; points of
    unknown elevation have none."""
    rise = F.when(F.col("elevation").isNotNull(), F.format_string("<ele>%.1f</ele>", F.col("elevation"))).otherwise("")
    item = F.concat(F.format_string('<trkpt lat="%.7f" lon="%.7f">', F.col("y"), F.col("x")), rise, F.lit("</trkpt>"))
    head = F.format_string('<gpx version="1.1" creator="pacegrid" xmlns="http://www.topografix.com/GPX/1/1"><trk><name>Route %d</name><trkseg>', F.col("route_id"))
    return _lines(points, item).select("route_id", F.concat(head, F.array_join("points", ""), F.lit("</trkseg></trk></gpx>")).alias("gpx"))


def geojson(points: DataFrame) -> DataFrame:
    """(route_id, feature): a LineString of longitude and latitude."""
    item = F.format_string("[%.7f,%.7f]", F.col("x"), F.col("y"))
    head = F.format_string('{"type":"Feature","properties":{"id":%d},"geometry":{"type":"LineString","coordinates":[', F.col("route_id"))
    return _lines(points, item).select("route_id", F.concat(head, F.array_join("points", ","), F.lit("]}}")).alias("feature"))
