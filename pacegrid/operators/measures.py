"""All measures of walked routes in one row each."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pacegrid import scratch
from pacegrid.functions import geo
from pacegrid.operators import network, routes, shapes

#: Feet in a metre.
FEET = 3.28084


def measure(route_nodes: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(route_id, miles, gain, signals, crossings, trail, repeated, coverage, compactness) of every route
    (route_id, pos, node_id). ``edges`` has one edge per pair of ends (u, v, length, highway, surface,
    names); a step without one has no length. Gain is in feet; what is walked again counts by street or
    by running back beside an earlier part, whichever is more. Checkpointed."""
    walked = route_nodes.select("route_id", "pos", "node_id").transform(scratch.kept)
    steps = routes.steps(walked)
    measured = routes.measured_steps(steps, edges.withColumn("key", F.lit(0)))
    points = walked.join(nodes.select("node_id", "y", "x"), "node_id").transform(scratch.kept)
    lined = shapes.directed(edges.withColumn("major", network.is_major(edges)), nodes)
    crossings = shapes.major_crossings(walked, lined, nodes).groupBy("route_id").agg(F.count("*").alias("crossings"))
    parts = [
        routes.profile(steps, edges.withColumn("key", F.lit(0)), nodes),
        routes.repeated_share(measured),
        routes.signal_events(steps, measured, nodes),
        crossings,
        shapes.doubled_back(points),
        shapes.compactness(points),
    ]
    whole = walked.select("route_id").distinct()
    for part in parts:
        whole = whole.join(part.drop("metres"), "route_id", "left")
    lengths = measured.groupBy("route_id").agg(F.coalesce(F.sum("length"), F.lit(0.0)).alias("metres"))
    none = lambda c: F.coalesce(c, F.lit(0.0))
    return whole.join(lengths, "route_id", "left").select(
        "route_id",
        none(F.col("metres") / geo.MILE).alias("miles"),
        none(F.col("gain") * FEET).alias("gain"),
        F.coalesce("signals", F.lit(0)).cast("long").alias("signals"),
        F.coalesce("crossings", F.lit(0)).cast("long").alias("crossings"),
        none(F.col("trail_share")).alias("trail"),
        F.greatest(none(F.try_divide("repeated_metres", "metres")), none(F.col("doubled"))).alias("repeated"),
        none(F.col("coverage")).alias("coverage"),
        none(F.col("compactness")).alias("compactness"),
    ).transform(scratch.kept)
