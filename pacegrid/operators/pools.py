"""Answers from pools of precomputed loops: look up by cell, join to the runner, filter, retry."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pacegrid import scratch
from pacegrid.functions import geo
from pacegrid.operators import network

#: Metres of a connector at first and when widened, rings of cells at first and then,
#: metres by which a joined loop may miss the target.
CONNECTOR, WIDER, NEAR_RINGS, RINGS, BAND = 300.0, 500.0, 1, 2, 0.25 * geo.MILE


def ring(cells: DataFrame, rings: int, cell: float = geo.CELL) -> DataFrame:
    """Rows of ``cells`` (with y, x) for each cell within ``rings`` steps, found by looking the
    stepped point up again; several steps into one cell give one row."""
    steps = F.sequence(F.lit(-rings), F.lit(rings))
    row = geo.cell_row(F.col("y"), cell)
    centre = (row + F.col("up") + 0.5) * F.lit(cell / geo.LATITUDE_METRES)
    around = cells.withColumn("up", F.explode(steps)).withColumn("across", F.explode(steps))
    around = around.withColumn("lat2", centre).withColumn("lon2", F.col("x") + F.col("across") * geo.column_width(row, cell))
    return around.withColumn("cell", geo.cell_id(F.col("lat2"), F.col("lon2"), cell)).drop("up", "across", "lat2", "lon2").distinct()


def both_ways(origins: DataFrame, edges: DataFrame, limit: float) -> DataFrame:
    """(source, node_id, out, back): metres to a node and from it, where both are within ``limit``."""
    out = network.bounded_reach(origins, edges, limit).withColumnRenamed("metres", "out")
    turned = edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "length")
    back = network.bounded_reach(origins, turned, limit).withColumnRenamed("metres", "back")
    return out.join(back, ["source", "node_id"])


def anchored(looked: DataFrame, loops: DataFrame, reach: DataFrame, limit: float) -> DataFrame:
    """(source, route_id, pos, connector, metres): per origin and loop of its cells the join of
    least connector, the first position on ties. ``loops`` has a row per node."""
    near = reach.filter((F.col("out") <= limit) & (F.col("back") <= limit))
    met = looked.select("source", "cell").join(loops, "cell").join(scratch.dealt(near), ["source", "node_id"])
    best = F.min(F.struct(F.round(F.col("out") + F.col("back"), 3).alias("connector"), "pos")).alias("best")
    joined = met.groupBy("source", "route_id", "metres").agg(best)
    return joined.select("source", "route_id", "best.pos", "best.connector", (F.col("metres") + F.col("best.connector")).alias("metres"))


def serve(requests: DataFrame, nodes: DataFrame, edges: DataFrame, loops: DataFrame, near_rings: int = 0) -> DataFrame:
    """(request_id, retry, route_id, pos, connector, metres) of all loops that answer a request
    (request_id, source, target_miles), from the cells within ``near_rings`` steps of its own.
    Requests without an answer are tried once more with further cells and longer connectors. Work is done by distinct origin, not by request; reach
    is only computed for origins that have loops around."""
    places = requests.select("source").distinct().join(nodes.select(F.col("node_id").alias("source"), "y", "x"), "source")
    cells = loops.select("cell").distinct()
    wide = ring(places, RINGS).join(cells, "cell", "left_semi")
    near = ring(places, near_rings).join(cells, "cell", "left_semi")
    reach = both_ways(wide.select("source").distinct(), edges, WIDER)

    def answers(asked: DataFrame, looked: DataFrame, limit: float, label: str) -> DataFrame:
        found = asked.join(scratch.dealt(anchored(looked, loops, reach, limit)), "source")
        fits = F.abs(F.col("metres") - F.col("target_miles") * geo.MILE) <= BAND
        return found.filter(fits).select("request_id", F.lit(label).alias("retry"), "route_id", "pos", "connector", "metres")

    first = answers(requests, near, CONNECTOR, "none").transform(scratch.kept)
    open_ = requests.join(first.select("request_id").distinct(), "request_id", "left_anti")
    return first.unionByName(answers(open_, wide, WIDER, "wider"))
