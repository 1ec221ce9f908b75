"""What lies along routes, and loops of one cell by their length."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def travel(measured: DataFrame) -> DataFrame:
    """``measured`` steps with the metres walked before and after each."""
    along = Window.partitionBy("route_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    walked = measured.withColumn("after", F.sum(F.coalesce("length", F.lit(0.0))).over(along))
    return walked.withColumn("before", F.col("after") - F.coalesce("length", F.lit(0.0)))


def clusters(marks: DataFrame, apart: float = 40.0) -> DataFrame:
    """(route_id, cluster, first, last, marks) of places ``at`` along routes: a mark that is more than
    ``apart`` metres behind the last one begins a cluster."""
    along = Window.partitionBy("route_id").orderBy("at", "pos")
    new = F.coalesce(F.col("at") - F.lag("at").over(along) > apart, F.lit(True)).cast("int")
    numbered = marks.withColumn("new", new).withColumn("cluster", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("route_id", "cluster").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("marks"))


def best_band(loops: DataFrame, group: str, band: float = 0.25) -> DataFrame:
    """(group, miles, near) per group: the length that most loops of the group are within ``band``
    miles of, the longest on ties. A window over lengths, in millionths of a mile, counts, so no
    loop meets every other."""
    parts = lambda c: F.round(c * 1e6).cast("long")
    around = Window.partitionBy(group).orderBy(parts(F.col("miles"))).rangeBetween(-round(band * 1e6), round(band * 1e6))
    counted = loops.withColumn("near", F.count("*").over(around))
    return counted.groupBy(group).agg(F.max(F.struct("near", "miles")).alias("best")).select(group, "best.miles", "best.near")
