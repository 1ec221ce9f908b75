"""Figures over groups of measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def order_statistics(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, p95_linear, p95_rank, p95_floor, median, upper_median). Equal values are counted
    before anything moves, so that a group's window holds its distinct values only; nulls don't
    count."""
    counted = rows.filter(F.col(value).isNotNull()).groupBy(group, F.col(value).alias("value")).agg(F.count("*").alias("times"))
    along = Window.partitionBy(group).orderBy("value")
    placed = counted.withColumn("upto", F.sum("times").over(along)).withColumn("n", F.sum("times").over(Window.partitionBy(group)))
    n = F.col("n")

    def at(index):
        """The value at a zero-based place of the sorted values."""
        return F.max(F.when((F.col("upto") - F.col("times") <= index) & (index < F.col("upto")), F.col("value")))

    place = (n - 1) * F.lit(0.95)
    low, high = at(F.floor(place)), at(F.ceil(place))
    share = F.first(place - F.floor(place))
    return placed.groupBy(group).agg(
        F.first("n").alias("n"),
        F.round(low + (high - low) * share, 6).alias("p95_linear"),
        at(F.ceil(n * F.lit(0.95)) - 1).alias("p95_rank"),
        low.alias("p95_floor"),
        ((at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2).alias("median"),
        at(F.floor(n / 2)).alias("upper_median"),
    )


def distance_accuracy(ranked: DataFrame, shown: int = 3) -> DataFrame:
    """One row per target: requests, those whose first route is within 5 and 10 percent, those
    with any shown route within 10 percent, and the largest error of a first route."""
    off = F.col("error") / F.col("target")
    each = ranked.filter(F.col("rank") <= shown).groupBy("request_id", "target").agg(F.min(F.when(F.col("rank") == 1, off)).alias("first"), F.min(off).alias("best"))
    return each.groupBy("target").agg(
        F.count("*").alias("requests"),
        F.count_if(F.col("first") <= 0.05).alias("within5"),
        F.count_if(F.col("first") <= 0.10).alias("within10"),
        F.count_if(F.col("best") <= 0.10).alias("any10"),
        F.round(F.max("first"), 6).alias("largest"),
    )
