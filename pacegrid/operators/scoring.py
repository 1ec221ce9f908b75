"""Ranking of route candidates within their request."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F


@dataclass(frozen=True)
class Weights:
    """Fixed values of the score's parts."""

    distance: float = 7.0
    signals: float = 6.0
    crossings: float = 4.0
    surface: float = 2.5
    climb: float = 1.5
    repeated: float = 5.0
    shape: float = 4.0
    driving: float = 0.35


#: Rounder shapes than this cost nothing; flatter or more repeating loops are awkward.
ROUND_ENOUGH, LEAST_COMPACT, MOST_REPEATED, TOLERANCE = 0.35, 0.2, 0.10, 0.25
#: Share of a distance error that still counts within the band.
IN_BAND = 0.15


def normalised(value: Column, low: Column, high: Column) -> Column:
    """Place of a value in a range; the middle where the range is a point."""
    return F.when(high <= low, F.lit(0.5)).otherwise((value - low) / (high - low))


def surface_penalty(wish: Column, trail: Column) -> Column:
    return F.when(wish == "road", trail).when(wish == "trail", 1 - trail).otherwise(0.6 * F.abs(trail - 0.5))


def climb_penalty(wish: Column, coverage: Column, place: Column) -> Column:
    """Unknown elevations count as middling."""
    known = F.when(wish == "flat", place).when(wish == "hilly", 1 - place).otherwise(2 * F.abs(place - 0.5))
    return F.when(coverage < 0.95, F.lit(0.5)).otherwise(known)


def awkward(compactness: Column, repeated: Column) -> Column:
    return (compactness < LEAST_COMPACT) | (repeated > MOST_REPEATED)


def rank(candidates: DataFrame, weights: Weights = Weights()) -> DataFrame:
    """``candidates`` with error, score, awkward and rank. In the distance band come first those
    that aren't awkward, then by score; the others follow by distance error. Climbs are compared
    among a request's candidates; all windows share the request's partitioning, so the rows are
    shuffled once."""
    request = Window.partitionBy("request_id")
    place = normalised(F.col("gain"), F.min("gain").over(request), F.max("gain").over(request))
    error = F.abs(F.col("miles") - F.col("target"))
    score = (
        weights.distance * (error / TOLERANCE) * F.when(F.round(error, 9) <= TOLERANCE, IN_BAND).otherwise(1.0)
        + weights.signals * F.col("signals") / F.greatest("miles", F.lit(1.0))
        + weights.crossings * F.col("crossings") / F.greatest("miles", F.lit(1.0))
        + weights.surface * surface_penalty(F.col("surface"), F.col("trail"))
        + weights.climb * climb_penalty(F.col("climb"), F.col("coverage"), place)
        + weights.repeated * F.col("repeated")
        + weights.shape * F.greatest(F.lit(0.0), (ROUND_ENOUGH - F.col("compactness")) / ROUND_ENOUGH)
        + weights.driving * F.col("drive")
    )
    scored = candidates.withColumns({"error": F.round(error, 9), "score": F.round(score, 9), "awkward": awkward(F.col("compactness"), F.col("repeated"))})
    out = F.col("error") > TOLERANCE
    order = [out.cast("int"), F.when(out, F.lit(0)).otherwise(F.col("awkward").cast("int")), F.when(out, F.col("error")).otherwise(F.col("score")), F.when(out, F.col("score")).otherwise(F.col("error")), "ordinal"]
    return scored.withColumn("rank", F.row_number().over(request.orderBy(*order)))
