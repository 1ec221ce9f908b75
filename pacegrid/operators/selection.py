"""Choices among ranked candidates of a request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pacegrid import scratch
from pacegrid.operators import routes


def leading(ranked: DataFrame, group: str, order: str, most: int) -> DataFrame:
    """The first ``most`` rows of each group with their place; Spark keeps no more than these per
    group before it shuffles."""
    return ranked.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(order))).filter(F.col("place") <= most)


def distinct_routes(placed: DataFrame, conflicts: DataFrame, group: str, most: int) -> DataFrame:
    """(group, route_id, place) chosen greedily by place: a route goes if it conflicts with one
    chosen before; ``most`` stay. ``placed`` must be short per group (see ``leading``), for a
    group's rows are folded in order."""
    before = conflicts.select(group, F.col("a").alias("route_id"), F.col("b").alias("other")).unionByName(conflicts.select(group, F.col("b").alias("route_id"), F.col("a").alias("other")))
    against = before.groupBy(group, "route_id").agg(F.collect_set("other").alias("against"))
    rows = placed.select(group, "route_id", "place").join(against, [group, "route_id"], "left")
    none = F.array().cast("array<bigint>")
    queue = rows.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("place", "route_id", F.coalesce("against", none).alias("against")))).alias("queue"))

    def step(chosen, row):
        taken = (F.size(chosen) < most) & ~F.arrays_overlap(chosen, row["against"])
        return F.when(taken, F.concat(chosen, F.array(row["route_id"]))).otherwise(chosen)

    chosen = queue.withColumn("chosen", F.aggregate("queue", none, step))
    return chosen.select(group, F.posexplode("chosen").alias("place", "route_id")).select(group, "route_id", (F.col("place") + 1).cast("long").alias("place"))


def distinct_by_streets(placed: DataFrame, streets: DataFrame, group: str, most: int, least_share: float) -> DataFrame:
    """(group, route_id, place) as ``distinct_routes`` chooses with conflicts of ``least_share``, over
    groups of any length. Each round takes the open route of least place in every group and closes
    those too like it; no group is collected, and routes meet only those taken. Rounds are
    checkpointed. ``streets`` as of ``routes.walked_streets``."""
    open_, taken = placed.select(group, "route_id", "place"), []
    for turn in range(1, most + 1):
        first = open_.groupBy(group).agg(F.min(F.struct("place", "route_id")).alias("first"))
        leads = first.select(group, "first.route_id").transform(scratch.kept)
        if leads.isEmpty():
            break
        taken.append(leads.withColumn("place", F.lit(turn).cast("long")))
        if turn < most:
            closed = routes.like_leads(streets, leads, group, least_share).unionByName(leads)
            open_ = open_.join(closed, [group, "route_id"], "left_anti").transform(scratch.kept)
    out = taken[0] if taken else placed.select(group, "route_id", F.col("place").cast("long")).limit(0)
    for more in taken[1:]:
        out = out.unionByName(more)
    return out


def answer_gate(ranked: DataFrame, wanted: int, tolerance: float = 0.25, sound: Column | None = None, distinct: DataFrame | None = None) -> DataFrame:
    """(request_id, near, sound, reason): candidates in the distance band, those of them that are
    ``sound`` (by default: not awkward), and why a request can't be answered; three routes may be
    two. ``distinct`` (request_id, distinct) has the size of the choice of distinct routes per
    request, none counting as 0; without it that reason isn't given."""
    least = 2 if wanted == 3 else wanted
    near = F.col("error") <= tolerance
    sound = ~F.col("awkward") if sound is None else sound
    counted = ranked.groupBy("request_id").agg(F.count_if(near).alias("near"), F.count_if(near & sound).alias("sound"))
    reason = F.when(F.col("near") < least, "few in band").when(F.col("sound") < least, "few without doubling back")
    if distinct is not None:
        counted = counted.join(distinct.select("request_id", "distinct"), "request_id", "left")
        reason = reason.when(F.coalesce("distinct", F.lit(0)) < least, "few distinct")
    return counted.withColumn("reason", reason.otherwise("answered")).select("request_id", "near", "sound", "reason")
