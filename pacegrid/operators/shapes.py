"""Shapes of walked routes: crossings of major roads, doubling back, compactness of any outline.

All work is by route: steps see their neighbours through windows, samples and segments of a route
meet through grid cells, and outlines that cross themselves become faces by splitting their
segments, sorting what leaves each point by angle and following turns by doubling.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from pacegrid import scratch
from pacegrid.functions import geo

#: Fixed values, metres: how far out a road's direction is read; crossings of branches of one node, of
#: one road by name, and how near its two nodes are, that count once.
BEARING_OUT, SAME_JUNCTION, SAME_ROAD, SAME_PLACE = 15.0, 100.0, 60.0, 30.0

#: Fixed values, metres: what is the same street, how far back along the route an earlier part must
#: lie, how far samples are apart; headings are opposite below this cosine.
BESIDE, GAP, SAMPLE, OPPOSITE = 20.0, 40.0, 10.0, -0.5

#: Parts of a route up to which they all meet, without cells.
FEW = 64

#: Metres of the cells in which segments meet; parts of a metre that tell points of outlines apart.
SEGMENT_CELL, GRAIN = 250.0, 10_000


def _turn(angle: Column) -> Column:
    """An angle within one turn from 0."""
    return F.pmod(angle, F.lit(math.tau))


def _left(direction: Column, point: Column) -> Column:
    return F.sin(point - direction) > 0


def _direction(points: Column) -> Column:
    """Direction of a line of (y, x) at its start: to the first point that is far enough out."""
    start, last = F.element_at(points, 1), F.element_at(points, -1)
    apart = lambda p: F.hypot((p["x"] - start["x"]) * F.cos(F.radians(start["y"])), p["y"] - start["y"]) * geo.LONGITUDE_METRES
    out = F.filter(F.slice(points, 2, 1 << 30), lambda p: apart(p) >= BEARING_OUT)
    to = F.when(F.size(out) > 0, F.get(out, F.lit(0))).otherwise(last)
    return F.atan2(to["y"] - start["y"], (to["x"] - start["x"]) * F.cos(F.radians(start["y"])))


def directed(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``edges`` (u, v, ...) with the directions that leave their ends: ``leaving`` u, ``arrived`` back from
    v. A column ``line``, an array of (y, x) either way round, is their drawn line; without it they
    are straight."""
    place = lambda end: nodes.select(F.col("node_id").alias(end), F.struct("y", "x").alias(f"{end}_at"))
    both = edges.join(place("u"), "u").join(place("v"), "v")
    straight = F.array("u_at", "v_at")
    if "line" in edges.columns:
        off = lambda p: F.abs(p["y"] - F.col("u_at.y")) + F.abs(p["x"] - F.col("u_at.x"))
        forth = off(F.element_at("line", 1)) <= off(F.element_at("line", -1))
        straight = F.when(F.size("line") >= 2, F.when(forth, F.col("line")).otherwise(F.reverse("line"))).otherwise(straight)
    drawn = both.withColumn("line", straight)
    return drawn.withColumns({"leaving": _direction(F.col("line")), "arrived": _direction(F.reverse("line"))}).drop("u_at", "v_at")


def major_branches(lined: DataFrame) -> DataFrame:
    """(node_id, branches) of nodes with major roads, from ``directed`` edges with ``major`` and ``names``:
    one branch (other, bearing, names) per neighbour, by the edge that leaves if there is one."""
    major = lined.filter("major")
    out = major.select(F.col("u").alias("node_id"), F.col("v").alias("other"), F.lit(1).alias("leaves"), F.col("leaving").alias("bearing"), "names")
    into = major.select(F.col("v").alias("node_id"), F.col("u").alias("other"), F.lit(0).alias("leaves"), F.col("arrived").alias("bearing"), "names")
    best = out.unionByName(into).groupBy("node_id", "other").agg(F.max(F.struct("leaves", "bearing", "names")).alias("best"))
    branch = F.struct("other", F.col("best.bearing").alias("bearing"), F.col("best.names").alias("names"))
    return best.groupBy("node_id").agg(F.collect_list(branch).alias("branches"))


def passed_nodes(route_nodes: DataFrame, lined: DataFrame) -> DataFrame:
    """(route_id, pos, before, node_id, after, travelled, in_major, out_major, back, ahead) of all nodes of
    routes but their ends: metres walked to them, and the directions back and on."""
    along = Window.partitionBy("route_id").orderBy("pos")
    rows = route_nodes.select("route_id", "pos", "node_id", F.lag("node_id").over(along).alias("before"), F.lead("node_id").over(along).alias("after"))
    into = lined.select(F.col("u").alias("before"), F.col("v").alias("node_id"), "length", F.col("major").alias("in_major"), F.col("arrived").alias("back"))
    out = lined.select(F.col("u").alias("node_id"), F.col("v").alias("after"), F.col("major").alias("out_major"), F.col("leaving").alias("ahead"))
    both = rows.filter("before is not null and after is not null").join(into, ["before", "node_id"], "left").join(out, ["node_id", "after"], "left")
    both = both.withColumns({"in_major": F.coalesce("in_major", F.lit(False)), "out_major": F.coalesce("out_major", F.lit(False))})
    return both.withColumn("travelled", F.sum(F.coalesce("length", F.lit(0.0))).over(along.rowsBetween(Window.unboundedPreceding, 0))).drop("length")


def changes_of_side(passed: DataFrame, branches: DataFrame) -> DataFrame:
    """``passed`` nodes at which a route changes side of a major road, with the node's branches. Off major
    roads it does where branches lie on both sides of its way. Along one it does at every branch on its
    side, and where it leaves on the other side than it joined; a stretch begun on the road has no
    side."""
    along = Window.partitionBy("route_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    back, ahead = F.col("back"), F.col("ahead")
    joins = F.when(F.col("out_major") & ~F.col("in_major"), _left(ahead, back))
    rows = passed.withColumn("stretch", F.count_if(~F.col("in_major")).over(along))
    rows = rows.withColumn("joined_left", F.max(joins).over(Window.partitionBy("route_id", "stretch")))
    rows = rows.join(branches, "node_id")
    between = lambda b, start, end: _turn(b["bearing"] - start) < _turn(end - start)
    through = F.exists("branches", lambda b: between(b, back, ahead)) & ~F.forall("branches", lambda b: between(b, back, ahead))
    others = F.filter("branches", lambda b: (b["other"] != F.col("before")) & (b["other"] != F.col("after")))
    left = F.col("joined_left")
    beside = F.when(left, F.exists(others, lambda b: between(b, ahead, back))).otherwise(F.exists(others, lambda b: between(b, back, ahead)))
    leaves = ~F.col("out_major") & (left != _left(back + math.pi, ahead))
    on_major = F.col("in_major") | F.col("out_major")
    crossed = F.when(~on_major, through).otherwise(F.coalesce(left.isNotNull() & (beside | leaves), F.lit(False)))
    return rows.filter(crossed).select("route_id", "pos", "node_id", "travelled", "branches")


def major_crossings(route_nodes: DataFrame, lined: DataFrame, nodes: DataFrame) -> DataFrame:
    """(route_id, pos) of routes' crossings of major roads. Of a route's changes of side, taken in order,
    one doesn't count that follows the last counted one within a junction, or on the same road at
    the same place. A route's few changes are folded in one row. The edges' directions, read three
    times, are checkpointed."""
    lined = lined.select("u", "v", "length", "major", "names", "leaving", "arrived").transform(scratch.kept)
    changes = changes_of_side(passed_nodes(route_nodes, lined).transform(scratch.kept), major_branches(lined)).transform(scratch.kept).join(nodes.select("node_id", "y", "x"), "node_id")
    names = F.array_distinct(F.flatten(F.transform("branches", lambda b: b["names"])))
    change = F.struct("pos", "travelled", "y", "x", names.alias("names"), F.transform("branches", lambda b: b["other"]).alias("near"))
    folded = changes.groupBy("route_id").agg(F.sort_array(F.collect_list(change)).alias("changes"))

    def counted(kept, c):
        last = F.element_at(kept, -1)
        walked = c["travelled"] - last["travelled"]
        junction = (walked <= SAME_JUNCTION) & F.arrays_overlap(c["near"], last["near"])
        place = geo.haversine(c["y"], c["x"], last["y"], last["x"]) <= SAME_PLACE
        road = (walked <= SAME_ROAD) & F.arrays_overlap(c["names"], last["names"]) & place
        # Of an empty list there is no last one.
        return F.when((F.size(kept) > 0) & F.coalesce(junction | road, F.lit(False)), kept).otherwise(F.concat(kept, F.array(c)))

    first = F.slice("changes", 1, 1)
    kept = F.aggregate(F.slice("changes", 2, 1 << 30), first, counted)
    return folded.select("route_id", F.explode(F.transform(kept, lambda c: c["pos"])).alias("pos"))


def _flat(points: DataFrame) -> DataFrame:
    """Points with local metres (e, n), by the latitude of their route's first one."""
    along = Window.partitionBy("route_id").orderBy("pos")
    first = F.first("y").over(along)
    return points.withColumns({"e": F.col("x") * geo.LONGITUDE_METRES * F.cos(F.radians(first)), "n": F.col("y") * geo.LATITUDE_METRES})


def doubled_back(points: DataFrame) -> DataFrame:
    """(route_id, doubled) of drawn lines (route_id, pos, y, x): the share of a route's length that runs
    back along an earlier part of it, by samples that have an earlier one of opposite heading beside
    them. The gap between the two, along the route or around its end, keeps turns out. Parts of a route
    meet, not their samples: all of a route of ``FEW`` parts, else those of one cell. A sample looks at
    the few of the other part that can lie beside it."""
    along = Window.partitionBy("route_id").orderBy("pos")
    whole = Window.partitionBy("route_id")
    flat = _flat(points).select("route_id", "pos", "e", "n", (F.lead("e").over(along) - F.col("e")).alias("de"), (F.lead("n").over(along) - F.col("n")).alias("dn"))
    parts = flat.withColumn("length", F.hypot("de", "dn")).filter("length > 0")
    parts = parts.withColumn("walked", F.sum("length").over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length"))
    parts = parts.withColumns({"total": F.sum("length").over(whole), "parts": F.count("*").over(whole)})
    long = parts.filter(F.col("total") > 2 * GAP)

    def laid(wider: float) -> DataFrame:
        """Parts in the cells that their surroundings touch."""
        cells = lambda c: F.sequence(F.floor((F.least(F.col(c), F.col(c) + F.col(f"d{c}")) - wider) / SEGMENT_CELL), F.floor((F.greatest(F.col(c), F.col(c) + F.col(f"d{c}")) + wider) / SEGMENT_CELL))
        one = lambda c: F.when(F.col("parts") <= FEW, F.array(F.lit(0).cast("long"))).otherwise(cells(c))
        return long.withColumn("row", F.explode(one("n"))).withColumn("column", F.explode(one("e"))).drop("parts", "length")

    other = laid(BESIDE + 1).select("route_id", "row", "column", *(F.col(c).alias(f"o_{c}") for c in ("pos", "e", "n", "de", "dn", "walked")))
    met = laid(0.0).join(scratch.dealt(other), ["route_id", "row", "column"])
    size, o_size = F.hypot("de", "dn"), F.hypot("o_de", "o_dn")
    many = lambda length: F.greatest(F.lit(1), F.floor(length / SAMPLE).cast("int"))
    close = lambda c: (F.least(F.col(c), F.col(c) + F.col(f"d{c}")) <= F.greatest(F.col(f"o_{c}"), F.col(f"o_{c}") + F.col(f"o_d{c}")) + BESIDE + 1) & (F.greatest(F.col(c), F.col(c) + F.col(f"d{c}")) >= F.least(F.col(f"o_{c}"), F.col(f"o_{c}") + F.col(f"o_d{c}")) - BESIDE - 1)
    opposite = (F.col("de") / size) * (F.col("o_de") / o_size) + (F.col("dn") / size) * (F.col("o_dn") / o_size) < OPPOSITE
    pairs = met.filter((F.col("o_pos") < F.col("pos")) & opposite & close("e") & close("n"))
    pairs = pairs.withColumns({"length": size, "o_length": o_size, "samples": many(size), "o_samples": many(o_size)})
    each = pairs.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("samples") - 1)))
    share = F.col("k") / F.col("samples")
    each = each.withColumns({"at_e": F.col("e") + F.col("de") * share, "at_n": F.col("n") + F.col("dn") * share, "at": F.col("walked") + F.col("length") * share, "weight": F.col("length") / F.col("samples")})
    # Samples of the other part are even: those within BESIDE lie about the foot of this one on it.
    foot = ((F.col("at_e") - F.col("o_e")) * F.col("o_de") + (F.col("at_n") - F.col("o_n")) * F.col("o_dn")) / F.col("o_length")
    nth = lambda metres: F.floor(metres * F.col("o_samples") / F.col("o_length")).cast("int")
    each = each.withColumns({"first": F.greatest(F.lit(0), nth(foot - BESIDE)), "last": F.least(F.col("o_samples") - 1, nth(foot + BESIDE) + 1)})
    each = each.filter("first <= last").withColumn("j", F.explode(F.sequence("first", "last")))
    o_share = F.col("j") / F.col("o_samples")
    gap = F.col("at") - (F.col("o_walked") + F.col("o_length") * o_share)
    near = F.hypot(F.col("at_e") - (F.col("o_e") + F.col("o_de") * o_share), F.col("at_n") - (F.col("o_n") + F.col("o_dn") * o_share)) <= BESIDE
    found = each.filter(near & (gap > 0) & (F.least(gap, F.col("total") - gap) > GAP)).select("route_id", "pos", "k", "weight").distinct().groupBy("route_id").agg(F.sum("weight").alias("back"))
    totals = parts.groupBy("route_id").agg(F.max("total").alias("total"))
    routes = points.select("route_id").distinct()
    return routes.join(totals, "route_id", "left").join(found, "route_id", "left").select("route_id", F.coalesce(F.col("back") / F.col("total"), F.lit(0.0)).alias("doubled"))


def outlines(points: DataFrame) -> DataFrame:
    """(route_id, k, e, n, e2, n2, points) of the closed outlines' segments of some length, in local
    metres about the first point, to the grain that tells points apart."""
    along = Window.partitionBy("route_id").orderBy("pos")
    whole = Window.partitionBy("route_id")
    grain = lambda c: F.round(c * GRAIN).cast("long")
    flat = _flat(points).select("route_id", "pos", grain(F.col("e") - F.first("e").over(along)).alias("e"), grain(F.col("n") - F.first("n").over(along)).alias("n"), F.count("*").over(whole).alias("points"))
    first = lambda c: F.first(c).over(along)
    closed = flat.withColumns({"e2": F.coalesce(F.lead("e").over(along), first("e")), "n2": F.coalesce(F.lead("n").over(along), first("n"))})
    kept = closed.filter("e <> e2 or n <> n2")
    return kept.withColumn("k", F.row_number().over(along)).select("route_id", "k", "e", "n", "e2", "n2", "points")


def _cross(ax, ay, bx, by) -> Column:
    return ax * by - ay * bx


def meetings(segments: DataFrame) -> DataFrame:
    """(route_id, k, other, e, n) of points at which a route's segments meet that don't follow one another:
    crossings and touches, and the ends of one on the other where they overlap. Each point is listed
    for both."""
    size = round(SEGMENT_CELL * GRAIN)
    cells = lambda a, b: F.sequence(F.floor(F.least(a, b) / size), F.floor(F.greatest(a, b) / size))
    laid = segments.withColumn("row", F.explode(cells(F.col("n"), F.col("n2")))).withColumn("column", F.explode(cells(F.col("e"), F.col("e2"))))
    other = laid.select("route_id", "row", "column", F.col("k").alias("other"), *(F.col(c).alias(f"o_{c}") for c in ("e", "n", "e2", "n2")))
    # Of the cells that two segments share the least one counts, so no pair is listed twice.
    least = lambda a: F.greatest(*(F.floor(F.least(F.col(f"{o}{a}"), F.col(f"{o}{a}2")) / size) for o in ("", "o_")))
    met = laid.join(scratch.dealt(other), ["route_id", "row", "column"]).filter((F.col("k") < F.col("other")) & (F.col("row") == least("n")) & (F.col("column") == least("e"))).drop("row", "column")
    d = lambda c: F.col(c).cast("double")
    me, mn, oe, on = d("e2") - d("e"), d("n2") - d("n"), d("o_e2") - d("o_e"), d("o_n2") - d("o_n")
    we, wn = d("o_e") - d("e"), d("o_n") - d("n")
    area = _cross(me, mn, oe, on)
    t, s = F.try_divide(_cross(we, wn, oe, on), area), F.try_divide(_cross(we, wn, me, mn), area)
    point = lambda e, n: F.struct(F.round(e).cast("long").alias("e"), F.round(n).cast("long").alias("n"))
    none = F.array().cast("array<struct<e: bigint, n: bigint>>")
    crossing = F.when((area != 0) & t.between(0, 1) & s.between(0, 1), F.array(point(d("e") + t * me, d("n") + t * mn))).otherwise(none)

    def on_it(e: str, n: str, start: str, along_e: Column, along_n: Column) -> Column:
        """An end of one segment if it lies on the other one's line and within it."""
        fe, fn = d(e) - d(f"{start}e"), d(n) - d(f"{start}n")
        share = (fe * along_e + fn * along_n) / (along_e * along_e + along_n * along_n)
        return F.when((area == 0) & (_cross(fe, fn, along_e, along_n) == 0) & share.between(0, 1), point(d(e), d(n)))

    ends = F.array_compact(F.array(on_it("o_e", "o_n", "", me, mn), on_it("o_e2", "o_n2", "", me, mn), on_it("e", "n", "o_", oe, on), on_it("e2", "n2", "o_", oe, on)))
    found = met.select("route_id", "k", "other", F.explode(F.array_distinct(F.concat(crossing, ends))).alias("at")).select("route_id", "k", "other", "at.e", "at.n")
    return found.unionByName(found.select("route_id", F.col("other").alias("k"), F.col("k").alias("other"), "e", "n"))


def face_areas(segments: DataFrame, met: DataFrame) -> DataFrame:
    """(route_id, area) of outlines: the area of all faces that their segments enclose, each once. Split
    at meetings, the distinct pieces are taken both ways; a piece is followed by the next one to the right
    of the way back at its end, and around a face the pieces' cross products add up to its area."""
    ends = segments.select("route_id", "k", "e", "n").unionByName(segments.select("route_id", "k", F.col("e2").alias("e"), F.col("n2").alias("n")))
    marks = ends.unionByName(met.select("route_id", "k", "e", "n")).distinct()
    starts = segments.select("route_id", "k", F.col("e").alias("from_e"), F.col("n").alias("from_n"))
    order = Window.partitionBy("route_id", "k").orderBy(F.hypot((F.col("e") - F.col("from_e")).cast("double"), (F.col("n") - F.col("from_n")).cast("double")), "e", "n")
    cut = marks.join(scratch.dealt(starts), ["route_id", "k"]).select("route_id", "e", "n", F.lead("e").over(order).alias("e2"), F.lead("n").over(order).alias("n2")).filter("e2 is not null")
    back = cut.select("route_id", F.col("e2").alias("e"), F.col("n2").alias("n"), F.col("e").alias("e2"), F.col("n").alias("n2"))
    pieces = cut.unionByName(back).filter("e <> e2 or n <> n2").distinct().withColumn("angle", F.atan2((F.col("n2") - F.col("n")).cast("double"), (F.col("e2") - F.col("e")).cast("double")))
    at = Window.partitionBy("route_id", "e", "n").orderBy("angle")
    whole = Window.partitionBy("route_id", "e", "n")
    piece = F.struct("e", "n", "e2", "n2")
    # To the right of the way that leaves a point: the one of the next smaller angle, the largest after the least.
    turns = pieces.select("route_id", piece.alias("leaves"), F.coalesce(F.lag(piece).over(at), F.max_by(piece, "angle").over(whole)).alias("next"))
    backward = F.struct(F.col("leaves.e2").alias("e"), F.col("leaves.n2").alias("n"), F.col("leaves.e").alias("e2"), F.col("leaves.n").alias("n2"))
    step = turns.select("route_id", backward.alias("piece"), "next").withColumn("least", F.least("piece", "next")).transform(scratch.kept)
    while True:
        on = step.select("route_id", F.col("piece").alias("next"), F.col("next").alias("further"), F.col("least").alias("lesser"))
        now = step.join(on, ["route_id", "next"]).select("route_id", "piece", F.col("further").alias("next"), F.least("least", "lesser").alias("least"), (F.col("lesser") < F.col("least")).alias("moved")).transform(scratch.kept)
        step = now.drop("moved")
        if now.filter("moved").isEmpty():
            break
    metre = lambda c: F.col(f"piece.{c}") / GRAIN
    faces = step.groupBy("route_id", "least").agg((F.sum(_cross(metre("e"), metre("n"), metre("e2"), metre("n2"))) / 2).alias("area"))
    return faces.filter("area > 0").groupBy("route_id").agg(F.sum("area").alias("area"))


def compactness(points: DataFrame) -> DataFrame:
    """(route_id, compactness) of closed outlines (route_id, pos, y, x): 4 pi area / perimeter squared, 1
    at most; 0 for fewer than four points or no length. The area is that of all faces which an outline
    encloses where it meets itself, else the ring's."""
    segments = outlines(points).transform(scratch.kept)
    last = segments.groupBy("route_id").agg(F.max("k").alias("last"))
    met = meetings(segments).join(last, "route_id").transform(scratch.kept)
    follow = (F.abs(F.col("k") - F.col("other")) == 1) | (F.abs(F.col("k") - F.col("other")) == F.col("last") - 1)
    again = segments.groupBy("route_id", "e", "n").agg(F.count("*").alias("times")).filter("times > 1").select("route_id")
    crossed = met.filter(~follow).select("route_id").unionByName(again).distinct().transform(scratch.kept)
    faces = face_areas(segments.join(crossed, "route_id", "left_semi"), met.join(crossed, "route_id", "left_semi"))
    metre = lambda c: F.col(c) / GRAIN
    rings = segments.groupBy("route_id").agg(
        F.max("points").alias("points"),
        F.abs(F.sum(_cross(metre("e"), metre("n"), metre("e2"), metre("n2"))) / 2).alias("ring"),
        F.sum(F.hypot(metre("e2") - metre("e"), metre("n2") - metre("n"))).alias("around"),
    )
    both = points.select("route_id").distinct().join(rings, "route_id", "left").join(faces, "route_id", "left")
    both = both.join(crossed.withColumn("crossed", F.lit(True)), "route_id", "left")
    area = F.when(F.col("crossed"), F.coalesce("area", F.lit(0.0))).otherwise(F.col("ring"))
    value = F.least(F.lit(1.0), 4 * F.lit(math.pi) * area / (F.col("around") * F.col("around")))
    return both.select("route_id", F.when((F.col("points") >= 4) & (F.col("around") > 0), value).otherwise(0.0).alias("compactness"))
