"""Street tables derived from the star-schema tables by arithmetic: a grid of nodes 50 wide, its
links, closed walks over it, requests, tiles and scored candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pacegrid import scratch
from pacegrid.functions import geo

WIDTH = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return scratch.dealt(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey").cast("long")
    return table(spark, sf_dir, "part").select(
        k.alias("node_id"),
        (38.0 + F.floor(k / WIDTH) * 0.0013).alias("y"),
        (-78.5 + (k % WIDTH) * 0.0017).alias("x"),
        F.when(k % 97 != 0, 100.0 + F.col("p_size")).alias("elevation"),
        ((k % 11 == 0) | (k % 13 == 0)).alias("signal"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(u, v, key, length, highway, surface) in both directions."""
    at = nodes(spark, sf_dir).select("node_id", "y", "x")
    k = F.col("node_id")
    east = at.filter((k % WIDTH < WIDTH - 1) & (k % 31 != 0)).withColumn("far", k + 1).withColumn("main", F.floor(k / WIDTH) % 7 == 3)
    north = at.withColumn("far", k + WIDTH).withColumn("main", (k % WIDTH) % 7 == 3)
    to = at.select(F.col("node_id").alias("far"), F.col("y").alias("y2"), F.col("x").alias("x2"))
    links = east.unionByName(north).join(to, "far")
    links = links.select(
        "node_id",
        "far",
        F.round(geo.haversine(F.col("y"), F.col("x"), F.col("y2"), F.col("x2")), 6).alias("length"),
        F.when(F.col("main"), "primary").when(k % 5 == 0, "path").otherwise("residential").alias("highway"),
        F.when(F.col("main"), F.lit(None)).when(k % 5 == 0, "gravel").otherwise("asphalt").alias("surface"),
    )
    one = links.select(F.lit(0).alias("key"), "*")
    two = links.filter(k % 17 == 0).select(F.lit(1).alias("key"), "node_id", "far", (F.col("length") * 1.1).alias("length"), F.lit("footway").alias("highway"), F.lit(None).cast("string").alias("surface"))
    both = one.unionByName(two)
    forth = both.select(F.col("node_id").alias("u"), F.col("far").alias("v"), "key", "length", "highway", "surface")
    back = both.filter(k % 29 != 0).select(F.col("far").alias("u"), F.col("node_id").alias("v"), "key", "length", "highway", "surface")
    return forth.unionByName(back)


def road_names(edges: DataFrame) -> DataFrame:
    """``edges`` with ``names``, an array: main roads are named by their row or column."""
    lower = F.least("u", "v")
    row, column = F.floor(lower / WIDTH), lower % WIDTH
    name = F.when(F.abs(F.col("u") - F.col("v")) == 1, F.concat(F.lit("R"), row)).otherwise(F.concat(F.lit("C"), column))
    return edges.withColumn("names", F.when(F.col("highway") == "primary", F.array(name)).otherwise(F.array().cast("array<string>")))


def figure_eights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(route_id, pos, y, x): for each customer a rectangle, and one at its first corner that is walked the
    other way round."""
    s = F.col("c_custkey").cast("long")
    shaped = table(spark, sf_dir, "customer").select(s.alias("route_id"), (s % 3).alias("r"), (s % 44).alias("c"), (1 + s % 4).alias("w"), (1 + s % 2).alias("h"), (1 + s % 3).alias("w2"))
    corner = lambda up, across: F.struct(up.alias("up"), across.alias("across"))
    none = F.lit(0).cast("long")
    w, h, w2 = F.col("w"), F.col("h"), F.col("w2")
    corners = F.array(corner(none, none), corner(none, w), corner(h, w), corner(h, none), corner(none, none), corner(none, -w2), corner(-h, -w2), corner(-h, none), corner(none, none))
    each = shaped.select("route_id", "r", "c", F.posexplode(corners).alias("pos", "at"))
    return each.select("route_id", F.col("pos").cast("long").alias("pos"), (38.0 + (F.col("r") + F.col("at.up")) * 0.0013).alias("y"), (-78.5 + (F.col("c") + F.col("at.across")) * 0.0017).alias("x"))


def returning_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(route_id, pos, y, x): for each customer a street walked out and partly back, on the same line, on
    its other side, or on the next street."""
    s = F.col("c_custkey").cast("long")
    shaped = table(spark, sf_dir, "customer").select(s.alias("route_id"), (s % 7).alias("r"), (s % 44).alias("c"), (1 + s % 4).alias("w"), F.element_at(F.array(F.lit(0.0), F.lit(0.0001), F.lit(0.0003)), (s % 3 + 1).cast("int")).alias("off"))
    point = lambda up, across: F.struct(up.alias("up"), across.alias("across"))
    w, off = F.col("w").cast("double"), F.col("off")
    each = shaped.select("route_id", "r", "c", F.posexplode(F.array(point(F.lit(0.0), F.lit(0.0)), point(F.lit(0.0), w), point(off, w), point(off, w / 3))).alias("pos", "at"))
    return each.select("route_id", F.col("pos").cast("long").alias("pos"), (38.0 + F.col("r") * 0.0013 + F.col("at.up")).alias("y"), (-78.5 + (F.col("c") + F.col("at.across")) * 0.0017).alias("x"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, lat, lon, target_miles): starts near nodes, off the grid."""
    count = nodes(spark, sf_dir).agg(F.count("*").alias("count"))
    k = F.col("o_custkey") % F.col("count")
    return table(spark, sf_dir, "orders").crossJoin(F.broadcast(count)).select(
        F.col("o_orderkey").cast("long").alias("request_id"),
        (38.0003 + F.floor(k / WIDTH) * 0.0013).alias("lat"),
        (-78.4996 + (k % WIDTH) * 0.0017).alias("lon"),
        (2.0 + F.col("o_orderkey") % 5).alias("target_miles"),
    )


def loop_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, origin, lat, lon, target, tolerance, wanted, surface, climb): loops asked for at nodes, one
    per nation; the network grows with the parts."""
    count = nodes(spark, sf_dir).agg(F.count("*").alias("count"))
    s = F.col("n_nationkey").cast("long")
    k = (s * 197 + 60) % F.col("count")
    return table(spark, sf_dir, "nation").crossJoin(F.broadcast(count)).select(
        s.alias("request_id"), k.alias("origin"), (38.0 + F.floor(k / WIDTH) * 0.0013).alias("lat"), (-78.5 + (k % WIDTH) * 0.0017).alias("lon"), (1.0 + s % 2 * 0.5).alias("target"),
        F.lit(0.25).alias("tolerance"), F.lit(3).alias("wanted"), F.lit("mixed").alias("surface"), F.lit("balanced").alias("climb"),
    )


def metro_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(metro, ring, pos, y, x): an L-shaped boundary for each supplier."""
    s = F.col("s_suppkey").cast("long")
    shaped = table(spark, sf_dir, "supplier").select(s.alias("metro"), (30.0 + s % 40 * 0.5).alias("y0"), (-120.0 + s % 97 * 0.5).alias("x0"), (0.03 + s % 5 * 0.013).alias("w"), (0.027 + s % 3 * 0.017).alias("h"))
    corner = lambda up, across: F.struct(F.lit(up).alias("up"), F.lit(across).alias("across"))
    corners = F.array(corner(0.0, 0.0), corner(0.0, 1.0), corner(0.5, 1.0), corner(0.5, 0.5), corner(1.0, 0.5), corner(1.0, 0.0))
    each = shaped.select("metro", "y0", "x0", "w", "h", F.posexplode(corners).alias("pos", "at"))
    return each.select("metro", F.lit(0).alias("ring"), "pos", (F.col("y0") + F.col("at.up") * F.col("h")).alias("y"), (F.col("x0") + F.col("at.across") * F.col("w")).alias("x"))


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tile, lat, lon, reach): discs around nodes."""
    count = nodes(spark, sf_dir).agg(F.count("*").alias("count"))
    s = F.col("s_suppkey").cast("long")
    k = (s * 37) % F.col("count")
    return table(spark, sf_dir, "supplier").crossJoin(F.broadcast(count)).select(
        s.alias("tile"), (38.0 + F.floor(k / WIDTH) * 0.0013).alias("lat"), (-78.5 + (k % WIDTH) * 0.0017).alias("lon"), (300.0 + 50.0 * (s % 10)).alias("reach")
    )


def route_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(route_id, pos, node_id): closed rectangles, one per customer."""
    s = F.col("c_custkey").cast("long")
    shaped = table(spark, sf_dir, "customer").select(s.alias("route_id"), (s % 3).alias("r"), ((s * 7) % 44).alias("c"), (2 + s % 4).alias("w"), (1 + s % 2).alias("h"))
    walked = shaped.withColumn("pos", F.explode(F.sequence(F.lit(0).cast("long"), 2 * (F.col("w") + F.col("h")))))
    p, w, h = F.col("pos"), F.col("w"), F.col("h")
    row = F.when(p <= w, 0).when(p <= w + h, p - w).when(p <= 2 * w + h, h).otherwise(2 * w + 2 * h - p)
    column = F.when(p <= w, p).when(p <= w + h, w).when(p <= 2 * w + h, 2 * w + h - p).otherwise(0)
    return walked.select("route_id", "pos", ((F.col("r") + row) * WIDTH + F.col("c") + column).cast("long").alias("node_id"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored loops of requests; ordinal is their order within the request."""
    lines = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy(*lines.columns)
    return lines.withColumn("ordinal", F.row_number().over(order)).select(
        F.col("l_orderkey").cast("long").alias("request_id"),
        "ordinal",
        (F.col("l_quantity") / 5.0).alias("miles"),
        (F.col("l_extendedprice") / 100.0).alias("gain"),
        (F.col("l_suppkey") % 5).cast("long").alias("signals"),
        (F.col("l_partkey") % 4).cast("long").alias("crossings"),
        (F.col("l_discount") * 10.0).alias("trail"),
        (F.col("l_tax") * 2.0).alias("repeated"),
        ((F.col("l_partkey") % 60) / 100.0).alias("compactness"),
        F.when(F.col("l_linestatus") == "O", 1.0).otherwise(0.9).alias("coverage"),
        F.lit(0.0).alias("drive"),
        (2.0 + F.col("l_orderkey") % 5).alias("target"),
        F.element_at(F.array(F.lit("road"), F.lit("mixed"), F.lit("trail")), (F.col("l_orderkey") % 3 + 1).cast("int")).alias("surface"),
        F.element_at(F.array(F.lit("flat"), F.lit("balanced"), F.lit("hilly")), (F.floor(F.col("l_orderkey") / 3) % 3 + 1).cast("int")).alias("climb"),
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(feature_id, information, amenity, leisure, access, name, lat, lon): mapped places at nodes,
    one per customer."""
    count = nodes(spark, sf_dir).agg(F.count("*").alias("count"))
    s = F.col("c_custkey").cast("long")
    k = (s * 13) % F.col("count")
    return table(spark, sf_dir, "customer").crossJoin(F.broadcast(count)).select(
        s.alias("feature_id"),
        F.when(s % 5 == 0, "Trailhead").alias("information"),
        F.when((s % 5 == 1) | (s % 5 == 4), "parking").alias("amenity"),
        F.when(s % 5 == 2, "park").alias("leisure"),
        F.when(F.col("c_nationkey") % 6 == 0, "private").when(F.col("c_nationkey") % 6 == 1, "Customers").alias("access"),
        F.when(s % 3 != 0, F.col("c_name")).alias("name"),
        (38.0 + F.floor(k / WIDTH) * 0.0013).alias("lat"),
        (-78.5 + (k % WIDTH) * 0.0017).alias("lon"),
    )
