"""Queries on cheapest paths and the shapes of routes, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pacegrid import scratch
from pacegrid.operators import network, paths, routes, shapes
from pacegrid.plans.street_queries import EDGES, ENTERED, NODES, ROUTES, cost_sql
from pacegrid.sources import street_tables as t

#: Where each node's path leads: so many rows up and columns on. Metres of cost of a search at first.
ROWS_UP, COLUMNS_ON, LIMIT = 2, 3, 1500.0


def _collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    costs = network.edge_costs(t.edges(spark, sf_dir), t.nodes(spark, sf_dir), "mixed", False)
    return network.collapse(costs)


def chosen_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one edge per pair of ends that its cost chose, with its tags."""
    return t.edges(spark, sf_dir).join(_collapsed(spark, sf_dir).select("u", "v", "key"), ["u", "v", "key"])


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = t.nodes(spark, sf_dir).select("node_id")
    inner = ids.filter(F.col("node_id") % t.WIDTH < t.WIDTH - COLUMNS_ON)
    pairs = inner.select(F.col("node_id").alias("source"), (F.col("node_id") + ROWS_UP * t.WIDTH + COLUMNS_ON).alias("target"))
    return pairs.join(ids.withColumnRenamed("node_id", "target"), "target", "left_semi").select("source", "target")


def _drawn(read: DataFrame, edges: DataFrame, *of: str) -> DataFrame:
    """Metres, hops and nodes of paths (of, pos, node_id)."""
    named = read.withColumnRenamed("source", "first") if "source" in read.columns else read
    walked = routes.steps(read.select(F.struct(*of).alias("route_id"), "pos", "node_id"))
    metres = walked.join(edges.select("u", "v", "length"), ["u", "v"]).groupBy("route_id").agg(F.round(F.sum("length"), 2).alias("metres"))
    nodes = named.groupBy(F.struct(*(F.col("first").alias("source") if c == "source" else F.col(c) for c in of)).alias("route_id")).agg(
        F.max("pos").alias("hops"), F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("pos", "node_id"))), lambda p: p["node_id"].cast("string"))).alias("nodes")
    )
    return nodes.join(metres, "route_id", "left").select("route_id.*", F.coalesce("metres", F.lit(0.0)).alias("metres"), "hops", "nodes")


def path_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From every node the cheapest path to the node that lies so many rows up and columns on."""
    scratch.checkpoints(spark)
    links = paths.cost_links(_collapsed(spark, sf_dir))
    costs, read = paths.cheapest_paths(_pairs(spark, sf_dir), links, LIMIT, places=t.nodes(spark, sf_dir))
    drawn = _drawn(read, chosen_edges(spark, sf_dir), "source", "target")
    return drawn.join(costs, ["source", "target"]).select("source", "target", F.round(F.col("cost") / paths.UNIT, 3).alias("cost"), "metres", "hops", "nodes")


def separated_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ways back of all these paths, off the streets that led out where that isn't three times as dear."""
    scratch.checkpoints(spark)
    links = paths.cost_links(_collapsed(spark, sf_dir)).transform(scratch.kept)
    costs, read = paths.cheapest_paths(_pairs(spark, sf_dir), links, LIMIT, places=t.nodes(spark, sf_dir))
    used = routes.steps(read.select(F.col("source").alias("route_id"), "pos", "node_id")).select(F.col("route_id").alias("pair"), "u", "v")
    back = costs.select(F.col("source").alias("pair"), F.col("target").alias("source"), F.col("source").alias("target"))
    return _drawn(paths.penalised_paths(back, links, used, places=t.nodes(spark, sf_dir)), chosen_edges(spark, sf_dir), "pair")


def whole_routes(spark: SparkSession, sf_dir: str, edges: DataFrame) -> DataFrame:
    """Nodes of the routes whose every step has an edge."""
    walked = t.route_nodes(spark, sf_dir)
    broken = routes.steps(walked).join(edges, ["u", "v"], "left_anti").select("route_id").distinct()
    return walked.join(broken, "route_id", "left_anti")


def _lined(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return shapes.directed(t.road_names(edges).withColumn("major", network.is_major(edges)), nodes)


def major_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch.checkpoints(spark)
    nodes, edges = t.nodes(spark, sf_dir), chosen_edges(spark, sf_dir)
    return shapes.major_crossings(whole_routes(spark, sf_dir, edges), _lined(edges, nodes), nodes)


def doubled_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shapes.doubled_back(t.returning_lines(spark, sf_dir))
    return found.select("route_id", F.round("doubled", 6).alias("doubled"))


def crossed_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch.checkpoints(spark)
    found = shapes.compactness(t.figure_eights(spark, sf_dir))
    return found.select("route_id", F.round("compactness", 4).alias("compactness"))


QUERIES = {
    "gph6_path_trees": path_trees,
    "gph9_separated_returns": separated_returns,
    "rte5_major_crossings": major_crossings,
    "rte8_doubled_back": doubled_back,
    "rte7_crossed_outlines": crossed_outlines,
}

CHOSEN = f"""{ENTERED}, chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY u, v ORDER BY cost, key) AS rn FROM ({cost_sql("mixed", False)})) WHERE rn = 1),
ways AS (SELECT u, v, key, greatest(1, CAST(round(cost * 1000000) AS BIGINT)) AS cost FROM chosen), one AS (SELECT e.*, s.major FROM edges e JOIN ways USING (u, v, key) JOIN sided s USING (u, v, key))"""

_PATHS = f"""{NODES}, {EDGES}, {CHOSEN}, dist(source, node, cost) USING KEY (source, node) AS (
  SELECT node_id AS source, node_id AS node, CAST(0 AS BIGINT) AS cost FROM nodes
  UNION SELECT d.source, l.v, min(d.cost + l.cost) FROM dist d JOIN ways l ON d.node = l.u LEFT JOIN recurring.dist r ON r.source = d.source AND r.node = l.v
  WHERE d.cost + l.cost <= 4000000000 AND (r.cost IS NULL OR d.cost + l.cost < r.cost) GROUP BY d.source, l.v
), parents AS (
  SELECT a.source, l.v AS node, min(l.u) AS parent FROM dist a JOIN ways l ON a.node = l.u JOIN dist b ON b.source = a.source AND b.node = l.v AND b.cost = a.cost + l.cost WHERE l.v <> a.source GROUP BY a.source, l.v
), pairs AS (
  SELECT d.source, d.node AS target, d.cost FROM dist d WHERE d.node = d.source + {ROWS_UP * 50 + COLUMNS_ON} AND d.source % 50 < {50 - COLUMNS_ON}
), back AS (
  SELECT source, target, target AS node, 0 AS back FROM pairs UNION ALL SELECT b.source, b.target, p.parent, b.back + 1 FROM back b JOIN parents p USING (source, node)
)"""

_BEARING = "atan2({0}.y - {1}.y, ({0}.x - {1}.x) * cos(radians({1}.y)))"
_MOD = "(({0}) % (2 * pi()) + 2 * pi()) % (2 * pi())"

SQL = {
    "gph6_path_trees": f"""WITH RECURSIVE {_PATHS}
SELECT b.source, b.target, round(any_value(p.cost) / 1000000e0, 3) AS cost, round(sum(coalesce(e.length, 0e0)), 2) AS metres, CAST(max(back) AS BIGINT) AS hops, string_agg(CAST(b.node AS VARCHAR), ',' ORDER BY back DESC) AS nodes
FROM back b JOIN pairs p USING (source, target) LEFT JOIN parents f USING (source, node) LEFT JOIN one e ON e.u = f.parent AND e.v = b.node GROUP BY b.source, b.target""",
    "gph9_separated_returns": f"""WITH RECURSIVE {_PATHS}, used AS (
  SELECT DISTINCT b.source AS pair, unnest([f.parent, b.node]) AS u, unnest([b.node, f.parent]) AS v FROM back b JOIN parents f USING (source, node)
), home(pair, node, cost) USING KEY (pair, node) AS (
  SELECT source AS pair, target AS node, CAST(0 AS BIGINT) AS cost FROM pairs
  UNION SELECT d.pair, l.v, min(d.cost + l.cost * CASE WHEN x.u IS NULL THEN 1 ELSE 3 END) FROM home d JOIN ways l ON d.node = l.u LEFT JOIN used x ON x.pair = d.pair AND x.u = l.u AND x.v = l.v
  LEFT JOIN recurring.home r ON r.pair = d.pair AND r.node = l.v
  WHERE d.cost + l.cost * CASE WHEN x.u IS NULL THEN 1 ELSE 3 END <= 6000000000 AND (r.cost IS NULL OR d.cost + l.cost * CASE WHEN x.u IS NULL THEN 1 ELSE 3 END < r.cost) GROUP BY d.pair, l.v
), before AS (
  SELECT a.pair, l.v AS node, min(l.u) AS parent FROM home a JOIN ways l ON a.node = l.u LEFT JOIN used x ON x.pair = a.pair AND x.u = l.u AND x.v = l.v
  JOIN home b ON b.pair = a.pair AND b.node = l.v AND b.cost = a.cost + l.cost * CASE WHEN x.u IS NULL THEN 1 ELSE 3 END JOIN pairs p ON p.source = a.pair WHERE l.v <> p.target GROUP BY a.pair, l.v
), returned AS (
  SELECT h.pair, h.node, 0 AS back FROM home h WHERE h.node = h.pair UNION ALL SELECT r.pair, f.parent, r.back + 1 FROM returned r JOIN before f USING (pair, node)
)
SELECT r.pair, round(sum(coalesce(e.length, 0e0)), 2) AS metres, CAST(max(back) AS BIGINT) AS hops, string_agg(CAST(r.node AS VARCHAR), ',' ORDER BY back DESC) AS nodes
FROM returned r LEFT JOIN before f USING (pair, node) LEFT JOIN one e ON e.u = f.parent AND e.v = r.node GROUP BY r.pair""",
    "rte5_major_crossings": f"""WITH RECURSIVE {NODES}, {EDGES}, {CHOSEN}, {ROUTES}, broken AS (SELECT DISTINCT s.route_id FROM steps s LEFT JOIN one USING (u, v) WHERE one.u IS NULL),
passed AS (
  SELECT * FROM (SELECT route_id, pos, lag(node_id) OVER w AS a, node_id AS n, lead(node_id) OVER w AS b FROM route_nodes WHERE route_id NOT IN (FROM broken) WINDOW w AS (PARTITION BY route_id ORDER BY pos)) WHERE a IS NOT NULL AND b IS NOT NULL
), placed AS (
  SELECT p.*, i.major AS ins, o.major AS outs, sum(i.length) OVER (PARTITION BY route_id ORDER BY pos) AS travelled, here.y, here.x, {_BEARING.format("f", "here")} AS back, {_BEARING.format("t", "here")} AS ahead
  FROM passed p JOIN one i ON i.u = a AND i.v = n JOIN one o ON o.u = n AND o.v = b JOIN nodes here ON here.node_id = n JOIN nodes f ON f.node_id = a JOIN nodes t ON t.node_id = b
), ends AS (
  SELECT u AS n, v AS other FROM one WHERE major UNION SELECT v, u FROM one WHERE major
), branches AS (
  SELECT e.n, e.other, {_BEARING.format("o", "here")} AS bearing, CASE WHEN abs(e.n - e.other) = 1 THEN 'R' || CAST(floor(least(e.n, e.other) / 50) AS BIGINT) ELSE 'C' || (least(e.n, e.other) % 50) END AS name
  FROM ends e JOIN nodes here ON here.node_id = e.n JOIN nodes o ON o.node_id = e.other
), stretched AS (
  SELECT *, count(*) FILTER (NOT ins) OVER (PARTITION BY route_id ORDER BY pos) AS stretch FROM placed
), joined AS (
  SELECT *, max(CASE WHEN outs AND NOT ins THEN CASE WHEN sin(back - ahead) > 0 THEN 1 ELSE 0 END END) OVER (PARTITION BY route_id, stretch) AS left_side FROM stretched
), judged AS (
  SELECT s.route_id, s.pos, s.travelled, s.y, s.x, list(other) AS near, list(name) AS names,
    CASE WHEN NOT any_value(ins OR outs) THEN bool_or({_MOD.format("bearing - back")} < {_MOD.format("ahead - back")}) AND NOT bool_and({_MOD.format("bearing - back")} < {_MOD.format("ahead - back")})
      ELSE coalesce(any_value(left_side) IS NOT NULL AND (coalesce(CASE WHEN any_value(left_side) = 1 THEN bool_or({_MOD.format("bearing - ahead")} < {_MOD.format("back - ahead")}) FILTER (other NOT IN (a, b))
        ELSE bool_or({_MOD.format("bearing - back")} < {_MOD.format("ahead - back")}) FILTER (other NOT IN (a, b)) END, false)
        OR (NOT any_value(outs) AND any_value(left_side) <> any_value(CASE WHEN sin(ahead - back - pi()) > 0 THEN 1 ELSE 0 END))), false) END AS crossed
  FROM joined s JOIN branches USING (n) GROUP BY ALL
), changes AS (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY pos) AS rn FROM judged WHERE crossed),
folded AS (
  SELECT route_id, rn, pos, travelled, near, names, true AS counted FROM changes WHERE rn = 1
  UNION ALL SELECT c.route_id, c.rn, CASE WHEN same THEN f_pos ELSE pos END, CASE WHEN same THEN f_travelled ELSE travelled END, CASE WHEN same THEN f_near ELSE near END, CASE WHEN same THEN f_names ELSE names END, NOT same
  FROM (SELECT c.*, f.pos AS f_pos, f.travelled AS f_travelled, f.near AS f_near, f.names AS f_names, c.travelled - f.travelled <= 100e0 AND list_has_any(c.near, f.near) AS same FROM folded f JOIN changes c ON c.route_id = f.route_id AND c.rn = f.rn + 1) c
)
SELECT route_id, pos FROM folded WHERE counted""",
    "rte8_doubled_back": """WITH shaped AS (SELECT CAST(c_custkey AS BIGINT) AS route_id, c_custkey % 7 AS r, c_custkey % 44 AS c, CAST(1 + c_custkey % 4 AS DOUBLE) AS w, [0e0, 0.0001e0, 0.0003e0][CAST(c_custkey % 3 + 1 AS INT)] AS off FROM customer),
corners AS (SELECT route_id, unnest([0, 1, 2, 3]) AS pos, r, c, unnest([0e0, 0e0, off, off]) AS up, unnest([0e0, w, w, w / 3]) AS across FROM shaped),
points AS (SELECT route_id, pos, 38e0 + r * 0.0013e0 + up AS y, -78.5e0 + (c + across) * 0.0017e0 AS x FROM corners),
flat AS (SELECT route_id, pos, x * 111320e0 * cos(radians(first_value(y) OVER w)) AS e, y * 110540e0 AS n FROM points WINDOW w AS (PARTITION BY route_id ORDER BY pos)),
legs AS (SELECT *, lead(e) OVER w - e AS de, lead(n) OVER w - n AS dn FROM flat WINDOW w AS (PARTITION BY route_id ORDER BY pos)),
sized AS (SELECT *, sqrt(de * de + dn * dn) AS length FROM legs WHERE de <> 0 OR dn <> 0),
walked AS (SELECT *, sum(length) OVER (PARTITION BY route_id ORDER BY pos) - length AS walked, sum(length) OVER (PARTITION BY route_id) AS total, greatest(1, CAST(floor(length / 10) AS BIGINT)) AS many FROM sized),
samples AS (SELECT *, unnest(generate_series(0, many - 1)) AS k FROM walked WHERE total > 80),
placed AS (SELECT route_id, pos, k, total, e + de * k / many AS e, n + dn * k / many AS n, walked + length * k / many AS metre, de / length AS he, dn / length AS hn, length / many AS weight FROM samples),
back AS (SELECT DISTINCT a.route_id, a.pos, a.k, a.weight FROM placed a JOIN placed b ON a.route_id = b.route_id AND b.metre < a.metre
  WHERE least(a.metre - b.metre, a.total - a.metre + b.metre) > 40 AND sqrt((a.e - b.e) * (a.e - b.e) + (a.n - b.n) * (a.n - b.n)) <= 20 AND a.he * b.he + a.hn * b.hn < -0.5e0),
doubled AS (SELECT route_id, sum(weight) AS back FROM back GROUP BY route_id)
SELECT w.route_id, round(coalesce(any_value(d.back) / max(w.total), 0e0), 6) AS doubled FROM walked w LEFT JOIN doubled d USING (route_id) GROUP BY w.route_id""",
    "rte7_crossed_outlines": """WITH shaped AS (SELECT CAST(c_custkey AS BIGINT) AS route_id, 38e0 + (c_custkey % 3) * 0.0013e0 AS y, CAST(1 + c_custkey % 4 AS DOUBLE) AS w, CAST(1 + c_custkey % 2 AS DOUBLE) AS h, CAST(1 + c_custkey % 3 AS DOUBLE) AS w2 FROM customer),
sized AS (SELECT *, 0.0017e0 * 111320e0 * cos(radians(y)) AS east, 0.0013e0 * 110540e0 AS north FROM shaped)
SELECT route_id, round(least(1e0, 4 * pi() * (w + w2) * h * east * north / pow(2 * ((w + w2) * east + 2 * h * north), 2)), 4) AS compactness FROM sized""",
}
