"""Queries that measure routes in full and generate loops, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pacegrid import scratch
from pacegrid.operators import loops, measures, network, paths
from pacegrid.plans.path_queries import CHOSEN, chosen_edges, whole_routes
from pacegrid.plans.street_queries import EDGES, HAVERSINE, NODES
from pacegrid.sources import street_tables as t

#: The longest of the requests' targets in miles.
LONGEST = 1.5


def _network(spark: SparkSession, sf_dir: str) -> loops.Network:
    nodes, edges = t.nodes(spark, sf_dir), t.edges(spark, sf_dir)
    collapsed = network.collapse(network.edge_costs(edges, nodes, "mixed", False))
    return loops.Network(nodes, t.road_names(chosen_edges(spark, sf_dir)), paths.cost_links(collapsed))


def loop_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waypoints of every request's first attempts, and what the legs between them cost."""
    scratch.checkpoints(spark)
    on, asked = _network(spark, sf_dir), t.loop_requests(spark, sf_dir)
    tried = loops.waypoints(loops.first_attempts(asked), asked, on.nodes)
    pair = lambda a, b: tried.select(F.col(a).alias("source"), F.col(b).alias("target"))
    costs, _ = paths.cheapest_paths(pair("origin", "first").unionByName(pair("first", "second")), on.links, LONGEST * 1609.344 * loops.SEARCH, near=on.near)
    home, _ = paths.cheapest_paths(pair("origin", "second"), on.turned, LONGEST * 1609.344 * loops.SEARCH, near=on.near_turned)
    leg = lambda costs, a, b, name: costs.select(F.col("source").alias(a), F.col("target").alias(b), F.col("cost").alias(name))
    whole = tried.join(leg(costs, "origin", "first", "one"), ["origin", "first"]).join(leg(costs, "first", "second", "two"), ["first", "second"]).join(leg(home, "origin", "second", "three"), ["origin", "second"])
    return whole.select("request_id", "attempt", "first", "second", F.round((F.col("one") + F.col("two") + F.col("three")) / paths.UNIT, 3).alias("cost"))


def generated_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three distinct loops for every request."""
    scratch.checkpoints(spark)
    found = loops.generate(t.loop_requests(spark, sf_dir), _network(spark, sf_dir), LONGEST)
    rounded = lambda c: F.round(c, 6).alias(c)
    return found.select("request_id", "place", F.concat_ws(",", F.transform("nodes", lambda n: n.cast("string"))).alias("nodes"), "signals", "crossings", *(rounded(c) for c in ("miles", "gain", "trail", "repeated", "coverage", "compactness", "error", "score")))


def route_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All measures of the routes whose every step has an edge."""
    scratch.checkpoints(spark)
    edges = t.road_names(chosen_edges(spark, sf_dir)).transform(scratch.kept)
    found = measures.measure(whole_routes(spark, sf_dir, edges), edges, t.nodes(spark, sf_dir))
    rounded = lambda c, n: F.round(c, n).alias(c)
    return found.select("route_id", rounded("miles", 6), rounded("gain", 2), "signals", rounded("trail", 4), rounded("coverage", 4), rounded("compactness", 4))


QUERIES = {"rte11_route_measures": route_measures}

#: Not registered yet: their rounds are many small jobs, which take minutes on one machine (see README).
SLOW_QUERIES = {"gen1_loop_legs": loop_legs, "gen1_loops": generated_loops}

_TRIES = f"""asked AS (
  SELECT CAST(n_nationkey AS BIGINT) AS request_id, (n_nationkey * 197 + 60) % c AS origin, 1e0 + n_nationkey % 2 * 0.5e0 AS target FROM nation, (SELECT count(*) AS c FROM part)
), scales AS (SELECT unnest([0, 1, 2, 3]) AS si, unnest([0.72e0, 0.9e0, 1.08e0, 1.26e0]) AS scale), turns AS (SELECT unnest(generate_series(0, 11)) AS hi), sweeps AS (SELECT unnest([0, 1]) AS wi, unnest([80, 120]) AS sweep),
tries AS (
  SELECT request_id, origin, CAST(si * 24 + hi * 2 + wi AS INT) AS attempt, side, radians(hi * 30 + side * sweep / 2e0) AS theta, target * 1609.344e0 / 3e0 * scale / 6371008.8e0 AS arc, radians(y) AS phi, x
  FROM asked JOIN nodes ON node_id = origin, scales, turns, sweeps, (SELECT unnest([-1, 1]) AS side)
), aimed AS (SELECT *, asin(sin(phi) * cos(arc) + cos(phi) * sin(arc) * cos(theta)) AS reached FROM tries),
points AS (SELECT request_id, origin, attempt, side, degrees(reached) AS lat, x + degrees(atan2(sin(theta) * sin(arc) * cos(phi), cos(arc) - sin(phi) * sin(reached))) AS lon FROM aimed),
snapped AS (
  SELECT request_id, origin, attempt, side, arg_min(node_id, (round({HAVERSINE.format("lat", "lon", "y", "n.x")}, 6), node_id)) AS node
  FROM points JOIN nodes n ON abs(n.y - lat) < 0.02e0 AND abs(n.x - lon) < 0.02e0 GROUP BY request_id, origin, attempt, side
), triples AS (
  SELECT request_id, origin, attempt, max(node) FILTER (side < 0) AS first, max(node) FILTER (side > 0) AS second FROM snapped GROUP BY ALL
), kept AS (SELECT * FROM triples WHERE first <> second AND first <> origin AND second <> origin)"""

SLOW_SQL = {
    "gen1_loop_legs": f"""WITH RECURSIVE {NODES}, {EDGES}, {CHOSEN}, {_TRIES}, dist(source, node, cost) USING KEY (source, node) AS (
  SELECT node AS source, node, CAST(0 AS BIGINT) AS cost FROM (SELECT DISTINCT unnest([origin, first, second]) AS node FROM kept)
  UNION SELECT d.source, w.v, min(d.cost + w.cost) FROM dist d JOIN ways w ON d.node = w.u LEFT JOIN recurring.dist r ON r.source = d.source AND r.node = w.v
  WHERE d.cost + w.cost <= 6000000000 AND (r.cost IS NULL OR d.cost + w.cost < r.cost) GROUP BY d.source, w.v
)
SELECT request_id, attempt, first, second, round((a.cost + b.cost + c.cost) / 1000000e0, 3) AS cost FROM kept
JOIN dist a ON a.source = origin AND a.node = first JOIN dist b ON b.source = first AND b.node = second JOIN dist c ON c.source = second AND c.node = origin""",
}

SQL = {
    "rte11_route_measures": f"""WITH {NODES}, {EDGES}, {CHOSEN}, shaped AS (
  SELECT CAST(c_custkey AS BIGINT) AS route_id, c_custkey % 3 AS r, (c_custkey * 7) % 44 AS c, 2 + c_custkey % 4 AS w, 1 + c_custkey % 2 AS h FROM customer
), walked AS (SELECT *, unnest(generate_series(0, 2 * (w + h))) AS pos FROM shaped), route_nodes AS (
  SELECT route_id, w, h, CAST(pos AS BIGINT) AS pos, CAST((r + CASE WHEN pos <= w THEN 0 WHEN pos <= w + h THEN pos - w WHEN pos <= 2 * w + h THEN h ELSE 2 * w + 2 * h - pos END) * 50
    + c + CASE WHEN pos <= w THEN pos WHEN pos <= w + h THEN w WHEN pos <= 2 * w + h THEN 2 * w + h - pos ELSE 0 END AS BIGINT) AS node_id FROM walked
), steps AS (SELECT * FROM (SELECT route_id, w, h, pos, node_id AS u, lead(node_id) OVER (PARTITION BY route_id ORDER BY pos) AS v FROM route_nodes) WHERE v IS NOT NULL),
walked_on AS (SELECT s.route_id, s.w, s.h, o.length, o.u IS NULL AS missing, coalesce(o.highway IN ('bridleway', 'footway', 'path', 'track') OR o.surface = 'gravel', false) AS trail, a.elevation AS low, b.elevation AS high, a.signal AS lit, b.signal AS met
  FROM steps s LEFT JOIN one o USING (u, v) LEFT JOIN nodes a ON a.node_id = s.u LEFT JOIN nodes b ON b.node_id = s.v),
firsts AS (SELECT route_id, cos(radians(y)) AS shrink FROM route_nodes JOIN nodes USING (node_id) WHERE pos = 0)
SELECT w.route_id, round(sum(length) / 1609.344e0, 6) AS miles, round(sum(greatest(high - low, 0e0)) * 3.28084e0, 2) AS gain, count(*) FILTER (met AND (NOT lit OR length > 40)) AS signals,
  round(coalesce(sum(length) FILTER (trail), 0e0) / sum(length), 4) AS trail, round(coalesce(sum(length) FILTER (high IS NOT NULL AND low IS NOT NULL), 0e0) / sum(length), 4) AS coverage,
  round(4 * pi() * any_value(w.w * 0.0017e0 * 111320e0 * shrink * w.h * 0.0013e0 * 110540e0) / pow(any_value(2 * w.w * 0.0017e0 * 111320e0 * shrink + 2 * w.h * 0.0013e0 * 110540e0), 2), 4) AS compactness
FROM walked_on w JOIN firsts USING (route_id) GROUP BY w.route_id HAVING NOT bool_or(missing)""",
}
