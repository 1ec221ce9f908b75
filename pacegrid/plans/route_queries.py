"""Queries that answer, select, measure, audit, report and export routes, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pacegrid import scratch
from pacegrid.functions import geo
from pacegrid.operators import elevation, exports, network, pools, reports, routes, scoring, selection, shapes
from pacegrid.plans.street_queries import CELLS, EDGES, HAVERSINE, NODES, RANKED, REQUESTS, ROUTES
from pacegrid.sources import street_tables as t


#: Share of two routes' streets from which they count as one.
MOST_SHARED = 0.7


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.route_nodes(spark, sf_dir).join(t.nodes(spark, sf_dir), "node_id").select("route_id", "pos", "node_id", "y", "x", "elevation")


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes.measured_steps(routes.steps(t.route_nodes(spark, sf_dir)), t.edges(spark, sf_dir))


def whole_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(route_id, pos, node_id, cell, metres) of routes whose every step has an edge, keyed by their first cell."""
    lengths = routes.repeated_share(_measured(spark, sf_dir)).filter("missing = 0").select("route_id", "metres")
    points = _points(spark, sf_dir)
    first = points.filter("pos = 0").select("route_id", geo.cell_id(F.col("y"), F.col("x")).alias("cell"))
    return points.select("route_id", "pos", "node_id").join(scratch.dealt(first), "route_id").join(scratch.dealt(lengths), "route_id")


def serve_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of every node as origin, answered from whole loops keyed by their first cell."""
    scratch.checkpoints(spark)
    nodes, edges, loops = t.nodes(spark, sf_dir), t.edges(spark, sf_dir), whole_loops(spark, sf_dir)
    asked = nodes.select(F.col("node_id").alias("request_id"), F.col("node_id").alias("source"), (1.0 + F.col("node_id") % 2 * 0.5).alias("target_miles"))
    found = pools.serve(asked, nodes, edges, loops.transform(scratch.kept), pools.NEAR_RINGS)
    return found.select("request_id", "retry", "route_id", "pos", F.round("connector", 2).alias("connector"), F.round("metres", 1).alias("metres"))


def distinct_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each area's routes up to five, none of which shares 70 percent with another."""
    scratch.checkpoints(spark)
    area = t.route_nodes(spark, sf_dir).filter("pos = 0").select("route_id", F.floor(F.col("node_id") / 11).alias("area"))
    walked = _measured(spark, sf_dir).filter("length is not null").join(area, "route_id")
    streets = routes.walked_streets(walked, "area").transform(scratch.kept)
    return selection.distinct_by_streets(area.withColumn("place", F.col("route_id")), streets, "area", 5, MOST_SHARED)


def _gate(ranked: DataFrame) -> DataFrame:
    """Thin loops are sound; candidates of these tables have no streets to choose distinct ones by."""
    return selection.answer_gate(ranked, 3, scoring.TOLERANCE, F.col("repeated") <= scoring.MOST_REPEATED)


def answer_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gate(scoring.rank(t.candidates(spark, sf_dir)))


def miss_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by reason, by reason and surface, and by reason and target."""
    ranked = scoring.rank(t.candidates(spark, sf_dir))
    asked = ranked.groupBy("request_id").agg(F.min("surface").alias("surface"), F.min("target").alias("target"))
    said = _gate(ranked).join(asked, "request_id")
    return said.groupingSets([["reason"], ["reason", "surface"], ["reason", "target"]], "reason", "surface", "target").agg(F.count("*").alias("requests"))


def distance_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.distance_accuracy(scoring.rank(t.candidates(spark, sf_dir)))


def order_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = t.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("label"), F.col("l_quantity").cast("double").alias("value"))
    return reports.order_statistics(lines, "label", "value")


def route_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = routes.profile(routes.steps(t.route_nodes(spark, sf_dir)), t.edges(spark, sf_dir), t.nodes(spark, sf_dir))
    return found.select("route_id", F.round("metres", 2).alias("metres"), F.round("trail_share", 4).alias("trail_share"), F.round("gain", 2).alias("gain"), F.round("coverage", 4).alias("coverage"))


def route_compactness(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch.checkpoints(spark)
    return shapes.compactness(_points(spark, sf_dir)).select("route_id", F.round("compactness", 4).alias("compactness"))


def pool_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes.audit(t.route_nodes(spark, sf_dir), _measured(spark, sf_dir))


def request_elevations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests on a raster of 50 columns of the parts' sizes, unknown at every 37th."""
    k = F.col("p_partkey").cast("long")
    raster = t.table(spark, sf_dir, "part").select(F.floor(k / 50).alias("row"), (k % 50).alias("column"), F.when(k % 37 != 0, F.col("p_size").cast("double")).alias("height"))
    asked = t.requests(spark, sf_dir)
    points = asked.select("request_id", ((F.col("lat") - 38.0) / 0.0013 - 0.1).alias("at_row"), ((F.col("lon") + 78.5) / 0.0017 + 0.2).alias("at_column"))
    return elevation.bilinear(points, raster, "request_id").select("request_id", F.round("elevation", 4).alias("elevation"))


def crop_to_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = network.crop(t.nodes(spark, sf_dir), t.edges(spark, sf_dir), 38.005, -78.47, 1500.0)
    return edges.select("u", "v", "key", F.round("length", 3).alias("length"))


def cell_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.cell_origins(t.nodes(spark, sf_dir)).select("cell", "node_id", F.round("metres", 3).alias("metres"))


def routes_gpx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.gpx(_points(spark, sf_dir))


def routes_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.geojson(_points(spark, sf_dir))


QUERIES = {
    "srv1_serve_pools": serve_pools,
    "sel1_distinct_routes": distinct_routes,
    "sel4_answer_gate": answer_gate,
    "agg5_miss_counters": miss_counters,
    "agg6_distance_accuracy": distance_accuracy,
    "mth_order_statistics": order_statistics,
    "rte10_route_profile": route_profile,
    "rte7_route_compactness": route_compactness,
    "gov4_pool_audit": pool_audit,
    "src22_request_elevations": request_elevations,
    "prd9_crop_to_radius": crop_to_radius,
    "pre2_cell_origins": cell_origins,
    "snk3_routes_gpx": routes_gpx,
    "snk1_routes_geojson": routes_geojson,
}

GATE = f"""{RANKED}, gate AS (
  SELECT request_id, count(*) FILTER (error <= 0.25e0) AS near, count(*) FILTER (error <= 0.25e0 AND repeated <= 0.1e0) AS sound, min(surface) AS surface, min(target) AS target FROM ranked GROUP BY request_id
), said AS (SELECT *, CASE WHEN near < 2 THEN 'few in band' WHEN sound < 2 THEN 'few without doubling back' ELSE 'answered' END AS reason FROM gate)"""
POINTS = f"{NODES}, {EDGES}, {ROUTES}, points AS (SELECT route_id, pos, n.* FROM route_nodes JOIN nodes n USING (node_id))"
REPEATED = "again AS (SELECT *, row_number() OVER (PARTITION BY route_id, least(u, v), greatest(u, v) ORDER BY pos) > 1 AS again FROM measured)"
_HIGH = "(200e0 / 110540e0)"
def _ring(name: str, steps: int) -> str:
    """Cells within so many steps of each node's, found by looking the stepped point up again."""
    return f"""{name} AS (
  SELECT DISTINCT source, '200:' || r2 || ':' || CAST(floor((x + across * w0) / (200e0 / (111320e0 * cos(radians((r2 + 0.5e0) * {_HIGH}))))) AS BIGINT) AS cell FROM (
    SELECT node_id AS source, x, row + up AS r2, across, 200e0 / (111320e0 * cos(radians((row + 0.5e0) * {_HIGH}))) AS w0 FROM celled, generate_series(-{steps}, {steps}) a(up), generate_series(-{steps}, {steps}) b(across)))"""


def _answers(asked: str, looked: str, limit: str, label: str) -> str:
    return f"""SELECT request_id, '{label}' AS retry, route_id, pos, connector, joined FROM (
    SELECT q.request_id, q.target, l.route_id, l.pos, round(h.out + h.back, 3) AS connector, l.metres + round(h.out + h.back, 3) AS joined,
      row_number() OVER (PARTITION BY q.request_id, l.route_id ORDER BY round(h.out + h.back, 3), l.pos) AS rn
    FROM {asked} q JOIN {looked} c ON q.request_id = c.source JOIN loops l ON c.cell = l.cell JOIN reach h ON h.source = c.source AND h.node_id = l.node_id AND h.out <= {limit} AND h.back <= {limit}
  ) WHERE rn = 1 AND abs(joined - target * 1609.344e0) <= 402.336e0"""


SQL = {
    "srv1_serve_pools": f"""WITH RECURSIVE {POINTS}, {CELLS}, {_ring('near', 1)}, {_ring('ring', 2)}, short AS (SELECT u, v, min(length) AS step FROM edges GROUP BY u, v),
walk AS (SELECT node_id AS source, node_id, 0e0 AS metres FROM nodes UNION ALL SELECT source, v, metres + step FROM walk JOIN short ON node_id = u WHERE metres + step <= 500e0),
away AS (SELECT source, node_id, min(metres) AS out FROM walk GROUP BY source, node_id),
reach AS (SELECT a.source, a.node_id, a.out, b.out AS back FROM away a JOIN away b ON a.source = b.node_id AND a.node_id = b.source),
lengths AS (SELECT route_id, round(sum(length), 4) AS metres FROM measured GROUP BY route_id HAVING count(*) = count(length)),
firsts AS (SELECT route_id, '200:' || c.row || ':' || c.col AS cell FROM route_nodes r JOIN celled c USING (node_id) WHERE pos = 0),
loops AS (SELECT r.route_id, r.pos, r.node_id, f.cell, l.metres FROM route_nodes r JOIN firsts f USING (route_id) JOIN lengths l USING (route_id)),
asked AS (SELECT node_id AS request_id, 1e0 + node_id % 2 * 0.5e0 AS target FROM nodes),
one AS ({_answers("asked", "near", "300e0", "none")}), open AS (SELECT * FROM asked WHERE request_id NOT IN (SELECT request_id FROM one)), two AS ({_answers("open", "ring", "500e0", "wider")})
SELECT request_id, retry, route_id, pos, round(connector, 2) AS connector, round(joined, 1) AS metres FROM (SELECT * FROM one UNION ALL SELECT * FROM two)""",
    "sel1_distinct_routes": f"""WITH RECURSIVE {NODES}, {EDGES}, {ROUTES}, placed AS (
  SELECT route_id, node_id // 11 AS area, row_number() OVER (PARTITION BY node_id // 11 ORDER BY route_id) AS place FROM route_nodes WHERE pos = 0
), streets AS (SELECT area, route_id, least(u, v) AS p, greatest(u, v) AS q, max(length) AS length FROM measured JOIN placed USING (route_id) WHERE length IS NOT NULL GROUP BY ALL),
totals AS (SELECT route_id, sum(length) AS total FROM streets GROUP BY route_id),
met AS (SELECT x.route_id AS a, y.route_id AS b, sum(least(x.length, y.length)) AS shared FROM streets x JOIN streets y USING (area, p, q) WHERE x.route_id <> y.route_id GROUP BY ALL),
against AS (SELECT a AS route_id, list(b) AS against FROM met JOIN totals ta ON a = ta.route_id JOIN totals tb ON b = tb.route_id WHERE round(shared / (ta.total + tb.total - shared), 6) >= 0.7 GROUP BY a),
queue AS (SELECT area, place, route_id, coalesce(against, []::BIGINT[]) AS against FROM placed LEFT JOIN against USING (route_id)),
pick AS (SELECT DISTINCT area, CAST(0 AS BIGINT) AS place, []::BIGINT[] AS chosen FROM queue
  UNION ALL SELECT p.area, q.place, CASE WHEN len(chosen) < 5 AND NOT list_has_any(chosen, against) THEN list_append(chosen, route_id) ELSE chosen END FROM pick p JOIN queue q ON p.area = q.area AND q.place = p.place + 1),
last AS (SELECT area, arg_max(chosen, place) AS chosen FROM pick GROUP BY area)
SELECT area, unnest(chosen) AS route_id, unnest(generate_series(1, len(chosen))) AS place FROM last""",
    "sel4_answer_gate": f"WITH {GATE} SELECT request_id, near, sound, reason FROM said",
    "agg5_miss_counters": f"WITH {GATE} SELECT reason, surface, target, count(*) AS requests FROM said GROUP BY GROUPING SETS ((reason), (reason, surface), (reason, target))",
    "agg6_distance_accuracy": f"""WITH {RANKED}, firsts AS (SELECT request_id, target, min(error / target) FILTER (rank = 1) AS first, min(error / target) AS best FROM ranked WHERE rank <= 3 GROUP BY request_id, target)
SELECT target, count(*) AS requests, count(*) FILTER (first <= 0.05e0) AS within5, count(*) FILTER (first <= 0.1e0) AS within10, count(*) FILTER (best <= 0.1e0) AS any10, round(max(first), 6) AS largest FROM firsts GROUP BY target""",
    "mth_order_statistics": """WITH sorted AS (SELECT l_returnflag AS label, count(l_quantity) AS n, list_sort(list(CAST(l_quantity AS DOUBLE))) AS v FROM lineitem GROUP BY l_returnflag)
SELECT label, n, round(quantile, 6) AS p95_linear, v[CAST(ceil(n * 0.95e0) AS INT)] AS p95_rank, v[CAST(floor((n - 1) * 0.95e0) AS INT) + 1] AS p95_floor, median, v[n // 2 + 1] AS upper_median
FROM sorted JOIN (SELECT l_returnflag AS label, quantile_cont(CAST(l_quantity AS DOUBLE), 0.95) AS quantile, median(CAST(l_quantity AS DOUBLE)) AS median FROM lineitem GROUP BY l_returnflag) USING (label)""",
    "rte10_route_profile": f"""WITH {NODES}, {EDGES}, {ROUTES}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY u, v ORDER BY length, key) AS rn FROM edges) WHERE rn = 1),
profiled AS (SELECT s.route_id, e.length, e.highway IN ('path', 'footway') OR coalesce(e.surface = 'gravel', false) AS trail, b.elevation - a.elevation AS rise
  FROM steps s JOIN best e USING (u, v) JOIN nodes a ON a.node_id = u JOIN nodes b ON b.node_id = v)
SELECT route_id, round(sum(length), 2) AS metres, round(coalesce(sum(length) FILTER (trail), 0e0) / sum(length), 4) AS trail_share, round(coalesce(sum(rise) FILTER (rise > 0), 0e0), 2) AS gain,
round(coalesce(sum(length) FILTER (rise IS NOT NULL), 0e0) / sum(length), 4) AS coverage FROM profiled GROUP BY route_id""",
    "rte7_route_compactness": f"""WITH {POINTS}, based AS (SELECT *, first_value(y) OVER (PARTITION BY route_id ORDER BY pos) AS ref, min(x) OVER (PARTITION BY route_id) AS x0, min(y) OVER (PARTITION BY route_id) AS y0 FROM points),
flat AS (SELECT route_id, pos, (x - x0) * 111320e0 * cos(radians(ref)) AS e, (y - y0) * 110540e0 AS n FROM based),
turned AS (SELECT *, coalesce(lead(e) OVER w, first_value(e) OVER w) AS e2, coalesce(lead(n) OVER w, first_value(n) OVER w) AS n2 FROM flat WINDOW w AS (PARTITION BY route_id ORDER BY pos))
SELECT route_id, round(CASE WHEN count(*) < 4 THEN 0e0 ELSE least(1e0, 4 * pi() * abs(sum(e * n2 - e2 * n)) / 2 / pow(sum(sqrt((e2 - e) * (e2 - e) + (n2 - n) * (n2 - n))), 2)) END, 4) AS compactness FROM turned GROUP BY route_id""",
    "gov4_pool_audit": f"""WITH {NODES}, {EDGES}, {ROUTES}, {REPEATED}, totals AS (
  SELECT route_id, coalesce(sum(length), 0e0) AS metres, coalesce(sum(length) FILTER (again), 0e0) AS twice, count(*) FILTER (length IS NULL) AS missing FROM again GROUP BY route_id
), ends AS (SELECT route_id, count(*) AS nodes, arg_min(node_id, pos) AS first, arg_max(node_id, pos) AS last FROM route_nodes GROUP BY route_id)
SELECT route_id, 'short' AS problem FROM ends WHERE nodes < 4 UNION ALL SELECT route_id, 'open' FROM ends WHERE first <> last
UNION ALL SELECT route_id, 'missing edge' FROM totals WHERE missing > 0 UNION ALL SELECT route_id, 'repeating' FROM totals WHERE round(twice, 4) > 0.10001e0 * round(metres, 4)""",
    "src22_request_elevations": f"""WITH {REQUESTS}, raster AS (SELECT p_partkey // 50 AS r, p_partkey % 50 AS c, CASE WHEN p_partkey % 37 <> 0 THEN CAST(p_size AS DOUBLE) END AS h FROM part),
size AS (SELECT max(r) AS rows, max(c) AS columns FROM raster),
inside AS (SELECT request_id, greatest(0e0, least((lat - 38e0) / 0.0013e0 - 0.1e0, rows)) AS r, greatest(0e0, least((lon + 78.5e0) / 0.0017e0 + 0.2e0, columns)) AS c, rows, columns FROM requests, size),
cut AS (SELECT *, floor(r) AS r0, floor(c) AS c0, r - floor(r) AS fr, c - floor(c) AS fc FROM inside)
SELECT request_id, round((1 - fr) * (1 - fc) * a.h + (1 - fr) * fc * b.h + fr * (1 - fc) * d.h + fr * fc * e.h, 4) AS elevation FROM cut
LEFT JOIN raster a ON a.r = r0 AND a.c = c0 LEFT JOIN raster b ON b.r = r0 AND b.c = least(c0 + 1, columns) LEFT JOIN raster d ON d.r = least(r0 + 1, rows) AND d.c = c0 LEFT JOIN raster e ON e.r = least(r0 + 1, rows) AND e.c = least(c0 + 1, columns)""",
    "prd9_crop_to_radius": f"""WITH {NODES}, {EDGES}, kept AS (SELECT node_id FROM nodes WHERE {HAVERSINE.format("38.005e0", "(-78.47e0)", "y", "x")} <= 1500e0)
SELECT u, v, key, round(length, 3) AS length FROM edges WHERE u IN (SELECT node_id FROM kept) AND v IN (SELECT node_id FROM kept)""",
    "pre2_cell_origins": f"""WITH {NODES}, {CELLS}, far AS (SELECT '200:' || row || ':' || col AS cell, node_id, round({HAVERSINE.format("y", "x", f"((row + 0.5e0) * {_HIGH})", f"((col + 0.5e0) * (200e0 / (111320e0 * cos(radians((row + 0.5e0) * {_HIGH})))))")}, 6) AS metres FROM celled)
SELECT cell, node_id, round(metres, 3) AS metres FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY metres, node_id) AS rn FROM far) WHERE rn = 1""",
    "snk3_routes_gpx": f"""WITH {POINTS} SELECT route_id, '<gpx version="1.1" creator="pacegrid" xmlns="http://www.topografix.com/GPX/1/1"><trk><name>Route ' || route_id || '</name><trkseg>' ||
string_agg(printf('<trkpt lat="%.7f" lon="%.7f">', y, x) || CASE WHEN elevation IS NOT NULL THEN printf('<ele>%.1f</ele>', elevation) ELSE '' END || '</trkpt>', '' ORDER BY pos) || '</trkseg></trk></gpx>' AS gpx FROM points GROUP BY route_id""",
    "snk1_routes_geojson": f"""WITH {POINTS} SELECT route_id, '{{"type":"Feature","properties":{{"id":' || route_id || '}},"geometry":{{"type":"LineString","coordinates":[' || string_agg(printf('[%.7f,%.7f]', x, y), ',' ORDER BY pos) || ']}}}}' AS feature FROM points GROUP BY route_id""",
}
