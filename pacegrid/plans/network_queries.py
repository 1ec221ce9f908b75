"""Queries on components, places along routes and pools, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pacegrid import scratch
from pacegrid.functions import geo
from pacegrid.operators import along, graphs, routes, scoring
from pacegrid.plans.street_queries import CELLS, EDGES, HAVERSINE, NODES, RANKED, ROUTES
from pacegrid.sources import street_tables as t

#: Nodes that no edge of this fixture leads to: they aren't in the core.
UNENTERED = "v % 211 <> 5"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.edges(spark, sf_dir).filter(UNENTERED)


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch.checkpoints(spark)
    return graphs.strong_components(t.nodes(spark, sf_dir), _edges(spark, sf_dir))


def core_snaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node as a start."""
    scratch.checkpoints(spark)
    nodes = t.nodes(spark, sf_dir)
    starts = nodes.select(F.col("node_id").alias("start"), "node_id")
    found = graphs.core_nodes(starts, nodes, graphs.core(nodes, _edges(spark, sf_dir)), "start")
    return found.select("start", "core_node", F.round("metres", 3).alias("metres"))


def shortest_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.shortest_collapse(t.edges(spark, sf_dir)).withColumn("length", F.round("length", 4))


def signal_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals that routes arrive at, clustered by the metres walked between them."""
    measured = routes.measured_steps(routes.steps(t.route_nodes(spark, sf_dir)), t.edges(spark, sf_dir))
    walked = along.travel(measured)
    signals = t.nodes(spark, sf_dir).filter("signal").select(F.col("node_id").alias("v"))
    marks = walked.join(signals, "v", "left_semi").select("route_id", "pos", F.round("after", 4).alias("at"))
    return along.clusters(marks, 200.0)


def loop_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per cell of a loop's first node."""
    measured = routes.measured_steps(routes.steps(t.route_nodes(spark, sf_dir)), t.edges(spark, sf_dir))
    miles = measured.groupBy("route_id").agg(F.round(F.sum(F.coalesce("length", F.lit(0.0))) / geo.MILE, 6).alias("miles"))
    first = t.route_nodes(spark, sf_dir).filter("pos = 0").join(t.nodes(spark, sf_dir), "node_id")
    loops = first.select("route_id", geo.cell_id(F.col("y"), F.col("x")).alias("cell")).join(miles, "route_id")
    return along.best_band(loops, "cell")


def pool_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, cells, loops and rows of the largest: pools of requests by surface."""
    pools = t.candidates(spark, sf_dir).groupBy("request_id", "surface").agg(F.count_if(F.abs(F.col("miles") - F.col("target")) <= 0.25).alias("loops"))
    cells = pools.withColumn("cell", F.floor(F.col("request_id") / 4))
    return cells.groupBy("surface").agg(F.count("*").alias("rows"), F.count_distinct("cell").alias("cells"), F.coalesce(F.sum("loops"), F.lit(0)).alias("loops"), F.max("loops").alias("largest"))


def distance_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by distance error alone, the lowest ordinal on ties."""
    scored = t.candidates(spark, sf_dir).withColumn("error", F.round(F.abs(F.col("miles") - F.col("target")), 9))
    by = Window.partitionBy("request_id").orderBy("error", "ordinal")
    return scored.select("request_id", F.col("ordinal").cast("long").alias("ordinal"), "error", F.row_number().over(by).cast("long").alias("rank"))


def request_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over the three routes that a request gets back."""
    given = scoring.rank(t.candidates(spark, sf_dir)).filter("rank <= 3")
    rate = lambda c: F.round(F.avg(F.col(c) / F.greatest("miles", F.lit(1.0))), 6)
    return given.groupBy("request_id").agg(
        F.round(F.avg("error"), 6).alias("mean_error"),
        rate("signals").alias("signals_a_mile"),
        rate("crossings").alias("crossings_a_mile"),
        F.round(F.avg("repeated"), 6).alias("repeated"),
        F.round(F.avg("compactness"), 6).alias("compactness"),
    )


QUERIES = {
    "gph3_strong_components": components,
    "jn2_core_nodes": core_snaps,
    "gph2_shortest_edges": shortest_edges,
    "win4_signal_clusters": signal_clusters,
    "sel7_loop_bands": loop_bands,
    "agg13_pool_facts": pool_facts,
    "scr4_distance_rank": distance_rank,
    "agg3_request_summary": request_summary,
}

_STRONG = f"""{NODES}, {EDGES}, ways AS (SELECT DISTINCT u, v FROM edges WHERE {UNENTERED} AND u <> v),
leads AS (SELECT node_id AS a, node_id AS b FROM nodes UNION SELECT a, v FROM leads JOIN ways ON b = u),
strong AS (SELECT x.a AS node_id, min(x.b) AS component FROM leads x JOIN leads y ON x.a = y.b AND x.b = y.a GROUP BY x.a)"""

SQL = {
    "gph3_strong_components": f"WITH RECURSIVE {_STRONG} SELECT node_id, component FROM strong",
    "jn2_core_nodes": f"""WITH RECURSIVE {_STRONG}, largest AS (SELECT component FROM strong GROUP BY component ORDER BY count(*) DESC, component LIMIT 1),
core AS (SELECT n.* FROM nodes n JOIN strong USING (node_id) WHERE component = (SELECT component FROM largest)),
far AS (SELECT s.node_id AS start, c.node_id AS core_node, round({HAVERSINE.format("s.y", "s.x", "c.y", "c.x")}, 6) AS metres FROM nodes s CROSS JOIN core c WHERE s.node_id NOT IN (SELECT node_id FROM core))
SELECT start, core_node, round(metres, 3) AS metres FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY metres, core_node) AS rn FROM far) WHERE rn = 1""",
    "gph2_shortest_edges": f"""WITH {NODES}, {EDGES} SELECT u, v, key, round(length, 4) AS length FROM (
  SELECT *, row_number() OVER (PARTITION BY u, v ORDER BY coalesce(length, 1e0), key) AS rn FROM edges) WHERE rn = 1""",
    "win4_signal_clusters": f"""WITH {NODES}, {EDGES}, {ROUTES}, passed AS (SELECT *, sum(coalesce(length, 0e0)) OVER (PARTITION BY route_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS after FROM measured),
marks AS (SELECT route_id, pos, round(after, 4) AS metre FROM passed JOIN nodes ON v = node_id WHERE signal),
begun AS (SELECT *, CASE WHEN metre - lag(metre) OVER w <= 200e0 THEN 0 ELSE 1 END AS new FROM marks WINDOW w AS (PARTITION BY route_id ORDER BY metre, pos)),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY route_id ORDER BY metre, pos ROWS UNBOUNDED PRECEDING) AS cluster FROM begun)
SELECT route_id, CAST(cluster AS BIGINT) AS cluster, min(metre) AS first, max(metre) AS last, count(*) AS marks FROM numbered GROUP BY route_id, cluster""",
    "sel7_loop_bands": f"""WITH {NODES}, {EDGES}, {ROUTES}, {CELLS}, miles AS (SELECT route_id, round(sum(coalesce(length, 0e0)) / 1609.344e0, 6) AS miles FROM measured GROUP BY route_id),
loops AS (SELECT r.route_id, '200:' || row || ':' || col AS cell, miles FROM route_nodes r JOIN celled USING (node_id) JOIN miles m ON r.route_id = m.route_id WHERE pos = 0),
counted AS (SELECT a.cell, a.route_id, a.miles, count(*) AS near FROM loops a JOIN loops b ON a.cell = b.cell AND abs(round((b.miles - a.miles) * 1e6)) <= 250000 GROUP BY ALL)
SELECT cell, miles, near FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY near DESC, miles DESC) AS rn FROM counted) WHERE rn = 1""",
    "agg13_pool_facts": f"""WITH {RANKED}, pools AS (SELECT request_id, surface, count(*) FILTER (abs(miles - target) <= 0.25e0) AS loops FROM candidates GROUP BY ALL)
SELECT surface, count(*) AS rows, count(DISTINCT request_id // 4) AS cells, CAST(coalesce(sum(loops), 0) AS BIGINT) AS loops, max(loops) AS largest FROM pools GROUP BY surface""",
    "scr4_distance_rank": f"""WITH {RANKED} SELECT request_id, ordinal, error, row_number() OVER (PARTITION BY request_id ORDER BY error, ordinal) AS rank FROM scored""",
    "agg3_request_summary": f"""WITH {RANKED} SELECT request_id, round(avg(error), 6) AS mean_error, round(avg(signals / greatest(miles, 1e0)), 6) AS signals_a_mile, round(avg(crossings / greatest(miles, 1e0)), 6) AS crossings_a_mile,
round(avg(repeated), 6) AS repeated, round(avg(compactness), 6) AS compactness FROM ranked WHERE rank <= 3 GROUP BY request_id""",
}
