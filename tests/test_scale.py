"""What must not pass through the driver or one task, whatever the planner takes its size for."""

import math
import random

from pyspark.sql import functions as F

from pacegrid import scratch
from pacegrid.operators import graphs, network, pools, routes, shapes, starts, tiling
from pacegrid.plans import network_queries, route_queries, street_queries
from pacegrid.sources import street_tables as t


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def customers(spark, tmp_path, many):
    spark.range(many).select(F.col("id").alias("c_custkey"), F.lit("x").alias("c_name")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    return str(tmp_path)


def test_samples_of_lines_are_not_broadcast(spark, tmp_path):
    """samples are many times their file, which is small."""
    found = shapes.doubled_back(t.returning_lines(spark, customers(spark, tmp_path, 60)))
    joins = [line for line in plan_of(found).splitlines() if "Join" in line and "row" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)
    assert found.count() == 60


def test_tables_of_rounds_are_not_broadcast(spark):
    """F8: a file of a round is much smaller than its rows."""
    a, b = (spark.range(1000).select("id", F.lit(1).alias(c)).transform(scratch.kept) for c in "ab")
    assert "BroadcastHashJoin" not in plan_of(a.join(b, "id"))


def test_cells_around_nodes_are_not_broadcast(spark):
    """each node stands in nine cells, also where nodes come from a join."""
    nodes = spark.range(200).select(F.col("id").alias("node_id"), (38.0 + F.col("id") * 0.001).alias("y"), F.lit(-78.5).alias("x"))
    points = spark.range(50).select(F.col("id").alias("key"), (38.0 + F.col("id") * 0.003).alias("lat"), F.lit(-78.5).alias("lon"))
    inner = nodes.join(spark.range(100).withColumnRenamed("id", "node_id"), "node_id", "left_semi")
    found = network._nearest_within(points, inner, "key", 400.0)
    joins = [line for line in plan_of(found).splitlines() if "Join" in line and "row" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)


def test_routes_with_the_same_streets_are_compared_once(spark):
    """copies are listed, but not compared, in pairs."""
    walks = {1: (1, 2, 3), 2: (3, 2, 1), 3: (1, 2, 3), 4: (2, 3, 4), 5: (7, 8), 6: (1, 2, 3, 4)}
    rows = [(0, r, a, b, 10.0) for r, w in walks.items() for a, b in zip(w, w[1:])]
    measured = spark.createDataFrame(rows, "g long, route_id long, u long, v long, length double")
    members = {(r.route_id, r.like) for r in routes.alike(routes.walked_streets(measured, "g"), "g").collect()}
    assert members == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 6)}
    sets = {r: {(min(s), max(s)) for s in zip(w, w[1:])} for r, w in walks.items()}
    share = lambda a, b: round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6)
    expected = {(a, b, share(a, b)) for a in sets for b in sets if a < b and share(a, b) >= 0.3}
    assert {(r.a, r.b, r.share) for r in routes.overlaps(measured, "g", 0.3).collect()} == expected


def test_starts_are_looked_for_no_farther_than_answers_lie(spark, monkeypatch):
    """an origin's whole circle isn't listed where near starts fill the answer; answers are those of
    the whole circle."""
    draw = random.Random(5)
    feature = lambda i: (i, draw.choice(["Trailhead", None]), draw.choice(["parking", None]), "park", None, None, 38.0 + draw.randrange(40) * 0.0013, -78.5 + draw.randrange(12) * 0.0017)
    placed = [feature(i) for i in range(350)]
    features = spark.createDataFrame(placed, "feature_id long, information string, amenity string, leisure string, access string, name string, lat double, lon double")
    asked = [(i, 38.0 + i * 0.004, -78.4913, 2.0) for i in range(12)] + [(99, 38.15, -78.5, 8.0)]
    origins = spark.createDataFrame(asked, "request_id long, lat double, lon double, radius double")
    looked, near = {}, starts._near

    def watched(some, to, reach):
        found = near(some, to, reach)
        looked[reach] = {r.request_id for r in some.select("request_id").collect()}
        return found

    monkeypatch.setattr(starts, "_near", watched)
    got = {(r.request_id, r.place, r.feature_id) for r in starts.discover(origins, features, 8.0, 5).collect()}
    assert looked[starts.FIRST] == {i for i, *_ in asked} and len(looked[2 * starts.FIRST]) < 8

    def metres(a, b):
        up, across = (math.radians(b[i] - a[i]) / 2 for i in (0, 1))
        return 2 * 6371008.8 * math.asin(math.sqrt(math.sin(up) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(across) ** 2))

    expected = set()
    for i, lat, lon, radius in asked:
        taken = []
        for f in placed:
            far = metres((lat, lon), f[6:8]) / starts.MILE
            if starts.NEAREST <= far <= radius and all(metres(f[6:8], g[6:8]) >= starts.SAME for _, _, g in taken):
                taken.append((0 if f[1] else 1 if f[2] else 2, far, f))
        expected |= {(i, n + 1, f[0]) for n, (_, _, f) in enumerate(sorted(taken, key=lambda t: (t[0], t[1], t[2][0]))[:5])}
    assert got == expected


def test_cells_of_boundaries_are_made_by_many_tasks(spark, monkeypatch):
    """a small file of boundaries is one task, and one task held all their cells."""
    assert scratch.spread(spark.range(10), 3, "id").rdd.getNumPartitions() == 4
    corners = [(m, 0, i, 38.0 + y * 0.02, -78.5 + x * 0.02) for m in range(3) for i, (y, x) in enumerate([(0, 0), (0, 1), (1, 1), (1, 0)])]
    rings = spark.createDataFrame(corners, "metro long, ring int, pos int, y double, x double")
    monkeypatch.setattr(tiling, "RING_POINTS", 2)
    cells = tiling.metro_cells(rings)
    assert "hashpartitioning(metro" in plan_of(cells) and ", 6), REPARTITION_BY_NUM" in plan_of(cells)
    assert cells.groupBy("metro").count().select("count").distinct().count() == 1


def test_edges_are_listed_for_wishes_after_the_choice(spark, monkeypatch):
    """each task sorted six rows an edge; now edges are listed for the wishes once chosen."""
    monkeypatch.setattr(t, "table", lambda spark, sf_dir, name: spark.range(300).select(F.col("id").alias("p_partkey"), (F.col("id") % 50).alias("p_size")))
    found = street_queries.edge_costs(spark, "")
    lines = plan_of(found).splitlines()
    at = [n for n, line in enumerate(lines) if "Generate inline" in line]
    assert len(at) == 1 and all(n > at[0] for n, line in enumerate(lines) if "Sort" in line or "Aggregate" in line)
    nodes, edges = t.nodes(spark, ""), t.edges(spark, "")
    for surface in network.SURFACES:
        for flat in (False, True):
            one = network.collapse(network.edge_costs(edges, nodes, surface, flat)).select("u", "v", "key", F.round("cost", 4).alias("cost"))
            got = found.filter((F.col("surface") == surface) & (F.col("flat") == flat)).select(one.columns)
            assert one.count() > 1000 and one.exceptAll(got).isEmpty() and got.exceptAll(one).isEmpty()


def test_loops_of_pools_are_not_broadcast(spark, tmp_path):
    """routes' first cells, lengths and reach went whole through the driver, being joins' results."""
    folder = customers(spark, tmp_path, 60)
    spark.range(300).select(F.col("id").alias("p_partkey"), F.lit(1).alias("p_size")).write.parquet(f"{folder}/part.parquet")
    assert "Join" in plan_of(found := route_queries.whole_loops(spark, folder)) and "BroadcastHashJoin" not in plan_of(found)
    row = lambda *columns: spark.range(50).select(*(F.col("id").cast(kind).alias(c) for c, kind in columns)).distinct()
    loops = row(("cell", "string"), ("route_id", "long"), ("pos", "long"), ("node_id", "long"), ("metres", "double")).transform(scratch.kept)
    reach = row(("source", "long"), ("node_id", "long"), ("out", "double")).join(row(("source", "long"), ("node_id", "long"), ("back", "double")), ["source", "node_id"])
    met = pools.anchored(row(("source", "long"), ("cell", "string")), loops, reach, 20.0)
    joins = [line for line in plan_of(met).splitlines() if "BroadcastHashJoin" in line]
    assert met.count() == 21 and len(joins) <= 1


def test_steps_are_dealt_out_once_by_streets_and_once_by_route(spark, tmp_path):
    """steps met nodes twice, sorted whole each time, and each task summed about half of all routes."""
    folder = customers(spark, tmp_path, 60)
    spark.range(300).select(F.col("id").alias("p_partkey"), (F.col("id") % 50).alias("p_size")).write.parquet(f"{folder}/part.parquet")
    lines = plan_of(route_queries.route_profile(spark, folder)).splitlines()
    at = lambda word: next(n for n, line in enumerate(lines) if word in line)
    assert sum("Join" in line for line in lines[: at("Window")]) == 1 and at("partial_sum") < at("Exchange hashpartitioning(route_id")
    nodes, steps = t.nodes(spark, folder), routes.steps(t.route_nodes(spark, folder))
    best = {}
    for e in t.edges(spark, folder).collect():
        best[e.u, e.v] = min(best.get((e.u, e.v), (math.inf,)), (e.length, e.key, e.highway in network.TRAILS or e.surface in network.UNPAVED))
    high, want = {n.node_id: n.elevation for n in nodes.collect()}, {}
    for s in steps.collect():
        if (s.u, s.v) in best:
            length, _, trail = best[s.u, s.v]
            rise = None if high[s.u] is None or high[s.v] is None else high[s.v] - high[s.u]
            sums = want.setdefault(s.route_id, [0.0, 0.0, 0.0, 0.0])
            for i, x in enumerate((length, length * trail, max(rise or 0.0, 0.0), length * (rise is not None))):
                sums[i] += x
    got = {r.route_id: (r.metres, r.trail_share, r.gain, r.coverage) for r in routes.profile(steps, t.edges(spark, folder), nodes).collect()}
    assert len(want) == 60 and got.keys() == want.keys() and len({r[3] for r in got.values()}) > 2
    for route, (metres, trail, gain, known) in want.items():
        assert all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip(got[route], (metres, trail / metres, gain, known / metres)))


def test_no_round_of_core_nodes_is_broadcast(spark, tmp_path, monkeypatch):
    """of all rounds of the whole query only the name of the largest component, one row, goes through the
    driver; the nodes around a place did."""
    spark.range(500).select(F.col("id").alias("p_partkey"), F.lit(1).alias("p_size")).write.parquet(f"{tmp_path}/part.parquet")
    plans, kept = [], scratch.kept
    monkeypatch.setattr(scratch, "kept", lambda df: plans.append(plan_of(df)) or kept(df))
    got = {r.start: (r.core_node, r.metres) for r in network_queries.core_snaps(spark, str(tmp_path)).collect()}
    lines = [line for p in plans for line in p.splitlines()]
    assert any("SortMergeJoin [row" in line for line in lines)
    assert all("[component" in line for line in lines if "BroadcastHashJoin" in line or "BroadcastNestedLoopJoin" in line)
    nodes, edges = t.nodes(spark, str(tmp_path)), t.edges(spark, str(tmp_path)).filter(network_queries.UNENTERED)
    core, at = {r.node_id for r in graphs.core(nodes, edges).collect()}, {n.node_id: (n.y, n.x) for n in nodes.collect()}

    def metres(a, b):
        up, across = (math.radians(b[i] - a[i]) / 2 for i in (0, 1))
        return round(2 * 6371008.8 * math.asin(math.sqrt(math.sin(up) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(across) ** 2)), 6)

    want = {n: min((metres(at[n], at[c]), c) for c in core) for n in at.keys() - core}
    assert want and {n: (c, round(m, 3)) for n, (m, c) in want.items()} == got
