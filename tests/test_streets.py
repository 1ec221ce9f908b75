import math

import pytest
from pyspark.sql import functions as F

from pacegrid.functions import geo
from pacegrid.operators import network, routes, scoring
from pacegrid.streaming import recorder


def test_haversine_and_destination(spark):
    row = spark.range(1).select(*(c.alias(n) for c, n in zip(geo.destination(F.lit(38.0), F.lit(-78.5), F.lit(90.0), F.lit(1500.0)), "ab", strict=True))).select("a", "b", geo.haversine(F.lit(38.0), F.lit(-78.5), F.col("a"), F.col("b")).alias("d")).first()
    assert row.d == pytest.approx(1500, abs=1e-6) and row.b > -78.5


def test_cells_of_negative_places(spark):
    row = spark.range(1).select(geo.cell_row(F.lit(-0.0001)).alias("r"), geo.cell_column(F.lit(-0.0001), F.lit(-0.0001)).alias("c")).first()
    assert (row.r, row.c) == (-1, -1)


NODES = "node_id long, y double, x double, elevation double, signal boolean"
EDGES = "u long, v long, key int, length double, highway string, surface string"


def test_crossing_entry_costs(spark):
    nodes = spark.createDataFrame([(i, 0.0, 0.0, 100.0, False) for i in (1, 2, 3, 4)], NODES)
    rows = [(1, 2, 0, 100.0, "primary", None), (2, 3, 0, 100.0, "primary", None), (4, 2, 0, 100.0, "residential", None), (2, 4, 0, 100.0, "residential", None)]
    costs = network.collapse(network.edge_costs(spark.createDataFrame(rows, EDGES), nodes, "mixed", False))
    found = {(r.u, r.v): r.cost for r in costs.collect()}
    assert found[4, 2] == 400 and found[2, 4] == 100 and found[1, 2] == 280


def test_parallel_edges_by_preference(spark):
    nodes = spark.createDataFrame([(i, 0.0, 0.0, None, False) for i in (1, 2)], NODES)
    edges = spark.createDataFrame([(1, 2, 0, 100.0, "residential", None), (1, 2, 1, 110.0, "path", "gravel")], EDGES)
    for surface, key in (("road", 0), ("trail", 1)):
        assert network.collapse(network.edge_costs(edges, nodes, surface, False)).first().key == key


def test_flat_climb(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0, 100.0, False), (2, 0.0, 0.0, 105.0, False), (3, 0.0, 0.0, None, False)], NODES)
    edges = spark.createDataFrame([(1, 2, 0, 100.0, "residential", None), (2, 1, 0, 100.0, "residential", None), (1, 3, 0, 100.0, "residential", None)], EDGES)
    found = {(r.u, r.v): r.cost for r in network.edge_costs(edges, nodes, "mixed", True).collect()}
    assert found == {(1, 2): 150, (2, 1): 100, (1, 3): 100}


def test_reach_is_bounded_and_shortest(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    edges = spark.createDataFrame([(1, 2, 0, 100.0, "", ""), (2, 3, 0, 100.0, "", ""), (1, 3, 0, 250.0, "", ""), (3, 4, 0, 150.0, "", "")], EDGES)
    found = {r.node_id: r.metres for r in network.bounded_reach(spark.createDataFrame([(1,)], "source long"), edges, 300.0).collect()}
    assert found == {1: 0, 2: 100, 3: 200}


def test_repeated_share_counts_both_ways(spark):
    walked = spark.createDataFrame([(1, p, n) for p, n in enumerate([1, 2, 3, 2, 1])], "route_id long, pos long, node_id long")
    edges = spark.createDataFrame([(a, b, 0, 1000.0, "", "") for a, b in ((1, 2), (2, 3), (3, 2), (2, 1))], EDGES)
    row = routes.repeated_share(routes.measured_steps(routes.steps(walked), edges)).first()
    assert (row.metres, row.repeated_metres, row.missing) == (4000, 2000, 0)


def test_ranking_puts_awkward_and_off_target_loops_last(spark):
    base = dict(request_id=1, gain=10.0, signals=0, crossings=0, trail=0.5, repeated=0.0, compactness=0.5, coverage=1.0, drive=0.0, target=5.0, surface="mixed", climb="balanced")
    rows = [base | x for x in (dict(ordinal=1, miles=5.0, signals=3), dict(ordinal=2, miles=5.1), dict(ordinal=3, miles=5.0, compactness=0.1), dict(ordinal=4, miles=7.0))]
    found = {r.ordinal: r.rank for r in scoring.rank(spark.createDataFrame(rows)).collect()}
    assert found == {2: 1, 1: 2, 3: 3, 4: 4}


def test_recorder_reasons():
    state, fix = recorder.START, lambda ts, lon, accuracy=5.0, arrival=None: (ts, ts if arrival is None else arrival, 0.0, lon, accuracy)
    said = []
    for f in (fix(1000, 0.0), fix(3000, 0.0001), fix(2000, 0.0), fix(5000, 0.0001), fix(6000, 1.0), fix(7000, 0.0002, 99.0), fix(9000, 0.0003), fix(60_000, 0.0004), fix(61_000, 0.0004, arrival=90_000), fix(62_000, math.nan)):
        state, reason, _ = recorder.accept(state, f)
        said.append(reason)
    assert said == ["accepted", "accepted", "out-of-order", "jitter", "jump", "accuracy", "accepted", "accepted", "stale", "invalid"]
    assert state[2] == 2 and state[1] == pytest.approx(11.12, abs=0.01)


def test_recorder_stream_equals_table(spark, tmp_path):
    rows = [(s, 1000 * i, 1000 * i, 0.0, 0.0001 * i, 5.0) for s in (1, 2) for i in range(20)]
    fixes = spark.createDataFrame(rows, recorder.FIX)
    fixes.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = recorder.record_stream(spark.readStream.schema(recorder.FIX).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("runs").option("checkpointLocation", str(tmp_path / "at")).outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(90)
    assert sorted(map(tuple, spark.table("runs").collect())) == sorted(map(tuple, recorder.record_table(fixes).collect()))


def test_far_points_find_their_nearest_node(spark):
    from pacegrid import scratch

    scratch.checkpoints(spark)
    nodes = spark.createDataFrame([(1, 38.0, -78.0), (2, 38.0, -78.2), (3, 38.001, -78.0)], "node_id long, y double, x double")
    points = spark.createDataFrame([(1, 38.0, -78.001), (2, 38.3, -78.1), (3, 39.9, -80.0), (4, -20.0, 100.0)], "request_id long, lat double, lon double")
    found = {r.request_id: r for r in network.nearest_nodes(points, nodes, "request_id").collect()}

    def plain(lat, lon):
        far = lambda y, x: 2 * 6371008.8 * math.asin(math.sqrt(math.sin(math.radians(y - lat) / 2) ** 2 + math.cos(math.radians(lat)) * math.cos(math.radians(y)) * math.sin(math.radians(x - lon) / 2) ** 2))
        return min((round(far(n.y, n.x), 6), n.node_id) for n in nodes.collect())

    for p in points.collect():
        metres, node = plain(p.lat, p.lon)
        assert found[p.request_id].node_id == node and abs(found[p.request_id].metres - metres) < 1e-3
