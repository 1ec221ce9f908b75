import random
import statistics

import pytest
from pyspark.sql import functions as F

from pacegrid import scratch
from pacegrid.operators import elevation, exports, network, pools, reports, routes, selection, shapes


def test_greedy_choice_equals_a_plain_loop(spark):
    rng = random.Random(5)
    placed = [(g, r, p + 1) for g in range(6) for p, r in enumerate(rng.sample(range(100 * g, 100 * g + 30), 20))]
    against = {(g, *sorted(rng.sample([r for k, r, _ in placed if k == g], 2))) for g in range(5) for _ in range(40)}
    want = set()
    for g in range(6):
        chosen = []
        for _, r, _ in sorted((x for x in placed if x[0] == g), key=lambda x: x[2]):
            if len(chosen) < 4 and not any((g, min(r, c), max(r, c)) in against for c in chosen):
                chosen.append(r)
        want |= {(g, r, i + 1) for i, r in enumerate(chosen)}
    rows = spark.createDataFrame(placed, "g long, route_id long, place long")
    met = spark.createDataFrame(sorted(against), "g long, a long, b long")
    assert {tuple(r) for r in selection.distinct_routes(rows, met, "g", 4).collect()} == want


def test_choice_by_streets_takes_all_routes_of_a_group(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rng = random.Random(7)
    length = {e: 50.0 + 10 * e for e in range(40)}
    walks = {(g, 1000 * g + r): set(range(15 + g, 36 + g)) | {rng.randrange(5)} for g in range(3) for r in range(70)}
    walks |= {(g, 1000 * g + 70 + r): set(rng.sample(range(40), 10)) for g in range(3) for r in range(30)}
    want = set()
    for g in range(3):
        chosen = []
        for k in sorted(k for k in walks if k[0] == g):
            size = lambda streets: sum(length[e] for e in streets)
            if len(chosen) < 5 and not any(size(walks[k] & walks[c]) / size(walks[k] | walks[c]) >= 0.7 for c in chosen):
                chosen.append(k)
        want |= {(*k, i + 1) for i, k in enumerate(chosen)}
    steps = [(g, r, e, e + 100, length[e]) for (g, r), streets in walks.items() for e in streets]
    streets = routes.walked_streets(spark.createDataFrame(steps, "g long, route_id long, u long, v long, length double"), "g")
    placed = spark.createDataFrame([(g, r, r) for g, r in walks] + [(9, 9000, 1)], "g long, route_id long, place long")
    assert {tuple(r) for r in selection.distinct_by_streets(placed, streets, "g", 5, 0.7).collect()} == want | {(9, 9000, 1)}
    assert any(r % 1000 >= 60 for _, r, _ in want)
    assert selection.distinct_by_streets(placed.limit(0), streets, "g", 5, 0.7).count() == 0


def test_distinct_routes_query_takes_all_routes_of_an_area(spark):
    from pacegrid.plans import route_queries as q

    sf_dir = "/root/testdata/sf0.01"
    area, walks = {}, {}
    for r in q.t.route_nodes(spark, sf_dir).filter("pos = 0").collect():
        area[r.route_id] = r.node_id // 11
    for r in q._measured(spark, sf_dir).filter("length is not null").collect():
        walks.setdefault(r.route_id, {})[min(r.u, r.v), max(r.u, r.v)] = r.length
    chosen = {}
    for r in sorted(area):
        mine, others = walks.get(r, {}), chosen.setdefault(area[r], [])

        def share(c, mine=mine):
            common = sum(min(mine[e], walks[c][e]) for e in mine.keys() & walks[c].keys())
            return round(common / (sum(mine.values()) + sum(walks[c].values()) - common), 6)

        if len(others) < 5 and all(share(c) < 0.7 for c in others):
            others.append(r)
    want = {(a, r, i + 1) for a, routes_ in chosen.items() for i, r in enumerate(routes_)}
    assert {tuple(r) for r in q.distinct_routes(spark, sf_dir).collect()} == want


def test_gate_reasons(spark):
    rows = [(1, 0.1, False), (1, 0.1, False), (2, 0.1, True), (2, 0.1, False), (3, 0.1, False), (3, 0.9, False)]
    found = selection.answer_gate(spark.createDataFrame(rows, "request_id long, error double, awkward boolean"), 3)
    assert {r.request_id: r.reason for r in found.collect()} == {1: "answered", 2: "few without doubling back", 3: "few in band"}


def test_gate_counts_thin_loops_and_distinct_routes(spark):
    rows = [(1, 0.1, True, 0.0), (1, 0.25, True, 0.1), (2, 0.1, False, 0.0), (2, 0.1, False, 0.2), (3, 0.1, False, 0.0), (3, 0.3, False, 0.0)]
    rows += [(r, 0.1, False, 0.0) for r in (4, 4, 5, 5)]
    ranked = spark.createDataFrame(rows, "request_id long, error double, awkward boolean, repeated double")
    distinct = spark.createDataFrame([(1, 2), (4, 1)], "request_id long, distinct long")
    found = selection.answer_gate(ranked, 3, 0.25, F.col("repeated") <= 0.10, distinct).collect()
    assert {r.request_id: r.reason for r in found} == {1: "answered", 2: "few without doubling back", 3: "few in band", 4: "few distinct", 5: "few distinct"}


def test_gate_query_counts_by_repetition_in_the_band(spark):
    from pacegrid.plans import route_queries as q

    ranked = q.scoring.rank(q.t.candidates(spark, "/root/testdata/sf0.001"))
    near, sound = {}, {}
    for r in ranked.select("request_id", "error", "repeated").collect():
        near[r.request_id] = near.get(r.request_id, 0) + (r.error <= 0.25)
        sound[r.request_id] = sound.get(r.request_id, 0) + (r.error <= 0.25 and r.repeated <= 0.10)
    found = q.answer_gate(spark, "/root/testdata/sf0.001").collect()
    assert {(r.request_id, r.near, r.sound) for r in found} == {(k, near[k], sound[k]) for k in near}


@pytest.mark.parametrize("n", [1, 2, 19, 20, 21, 100])
def test_order_statistics(spark, n):
    values = sorted(random.Random(n).choices(range(30), k=n))
    rows = spark.createDataFrame([("a", float(v)) for v in values] + [("a", None)], "k string, v double")
    row = reports.order_statistics(rows, "k", "v").first()
    at = 0.95 * (n - 1)
    low, high = values[int(at)], values[min(n - 1, -int(-at // 1))]
    assert row.n == n and row.median == statistics.median(values) and row.upper_median == values[n // 2]
    assert row.p95_floor == low and row.p95_rank == values[-int(-n * 0.95 // 1) - 1]
    assert row.p95_linear == pytest.approx(low + (high - low) * (at - int(at)), abs=1e-6)


def test_bilinear_clamps_and_skips_unknown_corners(spark):
    raster = spark.createDataFrame([(0, 0, 0.0), (0, 1, 10.0), (1, 0, 20.0), (1, 1, 30.0), (0, 2, None), (1, 2, 5.0)], "row long, column long, height double")
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, -3.0, 0.0), (3, 0.5, 1.5), (4, 9.0, 0.0)], "id long, at_row double, at_column double")
    assert {r.id: r.elevation for r in elevation.bilinear(points, raster, "id").collect()} == {1: 15.0, 2: 0.0, 3: None, 4: 20.0}


def test_audit(spark):
    nodes = [(1, p, n) for p, n in enumerate([1, 2, 3, 1])] + [(2, p, n) for p, n in enumerate([1, 2, 1])] + [(3, p, n) for p, n in enumerate([1, 2, 9, 3])]
    walked = spark.createDataFrame(nodes, "route_id long, pos long, node_id long")
    edges = spark.createDataFrame([(a, b, 0, 100.0, "", "") for a, b in ((1, 2), (2, 3), (3, 1), (2, 1))], "u long, v long, key int, length double, highway string, surface string")
    found = routes.audit(walked, routes.measured_steps(routes.steps(walked), edges))
    assert sorted(map(tuple, found.collect())) == [(2, "repeating"), (2, "short"), (3, "missing edge"), (3, "open")]


def test_serving_retries_only_open_requests(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    nodes = spark.createDataFrame([(i, 0.0001, 0.0001 + 0.001 * i, None, False) for i in range(6)], "node_id long, y double, x double, elevation double, signal boolean")
    edges = spark.createDataFrame([(a, b, 0, 110.0, "", "") for i in range(5) for a, b in ((i, i + 1), (i + 1, i))], "u long, v long, key int, length double, highway string, surface string")
    loops = spark.createDataFrame([(7, p, n, "200:0:0", 1500.0) for p, n in enumerate([0, 1, 0])], "route_id long, pos long, node_id long, cell string, metres double")
    asked = spark.createDataFrame([(1, 1, 1.0), (2, 3, 1.0), (3, 5, 1.0), (4, 1, 5.0)], "request_id long, source long, target_miles double")
    found = {r.request_id: (r.retry, r.pos, r.connector, r.metres) for r in pools.serve(asked, nodes, edges, loops).collect()}
    assert found == {1: ("none", 1, 0.0, 1500.0), 2: ("wider", 1, 440.0, 1940.0)}


def test_first_attempt_takes_loops_of_neighbour_cells(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    nodes = spark.createDataFrame([(i, 0.0001, 0.0001 + 0.001 * i, None, False) for i in range(6)], "node_id long, y double, x double, elevation double, signal boolean")
    edges = spark.createDataFrame([(a, b, 0, 110.0, "", "") for i in range(5) for a, b in ((i, i + 1), (i + 1, i))], "u long, v long, key int, length double, highway string, surface string")
    walked = [(7, 0, "200:0:0"), (8, 3, "200:0:1"), (9, 5, "200:0:2")]
    loops = spark.createDataFrame([(r, 0, n, cell, 1500.0) for r, n, cell in walked], "route_id long, pos long, node_id long, cell string, metres double")
    asked = spark.createDataFrame([(1, 1, 1.0)], "request_id long, source long, target_miles double")
    found = {(r.retry, r.route_id, r.connector) for r in pools.serve(asked, nodes, edges, loops, pools.NEAR_RINGS).collect()}
    assert found == {("none", 7, 220.0), ("none", 8, 440.0)}
    assert {(r.retry, r.route_id) for r in pools.serve(asked, nodes, edges, loops).collect()} == {("none", 7)}


def test_exports(spark):
    points = spark.createDataFrame([(1, 1, 2.5, -1.25, None), (1, 0, 2.0, -1.0, 3.04)], "route_id long, pos long, y double, x double, elevation double")
    assert '<trkpt lat="2.0000000" lon="-1.0000000"><ele>3.0</ele></trkpt><trkpt lat="2.5000000" lon="-1.2500000"></trkpt>' in exports.gpx(points).first().gpx
    assert exports.geojson(points).first().feature.endswith("[[-1.0000000,2.0000000],[-1.2500000,2.5000000]]}}")


def test_crop_and_origins(spark):
    nodes = spark.createDataFrame([(1, 0.0005, 0.0005, None, False), (2, 0.0009, 0.0009, None, False), (3, 1.0, 1.0, None, False)], "node_id long, y double, x double, elevation double, signal boolean")
    edges = spark.createDataFrame([(1, 2, 0, 10.0, "", ""), (2, 3, 0, 10.0, "", "")], "u long, v long, key int, length double, highway string, surface string")
    kept, inner = network.crop(nodes, edges, 0.0, 0.0, 500.0)
    assert kept.count() == 2 and [(r.u, r.v) for r in inner.collect()] == [(1, 2)]
    assert [r.node_id for r in network.cell_origins(nodes).orderBy(F.col("node_id")).collect()] == [2, 3]


def test_compactness(spark):
    scratch.checkpoints(spark)
    square = [(1, i, y, x) for i, (y, x) in enumerate([(0.0, 0.0), (0.0, 0.001), (0.001, 0.001), (0.001, 0.0), (0.0, 0.0)])]
    line = [(2, 0, 0.0, 0.0), (2, 1, 0.0, 0.1), (2, 2, 0.0, 0.0)]
    found = {r.route_id: r.compactness for r in shapes.compactness(spark.createDataFrame(square + line, "route_id long, pos long, y double, x double")).collect()}
    assert found[1] == pytest.approx(0.7854, abs=1e-3) and found[2] == 0
