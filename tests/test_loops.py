import heapq
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pacegrid import scratch
from pacegrid.functions.geo import EARTH_RADIUS, MILE
from pacegrid.operators import loops, measures, network, paths

SIDE = 14


@pytest.fixture(scope="module")
def town(spark):
    """(nodes, edges) of a town of streets some 110 m long, a few of them trails or major, some one-way."""
    rng = random.Random(6)
    nodes = {k: (38.0 + k // SIDE * 0.001 + rng.uniform(-1, 1) * 1e-4, -78.5 + k % SIDE * 0.00125 + rng.uniform(-1, 1) * 1e-4) for k in range(SIDE * SIDE)}
    edges = {}
    for k in nodes:
        for far in [k + 1] * (k % SIDE < SIDE - 1) + [k + SIDE] * (k + SIDE in nodes):
            tags = rng.choice([("residential", "asphalt")] * 6 + [("path", "gravel"), ("primary", None)])
            length = round(metres(nodes[k], nodes[far]), 3)
            edges[k, far] = (length, *tags)
            if rng.random() > 0.05:
                edges[far, k] = (length, *tags)
    rows = [(k, y, x, 100.0 + k % 17, k % 23 == 0) for k, (y, x) in nodes.items()]
    table = spark.createDataFrame(rows, "node_id long, y double, x double, elevation double, signal boolean")
    tagged = spark.createDataFrame([(u, v, 0, *e, []) for (u, v), e in edges.items()], "u long, v long, key int, length double, highway string, surface string, names array<string>")
    return nodes, edges, table, tagged


def metres(a, b):
    up, across = math.sin(math.radians(b[0] - a[0]) / 2), math.sin(math.radians(b[1] - a[1]) / 2)
    return 2 * EARTH_RADIUS * math.asin(math.sqrt(up * up + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * across * across))


def destination(start, bearing, far):
    arc, turn, phi = far / EARTH_RADIUS, math.radians(bearing), math.radians(start[0])
    to = math.asin(math.sin(phi) * math.cos(arc) + math.cos(phi) * math.sin(arc) * math.cos(turn))
    return math.degrees(to), start[1] + math.degrees(math.atan2(math.sin(turn) * math.sin(arc) * math.cos(phi), math.cos(arc) - math.sin(phi) * math.sin(to)))


def plain_path(out, start, end):
    cost, todo, before = {start: 0}, [(0, start)], {}
    while todo:
        d, u = heapq.heappop(todo)
        if d > cost[u]:
            continue
        for v, c in out.get(u, {}).items():
            if d + c < cost.get(v, d + c + 1):
                cost[v] = d + c
                heapq.heappush(todo, (d + c, v))
    if end not in cost:
        return None
    line = [end]
    while line[-1] != start:
        line.append(min(u for u in cost if line[-1] in out.get(u, {}) and cost[u] + out[u][line[-1]] == cost[line[-1]]))
    return line[::-1]


def plain_trim(nodes):
    while True:
        at = next((i for i in range(len(nodes) - 2) if nodes[i] == nodes[i + 2]), None)
        if at is None:
            return nodes
        nodes = nodes[: at + 1] + nodes[at + 3 :]


def test_trimmed_spurs(spark):
    trim = lambda nodes: loops.trim_spurs.func(pd.Series([nodes]))[0]
    assert trim([1, 2, 3, 9, 3, 4, 7, 8, 7, 4, 1]) == [1, 2, 3, 4, 1]
    assert trim([1, 2, 3, 4, 2, 5, 1]) == [1, 2, 3, 4, 2, 5, 1] and trim([]) == [] and trim([1, 2, 1]) == [1]
    rng = random.Random(1)
    for _ in range(200):
        nodes = [0]
        for _ in range(rng.randrange(25)):
            nodes.append(rng.choice([n for n in range(4) if n != nodes[-1]]))
        assert trim(nodes) == plain_trim(nodes)


@pytest.fixture(scope="module")
def on(spark, town):
    scratch.checkpoints(spark)
    _, _, nodes, edges = town
    collapsed = network.collapse(network.edge_costs(edges, nodes, "mixed", False))
    return loops.Network(nodes, edges, paths.cost_links(collapsed))


def asked(spark, nodes, *rows):
    full = [(i, origin, *nodes[origin], target, 0.25, wanted, "mixed", "balanced") for i, (origin, target, wanted) in enumerate(rows)]
    return spark.createDataFrame(full, "request_id long, origin long, lat double, lon double, target double, tolerance double, wanted int, surface string, climb string")


def test_first_attempts_against_plain_search(spark, town, on):
    nodes, _, _, _ = town
    requests = asked(spark, nodes, (SIDE * 7 + 6, 0.8, 3))
    tried = loops.waypoints(loops.first_attempts(requests), requests, on.nodes)
    found, _ = loops.measured_loops(tried, on, 0.8 * MILE * loops.SEARCH)
    got = {r.attempt: list(r.nodes) for r in found.collect()}
    out, turned = {}, {}
    for r in on.links.collect():
        out.setdefault(r.u, {})[r.v] = r.cost
        turned.setdefault(r.v, {})[r.u] = r.cost
    want, origin, attempt = {}, SIDE * 7 + 6, 0
    nearest = lambda p: min(nodes, key=lambda k: (round(metres(p, nodes[k]), 6), k))
    for scale in loops.SCALES:
        for heading in loops.HEADINGS:
            for sweep in loops.SWEEPS:
                ends = [nearest(destination(nodes[origin], heading + side * sweep / 2, 0.8 * MILE / 3 * scale)) for side in (-1, 1)]
                if len({origin, *ends}) == 3:
                    legs = plain_path(out, origin, ends[0]), plain_path(out, *ends), plain_path(turned, origin, ends[1])
                    if all(legs):
                        line = plain_trim([*legs[0], *legs[1][1:], *legs[2][::-1][1:]])
                        if len(line) >= 4:
                            want[attempt] = line
                attempt += 1
    assert got == want and len(want) > 40


def test_generated_loops(spark, town, on):
    nodes, edges, table, _ = town
    requests = asked(spark, nodes, (SIDE * 7 + 6, 1.0, 3), (0, 1.0, 2), (SIDE * 3 + 9, 20.0, 3))
    rows = loops.generate(requests, on, 1.0).orderBy("request_id", "place").collect()
    by = {i: [r for r in rows if r.request_id == i] for i in range(3)}
    # Twenty miles don't fit into the town: nothing is long enough.
    assert len(by[0]) == 3 and 1 <= len(by[1]) <= 2 and not by[2]
    for r in rows:
        line = list(r.nodes)
        assert line[0] == line[-1] == (SIDE * 7 + 6, 0)[r.request_id] and all(s in edges for s in zip(line, line[1:]))
        assert plain_trim(line) == line and r.miles == pytest.approx(sum(edges[s][0] for s in zip(line, line[1:])) / MILE)
        assert 0.55 <= r.miles <= 1.5
    for some in by.values():
        streets = [{(min(s), max(s)): edges[s][0] for s in zip(r.nodes, r.nodes[1:])} for r in some]
        for i, a in enumerate(streets):
            for b in streets[:i]:
                shared = sum(min(x, b.get(s, 0)) for s, x in a.items())
                assert shared / (sum(a.values()) + sum(b.values()) - shared) < 0.7
        assert [r.place for r in some] == list(range(1, len(some) + 1)) and [r.rank for r in some] == sorted(r.rank for r in some)
    assert abs(by[0][0].miles - 1.0) <= 0.25


def test_second_attempts(spark):
    closest = spark.createDataFrame([(1, 0.72, 30, 80, 2.0, 1.0, 0.25), (1, 0.9, 60, 120, 1.1, 1.0, 0.25), (1, 0.9, 90, 120, 0.001, 1.0, 0.25), (2, 0.9, 90, 80, 3.0, 1.0, 0.25)], "request_id long, scale double, heading int, sweep int, miles double, target double, tolerance double")
    ids = lambda *i: spark.createDataFrame([(k,) for k in i], "request_id long")
    rows = loops.second_attempts(closest, ids(1), ids(3)).collect()
    bent = sorted((r.request_id, round(r.scale, 3), r.heading, r.sweep) for r in rows if r.attempt < 3 * loops.SECOND)
    # The one within tolerance isn't bent; the tiny one only as far as waypoints may go.
    assert bent == [(1, 0.36, 30, 80), (1, 4.0, 90, 120)]
    assert sum(r.request_id == 1 for r in rows) == 2 + 48 and {(r.scale, r.sweep) for r in rows if r.request_id == 3} == {(0.65, 90)} and sum(r.request_id == 3 for r in rows) == 12
    assert len({(r.request_id, r.attempt) for r in rows}) == len(rows)


def test_measures_in_one_row(spark):
    """Three nodes walked out and back: two signals, half trail, half repeated."""
    scratch.checkpoints(spark)
    nodes = spark.createDataFrame([(1, 38.0, -78.5, 100.0, True), (2, 38.009, -78.5, 110.0, True), (3, 38.018, -78.5, 105.0, False), (4, 39.0, -78.5, None, False)], "node_id long, y double, x double, elevation double, signal boolean")
    rows = [(1, 2, "residential", "asphalt"), (2, 1, "residential", "asphalt"), (2, 3, "path", "gravel"), (3, 2, "path", "gravel")]
    edges = spark.createDataFrame([(u, v, 1000.0, h, s, []) for u, v, h, s in rows], "u long, v long, length double, highway string, surface string, names array<string>")
    walked = spark.createDataFrame([(7, p, n) for p, n in enumerate([1, 2, 3, 2, 1])] + [(8, 0, 4)], "route_id long, pos long, node_id long")
    found = {r.route_id: r for r in measures.measure(walked, edges, nodes).collect()}
    r = found[7]
    assert (r.miles, r.gain, r.signals, r.crossings, r.trail, r.coverage, r.compactness) == pytest.approx((4000 / MILE, 15 * 3.28084, 3, 0, 0.5, 1.0, 0.0))
    assert r.repeated == pytest.approx(0.5, abs=0.03)
    assert found[8].miles == found[8].repeated == found[8].compactness == 0


def test_tags_of_any_kind(spark):
    rows = [(["Path", "x"], None), (["primary", "residential"], ["Mud"]), (None, None), ([], ["asphalt"])]
    listed = spark.createDataFrame(rows, "highway array<string>, surface array<string>")
    found = listed.select(network.is_trail(listed).alias("trail"), network.is_major(listed).alias("major")).collect()
    assert [tuple(r) for r in found] == [(True, False), (True, True), (False, False), (False, False)]
    one = spark.createDataFrame([("Footway", None), ("TRUNK", "woodchips"), (None, "grass")], "highway string, surface string")
    assert [tuple(r) for r in one.select(network.is_trail(one), network.is_major(one)).collect()] == [(True, False), (True, True), (False, False)]
    nodes = spark.createDataFrame([("traffic_signals", None, None), (None, "marked; Signals", None), (None, "zebra", "yes"), ("stop", "no", "no"), (None, None, None)], "highway string, crossing string, `crossing:signals` string")
    assert [r[0] for r in nodes.select(network.is_signal(nodes)).collect()] == [True, True, True, False, False]
    assert [r[0] for r in nodes.select("highway").select(network.is_signal(nodes.select("highway"))).collect()] == [True, False, False, False, False]
