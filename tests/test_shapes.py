import math
import random

import pytest

from pacegrid import scratch
from pacegrid.functions.geo import EARTH_RADIUS
from pacegrid.operators import shapes


def crossings(spark, places, edges, *routes):
    """Crossings of each route; edges (u, v, length, major, name)."""
    scratch.checkpoints(spark)
    nodes = spark.createDataFrame([(k, float(y), float(x)) for k, (x, y) in places.items()], "node_id long, y double, x double")
    rows = [(u, v, float(length), major, [name] if name else []) for u, v, length, major, name in edges]
    lined = shapes.directed(spark.createDataFrame(rows, "u long, v long, length double, major boolean, names array<string>"), nodes)
    walked = spark.createDataFrame([(i, p, n) for i, route in enumerate(routes) for p, n in enumerate(route)], "route_id long, pos long, node_id long")
    found = [r.route_id for r in shapes.major_crossings(walked, lined, nodes).collect()]
    return [found.count(i) for i in range(len(routes))]


@pytest.mark.parametrize("other,count", [("Main Street", 1), ("Other Street", 2)])
def test_a_divided_road_is_one_crossing(spark, other, count):
    places = {k: (0.0001 * (k - 1), 0) for k in (1, 2, 3, 4)}
    edges = [(k, k + 1, 11, False, None) for k in (1, 2, 3)]
    for k in (2, 3):
        for side, off in ((0, -0.0001), (1, 0.0001)):
            places[k * 10 + side] = (places[k][0], off)
            edges.append((k, k * 10 + side, 11, True, "Main Street" if k == 2 else other))
    assert crossings(spark, places, edges, [1, 2, 3, 4]) == [count]


def test_a_turn_on_one_side_is_none(spark):
    places = {1: (-0.0002, 0.0002), 2: (0, 0), 3: (-0.0002, -0.0002), 4: (0, 0.0003), 5: (0, -0.0003), 6: (0.0002, -0.0002)}
    edges = [(u, v, 30, False, None) for u, v in ((1, 2), (2, 3), (2, 6))]
    edges += [e for k in (4, 5) for e in ((2, k, 33, True, "Main Street"), (k, 2, 33, True, "Main Street"))]
    assert crossings(spark, places, edges, [1, 2, 3], [1, 2, 6]) == [0, 1]


def test_leaving_on_the_other_side(spark):
    places = {1: (-0.0003, 0), 2: (0, 0), 3: (0, 0.0003), 4: (0.0003, 0.0003), 5: (-0.0003, 0.0003)}
    edges = [(1, 2, 26, False, None), (2, 3, 33, True, "Main Street"), (3, 4, 26, False, None), (3, 5, 26, False, None)]
    # A route that begins on the road has no side to leave.
    assert crossings(spark, places, edges, [1, 2, 3, 4], [1, 2, 3, 5], [2, 3, 4]) == [1, 0, 0]


def test_passing_a_major_side_road(spark):
    places = {1: (-0.0003, 0), 2: (0, 0), 3: (0, 0.0003), 4: (0, 0.0006), 5: (0, 0.0009), 6: (-0.0003, 0.0009), 7: (-0.0003, 0.0003), 8: (0.0003, 0.0006)}
    edges = [(1, 2, 26, False, None), *((k, k + 1, 33, True, "Main Street") for k in (2, 3, 4)), (5, 6, 26, False, None)]
    edges += [(3, 7, 26, True, "Side Road"), (4, 8, 26, True, "East Road")]
    assert crossings(spark, places, edges, [1, 2, 3, 4, 5, 6]) == [1]


def test_directions_of_curved_edges(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.001)], "node_id long, y double, x double")
    bend = [(0.0, 0.0), (0.00001, 0.0), (0.0003, 0.0), (0.0, 0.001)]
    rows = [(1, 2, [{"y": y, "x": x} for y, x in bend]), (2, 1, [{"y": y, "x": x} for y, x in bend])]
    found = {(r.u, r.v): (r.leaving, r.arrived) for r in shapes.directed(spark.createDataFrame(rows, "u long, v long, line array<struct<y: double, x: double>>"), nodes).collect()}
    back = math.atan2(0.0003, -0.001)
    assert found[1, 2] == pytest.approx((math.pi / 2, back), abs=1e-4) and found[2, 1] == pytest.approx((back, math.pi / 2), abs=1e-4)


def walk(*legs):
    """Points from a start, one per (bearing, metres)."""
    out = [(38.03, -78.48)]
    for bearing, metres in legs:
        (y, x), arc, turn = out[-1], metres / EARTH_RADIUS, math.radians(bearing)
        phi = math.radians(y)
        to = math.asin(math.sin(phi) * math.cos(arc) + math.cos(phi) * math.sin(arc) * math.cos(turn))
        out.append((math.degrees(to), x + math.degrees(math.atan2(math.sin(turn) * math.sin(arc) * math.cos(phi), math.cos(arc) - math.sin(phi) * math.sin(to)))))
    return out


def table(spark, *lines):
    return spark.createDataFrame([(i, p, y, x) for i, line in enumerate(lines) for p, (y, x) in enumerate(line)], "route_id long, pos long, y double, x double")


def plain_doubled(line):
    scale = 111_320.0 * math.cos(math.radians(line[0][0]))
    flat = [(x * scale, y * 110_540.0) for y, x in line]
    total = sum(math.dist(a, b) for a, b in zip(flat, flat[1:]))
    samples, at = [], 0.0
    for a, b in zip(flat, flat[1:]):
        length = math.dist(a, b)
        n = max(1, int(length // 10))
        if length:
            for k in range(n):
                samples.append((a[0] + (b[0] - a[0]) * k / n, a[1] + (b[1] - a[1]) * k / n, at + length * k / n, (b[0] - a[0]) / length, (b[1] - a[1]) / length, length / n))
        at += length
    back = 0.0
    for e, n, w, he, hn, weight in samples:
        back += weight * any(v < w and min(w - v, total - w + v) > 40 and math.hypot(e - a, n - b) <= 20 and he * ha + hn * hb < -0.5 for a, b, v, ha, hb, _ in samples)
    return back / total if total > 80 else 0.0


def dealt_rows(spark, found):
    """Rows that a query deals out to other tasks."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None))
    before = {s.stageId() for s in stages()}
    found.collect()
    return sum(s.shuffleWriteRecords() for s in stages() if s.stageId() not in before)


def test_parts_of_lines_are_dealt_out_not_their_samples(spark, monkeypatch):
    """each sample was dealt out nine times; now a part is dealt out once for each cell, and of
    samples only those that run back."""
    rng = random.Random(4)
    lines = [walk((90, 800), (0, 60), (270, 700)) for _ in range(20)]
    assert dealt_rows(spark, shapes.doubled_back(table(spark, *lines))) < 20 * 40
    wild = [walk(*((rng.choice([0, 85, 180, 265]), rng.choice([4, 15, 60, 300, 700])) for _ in range(n))) for n in (30, 40, 90)]
    for few in (0, 1000):
        monkeypatch.setattr(shapes, "FEW", few)
        found = {r.route_id: r.doubled for r in shapes.doubled_back(table(spark, *wild)).collect()}
        assert min(found.values()) > 0 and all(found[i] == pytest.approx(plain_doubled(line), abs=1e-9) for i, line in enumerate(wild))


def test_segments_that_share_cells_meet_once(spark):
    """pairs of segments were dealt out again to drop those that met in several cells."""
    metre = lambda *at: [round(c * shapes.GRAIN) for c in at]
    rows = [(1, 1, *metre(-900, -900, 900, 900)), (1, 2, *metre(-900, 900, 900, -900)), (1, 3, *metre(-800, 0, 1200, 0)), (1, 4, *metre(-700, 0, 700, 0)), (1, 5, *metre(3000, 3000, 3100, 3000))]
    segments = spark.createDataFrame(rows, "route_id long, k long, e long, n long, e2 long, n2 long")
    found = shapes.meetings(segments)
    lines = found._jdf.queryExecution().executedPlan().toString().splitlines()
    assert any("Join" in line for line in lines) and not any("Aggregate" in line for line in lines)
    centre = [(a, b, 0, 0) for a in range(1, 5) for b in range(1, 5) if a != b and {a, b} != {3, 4}]
    along = [(a, b, e * shapes.GRAIN, 0) for a, b in ((3, 4), (4, 3)) for e in (-700, 700)]
    assert sorted((r.k, r.other, r.e, r.n) for r in found.collect()) == sorted(centre + along)


def test_doubling_back(spark):
    square = walk((90, 500), (0, 500), (270, 500), (180, 500))
    spur = walk((90, 500), (0, 250), (90, 100), (0, 12), (270, 100), (0, 238), (270, 500), (180, 500))
    rng = random.Random(1)
    wild = [walk(*((rng.choice([0, 90, 180, 270]) + rng.choice([0, 0, 3]), rng.choice([15, 40, 60, 200])) for _ in range(25))) for _ in range(4)]
    lines = [walk((90, 800), (0, 12), (270, 800)), square, square + square[1:], spur, walk((90, 800), (0, 60), (270, 800)), walk((90, 30), (270, 30)), walk(), [*square[:2], *square[1:]], *wild]
    found = {r.route_id: r.doubled for r in shapes.doubled_back(table(spark, *lines)).collect()}
    assert found[0] == pytest.approx(0.5, abs=0.03) and found[3] == pytest.approx(100 / 2212, abs=0.01)
    assert [found[i] for i in (1, 2, 4, 5, 6, 7)] == [0] * 6
    assert all(found[i] == pytest.approx(plain_doubled(line), abs=1e-9) for i, line in enumerate(lines))
    assert max(found[i] for i in range(8, 12)) > 0.1


def shoelace(line):
    scale = 111_320.0 * math.cos(math.radians(line[0][0]))
    flat = [(x * scale, y * 110_540.0) for y, x in line]
    both = list(zip(flat, flat[1:] + flat[:1]))
    return min(1.0, 2 * math.pi * abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in both)) / sum(math.dist(a, b) for a, b in both) ** 2)


def test_compactness_of_outlines(spark):
    scratch.checkpoints(spark)
    line = lambda *points: [(y * 0.01, x * 0.01) for x, y in points]
    diamond = [(0, 0), (1, 1), (2, 0), (1, -1), (0, 0)]
    cases = {
        "square": line((0, 0), (1, 0), (1, 1), (0, 1), (0, 0)),
        "sliver": line((0, 0), (1, 0), (1, 0.05), (0, 0.05), (0, 0)),
        "pentagon": line((0, 0), (3, 0), (4, 2), (1, 3), (-1, 1), (0, 0)),
        "eight": line(*diamond, (-1, 1), (-2, 0), (-1, -1), (0, 0)),
        "lobe": line(*diamond),
        "bowtie": line((0, 0), (2, 2), (2, 0), (0, 2), (0, 0)),
        "triangle": line((0, 0), (1, 1), (0, 2), (0, 1), (0, 0)),
        "spur": line((0, 0), (2, 0), (2, 2), (3, 3), (2, 2), (0, 2), (0, 0)),
        "within": line((0, 0), (4, 0), (4, 4), (0, 4), (0, 0), (1, 1), (2, 1), (1, 2), (1, 1), (0, 0)),
        "out and back": line((0, 0), (1, 0), (2, 0), (1, 0), (0, 0)),
        "short": line((0, 0), (1, 0), (0, 0)),
        "still": line(*[(1, 1)] * 5),
        "twice": line(*diamond, *diamond[1:]),
        "touching": line((0, 0), (4, 0), (4, 4), (2, 0), (0, 4), (0, 0)),
    }
    found = {list(cases)[r.route_id]: r.compactness for r in shapes.compactness(table(spark, *cases.values())).collect()}
    near = lambda want, rel=1e-5: pytest.approx(want, rel=rel)
    for name in ("square", "sliver", "pentagon", "lobe", "spur", "touching"):
        assert found[name] == near(shoelace(cases[name])), name
    assert 0.7 < found["square"] < 0.85 and found["sliver"] < 0.2
    assert found["eight"] == near(found["lobe"] / 2) and shoelace(cases["eight"]) < 1e-9
    assert found["bowtie"] == near(found["triangle"] / 2, 1e-3)
    assert found["twice"] == near(found["lobe"] / 4)
    outer = shoelace(cases["within"][:5])
    around = lambda points: sum(math.hypot((b[1] - a[1]) * 111_320, (b[0] - a[0]) * 110_540) for a, b in zip(points, points[1:]))
    assert found["within"] == near(outer * (around(cases["within"][:5]) / around(cases["within"])) ** 2)
    assert found["out and back"] == found["short"] == found["still"] == 0
