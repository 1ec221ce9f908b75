import math

import pytest
from pyspark.sql import functions as F

from pacegrid import scratch
from pacegrid.operators import tiling


def ellipse(lat, lon, up, across, n=60):
    return [(lat + up * math.sin(2 * math.pi * k / n), lon + across * math.cos(2 * math.pi * k / n)) for k in range(n)]


SHAPES = {
    "ellipse": [ellipse(39.9, -75.1, 0.15, 0.2)],
    "l-shape": [[(25.6, -80.4), (25.6, -80.2), (25.66, -80.2), (25.66, -80.34), (25.9, -80.34), (25.9, -80.4), (25.6, -80.4)]],
    "islands": [ellipse(47.6, -122.3, 0.05, 0.05), ellipse(47.75, -122.5, 0.02, 0.04), ellipse(47.6, -122.3, 0.02, 0.02)],
    "sliver": [[(36.0, -86.0), (36.3, -86.0005), (36.3, -86.0)]],
}


def rings(spark, shapes):
    rows = [(m, i, p, y, x) for m, parts in shapes.items() for i, ring in enumerate(parts) for p, (y, x) in enumerate(ring)]
    return spark.createDataFrame(rows, "metro string, ring int, pos int, y double, x double")


def inside(parts, y, x):
    odd = False
    for ring in parts:
        for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1]):
            if (a > y) != (c > y) and x < (d - b) * (y - a) / (c - a) + b:
                odd = not odd
    return odd


def test_radii():
    assert tiling.needed_radius(12) == pytest.approx(10_621.67, abs=0.01) and tiling.needed_radius(1) == 2000
    assert tiling.tile_radius(12, 3000.0) == 13_800 and 0 < tiling.reach(13_800, 12) < 3100


def test_cells_that_a_shape_touches(spark):
    found = {(r.metro, r.row, r.column) for r in tiling.metro_cells(rings(spark, SHAPES)).collect()}
    high = 200 / 110_540
    for name, parts in SHAPES.items():
        ys, xs = [p[0] for ring in parts for p in ring], [p[1] for ring in parts for p in ring]
        touched, y = set(), min(ys)
        while y <= max(ys):
            row = math.floor(y / high)
            width = 200 / (111_320 * math.cos(math.radians((row + 0.5) * high)))
            touched |= {(name, row, math.floor(x / width)) for k in range(int((max(xs) - min(xs)) / 0.0008)) if inside(parts, y, x := min(xs) + k * 0.0008)}
            y += 0.0007
        assert touched <= found, name
        own = {c for c in found if c[0] == name}
        assert len(own) < 1.35 * len(touched) + 400, name
    # A hole's middle isn't in.
    assert not any(m == "islands" and abs((r + 0.5) * high - 47.6) < 0.005 and abs((c + 0.5) * 200 / (111_320 * math.cos(math.radians((r + 0.5) * high))) + 122.3) < 0.005 for m, r, c in found)


def test_plans_cover_every_cell(spark):
    scratch.checkpoints(spark)
    shapes = rings(spark, SHAPES)
    tiles, owned = tiling.plan(shapes, 12.0, 3000.0)
    tiles = tiles.checkpoint()
    cells = tiling.metro_cells(shapes).checkpoint()
    assert owned.count() == owned.select("metro", "row", "column").distinct().count() == cells.count()
    assert tiling.uncovered(cells, tiles, tiling.needed_radius(12)).count() == 0
    assert tiles.filter("cells = 0").count() == 0
    numbers = {m: sorted(r.tile for r in tiles.filter(F.col("metro") == m).collect()) for m in SHAPES}
    assert all(n == list(range(len(n))) and n for n in numbers.values())
    # Without one of its tiles a metro has bare cells, and only that one.
    fewer = tiles.filter("metro <> 'ellipse' or tile <> 1")
    assert [r.metro for r in tiling.uncovered(cells, fewer, tiling.needed_radius(12)).select("metro").distinct().collect()] == ["ellipse"]
    wide, _ = tiling.plan(shapes.filter("metro = 'ellipse'"), 12.0, 6000.0)
    assert wide.count() < len(numbers["ellipse"])


def test_gaps_are_patched(spark, monkeypatch):
    scratch.checkpoints(spark)
    # A lattice too wide leaves cells out.
    monkeypatch.setattr(tiling, "LATTICE_SAFETY", 1.6)
    shapes = rings(spark, {"ellipse": SHAPES["ellipse"], "sliver": SHAPES["sliver"]})
    tiles, owned = tiling.plan(shapes, 12.0, 3000.0)
    assert owned.count() == tiling.metro_cells(shapes).count()
    assert tiling.uncovered(tiling.metro_cells(shapes), tiles, tiling.needed_radius(12)).count() == 0


def test_no_reach_is_an_error(spark):
    with pytest.raises(ValueError):
        tiling.plan(rings(spark, SHAPES), 12.0, -1000.0)
