import random

import pytest

from pacegrid import scratch
from pacegrid.operators import along, graphs


def plain_components(nodes, links):
    out = {n: {v for u, v in links if u == n} for n in nodes}

    def led_to(start):
        seen, todo = {start}, [start]
        while todo:
            for v in out[todo.pop()] - seen:
                seen.add(v)
                todo.append(v)
        return seen

    reach = {n: led_to(n) for n in nodes}
    return {n: min(m for m in reach[n] if n in reach[m]) for n in nodes}


@pytest.mark.parametrize("seed", [1, 2])
def test_strong_components(spark, seed):
    scratch.checkpoints(spark)
    rng = random.Random(seed)
    nodes = list(range(60))
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(55)] + [(40 + i, 40 + (i + 1) % 9) for i in range(9)] + [(3, 4), (4, 3), (4, 5), (5, 4)]
    nodes_table = spark.createDataFrame([(n, float(n), 0.0) for n in nodes], "node_id long, y double, x double")
    edges = spark.createDataFrame([(u, v, 0, 1.0) for u, v in links], "u long, v long, key int, length double")
    found = {r.node_id: r.component for r in graphs.strong_components(nodes_table, edges).collect()}
    want = plain_components(nodes, links)
    assert found == want
    sizes = {c: list(want.values()).count(c) for c in want.values()}
    largest = min(sizes, key=lambda c: (-sizes[c], c))
    assert {r.node_id for r in graphs.core(nodes_table, edges).collect()} == {n for n in nodes if want[n] == largest}
    assert graphs.strong_components(nodes_table, edges.limit(0)).filter("node_id = component").count() == 60


def test_clusters_and_bands(spark):
    marks = spark.createDataFrame([(1, 0, 0.0), (1, 1, 40.0), (1, 2, 80.1), (1, 3, 300.0), (2, 0, 5.0)], "route_id long, pos long, at double")
    found = sorted((r.route_id, r.cluster, r.first, r.last, r.marks) for r in along.clusters(marks).collect())
    assert found == [(1, 1, 0.0, 40.0, 2), (1, 2, 80.1, 80.1, 1), (1, 3, 300.0, 300.0, 1), (2, 1, 5.0, 5.0, 1)]
    loops = spark.createDataFrame([("a", 1.0), ("a", 1.2), ("a", 1.45), ("a", 3.0), ("b", 2.0)], "cell string, miles double")
    assert sorted(map(tuple, along.best_band(loops, "cell").collect())) == [("a", 1.2, 3), ("b", 2.0, 1)]
