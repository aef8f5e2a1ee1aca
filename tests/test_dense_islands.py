"""Clusters and islands of many hits in few places and times."""

import random
import tracemalloc

import numpy as np
from test_cluster_fit import frame

from tofloom.operators import cluster as C


def loop_dbscan(points, eps, least):
    """Labels by the definition: core points, their components in order, border points to the first."""
    near = [[j for j, b in enumerate(points) if (a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2 <= eps * eps] for a in points]
    core = [len(n) >= least for n in near]
    labels, current = [-1] * len(points), 0
    for i in range(len(points)):
        if not core[i] or labels[i] != -1:
            continue
        stack, labels[i] = [i], current
        while stack:
            for j in near[stack.pop()]:
                if labels[j] == -1:
                    labels[j] = current
                    stack += [j] if core[j] else []
        current += 1
    return labels


def test_dbscan_against_loop(spark):
    rng = random.Random(9)
    for least in (3, 8, 12):
        points = [(rng.randrange(40), rng.randrange(40)) for _ in range(300)]
        want = loop_dbscan(points, 2, least)
        x, y = (np.array(v, dtype=float) for v in zip(*points))
        assert C.dbscan_xy(x, y, 2, least).tolist() == want
        hits = frame(spark, [(0, *p, 5, 1, 1) for p in points])
        got = C.dbscan(hits, 200, 3, 2, least).orderBy("seq").collect()
        assert [r.label for r in got] == want


def test_dbscan_memory_of_a_dense_island():
    x = np.arange(2000) % 4.0
    tracemalloc.start()
    labels = C.dbscan_xy(x, x, 4.0, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(labels.tolist()) == {0} and peak < 4_000_000


def test_island_windows_see_times_once(spark):
    hits = frame(spark, [(0, 0, 0, t % 7 + 100 * (t % 3), 1, 1) for t in range(3000)])
    plan = C.time_islands(hits, 300, 3)._jdf.queryExecution().optimizedPlan().toString()
    windows = [k for k, line in enumerate(plan.splitlines()) if "Window [" in line]
    sums = [k for k, line in enumerate(plan.splitlines()) if "Aggregate [" in line]
    assert windows and sums and max(windows) < min(sums)
    rows = C.time_islands(hits, 300, 3)
    assert rows.count() == 3000 and rows.schema["island"].dataType.simpleString() == "int"
    assert {(r.toa // 100, r.island) for r in rows.collect()} == {(0, 0), (1, 1), (2, 2)}
