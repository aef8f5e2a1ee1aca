"""Clustering and fitting against plain loops and fixtures."""

import random

import numpy as np
import pytest

from tofloom.operators import cluster as C
from tofloom.operators import fit as Fit

HIT = "file string, batch_offset long, seq int, x int, y int, tot int, toa int, ftoa int, tof long, spidertime long"


def frame(spark, rows):
    """(batch, x, y, spidertime, tot, tof) rows."""
    seq, data = {}, []
    for b, x, y, t, tot, tof in rows:
        seq[b] = seq.get(b, -1) + 1
        data.append(("f", b, seq[b], x, y, tot, t % 16384, 0, tof, t))
    return spark.createDataFrame(data, HIT)


def loop_abs(hits, slots=8, r=5.0, span=75):
    boxes, labels, following = [], [], slots
    for x, y, t in hits:
        for b in boxes:
            if abs(t - b[4]) <= span and b[0] - r <= x <= b[1] + r and b[2] - r <= y <= b[3] + r:
                b[0], b[1], b[2], b[3] = min(b[0], x), max(b[1], x), min(b[2], y), max(b[3], y)
                labels.append(b[5])
                break
        else:
            if len(boxes) < slots:
                boxes.append([x, x, y, y, t, len(boxes)])
                labels.append(len(boxes) - 1)
            else:
                k = min(range(slots), key=lambda k: (boxes[k][4], k))
                boxes[k] = [x, x, y, y, t, following]
                labels.append(following)
                following += 1
    return labels


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("narrow", [1, 48, 10**9])
def test_kernel_against_loop(seed, narrow, monkeypatch):
    monkeypatch.setattr(C, "NARROW", narrow)
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 60, 90)
    key = np.repeat(np.arange(90), sizes)
    x, y = rng.integers(0, 60, len(key)), rng.integers(0, 60, len(key))
    t = rng.integers(0, 6, len(key)) * 25 * rng.integers(1, 3)
    for slots in (4, 8):
        got = C.BoxSearch(slots=slots).label(key, x, y, t)
        want = [v for k in range(90) for v in loop_abs(list(zip(x[key == k].tolist(), y[key == k].tolist(), t[key == k].tolist())), slots)]
        assert got.tolist() == want


def test_batches_cross_arrow_batches(spark):
    rng = random.Random(1)
    rows = [(b, rng.randrange(80), rng.randrange(80), rng.randrange(5), 1, 1) for b in range(40) for _ in range(rng.randrange(1, 50))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r.batch_offset, r.seq): r.label for r in C.cluster(frame(spark, rows)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for b in range(40):
        want = loop_abs([(x, y, t * 25) for k, x, y, t, *_ in rows if k == b])
        assert [got[b, k] for k in range(len(want))] == want


def test_three_groups(spark):
    rng = random.Random(2)
    rows = [(0, c + rng.randrange(2), c + rng.randrange(2), t + rng.randrange(-1, 2), 10, 100) for c, t in ((50, 10), (100, 15), (150, 20)) for _ in range(100)]
    events = Fit.centroid(C.cluster(frame(spark, rows))).orderBy("label").collect()
    assert [round(e.x / 50) * 50 for e in events] == [50, 100, 150]
    assert all(abs(e.x - c - 0.5) < 0.5 and abs(e.y - c - 0.5) < 0.5 for e, c in zip(events, (50, 100, 150)))


GOLDEN = [(0, 1750, 2038, 740, 2445, 3026), (0, 3015, 2073, 422, 3212, 428), (0, 772, 3912, 3134, 3133, 3334)]


def test_centroid_golden(spark):
    from pyspark.sql import functions as F

    hits = frame(spark, GOLDEN).withColumn("label", F.lit(0))
    w = Fit.centroid(hits).first()
    assert (w.x, w.y, w.tof) == pytest.approx((1863.66, 2718.74, 2262.67), abs=0.01)
    twice = Fit.centroid(hits, scale=2.0).first()
    assert (twice.x, twice.y) == pytest.approx((2 * w.x, 2 * w.y))
    plain = Fit.centroid(hits, weighted=False).first()
    assert (plain.x, plain.y, plain.tof, plain.n_hits) == pytest.approx((1845.67, 2674.33, 2262.67, 3), abs=0.01)
    none = Fit.centroid(hits.withColumn("tot", F.lit(0)))
    assert none.count() == 0 and Fit.centroid(hits, min_size=4).count() == 0


def test_fast_gaussian(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    xs, ys = rng.normal(200, 2, 1000), rng.normal(200, 2, 1000)
    tots, tofs = np.maximum(1, rng.normal(20, 5, 1000)), rng.normal(1000, 2, 1000)
    rows = [(0, int(round(a)), int(round(b)), 0, int(c), int(d)) for a, b, c, d in zip(xs, ys, tots, tofs)]
    hits = frame(spark, rows).withColumn("label", F.lit(0))
    e = Fit.fit(hits, "fast_gaussian").first()
    assert (e.x, e.y, e.tof) == pytest.approx((200, 200, 1000), abs=1) and e.n_hits == 1000
    few = frame(spark, rows[:7]).withColumn("label", F.lit(0))
    even = hits.withColumn("tot", F.lit(3))
    line = hits.withColumn("x", F.lit(5))
    assert [Fit.fast_gaussian(h).count() for h in (few, even, line)] == [0, 0, 0]
    with pytest.raises(ValueError):
        Fit.fit(hits, "other")
    with pytest.raises(ValueError):
        C.by_name("other")


def test_dbscan_groups(spark):
    rng = random.Random(4)
    rows = [(0, c + rng.randrange(3), c + rng.randrange(3), rng.randrange(0, 30), 1, 1) for c in (50, 100, 150) for _ in range(10)]
    events = C.dbscan_events(C.dbscan(frame(spark, rows), 8000, 30, 4, 10)).collect()
    assert sorted(round(e.x / 50) * 50 for e in events) == [50, 100, 150] and {e.n_hits for e in events} == {10}
    assert C.dbscan(frame(spark, rows[:5]), 8000, 30, 4, 10).where("label >= 0").count() == 0


def test_time_islands_against_brute(spark):
    rng = random.Random(6)
    toas = [rng.randrange(3000) for _ in range(200)]
    got = C.time_islands(frame(spark, [(0, 0, 0, t, 1, 1) for t in toas]), 300, 3).select("toa", "island").collect()
    islands, last = [], None
    for t in sorted(toas):
        if last is None or (t - last) * 25 > 300:
            islands.append([])
        islands[-1].append(t)
        last = t
    large = [i for i in islands if len(i) >= 3]
    want = {t: next((k for k, i in enumerate(large) if t in i), None) for t in toas}
    assert {r.toa: r.island for r in got} == want


def test_display_ring():
    search = C.BoxSearch(radius=5, time_range=3, slots=3, policy="fifo", strict=True)
    key = np.zeros(5, dtype=int)
    x = np.array([0, 100, 200, 0, 200])
    t = np.zeros(5, dtype=int)
    assert search.label(key, x, x, t).tolist() == [0, 1, 2, 3, 2]
