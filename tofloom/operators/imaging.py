"""Binned images and spectra, kept sparse until a sink needs them dense."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import check_edges
from ..functions import hits as H
from ..schemas import CANVAS


def edge_array(edges: list[float]) -> Column:
    return F.array(*(F.lit(float(e)) for e in edges))


def tof_bin(seconds: Column, edges: list[float]) -> Column:
    """Bin of a time: bin i is ``(e_i, e_i+1]``; null outside and on the first edge; the last edge itself is outside.

    Equal steps are found by division and put right by comparing with the two
    edges around; other edges by counting those below.
    """
    check_edges(edges)
    n = len(edges) - 1
    inside = (seconds >= F.lit(edges[0])) & (seconds < F.lit(edges[-1]))
    step = (edges[-1] - edges[0]) / n
    if all(abs(e - (edges[0] + step * i)) <= 1e-9 * step * n for i, e in enumerate(edges)):
        table = edge_array(edges)
        guess = F.least(F.greatest((F.ceil((seconds - F.lit(edges[0])) / F.lit(step)) - 1).cast("int"), F.lit(0)), F.lit(n - 1))
        # bound once: named four times over, the quotient would be copied into every filter that is pushed down
        put_right = lambda g: F.when(F.get(table, g) >= seconds, g - 1).when(F.get(table, g + 1) < seconds, g + 1).otherwise(g)
        found = F.transform(F.array(guess), put_right)[0]
        return F.when(inside, F.nullif(found, F.lit(-1)))
    below = F.size(F.filter(edge_array(edges), lambda e: e < seconds)) - 1
    return F.when(inside & (below >= 0), below)


def valid_tof(tof_ns: Column) -> Column:
    return tof_ns.isNotNull() & ~F.isnan(tof_ns) & (tof_ns >= 0) & (tof_ns < float("inf"))


def dimension(scale: float) -> int:
    return int(CANVAS * scale)


def binned(rows: DataFrame, edges: list[float], scale: float = 1.0) -> DataFrame:
    """Rows in range with ``bin, iy, ix``; ``tof`` in ticks."""
    ns = F.col("tof") * 25.0
    size = dimension(scale)
    rows = rows.where(valid_tof(ns.cast("double"))).withColumn("bin", tof_bin(ns / 1e9, edges)).where("bin IS NOT NULL")
    rows = rows.withColumns({"ix": H.scale(F.col("x"), scale), "iy": H.scale(F.col("y"), scale)})
    return rows.where((F.col("ix") >= 0) & (F.col("ix") < size) & (F.col("iy") >= 0) & (F.col("iy") < size))


def tof_image(rows: DataFrame, edges: list[float], scale: float = 1.0) -> DataFrame:
    """``bin, y, x, count`` of hits or neutrons (positions in pixels before scaling)."""
    cells = binned(rows, edges, scale).groupBy("bin", F.col("iy").alias("y"), F.col("ix").alias("x"))
    return cells.agg(F.count("*").alias("count"))


def binned_totals(rows: DataFrame, edges: list[float], scale: float = 1.0) -> DataFrame:
    """One row: entries in all, and those that land in an image."""
    ns = (F.col("tof") * 25.0).cast("double")
    size = dimension(scale)
    ix, iy = H.scale(F.col("x"), scale), H.scale(F.col("y"), scale)
    ok = valid_tof(ns) & tof_bin(ns / 1e9, edges).isNotNull() & (ix >= 0) & (ix < size) & (iy >= 0) & (iy < size)
    return rows.agg(F.count("*").alias("total"), F.count_if(ok).alias("binned"))


def spectrum(image: DataFrame, edges: list[float]) -> DataFrame:
    """``bin, shutter_time, counts`` for every bin; the time is the bin's upper edge."""
    spark: SparkSession = image.sparkSession
    every = spark.range(len(edges) - 1).select(F.col("id").cast("int").alias("bin"))
    sums = image.groupBy("bin").agg(F.sum("count").alias("counts"))
    return every.join(sums, "bin", "left").select(
        "bin", F.get(edge_array(edges), F.col("bin") + 1).alias("shutter_time"), F.coalesce("counts", F.lit(0)).alias("counts")
    )


def accumulate(*images: DataFrame) -> DataFrame:
    """Sum of sparse images of equal size."""
    total = images[0]
    for image in images[1:]:
        total = total.unionByName(image)
    return total.groupBy("bin", "y", "x").agg(F.sum("count").alias("count"))


def histogram_2d(rows: DataFrame, scale: float = 1.0, rotate_degrees: float = 0.0, size: int = 512) -> DataFrame:
    """``ix, iy, count`` of scaled, rotated and truncated positions within ``size * scale``."""
    x, y = F.col("x") * F.lit(float(scale)), F.col("y") * F.lit(float(scale))
    if rotate_degrees:
        x, y = H.rotate(x, y, rotate_degrees)
    side = int(size * scale)
    cells = rows.select(x.cast("int").alias("ix"), y.cast("int").alias("iy"))
    cells = cells.where((F.col("ix") >= 0) & (F.col("ix") < side) & (F.col("iy") >= 0) & (F.col("iy") < side))
    return cells.groupBy("ix", "iy").agg(F.count("*").alias("count"))


DISPLAY_TOF_BINS = 170_000


def display_tof_histogram(hits: DataFrame, roi: tuple[int, int, int, int] = (250, 425, 125, 325), x: str = "x", y: str = "y") -> DataFrame:
    """``itof, count`` in steps of 100 ns inside an open region of interest."""
    x0, x1, y0, y1 = roi
    inside = (F.col(x) > x0) & (F.col(x) < x1) & (F.col(y) > y0) & (F.col(y) < y1)
    rows = hits.where(inside).select((F.col("tof") * 0.25).cast("int").alias("itof"))
    return rows.where((F.col("itof") >= 0) & (F.col("itof") < DISPLAY_TOF_BINS)).groupBy("itof").agg(F.count("*").alias("count"))


def accepted_clusters(labelled: DataFrame, least: int = 10, scale: float = 8.0, keys: tuple[str, ...] = ("file", "batch_offset", "label")) -> DataFrame:
    """Display clusters of more than ``least`` hits, with their tot-weighted centre in display pixels."""
    tot = F.col("tot").cast("long")
    sums = labelled.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(F.col("x") * tot).alias("sx"), F.sum(F.col("y") * tot).alias("sy"), F.sum(tot).alias("st")
    )
    fx = F.try_divide(F.col("sx") * F.lit(scale), F.col("st"))
    fy = F.try_divide(F.col("sy") * F.lit(scale), F.col("st"))
    return sums.where(F.col("n") > least).select(*keys, fx.alias("x"), fy.alias("y"), "n")
