"""One neutron per cluster: weighted or plain centroid, or a fast Gaussian fit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

KEYS = ("file", "batch_offset", "label")
#: Fewest hits that a Gaussian can be fitted to.
LEAST = 8


def centroid(hits: DataFrame, weighted: bool = True, scale: float = 1.0, keys: tuple[str, ...] = KEYS, min_size: int = 1) -> DataFrame:
    """Hash aggregation per cluster; a cluster without any tot has no weighted centre and goes."""
    tot = F.col("tot").cast("long")
    if weighted:
        x = F.try_divide((F.sum(F.col("x").cast("long") * tot) * F.lit(float(scale))).cast("double"), F.sum(tot).cast("double"))
        y = F.try_divide((F.sum(F.col("y").cast("long") * tot) * F.lit(float(scale))).cast("double"), F.sum(tot).cast("double"))
    else:
        x, y = F.avg("x") * F.lit(float(scale)), F.avg("y") * F.lit(float(scale))
    fitted = hits.groupBy(*keys).agg(
        x.alias("x"), y.alias("y"), F.avg("tof").alias("tof"), F.sum(tot).cast("double").alias("tot"), F.count("*").cast("int").alias("n_hits")
    )
    return fitted.where((F.col("n_hits") >= min_size) & (F.col("x") >= 0) & (F.col("y") >= 0))


def above_median(hits: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Hits of large enough clusters with ``tot_median`` and ``t``, the part of tot above it; others go."""
    w = Window.partitionBy(*keys)
    rows = hits.withColumn("__n", F.count("*").over(w)).where(F.col("__n") >= LEAST)
    rows = rows.withColumn("tot_median", F.percentile("tot", F.lit(0.5)).over(w))
    return rows.withColumn("t", F.col("tot") - F.col("tot_median")).where("t > 0").drop("__n")


def gaussian_peak(x: np.ndarray, y: np.ndarray, tot: np.ndarray, tof: np.ndarray) -> tuple[float, float, float, float] | None:
    """x, y, tof and tot of a cluster, or None without a unique solution.

    With tot above its median as height, a Gaussian's logarithm is linear in
    ``x, y, ln t`` and a constant for ``x^2 + y^2``.
    """
    if len(x) < LEAST:
        return None
    t = tot - np.median(tot)
    keep = t > 0
    if keep.sum() < 4:
        return None
    x, y, t, tof = x[keep], y[keep], t[keep], tof[keep]
    ox, oy = x.mean(), y.mean()  # fitted around the middle: far from the origin the columns are nearly dependent
    dx, dy = x - ox, y - oy
    a = np.column_stack([dx, dy, np.log(t), np.ones(len(x))])
    solution, _, rank, _ = np.linalg.lstsq(a, dx * dx + dy * dy, rcond=None)
    if rank < 4:
        return None
    known = tof[~np.isnan(tof)]
    return solution[0] / 2 + ox, solution[1] / 2 + oy, float(known.mean()) if len(known) else float("nan"), float(t.sum())


def fast_gaussian(hits: DataFrame, keys: tuple[str, ...] = KEYS, scale: float = 1.0, min_size: int = 1) -> DataFrame:
    """A fit per cluster of eight hits or more, in partitions sorted by cluster."""
    least = max(LEAST, min_size)
    w = Window.partitionBy(*keys)
    rows = hits.withColumn("__n", F.count("*").over(w)).where(F.col("__n") >= least)
    rows = rows.select(*keys, F.col("x").cast("double"), F.col("y").cast("double"), F.col("tot").cast("double"), F.col("tof").cast("double"))
    rows = rows.repartition(*keys).sortWithinPartitions(*keys)
    schema = StructType([hits.schema[k] for k in keys])
    for name in ("x", "y", "tof", "tot"):
        schema = schema.add(name, DoubleType())
    schema = schema.add("n_hits", IntegerType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []

        def fit(table: pa.Table, key: np.ndarray) -> Iterator[pa.RecordBatch]:
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            ends = np.concatenate([starts[1:], [len(key)]])
            x, y, tot, tof = (table[c].to_numpy() for c in ("x", "y", "tot", "tof"))
            fits = [gaussian_peak(x[a:b] * scale, y[a:b] * scale, tot[a:b], tof[a:b]) for a, b in zip(starts, ends)]
            good = [k for k, f in enumerate(fits) if f is not None and f[0] >= 0 and f[1] >= 0]
            if good:
                rows = table.select(list(keys)).take(pa.array(starts[good]))
                values = list(zip(*(fits[k] for k in good)))
                for name, v in zip(("x", "y", "tof", "tot"), values):
                    rows = rows.append_column(name, pa.array(v, pa.float64()))
                rows = rows.append_column("n_hits", pa.array((ends - starts)[good], pa.int32()))
                yield from rows.combine_chunks().to_batches()

        from .cluster import _runs

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*rest, batch]).combine_chunks()
            key = _runs([table[k].combine_chunks() for k in keys])
            cut = int(np.searchsorted(key, key[-1]))
            rest = table.slice(cut).combine_chunks().to_batches()
            if cut:
                yield from fit(table.slice(0, cut), key[:cut])
        if rest:
            table = pa.Table.from_batches(rest)
            yield from fit(table, _runs([table[k].combine_chunks() for k in keys]))

    return rows.mapInArrow(run, schema)


FITTERS = {"centroid": centroid, "fast_gaussian": fast_gaussian}


def fit(hits: DataFrame, method: str = "centroid", **options) -> DataFrame:
    if method not in FITTERS:
        raise ValueError(f"unknown fitting method {method}")
    return FITTERS[method](hits, **options)


def neutrons_ns(neutrons: DataFrame) -> DataFrame:
    """The five columns of a neutron file, in nanoseconds."""
    return neutrons.select(
        "x", "y", (F.col("tof") * 25.0).alias("tof_ns"), (F.col("tot") * 25.0).alias("tot_ns"), F.col("n_hits").cast("double").alias("nHits")
    )
