"""Counts and data-quality checks over packets and hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import packets as P

LIMIT_MS = 16.67


def packet_counts(words: DataFrame) -> DataFrame:
    """Per file: headers, TDC, GDC and pixel packets, and bytes."""
    w = F.col("word")
    return words.groupBy("file").agg(
        F.count_if(P.is_header(w)).alias("headers"),
        F.count_if(P.is_tdc(w)).alias("tdcs"),
        F.count_if(P.is_gdc(w)).alias("gdcs"),
        F.count_if(P.is_pixel(w)).alias("hits"),
        (F.count("*") * 8).alias("bytes"),
    )


def bad_tof(hits: DataFrame, limit_ms: float = LIMIT_MS) -> DataFrame:
    """Hits in all and those later than the limit."""
    ms = F.col("tof") * 25.0 * 1e-6
    return hits.agg(F.count("*").alias("total"), F.count_if(ms > limit_ms).alias("bad"))


def bad_tof_by_rate(hits: DataFrame, rates: tuple[int, ...] = (1, 10, 15, 30, 45, 60)) -> DataFrame:
    """Per pulse rate (Hz): hits later than one pulse length, in equal units."""
    ms = F.col("tof") * 25.0 * 1e-6
    counts = hits.agg(*(F.count_if(ms > 1000.0 / r).alias(f"r{r}") for r in rates))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(r).alias("rate_hz"), F.col(f"r{r}").alias("bad")) for r in rates))).alias("x")).select("x.*")


def totals(hits: DataFrame) -> DataFrame:
    """Hits, batches and the largest spidertime."""
    return hits.agg(
        F.count("*").alias("hits"), F.count_distinct("file", "batch_offset").alias("batches"), F.max("spidertime").alias("max_spidertime")
    )
