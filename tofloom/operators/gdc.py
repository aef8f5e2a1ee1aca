"""Extraction of global-clock records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import packets as P
from ..functions.timing import carried, gdc_after, gdc_inside, last_of_split, of_split


def gdc_records(words: DataFrame, order: str = "offset") -> DataFrame:
    """``chip_id, gdc_value, file_offset, timestamp_ns`` (and ``file``) of a table of all words.

    Every global-clock word counts, inside a batch or not.  Only headers and
    clock words are ordered, split by split; a record needs a chip and a value
    that isn't 0, and a zero value repeats the one before.
    """
    w, so_far = F.col("word"), of_split((order,))
    rows = words.where(P.is_full_header(w) | P.is_gdc(w))
    header = P.is_full_header(w)
    clock = ~header & P.is_gdc(w)
    rows = gdc_inside(rows, clock, so_far).withColumn("__chip", F.last(F.when(header, P.header_chip(w)), ignorenulls=True).over(so_far))
    ends = last_of_split(rows, F.struct(F.col("__chip").alias("chip"), F.col("__low").alias("low"), F.col("__gdc").alias("gdc")), (order,))
    end = F.col("__end")
    starts = ends.withColumns({"__lsb0": carried(end["low"]), "__chip0": carried(end["chip"] + 1).cast("int") - 1})
    starts = starts.withColumn("__value", gdc_after(end["gdc"], F.col("__lsb0"))).withColumn("__gdc0", carried(F.col("__value")))
    rows = rows.where(clock & (P.gdc_kind(w) == 5)).join(starts.select("file", "split", "__lsb0", "__chip0", "__gdc0"), ["file", "split"])
    rows = rows.withColumn("gdc_value", F.coalesce(gdc_after(F.col("__gdc"), F.col("__lsb0")), "__gdc0"))
    rows = rows.withColumn("chip_id", F.coalesce("__chip", "__chip0")).where((F.col("gdc_value") != 0) & (F.col("chip_id") >= 0))
    return rows.select(
        "file", "chip_id", "gdc_value", F.col(order).alias("file_offset"), (F.col("gdc_value") * 25).alias("timestamp_ns")
    )
