"""Detector time from interleaved timing packets.

Packets carry a 30-bit clock; the pulse (TDC) and global (GDC) clocks arrive in
packets of their own.  Each split of a file finds what its own packets say of
the state after them; only a row per split is then put in a file's order, and
each split takes on the state that the splits before it leave.  No task sees
more packets than one split's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from . import packets as P

ORDER = ("batch_offset", "seq")
STATES = ("lsb", "gdc", "tdc_by_gdc", "tdc_by_tdc")


def _running(w: WindowSpec, value: Column) -> Column:
    return F.last(value, ignorenulls=True).over(w)


def of_split(order: tuple[str, ...]) -> WindowSpec:
    """The packets of a split up to the current one."""
    return Window.partitionBy("file", "split").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def gdc_inside(rows: DataFrame, clock: Column, so_far: WindowSpec) -> DataFrame:
    """Adds ``__low`` and ``__gdc``: what the split says so far of the low bits and the global clock.

    ``__gdc.known`` is the last value whose low bits are the split's own.  High
    bits before those complete the low bits of an earlier split: ``any`` are the
    last of them, ``some`` the last that aren't 0.
    """
    word = F.col("word")
    low = F.when(clock & (P.gdc_kind(word) == 4), P.gdc_lsb32(word))
    rows = rows.withColumn("__low", _running(so_far, low))
    high = F.when(clock & (P.gdc_kind(word) == 5), P.gdc_msb16(word))
    known = F.nullif(F.shiftleft(high, 32).bitwiseOR(F.col("__low")), F.lit(0).cast("long"))
    early = F.when(F.col("__low").isNull(), high)
    parts = {"known": known, "any": early, "some": F.nullif(early, F.lit(0).cast("long"))}
    return rows.withColumn("__gdc", F.struct(*(_running(so_far, v).alias(k) for k, v in parts.items())))


def gdc_after(gdc: Column, lsb: Column) -> Column:
    """The value of ``__gdc``, given the low bits before the split; null if the split has none."""
    early = F.when(lsb != 0, F.shiftleft(gdc["any"], 32).bitwiseOR(lsb)).otherwise(F.shiftleft(gdc["some"], 32))
    return F.coalesce(gdc["known"], early)


def _tdc_by_gdc(t: Column, gdc: Column) -> Column:
    gdc_low, gdc_high = P.bits(gdc, 0, 0xFFFFFFFF), P.bits(gdc, 32, 0xFFFF)
    high = (gdc_high + (t < gdc_low).cast("long")).bitwiseAND(F.lit(0xFFFF).cast("long"))
    return F.shiftleft(high, 32).bitwiseOR(t)


def _tdc_by_tdc(t: Column, roll: Column) -> Column:
    return F.shiftleft(P.bits(roll, 0, 0xFFFF), 32).bitwiseOR(t)


def _dropped(before: Column, t: Column) -> Column:
    """1 where the low bits fall by more than half their range, else 0."""
    return F.coalesce(((before - t) > 0x80000000).cast("long"), F.lit(0).cast("long"))


def _inside(packets: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Adds ``__own``: what the split's packets say of the state after each.

    ``low`` and ``gdc`` are as in :func:`gdc_inside`; ``tdc`` is of the last
    pulse: its low bits ``t``, the ``gdc`` then, the drops of low bits inside the
    split ``roll``, and the split's ``first`` low bits.
    """
    so_far, word = of_split(order), F.col("word")
    rows = gdc_inside(packets, P.is_gdc(word), so_far).withColumn("__t", F.when(P.is_tdc(word), P.tdc32(word)))
    before = Window.partitionBy("file", "split").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__prev", _running(before, F.col("__t")))
    rows = rows.withColumn("__roll", F.sum(_dropped(F.col("__prev"), F.col("__t"))).over(so_far))
    rows = rows.withColumn("__first", F.first("__t", ignorenulls=True).over(so_far))
    pulse = F.struct(F.col("__t").alias("t"), F.col("__gdc").alias("gdc"), F.col("__roll").alias("roll"), F.col("__first").alias("first"))
    rows = rows.withColumn("__tdc", _running(so_far, F.when(F.col("__t").isNotNull(), pulse)))
    own = F.struct(F.col("__low").alias("low"), F.col("__gdc").alias("gdc"), F.col("__tdc").alias("tdc"))
    return rows.withColumn("__own", own).drop("__low", "__gdc", "__t", "__prev", "__roll", "__first", "__tdc")


def _after(own: Column, start: Column) -> Column:
    """:data:`STATES` from ``__own`` and the split's start."""
    pulse = own["tdc"]
    gdc = F.coalesce(gdc_after(pulse["gdc"], start["lsb"]), start["gdc"])
    by_gdc = F.coalesce(_tdc_by_gdc(pulse["t"], gdc), start["tdc_by_gdc"])
    by_tdc = F.coalesce(_tdc_by_tdc(pulse["t"], start["roll"] + pulse["roll"]), start["tdc_by_tdc"])
    values = F.coalesce(own["low"], start["lsb"]), F.coalesce(gdc_after(own["gdc"], start["lsb"]), start["gdc"]), by_gdc, by_tdc
    return F.struct(*(v.alias(c) for v, c in zip(values, STATES)))


def last_of_split(rows: DataFrame, value: Column, order: tuple[str, ...]) -> DataFrame:
    """``value`` of each split's last row, as ``__end``."""
    more = F.lead(F.lit(True)).over(Window.partitionBy("file", "split").orderBy(*order))
    return rows.withColumn("__more", more).where("__more IS NULL").select("file", "split", value.alias("__end"))


def splits_before() -> WindowSpec:
    """Over a row per split."""
    return Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)


def carried(value: Column) -> Column:
    """The last value of the splits before, or 0."""
    return F.coalesce(_running(splits_before(), value), F.lit(0).cast("long"))


def split_starts(packets: DataFrame, order: tuple[str, ...] = ORDER) -> DataFrame:
    """``file, split, start``: the state before each split's first packet, and the drops of the pulse's low bits until its own first pulse."""
    word = F.col("word")
    ends = last_of_split(_inside(packets.where(P.is_tdc(word) | P.is_gdc(word)), order), F.col("__own"), order)
    every = packets.select("file", "split").distinct().join(ends, ["file", "split"], "left")
    own, pulse = F.col("__end"), F.col("__end.tdc")
    every = every.withColumn("lsb", carried(own["low"])).withColumn("__t", carried(pulse["t"]))
    every = every.withColumn("__gdc", gdc_after(own["gdc"], F.col("lsb"))).withColumn("gdc", carried(F.col("__gdc")))
    before = splits_before()
    upto = before.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = every.withColumn("__drop", _dropped(F.col("__t"), pulse["first"]))
    rolls = F.coalesce(F.sum(pulse["roll"]).over(before), F.lit(0).cast("long"))
    every = every.withColumn("roll", F.sum("__drop").over(upto) + rolls)
    by_gdc = _tdc_by_gdc(pulse["t"], F.coalesce(gdc_after(pulse["gdc"], F.col("lsb")), F.col("gdc")))
    by_tdc = _tdc_by_tdc(pulse["t"], F.col("roll") + pulse["roll"])
    every = every.withColumns({"tdc_by_gdc": carried(by_gdc), "tdc_by_tdc": carried(by_tdc)})
    return every.select("file", "split", F.struct(*STATES, "roll").alias("start"))


def timing_states(packets: DataFrame, order: tuple[str, ...] = ORDER) -> DataFrame:
    """State after each timing packet: ``lsb, gdc, tdc_by_gdc, tdc_by_tdc`` (0 before the first)."""
    word = F.col("word")
    timing = packets.where(P.is_tdc(word) | P.is_gdc(word))
    rows = _inside(timing, order).join(split_starts(timing, order), ["file", "split"])
    return rows.select("file", "split", *order, "word", _after(F.col("__own"), F.col("start")).alias("__state")).select(
        "file", "split", *order, "word", "__state.*"
    )


def with_time(packets: DataFrame, timing: str, order: tuple[str, ...] = ORDER) -> DataFrame:
    """All packets with the state after them: ``tdc`` and ``gdc`` (0 if there is none yet).

    ``timing`` is ``gdc`` or ``tdc``.  Columns other than the packet's go along.
    """
    rows = _inside(packets, order).join(split_starts(packets, order), ["file", "split"])
    state = _after(F.col("__own"), F.col("start"))
    return rows.withColumns({"tdc": state["tdc_by_gdc" if timing == "gdc" else "tdc_by_tdc"], "gdc": state["gdc"]}).drop("__own", "start")


def batch_starts(packets: DataFrame, timing: str = "gdc", order: tuple[str, ...] = ORDER) -> DataFrame:
    """State before each batch: ``file, batch_offset, chip, num_packets, lsb0, gdc0, tdc0``; batches are whole inside splits."""
    w = Window.partitionBy("file", "split").orderBy(*order)
    batch = Window.partitionBy("file", "split", "batch_offset")
    rows = _inside(packets, order).withColumn("__before", F.lag("__own").over(w))
    rows = rows.withColumns({"num_packets": F.count("*").over(batch).cast("int"), "__last": F.lag("batch_offset").over(w)})
    rows = rows.where(~F.col("__last").eqNullSafe(F.col("batch_offset"))).join(split_starts(packets, order), ["file", "split"])
    state = _after(F.col("__before"), F.col("start"))
    tdc = "tdc_by_gdc" if timing == "gdc" else "tdc_by_tdc"
    return rows.select("file", "batch_offset", "chip", "num_packets", *(state[c].alias(n) for c, n in (("lsb", "lsb0"), ("gdc", "gdc0"), (tdc, "tdc0"))))


def rollover_counter(ticks: Column, w: WindowSpec) -> Column:
    """Times the 30-bit clock has rolled over, in hit order, never below zero.

    Steps of a half range or more count up or down; clamping at zero equals
    taking off the lowest running sum.  Use :func:`with_rollover`.
    """
    prev = F.coalesce(F.lag(ticks).over(w), F.lit(0))
    half = (1 << 30) // 2
    return F.when((ticks < prev) & (prev - ticks > half), 1).when((ticks >= prev) & (ticks - prev > half), -1).otherwise(0)


def with_rollover(rows: DataFrame, ticks: str, partition: tuple[str, ...] = ("file",), order: tuple[str, ...] = ORDER) -> DataFrame:
    """Adds ``rollovers``."""
    w = Window.partitionBy(*partition).orderBy(*order)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("__d", rollover_counter(F.col(ticks), w)).withColumn("__s", F.sum("__d").over(so_far))
    low = F.least(F.lit(0), F.min("__s").over(so_far))
    return rows.withColumn("rollovers", (F.col("__s") - low).cast("long")).drop("__d", "__s")
