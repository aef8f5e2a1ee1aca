"""Pixel packets to hits, by timing mode, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import LAST_TOF_TICK, PULSE_TICKS, SPIDER_RANGE
from . import packets as P
from .timing import ORDER, with_rollover, with_time

U32 = 1 << 32


def extended_ticks(st: Column, gdc: Column) -> Column:
    """30-bit hit time extended by the global clock."""
    low = P.bits(gdc, 0, 0x3FFFFFFF)
    msb = P.bits(gdc, 30, 0x3FFFF) + (st < low).cast("long")
    sp = F.shiftleft(msb, 30).bitwiseAND(F.lit(0xFFFFC0000000)).bitwiseOR(st)
    ahead = sp - gdc  # negative stands for a huge unsigned number
    return F.when((ahead < 0) | (ahead >= 40_000_000), sp - SPIDER_RANGE).otherwise(sp)


def fold_tof(ticks: Column) -> Column:
    """Subtract whole pulses until the time of flight is at most 16.67 ms (closed form)."""
    over = ticks - LAST_TOF_TICK
    pulses = F.floor((over + (PULSE_TICKS - 1)) / F.lit(PULSE_TICKS)).cast("long")
    return F.when(over <= 0, ticks).otherwise(ticks - PULSE_TICKS * pulses)


def u32(value: Column) -> Column:
    return F.pmod(value, F.lit(U32))


def gdc_time(st: Column, tdc: Column, gdc: Column) -> tuple[Column, Column]:
    """spidertime and tof by the global clock."""
    sp = extended_ticks(st, gdc)
    return sp, fold_tof(u32(sp - tdc))


def tdc_time(st: Column, tdc: Column) -> tuple[Column, Column]:
    """spidertime and tof by the pulse alone; tof is null where the hit precedes the pulse's full time."""
    ts = F.when(tdc > st + 0x400000, st.bitwiseOR(F.lit(SPIDER_RANGE).cast("long"))).otherwise(st)
    return ts, F.when(ts >= tdc, u32(ts - tdc))


def legacy_gdc_time(st: Column, tdc: Column, gdc: Column) -> tuple[Column, Column]:
    """Like :func:`gdc_time` without correction or fold; early hits get a second pulse length of 16.67 ms."""
    low = P.bits(gdc, 0, 0x3FFFFFFF)
    msb = P.bits(gdc, 30, 0x3FFFF) + (st < low).cast("long")
    sp = F.shiftleft(msb, 30).bitwiseAND(F.lit(0xFFFFC0000000)).bitwiseOR(st)
    return sp, u32(F.when(sp < tdc, sp - tdc + 16666667).otherwise(sp - tdc))


def display_time(st: Column, tdc: Column) -> tuple[Column, Column]:
    return st, u32(st - P.bits(tdc, 0, 0x3FFFFFFF))


MODES = ("gdc", "tdc", "legacy_gdc", "rollover", "display")


def clock_of(mode: str) -> str:
    """The timing that a mode's pulse clock is extended by."""
    return "tdc" if mode in ("tdc", "display") else "gdc"


def decode_hits(packets: DataFrame, mode: str = "tdc", order: tuple[str, ...] = ORDER, timed: bool = False) -> DataFrame:
    """Hits of a packet table, with the packet's other columns.

    Where ``timed`` is set, packets have their ``tdc``, ``gdc`` and ``rollovers`` already.
    Modes: ``gdc`` and ``tdc`` (hits before the first timing packets go),
    ``legacy_gdc``, ``rollover`` (no timing packets needed), ``display``.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    word = F.col("word")
    st = P.spider_ticks(word)
    if mode == "rollover":
        rows = packets.where(P.is_pixel(word)).withColumn("__st", st)
        rows = rows if timed else with_rollover(rows, "__st", order=order)
        sp = F.col("__st") + F.col("rollovers") * SPIDER_RANGE
        times = sp, sp % PULSE_TICKS
    else:
        rows = packets if timed else with_time(packets, clock_of(mode), order)
        rows = rows.where(P.is_pixel(word))
        known = F.col("tdc") != 0
        if mode in ("gdc", "legacy_gdc"):
            known = known & (F.col("gdc") != 0)
        rows = rows.where(known)
        times = {
            "gdc": lambda: gdc_time(st, F.col("tdc"), F.col("gdc")),
            "legacy_gdc": lambda: legacy_gdc_time(st, F.col("tdc"), F.col("gdc")),
            "tdc": lambda: tdc_time(st, F.col("tdc")),
            "display": lambda: display_time(st, F.col("tdc")),
        }[mode]()
    x, y = P.place(F.col("chip"), *P.raw_xy(word), "display" if mode == "display" else "gapped")
    return rows.withColumns(
        {
            "x": x, "y": y, "tot": P.tot(word), "toa": P.toa(word), "ftoa": P.ftoa(word),
            "tof": times[1].cast("long"), "spidertime": times[0].cast("long"),
        }
    ).drop("word", "tdc", "gdc", "__st", "rollovers")


def hits_ns(hits: DataFrame) -> DataFrame:
    """The seven columns of a hit file, in nanoseconds."""
    d = {c: F.col(c).cast("double") for c in ("x", "y", "tot", "toa", "ftoa", "tof", "spidertime")}
    return hits.select(
        d["x"].alias("x"), d["y"].alias("y"), (d["tot"] * 25.0).alias("tot_ns"), (d["toa"] * 25.0).alias("toa_ns"),
        (d["ftoa"] * 25.0 / 16.0).alias("ftoa_ns"), (d["tof"] * 25.0).alias("tof_ns"), (d["spidertime"] * 25.0).alias("spidertime_ns"),
    )


def position_tof(rows: DataFrame) -> DataFrame:
    """Adds ``tof_ns`` to hits or neutrons: what imaging needs beside x and y."""
    return rows.withColumn("tof_ns", F.col("tof") * 25.0)


def fine_time_ns(word: Column) -> Column:
    """Hit time by the sensor's fine counter."""
    coarse = F.shiftleft(P.bits(word, 30, 0x3FFF), 4).bitwiseOR(F.bitwise_not(P.bits(word, 16, 0xF)).bitwiseAND(F.lit(0xF).cast("long")))
    return P.spidr(word) * (25.0 * 16384) + coarse * 25.0 / 16.0


def tdc_fine(word: Column) -> tuple[Column, Column, Column]:
    """Trigger counter, coarse time and fine time of a pulse packet."""
    return P.bits(word, 44, 0xFFF), P.bits(word, 12, 0xFFFFFFFF), P.bits(word, 5, 0xF)


def scale(value: Column, factor: float) -> Column:
    """Super-resolution coordinate: rounded half away from zero."""
    return F.round(value * F.lit(factor)).cast("int")


def rotate(x: Column, y: Column, degrees: float = -1.0) -> tuple[Column, Column]:
    c, s = F.cos(F.radians(F.lit(degrees))), F.sin(F.radians(F.lit(degrees)))
    return x * c - y * s, x * s + y * c


def hit_text() -> Column:
    return F.format_string("Hit: x=%d, y=%d, tot=%d, toa=%d, ftoa=%d, tof=%d, spidertime=%d", "x", "y", "tot", "toa", "ftoa", "tof", "spidertime")


def neutron_text() -> Column:
    return F.format_string("Neutron: x=%f, y=%f, tof=%f, tot=%f, nHits=%d", "x", "y", "tof", "tot", "n_hits")
