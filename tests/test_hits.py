"""Golden values of decoding, clocks and time of flight, and loops as oracles."""

import random

import pytest
from pyspark.sql import functions as F

from tofloom.functions import hits as H
from tofloom.functions import packets as P
from tofloom.functions import timing as T

WORD = int.from_bytes(bytes(range(1, 9)), "little")
PACKET_DDL = "file string, split int, batch_offset long, chip int, seq int, offset long, word long"


def signed(word):
    return word - (1 << 64) if word >= 1 << 63 else word


def packets(spark, rows, split=10**9):
    """(chip, word) rows, one batch each."""
    data = [("f", k // split, k, chip, 0, 8 * k, signed(word)) for k, (chip, word) in enumerate(rows)]
    return spark.createDataFrame(data, PACKET_DDL)


def test_golden_packet(spark):
    row = spark.createDataFrame([(WORD, 8411155, 2000)], "word long, tdc long, gdc long")
    x, y = P.place(F.lit(0), *P.raw_xy(F.col("word")))
    sp, tof = H.gdc_time(P.spider_ticks(F.col("word")), F.col("tdc"), F.col("gdc"))
    got = row.select(x, y, sp, tof, sp * 25, tof * 25).first()
    assert tuple(got) == (388, 56, 8411156, 1, 210278900, 25)


def test_long_fold(spark):
    rows = spark.createDataFrame([(0, 1000 + j, 2000 + j) for j in range(5)], "word long, tdc long, gdc long")
    sp, tof = H.gdc_time(P.spider_ticks(F.col("word")), F.col("tdc"), F.col("gdc"))
    assert [tuple(r) for r in rows.select(sp, tof).collect()] == [(0, 297482 - j) for j in range(5)]


def test_fold_edges(spark):
    ticks = [0, 666667, 666800, 666801, 1333467, 1333468, 2**32 - 1]
    rows = spark.createDataFrame([(t,) for t in ticks], "t long")
    got = [r[0] for r in rows.select(H.fold_tof(F.col("t"))).collect()]

    def loop(t):
        while t * 25e-6 > 16.67:
            t -= 666667
        return t

    assert got == [loop(t) for t in ticks]


SPIDR = (
    "F000 FF00 FFFF 000F 00FF 0FFF 2FFF 000F 3FFF 00FF 0FFF 1FFF 2FFF 000F 00FF 0FFF 2FFF F000 FF00 FFFF 000F 00FF 0FFF 1FFF 2FFF 3FFF"
)


def test_rollover_golden(spark):
    spidr = [int(s, 16) for s in SPIDR.split()]
    rows = [(0, int.from_bytes(P.pack_pixel(0x9876, 0x3FFF, 0x3FF, 0xF, s), "little")) for s in spidr]
    got = H.decode_hits(packets(spark, rows), "rollover").orderBy("batch_offset").collect()
    zero = {0, 1, 2, 17, 18, 19}
    want = [s * 16384 + 0x3FFF + (0 if k in zero else 1 << 30) for k, s in enumerate(spidr)]
    assert [r.spidertime for r in got] == want
    assert [r.tof for r in got] == [w % 666667 for w in want]


def stream(seed, n=1500):
    rng = random.Random(seed)
    rows, now = [], rng.randrange(1 << 33)
    for _ in range(n):
        now += rng.randrange(1 << rng.choice((5, 20, 31)))
        kind = rng.random()
        chip = rng.randrange(5)
        if kind < 0.2:
            rows.append((chip, int.from_bytes(P.pack_tdc(now & 0xFFFFFFFF), "little")))
        elif kind < 0.3:
            low, high = P.pack_gdc(0 if rng.random() < 0.1 else now)[:8], P.pack_gdc(now if rng.random() < 0.9 else 0)[8:]
            rows += [(chip, int.from_bytes(low, "little")), (chip, int.from_bytes(high, "little"))][rng.randrange(2) :]
        elif kind < 0.35:
            rows.append((chip, rng.randrange(1 << 56)))
        else:
            address, st = rng.randrange(1 << 16), now & 0x3FFFFFFF
            word = P.pack_pixel(address, st & 0x3FFF, rng.randrange(1024), rng.randrange(16), st >> 14)
            rows.append((chip, int.from_bytes(word, "little")))
    return rows


def loop_hits(rows, mode):
    """The plain loop over words."""
    lsb = gdc = tdc = 0
    out = []
    for k, (chip, w) in enumerate(rows):
        top = w >> 56
        if top == 0x6F:
            t = w >> 12 & 0xFFFFFFFF
            if mode == "gdc":
                tdc = ((gdc >> 32 & 0xFFFF) + (t < gdc & 0xFFFFFFFF) & 0xFFFF) << 32 | t
            else:
                tdc = (tdc & 0xFFFF00000000) + (0x100000000 if (tdc & 0xFFFFFFFF) - t > 0x80000000 else 0) | t
        elif top & 0xF0 == 0x40:
            if top & 15 == 4:
                lsb = w >> 16 & 0xFFFFFFFF
            elif top & 15 == 5:
                gdc = (w >> 16 & 0xFFFF) << 32 | lsb or gdc
        elif top & 0xF0 == 0xB0 and tdc and (mode == "tdc" or gdc):
            st = (w & 0xFFFF) * 16384 + (w >> 30 & 0x3FFF)
            if mode == "gdc":
                msb = (gdc >> 30 & 0x3FFFF) + (st < gdc & 0x3FFFFFFF)
                sp = msb << 30 & 0xFFFFC0000000 | st
                if (sp - gdc) % (1 << 64) >= 40_000_000:
                    sp -= 1 << 30
                tof = (sp - tdc) % (1 << 32)
                while tof * 25e-6 > 16.67:
                    tof -= 666667
            else:
                sp = st | 0x40000000 if tdc > st + 0x400000 else st
                tof = sp - tdc if sp >= tdc else None
            out.append((k, sp, tof))
    return out


@pytest.mark.parametrize("mode", ["gdc", "tdc"])
@pytest.mark.parametrize("split", [10**9, 37])
def test_clock_against_loop(spark, mode, split):
    rows = stream(7)
    got = H.decode_hits(packets(spark, rows, split), mode).orderBy("batch_offset").select("batch_offset", "spidertime", "tof").collect()
    assert [tuple(r) for r in got] == loop_hits(rows, mode)


def test_rollover_of_exactly_half_is_none(spark):
    tdcs = [0x90000000, 0x10000000, 0x0FFFFFFF, 0xA0000000, 0x1FFFFFFF]
    rows = [(0, int.from_bytes(P.pack_tdc(t), "little")) for t in tdcs]
    got = [r.tdc_by_tdc for r in T.timing_states(packets(spark, rows)).orderBy("batch_offset").collect()]
    assert got == [0x90000000, 0x10000000, 0x0FFFFFFF, 0xA0000000, 0x11FFFFFFF]


@pytest.mark.parametrize("chip,want", [(0, (270, 20)), (1, (505, 495)), (2, (245, 495)), (3, (10, 20)), (-1, (10, 20))])
def test_layout(spark, chip, want):
    x, y = P.place(F.lit(chip), F.lit(10), F.lit(20))
    assert tuple(spark.range(1).select(x, y).first()) == want


def test_pack_round_trip(spark):
    rng = random.Random(3)
    fields = [(rng.randrange(1 << 16), rng.randrange(1 << 14), rng.randrange(1 << 10), rng.randrange(16), rng.randrange(1 << 16)) for _ in range(50)]
    df = spark.createDataFrame(fields, "a long, toa long, tot long, ftoa long, spidr long")
    word = P.pixel_word(*(F.col(c) for c in ("a", "toa", "tot", "ftoa", "spidr")))
    got = df.select(word, P.pixaddr(word), P.toa(word), P.tot(word), P.ftoa(word), P.spidr(word), P.packet_class(word)).collect()
    for r, f in zip(got, fields):
        assert r[0] == signed(int.from_bytes(P.pack_pixel(*f), "little"))
        assert tuple(r)[1:] == (*f, "pixel")


def test_ns_and_scale(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 8, 5, 6)], "x int, y int, tot int, toa int, ftoa int, tof long, spidertime long")
    assert tuple(H.hits_ns(df).first()) == (1.0, 2.0, 75.0, 100.0, 12.5, 125.0, 150.0)
    assert H.hit_text() is not None
    got = spark.createDataFrame([(2.5,), (-0.5,), (1.4,)], "v double").select(H.scale(F.col("v"), 1.0)).collect()
    assert [r[0] for r in got] == [3, -1, 1]
