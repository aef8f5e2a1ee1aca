"""Clock states found split by split."""

import random
import re

import pytest
from pyspark.sql import functions as F
from test_hits import packets

from tofloom.functions import packets as P
from tofloom.functions import timing as T
from tofloom.operators.gdc import gdc_records


def words(seed, n=300):
    """Pulses, halves of the global clock that come alone, zeros and hits."""
    rng = random.Random(seed)
    kinds = {
        "tdc": lambda: 0x6F << 56 | rng.choice([0, 0x10000000, 0xF0000000, rng.getrandbits(32)]) << 12,
        "low": lambda: 0x44 << 56 | rng.choice([0, rng.getrandbits(32)]) << 16,
        "high": lambda: 0x45 << 56 | rng.choice([0, rng.getrandbits(16)]) << 16,
        "hit": lambda: 0xB << 60 | rng.getrandbits(60),
    }
    return [(0, kinds[rng.choice(list(kinds))]()) for _ in range(n)]


def loop_states(rows):
    lsb = gdc = by_gdc = by_tdc = prev = roll = 0
    for _, w in rows:
        if w >> 56 == 0x6F:
            t = w >> 12 & 0xFFFFFFFF
            roll, prev = roll + (prev - t > 0x80000000), t
            by_gdc = ((gdc >> 32) + (t < gdc & 0xFFFFFFFF) & 0xFFFF) << 32 | t
            by_tdc = (roll & 0xFFFF) << 32 | t
        elif w >> 56 == 0x44:
            lsb = w >> 16 & 0xFFFFFFFF
        elif w >> 56 == 0x45:
            gdc = (w >> 16 & 0xFFFF) << 32 | lsb or gdc
        yield lsb, gdc, by_gdc, by_tdc


@pytest.mark.parametrize("split", [1, 4, 10**9])
def test_states_against_loop(spark, split):
    rows = words(split % 97)
    want = list(loop_states(rows))
    df = packets(spark, rows, split)
    got = {r.batch_offset: tuple(r)[1:] for r in T.timing_states(df).select("batch_offset", *T.STATES).collect()}
    assert got == {k: want[k] for k, (_, w) in enumerate(rows) if w >> 60 != 0xB}
    starts = T.batch_starts(df, "tdc").orderBy("batch_offset").collect()
    before = [(0, 0, 0, 0), *want][: len(rows)]
    assert [(r.lsb0, r.gdc0, r.tdc0, r.num_packets) for r in starts] == [(a, b, d, 1) for a, b, _, d in before]
    timed = T.with_time(df, "gdc").orderBy("batch_offset").collect()
    assert [(r.gdc, r.tdc) for r in timed] == [(b, c) for _, b, c, _ in want]


def by_file(df):
    """Orders of the plan's windows that a whole file is one partition of."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [o for o in re.findall(r"Window .*\], \[file#\d+\], \[(\w+)#", plan)]


def test_files_order_splits_only(spark):
    df = packets(spark, words(5), 7)
    for rows in (T.timing_states(df), T.with_time(df, "gdc").where(P.is_pixel(F.col("word"))), T.batch_starts(df)):
        assert set(by_file(rows)) == {"split"}


def test_gdc_records_by_split(spark):
    header = lambda chip: int.from_bytes(P.pack_header(chip, 1), "little")
    rows = [(0, header(k % 3)) if k % 11 == 5 else row for k, row in enumerate(words(8))]
    whole, cut = (gdc_records(packets(spark, rows, split)) for split in (10**9, 3))
    chip, lsb, value, want = -1, 0, 0, []
    for k, (_, w) in enumerate(rows):
        if w & 0xFFFFFFFF == P.HEADER_FULL:
            chip = w >> 32 & 0xFF
        elif w >> 56 == 0x44:
            lsb = w >> 16 & 0xFFFFFFFF
        elif w >> 56 == 0x45:
            value = (w >> 16 & 0xFFFF) << 32 | lsb or value
            want += [("f", chip, value, 8 * k, value * 25)] if value and chip >= 0 else []
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, whole.collect())) == sorted(want)
    assert set(by_file(cut)) == {"split"}
