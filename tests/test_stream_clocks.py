"""Clocks of a growing file go on from micro-batch to micro-batch."""

import pytest
from test_imaging_io import capture

from tofloom.functions import packets as P
from tofloom.functions.hits import decode_hits
from tofloom.sources import tpx3
from tofloom.streaming import live

COLUMNS = ["offset", "x", "y", "tot", "tof", "spidertime"]


@pytest.mark.parametrize("timing", ["tdc", "gdc", "rollover"])
def test_two_micro_batches_are_one_read(spark, tmp_path, monkeypatch, timing):
    folder = tmp_path / "in"
    folder.mkdir()
    data = capture(8, batches=19, long=True)
    cut = len(capture(8, batches=13, long=True))  # no clock packet follows
    # the pulse clock and the pixels' clock roll over before the cut
    late = (1 << 30) - 5
    first = P.pack_header(0, 3) + P.pack_gdc(0xFFFFFFF0) + P.pack_tdc(0xFFFFFFF0) + P.pack_pixel(9, late & 0x3FFF, 5, 0, late >> 14)
    seen = []
    decode = live.decode_hits

    def spy(*args, **options):
        hits = decode(*args, **options)
        seen.extend(map(tuple, hits.select(*COLUMNS).collect()))
        return hits

    monkeypatch.setattr(live, "decode_hits", spy)
    for size in (cut, len(data)):
        (folder / "s.tpx3").write_bytes(first + data[:size])
        query = live.cluster_stream(live.packet_stream(spark, str(folder)), str(tmp_path / "out"), str(tmp_path / "ck"), timing, fitting="centroid")
        query.awaitTermination()
        parts = len(list((tmp_path / "out").glob("batch=*")))
    assert parts > 1
    want = decode_hits(tpx3.packets(spark, str(folder)), timing).select(*COLUMNS).collect()
    assert sorted(seen, key=str) == sorted(map(tuple, want), key=str) and len(want) > 100
