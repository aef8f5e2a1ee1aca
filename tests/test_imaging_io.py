"""Binning, images, sources, sinks, configuration, streaming and the command line."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tofloom import cli, config
from tofloom.functions import packets as P
from tofloom.operators import checks, gdc
from tofloom.operators import imaging as I
from tofloom.plans import pipeline
from tofloom.sources import sinks, tpx3
from tofloom.streaming import live


def capture(seed=0, batches=200, long=False):
    """Bytes of a small run: clock packets, then batches of hits."""
    rng = random.Random(seed)
    out, now = b"", 1_000_000
    for k in range(batches):
        chip = rng.randrange(4)
        words = b""
        if k % 10 == 0:
            words += P.pack_gdc(now) + P.pack_tdc(now & 0xFFFFFFFF)
        for _ in range(rng.randrange(0, 40 if long else 6)):
            st = (now + rng.randrange(2000)) & 0x3FFFFFFF
            words += P.pack_pixel(rng.randrange(1 << 16), st & 0x3FFF, rng.randrange(1, 1024), rng.randrange(16), st >> 14)
        out += P.pack_header(chip, len(words) // 8) + words
        now += rng.randrange(10_000)
    return out


def loop_packets(data):
    words = [int.from_bytes(data[i : i + 8], "little") for i in range(0, len(data) // 8 * 8, 8)]
    out = []
    for h, w in enumerate(words):
        if w & 0xFFFFFF == 0x585054:
            n = w >> 51
            out += [(h * 8, seq, (h + 1 + seq) * 8) for seq in range(n) if h + 1 + seq < len(words)]
    return sorted(out)


@pytest.mark.parametrize("tail", [b"", b"\1\2\3", P.pack_header(1, 5) + P.pack_pixel(1, 2, 3, 4, 5), P.pack_header(0, 1) + P.pack_header(2, 3)])
@pytest.mark.parametrize("split", ["64", "4000", "67108864"])
def test_source_against_loop(spark, tmp_path, tail, split):
    data = capture(1) + tail
    (tmp_path / "a.tpx3").write_bytes(data)
    rows = tpx3.packets(spark, str(tmp_path / "a.tpx3"), splitSize=split).select("batch_offset", "seq", "offset").collect()
    assert sorted(map(tuple, rows)) == loop_packets(data)


def test_source_edges(spark, tmp_path):
    (tmp_path / "empty.tpx3").write_bytes(b"")
    assert tpx3.packets(spark, str(tmp_path / "empty.tpx3")).count() == 0
    with pytest.raises(Exception, match="no such file"):
        tpx3.packets(spark, str(tmp_path / "missing.tpx3")).count()
    (tmp_path / "b.tpx3").write_bytes((P.pack_header(0, 1) + bytes(8)) * 100)
    rows = tpx3.packets(spark, str(tmp_path / "b.tpx3"))
    assert rows.select("batch_offset").distinct().count() == 100
    assert rows.where(P.is_pixel(F.col("word"))).count() == 0
    nested = P.pack_header(0, 2) + P.pack_header(1, 1) + P.pack_pixel(1, 1, 1, 1, 1)
    (tmp_path / "c.tpx3").write_bytes(nested)
    assert tpx3.packets(spark, str(tmp_path / "c.tpx3")).count() == 3
    assert tpx3.packets(spark, str(tmp_path / "c.tpx3"), strict="true").count() == 2


def test_gdc_records(spark, tmp_path):
    value = 0x1234 << 32 | 1987
    data = b"".join(P.pack_header(c, 2) + P.pack_gdc(value) for c in (1, 2))
    (tmp_path / "g.tpx3").write_bytes(data)
    rows = gdc.gdc_records(tpx3.words(spark, str(tmp_path / "g.tpx3"))).orderBy("file_offset").collect()
    assert [(r.chip_id, r.gdc_value, r.timestamp_ns) for r in rows] == [(1, value, value * 25), (2, value, value * 25)]
    counts = checks.packet_counts(tpx3.words(spark, str(tmp_path / "g.tpx3"))).first()
    assert (counts.headers, counts.gdcs, counts.bytes) == (2, 4, 48)


def bins(spark, times, edges):
    df = spark.createDataFrame([(t,) for t in times], "t double")
    return [r[0] for r in df.select(I.tof_bin(F.col("t"), edges)).collect()]


def test_bin_edges(spark):
    edges = [0.0, 0.1, 0.2, 0.3]
    assert bins(spark, [0.0, 1e-12, 0.1, 0.15, 0.2, 0.3, 0.29, -1.0, None, float("nan")], edges) == [None, 0, 0, 1, 1, None, 2, None, None, None]
    custom = [0.001, 0.002, 0.005, 0.01]
    assert bins(spark, [0.001, 0.002, 0.0021, 0.01, 0.009], custom) == [None, 0, 1, None, 2]
    uniform = config.TofBinning(1500, 16.7e-3).edges()
    times = uniform + [e + d for e in uniform for d in (1e-9, -1e-9)]
    want = []
    for t in times:
        n = int(np.searchsorted(uniform, t, side="left")) - 1
        want.append(n if uniform[0] <= t < uniform[-1] and n >= 0 else None)
    assert bins(spark, times, uniform) == want
    for bad in ([0.1], [0.2, 0.1], []):
        with pytest.raises(ValueError):
            I.tof_bin(F.lit(0.0), bad)


def test_image_and_spectrum(spark, tmp_path):
    edges = [0.0, 0.1, 0.2, 0.3]
    ones = [(b, y, x, 1) for b in range(3) for y in range(10) for x in range(10)]
    image = spark.createDataFrame(ones, "bin int, y int, x int, count long")
    assert list(sinks.spectrum_lines(I.spectrum(image, edges))) == ["shutter_time,counts", "0.1,100", "0.2,100", "0.3,100"]
    rows = spark.createDataFrame([(516.0, 0.0, 1.0), (517.0, 0.0, 1.0), (-1.0, 3.0, 1.0), (1.4, 1.5, 1.0), (1.0, 1.0, None)], "x double, y double, tof double")
    cells = {(r.y, r.x): r["count"] for r in I.tof_image(rows, [0.0, 1.0]).collect()}
    assert cells == {(0, 516): 1, (2, 1): 1}
    assert tuple(I.binned_totals(rows, [0.0, 1.0]).first()) == (5, 2)


def test_tiff_accumulates(spark, tmp_path):
    image = spark.createDataFrame([(0, 1, 2, 3), (2, 0, 0, 7)], "bin int, y int, x int, count long")
    for _ in range(2):
        sinks.write_tiffs(image, str(tmp_path), "run", 3, 0.02)
    files = sorted(p.name for p in tmp_path.glob("*.tiff"))
    assert files == [f"run_bin_{k:04d}.tiff" for k in (1, 2, 3)]
    first = sinks.read_tiff(str(tmp_path / files[0]))
    assert first.shape == (10, 10) and first[1, 2] == 6 and first.sum() == 6
    back = {(r.bin, r.y, r.x): r["count"] for r in sinks.read_tiffs(spark, str(tmp_path), "run").collect()}
    assert back == {(0, 1, 2): 6, (2, 0, 0): 14}
    sinks.write_tiffs(image, str(tmp_path), "run", 3, 0.04)
    assert sinks.read_tiff(str(tmp_path / files[0])).sum() == 3  # another size replaces


def test_groups(spark, tmp_path):
    rows = spark.range(10).selectExpr(*(f"cast(id as int) {c}" for c in ("x", "y", "tot", "toa", "ftoa")), "id tof", "id spidertime")
    path = sinks.save_hits(rows, str(tmp_path / "h"))
    assert sinks.append_hits(rows.limit(5), path) == "hits_1"
    counts = {r.group: r["count"] for r in spark.read.parquet(path).groupBy("group").count().collect()}
    assert counts == {"hits": 10, "hits_1": 5}
    again = sinks.save_hits(rows, path)
    assert again != path and again.startswith(str(tmp_path / "h"))
    assert sinks.save_hits(rows.where("x < 0"), str(tmp_path / "none")) is None
    events = spark.range(4).selectExpr("cast(id as double) x", "cast(id as double) y", "1.0D tof", "2.0D tot", "1 n_hits")
    assert sinks.append_neutrons(events, sinks.save_neutrons(events, str(tmp_path / "n"))) == "neutrons_1"
    sinks.extend(events, str(tmp_path / "e"), "neutrons")
    sinks.extend(events, str(tmp_path / "e"), "neutrons")
    assert spark.read.parquet(str(tmp_path / "e")).count() == 8
    with pytest.raises(ValueError):
        sinks.save_events(events.limit(0), str(tmp_path / "v"))
    assert sinks.packed_events(events).count() == 4


def test_config(tmp_path):
    d = config.default_json()
    assert (d.abs_radius, d.abs_min_cluster_size, d.spider_time_range, d.super_resolution, len(d.binning.edges())) == (5.0, 1, 75, 1.0, 1501)
    c = config.from_dict({"abs": {"radius": 6}, "tof_imaging": {"uniform_bins": {"num_bins": 1000, "end": 0.0167}, "super_resolution": 2.0}})
    assert (c.abs_radius, len(c.binning.edges()), c.super_resolution) == (6.0, 1001, 2.0)
    c = config.from_dict({"tof_imaging": {"bin_edges": [0, 0.001, 0.002, 0.005, 0.01, 0.0167], "uniform_bins": {"num_bins": 3}}})
    assert len(c.binning.edges()) == 6
    assert len(config.from_dict({"tof_imaging": {"_bin_edges": [0, 1]}}).binning.edges()) == 1501
    text = tmp_path / "p.txt"
    text.write_text("# c\nabs_radius 20.0\n\nabs_min_cluster_size 30\nspider_time_range 500\ntof_bins 3\nother 1\n")
    with pytest.warns(UserWarning):
        c = config.load(str(text))
    assert (c.abs_radius, c.abs_min_cluster_size, c.spider_time_range, len(c.binning.edges())) == (20.0, 30, 500, 1501)
    assert c.binning.edges()[-1] == 1 / 60 and "radius=20" in str(c)
    for size in ((1 << 20) - 1, (20 << 30) + 1):
        with pytest.raises(ValueError):
            config.check_options(chunk_size=size)
    config.check_options(chunk_size=10 << 20)
    for bad in ({"mode": "x"}, {"timing": "x"}, {"interval": 0}, {"inputs": ("/no/such/file",)}):
        with pytest.raises(ValueError):
            config.check_options(**bad)


def test_reduce_by_command(spark, tmp_path):
    (tmp_path / "run.tpx3").write_bytes(capture(3, long=True))
    source = str(tmp_path / "run.tpx3")
    settings = tmp_path / "c.json"
    settings.write_text('{"tof_imaging": {"uniform_bins": {"num_bins": 5, "end": 0.0167}, "super_resolution": 0.1}}')
    out = {k: str(tmp_path / k) for k in ("hits", "events", "tiff", "spectra.txt", "gdc")}
    cli.main(["reduce", "-i", source, "-H", out["hits"], "-E", out["events"], "-T", out["tiff"], "-s", out["spectra.txt"], "-u", str(settings), "-t", "gdc"], spark)
    plan = pipeline.reduce(spark, source, config.load(str(settings)), timing="gdc")
    assert spark.read.parquet(out["hits"]).count() == plan.hits.count() > 1000
    assert spark.read.parquet(out["events"]).count() == plan.neutrons.count() > 100
    lines = (tmp_path / "spectra.txt").read_text().splitlines()
    assert len(lines) == 6 and sum(int(x.split(",")[1]) for x in lines[1:]) == plan.image.agg(F.sum("count")).first()[0]
    cli.main(["extract-gdc", "-i", source, "-o", out["gdc"]], spark)
    assert spark.read.csv(out["gdc"], header=True).columns == ["chip_id", "gdc_value", "file_offset", "timestamp_ns"]
    ordered = pipeline.Reduction(plan.hits, plan.config, in_order=False)
    assert ordered.neutrons.count() == plan.neutrons.count()


def test_watch_counts_each_file_once(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    small = config.from_dict({"tof_imaging": {"uniform_bins": {"num_bins": 3, "end": 0.0167}, "super_resolution": 0.1}})
    (folder / "a.tpx3").write_bytes(capture(5))
    assert live.reduce_new_files(spark, str(folder), str(out), config=small) == ["a"]
    assert live.reduce_new_files(spark, str(folder), str(out), config=small) == []
    (folder / "b.tpx3").write_bytes(capture(6))
    (folder / "end.nxs.h5").write_bytes(b"")
    assert live.watch(spark, str(folder), str(out), 1.0, sleep=lambda s: None, config=small) == ["b"]
    total = live.accumulated(spark, str(out)).agg(F.sum("count")).first()[0]
    parts = [pipeline.reduce(spark, str(folder / f), small, timing="gdc").image.agg(F.sum("count")).first()[0] for f in ("a.tpx3", "b.tpx3")]
    assert total == sum(parts)
    stack = sum(int(sinks.read_tiff(str(p)).sum()) for p in out.glob("*.tiff"))
    assert stack == total
    with pytest.raises(ValueError):
        live.watch(spark, str(folder), str(out), 0)


def test_streams(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    data = capture(8, long=True)
    (folder / "s.tpx3").write_bytes(data[: len(data) // 3])

    def run():
        live.cluster_stream(live.packet_stream(spark, str(folder)), str(tmp_path / "out"), str(tmp_path / "ck"), fitting="centroid").awaitTermination()

    run()
    first = spark.read.parquet(str(tmp_path / "out")).count()
    (folder / "s.tpx3").write_bytes(data)
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() > first > 0
    timed = live.timed_stream(live.packet_stream(spark, str(folder)), "gdc").writeStream.format("memory").queryName("timed")
    query = timed.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck2")).start()
    query.awaitTermination()
    from tofloom.functions.timing import with_time

    want = with_time(tpx3.packets(spark, str(folder)), "gdc").select("offset", "tdc", "gdc").collect()
    got = spark.sql("SELECT offset, tdc, gdc FROM timed").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_unprocessed(spark):
    files = spark.createDataFrame([("/d/a.tpx3",), ("/d/b.c.tpx3",)], "file string")
    done = spark.createDataFrame([("a",)], "stem string")
    assert [r.stem for r in tpx3.unprocessed(files, done).collect()] == ["b.c"]
