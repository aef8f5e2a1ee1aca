"""Live acquisition: growing files, watched folders and carried timing state."""

from __future__ import annotations

import os
import time
from collections.abc import Callable
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..config import ReduceConfig, default_json
from ..functions.hits import clock_of, decode_hits
from ..operators import cluster as C
from ..operators import fit as Fit
from ..operators import imaging as I
from ..plans.pipeline import reduce
from ..schemas import PACKET
from ..sources import sinks, tpx3

STOP_PATTERN = "*.nxs.h5"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def packet_stream(spark: SparkSession, path: str) -> DataFrame:
    tpx3.register(spark)
    return spark.readStream.format("tpx3").load(path)


class TimingState(StatefulProcessor):
    """Carries the clock state of a file from one micro-batch to the next.

    Emits every packet with ``tdc``, ``gdc`` and, for pixels, ``rollovers`` of
    the 30-bit clock; ``timing`` as in the batch plan.
    """

    def __init__(self, timing: str):
        self.timing = timing

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("clock", "lsb long, gdc long, tdc long, ticks long, rollovers long")

    def handleInputRows(self, key, rows, timerValues):
        parts = [pdf for pdf in rows if len(pdf)]
        if not parts:
            return
        pdf = pd.concat(parts).sort_values(["batch_offset", "seq"], kind="stable")
        lsb, gdc, tdc, ticks, rolled = self.state.get() if self.state.exists() else (0, 0, 0, 0, 0)
        tdcs, gdcs, rollovers = [], [], []
        half = (1 << 30) // 2
        for word in pdf["word"].tolist():
            top = word >> 56 & 0xFF
            if top == 0x6F:
                new = word >> 12 & 0xFFFFFFFF
                if self.timing == "gdc":
                    tdc = ((gdc >> 32 & 0xFFFF) + (new < gdc & 0xFFFFFFFF) & 0xFFFF) << 32 | new
                else:
                    tdc = (tdc & 0xFFFF00000000) + ((tdc & 0xFFFFFFFF) - new > 0x80000000) * 0x100000000 | new
            elif top & 0xF0 == 0x40:
                if top & 15 == 4:
                    lsb = word >> 16 & 0xFFFFFFFF
                elif top & 15 == 5:
                    gdc = (word >> 16 & 0xFFFF) << 32 | lsb or gdc
            elif top & 0xF0 == 0xB0:
                now = (word & 0xFFFF) << 14 | word >> 30 & 0x3FFF
                rolled = max(0, rolled + (ticks - now > half) - (now - ticks > half))
                ticks = now
            tdcs.append(tdc)
            gdcs.append(gdc)
            rollovers.append(rolled)
        self.state.update((lsb, gdc, tdc, ticks, rolled))
        yield pdf.assign(tdc=tdcs, gdc=gdcs, rollovers=rollovers)

    def close(self) -> None:
        pass


def timed_stream(packets: DataFrame, timing: str = "tdc") -> DataFrame:
    """A packet stream with the clock state after each packet, per file."""
    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in PACKET)
    return packets.groupBy("file").transformWithStateInPandas(
        TimingState(timing), f"{names}, tdc bigint, gdc bigint, rollovers bigint", "append", "none"
    )


def cluster_stream(
    packets: DataFrame, out: str, checkpoint: str, timing: str = "tdc", batch: int = 10_000, fitting: str = "fast_gaussian", available_now: bool = True
) -> StreamingQuery:
    """Micro-batches of packets to neutrons, appended by batch number, so that a replayed batch replaces itself.

    Clocks go on from one micro-batch of a file to the next; their state needs
    the RocksDB store, which the session is set to.
    """
    packets.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)

    def write(rows: DataFrame, number: int) -> None:
        rows.persist()  # read more than once, and stateful
        hits = C.numbered_batches(decode_hits(rows, timing, timed=True), batch)
        neutrons = Fit.fit(C.cluster(hits, C.LEGACY_ABS), fitting)
        neutrons.write.mode("overwrite").parquet(f"{out}/batch={number}")
        rows.unpersist()

    query = timed_stream(packets, clock_of(timing)).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if available_now else query).start()


def reduce_new_files(
    spark: SparkSession, folder: str, out: str, base: str = "tof_image", config: ReduceConfig | None = None, mode: str = "neutron", timing: str = "gdc"
) -> list[str]:
    """Reduce the files that have no result yet, each once; then refresh stack and spectrum from all results.

    A file's sparse image is written below ``out/images/stem=...`` and replaces
    itself on a retry, so nothing is counted twice.
    """
    config = config or default_json()
    done = []
    for path in sorted(Path(folder).glob("*.tpx3")):
        target = f"{out}/images/stem={path.stem}"
        if os.path.exists(f"{target}/_SUCCESS"):
            continue
        reduce(spark, str(path), config, mode, timing).image.write.mode("overwrite").parquet(target)
        done.append(path.stem)
    if done:
        image = accumulated(spark, out)
        bins = len(config.binning.edges()) - 1
        for number in range(bins):
            old = sinks.tiff_name(out, base, number)
            if os.path.exists(old):
                os.remove(old)
        sinks.write_tiffs(image, out, base, bins, config.super_resolution)
        sinks.write_spectrum(I.spectrum(image, config.binning.edges()), f"{out}/{base}_Spectra.txt")
    return done


def accumulated(spark: SparkSession, out: str) -> DataFrame:
    """Sum of the images of all files reduced so far."""
    return spark.read.parquet(f"{out}/images").groupBy("bin", "y", "x").agg(F.sum("count").alias("count"))


def watch(
    spark: SparkSession, folder: str, out: str, interval: float = 5.0, stop_pattern: str = STOP_PATTERN, sleep: Callable[[float], None] = time.sleep, **options
) -> list[str]:
    """Poll a folder until the stop file is there; files that came with it are reduced before the end."""
    if interval <= 0:
        raise ValueError("interval must be positive")
    seen: list[str] = []
    while True:
        last = any(Path(folder).glob(stop_pattern))
        seen += reduce_new_files(spark, folder, out, **options)
        if last:
            return seen
        sleep(interval)
