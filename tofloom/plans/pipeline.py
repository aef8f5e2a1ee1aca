"""The reduction: raw files to hits, neutrons, images and spectrum."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..config import ReduceConfig, check_options, default_json
from ..functions.hits import decode_hits
from ..operators import cluster as C
from ..operators import fit as Fit
from ..operators import imaging as I
from ..operators.gdc import gdc_records
from ..sources import sinks, tpx3


@dataclass
class Reduction:
    """Lazy results; each is a plan until a sink runs it."""

    hits: DataFrame
    config: ReduceConfig
    mode: str = "neutron"
    in_order: bool = False
    fitting: str = "centroid"

    @cached_property
    def labelled(self) -> DataFrame:
        search = C.BoxSearch(self.config.abs_radius, self.config.spider_time_range)
        return C.cluster(self.hits, search, in_order=self.in_order)

    @cached_property
    def neutrons(self) -> DataFrame:
        return Fit.fit(self.labelled, self.fitting, min_size=self.config.abs_min_cluster_size)

    @cached_property
    def image(self) -> DataFrame:
        rows = self.hits if self.mode == "hit" else self.neutrons
        return I.tof_image(rows, self.config.binning.edges(), self.config.super_resolution)

    @cached_property
    def spectrum(self) -> DataFrame:
        return I.spectrum(self.image, self.config.binning.edges())


def reduce(
    spark: SparkSession, path: str, config: ReduceConfig | None = None, mode: str = "neutron", timing: str = "tdc", fitting: str = "centroid", **options
) -> Reduction:
    """Plan the reduction of a file, a folder or a pattern."""
    check_options(mode=mode, timing=timing)
    packets = tpx3.packets(spark, path, **options)
    return Reduction(decode_hits(packets, timing), config or default_json(), mode, fitting=fitting)


def extract_gdc(spark: SparkSession, path: str, **options) -> DataFrame:
    return gdc_records(tpx3.words(spark, path, **options))


def run_reduce(
    spark: SparkSession, path: str, *, hits: str | None = None, neutrons: str | None = None, tiff: str | None = None,
    base: str = "tof_image", spectra: str | None = None, config: ReduceConfig | None = None, mode: str = "neutron", timing: str = "tdc",
    chunk_size: int | None = None,
) -> dict[str, str]:
    """Write the outputs that are asked for; returns their places."""
    check_options(mode=mode, timing=timing, chunk_size=chunk_size)
    options = {"splitSize": str(min(chunk_size, 1 << 30))} if chunk_size else {}
    plan = reduce(spark, path, config, mode, timing, **options)
    done = {}
    if hits:
        done["hits"] = sinks.save_hits(plan.hits, hits)
    if neutrons:
        done["neutrons"] = sinks.save_neutrons(plan.neutrons, neutrons)
    if tiff or spectra:
        image = plan.image.persist()  # counts only: read by both sinks
        if tiff:
            sinks.write_tiffs(image, tiff, base, len(plan.config.binning.edges()) - 1, plan.config.super_resolution)
            done["tiff"] = tiff
        if spectra:
            sinks.write_spectrum(I.spectrum(image, plan.config.binning.edges()), spectra)
            done["spectra"] = spectra
        image.unpersist()
    return done
