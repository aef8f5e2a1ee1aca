"""Reduction settings, from JSON, from text files, or by default."""

from __future__ import annotations

import json
import warnings
from dataclasses import dataclass, field, replace
from pathlib import Path

CHUNK_LIMITS = (1 << 20, 20 << 30)


@dataclass(frozen=True)
class TofBinning:
    """Bin edges in seconds: custom ones, else ``num_bins`` equal steps up to ``tof_max``."""

    num_bins: int = 1500
    tof_max: float = 1.0 / 60.0
    custom_edges: tuple[float, ...] = ()

    def edges(self) -> list[float]:
        if self.custom_edges:
            return check_edges(list(self.custom_edges))
        return check_edges([self.tof_max * i / self.num_bins for i in range(self.num_bins + 1)])


def check_edges(edges: list[float]) -> list[float]:
    """At least two edges, strictly increasing."""
    if len(edges) < 2 or any(b <= a for a, b in zip(edges, edges[1:])):
        raise ValueError("bin edges must be at least two strictly increasing numbers")
    return edges


@dataclass(frozen=True)
class ReduceConfig:
    abs_radius: float = 5.0
    abs_min_cluster_size: int = 1
    spider_time_range: int = 75
    binning: TofBinning = field(default_factory=TofBinning)
    super_resolution: float = 1.0

    def __str__(self) -> str:
        return (
            f"ABS: radius={self.abs_radius:g}, min_cluster_size={self.abs_min_cluster_size}, "
            f"spider_time_range={self.spider_time_range}; TOF bins={len(self.binning.edges()) - 1}, "
            f"super resolution={self.super_resolution:g}"
        )


JSON_BINNING = TofBinning(1500, 16.7e-3)


def from_dict(config: dict) -> ReduceConfig:
    """Settings of a parsed JSON file; missing ones have defaults, unknown ones (also ``_bin_edges``) are ignored."""
    clusters, imaging = config.get("abs", {}), config.get("tof_imaging", {})
    if "bin_edges" in imaging:
        binning = TofBinning(custom_edges=tuple(float(e) for e in imaging["bin_edges"]))
    elif "uniform_bins" in imaging:
        uniform = imaging["uniform_bins"]
        binning = TofBinning(int(uniform.get("num_bins", 1500)), float(uniform.get("end", 16.7e-3)))
    else:
        binning = JSON_BINNING
    return ReduceConfig(
        float(clusters.get("radius", 5.0)),
        int(clusters.get("min_cluster_size", 1)),
        int(clusters.get("spider_time_range", 75)),
        binning,
        float(imaging.get("super_resolution", 1.0)),
    )


def default_json() -> ReduceConfig:
    return from_dict({})


def from_json(path: str) -> ReduceConfig:
    return from_dict(json.loads(Path(path).read_text()))


_TEXT = {
    "abs_radius": ("abs_radius", float),
    "abs_min_cluster_size": ("abs_min_cluster_size", int),
    "spider_time_range": ("spider_time_range", int),
}


def from_text(path: str) -> ReduceConfig:
    """``name value`` lines; ``#`` starts a comment line; binning names are read and dropped."""
    config = ReduceConfig()
    for line in Path(path).read_text().splitlines():
        name, *rest = line.split() or [""]
        if not name or name.startswith("#"):
            continue
        if name in _TEXT and rest:
            to, kind = _TEXT[name]
            config = replace(config, **{to: kind(float(rest[0])) if kind is int else kind(rest[0])})
        elif name in ("tof_bins", "tof_max"):
            warnings.warn(f"{name} has no effect in a text configuration", stacklevel=2)
        else:
            warnings.warn(f"unknown parameter {name}", stacklevel=2)
    return config


def load(path: str | None) -> ReduceConfig:
    if not path:
        return default_json()
    return from_json(path) if path.endswith(".json") else from_text(path)


def check_options(
    *, mode: str = "neutron", timing: str = "tdc", chunk_size: int | None = None, interval: float | None = None, inputs: tuple[str, ...] = ()
) -> None:
    """Raise ValueError for options that no run can use."""
    if mode not in ("hit", "neutron"):
        raise ValueError(f"mode must be hit or neutron, not {mode}")
    if timing not in ("tdc", "gdc"):
        raise ValueError(f"timing must be tdc or gdc, not {timing}")
    if chunk_size is not None and not CHUNK_LIMITS[0] <= chunk_size <= CHUNK_LIMITS[1]:
        raise ValueError("chunk size must be between 1 MB and 20 GB")
    if interval is not None and interval <= 0:
        raise ValueError("interval must be positive")
    for path in inputs:
        if not Path(path).exists():
            raise ValueError(f"cannot read {path}")
