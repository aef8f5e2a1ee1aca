"""Outputs: Parquet groups, TIFF stacks, spectra, CSV and raw dumps."""

from __future__ import annotations

import os
import struct
import time
from collections.abc import Iterator
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hits import hits_ns
from ..operators.fit import neutrons_ns
from ..operators.imaging import accumulate, dimension
from ..schemas import IMAGE


def stamped_name(path: str) -> str:
    """``base_NNNNNN.ext``: the name with the current microseconds; no extension counts as ``.parquet``."""
    base, ext = os.path.splitext(path)
    return f"{base}_{int(time.time() * 1e6) % 1_000_000:06d}{ext or '.parquet'}"


def _fresh(path: str) -> str:
    while os.path.exists(path):
        path = stamped_name(path)
    return path


def save(rows: DataFrame, path: str, group: str) -> str | None:
    """A table below ``path/group=...``; an existing path gets a stamped name; nothing is written for no rows.

    Returns the path written to.
    """
    if rows.isEmpty():
        return None
    path = _fresh(path)
    rows.write.parquet(f"{path}/group={group}")
    return path


def append(rows: DataFrame, path: str, group: str) -> str | None:
    """Adds the next free group: ``group``, ``group_1``, ``group_2`` and so on; returns its name."""
    if rows.isEmpty():
        return None
    name, n = group, 0
    while os.path.exists(f"{path}/group={name}"):
        n += 1
        name = f"{group}_{n}"
    rows.write.parquet(f"{path}/group={name}")
    return name


def extend(rows: DataFrame, path: str, group: str) -> None:
    """Adds rows to a group."""
    rows.write.mode("append").parquet(f"{path}/group={group}")


def save_hits(hits: DataFrame, path: str) -> str | None:
    return save(hits_ns(hits), path, "hits")


def append_hits(hits: DataFrame, path: str) -> str | None:
    return append(hits_ns(hits), path, "hits")


def save_labelled_hits(hits: DataFrame, path: str) -> str | None:
    """Hits with a ``label``; x, y and the label stay integers."""
    ns = hits.select("x", "y", *(c.alias(n) for c, n in ((F.col(k) * f, f"{k}_ns") for k, f in (("tot", 25.0), ("toa", 25.0), ("ftoa", 25.0 / 16), ("tof", 25.0), ("spidertime", 25.0)))), "label")
    return save(ns, path, "hits")


def save_neutrons(neutrons: DataFrame, path: str) -> str | None:
    return save(neutrons_ns(neutrons), path, "neutrons")


def append_neutrons(neutrons: DataFrame, path: str) -> str | None:
    return append(neutrons_ns(neutrons), path, "neutrons")


def save_events(neutrons: DataFrame, path: str) -> str:
    """Event table of the older layout; no events are an error."""
    ns = neutrons.select("x", "y", (F.col("tof") * 25.0).alias("tof_ns"), F.col("n_hits").alias("NHits"), "tot")
    done = save(ns, path, "events")
    if done is None:
        raise ValueError("no events to save")
    return done


def hdf5(rows: DataFrame, path: str, group: str) -> None:
    """One dataset per column in a group of an HDF5 file, where h5py is installed; rows pass through the driver in parts."""
    try:
        import h5py
    except ImportError as e:
        raise RuntimeError("HDF5 output needs h5py; use the Parquet sink") from e
    with h5py.File(path, "a") as file:
        target = file.create_group(group)
        sets = {c: target.create_dataset(c, (0,), "f8", maxshape=(None,), chunks=(1024,)) for c in rows.columns}
        for row in rows.toLocalIterator():
            for c, d in sets.items():
                d.resize(len(d) + 1, 0)
                d[-1] = row[c]


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def gdc_csv(records: DataFrame, path: str) -> None:
    write_csv(records.select("chip_id", "gdc_value", "file_offset", "timestamp_ns"), path)


def events_csv(neutrons: DataFrame, path: str) -> None:
    """Adds events with the bench's column names."""
    named = neutrons.select(
        F.col("x").alias("X"), F.col("y").alias("Y"), (F.col("tof") * 25.0).alias("TOF (ns)"), F.col("n_hits").alias("Nhits"), F.col("tot").alias(" TOT")
    )
    named.write.mode("append").option("header", True).option("ignoreLeadingWhiteSpace", False).csv(path)


def packed_events(neutrons: DataFrame) -> DataFrame:
    """Positions scaled to 16 bits, as the compact event text has them."""

    def short(c: str):
        return (F.col(c) * 65535 / 512).cast("int")

    return neutrons.select(short("x").alias("x"), short("y").alias("y"), (F.col("tof") * 25).cast("long").alias("tof"), "n_hits", F.col("tot").cast("int").alias("tot"))


# -- images -------------------------------------------------------------------


def tiff_bytes(image: np.ndarray) -> bytes:
    """A baseline TIFF of 32-bit unsigned counts, one strip, little-endian."""
    height, width = image.shape
    data = np.ascontiguousarray(image, dtype="<u4").tobytes()
    tags = [
        (256, 4, width), (257, 4, height), (258, 3, 32), (259, 3, 1), (262, 3, 1), (273, 4, 8), (277, 3, 1),
        (278, 4, height), (279, 4, len(data)), (284, 3, 1), (339, 3, 1),
    ]
    ifd = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in tags) + struct.pack("<I", 0)
    return b"II*\0" + struct.pack("<I", 8 + len(data)) + data + ifd


def read_tiff(path: str) -> np.ndarray:
    data = Path(path).read_bytes()
    if data[:4] != b"II*\0":
        raise ValueError(f"{path} is not a little-endian TIFF")
    (at,) = struct.unpack_from("<I", data, 4)
    (n,) = struct.unpack_from("<H", data, at)
    tags = {}
    for k in range(n):
        tag, kind, _, value = struct.unpack_from("<HHII", data, at + 2 + 12 * k)
        tags[tag] = value & 0xFFFF if kind == 3 else value
    width, height = tags[256], tags[257]
    return np.frombuffer(data, "<u4", width * height, tags[273]).reshape(height, width)


def tiff_name(folder: str, base: str, number: int) -> str:
    return os.path.join(folder, f"{base}_bin_{number + 1:04d}.tiff")


def write_tiffs(image: DataFrame, folder: str, base: str, bins: int, scale: float = 1.0) -> None:
    """A file per bin, also for empty ones; counts add to an existing file of the same size, else replace it.

    Executors write to ``folder``, which all must share.  A bin is dense only in its own task.
    """
    size = dimension(scale)
    os.makedirs(folder, exist_ok=True)

    def dump(rows: Iterator) -> None:
        now, cells = None, None
        for row in rows:
            if row["bin"] != now:
                if now is not None:
                    _add_tiff(tiff_name(folder, base, now), cells)
                now, cells = row["bin"], np.zeros((size, size), dtype=np.uint32)
            if row["y"] is not None:
                cells[row["y"], row["x"]] += row["count"]
        if now is not None:
            _add_tiff(tiff_name(folder, base, now), cells)

    every = image.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    cells = every.join(image.select(*IMAGE.fieldNames()), "bin", "left")
    cells.repartition("bin").sortWithinPartitions("bin").foreachPartition(dump)


def _add_tiff(path: str, cells: np.ndarray) -> None:
    if os.path.exists(path):
        old = read_tiff(path)
        if old.shape == cells.shape:
            cells = cells + old
    part = f"{path}.part"
    Path(part).write_bytes(tiff_bytes(cells))
    os.replace(part, path)


def read_tiffs(spark, folder: str, base: str) -> DataFrame:
    """The sparse image of a stack."""
    files = sorted(Path(folder).glob(f"{base}_bin_*.tiff"))

    def load(pdfs):
        import pandas as pd

        for pdf in pdfs:
            for path in pdf["path"]:
                image = read_tiff(path)
                y, x = np.nonzero(image)
                number = int(Path(path).stem.rsplit("_", 1)[1]) - 1
                yield pd.DataFrame({"bin": np.int32(number), "y": y.astype(np.int32), "x": x.astype(np.int32), "count": image[y, x].astype(np.int64)})

    paths = spark.createDataFrame([(str(f),) for f in files], "path string")
    return paths.repartition(max(1, len(files))).mapInPandas(load, IMAGE)


def add_images(old: DataFrame, new: DataFrame) -> DataFrame:
    return accumulate(old, new)


def spectrum_lines(spectrum: DataFrame) -> Iterator[str]:
    """Lines of a spectrum file: a row per bin, with six significant digits."""
    yield "shutter_time,counts"
    for row in spectrum.orderBy("bin").toLocalIterator():
        yield f"{row['shutter_time']:g},{row['counts']}"


def write_spectrum(spectrum: DataFrame, path: str) -> None:
    Path(path).write_text("\n".join(spectrum_lines(spectrum)) + "\n")


def dump_histogram(cells: DataFrame, path: str, size: int) -> None:
    """Doubles with the axes swapped: x is the slow one."""
    dense = np.zeros((size, size), dtype="<f8")
    for row in cells.toLocalIterator():
        dense[row["ix"], row["iy"]] = row["count"]
    Path(path).write_bytes(dense.tobytes())


def dump_tof(cells: DataFrame, path: str, bins: int) -> None:
    """Unsigned 32-bit counts by bin."""
    dense = np.zeros(bins, dtype="<u4")
    for row in cells.toLocalIterator():
        dense[row["itof"]] = row["count"]
    Path(path).write_bytes(dense.tobytes())
