"""Raw detector files as a Spark data source, batch and streaming.

``spark.read.format("tpx3").load(path)`` gives a row per packet of a batch:
``file, split, batch_offset, chip, seq, offset, word``.  Option ``rows=words``
gives every 8-byte word instead.  Files are read in splits of ``splitSize``
bytes: a batch belongs to the split that holds its header and is read to its
end, so batches are never cut.

A header is any word that starts with TPX, also inside a payload; with
``strict=true`` payloads are skipped instead, and a file is one split.  What is
cut off by the end of the file is left out.
"""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..schemas import PACKET, WORD

SPLIT = 64 << 20
#: Words that are looked at, and rows that are given, at once.
STEP = 1 << 20
#: A batch has at most so many payload words.
LONGEST = 8191


def list_files(path: str, pattern: str = "*.tpx3") -> list[str]:
    """The file, the files of the folder, or those that match the pattern; in name order."""
    path = path.removeprefix("file://")
    if os.path.isdir(path):
        return sorted(glob.glob(os.path.join(path, pattern)))
    found = sorted(glob.glob(path))
    if not found:
        raise FileNotFoundError(f"no such file: {path}")
    return found


def headers(words: np.ndarray) -> np.ndarray:
    return np.flatnonzero((words & np.uint64(0xFFFFFF)) == np.uint64(0x585054))


def strict_headers(words: np.ndarray) -> np.ndarray:
    """Headers that aren't payload of the header before."""
    found, free = [], 0
    for h in headers(words).tolist():
        if h >= free:
            found.append(h)
            free = h + 1 + (int(words[h]) >> 51)
    return np.array(found, dtype=np.int64)


class Split(InputPartition):
    def __init__(self, file: str, number: int, start: int, end: int):
        super().__init__((file, number, start, end))


def read_packets(split: Split, strict: bool) -> Iterator[pa.RecordBatch]:
    """Packets of the batches whose headers are in a split (byte range)."""
    file, number, start, end = split.value
    size = os.path.getsize(file) // 8
    first, last = start // 8, min(end // 8, size)
    if first >= last:
        return
    words = np.memmap(file, dtype="<u8", mode="r", shape=(size,))
    at = first
    while at < last:
        stop = last if strict else min(at + STEP, last)
        heads = (strict_headers if strict else headers)(words[at:stop]) + at
        counts = np.minimum((words[heads] >> np.uint64(51)).astype(np.int64), size - heads - 1)
        for a, b in _pieces(counts):
            yield _packets(file, number, words, heads[a:b], counts[a:b])
        at = stop


def _pieces(counts: np.ndarray) -> Iterator[tuple[int, int]]:
    total, a = np.cumsum(counts), 0
    while a < len(counts):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + STEP // 4, "right")))
        yield a, b
        a = b


def _packets(file: str, number: int, words: np.ndarray, heads: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    n = int(counts.sum())
    seq = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)
    at = np.repeat(heads, counts) + 1 + seq
    chip = ((words[heads] >> np.uint64(32)) & np.uint64(0xFF)).astype(np.uint8).view(np.int8).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n, file), pa.string()) if n else pa.array([], pa.string()),
            pa.array(np.full(n, number), pa.int32()),
            pa.array(np.repeat(heads * 8, counts), pa.int64()),
            pa.array(np.repeat(chip, counts), pa.int32()),
            pa.array(seq, pa.int32()),
            pa.array(at * 8, pa.int64()),
            pa.array(np.asarray(words[at]).view(np.int64), pa.int64()),
        ],
        names=PACKET.fieldNames(),
    )


def read_words(split: Split) -> Iterator[pa.RecordBatch]:
    file, number, start, end = split.value
    size = os.path.getsize(file) // 8
    first, last = start // 8, min(end // 8, size)
    if first >= last:
        return
    words = np.memmap(file, dtype="<u8", mode="r", shape=(size,))
    for at in range(first, last, STEP):
        part = np.asarray(words[at : min(at + STEP, last)])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([file] * len(part), pa.string()),
                pa.array(np.full(len(part), number), pa.int32()),
                pa.array(np.arange(at, at + len(part)) * 8, pa.int64()),
                pa.array(part.view(np.int64), pa.int64()),
            ],
            names=WORD.fieldNames(),
        )


class Tpx3Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.words = options.get("rows", "packets") == "words"
        self.strict = options.get("strict", "false").lower() == "true"
        self.split = int(options.get("splitsize", SPLIT)) // 8 * 8

    def partitions(self) -> list[Split]:
        found = []
        for file in list_files(self.path):
            size = os.path.getsize(file)
            step = size + 8 if self.strict and not self.words else self.split
            found += [Split(file, k, at, at + step) for k, at in enumerate(range(0, size, step))]
        return found or [Split("", 0, 0, 0)]

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        if not split.value[0]:
            return iter(())
        return read_words(split) if self.words else read_packets(split, self.strict)


class Tpx3StreamReader(DataSourceStreamReader):
    """Growing files of a folder: an offset is the consumed length of each file, up to the last whole batch."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.split = int(options.get("splitsize", SPLIT)) // 8 * 8
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        try:
            files = list_files(self.path)
        except FileNotFoundError:
            files = []
        for file in files:
            self.known[file] = self._whole(file, self.known.get(file, 0))
        return {"files": json.dumps(self.known, sort_keys=True)}

    @staticmethod
    def _whole(file: str, start: int) -> int:
        """End of the last whole batch: only the longest possible batch's words before the end can be unfinished."""
        size = os.path.getsize(file) // 8
        if size * 8 <= start:
            return start
        words = np.memmap(file, dtype="<u8", mode="r", shape=(size,))
        low = max(start // 8, size - LONGEST - 1)
        heads = headers(words[low:]) + low
        open_ = heads[heads + 1 + (words[heads] >> np.uint64(51)).astype(np.int64) > size]
        return int(open_[0] if len(open_) else size) * 8

    def partitions(self, start: dict, end: dict) -> list[Split]:
        before, now = json.loads(start["files"]), json.loads(end["files"])
        found = []
        for file, stop in sorted(now.items()):
            first = before.get(file, 0)
            self.known[file] = max(self.known.get(file, 0), stop)
            found += [Split(file, at // self.split, at, min(at + self.split, stop)) for at in range(first, stop, self.split)]
        return found or [Split("", 0, 0, 0)]

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        return read_packets(split, False) if split.value[0] else iter(())

    def commit(self, end: dict) -> None:
        pass


class Tpx3DataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tpx3"

    def schema(self) -> StructType:
        return WORD if self.options.get("rows", "packets") == "words" else PACKET

    def reader(self, schema: StructType) -> Tpx3Reader:
        return Tpx3Reader(dict(self.options))

    def streamReader(self, schema: StructType) -> Tpx3StreamReader:
        return Tpx3StreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Tpx3DataSource)


def packets(spark: SparkSession, path: str, **options):
    register(spark)
    return spark.read.format("tpx3").options(**options).load(path)


def words(spark: SparkSession, path: str, **options):
    return packets(spark, path, rows="words", **options)


def unprocessed(files, manifest):
    """Rows of ``files`` whose file stem isn't in ``manifest``: a left anti join."""
    from pyspark.sql import functions as F

    stem = F.regexp_replace(F.regexp_extract("file", r"([^/]*)$", 1), r"\.[^.]*$", "")
    return files.withColumn("stem", stem).join(manifest.select("stem"), "stem", "left_anti")
