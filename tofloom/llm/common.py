"""Helpers that the text operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

#: ASCII white space: what separates words.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RE = r"[\x20\x09-\x0D]+"
WORD_RE = r"[^\x20\x09-\x0D]"


def text_of(column: str = "text") -> Column:
    """The text, null as the empty string."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Words of a non-null text: maximal runs of anything but ASCII white space."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RE))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often body names it."""
    return F.transform(F.array(value), body)[0]


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below the one that the cluster shares for checkpoints.

    Where ``spark.checkpoint.dir`` is unset, a local session gets a temporary
    folder; a cluster without the setting is refused, as its executors have no
    folder in common.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tofloom-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tables/{uuid.uuid4().hex}"


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session setting for the time being."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


_recorders: list[list[str]] = []

#: Setting by which Spark deletes a query's shuffle files as soon as the query has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, codec: str = "zstd", **options: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors.

    The job's shuffle files go when it ends: what it wrote replaces them.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    for paths in _recorders:
        paths.append(path)
    with setting(spark, _CLEANUP, "true"):
        df.write.options(compression=codec, **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The folders of all tables that are materialized meanwhile."""
    paths: list[str] = []
    _recorders.append(paths)
    try:
        yield paths
    finally:
        _recorders.pop()


def delete(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete the files of materialized tables that nothing will read again."""
    for df in tables:
        delete(spark, *(file.rpartition("/")[0] for file in df.inputFiles()[:1]))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def widen(schema: StructType, fields: dict[str, str]) -> StructType:
    """A copy of the schema with more fields (``StructType.add`` changes the frame's own)."""
    out = StructType(list(schema.fields))
    for name, kind in fields.items():
        out = out.add(name, DataType.fromDDL(kind))
    return out
