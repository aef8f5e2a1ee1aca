"""Schemas and constants of the detector data model."""

from __future__ import annotations

from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

TICK_NS = 25.0
FINE_NS = 25.0 / 16.0
PULSE_TICKS = 666667
LAST_TOF_TICK = 666800  # 16.67 ms
CANVAS = 517
SPIDER_RANGE = 1 << 30


_KINDS = {"int": IntegerType(), "long": LongType(), "double": DoubleType(), "string": StringType()}


def _schema(fields: str) -> StructType:
    return StructType([StructField(name, _KINDS[kind]) for name, kind in (f.split() for f in fields.split(","))])


WORD = _schema("file string, split int, offset long, word long")
PACKET = _schema("file string, split int, batch_offset long, chip int, seq int, offset long, word long")
HIT = _schema(
    "file string, batch_offset long, seq int, chip int, x int, y int, tot int, toa int, ftoa int, tof long, spidertime long"
)
NEUTRON = _schema("file string, batch_offset long, label int, x double, y double, tof double, tot double, n_hits int")
HIT_NS = _schema("x double, y double, tot_ns double, toa_ns double, ftoa_ns double, tof_ns double, spidertime_ns double")
NEUTRON_NS = _schema("x double, y double, tof_ns double, tot_ns double, nHits double")
GDC_RECORD = _schema("chip_id int, gdc_value long, file_offset long, timestamp_ns long")
IMAGE = _schema("bin int, y int, x int, count long")
SPECTRUM = _schema("bin int, shutter_time double, counts long")
