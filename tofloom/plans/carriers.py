"""Deterministic packets and hits from the supplied tables.

The tables have nothing to do with detectors; they only carry integers, so that
queries have inputs that SQL can reproduce.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import packets as P

SPLIT_EVENTS = 2000


def event_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, user_id, event_type, v, tick``: time in 25 ns ticks since 2024."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    tick = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))") * 40
    return events.select(
        "event_id", "user_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("v"), tick.cast("long").alias("tick")
    )


def event_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A packet table in event order: most events are hits, some are clock packets."""
    e = event_fields(spark, sf_dir)
    tick, i = F.col("tick"), F.col("event_id")
    pixel = P.pixel_word(
        (i * 7919) % 65536, tick % 16384, F.col("v") % 1024, i % 16, F.floor(tick / 16384) % 65536
    )
    low, high = P.gdc_words(tick)
    words = (
        F.when(F.col("event_type").isin("view", "click", "error"), F.array(pixel))
        .when(F.col("event_type") == "signup", F.array(P.tdc_word(tick % (1 << 32))))
        .when(F.col("event_type") == "purchase", F.array(low, high))
    )
    rows = e.where(words.isNotNull()).select(
        F.lit("events").alias("file"),
        F.floor(i / SPLIT_EVENTS).cast("int").alias("split"),
        i.alias("batch_offset"),
        (F.col("user_id") % 4).cast("int").alias("chip"),
        F.posexplode(words).alias("seq", "word"),
    )
    return rows.select("file", "split", "batch_offset", "chip", "seq", (F.col("batch_offset") * 16 + F.col("seq") * 8).alias("offset"), "word")


def event_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a table of all words, with a header before each event's packets."""
    p = event_packets(spark, sf_dir)
    header = F.lit(P.HEADER_FULL).bitwiseOR(F.shiftleft(F.col("chip").cast("long"), 32)).bitwiseOR(F.lit(8 << 48))
    heads = p.where("seq = 0").select("file", "split", (F.col("batch_offset") * 32).alias("offset"), header.alias("word"))
    body = p.select("file", "split", (F.col("batch_offset") * 32 + 8 + F.col("seq") * 8).alias("offset"), "word")
    return heads.union(body)


def line_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with a batch per order."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"
    )
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return rows.select(
        F.lit("lineitem").alias("file"),
        F.col("l_orderkey").alias("batch_offset"),
        (F.row_number().over(w) - 1).alias("seq"),
        F.lit(3).alias("chip"),
        (F.col("l_partkey") % 16).cast("int").alias("x"),
        (F.col("l_suppkey") % 16).cast("int").alias("y"),
        F.col("l_quantity").cast("int").alias("tot"),
        ((F.col("l_partkey") * 7 + F.col("l_linenumber")) % 16384).cast("int").alias("toa"),
        (F.col("l_suppkey") % 16).cast("int").alias("ftoa"),
        ((F.col("l_partkey") * 331 + F.col("l_suppkey") * 17) % 666667).alias("tof"),
        (F.col("l_linenumber") % 7).cast("long").alias("spidertime"),
    )


def wide_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line hits spread over the canvas."""
    return line_hits(spark, sf_dir).withColumns(
        {"x": ((F.col("tof") * 7) % 517).cast("int"), "y": ((F.col("tof") * 11) % 517).cast("int")}
    )


def dense_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide hits in a quarter of the canvas's side, a batch per hundred orders: clusters compete for slots."""
    rows = wide_hits(spark, sf_dir).withColumns({"x": F.col("x") % 64, "y": F.col("y") % 64, "__order": F.col("batch_offset")})
    rows = rows.withColumn("batch_offset", F.floor(F.col("__order") / 100))
    w = Window.partitionBy("batch_offset").orderBy("__order", "seq")
    return rows.withColumn("seq", F.row_number().over(w) - 1).drop("__order")


EVENTS_SQL = """
ev AS (
  SELECT event_id, user_id, event_type, CAST(round(value * 100) AS BIGINT) AS v,
    (epoch_us(ts) - 1704067200000000) * 40 AS tick FROM events),
px AS (
  SELECT event_id, CAST(user_id % 4 AS INTEGER) AS chip, (event_id * 7919) % 65536 AS pa, CAST(tick % 16384 AS INTEGER) AS toa,
    CAST(v % 1024 AS INTEGER) AS tot, CAST(event_id % 16 AS INTEGER) AS ftoa, tick % 1073741824 AS st
  FROM ev WHERE event_type IN ('view', 'click', 'error')),
xy AS (SELECT *, 2 * (pa // 512) + (pa % 8) // 4 AS rx, 4 * ((pa // 8) % 64) + pa % 4 AS ry FROM px),
hit AS (
  SELECT *, CAST(CASE chip WHEN 0 THEN rx + 260 WHEN 1 THEN 515 - rx WHEN 2 THEN 255 - rx ELSE rx END AS INTEGER) AS x,
    CAST(CASE chip WHEN 1 THEN 515 - ry WHEN 2 THEN 515 - ry ELSE ry END AS INTEGER) AS y FROM xy)"""

CLOCK_SQL = EVENTS_SQL + """,
g AS (
  SELECT event_id, event_type, tick,
    coalesce(last_value(CASE WHEN event_type = 'purchase' AND tick % 281474976710656 <> 0 THEN tick % 281474976710656 END IGNORE NULLS) OVER o, 0) AS gdc,
    CASE WHEN event_type = 'signup' THEN tick % 4294967296 END AS t
  FROM ev WINDOW o AS (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
h AS (
  SELECT *, ((gdc // 4294967296 % 65536 + CASE WHEN t < gdc % 4294967296 THEN 1 ELSE 0 END) % 65536) * 4294967296 + t AS by_gdc,
    coalesce(last_value(t IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev
  FROM g),
i AS (
  SELECT *, CAST(sum(CASE WHEN prev - t > 2147483648 THEN 1 ELSE 0 END) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS roll FROM h),
clock AS (
  SELECT event_id, event_type, gdc, coalesce(last_value(by_gdc IGNORE NULLS) OVER o, 0) AS tdc_by_gdc,
    coalesce(last_value(CASE WHEN t IS NOT NULL THEN (roll % 65536) * 4294967296 + t END IGNORE NULLS) OVER o, 0) AS tdc_by_tdc
  FROM i WINDOW o AS (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""

LINES_SQL = """
lh AS (
  SELECT l_orderkey AS batch_offset,
    CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS INTEGER) AS seq,
    CAST(l_partkey % 16 AS INTEGER) AS x, CAST(l_suppkey % 16 AS INTEGER) AS y, CAST(trunc(l_quantity) AS INTEGER) AS tot,
    CAST((l_partkey * 7 + l_linenumber) % 16384 AS INTEGER) AS toa, CAST(l_suppkey % 16 AS INTEGER) AS ftoa,
    (l_partkey * 331 + l_suppkey * 17) % 666667 AS tof, CAST(l_linenumber % 7 AS BIGINT) AS spidertime
  FROM lineitem),
wh AS (SELECT * REPLACE (CAST((tof * 7) % 517 AS INTEGER) AS x, CAST((tof * 11) % 517 AS INTEGER) AS y) FROM lh),
dh AS (
  SELECT * REPLACE (batch_offset // 100 AS batch_offset, CAST(x % 64 AS INTEGER) AS x, CAST(y % 64 AS INTEGER) AS y,
    CAST(row_number() OVER (PARTITION BY batch_offset // 100 ORDER BY batch_offset, seq) - 1 AS INTEGER) AS seq) FROM wh)"""


def box_sql(source: str, slots: int) -> str:
    """CTE ``ab``: the box search as a fold over each batch's hits, one per step; ``source`` has ``t`` in ns."""
    fresh = "{'x0': h.x, 'x1': h.x, 'y0': h.y, 'y1': h.y, 't': h.t, 'label': %s}"
    return f"""
ab AS (
  SELECT batch_offset, seq, [{(fresh % '0').replace("h.", "")}] AS slots, {slots} AS following, 0 AS label FROM {source} WHERE seq = 0
  UNION ALL
  SELECT batch_offset, seq,
    CASE WHEN k > 0 THEN list_transform(slots, lambda s, i: CASE WHEN i = k THEN
        {{'x0': least(s.x0, x), 'x1': greatest(s.x1, x), 'y0': least(s.y0, y), 'y1': greatest(s.y1, y), 't': s.t, 'label': s.label}} ELSE s END)
      WHEN len(slots) < {slots} THEN list_append(slots, fresh)
      ELSE list_transform(slots, lambda s, i: CASE WHEN i = oldest THEN fresh ELSE s END) END,
    following + CASE WHEN k = 0 AND len(slots) = {slots} THEN 1 ELSE 0 END,
    CASE WHEN k > 0 THEN slots[k].label ELSE fresh.label END
  FROM (
    SELECT a.batch_offset, h.seq, h.x, h.y, a.slots, a.following,
      CAST(coalesce(list_position(list_transform(a.slots, lambda s:
        abs(h.t - s.t) <= 75 AND h.x BETWEEN s.x0 - 5 AND s.x1 + 5 AND h.y BETWEEN s.y0 - 5 AND s.y1 + 5), true), 0) AS INTEGER) AS k,
      list_position(list_transform(a.slots, lambda s: s.t), list_min(list_transform(a.slots, lambda s: s.t))) AS oldest,
      {fresh % f'CASE WHEN len(a.slots) < {slots} THEN CAST(len(a.slots) AS INTEGER) ELSE a.following END'} AS fresh
    FROM ab a JOIN {source} h ON h.batch_offset = a.batch_offset AND h.seq = a.seq + 1))"""


def ring_sql(source: str, slots: int) -> str:
    """CTE ``ab``: the box search over a ring, of which the last ``slots - 1`` openings are live."""
    fresh = "{'x0': h.x, 'x1': h.x, 'y0': h.y, 'y1': h.y, 't': h.t, 'label': %s}"
    return f"""
ab AS (
  SELECT batch_offset, seq, [{(fresh % '0').replace("h.", "")}] AS ring, 1 AS following, 0 AS label FROM {source} WHERE seq = 0
  UNION ALL
  SELECT batch_offset, seq,
    CASE WHEN hit IS NOT NULL THEN list_transform(ring, lambda s: CASE WHEN s.label = hit THEN
        {{'x0': least(s.x0, x), 'x1': greatest(s.x1, x), 'y0': least(s.y0, y), 'y1': greatest(s.y1, y), 't': s.t, 'label': s.label}} ELSE s END)
      WHEN len(ring) < {slots - 1} THEN list_append(ring, fresh) ELSE list_append(ring[2:], fresh) END,
    following + CASE WHEN hit IS NULL THEN 1 ELSE 0 END, coalesce(hit, following)
  FROM (
    SELECT a.batch_offset, h.seq, h.x, h.y, a.ring, a.following, {fresh % 'a.following'} AS fresh,
      list_min(list_transform(list_filter(a.ring, lambda s:
        abs(h.t - s.t) < 3 AND h.x BETWEEN s.x0 - 5 AND s.x1 + 5 AND h.y BETWEEN s.y0 - 5 AND s.y1 + 5),
        lambda s: {{'place': s.label % {slots}, 'label': s.label}})).label AS hit
    FROM ab a JOIN {source} h ON h.batch_offset = a.batch_offset AND h.seq = a.seq + 1))"""
