"""Registered detector queries, and the SQL that must agree with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import TofBinning
from ..functions import hits as H
from ..functions import packets as P
from ..functions import timing as T
from ..operators import checks, cluster, fit, imaging
from ..operators.gdc import gdc_records as records_of
from ..sources.tpx3 import unprocessed
from .carriers import CLOCK_SQL, EVENTS_SQL, LINES_SQL, box_sql, dense_hits, event_packets, event_words, line_hits, ring_sql, wide_hits

QUERIES: dict = {}
ORACLE_SQL: dict = {}

UNIFORM = TofBinning(200, 16.7e-3).edges()
CUSTOM = [0.0, 0.001, 0.002, 0.005, 0.01, 0.0167]
HIT_COLUMNS = ("x", "y", "tot", "toa", "ftoa", "tof", "spidertime")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _six(*columns: str):
    return [F.round(c, 6).alias(c) for c in columns]


# -- packets and decoding -----------------------------------------------------


@query(f"""WITH {EVENTS_SQL}, c AS (
  SELECT CASE WHEN event_type = 'signup' THEN 'tdc' WHEN event_type = 'purchase' THEN 'gdc' ELSE 'pixel' END AS class,
    CASE WHEN event_type = 'purchase' THEN 2 ELSE 1 END AS n FROM ev)
SELECT class, CAST(sum(n) AS BIGINT) AS packets FROM c GROUP BY class""")
def packet_class_counts(spark, d):
    return event_packets(spark, d).groupBy(P.packet_class(F.col("word")).alias("class")).agg(F.count("*").alias("packets"))


@query(f"WITH {EVENTS_SQL} SELECT event_id AS batch_offset, chip, x, y, tot, toa, ftoa, st AS ticks FROM hit")
def decode_hits(spark, d):
    w = F.col("word")
    x, y = P.place(F.col("chip"), *P.raw_xy(w))
    return event_packets(spark, d).where(P.is_pixel(w)).select(
        "batch_offset", "chip", x.alias("x"), y.alias("y"), P.tot(w).alias("tot"), P.toa(w).alias("toa"), P.ftoa(w).alias("ftoa"),
        P.spider_ticks(w).alias("ticks"),
    )


@query(f"""WITH {EVENTS_SQL} SELECT event_id AS batch_offset,
  CAST(CASE chip WHEN 0 THEN rx + 256 WHEN 1 THEN 511 - rx WHEN 2 THEN 255 - rx ELSE rx END AS INTEGER) AS x,
  CAST(CASE chip WHEN 1 THEN 511 - ry WHEN 2 THEN 511 - ry ELSE ry END AS INTEGER) AS y FROM xy""")
def display_layout(spark, d):
    w = F.col("word")
    x, y = P.place(F.col("chip"), *P.raw_xy(w), "display")
    return event_packets(spark, d).where(P.is_pixel(w)).select("batch_offset", x.alias("x"), y.alias("y"))


@query(f"""WITH {EVENTS_SQL} SELECT event_id AS batch_offset,
  round((tick // 16384 % 65536) * 409600.0 + ((tick % 16384) * 16 + 15 - event_id % 16) * 25 / 16.0, 6) AS fine_ns
FROM ev WHERE event_type IN ('view', 'click', 'error')""")
def fine_time(spark, d):
    w = F.col("word")
    rows = event_packets(spark, d).where(P.is_pixel(w))
    return rows.select("batch_offset", F.round(H.fine_time_ns(w), 6).alias("fine_ns"))


@query(f"""WITH {LINES_SQL} SELECT batch_offset, seq, x::DOUBLE AS x, y::DOUBLE AS y, tot * 25.0::DOUBLE AS tot_ns, toa * 25.0::DOUBLE AS toa_ns,
  ftoa * 25.0::DOUBLE / 16 AS ftoa_ns, tof * 25.0::DOUBLE AS tof_ns, spidertime * 25.0::DOUBLE AS spidertime_ns FROM lh""")
def hits_ns(spark, d):
    rows = line_hits(spark, d)
    ns = H.hits_ns(rows)
    return rows.select("batch_offset", "seq", *(F.expr(e).alias(c) for c, e in zip(ns.columns, (
        "CAST(x AS DOUBLE)", "CAST(y AS DOUBLE)", "tot * 25D", "toa * 25D", "ftoa * 25D / 16D", "tof * 25D", "spidertime * 25D"))))


# -- clocks -------------------------------------------------------------------


@query(f"WITH {CLOCK_SQL} SELECT event_id AS batch_offset, gdc FROM clock WHERE event_type = 'purchase'")
def gdc_forward_fill(spark, d):
    return T.timing_states(event_packets(spark, d)).where(P.is_gdc(F.col("word")) & (F.col("seq") == 1)).select("batch_offset", "gdc")


@query(f"WITH {CLOCK_SQL} SELECT event_id AS batch_offset, gdc, tdc_by_gdc AS tdc FROM clock WHERE event_type NOT IN ('signup', 'purchase')")
def clock_gdc_mode(spark, d):
    rows = T.with_time(event_packets(spark, d), "gdc").where(P.is_pixel(F.col("word")))
    return rows.select("batch_offset", "gdc", "tdc")


@query(f"WITH {CLOCK_SQL} SELECT event_id AS batch_offset, tdc_by_tdc AS tdc FROM clock WHERE event_type NOT IN ('signup', 'purchase')")
def clock_tdc_mode(spark, d):
    return T.with_time(event_packets(spark, d), "tdc").where(P.is_pixel(F.col("word"))).select("batch_offset", "tdc")


@query(f"""WITH {CLOCK_SQL} SELECT event_id AS batch_offset,
  coalesce(lag(gdc) OVER (ORDER BY event_id), 0) AS gdc0, coalesce(lag(tdc_by_gdc) OVER (ORDER BY event_id), 0) AS tdc0 FROM clock""")
def batch_start_state(spark, d):
    return T.batch_starts(event_packets(spark, d), "gdc").select("batch_offset", "gdc0", "tdc0")


@query(f"""WITH {CLOCK_SQL} SELECT CAST(user_id % 4 AS INTEGER) AS chip_id, tick % 281474976710656 AS gdc_value,
  event_id * 32 + 16 AS file_offset, (tick % 281474976710656) * 25 AS timestamp_ns
FROM ev WHERE event_type = 'purchase' AND tick <> 0""")
def gdc_records(spark, d):
    return records_of(event_words(spark, d)).drop("file")


_GDC = f"""WITH {CLOCK_SQL},
k AS (
  SELECT hit.*, gdc, tdc_by_gdc AS tdc, ((gdc // 1073741824 % 262144 + CASE WHEN st < gdc % 1073741824 THEN 1 ELSE 0 END) % 262144) * 1073741824 + st AS sp0
  FROM hit JOIN clock USING (event_id) WHERE gdc <> 0 AND tdc_by_gdc <> 0),
m AS (SELECT *, CASE WHEN sp0 - gdc < 0 OR sp0 - gdc >= 40000000 THEN sp0 - 1073741824 ELSE sp0 END AS sp FROM k),
t0 AS (SELECT *, ((sp - tdc) % 4294967296 + 4294967296) % 4294967296 AS t FROM m)"""


@query(_GDC + """ SELECT event_id AS batch_offset, x, y, tot, toa, ftoa, sp AS spidertime,
  CASE WHEN t <= 666800 THEN t ELSE t - 666667 * ((t - 666800 + 666666) // 666667) END AS tof FROM t0""")
def hits_gdc_mode(spark, d):
    return H.decode_hits(event_packets(spark, d), "gdc").select("batch_offset", *HIT_COLUMNS)


@query(_GDC + """ SELECT event_id AS batch_offset, x, y, sp0 AS spidertime,
  ((sp0 - tdc + CASE WHEN sp0 < tdc THEN 16666667 ELSE 0 END) % 4294967296 + 4294967296) % 4294967296 AS tof FROM m""")
def hits_legacy_gdc_mode(spark, d):
    return H.decode_hits(event_packets(spark, d), "legacy_gdc").select("batch_offset", "x", "y", "spidertime", "tof")


@query(f"""WITH {CLOCK_SQL},
k AS (SELECT hit.*, tdc_by_tdc AS tdc, CASE WHEN tdc_by_tdc > st + 4194304 THEN st + 1073741824 ELSE st END AS ts
  FROM hit JOIN clock USING (event_id) WHERE tdc_by_tdc <> 0)
SELECT event_id AS batch_offset, x, y, tot, toa, ftoa, ts AS spidertime, CASE WHEN ts >= tdc THEN ts - tdc END AS tof FROM k""")
def hits_tdc_mode(spark, d):
    return H.decode_hits(event_packets(spark, d), "tdc").select("batch_offset", *HIT_COLUMNS)


@query(f"""WITH {CLOCK_SQL} SELECT event_id AS batch_offset, st AS spidertime,
  ((st - tdc_by_tdc % 1073741824) % 4294967296 + 4294967296) % 4294967296 AS tof FROM hit JOIN clock USING (event_id) WHERE tdc_by_tdc <> 0""")
def hits_display_mode(spark, d):
    return H.decode_hits(event_packets(spark, d), "display").select("batch_offset", "spidertime", "tof")


@query(f"""WITH {EVENTS_SQL},
a AS (SELECT event_id, st, coalesce(lag(st) OVER (ORDER BY event_id), 0) AS prev FROM hit),
b AS (SELECT *, CASE WHEN st < prev AND prev - st > 536870912 THEN 1 WHEN st >= prev AND st - prev > 536870912 THEN -1 ELSE 0 END AS d FROM a),
c AS (SELECT *, CAST(sum(d) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS s FROM b),
e AS (SELECT *, s - least(0, min(s) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING)) AS n FROM c)
SELECT event_id AS batch_offset, st + n * 1073741824 AS spidertime, (st + n * 1073741824) % 666667 AS tof FROM e""")
def hits_rollover_mode(spark, d):
    return H.decode_hits(event_packets(spark, d), "rollover").select("batch_offset", "spidertime", "tof")


@query(f"""WITH {EVENTS_SQL}, c AS (SELECT event_type, count(*) AS n FROM ev GROUP BY event_type)
SELECT 'events' AS file, CAST(sum(n) AS BIGINT) AS headers, CAST(sum(n) FILTER (WHERE event_type = 'signup') AS BIGINT) AS tdcs,
  CAST(2 * sum(n) FILTER (WHERE event_type = 'purchase') AS BIGINT) AS gdcs,
  CAST(sum(n) FILTER (WHERE event_type NOT IN ('signup', 'purchase')) AS BIGINT) AS hits,
  CAST(8 * (2 * sum(n) + sum(n) FILTER (WHERE event_type = 'purchase')) AS BIGINT) AS bytes FROM c""")
def packet_file_counts(spark, d):
    return checks.packet_counts(event_words(spark, d))


# -- binning, images, spectra -------------------------------------------------


def _bins_sql(edges: list[float], rows: str = "wh") -> str:
    table = ", ".join(f"{e!r}::DOUBLE" for e in edges)
    return f"""b AS (
  SELECT *, CASE WHEN s >= {edges[0]!r}::DOUBLE AND s < {edges[-1]!r}::DOUBLE AND n > 0 THEN CAST(n - 1 AS INTEGER) END AS bin
  FROM (SELECT *, len(list_filter([{table}], lambda e: e < s)) AS n FROM (SELECT *, tof * 25.0::DOUBLE / 1e9::DOUBLE AS s FROM {rows})))"""


@query(f"WITH {LINES_SQL}, {_bins_sql(UNIFORM)} SELECT batch_offset, seq, bin FROM b")
def tof_bin_uniform(spark, d):
    return wide_hits(spark, d).select("batch_offset", "seq", imaging.tof_bin(F.col("tof") * 25.0 / 1e9, UNIFORM).alias("bin"))


@query(f"WITH {LINES_SQL}, {_bins_sql(CUSTOM)} SELECT batch_offset, seq, bin FROM b")
def tof_bin_custom(spark, d):
    return wide_hits(spark, d).select("batch_offset", "seq", imaging.tof_bin(F.col("tof") * 25.0 / 1e9, CUSTOM).alias("bin"))


_IMAGE = f"WITH {LINES_SQL}, {_bins_sql(UNIFORM)}, img AS (SELECT bin, y, x, count(*) AS count FROM b WHERE bin IS NOT NULL GROUP BY bin, y, x)"


@query(_IMAGE + " SELECT bin, y, x, count FROM img")
def tof_image_hit(spark, d):
    return imaging.tof_image(wide_hits(spark, d), UNIFORM)


@query(f"""WITH {LINES_SQL}, {_bins_sql(CUSTOM)}
SELECT bin, CAST(round(y * 1.5) AS INTEGER) AS y, CAST(round(x * 1.5) AS INTEGER) AS x, count(*) AS count FROM b
WHERE bin IS NOT NULL AND round(x * 1.5) < 775 AND round(y * 1.5) < 775 GROUP BY ALL""")
def tof_image_super_resolution(spark, d):
    return imaging.tof_image(wide_hits(spark, d), CUSTOM, 1.5)


@query(f"WITH {LINES_SQL}, {_bins_sql(UNIFORM)} SELECT count(*) AS total, count(bin) AS binned FROM b")
def binned_totals(spark, d):
    return imaging.binned_totals(wide_hits(spark, d), UNIFORM)


def _spectrum_sql(head: str, edges: list[float]) -> str:
    table = ", ".join(f"{e!r}::DOUBLE" for e in edges)
    return f"""{head}
SELECT CAST(r.bin AS INTEGER) AS bin, ([{table}])[r.bin + 2] AS shutter_time, CAST(coalesce(sum(count), 0) AS BIGINT) AS counts
FROM range({len(edges) - 1}) r(bin) LEFT JOIN img ON img.bin = r.bin GROUP BY r.bin"""


@query(_spectrum_sql(_IMAGE, UNIFORM))
def spectrum(spark, d):
    return imaging.spectrum(imaging.tof_image(wide_hits(spark, d), UNIFORM), UNIFORM)


@query(_IMAGE + ", two AS (SELECT * FROM img UNION ALL SELECT * FROM img WHERE bin < 100) SELECT bin, y, x, CAST(sum(count) AS BIGINT) AS count FROM two GROUP BY bin, y, x")
def image_accumulate(spark, d):
    image = imaging.tof_image(wide_hits(spark, d), UNIFORM)
    return imaging.accumulate(image, image.where("bin < 100"))


@query(f"WITH {LINES_SQL} SELECT x AS ix, y AS iy, count(*) AS count FROM wh WHERE x < 512 AND y < 512 GROUP BY x, y")
def gui_histogram(spark, d):
    return imaging.histogram_2d(wide_hits(spark, d))


@query(f"""WITH {LINES_SQL}, r AS (
  SELECT CAST(trunc(x * cos(radians(-1.0::DOUBLE)) - y * sin(radians(-1.0::DOUBLE))) AS INTEGER) AS ix,
    CAST(trunc(x * sin(radians(-1.0::DOUBLE)) + y * cos(radians(-1.0::DOUBLE))) AS INTEGER) AS iy FROM wh)
SELECT ix, iy, count(*) AS count FROM r WHERE ix BETWEEN 0 AND 511 AND iy BETWEEN 0 AND 511 GROUP BY ix, iy""")
def rotated_histogram(spark, d):
    return imaging.histogram_2d(wide_hits(spark, d), rotate_degrees=-1.0)


@query(f"""WITH {LINES_SQL} SELECT CAST(trunc(tof * 0.25::DOUBLE) AS INTEGER) AS itof, count(*) AS count FROM wh
WHERE x > 250 AND x < 425 AND y > 125 AND y < 325 AND tof * 0.25 < 170000 GROUP BY itof""")
def display_tof_histogram(spark, d):
    return imaging.display_tof_histogram(wide_hits(spark, d))


# -- clusters and fits --------------------------------------------------------


def _thirds(spark, d) -> DataFrame:
    """Line hits with a label for every three of a batch."""
    return line_hits(spark, d).withColumn("label", F.floor(F.col("seq") / 3).cast("int"))


_CENTRE = f"""WITH {LINES_SQL}, c AS (SELECT *, seq // 3 AS label FROM lh)
SELECT batch_offset, CAST(label AS INTEGER) AS label, round({{x}}, 6) AS x, round({{y}}, 6) AS y, round(avg(tof), 6) AS tof,
  CAST(sum(tot) AS DOUBLE) AS tot, CAST(count(*) AS INTEGER) AS n_hits FROM c GROUP BY batch_offset, label {{having}}"""


@query(_CENTRE.format(x="sum(x * tot)::DOUBLE / sum(tot)", y="sum(y * tot)::DOUBLE / sum(tot)", having=""))
def centroid_weighted(spark, d):
    return fit.centroid(_thirds(spark, d)).select("batch_offset", "label", *_six("x", "y", "tof"), "tot", "n_hits")


@query(_CENTRE.format(x="avg(x) * 2", y="avg(y) * 2", having=""))
def centroid_unweighted(spark, d):
    return fit.centroid(_thirds(spark, d), weighted=False, scale=2.0).select("batch_offset", "label", *_six("x", "y", "tof"), "tot", "n_hits")


@query(_CENTRE.format(x="sum(x * tot)::DOUBLE / sum(tot)", y="sum(y * tot)::DOUBLE / sum(tot)", having="HAVING count(*) >= 3"))
def cluster_size_filter(spark, d):
    return fit.centroid(_thirds(spark, d), min_size=3).select("batch_offset", "label", *_six("x", "y", "tof"), "tot", "n_hits")


@query(f"""WITH {LINES_SQL}, c AS (
  SELECT *, batch_offset % 1000 AS k, median(tot) OVER (PARTITION BY batch_offset % 1000) AS m, count(*) OVER (PARTITION BY batch_offset % 1000) AS n FROM lh)
SELECT CAST(k AS BIGINT) AS label, batch_offset, seq, CAST(m AS DOUBLE) AS tot_median, CAST(tot - m AS DOUBLE) AS t FROM c WHERE n >= 8 AND tot > m""")
def tot_median_filter(spark, d):
    rows = line_hits(spark, d).withColumn("label", F.col("batch_offset") % 1000)
    return fit.above_median(rows, ("label",)).select("label", "batch_offset", "seq", "tot_median", F.col("t").cast("double").alias("t"))


_ISLANDS = f"""WITH {LINES_SQL}, k AS (SELECT *, batch_offset % 50 AS part FROM lh),
a AS (SELECT *, toa * 25.0 AS t, CASE WHEN toa * 25.0 - lag(toa * 25.0) OVER (PARTITION BY part ORDER BY toa) <= 200 THEN 0 ELSE 1 END AS fresh FROM k),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY part ORDER BY toa RANGE UNBOUNDED PRECEDING) AS raw FROM a),
c AS (SELECT *, count(*) OVER (PARTITION BY part, raw) >= 3 AS large FROM b),
e AS (SELECT *, CASE WHEN large THEN CAST(dense_rank() OVER (PARTITION BY part, large ORDER BY raw) - 1 AS INTEGER) END AS island FROM c)"""


def _islands(spark, d) -> DataFrame:
    rows = line_hits(spark, d).withColumn("part", F.col("batch_offset") % 50)
    return cluster.time_islands(rows, 200.0, 3, ("part",))


@query(_ISLANDS + " SELECT part, batch_offset, seq, island FROM e")
def time_islands(spark, d):
    return _islands(spark, d).select("part", "batch_offset", "seq", "island")


@query(_ISLANDS + """ SELECT part, island, count(*) AS n_hits, round(avg(t), 6) AS time_mean_ns, CAST(min(t) AS DOUBLE) AS time_min_ns,
  CAST(max(t) AS DOUBLE) AS time_max_ns FROM e WHERE island IS NOT NULL GROUP BY part, island""")
def island_stats(spark, d):
    stats = cluster.island_stats(_islands(spark, d), ("part",))
    return stats.select("part", "island", "n_hits", *_six("time_mean_ns"), "time_min_ns", "time_max_ns")


def _abs_sql(rows: str, slots: int, then: str) -> str:
    timed = f"h AS MATERIALIZED (SELECT *, spidertime * 25 AS t FROM {rows})"
    labelled = "lab AS (SELECT h.*, ab.label FROM h JOIN ab ON h.batch_offset = ab.batch_offset AND h.seq = ab.seq)"
    return f"WITH RECURSIVE {LINES_SQL}, {timed}, {box_sql('h', slots)}, {labelled}{then}"


_LABELS = " SELECT batch_offset, seq, label FROM lab"
_NEUTRONS = """, n AS (
  SELECT batch_offset, label, sum(x * tot)::DOUBLE / sum(tot) AS x, sum(y * tot)::DOUBLE / sum(tot) AS y, avg(tof) AS tof,
    CAST(sum(tot) AS DOUBLE) AS tot, CAST(count(*) AS INTEGER) AS n_hits
  FROM lab GROUP BY batch_offset, label HAVING sum(tot) > 0)"""


@query(_abs_sql("lh", 8, _LABELS))
def abs_cluster(spark, d):
    return cluster.cluster(line_hits(spark, d)).select("batch_offset", "seq", "label")


@query(_abs_sql("lh", 4, _LABELS))
def abs_cluster_legacy(spark, d):
    return cluster.cluster(line_hits(spark, d), cluster.LEGACY_ABS).select("batch_offset", "seq", "label")


@query(_abs_sql("dh", 8, _LABELS))
def abs_cluster_dense(spark, d):
    """Some four hundred hits a batch, so that open clusters are closed for want of slots."""
    return cluster.cluster(dense_hits(spark, d)).select("batch_offset", "seq", "label")


@query(_abs_sql("lh", 8, _NEUTRONS + " SELECT * FROM n"))
def abs_neutrons(spark, d):
    return fit.centroid(cluster.cluster(line_hits(spark, d))).drop("file")


_NEUTRON_IMAGE = _abs_sql("wh", 8, _NEUTRONS + f""", {_bins_sql(UNIFORM, "n")},
img AS (SELECT bin, round(y) AS iy, round(x) AS ix, count(*) AS count FROM b
  WHERE bin IS NOT NULL AND round(x) BETWEEN 0 AND 516 AND round(y) BETWEEN 0 AND 516 GROUP BY ALL)""")


@query(_spectrum_sql(_NEUTRON_IMAGE, UNIFORM))
def neutron_spectrum(spark, d):
    neutrons = fit.centroid(cluster.cluster(wide_hits(spark, d)))
    return imaging.spectrum(imaging.tof_image(neutrons, UNIFORM), UNIFORM)


_DISPLAY = f"""WITH RECURSIVE {LINES_SQL}, h AS MATERIALIZED (
  SELECT * REPLACE (batch_offset // 500 AS batch_offset,
    row_number() OVER (PARTITION BY batch_offset // 500 ORDER BY seq, tof, toa, x, y, tot) - 1 AS seq), spidertime AS t FROM lh),
{ring_sql('h', 128)}, lab AS (SELECT h.*, ab.label FROM h JOIN ab ON h.batch_offset = ab.batch_offset AND h.seq = ab.seq)
SELECT batch_offset, label, round(sum(x * tot) * 8.0::DOUBLE / sum(tot), 6) AS x, round(sum(y * tot) * 8.0::DOUBLE / sum(tot), 6) AS y, count(*) AS n
FROM lab GROUP BY batch_offset, label HAVING count(*) > 10"""


@query(_DISPLAY)
def display_clusters(spark, d):
    rows = line_hits(spark, d).withColumn("batch_offset", F.floor(F.col("batch_offset") / 500))
    labelled = cluster.cluster(rows, cluster.DISPLAY, order=("seq", "tof", "toa", "x", "y", "tot"))
    return imaging.accepted_clusters(labelled).select("batch_offset", "label", *_six("x", "y"), "n")


@query()
def fast_gaussian(spark, d):
    rows = line_hits(spark, d).withColumn("label", (F.col("batch_offset") % 1000).cast("int")).withColumn("batch_offset", F.lit(0).cast("long"))
    return fit.fast_gaussian(rows).select("label", *(F.round(c, 4).alias(c) for c in ("x", "y", "tof")), "tot", "n_hits")


@query()
def dbscan_events(spark, d):
    rows = line_hits(spark, d).withColumn("file", (F.col("batch_offset") % 50).cast("string"))
    return cluster.dbscan_events(cluster.dbscan(rows, 200.0, 3, 4.0, 3))


# -- checks, files ------------------------------------------------------------


@query(f"WITH {LINES_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE tof * 25.0 * 1e-6 > 5.0) AS bad FROM lh")
def bad_tof_check(spark, d):
    return checks.bad_tof(line_hits(spark, d), 5.0)


@query(f"""WITH {LINES_SQL} SELECT CAST(r AS INTEGER) AS rate_hz, count(*) FILTER (WHERE tof * 20 * 25.0::DOUBLE * 1e-6::DOUBLE > 1000.0::DOUBLE / r) AS bad
FROM lh, (VALUES (1), (10), (15), (30), (45), (60)) v(r) GROUP BY r""")
def bad_tof_by_rate(spark, d):
    return checks.bad_tof_by_rate(line_hits(spark, d).withColumn("tof", F.col("tof") * 20))


@query(f"WITH {LINES_SQL} SELECT count(*) AS hits, count(DISTINCT batch_offset) AS batches, max(spidertime) AS max_spidertime FROM lh")
def batch_stats(spark, d):
    return checks.totals(line_hits(spark, d))


@query("""SELECT 'run_' || c_custkey AS stem, '/data/run_' || c_custkey || '.tpx3' AS file FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def unprocessed_files(spark, d):
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    files = read("customer").select(F.concat(F.lit("/data/run_"), F.col("c_custkey").cast("string"), F.lit(".tpx3")).alias("file"))
    done = read("orders").select(F.concat(F.lit("run_"), F.col("o_custkey").cast("string")).alias("stem")).distinct()
    return unprocessed(files, done)


@query(f"""WITH {LINES_SQL}, c AS (SELECT *, seq // 3 AS label FROM lh)
SELECT batch_offset, CAST(label AS INTEGER) AS label, round(sum(x * tot)::DOUBLE / sum(tot), 6) AS x, round(sum(y * tot)::DOUBLE / sum(tot), 6) AS y,
  round(avg(tof) * 25, 6) AS tof_ns, sum(tot) * 25.0::DOUBLE AS tot_ns, CAST(count(*) AS DOUBLE) AS "nHits" FROM c GROUP BY batch_offset, label""")
def neutrons_ns(spark, d):
    n = fit.centroid(_thirds(spark, d))
    return n.select(
        "batch_offset", "label", *_six("x", "y"), F.round(F.col("tof") * 25.0, 6).alias("tof_ns"), (F.col("tot") * 25.0).alias("tot_ns"),
        F.col("n_hits").cast("double").alias("nHits"),
    )
