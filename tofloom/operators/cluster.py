"""Clustering of hits: adaptive boxes (order-dependent) and density (DBSCAN).

The box search keeps a few open clusters per packet batch and looks at hits in
stored order, so it runs as a kernel over partitions sorted by batch.  The
kernel steps through all batches of an Arrow chunk at once: step k handles the
k-th hit of every batch with numpy; what few long batches remain are finished
one by one.  A batch has at most 8191 hits (its size field has 16 bits), which
bounds what is carried from one record batch to the next.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

#: Below so many batches, a step in numpy costs more than single hits do.
NARROW = 48


@dataclass(frozen=True)
class BoxSearch:
    """Parameters of the adaptive box search.

    ``policy``: ``oldest`` closes the open cluster with the earliest first hit;
    ``fifo`` closes them in the order of opening (a ring of ``slots`` entries,
    of which one stays free).
    """

    radius: float = 5.0
    time_range: int = 75
    slots: int = 8
    policy: str = "oldest"
    strict: bool = False

    def label(self, key: np.ndarray, x: np.ndarray, y: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Labels of hits, by runs of equal ``key``; ``t`` in ns."""
        n = len(key)
        labels = np.empty(n, dtype=np.int32)
        if not n:
            return labels
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.concatenate([starts, [n]]))
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        if self.policy == "fifo":
            for a, size in zip(starts, sizes):
                labels[a : a + size] = self._ring(x[a : a + size], y[a : a + size], t[a : a + size])
            return labels
        k, m, width = 0, len(starts), self.slots
        box = np.zeros((4, m, width), dtype=np.int64)
        first = np.zeros((m, width), dtype=np.int64)
        label = np.tile(np.arange(width, dtype=np.int32), (m, 1))
        used = np.zeros((m, width), dtype=bool)
        following = np.full(m, width, dtype=np.int32)
        live = int(np.searchsorted(-sizes, 0, "left"))
        while True:
            live = int(np.searchsorted(-sizes, -k, "left"))
            if live < NARROW:
                break
            at = starts[:live] + k
            hx, hy, ht = x[at], y[at], t[at]
            x0, x1, y0, y1 = (b[:live] for b in box)
            near = self._near(hx[:, None], hy[:, None], ht[:, None], x0, x1, y0, y1, first[:live])
            open_ = used[:live]
            fits = ~open_ | near
            slot = fits.argmax(axis=1)
            rows = np.arange(live)
            found = fits[rows, slot]
            evict = ~found
            if evict.any():
                slot[evict] = first[:live][evict].argmin(axis=1)
                label[rows[evict], slot[evict]] = following[rows[evict]]
                following[rows[evict]] += 1
            fresh = evict | ~open_[rows, slot]
            fr, fs = rows[fresh], slot[fresh]
            for b, h in zip(box, (hx, hx, hy, hy)):
                b[fr, fs] = h[fresh]
            first[fr, fs] = ht[fresh]
            used[fr, fs] = True
            jr, js = rows[~fresh], slot[~fresh]
            for b, h, pick in zip(box, (hx, hx, hy, hy), (np.minimum, np.maximum, np.minimum, np.maximum)):
                b[jr, js] = pick(b[jr, js], h[~fresh])
            labels[at] = label[rows, slot]
            k += 1
        for row in range(live):
            a, size = int(starts[row]) + k, int(sizes[row]) - k
            state = [
                [*(int(b[row, s]) for b in box), int(first[row, s]), int(label[row, s])] for s in range(width) if used[row, s]
            ]
            labels[a : a + size] = self._one(
                x[a : a + size].tolist(), y[a : a + size].tolist(), t[a : a + size].tolist(), state, int(following[row])
            )
        return labels

    def _near(self, hx, hy, ht, x0, x1, y0, y1, first):
        r, apart = self.radius, np.abs(ht - first)
        in_time = apart < self.time_range if self.strict else apart <= self.time_range
        return in_time & (hx >= x0 - r) & (hx <= x1 + r) & (hy >= y0 - r) & (hy <= y1 + r)

    def _one(self, xs: list, ys: list, ts: list, state: list[list], following: int) -> list[int]:
        """The rest of one batch; a slot is [x0, x1, y0, y1, first time, label]."""
        r, span, width, out = self.radius, self.time_range, self.slots, []
        for hx, hy, ht in zip(xs, ys, ts):
            for s in state:
                if abs(ht - s[4]) <= span and s[0] - r <= hx <= s[1] + r and s[2] - r <= hy <= s[3] + r:
                    if hx < s[0]:
                        s[0] = hx
                    if hx > s[1]:
                        s[1] = hx
                    if hy < s[2]:
                        s[2] = hy
                    if hy > s[3]:
                        s[3] = hy
                    out.append(s[5])
                    break
            else:
                if len(state) < width:
                    state.append([hx, hx, hy, hy, ht, len(state)])
                    out.append(len(state) - 1)
                else:
                    oldest = min(range(width), key=lambda k: (state[k][4], k))
                    state[oldest] = [hx, hx, hy, hy, ht, following]
                    out.append(following)
                    following += 1
        return out

    def _ring(self, x: np.ndarray, y: np.ndarray, t: np.ndarray) -> np.ndarray:
        r, slots = self.radius, self.slots
        ring: list = [None] * slots
        head = tail = 0
        out, following = [], 0
        for hx, hy, ht in zip(x.tolist(), y.tolist(), t.tolist()):
            for s in ring:
                if s is None:
                    continue
                apart = abs(ht - s[4])
                if (apart < self.time_range if self.strict else apart <= self.time_range) and s[0] - r <= hx <= s[1] + r and s[2] - r <= hy <= s[3] + r:
                    s[0], s[1], s[2], s[3] = min(s[0], hx), max(s[1], hx), min(s[2], hy), max(s[3], hy)
                    out.append(s[5])
                    break
            else:
                if (head + 1) % slots == tail:
                    ring[tail] = None
                    tail = (tail + 1) % slots
                ring[head] = [hx, hx, hy, hy, ht, following]
                head = (head + 1) % slots
                out.append(following)
                following += 1
        return np.array(out, dtype=np.int32)


ABS = BoxSearch()
LEGACY_ABS = BoxSearch(slots=4)
#: Time in ticks: a difference below 3 joins; 128 ring entries.
DISPLAY = BoxSearch(radius=5, time_range=3, slots=128, policy="fifo", strict=True)


def _labelled(search: BoxSearch, keys: tuple[str, ...], ns: float, schema: StructType) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def label(table: pa.Table) -> Iterator[pa.RecordBatch]:
            table = table.combine_chunks()
            key = _runs([table[k].combine_chunks() for k in keys])
            t = table["spidertime"].to_numpy() * int(ns)
            found = search.label(key, table["x"].to_numpy(), table["y"].to_numpy(), t)
            yield from table.append_column("label", pa.array(found, pa.int32())).select(schema.fieldNames()).to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table])
            key = _runs([table[k].combine_chunks() for k in keys])
            cut = int(np.searchsorted(key, key[-1]))  # the last batch may go on
            rest = table.slice(cut)
            if cut:
                yield from label(table.slice(0, cut))
        if rest is not None and rest.num_rows:
            yield from label(rest)

    return run


def _runs(columns: list[pa.Array]) -> np.ndarray:
    """Number of the run of equal rows that each row is in."""
    new = np.zeros(len(columns[0]), dtype=bool)
    for c in columns:
        code = c.dictionary_encode().indices.to_numpy(zero_copy_only=False) if pa.types.is_string(c.type) else c.to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return np.cumsum(new)


def cluster(
    hits: DataFrame,
    search: BoxSearch = ABS,
    keys: tuple[str, ...] = ("file", "batch_offset"),
    order: tuple[str, ...] = ("seq",),
    in_order: bool = False,
) -> DataFrame:
    """Hits with an int ``label`` per batch, from 0 in the order of opening.

    ``in_order``: partitions already hold whole batches in order (as the packet
    source gives them), so nothing is shuffled or sorted.
    """
    if not in_order:
        hits = hits.repartition(*keys).sortWithinPartitions(*keys, *order)
    schema = StructType([*hits.schema.fields]).add("label", IntegerType())
    ns = 1.0 if search.policy == "fifo" else 25.0
    return hits.mapInArrow(_labelled(search, keys, ns, schema), schema)


def numbered_batches(hits: DataFrame, size: int = 10_000, keys: tuple[str, ...] = ("file",), order: tuple[str, ...] = ("batch_offset", "seq")) -> DataFrame:
    """Replaces packet batches by runs of ``size`` hits of a file: ``batch_offset`` and ``seq`` are renumbered."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    hits = hits.withColumn("__n", n.cast("long"))
    return hits.withColumns({"batch_offset": F.floor(F.col("__n") / size), "seq": (F.col("__n") % size).cast("int")}).drop("__n")


# -- DBSCAN -------------------------------------------------------------------


def time_islands(
    hits: DataFrame, eps: float, min_points: int, keys: tuple[str, ...] = ("file",), time: str = "toa", ns: float = 25.0
) -> DataFrame:
    """Hits with ``island`` (from 0 by time, per key) where gaps are at most ``eps`` ns and members enough; else null.

    Hits of one time share an island, so the windows see each time of a key once:
    16,384 rows a key at most for ``toa``.  A time with more bits has more of them.
    """
    by = [*keys, time]
    rows = hits.groupBy(*by).agg(F.count("*").alias("__n"))
    t = F.col(time).cast("double") * ns
    w = Window.partitionBy(*keys).orderBy(time)
    gap = t - F.lag(t).over(w)
    rows = rows.withColumn("__new", F.when(gap.isNull() | (gap > eps), 1).otherwise(0))
    rows = rows.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.withColumn("__size", F.sum("__n").over(Window.partitionBy(*keys, "__island")))
    rows = rows.withColumn("__large", F.col("__size") >= min_points)
    rank = F.dense_rank().over(Window.partitionBy(*keys, "__large").orderBy("__island")) - 1
    rows = rows.withColumn("island", rank).where("__large").select(*(F.col(k).alias(f"__{k}") for k in by), "island")
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in by]
    return hits.join(rows, same, "left").select(*hits.columns, "island")


def island_stats(islands: DataFrame, keys: tuple[str, ...] = ("file",), time: str = "toa", ns: float = 25.0) -> DataFrame:
    """Per island: size, mean, least and greatest time in ns."""
    t = F.col(time).cast("double") * ns
    return islands.where("island IS NOT NULL").groupBy(*keys, "island").agg(
        F.count("*").alias("n_hits"), F.avg(t).alias("time_mean_ns"), F.min(t).alias("time_min_ns"), F.max(t).alias("time_max_ns")
    )


def dbscan_places(x: np.ndarray, y: np.ndarray, weight: np.ndarray, eps: float, min_points: int) -> np.ndarray:
    """Textbook DBSCAN of different places in the plane that hold ``weight`` points each, in the order of their first points.

    A point counts itself; border points join the first cluster that reaches them; noise is -1.
    Points of one place have the same neighbours, so a label per place is a label per point,
    and neighbours are looked up once or twice a place, in a grid of cells of side ``eps``.
    """
    n = len(x)
    labels = np.full(n, -1, dtype=np.int64)
    cells: dict[tuple[int, int], list[int]] = {}
    cx, cy = np.floor(x / eps).astype(int).tolist(), np.floor(y / eps).astype(int).tolist()
    for i, cell in enumerate(zip(cx, cy)):
        cells.setdefault(cell, []).append(i)
    members = {c: np.array(v) for c, v in cells.items()}

    def neighbours(i: int) -> np.ndarray:
        near = [members[c] for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (c := (cx[i] + dx, cy[i] + dy)) in members]
        near = np.concatenate(near)
        return near[(x[near] - x[i]) ** 2 + (y[near] - y[i]) ** 2 <= eps * eps]

    core = np.fromiter((weight[neighbours(i)].sum() >= min_points for i in range(n)), dtype=bool, count=n)
    current = 0
    for i in np.flatnonzero(core).tolist():
        if labels[i] != -1:
            continue
        labels[i] = current
        queue = [i]  # holds a place once at most
        while queue:
            near = neighbours(queue.pop())
            fresh = near[labels[near] == -1]
            labels[fresh] = current
            queue.extend(fresh[core[fresh]].tolist())
        current += 1
    return labels


def dbscan_xy(x: np.ndarray, y: np.ndarray, eps: float, min_points: int) -> np.ndarray:
    """:func:`dbscan_places` of points, a label per point."""
    _, first, place, weight = np.unique(np.stack([x, y]), axis=1, return_index=True, return_inverse=True, return_counts=True)
    order = np.argsort(first)
    labels = np.empty(len(first), dtype=np.int64)
    labels[order] = dbscan_places(x[first[order]], y[first[order]], weight[order], eps, min_points)
    return labels[place.reshape(-1)]


def dbscan(
    hits: DataFrame, eps_time: float, min_points_time: int, eps_xy: float, min_points_xy: int,
    keys: tuple[str, ...] = ("file",), order: tuple[str, ...] = ("batch_offset", "seq"),
) -> DataFrame:
    """Hits with ``label``: -1 for noise, else numbered by island and first member, per key.

    Python sees each place of an island once, however many hits it has: a task
    holds as many rows as the canvas has pixels, at most.
    """
    rows = time_islands(hits, eps_time, min_points_time, keys)
    by = [*keys, "island"]
    places = rows.where("island IS NOT NULL").groupBy(*by, "x", "y").agg(F.count("*").alias("__n"), F.min(F.struct(*order)).alias("__first"))
    places = places.repartition(*by).sortWithinPartitions(*by, "__first").select(*by, "x", "y", "__n")
    schema = StructType([*places.schema.fields]).add("local", IntegerType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []

        def label(table: pa.Table, key: np.ndarray) -> Iterator[pa.RecordBatch]:
            x, y, n = table["x"].to_numpy().astype(float), table["y"].to_numpy().astype(float), table["__n"].to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
            found = np.concatenate([dbscan_places(x[a:b], y[a:b], n[a:b], eps_xy, min_points_xy) for a, b in zip(cuts, cuts[1:])])
            yield from table.append_column("local", pa.array(found, pa.int32())).combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*rest, batch]).combine_chunks()
            key = _runs([table[k].combine_chunks() for k in by])
            cut = int(np.searchsorted(key, key[-1]))  # the last island may go on
            rest = table.slice(cut).combine_chunks().to_batches()
            if cut:
                yield from label(table.slice(0, cut), key[:cut])
        if rest:
            table = pa.Table.from_batches(rest)
            yield from label(table, _runs([table[k].combine_chunks() for k in by]))

    found = places.mapInArrow(run, schema)
    upto = Window.partitionBy(*keys).orderBy("island").rowsBetween(Window.unboundedPreceding, -1)
    sizes = found.groupBy(*by).agg((F.max("local") + 1).alias("__size"))
    sizes = sizes.withColumn("__base", F.coalesce(F.sum("__size").over(upto), F.lit(0))).drop("__size")
    found = found.where("local >= 0").join(sizes, by)
    found = found.select(*by, "x", "y", (F.col("__base") + F.col("local")).cast("int").alias("__label"))
    rows = rows.join(found, [*by, "x", "y"], "left")
    return rows.select(*hits.columns, F.coalesce("__label", F.lit(-1)).alias("label"))


def dbscan_events(labelled: DataFrame, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """Unweighted centroid, mean arrival time in ns and size of each cluster."""
    return labelled.where("label >= 0").groupBy(*keys, "label").agg(
        F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg(F.col("toa") * 25.0).alias("time_mean_ns"), F.count("*").cast("int").alias("n_hits")
    )


CLUSTERERS = {
    "abs": lambda hits, **o: cluster(hits, BoxSearch(**o)),
    "abs_legacy": lambda hits, **o: cluster(hits, BoxSearch(slots=4, **o)),
    "display": lambda hits, **o: cluster(hits, DISPLAY, **o),
    "dbscan": dbscan,
}


def by_name(method: str) -> Callable[..., DataFrame]:
    try:
        return CLUSTERERS[method]
    except KeyError:
        raise ValueError(f"unknown clustering method {method}") from None
