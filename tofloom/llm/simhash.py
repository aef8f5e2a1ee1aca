"""SimHash near-duplicates: fingerprints, a binary trie self-join and components.

A fingerprint's bits are the majority over the XXH64 hashes of a text's word
shingles.  Distinct fingerprints that differ in at most ``budget`` bits are
linked.  The join is distributed by pigeonhole: with one block more than the
budget, linked fingerprints agree in some block entirely, so each fingerprint
goes to one group per block.  Inside a group, fingerprints form a binary trie;
pairs of its nodes are walked together from the root, differing bits add up,
and a pair is dropped as soon as they exceed the budget.  Groups larger than
``GROUP_ROWS`` are cut once more by the same rule on the other bits.

A group emits a spanning forest of its links, never all pairs; components of
the forests follow by star contraction.

Edge cases: null and blank texts have fingerprint zero and are linked like any
other.  A text shorter than a shingle is one shingle.  Null ids take part, but
a component's id is its smallest id that isn't null.  Equal fingerprints (so
repeated rows) are joined before any link is searched.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import materialize, widen
from .components import components

BITS = 64
#: Rows of a group beyond which it is cut by a second block.
GROUP_ROWS = 200_000
#: Node pairs, or pairs of fingerprints, that are compared at once.
CHUNK = 1 << 20
#: A pair of nodes with at most so many pairs of fingerprints is compared directly.
LEAF = 64
SEGMENT = 1 << 16


def _hashes(words: list[bytes], size: int) -> Iterator[np.ndarray]:
    """XXH64 of all shingles, in segments."""
    digest = xxhash.xxh64_intdigest
    if len(words) < size:
        if words:
            yield np.array([digest(b" ".join(words), 42)], dtype=np.uint64)
        return
    for at in range(0, len(words) - size + 1, SEGMENT):
        part = words[at : at + SEGMENT + size - 1]
        line = b" ".join(part)
        ends = list(accumulate(map(len, part), lambda a, n: a + n + 1))
        starts = [0, *(e + 1 for e in ends)]
        yield np.array([digest(line[a:b], 42) for a, b in zip(starts, ends[size - 1 :])], dtype=np.uint64)


def _ones(hashes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """How often each bit is set, most significant first, by run of hashes."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)


def fingerprints_of(texts: list[str | None], size: int) -> np.ndarray:
    """Fingerprints as signed 64-bit integers."""
    ones = np.zeros((len(texts), BITS), dtype=np.int64)
    counts = np.zeros(len(texts), dtype=np.int64)
    pending: list[tuple[int, np.ndarray]] = []

    def flush() -> None:
        if pending:
            sizes = [len(h) for _, h in pending]
            cuts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            rows = [i for i, _ in pending]
            np.add.at(ones, rows, _ones(np.concatenate([h for _, h in pending]), cuts))
            np.add.at(counts, rows, sizes)
            pending.clear()

    held = 0
    for i, text in enumerate(texts):
        for hashes in _hashes((text or "").encode().lower().split(), size):
            pending.append((i, hashes))
            held += len(hashes)
            if held >= SEGMENT:
                flush()
                held = 0
    flush()
    return np.packbits(ones * 2 > counts[:, None], axis=1).view(">u8").ravel().astype(np.uint64).view(np.int64)


def add_fingerprints(docs: DataFrame, text: str = "text", size: int = 5, name: str = "__fingerprint") -> DataFrame:
    """All columns but the text, and the fingerprint as a long."""
    carry = [c for c in docs.columns if c != text]
    schema = widen(StructType([docs.schema[c] for c in carry]), {name: "long"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = fingerprints_of(batch.column(text).to_pylist(), size)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), pa.array(found)], names=schema.fieldNames())

    return docs.mapInArrow(run, schema)


# -- the join ---------------------------------------------------------------


def _blocks(bits: int, count: int) -> list[tuple[int, int]]:
    """(first bit, width) of ``count`` blocks that cover ``bits``."""
    edges = [round(k * bits / count) for k in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


class _Union:
    """Components of positions, by hooking the larger root below the smaller."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        root = self.root
        while len(i):
            a, b = root[i], root[j]
            open_ = a != b
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            if not len(i):
                break
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root[:] = up


def near_pairs(values: np.ndarray, group: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of positions inside a group whose values differ in at most ``budget`` bits (some both ways round).

    ``values`` are uint64, sorted inside each group; ``group`` is sorted.  Node
    pairs of all groups are walked together, level by level, in chunks.
    """
    n = len(values)
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    ends = np.concatenate([starts[1:], [n]])
    many = ends - starts > 1
    starts, ends = starts[many], ends[many]
    ones: dict[int, np.ndarray] = {}

    def prefix(level: int) -> np.ndarray:
        if level not in ones:
            bit = (values >> np.uint64(BITS - 1 - level)) & np.uint64(1)
            ones[level] = np.concatenate([[0], np.cumsum(bit.astype(np.int32))]).astype(np.int32)
        return ones[level]

    def leaves(a0, a1, b0, b1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        sizes = (a1 - a0) * (b1 - b0)
        at = 0
        total = np.cumsum(sizes)
        while at < len(sizes):
            stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + CHUNK, "right")))
            part = slice(at, stop)
            size = sizes[part]
            which = np.repeat(np.arange(len(size)), size)
            k = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
            wide = (b1[part] - b0[part])[which]
            i, j = a0[part][which] + k // wide, b0[part][which] + k % wide
            near = (i != j) & (np.bitwise_count(values[i] ^ values[j]) <= budget)
            yield i[near], j[near]
            at = stop

    stack = [(0, starts, ends, starts, ends, np.zeros(len(starts), dtype=np.int8))]
    while stack:
        level, a0, a1, b0, b1, differ = stack.pop()
        if len(a0) > CHUNK:
            half = len(a0) // 2
            stack += [(level, *(x[s] for x in (a0, a1, b0, b1, differ))) for s in (slice(half, None), slice(half))]
            continue
        done = ((a1 - a0) * (b1 - b0) <= LEAF) | (level == BITS)
        if done.any():
            yield from leaves(a0[done], a1[done], b0[done], b1[done])
            a0, a1, b0, b1, differ = (x[~done] for x in (a0, a1, b0, b1, differ))
        if not len(a0):
            continue
        count = prefix(level)
        am, bm = a1 - (count[a1] - count[a0]), b1 - (count[b1] - count[b0])
        own = (a0 == b0) & (a1 == b1)
        other = ~own
        parts = [
            (a0, am, b0, bm, differ),
            (am, a1, bm, b1, differ),
            (a0, am, bm, b1, differ + 1),
            (am[other], a1[other], b0[other], bm[other], differ[other] + 1),
        ]
        a0, a1, b0, b1, differ = (np.concatenate(x) for x in zip(*parts))
        live = (a1 > a0) & (b1 > b0) & (differ <= budget)
        # a node with itself needs two fingerprints
        live &= ~((a0 == b0) & (a1 == b1) & (a1 - a0 < 2))
        stack.append((level + 1, *(x[live] for x in (a0, a1, b0, b1, differ))))


def trie_links(values: np.ndarray, group: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside each group: positions (i, j)."""
    union = _Union(len(values))
    for i, j in near_pairs(values, group, budget):
        union.add(i, j)
    far = np.flatnonzero(union.root != np.arange(len(values)))
    return far, union.root[far]


def _join_sorted(budget: int):
    """Links from rows ``group, value`` that are sorted by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: list[np.ndarray] = []
        values: list[np.ndarray] = []
        held = 0

        def links(g: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(v) < 2:
                return
            order = np.lexsort((v, g))
            g, v = g[order], v[order]
            i, j = trie_links(v, g, budget)
            yield pa.RecordBatch.from_arrays([pa.array(v[i].view(np.int64)), pa.array(v[j].view(np.int64))], names=["u", "v"])

        for batch in batches:
            groups.append(batch.column("group").to_numpy(zero_copy_only=False))
            values.append(batch.column("value").to_numpy(zero_copy_only=False).view(np.uint64))
            held += batch.num_rows
            if held >= GROUP_ROWS:
                g, v = np.concatenate(groups), np.concatenate(values)
                last = int(np.searchsorted(g, g[-1]))  # the last group may go on
                yield from links(g[:last], v[:last])
                groups, values = [g[last:]], [v[last:]]
                held = len(g) - last
        if held:
            yield from links(np.concatenate(groups), np.concatenate(values))

    return run


def links(prints: DataFrame, budget: int, value: str = "__fingerprint") -> DataFrame:
    """``u, v``: a forest with the components of all links between distinct fingerprints."""

    def keys(first: list[tuple[int, int]], v):
        return F.array(*(
            (F.lit(k << 58) + (F.shiftrightunsigned(v, BITS - at - width).bitwiseAND(F.lit((1 << width) - 1)))).alias("k")
            for k, (at, width) in enumerate(first)
        ))

    blocks = _blocks(BITS, budget + 1)
    rows = prints.select(F.col(value).alias("value")).distinct()
    placed = materialize(rows.select("value", F.explode(keys(blocks, F.col("value"))).alias("group")))
    hot = placed.groupBy("group").count().where(F.col("count") > GROUP_ROWS).select("group", F.lit(True).alias("hot"))
    placed = placed.join(hot, "group", "left")
    # A hot group's members agree in its block; by the same rule they agree in one of the others' sub-blocks.
    fine = [(a, w) for at, width in blocks for a, w in ((at, width // 2), (at + width // 2, width - width // 2))]
    sub = F.array(*(
        F.xxhash64("group", F.lit(k), F.shiftrightunsigned("value", BITS - a - w).bitwiseAND(F.lit((1 << w) - 1)))
        for k, (a, w) in enumerate(fine)
    ))
    own = [F.floor(F.shiftright("group", 58)) == k // 2 for k in range(len(fine))]
    sub = F.array_compact(F.array(*(F.when(~o, sub[k]) for k, o in enumerate(own))))
    placed = placed.select("value", F.explode(F.when(F.col("hot"), sub).otherwise(F.array("group"))).alias("group"))
    found = placed.repartition("group").sortWithinPartitions("group").mapInArrow(_join_sorted(budget), "u long, v long")
    return found.distinct()


def near_duplicates(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 5, budget: int = 4
) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` of every document."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("__text"))
    prints = materialize(add_fingerprints(slim, "__text", size))
    least = prints.groupBy(F.col("__fingerprint").alias("node")).agg(F.min("doc_id").alias("least"))
    roots = materialize(components(links(prints, budget)))
    placed = least.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    table = placed.join(ids, "root").select(F.col("node").alias("__fingerprint"), "component_id")
    return prints.join(table, "__fingerprint").select(
        "doc_id", F.lpad(F.lower(F.hex("__fingerprint")), 16, "0").alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """One document of each group: the smallest id's first row; documents without id stay."""
    found = near_duplicates(docs, text, doc_id, **options)
    gone = found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("__gone")).distinct()
    left = docs.join(gone, F.col(doc_id) == F.col("__gone"), "left_anti")
    again = left.groupBy(F.col(doc_id).alias("__id")).agg(F.count("*").alias("__n")).where("__n > 1 and __id is not null")
    if again.isEmpty():
        return left
    first = left.join(again, F.col(doc_id) == F.col("__id"), "left_semi")
    rank = F.row_number().over(Window.partitionBy(doc_id).orderBy(F.xxhash64(text)))
    first = first.withColumn("__k", rank).where("__k = 1").drop("__k")
    return left.join(again, F.col(doc_id) == F.col("__id"), "left_anti").union(first)
