"""Near copies: texts whose sets of word shingles have a Jaccard similarity of 4/5 or more.

Candidates come from SimHash fingerprints and their binary trie self-join.  At
0.8 the fingerprints of whole texts lie 9 of 64 bits apart in the median, too
far for a join, so a text has several: that of all its shingles, joined at
``BUDGET`` bits, and ``BANDS`` more, each the majority over ``ROWS`` shingles
drawn by min-hashes, joined at ``DRAWN_BUDGET`` bits.  Two texts that draw the
same shingles have the same fingerprint: a pair at 0.8 is missed with a chance
of (1 - 0.8^4)^24 = 3e-6 at most, less above.  Every candidate pair is then
verified on the shingles themselves, so nothing below 4/5 is linked.

As in op3's join, a fingerprint is posted under each of budget + 1 blocks of
its bits, one of which near fingerprints share.

Texts with the same words are one node.  A first round verifies a spanning
forest of each group's links only; a second all pairs of the join whose members
are still in different components, so that large groups of copies don't
lead to all their pairs.  Before texts move, pairs are dropped whose sizes rule
4/5 out, or of whose 64 min-hash bits over ``FAR`` differ (a pair at 0.8 has
6.4 in the mean, standard deviation 2.4).

Edge cases: null counts as empty; a text shorter than a shingle is one shingle;
texts without words are copies of each other.  Rows are decided one by one, so
ids may repeat or be null: of a component the smallest id's row stays (null
last, then by hash of the text).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_of
from .components import components
from .simhash import BITS, SEGMENT, _blocks, _hashes, _ones, near_pairs, trie_links

BANDS, ROWS = 24, 4
#: Differing bits at which fingerprints of whole texts, and of drawn shingles, are candidates.
BUDGET, DRAWN_BUDGET = 4, 1
#: Differing min-hash bits beyond which a pair isn't verified.
FAR = 22
#: Postings that are joined at once.
CHUNK = 1 << 20

_seeds = np.random.default_rng(20).integers(0, 1 << 64, (2, BANDS * ROWS), dtype=np.uint64)
_XOR, _MULTIPLY = _seeds[0], _seeds[1] | np.uint64(1)
_INVERSE = np.array([pow(int(m), -1, 1 << 64) for m in _MULTIPLY], dtype=np.uint64)
_NONE = np.uint64(2**64 - 1)


def min_hashes(hashes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """``BANDS * ROWS`` min-hashes of every run of shingle hashes."""
    columns = [np.minimum.reduceat((hashes ^ x) * m, cuts) for x, m in zip(_XOR, _MULTIPLY)]
    return np.stack(columns, axis=1)


def signatures(texts: list[str | None], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Min-hashes, numbers of distinct shingles and SimHash fingerprints of the texts."""
    least = np.full((len(texts), BANDS * ROWS), _NONE)
    sizes = np.zeros(len(texts), dtype=np.int64)
    ones = np.zeros((len(texts), BITS), dtype=np.int64)
    counts = np.zeros(len(texts), dtype=np.int64)
    pending: list[tuple[int, np.ndarray]] = []

    def flush() -> None:
        if pending:
            cuts = np.concatenate([[0], np.cumsum([len(h) for _, h in pending])[:-1]])
            hashes, rows = np.concatenate([h for _, h in pending]), [i for i, _ in pending]
            np.add.at(ones, rows, _ones(hashes, cuts))
            np.add.at(counts, rows, [len(h) for _, h in pending])
            for i, row in zip(rows, min_hashes(hashes, cuts)):
                np.minimum(least[i], row, out=least[i])
            pending.clear()

    held = 0
    for i, text in enumerate(texts):
        parts = list(_hashes((text or "").encode().lower().split(), size))
        if parts:
            sizes[i] = len(np.unique(np.concatenate(parts)))
        for hashes in parts:
            pending.append((i, hashes))
            held += len(hashes)
            if held >= SEGMENT:
                flush()
                held = 0
    flush()
    whole = np.packbits(ones * 2 > counts[:, None], axis=1).view(">u8").astype(np.uint64)
    return least, sizes, np.concatenate([whole, _drawn(least)], axis=1)


def _drawn(least: np.ndarray) -> np.ndarray:
    """A SimHash fingerprint per band: the bits set in over half the shingle hashes that its min-hashes draw."""
    drawn = ((least * _INVERSE) ^ _XOR).reshape(len(least), ROWS, BANDS)
    bits = np.unpackbits(drawn.astype(">u8").view(np.uint8).reshape(len(least), ROWS, BANDS, 8), axis=3)
    return np.packbits(2 * bits.sum(axis=1, dtype=np.uint8) > ROWS, axis=2).view(">u8").reshape(len(least), BANDS).astype(np.uint64)


def _sketch(least: np.ndarray) -> np.ndarray:
    bits = (least[:, :64] & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64).view(np.int64)


def _sign(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            least, sizes, prints = signatures(texts, size)
            same = [xxhash.xxh3_128_digest(b" ".join((t or "").encode().lower().split())) for t in texts]
            prints = pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32) * (BANDS + 1), prints.view(np.int64).ravel())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(same, pa.binary()), pa.array(sizes), pa.array(_sketch(least)), prints],
                names=["row", "same", "size", "sketch", "prints"],
            )

    return run


def _joined(key: np.ndarray, value: np.ndarray, root: np.ndarray, budget: int, first: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions from the trie join of groups sorted by key and value: a forest at first, then all between components."""
    if not first:
        for i, j in near_pairs(value, key, budget):
            open_ = (i < j) & (root[i] != root[j])
            yield i[open_], j[open_]
        return
    heads = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (value[1:] != value[:-1])]))
    head = np.repeat(heads, np.diff(np.append(heads, len(key))))
    copies = np.flatnonzero(head != np.arange(len(key)))
    yield head[copies], copies
    i, j = trie_links(value[heads], key[heads], budget)
    yield heads[i], heads[j]


def _candidates(first: bool):
    """Pairs worth verifying, from postings that are sorted by key; odd keys are those of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def emit(key, value, row, root, size, sketch) -> Iterator[pa.RecordBatch]:
            order = np.lexsort((row, value, key))
            cols = [c[order] for c in (key, value, row, root, size, sketch)]
            starts = np.flatnonzero(np.concatenate([[True], cols[0][1:] != cols[0][:-1]]))
            several = np.diff(np.append(starts, len(key))) > 1
            if not first:
                several &= np.minimum.reduceat(cols[3], starts) != np.maximum.reduceat(cols[3], starts)
            several = np.repeat(several, np.diff(np.append(starts, len(key))))
            for odd, budget in ((1, BUDGET), (0, DRAWN_BUDGET)):
                own = several & (cols[0] & 1 == odd)
                if not own.any():
                    continue
                k, v, r, c, s, x = (col[own] for col in cols)
                for i, j in _joined(k, v, c, budget, first):
                    near = 5 * np.minimum(s[i], s[j]) >= 4 * np.maximum(s[i], s[j])
                    near &= np.bitwise_count((x[i] ^ x[j]).view(np.uint64)) <= FAR
                    i, j = r[i[near]], r[j[near]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j))], names=["u", "v"])

        count = 0
        for batch in batches:
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "value", "row", "root", "size", "sketch")]
            now[1] = now[1].view(np.uint64)
            held.append(now)
            count += len(now[0])
            if count < CHUNK or now[0][-1] == held[0][0][0]:  # or one group goes on
                continue
            cols = [np.concatenate(c) for c in zip(*held)]
            last = int(np.flatnonzero(cols[0] != cols[0][-1])[-1]) + 1
            yield from emit(*(c[:last] for c in cols))
            held, count = [[c[last:] for c in cols]], len(cols[0]) - last
        if count:
            yield from emit(*(np.concatenate(c) for c in zip(*held)))

    return run


def shingle_set(text: str | None, size: int) -> set[bytes]:
    words = (text or "").encode().lower().split()
    if len(words) < size:
        return {b" ".join(words)} if words else set()
    return {b" ".join(words[k : k + size]) for k in range(len(words) - size + 1)}


def _verify(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                s, t = shingle_set(a, size), shingle_set(b, size)
                good.append(9 * len(s & t) >= 4 * (len(s) + len(t)))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("u").filter(keep), batch.column("v").filter(keep)], names=["u", "v"])

    return run


def _verified(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """The pairs with a Jaccard of 4/5 or more; only texts of candidates move."""
    ends = pairs.select(F.col("u").alias("row")).union(pairs.select(F.col("v").alias("row"))).distinct()
    texts = materialize(texts.join(ends, "row", "left_semi"))
    both = pairs.join(texts.select(F.col("row").alias("u"), F.col("__text").alias("a")), "u")
    both = both.join(texts.select(F.col("row").alias("v"), F.col("__text").alias("b")), "v")
    return both.select("u", "v", "a", "b").mapInArrow(_verify(size), "u long, v long")


def _keys(budget: int, odd: int) -> Column:
    """Keys of a fingerprint's blocks: near fingerprints share one."""
    parts = (F.shiftrightunsigned("value", BITS - at - width).bitwiseAND(F.lit((1 << width) - 1)) for at, width in _blocks(BITS, budget + 1))
    return F.array(*(F.xxhash64("k", F.lit(n), part).bitwiseAND(F.lit(-2)).bitwiseOR(F.lit(odd)) for n, part in enumerate(parts)))


def links(prints: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """Verified links ``u, v`` whose components are those of all pairs found; a row of each distinct text takes part."""
    nodes = prints.groupBy("same").agg(F.min("row").alias("row"))
    nodes = prints.join(nodes.select("row"), "row", "left_semi")
    posted = nodes.select("row", "size", "sketch", F.posexplode("prints").alias("k", "value"))
    posted = materialize(posted.withColumn("key", F.explode(F.when(F.col("k") == 0, _keys(BUDGET, 1)).otherwise(_keys(DRAWN_BUDGET, 0)))).drop("k"))
    # blocks of a single text lead to nothing
    shared = posted.groupBy("key").agg(F.count("*").alias("__n")).where("__n > 1").select("key")
    posted = materialize(posted.join(shared, "key", "left_semi"))

    def search(rows: DataFrame, first_only: bool) -> DataFrame:
        rows = rows.select("key", "value", "row", "root", "size", "sketch").repartition("key").sortWithinPartitions("key")
        return rows.mapInArrow(_candidates(first_only), "u long, v long").distinct()

    tried = materialize(search(posted.withColumn("root", F.col("row")), True))
    found = materialize(_verified(tried, texts, size))
    roots = components(found).select(F.col("node").alias("row"), "root")
    rows = posted.join(roots, "row", "left").withColumn("root", F.coalesce("root", "row"))
    more = materialize(search(rows, False).join(tried, ["u", "v"], "left_anti"))
    return found.union(_verified(more, texts, size))


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 5) -> DataFrame:
    """One document of each component of near copies."""
    numbered = materialize(docs.withColumn("__row", F.monotonically_increasing_id()))
    texts = numbered.select(F.col("__row").alias("row"), text_of(text).alias("__text"))
    prints = materialize(texts.mapInArrow(_sign(size), "row long, same binary, size long, sketch long, prints array<long>"))
    roots = materialize(components(links(prints, texts, size)))
    nodes = prints.groupBy("same").agg(F.min("row").alias("row"), F.count("*").alias("n"))
    nodes = nodes.join(roots.select(F.col("node").alias("row"), "root"), "row", "left").where("n > 1 or root is not null")
    members = prints.select("row", "same").join(nodes.select("same", F.coalesce("root", "row").alias("root")), "same")
    order = numbered.select(
        F.col("__row").alias("row"), F.struct(F.col(doc_id).isNull(), F.col(doc_id), F.xxhash64(text_of(text)), "__row").alias("at")
    )
    members = materialize(members.join(order, "row").select("row", "root", "at"))
    stay = members.groupBy("root").agg(F.min_by("row", "at").alias("stay"))
    gone = members.join(stay, "root").where("row != stay").select(F.col("row").alias("__gone"))
    return numbered.join(gone, F.col("__row") == F.col("__gone"), "left_anti").select(*docs.columns)
