"""Substring dedup: repeated byte strings by windows sampled with a difference cover.

A byte goes if it is covered by a string of ``LENGTH`` bytes that also starts in
a document with a smaller id.

1. *Sampled tuples.*  Positions whose place in the document, modulo 21, lies in
   the perfect difference cover {0, 1, 4, 14, 16} are sampled.  For any two
   positions some shift below 21 takes both into the sample, so two equal
   strings of 50 bytes share a sampled tuple of 30 bytes at equal offset.
   Tuples are named by hash, sorted inside each block of documents, and merged
   by range of names.
2. A name of one document settles its tuple; only repeated names go on.
3. *Remaining suffixes.*  The suffixes (sampled or not) from which a repeated
   name is reached within 20 bytes are named to the full depth, sorted and
   merged the same way.
4. Equal names are adjacent after the merge.  Blocks are ranges of ids, so a
   suffix repeats an earlier document if its name occurs in an earlier block,
   or in its block with a smaller id.

This is not a suffix sort: names are hashes, not ranks, and nothing is ordered
by its bytes.  Tuples sorted by their bytes, front-coded and compressed, take
10.3 bytes each against 2.3 for the names.

Blocks exchange sorted, difference-coded lists of names and get back one bit per
name; texts move once (into blocks).  Whole copies of an earlier text are
settled beforehand by SHA-256.  Names of step 1 are a filter only; names of
step 3 have 96 bits, so that two different strings pass for equal with a chance
of 2^-96 a pair.

Edge cases: null texts count as empty; null ids come last and count as equal to
one another; rows with one id never repeat each other; texts below 50 bytes
keep all.  A document is in one block whole, so it must fit in memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_of

LENGTH = 50
PERIOD = 21
COVER = (0, 1, 4, 14, 16)
TUPLE = LENGTH - PERIOD + 1
#: Bytes of text in a block, and of names that one merge task gets.
BLOCK_BYTES = 8 << 20
MERGE_BYTES = 16 << 20
#: Bits that may be broadcast to the blocks; more are joined by shuffle.
BROADCAST_BYTES = 48 << 20
CHUNK = 1 << 20
LAST = 2**63 - 1
_SAMPLED = np.zeros(PERIOD, dtype=bool)
_SAMPLED[list(COVER)] = True


#: Strings hashed at once: their words stay in the processor's cache.
STEP = 1 << 13


def _lane(words: list[np.ndarray], seed: int, factor: int) -> np.ndarray:
    h = words[0] ^ np.uint64(seed)
    shifted = np.empty_like(h)
    for word in words[1:]:
        h *= np.uint64(factor)
        np.right_shift(h, np.uint64(32), out=shifted)
        h ^= shifted
        h ^= word
    for _ in range(2):
        h *= np.uint64(factor)
        np.right_shift(h, np.uint64(29), out=shifted)
        h ^= shifted
    return h


def hashes(data: np.ndarray, at: np.ndarray, length: int, checked: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """Names of 64 and checks of 32 more bits of the strings of ``length`` (8 or more) bytes at the positions ``at``.

    Every word of eight bytes is mixed in, so no algebra links the names of
    strings that are alike; a rolling polynomial modulo 2^64 has such links.
    """
    names = np.empty(len(at), np.uint64)
    checks = np.empty(len(at), np.uint32) if checked else None
    if len(at):
        every = np.ndarray(len(data) - 7, dtype="<u8", buffer=data, strides=(1,))  # the word at each byte
    for k in range(0, len(at), STEP):
        part = slice(k, k + STEP)
        words = [every[at[part] + j] for j in (*range(0, length - 8, 8), length - 8)]
        names[part] = _lane(words, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9)
        if checked:
            checks[part] = _lane(words, 0x2545F4914F6CDD1D, 0xD6E8FEB86659FD93) >> np.uint64(32)
    return names, checks


def pack(names: np.ndarray) -> bytes:
    """Sorted uint64 to compressed differences, by byte plane."""
    steps = np.diff(names, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


# -- blocks -------------------------------------------------------------------

BLOCK_SCHEMA = "block long, ids array<long>, lens array<long>, data binary, copy_ids array<long>, copy_lens array<long>"


def build_blocks(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """Documents in ascending id order, whole, in blocks of about ``BLOCK_BYTES``; one row a block."""
    rows = docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("id"), text_of(text).cast("binary").alias("data")
    )
    keyed = rows.select("id", F.sha2("data", 256).alias("sha"), F.octet_length("data").cast("long").alias("n"))
    keyed = materialize(keyed)
    total = keyed.agg(F.sum("n")).first()[0] or 0
    first = keyed.where(F.col("n") >= LENGTH).groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("k"))
    copies = keyed.join(first.where("k > 1"), "sha").where("id > first").select("id", "sha").distinct()
    marks = copies.select("id", F.lit(0).alias("kind"), F.unhex("sha").alias("data"))
    both = rows.select("id", F.lit(1).alias("kind"), "data").union(marks)
    parts = max(1, -(-total // (2 * BLOCK_BYTES)))
    both = both.repartitionByRange(parts, "id").sortWithinPartitions("id", "kind")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, seq = TaskContext.get().partitionId() << 32, 0
        ids, datas, copy_ids, copy_lens, held = [], [], [], [], 0
        now, shas = None, set()

        def block() -> pa.RecordBatch:
            columns = [[base + seq], [ids], [[len(d) for d in datas]], [b"".join(datas)], [copy_ids], [copy_lens]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            names = [f.split()[0] for f in BLOCK_SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for batch in batches:
            for i, kind, data in zip(batch.column("id").to_pylist(), batch.column("kind").to_pylist(), batch.column("data")):
                if i != now:
                    now, shas = i, set()
                    if held >= BLOCK_BYTES:
                        yield block()
                        seq += 1
                        ids, datas, copy_ids, copy_lens, held = [], [], [], [], 0
                data = data.as_py()
                if kind == 0:
                    shas.add(data)
                elif shas and hashlib.sha256(data).digest() in shas:
                    copy_ids.append(i)
                    copy_lens.append(len(data))
                else:
                    ids.append(i)
                    datas.append(data)
                    held += len(data)
        if ids or copy_ids:
            yield block()

    return materialize(both.mapInArrow(gather, BLOCK_SCHEMA))


class Block:
    def __init__(self, ids: list[int], lens: list[int], data: bytes):
        self.ids = np.array(ids, dtype=np.int64)
        self.lens = np.array(lens, dtype=np.int64)
        self.data = np.frombuffer(data, dtype=np.uint8)
        self.starts = np.concatenate([[0], np.cumsum(self.lens)])

    def chunks(self) -> Iterator[tuple[int, int]]:
        """Runs of whole documents, of about ``CHUNK`` bytes."""
        at = 0
        while at < len(self.ids):
            stop = max(at + 1, int(np.searchsorted(self.starts, self.starts[at] + CHUNK, "right")) - 1)
            yield at, min(stop, len(self.ids))
            at = stop

    def _places(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, place in it and bytes left, for each byte of a chunk."""
        doc = np.repeat(np.arange(a, b), self.lens[a:b])
        place = np.arange(self.starts[a], self.starts[b]) - self.starts[doc]
        return doc, place, self.lens[doc] - place

    def tuples(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Names of sampled tuples, and their position in the block and document."""
        found = [(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))]
        for a, b in self.chunks():
            lo, hi = self.starts[a], self.starts[b]
            doc, place, left = self._places(a, b)
            at = np.flatnonzero(_SAMPLED[place % PERIOD] & (left >= TUPLE))
            found.append((hashes(self.data[lo:hi], at, TUPLE, checked=False)[0], at + lo, doc[at]))
        return tuple(np.concatenate(x) for x in zip(*found))

    def suffixes(self, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Full-depth names and checks of the suffixes that reach a repeated tuple within the period, and their places."""
        found = [(np.empty(0, np.uint64), np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64))]
        mark = np.zeros(len(self.data) + 1, dtype=np.int8)
        mark[repeated] = 1
        for a, b in self.chunks():
            lo, hi = self.starts[a], self.starts[b]
            doc, _, left = self._places(a, b)
            upto = np.concatenate([[0], np.cumsum(mark[lo:hi], dtype=np.int32)])
            n = hi - lo
            reach = upto[np.minimum(np.arange(n) + PERIOD, n)] > upto[:n]
            at = np.flatnonzero(reach & (left >= LENGTH))
            if len(at):
                found.append((*hashes(self.data[lo:hi], at, LENGTH), at + lo, doc[at]))
        return tuple(np.concatenate(x) for x in zip(*found))


def _order(names: np.ndarray) -> np.ndarray:
    """Stable sorting order.  Low bits give way to the position, which sorts plain integers; rare wrong ties are put right."""
    bits = np.uint64(max(1, (len(names) - 1).bit_length()))
    keys = (names >> bits << bits) | np.arange(len(names), dtype=np.uint64)
    keys.sort()
    order = (keys & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    now = names[order]
    if (now[1:] < now[:-1]).any():
        tied = np.zeros(len(now), dtype=bool)
        tied[1:] = (now[1:] >> bits) == (now[:-1] >> bits)
        tied[:-1] |= tied[1:]
        at = np.flatnonzero(tied)
        order[at] = order[at][np.argsort(now[at], kind="stable")]
    return order


def _sorted(names: np.ndarray, checks: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Stable order by name and check, and which row of that order starts a new one."""
    order = _order(names)
    now = names[order]
    new = np.ones(len(names), dtype=bool)
    np.not_equal(now[1:], now[:-1], out=new[1:])
    if checks is not None:
        now = checks[order]
        other = now[1:] != now[:-1]
        if (other & ~new[1:]).any():  # two strings share a name
            order = np.lexsort((checks, names))
            new[1:] = (np.diff(names[order]) != 0) | (np.diff(checks[order]) != 0)
    return order, new


def _distinct(names: np.ndarray, ids: np.ndarray, checks: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Sorted distinct names, smallest and largest id of each, each row's place among them, and their checks.

    ``ids`` don't fall.
    """
    if not len(names):
        return names, ids, ids, np.empty(0, np.int64), checks
    order, new = _sorted(names, checks)
    heads = np.flatnonzero(new)
    first, last = order[heads], order[np.append(heads[1:], len(names)) - 1]
    place = np.empty(len(names), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    return names[first], ids[first], ids[last], place, None if checks is None else checks[first]


def _rounded(names: np.ndarray, bits: int) -> np.ndarray:
    """Names of step 1 cut to the merge range's bits and 32 more."""
    return names >> np.uint64(64 - bits - 32)


def _lists(block: int, names: np.ndarray, bits: int, width: int, checks: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """A row per merge range: the block's sorted names in it, without the range's bits, and their checks."""
    ranges = names >> np.uint64(width - bits)
    cuts = np.searchsorted(ranges, np.arange((1 << bits) + 1).astype(np.uint64))
    mask = np.uint64((1 << (width - bits)) - 1)
    rows = [(r, cuts[r], cuts[r + 1]) for r in range(1 << bits) if cuts[r + 1] > cuts[r]]
    for at in range(0, len(rows), 64):
        part = rows[at : at + 64]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r for r, _, _ in part], pa.int32()),
                pa.array([block] * len(part), pa.int64()),
                pa.array([pack(names[a:b] & mask) for _, a, b in part], pa.binary()),
                pa.array([None if checks is None else checks[a:b].astype("<u4").tobytes() for _, a, b in part], pa.binary()),
            ],
            names=["range", "block", "names", "checks"],
        )


def _merge(earlier_only: bool):
    """For each block's list, one bit per name: is it in another (or an earlier) block's list of the range?"""

    def answer(key: int, held: list[tuple[int, bytes, bytes | None]]) -> pa.RecordBatch:
        lists = [unpack(b) for _, b, _ in held]
        sizes = [len(x) for x in lists]
        names = np.concatenate(lists)
        checks = None if held[0][2] is None else np.concatenate([np.frombuffer(c, "<u4") for _, _, c in held])
        order, new = _sorted(names, checks)  # lists come in block order, so ties do
        same = ~new[1:]
        hit = np.concatenate([[False], same])
        if not earlier_only:
            hit |= np.concatenate([same, [False]])
        bits = np.empty(len(names), dtype=bool)
        bits[order] = hit
        parts = np.split(bits, np.cumsum(sizes)[:-1])
        return pa.RecordBatch.from_arrays(
            [
                pa.array([b for b, _, _ in held], pa.int64()),
                pa.array([key] * len(held), pa.int32()),
                pa.array(sizes, pa.int32()),
                pa.array([np.packbits(p).tobytes() for p in parts], pa.binary()),
            ],
            names=["block", "range", "n", "bits"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("range", "block")), batch.column("names"), batch.column("checks"))
            for r, b, blob, check in rows:
                if r != key:
                    if held:
                        yield answer(key, held)
                    key, held = r, []
                held.append((b, blob.as_py(), check.as_py()))
        if held:
            yield answer(key, held)

    return run


LIST_SCHEMA = "range int, block long, names binary, checks binary"
BITS_SCHEMA = "block long, range int, n int, bits binary"


def _exchange(lists: DataFrame, bits: int, earlier_only: bool) -> DataFrame:
    """A row per block with the answers to all its names, in order."""
    merged = lists.repartition(1 << bits, "range").sortWithinPartitions("range", "block").mapInArrow(_merge(earlier_only), BITS_SCHEMA)
    answers = merged.groupBy(F.col("block").alias("b")).agg(F.sort_array(F.collect_list(F.struct("range", "n", "bits"))).alias("answers"))
    answers = materialize(answers)
    return answers


def _with_answers(blocks: DataFrame, answers: DataFrame, *names: str) -> DataFrame:
    size = answers.select(F.sum(F.aggregate("answers", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x["bits"])))).first()[0]
    own = answers.select("b", *(F.col("answers").alias(n) for n in names))
    own = F.broadcast(own) if (size or 0) <= BROADCAST_BYTES else own
    return blocks.join(own, F.col("block") == F.col("b"), "left").drop("b")


def _bits(answers) -> np.ndarray:
    parts = [np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=x["n"]) for x in answers or []]
    return np.concatenate(parts).astype(bool) if parts else np.empty(0, dtype=bool)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Block]]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = {n: batch.column(n)[k].as_py() for n in batch.schema.names}
            yield row, Block(row["ids"], row["lens"], row["data"])


def _repeated(own: Block, answers, bits: int) -> np.ndarray:
    """Positions of sampled tuples whose name is another document's too."""
    names, where, doc = own.tuples()
    _, low, high, place, _ = _distinct(_rounded(names, bits), own.ids[doc])
    return where[(_bits(answers) | (low < high))[place]]


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep_bytes: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and ``kept`` (the bytes, null without ``keep_bytes``)."""
    blocks = build_blocks(docs, text, doc_id)
    total = blocks.agg(F.sum(F.octet_length("data").cast("long"))).first()[0] or 0
    bits = max(1, min(31, int(total // MERGE_BYTES).bit_length()))

    def first(batches):
        for row, own in _blocks(batches):
            names, _, doc = own.tuples()
            yield from _lists(row["block"], _distinct(_rounded(names, bits), own.ids[doc])[0], bits, bits + 32)

    columns = ["block", "ids", "lens", "data"]
    answers = _exchange(blocks.select(*columns).mapInArrow(first, LIST_SCHEMA), bits, earlier_only=False)
    once = _with_answers(blocks, answers, "tuples")

    def second(batches):
        for row, own in _blocks(batches):
            names, checks, _, doc = own.suffixes(_repeated(own, row["tuples"], bits))
            names, _, _, _, checks = _distinct(names, own.ids[doc], checks)
            yield from _lists(row["block"], names, bits, 64, checks)

    answers = _exchange(once.select(*columns, "tuples").mapInArrow(second, LIST_SCHEMA), bits, earlier_only=True)
    twice = _with_answers(once, answers, "suffixes")

    def last(batches):
        for row, own in _blocks(batches):
            names, checks, where, doc = own.suffixes(_repeated(own, row["tuples"], bits))
            _, low, _, place, _ = _distinct(names, own.ids[doc], checks)
            gone = where[_bits(row["suffixes"])[place] | (own.ids[doc] > low[place])] if len(names) else where
            edge = np.zeros(len(own.data) + LENGTH + 1, dtype=np.int32)
            edge[gone] += 1
            edge[gone + LENGTH] -= 1
            covered = np.cumsum(edge[: len(own.data)]) > 0
            out = []
            for k, i in enumerate(own.ids.tolist()):
                a, b = own.starts[k], own.starts[k + 1]
                cover = covered[a:b]
                kept = own.data[a:b][~cover].tobytes() if cover.any() else own.data[a:b].tobytes()
                spans = int(np.count_nonzero(cover[1:] & ~cover[:-1])) + bool(len(cover) and cover[0])
                out.append((i, int(b - a), int(b - a) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
            out += [(i, n, n, 1, hashlib.sha256(b"").hexdigest(), b"") for i, n in zip(row["copy_ids"], row["copy_lens"])]
            for at in range(0, len(out), 1024):
                ids, sizes, removed, spans, shas, kept = zip(*out[at : at + 1024])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([None if i == LAST else i for i in ids], pa.int64()),
                        *(pa.array(x, pa.int64()) for x in (sizes, removed, spans)),
                        pa.array(shas, pa.string()),
                        pa.array(kept if keep_bytes else [None] * len(ids), pa.binary()),
                    ],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
                )

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return twice.mapInArrow(last, schema)
