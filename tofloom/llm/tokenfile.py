"""Token ids in binary files, compressed with static range asymmetric numeral systems (rANS).

Three steps, each a distributed job:

1. Texts are tokenised and the ids of a document, with its end id, are written
   to the shared folder.
2. One frequency table over all ids is counted and scaled to 2^20 slots (at
   least one for each id that occurs).  The table has a row per id of the
   vocabulary, which bounds what the tasks are given.
3. Documents are range-partitioned and sorted by ``doc_id`` into shards of about
   ``SHARD_TOKENS``; a shard becomes a file, or several where it is larger, of
   independent blocks of up to ``BLOCK_TOKENS`` ids, coded by ``LANES``
   interleaved 64-bit states with 32-bit words.

File layout, little-endian: ``magic b"TRNS", u32 version, u64 tokens, u64
documents, u32 blocks, u32 table CRC``, then for each block its checkpoint
``u64 first token, u64 byte offset, u32 bytes, u32 tokens, u32 CRC of the ids``,
then the document index (ids, token counts), then the blocks.  A block holds its lanes'
final states and its words, so any block can be decoded alone.  Reading checks
every CRC.

Edge cases: null texts count as empty (only the end id); documents with a null
id come first; repeated ids keep their order by text digest; an empty table gives no files.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import discard, materialize, shared_dir, widen
from .wordcache import Learnt, WordCache, cut, joined, merged, steps

SCALE = 20
LANES = 2048
BLOCK_TOKENS = 1 << 19
SHARD_TOKENS = 1 << 22
#: Words, and pieces of words, that one worker remembers; the rarer ones go when they are full.
CACHE, PIECES = 600_000, 900_000
LOW = np.uint64(1 << 31)
MAGIC = b"TRNS"
#: Files whose positions (24 bytes each) may be broadcast.
BROADCAST_FILES = 200_000

# -- tokenising ---------------------------------------------------------------

#: Characters for which Python's lower case and the pattern below agree with the library's.
_PLAIN = regex.compile(r"[\x00-\x7e\xa1-\xb4\xb6-įĲ-ňŊ-ž]*")
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_PARTS = regex.compile(_PIECES.pattern + "| ")


class WordCoder:
    """Ids of whole texts, from cached ids of their words.

    A tokenizer qualifies for the cache if it normalises by NFC, white space and
    lower case and splits with the pattern above, so that words between ASCII
    white space, and pieces inside words, are coded by themselves; any other
    one gets whole texts.  Words with unusual characters or with a special
    token's text go to the library whole.
    """

    EXPECTED = ["NFC", "Replace", "Lowercase"]

    def __init__(self, path: str):
        self.library = tokenizers.Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        normal = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        pattern = split.get("pattern", {}).get("Regex", "").replace(r"[\p{L}]", r"\p{L}").replace(r"[\p{N}]", r"\p{N}")
        added = spec.get("added_tokens", [])
        self.by_word = (
            normal == self.EXPECTED
            and pattern == _PIECES.pattern
            and split.get("behavior") == "Removed"
            and split.get("invert") is True
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["content"].split() != [t["content"]] for t in added)
        )
        self.special = [t["content"] for t in added]
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.kind = "<u2" if max(vocabulary.values()) < 0xFE00 else "<u4"
        suffix = spec.get("model", {}).get("end_of_word_suffix")
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        if suffix:
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.words = WordCache(self._learn, self.kind, CACHE)
        self.pieces = WordCache(self._learn_pieces, self.kind, PIECES)

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def _learn_pieces(self, pieces: list[str]) -> Learnt:
        """Pieces are coded many at a time; each ends with its only id that has the end-of-word mark.

        The space, which stands between words, has no id.
        """
        flat: list[np.ndarray] = [np.empty(0, self.kind)]
        sizes: list[np.ndarray] = []
        blank = pieces.index(" ") if " " in pieces else -1
        coded = pieces[:blank] + pieces[blank + 1 :] if blank >= 0 else pieces
        for at in range(0, len(coded), 2048):
            part = coded[at : at + 2048]
            ids = np.array(self.library.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, self.kind)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(part) or stops[-1] != len(ids):
                own = self._library(part)
                flat += own
                sizes.append(np.fromiter(map(len, own), np.int64, len(own)))
                continue
            flat.append(ids)
            sizes.append(np.diff(stops, prepend=0))
        size = np.concatenate([np.empty(0, np.int64), *sizes])
        return cut(np.concatenate(flat), np.cumsum(np.insert(size, blank, 0) if blank >= 0 else size))

    def _learn(self, words: list[str]) -> Learnt:
        line = " ".join(words)
        if _PLAIN.fullmatch(line) and not any(special in line for special in self.special):
            return self._learn_plain(words)
        other = np.array([not _PLAIN.fullmatch(w) or any(special in w for special in self.special) for w in words])
        plain = self._learn_plain([w for w, o in zip(words, other) if not o])
        return merged(other, plain, joined(self._library([w for w, o in zip(words, other) if o]), self.kind))

    def _learn_plain(self, words: list[str]) -> Learnt:
        if not words:
            return cut(np.empty(0, self.kind), np.empty(0, np.int64))
        parts = [" ", *_PARTS.findall(" ".join(words).lower()), " "]
        places = self.pieces.places(parts, len(parts))
        ids, ends = self.pieces.gather(places)
        gaps = np.flatnonzero(places == places[0])[1:]
        if len(gaps) != len(words):
            raise ValueError("words and their pieces don't agree")
        self.pieces.trim()
        return cut(ids, ends[gaps])

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Ids of each text as little-endian integers of type ``kind``."""
        if not self.by_word:
            return [i.tobytes() for i in self._library(texts if isinstance(texts, list) else texts.to_pylist())]
        # Words between ASCII white space, and empty ones before and after it.
        return [i.tobytes() for i in self.words.encode(pc.ascii_split_whitespace(pa.array(texts, pa.string())))]


@lru_cache(maxsize=2)
def coder(path: str) -> WordCoder:
    return WordCoder(path)


def add_ids(docs: DataFrame, tokenizer: str, end_id: int, text: str = "text") -> DataFrame:
    """All columns but the text, ``__ids`` (end id included, little-endian, 16 bit where the vocabulary fits) and ``__n``."""
    carry = [c for c in docs.columns if c != text]
    schema = widen(StructType([docs.schema[c] for c in carry]), {"__ids": "binary", "__n": "long"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(tokenizer)
        end, size = np.array([end_id]).astype(own.kind).tobytes(), np.dtype(own.kind).itemsize
        for batch in batches:
            for part in steps(batch, text):
                ids = [i + end for i in own.encode(pc.fill_null(part.column(text), ""))]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in carry), pa.array(ids, pa.binary()), pa.array([len(i) // size for i in ids], pa.int64())],
                    names=schema.fieldNames(),
                )

    return docs.mapInArrow(run, schema)


# -- rANS ---------------------------------------------------------------------


class Table:
    """Scaled frequencies: symbol k owns slots ``start[k] .. start[k] + freq[k]``."""

    def __init__(self, symbols: np.ndarray, counts: np.ndarray):
        size = int(symbols.max()) + 1 if len(symbols) else 0
        total = 1 << SCALE
        if len(symbols) > total:
            raise ValueError("more symbols than slots")
        freq = np.maximum(1, np.floor(counts / max(1, counts.sum()) * (total - len(symbols))).astype(np.int64))
        over = total - int(freq.sum())
        if len(freq):
            freq[np.argmax(freq)] += over  # never below one: floors and ones stay under the total
        self.freq = np.zeros(size, dtype=np.uint64)
        self.freq[symbols] = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64) if size else np.zeros(0, np.uint64)
        self.slots = np.repeat(np.arange(size, dtype=np.uint32), self.freq.astype(np.int64))
        self.crc = zlib.crc32(self.freq.astype("<u4").tobytes())


def encode_block(ids: np.ndarray, table: Table) -> bytes:
    """Lane count, final states and words; id k goes to lane k modulo the lanes."""
    lanes = max(1, min(LANES, len(ids)))
    state = np.full(lanes, LOW, dtype=np.uint64)
    words: list[np.ndarray] = []
    shift, mask = np.uint64(SCALE), np.uint64(0xFFFFFFFF)
    rows = -(-len(ids) // lanes)
    for row in range(rows - 1, -1, -1):
        part = ids[row * lanes : (row + 1) * lanes]
        m = len(part)
        freq, start = table.freq[part], table.start[part]
        x = state[:m]
        full = x >= freq << np.uint64(63 - SCALE)
        if full.any():
            words.append((x[full] & mask).astype("<u4")[::-1])
            x = np.where(full, x >> np.uint64(32), x)
        q = x // freq
        state[:m] = (q << shift) + (x - q * freq) + start
    body = np.concatenate(words)[::-1] if words else np.empty(0, "<u4")
    return struct.pack("<II", lanes, len(body)) + state.astype("<u8").tobytes() + body.tobytes()


def decode_block(data: bytes, count: int, table: Table) -> np.ndarray:
    lanes, size = struct.unpack_from("<II", data)
    state = np.frombuffer(data, "<u8", lanes, 8).astype(np.uint64)
    words = np.frombuffer(data, "<u4", size, 8 + 8 * lanes).astype(np.uint64)
    out = np.empty(count, dtype=np.uint32)
    at, slot_mask, shift = 0, np.uint64((1 << SCALE) - 1), np.uint64(SCALE)
    for row in range(-(-count // lanes)):
        m = min(lanes, count - row * lanes)
        x = state[:m]
        slot = x & slot_mask
        ids = table.slots[slot]
        x = table.freq[ids] * (x >> shift) + slot - table.start[ids]
        low = x < LOW
        n = int(np.count_nonzero(low))
        if n:
            x[low] = (x[low] << np.uint64(32)) | words[at : at + n]
            at += n
        state[:m] = x
        out[row * lanes : row * lanes + m] = ids
    if at != size or (state != LOW).any():
        raise ValueError("a block doesn't end where it began")
    return out


_HEAD = struct.Struct("<4sIQQII")
_POINT = struct.Struct("<QQIII")


def pack_shard(doc_ids: list[int | None], counts: list[int], ids: np.ndarray, table: Table) -> bytes:
    points, blocks, at = [], [], 0
    for first in range(0, len(ids), BLOCK_TOKENS):
        part = ids[first : first + BLOCK_TOKENS]
        block = encode_block(part, table)
        points.append(_POINT.pack(first, at, len(block), len(part), zlib.crc32(part.astype("<u4").tobytes())))
        blocks.append(block)
        at += len(block)
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    index = (
        np.array([d or 0 for d in doc_ids], "<i8").tobytes() + known.tobytes() + np.array(counts, "<u4").tobytes()
    )
    head = _HEAD.pack(MAGIC, 1, len(ids), len(doc_ids), len(points), table.crc)
    return head + b"".join(points) + index + b"".join(blocks)


def unpack_shard(data: bytes, table: Table) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, token counts and all token ids of a file; every checksum is verified."""
    magic, version, tokens, docs, blocks, crc = _HEAD.unpack_from(data)
    if magic != MAGIC or version != 1 or crc != table.crc:
        raise ValueError("not a token file of this table")
    at = _HEAD.size
    points = [_POINT.unpack_from(data, at + k * _POINT.size) for k in range(blocks)]
    at += blocks * _POINT.size
    doc_ids = np.frombuffer(data, "<i8", docs, at)
    known = np.frombuffer(data, np.uint8, docs, at + 8 * docs)
    counts = np.frombuffer(data, "<u4", docs, at + 9 * docs)
    at += 13 * docs
    ids = np.empty(tokens, dtype=np.uint32)
    for first, offset, size, count, check in points:
        part = decode_block(data[at + offset : at + offset + size], count, table)
        if zlib.crc32(part.astype("<u4").tobytes()) != check:
            raise ValueError("a block fails its checksum")
        ids[first : first + count] = part
    return [int(d) if k else None for d, k in zip(doc_ids, known)], counts, ids


# -- the operator -------------------------------------------------------------


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, text: str = "text", doc_id: str = "doc_id"
) -> None:
    """Token files of all documents in ascending ``doc_id`` order below ``path``, with their frequency table.

    ``path/shards`` holds a row per file (shard, place in it, tokens, file), and
    ``path/table`` the counts by id.
    """
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("__text"))
    coded = materialize(add_ids(slim, tokenizer, end_id, "__text"))
    kind = coder(tokenizer).kind

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                raw = b"".join(batch.column("__ids").slice(at, 1024).to_pylist())
                part = np.bincount(np.frombuffer(raw, kind), minlength=len(seen))
                part[: len(seen)] += seen
                seen = part
        ids = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(seen[ids])], names=["id", "n"])

    counts = coded.select("__ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts.coalesce(1).write.parquet(f"{path}/table")
    table = read_table(docs.sparkSession, path)
    tokens = coded.agg(F.sum("__n")).first()[0] or 0

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, seq = TaskContext.get().partitionId(), 0
        doc_ids, sizes, parts, held = [], [], [], 0

        def file() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), kind).astype("<u4")
            data = pack_shard(doc_ids, sizes, ids, table())
            columns = [pa.array([shard], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(ids)], pa.int64())]
            return pa.RecordBatch.from_arrays([*columns, pa.array([data], pa.binary())], names=["shard", "seq", "tokens", "file"])

        for batch in batches:
            for doc, n, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "__n", "__ids"))):
                doc_ids.append(doc)
                sizes.append(n)
                parts.append(raw)
                held += n
                if held >= SHARD_TOKENS:
                    yield file()
                    seq += 1
                    doc_ids, sizes, parts, held = [], [], [], 0
        if doc_ids:
            yield file()

    order = [F.col("doc_id").asc_nulls_first(), F.crc32("__ids")]
    ranges = coded.repartitionByRange(max(1, -(-tokens // SHARD_TOKENS)), order[0]).sortWithinPartitions(*order)
    files = ranges.mapInArrow(encode, "shard int, seq int, tokens long, file binary")
    files.write.option("compression", "none").option("parquet.block.size", 1 << 24).parquet(f"{path}/shards")
    discard(docs.sparkSession, coded)


def read_table(spark: SparkSession, path: str):
    """A function that builds the table once per worker; its size is bounded by the vocabulary."""
    rows = spark.read.parquet(f"{path}/table").orderBy("id").toArrow()
    shared = spark.sparkContext.broadcast((rows["id"].to_numpy(), rows["n"].to_numpy()))
    held: list[Table] = []

    def table() -> Table:
        if not held:
            held.append(Table(*shared.value))
        return held[0]

    return table


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document, decoded from the files; ids are 32-bit binary."""
    table = read_table(spark, path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, file in zip(batch.column("first"), batch.column("file")):
                docs, counts, ids = unpack_shard(file.as_py(), table())
                ends = np.cumsum(counts.astype(np.int64))
                raw = ids.astype("<u4").tobytes()
                for at in range(0, len(docs), 1024):
                    stop = min(at + 1024, len(docs))
                    spans = list(zip((ends[at:stop] - counts[at:stop]).tolist(), ends[at:stop].tolist()))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(docs[at:stop], pa.int64()),
                            pa.array([first.as_py() + a for a, _ in spans], pa.int64()),
                            pa.array([b - a for a, b in spans], pa.int64()),
                            pa.array([raw[4 * a : 4 * b] for a, b in spans], pa.binary()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )

    schema = "doc_id long, start long, n_tokens long, ids binary"
    files = spark.read.schema("shard int, seq int, tokens long, file binary").parquet(f"{path}/shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = files.groupBy("shard").agg(F.sum("tokens").alias("n"))  # a row per shard
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    firsts = files.select("shard", "seq", F.coalesce(F.sum("tokens").over(inside), F.lit(0)).alias("skip")).join(shards, "shard")
    firsts = firsts.select("shard", "seq", (F.col("base") + F.col("skip")).alias("first"))
    if firsts.count() <= BROADCAST_FILES:  # files stay where they are; more firsts than that are joined by shuffle
        firsts = F.broadcast(firsts)
    placed = files.join(firsts, ["shard", "seq"]).select("first", "file")
    return placed.mapInArrow(decode, schema)


def digest(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32, all read back from the files."""
    path = shared_dir(docs.sparkSession)
    write_token_files(docs, path, tokenizer, end_id)
    return read_token_files(docs.sparkSession, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
