"""SentencePiece encoding and decoding with offsets into the original bytes.

Encoding has three steps.  *Normalisation*: at each place of the source the
longest prefix found in the model's compiled character map is replaced, else
one character is copied; every normalised byte records the source byte it came
from.  (Stretches that no rule can touch are copied whole; a model without a
map copies everything.)  *Segmentation*: the normalised text is cut where no
piece of the vocabulary can reach across - before a run of word marks - and the
library encodes each distinct chunk once per worker, in a bounded cache.  A
vocabulary with pieces across such places, or another model type, gets
whole texts encoded instead.  *Projection*: piece lengths add up to offsets in
the normalised text, which the recorded alignment maps to source byte spans.

Decoding is the library's.

Edge cases: null counts as empty (begin and end ids only, empty decoded text).
Texts are always encoded whole, however long.  Repeated rows give equal rows.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from .common import widen
from .wordcache import Learnt, WordCache, cut, joined, merged, steps

MARK = "▁"
#: Chunks that one worker remembers; the rarer ones go when they are full.
CACHE = 200_000


class CharacterMap:
    """The compiled map: a double-array trie over UTF-8 keys and a block of replacements."""

    def __init__(self, blob: bytes):
        self.units: list[int] = []
        self.block = b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = list(struct.unpack_from(f"<{size // 4}I", blob, 4))
            self.block = blob[4 + size :]
        self.first = re.compile(b"[" + b"".join(b"\\x%02x" % b for b in self._starts()) + b"]") if self.units else None

    def _starts(self) -> list[int]:
        root = self._offset(self.units[0])
        return [b for b in range(256) if (u := root ^ b) < len(self.units) and (self.units[u] & 0x800000FF) == b]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key that ``text`` has at ``at``."""
        node, found = self._offset(self.units[0]), None
        for k in range(at, len(text)):
            node ^= text[k]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != text[k]:
                break
            node ^= self._offset(unit)
            if (unit >> 8) & 1:
                value = self.units[node] & 0x7FFFFFFF
                found = k + 1 - at, self.block[value : self.block.index(b"\0", value)]
        return found


class PieceCodec:
    def __init__(self, path: str):
        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        model = model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        spec, trainer = model.normalizer_spec, model.trainer_spec
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.dummy, self.trim = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.bos, self.eos = self.processor.bos_id(), self.processor.eos_id()
        kinds = model_pb2.ModelProto.SentencePiece
        self.byte = np.array([p.type == kinds.BYTE for p in model.pieces])
        self.length = np.array([1 if p.type == kinds.BYTE else len(p.piece.encode()) for p in model.pieces], dtype=np.int64)
        self.length[[p.type == kinds.CONTROL for p in model.pieces]] = 0
        self.covers = self.length - 2 * np.array([p.piece.count(MARK) for p in model.pieces])
        self.unknown = self.processor.unk_id()
        across = any(
            re.search(f"[^{MARK}]{MARK}", p.piece) or p.type == kinds.USER_DEFINED for p in model.pieces if p.type != kinds.CONTROL
        )
        self.chunked = (
            trainer.model_type == trainer.BPE
            and not across
            and not spec.precompiled_charsmap
            and self.dummy
            and not self.trim
            and spec.escape_whitespaces
            and not trainer.treat_whitespace_as_suffix
            and trainer.byte_fallback  # else unknown characters of neighbouring chunks would join
        )
        self.cache = WordCache(self._learn, "<u4", CACHE)

    # -- normalisation ---------------------------------------------------

    def normalise(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and the source offset of each and of the end."""
        parts: list[tuple[bytes, int, int]] = []  # bytes, source start, source length
        at = 0
        if self.map.first is None:
            parts.append((text, 0, len(text)))
        else:
            while at < len(text):
                hit = self.map.first.search(text, at)
                stop = hit.start() if hit else len(text)
                if stop > at:
                    parts.append((text[at:stop], at, stop - at))
                at = stop
                if hit:
                    found = self.map.longest(text, at)
                    if found:
                        parts.append((found[1], at, found[0]))
                        at += found[0]
                    else:
                        size = max(1, next((n for m, n in ((0xF0, 4), (0xE0, 3), (0xC0, 2)) if text[at] >= m), 1))
                        parts.append((text[at : at + size], at, size))
                        at += size
        flat = b"".join(p for p, _, _ in parts)
        if len(parts) == 1 and len(parts[0][0]) == parts[0][2]:
            source = np.arange(len(flat) + 1, dtype=np.int64)
        else:
            source = np.concatenate(
                [
                    np.arange(s, s + n, dtype=np.int64) if len(p) == n and p == text[s : s + n] else np.full(len(p), s, dtype=np.int64)
                    for p, s, n in parts
                ]
                + [np.array([len(text)], dtype=np.int64)]
            )
        if self.trim:
            raw = np.frombuffer(flat, dtype=np.uint8)
            space = raw == 32
            keep = ~(space & np.concatenate([[True], space[:-1]]))
            if len(keep) and keep[-1] and space[-1]:
                keep[-1] = False
            flat, source = raw[keep].tobytes(), np.concatenate([source[:-1][keep], source[-1:]])
        if not flat:
            return b"", np.array([len(text)], dtype=np.int64)
        raw = np.frombuffer(flat, dtype=np.uint8)
        wide = np.where(raw == 32, 3, 1)
        source = np.concatenate([np.repeat(source[:-1], wide), source[-1:]])
        mark = MARK.encode()
        flat = flat.replace(b" ", mark)
        if self.dummy:
            flat, source = mark + flat, np.concatenate([np.zeros(3, dtype=np.int64), source])
        return flat, source

    # -- segmentation ----------------------------------------------------

    def ids(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """Ids of each text as the library gives them, without begin and end."""
        if not self.chunked:
            texts = texts if isinstance(texts, list) else texts.to_pylist()
            return [np.array(i, dtype="<u4") for i in self.processor.encode(texts, num_threads=1)]
        texts = pa.array(texts, pa.string())
        chunks = pc.split_pattern(texts, " ")
        # Texts with runs of spaces, spaces at an end or marks, and empty ones, are cut one by one.
        odd = pc.or_(pc.match_substring(texts, MARK), pc.match_substring(pc.binary_join_element_wise("", texts, "", " "), "  "))
        if pc.any(odd).as_py():
            own = pa.array([self._chunks(t) for t in texts.filter(odd).to_pylist()], chunks.type)
            rows = odd.to_numpy(zero_copy_only=False)
            order = np.empty(len(rows), np.int64)
            order[~rows], order[rows] = np.arange((~rows).sum()), (~rows).sum() + np.arange(rows.sum())
            chunks = pa.concat_arrays([chunks.filter(pc.invert(odd)), own]).take(pa.array(order))
        return self.cache.encode(chunks)

    @staticmethod
    def _chunks(text: str) -> list[str]:
        if not text:
            return []
        if MARK in text:
            text = text.replace(MARK, " ")  # the same once normalised
        chunks = text.split(" ")
        return _runs(chunks) if "" in chunks else chunks

    def _learn(self, chunks: list[str]) -> Learnt:
        """Ids of chunks, each encoded with a mark in front.

        Many are encoded in one call - they stay apart, as each starts with a mark - and the ids are cut by length.
        Runs of spaces and the mark at a text's end have no word that would part them from the next chunk: they go by themselves.
        """
        blank = np.array([c == MARK or not c.strip(" ") for c in chunks])
        parts, sizes = [np.empty(0, "<u4")], []
        words = [c for c, b in zip(chunks, blank) if not b] if blank.any() else chunks
        for at in range(0, len(words), 4096):
            part = words[at : at + 4096]
            line = " ".join(part)
            ids = np.array(self.processor.encode(line, num_threads=1), dtype="<u4")
            raw = np.frombuffer(line.encode(), np.uint8) == 32
            if np.count_nonzero(raw) == len(part) - 1:
                upto = np.append(np.flatnonzero(raw), len(raw)) + 2 * np.arange(1, len(part) + 1) + 1
            else:  # chunks that start with spaces
                upto = np.cumsum([len(c.encode()) + 2 * c.count(" ") + 3 for c in part])
            parts.append(ids)
            sizes.append(np.diff(np.searchsorted(np.cumsum(self.length[ids]), upto) + 1, prepend=0))
        coded = cut(np.concatenate(parts), np.cumsum(np.concatenate([np.empty(0, np.int64), *sizes])))
        if not blank.any():
            return coded
        mark = self.processor.piece_to_id(MARK)
        alone = [[mark] if c == MARK else self.processor.encode(c, num_threads=1) for c, b in zip(chunks, blank) if b]
        return merged(blank, coded, joined([np.array(i, "<u4") for i in alone], "<u4"))

    # -- projection ------------------------------------------------------

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Source byte span of each id (begin and end ids left out of ``ids``)."""
        if self.map.first is None and self.chunked and MARK not in text:
            # Copied whole: each piece covers as many source bytes as it has, a mark one, the mark put in front none.
            ends = np.cumsum(self.covers[ids]) - 1
            return np.concatenate([[0], ends[:-1]])[: len(ids)], ends
        normal, source = self.normalise(text.encode())
        length = self.length[ids]
        if not self.chunked and (ids == self.unknown).any():
            pieces = self.processor.encode(text, return_type="proto").pieces
            length = np.array([len(p.piece.encode()) for p in pieces], dtype=np.int64)
        ends = np.minimum(np.cumsum(length), len(normal))
        return source[ends - length], source[ends]


def _runs(chunks: list[str]) -> list[str]:
    """Chunks between single spaces to chunks that start with a whole run of spaces.

    ``"a  b "`` splits to ``a, "", b, ""``; its normalised form is ``_a__b_``,
    whose chunks (the leading mark left out, as encoding adds it) are ``a`` and
    ``  b``; a lone mark at the end stands as the mark itself.
    """
    out, run = [], 0
    for chunk in chunks:
        if chunk:
            out.append(" " * run + chunk)
            run = 0
        else:
            run += 1
    if run:
        out.append(" " * (run - 1) if run > 1 else MARK)
    return out


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def encode_documents(docs: DataFrame, model: str, text: str = "text", offsets: bool = True) -> DataFrame:
    """All columns, ``ids`` (begin and end included) and, per id, ``starts`` and ``ends``: source byte spans.

    ``ids``, ``starts`` and ``ends`` are little-endian 32-bit binary columns;
    existing columns of these names are replaced.  ``model`` is a file that
    every executor can read.
    """
    names = [("ids", "binary"), *([("starts", "binary"), ("ends", "binary")] if offsets else [])]
    base = docs.drop(*(n for n, _ in names))
    schema = widen(base.schema, dict(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        bos, eos = np.array([own.bos], "<u4").tobytes(), np.array([own.eos], "<u4").tobytes()
        for batch in batches:
            for part in steps(batch, text):
                columns: list[list[bytes]] = [[] for _ in names]
                texts = pc.fill_null(part.column(text), "")
                for raw, ids in zip(texts.to_pylist() if offsets else texts, own.ids(texts)):
                    columns[0].append(bos + ids.tobytes() + eos)
                    if offsets:
                        starts, ends = own.spans(raw, ids)
                        last = ends[-1] if len(ends) else 0
                        columns[1].append(np.concatenate([[0], starts, [last]]).astype("<u4").tobytes())
                        columns[2].append(np.concatenate([[0], ends, [last]]).astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *(pa.array(c, pa.binary()) for c in columns)], names=schema.fieldNames()
                )

    return base.mapInArrow(run, schema)


def decode_documents(rows: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """All columns and ``decoded``: the text of the ids, as the library decodes them."""
    base = rows.drop("decoded")
    schema = widen(base.schema, {"decoded": "string"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = [np.frombuffer(v or b"", dtype="<u4").tolist() for v in part.column(ids).to_pylist()]
                texts = own.processor.decode(lists, num_threads=1) if lists else []
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=schema.fieldNames())

    return base.mapInArrow(run, schema)


def digest(docs: DataFrame, model: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and spans_crc32 of every document."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("__text"))
    coded = encode_documents(slim, model, "__text").select("doc_id", "ids", "starts", "ends")
    return decode_documents(coded, model).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        F.crc32(F.concat("starts", "ends")).alias("spans_crc32"),
    )
