"""Media columns: telephony audio in WAV containers, decoded with numpy.

``encode_media`` stores a payload of codec bytes (mu-law, A-law or IMA ADPCM at
8 kHz) unchanged in a WAV container; ``decode_media`` reads containers back,
expands mu-law and A-law through lookup tables, decodes ADPCM with numpy across
all blocks of a batch at once, and stores the audio as 16-bit PCM resampled to
16 kHz, with its features.

Edge cases: null and empty payloads become one 64-byte block of zeros; payloads
are padded with zero bytes to whole blocks, and the WAV header records the
length.  Equal payloads give equal values.  An unreadable container is an error.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import widen

BLOCK = 64
RATE = 8000
OUT_RATE = 16000
CODECS = {"alaw": 6, "ulaw": 7, "adpcm": 0x11}
#: Bytes of codec data that are decoded at once.
BATCH_BYTES = 1 << 20


def _ulaw_table() -> np.ndarray:
    u = ~np.arange(256, dtype=np.int32) & 0xFF
    magnitude = (((u & 0x0F) << 3) + 0x84 << ((u >> 4) & 7)) - 0x84
    return np.where(u & 0x80, -magnitude, magnitude).astype(np.int16)


def _alaw_table() -> np.ndarray:
    a = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, mantissa = (a >> 4) & 7, (a & 0x0F) << 4
    magnitude = np.where(exponent == 0, mantissa + 8, (mantissa + 0x108) << np.maximum(exponent - 1, 0))
    return np.where(a & 0x80, magnitude, -magnitude).astype(np.int16)


TABLES = {"ulaw": _ulaw_table(), "alaw": _alaw_table()}
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107,
    118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963,
    1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894,
    6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794,
    32767,
], dtype=np.int32)
_INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, dtype=np.int32)
_NIBBLES = np.arange(16)
#: Change of the predictor by (step index, nibble).
_DELTA = STEPS[:, None] >> 3
_DELTA = _DELTA + np.where(_NIBBLES & 4, STEPS[:, None], 0) + np.where(_NIBBLES & 2, STEPS[:, None] >> 1, 0)
_DELTA = _DELTA + np.where(_NIBBLES & 1, STEPS[:, None] >> 2, 0)
_DELTA = np.where(_NIBBLES & 8, -_DELTA, _DELTA).astype(np.int32).ravel()
_NEXT = np.clip(np.arange(89)[:, None] + _INDEX[None, :], 0, 88).astype(np.int32).ravel()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """IMA ADPCM, mono: ``(n, block bytes)`` uint8 to ``(n, samples)`` int16.

    Every block has its own start (predictor and step index), so the loop runs
    over the samples of a block while numpy works across all blocks.
    """
    n, width = blocks.shape
    out = np.empty((1 + 2 * (width - 4), n), dtype=np.int16)
    predictor = blocks[:, :2].copy().view("<i2").ravel().astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    out[0] = predictor
    for k in range(2 * (width - 4)):
        nibble = (codes[k >> 1] >> 4) if k & 1 else (codes[k >> 1] & 15)
        at = (index << 4) + nibble
        predictor = np.clip(predictor + _DELTA[at], -32768, 32767)
        index = _NEXT[at]
        out[k + 1] = predictor
    return np.ascontiguousarray(out.T)


def encode_adpcm(samples: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """IMA ADPCM blocks of int16 samples (``(n, samples a block)``), for round trips."""
    n, per = samples.shape
    blocks = np.zeros((n, block), dtype=np.uint8)
    predictor, index = samples[:, 0].astype(np.int32), np.zeros(n, dtype=np.int32)
    blocks[:, :2] = samples[:, :1].astype("<i2").view(np.uint8).reshape(n, 2)
    for k in range(per - 1):
        trial = predictor[:, None] + _DELTA.reshape(89, 16)[index]
        code = np.abs(np.clip(trial, -32768, 32767) - samples[:, k + 1, None]).argmin(axis=1).astype(np.int32)
        at = (index << 4) + code
        predictor, index = np.clip(predictor + _DELTA[at], -32768, 32767), _NEXT[at]
        blocks[:, 4 + (k >> 1)] |= (code << (4 * (k & 1))).astype(np.uint8)
    return blocks


def wav(codec: str, payload: bytes) -> bytes:
    per = 1 + 2 * (BLOCK - 4)
    if codec == "adpcm":
        form = struct.pack("<HHIIHHHH", CODECS[codec], 1, RATE, RATE * BLOCK // per, BLOCK, 4, 2, per)
    else:
        form = struct.pack("<HHIIHHH", CODECS[codec], 1, RATE, RATE, 1, 8, 0)
    size = 4 + 8 + len(form) + 8 + len(payload)
    return b"RIFF%sWAVEfmt %s%sdata%s%s" % (
        struct.pack("<I", size), struct.pack("<I", len(form)), form, struct.pack("<I", len(payload)), payload,
    )


def parse_wav(media: bytes) -> tuple[str, memoryview]:
    """Codec and payload of a container; chunks other than ``fmt`` and ``data`` are skipped."""
    view = memoryview(media)
    if bytes(view[:4]) != b"RIFF" or bytes(view[8:12]) != b"WAVE":
        raise ValueError("not a WAV container")
    at, codec = 12, None
    while at + 8 <= len(view):
        kind, size = bytes(view[at : at + 4]), struct.unpack_from("<I", view, at + 4)[0]
        if kind == b"fmt ":
            tag = struct.unpack_from("<H", view, at + 8)[0]
            codec = next((k for k, v in CODECS.items() if v == tag), None)
        elif kind == b"data":
            if codec is None:
                raise ValueError("unknown codec")
            return codec, view[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no audio data")


def pad(data: bytes) -> bytes:
    return data + bytes(-len(data) % BLOCK if data else BLOCK)


def expand(codec: str, payload) -> np.ndarray:
    raw = np.frombuffer(payload, dtype=np.uint8)
    if codec == "adpcm":
        return decode_adpcm(raw.reshape(-1, BLOCK)).ravel()
    return TABLES[codec][raw]


def resample(pcm: np.ndarray) -> np.ndarray:
    """8 to 16 kHz: linear interpolation; the last sample is repeated."""
    out = np.empty(2 * len(pcm), dtype=np.int16)
    out[::2] = pcm
    wide = pcm.astype(np.int32)
    out[1:-1:2] = (wide[:-1] + wide[1:]) >> 1
    out[-1:] = pcm[-1:]
    return out


def feature(codec: str, pcm: np.ndarray) -> str:
    """Codec, samples, RMS, peak and zero crossings."""
    if not len(pcm):
        return f"{codec}:0"
    wide = pcm.astype(np.float64)
    rms = int(np.sqrt(np.dot(wide, wide) / len(pcm)))
    negative = pcm < 0
    crossings = int(np.count_nonzero(negative[1:] != negative[:-1]))
    return f"{codec}:{len(pcm)}:{rms}:{int(max(wide.max(), -wide.min()))}:{crossings}"


def choose_codec(payload: bytes, codec: str | None) -> str:
    """The codec asked for, or one by content (so equal payloads agree)."""
    return codec or ("ulaw", "alaw", "adpcm")[zlib.crc32(payload) % 3]


def encode_media(rows: DataFrame, payload: str, codec: str | None = None) -> DataFrame:
    """Adds ``media`` (the WAV container) and ``n_bytes`` to rows with a binary ``payload``, which goes."""
    carry = [c for c in rows.columns if c != payload]
    schema = widen(rows.select(*carry).schema, {"n_bytes": "long", "media": "binary"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, media = [], []
            for value in batch.column(payload):
                data = value.as_py() or b""
                full = pad(data)
                sizes.append(len(data))
                media.append(wav(choose_codec(full, codec), full))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in carry), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())],
                names=[*carry, "n_bytes", "media"],
            )

    return rows.mapInArrow(run, schema)


DECODED = {"codec": "string", "payload": "binary", "pcm": "binary", "feature": "string"}


def decode_media(rows: DataFrame, media: str = "media", keep_pcm: bool = True) -> DataFrame:
    """Adds codec, payload, pcm (16 kHz, 16 bit, little-endian; null without ``keep_pcm``) and feature.

    ADPCM blocks of up to ``BATCH_BYTES`` of one Arrow batch are decoded together.
    """
    schema = widen(rows.schema, DECODED)

    def decode(parts: list[tuple[str, memoryview]]) -> list[np.ndarray]:
        out: list = [None] * len(parts)
        group: list[int] = []

        def flush() -> None:
            if group:
                raw = np.concatenate([np.frombuffer(parts[i][1], dtype=np.uint8) for i in group]).reshape(-1, BLOCK)
                pcm = decode_adpcm(raw)
                ends = np.cumsum([len(parts[i][1]) // BLOCK for i in group])
                for i, one in zip(group, np.split(pcm, ends[:-1])):
                    out[i] = one.ravel()
                group.clear()

        size = 0
        for i, (codec, payload) in enumerate(parts):
            if codec != "adpcm":
                out[i] = expand(codec, payload)
                continue
            group.append(i)
            size += len(payload)
            if size >= BATCH_BYTES:
                flush()
                size = 0
        flush()
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                parts = [parse_wav(v.as_py()) for v in part.column(media)]
                sounds = [resample(pcm) for pcm in decode(parts)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns,
                        pa.array([c for c, _ in parts], pa.string()),
                        pa.array([bytes(p) for _, p in parts], pa.binary()),
                        pa.array([s.tobytes() if keep_pcm else None for s in sounds], pa.binary()),
                        pa.array([feature(c, s) for (c, _), s in zip(parts, sounds)], pa.string()),
                    ],
                    names=schema.fieldNames(),
                )

    return rows.mapInArrow(run, schema)


def media_digest(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per document: sizes, digests and features of its text stored as telephony audio and read back."""
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("__payload")
    )
    back = decode_media(encode_media(rows, "__payload"))
    tail = F.expr("substring(payload, octet_length(payload) - 63, 64)")
    return back.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        F.octet_length("pcm").cast("long").alias("pcm_bytes"),
        F.crc32("pcm").alias("pcm_crc32"),
    )
