"""Telephony audio columns.

A byte payload is kept as G.711 samples (mu-law or A-law) or as IMA ADPCM
blocks in a RIFF/WAVE container, read back, expanded to 16-bit PCM and
resampled.  Expansion of the companded laws is a lookup in a 256-entry table
made from their formulas; ADPCM blocks are decoded with numpy across all
blocks of a slice, one sample position at a time.

Defined results: a null text is the empty text; the payload of an empty text is
64 zero bytes; equal texts give equal values; repeated rows each give a row;
an empty table gives an empty table; columns other than the id and the text
are ignored.  A text of any length is one container, never cut.
"""
from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table, texts
from .textkit import slices

UNIT = 64
#: WAVE format tags (fixed values).
TAGS = {"alaw": 6, "mulaw": 7, "ima_adpcm": 17}
#: IMA ADPCM index steps for the eight code magnitudes (fixed values).
INDEX_STEP = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)
#: IMA ADPCM step sizes (fixed values).
STEP_SIZE = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
    7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)


def mulaw_table() -> np.ndarray:
    """PCM value of each mu-law code (G.711): inverted bits, bias 132."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """PCM value of each A-law code (G.711): even bits inverted."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    part, size = code >> 4 & 7, (code & 15) << 4
    size = np.where(part == 0, size + 8, size + 264 << np.maximum(part - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


TABLES = {"mulaw": mulaw_table(), "alaw": alaw_table()}


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """PCM of IMA ADPCM blocks (blocks x bytes, mono): 1 + 2 * (bytes - 4) samples each.

    The predictor and index of each header start its block; an index beyond the step table is taken as its last entry.
    """
    n, width = blocks.shape
    out = np.empty((1 + 2 * (width - 4), n), np.int16)
    value = blocks[:, :2].copy().view("<i2").ravel().astype(np.int32)
    index = np.minimum(blocks[:, 2], len(STEP_SIZE) - 1).astype(np.int32)
    out[0] = value
    for at, column in enumerate(np.ascontiguousarray(blocks[:, 4:].T)):
        for half in (0, 1):
            code = (column >> (4 * half) & 15).astype(np.int32)
            step = STEP_SIZE[index]
            move = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
            value = np.clip(value + np.where(code & 8, -move, move), -32768, 32767)
            index = np.clip(index + INDEX_STEP[code & 7], 0, len(STEP_SIZE) - 1)
            out[1 + 2 * at + half] = value
    return np.ascontiguousarray(out.T)


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation between sampling rates, 16-bit, ceil(n * to / rate) samples."""
    n = len(pcm)
    if not n or rate == to:
        return pcm
    k = np.arange(-(-n * to // rate), dtype=np.int64) * rate
    at, rest = k // to, k % to
    a, b = pcm[np.minimum(at, n - 1)].astype(np.int64), pcm[np.minimum(at + 1, n - 1)].astype(np.int64)
    return ((a * (to - rest) + b * rest + to // 2) // to).astype(np.int16)


def pack(payload: bytes, codec: str, rate: int = 8000) -> bytes:
    """A WAVE file of the payload; payloads are multiples of the 64-byte unit, so chunks need no padding."""
    width = UNIT if codec == "ima_adpcm" else 1
    bits = 4 if codec == "ima_adpcm" else 8
    per = 1 + 2 * (UNIT - 4) if codec == "ima_adpcm" else 1
    extra = struct.pack("<HH", 2, per) if codec == "ima_adpcm" else struct.pack("<H", 0)
    fmt = struct.pack("<HHIIHH", TAGS[codec], 1, rate, rate * width // per, width, bits) + extra
    fact = struct.pack("<4sII", b"fact", 4, (len(payload) // width * per) & 0xFFFFFFFF)
    body = b"WAVE" + struct.pack("<4sI", b"fmt ", len(fmt)) + fmt + fact + struct.pack("<4sI", b"data", len(payload)) + payload
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def unpack(media: bytes) -> tuple[str, int, bytes]:
    """(codec, rate, payload) of a WAVE file, by walking its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, codec, rate = 12, "", 0
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            tag, _, rate = struct.unpack_from("<HHI", media, at + 8)
            codec = next((k for k, v in TAGS.items() if v == tag), "")
            if not codec:
                raise ValueError(f"format tag {tag} isn't a telephony codec")
        elif name == b"data":
            return codec, rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def expand(payload: bytes, codec: str) -> np.ndarray:
    """PCM samples of a payload."""
    raw = np.frombuffer(payload, np.uint8)
    if codec in TABLES:
        return TABLES[codec][raw]
    return decode_adpcm(raw.reshape(-1, UNIT)).ravel()


def describe(pcm: np.ndarray) -> str:
    """n:mean:rms:zero crossings, integers only, so equal on every machine."""
    n = len(pcm)
    wide = pcm.astype(np.int64)
    total, power = int(wide.sum()), int((wide * wide).sum())
    crossings = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    return f"{n}:{total // max(n, 1)}:{int((power // max(n, 1)) ** 0.5)}:{crossings}"


SCHEMA = "doc_id long, n_bytes long, media binary"


def encode_media(docs: DataFrame, codec: str = "mulaw") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as UTF-8, zero-padded to a positive multiple of 64 bytes, in a WAVE container."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in slices(batch.column(1)):
                media = []
                for s, e in zip(offs[:-1], offs[1:]):
                    size = max(UNIT, -(-(e - s) // UNIT) * UNIT)
                    media.append(pack(data[s:e].tobytes().ljust(int(size), b"\0"), codec))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(offs)), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return texts(docs).mapInArrow(run, SCHEMA)


def _parts(batch: pa.RecordBatch, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of some `most` bytes of media; PCM takes four times as much."""
    turn = np.cumsum([len(x.as_buffer()) for x in batch.column(2)]) // most
    cuts = np.flatnonzero(np.diff(turn, prepend=-1)).tolist()
    for a, b in zip(cuts, [*cuts[1:], batch.num_rows]):
        yield batch.slice(a, b - a)


def decode_media(media: DataFrame, to_rate: int = 16000, keep_pcm: bool = True) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature[, pcm]).

    Everything is computed from the stored container: the payload is read back,
    expanded by its codec and resampled to `to_rate`; pcm is little-endian
    16-bit.  For a payload of a companded law the feature also has the other
    two readings of the same bytes (other law, ADPCM blocks).
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", pcm binary" * keep_pcm

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _parts(whole)):
            out: list[list] = [[] for _ in range(7 + keep_pcm)]
            loads, blocks = [], []
            for stored in batch.column(2):
                loads.append(unpack(stored.as_buffer().to_pybytes()))
            # ADPCM: all blocks of several files at once
            adpcm, group, held = [], [], 0
            for k, (_, _, payload) in enumerate(loads):
                group.append(np.frombuffer(payload, np.uint8).reshape(-1, UNIT))
                held += len(payload)
                if held >= 1 << 20 or k == len(loads) - 1:
                    pcm = decode_adpcm(np.concatenate(group))
                    cuts = np.cumsum([len(g) for g in group])[:-1]
                    adpcm += [describe(x.ravel()) if not keep_pcm or loads[0][0] != "ima_adpcm" else x.ravel() for x in np.split(pcm, cuts)]
                    group, held = [], 0
            for k, ((codec, rate, payload), stored) in enumerate(zip(loads, batch.column(2))):
                media = stored.as_buffer()
                readings = {c: expand(payload, c) for c in TABLES}
                text = adpcm[k] if isinstance(adpcm[k], str) else describe(adpcm[k])
                main = readings[codec] if codec in TABLES else (adpcm[k] if not isinstance(adpcm[k], str) else expand(payload, codec))
                pcm = resample(main, rate, to_rate)
                feature = f"{codec};mulaw={describe(readings['mulaw'])};alaw={describe(readings['alaw'])};ima_adpcm={text};pcm{to_rate}={len(pcm)}:{zlib.crc32(pcm.astype('<i2').tobytes()):08x}"
                row = [len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), media.size, hashlib.sha256(media).hexdigest(), feature]
                for c, v in zip(out, row):
                    c.append(v)
                if keep_pcm:
                    out[6].append(pcm.astype("<i2").tobytes())
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.binary()] * keep_pcm
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] + ["pcm"] * keep_pcm
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(out, kinds))], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = decode_media(encode_media(table(spark, sf_dir, "documents"), "mulaw"))
    return stored.withColumns({"pcm_bytes": F.length("pcm").cast("long"), "pcm_crc32": F.crc32("pcm")}).drop("pcm")
