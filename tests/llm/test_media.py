import hashlib
import zlib

import numpy as np
import pytest

from readweaver.llm import media
from tests.llm.fixtures import awkward_texts, docs, empty


def expand_mulaw(code):
    """One G.711 mu-law code, bit by bit."""
    code = ~code & 0xFF
    value = ((((code & 15) << 1) + 33) << (code >> 4 & 7)) - 33
    return -4 * value if code & 128 else 4 * value


def expand_alaw(code):
    code ^= 0x55
    part, mantissa = code >> 4 & 7, code & 15
    value = (2 * mantissa + 1) if part == 0 else (2 * mantissa + 33) << (part - 1)
    return 8 * value if code & 128 else -8 * value


def adpcm(block):
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(media.STEP_SIZE[index])
            move = step >> 3
            for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
                if code & bit:
                    move += part
            value = max(-32768, min(32767, value - move if code & 8 else value + move))
            index = max(0, min(88, index + [-1, -1, -1, -1, 2, 4, 6, 8][code & 7]))
            out.append(value)
    return out


def test_expansion_tables():
    assert media.TABLES["mulaw"].tolist() == [expand_mulaw(c) for c in range(256)]
    assert media.TABLES["alaw"].tolist() == [expand_alaw(c) for c in range(256)]


def test_adpcm_blocks():
    raw = np.random.default_rng(3).integers(0, 256, (40, 64), dtype=np.uint8)
    assert media.decode_adpcm(raw).tolist() == [adpcm(bytes(b)) for b in raw]


@pytest.mark.parametrize("codec", ["mulaw", "alaw", "ima_adpcm"])
def test_container_round_trip(codec):
    payload = bytes(range(64)) * 3
    assert media.unpack(media.pack(payload, codec)) == (codec, 8000, payload)


def test_resample():
    pcm = np.array([0, 100, -100], np.int16)
    assert media.resample(pcm, 8000, 16000).tolist() == [0, 50, 100, 0, -100, -100]
    assert media.resample(pcm, 8000, 8000) is pcm
    assert len(media.resample(pcm, 3, 1)) == 1


@pytest.mark.parametrize("codec", ["mulaw", "alaw", "ima_adpcm"])
def test_query_against_brute_force(spark, codec):
    texts = awkward_texts()
    stored = media.encode_media(docs(spark, texts), codec)
    kept = {r.doc_id: r.media for r in stored.collect()}
    got = {r.doc_id: r for r in media.decode_media(stored).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
        assert (r.media_bytes, r.media_sha256) == (len(kept[i]), hashlib.sha256(kept[i]).hexdigest())
        pcm = np.frombuffer(bytes(r.pcm), "<i2")
        base = [expand_mulaw(b) for b in payload] if codec == "mulaw" else [expand_alaw(b) for b in payload] if codec == "alaw" else [x for k in range(0, len(payload), 64) for x in adpcm(payload[k : k + 64])]
        assert pcm[::2].tolist() == base and len(pcm) == 2 * len(base)
    same = [r.feature for i, r in got.items() if texts[i] == "x"]
    assert len(set(same)) == 1 and len(same) == 2


def test_empty_table(spark):
    assert media.decode_media(media.encode_media(empty(spark))).collect() == []
