import hashlib
import random
import zlib

import numpy as np
import pytest

from lakeloom.llm import telephony as t
from lakeloom.llm.queries import QUERIES


def test_tables_have_the_known_values():
    assert [int(t.MULAW_PCM[x]) for x in (0x00, 0x7F, 0x80, 0xFF, 0x0F)] == [-32124, 0, 32124, 0, -16764]
    assert [int(t.ALAW_PCM[x]) for x in (0x55, 0xD5, 0x2A, 0xAA)] == [-8, 8, -32256, 32256]
    assert len(set(t.ALAW_PCM.tolist())) == 256 and len(set(t.MULAW_PCM.tolist())) == 255


def scalar_adpcm(block):
    value = int.from_bytes(block[:2], "little", signed=True)
    index, out = min(block[2], 88), [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(t.STEPS[index])
            diff = step >> 3
            for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
                if code & bit:
                    diff += part
            value = max(-32768, min(32767, value - diff if code & 8 else value + diff))
            index = max(0, min(88, index + int(t.MOVES[code & 7])))
            out.append(value)
    return out


def test_adpcm_blocks_equal_a_scalar_decoder():
    r = random.Random(1)
    blocks = [bytes(r.randrange(256) for _ in range(64)) for _ in range(50)]
    got = t.decode_adpcm(np.frombuffer(b"".join(blocks), dtype=np.uint8).reshape(-1, 64))
    assert got.tolist() == [scalar_adpcm(b) for b in blocks]


def test_resampling_keeps_samples_and_a_tone():
    x = (8000 * np.sin(np.arange(400) * 2 * np.pi * 440 / 8000)).astype(np.int16)
    wide = t.resample(x)
    assert len(wide) == 800 and (wide[0::2] == x).all()
    want = 8000 * np.sin(np.arange(800) * 2 * np.pi * 440 / 16000)
    assert np.abs(wide[20:-20] - want[20:-20]).max() < 100
    assert len(t.resample(x, 8000, 11025)) == round(400 * 11025 / 8000)
    assert len(t.resample(x[:0])) == 0


def test_stored_payload_comes_back():
    for n in (0, 1, 63, 64, 65, 1000):
        data = bytes(range(256)) * 4
        tag, rate, align, back = t.read_stored(t.store_payload(data[:n]))
        assert (tag, rate, align) == (7, 8000, 1)
        assert back[:n] == data[:n] and len(back) % 64 == 0 and len(back) >= 64 and not any(back[n:])


def test_transcode(spark):
    good = t.wav(bytes(range(200)))
    rows = [(1, good), (2, None), (3, b""), (4, b"RIFFxxxxWAVE"), (5, t.wav(bytes(128), t.ADPCM, 8000, 64, 4)), (6, t.wav(b"\x55\xd5", t.ALAW)), (7, t.wav(b"abc", 85)), (1, good)]
    df = spark.createDataFrame(rows, "id int, audio binary")
    got = {r.key: r for r in t.transcode(df, "id", "audio").collect()}
    assert got[1].n_samples == 400 and np.frombuffer(bytes(got[1].pcm), "<i2")[0::2].tolist() == t.MULAW_PCM[:200].tolist()
    assert got[2].pcm is None and got[2].problem is None
    assert got[3].pcm is None and got[4].pcm is None and got[7].pcm is None and "unknown codec" in got[7].problem
    assert got[5].n_samples == 2 * 2 * 121
    assert np.frombuffer(bytes(got[6].pcm), "<i2")[0::2].tolist() == [-8, 8]
    raw = {r.key: r.n_samples for r in t.transcode(df, "id", "audio", "mulaw", 8000).collect()}
    assert raw[3] == 0 and raw[1] == len(good)


def test_query_columns(spark, small):
    texts = {r.doc_id: r.text.encode() for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in QUERIES["op4_telephony_audio"](spark, small).collect():
        raw = texts[r.doc_id]
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
        stored = t.store_payload(raw)
        assert r.media_bytes == len(stored) and r.media_sha256 == hashlib.sha256(stored).hexdigest()


def test_features_do_not_depend_on_neighbours(messy, empty):
    rows = t.payload_features(messy).collect()
    assert len(rows) == 9
    by = {}
    for r in rows:
        by.setdefault(r.payload_sha256, set()).add(r.feature)
    assert all(len(f) == 1 for f in by.values())
    assert t.features([bytes(64), b"a" * 64])[1] == t.features([b"a" * 64])[0]
    null, blank = (next(r for r in rows if r.doc_id == i) for i in (2, 3))
    assert null.payload_sha256 == blank.payload_sha256 and null.n_bytes == 0 and null.payload_bytes == 64
    assert t.payload_features(empty).count() == 0


def test_unknown_codec_is_refused():
    with pytest.raises(ValueError):
        t.expand(b"", "opus")


def scalar_mulaw(byte):
    """The companding rule by the segment's start and step."""
    code = 255 - byte
    segment, place = code // 16 % 8, code % 16
    size = (33 + 2 * place) * 2**segment - 33
    return -4 * size if code > 127 else 4 * size


def scalar_alaw(byte):
    code = byte ^ 85
    segment, place = code // 16 % 8, code % 16
    size = (2 * place + 1) * 8 if segment == 0 else (2 * place + 33) * 4 * 2**segment
    return size if code > 127 else -size


def scalar_wide(pcm):
    """Every sample, and between each two the windowed sinc over four neighbours on either side."""
    taps = [np.sinc(k - 3.5) * (0.5 - 0.5 * np.cos(2 * np.pi * (k + 1) / 9)) for k in range(8)]
    out = []
    for i, x in enumerate(pcm):
        between = sum(tap / sum(taps) * (pcm[i + 4 - k] if 0 <= i + 4 - k < len(pcm) else 0) for k, tap in enumerate(taps))
        out += [x, max(-32768, min(32767, round(between)))]
    return out


def test_features_and_pcm_equal_scalar_ones(spark, small):
    assert [scalar_mulaw(b) for b in range(256)] == t.MULAW_PCM.tolist() and [scalar_alaw(b) for b in range(256)] == t.ALAW_PCM.tolist()
    docs = spark.read.parquet(f"{small}/documents.parquet").filter("n_chars < 600")
    rms = lambda x: (sum(v * v for v in x) / len(x)) ** 0.5
    rows = t.stored(docs).collect()
    assert len(rows) > 20
    for r in rows:
        payload = bytes(r.payload)
        mu, wide = [scalar_mulaw(b) for b in payload], np.frombuffer(bytes(r.pcm), "<i2").tolist()
        want = scalar_wide(mu)
        assert len(wide) == len(want) and max(abs(a - b) for a, b in zip(wide, want)) <= 1  # the order of sums may round otherwise
        got = dict(x.split("=") for x in r.feature.split(";"))
        adpcm = [v for k in range(0, len(payload), 64) for v in scalar_adpcm(payload[k : k + 64])]
        assert abs(float(got["mulaw_rms"]) - rms(mu)) < 0.01 and abs(float(got["alaw_rms"]) - rms([scalar_alaw(b) for b in payload])) < 0.01
        assert abs(float(got["adpcm_rms"]) - rms(adpcm)) < 0.05 and abs(float(got["wide_rms"]) - rms(want)) < 0.5
        assert int(got["crossings"]) == sum((a < 0) != (b < 0) for a, b in zip(mu, mu[1:])) and int(got["peak"]) == max(map(abs, mu))
        assert int(got["wide_samples"]) == 2 * len(mu)


def test_headers_that_cannot_be_have_a_reason(spark):
    def header(tag=7, channels=1, rate=8000, align=1, data=bytes(64)):
        whole = bytearray(t.wav(data, tag, 8000))
        whole[22:24], whole[24:28], whole[32:34] = channels.to_bytes(2, "little"), rate.to_bytes(4, "little"), align.to_bytes(2, "little")
        return bytes(whole)

    bad = [header(rate=0), header(rate=1), header(rate=2**32 - 1), header(channels=0), header(tag=17, align=0), header(tag=17, align=4), header(tag=17, align=64, channels=2), b"RIFF", header()[:30]]
    good = [header(), header(channels=2), header(rate=11025), header(tag=17, align=32)]
    df = spark.createDataFrame(list(enumerate(bad + good)), "id int, audio binary")
    got = {r.key: r for r in t.transcode(df, "id", "audio").collect()}
    assert all(got[i].pcm is None and got[i].problem for i in range(len(bad)))
    assert [got[len(bad) + i].n_samples for i in range(len(good))] == [128, 64, round(64 * 16000 / 11025), 2 * 2 * 57]
    assert all(got[len(bad) + i].problem is None for i in range(len(good)))


def test_empty_and_cut_containers(spark):
    whole = t.wav(bytes(range(256)) * 4)
    df = spark.createDataFrame([(0, bytearray(b"")), (1, bytearray(whole[:-100])), (2, bytearray(whole))], "k int, b binary")
    got = {r.key: r for r in t.transcode(df, "k", "b").collect()}
    assert got[0].pcm is None and got[0].problem == "not a WAV container"
    assert got[1].pcm is None and got[1].problem == "924 of 1024 bytes of samples"
    assert got[2].n_samples == 2048
