"""Telephony audio columns: companded and ADPCM samples, expanded to 16-bit PCM and resampled.

``transcode`` turns a column of telephony bytes (mu-law, A-law or IMA ADPCM, raw or in a WAV
container) into a column of PCM16 bytes at a target rate. ``stored`` keeps texts' bytes losslessly
as mu-law WAV samples, reads them back, and stores their resampled PCM beside them; ``payload_features``
is the query's form, which takes its digests from these columns.

Defined results: null bytes give null PCM; empty raw bytes give empty PCM; an unknown codec, a
broken container (an empty one, or one cut short within its samples), or a header that can't be (a rate outside ``RATES``, no channel, an ADPCM block
without samples, or with several channels) gives null PCM and a reason in ``problem``; two channels
or more become one, their mean; repeated rows give repeated results. Only the key is carried on;
if it has an added column's name, ``input_`` goes in front.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import apart, chunks, in_worker, small_batches, utf8

RATE = 8000
#: Rates that a header may have. A sample gives to / rate samples, so these also bound what comes out.
RATES = (1000, 192_000)
BLOCK = 64  # bytes of an ADPCM block: a 4-byte header and two samples in each other byte
UNIT = 64
PART = 2_000_000  # bytes of texts whose audio goes back to Spark at a time

# Step sizes and index moves of IMA ADPCM.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166,
    1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845,
    8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], dtype=np.int32)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int32)
MULAW, ALAW, ADPCM = 7, 6, 17  # format tags of a WAV container


def mulaw_table() -> np.ndarray:
    """PCM16 value of each mu-law byte."""
    u = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((u & 0x0F) << 3) + 0x84 << ((u & 0x70) >> 4)) - 0x84
    return np.where(u & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """PCM16 value of each A-law byte."""
    a = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, size = (a & 0x70) >> 4, ((a & 0x0F) << 4) + 8
    size = np.where(exponent == 0, size, (size + 0x100) << np.maximum(exponent - 1, 0))
    return np.where(a & 0x80, size, -size).astype(np.int16)


MULAW_PCM, ALAW_PCM = mulaw_table(), alaw_table()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """PCM16 of IMA ADPCM blocks (one row each): one step for each sample, over all blocks at once."""
    n, width = blocks.shape
    first = np.ascontiguousarray(blocks[:, :2]).view("<i2").astype(np.int32).ravel()
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    codes = np.empty(((width - 4) * 2, n), dtype=np.uint8)
    body = blocks[:, 4:].T
    codes[0::2], codes[1::2] = body & 15, body >> 4
    out = np.empty((len(codes) + 1, n), dtype=np.int16)
    out[0] = value = first
    # Signed difference of each (index, code), so a sample costs two look-ups.
    c = np.arange(16, dtype=np.int32)
    s = STEPS[:, None]
    size = (s >> 3) + np.where(c & 4, s, 0) + np.where(c & 2, s >> 1, 0) + np.where(c & 1, s >> 2, 0)
    change = np.where(c & 8, -size, size).ravel().astype(np.int32)
    following = np.clip(np.arange(89, dtype=np.int32)[:, None] + MOVES[c & 7], 0, 88).ravel().astype(np.int32)
    for k in range(len(codes)):
        at = (index << 4) + codes[k]
        value = value + change[at]
        np.clip(value, -32768, 32767, out=value)
        out[k + 1] = value
        index = following[at]
    return out.T


def _half_sample_taps(n: int = 8) -> np.ndarray:
    """Windowed sinc that gives the value halfway between two samples."""
    t = np.arange(n) - (n - 1) / 2
    taps = np.sinc(t) * np.hanning(n + 2)[1:-1]
    return taps / taps.sum()


_TAPS = _half_sample_taps()


def resample(pcm: np.ndarray, rate: int = RATE, to: int = 2 * RATE) -> np.ndarray:
    """PCM16 at another rate: a half-band filter when it doubles, else linear interpolation."""
    if not (RATES[0] <= rate <= RATES[1] and RATES[0] <= to <= RATES[1]):
        raise ValueError(f"a rate of {rate} or {to}")
    if rate == to or not len(pcm):
        return pcm.astype(np.int16)
    x = pcm.astype(np.float32)
    if to == 2 * rate:
        out = np.empty(2 * len(x), dtype=np.float32)
        out[0::2] = x
        out[1::2] = np.convolve(x, _TAPS.astype(np.float32))[len(_TAPS) // 2 :][: len(x)]
    else:
        n = max(1, round(len(x) * to / rate))
        out = np.interp(np.arange(n) * (rate / to), np.arange(len(x)), x)
    return np.clip(np.rint(out), -32768, 32767).astype(np.int16)


def wav(data: bytes, tag: int = MULAW, rate: int = RATE, align: int = 1, bits: int = 8) -> bytes:
    """A WAV container of one channel around stored samples."""
    fmt = struct.pack("<HHIIHHH", tag, 1, rate, rate * align if align == 1 else rate * align // (2 * (align - 4) + 1), align, bits, 0)
    n_samples = len(data) if align == 1 else len(data) // align * (2 * (align - 4) + 1)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, n_samples)
    body += b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def container(stored: bytes) -> tuple[int, int, int, int, bytes]:
    """Format tag, channels, rate, block size and data of a WAV container."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("not a WAV container")
    at, tag, channels, rate, align, data = 12, 0, 0, 0, 1, None
    while at + 8 <= len(stored):
        name, size = stored[at : at + 4], struct.unpack_from("<I", stored, at + 4)[0]
        if name == b"fmt ":
            tag, channels, rate, _, align = struct.unpack_from("<HHIIH", stored, at + 8)
        elif name == b"data":
            data = stored[at + 8 : at + 8 + size]
            if len(data) < size:
                raise ValueError(f"{len(data)} of {size} bytes of samples")
        at += 8 + size + (size & 1)
    if data is None or not tag:
        raise ValueError("no samples")
    return tag, channels, rate, align, data


def read_stored(stored: bytes) -> tuple[int, int, int, bytes]:
    """Format tag, rate, block size and data of a WAV container."""
    tag, _, rate, align, data = container(stored)
    return tag, rate, align, data


def store_payload(text: bytes) -> bytes:
    """Bytes, padded with 0 to a positive multiple of 64, stored as mu-law samples."""
    size = max(UNIT, -(-len(text) // UNIT) * UNIT)
    return wav(text.ljust(size, b"\0"))


def expand(data: bytes, codec: str, block: int = BLOCK) -> np.ndarray:
    """PCM16 of one value's bytes; ADPCM bytes past the last whole block are no samples."""
    raw = np.frombuffer(data, dtype=np.uint8)
    if codec == "mulaw":
        return MULAW_PCM[raw]
    if codec == "alaw":
        return ALAW_PCM[raw]
    if codec == "adpcm":
        if block < 5:
            raise ValueError(f"an ADPCM block of {block} bytes")
        return decode_adpcm(raw[: len(raw) // block * block].reshape(-1, block)).ravel()
    raise ValueError(f"unknown codec {codec}")


def expanded(stored: bytes) -> tuple[np.ndarray, int]:
    """PCM16 of one channel, and its rate, of a WAV container's samples."""
    tag, channels, rate, align, data = container(stored)
    codec = {MULAW: "mulaw", ALAW: "alaw", ADPCM: "adpcm"}.get(tag, str(tag))
    if not channels or (codec == "adpcm" and channels > 1):
        raise ValueError(f"{channels} channels")
    pcm = expand(data, codec, align)
    if channels > 1:
        pcm = pcm[: len(pcm) // channels * channels].reshape(-1, channels).mean(axis=1).astype(np.int16)
    return pcm, rate


def transcode(df: DataFrame, key: str, column: str, codec: str | None = None, to: int = 2 * RATE) -> DataFrame:
    """key, pcm binary (PCM16, little-endian), rate int, n_samples long, problem string.

    codec: mulaw, alaw or adpcm for raw bytes at 8 kHz; None for WAV containers.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_worker("telephony")
        for b in batches:
            pcm, rates, counts, problems = [], [], [], []
            for data in b.column(1).to_pylist():
                out, problem = None, None
                if data is not None:
                    try:
                        if codec:
                            out = resample(expand(data, codec), RATE, to)
                        else:
                            out = resample(*expanded(data), to)
                    except (ValueError, struct.error) as e:
                        problem = str(e)
                pcm.append(None if out is None else out.astype("<i2").tobytes())
                rates.append(to)
                counts.append(None if out is None else len(out))
                problems.append(problem)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pcm, pa.binary()), pa.array(rates, pa.int32()), pa.array(counts, pa.int64()), pa.array(problems, pa.string())], names=["key", "pcm", "rate", "n_samples", "problem"])

    small_batches(df.sparkSession)
    return df.select(df[key].alias("key"), df[column].cast("binary").alias("bytes")).mapInArrow(run, f"key {kind}, pcm binary, rate int, n_samples long, problem string")


def _rms(x: np.ndarray) -> float:
    x = x.astype(np.float64)
    return float(np.sqrt(np.dot(x, x) / max(1, len(x))))


def features(payloads: list[bytes], wide: list[np.ndarray] | None = None) -> list[str]:
    """Features of payloads read back, each a positive multiple of 64 bytes, by all three codecs, and of their resampled PCM."""
    if wide is None:
        wide = [resample(MULAW_PCM[np.frombuffer(p, dtype=np.uint8)]) for p in payloads]
    sizes = np.array([len(p) // BLOCK for p in payloads])
    blocks = np.frombuffer(b"".join(payloads), dtype=np.uint8).reshape(-1, BLOCK)
    energy = np.empty(len(blocks))
    for at in range(0, len(blocks), 16384):  # so many blocks stay in the processor's cache
        pcm = decode_adpcm(blocks[at : at + 16384]).astype(np.float32)
        energy[at : at + 16384] = np.einsum("ij,ij->i", pcm, pcm, dtype=np.float64)
    by_text = np.add.reduceat(energy, np.concatenate([[0], np.cumsum(sizes)[:-1]])) if len(payloads) else energy
    out = []
    for p, n, e, w in zip(payloads, sizes, by_text, wide, strict=True):
        raw = np.frombuffer(p, dtype=np.uint8)
        mu = MULAW_PCM[raw]
        negative = mu < 0
        crossings = int(np.count_nonzero(negative[1:] != negative[:-1]))
        out.append(
            f"mulaw_rms={_rms(mu):.3f};alaw_rms={_rms(ALAW_PCM[raw]):.3f};adpcm_rms={np.sqrt(e / (n * (2 * BLOCK - 7))):.3f};"
            f"crossings={crossings};peak={int(np.abs(mu.astype(np.int32)).max())};wide_samples={len(w)};wide_rms={_rms(w):.3f}"
        )
    return out


def stored(df: DataFrame, key: str = "doc_id", column: str = "text", to: int = 2 * RATE) -> DataFrame:
    """Each text kept as audio: key, n_bytes, media (the WAV container), payload (its bytes read back), pcm
    (PCM16 of the samples, resampled) and feature. A null text is an empty one."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_worker("telephony")
        for b in batches:
            every = utf8(b.column(1))
            for i, j in chunks(every, PART):
                texts = every[i:j]
                media = [store_payload(t) for t in texts]
                back = [read_stored(m)[3] for m in media]
                wide = [resample(*expanded(m), to) for m in media]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(i, j - i),
                        pa.array([len(t) for t in texts], pa.int64()),
                        pa.array(media, pa.binary()),
                        pa.array(back, pa.binary()),
                        pa.array([w.astype("<i2").tobytes() for w in wide], pa.binary()),
                        pa.array(features(back, wide)),
                    ],
                    names=["k", "n_bytes", "media", "payload", "pcm", "feature"],
                )

    small_batches(df.sparkSession, 512)
    out = df.select(df[key].alias("k"), df[column].cast("string").alias("t")).mapInArrow(run, f"k {kind}, n_bytes long, media binary, payload binary, pcm binary, feature string")
    return out.withColumnRenamed("k", apart([key], out.columns[1:])[0])


def payload_features(df: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """Digests of what ``stored`` gives: of the payload read back, the container, and the resampled PCM."""
    out = stored(df, key, column)
    return out.select(
        out.columns[0],
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -UNIT, UNIT)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        F.octet_length("pcm").cast("long").alias("pcm_bytes"),
        F.sha2("pcm", 256).alias("pcm_sha256"),
    )
