"""Telephony audio columns: mu-law, A-law and wideband IMA ADPCM in WAV, decoded to 16-bit PCM of one rate.

mu-law and A-law expand by lookup tables. ADPCM blocks are decoded together: the loop runs over the samples of a
block, and each step is one numpy operation over all blocks of the batch.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import byte_chunks, runs, store

#: WAVE format tags.
ALAW, MULAW, IMA_ADPCM = 0x0006, 0x0007, 0x0011
CODECS = (MULAW, ALAW, IMA_ADPCM)
NAMES = {MULAW: "mulaw", ALAW: "alaw", IMA_ADPCM: "ima_adpcm"}
RATES = {MULAW: 8000, ALAW: 8000, IMA_ADPCM: 16000}
RATE, UNIT, FILL = 8000, 576, 255
#: Parquet options of the media tables: they hold what is hard to compress, and much of it.
STORED = {"compression": "zstd", "parquet.compression.codec.zstd.level": "9", "parquet.page.size": str(8 << 20)}
BLOCK_SAMPLES = 1 + 2 * (UNIT - 4)
#: Fixed values of the IMA ADPCM format.
INDEX_STEP = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    np.int32,
)


@lru_cache(maxsize=1)
def expansion() -> dict[int, np.ndarray]:
    """The 256-entry tables of G.711, from its rules."""
    code = np.arange(256)
    u = ~code & 0xFF
    mu = ((((u & 0x0F) << 3) + 0x84) << (u >> 4 & 7)) - 0x84
    a = code ^ 0x55
    exponent, step = a >> 4 & 7, (a & 0x0F) << 4
    al = np.where(exponent == 0, step + 8, (step + 0x108) << np.maximum(exponent - 1, 0))
    return {MULAW: np.where(u & 0x80, -mu, mu).astype(np.int16), ALAW: np.where(a & 0x80, al, -al).astype(np.int16)}


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """(n, UNIT) bytes to (n, BLOCK_SAMPLES) samples. A start index over 88 counts as 88."""
    head = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    data = np.ascontiguousarray(blocks[:, 4:].T)  # a row is one byte of every block
    out = np.empty((BLOCK_SAMPLES, len(blocks)), np.int16)
    out[0] = value = head
    for i in range(len(data)):
        for k, code in enumerate((data[i] & 15, data[i] >> 4)):
            step = STEPS[index]
            size = code & 7
            delta = (step >> 3) + np.where(size & 4, step, 0) + np.where(size & 2, step >> 1, 0) + np.where(size & 1, step >> 2, 0)
            value = np.clip(np.where(code & 8, value - delta, value + delta), -32768, 32767)
            index = np.clip(index + INDEX_STEP[size], 0, 88)
            out[1 + 2 * i + k] = value
    return out.T


def pad(raw: bytes) -> bytes:
    """Fill up to a positive multiple of UNIT bytes."""
    return raw + bytes([FILL]) * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def wav(payload: bytes, codec: int) -> bytes:
    """A mono WAV file that holds the payload as it is."""
    rate = RATES[codec]
    if codec == IMA_ADPCM:
        fmt, n = struct.pack("<HHIIHHHH", codec, 1, rate, rate * UNIT // BLOCK_SAMPLES, UNIT, 4, 2, BLOCK_SAMPLES), len(payload) // UNIT * BLOCK_SAMPLES
    else:
        fmt, n = struct.pack("<HHIIHHH", codec, 1, rate, rate, 1, 8, 0), len(payload)
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    body = b"WAVE" + chunk(b"fmt ", fmt) + chunk(b"fact", struct.pack("<I", n)) + chunk(b"data", payload)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse_wav(media: bytes) -> tuple[int, int, bytes]:
    """(format tag, sample rate, data) of a WAV file; ValueError if it is none."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, codec, rate = 12, None, None
    while at + 8 <= len(media):
        name, n = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            codec, _, rate = struct.unpack_from("<HHI", media, at + 8)
        elif name == b"data":
            if codec is None:
                raise ValueError("data before fmt")
            return codec, rate, media[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)
    raise ValueError("no data chunk")


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Halving takes the means of pairs, rounded down (a last single sample stays); doubling puts means between samples;
    other rates interpolate, rounded half to even, and their length is scaled and rounded down."""
    if rate == to or not len(pcm):
        return pcm
    if rate == 2 * to:
        wide = np.append(pcm, pcm[-1:] if len(pcm) % 2 else []).astype(np.int32)
        return ((wide[::2] + wide[1::2]) >> 1).astype(np.int16)
    if to == 2 * rate:
        wide = pcm.astype(np.int32)
        out = np.empty(2 * len(pcm), np.int16)
        out[::2] = pcm
        out[1:-1:2] = (wide[1:] + wide[:-1]) >> 1
        out[-1] = pcm[-1]
        return out
    n = len(pcm) * to // rate
    return np.rint(np.interp(np.arange(n) * (rate / to), np.arange(len(pcm)), pcm)).astype(np.int16)


def decode_all(parsed: list[tuple[int, int, bytes]], to: int) -> list[np.ndarray]:
    """PCM of many parsed files at the rate ``to``; the ADPCM blocks of all of them are decoded together."""
    tables = expansion()
    adpcm = [x[2] for x in parsed if x[0] == IMA_ADPCM]
    whole = [b[: len(b) // UNIT * UNIT] for b in adpcm]
    pcm = iter(())
    if whole:
        out = decode_adpcm(np.frombuffer(b"".join(whole), np.uint8).reshape(-1, UNIT))
        pcm = iter(np.split(out, np.cumsum([len(b) // UNIT for b in whole])[:-1]))
    return [resample(next(pcm).reshape(-1) if codec == IMA_ADPCM else tables[codec][np.frombuffer(data, np.uint8)], rate, to) for codec, rate, data in parsed]


def encode_media(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts as telephony WAV files: doc_id, n_bytes, media.

    The UTF-8 bytes (null: none), filled up to a positive multiple of UNIT, are the data of the file; the codec
    follows from the data's CRC-32, so equal texts make equal files. Repeated rows stay; other columns are not read.
    """
    schema = f"{id_col} {dict(df.dtypes)[id_col]}, n_bytes long, media binary"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in byte_chunks(batches, text_col):
            payloads = map(pad, texts)
            media = [wav(p, CODECS[zlib.crc32(p) % 3]) for p in payloads]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], [id_col, "n_bytes", "media"])

    return df.select(id_col, text_col).mapInArrow(encode, schema)


def _media_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        media = batch.column("media").to_pylist()
        for i, j in runs(np.array([len(m) for m in media], np.int64), 1 << 20):
            yield batch.slice(i, j - i), media[i:j]


#: What is kept of a stored file beside its samples.
DIGESTS = {"payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string"}


def decode_media(df: DataFrame, *, to: int = RATE, id_col: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """The column ``media`` (WAV files) as PCM: id, ``keep`` columns, DIGESTS of the data, its last 32 bytes and the
    file, codec, rate, and pcm (little-endian 16-bit samples at the rate ``to``). Repeated rows stay; an empty table
    gives an empty result; a file that is no WAV fails the job."""
    types, names = dict(df.dtypes), [id_col, *(keep or [])]
    columns = [*names, *DIGESTS, "codec", "rate", "pcm"]
    schema = ", ".join(f"`{c}` {types[c]}" for c in names) + ", " + ", ".join(f"{c} {t}" for c, t in DIGESTS.items()) + ", codec string, rate int, pcm binary"

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, media in _media_chunks(batches):
            parsed = [parse_wav(m) for m in media]
            data, pcm = [p[2] for p in parsed], decode_all(parsed, to)
            digests = [
                pa.array(map(len, data), pa.int64()), pa.array([hashlib.sha256(d).hexdigest() for d in data], pa.string()), pa.array([zlib.crc32(d[-32:]) for d in data], pa.int64()),
                pa.array(map(len, media), pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in media], pa.string()),
            ]
            sound = [pa.array([NAMES[p[0]] for p in parsed], pa.string()), pa.array([to] * len(pcm), pa.int32()), pa.array([x.astype("<i2").tobytes() for x in pcm], pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *digests, *sound], columns)

    return df.select(*dict.fromkeys([*names, "media"])).mapInArrow(decode, schema)


def pcm_feature(codec: str, pcm: np.ndarray) -> str:
    """Codec, samples, peak, mean magnitude, sign changes and CRC-32 of the samples."""
    wide, low = np.abs(pcm.astype(np.int32)), pcm < 0
    return f"{codec}:{len(pcm)}:{wide.max()}:{wide.sum() // len(pcm)}:{np.count_nonzero(low[1:] != low[:-1])}:{zlib.crc32(pcm.tobytes()):08x}"


def pcm_features(df: DataFrame) -> DataFrame:
    """``df`` with ``feature`` in the place of codec, rate and pcm."""
    names = [c for c in df.columns if c not in ("codec", "rate", "pcm")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            feature = [pcm_feature(c, np.frombuffer(p.as_buffer(), "<i2")) for c, p in zip(batch.column("codec").to_pylist(), batch.column("pcm"), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(feature, pa.string())], [*names, "feature"])

    types = dict(df.dtypes)
    return df.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in names) + ", feature string")


def stored_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts as media that are written, read back, decoded to PCM that is written, and read back: id, n_bytes, DIGESTS
    and feature."""
    media = store(encode_media(docs, id_col=id_col, text_col=text_col), "media", **STORED).df
    return pcm_features(store(decode_media(media, id_col=id_col, keep=["n_bytes"]), "pcm", **STORED).df)
