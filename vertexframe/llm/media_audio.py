"""Media columns: telephony audio.

Bytes become the samples of a mu-law or A-law WAV file (8 bits, 8 kHz), or the blocks of an IMA ADPCM
one, without loss; reading parses the file again.  Decoding expands mu-law and A-law by lookup tables and
decodes ADPCM with numpy across all blocks of a batch at once (the loop runs over places in a block, never
over blocks); the samples are resampled by linear interpolation and stored as 16-bit PCM.  Where no codec is
named, the payload's checksum picks one of the three, so equal texts are stored alike.

Defined results: a null text counts as empty; an empty payload is padded to one unit; equal texts give
equal values; repeated rows are kept; an empty table gives an empty result.  store_audio reads the id and
text columns only; decode_audio passes other columns on as they are, but for those that clash (in upper or
lower case) with the ones it adds, which are replaced.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .common import ROW, col, held, others, raw_values, released, slices

#: Payloads are padded with PAD to a positive multiple of UNIT, which is also the size of an ADPCM block.
UNIT, PAD, RATE = 192, 32, 8000
#: Format tags of WAV files (fixed values).
TAGS = {"alaw": 6, "mulaw": 7, "adpcm": 0x11}
CODECS = ("mulaw", "alaw", "adpcm")
#: The IMA ADPCM index table (fixed values).
INDEX_STEPS = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


def ima_steps() -> np.ndarray:
    """The 89 IMA step sizes (fixed values)."""
    return np.array(
        [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494,
         544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487,
         12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767], np.int32)


def mulaw_table() -> np.ndarray:
    """16-bit value of each mu-law code (ITU-T G.711)."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((code & 15) << 3) + 0x84 << (code >> 4 & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """16-bit value of each A-law code (ITU-T G.711)."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    low, exponent = (code & 15) << 4, code >> 4 & 7
    size = np.where(exponent == 0, low + 8, low + 0x108 << np.maximum(exponent - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


TABLES = {"mulaw": mulaw_table(), "alaw": alaw_table()}
STEPS = ima_steps()


def payload_of(raw: bytes) -> bytes:
    return raw + bytes([PAD]) * (-len(raw) % UNIT if raw else UNIT)


def wav(payload: bytes, codec: str) -> bytes:
    """A WAV file of one channel that holds the payload as it is."""
    if codec == "adpcm":
        per_block = (UNIT - 4) * 2 + 1
        fmt = struct.pack("<HHIIHHHH", TAGS[codec], 1, RATE, RATE * UNIT // per_block, UNIT, 4, 2, per_block)
        count = len(payload) // UNIT * per_block
    else:
        fmt, count = struct.pack("<HHIIHHH", TAGS[codec], 1, RATE, RATE, 1, 8, 0), len(payload)
    chunks = b"".join(name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1) for name, body in ((b"fmt ", fmt), (b"fact", struct.pack("<I", count)), (b"data", payload)))
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def read_wav(media: bytes) -> tuple[str, memoryview]:
    """Codec and stored samples of a WAV file."""
    view, at, codec, data = memoryview(media), 12, "", memoryview(b"")
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    while at + 8 <= len(view):
        name, size = bytes(view[at : at + 4]), struct.unpack_from("<I", view, at + 4)[0]
        body = view[at + 8 : at + 8 + size]
        if name == b"fmt ":
            codec = {v: k for k, v in TAGS.items()}[struct.unpack_from("<H", body)[0]]
        elif name == b"data":
            data = body
        at += 8 + size + (size & 1)
    return codec, data


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """(n, size) bytes of IMA ADPCM blocks -> (n, 2 * (size - 4) + 1) samples; all blocks step together."""
    n, size = blocks.shape
    value = blocks[:, 0:2].copy().view("<i2").ravel().astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    out = np.empty((2 * (size - 4) + 1, n), np.int16)
    out[0] = value
    body = np.ascontiguousarray(blocks[:, 4:].T)
    # Change of value for each (index, nibble), so that a sample costs two lookups and a clip.
    nibble = np.arange(16)
    step = STEPS[:, None]
    change = (step >> 3) + (nibble & 4 > 0) * step + (nibble & 2 > 0) * (step >> 1) + (nibble & 1 > 0) * (step >> 2)
    change = np.where(nibble & 8, -change, change).astype(np.int32).ravel()
    moved = np.clip(np.arange(89)[:, None] + INDEX_STEPS[None, :], 0, 88).astype(np.int32).ravel()
    for k in range(size - 4):
        for half, code in enumerate((body[k] & 15, body[k] >> 4)):
            place = index * 16 + code
            value = np.clip(value + change[place], -32768, 32767)
            index = moved[place]
            out[2 * k + half + 1] = value
    return out.T


def resample(samples: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation; doubling, the usual case, without a search."""
    if to == rate or not len(samples):
        return samples
    if to == 2 * rate:
        out = np.empty(2 * len(samples), np.int16)
        out[::2] = samples
        out[1:-1:2] = (samples[:-1].astype(np.int32) + samples[1:]) >> 1
        out[-1] = samples[-1]
        return out
    at = np.arange(len(samples) * to // rate) * (rate / to)
    return np.rint(np.interp(at, np.arange(len(samples)), samples)).astype(np.int16)


def codec_of(payload: bytes) -> str:
    return CODECS[zlib.crc32(payload) % len(CODECS)]


def store_audio(df: DataFrame, *, codec: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and `media`: a WAV file of the padded bytes of each text."""
    base = df.select(col(id_col).alias("id"), col(text_col).alias("text"))
    id_type = base.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 22):
            payloads = [payload_of(raw) for raw in raw_values(part.column("text"))]
            sizes = [len(raw) for raw in raw_values(part.column("text"))]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sizes, pa.int64()), pa.array([wav(p, codec or codec_of(p)) for p in payloads], pa.binary())], ["id", "n_bytes", "media"])

    return base.mapInArrow(run, f"id {id_type}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def measure(wave: np.ndarray) -> str:
    """Mean absolute value, peak and sign changes of samples."""
    loud = np.abs(wave.astype(np.int32))
    turns = int(np.count_nonzero((wave[1:] < 0) != (wave[:-1] < 0)))
    return f"n={len(wave)};mean={int(loud.sum()) // max(1, len(wave))};peak={int(loud.max(initial=0))};turns={turns}"


def expand_all(stored: list[tuple[str, memoryview]]) -> list[np.ndarray]:
    """Samples of each stored file; the ADPCM blocks of all files are decoded at once."""
    blocks = [np.frombuffer(d, np.uint8).reshape(-1, UNIT) for codec, d in stored if codec == "adpcm"]
    waves = iter(np.split(decode_adpcm(np.concatenate(blocks)), np.cumsum([len(b) for b in blocks])[:-1]) if blocks else [])
    return [next(waves).ravel() if codec == "adpcm" else TABLES[codec][np.frombuffer(d, np.uint8)] for codec, d in stored]


ADDED = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm")


def decode_audio(df: DataFrame, *, id_col: str = "doc_id", media_col: str = "media", to_rate: int = 16000) -> DataFrame:
    """Digests, features and resampled PCM of stored audio, from its stored bytes alone.

    feature: codec, samples, mean absolute value, peak, sign changes, and the checksum of the PCM.
    """
    kept = others(df, (*ADDED, media_col))
    base = df.select(held(kept), col(media_col).alias("media"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                part = batch.slice(k, 128)
                out: dict[str, list] = {n: [] for n in ADDED}
                media = part.column("media").to_pylist()
                stored = [read_wav(m) for m in media]
                for m, (codec, data), wave in zip(media, stored, expand_all(stored)):
                    pcm = resample(wave, RATE, to_rate).astype("<i2", copy=False).tobytes()
                    found = (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(m), hashlib.sha256(m).hexdigest(), f"{codec};{measure(wave)};pcm={zlib.crc32(pcm):08x}", pcm)
                    for n, x in zip(ADDED, found):
                        out[n].append(x)
                kinds = {"payload_sha256": pa.string(), "media_sha256": pa.string(), "feature": pa.string(), "pcm": pa.binary()}
                yield pa.RecordBatch.from_arrays([part.column(ROW), *(pa.array(v, kinds.get(n, pa.int64())) for n, v in out.items())], [ROW, *out])

    types = {"payload_sha256": StringType(), "media_sha256": StringType(), "feature": StringType(), "pcm": BinaryType()}
    schema = StructType([base.schema[ROW], *(StructField(n, types.get(n, LongType())) for n in ADDED)])
    return base.mapInArrow(run, schema).select(*released(kept), *ADDED)
