"""Media columns (operator 2): bytes as 8-bit WAV, short-time spectra, and spectral-peak pairs as time-coded arrays.

A null text counts as empty. A payload is the UTF-8 bytes and zeros up to a positive multiple of 64, so an empty text has one
block. Equal texts have equal payloads, WAV bytes and fingerprints. Long texts go through the spectra block by block.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

RATE, FRAME, HOP, FRAMES_AT_ONCE = 8000, 128, 64, 8192
#: A peak stands out over this many frames to either side, and is paired with so many peaks after it.
AROUND, FAN_OUT, FAR = 2, 3, 255
#: Bands of bins, first and past the last; the constant bin 0 is left out.
BANDS = ((1, 8), (8, 24), (24, FRAME // 2 + 1))
_WINDOW = np.hanning(FRAME).astype(np.float32)
SCHEMA = "array<struct<t:int,code:int>>"


def payload(text: str | None) -> bytes:
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + bytes(-len(data) % 64 or (64 if not data else 0))


def to_wav(data: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(data)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("one channel of 8-bit samples is expected")
        return w.readframes(w.getnframes())


def spectra(samples: bytes):
    """Magnitudes (frames x bins) of the short-time Fourier transform, so many frames at once; the end is padded with silence."""
    x = np.frombuffer(samples, np.uint8)
    frames = max(1, -(-len(x) // HOP))
    for at in range(0, frames, FRAMES_AT_ONCE):
        n = min(FRAMES_AT_ONCE, frames - at)
        part = np.full((n - 1) * HOP + FRAME, 128, np.uint8)
        piece = x[at * HOP : at * HOP + len(part)]
        part[: len(piece)] = piece
        block = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP].astype(np.float32)
        block -= 128
        block *= _WINDOW
        yield np.abs(np.fft.rfft(block, axis=1))


def peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Times (in hops) and bins of peaks, by time and bin: in each band a frame's strongest bin, where it is the strongest of the band's in the frames around."""
    bins, powers = [], []
    for m in spectra(samples):
        best = np.column_stack([low + m[:, low:high].argmax(axis=1) for low, high in BANDS])
        bins.append(best)
        powers.append(np.take_along_axis(m, best, 1))
    b, p = np.concatenate(bins), np.concatenate(powers)
    padded = np.full((len(p) + 2 * AROUND, len(BANDS)), -1, p.dtype)
    padded[AROUND:-AROUND] = p
    top = padded[: len(p)].copy()
    for k in range(1, 2 * AROUND + 1):
        np.maximum(top, padded[k : k + len(p)], out=top)
    t, band = np.nonzero((p >= top) & (p > 0))
    return t, b[t, band]


def fingerprint(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Times and codes of peak pairs, by time: code = first bin, second bin and the time between, 7, 7 and 8 bits."""
    t, b = peaks(samples)
    times, codes = [], []
    for k in range(1, FAN_OUT + 1):
        dt = t[k:] - t[:-k]
        near = dt <= FAR
        times.append(t[:-k][near])
        codes.append((b[:-k][near] << 15) | (b[k:][near] << 8) | dt[near])
    times, codes = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((codes, times))
    return times[order].astype("<i4"), codes[order].astype("<i4")


def store(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_bytes, media): the stored form of each text."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len((t or "").encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array([to_wav(payload(t)) for t in texts], pa.binary())], names=[key, "n_bytes", "media"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_bytes long, media binary")


def fingerprints(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """Rows (key, peaks): time-coded arrays of peak pairs of stored WAV bytes; null media has none."""
    kind = media.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = [None if m is None else [{"t": t, "code": c} for t, c in zip(*(x.tolist() for x in fingerprint(from_wav(m))))] for m in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.struct([("t", pa.int32()), ("code", pa.int32())])))], names=[key, "peaks"])

    return media.select(key, column).mapInArrow(run, f"`{key}` {kind}, peaks {SCHEMA}")


def _lists(rows: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    """Time-coded arrays: a list of (t, code) for each row of times and codes."""
    ends = pa.array(np.cumsum([0, *(len(t) for t, _ in rows)]).astype(np.int32))
    t, code = (np.concatenate([*(r[k] for r in rows), np.empty(0, np.int32)]).astype(np.int32) for k in (0, 1))
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(t), pa.array(code)], names=["t", "code"]))


def digest(docs: DataFrame, at_once: int = 256) -> DataFrame:
    """Stores each text, reads the stored bytes back and returns their digests, the fingerprint's, and the fingerprint itself as a time-coded array; one pass, no shuffle."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_pairs", "pairs"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def one(text):
        raw = payload(text)
        stored = to_wav(raw)
        back = from_wav(stored)
        times, codes = fingerprint(back)
        feature = hashlib.sha256(times.tobytes() + codes.tobytes()).hexdigest()
        n = len((text or "").encode("utf-8", "surrogatepass"))
        return (n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, len(times)), (times, codes)

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, at_once):
                b = whole.slice(at, at_once)
                rows, found = zip(*(one(t.as_py()) for t in b.column(1)))
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds)), _lists(found)], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pairs long, pairs {SCHEMA}")
