"""Texts stored as sound: WAV bytes in a column, and spectral-peak pairs with the time at which they begin.

A payload's bytes are the 8-bit samples of a mono WAV.  Reading it back gives the payload and its fingerprint: a short-time
Fourier transform, the strongest bin of each band in each frame, and pairs of such peaks a few frames apart.
"""

from __future__ import annotations

import io
import wave
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millwright.llm.common import extended

#: Samples a second (only a label here), samples of a frame and between frames, bands of bins, frames that a pair spans at most.
RATE, FRAME, HOP, BANDS, REACH = 8000, 1024, 512, ((2, 32), (32, 128), (128, 512)), 2
#: Payloads are padded with zero bytes to a positive multiple of this.
UNIT = 64


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


@lru_cache(1)
def _taper() -> np.ndarray:
    return np.hanning(FRAME + 1)[:-1]


def peaks(samples: np.ndarray) -> np.ndarray:
    """The strongest bin of each band, one row a frame; the last frame is filled up with silence."""
    count = max(1, -(-max(0, len(samples) - FRAME) // HOP) + 1)
    padded = np.zeros((count - 1) * HOP + FRAME)
    padded[: len(samples)] = samples.astype(np.float64) - 128
    frames = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP]
    out = np.zeros((count, len(BANDS)), np.int32)
    for lo in range(0, count, 256):
        power = np.round(np.abs(np.fft.rfft(frames[lo : lo + 256] * _taper(), axis=1)), 6)
        for k, (a, b) in enumerate(BANDS):
            out[lo : lo + 256, k] = power[:, a:b].argmax(axis=1) + a
    return out


def peak_pairs(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frame, pair) of all pairs of a frame's peak with the same band's peak up to ``REACH`` frames later; a lone frame pairs with itself."""
    bins = peaks(samples).astype(np.int64)
    times, pairs = [], []
    for gap in range(1, REACH + 1) if len(bins) > 1 else [0]:
        a, b = bins[: len(bins) - gap], bins[gap:]
        times.append(np.repeat(np.arange(len(a)), len(BANDS)))
        pairs.append((((a << 10) | b) << 4 | gap).ravel())
    time, pair = np.concatenate(times), np.concatenate(pairs)
    order = np.lexsort((pair, time))
    return time[order].astype(np.int32), pair[order]


def store_media(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with n_bytes long (of the UTF-8 text) and media binary (a WAV whose samples are the padded bytes).

    Null and empty texts are stored as one unit of zero bytes; repeated texts give equal bytes; very long texts are stored whole;
    an empty table gives an empty one.  Columns already so named are replaced, all others kept.
    """

    def work(batch):
        raw = [(t or "").encode("utf-8", "replace") for t in batch.column("t").to_pylist()]
        return [pa.array([len(r) for r in raw], pa.int64()), pa.array([to_wav(r + bytes(-len(r) % UNIT if r else UNIT)) for r in raw], pa.binary())]

    return extended(docs, {"t": F.col(text_col).cast("string")}, T.StructType().add("n_bytes", "long").add("media", "binary"), work)


MARKS = T.ArrayType(T.StructType().add("t", "integer").add("pair", "long"))


def read_media(stored: DataFrame, *, media_col: str = "media") -> DataFrame:
    """``stored`` with payload binary, as read back from the WAV, and marks array<struct<t int, pair long>>.

    Null media give a null payload and null marks; equal media give equal marks; long ones are read whole, a few frames at a time
    for the transform; an empty table gives an empty one.  Columns already so named are replaced, all others kept.
    """
    kind = pa.list_(pa.struct([("t", pa.int32()), ("pair", pa.int64())]))

    def work(batch):
        payloads, marks = [], []
        for m in batch.column("m").to_pylist():
            payloads.append(None if m is None else from_wav(m))
            if m is None:
                marks.append(None)
            else:
                t, pair = peak_pairs(np.frombuffer(payloads[-1], np.uint8))
                marks.append([{"t": a, "pair": b} for a, b in zip(t.tolist(), pair.tolist())])
        return [pa.array(payloads, pa.binary()), pa.array(marks, kind)]

    return extended(stored, {"m": F.col(media_col).cast("binary")}, T.StructType().add("payload", "binary").add("marks", MARKS), work)
