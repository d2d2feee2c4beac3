"""Operator 3, media columns: texts as WAV sound, with spectral-peak pair fingerprints.

A payload is stored as the samples of a mono, 8-bit WAV file by the ``wave`` module and
read back by it. The samples then go through a short-time Fourier transform. In each of a
few frequency bands the strongest bin of a frame is a peak where no neighbouring frame has
a stronger one in that band. A peak pairs with the next peaks that follow it; a pair
(its two bins and their distance) is a landmark, and the landmarks form an array of
(frame, hash) in time order.

Defined results: a null or empty payload text is 64 zero bytes, so one silent clip without
peaks; equal texts give equal values; repeated rows give repeated results; an empty table
gives an empty result. Long texts go through the transform in blocks of frames, so memory
beyond the payload itself is a small fraction of it. The operator reads its id and
text columns by name, so further columns of any name don't matter.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

FRAME, HOP, RATE = 1024, 512, 8000
BANDS = (4, 16, 48, 128, 512)
NEIGHBOURS, FAN_OUT, BLOCK_FRAMES = 3, 3, 2048

SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, n_frames int, landmarks array<struct<frame:int,hash:int>>"
)
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_bytes", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_sha256", pa.string()),
        ("tail_crc32", pa.int64()),
        ("media_bytes", pa.int64()),
        ("media_sha256", pa.string()),
        ("feature", pa.string()),
        ("n_frames", pa.int32()),
        ("landmarks", pa.list_(pa.struct([("frame", pa.int32()), ("hash", pa.int32())]))),
    ]
)


def pad(data: bytes) -> bytes:
    """``data`` with zero bytes up to a positive multiple of 64."""
    return data + bytes(64 - len(data) if not data else -len(data) % 64)


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as w:
        return w.readframes(w.getnframes())


def band_peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(frame, bin) of the spectral peaks in time order, and the number of frames."""
    n_frames = max(1, -(-(len(samples) - FRAME) // HOP) + 1)
    power = np.empty((n_frames, len(BANDS) - 1), dtype=np.float32)
    bins = np.empty((n_frames, len(BANDS) - 1), dtype=np.int16)
    window = np.hanning(FRAME).astype(np.float32)
    for start in range(0, n_frames, BLOCK_FRAMES):
        stop = min(n_frames, start + BLOCK_FRAMES)
        need = (stop - start - 1) * HOP + FRAME
        part = np.zeros(need, dtype=np.float32)
        have = samples[start * HOP : start * HOP + need]
        part[: len(have)] = have
        part[: len(have)] -= 128.0
        frames = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP] * window
        spectrum = np.fft.rfft(frames, axis=1)
        strength = (spectrum.real * spectrum.real + spectrum.imag * spectrum.imag).astype(np.float32)
        for k in range(len(BANDS) - 1):
            band = strength[:, BANDS[k] : BANDS[k + 1]]
            best = band.argmax(axis=1)
            bins[start:stop, k] = best + BANDS[k]
            power[start:stop, k] = band[np.arange(len(best)), best]
    around = power.copy()
    for shift in range(1, NEIGHBOURS + 1):
        if n_frames > shift:
            around[shift:] = np.maximum(around[shift:], power[:-shift])
            around[:-shift] = np.maximum(around[:-shift], power[shift:])
    frame, band = np.nonzero((power >= around) & (power > 1.0))
    return frame, bins[frame, band].astype(np.int64), n_frames


def landmarks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(frame, hash) of the peak pairs, ordered by frame; bins take 9 bits, distances 10."""
    frame, bin_, n_frames = band_peaks(samples)
    times, hashes = [], []
    for ahead in range(1, FAN_OUT + 1):
        if len(frame) > ahead:
            gap = frame[ahead:] - frame[:-ahead]
            times.append(frame[:-ahead])
            hashes.append((bin_[:-ahead] << 19) | (bin_[ahead:] << 10) | np.minimum(gap, 1023))
    if not times:
        return np.empty(0, np.int32), np.empty(0, np.int32), n_frames
    t, h = np.concatenate(times), np.concatenate(hashes)
    order = np.lexsort((h, t))
    return t[order].astype(np.int32), h[order].astype(np.int32), n_frames


def clip(text: str | None) -> tuple:
    """All values of one text but its id and landmark arrays, then these arrays."""
    data = (text or "").encode("utf-8", "surrogatepass")
    stored = to_wav(pad(data))
    back = from_wav(stored)
    t, h, n_frames = landmarks(np.frombuffer(back, dtype=np.uint8))
    mark = hashlib.blake2b(t.tobytes() + h.tobytes(), digest_size=12).hexdigest()
    return (
        len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored),
        hashlib.sha256(stored).hexdigest(), f"{n_frames}:{len(t)}:{mark}", n_frames, t, h,
    )


def _clips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            rows = [clip(x.as_py()) for x in part.column(1)]
            if not rows:
                continue
            *plain, times, hashes = (list(c) for c in zip(*rows, strict=True))
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in times])]).astype(np.int32)
            pairs = pa.StructArray.from_arrays(
                [pa.array(np.concatenate(times), pa.int32()), pa.array(np.concatenate(hashes), pa.int32())], ["frame", "hash"]
            )
            arrays = [part.column(0), *(pa.array(v, _ARROW.field(i + 1).type) for i, v in enumerate(plain))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.ListArray.from_arrays(pa.array(offsets), pairs)], schema=_ARROW)


def sound_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df`` with the values of ``SCHEMA``."""
    narrow = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.transform(arrow_map, _clips, SCHEMA)
