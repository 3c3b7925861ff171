"""Media columns: payloads stored as WAV files, read back, and fingerprinted by pairs of spectral peaks.

Every payload is one mono file of 8-bit samples written and read by the ``wave`` module. The samples read back go
through a short-time Fourier transform (Hann frames of 384, hop 192); in each of four frequency bands a frame's
strongest bin is a peak if it is no weaker than the same band's peak in the frames beside it. A peak pairs with the next two
peaks of its band within 32 frames; each pair is one time-coded entry (frame, first bin << 16 | second bin << 8 | distance),
and a peak with no later one in reach is an entry of its own (distance and second bin 0).
Long files are transformed some thousand frames at a time.

Defined results: a null payload counts as empty; an empty one is padded to one unit of 192 samples; silence (all samples
equal) has no pairs; equal payloads have equal files and fingerprints.
"""

from __future__ import annotations

import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vellum.llm.common import small_batches

UNIT, FRAME, HOP, RATE, BANDS, FANOUT, REACH, BLOCK = 192, 384, 192, 8000, (2, 12, 32, 80, 193), 2, 32, 4096
_WINDOW = np.hanning(FRAME).astype(np.float32)


def write_wav(samples: bytes) -> bytes:
    """A mono WAV file of 8-bit samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(samples)
    return out.getvalue()


def read_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Bin and strength of the strongest bin of each frame and band."""
    x = np.frombuffer(samples, np.uint8).astype(np.float32) - 128
    n = max(1, -(-(len(x) - FRAME) // HOP) + 1)
    x = np.pad(x, (0, (n - 1) * HOP + FRAME - len(x)))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    bins, power = [], []
    for at in range(0, n, BLOCK):
        part = frames[at : at + BLOCK]
        spec = np.fft.rfft((part - part.mean(axis=1, keepdims=True)) * _WINDOW, axis=1)
        mag = np.round(spec.real**2 + spec.imag**2, 3)
        at_most = [lo + mag[:, lo:hi].argmax(axis=1) for lo, hi in zip(BANDS, BANDS[1:], strict=False)]
        bins.append(np.stack(at_most, axis=1))
        power.append(np.take_along_axis(mag, bins[-1], axis=1))
    return np.concatenate(bins), np.concatenate(power)


def fingerprint(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Frame and code of every pair of peaks, by frame."""
    bins, power = peaks(samples)
    edge = np.full((1, power.shape[1]), -1, power.dtype)
    keep = (power > 1) & (power >= np.vstack([edge, power[:-1]])) & (power >= np.vstack([power[1:], edge]))
    times, codes = [], []
    for b in range(bins.shape[1]):
        t = np.flatnonzero(keep[:, b])
        f = bins[t, b]
        alone = np.append(np.diff(t) > REACH, True)[: len(t)]
        times.append(t[alone])
        codes.append(f[alone] << 16)
        for k in range(1, FANOUT + 1):
            gap = t[k:] - t[:-k]
            near = gap <= REACH
            times.append(t[:-k][near])
            codes.append((f[:-k] << 16 | f[k:] << 8 | gap)[near])
    t, c = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((c, t))
    return t[order].astype(np.int32), c[order].astype(np.int32)


def media_columns(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: id_col, n_bytes, media binary (the WAV file), payload binary (the samples read back from it),
    n_frames, fp_time array<int>, fp_code array<int>."""
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("raw"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                size, files, back, n_frames, t, c = [], [], [], [], [], []
                for raw in part.column(1).to_pylist():
                    size.append(len(raw))
                    files.append(write_wav(raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b" ")))
                    back.append(samples := read_wav(files[-1]))
                    a, b = fingerprint(samples)
                    n_frames.append(max(1, -(-(len(samples) - FRAME) // HOP) + 1))
                    t.append(a)
                    c.append(b)
                ints = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(size, pa.int64()), pa.array(files, pa.binary()), pa.array(back, pa.binary()), pa.array(n_frames, pa.int64()), pa.array(t, ints), pa.array(c, ints)],
                    ["id", "n_bytes", "media", "payload", "n_frames", "fp_time", "fp_code"],
                )

    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(run, f"id {kind}, n_bytes long, media binary, payload binary, n_frames long, fp_time array<int>, fp_code array<int>").withColumnRenamed("id", id_col)
