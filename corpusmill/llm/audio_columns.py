"""Media columns: 8-bit audio with log-mel features and time spans.

store() keeps a payload losslessly as the samples of a WAV file (8-bit, mono). analyse() reads the samples back
from the file's bytes, resamples them by polyphase filters, takes overlapped log-mel frames and finds active
spans by energy with hysteresis. Frames come as Arrow fixed-shape tensors (frames x bands, the last padded with
the floor value), one for each stretch of time, in Arrow IPC bytes beside their time spans.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batches, id_text, rows

UNIT = 192  #: a payload's length is a positive multiple of this many bytes
RATE = 16_000  #: samples a second in the file
UP, DOWN = 3, 4  #: resampling to 12 kHz
TAPS = 16  #: of each phase
FRAME, HOP = 256, 128  #: samples after resampling
BANDS = 20
TENSOR_FRAMES = 32  #: frames of one tensor
FLOOR = -10.0  #: log energy of silence
ENTER, LEAVE = 0.5, 0.1  #: hysteresis, in standard deviations of frame energy above the mean
BLOCK = 1 << 20  #: samples resampled at once, so that memory stays bounded beside the payload


def payload(text: str | None) -> bytes:
    """UTF-8 with spaces up to a positive multiple of UNIT bytes."""
    data = (text or "").encode()
    return data.ljust(max(1, -(-len(data) // UNIT)) * UNIT, b" ")


def to_wav(samples: bytes) -> bytes:
    """A RIFF file with 8-bit mono samples; sizes are those of the format (an even data size needs no pad)."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples)) + samples


def from_wav(media: bytes) -> bytes:
    """The samples of a RIFF file, found by walking its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(media):
        kind, size = struct.unpack_from("<4sI", media, at)
        if kind == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


@lru_cache(1)
def phases() -> np.ndarray:
    """TAPS x UP: windowed-sinc low-pass filter, dealt out to the phases."""
    n = TAPS * UP
    k = np.arange(n) - (n - 1) / 2
    h = np.sinc(k / max(UP, DOWN)) * np.hamming(n)
    h *= UP / h.sum()
    return h.reshape(TAPS, UP)[::-1].copy()


def resampled(x: np.ndarray) -> np.ndarray:
    """Output m is phase (m DOWN) mod UP over the TAPS inputs up to floor(m DOWN / UP)."""
    total = len(x) * UP // DOWN
    padded = np.r_[np.zeros(TAPS - 1), x, np.zeros(DOWN)]
    taps = phases()
    out = np.empty(-(-total // UP) * UP)
    for first in range(0, len(out) // UP, BLOCK // DOWN):
        last = min(first + BLOCK // DOWN, len(out) // UP)
        window = np.lib.stride_tricks.sliding_window_view(padded[first * DOWN : (last - 1) * DOWN + TAPS + DOWN - 1], TAPS)
        for p in range(UP):
            skip, phase = divmod(p * DOWN, UP)
            out[first * UP + p : last * UP : UP] = window[skip::DOWN][: last - first] @ taps[:, phase]
    return out[:total]


@lru_cache(1)
def mel_bank() -> np.ndarray:
    """Triangles, evenly spaced on the mel scale, over the bins of a frame's spectrum."""
    rate = RATE * UP / DOWN
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(60), mel(rate / 2), BANDS + 2) / 2595) - 1)
    bins = np.arange(FRAME // 2 + 1) * rate / FRAME
    left, mid, right = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.clip(np.minimum((bins - left) / (mid - left), (right - bins) / (right - mid)), 0, None).T


def log_mel(y: np.ndarray) -> np.ndarray:
    """Frames x bands; the tail is padded with silence to a whole frame."""
    count = max(1, -(-max(len(y) - FRAME, 0) // HOP) + 1)
    y = np.r_[y, np.zeros((count - 1) * HOP + FRAME - len(y))] if len(y) < (count - 1) * HOP + FRAME else y
    frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
    window, bank = np.hanning(FRAME), mel_bank()
    out = np.empty((count, BANDS), np.float32)
    for a in range(0, count, 2048):
        power = np.abs(np.fft.rfft(frames[a : a + 2048][: count - a] * window)) ** 2 / FRAME
        out[a : a + 2048] = np.log(np.maximum(power @ bank, np.exp(FLOOR)))
    return out


def active(energy: np.ndarray) -> list[tuple[int, int]]:
    """Runs of frames that start above one threshold and last while above a lower one."""
    spread = float(energy.std())
    if spread < 1e-6:
        return []
    high, low = energy > energy.mean() + ENTER * spread, energy > energy.mean() + LEAVE * spread
    edges = np.flatnonzero(np.diff(np.r_[0, low.astype(np.int8), 0]))
    starts, ends = edges[::2], edges[1::2]
    seen = np.r_[0, np.cumsum(high)]
    return [(int(a), int(b)) for a, b in zip(starts, ends, strict=True) if seen[b] > seen[a]]


def second(frame: int) -> float:
    return frame * HOP * DOWN / (RATE * UP)


def tensors(mel: np.ndarray) -> bytes:
    """Arrow IPC stream: start_s, end_s, mel as fixed_shape_tensor(float32, [TENSOR_FRAMES, BANDS])."""
    n = -(-len(mel) // TENSOR_FRAMES)
    whole = np.full((n * TENSOR_FRAMES, BANDS), FLOOR, np.float32)
    whole[: len(mel)] = mel
    kind = pa.fixed_shape_tensor(pa.float32(), [TENSOR_FRAMES, BANDS])
    storage = pa.FixedSizeListArray.from_arrays(pa.array(whole.ravel()), TENSOR_FRAMES * BANDS)
    starts = [second(k * TENSOR_FRAMES) for k in range(n)]
    ends = [second(min((k + 1) * TENSOR_FRAMES, len(mel)) - 1) + FRAME * DOWN / (RATE * UP) for k in range(n)]
    batch = pa.record_batch([pa.array(starts, pa.float64()), pa.array(ends, pa.float64()), pa.ExtensionArray.from_storage(kind, storage)], names=["start_s", "end_s", "mel"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def analysed(media: bytes) -> tuple[bytes, bytes, list[dict], str]:
    """(samples read back, tensors, spans, summary) of one file."""
    samples = from_wav(media)
    x = (np.frombuffer(samples, np.uint8).astype(np.float64) - 128) / 128
    mel = log_mel(resampled(x))
    spans = [{"start_s": second(a), "end_s": second(b - 1) + FRAME * DOWN / (RATE * UP)} for a, b in active(mel.mean(1))]
    summary = f"frames={len(mel)};spans={len(spans)};active_s={sum(s['end_s'] - s['start_s'] for s in spans):.3f};mel=" + ",".join(f"{v:.3f}" for v in mel.mean(0))
    return samples, tensors(mel), spans, summary


def media_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media (WAV), payload (read back from media), tensors (Arrow IPC), spans, summary.

    A null or empty text has a payload of 192 spaces, no active span and n_bytes 0. Equal texts give equal
    values. Null ids and repeated rows stay: one row out for each row in. Narrow: no shuffle.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("payload", pa.binary()), ("tensors", pa.binary()), ("spans", pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))), ("summary", pa.string())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            for batch in it:
                for k, text in rows(batch):
                    media = to_wav(payload(text))
                    yield k, len((text or "").encode()), media, *analysed(media)

        yield from batches(out(), schema)

    return id_text(df, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, media binary, payload binary, tensors binary, spans array<struct<start_s:double,end_s:double>>, summary string")
