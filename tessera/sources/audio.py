"""Audio: decoding, framing and MFCC features with NumPy, with the extractor as a parameter."""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tessera.session import ship
from tessera.sources import files

EXTENSIONS = [".wav", ".mp3", ".flac", ".ogg"]
RATE = 16_000


def decode(content: bytes, rate: int = RATE) -> np.ndarray:
    """Mono samples at `rate` of a PCM WAVE file; channels are averaged."""
    with wave.open(io.BytesIO(content)) as w:
        width, channels, own, raw = w.getsampwidth(), w.getnchannels(), w.getframerate(), w.readframes(w.getnframes())
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    elif width in (2, 4):
        x = np.frombuffer(raw, f"<i{width}") / float(1 << (8 * width - 1))
    else:
        raise ValueError(f"samples of {width} bytes aren't read")
    x = x.reshape(-1, channels).mean(axis=1)
    if own == rate or not len(x):
        return x.astype(np.float32)
    if own > rate:  # a box as wide as the new step against aliasing
        box = max(1, round(own / rate))
        x = np.convolve(x, np.ones(box) / box, mode="same")
    at = np.arange(int(len(x) * rate / own)) * own / rate
    return np.interp(at, np.arange(len(x)), x).astype(np.float32)


def frames(x: np.ndarray, rate: int = RATE, window_ms: int = 100, hop_ms: int = 100) -> np.ndarray:
    """Frames of a signal; one that is shorter than a frame is padded with zeros."""
    size, hop = int(rate * window_ms / 1000), int(rate * hop_ms / 1000)
    if len(x) < size:
        x = np.pad(x, (0, size - len(x)))
    return np.lib.stride_tricks.sliding_window_view(x, size)[::hop]


@lru_cache(4)
def mel_filters(rate: int, size: int, bands: int = 128) -> np.ndarray:
    """Triangular filters of unit area on a mel scale that is linear below 1 kHz and logarithmic above."""
    step = np.log(6.4) / 27
    to_mel = lambda f: np.where(f < 1000, 3 * f / 200, 15 + np.log(np.maximum(f, 1e-9) / 1000) / step)
    to_hz = lambda m: np.where(m < 15, 200 * m / 3, 1000 * np.exp(step * (m - 15)))
    edges = to_hz(np.linspace(to_mel(np.array(0.0)), to_mel(np.array(rate / 2)), bands + 2))
    f = np.fft.rfftfreq(size, 1 / rate)[:, None]
    up, down = (f - edges[:-2]) / np.diff(edges)[:-1], (edges[2:] - f) / np.diff(edges)[1:]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edges[2:] - edges[:-2]))


def mfcc(content: bytes, n_mfcc: int = 13, window_ms: int = 100, hop_ms: int = 100, rate: int = RATE, floor_db: float = 80.0) -> np.ndarray:
    """(frames, n_mfcc): orthonormal cosine transform of mel energies in decibels, at most floor_db below the loudest."""
    x = frames(decode(content, rate), rate, window_ms, hop_ms)
    size = x.shape[1]
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    power = np.abs(np.fft.rfft(x * hann, axis=1)) ** 2
    level = 10 * np.log10(np.maximum(power @ mel_filters(rate, size), 1e-10))
    level = np.maximum(level, level.max() - floor_db)
    bands = level.shape[1]
    basis = np.cos(np.pi * np.outer(np.arange(n_mfcc), np.arange(bands) + 0.5) / bands) * np.sqrt(2 / bands)
    basis[0] /= np.sqrt(2)
    return (level @ basis.T).astype(np.float32)


def extract(media: DataFrame, extractor: Callable[[bytes], np.ndarray], id_col: str = "stem", content_col: str = "content") -> DataFrame:
    """(doc_id, vec_idx, features, error): a row for each feature vector, and one with an error for media that fail."""
    ship(media.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for doc, content in zip(pdf[id_col], pdf[content_col]):
                try:
                    found = extractor(bytes(content))
                    rows = [(doc, i, v.tolist(), None) for i, v in enumerate(found)]
                except Exception as e:  # noqa: BLE001  one unreadable file must not end the job; the row says why
                    rows = [(doc, None, None, f"{type(e).__name__}: {e}"[:200])]
                if rows:
                    yield pd.DataFrame(rows, columns=["doc_id", "vec_idx", "features", "error"])

    kind = media.schema[id_col].dataType.simpleString()
    return media.select(id_col, content_col).mapInPandas(run, f"doc_id {kind}, vec_idx int, features array<float>, error string")


def features(spark: SparkSession, folder: str, extractor: Callable[[bytes], np.ndarray] = mfcc) -> DataFrame:
    """Feature rows of all audio files below a folder; formats without a decoder give error rows."""
    return extract(files.contents(spark, folder, EXTENSIONS), extractor)
