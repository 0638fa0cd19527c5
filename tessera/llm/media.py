"""Media columns (operator 6): audio features of stored samples.

Media are 8-bit mono PCM in RIFF/WAVE containers.  Features: polyphase resampling by a rational factor with a windowed-sinc
filter, overlapped log-mel filterbanks, and segments of energy found with two thresholds (hysteresis).  Filterbanks are
cut into tensors of one fixed shape (FRAMES x BANDS), each with its time span; they are Arrow fixed-shape tensors
(`arrow_tensors`), whose storage is a list column of that length in Spark.  A feature is computed from that storage.

`store` makes each medium's file as a binary column, `describe` reads samples back from those bytes; between the two operators the
files travel in Arrow batches and are not written to disk by themselves.

Every medium is computed by itself with the same operations, so equal media have equal values.

Defined results: null and empty texts become one block of padding; a medium shorter than a frame is one padded frame;
media that aren't readable as WAVE get null features and an error text; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import common

BLOCK, PAD, RATE = 576, b"\xff", 8000
TARGET, FRAME, HOP, BANDS, FRAMES = 6000, 256, 128, 16, 32
#: Outputs of one phase that are computed at a time.
OUTPUTS = 1 << 14
LOUD_DB, QUIET_DB, FLOOR = -1.0, -3.0, 1e-10


def payload_of(raw: bytes) -> bytes:
    """The bytes, with 255 appended up to a positive multiple of BLOCK."""
    return raw + PAD * ((-len(raw)) % BLOCK if raw else BLOCK)


def write_wave(samples: bytes, rate: int = RATE) -> bytes:
    """8-bit mono PCM: one byte a sample, kept as it is."""
    pad = b"\0" * (len(samples) % 2)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples + pad


def read_wave(media: bytes) -> tuple[bytes, int]:
    """(samples, rate) of an 8-bit mono PCM file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt ":
            coding, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (coding, channels, bits) != (1, 1, 8):
                raise ValueError("only 8-bit mono PCM is read")
        elif kind == b"data":
            if at + 8 + size > len(media) or not rate:
                raise ValueError("truncated WAVE file")
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no samples")


@lru_cache(8)
def phases(up: int, down: int, half: int = 6) -> np.ndarray:
    """Windowed-sinc low-pass, as one row of taps for each of the `up` phases."""
    widest = max(up, down)
    n = 2 * half * widest + 1
    t = np.arange(n) - (n - 1) / 2
    taps = np.sinc(t / widest) * np.hamming(n)
    taps = np.concatenate([taps, np.zeros(-n % up)]) * up / taps.sum()
    return np.ascontiguousarray(taps.reshape(-1, up).T.astype(np.float32))


def resample(x: np.ndarray, rate: int, target: int) -> np.ndarray:
    """Polyphase resampling: output m takes the taps of phase (m * down) mod up, whose outputs lie `down` samples apart."""
    common_factor = gcd(rate, target)
    up, down = target // common_factor, rate // common_factor
    if up == down:
        return x
    rows = phases(up, down)
    taps = rows.shape[1]
    m = -(-len(x) * up // down)
    delay = (rows.size - up) // 2 if up > 1 else (taps - 1) // 2
    last = (np.arange(min(up, m)) * down + delay) // up  # newest sample of each phase's first output
    end = (m - 1) * down + delay
    padded = np.concatenate([np.zeros(taps - 1, np.float32), x, np.zeros(max(0, end // up + 1 - len(x)), np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, taps)
    out = np.empty(m, np.float32)
    for k, at in enumerate(last.tolist()):
        own, phase = windows[at::down], rows[(k * down + delay) % up, ::-1]
        count = -(-(m - k) // up)
        for i in range(0, count, OUTPUTS):
            n = min(OUTPUTS, count - i)
            out[k + i * up : k + (i + n) * up : up] = own[i : i + n] @ phase
    return out


@lru_cache(4)
def mel_bank(rate: int, frame: int, bands: int) -> np.ndarray:
    """Triangles on the mel scale, (frame / 2 + 1) x bands."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(0.0), mel(rate / 2), bands + 2) / 2595) - 1)
    f = np.fft.rfftfreq(frame, 1 / rate)[:, None]
    rise, fall = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def log_mel(x: np.ndarray, rate: int) -> np.ndarray:
    """(frames, BANDS) log10 energies of overlapped Hann frames; the last frame is padded with zeros."""
    n = max(1, -(-max(0, len(x) - FRAME) // HOP) + 1)
    x = np.concatenate([x, np.zeros((n - 1) * HOP + FRAME - len(x), np.float32)]).astype(np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    bank, window = mel_bank(rate, FRAME, BANDS), np.hanning(FRAME).astype(np.float32)
    out = np.empty((n, BANDS), np.float32)
    for i in range(0, n, 512):
        spectrum = np.fft.rfft(frames[i : i + 512] * window, axis=1)
        out[i : i + 512] = np.log10((spectrum.real**2 + spectrum.imag**2) @ bank + FLOOR)
    return out


def segments(x: np.ndarray, rate: int, loud: float = LOUD_DB, quiet: float = QUIET_DB) -> list[tuple[float, float]]:
    """Time spans (seconds) that begin above `loud` and go on until energy falls below `quiet`, in dB to the mean energy."""
    n = max(1, -(-len(x) // HOP))
    padded = np.concatenate([x, np.zeros(n * HOP - len(x), np.float32)]).reshape(n, HOP)
    energy = (padded.astype(np.float64) ** 2).mean(axis=1)
    level = 10 * np.log10((energy + FLOOR) / (energy.mean() + FLOOR))
    # The state after a frame is set by the last frame that was above `loud` (on) or below `quiet` (off).
    sets = np.where(level >= loud, 1, np.where(level < quiet, -1, 0))
    last = np.maximum.accumulate(np.where(sets != 0, np.arange(n), -1))
    on = (last >= 0) & (sets[last] > 0)
    edge = np.diff(np.concatenate([[0], on.astype(np.int8), [0]]))
    return [(a * HOP / rate, min(b * HOP, len(x)) / rate) for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())]


def features(samples: bytes, rate: int) -> tuple[np.ndarray, list[tuple[float, float]], list[tuple[float, float]]]:
    """(tensors (n, FRAMES, BANDS), their time spans, energy segments)."""
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    x = resample(x, rate, TARGET)
    mel = log_mel(x, TARGET)
    n = -(-len(mel) // FRAMES)
    full = np.full((n * FRAMES, BANDS), np.float32(np.log10(FLOOR)))
    full[: len(mel)] = mel
    length = len(x) / TARGET
    spans = [(i * FRAMES * HOP / TARGET, min(length, (((i + 1) * FRAMES - 1) * HOP + FRAME) / TARGET)) for i in range(n)]
    return full.reshape(n, FRAMES, BANDS), spans, segments(x, TARGET)


def arrow_tensors(values: np.ndarray, shape: tuple[int, int] = (FRAMES, BANDS)) -> pa.FixedShapeTensorArray:
    """Arrow's fixed-shape tensors of an array (n, *shape), or of a flat one."""
    flat = pa.array(np.ascontiguousarray(values, np.float32).ravel())
    return pa.ExtensionArray.from_storage(pa.fixed_shape_tensor(pa.float32(), shape), pa.FixedSizeListArray.from_arrays(flat, shape[0] * shape[1]))


def feature_digest(tensors: pa.FixedShapeTensorArray, spans: list, found: list) -> str:
    """Mean, spread and energy segments as text, with a hash of the tensors' storage in hundredths."""
    rounded = np.round(tensors.storage.values.to_numpy() * 100).astype(np.int32)
    share = sum(b - a for a, b in found) / max(spans[-1][1], 1e-9)
    return f"{len(tensors)}x{FRAMES}x{BANDS};mean={rounded.mean():.2f};sd={rounded.std():.2f};segments={len(found)};active={share:.3f};crc={zlib.crc32(rounded.tobytes()):08x}"


def extract(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row for each tensor: (id_col, chunk, start_s, end_s, tensor array<float>, segments, error).

    A medium that isn't readable has one row with an error and nulls (a null medium likewise).
    """

    def make(chunk: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[tuple] = []
        for key, media in zip(chunk.column(0).to_pylist(), chunk.column(1).to_pylist()):
            try:
                tensors, spans, found = features(*read_wave(media or b""))
            except ValueError as e:
                rows.append((key, None, None, None, None, None, str(e)))
                continue
            listed = [{"start_s": a, "end_s": b} for a, b in found]
            stored = arrow_tensors(tensors).storage.values.to_numpy().reshape(len(tensors), -1)
            rows += [(key, i, *span, stored[i], listed if i == 0 else None, None) for i, span in enumerate(spans)]
        kinds = [chunk.column(0).type, pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.float32()), pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())])), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [id_col, "chunk", "start_s", "end_s", "tensor", "segments", "error"])

    rows = df.select(id_col, media_col)
    kind = rows.schema[id_col].dataType.simpleString()
    return common.map_chunks(rows, make, f"`{id_col}` {kind}, chunk int, start_s double, end_s double, tensor array<float>, segments array<struct<start_s double, end_s double>>, error string", media_col)


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, media): each text's bytes, padded, as a WAVE file."""

    def make(chunk: pa.RecordBatch) -> pa.RecordBatch:
        raws = common.raw_texts(chunk.column(1))
        return pa.RecordBatch.from_arrays([chunk.column(0), pa.array([len(r) for r in raws], pa.int64()), pa.array([write_wave(payload_of(r)) for r in raws], pa.binary())], [id_col, "n_bytes", "media"])

    rows = df.select(id_col, common.text_or_empty(text_col).alias(text_col))
    return common.map_chunks(rows, make, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, n_bytes bigint, media binary", text_col)


def describe(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digests of stored media: the samples read back, the stored form, and the features."""

    def make(chunk: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for key, n, media in zip(*(chunk.column(i).to_pylist() for i in range(3))):
            samples, rate = read_wave(media)
            tensors, spans, found = features(samples, rate)
            text = feature_digest(arrow_tensors(tensors), spans, found)
            out.append((key, n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(media), hashlib.sha256(media).hexdigest(), text))
        kinds = [chunk.column(0).type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = stored.schema[id_col].dataType.simpleString()
    return common.map_chunks(stored.select(id_col, "n_bytes", "media"), make, f"`{id_col}` {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string", "media")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe(store(common.documents(spark, sf_dir)))
