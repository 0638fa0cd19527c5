"""Images: decoding, patches and gradient descriptors with NumPy, with the extractor as a parameter."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tessera.sources import audio, files

EXTENSIONS = [".png", ".jpg", ".jpeg", ".ppm"]


def decode(content: bytes) -> np.ndarray:
    """(height, width, 3) uint8 of an 8-bit PNG without interlacing, or a binary PPM."""
    if content[:2] == b"P6":
        head = content.split(maxsplit=4)
        width, height = int(head[1]), int(head[2])
        return np.frombuffer(content[-width * height * 3 :], np.uint8).reshape(height, width, 3)
    if content[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG or PPM file")
    at, data, palette = 8, [], None
    while at + 8 <= len(content):
        size, kind = struct.unpack_from(">I4s", content, at)
        body = content[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", body)
            if depth != 8 or interlaced:
                raise ValueError("only 8-bit PNG files without interlacing are read")
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height, width * channels), np.uint8)
    above = np.zeros(width * channels, np.uint8)
    for y, row in enumerate(rows):
        out[y] = above = _unfiltered(int(row[0]), row[1:], above, channels)
    x = out.reshape(height, width, channels)
    if colour == 3:
        return palette[x[:, :, 0]]
    return x[:, :, :3] if channels >= 3 else np.repeat(x[:, :, :1], 3, axis=2)


def _unfiltered(kind: int, row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """One scan line of a PNG file with its prediction added back."""
    if kind == 0:
        return row.copy()
    if kind == 2:
        return row + above
    if kind == 1:
        return np.cumsum(row.reshape(-1, step), axis=0, dtype=np.uint64).astype(np.uint8).ravel()
    out = [0] * len(row)
    up = above.tolist()
    for i, value in enumerate(row.tolist()):
        left, corner = (out[i - step], up[i - step]) if i >= step else (0, 0)
        if kind == 3:
            guess = (left + up[i]) // 2
        else:
            toward = left + up[i] - corner
            guess = min((left, up[i], corner), key=lambda v: abs(toward - v))
        out[i] = (value + guess) & 255
    return np.array(out, np.uint8)


def shrunk(image: np.ndarray, most: int = 400) -> np.ndarray:
    """At most `most` pixels a side, by area means."""
    h, w = image.shape[:2]
    if max(h, w) <= most:
        return image
    scale = most / max(h, w)
    for axis, size in ((0, max(1, int(h * scale))), (1, max(1, int(w * scale)))):
        edges = np.linspace(0, image.shape[axis], size + 1)
        sums = np.concatenate([np.zeros_like(np.take(image, [0], axis), dtype=np.float64), np.cumsum(image, axis=axis, dtype=np.float64)], axis=axis)
        low = np.floor(edges).astype(int)
        part = np.expand_dims(edges - low, tuple(i for i in range(image.ndim) if i != axis))
        whole = np.take(sums, low, axis) * (1 - part) + np.take(sums, np.minimum(low + 1, image.shape[axis]), axis) * part
        image = np.diff(whole, axis=axis) / (image.shape[axis] / size)
    return np.round(image).astype(np.uint8)


def patches(image: np.ndarray, size: int = 32, stride: int = 16) -> list[np.ndarray]:
    """Square patches; an image that is too small is one patch."""
    h, w = image.shape[:2]
    found = [image[y : y + size, x : x + size] for y in range(0, h - size + 1, stride) for x in range(0, w - size + 1, stride)]
    return found or [image]


def descriptor(patch: np.ndarray) -> np.ndarray | None:
    """128 numbers: gradient strength by 8 directions in 4 x 4 cells, at unit length; none for a flat patch."""
    grey = patch.astype(np.float64) @ np.array([0.299, 0.587, 0.114]) if patch.ndim == 3 else patch.astype(np.float64)
    if min(grey.shape) < 4:
        return None
    dy, dx = np.gradient(grey)
    strength, turn = np.hypot(dx, dy), ((np.arctan2(dy, dx) / (2 * np.pi) * 8) % 8).astype(int) % 8
    rows, columns = np.arange(grey.shape[0]) * 4 // grey.shape[0], np.arange(grey.shape[1]) * 4 // grey.shape[1]
    cell = (rows[:, None] * 4 + columns[None, :]) * 8 + turn
    out = np.bincount(cell.ravel(), strength.ravel(), 128)
    size = np.linalg.norm(out)
    if size == 0:
        return None
    out = np.minimum(out / size, 0.2)
    return out / np.linalg.norm(out)


def gradients(content: bytes, size: int = 32, stride: int = 16, most: int = 400) -> np.ndarray:
    """(n, 128) descriptors of an image's patches."""
    found = [d for p in patches(shrunk(decode(content), most), size, stride) if (d := descriptor(p)) is not None]
    return np.array(found, np.float32).reshape(-1, 128)


def features(spark: SparkSession, folder: str, extractor: Callable[[bytes], np.ndarray] = gradients) -> DataFrame:
    """Feature rows of all images below a folder; formats without a decoder give error rows."""
    return audio.extract(files.contents(spark, folder, EXTENSIONS), extractor)
