"""Pre-processing of images and sound: resizing, normalising, patches; frames, windows and log-mel spectra. NumPy on Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resize_bilinear(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """(h, w, c) to another size; corners stay corners."""
    h, w = image.shape[:2]
    y = np.linspace(0, h - 1, height) if height > 1 else np.zeros(1)
    x = np.linspace(0, w - 1, width) if width > 1 else np.zeros(1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None, None], (x - x0)[None, :, None]
    upper = image[y0][:, x0] * (1 - fx) + image[y0][:, x1] * fx
    lower = image[y1][:, x0] * (1 - fx) + image[y1][:, x1] * fx
    return upper * (1 - fy) + lower * fy


def fit_size(h: int, w: int, most: int, align: int) -> tuple[int, int]:
    """Size within ``most`` on the longer side at the same ratio, both sides multiples of ``align``."""
    scale = min(1.0, most / max(h, w))
    side = lambda n: max(align, round(n * scale / align) * align)
    return side(h), side(w)


def pad_square(image: np.ndarray, colour: tuple[float, ...]) -> np.ndarray:
    """The image in the middle of a square of one colour."""
    h, w, c = image.shape
    n = max(h, w)
    out = np.broadcast_to(np.asarray(colour, dtype=np.float64), (n, n, c)).copy()
    top, left = (n - h) // 2, (n - w) // 2
    out[top : top + h, left : left + w] = image
    return out


def normalise(image: np.ndarray, mean: tuple[float, ...], std: tuple[float, ...]) -> np.ndarray:
    """0..255 to (x / 255 - mean) / std per channel."""
    return (image / 255.0 - np.asarray(mean)) / np.asarray(std)


def patches(image: np.ndarray, size: int) -> np.ndarray:
    """(n, size * size * c): the tiles in reading order."""
    h, w, c = image.shape
    return image[: h // size * size, : w // size * size].reshape(h // size, size, w // size, size, c).swapaxes(1, 2).reshape(-1, size * size * c)


def mel_filters(n_mel: int, n_fft: int, rate: int) -> np.ndarray:
    """(n_mel, n_fft / 2 + 1) triangles evenly spaced on the mel scale (linear to 1 kHz, logarithmic above), of equal area."""
    step = math.log(6.4) / 27
    to_mel = lambda f: np.where(f < 1000, f * 3 / 200, 15 + np.log(np.maximum(f, 1e-9) / 1000) / step)
    to_hz = lambda m: np.where(m < 15, m * 200 / 3, 1000 * np.exp((m - 15) * step))
    edges = to_hz(np.linspace(0, to_mel(np.array(rate / 2)), n_mel + 2))
    f = np.arange(n_fft // 2 + 1) * rate / n_fft
    up = (f - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - f) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def log_mel(samples: np.ndarray, filters: np.ndarray, n_fft: int = 400, hop: int = 160) -> np.ndarray:
    """(n_mel, frames): log10 power under Hann windows, held to 8 below the loudest, then (x + 4) / 4."""
    padded = np.pad(samples.astype(np.float64), (n_fft // 2, n_fft // 2), mode="reflect") if len(samples) > n_fft // 2 else np.pad(samples.astype(np.float64), (n_fft // 2, n_fft))
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)
    frames = np.lib.stride_tricks.sliding_window_view(padded, n_fft)[::hop]
    power = np.abs(np.fft.rfft(frames * window, axis=1)) ** 2
    mel = np.log10(np.maximum(filters @ power.T, 1e-10))
    return (np.maximum(mel, mel.max() - 8) + 4) / 4


def inverse_frames(frames: np.ndarray, hop: int) -> np.ndarray:
    """Overlapping windowed frames added back into one signal, divided by the windows' squares."""
    n = frames.shape[1]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    out, weight = np.zeros(hop * (len(frames) - 1) + n), np.zeros(hop * (len(frames) - 1) + n)
    for i, f in enumerate(frames):
        out[i * hop : i * hop + n] += f * window
        weight[i * hop : i * hop + n] += window**2
    return out / np.maximum(weight, 1e-8)


def _mapped(d: DataFrame, keep: list[str], arrays: list[str], f: Callable) -> DataFrame:
    schema = ", ".join(f"{c} {t}" for c, t in d.select(*keep).dtypes) + ", v array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [None if any(x is None for x in row) else f(*row).reshape(-1).tolist() for row in zip(*[b.column(a).to_pylist() for a in arrays], strict=True)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(out, pa.list_(pa.float64()))], [*keep, "v"])

    return d.select(*keep, *[F.col(a) for a in arrays if a not in keep]).mapInArrow(run, schema)


def resize_column(d: DataFrame, keep: list[str], pixels: str, h: int, w: int, height: int, width: int) -> DataFrame:
    """``keep`` and v: images of one channel as arrays of h x w values, resized."""
    return _mapped(d, keep, [pixels], lambda p: resize_bilinear(np.asarray(p, dtype=np.float64).reshape(h, w, 1), height, width))


def spectrum_column(d: DataFrame, keep: list[str], samples: str, n_mel: int = 80, rate: int = 16_000, n_fft: int = 400, hop: int = 160) -> DataFrame:
    """``keep`` and v: the log-mel spectrum of a column of samples, row by row."""
    filters = mel_filters(n_mel, n_fft, rate)
    return _mapped(d, keep, [samples], lambda s: log_mel(np.asarray(s), filters, n_fft, hop))
