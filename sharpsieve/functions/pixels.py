"""Kernels over one frame, in numpy; all that needs pixels is here."""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Rec. 709 weights of red, green and blue.
WEIGHTS = np.array([0.2126, 0.7152, 0.0722], np.float32)
SCALE = 100.0
WORK, SPREAD, LEAST_HALF = 64, 1.5, 0.05


def from_spark_image(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """An RGB array of a row of Spark's image source (blue first; one channel is grey)."""
    raw = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(raw, 3, axis=2) if channels == 1 else raw[:, :, 2::-1]


def orient(image: np.ndarray, orientation: int | None) -> np.ndarray:
    """From stored into viewed position."""
    turned = image.swapaxes(0, 1) if orientation in (5, 6, 7, 8) else image
    if orientation in (3, 4, 7, 8):
        turned = turned[::-1]
    if orientation in (2, 3, 6, 7):
        turned = turned[:, ::-1]
    return turned


def _averages(n_in: int, n_out: int) -> np.ndarray:
    """n_out rows of weights: the mean of each output cell's share of n_in cells."""
    edges = np.linspace(0, n_in, n_out + 1)
    cells = np.arange(n_in)
    overlap = np.clip(np.minimum(edges[1:, None], cells + 1) - np.maximum(edges[:-1, None], cells), 0, None)
    return overlap / overlap.sum(axis=1, keepdims=True)


def _shrunk(values: np.ndarray, n_out: int) -> np.ndarray:
    """Means along the first axis over n_out equal spans, cells at the edges by their share."""
    n_in = values.shape[0]
    if n_out == n_in:
        return values.astype(np.float64)
    if n_out > n_in:
        return np.tensordot(_averages(n_in, n_out), values, axes=1)
    edges = np.arange(n_out + 1) * (n_in / n_out)
    whole = np.minimum(edges.astype(int), n_in)
    part = (edges - whole).reshape(-1, *[1] * (values.ndim - 1))
    sums = np.add.reduceat(values, whole[:-1], axis=0, dtype=np.float64)
    beyond = np.concatenate((values, values[-1:]))[whole]
    return (sums - part[:-1] * beyond[:-1] + part[1:] * beyond[1:]) * (n_out / n_in)


def resize(values: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area means; the last axis may be channels."""
    rows = _shrunk(values, height)
    return _shrunk(rows.swapaxes(0, 1), width).swapaxes(0, 1)


def luma(rgb: np.ndarray, working_edge: int) -> np.ndarray:
    """Brightness from 0 to 1 at the working size; never enlarged. Weights first: the mean of brightness is the brightness of the mean."""
    h, w = rgb.shape[:2]
    y = (rgb @ WEIGHTS) / np.float32(255)
    scale = working_edge / max(h, w)
    return resize(y, max(1, round(h * scale)), max(1, round(w * scale))).astype(np.float32) if scale < 1 else y


def laplacian(y: np.ndarray) -> np.ndarray:
    """Eight times a pixel less its neighbours, without the border; a frame under 3 by 3 is repeated at its border first."""
    if min(y.shape) < 3:
        y = np.pad(y, 1, mode="edge")
    total = sum(y[1 + i : y.shape[0] - 1 + i, 1 + j : y.shape[1] - 1 + j] for i in (-1, 0, 1) for j in (-1, 0, 1))
    return 9 * y[1:-1, 1:-1] - total


def grid_shape(height: int, width: int, long_edge: int) -> tuple[int, int]:
    short = max(1, round(long_edge * min(height, width) / max(height, width)))
    rows, cols = (long_edge, short) if height >= width else (short, long_edge)
    return min(rows, max(1, height)), min(cols, max(1, width))


def tile_map(y: np.ndarray, long_edge: int = 24) -> np.ndarray:
    """Root mean squares of the Laplacian in a grid of tiles, times 100."""
    response = laplacian(y)
    rows, cols = grid_shape(*response.shape, long_edge)
    starts = [np.linspace(0, n, k + 1).astype(int)[:-1] for n, k in zip(response.shape, (rows, cols), strict=True)]
    sums = np.add.reduceat(np.add.reduceat(response.astype(np.float64) ** 2, starts[0], axis=0), starts[1], axis=1)
    sizes = np.outer(*[np.diff(np.append(s, n)) for s, n in zip(starts, response.shape, strict=True)])
    return (np.sqrt(sums / sizes) * SCALE).astype(np.float32)


def exposure(y: np.ndarray, percent: float = 0.5, margin: float = 2 / 255) -> dict[str, float]:
    if not y.size:
        return dict.fromkeys(("highlight_clipped", "shadow_clipped", "dynamic_range", "mean_luma", "contrast"), 0.0)
    low, high = np.percentile(y, [percent, 100 - percent])
    return {
        "highlight_clipped": float((y >= 1 - margin).mean()), "shadow_clipped": float((y <= margin).mean()), "dynamic_range": float(high - low),
        "mean_luma": float(y.mean()), "contrast": float(y.std()),
    }


def structure_tensor(y: np.ndarray) -> tuple[float, float, float]:
    """Means of gx * gx, gy * gy and gx * gy."""
    if min(y.shape) < 2:
        return 0.0, 0.0, 0.0
    gy, gx = np.gradient(y.astype(np.float32))
    return float((gx * gx).mean()), float((gy * gy).mean()), float((gx * gy).mean())


def difference_hash(y: np.ndarray, size: int = 8) -> list[int]:
    """size * size bits, first bit highest, in signed 64-bit words (the last one filled with zeros)."""
    small = resize(np.floor(np.clip(y, 0, 1) * 255), size, size + 1)
    small = np.floor(small + 0.5).astype(np.int16)
    bits = (small[:, 1:] > small[:, :-1]).ravel()
    words = -(-bits.size // 64)
    packed = np.packbits(np.pad(bits, (0, words * 64 - bits.size)))
    return [int(x) for x in packed.view(">i8")]


def _smooth(values: np.ndarray, radius: int) -> np.ndarray:
    """Means over squares, edges repeated."""
    k = 2 * radius + 1
    padded = np.pad(values, radius, mode="edge")
    return np.lib.stride_tricks.sliding_window_view(padded, (k, k)).mean(axis=(2, 3))


def saliency(y: np.ndarray) -> np.ndarray:
    """Spectral residual (Hou and Zhang, CVPR 2007) on a 64 by 64 copy, with a peak of 1."""
    spectrum = np.fft.fft2(resize(np.floor(np.clip(y, 0, 1) * 255), WORK, WORK))
    logs = np.log(np.abs(spectrum) + 1e-8)
    energy = _smooth(np.abs(np.fft.ifft2(np.exp(logs - _smooth(logs, 1) + 1j * np.angle(spectrum)))) ** 2, 2)
    return energy / energy.max() if energy.max() > 0 else energy


def saliency_box(y: np.ndarray, spread: float = SPREAD) -> tuple[float, float, float, float] | None:
    """A box around the salient mass (above mean plus one deviation), by its moments; inside the frame."""
    if not y.size:
        return None
    map_ = saliency(y)
    weights = np.where(map_ >= map_.mean() + map_.std(), map_, 0)
    total = weights.sum()
    if total <= 0:
        return None
    out = []
    for axis in (1, 0):
        mass = weights.sum(axis=1 - axis) / total
        at = np.arange(len(mass)) / len(mass)
        centre = float((mass * at).sum())
        half = max(spread * float(np.sqrt((mass * (at - centre) ** 2).sum())), LEAST_HALF)
        start = min(max(centre - half, 0.0), 1.0)
        out.append((start, max(min(2 * half, 1 - start), 1e-6)))
    (x, w), (top, h) = out
    return x, top, w, h


def thumbnail(rgb: np.ndarray, edge: int) -> bytes:
    """A PNG whose longer side is `edge` at most."""
    h, w = rgb.shape[:2]
    scale = min(1.0, edge / max(h, w))
    if scale < 1:
        rgb = resize(rgb, max(1, round(h * scale)), max(1, round(w * scale)))
    return png(np.rint(rgb).astype(np.uint8))


def png(rgb: np.ndarray) -> bytes:
    h, w = rgb.shape[:2]
    rows = np.concatenate((np.zeros((h, 1), np.uint8), rgb.reshape(h, -1)), axis=1).tobytes()

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows, 6)) + chunk(b"IEND", b"")
