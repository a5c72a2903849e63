"""Image kernels that need convolution or transforms, in numpy over Arrow batches.

An image is a row-major plane (``array<double>``) with its height and width; a result for
a plane that is missing, empty or not of height * width values is NULL.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PLANE = T.ArrayType(T.DoubleType())

#: The three residual kernels, 5 x 5, and what they are divided by.
LAPLACE = ((0, 0, -1, 0, 0), (0, -1, -2, -1, 0), (-1, -2, 16, -2, -1), (0, -1, -2, -1, 0), (0, 0, -1, 0, 0))
ACROSS = ((0, 0, 0, 0, 0), (0, 0, 0, 0, 0), (0, -1, 2, -1, 0), (0, 0, 0, 0, 0), (0, 0, 0, 0, 0))
SRM_KERNELS = (np.array(LAPLACE) / 8, np.array(ACROSS) / 2, np.array(ACROSS).T / 2)


def correlate(plane: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Cross-correlation with zero padding."""
    r = kernel.shape[0] // 2
    padded = np.pad(plane, r)
    views = np.lib.stride_tricks.sliding_window_view(padded, kernel.shape)
    return np.einsum("ijkl,kl->ij", views, kernel)


def laplacian_variance(plane: np.ndarray) -> float:
    """Population variance of the 4-neighbour Laplacian, borders mirrored without repeating the edge."""
    p = np.pad(plane, 1, mode="reflect") if min(plane.shape) > 1 else np.pad(plane, 1, mode="edge")
    lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * plane
    return float(lap.var())


def _weights(old: int, new: int, support: float, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    scale = max(old / new, 1.0)
    centre = (np.arange(new)[:, None] + 0.5) * old / new - 0.5
    w = f((np.arange(old)[None, :] - centre) / scale)
    w[np.abs(np.arange(old)[None, :] - centre) > support * scale] = 0
    return w / w.sum(1, keepdims=True)


def lanczos_resize(plane: np.ndarray, height: int, width: int, a: int = 3) -> np.ndarray:
    """Separable windowed-sinc resampling; shrinking widens the window."""
    f = lambda x: np.sinc(x) * np.sinc(x / a) * (np.abs(x) < a)
    return _weights(plane.shape[0], height, a, f) @ plane @ _weights(plane.shape[1], width, a, f).T


def _dct(n: int) -> np.ndarray:
    k = np.arange(n)
    return np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n))


def perceptual_hash(plane: np.ndarray, side: int = 8, factor: int = 4) -> str:
    """Shrunk to 32 x 32, cosine transform, and for each of the 8 x 8 lowest frequencies whether it is above their median."""
    n = side * factor
    small = lanczos_resize(plane, n, n)
    low = (_dct(n) @ small @ _dct(n).T)[:side, :side].ravel()
    bits = (low > np.median(low)).astype(int)
    return f"{int(''.join(map(str, bits)), 2):016x}"


def srm_residuals(plane: np.ndarray) -> np.ndarray:
    """Three residual planes of a grey image, clamped to -2..2."""
    return np.stack([np.clip(correlate(plane, k), -2, 2) for k in SRM_KERNELS])


def fft_magnitude(plane: np.ndarray) -> np.ndarray:
    """Log magnitude of the spectrum, zero frequency in the middle, scaled to 0..1. Each image for itself."""
    m = np.log(np.abs(np.fft.fftshift(np.fft.fft2(plane))) + 1e-8)
    return (m - m.min()) / (m.max() - m.min() + 1e-8)


def channel_attention(x: np.ndarray, w1: np.ndarray, w2: np.ndarray) -> np.ndarray:
    """Channels weighted by sigmoid(MLP(mean) + MLP(max)); ``x`` is channels x height x width."""
    mlp = lambda v: w2 @ np.maximum(w1 @ v, 0)
    gate = 1 / (1 + np.exp(-(mlp(x.mean((1, 2))) + mlp(x.max((1, 2))))))
    return x * gate[:, None, None]


def spatial_attention(x: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Positions weighted by sigmoid of a convolution over mean and maximum of the channels; ``kernel`` is 2 x k x k, k 3 or 7."""
    if kernel.shape[1] not in (3, 7):
        raise ValueError("kernel size must be 3 or 7")
    s = correlate(x.mean(0), kernel[0]) + correlate(x.max(0), kernel[1])
    return x / (1 + np.exp(-s))


def attention_block(x: np.ndarray, w1: np.ndarray, w2: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Channel attention, then spatial attention."""
    return spatial_attention(channel_attention(x, w1, w2), kernel)


def expand_first_layer(weight: np.ndarray, channels: int, mode: str = "first") -> np.ndarray:
    """Weights (out x 3 x k x k) for more input channels: the first three as they are, others 0.1 of the first channel or of the mean."""
    extra = weight[:, :1] if mode == "first" else weight.mean(1, keepdims=True)
    return np.concatenate([weight, np.repeat(0.1 * extra, channels - weight.shape[1], axis=1)], axis=1)


def _plane(v, h, w) -> np.ndarray | None:
    if v is None or not h or not w or len(v) != int(h) * int(w):
        return None
    return np.asarray(v, float).reshape(int(h), int(w))


def _mapped(f: Callable[[np.ndarray], object]):
    def run(v: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
        planes = (_plane(a, b if b == b else 0, c if c == c else 0) for a, b, c in zip(v, h, w))
        return pd.Series([None if p is None else f(p) for p in planes], dtype=object)

    return run


blur_score = F.pandas_udf(_mapped(laplacian_variance), T.DoubleType())
phash = F.pandas_udf(_mapped(perceptual_hash), T.StringType())
srm = F.pandas_udf(_mapped(lambda p: srm_residuals(p).ravel()), _PLANE)
spectrum = F.pandas_udf(_mapped(lambda p: fft_magnitude(p).ravel()), _PLANE)


def resized(height: int, width: int):
    """A column function that resamples planes to this size."""
    return F.pandas_udf(_mapped(lambda p: lanczos_resize(p, height, width).ravel()), _PLANE)


def srm_six_channels(rgb: np.ndarray) -> np.ndarray:
    """Red, green and blue planes (3 x height x width), then the three residual planes of their mean."""
    return np.concatenate([rgb, srm_residuals(rgb.mean(0))])


def planes_function(f: Callable[[np.ndarray], np.ndarray], channels: int):
    """A column function (planes one behind the other, height, width) of a function on channels x height x width; NULL for arrays of another size."""

    def run(v: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
        out = []
        for a, b, c in zip(v, h, w):
            fits = a is not None and b == b and c == c and b and c and len(a) == channels * int(b) * int(c)
            out.append(f(np.asarray(a, float).reshape(channels, int(b), int(c))).ravel() if fits else None)
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, _PLANE)


def attention(w1: np.ndarray, w2: np.ndarray, kernel: np.ndarray | None = None):
    """A column function of ``channel_attention``, or with a kernel of ``attention_block``, over maps with as many channels as ``w1`` has columns."""
    return planes_function((lambda x: channel_attention(x, w1, w2)) if kernel is None else (lambda x: attention_block(x, w1, w2, kernel)), w1.shape[1])


def rotate(plane: np.ndarray, degrees: float) -> np.ndarray:
    """Turned about its centre, bilinear, edges mirrored."""
    h, w = plane.shape
    t = np.deg2rad(degrees)
    y, x = np.mgrid[:h, :w]
    y, x = y - (h - 1) / 2, x - (w - 1) / 2
    sy, sx = np.cos(t) * y - np.sin(t) * x + (h - 1) / 2, np.sin(t) * y + np.cos(t) * x + (w - 1) / 2
    fold = lambda v, n: np.abs((v + (n - 1)) % (2 * (n - 1)) - (n - 1)) if n > 1 else v * 0
    sy, sx = fold(-sy, h), fold(-sx, w)
    y0, x0 = np.floor(sy).astype(int), np.floor(sx).astype(int)
    y1, x1, fy, fx = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1), sy - y0, sx - x0
    return (plane[y0, x0] * (1 - fx) + plane[y0, x1] * fx) * (1 - fy) + (plane[y1, x0] * (1 - fx) + plane[y1, x1] * fx) * fy


#: The luminance quantisation table that the JPEG standard recommends.
JPEG_LUMINANCE = (
    (16, 11, 10, 16, 24, 40, 51, 61), (12, 12, 14, 19, 26, 58, 60, 55), (14, 13, 16, 24, 40, 57, 69, 56), (14, 17, 22, 29, 51, 87, 80, 62),
    (18, 22, 37, 56, 68, 109, 103, 77), (24, 35, 55, 64, 81, 104, 113, 92), (49, 64, 78, 87, 103, 121, 120, 101), (72, 92, 95, 98, 112, 100, 103, 99),
)


def compressed(plane: np.ndarray, quality: int) -> np.ndarray:
    """What coding a plane as JPEG of this quality (1 to 100) leaves of it: 8 x 8 cosine blocks, rounded to the scaled table's steps."""
    h, w = plane.shape
    p = np.pad(plane, ((0, -h % 8), (0, -w % 8)), mode="edge") - 128
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    steps = np.clip(np.floor((np.array(JPEG_LUMINANCE) * scale + 50) / 100), 1, 255)
    d = _dct(8) * np.where(np.arange(8) == 0, np.sqrt(1 / 8), np.sqrt(2 / 8))[:, None]
    blocks = p.reshape(p.shape[0] // 8, 8, p.shape[1] // 8, 8).transpose(0, 2, 1, 3)
    back = d.T @ (np.round((d @ blocks @ d.T) / steps) * steps) @ d
    return np.clip(np.round(back.transpose(0, 2, 1, 3).reshape(p.shape)[:h, :w] + 128), 0, 255)


def blurred(plane: np.ndarray, size: int) -> np.ndarray:
    """Gaussian blur of an odd size, edges mirrored."""
    r = size // 2
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    g = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    g /= g.sum()
    p = np.pad(plane, r, mode="reflect" if min(plane.shape) > r else "edge")
    rows = sum(k * p[:, i : i + plane.shape[1]] for i, k in enumerate(g))
    return sum(k * rows[i : i + plane.shape[0]] for i, k in enumerate(g))


def median_blurred(plane: np.ndarray, size: int = 3) -> np.ndarray:
    p = np.pad(plane, size // 2, mode="edge")
    return np.median(np.lib.stride_tricks.sliding_window_view(p, (size, size)), axis=(2, 3))


def augmented(mode: str, seed: int = 42):
    """A column function (plane, height, width, key): ``light`` flips (half of the images); ``standard`` also turns by up to 15 degrees and changes brightness and
    contrast (half each) and compresses at quality 30 to 100 (four in ten); ``strong`` compresses at 20 to 95 (half), adds sensor noise (four in ten) and blurs (three in ten).

    What happens to an image follows the hash of seed and key. Planes keep their size; resizing and normalising have their own functions.
    """
    import zlib

    def one(p: np.ndarray, key: str) -> np.ndarray:
        rng = np.random.default_rng([seed, zlib.crc32(str(key).encode())])
        if rng.random() < 0.5:
            p = p[:, ::-1]
        if mode != "light":
            if rng.random() < 0.5:
                p = rotate(p, rng.uniform(-15, 15))
            if rng.random() < 0.5:
                p = np.clip((p - p.mean()) * rng.uniform(0.8, 1.2) + p.mean() + 255 * rng.uniform(-0.2, 0.2), 0, 255)
            low, high, chance = (30, 100, 0.4) if mode == "standard" else (20, 95, 0.5)
            if rng.random() < chance:
                p = compressed(p, int(rng.integers(low, high + 1)))
        if mode == "strong":
            if rng.random() < 0.4:
                # Noise of one strength, or one that grows with the light as a sensor's does.
                spread = 255 * rng.uniform(0.02, 0.08) if rng.random() < 0.5 else 255 * rng.uniform(0.1, 0.5) * 0.1 * np.sqrt(np.clip(p, 0, 255) / 255)
                p = np.clip(p + rng.normal(0, 1, p.shape) * spread, 0, 255)
            if rng.random() < 0.3:
                p = blurred(p, int(rng.choice([3, 5]))) if rng.random() < 0.5 else median_blurred(p)
        return p.ravel()

    if mode not in ("light", "standard", "strong"):
        raise ValueError(mode)

    def run(v: pd.Series, h: pd.Series, w: pd.Series, k: pd.Series) -> pd.Series:
        planes = [_plane(a, b if b == b else 0, c if c == c else 0) for a, b, c in zip(v, h, w)]
        return pd.Series([None if p is None else one(p, key) for p, key in zip(planes, k)], dtype=object)

    return F.pandas_udf(run, _PLANE)


def augmentation_preview(planes: DataFrame, mode: str, n: int = 8, key: str = "path", seed: int = 42) -> DataFrame:
    """(``key``, ``variant``, ``plane``): ``n`` variants of each plane, numbered from 0; ``planes`` has ``key``, ``plane``, ``h`` and ``w``."""
    each = planes.select(key, "plane", "h", "w", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("variant"))
    return each.select(key, "variant", augmented(mode, seed)("plane", "h", "w", F.concat_ws("#", key, "variant")).alias("plane"))
