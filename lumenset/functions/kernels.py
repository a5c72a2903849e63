"""Array kernels as higher-order functions; they stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def _mean(a: Column) -> Column:
    return F.try_divide(_sum(a), F.size(a))


def softmax(z: Column) -> Column:
    e = F.transform(z, lambda x: F.exp(x - F.array_max(z)))
    return F.transform(e, lambda x: x / _sum(e))


def argmax(z: Column) -> Column:
    """First position of the maximum, from 0."""
    return (F.array_position(z, F.array_max(z)) - 1).cast("int")


def log_softmax(z: Column) -> Column:
    top = F.array_max(z)
    lse = top + F.log(_sum(F.transform(z, lambda x: F.exp(x - top))))
    return F.transform(z, lambda x: x - lse)


def cross_entropy(z: Column, target: Column, weights: tuple[float, ...] | None = None, smoothing: float = 0.0) -> Column:
    """Weighted, smoothed loss of one sample before any mean."""
    lp = log_softmax(z)
    w = F.array(*[F.lit(float(x)) for x in weights]) if weights else F.transform(z, lambda x: F.lit(1.0))
    hard = -F.get(w, target) * F.get(lp, target)
    if not smoothing:
        return hard
    soft = -_sum(F.zip_with(w, lp, lambda a, b: a * b)) / F.size(z)
    return (1 - smoothing) * hard + smoothing * soft


def focal(z: Column, target: Column, gamma: float = 3.0, weights: tuple[float, ...] | None = None, smoothing: float = 0.0) -> Column:
    """(1 - exp(-ce))**gamma * ce with the weighted, smoothed cross-entropy."""
    ce = cross_entropy(z, target, weights, smoothing)
    return F.pow(1 - F.exp(-ce), F.lit(gamma)) * ce


def weighted_mean_loss(loss: Column, target: Column, weights: tuple[float, ...]) -> Column:
    """Mean of weighted cross-entropies: their sum divided by the weights of the targets (focal loss takes the plain mean)."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    return F.sum(loss) / F.sum(F.get(w, target))


def gem_pool(x: Column, p: float = 3.0, eps: float = 1e-6) -> Column:
    """Generalised mean; p is kept within 0.001 and 10."""
    p = min(max(p, 1e-3), 10.0)
    return F.pow(_mean(F.transform(x, lambda v: F.pow(F.greatest(v, F.lit(eps)), F.lit(p)))), F.lit(1.0 / p))


def concat_channels(channels: list[Column], expected: int) -> Column:
    """Channels (arrays of one length) one after the other; cut to, or filled up with zeros to, ``expected`` channels."""
    plane = F.size(channels[0])
    joined = F.concat(*channels)
    padded = F.concat(joined, F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), plane * expected - F.size(joined))))
    return F.slice(padded, F.lit(1), plane * expected)


def minmax(x: Column, eps: float = 1e-8) -> Column:
    """To 0..1; zeros if all values are equal up to eps."""
    lo, hi = F.array_min(x), F.array_max(x)
    return F.transform(x, lambda v: F.when(hi - lo > eps, (v - lo) / (hi - lo)).otherwise(0.0))


def class_activation(maps: Column, grads: Column, by_max: bool = False) -> Column:
    """From feature maps and gradients (arrays of channels): ReLU of the sum of maps weighted by their mean gradients, scaled to 0..1.

    ``by_max`` divides by the maximum alone.
    """
    weights = F.transform(grads, _mean)
    zero = F.transform(F.get(maps, F.lit(0)), lambda v: F.lit(0.0))
    scaled = F.zip_with(maps, weights, lambda m, w: F.transform(m, lambda v: v * w))
    total = F.aggregate(scaled, zero, lambda acc, m: F.zip_with(acc, m, lambda a, b: a + b))
    cam = F.transform(total, lambda v: F.greatest(v, F.lit(0.0)))
    if by_max:
        top = F.array_max(cam)
        return F.transform(cam, lambda v: F.when(top > 0, v / top).otherwise(0.0))
    return minmax(cam)


def blend(image: Column, heat: Column, alpha: float = 0.4) -> Column:
    return F.zip_with(image, heat, lambda a, b: (1 - alpha) * a + alpha * b)


def jet(x: Column) -> Column:
    """Red, green and blue, 0 to 255, of a value from 0 to 1 on the scale from blue over green to red."""
    up = lambda at: F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1.5 - F.abs(4 * x - at))) * 255
    return F.array(up(3), up(2), up(1))


def _once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x evaluated once: an expression inside a lambda would be for each element."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def resize_bilinear(plane: Column, height: int, width: int, new_height: int, new_width: int) -> Column:
    """A row-major plane at another size: half-pixel centres, edges repeated."""
    return _once(plane, lambda p: _resized(p, height, width, new_height, new_width))


def _resized(plane: Column, height: int, width: int, new_height: int, new_width: int) -> Column:

    def axis(i: Column, old: int, new: int) -> tuple[Column, Column, Column]:
        at = F.least(F.lit(old - 1.0), F.greatest(F.lit(0.0), (i + 0.5) * old / new - 0.5))
        low = F.floor(at).cast("int")
        return low, F.least(F.lit(old - 1), low + 1), at - low

    def one(i: Column) -> Column:
        y0, y1, fy = axis(F.floor(i / new_width).cast("int"), height, new_height)
        x0, x1, fx = axis(i % new_width, width, new_width)
        v = lambda y, x: F.get(plane, y * width + x)
        return (v(y0, x0) * (1 - fx) + v(y0, x1) * fx) * (1 - fy) + (v(y1, x0) * (1 - fx) + v(y1, x1) * fx) * fy

    return F.transform(F.sequence(F.lit(0), F.lit(new_height * new_width - 1)), one)


def heat_overlay(pixels: Column, height: int, width: int, heat: Column, heat_height: int, heat_width: int, alpha: float = 0.5) -> Column:
    """Interleaved red, green and blue pixels with a heat map (0 to 1, of any size) laid over: the map is resized, coloured and blended."""
    coloured = F.flatten(F.transform(resize_bilinear(heat, heat_height, heat_width, height, width), jet))
    return blend(pixels, coloured, alpha)


def normalise(pixels: Column, mean: tuple[float, ...] = (0.485, 0.456, 0.406), std: tuple[float, ...] = (0.229, 0.224, 0.225)) -> Column:
    """(x / 255 - mean) / std for interleaved channels."""
    m, s = (F.array(*[F.lit(v) for v in t]) for t in (mean, std))
    n = len(mean)
    return F.transform(pixels, lambda x, i: (x / 255.0 - F.get(m, i % n)) / F.get(s, i % n))


def flip_rows(plane: Column, width: int) -> Column:
    """Horizontal flip of a row-major plane."""
    rows = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), (F.size(plane) / width).cast("int") - 1)), lambda r: F.reverse(F.slice(plane, r * width + 1, F.lit(width))))
    return F.flatten(rows)


def brightness(plane: Column, factor: float, shift: float = 0.0) -> Column:
    """Affine change, kept within 0 and 255."""
    return F.transform(plane, lambda v: F.least(F.lit(255.0), F.greatest(F.lit(0.0), v * factor + shift)))


def brightness_predictor(mean: Column) -> Column:
    """Stand-in class probabilities from the mean brightness: array of real, generated, edited."""
    r = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.2 + 0.6 * mean / 255))
    parts = F.array(r, 0.6 * (1 - r), 0.4 * (1 - r))
    return F.transform(parts, lambda v: v / _sum(parts))


def correlate_1d(x: Column, kernel: tuple[float, ...]) -> Column:
    """Cross-correlation with zero padding, as long as the input."""
    half = len(kernel) // 2

    def at(i: Column) -> Column:
        terms = [F.coalesce(F.when(i + (j - half) >= 0, F.get(x, F.greatest(F.lit(0), i + (j - half)))), F.lit(0.0)) * F.lit(float(k)) for j, k in enumerate(kernel)]
        out = terms[0]
        for t in terms[1:]:
            out = out + t
        return out

    return F.transform(x, lambda v, i: at(i))


def vector_hash(e: Column) -> Column:
    """16 hexadecimal digits of a 64-vector: bit i tells whether value i is above the median."""
    s = F.array_sort(e)
    m = (F.get(s, F.lit(31)).cast("double") + F.get(s, F.lit(32)).cast("double")) / 2
    nibble = lambda i: sum((F.when(F.get(e, i * 4 + k) > m, 1 << (3 - k)).otherwise(0) for k in range(1, 4)), F.when(F.get(e, i * 4) > m, 8).otherwise(0))
    return F.when(F.size(e) == 64, F.array_join(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.lower(F.hex(nibble(i)))), ""))
