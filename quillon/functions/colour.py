"""Colour conversions: hex, Oklab, luminance, contrast, HSL, hue peaks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# The published Oklab matrices.
TO_LMS = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
TO_LAB = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))


def channel(colour: Column, i: int) -> Column:
    """The i-th of red, green, blue of ``#rrggbb`` in 0..1."""
    return F.conv(F.substring(colour, 2 + 2 * i, 2), 16, 10).cast("double") / 255.0


def linear(c: Column) -> Column:
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, 2.4))


def luminance(colour: Column) -> Column:
    r, g, b = (linear(channel(colour, i)) for i in range(3))
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def contrast(a: Column, b: Column) -> Column:
    x, y = luminance(a), luminance(b)
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)


def oklab(colour: Column) -> tuple[Column, Column, Column]:
    rgb = [linear(channel(colour, i)) for i in range(3)]
    lms = [F.cbrt(sum((c * w for c, w in zip(rgb, row, strict=True)), F.lit(0.0))) for row in TO_LMS]
    return tuple(sum((c * w for c, w in zip(lms, row, strict=True)), F.lit(0.0)) for row in TO_LAB)


def oklab_distance(a: Column, b: Column) -> Column:
    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(oklab(a), oklab(b), strict=True)), F.lit(0.0)))


def hsl_hex(h: Column, s: Column, light: Column) -> Column:
    """Hex colour of hue in degrees, saturation and lightness in 0..1."""
    a = s * F.least(light, 1 - light)

    def part(n: int) -> Column:
        k = F.pmod(n + h / 30.0, F.lit(12.0))
        v = light - a * F.greatest(F.lit(-1.0), F.least(F.least(k - 3, 9 - k), F.lit(1.0)))
        return F.lpad(F.lower(F.hex(F.floor(v * 255 + 0.5).cast("bigint"))), 2, "0")

    return F.concat(F.lit("#"), part(0), part(8), part(4))


def hue_peaks(hues: np.ndarray, weights: np.ndarray, bins: int = 36, apart: float = 40.0) -> list[float]:
    """Up to two peaks, in degrees, of a circularly smoothed hue histogram, more than ``apart`` from each other."""
    h, _ = np.histogram(hues % 360, bins=bins, range=(0, 360), weights=weights)
    smooth = 0.25 * np.roll(h, 1) + 0.5 * h + 0.25 * np.roll(h, -1)
    out: list[float] = []
    for i in np.argsort(-smooth, kind="stable"):
        centre = (i + 0.5) * 360 / bins
        if smooth[i] > 0 and all(min(abs(centre - o), 360 - abs(centre - o)) > apart for o in out):
            out.append(centre)
        if len(out) == 2:
            break
    return out
