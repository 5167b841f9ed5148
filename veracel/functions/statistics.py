"""Distribution functions and the rescaled-range exponent, over arrays."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Points that a rescaled-range fit needs; below, the exponent is that of noise.
MIN_POINTS, NOISE = 20, 0.5


def log_gamma(x: np.ndarray) -> np.ndarray:
    return np.array([math.lgamma(v) for v in np.ravel(x).tolist()]).reshape(np.shape(x))


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    flip = x > (a + 1) / (a + b + 2)  # where the fraction of the other tail converges faster
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    inner = (z > 0) & (z < 1)
    z = np.where(inner, z, 0.5)
    front = np.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
    tiny = 1e-300
    c, d = np.ones_like(z), 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for k in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d, c = 1 + k * d, 1 + k / c
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * c * d
        if np.all(np.abs(c * d - 1) < 1e-15):
            break
    got = np.where(inner, front * h, np.where(np.where(flip, 1 - x, x) <= 0, 0.0, 1.0))
    return np.where(flip, 1 - got, got)


def rank_p_value(rho: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Two-sided p of a rank correlation over n pairs by the t distribution; 1 for fewer than three or no correlation, 0 for a perfect one."""
    rho, n = np.asarray(rho, float), np.asarray(n, float)
    ok = (n > 2) & np.isfinite(rho)
    r = np.where(ok, np.clip(rho, -1, 1), 0.0)
    return np.where(ok, incomplete_beta(np.maximum(n - 2, 1) / 2, 0.5, 1 - r * r), 1.0)


def p_value(rho: Column, n: Column) -> Column:
    @F.pandas_udf("double")
    def of(r: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series(rank_p_value(r.to_numpy(float), k.to_numpy(float)))

    return of(rho.cast("double"), n.cast("double"))


def expected_range(n: int) -> float:
    """Mean rescaled range of n values of noise."""
    i = np.arange(1, n)
    return (n - 0.5) / n * math.exp(math.lgamma((n - 1) / 2) - math.lgamma(n / 2)) / math.sqrt(math.pi) * float(np.sqrt((n - i) / i).sum())


def window_sizes(n: int, steps: int = 15) -> list[int]:
    """Sizes evenly spaced by logarithm over the middle half of the range from 4 to n."""
    low, high = math.log(4), math.log(n)
    quarter = (high - low) / 4
    return sorted({int(round(math.exp(low + quarter + (high - low - 2 * quarter) * k / (steps - 1)))) for k in range(steps)})


def hurst(signal: np.ndarray, corrected: bool = True) -> float:
    """Slope of log(rescaled range) by log(window size), windows side by side, in [0, 1]; with the range of noise taken off unless told not to."""
    x = np.asarray(signal, float)
    if len(x) < MIN_POINTS:
        return NOISE
    sizes, ratios = [], []
    for n in window_sizes(len(x)):
        rows = x[: len(x) // n * n].reshape(-1, n)
        walk = np.cumsum(rows - rows.mean(1, keepdims=True), 1)
        spread, s = walk.max(1) - walk.min(1), rows.std(1, ddof=1)
        ok = (s > 0) & (spread > 0)
        if ok.any():
            sizes.append(n)
            ratios.append(float((spread[ok] / s[ok]).mean()))
    if len(sizes) < 2:
        return NOISE
    y = np.log(ratios) - (np.log([expected_range(n) for n in sizes]) if corrected else 0)
    slope = float(np.polyfit(np.log(sizes), y, 1)[0]) + (NOISE if corrected else 0)
    return min(1.0, max(0.0, slope)) if math.isfinite(slope) else NOISE


def hurst_pair(text: str | None) -> tuple[float, float]:
    """Exponents of a text's code points and of the lengths of its words."""
    if not text or not text.strip():
        return NOISE, NOISE
    return hurst(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)), hurst(np.fromiter(map(len, text.split()), float))


def hurst_exponents(text: Column) -> Column:
    @F.pandas_udf("struct<hurst_char:double,hurst_word:double>")
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([hurst_pair(t) for t in texts], columns=["hurst_char", "hurst_word"])

    return of(text)
