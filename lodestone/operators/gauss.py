"""Tukey HH distribution: a normal variable z stretched to z * exp(h * z * z / 2), with an h for each side."""

from __future__ import annotations

from functools import lru_cache
from math import erfc

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: L-kurtosis of the normal distribution; with less there are no tails to fit.
NORMAL_L_KURTOSIS = 0.1226017


@lru_cache(maxsize=1)
def _grid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points z in order, their quadrature weights over [-20, 20], and 2 F(z) - 1 of the normal distribution."""
    x, w = np.polynomial.legendre.leggauss(400)
    order = np.argsort(x)
    z = 20.0 * x[order]
    return z, 20.0 * w[order] / np.sqrt(2 * np.pi), np.array([1 - erfc(v / np.sqrt(2)) for v in z])


def l_moments_of(hl: float, hr: float) -> tuple[float, float, float, float]:
    """L-moments of the distribution by quadrature over z; its own exponent is joined to the density's to avoid overflow."""
    z, weight, q = _grid()
    value = z * np.exp((np.where(z < 0, hl, hr) - 1) * z * z / 2) * weight
    return (
        float(value.sum()),
        float((value * q).sum()),
        float((value * (1.5 * q * q - 0.5)).sum()),
        float((value * (2.5 * q**3 - 1.5 * q)).sum()),
    )


def solve_h(skew: float, kurtosis: float) -> tuple[float, float]:
    """(hl, hr) whose L-skewness and L-kurtosis are given; (0, 0) if the tails are no heavier than normal ones.

    For each right parameter the left one that gives the skewness is found by
    bisection, and the right one by bisection on the kurtosis.
    """
    if not np.isfinite(skew) or not np.isfinite(kurtosis) or kurtosis < NORMAL_L_KURTOSIS:
        return 0.0, 0.0
    swap, skew, kurtosis = skew < 0, abs(skew), min(kurtosis, 0.99)

    def ratios(hl: float, hr: float) -> tuple[float, float]:
        _, l2, l3, l4 = l_moments_of(hl, hr)
        return l3 / l2, l4 / l2

    def left(hr: float) -> float:
        low, high = 0.0, hr
        if ratios(0.0, hr)[0] <= skew:
            return 0.0
        for _ in range(40):
            mid = (low + high) / 2
            if ratios(mid, hr)[0] > skew:
                low = mid
            else:
                high = mid
        return (low + high) / 2

    low, high = 0.0, 0.97
    for _ in range(40):
        mid = (low + high) / 2
        if ratios(left(mid), mid)[1] < kurtosis:
            low = mid
        else:
            high = mid
    hr = (low + high) / 2
    hl = left(hr)
    return (hr, hl) if swap else (hl, hr)


def fit_tukey(m: dict[str, float]) -> dict[str, float]:
    """Location, scale and tails from the first four L-moments; without tails the scale is that of the normal fit."""
    sd = float(np.sqrt(m["var"]))
    out = {"loc": m["l1"], "scale": sd if sd > 0 else 1.0, "hl": 0.0, "hr": 0.0, "mean": m["l1"], "sd": sd}
    if m["l2"] <= 0 or m["n"] < 4:
        return out
    hl, hr = solve_h(m["l3"] / m["l2"], m["l4"] / m["l2"])
    if hl == 0.0 and hr == 0.0:
        return out
    l1, l2, _, _ = l_moments_of(hl, hr)
    scale = m["l2"] / l2
    return out | {"loc": m["l1"] - scale * l1, "scale": scale, "hl": hl, "hr": hr}


def inverse(u: np.ndarray, hl: float, hr: float) -> np.ndarray:
    """z with z * exp(h z^2 / 2) = u, by Newton steps on log z for the side of u."""
    u = np.asarray(u, float)
    h = np.where(u < 0, hl, hr)
    out = u.copy()
    far = np.isfinite(u) & (h * u * u >= 1e-7)
    a, k = np.abs(u[far]), h[far]
    # t = z^2 solves t * exp(k t) = a^2, so k t is Lambert's W of k a^2
    y = k * a * a
    w = np.where(y > np.e, np.log(np.maximum(y, 1e-300)) - np.log(np.maximum(np.log(np.maximum(y, np.e)), 1e-300)), y / (1 + y))
    for _ in range(20):
        e = np.exp(w)
        w = w - (w * e - y) / (e * (w + 1))
    out[far] = np.sign(u[far]) * np.sqrt(w / k)
    return out


def gaussianized(x: Column, loc: float, scale: float, hl: float, hr: float) -> Column:
    u = (x.cast("double") - F.lit(loc)) / F.lit(scale)
    if hl == 0.0 and hr == 0.0:
        return u

    @F.pandas_udf("double")
    def back(v: pd.Series) -> pd.Series:
        return pd.Series(inverse(v.to_numpy(float, na_value=np.nan), hl, hr)).where(v.notna(), None)

    return back(u)
