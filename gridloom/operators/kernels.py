"""Gaussian kernels and their derivatives, as lists of taps."""

from __future__ import annotations

import math

import numpy as np

#: Each tap is the mean of the function at so many places over one element.
SUBSAMPLES = 11


def gaussian(x: np.ndarray, s: float) -> np.ndarray:
    return np.exp(-0.5 * (x / s) ** 2) / (math.sqrt(2 * math.pi) * s)


def gaussian_1(x: np.ndarray, s: float) -> np.ndarray:
    return -x / s**2 * gaussian(x, s)


def gaussian_2(x: np.ndarray, s: float) -> np.ndarray:
    return (x**2 / s**4 - 1 / s**2) * gaussian(x, s)


def _taps(f, s: float) -> np.ndarray:
    extent = math.floor(3 * s + 0.5)
    places = np.arange(-extent, extent + 1)[:, None] - np.linspace(-0.5, 0.5, SUBSAMPLES)[None, :]
    return f(places, s).mean(1)


def _balanced(taps: np.ndarray, total: float) -> np.ndarray:
    """Positive and negative taps scaled to the same total, so that all sum to zero."""
    up, down = taps[taps > 0].sum(), taps[taps <= 0].sum()
    up, down = (abs(total / x) if x else 0.0 for x in (up, down))
    return np.where(taps > 0, taps * up, taps * down)


def gauss(stddev: float) -> list[float]:
    taps = _taps(gaussian, stddev)
    return (taps / taps.sum()).tolist()


def dgauss_dx(stddev: float) -> list[float]:
    return _balanced(_taps(gaussian_1, stddev), float(gaussian(np.zeros(1), stddev)[0])).tolist()


def ddgauss_dxdx(stddev: float) -> list[float]:
    return _balanced(_taps(gaussian_2, stddev), 2 * float(gaussian_1(np.array([stddev]), stddev)[0])).tolist()
