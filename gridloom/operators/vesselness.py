"""Tube filters from the eigenvalues of Gaussian second derivatives."""

from __future__ import annotations

import numpy as np

from ..meta import F64, TensorError
from ..tensor import EmbeddedTensor
from . import kernels
from .window import along, map_overlap

#: Of the Sato measure: the widths for a first eigenvalue at most zero, and above.
BELOW, ABOVE = 0.5, 8.0


def sato(eigenvalues: np.ndarray) -> np.ndarray:
    """The measure from eigenvalues sorted ascending on the last axis."""
    first, second = eigenvalues[..., 2], eigenvalues[..., 1]
    lc = -second
    width = np.where(first <= 0, BELOW, ABOVE)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        out = np.exp(-(first**2) / (width * lc**2)) * lc
    return np.where(lc == 0, 0.0, out)


def _taps(t: EmbeddedTensor, scale: float) -> list[list[np.ndarray]]:
    """Kernels of the Gaussian and its first two derivatives along each axis."""
    return [[np.array(f(max(scale / s, 1e-3))) for s in t.embedding.spacing] for f in (kernels.gauss, kernels.dgauss_dx, kernels.ddgauss_dxdx)]


def _measure(volume: np.ndarray, core, taps: list[list[np.ndarray]]) -> np.ndarray:
    """The Sato measure of a chunk, from six separable derivatives of it and its surroundings."""
    hessian = np.zeros((*volume.shape, 3, 3))
    for i in range(3):
        for j in range(i, 3):
            orders = [0, 0, 0]
            orders[i] += 1
            orders[j] += 1
            out = volume
            for axis in (2, 1, 0):
                out = along(out, taps[orders[axis]][axis], axis)
            hessian[..., i, j] = hessian[..., j, i] = out
    return sato(np.linalg.eigvalsh(hessian[core]))


def vesselness(t: EmbeddedTensor, scale: float) -> EmbeddedTensor:
    """Six separable derivatives at ``scale`` (physical), their eigenvalues, and the Sato measure.

    Each chunk is computed with the surroundings that the kernels reach, after
    one shuffle, instead of eighteen passes along the axes.
    """
    return _largest(t, [(scale, 1.0)])


def multiscale_vesselness(t: EmbeddedTensor, min_scale: float, max_scale: float, steps: int) -> EmbeddedTensor:
    """The largest measure over scales on a logarithmic ladder, each times scale squared over the spacing's squared length.

    All scales are computed from one chunk and its surroundings, after one shuffle.
    """
    if not 0 < min_scale <= max_scale or steps < 1:
        raise TensorError("scales are positive and ascending, with one step at least")
    scales = [min_scale] if steps == 1 else np.exp(np.linspace(np.log(min_scale), np.log(max_scale), steps)).tolist()
    unit = float(np.dot(t.embedding.spacing, t.embedding.spacing))
    return _largest(t, [(s, s * s / unit) for s in scales])


def _largest(t: EmbeddedTensor, scales: list[tuple[float, float]]) -> EmbeddedTensor:
    """The largest of the measures at some scales, each times its factor."""
    if t.nd != 3:
        raise TensorError("vesselness takes volumes")
    every = [(_taps(t, s), factor) for s, factor in scales]
    halo = tuple(max(len(k[i]) // 2 for taps, _ in every for k in taps) for i in range(3))

    def kernel(arrays, low, core):
        return np.max([_measure(arrays[0], core, taps) * factor for taps, factor in every], axis=0)

    return EmbeddedTensor(map_overlap(t.df, t.meta, halo, ["value"], kernel, F64), t.embedding)
