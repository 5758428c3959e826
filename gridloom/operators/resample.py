"""Resampling through affine maps, and pyramids of levels."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import functions as F

from ..meta import DownsampleStep, Embedding, TensorError, TensorMeta, can_reduce_further, coarser, scaling, translation
from ..storage import staged
from ..tensor import EmbeddedTensor, LodTensor, Tensor, grid_frame, positions
from . import kernels, window
from .geometry import affine, rounded


def rescale_matrix(source: TensorMeta, target: TensorMeta) -> np.ndarray:
    """Output to input positions such that both cover the same extent: ``(out + 0.5) * in / out - 0.5``."""
    n = source.ndim
    return translation([-0.5] * n) @ scaling([a / b for a, b in zip(source.dims, target.dims, strict=True)]) @ translation([0.5] * n)


def resample_transform(t: Tensor, meta: TensorMeta, matrix: np.ndarray, border: str = "repeat") -> Tensor:
    """The element nearest to ``matrix`` applied to each output position.

    Source positions are integers computed from output positions, so this is
    an equality join; outside the input ``repeat`` clamps and ``pad0`` gives
    zero. Only the input box that the output maps into takes part. Where the
    matrix only scales and moves axes, each source row is copied to the output
    positions that read it, without a join.
    """
    source = t.shape()
    if border not in ("repeat", "pad0"):
        raise TensorError(f"no such border: {border}")
    if len(matrix) != source.ndim + 1 or meta.ndim != source.ndim:
        raise TensorError("matrix, input and output differ in rank")
    p, q = positions(meta.ndim), [f"q{i}" for i in range(meta.ndim)]
    at = [rounded(c) for c in affine(matrix, [F.col(c).cast("double") for c in p])]
    if border == "repeat":
        at = [F.greatest(F.lit(0), F.least(F.lit(d - 1), c)) for c, d in zip(at, source.dims, strict=True)]
    out = grid_frame(t.df.sparkSession, meta.dims).select(*p, *[c.cast("long").alias(k) for c, k in zip(at, q, strict=True)])
    corners = np.stack(np.meshgrid(*[[0, d - 1] for d in meta.dims], indexing="ij"), -1).reshape(-1, meta.ndim)
    reached = (np.column_stack([np.ones(len(corners)), corners]) @ np.asarray(matrix, float).T)[:, 1:]
    box = [(max(0, min(d - 1, int(np.floor(a)))), max(0, min(d - 1, int(np.ceil(b + 0.5))))) for a, b, d in zip(reached.min(0), reached.max(0), source.dims, strict=True)]
    scale, move = np.diag(matrix)[1:], np.asarray(matrix, float)[1:, 0]
    plain = (np.asarray(matrix, float)[1:, 1:] == np.diag(scale)).all() and (scale > 0).all()
    # Far outside, an element of the border would be copied to many positions.
    if border == "repeat" and plain and all(a >= -1 and b <= d for a, b, d in zip(reached.min(0), reached.max(0), source.dims, strict=True)):
        frame = t.df.select(*[F.col(a).alias(b) for a, b in zip(p, q, strict=True)], "value")
        for i, (d, e) in enumerate(zip(source.dims, meta.dims, strict=True)):
            # A little wider than the positions that read the row; which do is told by the very expression that a join would use.
            ends = [(F.col(q[i]) + F.lit(half - float(move[i]))) / F.lit(float(scale[i])) for half in (-0.5, 0.5)]
            low = F.when(F.col(q[i]) == 0, F.lit(0)).otherwise(F.greatest(F.lit(0), F.ceil(ends[0] - 1e-3))).cast("long")
            high = F.when(F.col(q[i]) == d - 1, F.lit(e - 1)).otherwise(F.least(F.lit(e - 1), F.floor(ends[1] + 1e-3))).cast("long")
            frame = frame.where(low <= high).withColumn(p[i], F.explode(F.sequence(low, high))).where(at[i].cast("long") == F.col(q[i]))
        return Tensor(meta, t.dtype, frame.select(*p, "value"))
    inputs = t.df
    for i, ((a, b), d) in enumerate(zip(box, source.dims, strict=True)):
        if (a, b) != (0, d - 1):
            inputs = inputs.where((F.col(f"p{i}") >= a) & (F.col(f"p{i}") <= b))
    inputs = inputs.select(*[F.col(a).alias(b) for a, b in zip(positions(source.ndim), q, strict=True)], "value")
    if border == "repeat":
        frame = out.join(inputs, q).select(*p, "value")
    else:
        zero = F.lit(0).cast(t.dtype.element)
        frame = out.join(inputs, q, "left").select(*p, F.coalesce("value", zero if t.dtype.size == 1 else F.array_repeat(zero, t.dtype.size)).alias("value"))
    return Tensor(meta, t.dtype, frame)


def resample(t: EmbeddedTensor, meta: TensorMeta) -> EmbeddedTensor:
    """The nearest elements on another grid over the same extent."""
    spacing = tuple(s * a / b for s, a, b in zip(t.embedding.spacing, t.meta.dims, meta.dims, strict=True))
    return EmbeddedTensor(resample_transform(t.inner, meta, rescale_matrix(t.meta, meta)), Embedding(spacing))


def smooth_downsample(t: EmbeddedTensor, meta: TensorMeta) -> EmbeddedTensor:
    """Axes that shrink are smoothed by a Gaussian of half the factor, then resampled."""
    inner = t.inner
    for axis in reversed(range(t.nd)):
        factor = t.meta.dims[axis] / meta.dims[axis]
        if factor != 1:
            inner = window.convolution_1d(inner, kernels.gauss(0.5 * factor), axis, "repeat")
    return resample(EmbeddedTensor(inner, t.embedding), meta)


def stored(level: EmbeddedTensor, k: int) -> EmbeddedTensor:
    """A level written to the shared folder and read back, which cuts lineage: for ``between``."""
    return EmbeddedTensor(level.inner.replaced(staged(level.df, f"level{k}")), level.embedding)


def create_lod(t: EmbeddedTensor, steps, between: Callable[[EmbeddedTensor, int], EmbeddedTensor] | None = None) -> LodTensor:
    """Levels until no axis can shrink further. ``between`` may store each level, which then feeds the next."""
    if len(steps) != t.nd:
        raise TensorError(f"{len(steps)} steps for {t.nd} axes")
    steps = [DownsampleStep.of(s) for s in steps]
    levels = [t if between is None else between(t, 0)]
    while can_reduce_further(levels[-1].meta, steps):
        last = levels[-1]
        meta = coarser(last.meta, last.embedding, steps)
        if meta.dims == last.meta.dims:
            raise TensorError("the steps don't shrink the tensor")
        new = smooth_downsample(last, meta)
        levels.append(new if between is None else between(new, len(levels)))
    return LodTensor(levels)


def select_level(lod: LodTensor, matrix: np.ndarray, directions, coarse_factor: float = 1.0) -> int:
    """The coarsest level whose elements lie no further apart than ``coarse_factor`` times neighbouring pixels.

    ``matrix`` maps pixels to the physical space of the levels; ``directions``
    are the steps between neighbouring pixels.
    """
    steps = [np.asarray(matrix, float)[1:, 1:] @ np.asarray(d, float) for d in directions]
    chosen = 0
    for k, level in enumerate(lod.levels):
        spacing = np.array(level.embedding.spacing)
        apart = [(np.linalg.norm(np.abs(s) / max(np.linalg.norm(s), 1e-30) * spacing), np.linalg.norm(s)) for s in steps]
        if k and any(voxel > pixel * coarse_factor for voxel, pixel in apart):
            break
        chosen = k
    return chosen
