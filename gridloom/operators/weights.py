"""Edge weights of the grid graph: how alike neighbouring elements are.

Weights form a tensor with the direction as last axis: ``w[p, d]`` belongs to
the edge from p to its next element on axis d. Edges that would leave the
tensor have no row.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..meta import F64, I8, TensorError
from ..tensor import LodTensor, Tensor
from . import window
from .aggregate import sampled


def _weighted(pairs: Tensor, f) -> Tensor:
    meta = pairs.shape()
    frame = pairs.df.select(*pairs.p, f(F.col("value")[0].cast("double"), F.col("value")[1].cast("double")).alias("value"))
    return Tensor(meta, F64, frame)


def grady(t: Tensor, beta: float, min_weight: float = 1e-5) -> Tensor:
    """``max(exp(-beta * difference squared), min_weight)``."""
    return _weighted(window.weight_pairs(t), lambda a, b: F.greatest(F.exp(-beta * (a - b) * (a - b)), F.lit(float(min_weight))))


def bian(t: Tensor, extent, min_weight: float = 1e-5, seed: int = 0) -> Tensor:
    """Grady weights on box means, with beta from the variance of elements around them.

    The variance comes from at most ten chunks and stays a frame of one row,
    joined to every edge, so nothing is computed on the driver.
    """
    sizes = {extent} if isinstance(extent, int) else set(extent)
    if len(sizes) != 1:
        raise TensorError("the box must be equally long on all axes")
    size = 2 * sizes.pop() + 1
    n = t.nd
    smooth = window.mean_filter(t, extent).compile()
    d = (t.cast("f64") - smooth).square().compile()
    count = F.count("value").cast("double")
    variance = sampled(d, 10, seed).agg((F.avg("value") * F.try_divide(count, count - 1)).alias("variance"))
    beta = 2.0 / F.greatest(F.coalesce("variance", F.lit(0.0)) * 2.0 / size ** (n + 1), F.lit(1.1754943508222875e-38))
    pairs = window.weight_pairs(smooth)
    frame = pairs.df.crossJoin(F.broadcast(variance))
    step = F.col("value")[0] - F.col("value")[1]
    frame = frame.select(*pairs.p, F.greatest(F.exp(-beta * step * step), F.lit(float(min_weight))).alias("value"))
    return Tensor(pairs.shape(), F64, frame)


# Kernels on one chunk with its surroundings.


def _shifted(a: np.ndarray, offset, fill: float = np.nan) -> np.ndarray:
    """``out[p] = a[p + offset]``."""
    out = np.full(a.shape, fill)
    to = tuple(slice(max(0, -o), a.shape[i] - max(0, o)) for i, o in enumerate(offset))
    of = tuple(slice(max(0, o), a.shape[i] + min(0, o)) for i, o in enumerate(offset))
    out[to] = a[of]
    return out


def _offsets(extent):
    return [tuple(o) for o in np.stack(np.meshgrid(*[np.arange(-e, e + 1) for e in extent], indexing="ij"), -1).reshape(-1, len(extent))]


def _box_mean(a: np.ndarray, extent) -> np.ndarray:
    stack = [_shifted(a, o) for o in _offsets(extent)]
    with np.errstate(invalid="ignore"):
        return np.nanmean(stack, axis=0)


def _box_variance(a: np.ndarray, mean: np.ndarray, extent) -> np.ndarray:
    stack = np.array([_shifted((a - mean) ** 2, o) for o in _offsets(extent)])
    n = np.isfinite(stack).sum(0)
    return np.nansum(stack, axis=0) / np.maximum(n - 1, 1)


def centre_offsets(a: np.ndarray, low, dims, extent) -> np.ndarray:
    """For each element the offset of the box centre under which it is likeliest; 127 where the box leaves the tensor."""
    mean = _box_mean(a, extent)
    var = _box_variance(a, mean, extent)
    best = np.full(a.shape, -np.inf)
    out = np.full((*a.shape, a.ndim), 127, np.int8)
    place = np.indices(a.shape) + np.array(low).reshape(-1, *[1] * a.ndim)
    inside = np.all([(place[i] >= extent[i]) & (place[i] < dims[i] - extent[i]) for i in range(a.ndim)], axis=0)
    for o in _offsets(extent):
        m, v, ok = _shifted(mean, o), _shifted(var, o), _shifted(inside.astype(float), o, 0.0) > 0
        with np.errstate(divide="ignore", invalid="ignore"):
            score = -((a - m) ** 2 * 0.5 / v + 0.5 * np.log(v))
        score = np.where(v == 0, np.where(a == m, 0.0, -np.inf), score)
        better = ok & (score > best)
        best = np.where(better, score, best)
        out[better] = o
    return out


def best_centers(t: Tensor, extent) -> Tensor:
    """Offsets (i8, as last axis) of the best box centre of every element."""
    extent = window._extents(extent, t.nd)
    dims = t.shape().dims

    def kernel(arrays, low, core):
        return centre_offsets(arrays[0], low, dims, extent)[core]

    found = window.map_overlap(t.cast("f64").df, t.shape(), tuple(3 * e for e in extent), ["value"], kernel, I8.vec(t.nd))
    return found.unfold_dtype()


def bhattacharyya(m1, v1, n1, m2, v2, n2) -> np.ndarray:
    below = (v1 + v2) / 2 + ((m1 - m2) / 2) ** 2
    share = np.sqrt(v1 * v2) / np.where(below == 0, 1.0, below)
    with np.errstate(divide="ignore"):
        return np.where(below == 0, 1.0, share ** ((n1 - 3) / 2))


def ttest(m1, v1, n1, m2, v2, n2) -> np.ndarray:
    a, b = np.maximum(1e-6, v1) / n1, np.maximum(1e-6, v2) / n2
    t2 = (m1 - m2) ** 2 / (a + b)
    freedom = np.floor((a + b) ** 2 / (a**2 / np.maximum(n1 - 1, 1) + b**2 / np.maximum(n2 - 1, 1)) + 0.5)
    freedom = np.maximum(freedom, 1)
    # Whole numbers, and few of them.
    some, back = np.unique(freedom, return_inverse=True)
    log_beta = np.array([math.lgamma(0.5) + math.lgamma(m / 2) - math.lgamma((m + 1) / 2) for m in some.tolist()])[back].reshape(freedom.shape)
    return np.exp(-(freedom + 1) / 2 * np.log1p(t2 / freedom) - 0.5 * np.log(freedom) - log_beta)


def _box_statistics(a: np.ndarray, low: np.ndarray, dims: np.ndarray, extent, centres: tuple[np.ndarray, np.ndarray], axis: int, which: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, variance and size of one of two boxes for every element at once; ``centres`` are (element, axis).

    A box reaches ``extent`` around its centre inside the tensor. What both
    boxes share goes to the nearer centre, ties to the side of their element
    along ``axis``. Each place in the box is one pass over all elements.
    """
    reach = np.array(extent)
    first = [np.maximum(c - reach, 0) for c in centres]
    end = [np.minimum(c + reach + 1, dims) for c in centres]
    lo, hi = np.maximum(*first), np.minimum(*end)
    middle, way = (lo + hi - 1) / 2, centres[1] - centres[0]
    sign = 1 if which == 0 else -1

    def places():
        for o in _offsets(extent):
            at = centres[which] + np.array(o)
            inside = np.all((at >= 0) & (at < dims), axis=1)
            shared = np.all((at >= lo) & (at < hi), axis=1)
            side = ((at - middle) * way).sum(axis=1)
            side = np.where(side != 0, side, (at - middle)[:, axis]) * sign
            own = inside & (~shared | (side < 0))
            value = a[tuple(np.clip(at - low, 0, np.array(a.shape) - 1).T)]
            yield own, np.where(own, value, 0.0)

    n, total = np.zeros(len(way)), np.zeros(len(way))
    for own, value in places():
        n += own
        total += value
    mean = total / np.maximum(n, 1)
    squares = np.zeros(len(way))
    for own, value in places():
        squares += np.where(own, (value - mean) ** 2, 0.0)
    return mean, squares / np.maximum(n - 1, 1), np.maximum(n, 1)


def region_weights(a: np.ndarray, low, dims, extent, core, min_weight: float, measure) -> np.ndarray:
    """Weights of a chunk's elements, from the statistics of the best boxes of an element and of its next on each axis; NaN where there is none."""
    low, dims, n = np.array(low), np.array(dims), a.ndim
    offsets = centre_offsets(a, low, dims, extent)
    shape = a[core].shape
    place = np.indices(shape).reshape(n, -1).T + np.array([s.start for s in core]) + low
    out = np.full((place.shape[0], n), np.nan)

    def centre(at: np.ndarray) -> np.ndarray:
        o = offsets[tuple((at - low).T)].astype(np.int64)
        return np.where((o == 127).any(axis=1)[:, None], at, at + o)

    for axis in range(n):
        there = place[:, axis] + 1 < dims[axis]
        p = place[there]
        q = p + (np.arange(n) == axis)
        centres = centre(p), centre(q)
        one, other = (_box_statistics(a, low, dims, extent, centres, axis, k) for k in (0, 1))
        out[there, axis] = np.maximum(measure(*one, *other), min_weight)
    return out.reshape(*shape, n)


def _region_weights(t: Tensor, extent, min_weight: float, measure) -> Tensor:
    """Weights from the statistics of the two elements' best boxes; what both boxes share goes to the nearer centre."""
    extent, dims, n = window._extents(extent, t.nd), t.shape().dims, t.nd
    if any(c <= 2 * e + 1 and c < d for c, d, e in zip(t.shape().chunk, dims, extent, strict=True)):
        raise TensorError("chunks must be longer than the box")

    def kernel(arrays, low, core):
        return region_weights(arrays[0], low, dims, extent, core, min_weight, measure)

    found = window.map_overlap(t.cast("f64").df, t.shape(), tuple(4 * e + 1 for e in extent), ["value"], kernel, F64.vec(n)).unfold_dtype()
    return found.replaced(found.df.where(~F.isnan("value")))


def bhattacharyya_var_gaussian(t: Tensor, extent, min_weight: float = 1e-5) -> Tensor:
    return _region_weights(t, extent, min_weight, bhattacharyya)


def ttest_weights(t: Tensor, extent, min_weight: float = 1e-5) -> Tensor:
    return _region_weights(t, extent, min_weight, ttest)


def random_walker_weights(t: Tensor, function: str, min_weight: float = 1e-5, **args) -> Tensor:
    """Weights by name: ``grady``, ``bian_mean``, ``bhattacharyya_var_gaussian`` or ``ttest``."""
    table = {"grady": grady, "bian_mean": bian, "bhattacharyya_var_gaussian": bhattacharyya_var_gaussian, "ttest": ttest_weights}
    if function not in table:
        raise TensorError(f"no such weight function: {function}")
    return table[function](t, min_weight=min_weight, **args)


def random_walker_weights_lod(lod: LodTensor, function: str, min_weight: float = 1e-5, **args) -> list[Tensor]:
    return [random_walker_weights(x.inner, function, min_weight, **args) for x in lod.levels]


