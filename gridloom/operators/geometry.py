"""Points under affine matrices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..meta import F32, TensorError
from ..tensor import Tensor


def affine(m: np.ndarray, coords: list[Column]) -> list[Column]:
    """Columns of the transformed coordinates; zero coefficients leave no term."""
    out = []
    for row in np.asarray(m, float)[1:]:
        terms = [F.lit(float(k)) * c for k, c in zip(row[1:], coords, strict=True) if k]
        total = F.lit(float(row[0]))
        for x in terms:
            total = total + x
        out.append(total)
    return out


def rounded(c: Column) -> Column:
    """Nearest integer, halves up."""
    return F.floor(c + 0.5)


def transform(points: Tensor, m: np.ndarray) -> Tensor:
    """A list of points (1-D tensor of vectors) under an affine matrix."""
    n = points.dtype.size
    if points.nd != 1 or len(m) != n + 1:
        raise TensorError("points are a list of vectors, with a matrix of one more row")
    cols = affine(m, [F.col("value")[i].cast("double") for i in range(n)] if n > 1 else [F.col("value").cast("double")])
    return points.replaced(points.df.select("p0", F.array(*[c.cast("float") for c in cols]).alias("value")), dtype=F32.vec(n))
