"""Transfer functions: values to colours."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..meta import U8, TensorError
from ..tensor import EmbeddedTensor, Tensor


@dataclass
class TransferFunction:
    """A table of RGBA colours over ``[min, max]``."""

    min: float
    max: float
    table: list[tuple[int, int, int, int]]

    @classmethod
    def gen(cls, low: float, high: float, n: int, f: Callable[[int], tuple]) -> TransferFunction:
        return cls(low, high, [tuple(int(v) for v in f(i)) for i in range(n)])

    @classmethod
    def gen_normalized(cls, low: float, high: float, n: int, f: Callable[[float], tuple]) -> TransferFunction:
        return cls.gen(low, high, n, lambda i: f(i / max(1, n - 1)))

    @classmethod
    def grey_ramp(cls, low: float, high: float) -> TransferFunction:
        return cls.gen(low, high, 256, lambda i: (i, i, i, i))

    @classmethod
    def red_ramp(cls, low: float, high: float) -> TransferFunction:
        return cls.gen(low, high, 256, lambda i: (i, 0, 0, i))

    @classmethod
    def from_numpy(cls, low: float, high: float, values: np.ndarray) -> TransferFunction:
        if values.ndim != 2 or values.shape[1] != 4 or values.dtype != np.uint8:
            raise TensorError("a table has rows of four bytes")
        return cls(low, high, [tuple(map(int, r)) for r in values])

    def normalized(self) -> TransferFunction:
        return TransferFunction(0.0, 1.0, self.table)

    def place(self, value: Column) -> Column:
        """The table's entry for a value: below ``min`` the first, above ``max`` the last."""
        share = F.greatest(F.lit(0.0), (value.cast("double") - self.min) / (self.max - self.min))
        return F.least(F.floor(share * len(self.table)), F.lit(len(self.table) - 1)).cast("int")

    def channel(self, value: Column, k: int) -> Column:
        """One byte of the colour, looked up in a literal string of hex digits: no join, and little generated code."""
        digits = "".join(f"{row[k]:02x}" for row in self.table)
        return F.conv(F.substr(F.lit(digits), self.place(value) * 2 + 1, F.lit(2)), 16, 10).cast("smallint")

    def colour(self, value: Column) -> Column:
        return F.when(value.isNotNull(), F.array(*[self.channel(value, k) for k in range(4)]))


def apply_tf(t, tf: TransferFunction):
    """Every element's colour, four bytes."""
    if isinstance(t, EmbeddedTensor):
        return t.map_inner(lambda x: apply_tf(x, tf))
    if t.dtype.size != 1:
        raise TensorError("transfer functions take scalars")
    return t.map(tf.colour, U8.vec(4))


def fit_range(t: Tensor, tf: TransferFunction, num_samples: int | None = 10, seed: int = 0) -> TransferFunction:
    """The same colours over the values' range, taken from a sample of chunks."""
    return TransferFunction(t.min_value(num_samples, seed).value(), t.max_value(num_samples, seed).value(), tf.table)


def alpha_blending(over: Tensor, under: Tensor) -> Tensor:
    """``over`` on ``under``, by the alpha of ``over``."""
    a = (over.index(3).cast("f32") / 255.0).splat(4)
    mixed = over.cast("f32x4") * a + under.cast("f32x4") * (_ones(4) - a)
    return mixed.cast("u8x4")


def _ones(n: int) -> Tensor:
    from ..tensor import const_vec

    return const_vec([1.0] * n)


def pad_channels(t: Tensor, n: int, value) -> Tensor:
    """Further vector elements of ``value`` up to ``n``."""
    from ..tensor import const, const_vec

    missing = n - t.dtype.size
    if missing <= 0:
        return t
    return t.concat(const(value, t.dtype.scalar) if missing == 1 else const_vec([value] * missing, t.dtype.scalar))
