"""Column forms of the element-wise operations, for scalars and for vectors held as arrays."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..meta import DType, TensorError


def elementwise(f: Callable[..., Column], size: int, *cols: Column) -> Column:
    """``f`` on scalars, or on the elements of arrays of equal length."""
    if size == 1:
        return f(*cols)
    if len(cols) == 1:
        return F.transform(cols[0], f)
    if len(cols) == 2:
        return F.zip_with(cols[0], cols[1], f)
    return F.array(*[f(*(c[i] for c in cols)) for i in range(size)])


def wrapped(c: Column, to: DType) -> Column:
    """An integer column folded into the range of ``to``, as fixed-width arithmetic does."""
    if to.bits >= 64:
        return c.cast(to.element)
    span = 1 << to.bits
    if to.is_signed:
        return (F.pmod(c.cast("long") + span // 2, F.lit(span)) - span // 2).cast(to.element)
    return F.pmod(c.cast("long"), F.lit(span)).cast(to.element)


def converted(c: Column, source: DType, to: DType) -> Column:
    """A cast: fractions are cut off, integers that don't fit wrap around."""
    if to.is_integer and (source.is_integer and (source.bits > to.bits or source.is_signed != to.is_signed)):
        return elementwise(lambda x: wrapped(x, to), to.size, c)
    if to.is_integer and not source.is_integer and to.bits < 64:
        return elementwise(lambda x: wrapped(x.cast("long"), to), to.size, c)
    return c.cast(to.spark)


def divided(a: Column, b: Column, kind: DType) -> Column:
    """Quotients: those of integers are cut off; division by zero gives null."""
    if kind.is_integer:
        return F.when(b != 0, F.when((a < 0) != (b < 0), -F.floor(F.abs(a) / F.abs(b))).otherwise(F.floor(F.abs(a) / F.abs(b)))).cast(kind.element)
    return F.try_divide(a, b).cast(kind.element)


def folded(f: Callable[[Column, Column], Column], size: int, c: Column) -> Column:
    """``f`` over the elements of a vector, from first to last."""
    return c if size == 1 else reduce(f, [c[i] for i in range(size)])


def vector(c: Column, size: int) -> Column:
    """A scalar as array of one, an array as itself."""
    return F.array(c) if size == 1 else c


def checked_index(i: int, size: int) -> int:
    if not 0 <= i < size:
        raise TensorError(f"index {i} is outside a vector of {size}")
    return i
