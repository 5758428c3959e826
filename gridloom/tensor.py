"""Lazy tensors over DataFrames.

A tensor is a relation ``(p0, .., p{n-1}) -> value`` with one row an element.
Element-wise operations build one expression over the tensors they read, and
become one projection: of a single tensor without any join, of several after
a join on the position.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns as C
from .meta import F32, F64, I32, I64, U32, DType, Embedding, TensorError, TensorMeta


def positions(n: int) -> list[str]:
    return [f"p{i}" for i in range(n)]


def grid_frame(spark: SparkSession, dims: tuple[int, ...]) -> DataFrame:
    """Every position of a shape, computed where it is needed."""
    size = int(np.prod(dims, dtype=object)) if dims else 1
    return spark.range(size).select(*[F.expr(f"(id div {s}) % {d}").alias(f"p{i}") for i, (s, d) in enumerate(zip(TensorMeta.strides(dims), dims, strict=True))])


@dataclass(frozen=True, eq=False)
class Source:
    """A stored frame of positions and values that expressions read."""

    frame: DataFrame
    meta: TensorMeta
    #: From the first and last positions of a box, a frame that holds at least its elements but is cheaper to read.
    narrow: Callable[[list[int], list[int]], DataFrame] | None = None

    def within(self, low: list[int], high: list[int]) -> DataFrame:
        return self.narrow(low, high) if self.narrow else self.frame


@dataclass(frozen=True, eq=False)
class Expr:
    """An element-wise expression: the sources it reads and how to form its column from theirs."""

    sources: tuple[Source, ...]
    build: Callable[[dict[Source, Column]], Column]

    @staticmethod
    def join(f: Callable[..., Column], *parts: Expr) -> Expr:
        sources = tuple(dict.fromkeys(s for p in parts for s in p.sources))
        return Expr(sources, lambda env: f(*(p.build(env) for p in parts)))


class Tensor:
    """A lazy tensor of ``dtype``; ``meta`` is None for an expression that has no shape yet."""

    def __init__(self, meta: TensorMeta | None, dtype: DType | str, frame: DataFrame | None = None, expr: Expr | None = None, narrow: Callable[[list[int], list[int]], DataFrame] | None = None):
        self.meta, self.dtype = meta, DType.parse(dtype)
        if expr is None:
            source = Source(frame, meta, narrow)
            expr = Expr((source,), lambda env: env[source])
        self.expr = expr
        self._compiled: DataFrame | None = frame

    # Plan

    @property
    def nd(self) -> int:
        return self.shape().ndim

    def shape(self) -> TensorMeta:
        if self.meta is None:
            raise TensorError("the expression has no shape; give it one by with_md")
        return self.meta

    @property
    def p(self) -> list[str]:
        return positions(self.nd)

    @property
    def df(self) -> DataFrame:
        """The frame ``(p0, .., value)``: one projection over the joined sources."""
        if self._compiled is None:
            self._compiled = self._projection(lambda s: s.frame)
        return self._compiled

    def within(self, low: list[int], high: list[int]) -> DataFrame:
        """The elements from ``low`` to ``high``, both included: each source is narrowed to the box where it can be, and rows are then filtered."""
        meta = self.shape()
        frame = self._projection(lambda s: s.within(low, high)) if any(s.narrow for s in self.expr.sources) else self.df
        keep = [F.col(f"p{i}").between(a, b) for i, (a, b) in enumerate(zip(low, high, strict=True)) if (a, b) != (0, meta.dims[i] - 1)]
        return frame.where(reduce(lambda x, y: x & y, keep)) if keep else frame

    def _projection(self, of: Callable[[Source], DataFrame]) -> DataFrame:
        meta = self.shape()
        p = positions(meta.ndim)
        frames = []
        env: dict[Source, Column] = {}
        for k, s in enumerate(self.expr.sources):
            frames.append(of(s).select(*p, F.col("value").alias(f"v{k}")))
            env[s] = F.col(f"v{k}")
        if not frames:
            base = grid_frame(SparkSession.active(), meta.dims)
        else:
            base = frames[0]
            for f in frames[1:]:
                base = base.join(f, p) if p else base.crossJoin(f)
        return base.select(*p, self.expr.build(env).alias("value"))

    def compile(self) -> Tensor:
        """The same tensor as a plan of its own, which later expressions read as one source."""
        narrow = self.within if any(s.narrow for s in self.expr.sources) else None
        return Tensor(self.shape(), self.dtype, self.df, narrow=narrow)

    def with_md(self, meta: TensorMeta) -> Tensor:
        if self.meta is not None and self.meta != meta:
            raise TensorError("the expression has another shape already")
        return Tensor(meta, self.dtype, expr=self.expr)

    def replaced(self, frame: DataFrame, meta: TensorMeta | None = None, dtype: DType | None = None) -> Tensor:
        return Tensor(meta or self.shape(), dtype or self.dtype, frame)

    def embedded(self, embedding: Embedding) -> EmbeddedTensor:
        return EmbeddedTensor(self, embedding)

    def cache(self) -> Tensor:
        from pyspark import StorageLevel

        return self.replaced(self.df.persist(StorageLevel.MEMORY_AND_DISK))

    def distribute(self, n: int) -> Tensor:
        """Ranges of the axis with most chunks, one for each of ``n`` places."""
        meta = self.shape()
        axis = int(np.argmax(meta.grid))
        return self.replaced(self.df.repartitionByRange(n, f"p{axis}"))

    # Element-wise operations

    def _unary(self, dtype: DType, f: Callable[[Column], Column], meta: TensorMeta | None = None) -> Tensor:
        return Tensor(meta or self.meta, dtype, expr=Expr.join(f, self.expr))

    @staticmethod
    def _of(x, like: Tensor | None = None) -> Tensor:
        if isinstance(x, EmbeddedTensor):
            return x.inner
        if isinstance(x, Tensor):
            return x
        if isinstance(x, (list, tuple)):
            return const_vec(x)
        # A Python number is an f32 constant; an f64 tensor takes it as f64.
        return const(float(x), F64 if like is not None and like.dtype.scalar == "f64" else F32)

    @staticmethod
    def _shared(*parts: Tensor) -> TensorMeta | None:
        shapes = {p.meta for p in parts if p.meta is not None}
        if len(shapes) > 1:
            raise TensorError("tensors of different shape or chunks don't combine")
        return next(iter(shapes), None)

    def _binary(self, other, f: Callable[[Column, Column], Column], name: str) -> Tensor:
        other = self._of(other, self)
        if other.dtype != self.dtype:
            raise TensorError(f"{name} of {self.dtype} and {other.dtype}")
        size, kind = self.dtype.size, self.dtype.spark
        return Tensor(self._shared(self, other), self.dtype, expr=Expr.join(lambda a, b: C.elementwise(f, size, a, b).cast(kind), self.expr, other.expr))

    def __add__(self, other):
        return self._binary(other, lambda a, b: a + b, "sum")

    def __sub__(self, other):
        return self._binary(other, lambda a, b: a - b, "difference")

    def __mul__(self, other):
        return self._binary(other, lambda a, b: a * b, "product")

    def __truediv__(self, other):
        return self._binary(other, lambda a, b: C.divided(a, b, self.dtype), "quotient")

    def __radd__(self, other):
        return self._of(other, self) + self

    def __rsub__(self, other):
        return self._of(other, self) - self

    def __rmul__(self, other):
        return self._of(other, self) * self

    def __rtruediv__(self, other):
        return self._of(other, self) / self

    def min(self, other):
        return self._binary(other, F.least, "minimum")

    def max(self, other):
        return self._binary(other, F.greatest, "maximum")

    def _compare(self, other, f: Callable[[Column, Column], Column]) -> Tensor:
        other = self._of(other, self)
        if other.dtype != self.dtype or self.dtype.size != 1:
            raise TensorError(f"comparison of {self.dtype} and {other.dtype}; only equal scalars compare")
        return Tensor(self._shared(self, other), U32, expr=Expr.join(lambda a, b: f(a, b).cast("long"), self.expr, other.expr))

    def __lt__(self, other):
        return self._compare(other, lambda a, b: a < b)

    def __le__(self, other):
        return self._compare(other, lambda a, b: a <= b)

    def __gt__(self, other):
        return self._compare(other, lambda a, b: a > b)

    def __ge__(self, other):
        return self._compare(other, lambda a, b: a >= b)

    def __eq__(self, other):
        return self._compare(other, lambda a, b: a == b)

    def __ne__(self, other):
        return self._compare(other, lambda a, b: a != b)

    __hash__ = object.__hash__

    def _logical(self, other, f) -> Tensor:
        other = self._of(other)
        if self.dtype != U32 or other.dtype != U32:
            raise TensorError("and, or: only comparison results combine")
        return Tensor(self._shared(self, other), U32, expr=Expr.join(lambda a, b: f(a != 0, b != 0).cast("long"), self.expr, other.expr))

    def and_(self, other):
        return self._logical(other, lambda a, b: a & b)

    def or_(self, other):
        return self._logical(other, lambda a, b: a | b)

    __and__, __or__ = and_, or_

    def select(self, yes, no) -> Tensor:
        """``yes`` where this is not zero, else ``no``."""
        yes, no = self._of(yes), self._of(no)
        if yes.dtype != no.dtype or self.dtype.size != 1:
            raise TensorError(f"select of {yes.dtype} or {no.dtype} by {self.dtype}")
        return Tensor(self._shared(self, yes, no), yes.dtype, expr=Expr.join(lambda c, a, b: F.when(c != 0, a).otherwise(b), self.expr, yes.expr, no.expr))

    def _map(self, f: Callable[[Column], Column]) -> Tensor:
        size, kind = self.dtype.size, self.dtype.spark
        return self._unary(self.dtype, lambda c: C.elementwise(f, size, c).cast(kind))

    def abs(self) -> Tensor:
        if not self.dtype.is_signed:
            raise TensorError("abs of an unsigned type")
        return self._map(F.abs)

    def neg(self) -> Tensor:
        if not self.dtype.is_signed:
            raise TensorError("negative of an unsigned type")
        return self._map(lambda x: -x)

    __neg__ = neg

    def log(self) -> Tensor:
        """Natural logarithm: minus infinity for zero and NaN below it, as floating-point arithmetic has it; integers have neither, so null."""
        if self.dtype.is_integer:
            return self._map(F.ln)
        return self._map(lambda x: F.when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan"))).otherwise(F.ln(x)))

    def exp(self) -> Tensor:
        return self._map(F.exp)

    def sqrt(self) -> Tensor:
        return self._map(F.sqrt)

    def square(self) -> Tensor:
        return self._map(lambda x: x * x)

    def cast(self, dtype) -> Tensor:
        to = DType.parse(dtype)
        if to.size != self.dtype.size:
            raise TensorError(f"cast of {self.dtype} to {to}")
        return self if to == self.dtype else self._unary(to, lambda c: C.converted(c, self.dtype, to))

    def reinterpret(self, dtype) -> Tensor:
        """The same 32 bits read as the other of u32 and f32."""
        to = DType.parse(dtype)
        if {self.dtype.scalar, to.scalar} != {"u32", "f32"} or to.size != 1 or self.dtype.size != 1:
            raise TensorError(f"reinterpretation of {self.dtype} as {to}")
        a, b = self.dtype.numpy, to.numpy

        @F.arrow_udf(to.spark)
        def bits(x):
            import pyarrow as pa

            valid = np.array(x.is_valid())
            return pa.array(x.fill_null(0).to_numpy(zero_copy_only=False).astype(a).view(b).astype(np.int64 if b.kind == "u" else b), mask=~valid)

        return self._unary(to, bits)

    def index(self, i: int) -> Tensor:
        C.checked_index(i, self.dtype.size)
        size = self.dtype.size
        return self._unary(self.dtype.scalar_type(), lambda c: C.vector(c, size)[i])

    def index_range(self, start: int, end: int) -> Tensor:
        if not 0 <= start < end <= self.dtype.size:
            raise TensorError(f"range {start}..{end} of a vector of {self.dtype.size}")
        size = self.dtype.size
        one = end - start == 1
        return self._unary(self.dtype.vec(end - start), lambda c: C.vector(c, size)[start] if one else F.slice(C.vector(c, size), start + 1, end - start))

    def splat(self, n: int) -> Tensor:
        if self.dtype.size != 1:
            raise TensorError("only a scalar can be repeated")
        return self if n == 1 else self._unary(self.dtype.vec(n), lambda c: F.array_repeat(c, n))

    def concat(self, other) -> Tensor:
        other = self._of(other, self)
        if other.dtype.scalar != self.dtype.scalar:
            raise TensorError(f"concatenation of {self.dtype} and {other.dtype}")
        n, m = self.dtype.size, other.dtype.size
        return Tensor(self._shared(self, other), self.dtype.vec(n + m), expr=Expr.join(lambda a, b: F.concat(C.vector(a, n), C.vector(b, m)), self.expr, other.expr))

    def _fold(self, f) -> Tensor:
        size, kind = self.dtype.size, self.dtype.element
        return self._unary(self.dtype.scalar_type(), lambda c: C.folded(f, size, c).cast(kind))

    def hsum(self) -> Tensor:
        return self._fold(lambda a, b: a + b)

    hadd = hsum

    def hmul(self) -> Tensor:
        return self._fold(lambda a, b: a * b)

    def hmin(self) -> Tensor:
        return self._fold(F.least)

    def hmax(self) -> Tensor:
        return self._fold(F.greatest)

    def map(self, f: Callable[[Column], Column], dtype=None) -> Tensor:
        """Any column function, or an Arrow function, on each element."""
        to = DType.parse(dtype) if dtype else self.dtype
        return self._unary(to, lambda c: f(c).cast(to.spark))

    def map_numpy(self, f: Callable[[np.ndarray], np.ndarray], dtype=None) -> Tensor:
        """A numpy function of the values, batch by batch; vectors are rows of an array. For what columns can't express."""
        from .sources.memory import arrow_element, schema

        to, own = DType.parse(dtype) if dtype else self.dtype, self.dtype
        meta = self.shape()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                col = b.column(meta.ndim)
                values = col.flatten().to_numpy(zero_copy_only=False).reshape(-1, own.size) if own.size > 1 else col.to_numpy(zero_copy_only=False)
                out = np.asarray(f(values.astype(own.numpy)))
                kind = arrow_element(to)
                if to.size > 1:
                    value: pa.Array = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, to.size), pa.int32()), pa.array(out.ravel()).cast(kind))
                else:
                    value = pa.array(out).cast(kind)
                yield pa.RecordBatch.from_arrays([*b.columns[: meta.ndim], value], names=[*self_p, "value"])

        self_p = self.p
        mapped = lambda rows: rows.select(*self_p, "value").mapInArrow(run, schema(meta.ndim, to))
        return Tensor(meta, to, mapped(self.df), narrow=lambda low, high: mapped(self.within(low, high)))

    def linear_rescale(self, factor: float, offset: float) -> Tensor:
        return self._map(lambda x: x * F.lit(factor) + F.lit(offset))

    # Other operators

    def __getitem__(self, key):
        from .operators import select

        return select.indexed(self, key)

    def slice(self, *ranges, chunk=None) -> Tensor:
        from .operators import select

        return select.sliced(self, ranges, chunk)

    def rechunk(self, chunk) -> Tensor:
        from .operators import select

        return select.rechunk(self, chunk)

    def squash(self, dim: int) -> Tensor:
        from .operators import select

        return select.squash(self, dim)

    def unfold_dtype(self) -> Tensor:
        """Vector elements as a further, last axis."""
        meta, n = self.shape(), self.dtype.size
        p = positions(meta.ndim)
        array = F.col("value") if n > 1 else F.array("value")
        frame = self.df.select(*p, F.posexplode(array).alias("last", "value")).select(*p, F.col("last").cast("long").alias(f"p{meta.ndim}"), "value")
        return Tensor(TensorMeta((*meta.dims, n), (*meta.chunk, n)), self.dtype.scalar_type(), frame)

    def fold_into_dtype(self) -> Tensor:
        """The last axis, which must be one chunk, as vector elements."""
        meta = self.shape()
        if meta.grid[-1] != 1:
            raise TensorError("the last axis is more than one chunk")
        p, n = positions(meta.ndim - 1), meta.dims[-1]
        pairs = F.array_sort(F.collect_list(F.struct(F.col(f"p{meta.ndim - 1}").alias("i"), "value")))
        joined = pairs["value"] if self.dtype.size == 1 else F.flatten(pairs["value"])
        value = joined if n * self.dtype.size > 1 else joined[0]
        frame = self.df.groupBy(*p).agg(value.alias("value")) if p else self.df.agg(value.alias("value"))
        return Tensor(TensorMeta(meta.dims[:-1], meta.chunk[:-1]), self.dtype.vectorize(n), frame)

    def mean_value(self, num_samples: int | None = None, seed: int = 0) -> ScalarTensor:
        from .operators import aggregate

        return aggregate.mean(self, num_samples, seed)

    def min_value(self, num_samples: int | None = None, seed: int = 0) -> ScalarTensor:
        from .operators import aggregate

        return aggregate.minimum(self, num_samples, seed)

    def max_value(self, num_samples: int | None = None, seed: int = 0) -> ScalarTensor:
        from .operators import aggregate

        return aggregate.maximum(self, num_samples, seed)

    def chunk_aggregation(self, method: str, chunk=None) -> Tensor:
        from .operators import aggregate

        return aggregate.chunk_aggregation(self, method, chunk)

    def separable_convolution(self, kernels, border: str = "repeat") -> Tensor:
        from .operators import window

        return window.separable_convolution(self, kernels, border)

    def resample_transform(self, meta: TensorMeta, matrix, border: str = "repeat") -> Tensor:
        from .operators import resample

        return resample.resample_transform(self, meta, matrix, border)

    # Results

    def numpy(self) -> np.ndarray:
        """The whole tensor as array; for small ones."""
        from .sinks import as_array

        return as_array(self.df.toArrow(), self.shape().dims, (0,) * self.nd, self.dtype)


class ScalarTensor:
    """A lazy single value: a frame of one row."""

    def __init__(self, dtype: DType | str, frame: DataFrame):
        self.dtype, self.df = DType.parse(dtype), frame

    def map(self, f: Callable[[Column], Column], dtype=None) -> ScalarTensor:
        to = DType.parse(dtype) if dtype else self.dtype
        return ScalarTensor(to, self.df.select(f(F.col("value")).cast(to.spark).alias("value")))

    def value(self):
        row = self.df.first()
        return None if row is None else row[0]

    def over(self, tensor: Tensor, f: Callable[[Column, Column], Column], dtype=None) -> Tensor:
        """``f(element, scalar)`` for every element: the single row is joined to all, which no shuffle needs."""
        joined = tensor.df.crossJoin(F.broadcast(self.df.select(F.col("value").alias("scalar"))))
        return tensor.replaced(joined.select(*tensor.p, f(F.col("value"), F.col("scalar")).alias("value")), dtype=DType.parse(dtype) if dtype else None)


def const(value, dtype: DType | str = F32) -> Tensor:
    kind = DType.parse(dtype)
    return Tensor(None, kind, expr=Expr((), lambda env: F.lit(value).cast(kind.spark)))


def const_vec(values, dtype: DType | str = F32) -> Tensor:
    kind = DType.parse(dtype).vec(len(values))
    if kind.size == 1:
        return const(values[0], dtype)
    return Tensor(None, kind, expr=Expr((), lambda env: F.array(*[F.lit(v).cast(kind.element) for v in values])))


def constant(value, dtype: DType | str = F32) -> ScalarTensor:
    kind = DType.parse(dtype)
    return ScalarTensor(kind, SparkSession.active().range(1).select(F.lit(value).cast(kind.spark).alias("value")))


def position(meta: TensorMeta) -> Tensor:
    """Each element's own position, u32 of the rank."""
    p = positions(meta.ndim)
    kind = U32.vec(meta.ndim)
    cols = [F.col(c) for c in p]
    frame = grid_frame(SparkSession.active(), meta.dims)
    return Tensor(meta, kind, frame.select(*p, (F.array(*cols) if meta.ndim > 1 else cols[0]).alias("value")))


def dimensions(meta: TensorMeta) -> Tensor:
    return const_vec(list(meta.dims), U32)


class EmbeddedTensor:
    """A tensor with physical spacing; operations keep the spacing."""

    def __init__(self, inner: Tensor, embedding: Embedding):
        if embedding.nd != inner.nd:
            raise TensorError("spacing and tensor differ in rank")
        self.inner, self.embedding = inner, embedding

    meta = property(lambda self: self.inner.shape())
    dtype = property(lambda self: self.inner.dtype)
    nd = property(lambda self: self.inner.nd)
    df = property(lambda self: self.inner.df)

    def real_dimensions(self) -> tuple[float, ...]:
        return tuple(d * s for d, s in zip(self.meta.dims, self.embedding.spacing, strict=True))

    def map_inner(self, f: Callable[[Tensor], Tensor]) -> EmbeddedTensor:
        return EmbeddedTensor(f(self.inner), self.embedding)

    def unfold_dtype(self, spacing: float = 1.0) -> EmbeddedTensor:
        return EmbeddedTensor(self.inner.unfold_dtype(), Embedding((*self.embedding.spacing, spacing)))

    def fold_into_dtype(self) -> EmbeddedTensor:
        return EmbeddedTensor(self.inner.fold_into_dtype(), Embedding(self.embedding.spacing[:-1]))

    def single_level_lod(self) -> LodTensor:
        return LodTensor([self])

    def create_lod(self, steps) -> LodTensor:
        from .operators import resample

        return resample.create_lod(self, steps)

    def __getitem__(self, key):
        from .operators import select

        return select.indexed_embedded(self, key)

    def __getattr__(self, name: str):
        found = getattr(self.inner, name)
        if not callable(found):
            return found

        def call(*args, **kw):
            out = found(*args, **kw)
            return EmbeddedTensor(out, self.embedding) if isinstance(out, Tensor) and out.meta is not None and out.nd == self.nd else out

        return call


def _delegate(name: str):
    def method(self, *args):
        out = getattr(self.inner, name)(*args)
        return EmbeddedTensor(out, self.embedding)

    return method


for _name in ("__add__", "__sub__", "__mul__", "__truediv__", "__radd__", "__rsub__", "__rmul__", "__rtruediv__", "__neg__", "__lt__", "__le__", "__gt__", "__ge__", "__eq__", "__ne__", "__and__", "__or__"):
    setattr(EmbeddedTensor, _name, _delegate(_name))
EmbeddedTensor.__hash__ = object.__hash__


class LodTensor:
    """Levels of one tensor, finest first."""

    def __init__(self, levels: list[EmbeddedTensor]):
        if not levels or len({x.dtype for x in levels}) > 1:
            raise TensorError("levels must exist and share their type")
        self.levels = list(levels)

    nd = property(lambda self: self.levels[0].nd)
    dtype = property(lambda self: self.levels[0].dtype)

    def fine_metadata(self) -> TensorMeta:
        return self.levels[0].meta

    def fine_embedding_data(self) -> Embedding:
        return self.levels[0].embedding

    def map(self, f: Callable[[EmbeddedTensor], EmbeddedTensor]) -> LodTensor:
        return LodTensor([f(x) for x in self.levels])

    def cache(self) -> LodTensor:
        return self.map(lambda x: x.map_inner(Tensor.cache))

    def cache_coarse_levels(self) -> LodTensor:
        return LodTensor([self.levels[0], *(x.map_inner(Tensor.cache) for x in self.levels[1:])])

    def distribute(self, n: int) -> LodTensor:
        return self.map(lambda x: x.map_inner(lambda t: t.distribute(n)))


__all__ = ["F32", "F64", "I32", "I64", "U32", "EmbeddedTensor", "Expr", "LodTensor", "ScalarTensor", "Tensor", "const", "const_vec", "constant", "dimensions", "grid_frame", "position", "positions"]
