"""Driver-side descriptions of tensors: element types, chunk grids, spacing and affine matrices."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import types as T


class TensorError(ValueError):
    """A tensor expression that has no meaning: types, shapes or ranges that don't fit."""


#: Scalar type -> (bits, signed, integer, Spark type). Spark has no unsigned types, so those are widened.
SCALARS = {
    "i8": (8, True, True, T.ByteType()), "u8": (8, False, True, T.ShortType()),
    "i16": (16, True, True, T.ShortType()), "u16": (16, False, True, T.IntegerType()),
    "i32": (32, True, True, T.IntegerType()), "u32": (32, False, True, T.LongType()),
    "i64": (64, True, True, T.LongType()), "u64": (64, False, True, T.DecimalType(20, 0)),
    "f32": (32, True, False, T.FloatType()), "f64": (64, True, False, T.DoubleType()),
}


@dataclass(frozen=True)
class DType:
    """A scalar type, or a vector of ``size`` of them. ``f64`` extends the nine types of the model, as tables hold doubles."""

    scalar: str
    size: int = 1

    def __post_init__(self):
        if self.scalar not in SCALARS:
            raise TensorError(f"no such element type: {self.scalar}")
        if self.size < 1:
            raise TensorError("a vector has at least one element")

    @classmethod
    def parse(cls, name: str | DType) -> DType:
        if isinstance(name, DType):
            return name
        base, _, size = name.partition("x")
        return cls(base, int(size or 1))

    bits = property(lambda self: SCALARS[self.scalar][0])
    is_signed = property(lambda self: SCALARS[self.scalar][1])
    is_integer = property(lambda self: SCALARS[self.scalar][2])
    element = property(lambda self: SCALARS[self.scalar][3])
    size_in_bytes = property(lambda self: self.bits // 8 * self.size)

    @property
    def spark(self) -> T.DataType:
        return self.element if self.size == 1 else T.ArrayType(self.element)

    @property
    def numpy(self) -> np.dtype:
        return np.dtype({"i": "i", "u": "u", "f": "f"}[self.scalar[0]] + str(self.bits // 8))

    @property
    def min_value(self):
        return (-(1 << (self.bits - 1)) if self.is_signed else 0) if self.is_integer else -math.inf

    @property
    def max_value(self):
        return ((1 << (self.bits - self.is_signed)) - 1) if self.is_integer else math.inf

    def vec(self, n: int) -> DType:
        return DType(self.scalar, n)

    def vectorize(self, n: int) -> DType:
        return DType(self.scalar, self.size * n)

    def scalar_type(self) -> DType:
        return DType(self.scalar)

    def __str__(self) -> str:
        return self.scalar + (f"x{self.size}" if self.size > 1 else "")


F32, F64, U8, U32, I8, I32, I64 = map(DType, ("f32", "f64", "u8", "u32", "i8", "i32", "i64"))


class Full:
    """A chunk size that covers the whole axis."""


def chunk_of(size, dim: int) -> int:
    return max(1, dim) if size is Full or isinstance(size, Full) else int(size)


@dataclass(frozen=True)
class ChunkInfo:
    """A chunk's place: where it begins, its allocated size, and the part inside the tensor."""

    begin: tuple[int, ...]
    mem: tuple[int, ...]
    logical: tuple[int, ...]

    end = property(lambda self: tuple(b + n for b, n in zip(self.begin, self.logical, strict=True)))
    is_full = property(lambda self: self.mem == self.logical)


@dataclass(frozen=True)
class TensorMeta:
    """Shape and regular chunk grid; axis 0 is the slowest."""

    dims: tuple[int, ...]
    chunk: tuple[int, ...] = field(default=())

    def __post_init__(self):
        dims = tuple(int(d) for d in self.dims)
        chunk = tuple(chunk_of(c, d) for c, d in zip(self.chunk or dims, dims, strict=False))
        if len(chunk) != len(dims) or len(self.chunk or dims) != len(dims):
            raise TensorError("dimensions and chunk size differ in length")
        if any(d < 0 for d in dims) or any(c < 1 for c in chunk):
            raise TensorError("dimensions can't be negative, chunks can't be empty")
        object.__setattr__(self, "dims", dims)
        object.__setattr__(self, "chunk", chunk)

    ndim = property(lambda self: len(self.dims))
    size = property(lambda self: math.prod(self.dims))
    grid = property(lambda self: tuple(-(-d // c) for d, c in zip(self.dims, self.chunk, strict=True)))
    num_chunks = property(lambda self: math.prod(self.grid))
    is_single_chunk = property(lambda self: self.num_chunks == 1)

    @staticmethod
    def strides(dims: tuple[int, ...]) -> tuple[int, ...]:
        return tuple(math.prod(dims[i + 1 :]) for i in range(len(dims)))

    def chunk_pos(self, pos) -> tuple[int, ...]:
        return tuple(p // c for p, c in zip(pos, self.chunk, strict=True))

    def pos_in_chunk(self, chunk_pos, pos) -> tuple[int, ...]:
        return tuple(p - q * c for p, q, c in zip(pos, chunk_pos, self.chunk, strict=True))

    def chunk_index(self, chunk_pos) -> int:
        if any(not 0 <= p < n for p, n in zip(chunk_pos, self.grid, strict=True)):
            raise TensorError(f"chunk {tuple(chunk_pos)} is outside the grid {self.grid}")
        return sum(p * s for p, s in zip(chunk_pos, self.strides(self.grid), strict=True))

    def chunk_coords(self, index: int) -> tuple[int, ...]:
        if not 0 <= index < self.num_chunks:
            raise TensorError(f"no chunk {index}")
        return tuple(index // s % n for s, n in zip(self.strides(self.grid), self.grid, strict=True))

    def chunk_info(self, index: int) -> ChunkInfo:
        begin = tuple(p * c for p, c in zip(self.chunk_coords(index), self.chunk, strict=True))
        return ChunkInfo(begin, self.chunk, tuple(min(c, d - b) for b, c, d in zip(begin, self.chunk, self.dims, strict=True)))

    def norm_to_voxel(self) -> np.ndarray:
        return translation([-0.5] * self.ndim) @ scaling(self.dims)

    def voxel_to_norm(self) -> np.ndarray:
        return scaling([1 / d for d in self.dims]) @ translation([0.5] * self.ndim)

    def with_chunk(self, chunk) -> TensorMeta:
        return TensorMeta(self.dims, tuple(chunk))


@dataclass(frozen=True)
class Embedding:
    """Physical distance between elements, by axis."""

    spacing: tuple[float, ...]

    nd = property(lambda self: len(self.spacing))

    def voxel_to_physical(self) -> np.ndarray:
        return scaling(self.spacing)

    def physical_to_voxel(self) -> np.ndarray:
        return scaling([1 / s for s in self.spacing])

    def norm_to_physical(self, meta: TensorMeta) -> np.ndarray:
        return self.voxel_to_physical() @ meta.norm_to_voxel()


# Affine matrices act on homogeneous columns whose coordinate 0 is the constant 1.


def scaling(factors) -> np.ndarray:
    return np.diag([1.0, *map(float, factors)])


def translation(offsets) -> np.ndarray:
    m = np.eye(len(offsets) + 1)
    m[1:, 0] = offsets
    return m


def homogeneous(linear) -> np.ndarray:
    m = np.eye(len(linear) + 1)
    m[1:, 1:] = linear
    return m


def transformed(m: np.ndarray, point) -> np.ndarray:
    """``m`` applied to a point; a projective last step divides by coordinate 0."""
    out = m @ np.array([1.0, *point])
    return out[1:] / out[0]


@dataclass(frozen=True)
class AABB:
    """An axis-aligned box, both corners included."""

    low: tuple[float, ...]
    high: tuple[float, ...]

    @classmethod
    def around(cls, points) -> AABB:
        p = np.asarray(points, float)
        return cls(tuple(p.min(0)), tuple(p.max(0)))

    def corners(self) -> np.ndarray:
        grid = np.meshgrid(*zip(self.low, self.high, strict=True), indexing="ij")
        return np.stack([g.ravel() for g in grid], 1)

    def transform(self, m: np.ndarray) -> AABB:
        return AABB.around([transformed(m, c) for c in self.corners()])

    def contains(self, point) -> bool:
        return all(a <= p <= b for a, p, b in zip(self.low, point, self.high, strict=True))


@dataclass(frozen=True)
class DownsampleStep:
    """How an axis shrinks from level to level: not at all, by its own factor, or together with others."""

    kind: str
    factor: float = 1.0

    @classmethod
    def of(cls, step) -> DownsampleStep:
        """``i`` (ignore), ``f2`` (fixed), ``2`` (synchronized), a number, or a step."""
        if isinstance(step, DownsampleStep):
            return step
        text = str(step)
        if text == "i":
            return cls("ignore")
        return cls("fixed", float(text[1:])) if text.startswith("f") else cls("synchronized", float(text))


def IgnoreStep() -> DownsampleStep:  # noqa: N802
    return DownsampleStep("ignore")


def FixedStep(factor: float) -> DownsampleStep:  # noqa: N802
    return DownsampleStep("fixed", factor)


def SynchronizedStep(factor: float) -> DownsampleStep:  # noqa: N802
    return DownsampleStep("synchronized", factor)


def can_reduce_further(meta: TensorMeta, steps) -> bool:
    return any(n > 1 and DownsampleStep.of(s).kind != "ignore" for n, s in zip(meta.grid, steps, strict=True))


def coarser(meta: TensorMeta, embedding: Embedding, steps) -> TensorMeta:
    """The next level's shape: axes of one chunk stay, synchronized axes move to the smallest next spacing."""
    steps = [DownsampleStep.of(s) for s in steps]
    factors = [1.0 if n == 1 or s.kind == "ignore" else s.factor for s, n in zip(steps, meta.grid, strict=True)]
    if min(factors) < 1:
        raise TensorError("levels can't grow")
    nxt = [s * f for s, f in zip(embedding.spacing, factors, strict=True)]
    moving = [v for v, s, n in zip(nxt, steps, meta.grid, strict=True) if s.kind == "synchronized" and n > 1]
    if moving:
        nxt = [max(old, min(moving)) if s.kind == "synchronized" else v for v, old, s in zip(nxt, embedding.spacing, steps, strict=True)]
    # Rounded to single precision first, so that ratios that are whole stay whole.
    dims = [math.ceil(np.float32(d) * np.float32(old / new)) for d, old, new in zip(meta.dims, embedding.spacing, nxt, strict=True)]
    return TensorMeta(tuple(dims), meta.chunk)
