"""Tensors from values, arrays, tables and functions of the position."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..meta import F32, F64, DType, Embedding, TensorError, TensorMeta
from ..tensor import EmbeddedTensor, LodTensor, Tensor, grid_frame, positions


def arrow_element(dtype: DType) -> pa.DataType:
    """The Arrow type of the Spark type that holds an element."""
    return pa.from_numpy_dtype(np.dtype({"u1": "i2", "u2": "i4", "u4": "i8"}.get(dtype.numpy.str[1:], dtype.numpy.str)))


def rows(begin: tuple[int, ...], dense: np.ndarray, dtype: DType) -> pa.RecordBatch:
    """A dense box as long rows; vectors lie on the last axis."""
    shape = dense.shape[:-1] if dtype.size > 1 else dense.shape
    grid = np.indices(shape).reshape(len(shape), -1)
    kind = arrow_element(dtype)
    if dtype.size > 1:
        flat = pa.array(np.ascontiguousarray(dense).ravel()).cast(kind)
        value: pa.Array = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.__len__() + 1, dtype.size), pa.int32()), flat)
    else:
        value = pa.array(np.ascontiguousarray(dense).ravel()).cast(kind)
    return pa.RecordBatch.from_arrays([*(pa.array(grid[i].astype(np.int64) + begin[i]) for i in range(len(shape))), value], names=[*positions(len(shape)), "value"])


def schema(n: int, dtype: DType) -> str:
    return ", ".join(f"{p} long" for p in positions(n)) + (", " if n else "") + f"value {dtype.spark.simpleString()}"


def from_numpy(a: np.ndarray, chunk=None, dtype: DType | str | None = None) -> Tensor:
    """An array as tensor; f64 and 64-bit integers are accepted as extensions."""
    kind = DType.parse(dtype) if dtype else DType({"f4": "f32", "f8": "f64"}.get(a.dtype.str[1:], f"{a.dtype.kind}{a.dtype.itemsize * 8}"))
    shape = a.shape[:-1] if kind.size > 1 else a.shape
    spark = SparkSession.active()
    frame = spark.createDataFrame(pa.Table.from_batches([rows((0,) * len(shape), a, kind)]), schema(len(shape), kind))
    return Tensor(TensorMeta(shape, tuple(chunk) if chunk else shape), kind, frame)


def from_values(dims, values, dtype: DType | str = F32) -> Tensor:
    """A literal tensor of one chunk, row-major."""
    kind = DType.parse(dtype)
    a = np.asarray(values, kind.numpy)
    dims = tuple(dims)
    if a.size != int(np.prod(dims)) * kind.size:
        raise TensorError(f"{a.size} values for {dims} of {kind}")
    return from_numpy(a.reshape((*dims, kind.size) if kind.size > 1 else dims), dtype=kind)


def array(values, dtype: DType | str = F32) -> Tensor:
    return from_values((len(values) // DType.parse(dtype).size,), values, dtype)


def points(coords) -> DataFrame:
    """Points ``(point_id, coord)`` in physical space."""
    return SparkSession.active().createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(coords)], "point_id long, coord array<double>")


def from_table(frame: DataFrame, value: Column | str, coords: list[Column | str], meta: TensorMeta, dtype: DType | str = F64, key: str | None = None) -> Tensor:
    """Table rows as elements: a position for each axis and a value. Positions must be dense and distinct.

    ``key`` names a column that numbers the elements row-major. A box of
    positions then also is a range of keys, which the table's scan prunes by.
    """
    kind = DType.parse(dtype)
    col = lambda c: F.expr(c) if isinstance(c, str) else c

    def elements(rows: DataFrame) -> DataFrame:
        return rows.select(*[col(c).cast("long").alias(p) for c, p in zip(coords, positions(meta.ndim), strict=True)], col(value).cast(kind.spark).alias("value"))

    def narrow(low: list[int], high: list[int]) -> DataFrame:
        strides = TensorMeta.strides(meta.dims)
        return elements(frame.where(F.col(key).between(*(sum(a * s for a, s in zip(at, strides, strict=True)) for at in (low, high)))))

    return Tensor(meta, kind, elements(frame), narrow=narrow if key else None)


def voxel(dims, chunk, f: Callable[..., np.ndarray]) -> Tensor:
    """A numpy function of the position arrays, evaluated in Arrow batches."""
    meta = TensorMeta(tuple(dims), tuple(chunk))
    p = positions(meta.ndim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [b.column(c).to_numpy() for c in p]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.broadcast_to(np.asarray(f(*at), np.float32), at[0].shape))], names=[*p, "value"])

    return Tensor(meta, F32, grid_frame(SparkSession.active(), meta.dims).mapInArrow(run, schema(meta.ndim, F32)))


def normalized(dims, chunk, f: Callable[..., np.ndarray]) -> Tensor:
    """As ``voxel``, of positions divided by the dimensions."""
    return voxel(dims, chunk, lambda *at: f(*(a / d for a, d in zip(at, dims, strict=True))))


def rasterize(meta: TensorMeta, body: str) -> Tensor:
    """A SQL expression of ``v0..`` (positions) and ``n0..`` (positions by dimension), inside the generated code of the scan."""
    p = positions(meta.ndim)
    frame = grid_frame(SparkSession.active(), meta.dims)
    frame = frame.select(*p, *[F.col(c).alias(f"v{i}") for i, c in enumerate(p)], *[(F.col(c) / float(d)).alias(f"n{i}") for i, (c, d) in enumerate(zip(p, meta.dims, strict=True))])
    return Tensor(meta, F32, frame.select(*p, F.expr(body).cast("float").alias("value")))


def rasterize_lod(meta: TensorMeta, embedding: Embedding, body: str | Callable[[TensorMeta], Tensor]) -> LodTensor:
    """Levels of half the size each, until one chunk holds all."""
    make = body if callable(body) else lambda m: rasterize(m, body)
    levels, k = [], 0
    while True:
        dims = tuple(-(-d // (1 << k)) for d in meta.dims)
        own = TensorMeta(dims, meta.chunk)
        levels.append(EmbeddedTensor(make(own), Embedding(tuple(s * (1 << k) for s in embedding.spacing))))
        if all(c >= d for c, d in zip(own.chunk, dims, strict=True)):
            return LodTensor(levels)
        k += 1


def ball(meta: TensorMeta, embedding: Embedding) -> LodTensor:
    far = "sqrt(" + " + ".join(f"(n{i} - 0.5) * (n{i} - 0.5)" for i in range(meta.ndim)) + ")"
    return rasterize_lod(meta, embedding, f"greatest(0.0, least(1.0, 10 * (0.5 - {far})))")


def full(meta: TensorMeta, embedding: Embedding) -> LodTensor:
    return rasterize_lod(meta, embedding, "1.0")


#: Fixed values of the two fractals: centre of the view, its width and the radius at which a point counts as gone, most steps, and steps that count as none.
MANDELBROT_CENTRE, MANDELBROT_RADIUS, MANDELBROT_STEPS = (0.5, 0.8), 5.0, 50
MANDELBULB_RADIUS, MANDELBULB_STEPS, MANDELBULB_POWER = 2.3, 10, 8
NO_STEPS = 2


def _escape(points: np.ndarray, radius: float, most: int, step: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """For each column of ``points`` how long it takes to leave the radius when ``step`` is repeated from the point itself, from 0 (at once) to 1 (never)."""
    at, taken = points.copy(), np.zeros(points.shape[1])
    for _ in range(most):
        inside = np.sqrt((at * at).sum(axis=0)) <= radius
        if not inside.any():
            break
        at[:, inside] = step(at[:, inside], points[:, inside])
        at[:, ~inside] = np.inf
        taken += inside
    return np.maximum(taken - NO_STEPS, 0) / (most - NO_STEPS)


def _mandelbrot(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    points = np.stack([x - MANDELBROT_CENTRE[1], y - MANDELBROT_CENTRE[0]]) * MANDELBROT_RADIUS
    return _escape(points, MANDELBROT_RADIUS, MANDELBROT_STEPS, lambda v, c: np.stack([v[0] * v[0] - v[1] * v[1], 2 * v[0] * v[1]]) + c)


def mandelbrot(meta: TensorMeta, embedding: Embedding) -> LodTensor:
    return rasterize_lod(meta, embedding, lambda m: normalized(m.dims, m.chunk, _mandelbrot))


def _mandelbulb(z: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    def power(v: np.ndarray, c: np.ndarray) -> np.ndarray:
        r = np.sqrt((v * v).sum(axis=0)) ** MANDELBULB_POWER
        turn = MANDELBULB_POWER * np.arctan2(v[1], v[0])
        tilt = MANDELBULB_POWER * np.arctan2(np.sqrt(v[0] * v[0] + v[1] * v[1]), v[2])
        return np.stack([r * np.sin(tilt) * np.cos(turn), r * np.sin(tilt) * np.sin(turn), r * np.cos(tilt)]) + c

    return _escape(np.stack([x - 0.5, y - 0.5, z - 0.5]) * MANDELBULB_RADIUS, MANDELBULB_RADIUS, MANDELBULB_STEPS, power)


def mandelbulb(meta: TensorMeta, embedding: Embedding) -> LodTensor:
    return rasterize_lod(meta, embedding, lambda m: normalized(m.dims, m.chunk, _mandelbulb))
