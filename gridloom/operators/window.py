"""Neighbourhood operators: convolutions, box statistics, neighbour pairs, and kernels on overlapping chunks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..meta import F64, DType, TensorError, TensorMeta
from ..tensor import Tensor, positions
from .select import chunk_index

#: Elements of a line that one window may hold; longer lines are cut into overlapping blocks.
LINE = 4096
#: Elements of a box that kernels take where the result doesn't depend on the chunks, and rows, copies included, that a task of a shuffle to kernels gets.
BOX, ROWS = 1 << 16, 1 << 20


def lines(t: Tensor, axis: int, halo: int) -> tuple[DataFrame, list[str], Column]:
    """Rows of ``t`` with the keys of their line, and the condition that a row is not a copy.

    A line longer than ``LINE`` is cut into blocks, and elements within
    ``halo`` of a block are copied into it, so that no task holds a line.
    """
    meta = t.shape()
    others = [p for i, p in enumerate(positions(meta.ndim)) if i != axis]
    if meta.dims[axis] <= LINE and others:
        return t.df, others, F.lit(True)
    size, p = max(LINE, 4 * halo), f"p{axis}"
    last = max(0, (meta.dims[axis] - 1) // size)
    blocks = F.sequence(F.expr(f"greatest(0, ({p} - {halo}) div {size})"), F.expr(f"least({last}L, ({p} + {halo}) div {size})"))
    frame = t.df.withColumn("gl_block", F.explode(blocks))
    return frame, [*others, "gl_block"], F.expr(f"{p} div {size}") == F.col("gl_block")


def convolution_1d(t: Tensor, kernel, axis: int, border: str = "repeat") -> Tensor:
    """True convolution along an axis: ``out[p] = sum k[e - o] * in[p + o]`` for o from -e to e.

    ``repeat`` reads the first or last element outside the tensor, ``pad0``
    zero. Sums are formed in double precision and cast to the tensor's type
    after the pass, so integers are cut off each time.
    """
    kernel = [float(k) for k in kernel]
    if len(kernel) % 2 == 0:
        raise TensorError("kernels have an odd number of taps")
    if border not in ("repeat", "pad0"):
        raise TensorError(f"no such border: {border}")
    e, meta = len(kernel) // 2, t.shape()
    frame, keys, own = lines(t, axis, e)
    at = Window.partitionBy(*keys).orderBy(f"p{axis}")
    whole = at.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = range(t.dtype.size)
    values = [F.col("value") if t.dtype.size == 1 else F.col("value")[i] for i in parts]

    def reads(v: Column, o: int) -> Column:
        # Blocks hold their halo, so a missing neighbour is outside the tensor.
        found = F.lead(v, o).over(at) if o > 0 else F.lag(v, -o).over(at) if o < 0 else v
        outside = F.lit(0.0) if border == "pad0" else F.last(v).over(whole) if o > 0 else F.first(v).over(whole)
        return F.coalesce(found, outside).cast("double") if o else v.cast("double")

    sums = []
    for v in values:
        total = F.lit(0.0)
        for o in range(-e, e + 1):
            if kernel[e - o]:
                total = total + F.lit(kernel[e - o]) * reads(v, o)
        sums.append(total.cast(t.dtype.element) if not t.dtype.is_integer else F.when(total < 0, F.ceil(total)).otherwise(F.floor(total)).cast(t.dtype.element))
    p = positions(meta.ndim)
    value = sums[0] if t.dtype.size == 1 else F.array(*sums)
    return t.replaced(frame.select(*p, own.alias("gl_own"), value.alias("value")).where("gl_own").select(*p, "value"))


def separable_convolution(t: Tensor, kernels, border: str = "repeat") -> Tensor:
    """A kernel for each axis; the last axis is convolved first. One shuffle an axis."""
    if len(kernels) != t.nd:
        raise TensorError(f"{len(kernels)} kernels for {t.nd} axes")
    for axis in reversed(range(t.nd)):
        t = convolution_1d(t, kernels[axis], axis, border)
    return t


def along(a: np.ndarray, kernel: np.ndarray, axis: int, border: str = "repeat") -> np.ndarray:
    """The same convolution along an axis of an array."""
    e = len(kernel) // 2
    a = np.moveaxis(a, axis, -1)
    wide = np.pad(a, [(0, 0)] * (a.ndim - 1) + [(e, e)], mode="edge" if border == "repeat" else "constant")
    out = sum(kernel[e - o] * wide[..., e + o : e + o + a.shape[-1]] for o in range(-e, e + 1))
    return np.moveaxis(out, -1, axis)


def boxed(meta: TensorMeta, halo: tuple[int, ...]) -> TensorMeta:
    """The shape in chunks of up to ``BOX`` elements, made of smaller ones by doubling the axis on which the halo copies most."""
    size = list(meta.chunk)
    while True:
        short = [i for i in range(meta.ndim) if size[i] < meta.dims[i]]
        if not short:
            return meta.with_chunk(tuple(size))
        i = max(short, key=lambda i: halo[i] / size[i])
        longer = [min(2 * c, d) if i == k else c for k, (c, d) in enumerate(zip(size, meta.dims, strict=True))]
        if int(np.prod(longer, dtype=object)) > BOX:
            return meta.with_chunk(tuple(size))
        size = longer


def separable_in_chunks(t: Tensor, kernels, border: str = "repeat") -> Tensor:
    """``separable_convolution`` of a scalar tensor in one shuffle: each chunk with its surroundings as array.

    Short chunks are taken several at once, so that few elements are copied.
    """
    if len(kernels) != t.nd or t.dtype.size != 1 or t.dtype.is_integer:
        raise TensorError("a kernel for each axis, and a tensor of floating-point scalars")
    taps = [np.asarray(k, float) for k in kernels]

    def kernel(arrays, low, core):
        out = arrays[0]
        for axis in reversed(range(out.ndim)):
            out = along(out, taps[axis], axis, border)
        return out[core]

    halo = tuple(len(k) // 2 for k in taps)
    return t.replaced(map_overlap(t.df, boxed(t.shape(), halo), halo, ["value"], kernel, F64).df, dtype=F64)


def _extents(extent, n: int) -> tuple[int, ...]:
    out = (extent,) * n if isinstance(extent, int) else tuple(extent)
    if len(out) != n:
        raise TensorError("one extent for each axis")
    return out


def box(t: Tensor, extent, f: Callable[[Column], Column]) -> Tensor:
    """An aggregate over the elements within ``extent`` on each axis in turn."""
    for axis, e in reversed(list(enumerate(_extents(extent, t.nd)))):
        frame, keys, own = lines(t, axis, e)
        p = positions(t.nd)
        near = Window.partitionBy(*keys).orderBy(f"p{axis}").rowsBetween(-e, e)
        t = Tensor(t.shape(), F64, frame.select(*p, own.alias("gl_own"), f(F.col("value")).over(near).alias("value")).where("gl_own").select(*p, "value"))
    return t


def mean_filter(t: Tensor, extent) -> Tensor:
    """Mean over the box, of the elements inside the tensor. On a dense grid the mean of means is the box's mean."""
    return box(t.cast("f64"), extent, F.avg)


def box_counts(meta: TensorMeta, extent) -> list[Column]:
    """Elements of the box around a position, by axis."""
    return [F.expr(f"least({d - 1}L, p{i} + {e}) - greatest(0L, p{i} - {e}) + 1") for i, (d, e) in enumerate(zip(meta.dims, _extents(extent, meta.ndim), strict=True))]


def variances(t: Tensor, mean: Tensor, extent) -> Tensor:
    """Sum over the box of the squared distances of elements from their own means, by the box's count less one."""
    d = (t.cast("f64") - mean).square().compile()
    sums = box(d, extent, F.sum)
    count = F.lit(1)
    for c in box_counts(t.shape(), extent):
        count = count * c
    return sums.replaced(sums.df.select(*t.p, F.try_divide("value", (count - 1).cast("double")).alias("value")))


def weight_pairs(t: Tensor) -> Tensor:
    """``(value, next value)`` for each element and axis, as last axis; no row where there is no next element.

    A further axis of the rank's size numbers the directions.
    """
    meta = t.shape()
    p = positions(meta.ndim)
    out = None
    for axis in range(meta.ndim):
        frame, keys, own = lines(t, axis, 1)
        at = Window.partitionBy(*keys).orderBy(f"p{axis}")
        found = frame.select(*p, own.alias("gl_own"), "value", F.lead("value").over(at).alias("next"), F.lead(f"p{axis}").over(at).alias("gl_at")).where("gl_own AND gl_at IS NOT NULL")
        found = found.select(*p, F.lit(axis).cast("long").alias(f"p{meta.ndim}"), F.array("value", "next").alias("value"))
        out = found if out is None else out.unionByName(found)
    return Tensor(TensorMeta((*meta.dims, meta.ndim), (*meta.chunk, meta.ndim)), t.dtype.vec(2), out)


def with_halo(frame: DataFrame, meta: TensorMeta, halo: tuple[int, ...]) -> DataFrame:
    """Rows copied to every chunk that they lie within ``halo`` of, with that chunk's number (``gl_chunk``)."""
    index = F.lit(0)
    for i, (c, g, s, h) in enumerate(zip(meta.chunk, meta.grid, meta.strides(meta.grid), halo, strict=True)):
        near = F.sequence(F.expr(f"greatest(0, (p{i} - {h}) div {c})"), F.expr(f"least({g - 1}L, (p{i} + {h}) div {c})"))
        frame = frame.withColumn(f"gl_c{i}", F.explode(near) if h else F.expr(f"p{i} div {c}"))
        index = index + F.col(f"gl_c{i}") * s
    return frame.withColumn("gl_chunk", index.cast("long")).drop(*[f"gl_c{i}" for i in range(meta.ndim)])


def map_overlap(frame: DataFrame, meta: TensorMeta, halo, columns: list[str], kernel: Callable[..., np.ndarray | tuple[np.ndarray, ...]], dtype: DType | str, only: DataFrame | None = None) -> Tensor:
    """A numpy kernel on each chunk with its surroundings.

    ``kernel(arrays, low, core)`` gets a dense array for each of ``columns``
    (vectors as last axis, NaN where a row is missing; an element may have several rows
    if at most one tells each column's value), the position of its
    first element, and the slices of the chunk itself; it returns the chunk's
    values. One shuffle whatever the number of axes, with some ``ROWS`` rows a task at most; Python holds one chunk.
    ``only`` may list the chunks (``gl_chunk``) that are computed; rows of others aren't shuffled to them.
    """
    dtype, n = DType.parse(dtype), meta.ndim
    halo = _extents(halo, n)
    p = positions(n)
    halved = with_halo(frame.select(*p, *columns), meta, halo)
    if only is not None:
        halved = halved.join(only, "gl_chunk", "left_semi")
    copies = [d + 2 * h * (g - 1) for d, g, h in zip(meta.dims, meta.grid, halo, strict=True)]
    tasks = -(-int(np.prod(copies, dtype=object)) // ROWS)
    if tasks > 1:  # the sort before the kernel then needs no more memory on larger tensors
        halved = halved.repartition(max(tasks, int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "gl_chunk")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        info = meta.chunk_info(key[0].as_py())
        low = tuple(max(0, b - h) for b, h in zip(info.begin, halo, strict=True))
        high = tuple(min(d, b + s + h) for d, b, s, h in zip(meta.dims, info.begin, info.logical, halo, strict=True))
        shape = tuple(b - a for a, b in zip(low, high, strict=True))
        at = tuple(table.column(c).to_numpy() - low[i] for i, c in enumerate(p))
        arrays = []
        for c in columns:
            col = table.column(c).combine_chunks()
            if pa.types.is_list(col.type):
                width = len(col.values) // max(1, len(col)) if len(col) else 1
                a = np.full((*shape, width), np.nan)
                a[at] = col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), width)
            else:
                a = np.full(shape, np.nan)
                v = col.to_numpy(zero_copy_only=False)
                told = np.flatnonzero(~np.isnan(v)) if col.null_count else slice(None)
                a[tuple(x[told] for x in at)] = v[told]
            arrays.append(a)
        core = tuple(slice(b - a, b - a + s) for a, b, s in zip(low, info.begin, info.logical, strict=True))
        out = kernel(arrays, low, core)
        if not dtype.is_integer:
            out = np.asarray(out, np.float64)
        grid = np.indices(info.logical).reshape(n, -1)
        value = pa.array(out.reshape(-1, dtype.size).tolist() if dtype.size > 1 else out.ravel(), pa.list_(pa.from_numpy_dtype(dtype.numpy)) if dtype.size > 1 else None)
        if dtype.size == 1:
            value = value.cast(pa.from_numpy_dtype(np.dtype({"u1": "i2", "u2": "i4", "u4": "i8"}.get(dtype.numpy.str[1:], dtype.numpy.str))))
        return pa.table([*(pa.array(grid[i] + info.begin[i]) for i in range(n)), value], names=[*p, "value"])

    schema = ", ".join(f"{c} long" for c in p) + f", value {dtype.spark.simpleString()}"
    return Tensor(meta, dtype, halved.groupBy("gl_chunk").applyInArrow(run, schema))


def expand(t: Tensor, halo) -> DataFrame:
    """Chunks with their surroundings, clipped at the tensor's border: rows with ``gl_chunk``."""
    return with_halo(t.df, t.shape(), _extents(halo, t.nd))


def shrink(frame: DataFrame, meta: TensorMeta, dtype) -> Tensor:
    """The inverse of ``expand``: each element from its own chunk."""
    return Tensor(meta, dtype, frame.where(F.col("gl_chunk") == chunk_index(meta)).drop("gl_chunk"))


def gradient(t: Tensor, axis: int) -> Tensor:
    """Central differences along an axis, one-sided at the border."""
    frame, keys, own = lines(t.cast("f64"), axis, 1)
    at = Window.partitionBy(*keys).orderBy(f"p{axis}")
    before, after, v = F.lag("value").over(at), F.lead("value").over(at), F.col("value")
    steps = F.when(before.isNotNull(), 1).otherwise(0) + F.when(after.isNotNull(), 1).otherwise(0)
    value = F.coalesce(F.try_divide(F.coalesce(after, v) - F.coalesce(before, v), steps.cast("double")), F.lit(0.0))
    return Tensor(t.shape(), F64, frame.select(*t.p, own.alias("gl_own"), value.alias("value")).where("gl_own").select(*t.p, "value"))
