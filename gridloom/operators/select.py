"""Selection by position: slices, squashed axes, re-chunking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..meta import Embedding, TensorError, TensorMeta, chunk_of
from ..tensor import EmbeddedTensor, LodTensor, Tensor, positions


def bounds(item, dim: int) -> tuple[int, int, bool]:
    """``(start, end, scalar)`` of an int, a slice, a pair or None (all), clamped to the axis."""
    if item is None:
        return 0, dim, False
    if isinstance(item, tuple):
        item = slice(*item)
    if isinstance(item, slice):
        if item.step not in (None, 1):
            raise TensorError("slices have step 1")
        start, end, _ = item.indices(dim)
        return start, max(start, end), False
    i = int(item)
    if i < 0:
        i += dim
    return min(i, dim), min(i + 1, dim), True


def chunk_columns(meta: TensorMeta) -> list[Column]:
    return [F.expr(f"p{i} div {c}") for i, c in enumerate(meta.chunk)]


def chunk_index(meta: TensorMeta) -> Column:
    """The linear chunk number of a row."""
    parts = [c * s for c, s in zip(chunk_columns(meta), meta.strides(meta.grid), strict=True)]
    return reduce(lambda a, b: a + b, parts, F.lit(0)).cast("long")


def z_order(meta: TensorMeta) -> Column:
    """A row's chunk along the Z-order curve: the bits of the chunk's grid position, interleaved."""
    out, n = F.lit(0).cast("long"), meta.ndim
    for bit in range(max(1, max(meta.grid)).bit_length()):
        for i, c in enumerate(chunk_columns(meta)):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(c, bit).bitwiseAND(F.lit(1)).cast("long"), bit * n + n - 1 - i))
    return out


def sliced(t: Tensor, ranges, chunk=None) -> Tensor:
    """The box of ``ranges``, moved to the origin: a filter on positions, which a scan prunes by."""
    meta = t.shape()
    if len(ranges) != meta.ndim:
        raise TensorError(f"{len(ranges)} ranges for {meta.ndim} axes")
    found = [bounds(r, d) for r, d in zip(ranges, meta.dims, strict=True)]
    if any(b <= a for a, b, _ in found):
        raise TensorError("an empty slice")
    frame = t.within([a for a, _, _ in found], [b - 1 for _, b, _ in found])
    dims = tuple(b - a for a, b, _ in found)
    size = tuple(chunk_of(c, d) for c, d in zip(chunk, dims, strict=True)) if chunk else tuple(min(c, d) for c, d in zip(meta.chunk, dims, strict=True))
    moved = lambda rows: rows.select(*[(F.col(f"p{i}") - a).alias(f"p{i}") for i, (a, _, _) in enumerate(found)], "value")

    def narrow(low: list[int], high: list[int]) -> DataFrame:
        return moved(t.within([x + a for x, (a, _, _) in zip(low, found, strict=True)], [x + a for x, (a, _, _) in zip(high, found, strict=True)]))

    return Tensor(TensorMeta(dims, size), t.dtype, moved(frame), narrow=narrow)


def squash(t: Tensor, dim: int) -> Tensor:
    """Drops an axis of one element."""
    meta = t.shape()
    if meta.dims[dim] != 1 or meta.chunk[dim] != 1:
        raise TensorError(f"axis {dim} has {meta.dims[dim]} elements in chunks of {meta.chunk[dim]}")
    rest = [i for i in range(meta.ndim) if i != dim]
    part = lambda rows: rows.select(*[F.col(f"p{i}").alias(f"p{k}") for k, i in enumerate(rest)], "value")

    def narrow(low: list[int], high: list[int]) -> DataFrame:
        whole = lambda at: [*at[:dim], 0, *at[dim:]]
        return part(t.within(whole(low), whole(high)))

    return Tensor(TensorMeta(tuple(meta.dims[i] for i in rest), tuple(meta.chunk[i] for i in rest)), t.dtype, part(t.df), narrow=narrow)


def indexed(t: Tensor, key) -> Tensor:
    """``t[...]``: slices keep their axis, integers drop it; one index for each axis."""
    key = key if isinstance(key, tuple) else (key,)
    meta = t.shape()
    if len(key) != meta.ndim:
        raise TensorError(f"{len(key)} indices for {meta.ndim} axes")
    chunk = tuple(1 if bounds(k, d)[2] else c for k, d, c in zip(key, meta.dims, meta.chunk, strict=True))
    out = sliced(t, key)
    out = rechunk(out, tuple(min(a, b) for a, b in zip(out.shape().chunk, chunk, strict=True)))
    for i in reversed(range(meta.ndim)):
        if bounds(key[i], meta.dims[i])[2]:
            out = squash(out, i)
    return out


def indexed_embedded(t: EmbeddedTensor, key) -> EmbeddedTensor:
    key = key if isinstance(key, tuple) else (key,)
    inner = indexed(t.inner, key)
    return EmbeddedTensor(inner, Embedding(tuple(s for s, k, d in zip(t.embedding.spacing, key, t.meta.dims, strict=True) if not bounds(k, d)[2])))


def slice_time(lod: LodTensor, at: float) -> LodTensor:
    """The level-wise slice of the first axis at ``at`` of its length (0 to 1)."""
    full = (slice(None),) * (lod.nd - 1)
    return lod.map(lambda t: indexed_embedded(t, (min(int(at * t.meta.dims[0]), t.meta.dims[0] - 1), *full)))


def rechunk(t: Tensor, chunk) -> Tensor:
    """The same elements on another grid. Long frames hold no chunks, so only the shape changes; sinks lay rows out by it."""
    meta = t.shape()
    new = TensorMeta(meta.dims, tuple(chunk_of(c, d) for c, d in zip(chunk, meta.dims, strict=True)))
    if new == meta:
        return t
    return Tensor(new, t.dtype, t.df, narrow=t.within)


def chunked(t: Tensor) -> Tensor:
    """Rows laid out by chunk, sorted inside: the physical form of ``rechunk``."""
    meta = t.shape()
    frame = t.df.withColumn("gl_chunk", chunk_index(meta)).repartition("gl_chunk").sortWithinPartitions("gl_chunk", *positions(meta.ndim))
    return t.replaced(frame.drop("gl_chunk"))


def chunk_rows(t: Tensor, chunks) -> DataFrame:
    """Rows of some chunks, by number. Each chunk is a box of its own, so the source reads these chunks alone."""
    infos = [t.shape().chunk_info(c) for c in dict.fromkeys(chunks)]
    boxes = [t.within(list(x.begin), [e - 1 for e in x.end]) for x in infos]
    return reduce(DataFrame.unionByName, boxes) if boxes else t.df.limit(0)


def point(t: Tensor, pos) -> Tensor:
    """The element at one position, as tensor without axes."""
    return indexed(t, tuple(int(p) for p in pos))


def union_along(a: Tensor, b: Tensor, axis: int) -> Tensor:
    """Two tensors side by side along an axis (the splitter)."""
    x, y = a.shape(), b.shape()
    if a.dtype != b.dtype or any(m != n for i, (m, n) in enumerate(zip(x.dims, y.dims, strict=True)) if i != axis):
        raise TensorError("parts that lie side by side share type and all other axes")
    moved = b.df.select(*[(F.col(c) + x.dims[axis] if i == axis else F.col(c)).alias(c) for i, c in enumerate(positions(y.ndim))], "value")
    dims = tuple(m + y.dims[axis] if i == axis else m for i, m in enumerate(x.dims))
    return a.replaced(a.df.unionByName(moved), TensorMeta(dims, x.chunk))


class Splitter:
    """Two frames in one, cut at ``share`` of an axis."""

    def __init__(self, size: tuple[int, int], share: float = 0.5, axis: int = 1):
        self.size, self.share, self.axis = tuple(size), share, axis

    def _part(self, n: int) -> TensorMeta:
        return TensorMeta(tuple(n if i == self.axis else s for i, s in enumerate(self.size)))

    def metadata_first(self) -> TensorMeta:
        return self._part(round(self.size[self.axis] * self.share))

    def metadata_last(self) -> TensorMeta:
        return self._part(self.size[self.axis] - round(self.size[self.axis] * self.share))

    def metadata_out(self) -> TensorMeta:
        return TensorMeta(self.size)

    def render(self, first: Tensor, last: Tensor) -> Tensor:
        return union_along(first, last, self.axis)


def quad(size: tuple[int, int]) -> tuple[Splitter, Splitter, Splitter]:
    """Splitters for four frames: one of rows, and one of columns for each row."""
    rows = Splitter(size, axis=0)
    return rows, Splitter(rows.metadata_first().dims), Splitter(rows.metadata_last().dims)
