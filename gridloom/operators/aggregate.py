"""Aggregates over all elements and by chunk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..meta import F32, F64, Embedding, TensorError, TensorMeta, chunk_of
from ..tensor import EmbeddedTensor, LodTensor, ScalarTensor, Tensor, positions
from .select import chunk_columns, chunk_rows


def _number(t: Tensor) -> Column:
    if t.dtype.size != 1:
        raise TensorError("aggregates take scalars")
    value = F.col("value")
    # NaN marks what isn't there, and must not win a maximum.
    return value if t.dtype.is_integer else F.nanvl(value, F.lit(None).cast(t.dtype.spark))


def sampled(t: Tensor, n: int, seed: int = 0) -> DataFrame:
    """Rows of ``n`` chunks, chosen by a hash of seed and chunk number; chunk numbers are known without reading data."""
    chunks = t.df.sparkSession.range(t.shape().num_chunks)
    return chunk_rows(t, [r.id for r in chunks.orderBy(F.md5(F.concat_ws(":", F.lit(seed), "id").cast("binary")), "id").limit(n).collect()])


def aggregated(t: Tensor, f, num_samples: int | None = None, seed: int = 0) -> ScalarTensor:
    frame = t.df if num_samples is None else sampled(t, num_samples, seed)
    kind = F64 if not t.dtype.is_integer else t.dtype
    return ScalarTensor(kind, frame.agg(f(_number(t)).alias("value")))


def mean(t: Tensor, num_samples: int | None = None, seed: int = 0) -> ScalarTensor:
    out = aggregated(t, F.avg, num_samples, seed)
    return ScalarTensor(F64, out.df)


def minimum(t: Tensor, num_samples: int | None = None, seed: int = 0) -> ScalarTensor:
    return aggregated(t, F.min, num_samples, seed)


def maximum(t: Tensor, num_samples: int | None = None, seed: int = 0) -> ScalarTensor:
    return aggregated(t, F.max, num_samples, seed)


METHODS = {"mean": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "count": F.count, "stddev": F.stddev_samp}


def chunk_aggregation(t: Tensor, method: str, chunk=None) -> Tensor:
    """One element for each chunk: a grouped aggregate, combined before its shuffle."""
    meta = t.shape()
    p = positions(meta.ndim)
    frame = t.df.groupBy(*[c.alias(n) for c, n in zip(chunk_columns(meta), p, strict=True)]).agg(METHODS[method](_number(t)).alias("value"))
    out = TensorMeta(meta.grid, tuple(chunk_of(c, d) for c, d in zip(chunk or meta.grid, meta.grid, strict=True)))
    return Tensor(out, F64 if method in ("mean", "stddev", "sum") else t.dtype, frame)


def _table(t: EmbeddedTensor, chunk, decide) -> EmbeddedTensor:
    meta = t.meta
    grid = TensorMeta(meta.dims, tuple(chunk_of(c, d) for c, d in zip(chunk, meta.dims, strict=True)))
    p = positions(meta.ndim)
    value = _number(t.inner)
    frame = t.df.groupBy(*[c.alias(n) for c, n in zip(chunk_columns(grid), p, strict=True)]).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.avg(value).alias("mean"))
    frame = frame.select(*p, F.when(decide(F.col("lo"), F.col("hi")), F.col("mean")).alias("value"))
    spacing = tuple(s * c for s, c in zip(t.embedding.spacing, grid.chunk, strict=True))
    return EmbeddedTensor(Tensor(TensorMeta(grid.grid), F64, frame), Embedding(spacing))


def const_chunk_table(lod: LodTensor, chunk, diff_threshold: float = 0.0) -> LodTensor:
    """A zone map: the mean of each chunk whose values differ by at most the threshold, else null."""
    return lod.map(lambda t: _table(t, chunk, lambda lo, hi: hi - lo <= diff_threshold))


def determined_chunk_table(t: EmbeddedTensor, chunk, decided: float = 0.01, homogeneous: float = 0.01) -> EmbeddedTensor:
    """Chunks that lie on one side of 0.5 by ``decided``, or vary by less than ``homogeneous``: their mean, else null."""
    return _table(t, chunk, lambda lo, hi: (hi <= 0.5 - decided) | (lo >= 0.5 + decided) | (hi - lo < homogeneous))


def with_table(t: Tensor, table: Tensor, chunk) -> Tensor:
    """Elements with the table's value where their chunk is constant: a left join on the chunk."""
    meta = t.shape()
    grid = TensorMeta(meta.dims, tuple(chunk))
    if table.shape().dims != grid.grid:
        raise TensorError("the table belongs to another grid")
    p = positions(meta.ndim)
    keys = [f"c{i}" for i in range(meta.ndim)]
    known = table.df.where("value IS NOT NULL").select(*[F.col(a).alias(b) for a, b in zip(p, keys, strict=True)], F.col("value").alias("whole"))
    rows = t.df.select("*", *[c.alias(k) for c, k in zip(chunk_columns(grid), keys, strict=True)])
    return t.replaced(rows.join(known, keys, "left").select(*p, F.coalesce("whole", "value").alias("value")))


def undecided_chunks(table: Tensor) -> DataFrame:
    """Positions of the chunks that are not constant."""
    return table.df.where("value IS NULL").select(*table.p)


__all__ = ["F32", "chunk_aggregation", "const_chunk_table", "determined_chunk_table", "maximum", "mean", "minimum", "sampled", "undecided_chunks", "with_table"]
