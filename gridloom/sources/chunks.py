"""Tensors that are read chunk by chunk; a box of positions is turned into the chunks that it meets, and no others are read.

A Python data source with pushed filters would say the same to the optimizer.
Spark 4.1 keeps the last pushed filters with the relation, though, and a later
query without filters on the same frame then reads the former box; so boxes
are given by the tensor's own operations (``Source.narrow``) instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..meta import ChunkInfo, DType, TensorMeta
from ..tensor import Tensor
from .memory import rows, schema

#: Chunks that one task reads at most.
CHUNKS_A_TASK = 256


def from_chunks(meta: TensorMeta, dtype: DType, read: Callable[[ChunkInfo], np.ndarray], in_order: bool = False) -> Tensor:
    """A tensor whose chunks are read by tasks, those only that a query's box needs; with ``in_order`` one task reads them one after another."""
    spark = SparkSession.active()

    def frame(low: list[int], high: list[int]) -> DataFrame:
        first = [a // c for a, c in zip(low, meta.chunk, strict=True)]
        count = [b // c - f + 1 for b, c, f in zip(high, meta.chunk, first, strict=True)]
        n = prod(count)
        tasks = 1 if in_order else max(min(n, 4 * spark.sparkContext.defaultParallelism), -(-n // CHUNKS_A_TASK))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k in b.column(0).to_pylist():
                    at = np.unravel_index(k, count) if count else ()
                    info = meta.chunk_info(meta.chunk_index(tuple(int(f + i) for f, i in zip(first, at, strict=True))))
                    yield rows(info.begin, read(info), dtype)

        return spark.range(0, n, 1, tasks).mapInArrow(run, schema(meta.ndim, dtype))

    return Tensor(meta, dtype, frame([0] * meta.ndim, [d - 1 for d in meta.dims]), narrow=frame)
