"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import release, release_all, remove, shared_dir, shuffles_removed, staged  # noqa: F401

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sheltered(docs: DataFrame) -> tuple[DataFrame, Callable[[str], Column]]:
    """``docs`` with columns named by their place, and a function from a column's own name to that column.

    An operator that keeps all columns works on these and renames them back at
    its end, so no name of its own can clash with one of the table's.
    """
    names = list(docs.columns)
    return docs.toDF(*[f"in_{k}" for k in range(len(names))]), lambda name: F.col(f"in_{names.index(name)}")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and leave every other character alone."""
    return F.translate(c, UPPER, LOWER)


def remainder(c: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null ids count as empty text."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bits of a key filter: 8 MB, whatever the data.
FILTER_BITS = 26


def key_filter(keys: DataFrame, column: str, bits: int = FILTER_BITS) -> np.ndarray:
    """A bitmap of hashed keys (longs), of ``2**bits`` bits: a fixed size that may be sent to every executor."""
    place = F.pmod(F.col(column), F.lit(1 << bits))
    found = keys.groupBy(F.shiftright(place, 15).alias("bucket")).agg(F.bitmap_construct_agg(place.bitwiseAND(F.lit(32767))).alias("bitmap"))
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in found.collect():
        out[r.bucket * 4096 : (r.bucket + 1) * 4096] = np.frombuffer(r.bitmap, np.uint8)
    return out


def maybe_in(df: DataFrame, column: str, bitmap: np.ndarray, inside: bool = True) -> DataFrame:
    """Rows whose key may be among those of a filter, or with ``inside=False`` those whose key is surely not.

    No key of the filter is missed; an exact join has to follow.

    The more keys a filter holds the more other rows it lets through, so it
    only saves what would be shuffled in vain, and never changes a result.
    """
    sent = df.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield filtered(batch, column, sent.value, inside)

    return df.mapInArrow(run, df.schema)


def filtered(batch: pa.RecordBatch, column: str, bitmap: np.ndarray, inside: bool = True) -> pa.RecordBatch:
    """The rows of one batch that ``maybe_in`` keeps."""
    place = batch.column(column).to_numpy(zero_copy_only=False) & (bitmap.size * 8 - 1)
    return batch.filter(pa.array((bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == int(inside)))
