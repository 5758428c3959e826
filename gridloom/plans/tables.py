"""Tensors over the fixture tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..meta import F32, F64, TensorMeta
from ..sources.memory import from_table
from ..tensor import Tensor


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows(frame: DataFrame) -> int:
    return frame.count()  # answered from file footers


def events(spark: SparkSession, sf_dir: str, rank: int, dtype=F64, chunk=None) -> Tensor:
    """``events.value`` by event_id as 1-D, images of 100 columns, or volumes of 10 by 10 slices."""
    t = table(spark, sf_dir, "events").select("event_id", "value")
    n = rows(t)
    shape = {1: ((n,), ["event_id"], (1000,)), 2: ((n // 100, 100), ["event_id div 100", "event_id % 100"], (32, 32)), 3: ((n // 100, 10, 10), ["event_id div 100", "(event_id div 10) % 10", "event_id % 10"], (4, 4, 4))}
    dims, coords, size = shape[rank]
    return from_table(t, "value", coords, TensorMeta(dims, chunk or size), dtype, "event_id")


def unit(spark: SparkSession, sf_dir: str) -> Tensor:
    """The events image scaled to 0..1 by a constant."""
    return events(spark, sf_dir, 2).linear_rescale(1 / 500.0, 0.0).compile()


def embeddings(spark: SparkSession, sf_dir: str, dtype=F32) -> Tensor:
    """``embeddings`` as a list of vectors of 64."""
    t = table(spark, sf_dir, "embeddings")
    kind = dtype.vec(64)
    return from_table(t, F.col("embedding"), ["vec_id"], TensorMeta((rows(t),), (100,)), kind, "vec_id")


def vectors(spark: SparkSession, sf_dir: str) -> Tensor:
    return embeddings(spark, sf_dir, F64)


def part(spark: SparkSession, sf_dir: str) -> Tensor:
    t = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    return from_table(t, "p_retailprice", ["p_partkey"], TensorMeta((rows(t),), (500,)), key="p_partkey")


def orders(spark: SparkSession, sf_dir: str) -> Tensor:
    t = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return from_table(t, "o_totalprice", ["o_orderkey"], TensorMeta((rows(t),), (500,)), key="o_orderkey")
