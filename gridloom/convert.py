"""``python -m gridloom.convert SOURCE TARGET``: one format to another, with types, chunks and levels."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from . import sinks
from .meta import Embedding, Full, TensorMeta
from .operators.aggregate import const_chunk_table
from .sources import memory
from .sources.files import Hints, open_tensor
from .tensor import EmbeddedTensor

PROCEDURAL = {"ball": memory.ball, "full": memory.full, "mandelbulb": memory.mandelbulb, "mandelbrot": memory.mandelbrot}


def parse_chunk(text: str) -> tuple:
    return tuple(Full if x == "full" else int(x) for x in text.split(","))


def convert(source: str, target: str, chunk: tuple | None = None, dtype: str | None = None, unfold: bool = False, lod: tuple | None = None, table: float | None = None, dims: tuple | None = None, location: str | None = None) -> None:
    """Opens or makes a tensor, changes it as asked, and writes it by the target's ending."""
    if source in PROCEDURAL:
        meta = TensorMeta(dims, tuple(c if isinstance(c, int) else d for c, d in zip(chunk or dims, dims, strict=True)))
        t = PROCEDURAL[source](meta, Embedding((1.0,) * meta.ndim)).levels[0]
    else:
        t = open_tensor(source, Hints(chunk_size=chunk if source.endswith(".vvd") else None, location=location))
    if unfold:
        t = t.unfold_dtype()
    if dtype:
        t = t.map_inner(lambda x: x.cast(dtype))
    if chunk:
        t = t.map_inner(lambda x: x.rechunk(chunk))
    if table is not None:
        t = const_chunk_table(t.single_level_lod(), t.meta.chunk, table).levels[0].map_inner(lambda x: x.cast("f32"))
    write(t, target, lod)


def write(t: EmbeddedTensor, target: str, lod: tuple | None) -> None:
    if target.endswith(".zarr"):
        sinks.save_zarr_lod(t, target, lod) if lod else sinks.save_zarr(t, target)
    elif target.endswith((".h5", ".hdf5")):
        sinks.save_hdf5(t.create_lod(lod) if lod else t, target)
    elif target.endswith(".vvd"):
        sinks.save_vvd(t, target)
    elif target.endswith(".png"):
        sinks.save_screenshot(t.inner, target)
    elif target.endswith(".parquet"):
        sinks.save_lod(t, target, lod) if lod else sinks.save_tensor(t, target)
    else:
        raise SystemExit(f"no writer for {target}")


def main(args: list[str] | None = None) -> None:
    a = argparse.ArgumentParser(description=__doc__)
    a.add_argument("source", help=f"a file, or one of {', '.join(PROCEDURAL)}")
    a.add_argument("target")
    a.add_argument("--chunk", type=parse_chunk, help="sizes or 'full', by axis")
    a.add_argument("--dims", type=lambda s: tuple(map(int, s.split(","))), help="shape of a procedural source")
    a.add_argument("--dtype")
    a.add_argument("--unfold-dtype", action="store_true")
    a.add_argument("--lod", type=lambda s: tuple(s.split(",")), help="levels: i, f2 or 2, by axis")
    a.add_argument("--const-chunk-table", type=float, metavar="THRESHOLD")
    a.add_argument("--location")
    x = a.parse_args(args)
    SparkSession.builder.appName("convert").getOrCreate()
    convert(x.source, x.target, x.chunk, x.dtype, x.unfold_dtype, x.lod, x.const_chunk_table, x.dims, x.location)


if __name__ == "__main__":
    main()
