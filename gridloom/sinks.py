"""Results and files: chunks as arrays, Parquet tables of tensors and levels, zarr, vvd and PNG."""

from __future__ import annotations

import json
import os
import time
import zlib
from collections.abc import Iterator
from xml.sax.saxutils import quoteattr

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .meta import DType, Embedding, TensorError, TensorMeta
from .operators.resample import create_lod
from .operators.select import chunk_index, chunk_rows
from .storage import release, staged
from .tensor import EmbeddedTensor, LodTensor, ScalarTensor, Tensor, positions


def as_array(table: pa.Table, shape: tuple[int, ...], begin: tuple[int, ...], dtype: DType) -> np.ndarray:
    """Long rows as array; missing rows are NaN, or zero for integers."""
    n = len(shape)
    full = (*shape, dtype.size) if dtype.size > 1 else shape
    out = np.zeros(full, dtype.numpy) if dtype.is_integer else np.full(full, np.nan, dtype.numpy)
    at = tuple(table.column(p).to_numpy() - b for p, b in zip(positions(n), begin, strict=True))
    col = table.column("value").combine_chunks()
    if dtype.size > 1:
        out[at] = col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dtype.size).astype(dtype.numpy)
    else:
        values = col.to_numpy(zero_copy_only=False)
        out[at] = values.astype(dtype.numpy) if not dtype.is_integer or not col.null_count else np.nan_to_num(values).astype(dtype.numpy)
    return out


#: Chunks that are resolved as a box each; more are read as one box around them, which keeps the plan small.
BOXES = 64


class RunTime:
    """Evaluates lazy tensors; memory and threads are Spark's."""

    def __init__(self, spark: SparkSession | None = None):
        self.spark = spark or SparkSession.active()

    def resolve(self, t: Tensor | EmbeddedTensor, chunks: list) -> list[np.ndarray]:
        """Chosen chunks, by number or grid position, as arrays: one job that reads only what they need."""
        t = t.inner if isinstance(t, EmbeddedTensor) else t
        meta = t.shape()
        if t.dtype.size != 1:
            raise TensorError("only scalars are resolved; unfold vectors first")
        wanted = [c if isinstance(c, int) else meta.chunk_index(tuple(c)) for c in chunks]
        infos = [meta.chunk_info(c) for c in wanted]
        if not infos:
            return []
        if len(set(wanted)) <= BOXES:
            rows = chunk_rows(t, wanted)
        else:
            # One box around all prunes the scan; the exact set follows.
            rows = t.within([min(x.begin[i] for x in infos) for i in range(meta.ndim)], [max(x.end[i] for x in infos) - 1 for i in range(meta.ndim)])
        rows = rows.withColumn("gl_chunk", chunk_index(meta)).where(F.col("gl_chunk").isin(wanted)).toArrow()
        keys = rows.column("gl_chunk").to_numpy()
        return [as_array(rows.filter(pa.array(keys == c)), x.logical, x.begin, t.dtype) for c, x in zip(wanted, infos, strict=True)]

    def resolve_scalar(self, s: ScalarTensor):
        return s.value()

    def bench(self, t: Tensor) -> float:
        """Seconds that computing all elements takes."""
        began = time.time()
        t.df.write.format("noop").mode("overwrite").save()
        return time.time() - began


def element(t: Tensor | EmbeddedTensor, pos):
    """The value at one position."""
    from .operators.select import point

    inner = t.inner if isinstance(t, EmbeddedTensor) else t
    row = point(inner, pos).df.first()
    return None if row is None else row["value"]


# Parquet


def _meta_json(t: EmbeddedTensor, dense: bool) -> str:
    return json.dumps({"dims": t.meta.dims, "chunk": t.meta.chunk, "spacing": t.embedding.spacing, "dtype": str(t.dtype), "dense": dense})


def save_tensor(t: EmbeddedTensor, path: str, level: int = 0, mode: str = "overwrite", dense: bool = False) -> None:
    """A table laid out by chunk, with its description beside it; both are read back by ``read_tensor``.

    Long rows by default: rows of a chunk are neighbours in a file, so the
    statistics that Parquet keeps for every position column let slices skip the
    rest. With ``dense`` a row is a chunk, its place in the grid and its bytes, which
    take a fifth of the space or less, and slices skip by the place; missing elements are then NaN, or zero for integers.
    """
    p = positions(t.nd)
    spark = t.df.sparkSession
    if dense:
        frame = _dense_rows(t).repartitionByRange("chunk_index").sortWithinPartitions("chunk_index")
    else:
        frame = t.df.withColumn("chunk_index", chunk_index(t.meta)).repartitionByRange("chunk_index").sortWithinPartitions("chunk_index", *p)
    frame.write.mode(mode).option("compression", "zstd").parquet(f"{path}/level={level}/rows")
    spark.createDataFrame([(level, _meta_json(t, dense))], "level int, meta string").coalesce(1).write.mode(mode).json(f"{path}/level={level}/meta")


def _dense_rows(t: EmbeddedTensor) -> DataFrame:
    """``(chunk_index, c0, .., data)``: a row a chunk, row-major and little-endian."""
    meta, kind = t.meta, t.dtype
    cells = [f"c{i}" for i in range(meta.ndim)]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        info = meta.chunk_info(key[0].as_py())
        data = as_array(table, info.logical, info.begin, kind)
        at = [pa.array([b // c], pa.int64()) for b, c in zip(info.begin, meta.chunk, strict=True)]
        return pa.table([pa.array([key[0].as_py()], pa.int64()), *at, pa.array([data.astype(data.dtype.newbyteorder("<")).tobytes()], pa.binary())], names=["chunk_index", *cells, "data"])

    return _chunk_rows(t.inner).groupBy("gl_chunk").applyInArrow(run, "chunk_index long, " + ", ".join(f"{c} long" for c in cells) + ", data binary")


def _from_dense(chunks: DataFrame, meta: TensorMeta, kind: DType) -> Tensor:
    """The tensor of such rows; a box reads the chunks that it meets."""
    from .sources.memory import rows, schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for index, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                info = meta.chunk_info(index)
                shape = (*info.logical, kind.size) if kind.size > 1 else info.logical
                yield rows(info.begin, np.frombuffer(data.as_buffer(), kind.numpy.newbyteorder("<")).reshape(shape).astype(kind.numpy), kind)

    def frame(low: list[int], high: list[int]) -> DataFrame:
        some = chunks
        for i, (a, b, c, d) in enumerate(zip(low, high, meta.chunk, meta.dims, strict=True)):
            if (a, b) != (0, d - 1):
                some = some.where(F.col(f"c{i}").between(a // c, b // c))
        return some.select("chunk_index", "data").mapInArrow(run, schema(meta.ndim, kind))

    return Tensor(meta, kind, frame([0] * meta.ndim, [d - 1 for d in meta.dims]), narrow=frame)


def _read_level(path: str, level: int) -> EmbeddedTensor:
    spark = SparkSession.active()
    head = json.loads(spark.read.schema("level int, meta string").json(f"{path}/level={level}/meta").first()["meta"])
    meta, kind = TensorMeta(tuple(head["dims"]), tuple(head["chunk"])), DType.parse(head["dtype"])
    stored = spark.read.parquet(f"{path}/level={level}/rows")
    t = _from_dense(stored, meta, kind) if head.get("dense") else Tensor(meta, kind, stored.select(*positions(meta.ndim), "value"))
    return EmbeddedTensor(t, Embedding(tuple(head["spacing"])))


def read_tensor(path: str) -> EmbeddedTensor:
    return _read_level(path, 0)


def _levels(path: str) -> list[int]:
    spark = SparkSession.active()
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        raise TensorError(f"{path} does not exist")
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    return sorted(int(n.removeprefix("level=")) for n in names if n.startswith("level="))


def read_lod(path: str) -> LodTensor:
    return LodTensor([_read_level(path, k) for k in _levels(path)])


def save_lod(t: EmbeddedTensor | LodTensor, path: str, steps=None, dense: bool = False) -> LodTensor:
    """Levels as tables. Given one tensor, each level is written, read back, and shrunk to the next, which cuts lineage."""
    if isinstance(t, LodTensor):
        for k, level in enumerate(t.levels):
            save_tensor(level, path, k, dense=dense)
        return read_lod(path)

    def between(level: EmbeddedTensor, k: int) -> EmbeddedTensor:
        save_tensor(level, path, k, dense=dense)
        return _read_level(path, k)

    return create_lod(t, steps or (2.0,) * t.nd, between)


# Files of other formats: each task writes its own chunks below a folder that all executors see.


def _chunk_rows(t: Tensor) -> DataFrame:
    return t.df.withColumn("gl_chunk", chunk_index(t.shape()))


def _each_chunk(t: Tensor, write) -> int:
    meta, kind = t.shape(), t.dtype

    def run(key: tuple, table: pa.Table) -> pa.Table:
        info = meta.chunk_info(key[0].as_py())
        write(info, as_array(table, info.logical, info.begin, kind))
        return pa.table({"n": pa.array([1], pa.int64())})

    return _chunk_rows(t).groupBy("gl_chunk").applyInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def save_zarr(t: EmbeddedTensor, path: str, location: str = "/array", compression: int = 1) -> None:
    """A zarr array, version 3, zstd unless ``compression`` is 0; empty chunks are stored too."""
    from .sources import paths
    from .sources.files import ZARR_TYPES

    names = {v: k for k, v in ZARR_TYPES.items()}
    if t.dtype.size != 1 or t.dtype.scalar not in names:
        raise TensorError(f"zarr does not store {t.dtype}")
    folder = paths.joined(path, location)
    codecs = [{"name": "bytes", "configuration": {"endian": "little"}}]
    if compression:
        codecs.append({"name": "zstd", "configuration": {"level": compression, "checksum": False}})
    head = {"zarr_format": 3, "node_type": "array", "shape": list(t.meta.dims), "data_type": names[t.dtype.scalar], "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": list(t.meta.chunk)}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "fill_value": 0, "codecs": codecs, "attributes": {"spacing_us": list(t.embedding.spacing)}}
    for name, body in ((path, {"zarr_format": 3, "node_type": "group", "attributes": {}}), (folder, head)):
        paths.put(paths.joined(name, "zarr.json"), json.dumps(body).encode())

    def write(info, data: np.ndarray) -> None:
        whole = np.zeros(info.mem, data.dtype)
        whole[tuple(slice(0, n) for n in info.logical)] = data
        raw = whole.astype(whole.dtype.newbyteorder("<")).tobytes()
        if compression:
            import zstandard

            raw = zstandard.ZstdCompressor(level=compression).compress(raw)
        paths.put(paths.joined(folder, "c", *(str(b // c) for b, c in zip(info.begin, info.mem, strict=True))), raw)

    _each_chunk(t.inner, write)


def save_zarr_lod(t: EmbeddedTensor | LodTensor, path: str, steps=None, compression: int = 1, recreate: bool = False) -> None:
    """Levels as arrays ``/level{k}``: those of ``t``, or with ``recreate`` and for one tensor, its finest, each level written, opened again and shrunk to the next."""
    from .sources.files import open_zarr

    if isinstance(t, LodTensor) and recreate:
        t = t.levels[0]
    if isinstance(t, LodTensor):
        for k, level in enumerate(t.levels):
            save_zarr(level, path, f"/level{k}", compression)
        return

    def between(level: EmbeddedTensor, k: int) -> EmbeddedTensor:
        save_zarr(level, path, f"/level{k}", compression)
        return open_zarr(path, f"/level{k}")

    create_lod(t, steps or (2.0,) * t.nd, between)


def zip_store(path: str, target: str) -> None:
    """A zarr folder as zip archive without compression, which readers can seek in."""
    import zipfile

    with zipfile.ZipFile(target, "w", zipfile.ZIP_STORED) as z:
        for folder, _, names in os.walk(path):
            for name in sorted(names):
                full = os.path.join(folder, name)
                z.write(full, os.path.relpath(full, path))


def save_raw(t: Tensor, path: str) -> None:
    """A row-major file; tasks write their chunks into their places."""
    meta, kind = t.shape(), t.dtype
    shape = (*meta.dims, kind.size) if kind.size > 1 else meta.dims
    with open(path, "wb") as f:
        f.truncate(meta.size * kind.size_in_bytes)
    kind_np = kind.numpy

    def write(info, data: np.ndarray) -> None:
        whole = np.memmap(path, kind_np, "r+", 0, shape)
        whole[tuple(slice(b, b + n) for b, n in zip(info.begin, info.logical, strict=True))] = data
        whole.flush()

    _each_chunk(t, write)


def save_vvd(t: EmbeddedTensor, path: str) -> None:
    """A volume of scalars as XML header and raw file."""
    from .sources.files import VVD_TYPES

    names = {v[0]: k for k, v in VVD_TYPES.items()}
    if t.nd != 3 or str(t.dtype) not in names:
        raise TensorError(f"vvd does not store {t.nd} axes of {t.dtype}")
    raw = os.path.splitext(path)[0] + ".raw"
    save_raw(t.inner, raw)
    z, y, x = t.meta.dims
    a, b, c = t.embedding.spacing
    scale = VVD_TYPES[names[str(t.dtype)]][1]
    with open(path, "w") as f:
        f.write(
            f'<?xml version="1.0" ?>\n<VoreenData version="1"><Volumes><Volume><RawData filename={quoteattr(os.path.basename(raw))} format="{names[str(t.dtype)]}" x="{x}" y="{y}" z="{z}" />'
            f'<MetaData><MetaItem name="Spacing" type="Vec3MetaData"><value x="{c}" y="{b}" z="{a}" /></MetaItem>'
            f'<MetaItem name="RealWorldMapping" type="RealWorldMappingMetaData"><value scale="{scale}" offset="0" unit="" /></MetaItem></MetaData></Volume></Volumes></VoreenData>\n'
        )


def save_hdf5(t: EmbeddedTensor | LodTensor, path: str, location: str = "/volume", compression: int = 1) -> None:
    """A dataset ``location``, or the levels as ``/level{k}``: chunks, shuffled and deflated unless ``compression`` is 0.

    Tasks compress chunks into a stored table; their sizes, two numbers a chunk, say where each
    lies, and tasks then write them there. The driver adds the metadata. ``path`` must be visible to every executor.
    """
    from .sources import hdf5

    parts = [(f"level{k}", level) for k, level in enumerate(t.levels)] if isinstance(t, LodTensor) else [(location.strip("/"), t)]
    end, done = hdf5.BEGIN, []
    with open(path, "wb") as f:
        f.write(bytes(end))
    for name, part in parts:
        if part.dtype.size != 1:
            raise TensorError(f"HDF5 does not store {part.dtype}")
        kind, meta = part.dtype.numpy.newbyteorder("<"), part.meta
        rows = staged(_packed_rows(part, kind, compression), "chunks")
        sizes = {r.chunk: r.size for r in rows.select("chunk", "size").collect()}
        places = {}
        for chunk in sorted(sizes):
            places[chunk] = end
            end += -(-sizes[chunk] // 8) * 8

        def write(batches: Iterator[pa.RecordBatch], places=places) -> Iterator[pa.RecordBatch]:
            for b in batches:
                with open(path, "r+b") as f:
                    for chunk, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                        f.seek(places[chunk])
                        f.write(data.as_py())
                yield pa.RecordBatch.from_arrays([b.column(0)], names=["chunk"])

        rows.select("chunk", "data").mapInArrow(write, "chunk long").agg(F.count("*")).collect()
        release(rows)
        filters = [(hdf5.SHUFFLE, (kind.itemsize,)), (hdf5.DEFLATE, (compression,))] if compression else []
        at = {meta.chunk_info(c).begin: (places[c], sizes[c]) for c in sizes}
        spacing = np.array(part.embedding.spacing, "<f8") * 1000
        done.append(hdf5.Written(name, meta.dims, kind, meta.chunk, at, filters, {"element_size_um": spacing}))
    head, rest = hdf5.metadata(done, end)
    with open(path, "r+b") as f:
        f.write(head)
        f.seek(end)
        f.write(rest)


def _packed_rows(t: EmbeddedTensor, kind: np.dtype, compression: int) -> DataFrame:
    """``(chunk, size, data)``: the bytes of each chunk as HDF5 stores them, always a whole chunk's."""
    meta, own = t.meta, t.dtype

    def run(key: tuple, table: pa.Table) -> pa.Table:
        info = meta.chunk_info(key[0].as_py())
        whole = np.zeros(meta.chunk, kind)
        whole[tuple(slice(0, n) for n in info.logical)] = as_array(table, info.logical, info.begin, own)
        raw = whole.tobytes()
        if compression:
            raw = zlib.compress(np.frombuffer(raw, np.uint8).reshape(-1, kind.itemsize).T.tobytes(), compression)
        return pa.table({"chunk": [key[0].as_py()], "size": [len(raw)], "data": pa.array([raw], pa.binary())})

    return _chunk_rows(t.inner).groupBy("gl_chunk").applyInArrow(run, "chunk long, size long, data binary")


def write_png(t: Tensor, path: str) -> None:
    """A frame of one chunk as PNG, encoded on the driver."""
    from .sources.files import encode_png

    if t.nd != 2 or str(t.dtype) != "u8x4" or not t.shape().is_single_chunk:
        raise TensorError("PNGs hold frames of four bytes in one chunk")
    with open(path, "wb") as f:
        f.write(encode_png(t.numpy()))


def save_screenshot(frame: Tensor, path: str) -> None:
    write_png(frame.rechunk(frame.shape().dims), path)


__all__ = ["RunTime", "element", "read_lod", "read_tensor", "save_lod", "save_tensor"]
