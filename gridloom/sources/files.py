"""Tensors in files: raw, vvd, NIfTI, PNG, HDF5 and zarr (version 3).

Headers are read on the driver; elements by the tasks, one chunk at a time and
only those that a query needs. Paths may be URIs; whatever they name must be
visible to every executor.
"""

from __future__ import annotations

import gzip
import json
import struct
import sys
import zipfile
import zlib
import xml.etree.ElementTree as ET
from dataclasses import dataclass

import numpy as np
from pyspark.sql import SparkSession

from ..meta import F32, U8, ChunkInfo, DType, Embedding, TensorError, TensorMeta, chunk_of
from ..operators.transfer import TransferFunction
from ..tensor import EmbeddedTensor, LodTensor, Tensor
from . import paths
from .chunks import from_chunks


def open_raw(path: str, meta: TensorMeta, dtype: DType | str, offset: int = 0) -> Tensor:
    """A row-major file of exactly the tensor's size; of a chunk, its rows are read, with all of the last axis."""
    kind = DType.parse(dtype)
    if paths.size(path) != meta.size * kind.size_in_bytes + offset:
        raise TensorError(f"{path} has {paths.size(path)} bytes, not {meta.size * kind.size_in_bytes + offset}")
    kind_np, dims = kind.numpy, meta.dims

    def read(info: ChunkInfo) -> np.ndarray:
        get = paths.ranges(path)
        n = max(0, meta.ndim - 2)
        out = []
        for at in np.ndindex(info.logical[:n]):
            lead = tuple(a + b for a, b in zip(at, info.begin, strict=False))
            rows = info.logical[n] if meta.ndim > 1 else 1
            first = (*lead, info.begin[n], 0) if meta.ndim > 1 else (0,)
            begin = int(np.ravel_multi_index(first, dims)) if dims else 0
            width = dims[-1] if dims else 1
            raw = get(offset + begin * kind.size_in_bytes, rows * width * kind.size_in_bytes)
            whole = np.frombuffer(raw, kind_np).reshape(rows, width, *([kind.size] if kind.size > 1 else []))
            last = slice(info.begin[-1], info.begin[-1] + info.logical[-1]) if dims else slice(None)
            out.append(whole[:, last])
        return np.stack(out).reshape((*info.logical, kind.size) if kind.size > 1 else info.logical)

    return from_chunks(meta, kind, read)


#: Vvd format names and NIfTI type codes, with the range that vvd maps integers from.
VVD_TYPES = {"float": ("f32", 1.0), "uint8": ("u8", 255.0), "uint16": ("u16", 65535.0)}
NIFTI_FLOAT = 16
NIFTI_UNITS_MM = {0: 1.0, 1: 1000.0, 2: 1.0, 3: 0.001}


def _xml(path: str) -> ET.Element:
    raw = paths.whole(path)
    if raw is None:
        raise TensorError(f"{path} does not exist")
    return ET.fromstring(raw)


def open_vvd(path: str, chunk=None) -> EmbeddedTensor:
    """A volume of one raw file with an XML header; values are mapped to real-world values as f32."""
    root = _xml(path)
    raw = root.find(".//RawData")
    if raw is None:
        raw = root.find(".//Raw")
    if raw is None:
        raise TensorError("the header names no raw data")
    dims = tuple(int(raw.get(k)) for k in ("z", "y", "x"))
    name = raw.get("format", "float")
    if name not in VVD_TYPES:
        raise TensorError(f"vvd type {name}")
    kind, top = VVD_TYPES[name]
    spacing, factor, shift = (1.0, 1.0, 1.0), 1.0, 0.0
    for item in root.iter("MetaItem"):
        v = item.find("value")
        if item.get("name") == "Spacing" and v is not None:
            spacing = tuple(float(v.get(k)) for k in ("z", "y", "x"))
        if item.get("name") == "RealWorldMapping" and v is not None:
            factor, shift = float(v.get("scale", 1)), float(v.get("offset", 0))
    meta = TensorMeta(dims, tuple(chunk_of(c, d) for c, d in zip(chunk or (64, 64, 64), dims, strict=True)))
    t = open_raw(paths.joined(path.rpartition("/")[0] or ".", raw.get("filename")), meta, kind)
    if kind != "f32":
        t = t.cast(F32)
        factor /= top
    if factor != 1.0 or shift != 0.0:
        t = t.linear_rescale(factor, shift)
    return EmbeddedTensor(t, Embedding(spacing))


def load_tfi(path: str) -> TransferFunction:
    """A transfer function from an XML list of keys, linear between them, 256 entries."""
    root = _xml(path)
    domain = root.find(".//domain")
    low, high = (float(domain.get("x", 0)), float(domain.get("y", 1))) if domain is not None else (0.0, 1.0)
    keys = []
    for key in root.iter("key"):
        at = float(key.find("intensity").get("value"))
        c = key.find("colorL")
        keys.append((at, [float(c.get(k)) for k in "rgba"]))
    keys.sort(key=lambda k: k[0])
    if not keys:
        raise TensorError("a transfer function has a key at least")
    xs = [k[0] for k in keys]
    place = np.linspace(0, 1, 256)
    table = np.stack([np.interp(place, xs, [k[1][i] for k in keys]) for i in range(4)], 1)
    return TransferFunction(low, high, [tuple(int(round(v)) for v in r) for r in table])


def _opened(path: str):
    files, inner = paths.located(path)
    f = files.open_input_file(inner)
    return gzip.open(f, "rb") if path.endswith(".gz") else f


def open_nifti(path: str, data: str | None = None) -> EmbeddedTensor:
    """A NIfTI-1 volume of 32-bit floats, in one file or header and data; a slice a chunk, spacing in mm."""
    with _opened(path) as f:
        h = f.read(352)
    order = "<" if struct.unpack("<i", h[:4])[0] == 348 else ">"
    if struct.unpack(order + "i", h[:4])[0] != 348 or h[344:347] not in (b"n+1", b"ni1"):
        raise TensorError("not a NIfTI header")
    dim = struct.unpack(order + "8h", h[40:56])
    if struct.unpack(order + "h", h[70:72])[0] != NIFTI_FLOAT or dim[0] != 3:
        raise TensorError("only volumes of 32-bit floats")
    unit = NIFTI_UNITS_MM.get(h[123] & 7, 1.0)
    pix = struct.unpack(order + "8f", h[76:108])
    offset = int(struct.unpack(order + "f", h[108:112])[0]) if data is None else 0
    meta = TensorMeta((dim[3], dim[2], dim[1]), (1, dim[2], dim[1]))
    source, plane = data or path, dim[2] * dim[1] * 4

    kept: dict[int, object] = {}

    def read(info: ChunkInfo) -> np.ndarray:
        # A task's slices follow each other: one stream goes on from each to the next, as a gzip file can't be entered elsewhere (one task reads it).
        at = offset + info.begin[0] * plane
        f = kept.get(0)
        if f is None or f.tell() > at:
            f = kept[0] = _opened(source)
        f.seek(at)
        return np.frombuffer(f.read(plane * info.logical[0]), order + "f4").reshape(info.logical).astype(np.float32)

    return EmbeddedTensor(from_chunks(meta, F32, read, in_order=source.endswith(".gz")), Embedding((pix[3] * unit, pix[2] * unit, pix[1] * unit)))


PNG = b"\x89PNG\r\n\x1a\n"


def decode_png(raw: bytes) -> np.ndarray:
    """8-bit RGB or RGBA, without interlacing, as (y, x, 4)."""
    if raw[:8] != PNG:
        raise TensorError("not a PNG")
    at, data, head = 8, b"", b""
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 4], "big")
        kind, body = raw[at + 4 : at + 8], raw[at + 8 : at + 8 + n]
        head = body if kind == b"IHDR" else head
        data += body if kind == b"IDAT" else b""
        at += 12 + n
    w, h, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", head)
    if depth != 8 or colour not in (2, 6) or interlace:
        raise TensorError("only 8-bit RGB and RGBA images without interlacing")
    c = 4 if colour == 6 else 3
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(h, 1 + w * c)
    out = np.zeros((h, w * c), np.uint8)
    for y in range(h):
        f, line = lines[y, 0], lines[y, 1:].copy()
        up = out[y - 1] if y else np.zeros(w * c, np.uint8)
        if f == 2:
            line += up
        elif f:
            for i in range(w * c):
                a = int(line[i - c]) if i >= c else 0
                b, d = int(up[i]), int(up[i - c]) if i >= c else 0
                if f == 1:
                    p = a
                elif f == 3:
                    p = (a + b) // 2
                else:
                    q = a + b - d
                    p = min((a, b, d), key=lambda v: abs(q - v))  # noqa: B023
                line[i] = (int(line[i]) + p) & 255
        out[y] = line
    image = out.reshape(h, w, c)
    return image if c == 4 else np.concatenate([image, np.full((h, w, 1), 255, np.uint8)], 2)


def encode_png(image: np.ndarray) -> bytes:
    h, w, _ = image.shape
    lines = np.concatenate([np.zeros((h, 1), np.uint8), image.astype(np.uint8).reshape(h, -1)], 1)

    def part(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return PNG + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines.tobytes())) + part(b"IEND", b"")


def read_png(path: str) -> Tensor:
    """An image of four bytes, one chunk, read through Spark's own file reader."""
    raw = bytes(SparkSession.active().read.format("binaryFile").load(path).select("content").first()[0])
    image = decode_png(raw)
    from .memory import from_numpy

    return from_numpy(image, dtype=U8.vec(4))


def open_frames(path: str) -> Tensor:
    """A folder of PNG images as video ``(frame, y, x)`` of three bytes, in the order of their names; a frame a chunk, so any is read alone.

    Stands for video files, which need a decoder: have one write its frames as images.
    """
    names = [n for n in paths.names(path) if n.lower().endswith(".png")]
    if not names:
        raise TensorError(f"{path} has no frames")

    def image(k: int) -> np.ndarray:
        return decode_png(paths.whole(paths.joined(path, names[k])))[..., :3]

    h, w, _ = image(0).shape

    def read(info: ChunkInfo) -> np.ndarray:
        out = image(info.begin[0])
        if out.shape[:2] != (h, w):
            raise TensorError(f"{names[info.begin[0]]} is {out.shape[:2]}, not {(h, w)}")
        return out[None]

    return from_chunks(TensorMeta((len(names), h, w), (1, h, w)), U8.vec(3), read)


#: zarr's names of the types.
ZARR_TYPES = {"int8": "i8", "uint8": "u8", "int16": "i16", "uint16": "u16", "int32": "i32", "uint32": "u32", "int64": "i64", "uint64": "u64", "float32": "f32"}


class Store:
    """Files below a folder, or members of a zip archive."""

    def __init__(self, path: str):
        self.path, self.zip = path, path.endswith(".zip")

    def archive(self) -> zipfile.ZipFile:
        """The archive, kept open by each process, so that its directory is read once."""
        kept = sys.__dict__.setdefault("_gridloom_archives", {})
        f = paths.opened(self.path)
        if kept.get(self.path, (None, None))[0] is not f:
            kept[self.path] = f, zipfile.ZipFile(f)
        return kept[self.path][1]

    def get(self, key: str) -> bytes | None:
        key = key.strip("/")
        if not self.zip:
            return paths.whole(paths.joined(self.path, key))
        try:
            return self.archive().read(key)
        except KeyError:
            return None

    def arrays(self) -> list[str]:
        every = self.archive().namelist() if self.zip else paths.names(self.path, recursive=True)
        names = [n[: -len("zarr.json")].rstrip("/") for n in every if n.endswith("zarr.json")]
        found = []
        for n in names:
            head = json.loads(self.get(f"{n}/zarr.json"))
            if head.get("node_type") == "array":
                found.append("/" + n)
        return found


def open_zarr(path: str, location: str = "/array") -> EmbeddedTensor:
    """An array of a zarr store, version 3: regular chunks of raw, gzip or zstd bytes; spacing from ``spacing_us``."""
    store = Store(path)
    raw = store.get(f"{location}/zarr.json")
    if raw is None:
        raise TensorError(f"{path} has no array {location}")
    head = json.loads(raw)
    if head["data_type"] not in ZARR_TYPES:
        raise TensorError(f"zarr type {head['data_type']}")
    kind = DType(ZARR_TYPES[head["data_type"]])
    if head["chunk_grid"]["name"] != "regular":
        raise TensorError("only regular chunk grids")
    meta = TensorMeta(tuple(head["shape"]), tuple(head["chunk_grid"]["configuration"]["chunk_shape"]))
    spacing = tuple(head.get("attributes", {}).get("spacing_us", [1.0] * meta.ndim))
    codecs = head["codecs"]
    sep = head.get("chunk_key_encoding", {}).get("configuration", {}).get("separator", "/")
    endian = next((c.get("configuration", {}).get("endian", "little") for c in codecs if c["name"] == "bytes"), "little")
    fill, kind_np = head.get("fill_value", 0), kind.numpy.newbyteorder("<" if endian == "little" else ">")

    def read(info: ChunkInfo) -> np.ndarray:
        at = sep.join(str(b // c) for b, c in zip(info.begin, info.mem, strict=True))
        data = store.get(f"{location}/c{sep}{at}")
        if data is None:
            return np.full(info.logical, fill, kind.numpy)
        for codec in reversed(codecs):
            if codec["name"] == "zstd":
                import zstandard

                data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
            elif codec["name"] == "gzip":
                data = gzip.decompress(data)
            elif codec["name"] == "crc32c":
                data = data[:-4]
            elif codec["name"] != "bytes":
                raise TensorError(f"zarr codec {codec['name']}")
        whole = np.frombuffer(data, kind_np).reshape(info.mem).astype(kind.numpy)
        return whole[tuple(slice(0, n) for n in info.logical)]

    return EmbeddedTensor(from_chunks(meta, kind, read), Embedding(spacing))


def _norm(e: Embedding) -> float:
    return float(np.linalg.norm(e.spacing))


def open_zarr_lod(path: str, prefix: str = "/level") -> LodTensor:
    """All arrays below a prefix, by spacing."""
    found = [open_zarr(path, a) for a in Store(path).arrays() if a.startswith(prefix)]
    if not found:
        raise TensorError(f"{path} has no arrays below {prefix}")
    return LodTensor(sorted(found, key=lambda t: _norm(t.embedding)))


def _hdf5(path: str):
    from .hdf5 import Reader

    return Reader(paths.ranges(path))


def open_hdf5(path: str, location: str | None = None) -> EmbeddedTensor:
    """A dataset of an HDF5 file, the only one unless named; spacing from ``element_size_um``."""
    found = _hdf5(path).datasets()
    if location is None:
        if len(found) != 1:
            raise TensorError(f"{path} has {len(found)} datasets; name one")
        location = next(iter(found))
    if location not in found:
        raise TensorError(f"{path} has no dataset {location}")
    d = _hdf5(path).dataset(found[location])
    # Without chunks, slices of the first axis are read.
    meta = TensorMeta(d.shape, d.chunks or (1, *d.shape[1:]))
    kind = DType(f"{d.dtype.kind}{d.dtype.itemsize * 8}")
    size = d.attributes.get("element_size_um")
    spacing = tuple(float(s) * 0.001 for s in size) if size is not None else (1.0 / d.shape[0],) * meta.ndim

    def read(info: ChunkInfo) -> np.ndarray:
        return _hdf5(path).box(d, info.begin, info.logical).astype(kind.numpy)

    return EmbeddedTensor(from_chunks(meta, kind, read), Embedding(spacing))


def open_hdf5_lod(path: str, prefix: str = "/level") -> LodTensor:
    found = [open_hdf5(path, n) for n in _hdf5(path).datasets() if n.startswith(prefix)]
    if not found:
        raise TensorError(f"{path} has no datasets below {prefix}")
    return LodTensor(sorted(found, key=lambda t: _norm(t.embedding)))


@dataclass(frozen=True)
class Hints:
    """What a reader may be told: chunks, the array's place, whether to re-chunk, and how levels shrink."""

    chunk_size: tuple | None = None
    location: str | None = None
    rechunk: bool = False
    lod_downsample_steps: tuple | None = None


def open_single_level(path: str, hints: Hints = Hints()) -> EmbeddedTensor:  # noqa: B008
    """A tensor by its file's ending."""
    name = path.lower().rstrip("/")
    if name.endswith(".vvd"):
        return open_vvd(path, hints.chunk_size)
    if name.endswith((".nii", ".nii.gz")):
        return open_nifti(path)
    if name.endswith(".hdr"):
        return open_nifti(path, path[:-4] + ".img")
    if name.endswith((".zarr", ".zarr.zip")):
        return open_zarr(path, hints.location or "/array")
    if name.endswith((".h5", ".hdf5")):
        return open_hdf5(path, hints.location)
    if name.endswith(".png"):
        t = read_png(path)
        return EmbeddedTensor(t, Embedding((1.0,) * t.nd))
    if name.endswith(".parquet"):
        from ..sinks import read_tensor

        return read_tensor(path)
    if name.endswith(".frames"):
        t = open_frames(path)
        return EmbeddedTensor(t, Embedding((1.0,) * t.nd))
    if name.endswith((".mp4", ".mkv")):
        raise TensorError("video files need a decoder, which isn't installed; have it write frames as PNG images into a folder named *.frames")
    raise TensorError(f"no reader for {path}")


def open_lod(path: str, hints: Hints = Hints()) -> LodTensor:  # noqa: B008
    name = path.lower().rstrip("/")
    if name.endswith((".zarr", ".zarr.zip")):
        return open_zarr_lod(path, hints.location or "/level")
    if name.endswith((".h5", ".hdf5")):
        return open_hdf5_lod(path, hints.location or "/level")
    if name.endswith(".parquet"):
        from ..sinks import read_lod

        return read_lod(path)
    raise TensorError(f"{path} can't hold levels")


def open_tensor(path: str, hints: Hints = Hints()) -> EmbeddedTensor:  # noqa: B008
    """The single tensor, or else level 0; the first attempt's error if neither works."""
    try:
        return open_single_level(path, hints)
    except (TensorError, OSError) as first:
        try:
            return open_lod(path, hints).levels[0]
        except (TensorError, OSError):
            raise first from None


def open_or_create_lod(path: str, hints: Hints = Hints()) -> tuple[LodTensor, str]:  # noqa: B008
    """The file's levels (``existing``), or levels made of its tensor (``dynamic``)."""
    if hints.rechunk and hints.chunk_size is None:
        raise TensorError("re-chunking needs a chunk size")
    try:
        return open_lod(path, hints), "existing"
    except (TensorError, OSError):
        t = open_tensor(path, hints)
        if hints.rechunk:
            t = t.map_inner(lambda x: x.rechunk(hints.chunk_size))
        return t.create_lod(hints.lod_downsample_steps or (2.0,) * t.nd), "dynamic"


__all__ = ["Hints", "load_tfi", "open_lod", "open_or_create_lod", "open_single_level", "open_tensor"]
