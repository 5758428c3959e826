"""Frames as queries: slices of volumes, images, and rays."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..meta import F32, U8, Embedding, TensorError, TensorMeta, homogeneous, scaling, transformed, translation
from ..tensor import EmbeddedTensor, LodTensor, Tensor, grid_frame
from .geometry import affine, rounded
from .resample import select_level
from .transfer import TransferFunction

#: Squares of the pattern outside the data, in pixels, and its two colours.
CHECKER, LIGHT, DARK = 32, 48, 24
#: Zoom for one step of the wheel.
ZOOM = 0.05
#: How far a camera turns for each pixel, and which part of its distance a unit of movement takes.
PAN, MOVE = 0.005, 0.1


def checkerboard() -> Column:
    """The pattern's grey at a pixel."""
    odd = F.expr(f"(p0 div {CHECKER} + p1 div {CHECKER}) % 2") == 1
    return F.when(odd, F.lit(LIGHT)).otherwise(F.lit(DARK)).cast("smallint")


def zoomed(offset: tuple[float, float], level: float, delta: float, on: tuple[float, float]) -> tuple[tuple[float, float], float]:
    """Offset and zoom after a step that leaves the point ``on`` where it is."""
    factor = math.exp(-ZOOM * delta)
    return tuple(p - (p - o) / factor for o, p in zip(offset, on, strict=True)), level * factor


def slice_projection_fit(volume: TensorMeta, image: TensorMeta, selected: int) -> np.ndarray:
    """Pixels to voxels, the image stretched over the whole slice of axis 0."""
    factors = [1.0, volume.dims[1] / image.dims[0], volume.dims[2] / image.dims[1]]
    return translation([selected, -0.5, -0.5]) @ scaling(factors) @ translation([0.0, 0.5, 0.5])


def slice_projection(axis: int, volume: TensorMeta, embedding: Embedding, image: tuple[int, int], selected: int, offset=(0.0, 0.0), zoom: float = 1.0) -> np.ndarray:
    """Pixels to voxels of a slice that fits the image, centred, then moved and zoomed."""
    size = np.array(volume.dims) * np.array(embedding.spacing)
    across, down = {0: (2, 1), 1: (2, 0), 2: (1, 0)}[axis]
    scale = max(size[across] / image[1], size[down] / image[0])
    margin = [max(image[0] - size[down] / scale, 0) / 2, max(image[1] - size[across] / scale, 0) / 2]
    axes = np.zeros((3, 3))
    axes[down, 1] = axes[across, 2] = 1
    pixel = homogeneous(axes) @ translation([0.0, -margin[0], -margin[1]]) @ scaling([zoom] * 3) @ translation([0.0, -offset[0], -offset[1]]) @ translation([0.0, 0.5, 0.5])
    place = np.full(3, -0.5)
    place[axis] = selected
    return translation(place) @ embedding.physical_to_voxel() @ scaling([scale] * 3) @ pixel


def slice_projection_rotated(volume: TensorMeta, embedding: Embedding, image: TensorMeta, angle: float) -> np.ndarray:
    """Pixels to voxels of a slice through the middle, turned around the middle axis."""
    size = np.array(volume.dims) * np.array(embedding.spacing)
    norm = scaling([2 / min(image.dims)] * 3) @ translation([0.0, -image.dims[0] / 2, -image.dims[1] / 2]) @ translation([0.0, 0.5, 0.5])
    c, s = math.cos(angle), math.sin(angle)
    turn = homogeneous([[c, 0, -s], [0, 1, 0], [s, 0, c]])
    return translation([-0.5] * 3) @ embedding.physical_to_voxel() @ translation(size / 2) @ scaling([min(size) / 2] * 3) @ turn @ norm


@dataclass(frozen=True)
class SliceState:
    """Which slice is shown, and where."""

    axis: int
    selected: int
    depth: int
    offset: tuple[float, float] = (0.0, 0.0)
    zoom: float = 1.0

    @classmethod
    def for_volume(cls, meta: TensorMeta, axis: int) -> SliceState:
        return cls(axis, meta.dims[axis] // 2, meta.dims[axis])

    def drag(self, delta) -> SliceState:
        return replace(self, offset=tuple(o + d for o, d in zip(self.offset, delta, strict=True)))

    def scroll(self, delta: int) -> SliceState:
        return replace(self, selected=max(0, min(self.depth - 1, self.selected + delta)))

    def zoomed(self, delta: float, on) -> SliceState:
        offset, zoom = zoomed(self.offset, self.zoom, delta, on)
        return replace(self, offset=offset, zoom=zoom)

    def projection(self, meta: TensorMeta, embedding: Embedding, image: tuple[int, int]) -> np.ndarray:
        return slice_projection(self.axis, meta, embedding, image, self.selected, self.offset, self.zoom)


@dataclass(frozen=True)
class ImageState:
    offset: tuple[float, float] = (0.0, 0.0)
    zoom: float = 1.0

    def drag(self, delta) -> ImageState:
        return replace(self, offset=tuple(o + d for o, d in zip(self.offset, delta, strict=True)))

    def zoomed(self, delta: float, on) -> ImageState:
        return ImageState(*zoomed(self.offset, self.zoom, delta, on))

    def projection(self, meta: TensorMeta, embedding: Embedding, image: tuple[int, int]) -> np.ndarray:
        size = np.array(meta.dims) * np.array(embedding.spacing)
        scale = max(size[0] / image[0], size[1] / image[1])
        margin = np.maximum(np.array(image) - size / scale, 0) / 2
        pixel = translation(-margin) @ scaling([self.zoom] * 2) @ translation([-o for o in self.offset]) @ translation([0.5, 0.5])
        return translation([-0.5, -0.5]) @ embedding.physical_to_voxel() @ scaling([scale] * 2) @ pixel


def position_of(matrix: np.ndarray, pixel) -> tuple[float, ...]:
    """The position under a pixel of a slice (two numbers) or of an image."""
    point = [0.0, *pixel] if len(matrix) == 4 else list(pixel)
    return tuple(transformed(matrix, point))


def element_under(matrix: np.ndarray, pixel, meta: TensorMeta) -> tuple[int, ...] | None:
    """The element under a pixel of a slice or of an image, halves to even; none outside the tensor."""
    at = np.round(position_of(matrix, pixel)).astype(int)
    return tuple(at.tolist()) if (at >= 0).all() and (at < np.array(meta.dims)).all() else None


def _pixels(meta: TensorMeta, matrix: np.ndarray, source: TensorMeta, spark) -> DataFrame:
    """Pixels with the element below them (``q0..``) and whether it exists."""
    coords = [F.col("p0").cast("double"), F.col("p1").cast("double")]
    at = affine(matrix, [F.lit(0.0), *coords] if len(matrix) == 4 else coords)
    cols = [rounded(c).cast("long").alias(f"q{i}") for i, c in enumerate(at)]
    return grid_frame(spark, meta.dims).select("p0", "p1", *cols)


def _scaled(lod: LodTensor, matrix: np.ndarray, k: int) -> np.ndarray:
    """A matrix to elements of the finest level, led on to level ``k``."""
    fine, own = lod.levels[0], lod.levels[k]
    return own.embedding.physical_to_voxel() @ fine.embedding.voxel_to_physical() @ matrix


def render_slice(lod: LodTensor, meta: TensorMeta, matrix: np.ndarray, tf: TransferFunction, table: LodTensor | None = None, coarse_factor: float = 1.0) -> Tensor:
    """The frame of a slice: each pixel's nearest element through the transfer function.

    ``matrix`` leads pixels ``(0, y, x)`` to elements of the finest level; the
    level that is read is the coarsest that still resolves pixels. Outside the
    volume lies a chequered pattern. With a table of constant chunks, elements
    of constant chunks are not read.
    """
    steps = [(0, 1, 0), (0, 0, 1)]
    k = select_level(lod, lod.levels[0].embedding.voxel_to_physical() @ matrix, steps, coarse_factor)
    level = lod.levels[k]
    volume = level.inner
    if table is not None:
        from .aggregate import with_table

        zone = table.levels[k]
        size = tuple(round(a / b) for a, b in zip(zone.embedding.spacing, level.embedding.spacing, strict=True))
        volume = with_table(volume, zone.inner, size)
    return _lookup(meta, _scaled(lod, matrix, k), volume, lambda v: tf.colour(v))


def view_image(lod: LodTensor, meta: TensorMeta, state: ImageState, coarse_factor: float = 1.0) -> Tensor:
    """The frame of an image of four bytes."""
    if lod.dtype != U8.vec(4):
        raise TensorError("images have four bytes")
    matrix = state.projection(lod.fine_metadata(), lod.fine_embedding_data(), meta.dims)
    k = select_level(lod, lod.levels[0].embedding.voxel_to_physical() @ matrix, [(1, 0), (0, 1)], coarse_factor)
    return _lookup(meta, _scaled(lod, matrix, k), lod.levels[k].inner, lambda v: v)


def _lookup(meta: TensorMeta, matrix: np.ndarray, source: Tensor, colour) -> Tensor:
    p, q = source.p, [f"q{i}" for i in range(source.nd)]
    pixels = _pixels(meta, matrix, source.shape(), source.df.sparkSession)
    found = source.df.select(*[F.col(a).alias(b) for a, b in zip(p, q, strict=True)], F.col("value"))
    inside = F.lit(True)
    for c, d in zip(q, source.shape().dims, strict=True):
        inside = inside & (F.col(c) >= 0) & (F.col(c) < d)
    grey = checkerboard()
    empty = F.when(inside, F.lit([0, 0, 0, 0]).cast("array<smallint>")).otherwise(F.array(grey, grey, grey, F.lit(255).cast("smallint")))
    frame = pixels.join(found, q, "left").select("p0", "p1", F.coalesce(colour(F.col("value")), empty).alias("value"))
    return Tensor(meta, U8.vec(4), frame)


# Rays


@dataclass(frozen=True)
class Trackball:
    """A camera that turns around ``center``; vectors are (z, y, x)."""

    eye: tuple[float, float, float]
    center: tuple[float, float, float]
    up: tuple[float, float, float]

    def pan_around(self, delta: tuple[int, int]) -> Trackball:
        """Turned about the centre, towards where a step of ``delta`` (down, right) pixels across the view leads; up stays at right angles to the view."""
        forward, right, up = self.basis()
        slope = PAN * (up * delta[0] + right * delta[1])
        aim = (forward + slope) / np.sqrt(1 + slope @ slope)
        # The up vector is turned by the rotation that takes forward to aim: it keeps to the plane of both.
        side = np.cross(self.up, aim)
        over = np.cross(aim, side / np.linalg.norm(side))
        return Trackball(tuple(np.asarray(self.center) - self.distance() * aim), self.center, tuple(over))

    def distance(self) -> float:
        return float(np.linalg.norm(np.subtract(self.center, self.eye)))

    def move_inout(self, delta: float) -> Trackball:
        """Nearer by a tenth of the distance for each unit of ``delta``."""
        centre = np.asarray(self.center, float)
        return replace(self, eye=tuple(centre + (np.asarray(self.eye) - centre) * (1 - MOVE * delta)))

    def basis(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward, right and up of unit length."""
        forward = np.subtract(self.center, self.eye)
        forward = forward / np.linalg.norm(forward)
        right = np.cross(self.up, forward)
        right = right / np.linalg.norm(right)
        return forward, right, np.cross(forward, right)

    def view_mat(self) -> np.ndarray:
        """World to camera: depth, down and right."""
        forward, right, up = self.basis()
        rotate = homogeneous(np.stack([forward, -up, right]))
        return rotate @ translation([-e for e in self.eye])


@dataclass(frozen=True)
class Camera:
    trackball: Trackball
    fov: float
    near: float
    far: float

    @classmethod
    def for_volume(cls, meta: TensorMeta, embedding: Embedding, fov: float = 30.0) -> Camera:
        size = np.array(meta.dims) * np.array(embedding.spacing)
        far = float(np.linalg.norm(size)) * 1.5
        return cls(Trackball((far, 0.0, 0.0), tuple(size / 2), (0.0, 1.0, 0.0)), fov, min(embedding.spacing), 20 * far)

    def rays(self, image: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Origin and a matrix from ``(1, y, x)`` of a pixel to its direction, of depth 1."""
        forward, right, up = self.trackball.basis()
        half = math.tan(math.radians(self.fov) / 2)
        wide = half * image[1] / image[0]
        m = np.zeros((3, 3))
        m[:, 0] = forward + up * half * (1 - 1 / image[0]) + right * wide * (1 / image[1] - 1)
        m[:, 1] = -up * 2 * half / image[0]
        m[:, 2] = right * 2 * wide / image[1]
        return np.asarray(self.trackball.eye, float), m


def entry_exit_points(meta: TensorMeta, embedding: Embedding, image: TensorMeta, camera: Camera) -> Tensor:
    """For each pixel where its ray enters and leaves the volume: ``(z, y, x, hit)`` twice, in parts of the volume.

    Slab intersection in closed form, on Arrow batches of pixels. A camera
    inside the volume enters at the near plane; no hit gives zeros.
    """
    size = np.array(meta.dims) * np.array(embedding.spacing)
    origin, m = camera.rays(image.dims)
    near, far = float(camera.near), float(camera.far)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y, x = b.column(0).to_numpy(), b.column(1).to_numpy()
            start = origin / size
            d = (np.stack([np.ones(y.size), y, x], 1) @ m.T) / size
            d = np.where(np.abs(d) < 1e-12, 1e-12, d)
            one, two = (0.0 - start) / d, (1.0 - start) / d
            first, last = np.maximum(near, np.minimum(one, two).max(1)), np.minimum(far, np.maximum(one, two).min(1))
            hit = (first < last)[:, None]
            ends = [np.hstack([start + t[:, None] * d, np.ones((y.size, 1))]) * hit for t in (first, last)]
            flat = pa.array(np.hstack(ends).astype(np.float32).ravel())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, 8), pa.int32()), flat)], names=["p0", "p1", "value"])

    frame = grid_frame(_session(), image.dims).mapInArrow(run, "p0 long, p1 long, value array<float>")
    return Tensor(image, F32.vec(8), frame)


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.active()


@dataclass(frozen=True)
class RaycasterConfig:
    lod_coarseness: float = 1.0
    preview_coarseness: float = 4.0
    oversampling: float = 1.0
    compositing: str = "mop"
    shading: str = "none"


#: Fixed values of the lighting: ambient, diffuse and specular parts, and shininess; and where a ray ends.
AMBIENT, DIFFUSE, SPECULAR, SHININESS = 0.2, 0.8, 0.5, 60.0
OPAQUE = 0.95
REFERENCE_STEPS = 256


def _cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[(i + 1) % 3] * b[(i + 2) % 3] - a[(i + 2) % 3] * b[(i + 1) % 3] for i in range(3)]


def _length(a: list[Column]) -> Column:
    return F.sqrt(sum((x * x for x in a), F.lit(0.0)))


def _rays(eep: Tensor, size: np.ndarray, neighbours: bool) -> DataFrame:
    """A row for each pixel whose ray meets the volume: start ``s``, way ``w`` through it and ``length``, in physical space.

    With ``neighbours`` also ``near`` and ``far``, the distances to the next
    pixel's ray at entry and exit (the previous one's at the border, the volume's
    size if there is none), and ``across``, the direction that they are measured in, for both axes of the image (0: down, 1: right).
    """
    v = F.col("value")
    ends = eep.df.select("p0", "p1", (v[3] > 0).alias("hit"), *[(v[j + i].cast("double") * float(size[i])).alias(f"{n}{i}") for n, j in (("s", 0), ("e", 4)) for i in range(3)])
    if neighbours:
        whole = F.struct(*[F.lit(0.0).alias(f"s{i}") for i in range(3)], *[F.lit(float(size[i])).alias(f"e{i}") for i in range(3)])
        own = F.when(F.col("hit"), F.struct(*[f"{n}{i}" for n in "se" for i in range(3)]))
        for axis in range(2):
            at = Window.partitionBy(f"p{1 - axis}").orderBy(f"p{axis}")
            ends = ends.withColumn(f"beside{axis}", F.coalesce(F.lead(own).over(at), F.lag(own).over(at), whole))
    ends = ends.where("hit").select("*", *[(F.col(f"e{i}") - F.col(f"s{i}")).alias(f"w{i}") for i in range(3)])
    ends = ends.withColumn("length", _length([F.col(f"w{i}") for i in range(3)])).where("length > 0")
    if not neighbours:
        return ends
    for axis in range(2):
        other = [F.col(f"beside{1 - axis}")[f"e{i}"] - F.col(f"e{i}") for i in range(3)]
        turned = _cross(other, [F.col(f"w{i}") for i in range(3)])
        unit = [F.coalesce(F.try_divide(x, _length(turned)), F.lit(0.0)) for x in turned]
        apart = lambda n, unit=unit, axis=axis: F.abs(sum((unit[i] * (F.col(f"beside{axis}")[f"{n}{i}"] - F.col(f"{n}{i}")) for i in range(3)), F.lit(0.0)))
        ends = ends.withColumns({f"near{axis}": apart("s"), f"far{axis}": apart("e"), f"across{axis}": F.array(*unit)})
    return ends.drop("beside0", "beside1")


def _levels_along(rays: DataFrame, spacings: list[np.ndarray], coarseness: float, oversampling: float) -> DataFrame:
    """The samples of each ray, ``(.., level, k, at, step)``: ``at`` is the way from its start.

    Pixels lie further apart the further a ray goes, in proportion, so where a
    ray turns to the next coarser level follows in closed form: as soon as the
    level's elements, seen across the ray, are closer together than
    ``coarseness`` pixels. Steps are as long as the level's elements along the ray, and go
    on from where the finer level's ended.
    """
    step = lambda sp: _length([F.col(f"w{i}") / F.col("length") * float(sp[i]) for i in range(3)]) / oversampling
    turn = F.lit(0.0)
    rays = rays.withColumn("begin0", F.lit(0.0)).withColumn("step0", step(spacings[0]))
    for k in range(1, len(spacings)):
        for axis in range(2):
            needed = _length([F.abs(F.col(f"across{axis}")[i]) * float(spacings[k][i]) for i in range(3)]) / coarseness
            slope = F.col(f"far{axis}") - F.col(f"near{axis}")
            from_ = F.when(F.col(f"near{axis}") > needed, F.lit(0.0)).when(F.col(f"far{axis}") <= needed, F.lit(2.0)).otherwise(F.coalesce(F.try_divide(needed - F.col(f"near{axis}"), slope), F.lit(2.0)))
            turn = F.greatest(turn, from_)
        # The first step of the finer level at or beyond the turn.
        before, stride = F.col(f"begin{k - 1}"), F.col(f"step{k - 1}")
        reach = before + F.greatest(F.lit(0.0), F.ceil((turn * F.col("length") - before) / stride)) * stride
        rays = rays.withColumns({f"begin{k}": F.when(turn > 1, F.lit(float("inf"))).otherwise(reach), f"step{k}": step(spacings[k])})
    parts = []
    for k in range(len(spacings)):
        end = F.least(F.col("length"), F.col(f"begin{k + 1}")) if k + 1 < len(spacings) else F.col("length")
        # Samples lie from begin on and before the next level's begin; the last may lie at the exit itself.
        count = F.floor((end - F.col(f"begin{k}")) / F.col(f"step{k}") + (1.0 if k + 1 == len(spacings) else 0.0))
        if k + 1 < len(spacings):
            count = F.when(F.col(f"begin{k + 1}") > F.col("length"), F.floor((F.col("length") - F.col(f"begin{k}")) / F.col(f"step{k}")) + 1).otherwise(F.round((F.col(f"begin{k + 1}") - F.col(f"begin{k}")) / F.col(f"step{k}")))
        parts.append(F.struct(F.lit(k).alias("level"), F.col(f"begin{k}").alias("begin"), F.col(f"step{k}").alias("step"), F.when(F.col(f"begin{k}") <= F.col("length"), F.greatest(F.lit(0), count)).otherwise(0).cast("int").alias("count")))
    rays = rays.withColumn("part", F.explode(F.filter(F.array(*parts), lambda x: x["count"] > 0)))
    rays = rays.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("part.count") - 1)))
    return rays.select("p0", "p1", *[f"{n}{i}" for n in "sw" for i in range(3)], "length", F.col("part.level").alias("level"), F.col("part.step").alias("step"), (F.col("part.begin") + F.col("k") * F.col("part.step")).alias("at"))


def _hits(samples: DataFrame, source: EmbeddedTensor, zone: EmbeddedTensor | None, gradients: bool) -> DataFrame:
    """Samples with the value ``v`` of their nearest element, and its gradient ``g0..``; those of elements that have none go."""
    meta, spacing = source.meta, np.array(source.embedding.spacing)
    q = [f"q{i}" for i in range(3)]
    place = [F.greatest(F.lit(0), F.least(F.lit(d - 1), rounded((F.col(f"s{i}") + F.col(f"w{i}") * F.col("at") / F.col("length")) / float(spacing[i]) - 0.5))).cast("long").alias(f"q{i}") for i, d in enumerate(meta.dims)]
    samples = samples.select("p0", "p1", "at", "step", "w0", "w1", "w2", "length", *place)
    known = None
    if zone is not None and not gradients:
        chunk = [round(a / b) for a, b in zip(zone.embedding.spacing, spacing, strict=True)]
        whole = zone.df.where("value IS NOT NULL").select(*[F.col(f"p{i}").alias(f"c{i}") for i in range(3)], F.col("value").cast("double").alias("v"))
        placed = samples.select("*", *[F.expr(f"q{i} div {c}").alias(f"c{i}") for i, c in enumerate(chunk)])
        cells = [f"c{i}" for i in range(3)]
        known, samples = placed.join(whole, cells).drop(*cells), placed.join(whole, cells, "left_anti").drop(*cells)
    voxels = source.df.select(*[F.col(f"p{i}").alias(f"q{i}") for i in range(3)], F.col("value").cast("double").alias("v"))
    if gradients:
        from .window import gradient

        for axis in range(3):
            g = gradient(source.inner, axis)
            voxels = voxels.join(g.df.select(*[F.col(f"p{i}").alias(f"q{i}") for i in range(3)], (F.col("value") / float(spacing[axis])).alias(f"g{axis}")), q)
    found = samples.join(voxels, q)
    return (found if known is None else found.unionByName(known)).drop(*q)


def raycast(lod: LodTensor, eep: Tensor, tf: TransferFunction, config: RaycasterConfig = RaycasterConfig(), table: LodTensor | None = None, level: int | None = None, preview: bool = False) -> Tensor:  # noqa: B008
    """The frame of rays through a volume, by maximum opacity (``mop``) or front to back (``dvr``).

    Each ray becomes its samples, a sample its nearest element; samples are
    joined to the volume by position and folded by ray in order. Only elements
    that a ray meets take part, through the join. Along each ray, the level is the
    coarsest whose elements are closer together than ``lod_coarseness`` pixels (``preview_coarseness`` for a
    preview), unless ``level`` names one. Samples in a chunk that ``table`` has a value for take it, and aren't joined to the volume.
    """
    if config.compositing not in ("mop", "dvr") or config.shading not in ("none", "phong"):
        raise TensorError("compositing is mop or dvr, shading none or phong")
    chosen = list(range(len(lod.levels))) if level is None else [level]
    spacings = [np.array(lod.levels[k].embedding.spacing) for k in chosen]
    size = np.array(lod.levels[0].meta.dims) * np.array(lod.levels[0].embedding.spacing)
    diagonal = float(np.linalg.norm(size))
    samples = _levels_along(_rays(eep, size, len(chosen) > 1), spacings, config.preview_coarseness if preview else config.lod_coarseness, config.oversampling)
    hits = reduce(DataFrame.unionByName, [_hits(samples.where(F.col("level") == i), lod.levels[k], table.levels[k] if table else None, config.shading == "phong") for i, k in enumerate(chosen)])
    colour = tf.colour(F.col("v"))
    if config.shading == "phong":
        norm = F.sqrt(sum((F.col(f"g{i}") ** 2 for i in range(3)), F.lit(1e-12)))
        facing = F.greatest(F.lit(0.0), sum((F.col(f"g{i}") / norm * F.col(f"w{i}") / F.col("length") for i in range(3)), F.lit(0.0)))
        hits = hits.withColumn("base", colour).withColumn("facing", facing)
        lit = lambda c: F.least(F.lit(255.0), c * (AMBIENT + DIFFUSE * F.col("facing")) + 255 * SPECULAR * F.pow(F.col("facing"), F.lit(SHININESS))).cast("smallint")
        colour = F.array(*[lit(F.col("base")[i]) for i in range(3)], F.col("base")[3])
    hits = hits.select("p0", "p1", "at", "step", colour.alias("c"))
    if config.compositing == "mop":
        # The largest alpha; of equal ones the sample nearest to the eye.
        best = hits.groupBy("p0", "p1").agg(F.max_by("c", F.struct(F.col("c")[3], -F.col("at"))).alias("c"))
        found = best.select("p0", "p1", "c")
    else:
        rays = hits.groupBy("p0", "p1").agg(F.array_sort(F.collect_list(F.struct("at", "step", "c"))).alias("samples"))
        begin = F.struct(*[F.lit(0.0).alias(n) for n in "rgba"])

        def blend(state: Column, s: Column) -> Column:
            a = 1 - F.pow(1 - s["c"][3] / 255.0, s["step"] / diagonal * REFERENCE_STEPS)
            part = a * (1 - state["a"])
            alpha = state["a"] + part
            new = F.struct(*[(state[n] + part * s["c"][i] / 255.0).alias(n) for i, n in enumerate("rgb")], F.when(alpha >= OPAQUE, 1.0).otherwise(alpha).alias("a"))
            return F.when(state["a"] >= 1.0, state).otherwise(new)

        done = F.aggregate("samples", begin, blend)
        found = rays.select("p0", "p1", done.alias("s")).select("p0", "p1", F.array(*[F.least(F.lit(255), F.floor(F.col("s")[n] * 255 + 0.5)).cast("smallint") for n in "rgba"]).alias("c"))
    frame = eep.df.select("p0", "p1").join(found, ["p0", "p1"], "left").select("p0", "p1", F.coalesce("c", F.lit([0, 0, 0, 0]).cast("array<smallint>")).alias("value"))
    return Tensor(eep.shape(), U8.vec(4), frame)


__all__ = ["Camera", "ImageState", "RaycasterConfig", "SliceState", "Trackball", "entry_exit_points", "raycast", "render_slice", "view_image"]
