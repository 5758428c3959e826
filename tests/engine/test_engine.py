"""Tensors against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import meta as M
from gridloom.operators import aggregate, kernels, render, resample, select, vesselness, weights, window
from gridloom.operators import randomwalker as rw
from gridloom.operators.transfer import TransferFunction, apply_tf
from gridloom.sources import files, memory
from gridloom.sinks import RunTime, element, read_lod, read_tensor, save_hdf5, save_lod, save_tensor, save_vvd, save_zarr, save_zarr_lod, write_png, zip_store
from gridloom.streaming import progressive
from gridloom.tensor import EmbeddedTensor, const_vec, dimensions, position

CHUNKINGS = [(5, 1, 1), (4, 4, 1), (2, 3, 4), (1, 1, 1), (5, 5, 5)]


@pytest.fixture(scope="module", autouse=True)
def session(spark):
    return spark


def linear(n: int, chunk=2):
    return memory.from_numpy(np.arange(n**3, dtype=np.float32).reshape(n, n, n), (chunk,) * 3)


def impulse(n: int):
    a = np.zeros((n, n, n), np.float32)
    a[n // 2, n // 2, n // 2] = 1
    return memory.from_numpy(a, (2, 2, 2))


def unit(t, n=None):
    return EmbeddedTensor(t, M.Embedding((1.0,) * (n or t.nd)))


def test_mean_min_max():
    t = linear(5)
    assert t.mean_value().value() == 62 and t.min_value().value() == 0 and t.max_value().value() == 124
    some = t.mean_value(num_samples=3, seed=1).value()
    assert some == t.mean_value(num_samples=3, seed=1).value() and 0 <= some <= 124
    assert t.mean_value().map(lambda v: v * 2).value() == 124


def test_chunk_aggregation():
    a = np.arange(343).reshape(7, 7, 7)
    got = linear(7).chunk_aggregation("min").numpy()
    assert (got == a[::2, ::2, ::2]).all() and got.shape == (4, 4, 4)
    ragged = linear(7).chunk_aggregation("mean").numpy()
    assert ragged[3, 3, 3] == 342 and ragged[0, 0, 0] == a[:2, :2, :2].mean()


@pytest.mark.parametrize("chunk", CHUNKINGS)
def test_slices_and_chunks(chunk):
    a = np.arange(125).reshape(5, 5, 5)
    t = linear(5).rechunk(chunk)
    assert t.shape().chunk == chunk
    parts = RunTime().resolve(t, list(range(t.shape().num_chunks)))
    whole = np.zeros((5, 5, 5))
    for k, p in enumerate(parts):
        i = t.shape().chunk_info(k)
        whole[tuple(slice(b, b + n) for b, n in zip(i.begin, i.logical, strict=True))] = p
    assert (whole == a).all()
    assert (select.sliced(t, ((2, 3), None, (1, 4))).numpy() == a[2:3, :, 1:4]).all()
    assert (select.chunked(t).numpy() == a).all()


def test_indexing():
    a = np.arange(125).reshape(5, 5, 5)
    t = linear(5)
    assert (t[2, :, 1:3].numpy() == a[2, :, 1:3]).all() and element(t, (1, 2, 3)) == a[1, 2, 3]
    e = EmbeddedTensor(t, M.Embedding((1.0, 2.0, 3.0)))[:, 1, :]
    assert e.embedding.spacing == (1.0, 3.0)
    for bad in [lambda: t[1], lambda: t[::2, :, :], lambda: t.slice((3, 3), None, None), lambda: t.squash(0), lambda: RunTime().resolve(t, [99])]:
        with pytest.raises(M.TensorError):
            bad()


def test_expressions():
    x, y, z = np.meshgrid(range(4), range(4), range(4), indexing="ij")
    a, b, c = (memory.from_numpy(v.astype(np.float32)) for v in (x * y * z, x + y + z, z > 2))
    ia, ib = a.cast("i32"), b.cast("i32")
    assert ((-ia + ib * ib).cast("f32").numpy() == -(x * y * z) + (x + y + z) ** 2).all()
    assert ((a - b).numpy() == x * y * z - (x + y + z)).all()
    assert ((c != 0.0).select(a, b).numpy() == np.where(z > 2, x * y * z, x + y + z)).all()
    both = c.concat(a)
    assert (both.index(0).numpy() == c.numpy()).all() and (both.index(1).numpy() == a.numpy()).all()
    shape = a.shape()
    assert (dimensions(shape).hmul().with_md(shape).numpy() == 64).all()
    assert (position(shape).hsum().numpy() == x + y + z).all()
    assert (a.cast("u8").cast("i8").numpy() == (x * y * z).astype(np.int8)).all()
    assert a.expr.sources and len((a + a * 2.0).expr.sources) == 1 and len((a + b).expr.sources) == 2
    assert ((a / 2.0).min(3.0).max(1.0).numpy() == np.clip(x * y * z / 2, 1, 3)).all()
    v = const_vec([1.0, 2.0, 3.0]).with_md(M.TensorMeta((2,)))
    assert (v.numpy() == [[1, 2, 3]] * 2).all() and (v.index_range(1, 3).hmax().numpy() == 3).all() and (v.hmin().splat(2).hsum().numpy() == 2).all()
    with_zero = memory.from_values((3,), [-7, 7, 0], "i32") / memory.from_values((3,), [2, 2, 0], "i32")
    assert [r.value for r in with_zero.df.orderBy("p0").collect()] == [-3, 3, None]
    for bad in [lambda: ia + b, lambda: ia + 1.0, lambda: a + linear(5), lambda: both < both, lambda: both.index(2), lambda: a.cast("u8").abs(), lambda: -a.cast("u8"), lambda: v.cast("f32"), lambda: both.splat(2), lambda: a.reinterpret("i32")]:
        with pytest.raises(M.TensorError):
            bad()
    bits = memory.from_values((2,), [1.0, -2.5]).reinterpret("u32")
    assert list(bits.numpy()) == list(np.array([1.0, -2.5], np.float32).view(np.uint32)) and list(bits.reinterpret("f32").numpy()) == [1.0, -2.5]


def test_logarithms_of_zero_and_less():
    for kind in ("f32", "f64"):
        t = memory.from_values((5,), [0.0, -0.0, -1.0, 1.0, np.inf], kind)
        want = [-np.inf, -np.inf, np.nan, 0.0, np.inf]
        assert np.array_equal([r.value for r in t.log().df.orderBy("p0").collect()], want, equal_nan=True)
        pair = t.concat(t).log()
        assert np.array_equal([r.value for r in pair.df.orderBy("p0").collect()], [[w, w] for w in want], equal_nan=True)
    assert [r.value for r in memory.from_values((2,), [0, 1], "i32").log().df.orderBy("p0").collect()] == [None, 0]


def test_fold_and_unfold():
    a = np.arange(24, dtype=np.float32).reshape(4, 6)
    t = memory.from_numpy(a, (2, 6)).fold_into_dtype()
    assert str(t.dtype) == "f32x6" and (t.numpy() == a).all() and (t.unfold_dtype().numpy() == a).all()
    with pytest.raises(M.TensorError):
        memory.from_numpy(a, (2, 3)).fold_into_dtype()


@pytest.mark.parametrize("axis", range(3))
@pytest.mark.parametrize("n,kernel", [(5, [1.0, -1.0, 2.0]), (13, [-1.0, -2.0, 0.0, 0.0, 0.0, 2.0, 1.0])])
def test_convolution_of_an_impulse(n, kernel, axis):
    want = np.zeros((n, n, n))
    at = [n // 2] * 3
    for k, v in enumerate(kernel):
        at[axis] = n // 2 + k - len(kernel) // 2
        want[tuple(at)] = v
    assert (window.convolution_1d(impulse(n), kernel, axis).numpy() == want).all()


def test_convolution_borders(monkeypatch):
    a = np.zeros((5, 5, 5), np.float32)
    a[0, 0, 0] = a[4, 4, 4] = 1
    t = memory.from_numpy(a, (2, 2, 2))
    for line in (4096, 2):  # whole lines, and blocks of a line
        monkeypatch.setattr(window, "LINE", line)
        got = window.convolution_1d(t, [7.0, 1.0, 3.0], 2, "repeat").numpy()
        assert (got[0, 0, 0], got[0, 0, 1], got[4, 4, 3], got[4, 4, 4], got.sum()) == (4, 3, 7, 8, 22)
        got = window.convolution_1d(t, [7.0, 1.0, 3.0], 2, "pad0").numpy()
        assert (got[0, 0, 0], got[0, 0, 1], got[4, 4, 3], got[4, 4, 4], got.sum()) == (1, 3, 7, 1, 12)
    near = impulse(5).separable_convolution([[2.0, 1.0, 2.0]] * 3).numpy()
    far = np.abs(np.indices((5, 5, 5)) - 2)
    assert (near == np.where(far.max(0) <= 1, 2.0 ** far.sum(0), 0)).all()
    for border in ("repeat", "pad0"):
        ks = [[1.0, 2.0, 4.0], [0.5, 1.0, 3.0, 1.0, 2.0], [1.0, -1.0, 2.0]]
        assert window.separable_in_chunks(linear(6), ks, border).numpy() == pytest.approx(linear(6).separable_convolution(ks, border).numpy(), rel=1e-5)
    with pytest.raises(M.TensorError):
        window.convolution_1d(t, [1.0, 2.0], 0)


@pytest.mark.parametrize("s", [0.5, 1.0, 2.3])
def test_kernels(s):
    g, d, dd = (np.array(f(s)) for f in (kernels.gauss, kernels.dgauss_dx, kernels.ddgauss_dxdx))
    assert len(g) == len(d) == len(dd) == 2 * int(3 * s + 0.5) + 1
    assert g.sum() == pytest.approx(1) and d.sum() == pytest.approx(0, abs=1e-9) and dd.sum() == pytest.approx(0, abs=1e-9)
    assert g == pytest.approx(g[::-1]) and d == pytest.approx(-d[::-1]) and dd == pytest.approx(dd[::-1])


def test_kernels_get_few_copies_and_bounded_tasks(spark, monkeypatch):
    a = np.random.default_rng(4).random((50, 6, 7))
    t, k = memory.from_numpy(a, (4, 4, 4)), kernels.gauss(1.0)
    want = a
    for axis in (2, 1, 0):
        want = window.along(want, np.array(k), axis)
    for n in (1 << 16, 300, 1):  # one box, some, the tensor's own chunks
        monkeypatch.setattr(window, "BOX", n)
        got = window.separable_in_chunks(t, [k] * 3)
        assert got.shape() == t.shape() and np.abs(got.numpy() - want).max() < 1e-12
    assert window.boxed(M.TensorMeta((10**5, 10, 10), (4, 4, 4)), (3, 3, 3)).chunk == (4, 4, 4)
    monkeypatch.setattr(window, "BOX", 1 << 16)
    assert window.boxed(M.TensorMeta((10**5, 10, 10), (4, 4, 4)), (3, 3, 3)).chunk == (512, 10, 10)
    monkeypatch.setattr(window, "ROWS", 100)
    assert window.map_overlap(t.df, t.shape(), 0, ["value"], lambda arrays, low, core: arrays[0][core], M.F64).df.rdd.getNumPartitions() == 21


def test_box_statistics_and_halo():
    a = np.random.default_rng(1).random((9, 8)).astype(np.float32)
    t = memory.from_numpy(a, (4, 3))
    pad = np.pad(a.astype(float), 1, constant_values=np.nan)
    want = np.nanmean([pad[1 + i : 10 + i, 1 + j : 9 + j] for i in (-1, 0, 1) for j in (-1, 0, 1)], 0)
    assert window.mean_filter(t, 1).numpy() == pytest.approx(want)
    assert (window.shrink(window.expand(t, 3), t.shape(), t.dtype).numpy() == a).all()
    blurred = window.map_overlap(t.df, t.shape(), 1, ["value"], lambda arrays, low, core: weights._box_mean(arrays[0], (1, 1))[core], M.F64)
    assert blurred.numpy() == pytest.approx(want)
    assert window.gradient(t, 1).numpy() == pytest.approx(np.gradient(a.astype(float), axis=1))


def test_lod_shapes():
    e, m = M.Embedding((1.0, 1.0, 2.0)), M.TensorMeta((10, 10, 10), (4, 4, 4))
    assert M.coarser(m, e, [2.0] * 3).dims == (5, 5, 10)
    assert M.coarser(m, e, ["f2"] * 3).dims == (5, 5, 5) and M.coarser(m, e, ["i", "f2", "i"]).dims == (10, 5, 10)
    lod = unit(linear(10, 4)).create_lod([2.0] * 3)
    assert [x.meta.dims for x in lod.levels] == [(10,) * 3, (5,) * 3, (3,) * 3] and lod.levels[2].df.count() == 27
    assert not M.can_reduce_further(lod.levels[-1].meta, [2.0] * 3)
    assert resample.select_level(lod, lod.levels[0].embedding.voxel_to_physical() @ M.scaling([1, 4, 4]), [(0, 1, 0), (0, 0, 1)]) >= 1


def test_resampling():
    t = memory.from_numpy(np.arange(8, dtype=np.float32), (4,))
    half = resample.resample(unit(t), M.TensorMeta((4,)))
    assert list(half.numpy()) == [1, 3, 5, 7] and half.embedding.spacing == (2.0,)
    assert list(resample.resample(half, M.TensorMeta((8,))).numpy()) == [1, 1, 3, 3, 5, 5, 7, 7]
    m = M.translation([-2.0])
    assert list(t.resample_transform(M.TensorMeta((4,)), m, "pad0").numpy()) == [0, 0, 0, 1] and list(t.resample_transform(M.TensorMeta((4,)), m).numpy()) == [0, 0, 0, 1]
    assert list(t.resample_transform(M.TensorMeta((3,)), M.translation([6.0])).numpy()) == [6, 7, 7]


def test_scaled_grids_are_read_without_a_join(spark):
    rng = np.random.default_rng(7)
    for source, target in (((7, 10), (13, 20)), ((13, 20), (7, 10)), ((9, 4), (9, 11)), ((5, 6), (1, 6)), ((1, 3), (4, 3))):
        a = rng.random(source)
        t, meta = memory.from_numpy(a), M.TensorMeta(target)
        for m in (resample.rescale_matrix(t.shape(), meta), M.scaling([(x - 1) / max(1, y - 1) or 0.25 for x, y in zip(source, target)])):
            at = [np.clip(np.floor(np.arange(n) * m[i + 1, i + 1] + m[i + 1, 0] + 0.5), 0, source[i] - 1).astype(int) for i, n in enumerate(target)]
            got = resample.resample_transform(t, meta, m)
            assert (got.numpy() == a[np.ix_(*at)]).all() and got.df.count() == target[0] * target[1]
            assert "Join" not in got.df._jdf.queryExecution().executedPlan().toString()


def test_levels_are_solved_without_joining_systems(monkeypatch):
    a = np.where(np.arange(40)[None, :] < 17, 0.1, 0.9) * np.ones((40, 40)) + np.random.default_rng(8).random((40, 40)) / 10
    lod = unit(memory.from_numpy(a, (8, 8))).create_lod([2.0] * 2)
    seen = []
    whole = rw.map_overlap
    monkeypatch.setattr(rw, "map_overlap", lambda frame, *rest: seen.append(frame._jdf.queryExecution().optimizedPlan().toString()) or whole(frame, *rest))
    w = weights.random_walker_weights_lod(lod, "grady", 1e-6, beta=100.0)
    out, _ = rw.hierarchical(w, lod, memory.points([(39, 39)]), memory.points([(0, 0)]))
    got = out.levels[0].numpy()
    assert len(seen) == len(lod.levels) and not any("Join" in s for s in seen)
    assert got.shape == (40, 40) and got[0, 0] == 0 and got[39, 39] == 1
    last = lod.levels[-1].inner
    dense = np.full((*last.shape().dims, 2), np.nan)
    for r in w[-1].df.collect():
        dense[r.p0, r.p1, r.p2] = r.value
    seed = np.full(last.shape().dims, np.nan)
    seed[0, 0], seed[-1, -1] = 0, 1
    assert np.abs(out.levels[-1].numpy() - rw.solve(dense, seed)).max() < 1e-9


def test_const_chunk_table():
    a = np.zeros((4, 4), np.float32)
    a[:2, :2] = 7
    a[2, 2] = 1
    table = aggregate.const_chunk_table(unit(memory.from_numpy(a, (2, 2))).single_level_lod(), (2, 2)).levels[0]
    rows = {(r.p0, r.p1): r.value for r in table.df.collect()}
    assert rows == {(0, 0): 7, (0, 1): 0, (1, 0): 0, (1, 1): None} and table.embedding.spacing == (2.0, 2.0)


def test_transfer_function():
    tf = TransferFunction.grey_ramp(1.0, 3.0)
    got = apply_tf(memory.from_values((5,), [0.0, 1.0, 2.0, 3.0, 9.0]), tf).numpy()
    assert [r[0] for r in got] == [0, 0, 128, 255, 255] and (got == got[:, :1]).all()


@pytest.mark.parametrize("volume,image", [((5, 3, 2), (5, 3)), ((6, 6, 6), (10, 20)), ((2, 10, 20), (6, 6))])
def test_slice_view(volume, image):
    x = np.indices(volume).sum(0).astype(np.float32) / 32
    t = unit(memory.from_numpy(x, tuple(max(1, d // 2) for d in volume)))
    m = M.TensorMeta(image)
    z = volume[0] - 1
    got = render.render_slice(t.single_level_lod(), m, render.slice_projection_fit(t.meta, m, z), TransferFunction.grey_ramp(0.0, 1.0)).numpy()
    at = [np.floor((np.arange(n) + 0.5) / n * v - 0.5 + 0.5) for n, v in zip(image, volume[1:], strict=True)]
    want = np.minimum(np.floor((at[0][:, None] + at[1][None, :] + z) / 32 * 256), 255)
    assert (got == want[..., None]).all()


def phantom(n, split):
    a = np.where(np.arange(n)[None, None, :] < split, 0.1, 0.9) * np.ones((n, n, n))
    return memory.from_numpy(a, (n,) * 3)


def seeds(n, shape):
    return rw.rasterize_seed_points(memory.points([(n - 1,) * 3]), memory.points([(0,) * 3]), shape, M.Embedding((1.0,) * 3)).inner


@pytest.mark.parametrize("n", [5, 8])
def test_random_walker(n):
    t = phantom(n, 2)
    got = rw.random_walker(t, seeds(n, t.shape()), "grady", 1e-5, beta=100.0).numpy()
    want = np.where(np.arange(n) < 2, 0, 1) * np.ones((n, n, n))
    assert np.abs(got - want).max() < 1e-3


def test_flat_systems_are_shared_and_end_where_seeds_do_not_reach(monkeypatch):
    rng = np.random.default_rng(5)
    for shape in ((60, 7), (4, 9, 3)):
        a = rng.random(shape)
        t = memory.from_numpy(a)
        w = weights.grady(t, 5.0)
        far = tuple(n - 1 for n in shape)
        marks = [far, tuple(n // 2 for n in shape)]
        sd = rw.rasterize_seed_points(memory.points(marks), memory.points([(0,) * len(shape)]), t.shape(), M.Embedding((1.0,) * len(shape))).inner
        dense = np.full((*shape, len(shape)), np.nan)
        for r in w.df.collect():
            dense[tuple(r[:-1])] = r.value
        for config in (rw.SolverConfig(1e-9), rw.SolverConfig(1e-9, 4, 6)):
            want = rw.solve(dense, sd.numpy(), config)
            found = []
            for slab, share in ((1 << 16, 1 << 20), (8, 24), (8, 1 << 20)):  # one task; four at once; one task of many slabs
                monkeypatch.setattr(rw, "SLAB", slab)
                monkeypatch.setattr(rw, "SHARE", share)
                found.append(rw.random_walker_single_chunk(w, sd, config).numpy())
                assert np.abs(found[-1] - want).max() < 1e-6
            assert (found[1] == found[2]).all()  # whatever the number of tasks
    none = sd.replaced(sd.df.withColumn("value", F.lit(None).cast("double")))
    assert (rw.random_walker_single_chunk(w, none).numpy() == 0.5).all()


def test_flat_systems_leave_far_slabs_out(monkeypatch):
    monkeypatch.setattr(rw, "SLAB", 16)
    t = memory.from_numpy(np.random.default_rng(6).random((400, 4)))
    sd = rw.rasterize_seed_points(memory.points([(399, 3)]), memory.points([(0, 0)]), t.shape(), M.Embedding((1.0, 1.0))).inner
    sizes = []
    whole = rw.staged
    monkeypatch.setattr(rw, "staged", lambda df, label: sizes.append((label, (s := whole(df, label)).count())) or s)
    got = rw.random_walker_single_chunk(weights.grady(t, 5.0), sd, rw.SolverConfig(1e-9, 4, 10)).numpy()
    assert dict(sizes)["solved"] == 2 * 12 * 4 and got.shape == (400, 4) and (got[12:-12] == 0.5).all()


def test_statistical_weights():
    t = phantom(7, 3)
    for name in ("bhattacharyya_var_gaussian", "ttest"):
        w = weights.random_walker_weights(t, name, 1e-5, extent=1)
        got = rw.random_walker_single_chunk(w, seeds(7, t.shape())).numpy()
        want = np.where(np.arange(7) < 3, 0, 1) * np.ones((7, 7, 7))
        assert np.abs(got - want).max() < 2e-2, name
    bian = weights.bian(t, 1)
    assert bian.df.count() == 3 * 7 * 7 * 6


def test_hierarchical_random_walker():
    a = np.where(np.arange(10)[None, None, :] < 5, 0.1, 0.9) * np.ones((10, 10, 10))
    lod = unit(memory.from_numpy(a, (4, 4, 4))).create_lod([2.0] * 3)
    w = weights.random_walker_weights_lod(lod, "grady", 1e-6, beta=1000.0)
    out, tables = rw.hierarchical(w, lod, memory.points([(9, 9, 9)]), memory.points([(0, 0, 0)]))
    got = out.levels[0].numpy()
    assert np.abs(got - np.where(np.arange(10) < 5, 0, 1)).max() < 0.6 and len(tables.levels) == len(out.levels)


def test_seed_conflicts_and_system():
    s = rw.rasterize_seed_points(memory.points([(1.2, 0.9)]), memory.points([(0.8, 1.1), (5.0, -3.0)]), M.TensorMeta((3, 3)), M.Embedding((1.0, 1.0)))
    got = {(r.p0, r.p1): r.value for r in s.df.where("value IS NOT NULL").collect()}
    assert got == {(1, 1): 1.0, (2, 0): 0.0}
    t = memory.from_numpy(np.random.default_rng(2).random((4, 4)))
    w = weights.grady(t, 5.0)
    sd = rw.rasterize_seed_points(memory.points([(3, 3)]), memory.points([(0, 0)]), M.TensorMeta((4, 4)), M.Embedding((1.0, 1.0))).inner
    a, b = rw.laplacian(w, sd)
    m, v = np.zeros((16, 16)), np.zeros(16)
    for r in a.collect():
        m[r.row, r.col] += r.value
    for r in b.collect():
        v[r.row] = r.b
    free = [i for i in range(16) if i not in (0, 15)]
    x = np.linalg.solve(m[np.ix_(free, free)], v[free])
    got = rw.random_walker_single_chunk(w, sd, rw.SolverConfig(1e-8)).numpy().ravel()
    assert got[free] == pytest.approx(x, abs=1e-6) and got[0] == 0 and got[15] == 1


def test_vesselness_of_a_line():
    a = np.zeros((12, 12, 12), np.float32)
    a[:, 6, 6] = 1
    v = vesselness.vesselness(unit(memory.from_numpy(a, (6, 6, 6))), 1.0).numpy()
    assert v[6, 6, 6] > 0.05 and abs(v[6, 1, 1]) < 1e-3


def test_rays_through_a_constant_volume():
    t = unit(memory.from_numpy(np.full((4, 4, 4), 0.5, np.float32)))
    frame = M.TensorMeta((9, 9))
    eep = render.entry_exit_points(t.meta, t.embedding, frame, render.Camera.for_volume(t.meta, t.embedding))
    hit = eep.numpy()[..., 3]
    assert hit[4, 4] == 1 and hit[0, 0] == 0
    for mode, alpha in (("mop", 128), ("dvr", 255)):
        got = render.raycast(t.single_level_lod(), eep, TransferFunction.grey_ramp(0.0, 1.0), render.RaycasterConfig(compositing=mode)).numpy()
        assert got[4, 4, 3] == alpha and (got[0, 0] == 0).all()
    inside = render.Camera(render.Trackball((2.0, 2.0, 2.0), (0.0, 2.0, 2.0), (0.0, 1.0, 0.0)), 30.0, 0.1, 100.0)
    assert render.entry_exit_points(t.meta, t.embedding, frame, inside).numpy()[4, 4, 3] == 1


def test_procedural():
    lod = memory.ball(M.TensorMeta((8, 8, 8), (4, 4, 4)), M.Embedding((1.0,) * 3))
    assert [x.meta.dims for x in lod.levels] == [(8,) * 3, (4,) * 3] and lod.levels[0].numpy()[4, 4, 4] == 1
    assert (memory.rasterize(M.TensorMeta((3, 4)), "v0 * 10 + v1").numpy() == np.arange(3)[:, None] * 10 + np.arange(4)).all()
    assert (memory.normalized((4,), (2,), lambda x: x).numpy() == np.arange(4) / 4).all()
    with pytest.raises(M.TensorError):
        memory.from_values((2, 2), [1.0])


def test_files(tmp_path):
    a = np.random.default_rng(3).random((5, 6, 7)).astype(np.float32)
    t = EmbeddedTensor(memory.from_numpy(a, (2, 3, 4)), M.Embedding((1.0, 0.5, 2.0)))
    save_zarr(t, str(tmp_path / "v.zarr"))
    z = files.open_tensor(str(tmp_path / "v.zarr"))
    assert (z.numpy() == a).all() and z.embedding == t.embedding and z.meta.chunk == (2, 3, 4)
    zip_store(str(tmp_path / "v.zarr"), str(tmp_path / "v.zarr.zip"))
    assert (files.open_tensor(str(tmp_path / "v.zarr.zip")).numpy() == a).all()
    save_zarr_lod(t, str(tmp_path / "l.zarr"), (2.0,) * 3)
    lod, origin = files.open_or_create_lod(str(tmp_path / "l.zarr"))
    assert origin == "existing" and len(lod.levels) >= 2 and (files.open_tensor(str(tmp_path / "l.zarr")).numpy() == a).all()
    made, origin = files.open_or_create_lod(str(tmp_path / "v.zarr"), files.Hints(chunk_size=(3, 3, 3), rechunk=True))
    assert origin == "dynamic" and made.levels[0].meta.chunk == (3, 3, 3)
    save_vvd(t, str(tmp_path / "v.vvd"))
    v = files.open_tensor(str(tmp_path / "v.vvd"))
    assert (v.numpy() == a).all() and v.embedding == t.embedding
    bytes8 = EmbeddedTensor(memory.from_numpy((a * 255).astype(np.uint8)), t.embedding)
    save_vvd(bytes8, str(tmp_path / "b.vvd"))
    assert files.open_tensor(str(tmp_path / "b.vvd")).numpy() == pytest.approx((a * 255).astype(np.uint8).astype(np.float32), abs=1e-3)
    save_tensor(t, str(tmp_path / "v.parquet"))
    assert (read_tensor(str(tmp_path / "v.parquet")).numpy() == a).all()
    saved = save_lod(t, str(tmp_path / "l.parquet"), (2.0,) * 3)
    assert [x.meta for x in read_lod(str(tmp_path / "l.parquet")).levels] == [x.meta for x in saved.levels]
    head = bytearray(352)
    head[0:4], head[344:348] = (348).to_bytes(4, "little"), b"n+1\0"
    head[40:48] = np.array([3, 7, 6, 5], "<i2").tobytes()
    head[70:72], head[123] = (16).to_bytes(2, "little"), 2
    head[76:92], head[108:112] = np.array([1, 2.0, 0.5, 1.0], "<f4").tobytes(), np.array([352], "<f4").tobytes()
    (tmp_path / "v.nii").write_bytes(bytes(head) + a.tobytes())
    n = files.open_tensor(str(tmp_path / "v.nii"))
    assert (n.numpy() == a).all() and n.embedding == t.embedding
    image = memory.from_numpy((np.random.default_rng(4).random((6, 5, 4)) * 255).astype(np.uint8), dtype="u8x4")
    write_png(image, str(tmp_path / "i.png"))
    assert (files.open_tensor(str(tmp_path / "i.png")).numpy() == image.numpy()).all()
    for bad in ("x.tiff", "x.mp4", "x.h5", "missing.zarr"):
        with pytest.raises(M.TensorError):
            files.open_tensor(str(tmp_path / bad))


def test_convert(tmp_path):
    from gridloom import convert

    convert.convert("ball", str(tmp_path / "ball.zarr"), chunk=(4, 4, 4), dims=(8, 8, 8), lod=("2", "2", "2"))
    assert len(files.open_lod(str(tmp_path / "ball.zarr")).levels) == 2
    convert.convert(str(tmp_path / "ball.zarr"), str(tmp_path / "ball.vvd"), dtype="f32")
    assert files.open_tensor(str(tmp_path / "ball.vvd")).meta.dims == (8, 8, 8)


def test_matrices():
    m = M.translation([1, 2]) @ M.scaling([2, 3])
    assert tuple(M.transformed(m, (1, 1))) == (3, 5)
    meta = M.TensorMeta((10, 20), (3, 5))
    assert np.allclose(meta.norm_to_voxel() @ meta.voxel_to_norm(), np.eye(3)) and tuple(M.transformed(meta.norm_to_voxel(), (0.5, 0.5))) == (4.5, 9.5)
    assert M.AABB((0, 0), (1, 1)).transform(m) == M.AABB((1, 2), (3, 5)) and meta.grid == (4, 4) and meta.chunk_info(15).logical == (1, 5)
    points = memory.from_values((2,), [0.0, 0.0, 1.0, 1.0], "f32x2")
    from gridloom.operators.geometry import transform

    assert (transform(points, m).numpy() == [[1, 2], [3, 5]]).all()


def test_streaming_windows(spark, tmp_path):
    from gridloom.streaming.progressive import Version, event_windows, progressive

    rows = spark.sql("SELECT timestamp_seconds(id * 60) AS ts, cast(id AS double) AS value FROM range(100)")
    rows.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "events"))
    q = event_windows(stream, "10 minutes", late="1 minute").writeStream.format("memory").queryName("windows").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("windows").count() == 10 == event_windows(rows, "10 minutes").count()
    lod = unit(linear(8, 4)).create_lod([2.0] * 3)
    found = [(v.level, f.first()[0]) for v, f in progressive(lod, lambda t: t.df.agg(F.count("*")))]
    assert found == [(1, 64), (0, 512)] and Version.combined(Version(0), Version(2)) == Version(2) and Version(2) < Version(0)


def test_splitter_and_state():
    s = select.Splitter((4, 10), 0.3)
    assert s.metadata_first().dims == (4, 3) and s.metadata_last().dims == (4, 7)
    a, b = memory.from_numpy(np.ones((4, 3), np.float32)), memory.from_numpy(np.zeros((4, 7), np.float32))
    assert s.render(a, b).numpy().sum() == 12
    state = render.SliceState.for_volume(M.TensorMeta((9, 9, 9)), 0)
    assert state.selected == 4 and state.scroll(9).selected == 8 and state.drag((1, 2)).offset == (1, 2)
    moved = state.zoomed(3.0, (5.0, 5.0))
    before, after = (x.projection(M.TensorMeta((9, 9, 9)), M.Embedding((1.0,) * 3), (10, 10)) for x in (state, moved))
    assert np.allclose(render.position_of(before, (4.5, 4.5)), render.position_of(after, (4.5, 4.5)))


def test_only_the_chunks_of_a_box_are_read(spark, tmp_path):
    a = np.arange(8 * 8 * 8, dtype=np.float32).reshape(8, 8, 8)
    path = str(tmp_path / "z.zarr")
    save_zarr(memory.from_numpy(a, chunk=(2, 2, 2)).embedded(M.Embedding((1.0,) * 3)), path)
    for k in range(64):
        i, j, m = k // 16, k // 4 % 4, k % 4
        if (i, j, m) not in {(0, 0, 0), (1, 2, 3)}:
            with open(f"{path}/array/c/{i}/{j}/{m}", "wb") as f:
                f.write(b"no chunk")
    t = files.open_zarr(path).inner
    run = RunTime()
    assert (run.resolve(t, [0])[0] == a[:2, :2, :2]).all() and (run.resolve((t + 1.0) * 2.0, [(1, 2, 3)])[0] == (a[2:4, 4:6, 6:] + 1) * 2).all()
    far = run.resolve(t, [(1, 2, 3), 0])
    assert (far[0] == a[2:4, 4:6, 6:]).all() and (far[1] == a[:2, :2, :2]).all()
    assert element(t, (3, 5, 7)) == a[3, 5, 7]
    assert {r.value for r in t[2:4, 4:6, 6:][1:, :, 1].df.collect()} == set(a[3, 4:6, 7].tolist())
    with pytest.raises(Exception, match="zstd|Zstd|ZSTD"):
        t.df.count()
    both = (t[:2, :2, :2] + t.slice((2, 4), (4, 6), (6, 8))).df
    assert {r.value for r in both.collect()} == set((a[:2, :2, :2] + a[2:4, 4:6, 6:]).ravel().tolist())


def test_boxes_become_key_ranges(spark, tmp_path):
    rows = spark.range(600).select(F.col("id").alias("k"), (F.col("id") * 2.0).alias("v"))
    rows.repartitionByRange(6, "k").sortWithinPartitions("k").write.parquet(str(tmp_path / "t"))
    t = memory.from_table(spark.read.parquet(str(tmp_path / "t")), "v", ["k div 60", "(k div 10) % 6", "k % 10"], M.TensorMeta((10, 6, 10), (4, 4, 4)), key="k")
    box = ((t * 3.0).slice((2, 5), (1, 4), None)).slice((1, 2), None, (3, 5))
    assert "GreaterThanOrEqual(k,193), LessThanOrEqual(k,214)" in box.df._jdf.queryExecution().toString()
    assert sorted(r.value for r in box.df.collect()) == [6.0 * (180 + y * 10 + x) for y in (1, 2, 3) for x in (3, 4)]


def test_fractals_by_their_definition():
    def escape(x, y):
        cx, cy = (x - 0.8) * 5, (y - 0.5) * 5
        vx, vy, i = cx, cy, 0
        while i < 50 and (vx * vx + vy * vy) ** 0.5 <= 5:
            vx, vy, i = vx * vx - vy * vy + cx, 2 * vx * vy + cy, i + 1
        return max(i - 2, 0) / 48

    y, x = np.meshgrid(np.arange(20) / 20, np.arange(30) / 30, indexing="ij")
    got = memory._mandelbrot(y.ravel(), x.ravel())
    assert got.tolist() == [escape(b, a) for a, b in zip(y.ravel().tolist(), x.ravel().tolist(), strict=True)] and len(set(got.tolist())) > 4
    bulb = memory._mandelbulb(np.array([0.5, 0.0, 0.5]), np.array([0.5, 0.0, 0.4]), np.array([0.5, 0.0, 0.55]))
    assert bulb[0] == 1.0 and bulb[1] < 1.0 and 0 <= bulb.min()


def test_camera_moves():
    start = render.Trackball((6.0, 2.0, 3.0), (1.0, 2.0, 3.0), (0.0, 1.0, 0.0))
    nearer = start.move_inout(2.0)
    assert np.allclose(nearer.eye, (5.0, 2.0, 3.0)) and np.allclose(start.move_inout(-1.0).eye, (6.5, 2.0, 3.0))
    turned = start.pan_around((30, -40))
    assert turned.distance() == pytest.approx(5.0)
    look = np.subtract(turned.center, turned.eye)
    assert np.dot(look, turned.up) == pytest.approx(0.0, abs=1e-9) and np.linalg.norm(turned.up) == pytest.approx(1.0)
    forward, right, up = start.basis()
    aim = look / 5
    assert np.allclose([aim @ up / (aim @ forward), aim @ right / (aim @ forward)], [30 * 0.005, -40 * 0.005])


def test_element_under_a_pixel():
    meta = M.TensorMeta((10, 20))
    assert render.element_under(np.eye(3), (3.4, 7.6), meta) == (3, 8) and render.element_under(np.eye(3), (2.5, 3.5), meta) == (2, 4)
    assert render.element_under(np.eye(3), (-0.6, 3), meta) is None and render.element_under(np.eye(3), (3, 19.6), meta) is None


def test_region_weights_element_by_element():
    """Against boxes gathered one by one."""
    r = np.random.default_rng(9)
    a = np.round(r.random((9, 11)), 1)
    dims, e = a.shape, 1
    offsets = weights.centre_offsets(a, (0, 0), dims, (e, e))
    for measure in (weights.bhattacharyya, weights.ttest):
        got = weights.region_weights(a, (0, 0), dims, (e, e), (slice(0, 9), slice(0, 11)), 1e-5, measure)
        for p in np.ndindex(dims):
            for axis in range(2):
                q = tuple(x + (i == axis) for i, x in enumerate(p))
                if q[axis] >= dims[axis]:
                    assert np.isnan(got[(*p, axis)])
                    continue
                centres = [np.array(x) + (0 if 127 in offsets[x] else offsets[x]) for x in (p, q)]
                boxes = [{(y, x) for y in range(max(0, c[0] - e), min(dims[0], c[0] + e + 1)) for x in range(max(0, c[1] - e), min(dims[1], c[1] + e + 1))} for c in centres]
                both = boxes[0] & boxes[1]
                middle = np.mean([min(both), max(both)], axis=0) if both else None
                own = []
                for k, box in enumerate(boxes):
                    mine = box - both
                    for x in both:
                        side = np.dot(np.array(x) - middle, centres[1] - centres[0]) or (np.array(x) - middle)[axis]
                        if side and (side < 0) == (k == 0):
                            mine = mine | {x}
                    own.append(np.array([a[x] for x in sorted(mine)]))
                s = [(v.mean(), v.var(ddof=1) if v.size > 1 else 0.0, v.size) if v.size else (0.0, 0.0, 1) for v in own]
                want = max(float(measure(*(np.array([v], float) for v in (*s[0], *s[1])))[0]), 1e-5)
                assert got[(*p, axis)] == pytest.approx(want, rel=1e-9)


def test_rays_choose_their_level():
    r = np.random.default_rng(4)
    a = r.random((24, 8, 8)).astype(np.float32)
    a[:8] = 0.01
    t = unit(memory.from_numpy(a, (4, 4, 4)))
    lod = t.create_lod((2.0,) * 3)
    frame = M.TensorMeta((6, 6))
    camera = render.Camera(render.Trackball((-30.0, 4.0, 4.0), (12.0, 4.0, 4.0), (0.0, 1.0, 0.0)), 10.0, 0.1, 500.0)
    eep = render.entry_exit_points(t.meta, t.embedding, frame, camera)
    tf = TransferFunction.grey_ramp(0.0, 1.0)
    image = lambda **args: {(x.p0, x.p1): tuple(x.value) for x in render.raycast(lod, eep, tf, render.RaycasterConfig(compositing=args.pop("mode", "mop"), **{k: args.pop(k) for k in list(args) if k.endswith("coarseness")}), **args).df.collect()}
    assert len(lod.levels) >= 3
    assert image(lod_coarseness=1e-6) == image(level=0) != image(level=1)
    coarsest = len(lod.levels) - 1
    assert image(lod_coarseness=1e9) == image(level=coarsest)
    assert image(lod_coarseness=1e-6, preview_coarseness=1e9, preview=True) == image(level=coarsest)
    table = aggregate.const_chunk_table(lod, (4, 4, 4))
    for mode in ("mop", "dvr"):
        assert image(mode=mode, table=table) == image(mode=mode) and image(mode=mode, level=0, table=table) == image(mode=mode, level=0)
    # Against the rule, step by step: the level of each sample of every ray.
    size, spacings = np.array(t.meta.dims, float), [np.array(x.embedding.spacing) for x in lod.levels]
    rays = render._rays(eep, size, True)
    for coarseness in (0.5, 1.5, 3.0):
        got = {}
        for x in render._levels_along(rays, spacings, coarseness, 1.0).collect():
            got.setdefault((x.p0, x.p1), []).append((x["at"], x.level))
        turned = 0
        for x in rays.collect():
            way, at, level, want = np.array([x.w0, x.w1, x.w2]), 0.0, 0, []
            while at <= x.length + 1e-9:
                share = at / x.length
                while level + 1 < len(spacings) and all(np.linalg.norm(np.abs(x[f"across{i}"]) * spacings[level + 1]) < (x[f"near{i}"] * (1 - share) + x[f"far{i}"] * share) * coarseness for i in (0, 1)):
                    level += 1
                want.append((at, level))
                at += np.linalg.norm(np.abs(way / x.length) * spacings[level])
            turned += len({v for _, v in want}) > 1
            mine = sorted(got[x.p0, x.p1])
            assert [v for _, v in mine][: len(want)] == [v for _, v in want][: len(mine)] and abs(len(mine) - len(want)) <= 1
            assert np.allclose([v for v, _ in mine][: len(want)], [v for v, _ in want][: len(mine)])
        assert turned or coarseness < 1


def test_numpy_functions_and_frames(tmp_path):
    a = np.arange(24, dtype=np.float32).reshape(4, 6)
    t = memory.from_numpy(a, (2, 3)).map_numpy(lambda v: np.sqrt(v) + 1)
    assert np.allclose([r.value for r in t.df.orderBy("p0", "p1").collect()], (np.sqrt(a) + 1).ravel()) and t[1:3, 2].df.count() == 2
    pairs = memory.from_numpy(np.stack([a, -a], -1), (2, 3), "f32x2").map_numpy(lambda v: v[:, 0] * v[:, 1], "f64")
    assert {r.value for r in pairs.df.collect()} == set((-a * a).ravel().tolist())
    folder = tmp_path / "film.frames"
    folder.mkdir()
    r = np.random.default_rng(2)
    film = r.integers(0, 256, (5, 4, 3, 3), np.uint8)
    for k in range(5):
        raw = files.encode_png(np.concatenate([film[k], np.full((4, 3, 1), 255, np.uint8)], -1))
        (folder / f"{k:03}.png").write_bytes(b"not read" if k == 1 else raw)
    video = files.open_tensor(str(folder)).inner
    assert video.shape().dims == (5, 4, 3) and video.dtype.size == 3
    got = {(r.p0, r.p1): list(r.value) for r in video[3, :, :].df.collect()}
    assert all(got[y, x] == film[3, y, x].tolist() for y in range(4) for x in range(3))


def test_zarr_levels_are_recreated(tmp_path):
    t = unit(memory.from_numpy(np.arange(64, dtype=np.float32).reshape(8, 8), (4, 4)))
    other = t.create_lod((2.0, 2.0)).map(lambda x: x.map_inner(lambda y: y * 0.0) if x.meta.dims != (8, 8) else x)
    save_zarr_lod(other, str(tmp_path / "a.zarr"))
    save_zarr_lod(other, str(tmp_path / "b.zarr"), (2.0, 2.0), recreate=True)
    a, b = (files.open_zarr_lod(str(tmp_path / n)) for n in ("a.zarr", "b.zarr"))
    assert [x.meta.dims for x in a.levels] == [x.meta.dims for x in b.levels] == [(8, 8), (4, 4)]
    assert a.levels[1].inner.max_value().value() == 0 and b.levels[1].inner.max_value().value() > 40


def test_dense_tables(tmp_path):
    r = np.random.default_rng(8)
    a = r.random((9, 7, 5)).astype(np.float32)
    t = unit(memory.from_numpy(a, (4, 3, 2)))
    save_tensor(t, str(tmp_path / "a"), dense=True)
    back = read_tensor(str(tmp_path / "a"))
    assert back.meta == t.meta and sorted(map(tuple, back.df.collect())) == sorted(map(tuple, t.df.collect()))
    box = back.inner[2:4, 5, 1:]
    assert sorted(x.value for x in box.df.collect()) == sorted(a[2:4, 5, 1:].ravel().tolist())
    plan = box.df._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(c0), IsNotNull(c1)" in plan and "LessThanOrEqual(c0,0)" in plan
    lod = save_lod(t, str(tmp_path / "b"), (2.0,) * 3, dense=True)
    plain = save_lod(t, str(tmp_path / "c"), (2.0,) * 3)
    assert len(lod.levels) == len(plain.levels) > 1
    for x, y in zip(lod.levels, plain.levels, strict=True):
        assert sorted(map(tuple, x.df.collect())) == sorted(map(tuple, y.df.collect()))
    pairs = memory.from_numpy(r.integers(0, 9, (6, 4, 3)), (4, 4), "u8x3")
    save_tensor(EmbeddedTensor(pairs, M.Embedding((1.0, 1.0))), str(tmp_path / "d"), dense=True)
    rows = lambda f: sorted((*x[:2], list(x.value)) for x in f.df.collect())
    assert rows(read_tensor(str(tmp_path / "d"))) == rows(pairs)


def test_hdf5(tmp_path):
    r = np.random.default_rng(6)
    for kind, chunk in (("f32", (4, 3, 2)), ("u8", (5, 9, 5)), ("i16", (1, 1, 1)), ("f64", (9, 2, 5)), ("i64", (2, 2, 2))):
        a = (r.random((9, 7, 5)) * 200 - (0 if kind[0] == "u" else 90)).astype(M.DType(kind).numpy)
        path = str(tmp_path / f"{kind}.h5")
        save_hdf5(EmbeddedTensor(memory.from_numpy(a, chunk, kind), M.Embedding((0.5, 1.0, 2.0))), path, compression=0 if kind == "u8" else 3)
        back = files.open_tensor(path)
        assert (back.numpy() == a).all() and back.dtype == M.DType(kind) and np.allclose(back.embedding.spacing, (0.5, 1.0, 2.0))
        assert {x.value for x in back.inner[3, 2:4, 4].df.collect()} == set(a[3, 2:4, 4].tolist())
    # 315 chunks need a tree of two levels.
    t = unit(memory.from_numpy(np.arange(512, dtype=np.float32).reshape(8, 8, 8), (4, 4, 4)))
    lod = t.create_lod((2.0,) * 3)
    save_hdf5(lod, str(tmp_path / "lod.h5"))
    again, how = files.open_or_create_lod(str(tmp_path / "lod.h5"))
    assert how == "existing" and [x.meta.dims for x in again.levels] == [x.meta.dims for x in lod.levels]
    assert (again.levels[1].numpy() == lod.levels[1].numpy()).all()
    with pytest.raises(M.TensorError, match="no dataset"):
        files.open_hdf5(path, "/other")


def test_hdf5_by_hand(tmp_path):
    """A file laid out byte by byte in the newer form: superblock 2, headers with links, a contiguous big-endian dataset."""
    import struct

    from gridloom.sources import hdf5

    a = np.arange(24).reshape(4, 6).astype(">i2")
    message = lambda kind, body: struct.pack("<BHB", kind, len(body), 0) + body
    header = lambda *m: b"OHDR" + struct.pack("<BBB", 2, 0, sum(map(len, m))) + b"".join(m) + bytes(4)
    place = 400
    kind = struct.pack("<BBBBIHH", 0x10, 0b1001, 0, 0, 2, 0, 16)
    size = np.array([2000.0, 500.0], "<f8")
    attribute = struct.pack("<BBHHHB", 3, 0, 16, 20, 12, 0) + b"element_size_um\0" + struct.pack("<BBBBIHHBBBBI", 0x11, 0x20, 63, 0, 8, 0, 64, 52, 11, 0, 52, 1023) + struct.pack("<BBBBQ", 2, 1, 0, 1, 2) + size.tobytes()
    dataset = header(message(hdf5.DATASPACE, struct.pack("<BBBBQQ", 2, 2, 0, 1, 4, 6)), message(hdf5.DATATYPE, kind), message(hdf5.LAYOUT, struct.pack("<BBQQ", 3, 1, place, a.nbytes)), message(hdf5.ATTRIBUTE, attribute))
    link = struct.pack("<BBB", 1, 0, 4) + b"data" + struct.pack("<Q", 120)
    root = header(message(hdf5.LINK, link))
    head = hdf5.SIGNATURE + struct.pack("<BBBBQQQQI", 2, 8, 8, 0, 0, hdf5.NOWHERE, 600, 48, 0)
    raw = head.ljust(48, b"\0") + root.ljust(72, b"\0") + dataset
    (tmp_path / "new.h5").write_bytes(raw.ljust(place, b"\0") + a.tobytes())
    t = files.open_tensor(str(tmp_path / "new.h5"))
    assert (t.numpy() == a).all() and str(t.dtype) == "i16" and t.embedding.spacing == (2.0, 0.5)
    assert [x.value for x in t.inner[2, 1:3].df.collect()] == [13, 14]


def test_files_by_uri(tmp_path):
    a = np.random.default_rng(1).random((6, 5, 4)).astype(np.float32)
    t = unit(memory.from_numpy(a, (3, 2, 4)))
    uri = f"file://{tmp_path}"
    save_zarr(t, f"{uri}/z.zarr")
    save_hdf5(t, f"{tmp_path}/h.h5")
    save_vvd(t, f"{tmp_path}/v.vvd")
    zip_store(f"{tmp_path}/z.zarr", f"{tmp_path}/z.zarr.zip")
    for name in ("z.zarr", "z.zarr.zip", "h.h5", "v.vvd"):
        found = files.open_tensor(f"{uri}/{name}")
        assert (found.numpy() == a).all(), name
        assert sorted(x.value for x in found.inner[2:5, 3, 1:3].df.collect()) == sorted(a[2:5, 3, 1:3].ravel().tolist()), name
    for shape, chunk in (((50,), (7,)), ((6, 5), (4, 2)), ((3, 4, 5, 2), (2, 3, 2, 1))):
        b = np.arange(np.prod(shape), dtype=np.int32).reshape(shape)
        (tmp_path / "raw").write_bytes(b"skip" + b.tobytes())
        assert (files.open_raw(f"{uri}/raw", M.TensorMeta(shape, chunk), "i32", 4).numpy() == b).all()
    with pytest.raises((M.TensorError, OSError)):
        files.open_tensor(f"{uri}/none.zarr")


def test_batches_until_a_deadline():
    t = memory.from_numpy(np.arange(64, dtype=np.float32), (1,))
    now = [0.0]
    query = lambda rows: rows.agg(F.sum("value").alias("s"))

    def run(cost, seconds, **args):
        got = []
        for chunks, rows in progressive.in_batches(t, lambda rows: (now.__setitem__(0, now[0] + cost), query(rows))[1], seconds, clock=lambda: now[0], **args):
            assert rows[0].s == sum(chunks)
            got.append(len(chunks))
        return got

    assert run(0.01, 100) == [1, 4, 16, 43]
    assert run(6, 10, first=8) == [8, 4]
    assert run(50, 10) == [1]
    assert run(0.01, 100, chunks=[3, 9]) == [1, 1]


def test_frames_keep_their_best_results(spark):
    t = unit(memory.from_numpy(np.arange(64, dtype=np.float32).reshape(8, 8), (4, 4)))
    lod = t.create_lod((2.0, 2.0))
    assert len(lod.levels) == 2
    cache = progressive.FrameCache(keep=2)
    level, frame = lambda v: v[0].level, spark.range(1)
    assert cache.put("a", progressive.Version(1), frame) and cache.put("b", progressive.Version(0), frame) and not cache.put("b", progressive.Version(1), frame)
    cache.next_frame()
    assert level(cache.get("a")) == 1  # used: young again
    cache.next_frame()
    assert cache.get("a") is not None
    cache.next_frame()
    cache.next_frame()
    assert cache.get("a") is None and level(cache.get("b")) == 0
    mean = lambda x: x.df.agg(F.avg("value").alias("m"))
    assert level(cache.refined("m", lod, mean, seconds=0)) == 1 and level(cache.refined("m", lod, mean, seconds=0)) == 0
    version, found = cache.refined("m", lod, mean)
    assert version.final and found.first().m == 31.5
