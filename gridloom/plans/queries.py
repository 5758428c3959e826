"""Queries over the fixture tables, one for each operator, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..meta import Embedding, FixedStep, Full, SynchronizedStep, TensorMeta, scaling, translation
from ..operators import aggregate, geometry, kernels, render, resample, select, vesselness, weights, window
from ..operators import randomwalker as rw
from ..operators.transfer import TransferFunction, alpha_blending, apply_tf, fit_range, pad_channels
from ..sources import memory
from ..streaming.progressive import event_sessions, event_windows, progressive
from ..tensor import EmbeddedTensor, LodTensor, Tensor, const, dimensions, position
from .tables import embeddings, events, orders, part, table, unit, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def out(t: Tensor | EmbeddedTensor, *names: str, digits: int | None = 6) -> DataFrame:
    """Rows with named positions (default x; y, x; z, y, x) and rounded values."""
    inner = t.inner if isinstance(t, EmbeddedTensor) else t
    names = names or ("z", "y", "x")[3 - inner.nd :]
    value = F.col("value").cast("double") if inner.dtype.size == 1 else F.col("value")
    if digits is not None and inner.dtype.size == 1:
        value = F.round(value, digits)
    return inner.df.select(*[F.col(p).alias(n) for p, n in zip(inner.p, names, strict=True)], value.alias("value"))


EV3 = "WITH t AS (SELECT event_id // 100 AS z, (event_id // 10) % 10 AS y, event_id % 10 AS x, value AS v FROM events) "
EV2 = "WITH t AS (SELECT event_id // 100 AS y, event_id % 100 AS x, value AS v FROM events) "
UNIT = "WITH t AS (SELECT event_id // 100 AS y, event_id % 100 AS x, value * (1 / 500.0::DOUBLE) AS v FROM events) "


# Element-wise


@query("SELECT event_id AS x, round((value * 2 + 1) - value / 4, 6) AS value FROM events")
def pw_arith(s, d):
    t = events(s, d, 1)
    return out((t * 2.0 + 1.0) - t / 4.0)


@query("SELECT event_id AS x, round(sqrt(exp(abs(-value) / 100)) + ln(value) + (value / 100) * (value / 100), 6) AS value FROM events")
def pw_unary(s, d):
    t = events(s, d, 1)
    return out(((-t).abs() / 100.0).exp().sqrt() + t.log() + (t / 100.0).square())


@query("SELECT event_id AS x, ((value < 50 OR value >= 200) AND value <> 10)::INT::DOUBLE AS value FROM events")
def pw_compare(s, d):
    t = events(s, d, 1)
    return out(((t < 50.0) | (t >= 200.0)) & (t != 10.0))


@query("SELECT event_id AS x, round(CASE WHEN value > 100 THEN value - 100 ELSE value * 3 END, 6) AS value FROM events")
def pw_select(s, d):
    t = events(s, d, 1)
    return out((t > 100.0).select(t - 100.0, t * 3.0))


@query("SELECT event_id AS x, (trunc(value * 3)::BIGINT % 256)::DOUBLE AS value FROM events")
def pw_cast(s, d):
    return out((events(s, d, 1) * 3.0).cast("i32").cast("u8"))


@query("SELECT event_id AS x, round(greatest(least(value, 120), 30), 6) AS value FROM events")
def pw_minmax(s, d):
    return out(events(s, d, 1).min(120.0).max(30.0))


@query("SELECT event_id AS x, round(value * 0.5 + 7, 6) AS value FROM events")
def pw_linear_rescale(s, d):
    return out(events(s, d, 1).linear_rescale(0.5, 7.0))


@query("SELECT event_id AS x, round(sin(value) * 2, 6) AS value FROM events")
def pw_map(s, d):
    return out(events(s, d, 1).map(lambda c: F.sin(c) * 2))


@query("SELECT event_id AS x, value::FLOAT::DOUBLE AS value FROM events")
def pw_reinterpret(s, d):
    return out(events(s, d, 1).cast("f32").reinterpret("u32").reinterpret("f32"), digits=None)


@query("SELECT p_partkey AS x, round(p_retailprice - o_totalprice, 6) AS value FROM part JOIN orders ON p_partkey = o_orderkey")
def pw_two_inputs(s, d):
    a = part(s, d)
    b = orders(s, d).slice((0, a.shape().dims[0]), chunk=a.shape().chunk)
    return out(a - b)


@query("SELECT event_id AS x, round(value * (SELECT avg(value) FROM events), 6) AS value FROM events")
def pw_scalar_operand(s, d):
    t = events(s, d, 1)
    return out(t.mean_value().over(t, lambda v, m: v * m))


@query("SELECT round(avg(value) * 2, 6) AS value FROM events")
def scalar_map(s, d):
    return events(s, d, 1).mean_value().map(lambda v: F.round(v * 2, 6)).df


@query("SELECT vec_id AS x, round(embedding[6]::DOUBLE, 6) AS value FROM embeddings")
def vec_index(s, d):
    return out(vectors(s, d).index(5))


@query("SELECT vec_id AS x, round(list_sum(list_transform(embedding[4:9], lambda e: e::DOUBLE)), 6) AS value FROM embeddings")
def vec_index_range(s, d):
    return out(vectors(s, d).index_range(3, 9).hsum())


@query("SELECT vec_id AS x, len(embedding[1:3]) + 2.0::DOUBLE AS n, round(list_sum(list_transform(list_concat(embedding[1:3], embedding[63:64]), lambda e: e::DOUBLE)), 6) AS value FROM embeddings")
def vec_concat(s, d):
    t = vectors(s, d)
    both = t.index_range(0, 3).concat(t.index_range(62, 64))
    return out(both.hsum()).select("x", F.lit(float(both.dtype.size)).alias("n"), "value")


def _fold(name: str):
    def f(s, d):
        # Zero is added, as a product may round to a negative zero.
        return out(getattr(vectors(s, d).index_range(0, 8), name)()).withColumn("value", F.col("value") + 0.0)

    f.__name__ = f"vec_{name}"
    return f


for _name, _sql in (("hsum", "list_sum"), ("hmul", "list_product"), ("hmin", "list_min"), ("hmax", "list_max")):
    query(f"SELECT vec_id AS x, round({_sql}(list_transform(embedding[1:8], lambda e: e::DOUBLE)), 6) + 0.0::DOUBLE AS value FROM embeddings")(_fold(_name))


@query("SELECT event_id AS x, round(value * 3, 6) AS value FROM events")
def vec_splat(s, d):
    return out(events(s, d, 1).splat(3).hsum())


@query("SELECT vec_id AS y, (i - 1)::BIGINT AS x, round(embedding[i]::DOUBLE, 6) AS value FROM embeddings, range(1, 65) r(i)")
def unfold_dtype(s, d):
    return out(vectors(s, d).unfold_dtype())


@query("SELECT event_id // 100 AS x, round(list_sum(list(value ORDER BY event_id)), 4) AS value FROM events GROUP BY 1")
def fold_dtype(s, d):
    return out(events(s, d, 2).rechunk((32, Full)).fold_into_dtype().hsum(), digits=4)


@query(EV3 + "SELECT z, y, x, (z * 10000 + y * 100 + x)::DOUBLE AS value FROM t")
def position_of(s, d):
    p = position(events(s, d, 3).shape())
    k = p.index(0).cast("i64") * const(10000, "i64") + p.index(1).cast("i64") * const(100, "i64") + p.index(2).cast("i64")
    return out(k)


@query("SELECT x, ((SELECT count(*) FROM events) // 100 * 100)::DOUBLE AS value FROM range(3) r(x)")
def dimensions_of(s, d):
    shape = events(s, d, 3).shape()
    return out(dimensions(shape).hmul().with_md(TensorMeta((3,))))


@query("SELECT vec_id AS x, round((embedding[1]::DOUBLE * 2 + embedding[3]::DOUBLE * 0.5 + 1)::FLOAT::DOUBLE, 5) AS value FROM embeddings")
def transform_points(s, d):
    m = translation([1.0, 0.0, 0.0]) @ scaling([1.0, 1.0, 1.0])
    m[1, 1], m[1, 3] = 2.0, 0.5
    return out(geometry.transform(embeddings(s, d).index_range(0, 3), m).index(0), digits=5)


@query("SELECT event_id AS x, round(len([value, 9, 9, 9]) + value, 6) AS value FROM events")
def pad_dtype_channels(s, d):
    t = events(s, d, 1)
    padded = pad_channels(t, 4, 9.0)
    return out(padded.index(0) + float(padded.dtype.size))


@query("SELECT event_id AS x, round(sin(value / 100) * 2, 6) AS value FROM events")
def map_numpy(s, d):
    return out(events(s, d, 1).map_numpy(lambda v: np.sin(v / 100) * 2))


# Selection


@query(EV3 + "SELECT z - 2 AS z, y - 1 AS y, x, round(v, 6) AS value FROM t WHERE z BETWEEN 2 AND 7 AND y BETWEEN 1 AND 4")
def slice_box(s, d):
    return out(events(s, d, 3).slice((2, 8), (1, 5), None))


@query(EV3 + "SELECT z, x - 3 AS x, round(v, 6) AS value FROM t WHERE y = 4 AND x >= 3")
def slice_squash(s, d):
    return out(events(s, d, 3)[:, 4, 3:], "z", "x")


@query(EV3 + "SELECT round(v, 6) AS value FROM t WHERE z = 3 AND y = 2 AND x = 1")
def point_lookup(s, d):
    return out(select.point(events(s, d, 3), (3, 2, 1)))


@query(EV3 + "SELECT y, x, round(v, 6) AS value FROM t WHERE z = (SELECT max(z) + 1 FROM t) // 2")
def slice_time(s, d):
    t = EmbeddedTensor(events(s, d, 3), Embedding((1.0, 1.0, 1.0)))
    return out(select.slice_time(t.single_level_lod(), 0.5).levels[0])


@query(EV3 + "SELECT (z // 2) * 12 + (y // 3) * 3 + x // 4 AS chunk, count(*) AS n, round(sum(v), 4) AS total FROM t GROUP BY 1")
def rechunk(s, d):
    t = select.chunked(events(s, d, 3).rechunk((2, 3, 4)))
    return t.df.groupBy(select.chunk_index(t.shape()).alias("chunk")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(EV2 + "SELECT " + " + ".join(f"((((y // 32) >> {b}) & 1) << {2 * b + 1}) + ((((x // 32) >> {b}) & 1) << {2 * b})" for b in range(12)) + " AS z_order, count(*) AS n FROM t GROUP BY 1")
def z_order_chunks(s, d):
    t = events(s, d, 2)
    return t.df.groupBy(select.z_order(t.shape()).alias("z_order")).agg(F.count("*").alias("n"))


@query(EV3 + "SELECT (z // 4) * 9 + (y // 4) * 3 + x // 4 AS chunk, count(*) AS n, round(sum(v), 4) AS total FROM t WHERE (z // 4) * 9 + (y // 4) * 3 + x // 4 IN (0, 4, 8) GROUP BY 1")
def resolve_chunks(s, d):
    t = events(s, d, 3)
    k = select.chunk_index(t.shape())
    return select.chunk_rows(t, (0, 4, 8)).groupBy(k.alias("chunk")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(EV2 + "SELECT y, x, round(v, 6) AS value FROM t WHERE x < 50 UNION ALL SELECT y, x, round(v * 2, 6) FROM t WHERE x >= 50")
def splitter_union(s, d):
    t = events(s, d, 2)
    return out(select.union_along(t.slice(None, (0, 50)), t.slice(None, (50, 100)) * 2.0, 1))


@query(EV3 + "SELECT z // 4 AS z, y // 4 AS y, x // 4 AS x, max(z * 65536 + y * 256 + x)::DOUBLE AS value FROM t GROUP BY ALL")
def distribute(s, d):
    t = events(s, d, 3).distribute(4)
    p = F.col("p0") * 65536 + F.col("p1") * 256 + F.col("p2")
    return out(t.replaced(t.df.select(*t.p, p.cast("double").alias("value"))).chunk_aggregation("max"))


# Aggregates


@query("SELECT round(avg(value), 6) AS value FROM events")
def agg_mean(s, d):
    return events(s, d, 1).mean_value().map(lambda v: F.round(v, 6)).df


@query("SELECT min(value) AS value FROM events")
def agg_min(s, d):
    return events(s, d, 1).min_value().df


@query("SELECT max(value) AS value FROM events")
def agg_max(s, d):
    return events(s, d, 1).max_value().df


@query(EV3 + ", c AS (SELECT *, (z // 4) * 9 + (y // 4) * 3 + x // 4 AS chunk FROM t), drawn AS (SELECT chunk FROM (SELECT DISTINCT chunk FROM c) ORDER BY md5('3:' || chunk), chunk LIMIT 10) SELECT round(avg(v), 6) AS value FROM c WHERE chunk IN (FROM drawn)")
def agg_mean_sampled(s, d):
    return events(s, d, 3).mean_value(num_samples=10, seed=3).df.select(F.round("value", 6).alias("value"))


def _chunk_agg(method: str):
    def f(s, d):
        return out(events(s, d, 3).chunk_aggregation(method), digits=9)

    f.__name__ = f"chunk_agg_{method}"
    return f


for _name in ("mean", "min", "max"):
    query(EV3 + f"SELECT z // 4 AS z, y // 4 AS y, x // 4 AS x, round({'avg' if _name == 'mean' else _name}(v), 9) AS value FROM t GROUP BY ALL")(_chunk_agg(_name))


@query(EV3 + "SELECT z // 2 AS z, y // 2 AS y, x // 2 AS x, CASE WHEN max(v) - min(v) <= 100 THEN round(avg(v), 6) END AS value FROM t GROUP BY ALL")
def const_chunk_table(s, d):
    t = EmbeddedTensor(events(s, d, 3), Embedding((1.0, 1.0, 1.0)))
    return out(aggregate.const_chunk_table(t.single_level_lod(), (2, 2, 2), 100.0).levels[0])


@query(UNIT + "SELECT y // 2 AS y, x // 2 AS x, CASE WHEN max(v) <= 0.4 OR min(v) >= 0.6 OR max(v) - min(v) < 0.01 THEN round(avg(v), 6) END AS value FROM t GROUP BY ALL")
def determined_chunk_table(s, d):
    t = EmbeddedTensor(unit(s, d), Embedding((1.0, 1.0)))
    return out(aggregate.determined_chunk_table(t, (2, 2), 0.1))


@query(EV3 + ", c AS (SELECT z // 2 AS a, y // 2 AS b, x // 2 AS c, CASE WHEN max(v) - min(v) <= 100 THEN avg(v) END AS m FROM t GROUP BY ALL) SELECT z, y, x, round(coalesce(m, v), 6) AS value FROM t JOIN c ON z // 2 = a AND y // 2 = b AND x // 2 = c.c")
def const_chunk_lookup(s, d):
    t = EmbeddedTensor(events(s, d, 3), Embedding((1.0, 1.0, 1.0)))
    zone = aggregate.const_chunk_table(t.single_level_lod(), (2, 2, 2), 100.0).levels[0].inner
    return out(aggregate.with_table(t.inner, zone, (2, 2, 2)))


@query(EV3 + "SELECT z // 2 AS z, y // 2 AS y, x // 2 AS x FROM t GROUP BY ALL HAVING max(v) - min(v) > 100")
def undecided_chunks(s, d):
    t = EmbeddedTensor(events(s, d, 3), Embedding((1.0, 1.0, 1.0)))
    zone = aggregate.const_chunk_table(t.single_level_lod(), (2, 2, 2), 100.0).levels[0].inner
    return aggregate.undecided_chunks(zone).toDF("z", "y", "x")


# Neighbourhoods


def conv_sql(kernel, axis: str, others: str, border: str, source: str = "v") -> str:
    e = len(kernel) // 2
    w = f"OVER (PARTITION BY {others} ORDER BY {axis})"
    full = f"OVER (PARTITION BY {others} ORDER BY {axis} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    terms = []
    for o in range(-e, e + 1):
        read = source if not o else f"{'lead' if o > 0 else 'lag'}({source}, {abs(o)}) {w}"
        outside = "0" if border == "pad0" else f"{'last' if o > 0 else 'first'}_value({source}) {full}"
        terms.append(f"({kernel[e - o]!r})::DOUBLE * " + (f"coalesce({read}, {outside})" if o else read))
    return " + ".join(terms)


K3, K7 = [1.0, -1.0, 2.0], [-1.0, -2.0, 0.5, 0.0, 0.25, 2.0, 1.0]
AXES = ("z", "y", "x")


def _conv(axis: int, border: str, kernel):
    def f(s, d):
        return out(window.convolution_1d(events(s, d, 3), kernel, axis, border))

    f.__name__ = f"conv1d_{border}_{AXES[axis]}"
    return f


for _axis, _border, _kernel in ((0, "repeat", K3), (1, "repeat", K7), (2, "repeat", K3), (2, "pad0", K7)):
    query(EV3 + f"SELECT z, y, x, round({conv_sql(_kernel, AXES[_axis], ', '.join(a for a in AXES if a != AXES[_axis]), _border)}, 6) AS value FROM t")(_conv(_axis, _border, _kernel))


def separable_sql(ks) -> str:
    return (
        EV3 + f", a AS (SELECT z, y, x, {conv_sql(ks[2], 'x', 'z, y', 'repeat')} AS v FROM t), b AS (SELECT z, y, x, {conv_sql(ks[1], 'y', 'z, x', 'repeat')} AS v FROM a) SELECT z, y, x, round({conv_sql(ks[0], 'z', 'y, x', 'repeat')}, 6) AS value FROM b"
    )


@query(separable_sql([[2.0, 1.0, 2.0]] * 3))
def conv_separable(s, d):
    return out(events(s, d, 3).separable_convolution([[2.0, 1.0, 2.0]] * 3))


@query(separable_sql([kernels.gauss(1.0)] * 3))
def gauss_smooth(s, d):
    return out(events(s, d, 3).separable_convolution([kernels.gauss(1.0)] * 3))


@query(separable_sql([kernels.gauss(1.0)] * 3))
def gauss_smooth_chunks(s, d):
    return out(window.separable_in_chunks(events(s, d, 3), [kernels.gauss(1.0)] * 3))


@query(EV3 + f"SELECT z, y, x, round({conv_sql(kernels.dgauss_dx(1.0), 'x', 'z, y', 'repeat')}, 6) AS value FROM t")
def gauss_derivative(s, d):
    return out(window.convolution_1d(events(s, d, 3), kernels.dgauss_dx(1.0), 2))


@query(f"SELECT event_id AS x, round({conv_sql(K7, 'event_id', '1', 'repeat', 'value')}, 6) AS value FROM events")
def conv1d_long_line(s, d):
    """A tensor of one line, cut into overlapping blocks."""
    return out(window.convolution_1d(events(s, d, 1), K7, 0))


BOX = "FROM t a JOIN t b ON b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY ALL"


@query(EV2 + f"SELECT a.y, a.x, round(avg(b.v), 6) AS value {BOX}")
def box_mean(s, d):
    return out(window.mean_filter(events(s, d, 2), 1))


@query(EV2 + f", m AS (SELECT a.y, a.x, avg(b.v) AS m {BOX}), e AS (SELECT y, x, (v - m) * (v - m) AS v FROM t JOIN m USING (y, x)) SELECT a.y, a.x, round(sum(b.v) / (count(*) - 1), 8) AS value FROM e a JOIN e b ON b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY ALL")
def box_variance(s, d):
    t = events(s, d, 2)
    return out(window.variances(t, window.mean_filter(t, 1).compile(), 1), digits=8)


@query(EV2 + "SELECT y, x, round((coalesce(lead(v) OVER w, v) - coalesce(lag(v) OVER w, v)) / (CASE WHEN x IN (0, 99) THEN 1 ELSE 2 END), 6) AS value FROM t WINDOW w AS (PARTITION BY y ORDER BY x)")
def gradient_central(s, d):
    return out(window.gradient(events(s, d, 2), 1))


@query(EV2 + "SELECT y, x, round(v, 6) AS value FROM t")
def expand_shrink(s, d):
    t = events(s, d, 2)
    return out(window.shrink(window.expand(t, 7), t.shape(), t.dtype))


@query(EV2 + "SELECT y, x, 0::BIGINT AS axis, round(v, 6) AS a, round(lead(v) OVER (PARTITION BY x ORDER BY y), 6) AS b FROM t QUALIFY lead(y) OVER (PARTITION BY x ORDER BY y) IS NOT NULL UNION ALL SELECT y, x, 1, round(v, 6), round(lead(v) OVER (PARTITION BY y ORDER BY x), 6) FROM t QUALIFY lead(x) OVER (PARTITION BY y ORDER BY x) IS NOT NULL")
def weight_pairs(s, d):
    return window.weight_pairs(events(s, d, 2)).df.select(F.col("p0").alias("y"), F.col("p1").alias("x"), F.col("p2").alias("axis"), F.round(F.col("value")[0], 6).alias("a"), F.round(F.col("value")[1], 6).alias("b"))


# Resampling


@query(EV2 + ", n AS (SELECT max(y) + 1 AS n FROM t) SELECT o.y, q.x, round(v, 6) AS value FROM n, range(n // 2) o(y), range(50) q(x) JOIN t ON t.y = floor((o.y + 0.5) * (n / (n // 2)) - 0.5 + 0.5) AND t.x = floor((q.x + 0.5) * 2 - 0.5 + 0.5)")
def resample_nearest(s, d):
    t = EmbeddedTensor(events(s, d, 2), Embedding((1.0, 1.0)))
    n = t.meta.dims[0]
    return out(resample.resample(t, TensorMeta((n // 2, 50))))


@query(EV2 + "SELECT o.y, q.x, round(coalesce(v, 0), 6) AS value FROM range(20) o(y) CROSS JOIN range(20) q(x) LEFT JOIN t ON t.y = floor(o.y * 1.5 - 4 + 0.5) AND t.x = floor(q.x * 1.5 - 4 + 0.5)")
def resample_transform_pad0(s, d):
    return out(events(s, d, 2).resample_transform(TensorMeta((20, 20)), translation([-4.0, -4.0]) @ scaling([1.5, 1.5]), "pad0"))


@query(EV2 + "SELECT o.y, q.x, round(v, 6) AS value FROM range(20) o(y) CROSS JOIN range(20) q(x) JOIN t ON t.y = greatest(0, floor(o.y * 0.25 - 2 + 0.5)) AND t.x = greatest(0, floor(q.x * 0.25 - 2 + 0.5))")
def resample_transform_repeat(s, d):
    return out(events(s, d, 2).resample_transform(TensorMeta((20, 20)), translation([-2.0, -2.0]) @ scaling([0.25, 0.25]), "repeat"))


def _down_sql(kernel) -> str:
    return EV2 + f", a AS (SELECT y, x, {conv_sql(kernel, 'x', 'y', 'repeat')} AS v FROM t), b AS (SELECT y, x, {conv_sql(kernel, 'y', 'x', 'repeat')} AS v FROM a) "


@query(_down_sql(kernels.gauss(1.0)) + "SELECT y // 2 AS y, x // 2 AS x, round(v, 6) AS value FROM b WHERE y % 2 = 1 AND x % 2 = 1")
def smooth_downsample(s, d):
    t = EmbeddedTensor(events(s, d, 2), Embedding((1.0, 1.0)))
    return out(resample.smooth_downsample(t, TensorMeta((t.meta.dims[0] // 2, 50))))


@query("WITH RECURSIVE l(level, n, w, sy, sx) AS (SELECT 0, (SELECT count(*) // 100 FROM events), 100::BIGINT, 1.0::DOUBLE, 1.0::DOUBLE UNION ALL SELECT level + 1, CASE WHEN n > 32 THEN ((n + 1) // 2) ELSE n END, CASE WHEN w > 32 THEN ((w + 1) // 2) ELSE w END, 1, 1 FROM l WHERE n > 32 OR w > 32) SELECT level::BIGINT AS level, n * w AS n FROM l")
def lod_pyramid(s, d):
    t = EmbeddedTensor(events(s, d, 2), Embedding((1.0, 1.0)))
    lod = resample.create_lod(t, (FixedStep(2.0), FixedStep(2.0)))
    frames = [x.df.agg(F.count("*").alias("n")).select(F.lit(k).cast("long").alias("level"), "n") for k, x in enumerate(lod.levels)]
    found = frames[0]
    for f in frames[1:]:
        found = found.unionByName(f)
    return found


@query()
def progressive_mean(s, d):
    t = EmbeddedTensor(events(s, d, 2), Embedding((1.0, 1.0)))
    lod = resample.create_lod(t, (2.0, 2.0))
    found = None
    for version, frame in progressive(lod, lambda x: x.df.agg(F.avg("value").alias("value"))):
        frame = frame.select(F.lit(version.level).alias("level"), F.lit(version.final).alias("final"), "value")
        found = frame if found is None else found.unionByName(frame)
    return found


# Colours and frames


@query("SELECT event_id AS x, least(floor(greatest(0, (value - 10) / 400) * 256), 255)::BIGINT AS r, least(floor(greatest(0, (value - 10) / 400) * 256), 255)::BIGINT AS a FROM events")
def transfer_function(s, d):
    t = apply_tf(events(s, d, 1), TransferFunction.grey_ramp(10.0, 410.0))
    return t.df.select(F.col("p0").alias("x"), F.col("value")[0].cast("long").alias("r"), F.col("value")[3].cast("long").alias("a"))


@query("SELECT min(value) AS low, max(value) AS high, 256 AS n FROM events")
def transfer_function_range(s, d):
    tf = fit_range(events(s, d, 1), TransferFunction.grey_ramp(0.0, 1.0), None)
    return s.createDataFrame([(tf.min, tf.max, len(tf.table))], "low double, high double, n int")


@query("SELECT event_id AS x, trunc(r * a + 100::FLOAT * (1::FLOAT - a))::BIGINT AS r FROM (SELECT event_id, r, (r / 255::DOUBLE)::FLOAT AS a FROM (SELECT event_id, least(floor(greatest(0, value / 500) * 256), 255)::FLOAT AS r FROM events))")
def blend_alpha(s, d):
    over = apply_tf(events(s, d, 1), TransferFunction.grey_ramp(0.0, 500.0))
    under = over.map(lambda c: F.transform(c, lambda v: F.lit(100)))
    return alpha_blending(over, under).df.select(F.col("p0").alias("x"), F.col("value")[0].cast("long").alias("r"))


@query(EV3 + "SELECT o.y, q.x, least(floor(greatest(0, v / 500) * 256), 255)::BIGINT AS r FROM range(40) o(y) CROSS JOIN range(30) q(x) JOIN t ON t.z = 5 AND t.y = floor((o.y + 0.5) * (10 / 40::DOUBLE) - 0.5 + 0.5) AND t.x = floor((q.x + 0.5) * (10 / 30::DOUBLE) - 0.5 + 0.5)")
def slice_view(s, d):
    t = EmbeddedTensor(events(s, d, 3), Embedding((1.0, 1.0, 1.0)))
    frame = TensorMeta((40, 30))
    v = render.render_slice(t.single_level_lod(), frame, render.slice_projection_fit(t.meta, frame, 5), TransferFunction.grey_ramp(0.0, 500.0))
    return v.df.select(F.col("p0").alias("y"), F.col("p1").alias("x"), F.col("value")[0].cast("long").alias("r"))


@query("SELECT y, x, (CASE WHEN (y // 32 + x // 32) % 2 = 1 THEN 48 ELSE 24 END)::BIGINT AS r FROM range(80) a(y) CROSS JOIN range(80) b(x)")
def slice_view_outside(s, d):
    t = EmbeddedTensor(events(s, d, 3), Embedding((1.0, 1.0, 1.0)))
    m = translation([0.0, 1e6, 1e6])
    v = render.render_slice(t.single_level_lod(), TensorMeta((80, 80)), m, TransferFunction.grey_ramp(0.0, 500.0))
    return v.df.select(F.col("p0").alias("y"), F.col("p1").alias("x"), F.col("value")[0].cast("long").alias("r"))


@query(EV2 + "SELECT o.y, q.x, least(floor(greatest(0, v / 500) * 256), 255)::BIGINT AS r FROM range((SELECT max(y) + 1 FROM t)) o(y) CROSS JOIN range(100) q(x) JOIN t ON t.y = o.y AND t.x = q.x")
def image_view(s, d):
    t = EmbeddedTensor(apply_tf(events(s, d, 2), TransferFunction.grey_ramp(0.0, 500.0)), Embedding((1.0, 1.0)))
    v = render.view_image(t.single_level_lod(), TensorMeta(t.meta.dims), render.ImageState())
    return v.df.select(F.col("p0").alias("y"), F.col("p1").alias("x"), F.col("value")[0].cast("long").alias("r"))


def _rays(s, d, mode: str, shading: str = "none"):
    t = EmbeddedTensor(events(s, d, 3), Embedding((1.0, 1.0, 1.0)))
    frame = TensorMeta((24, 32))
    eep = render.entry_exit_points(t.meta, t.embedding, frame, render.Camera.for_volume(t.meta, t.embedding))
    v = render.raycast(t.single_level_lod(), eep, TransferFunction.grey_ramp(0.0, 500.0), render.RaycasterConfig(compositing=mode, shading=shading))
    return v.df.select(F.col("p0").alias("y"), F.col("p1").alias("x"), *[F.col("value")[i].cast("long").alias(c) for i, c in enumerate("rgba")])


@query()
def raycast_mop(s, d):
    return _rays(s, d, "mop")


@query()
def raycast_dvr(s, d):
    return _rays(s, d, "dvr")


@query()
def raycast_phong(s, d):
    return _rays(s, d, "mop", "phong")


# Graphs


@query(UNIT + ", e AS (SELECT y, x, 0::BIGINT AS axis, v - lead(v) OVER (PARTITION BY x ORDER BY y) AS g FROM t UNION ALL SELECT y, x, 1, v - lead(v) OVER (PARTITION BY y ORDER BY x) FROM t) SELECT y, x, axis, round(greatest(exp(-100 * g * g), 1e-5), 6) AS value FROM e WHERE g IS NOT NULL")
def rw_weights_grady(s, d):
    return out(weights.grady(unit(s, d), 100.0), "y", "x", "axis")


@query(
    UNIT + ", m AS (SELECT a.y, a.x, any_value(a.v) AS v, avg(b.v) AS m FROM t a JOIN t b ON b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY a.y, a.x), c AS (SELECT (v - m) * (v - m) AS d, (y // 32) * 4 + x // 32 AS chunk FROM m),"
    " drawn AS (SELECT chunk FROM (SELECT DISTINCT chunk FROM c) ORDER BY md5('0:' || chunk), chunk LIMIT 10), beta AS (SELECT 2 / (avg(d) * count(*) / (count(*) - 1) * 2 / 27) AS beta FROM c WHERE chunk IN (FROM drawn)),"
    " e AS (SELECT y, x, 0::BIGINT AS axis, m - lead(m) OVER (PARTITION BY x ORDER BY y) AS g FROM m UNION ALL SELECT y, x, 1, m - lead(m) OVER (PARTITION BY y ORDER BY x) FROM m)"
    " SELECT y, x, axis, round(greatest(exp(-(SELECT beta FROM beta) * g * g), 1e-5), 6) AS value FROM e WHERE g IS NOT NULL"
)
def rw_weights_bian(s, d):
    return out(weights.bian(unit(s, d), 1), "y", "x", "axis")


@query("WITH p AS (SELECT (p_partkey % 100)::DOUBLE * 0.37 AS a, (p_partkey % 77)::DOUBLE * 0.61 AS b, (p_partkey % 2)::DOUBLE AS fg FROM part), r AS (SELECT least(39, floor(a + 0.5)) AS y, least(39, floor(b + 0.5)) AS x, max(fg) AS v FROM p GROUP BY ALL) SELECT o.y, q.x, v AS value FROM range(40) o(y) CROSS JOIN range(40) q(x) LEFT JOIN r ON r.y = o.y AND r.x = q.x")
def seed_rasterize(s, d):
    points = table(s, d, "part").select(F.array((F.col("p_partkey") % 100) * F.lit(0.37), (F.col("p_partkey") % 77) * F.lit(0.61)).alias("coord"), (F.col("p_partkey") % 2).alias("fg"))
    seeds = rw.rasterize_seed_points(points.where("fg = 1"), points.where("fg = 0"), TensorMeta((40, 40)), Embedding((1.0, 1.0)))
    return out(seeds)


def _corner_seeds(t):
    """Foreground at the last element of an image, background at the first."""
    far = tuple(n - 1 for n in t.shape().dims)
    return rw.rasterize_seed_points(memory.points([far]), memory.points([(0, 0)]), t.shape(), Embedding((1.0, 1.0))).inner


@query(
    UNIT + ", e AS (SELECT y * 100 + x AS r, y * 100 + x + 100 AS c, exp(-100 * (v - lead(v) OVER (PARTITION BY x ORDER BY y)) ** 2) AS w FROM t UNION ALL SELECT y * 100 + x, y * 100 + x + 1, exp(-100 * (v - lead(v) OVER (PARTITION BY y ORDER BY x)) ** 2) FROM t),"
    " g AS (SELECT r, c, greatest(w, 1e-5) AS w FROM e WHERE w IS NOT NULL), b AS (SELECT r, c, w FROM g UNION ALL SELECT c, r, w FROM g), seeds AS (SELECT unnest([0, (SELECT count(*) // 100 * 100 - 1 FROM events)]) AS s)"
    " SELECT r::BIGINT AS row, r::BIGINT AS col, round(sum(w), 6) AS value FROM b WHERE r NOT IN (FROM seeds) GROUP BY r UNION ALL SELECT r, c, round(-w, 6) FROM b WHERE r NOT IN (FROM seeds) AND c NOT IN (FROM seeds)"
)
def rw_laplacian(s, d):
    t = unit(s, d)
    a, _ = rw.laplacian(weights.grady(t, 100.0), _corner_seeds(t))
    return a.select("row", "col", F.round("value", 6).alias("value"))


@query()
def rw_solve(s, d):
    t = unit(s, d)
    t = t.replaced(t.df, t.shape().with_chunk(t.shape().dims))  # the flat solver takes one system
    return out(rw.random_walker_single_chunk(weights.grady(t, 100.0), _corner_seeds(t)))


@query()
def rw_bhattacharyya(s, d):
    return out(weights.bhattacharyya_var_gaussian(unit(s, d), 1), "y", "x", "axis")


@query()
def rw_ttest(s, d):
    return out(weights.ttest_weights(unit(s, d), 1), "y", "x", "axis")


@query()
def best_centers(s, d):
    return out(weights.best_centers(unit(s, d), 1), "y", "x", "axis")


@query()
def rw_hierarchical(s, d):
    t = EmbeddedTensor(unit(s, d), Embedding((1.0, 1.0)))
    far = tuple(n - 1 for n in t.meta.dims)
    lod = resample.create_lod(t, (SynchronizedStep(2.0),) * 2, resample.stored)
    w = weights.random_walker_weights_lod(lod, "grady", beta=100.0)
    return out(rw.hierarchical(w, lod, memory.points([far]), memory.points([(0, 0)]))[0].levels[0])


@query()
def vesselness_multiscale(s, d):
    t = EmbeddedTensor(events(s, d, 3, chunk=(32, 10, 10)), Embedding((1.0, 1.0, 1.0)))
    return out(vesselness.multiscale_vesselness(t, 0.5, 1.0, 2))


# Functions of the position


@query("SELECT y, x, round((y + x)::DOUBLE / 32, 6) AS value FROM range(20) a(y) CROSS JOIN range(30) b(x)")
def rasterize(s, d):
    return out(memory.rasterize(TensorMeta((20, 30)), "(v0 + v1) / 32.0"))


@query("SELECT z, y, x, round(greatest(0, least(1, 10 * (0.5 - sqrt((z / 16 - 0.5) ** 2 + (y / 16 - 0.5) ** 2 + (x / 16 - 0.5) ** 2))))::FLOAT::DOUBLE, 5) AS value FROM range(16) a(z) CROSS JOIN range(16) b(y) CROSS JOIN range(16) c(x)")
def procedural_ball(s, d):
    return out(memory.ball(TensorMeta((16, 16, 16), (8, 8, 8)), Embedding((1.0,) * 3)).levels[0], digits=5)


@query("SELECT x, (2.0 * x)::DOUBLE AS value FROM range(50) a(x)")
def rasterize_function(s, d):
    return out(memory.voxel((50,), (10,), lambda x: 2.0 * x))


@query(
    "WITH RECURSIVE px AS (SELECT y, x, (x / 64::DOUBLE - 0.8::DOUBLE) * 5 AS cx, (y / 48::DOUBLE - 0.5::DOUBLE) * 5 AS cy FROM range(48) a(y) CROSS JOIN range(64) b(x)),"
    " steps(y, x, cx, cy, vx, vy, i) AS (SELECT y, x, cx, cy, cx, cy, 0 FROM px UNION ALL SELECT y, x, cx, cy, vx * vx - vy * vy + cx, 2 * vx * vy + cy, i + 1 FROM steps WHERE i < 50 AND sqrt(vx * vx + vy * vy) <= 5)"
    " SELECT y, x, round((greatest(max(i) - 2, 0) / 48::DOUBLE)::FLOAT::DOUBLE, 6) AS value FROM steps GROUP BY y, x"
)
def mandelbrot(s, d):
    return out(memory.mandelbrot(TensorMeta((48, 64), (16, 16)), Embedding((1.0, 1.0))).levels[0])


@query(
    "WITH RECURSIVE px AS (SELECT z, y, x, (z / 16::DOUBLE - 0.5) * 2.3::DOUBLE AS cz, (y / 16::DOUBLE - 0.5) * 2.3::DOUBLE AS cy, (x / 16::DOUBLE - 0.5) * 2.3::DOUBLE AS cx FROM range(16) a(z) CROSS JOIN range(16) b(y) CROSS JOIN range(16) c(x)),"
    " steps(z, y, x, cz, cy, cx, vz, vy, vx, i) AS (SELECT z, y, x, cz, cy, cx, cz, cy, cx, 0 FROM px UNION ALL SELECT z, y, x, cz, cy, cx,"
    " pow(sqrt(vx * vx + vy * vy + vz * vz), 8) * cos(8 * atan2(sqrt(vx * vx + vy * vy), vz)) + cz, pow(sqrt(vx * vx + vy * vy + vz * vz), 8) * sin(8 * atan2(sqrt(vx * vx + vy * vy), vz)) * sin(8 * atan2(vy, vx)) + cy,"
    " pow(sqrt(vx * vx + vy * vy + vz * vz), 8) * sin(8 * atan2(sqrt(vx * vx + vy * vy), vz)) * cos(8 * atan2(vy, vx)) + cx, i + 1 FROM steps WHERE i < 10 AND sqrt(vx * vx + vy * vy + vz * vz) <= 2.3::DOUBLE)"
    " SELECT z, y, x, round((greatest(max(i) - 2, 0) / 8::DOUBLE)::FLOAT::DOUBLE, 6) AS value FROM steps GROUP BY z, y, x"
)
def mandelbulb(s, d):
    return out(memory.mandelbulb(TensorMeta((16, 16, 16), (8, 8, 8)), Embedding((1.0,) * 3)).levels[0])


# Event windows


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_tumbling(s, d):
    f = event_windows(table(s, d, "events"), "1 hour", keys=("event_type",))
    return f.select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query("WITH e AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e) SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM g GROUP BY user_id, k")
def event_sessions_by_user(s, d):
    f = event_sessions(table(s, d, "events"), "30 minutes", "user_id")
    return f.select("user_id", "start", "n", F.round("total", 4).alias("total"))


FLAGSHIP_SQL = (
    EV3.rstrip() + ", "
    f"a AS (SELECT z, y, x, v AS raw, {conv_sql([0.25, 0.5, 0.25], 'x', 'z, y', 'repeat')} AS v FROM t), b AS (SELECT z, y, x, raw, {conv_sql([0.25, 0.5, 0.25], 'y', 'z, x', 'repeat')} AS v FROM a), "
    f"c AS (SELECT z, y, x, raw, {conv_sql([0.25, 0.5, 0.25], 'z', 'y, x', 'repeat')} AS v FROM b) SELECT z // 4 AS z, y // 4 AS y, x // 4 AS x, round(avg(abs(v - raw)), 6) AS value FROM c GROUP BY ALL"
)


@query(FLAGSHIP_SQL)
def flagship(s, d):
    """Smooth along all axes, distance to the raw values, mean by chunk."""
    raw = events(s, d, 3).compile()
    smooth = raw.separable_convolution([[0.25, 0.5, 0.25]] * 3).compile()
    return out((smooth - raw).abs().chunk_aggregation("mean"))


__all__ = ["ORACLE_SQL", "QUERIES", "LodTensor", "progressive"]
