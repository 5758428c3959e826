"""The registered queries against DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
#: A few of each kind; the driver runs all.
NAMES = ["flagship", "pw_arith", "pw_two_inputs", "vec_hsum", "slice_box", "chunk_agg_min", "conv1d_repeat_y", "conv1d_long_line", "resample_nearest", "slice_view", "rw_laplacian", "seed_rasterize", "event_tumbling"]


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = c.execute(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, FOLDER).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    plain = lambda t: sorted([tuple(float(v) if isinstance(v, (int, float)) else str(v) for v in r) for r in t[columns].astype(object).where(t[columns].notna(), None).values.tolist()], key=repr)
    assert plain(got) == plain(want)


def test_neighbourhood_queries_take_the_whole_image(spark):
    found = entry.queries()
    for name, n in (("best_centers", 10 * 100 * 2), ("rw_bhattacharyya", 9 * 100 + 10 * 99), ("rw_ttest", 9 * 100 + 10 * 99)):
        assert found[name](spark, FOLDER).count() == n
