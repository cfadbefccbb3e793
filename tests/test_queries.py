"""A sample of the registered queries against their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
NAMES = ["degree_bins", "csr", "edge_balanced_ranges_7", "redistribute_by_edges", "missing_reverse", "netd_clique", "w_uniform", "grid3d", "gnm_undirected", "rmat", "rgg2d_weighted", "rhg", "ba", "image_mesh_20"]


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = entry.queries()[name](spark, DIR)
    want = con.sql(entry.oracle_sql()[name]).df()
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    rows = lambda f: sorted(map(str, f[cols].values.tolist()))
    got = df.toPandas()
    assert len(got)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count()
