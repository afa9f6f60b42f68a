"""Every named query against its SQL, run by another engine on the same tables."""

import os

import pandas as pd
import pytest

from colinear.plans import catalogue

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Queries that no SQL expresses; their operators meet brute force or hand-made results in test_kernels and test_operators.
BRUTE_FORCE = {
    "R36b_region_growth", "R46_chain_overlap_resolution", "R47_tandem_alignment",
    "R48b_markov_clusters", "R48c_cograph_editing", "R48e_seed_and_chain",
}
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def normal(df: pd.DataFrame, cols: list[str]) -> pd.DataFrame:
    def text(x):
        if x is None or x is pd.NA or (isinstance(x, float) and x != x):
            return "null"
        if isinstance(x, (int, float)) and not isinstance(x, bool):
            return f"{float(x):.6f}".replace("-0.000000", "0.000000")
        return str(x)

    return df[cols].map(text).sort_values(cols).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    got = catalogue.queries()[name](spark, DATA).toPandas()
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert name in BRUTE_FORCE and len(got) > 0
        return
    want = duck.execute(sql).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    pd.testing.assert_frame_equal(normal(got, cols), normal(want, cols))


def test_union_graph_of_part_numbers_past_a_million(spark, tmp_path):
    import duckdb

    rows = [(1_000_003, 2, 90.0), (1_000_002, 3, 70.0), (1_000_004, 4, 85.0), (7, 1, 61.0), (7, 1, 30.0), (8, 1, 59.0)]
    df = spark.createDataFrame(rows, "l_partkey long, l_suppkey long, l_quantity double")
    df.write.parquet(f"{tmp_path}/lineitem.parquet")
    name = "R37d_homology_and_union_graph"
    got = catalogue.queries()[name](spark, str(tmp_path)).toPandas()
    c = duckdb.connect()
    c.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    cols = ["dst", "score", "src"]
    pd.testing.assert_frame_equal(normal(got, cols), normal(c.execute(catalogue.oracle_sql()[name]).df(), cols))
