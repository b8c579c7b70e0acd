"""Every query of the catalogue against its SQL twin on the smallest tables."""

import glob
import os

import pandas as pd
import pytest

from tidemark.plans import catalog, oracle

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    def text(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return "~"
        return f"{float(v):.9g}" if isinstance(v, float) else str(v)

    df = df[sorted(df.columns)].map(text)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


FEW = ["dashboard_city_zone", "dedup_log", "coverage_audit", "quality_decisions", "neighbour_validation", "spearman_pairs", "hypothesis_gates", "permutation_eta_small", "imputation_methods", "baseline_folds", "quality_flags", "flags_appended", "latest_contracts", "latest_run", "model_registry", "filtered_sql", "flag_summary_refreshed", "scenario_inference"]


@pytest.mark.parametrize("name", FEW if not os.environ.get("ALL_QUERIES") else sorted(oracle.SQL))
def test_query(spark, duck, name):
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    got, expected = normal(catalog.QUERIES[name](spark, SF).toPandas()), normal(duck.sql(oracle.SQL[name]).df())
    pd.testing.assert_frame_equal(got, expected, check_dtype=False)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before  # nothing stays persisted


def test_names():
    assert set(oracle.SQL) <= set(catalog.QUERIES)
