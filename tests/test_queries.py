"""Some queries against their SQL in DuckDB, on the given tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = (
    "manifest_normalized", "occurrence_table", "knn_topk", "ri_curve", "mari_pooled", "margin_m_sweep", "aggregate_ranks", "schedule_tables", "bootstrap_median", "stratified_quota",
    "mari_per_sample_sharp", "share_tail", "probe_reductions", "t_interval_of_fifty", "tier_status", "downside_moments", "m_sweep_stability", "panel_scalars", "bijective_slice", "typed_rank_depth",
    "knn_pruned", "search_depth", "typed_widening", "bacc_curve", "correlation_tests", "density_curve", "subgroup_report", "margin_tail", "scale_numbers", "display_names", "closest_pairs", "model_correlations", "tau_agreement",
    "metadata_split", "metadata_expanded", "pooled_vectors", "probe_correlations", "frontier_changes",
)


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(df):
    columns = sorted(df.columns)
    return sorted(map(repr, df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False, name=None)))


def same(spark, duck, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    same(spark, duck, name)


def test_flagship(spark):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    assert entry.entry(spark).count() == 1
