"""Registered queries against their SQL twins, on the smallest supplied tables."""

import os

import duckdb
import pytest
from quillstone.plans import catalogue

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no supplied tables")
SOME = "disguised_missing strip_ws try_numeric profile_numeric outlier_rules exact_duplicates rule_unique rule_compare quarantine_reasons normalise_vote dedup_keep_first split_stratified impute_group_median cap_mad expand_dates freq_encode roc_auc corrupt detect clean_run repair_plan semantic_type type_counts infer_rules profile_table check_disguised_missing encoding_damage cap_zscore drop_columns clean_column_names read_delimited load_summary read_headerless".split()


def plain(x):
    return round(x, 6) + 0.0 if isinstance(x, float) else x


def test_names_agree():
    assert set(catalogue.ORACLE) <= set(catalogue.QUERIES)
    assert set(catalogue.QUERIES) - set(catalogue.ORACLE) == {"logistic_fit", "verdict"}


@pytest.mark.parametrize("name", SOME)
def test_twin(spark, name):
    con = duckdb.connect()
    for t in catalogue.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{TABLES}/{t}.parquet'")
    twin = con.execute(catalogue.ORACLE[name])
    columns = [d[0] for d in twin.description]
    got = catalogue.QUERIES[name](spark, TABLES)
    assert sorted(got.columns) == sorted(columns)
    want = sorted(str([plain(x) for x in r]) for r in twin.fetchall())
    assert sorted(str([plain(r[c]) for c in columns]) for r in got.collect()) == want


def test_entry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
