"""A sample of registered queries against their SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = (
    "gate_report a7_export_nested b4_normalize_answer b8_choice_index b9_shuffle_choices c4_passband_cohorts c6_label_noise_cohorts c7_duplication_cohorts c8_build_all_cohorts d4_summarize_rollouts d9_engineered_features d11_cosine "
    "d17_policy_loss e3_target e7_backfill_features f4_zscore_by_group g5_oof_single g8_evaluate_single g16_snapshots_single g17_prequential_single h7_pairwise_accuracy h10_selection_lift h11_bootstrap_ci h11_bootstrap_median "
    "h12_paired_bootstrap_ci h13_kendall_tau_a i6_seed_projection i10_single_feature_screen i11_dose_response j5_climb_comparison j6_rows_by_step k3_stall_batch k3_best_pod k4_transition_alerts k6_age_stream k8_windowed_label_rate"
).split()


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


def rows(columns, data):
    order = [columns.index(c) for c in sorted(columns)]
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else str(v)
    return sorted([tuple(plain(r[i]) for i in order) for r in data], key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, tables, name):
    df = entry.queries()[name](spark, SF)
    c = tables.execute(entry.oracle_sql()[name])
    assert rows(df.columns, df.collect()) == rows([d[0] for d in c.description], c.fetchall())


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
