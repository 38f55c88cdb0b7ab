"""Values of the archived study run (FIXTURES.md), recomputed by the operators."""

import math

import pytest
from granary.operators import metrics as M, signal as S
from granary.operators.fits import conformal
from pyspark.sql import functions as F
from granary.functions.exprs import pearson

# Candidate, seed, dose, lift, out-of-fold prediction.
RUN = [
    (1, "labelnoise-000-001", 0, 0.00, 0.002817, 0.00316522490),
    (2, "labelnoise-000-001", 1, 0.00, 0.002484, 0.00294725573),
    (3, "labelnoise-025-002", 0, 0.25, 0.005509, 0.00644238730),
    (4, "labelnoise-025-002", 1, 0.25, 0.009011, 0.00623419823),
    (5, "labelnoise-050-003", 0, 0.50, 0.0, 0.000518506126),
    (6, "labelnoise-050-003", 1, 0.50, 0.0, 0.0000159199449),
    (7, "labelnoise-100-004", 0, 1.00, 0.0, -0.00120938395),
    (8, "labelnoise-100-004", 1, 1.00, 0.0, 0.00124957980),
]


@pytest.fixture(scope="module")
def run(spark):
    return spark.createDataFrame(RUN, "id long, candidate string, seed int, dose double, truth double, pred double").withColumn("grp", F.lit("g")).coalesce(1)


def one(df):
    return df.first().asDict()


def test_metrics(run):
    assert one(run.agg(pearson("pred", "truth").alias("r")))["r"] == pytest.approx(0.9194903686, abs=1e-4)
    assert one(run.agg(*M.error_columns()))["rmse"] == pytest.approx(0.0012353220, abs=1e-6)
    assert one(M.spearman(run, ["grp"]))["spearman"] == pytest.approx(0.8809523810, abs=1e-9)
    assert one(M.spearman(run, ["grp"], ties="average"))["spearman"] == pytest.approx(0.9132233210, abs=1e-9)
    pairs = one(M.concordance(run, ["grp"]))
    assert (pairs["right"], pairs["pairs"]) == (21, 22)
    assert one(run.agg(F.avg((M.sign3(F.col("pred")) == M.sign3(F.col("truth"))).cast("double")).alias("a")))["a"] == 0.5
    assert one(M.top1_regret(run))["top1_regret"] == pytest.approx(0.0035015256, abs=1e-6)
    lift = one(M.selection_lift(run, "grp", 0.25))
    assert (lift["model"], lift["random"], lift["oracle"]) == pytest.approx((0.0072598979, 0.0024776826, 0.0072598979), abs=1e-6)


def test_conformal_dose_and_gate(run):
    c = one(conformal(run, ["grp"], 0.2))
    assert (c["q"], c["coverage"], c["indeterminate"]) == pytest.approx((0.0027764624, 1.0, 0.5), abs=1e-5)
    assert one(M.spearman(run, ["grp"], "dose", "truth"))["spearman"] == pytest.approx(-0.5476190476, abs=1e-9)
    assert one(M.spearman(run, ["grp"], "dose", "truth", ties="average"))["spearman"] == pytest.approx(-0.7278253429, abs=1e-9)
    assert [r.rises for r in S.dose_response(run, "dose", "truth").orderBy("dose").collect()] == [False, True, False, False]
    g = one(S.gate(run, "candidate", "truth"))
    assert (g["within_std"], g["between_std"], g["icc"], g["snr"]) == pytest.approx((0.0012435540, 0.0034242949, 0.8834839720, 2.7536358148), rel=1e-3)
    assert g["verdict"] == "strong_signal" and g["n_cohorts"] == 4
    flat = one(S.gate(run.withColumn("zero", F.lit(0.0)), "candidate", "zero"))
    assert flat["verdict"] == "insufficient_repeats" and flat["icc"] is None


def test_edges(spark):
    empty = spark.createDataFrame([], "id long, grp string, pred double, truth double")
    assert M.spearman(empty, ["grp"]).count() == 0
    assert one(M.within_group_spearman(empty))["within_spearman"] == 0.0
    same = spark.createDataFrame([(1, "g", 1.0, 2.0), (2, "g", 1.0, 3.0), (3, "h", None, 3.0)], "id long, grp string, pred double, truth double")
    got = {r.grp: r.r for r in same.groupBy("grp").agg(pearson("pred", "truth").alias("r")).collect()}
    assert got == {"g": 0.0, "h": 0.0}
    p = same.select(M.spearman_p(F.lit(1.0), F.lit(9)).alias("p")).first()[0]
    assert math.isnan(p)
