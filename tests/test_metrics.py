"""Metrics against published values and brute force."""

import json
import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from fabulon.functions import stats
from fabulon.operators import arcs as A
from fabulon.operators import divergence as D
from fabulon.operators import metrics as M
from fabulon.operators import selection as L
from fabulon.settings import METRICS

GOLDEN = Path(__file__).parent / "golden"


@pytest.fixture(scope="module")
def golden(spark):
    rows = []
    for key, scores in json.loads((GOLDEN / "arcs.json").read_text()).items():
        slug, version, method = key.split("|")
        rows.append((slug, 0, version.replace("_parallel", ""), method, scores))
    return spark.createDataFrame(rows, "slug string, run_id long, version string, method string, scores array<double>")


def test_published_results(golden):
    arcs = A.from_score_docs(golden)
    got = {
        (r["slug"], r["method"], r["pair"], r["normalization"]): r
        for r in M.compare(M.pairs(M.by_role(arcs, complete=False))).collect()
    }
    checked = 0
    for row in json.loads((GOLDEN / "results.json").read_text()):
        mine = got[(row["book"], row["method"], row["pair"], row["normalization"])]
        tolerance = 1e-9 if row["book"] == "treasure_island" else 1e-5
        for m in METRICS:
            want = float(row[m])
            if math.isnan(want):
                assert mine[m] is None
            else:
                assert mine[m] == pytest.approx(want, abs=tolerance), (row["book"], row["method"], row["pair"], m)
        checked += 1
    assert checked == 16


def test_published_divergences(golden):
    arcs = A.from_score_docs(golden)
    found = D.top_divergences(M.pairs(M.by_role(arcs, complete=False)))
    rows = found.where("method = 'sw_xlm_roberta' and pair = 'original_vs_human'").orderBy("slug", "rank_no").collect()
    at = {}
    for r in rows:
        at.setdefault(r["slug"], []).append(r["window_index"])
    assert at["jekyll_hyde"] == [96, 95, 88]
    assert at["treasure_island"] == [82, 85, 87]
    assert at["wuthering_heights"] == [21, 41, 59]


def test_published_offset(golden):
    row = L.calibration_offset(A.from_score_docs(golden)).first()
    assert row["direction"] == "en_to_fr" and row["n_points"] == 244
    assert row["offset"] == pytest.approx(-0.290818757, abs=1e-6)


def brute_dtw(a, b):
    n, m = len(a), len(b)
    cost = [[math.inf] * (m + 1) for _ in range(n + 1)]
    steps = [[0] * (m + 1) for _ in range(n + 1)]
    cost[0][0] = 0.0
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            best = min((cost[i - 1][j - 1], 0, steps[i - 1][j - 1]), (cost[i - 1][j], 1, steps[i - 1][j]), (cost[i][j - 1], 2, steps[i][j - 1]))
            cost[i][j] = abs(a[i - 1] - b[j - 1]) + best[0]
            steps[i][j] = best[2] + 1
    return cost[n][m] / steps[n][m]


def test_time_warping_against_brute_force():
    rng = np.random.default_rng(1)
    for n, m in ((1, 1), (1, 5), (4, 2), (7, 7), (12, 30), (40, 11)):
        for _ in range(5):
            a, b = np.round(rng.normal(size=n), 1), np.round(rng.normal(size=m), 1)
            assert stats.dtw_distance(a, b) == pytest.approx(brute_dtw(a.tolist(), b.tolist()), abs=1e-12)
    assert stats.dtw_distance([1.0, 2.0, 3.0], [1.0, 2.0, 3.0]) == 0.0
    assert stats.dtw_distance([], [1.0]) is None


def test_significance():
    # closed forms: one degree of freedom (n = 3) and two (n = 4)
    for r in (-0.9, -0.2, 0.0, 0.37, 0.99):
        assert stats.correlation_p(r, 3) == pytest.approx(1 - 2 / math.pi * math.asin(abs(r)), abs=1e-12)
        assert stats.correlation_p(r, 4) == pytest.approx(1 - abs(r), abs=1e-12)
    assert stats.correlation_p(0.5, 2) == 1.0
    assert stats.correlation_p(0.5, 1) is None and stats.correlation_p(None, 9) is None
    assert stats.correlation_p(1.0, 9) == 0.0
    assert 0 < stats.correlation_p(0.99, 100) < 1e-30


def test_smoothing_weights():
    h = A.smoothing_matrix(11, 3)
    assert [round(x * 429) for x in h[5]] == [-36, 9, 44, 69, 84, 89, 84, 69, 44, 9, -36]
    assert [round(x * 35) for x in A.smoothing_matrix(5, 3)[2]] == [-3, 12, 17, 12, -3]
    with pytest.raises(ValueError):
        A.smoothing_matrix(3, 3)


def one(spark, scores, *cols):
    return spark.createDataFrame([(scores,)], "s array<double>").select(*cols).first()


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 9, 10, 11, 12, 40])
def test_smoothing_keeps_cubics(spark, n):
    y = [0.3 + 0.2 * i - 0.05 * i**2 + 0.001 * i**3 for i in range(n)]
    got = one(spark, y, A.smooth(F.col("s")), A.smooth_for_plots(F.col("s")))
    assert got[0] == pytest.approx(y, abs=1e-9)
    assert len(got[1]) == n


def test_resampling(spark):
    y = [0.0, 1.0, 4.0]
    got = one(spark, y, A.resample(F.col("s"), 5), A.resample(F.col("s"), 3))
    assert got[0] == pytest.approx(np.interp(np.linspace(0, 1, 5), np.linspace(0, 1, 3), y).tolist())
    assert got[1] == y
    assert one(spark, [2.0], A.resample(F.col("s"), 4))[0] == [2.0] * 4
    assert one(spark, [], A.resample(F.col("s"), 4))[0] == []


def test_extrema(spark):
    y = [0.0, 3.0, 1.0, 5.0, 5.0, 2.0, 4.0, 0.0, 4.0, 1.0]
    got = one(spark, y, A.extrema(F.col("s")), A.extrema(F.col("s"), sign=-1))
    assert got[0] == [6, 8, 1]  # the plateau of fives is no peak
    assert got[1] == [7, 2, 5]
    assert one(spark, [1.0, 2.0, 3.0], A.extrema(F.col("s")))[0] == []


def test_undefined_values_are_null(spark):
    rows = [("b", 0, "m", "en_original", "original", [1.0, 1.0, 1.0]), ("b", 0, "m", "fr_human", "human", [0.0, 0.0, 0.0]), ("b", 0, "m", "fr_llm", "llm", [1.0, None, 2.0])]
    arcs = spark.createDataFrame(rows, "slug string, run_id long, method string, version string, role string, scores array<double>")
    got = {(r["pair"], r["normalization"]): r for r in M.compare(M.pairs(M.by_role(arcs))).collect()}
    r = got[("original_vs_human", "chapter")]
    assert r["pearson_r"] is None and r["pearson_p"] is None and r["spearman_rho"] is None and r["peak_alignment"] is None
    assert r["cosine_similarity"] == 0.0 and r["rmse"] == 1.0
    assert got[("original_vs_llm", "chapter")]["n"] == 2  # the missing point is left out


def test_empty_table(spark):
    arcs = spark.createDataFrame([], "slug string, run_id long, method string, version string, role string, scores array<double>")
    assert M.compare(M.pairs(M.by_role(arcs))).count() == 0


def test_metrics_are_symmetric(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=20).tolist(), rng.normal(size=20).tolist()
    df = spark.createDataFrame([(1, a, b, 20), (2, b, a, 20)], "k int, a array<double>, b array<double>, n int")
    x, y = M.compare(df, ("pearson_r", "spearman_rho", "dtw_distance", "rmse", "mean_abs_diff", "cosine_similarity")).orderBy("k").collect()
    for m in ("pearson_r", "spearman_rho", "rmse", "mean_abs_diff", "cosine_similarity"):
        assert x[m] == pytest.approx(y[m], abs=1e-12)
    assert abs(x["pearson_r"]) <= 1 and x["dtw_distance"] >= 0
    ra, rb = np.argsort(np.argsort(a)), np.argsort(np.argsort(b))
    assert x["spearman_rho"] == pytest.approx(np.corrcoef(ra, rb)[0, 1])


def test_strategy_comparison_of_arcs_with_missing_points(spark, tmp_path):
    from fabulon.plans import catalog

    line = [float(i) for i in range(100)]
    hole = lambda *at: [None if i in at else float("nan") if -i in at and i else x + 2.0 for i, x in enumerate(line)]
    rows = [("a", 1, "m", "en_original", [x if i != 5 else None for i, x in enumerate(line)]), ("a", 1, "m", "fr_llm", hole(50)), ("a", 1, "m", "fr_llm_bon5", hole(-70))]
    rows += [("b", 1, "m", "en_original", [1.0, None, 2.0]), ("b", 1, "m", "fr_llm", [1.0, 2.0, 3.0])]
    spark.createDataFrame(rows, "slug string, run_id long, method string, version string, scores array<double>").write.parquet(f"{tmp_path}/score_docs.parquet")
    got = {(r["slug"], r["version"]): r["mean_gap"] for r in catalog.strategy_comparison(spark, str(tmp_path)).collect()}
    assert got == {("a", "fr_llm"): 2.0, ("a", "fr_llm_bon5"): 2.0, ("b", "fr_llm"): None}
