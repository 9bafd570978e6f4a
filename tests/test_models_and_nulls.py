import numpy as np
import pytest
from pyspark.sql import functions as F

from tideglass.functions.design import obrien_fleming
from tideglass.operators import models
from tideglass.operators import resampling as rs
from tideglass.plans import kernel_queries, model_queries, null_queries

FOLDER = "/root/testdata/sf0.001"


def draws(f, n=200, seed=3):
    return np.array([f(np.random.default_rng([seed, i])) for i in range(n)])


def test_folds_never_train_on_what_they_test(spark):
    folds = models.expanding_folds(0, 100, 4, 5)
    assert folds == [(1, 15, 20, 40), (2, 35, 40, 60), (3, 55, 60, 80), (4, 75, 80, 100)]
    seen = []

    class Fake:
        def transform(self, df):
            return df.withColumn("prediction", F.lit(0.0))

    def fit(train):
        seen.append(train.agg(F.max("t")).first()[0])
        return Fake()

    rows = spark.range(100).select(F.col("id").alias("t"), F.lit(1.0).alias("y"))
    out = models.walk_forward(rows, "t", "y", folds, fit)
    assert seen == [14, 34, 54, 74] and out.count() == 80 and out.where("fold = 1").agg(F.min("t")).first()[0] == 20
    assert models.walk_forward(rows.limit(0), "t", "y", folds, fit).count() == 0


def test_linear_forecasts_equal_least_squares(spark):
    v = model_queries._log_variances(spark, FOLDER).orderBy("symbol", "day_no").toPandas()
    got = {(r.symbol, r.day_no): (r.fold, r.forecast) for r in model_queries.har_regression(spark, FOLDER).collect()}
    lo, hi = v.day_no.min(), v.day_no.max() + 1
    for fold, end, start, stop in models.expanding_folds(int(lo), int(hi), 4, 2):
        train, test = v[(v.day_no < end) & v.label.notna()], v[(v.day_no >= start) & (v.day_no < stop)]
        x = lambda d: np.column_stack([np.ones(len(d)), d[["d", "w", "m"]]])
        b, *_ = np.linalg.lstsq(x(train), train.label, rcond=None)
        for (_, r), p in zip(test.iterrows(), x(test) @ b):
            assert got[r.symbol, r.day_no] == (fold, pytest.approx(p, abs=1e-4))


def test_importance_finds_the_feature_that_matters(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 3))
    rows = spark.createDataFrame([(i, *map(float, r), float(3 * r[0])) for i, r in enumerate(x)], "k long, d double, w double, m double, label double")
    model = model_queries._linear(model_queries._assembled(rows))
    got = {r.feature: r.increase for r in models.permutation_importance(rows, model, ["d", "w", "m"], model_queries._assembled, "label", ["k"], 1, 4).collect()}
    assert got["d"] > 5 and abs(got["w"]) < 1e-6 and abs(got["m"]) < 1e-6


def test_shuffled_blocks_keep_classes_and_move_blocks(spark):
    rows = spark.createDataFrame([(h, i, i) for h in (0, None) for i in range(10)] + [(1, 0, 5)], "h int, i int, v int")
    out = rs.shuffled_blocks(rows, ["h"], ["i"], "v", 3, 1)
    for h in (0, None):
        got = [r.surrogate for r in out.where(F.col("h").eqNullSafe(F.lit(h))).orderBy("i").collect()]
        assert sorted(got) == list(range(10)) and got != list(range(10))
        assert all(got[k + 1] == got[k] + 1 for k in range(9) if got[k] % 3 != 2 and got[k] != 9)
    assert out.where("h = 1").first().surrogate == 5 and rs.shuffled_blocks(rows.limit(0), ["h"], ["i"], "v", 3, 1).count() == 0


def test_rank_measures():
    rng = np.random.default_rng(1)
    a = rng.standard_normal((30, 12))
    assert rs.mean_ic(a, a) == pytest.approx(1) and abs(rs.mean_ic(a, rng.standard_normal((30, 12)))) < 0.2
    b = a.copy()
    b[::2, 3] = np.nan
    assert rs.mean_ic(b, 2 * b) == pytest.approx(1) and np.isnan(rs.mean_ic(a[:, :3], a[:, :3]))
    assert rs.rank_correlation(np.array([1.0, 2, 2, 3]), np.array([1.0, 2, 2, 3])) == pytest.approx(1) and rs.rank_correlation(np.ones(4), np.arange(4.0)) == 0
    assert rs.trailing_sums(np.arange(5.0)[:, None], 2)[:, 0].tolist() == [0, 1, 3, 5, 7]


def test_simulated_panels_persist_as_fitted():
    rng = np.random.default_rng(2)
    sim = rs.persistent_panel(np.array([0.0, 0.7, -0.5]), np.array([1.0, 2.0, 1.0]), 4000, rng)
    phi, spread = rs.ar1_fits(sim)
    assert phi == pytest.approx([0, 0.7, -0.5], abs=0.05) and spread == pytest.approx([1, 2, 1], rel=0.05)
    panel = rng.standard_normal((80, 15))
    for null in (rs.persistence_null(panel, 4), rs.factor_null(panel, 4), rs.week_blocks_permuted(panel[:-1], panel[1:], 4)):
        d = draws(null, 60)
        assert abs(d.mean()) < 0.05 and 0.01 < d.std() < 0.1


def test_spectrum_pointers_and_spaced_days():
    v = np.ones(10) / np.sqrt(10)
    second = draws(rs.one_factor_second(5.0, v, 500), 50)
    assert 0.5 < second.min() and second.max() < 1.5
    scores = np.zeros((40, 6))
    scores[7] = 2.0
    scores[9, :5] = np.nan
    assert rs.pointer_count(scores) == 1
    assert draws(rs.rolled_columns_count(scores), 50).mean() < 1.5
    values = np.arange(20.0)
    observed, pool, draw = rs.spaced_days_mean(values, np.array([5, 6]), 3)
    assert observed == 5.5 and pool.tolist() == [0, 1, 2, *range(9, 20)] and abs(draws(draw, 300).mean() - values[pool].mean()) < 1


def test_portfolios_coherence_and_residuals():
    rng = np.random.default_rng(4)
    r = rng.standard_normal(500) * 0.01 + 0.0005
    assert abs(draws(rs.noise_portfolio_sharpe(r, 3, 20), 300).mean()) < 0.2
    x, y = rng.standard_normal(400), rng.standard_normal(400)
    stress = np.arange(400) % 4 == 0
    assert abs(draws(rs.coherence_lift_null(x, y, stress, 20), 100).mean()) < 0.06
    assert draws(rs.coherence_lift_null(x, y, stress, 20, True), 100).std() > 0
    fitted = np.full(50, 10.0)
    assert draws(rs.residual_bootstrap(fitted + rng.standard_normal(50), fitted, lambda c: c[3]), 300).mean() == pytest.approx(10, abs=0.3)


@pytest.mark.parametrize("name", ["cluster_bootstrap_p", "permutation_p", "circular_shift_p", "block_bootstrap_p"])
def test_replicate_queries_repeat_and_are_possible(spark, name):
    one, two = (getattr(kernel_queries, name)(spark, FOLDER).first() for _ in range(2))
    assert one == two and one.replicates == 2000 and 1 / 2001 <= one.p <= 1


def test_noise_spectra_and_ceilings_lie_where_theory_has_them(spark):
    largest = np.array([r.statistic for r in kernel_queries.noise_eigenvalues(spark, FOLDER).collect()])
    n = 25
    assert abs(largest.mean() / (1 + np.sqrt(n / 52)) ** 2 - 1) < 0.15
    ceiling = np.array([r.statistic for r in kernel_queries.selection_ceiling(spark, FOLDER).collect()])
    assert ceiling.mean() == pytest.approx(2.25 * 1.0, abs=0.35)


def test_bounds_of_repeated_looks():
    assert obrien_fleming(0.05, 2) == pytest.approx([2.797, 1.977], abs=0.01)
    assert obrien_fleming(0.05, 5)[-1] == pytest.approx(2.040, abs=0.01) and obrien_fleming(0.05, 1) == pytest.approx([1.96], abs=0.01)


def test_a_panel_beyond_the_bound_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(null_queries, "MOST_CELLS", 3)
    with pytest.raises(ValueError, match="too large"):
        null_queries.matrix(spark.range(4).select("id", F.col("id").alias("s"), F.lit(1.0).alias("v")), "id", "s", "v")
