import math

import numpy as np
import pytest

from cambium.operators import growth, spline


def by(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_tree_stats_against_numpy(rings):
    w = [1.0, 1.4, 0.7, 1.9, 1.1, 0.8]
    r = growth.tree_stats(rings({("a", "t"): (1950, w)})).collect()[0]
    x = np.array(w) - np.mean(w)
    assert (r["first"], r["last"], r["age"]) == (1950, 1955, 6)
    assert r["mean_growth"] == pytest.approx(np.mean(w))
    assert r["growth_sd"] == pytest.approx(np.std(w, ddof=1))
    assert r["ar1"] == pytest.approx((x[:-1] * x[1:]).sum() / (x * x).sum())


def test_tree_stats_of_a_constant_series_has_no_autocorrelation(rings):
    r = growth.tree_stats(rings({("a", "t"): (1950, [2.0] * 5), ("a", "u"): (1950, [1.0])})).collect()
    assert all(x["ar1"] is None for x in r)


def test_nan_and_infinite_widths_are_missing(spark):
    df = spark.createDataFrame(
        [("a", "t", 1, 1.0), ("a", "t", 2, float("nan")), ("a", "t", 3, float("inf")), ("a", "t", 4, 3.0)],
        "rwl string, tree string, year int, width double",
    )
    r = growth.tree_stats(df).collect()[0]
    assert r["mean_growth"] == 2.0 and r["age"] == 4


def test_site_ages_and_rollup(rings, spark):
    stats = growth.tree_stats(rings({("a", "t"): (1950, [1, 2, 1]), ("a", "u"): (1940, [1, 3, 2, 2, 1])}))
    flags = spark.createDataFrame([("bad", "reading rwl file failed")], "rwl string, flag string")
    ages = growth.tree_age(stats, flags)
    got = by(ages, "rwl", "tree")
    assert got[("a", "t")]["rwl_meanage"] == 4.0 and got[("a", "t")]["rwl_totage"] == 13
    assert got[("bad", None)]["flag"] == "reading rwl file failed"
    roll = by(growth.site_rollup(ages), "rwl")
    assert roll[("a",)]["max_age"] == 5 and roll[("a",)]["min_age"] == 3
    assert roll[("bad",)]["max_age"] is None


def test_bai_of_equal_rings(rings):
    got = growth.bai(rings({("a", "t"): (2000, [1, 1, 1])})).orderBy("year").collect()
    assert [r["bai"] for r in got] == pytest.approx([math.pi, 3 * math.pi, 5 * math.pi])


def test_dense_years_cover_the_site(rings):
    widths = rings({("a", "t"): (2000, [1, None, 1]), ("a", "u"): (1998, [1]), ("b", "v"): (1900, [1])})
    got = by(growth.bai_dense(widths), "rwl", "tree", "year")
    assert sorted(k[2] for k in got if k[1] == "t") == list(range(1998, 2003))
    assert sorted(k[2] for k in got if k[1] == "u") == list(range(1998, 2003))
    assert got[("a", "t", 2001)]["bai"] is None and got[("a", "t", 1999)]["bai"] is None
    assert got[("a", "t", 2002)]["bai"] == pytest.approx(3 * math.pi)
    assert got[("b", "v", 1900)]["bai"] == pytest.approx(math.pi)
    dense = by(growth.dense_widths(widths), "rwl", "tree", "year")
    assert dense.keys() == got.keys() and dense[("a", "t", 2001)]["width"] is None


def test_trends(rings, spark):
    chron = spark.createDataFrame(
        [("a", 1974, 9.0), ("a", 1980, 1.0), ("a", 1981, 1.5), ("a", 1982, None), ("b", 1990, 1.0)],
        "rwl string, year int, std double",
    )
    got = by(growth.site_trend(chron), "rwl")
    assert got[("a",)]["growth_slope"] == pytest.approx(0.5) and got[("a",)]["n_years"] == 3
    assert got[("b",)]["growth_slope"] is None
    trend = growth.tree_trend(growth.bai(rings({("a", "t"): (1990, [1, 1, 1, 1])}))).collect()[0]
    assert trend["growth_slope"] == pytest.approx(2 * math.pi)


def test_chronology_cv_of_a_zero_mean_is_null(spark):
    chron = spark.createDataFrame([("a", 1, 1.0), ("a", 2, -1.0)], "rwl string, year int, std double")
    r = growth.chronology_cv(chron).collect()[0]
    assert r["cv"] is None and r["sd"] == pytest.approx(math.sqrt(2))


def test_flags_sites_with_a_gap(rings):
    flags = growth.growth_trend_flags(rings({("a", "t"): (1, [1, None, 1]), ("b", "t"): (1, [1, 1])}))
    assert [(r["rwl"], r["flag"]) for r in flags.collect()] == [("a", "detrend failed")]


def dense_spline(y, period):
    """The same smoother through full matrices."""
    n = len(y)
    q = np.zeros((n, n - 2))
    r = np.zeros((n - 2, n - 2))
    for j in range(n - 2):
        q[j : j + 3, j] = [1, -2, 1]
        r[j, j] = 2 / 3
        if j:
            r[j, j - 1] = r[j - 1, j] = 1 / 6
    w = float(spline.smoothing_weight(np.array(period)))
    return y - w * q @ np.linalg.solve(r + w * q.T @ q, q.T @ y)


def test_spline_batch_equals_dense_solution():
    rng = np.random.default_rng(3)
    series = [rng.random(n) + 0.5 for n in (3, 4, 5, 17, 60, 61, 200)]
    for y, fit in zip(series, spline.fit_splines(series)):
        assert fit == pytest.approx(dense_spline(y, max(np.floor(0.67 * len(y)), 2.0)), abs=1e-9)
    for y, fit in zip(series, spline.fit_splines(series, 20.0)):
        assert fit == pytest.approx(dense_spline(y, 20.0), abs=1e-9)


def test_spline_chunks_do_not_change_the_result(monkeypatch):
    rng = np.random.default_rng(4)
    series = [rng.random(int(n)) + 0.5 for n in rng.integers(1, 40, 25)]
    whole = spline.fit_splines(series)
    monkeypatch.setattr(spline, "CHUNK", 4)
    for a, b in zip(whole, spline.fit_splines(series)):
        assert a == pytest.approx(b)


def test_spline_keeps_lines_and_halves_its_period():
    line = 2.0 + 0.1 * np.arange(50)
    assert spline.fit_splines([line])[0] == pytest.approx(line)
    for period in (20, 67):
        wave = np.cos(2 * np.pi * np.arange(period * 12) / period)
        middle = slice(period * 5, period * 7)
        fit = spline.fit_splines([wave], float(period))[0][middle]
        assert fit.max() == pytest.approx(0.5, abs=0.01)


def test_detrend_spline_query(rings):
    widths = rings({("a", "t"): (1900, list(2.0 + 0.01 * np.arange(40))), ("a", "u"): (1900, [1.0, 0.0])})
    got = spline.detrend_spline(widths).collect()
    assert len(got) == 42
    assert all(r["rwi"] == pytest.approx(1.0) for r in got)


def test_detrend_falls_back_to_the_mean():
    y = np.array([10.0, 8, 0.1, 0.05, 0.01, 0.01, 0.02, 5, 9, 0.01])
    curve = dense_spline(y, 6.0)
    ratio = spline.detrended([y], None, 0.001)[0]
    expected = y / (curve if np.all(curve > 0) else y.mean())
    assert ratio == pytest.approx(expected)
