import math

import numpy as np
import pytest

from cambium.operators import pointer, resilience


def by(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


@pytest.fixture
def noisy():
    rng = np.random.default_rng(1)
    return lambda n: list(1.0 + rng.random(n))


def test_weights_sum_to_one():
    assert pointer.LOWPASS_WEIGHTS == [math.comb(12, k) for k in range(13)]


def test_lowpass_against_convolution(rings, noisy):
    w = noisy(20)
    got = by(pointer.lowpass13(rings({("a", "t"): (1900, w)})), "year")
    smooth = np.convolve(w, np.array(pointer.LOWPASS_WEIGHTS) / 4096, mode="valid")
    assert sorted(got) == [(y,) for y in range(1906, 1914)]
    for i, s in enumerate(smooth):
        assert got[(1906 + i,)]["index"] == pytest.approx(w[6 + i] / s)
    flat = pointer.lowpass13(rings({("a", "t"): (1900, [2.0] * 13)}), mode="smooth").collect()
    assert flat[0]["index"] == pytest.approx(2.0)


def test_a_gap_breaks_the_kernel(rings, noisy):
    w = noisy(40)
    w[20] = None
    years = {r["year"] for r in pointer.lowpass13(rings({("a", "t"): (1900, w)})).collect()}
    assert years == set(range(1906, 1914)) | set(range(1927, 1934))


def test_growth_z(spark):
    x = np.random.default_rng(2).random(15).tolist()
    rows = [("a", "t", 1900 + i, v) for i, v in enumerate(x)] + [("a", "c", 1900 + i, 1.0) for i in range(15)]
    df = spark.createDataFrame(rows, "rwl string, tree string, year int, index double")
    got = by(pointer.growth_z(df), "tree", "year")
    # the constant series has no z, the other one only where 13 years are there
    assert sorted(got) == [("t", 1906), ("t", 1907), ("t", 1908)]
    part = np.array(x[1:14])
    assert got[("t", 1907)]["z"] == pytest.approx((x[7] - part.mean()) / part.std(ddof=1))


def test_classes_and_nature(spark):
    z = {1: [2.0, 1.5, 1.1, 0.0, 0.0], 2: [-2.0, -1.3, -1.2, 0.5, 0.5], 3: [1.645, 1.28, 1.0, 0, 0], 4: [-1.1, -1.1, 0, 0, 0]}
    rows = [("a", f"t{i}", y, float(v)) for y, vs in z.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "rwl string, tree string, year int, z double")
    got = by(pointer.pointer_years(df), "year")
    assert got[(1,)]["nature"] == 1 and got[(2,)]["nature"] == -1 and got[(4,)]["nature"] == 0
    assert [got[(1,)][f"perc_pos_{c}"] for c in ("extreme", "strong", "weak")] == [20.0, 20.0, 20.0]
    assert [got[(3,)][f"perc_pos_{c}"] for c in ("extreme", "strong", "weak")] == [0.0, 20.0, 20.0]
    assert got[(3,)]["nature"] == 0 and got[(2,)]["nb_series"] == 5


def site(name, trees, first, widths):
    return {(name, f"t{i}"): (first, widths()) for i in range(trees)}


def test_each_guard_alone(rings, spark, noisy):
    def dip():
        w = noisy(60)
        w[30] = 0.05
        return w

    series = {}
    series |= site("few", 2, 1950, lambda: noisy(60))
    series |= site("short", 3, 1950, lambda: noisy(20))
    series |= site("filtered", 3, 1950, lambda: noisy(30))
    series |= site("old", 3, 1800, lambda: noisy(60))
    # waves a third of a period apart never dip together
    series |= {
        ("calm", f"t{k}"): (1950, [1.0 + 0.1 * math.sin(2 * math.pi * (i / 9 + k / 3)) for i in range(60)])
        for k in range(3)
    }
    series |= site("good", 4, 1950, dip)
    widths = rings(series)
    index = pointer.lowpass13(widths)
    pointers = pointer.pointer_years(pointer.growth_z(index))
    guards = pointer.site_guards(widths, index)
    read = spark.createDataFrame([("broken", "reading rwl file failed")], "rwl string, flag string")
    flags = {r["rwl"]: r["flag"] for r in pointer.pointer_flags(guards, pointers, read_flags=read).collect()}
    assert flags == {
        "few": "less than 3 trees",
        "short": "Less than 26 years",
        "filtered": "Less than 26 years after detrend",
        "old": "older than 1900",
        "calm": "no pointer years calculated",
        "broken": "reading rwl file failed",
    }
    negative = pointer.negative_pointer_years(guards, pointers, read_flags=read)
    years = [r for r in negative.collect() if r["flag"] is None]
    assert {r["rwl"] for r in years} == {"good"} and 1980 in {r["pointer_year"] for r in years}
    assert all(r["total_year"] == 48 and r["series_count"] == 4 for r in years)
    assert negative.count() == len(years) + len(flags)
    rflags = {r["rwl"]: r["flag"] for r in resilience.resilience_flags(guards).collect()}
    assert set(rflags) == {"few", "short", "filtered"}
    freq = by(pointer.pointer_year_freq(negative), "pointer_year")
    assert freq[(None,)]["n"] == 6 and freq[(1980,)]["n"] == 1
    assert (None,) not in by(pointer.frequent_years(negative, 0), "pointer_year")
    assert pointer.frequent_years(negative, 10).count() == 0
    out = resilience.resilience_site(
        resilience.resilience_tree(index), guards, pointer.frequent_years(negative, 0), read
    ).collect()
    got = {r["rwl"] for r in out if r["flag"] is None}
    # frequent years are global, so the other passing sites appear in them too
    assert "good" in got and got <= {"good", "calm", "old"}
    assert {r["rwl"] for r in out if r["flag"]} == {"few", "short", "filtered", "broken"}


def test_missing_ring_codes(rings):
    widths = rings({("a", "t"): (1950, [0.0, 0.01, 0.001, 0.5]), ("a", "u"): (1960, [0.01])})
    r = pointer.missing_rings(widths).collect()[0]
    assert (r["missing_years_0"], r["missing_years_2"], r["missing_years_3"]) == (1, 2, 1)
    assert (r["total_missing_years"], r["series_count"], r["total_year"]) == (4, 2, 11)


def index_of(spark, values):
    rows = [("a", "t", 1950 + i, v) for i, v in enumerate(values) if v is not None]
    return spark.createDataFrame(rows, "rwl string, tree string, year int, index double")


def test_components_of_a_single_dip(spark):
    got = by(resilience.resilience_tree(index_of(spark, [2.0] * 4 + [1.0] + [2.0] * 4)), "year")
    r = got[(1954,)]
    assert (r["resist"], r["recov"], r["resil"], r["rel_resil"]) == (0.5, 2.0, 1.0, 0.5)
    assert got[(1953,)]["resist"] is None and got[(1953,)]["recov"] == pytest.approx(1.75 / 2)


def test_a_missing_year_does_not_shift_the_frame(spark):
    got = by(resilience.resilience_tree(index_of(spark, [2.0, 2.0, None, 2.0, 2.0, 1.0] + [2.0] * 4)), "year")
    assert got[(1955,)]["resist"] is None and got[(1955,)]["recov"] == 2.0


def test_zero_growth_has_no_recovery_ratio(spark):
    r = by(resilience.resilience_tree(index_of(spark, [2.0] * 4 + [0.0] + [2.0] * 4)), "year")[(1954,)]
    assert r["recov"] is None and r["resist"] == 0.0


def test_recovery_period(spark):
    values = [2.0] * 4 + [1.0, 1.5, 1.8, 2.1, 2.2] + [2.0] * 4
    got = by(resilience.recovery_period(index_of(spark, values)), "year")
    assert got[(1954,)]["rec_period"] == 3 and got[(1957,)]["rec_period"] is None
    never = by(resilience.recovery_period(index_of(spark, [2.0] * 4 + [1.0] * 15)), "year")
    assert never[(1954,)]["rec_period"] is None


def test_site_means(spark):
    rows = [("a", t, 1950, 1.0 * i, None, float("nan"), float("inf")) for i, t in enumerate("tuv", 1)]
    df = spark.createDataFrame(
        rows, "rwl string, tree string, year int, resist double, recov double, resil double, rel_resil double"
    )
    r = resilience.resilience_site_year(df).collect()[0]
    assert (r["resistance"], r["resistance_sd"], r["resistance_series"]) == (2.0, 1.0, 3)
    for name in ("recovery", "resilience", "rel_resilience"):
        assert r[name] is None and r[f"{name}_sd"] is None and r[f"{name}_series"] == 0


def test_even_windows_are_rejected(spark):
    index = spark.createDataFrame([("a", "t", 1, 1.0)], "rwl string, tree string, year int, index double")
    with pytest.raises(ValueError, match="odd number"):
        pointer.growth_z(index, window=12)
