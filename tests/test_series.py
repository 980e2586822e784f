import numpy as np
import pytest
from pyspark.sql import functions as F

from cambium.operators import growth, pointer, resilience, series, spline

RESILIENCE = series.RESILIENCE


@pytest.fixture(scope="module")
def widths(spark):
    """Long, short, gapped and constant trees, one of zeros, one with values that are no numbers."""
    rng = np.random.default_rng(3)
    rows = []
    for t in range(25):
        years = [y for y in range(1900 - 3 * t, 1960) if t % 4 != 1 or rng.random() > 0.06]
        values = {5: np.ones(len(years)), 6: np.zeros(len(years))}.get(t, rng.gamma(4.0, 0.3, len(years)))
        if t == 7:
            values[20], values[21], values[40] = np.nan, np.inf, 0.0
        rows += [(f"s{t % 3}", f"t{t:02d}", y, float(v)) for y, v in zip(years, values)]
    rows += [("s9", "one", 1950, 1.5), ("s9", "two", 1950, 1.5), ("s9", "two", 1951, 2.5), ("s9", "null", 1950, None)]
    rows += [("s9", "thirteen", 1940 + i, float(i + 1)) for i in range(13)]
    return spark.createDataFrame(rows, "rwl string, tree string, year int, width double").repartition(5).cache()


def rounded(df, columns):
    found = df.select("rwl", "tree", "year", *columns).collect() if "year" in df.columns else df.select("rwl", "tree", *columns).collect()
    return sorted((tuple(None if v is None else round(v, 9) if isinstance(v, float) else v for v in r) for r in found), key=repr)


def test_arrays_equal_windows(widths):
    trees = series.measured(series.tree_series(widths)).cache()
    index = pointer.lowpass13(widths).cache()
    assert rounded(series.rows(trees, "index_year", "index"), ["index"]) == rounded(index, ["index"])
    z = series.rows(trees, "index_year", "z").filter("z is not null")
    assert rounded(z, ["z"]) == rounded(pointer.growth_z(index), ["z"])
    assert rounded(series.rows(trees, "index_year", *RESILIENCE), RESILIENCE) == rounded(resilience.resilience_tree(index), RESILIENCE)
    stats = ["first", "last", "age", "mean_growth", "growth_sd", "ar1"]
    assert rounded(series.statistics(trees), stats) == rounded(growth.tree_stats(widths), stats)
    assert rounded(series.rows(spline.detrend_series(trees), "year", "rwi"), ["rwi"]) == rounded(spline.detrend_spline(widths), ["rwi"])


def test_other_windows(widths):
    trees = series.measured(series.tree_series(widths), mode="smooth", window=5, pre=3, post=6)
    index = pointer.lowpass13(widths, "smooth")
    assert rounded(series.rows(trees, "index_year", "index"), ["index"]) == rounded(index, ["index"])
    z = series.rows(trees, "index_year", "z").filter("z is not null")
    assert rounded(z, ["z"]) == rounded(pointer.growth_z(index, 5), ["z"])
    found = series.rows(trees, "index_year", *RESILIENCE)
    assert rounded(found, RESILIENCE) == rounded(resilience.resilience_tree(index, 3, 6), RESILIENCE)
    with pytest.raises(Exception, match="odd number of years"):
        series.rows(series.measured(series.tree_series(widths), window=6), "index_year", "z").collect()


def test_stored_series_need_no_shuffle(spark, widths):
    stored = series.store_series(widths)
    frames = [
        series.statistics(stored),
        series.rows(stored, "index_year", "index"),
        series.rows(stored, "index_year", "z"),
        series.rows(stored, "index_year", *RESILIENCE),
        series.rows(spline.detrend_series(stored), "year", "rwi"),
    ]
    for df in frames:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("FileScan") == 1
    scan = frames[2]._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    assert "width" not in scan and "resist" not in scan
    gathered = series.measured(series.tree_series(widths.filter("year > 0")))._jdf.queryExecution().executedPlan().toString()
    assert gathered.count("Exchange hashpartitioning") == 1


def test_no_trees(spark):
    empty = spark.createDataFrame([], "rwl string, tree string, year int, width double")
    stored = series.store_series(empty)
    assert stored.count() == series.statistics(stored).count() == 0
    assert series.rows(stored, "index_year", "z", *RESILIENCE).withColumn("x", F.lit(1)).collect() == []
