import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cambium.functions import months
from cambium.operators import climate, grid
from cambium.sources import tables

GEO = grid.GridGeometry(xmin=0.0, ymax=4.0, xres=1.0, yres=1.0, nrow=4, ncol=5)


def by(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


@pytest.fixture
def plane(spark):
    """value = 10 * row + col on the grid above, one layer."""
    rows = [("a", r, c, 10.0 * r + c) for r in range(4) for c in range(5)]
    return spark.createDataFrame(rows, "layer string, row int, col int, value double")


def test_cell_centres_get_their_own_value(spark, plane):
    points = spark.createDataFrame(
        [(f"p{r}{c}", c + 0.5, 3.5 - r) for r in range(4) for c in range(5)], "rwl string, longitude double, latitude double"
    )
    got = by(grid.sample_grid(points, plane, GEO), "rwl")
    assert len(got) == 20 and all(r["value"] == 10.0 * r["row"] + r["col"] for r in got.values())
    assert got[("p23",)]["value"] == 23.0


def test_edges_and_outside(spark, plane):
    rows = [("corner", 5.0, 0.0), ("origin", 0.0, 4.0), ("west", -0.1, 2.0), ("north", 1.0, 4.1), ("none", None, 1.0)]
    points = spark.createDataFrame(rows, "rwl string, longitude double, latitude double")
    got = by(grid.sample_grid(points, plane, GEO), "rwl")
    assert {k[0]: r["value"] for k, r in got.items()} == {"corner": 34.0, "origin": 0.0, "west": None, "north": None, "none": None}
    assert got[("west",)]["row"] is None and got[("corner",)]["col"] == 4
    gap = by(grid.sample_grid(points, plane.filter("row = 0").unionByName(plane.filter("row = 3").withColumn("layer", F.lit("b"))), GEO), "rwl", "layer")
    assert len(gap) == 10 and gap[("corner", "a")]["value"] is None and gap[("corner", "b")]["value"] == 34.0
    wide = grid.site_covariates(points, plane, GEO, ["a", "b"])
    kept = by(wide, "rwl")
    assert len(kept) == 5 and kept[("west",)]["a"] is None and kept[("corner",)]["b"] is None


def test_a_crowded_cell_keeps_all_its_points(spark, plane):
    points = spark.range(500).selectExpr("concat('p', id) as rwl", "0.5D as longitude", "3.5D as latitude")
    got = grid.sample_grid(points, plane, GEO, points_per_salt=20)
    assert got.count() == 500 and got.select("rwl").distinct().count() == 500
    assert got.filter("value <> 0").count() == 0


def test_no_layer_is_joined_or_lost(spark):
    """Cells without some layers, cells without points, points without cells, and a variable that no point has."""
    rng = np.random.default_rng(2)
    rows = [(v, r, c, k, float(rng.normal())) for v in ("pre", "tmp") for r in range(4) for c in range(5) for k in range(1, 13) if rng.random() < 0.6]
    rows += [("far", 0, 0, 99, 1.0), ("pre", 1, 1, 7, None), ("pre", 1, 1, 7, 5.0)]
    cells = spark.createDataFrame(rows, "variable string, row int, col int, layer int, value double")
    spots = [(f"p{i:02d}", float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0.5, 6.0, (30, 2)))] + [("none", None, None)]
    points = spark.createDataFrame(spots, "rwl string, longitude double, latitude double")
    inside = {p: (int(4.0 - y), int(x)) for p, x, y in spots if x is not None and x <= 5.0 and y <= 4.0}
    layers = {(v, k) for v, _, _, k, _ in rows}
    want = []
    for p, _, _ in spots:
        for v, k in layers:
            own = [z for w, r, c, m, z in rows if (w, m) == (v, k) and (r, c) == inside.get(p)]
            want += [(p, v, k, z) for z in own or [None]]
    packed = grid.pack_grid(cells)
    unfolded = grid.unfold_series(grid.sample_series(points, packed, GEO, points_per_salt=2), grid.series_layers(packed))
    for got in (grid.sample_grid(points, cells, GEO, points_per_salt=2), unfolded):
        found = sorted((tuple(r) for r in got.select("rwl", "variable", "layer", "value").collect()), key=repr)
        assert found == sorted(want, key=repr)
        joins = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
        assert joins and not any("layer" in line for line in joins)


def test_months_from_series(spark):
    """Series of sites beside one another, with gaps, a site outside, layers that only one variable has, and values that are no numbers."""
    rng = np.random.default_rng(6)
    rows = [(v, r, c, k, float(rng.normal())) for v in ("tmp", "pre", "spei") for r in range(2) for c in range(2) for k in range(1, 31) if rng.random() < 0.7]
    rows += [("pre", 0, 0, 40, float("nan")), ("tmp", 0, 0, 50, 1.0), ("pre", 1, 1, 31, 2.0), ("pre", 1, 1, 31, 5.0)]
    cells = spark.createDataFrame(rows, "variable string, row int, col int, layer int, value double")
    points = spark.createDataFrame([(f"p{i}", 0.5 + i % 3, 3.5 - i // 3 % 2) for i in range(7)] + [("none", None, None)], "rwl string, longitude double, latitude double")
    samples, layers = grid.sample_series(points, grid.pack_grid(cells), GEO), grid.grid_layers(cells)
    for variables in (["pre", "tmp"], ["pre", "spei"], ["spei"], ["tmp", "none"]):
        got = climate.climate_from_series(samples, layers, variables)
        want = climate.climate_long(grid.layer_to_month(grid.sample_grid(points, cells, GEO).drop("row", "col")), variables)
        assert got.columns == want.columns
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_months_from_series_that_were_sampled_together(spark):
    """The same months without a shuffle or a sort of the series: the variables of a site never part."""
    rng = np.random.default_rng(7)
    rows = [(v, r, c, k, float(rng.normal())) for v in ("tmp", "pre", "spei") for r in range(2) for c in range(2) for k in range(1, 31) if rng.random() < 0.7]
    rows += [("pre", 0, 0, 40, float("nan")), ("tmp", 0, 0, 50, 1.0), ("pre", 1, 1, 31, 2.0), ("pre", 1, 1, 31, 5.0)]
    cells = spark.createDataFrame(rows, "variable string, row int, col int, layer int, value double")
    points = spark.createDataFrame([(f"p{i}", 0.5 + i % 3, 3.5 - i // 3 % 2) for i in range(7)] + [("none", None, None)], "rwl string, longitude double, latitude double")
    packed, layers = grid.pack_grid(cells), grid.grid_layers(cells)
    samples = grid.sample_series(points, packed, GEO, together=True)
    assert samples.count() == 8 and samples.filter("size(variables) <> 3").count() == 0
    single = grid.sample_series(points, packed, GEO)
    assert sorted(map(repr, samples.selectExpr("rwl", "row", "col", "inline(variables)").collect())) == sorted(map(repr, single.collect()))
    for variables in (["pre", "tmp"], ["pre", "spei"], ["spei"], ["tmp", "none"]):
        got = climate.climate_from_series(samples, layers, variables)
        want = climate.climate_from_series(single, layers, variables)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan


def test_points_are_dealt_over_all_shuffle_partitions(spark, tmp_path):
    """A short file of points, read by one task, meets its series in as many tasks as there are shuffle partitions."""
    cells = spark.range(20 * 12).selectExpr("'pre' AS variable", "int(id div 12 div 5) AS row", "int(id div 12 % 5) AS col", "int(id % 12 + 1) AS layer", "double(id) AS value")
    spark.range(2000).selectExpr("concat('p', id) AS rwl", "0.5D + id % 5 AS longitude", "0.5D + id div 5 % 4 AS latitude").coalesce(1).write.parquet(str(tmp_path / "p"))
    cells.groupBy("row", "col", "variable").agg(F.sort_array(F.collect_list(F.struct("layer", "value"))).alias("series")).coalesce(1).write.parquet(str(tmp_path / "g"))
    points, packed = spark.read.parquet(str(tmp_path / "p")), spark.read.parquet(str(tmp_path / "g"))
    assert points.rdd.getNumPartitions() == 1
    rows = grid.unfold_series(grid.sample_series(points, packed, GEO), grid.series_layers(packed))
    per_task = rows.groupBy(F.spark_partition_id().alias("task")).agg(F.count("value").alias("n")).collect()
    assert sum(r["n"] for r in per_task) == 24_000
    assert len(per_task) > 1 and max(r["n"] for r in per_task) < 24_000 * 0.75


def test_a_box_of_a_stored_grid_skips_files_and_row_groups(spark, tmp_path):
    cells = spark.range(128 * 128).selectExpr("'pre' AS variable", "int(id div 128) AS row", "int(id % 128) AS col", "int(1) AS layer", "double(id) AS value")
    wide = grid.GridGeometry(xmin=0.0, ymax=128.0, xres=1.0, yres=1.0, nrow=128, ncol=128)
    stored = tables.store_grid(grid.pack_grid(cells), str(tmp_path / "g"), files=4, row_group_bytes=1 << 13)
    box = grid.crop(stored, wide, (70.0, 90.0, 20.0, 40.0))
    assert box.count() == 400
    groups = touched = 0
    for path in (tmp_path / "g").rglob("part-*.parquet"):
        meta = pq.ParquetFile(path).metadata
        for i in range(meta.num_row_groups):
            spans = {meta.row_group(i).column(j).path_in_schema: meta.row_group(i).column(j).statistics for j in range(3)}
            groups += 1
            touched += spans["row"].max >= 88 and spans["row"].min <= 107 and spans["col"].max >= 70 and spans["col"].min <= 89
    assert groups > 10 and 0 < touched < groups / 3
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        plan = grid.crop(stored, wide, (70.0, 90.0, 20.0, 40.0))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan.split("PushedFilters:")[1]
    assert "GreaterThanOrEqual(row,88)" in pushed and "LessThanOrEqual(col,89)" in pushed


@pytest.mark.parametrize("side", [1, 3, 4, 128])
def test_tiles_of_any_side_give_the_same(spark, side):
    rng = np.random.default_rng(side)
    source = grid.GridGeometry(xmin=-3.0, ymax=9.0, xres=1.5, yres=1.0, nrow=9, ncol=7)
    target = grid.GridGeometry(xmin=-4.0, ymax=10.0, xres=0.7, yres=0.45, nrow=24, ncol=20)
    known = {(k, r, c): float(rng.normal()) for k in "ab" for r in range(9) for c in range(7) if rng.random() < 0.8}
    cells = spark.createDataFrame([(*k, v) for k, v in known.items()] + [("a", 0, 0, None), ("a", None, 1, 2.0)], "layer string, row int, col int, value double")
    got = {(r["layer"], r["row"], r["col"]): r["value"] for r in grid.resample_bilinear(cells, source, target, side=side).collect()}
    want = {}
    for k in "ab":
        for i in range(24):
            for j in range(20):
                y = min(max((9.0 - (10.0 - (i + 0.5) * 0.45)) / 1.0 - 0.5, 0.0), 8.0)
                x = min(max((-4.0 + (j + 0.5) * 0.7 + 3.0) / 1.5 - 0.5, 0.0), 6.0)
                y0, x0 = min(int(y), 7), min(int(x), 5)
                near = [((k, y0 + a, x0 + b), (y - y0 if a else 1 - y + y0) * (x - x0 if b else 1 - x + x0)) for a in (0, 1) for b in (0, 1)]
                near = [(known[c], w) for c, w in near if w > 0 and c in known]
                if near:
                    want[k, i, j] = sum(v * w for v, w in near) / sum(w for _, w in near)
    assert got.keys() == want.keys() and all(got[c] == pytest.approx(want[c]) for c in want)


def test_crop_by_cell_centre(plane):
    cells = {(r["row"], r["col"]) for r in grid.crop(plane, GEO, (1.0, 3.0, 0.0, 1.5)).collect()}
    assert cells == {(2, 1), (2, 2), (3, 1), (3, 2)}
    assert grid.crop(plane, GEO, (90.0, 91.0, 0.0, 1.0)).count() == 0


def test_crop_reaches_the_scan(spark, plane, tmp_path):
    plane.write.parquet(str(tmp_path / "g"))
    cropped = grid.crop(spark.read.parquet(str(tmp_path / "g")), GEO, (1.0, 3.0, 0.0, 1.5))
    plan = cropped._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(row,2)" in plan


def test_last_point_wins(spark):
    rows = [(0.2, 3.9, 1, 7.0), (0.8, 3.1, 5, 8.0), (0.5, 3.5, 3, 9.0), (9.0, 9.0, 9, 1.0)]
    points = spark.createDataFrame(rows, "lon double, lat double, seq int, v double")
    got = grid.rasterize_last(points, GEO, "v", "seq").collect()
    assert [(r["row"], r["col"], r["value"]) for r in got] == [(0, 0, 8.0)]


def test_bilinear_of_a_plane_is_exact(plane):
    fine = grid.GridGeometry(xmin=0.0, ymax=4.0, xres=0.25, yres=0.25, nrow=16, ncol=20)
    got = by(grid.resample_bilinear(plane, GEO, fine), "row", "col")
    assert len(got) == 320
    for (r, c), row in got.items():
        y = min(max((r + 0.5) / 4 - 0.5, 0), 3)
        x = min(max((c + 0.5) / 4 - 0.5, 0), 4)
        assert row["value"] == pytest.approx(10 * y + x)


def test_bilinear_rescales_missing_neighbours(plane):
    holes = plane.withColumn("value", F.when(F.col("col") % 2 == 0, 1.0))
    shifted = grid.GridGeometry(xmin=0.5, ymax=4.0, xres=1.0, yres=1.0, nrow=4, ncol=4)
    assert {r["value"] for r in grid.resample_bilinear(holes, GEO, shifted).collect()} == {1.0}


def test_distinct_points_take_the_smallest_name(spark):
    rows = [("b", 1.0, 2.0), ("a", 1.0, 2.0), ("c", 1.0, 3.0)]
    sites = spark.createDataFrame(rows, "rwl string, longitude double, latitude double")
    assert sorted(r["rwl"] for r in grid.distinct_points(sites).collect()) == ["a", "c"]


def test_layers_wide_and_long(spark):
    rows = [("s", "pre", k, float(k)) for k in range(1, 15)] + [("s", "spei", k, float(k)) for k in range(1, 15)]
    samples = spark.createDataFrame(rows, "rwl string, variable string, layer int, value double")
    dated = grid.layer_to_month(samples)
    spei = dated.filter("variable = 'spei'").collect()
    assert sorted((r["year"], r["month"]) for r in spei) == [(1902, 1), (1902, 2)]
    assert dated.filter("variable = 'pre'").count() == 14
    wide = grid.climate_wide(samples, "pre", range(1, 15))
    assert wide.columns[:3] == ["rwl", "1901_Jan", "1901_Feb"] and wide.columns[-1] == "1902_Feb"
    long = by(grid.wide_to_long(wide, "pre"), "year", "month")
    assert long[(1902, "Feb")]["pre"] == 14.0 and len(long) == 14
    joined = climate.climate_long(dated, ["pre", "spei"])
    got = by(joined, "year", "month")
    assert got[(1901, 3)]["spei"] is None and got[(1902, 1)]["spei"] == 13.0


@pytest.fixture
def gappy(spark):
    """Points and a grid with gaps, whole series, a site outside, two points of one site, and layers that nobody asks for."""
    rng = np.random.default_rng(9)
    rows = [(v, r, c, k, float(rng.normal())) for v in ("pre", "tmp") for r in range(2) for c in range(2) for k in range(1, 15) if c == 0 or rng.random() < 0.6]
    rows += [("pre", 1, 1, 40, 1.0), ("far", 0, 0, 50, 1.0), ("pre", 0, 1, 3, None)]
    cells = spark.createDataFrame(rows, "variable string, row int, col int, layer int, value double")
    spots = [(f"p{i}", 0.5 + i % 2, 3.5 - i // 2 % 2) for i in range(6)] + [("out", 9.0, 9.0), ("none", None, None), ("p5", 1.5, 3.5)]
    points = spark.createDataFrame(spots, "rwl string, longitude double, latitude double")
    return points, cells


def test_wide_from_series(gappy):
    """A row per site out of series that are laid out where they are: layers take part in no shuffle."""
    points, cells = gappy
    whole = grid.sample_grid(points, cells, GEO, unfold=False)
    single = grid.sample_grid(points, cells, GEO)
    assert sorted(map(repr, whole.selectExpr("rwl", "row", "col", "variable", "inline(series)").collect())) == sorted(map(repr, single.collect()))
    for variable, layers in (("pre", range(1, 15)), ("pre", range(0, 42)), ("tmp", [5, 2]), ("far", range(1, 15)), ("lost", [1])):
        got, want = grid.climate_wide(whole, variable, layers), grid.climate_wide(single, variable, layers)
        values = {(r["rwl"], r["layer"]): r["value"] for r in single.filter(f"variable = '{variable}'").collect() if r["layer"] in layers}
        rows = by(got, "rwl")
        assert got.columns == want.columns == ["rwl", *grid.labels_of(layers)]
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
        assert rows.keys() == {(s,) for s, _ in values}
        assert all(r[label] == values.get((s, k)) for (s,), r in rows.items() for k, label in zip(layers, grid.labels_of(layers)))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "pivotfirst" not in plan and "Aggregate [rwl" in plan


def test_wide_from_series_and_back(gappy):
    points, cells = gappy
    layers = range(1, 15)
    wide = grid.climate_wide(grid.sample_grid(points, cells, GEO, unfold=False), "pre", layers)
    got = {(r["rwl"], r["year"], r["month"]): r["pre"] for r in grid.wide_to_long(wide, "pre").collect()}
    labels = dict(zip(layers, (label.split("_") for label in grid.labels_of(layers))))
    single = grid.sample_grid(points, cells, GEO).filter("variable = 'pre' AND layer <= 14").collect()
    assert got == {(r["rwl"], int(labels[r["layer"]][0]), labels[r["layer"]][1]): r["value"] for r in single}
    assert len(got) == 8 * 14


def test_month_functions(spark):
    df = spark.createDataFrame([("Jan", 1), ("Dec", 12), ("xx", 13)], "m string, k int")
    got = df.select(months.month_number(F.col("m")), months.layer_label(F.col("k"))).collect()
    assert [tuple(r) for r in got] == [(1, "1901_Jan"), (12, "1901_Dec"), (None, "1902_Jan")]
    assert [r[1] for r in months.window_labels()] == (
        "Jun Jul Aug Sep Oct Nov Dec JAN FEB MAR APR MAY JUN JUL AUG SEP".split()
    )


@pytest.fixture
def season(spark):
    """40 years of two variables; growth follows the June of the previous year."""
    rng = np.random.default_rng(8)
    values = rng.normal(size=(41, 12, 2))
    clim = [("s", 1950 + y, m + 1, float(values[y, m, 0]), float(values[y, m, 1])) for y in range(41) for m in range(12)]
    std = [("s", 1950 + y, float(values[y - 1, 5, 0] + 0.1 * rng.normal())) for y in range(1, 41)]
    return (
        spark.createDataFrame(std, "rwl string, year int, std double"),
        spark.createDataFrame(clim, "rwl string, year int, month int, pre double, tmp double"),
    )


def test_lagged_months(season):
    _, clim = season
    lagged = climate.lagged_months(clim, ["pre", "tmp"])
    assert lagged.filter("year = 1960").count() == 32
    june = lagged.filter("year = 1960 AND month = 'Jun' AND varname = 'pre'").collect()[0]["value"]
    assert june == clim.filter("year = 1959 AND month = 6").collect()[0]["pre"]
    assert lagged.filter("month = 'Oct'").select("is_prev").distinct().collect()[0][0] is True


@pytest.mark.parametrize("method", ["correlation", "response"])
def test_the_driving_month_is_found(season, method):
    chron, clim = season
    coefs = climate.climate_coef(chron, clim, ["pre", "tmp"], method=method, replicates=60)
    got = by(coefs, "varname", "month")
    assert len(got) == 32
    best = max(got.values(), key=lambda r: abs(r["coef"]))
    assert (best["varname"], best["month"], best["window"], best["id"]) == ("pre", "Jun", "pre.prev.jun", 1)
    assert best["significant"] and best["ci_lower"] > 0


def test_correlation_matches_numpy(season):
    chron, clim = season
    got = by(climate.climate_coef(chron, clim, ["pre", "tmp"], threshold=0.3), "varname", "month")
    x = {r["year"]: r["tmp"] for r in clim.filter("month = 3").collect()}
    y = {r["year"]: r["std"] for r in chron.collect()}
    expected = np.corrcoef([x[t] for t in y], list(y.values()))[0, 1]
    r = got[("tmp", "MAR")]
    assert r["coef"] == pytest.approx(expected) and r["significant"] == (abs(expected) >= 0.3)


def test_degenerate_climate_gives_null(season):
    chron, clim = season
    flat = clim.withColumn("pre", F.lit(1.0))
    got = climate.climate_coef(chron, flat, ["pre"], replicates=20).collect()
    assert len(got) == 16 and all(r["coef"] is None and r["ci_lower"] is None for r in got)


def test_bootstrap_repeats_and_ignores_partitions(season):
    chron, clim = season

    def limits(c, m, seed=1):
        coefs = climate.climate_coef(c, m, ["pre"], replicates=30, seed=seed).orderBy("id").collect()
        return [(round(r["coef"], 12), round(r["ci_lower"], 12), round(r["ci_upper"], 12)) for r in coefs]

    first = limits(chron, clim)
    assert first == limits(chron.repartition(7), clim.repartition(3))
    assert first != limits(chron, clim, seed=2)


@pytest.mark.parametrize("n, k", [(60, 5), (40, 20), (30, 40)])
def test_response_against_singular_values(n, k):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, k)) @ rng.normal(size=(k, k))
    y = x[:, 0] + rng.normal(size=n)
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    g = (y - y.mean()) / y.std(ddof=1)
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    values = s**2 / (n - 1)
    kept = next((i for i in range(len(values)) if np.prod(values[: i + 1]) <= 1.0), len(values))
    kept = max(1, min(kept, n - 2))
    expected = vt[:kept].T @ ((vt[:kept] @ (z.T @ g)) / s[:kept] ** 2)
    assert climate.response_coefficients(x, y) == pytest.approx(expected)


def test_response_without_variance_is_missing():
    assert np.isnan(climate.response_coefficients(np.ones((9, 2)), np.ones(9))).all()
    rng = np.random.default_rng(1)
    x = np.column_stack([rng.normal(size=20), np.ones(20)])
    beta = climate.response_coefficients(x, x[:, 0] * 2 + 1)
    assert beta[0] == pytest.approx(1.0) and np.isnan(beta[1])


def test_blocks_keep_neighbouring_years_together():
    free = climate.resample_draws(3, "s", 200, 50)
    blocks = climate.resample_draws(3, "s", 200, 50, 10.0)
    assert free.min() >= 0 and free.max() < 50 and blocks.max() < 50

    def follows(d):
        return np.mean((d[:, 1:] - d[:, :-1]) % 50 == 1)

    assert follows(free) < 0.05 and follows(blocks) == pytest.approx(0.9, abs=0.02)


def test_sites_draw_independently():
    a, b = (climate.resample_draws(3, site, 400, 50) for site in ("a", "b"))
    assert (a == climate.resample_draws(3, "a", 400, 50)).all() and (a != climate.resample_draws(4, "a", 400, 50)).any()
    assert np.mean(a == b) == pytest.approx(1 / 50, abs=0.005)
    assert np.bincount(a.ravel(), minlength=50) == pytest.approx(np.full(50, 400), rel=0.25)
    # positions, replicates and sites are uncorrelated
    for x, y in ((a[:, 0], a[:, 1]), (a[:-1].ravel(), a[1:].ravel()), (a.ravel(), b.ravel())):
        assert abs(np.corrcoef(x, y)[0, 1]) < 0.15 if len(x) < 1000 else abs(np.corrcoef(x, y)[0, 1]) < 0.03


def test_stacked_responses_equal_single_ones(monkeypatch):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(30, 12)), rng.normal(size=30)
    x[:, 3] = np.arange(30) == 7  # without variance in the samples that miss this year
    y[:25] = 1.0
    draws = np.concatenate([climate.resample_draws(1, "s", 40, 30), np.zeros((1, 30), int)])
    monkeypatch.setattr(climate, "STACK_BYTES", 5 * x.nbytes)
    for every in (False, True):
        got = climate.response_samples(x, y, draws, every)
        want = np.array([climate.response_coefficients(x[d], y[d], every) for d in draws])
        assert np.allclose(got, want, equal_nan=True) and np.isnan(got[-1]).all() and 0 < np.isnan(got[:-1, 3]).sum() < 40


def test_all_components_are_least_squares():
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(50, 9)) @ rng.normal(size=(9, 9)), rng.normal(size=50)
    z, g = (x - x.mean(0)) / x.std(0, ddof=1), (y - y.mean()) / y.std(ddof=1)
    assert climate.response_coefficients(x, y, every=True) == pytest.approx(np.linalg.lstsq(z, g, rcond=None)[0])


def test_too_short_sites_have_no_response(season):
    chron, clim = season
    short = chron.filter("year < 1953")
    few = climate.climate_coef(short, clim, ["pre"], method="response", replicates=5)
    assert few.count() == 0
    flags = climate.response_flags(short, climate.lagged_months(clim, ["pre"])).collect()
    assert [tuple(r) for r in flags] == [("s", 2, climate.FLAG_FEW_YEARS)]
    enough = chron.filter("year < 1956")
    assert climate.climate_coef(enough, clim, ["pre"], method="response", replicates=5).count() == 16
    assert climate.response_flags(enough, climate.lagged_months(clim, ["pre"])).count() == 0


def test_signature_and_significance(spark):
    rows = [("a", "pre", "Jun", 1, 0.4, True), ("b", "pre", "Jun", 1, 0.2, False), ("c", "pre", "Jun", 1, None, None)]
    coefs = spark.createDataFrame(rows, "rwl string, varname string, month string, month_order int, coef double, significant boolean")
    r = climate.signature(coefs).collect()[0]
    assert r["mean_coef"] == pytest.approx(0.3) and r["prop_sig"] == 0.5 and r["mark_sig"]
    yes, no = climate.split_by_significance(coefs)
    assert yes.count() == 1 and no.count() == 1


@pytest.fixture
def placed(spark):
    rows = [("a", "Jun", 1, 0.5, True), ("a", "SEP", 16, -0.5, False), ("a", "JAN", 8, 0.1, None), ("b", "Jun", 1, None, None)]
    rows += [(f"x{i}", "MAR", 10, float(v), True) for i, v in enumerate([1, 2, 3, 4, 100])]
    df = spark.createDataFrame(rows, "rwl string, spei_month string, month_order int, spei_coef double, spei_significant boolean")
    return df.withColumns({"latitude": F.lit(1.0), "longitude": F.lit(2.0)})


def test_spei_summaries(placed):
    mean = by(climate.spei_mean_map(placed), "rwl")
    assert mean[("a",)]["n_months"] == 3 and mean[("b",)]["mean_coef"] is None
    best = by(climate.strongest_month(placed), "rwl")
    assert (best[("a",)]["spei_month"], best[("a",)]["cor_sign"]) == ("Jun", "Positive")
    assert best[("b",)]["cor_sign"] is None
    sig = by(climate.significant_by_month(placed), "spei_month")
    assert (sig[("Jun",)]["n_sig"], sig[("Jun",)]["n_total"], sig[("JAN",)]["prop_sig"]) == (1, 1, None)


@pytest.mark.parametrize("max_group", [50_000, 3])
def test_box_numbers(placed, max_group):
    got = by(climate.month_distribution(placed, max_group), "spei_month")
    r = got[("MAR",)]
    assert (r["n"], r["q1"], r["q2"], r["q3"]) == (5, 2.0, 3.0, 4.0)
    assert (r["whisker_low"], r["whisker_high"], r["n_outliers"]) == (1.0, 4.0, 1)
    assert [r["rwl"] for r in climate.month_outliers(placed, max_group).collect()] == ["x4"]


def test_sites_without_coordinates_are_dropped(spark, placed):
    meta = spark.createDataFrame([("a", 1.0, 2.0), ("b", None, 2.0)], "rwl string, latitude double, longitude double")
    spei = placed.drop("latitude", "longitude")
    assert {r["rwl"] for r in climate.with_coordinates(spei, meta).collect()} == {"a"}
