import json

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cambium.operators import grid, growth, pointer, resilience
from cambium.plans import oracle, queries, run
from cambium.sources import catalogue, ring_text, tables


@pytest.fixture(scope="module")
def result(spark, tmp_path_factory):
    """Six sites of five trees as ring files, one broken file, small grids."""
    rng = np.random.default_rng(21)
    base = tmp_path_factory.mktemp("run")
    rings = [
        (f"site{s}", f"t{t}", 1905 + i, float(round(w, 3)))
        for s in range(6)
        for t in range(5)
        for i, w in enumerate(np.where(np.arange(75) == 40, 0.2, 1.0) + rng.random(75))
        if not (s == 5 and t == 0 and i == 30)
    ]
    widths = spark.createDataFrame(rings, "rwl string, tree string, year int, width double")
    ring_text.write_ring_files(widths, str(base / "rings"))
    (base / "rings" / "broken.txt").write_text("no rings here\n")
    read, status = ring_text.read_ring_files(spark, str(base / "rings"), suffix="*.txt")
    sites = [(f"site{s}", 1905, 1979, "X", 3.5 - (s % 2), 0.5 + (s // 2), 100.0, "PISY", "p") for s in range(6)]
    metadata = spark.createDataFrame(
        sites,
        "rwl string, first_year int, last_year int, country string, latitude double, longitude double, "
        "elevation double, species_code string, species_name string",
    )
    monthly = [
        (v, r, c, k, float(rng.normal()))
        for v in ("pre", "tmp", "tmn", "tmx", "spei")
        for r in range(2)
        for c in range(3)
        for k in range(1, 80 * 12 + 1)
    ]
    static = [(name, r, c, float(10 * r + c)) for name in grid.COVARIATE_LAYERS for r in range(2) for c in range(3)]
    geometry = grid.GridGeometry(xmin=0.0, ymax=4.0, xres=1.0, yres=1.0, nrow=4, ncol=5)
    src = run.Sources(
        widths=read,
        metadata=metadata,
        grid_monthly=spark.createDataFrame(monthly, "variable string, row int, col int, layer int, value double"),
        grid_static=spark.createDataFrame(static, "layer string, row int, col int, value double"),
        geometry=geometry,
        ecoregion_points=spark.createDataFrame([(0.5, 3.5, 1, 2.0), (0.6, 3.5, 2, 3.0)], "lon double, lat double, seq int, mainc_code double"),
        ecoregion_geometry=geometry,
        species_groups=spark.createDataFrame([("PISY", "conifer")], "species_code string, con_broad string"),
        read_flags=ring_text.read_flags(status),
    )
    conf = run.Settings(frequent_min_sites=3, replicates=20, trend_years=(1910, 1979), climate_method="correlation", box=(0.0, 5.0, 0.0, 4.0), tree_buckets=3)
    return run.run(spark, src, str(base / "out"), conf)


def test_all_final_tables_are_written(result):
    nine = {
        "site_growth_data", "site_clim_correlation", "site_spei_correlation", "site_year_chronologies",
        "site_year_resilience", "site_month_climate", "site_growth_trend", "tree_year_growth", "tree_growth_trend",
    }
    assert nine <= set(result)
    counts = {name: result[name].count() for name in nine}
    assert counts["tree_year_growth"] == 5 * 5 * 75 and counts["tree_growth_trend"] == 25
    assert counts["site_clim_correlation"] == 5 * 64 + 2 and counts["site_spei_correlation"] == 5 * 16 + 2
    assert counts["site_year_chronologies"] == 5 * 75 and counts["site_month_climate"] == 6 * 80 * 12
    assert counts["site_growth_data"] == 7


def test_failed_sites_carry_their_flags(result):
    flags = {(r["rwl"], r["flag"]) for r in result["growth_trend_flags"].collect()}
    assert flags == {("broken", "reading rwl file failed"), ("site5", "detrend failed")}
    assert result["chronology"].filter("rwl = 'site5'").count() == 0
    assert {r["flag"] for r in result["pointer_years"].filter("rwl = 'broken'").collect()} == {"reading rwl file failed"}
    assert {r["flag"] for r in result["site_year_resilience"].filter("rwl = 'broken'").collect()} == {"reading rwl file failed"}


def test_the_common_dip_is_found_everywhere(result):
    dips = result["pointer_years"].filter("pointer_year = 1945")
    assert {r["rwl"] for r in dips.collect()} >= {f"site{s}" for s in range(5)}
    year = result["site_year_resilience"].filter("pointer_year = 1945").collect()
    assert len(year) >= 5 and all(r["resistance"] < 0.8 and r["resistance_series"] >= 4 for r in year)


def test_covariates_and_groups_are_attached(result):
    meta = {r["rwl"]: r for r in result["site_metadata"].collect()}
    assert meta["site3"]["soil_ph"] == 11.0 and meta["site0"]["ecoregion"] == 3.0
    assert meta["site1"]["ecoregion"] is None and meta["site0"]["con_broad"] == "conifer"


def test_bucketed_rings_need_no_shuffle(result):
    for df in (
        growth.tree_stats(result["ring_width"]),
        pointer.growth_z(result["lowpass_index"]),
        resilience.resilience_tree(result["lowpass_index"]),
        growth.relative_widths(result["ring_width"]),
    ):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_a_plain_run_writes_folders(spark, rings, tmp_path):
    widths = rings({("a", f"t{k}"): (1950, [1.0 + (i * 7 + k * 3) % 5 for i in range(45)]) for k in range(3)})
    metadata = spark.createDataFrame(
        [("a", "X", 1.0, 2.0, "PISY")], "rwl string, country string, latitude double, longitude double, species_code string"
    )
    out = run.run(spark, run.Sources(widths, metadata, sites=metadata), str(tmp_path / "out"), run.Settings(csv=True))
    assert spark.read.csv(str(tmp_path / "out" / "site_growth_data_csv"), header=True).count() == 1
    assert "climate_coefs" not in out and out["tree_year_growth"].count() == 135
    assert spark.read.parquet(str(tmp_path / "out" / "ring_width")).count() == 135


def catalogue_of(names, missing=()):
    """A search response with a study per pair of names, each a site with one raw file per name."""
    studies = []
    for i, pair in enumerate(names):
        files = [
            {"linkText": f"{n.upper()}.rwl", "urlDescription": "Raw Measurements", "fileUrl": "u", "variables": [{"cvWhat": "physical property>width>total ring width", "cvUnit": "mm"}]}
            for n in pair
        ]
        files.append({"linkText": "notes.txt", "urlDescription": "Notes", "fileUrl": "u", "variables": "none"})
        site = {
            "NOAASiteId": str(i), "siteName": pair[0], "locationName": "Continent>Europe>Northern Europe>Norway",
            "geo": {"geometry": {"coordinates": [60 + i, 10.5]}, "properties": {"minElevationMeters": 100}},
            "paleoData": [{"timeUnit": "CE", "species": [{"speciesCode": "PISY", "scientificName": "p"}], "dataFile": files}],
        }
        studies.append({
            "NOAAStudyId": str(i), "studyName": "x - ITRDB", "studyCode": pair[0].upper(), "contributionDate": "2001-05-04",
            "earliestYearCE": -1500 if pair[0] == "old" else 1900, "mostRecentYearCE": 1990, "publication": [], "site": [site],
        })
    return json.dumps({"study": studies})


def test_from_a_catalogue_to_the_final_tables(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = [(site, f"t{t}", first + i, float(round(w, 3))) for site, first in (("aa", 1900), ("old", -1500), ("bad2", 1900), ("other", 1900)) for t in range(4) for i, w in enumerate(rng.random(60) + 0.5)]
    widths = spark.createDataFrame(rows, "rwl string, tree string, year int, width double")
    ring_text.write_ring_files(widths, str(tmp_path / "made"))
    (tmp_path / "files").mkdir()
    for site in ("aa", "old", "bad2", "other"):
        text = "".join(p.read_text() for p in sorted((tmp_path / "made" / f"rwl={site}").glob("part-*")))
        (tmp_path / "files" / f"{site}.rwl").write_text(text)
    (tmp_path / "files" / "bad1.rwl").write_text("<html>\n")
    (tmp_path / "c.json").write_text(catalogue_of([("aa",), ("old",), ("bad1", "bad2"), ("gone",)]))
    studies = catalogue.read_catalogue(spark, str(tmp_path / "c.json"), tolerant=True)
    src = run.Sources(studies=studies, rings=str(tmp_path / "files"))
    conf = run.Settings(csv=True)
    out = run.run(spark, src, str(tmp_path / "out"), conf)
    assert {r["linkText"]: r["status"] for r in out["file_checks"].collect()} == {"AA.rwl": "Good", "OLD.rwl": "Good", "BAD1.rwl": "Error", "BAD2.rwl": "Good", "GONE.rwl": "Error"}
    # a study with a file that cannot be read goes as a whole; files that no study lists are not read
    want = {(s, t, y): w for s, t, y, w in rows if s in ("aa", "old")}
    assert {(r["rwl"], r["tree"], r["year"]): round(r["width"], 6) for r in out["ring_width"].collect()} == want
    assert spark.read.csv(str(tmp_path / "out" / "raw_files_csv"), header=True).count() == 5
    assert spark.read.csv(str(tmp_path / "out" / "site_catalogue_csv"), header=True).count() == 4
    again, _ = ring_text.read_ring_files(spark, str(tmp_path / "out" / "rings"), spark.createDataFrame([("old",)], "rwl string"), "*.txt")
    assert {(r["rwl"], r["tree"], r["year"]): round(r["width"], 6) for r in again.collect()} == want
    nine = {"site_growth_data", "site_year_chronologies", "site_year_resilience", "site_growth_trend", "tree_year_growth", "tree_growth_trend"}
    assert nine <= set(out) and out["tree_year_growth"].count() == 480
    assert {r["flag"] for r in out["tree_age"].filter("rwl = 'bad1'").collect()} == {"reading rwl file failed"}
    # a run that fails leaves the tables of the run before, and the next may start from those
    broken = run.Sources(widths=out["ring_width"].withColumn("width", F.raise_error(F.lit("stopped")).cast("double")), metadata=src.metadata)
    with pytest.raises(Exception, match="stopped"):
        run.run(spark, broken, str(tmp_path / "out"), conf)
    kept = tables.read_version(spark, str(tmp_path / "out" / "ring_width"))
    assert kept.count() == 480
    sites = catalogue.analysis_metadata(out["site_catalogue"])
    rerun = run.run(spark, run.Sources(widths=kept.filter("rwl = 'aa'"), metadata=sites), str(tmp_path / "out"), run.Settings())
    assert rerun["ring_width"].count() == 240 and tables.versions(spark, str(tmp_path / "out" / "ring_width")).count() == 2


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(queries.QUERIES) <= set(entry.queries())
    assert set(queries.QUERIES) - set(oracle.oracle_sql()) == {"climate_response"}


def test_entry_runs(spark):
    rows = entry.entry(spark).collect()
    assert rows and {"rwl", "tree", "ar1", "rwl_meanage"} <= set(rows[0].asDict())
