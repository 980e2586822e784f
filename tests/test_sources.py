import json

import pytest
from pyspark.sql import functions as F

from cambium import schemas
from cambium.sources import catalogue as cat
from cambium.sources import ring_text, tables


def lines_of(spark, text, site="a"):
    return spark.createDataFrame([(site, line) for line in text], "rwl string, line string")


def widths_of(df):
    return {(r["rwl"], r["tree"], r["year"]): round(r["width"], 6) for r in df.collect()}


def data(tree, year, *values, id_width=8, year_width=4):
    return tree.ljust(id_width) + str(year).rjust(year_width) + "".join(str(v).rjust(6) for v in values)


def test_hundredths_and_thousandths(spark):
    text = [
        data("T1", 1998, 100, 101),
        data("T1", 2000, 102, 0, 103, 999),
        data("T2", 2000, 1000, 999, -9999),
        data("T3", 1997, 150, 160, 999),
        data("T3", 2000, 170, 999),
    ]
    got = widths_of(ring_text.parse_ring_lines(lines_of(spark, text)))
    assert got[("a", "T1", 1998)] == 1.0 and got[("a", "T1", 2001)] == 0.0 and got[("a", "T1", 2002)] == 1.03
    assert got[("a", "T2", 2000)] == 1.0 and got[("a", "T2", 2001)] == 0.999
    # 999 in the middle of a series is a ring, at its end the stop marker
    assert got[("a", "T3", 1999)] == 9.99 and ("a", "T3", 2001) not in got
    assert len(got) == 11


def test_stop_marker_on_its_own_line(spark):
    text = [data("T1", 1990, *range(101, 111)), data("T1", 2000, 999)]
    got = widths_of(ring_text.parse_ring_lines(lines_of(spark, text)))
    assert len(got) == 10 and got[("a", "T1", 1999)] == 1.1


def test_negative_years_and_long_variant(spark):
    text = [data("T1", -12, 100, 200), data("T1", -10, 300, 999)]
    got = widths_of(ring_text.parse_ring_lines(lines_of(spark, text)))
    assert got == {("a", "T1", -12): 1.0, ("a", "T1", -11): 2.0, ("a", "T1", -10): 3.0}
    text = [data("TREE001", -1012, 100, 999, id_width=7, year_width=5)]
    long = spark.createDataFrame([("a",)], "rwl string")
    assert widths_of(ring_text.parse_ring_lines(lines_of(spark, text), long)) == {("a", "TREE001", -1012): 1.0}


def test_status_of_good_and_bad_files(spark):
    good = ["a header", "another header", "", data("T1", 1990, 100, 999)]
    frames = [
        lines_of(spark, good, "good"),
        lines_of(spark, ["not a ring file"] * 2, "text"),
        lines_of(spark, good[:2] * 3 + good[3:], "headed"),
        lines_of(spark, [*good, data("T1", 2000, 100, "1x5", 102)], "damaged"),
        lines_of(spark, [data("T1", 1990, 100, 101, 102), data("T1", 1991, 100, 999)], "overlap"),
        lines_of(spark, [data("T1", 1990, 100, 999)] * 500, "copies"),
    ]
    lines = frames[0]
    for f in frames[1:]:
        lines = lines.unionByName(f)
    rows = {r["rwl"]: r for r in ring_text.file_status(ring_text.scan_lines(lines)).collect()}
    status = {k: r["status"] for k, r in rows.items()}
    assert status == {"good": "Good", "text": "Error", "headed": "Good", "damaged": "Error", "overlap": "Error", "copies": "Error"}
    assert (rows["damaged"]["n_data"], rows["damaged"]["n_header"], rows["damaged"]["n_damaged"]) == (1, 2, 1)
    assert rows["headed"]["n_header"] == 6 and rows["copies"]["n_data"] == 500


def test_blank_fields_are_years_without_a_ring(spark):
    text = [data("T1", 1980, 101, "", 103, 104), data("T1", 1990, "", 100, 999)]
    got = widths_of(ring_text.parse_ring_lines(lines_of(spark, text)))
    assert got == {("a", "T1", 1980): 1.01, ("a", "T1", 1982): 1.03, ("a", "T1", 1983): 1.04, ("a", "T1", 1991): 1.0}


def test_text_after_data_is_damage(spark, tmp_path):
    (tmp_path / "ok.rwl").write_text("\n".join(["some header", data("T1", 1990, 100, 999)]) + "\n")
    (tmp_path / "cut.rwl").write_text("\n".join([data("T1", 1990, 100, 999), "some trailer"]) + "\n")
    _, status = ring_text.read_ring_files(spark, str(tmp_path))
    got = {r["rwl"]: (r["status"], r["n_header"], r["n_damaged"]) for r in status.collect()}
    assert got == {"ok": ("Good", 1, 0), "cut": ("Error", 0, 1)}


def test_years_before_minus_999_are_written_in_the_long_variant(spark, rings):
    widths = rings({("old", "t1"): (-1234, [1.25] * 12), ("old", "t2"): (1990, [1.0, 2.0]), ("new", "t1"): (1990, [1.25] * 3)})
    lines = ring_text.format_ring_lines(widths).select("rwl", "line")
    assert widths_of(ring_text.parse_ring_lines(lines, ring_text.long_sites(widths))) == widths_of(widths)
    with pytest.raises(Exception, match="tree id longer"):
        ring_text.format_ring_lines(rings({("a", "eight888"): (-1234, [1.0])})).collect()
    with pytest.raises(Exception, match="year longer"):
        ring_text.format_ring_lines(rings({("a", "t"): (-12345, [1.0])})).collect()
    with pytest.raises(Exception, match="width longer"):
        ring_text.format_ring_lines(rings({("a", "t"): (1990, [12345.678])})).collect()


def test_round_trip_through_files(spark, rings, tmp_path):
    widths = rings(
        {
            ("abc1", "t1"): (1995, [0.123, 1.5, 2.25, None, 0.0, 9.99, 1.0]),
            ("abc1", "t2"): (1990, [1.111] * 20),
            ("xyz", "u1"): (1990, [1.25] * 10),
            ("xyz", "u2"): (1889, [0.01, 0.02]),
        }
    )
    precision = {r["rwl"]: r["per_mm"] for r in ring_text.site_precision(widths).collect()}
    assert precision == {"abc1": 1000, "xyz": 100}
    path = str(tmp_path / "rings")
    ring_text.write_ring_files(widths, path)
    back, status = ring_text.read_ring_files(spark, path, suffix="*.txt")
    assert widths_of(back) == widths_of(widths)
    assert {r["status"] for r in status.collect()} == {"Good"}


def test_read_files_drops_broken_ones(spark, tmp_path):
    (tmp_path / "Good1.rwl").write_text(data("T1", 1990, 100, 101, 999) + "\n")
    (tmp_path / "bad1.rwl").write_text("<html>\nnot found\n</html>\n")
    (tmp_path / "notes.md").write_text("ignored")
    widths, status = ring_text.read_ring_files(spark, str(tmp_path))
    assert widths_of(widths) == {("good1", "T1", 1990): 1.0, ("good1", "T1", 1991): 1.01}
    assert {r["rwl"]: r["flag"] for r in ring_text.read_flags(status).collect()} == {"bad1": "reading rwl file failed"}
    files = {r["rwl"]: r["length"] for r in tables.file_inventory(spark, str(tmp_path)).collect()}
    assert set(files) == {"good1", "bad1"} and files["bad1"] == 25


def test_ids_too_long_for_the_format_are_refused(spark, rings):
    with pytest.raises(Exception, match="tree id longer"):
        ring_text.format_ring_lines(rings({("a", "much_too_long"): (1990, [1.0])})).collect()


def study(**changes):
    site = {
        "NOAASiteId": "7",
        "siteName": "A",
        "locationName": "Continent>Europe>Northern Europe>Norway",
        "geo": {
            "geometry": {"coordinates": ["60.0", "62.0", "10.0", "11.0"]},
            "properties": {"minElevationMeters": "n/a"},
        },
        "paleoData": [
            {
                "timeUnit": "CE",
                "species": [{"speciesCode": "PISY", "scientificName": "p"}, {"speciesCode": "PCAB", "scientificName": "q"}],
                "dataFile": [
                    {
                        "linkText": "norw1.rwl",
                        "urlDescription": "Raw Measurements",
                        "fileUrl": "u",
                        "variables": [{"cvWhat": "physical property>width>total ring width", "cvUnit": "mm"}],
                    },
                    {"linkText": "norw1-noaa.rwl", "urlDescription": "Raw Measurements", "fileUrl": "u", "variables": []},
                    {"linkText": "norw1.crn", "urlDescription": "Chronology", "fileUrl": "u", "variables": None},
                ],
            },
            {"timeUnit": "BP", "species": [{"speciesCode": "QURO", "scientificName": "r"}], "dataFile": []},
        ],
    }
    base = {
        "NOAAStudyId": "1",
        "studyName": "x - ITRDB NORW1",
        "studyCode": "NORW1",
        "contributionDate": "2001-05-04",
        "earliestYearCE": -1500,
        "mostRecentYearCE": 1990,
        "publication": [{"citation": "one"}, {"citation": "two"}],
        "site": [site, dict(site, NOAASiteId="8")],
    }
    return base | changes


@pytest.mark.parametrize("one_document", [True, False])
def test_catalogue_file(spark, tmp_path, one_document):
    studies = [study(), study(NOAAStudyId="2", studyCode=None), study(NOAAStudyId="3", studyName="other")]
    file = tmp_path / "c.json"
    if one_document:
        file.write_text(json.dumps({"study": studies}, indent=1))
    else:
        file.write_text("\n".join(json.dumps(s) for s in studies))
    sites = cat.explode_sites(cat.read_catalogue(spark, str(file), one_document))
    assert sites.count() == 6
    kept = cat.filter_catalogue(sites)
    assert {r["NOAAStudyId"] for r in kept.collect()} == {"1", "2"}
    meta = cat.site_metadata(kept).orderBy("NOAASiteId").collect()
    assert [r["NOAASiteId"] for r in meta] == ["7", "8"]
    r = meta[0]
    assert (r["country"], r["latitude"], r["longitude"], r["elevation"]) == ("Norway", 61.0, 10.5, None)
    assert (r["species_code"], r["reference"], r["contr_year"], r["rwl"]) == ("PISY, PCAB", "one; two", 2001, "norw1")
    compat = cat.site_metadata(kept, compat=True, all_data_sets=True).first()
    assert (compat["latitude"], compat["longitude"], compat["species_code"]) == (60.0, 10.0, "PISY, PCAB, QURO")
    files = cat.raw_files(kept)
    assert {r["linkText"] for r in files.collect()} == {"norw1.rwl"} and files.count() == 4
    assert [r["rwl"] for r in cat.long_sites(files).collect()] == ["norw1"]


def test_usable_files_drop_whole_studies(spark):
    files = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "c")], "NOAAStudyId string, linkText string")
    status = files.withColumn("status", F.when(F.col("linkText") == "b", "Error").otherwise("Good"))
    assert [r["linkText"] for r in cat.usable_files(files, status).collect()] == ["c"]


def test_site_filter(spark):
    rows = [("a", "PISY", "Norway", 1990), ("b", "PISY", "Norway", 2010), ("c", "PCAB", "Sweden", 1995), ("a", "PISY", "Norway", 1990)]
    meta = spark.createDataFrame(rows, "rwl string, species_code string, country string, last_year int")

    def names(**k):
        return sorted(r["rwl"] for r in cat.site_filter(meta, **k).collect())

    assert names() == ["a", "b", "c"]
    assert names(species="PISY") == ["a", "b"] and names(country="Sweden") == ["c"]
    assert names(country="Norway", min_last=1980, max_last=2000) == ["a"]


def test_csv_with_na(spark, tmp_path):
    (tmp_path / "m.csv").write_text("rwl,year,std,samp_depth\na,1990,NA,3\nb,NA,1.5,2\n")
    got = tables.read_table_csv(spark, str(tmp_path / "m.csv"), schemas.CHRONOLOGY).collect()
    assert [tuple(r) for r in got] == [("a", 1990, None, 3), ("b", None, 1.5, 2)]
    df = spark.createDataFrame([("a", None)], "rwl string, std double")
    tables.write_table(df, str(tmp_path / "out"), "csv")
    assert spark.read.text(str(tmp_path / "out")).orderBy(F.desc("value")).collect()[0][0] == "rwl,std"
    assert tables.store(df, str(tmp_path / "p")).collect() == df.collect()


def test_point_csv_casts(spark, tmp_path):
    (tmp_path / "k.csv").write_text("lon,lat,climate,main.climate,mainc.code,KG\n1.5,2,Dfb,D,4,x\n1,NA,Cfb,C,3,7\n")
    got = tables.read_point_grid_csv(spark, str(tmp_path / "k.csv")).collect()
    assert got[0]["mainc_code"] == 4.0 and got[0]["kg"] is None and got[1]["lat"] is None


def test_small_reports(spark):
    df = spark.createDataFrame([("x", 1), ("x", 3), ("y", 2)], "k string, v int")
    assert {r["k"]: r["n"] for r in tables.column_profile(df, "k").collect()} == {"x": 2, "y": 1}
    assert tuple(tables.column_range(df, "v").first()) == (1, 3)
    assert tuple(tables.filter_counts(df, df.filter("v > 1")).first()) == (3, 2)


def test_grid_tables_are_read_with_their_schema(spark, tmp_path):
    monthly = spark.createDataFrame([("pre", 1, 2, 3, 4.0)], schemas.GRID_MONTHLY)
    static = spark.createDataFrame([("slope", 1, 2, 4.0)], schemas.GRID_STATIC)
    tables.write_table(monthly, str(tmp_path / "m"))
    tables.write_table(static, str(tmp_path / "s"))
    assert tables.read_monthly_grid(spark, str(tmp_path / "m")).collect() == monthly.collect()
    assert tables.read_static_grid(spark, str(tmp_path / "s")).collect() == static.collect()


def files_read(df):
    """How many files the scans of a plan have opened, by their own metric."""
    total = 0

    def walk(node):
        nonlocal total
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            return walk(node.executedPlan())
        if node.nodeName().endswith("QueryStage"):
            return walk(node.plan())
        if node.nodeName().startswith("Scan "):
            total += node.metrics().get("numFiles").get().value()
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return total


def test_files_of_other_sites_are_not_opened(spark, tmp_path):
    for i in range(12):
        (tmp_path / f"Site{i:02d}.rwl").write_text(data("T1", 1990, 100 + i, 999) + "\n")
    lines = ring_text.read_ring_lines(spark, str(tmp_path), sites=["site03", "site07", "nowhere"])
    assert sorted(r["rwl"] for r in lines.collect()) == ["site03", "site07"]
    assert files_read(lines) == 2
    everything = ring_text.read_ring_lines(spark, str(tmp_path))
    everything.collect()
    assert files_read(everything) == 12
    widths, status = ring_text.read_ring_files(spark, str(tmp_path), sites=["site03", "site07"])
    assert widths_of(widths) == {("site03", "T1", 1990): 1.03, ("site07", "T1", 1990): 1.07}
    assert {r["rwl"] for r in status.collect()} == {"site03", "site07"}
    assert ring_text.named_sites(spark.createDataFrame([("a",), ("a",), ("b",)], "rwl string")) in (["a", "b"], ["b", "a"])


def test_a_choice_of_too_many_sites_is_not_named(spark, monkeypatch):
    monkeypatch.setattr(ring_text, "SITES_NAMED", 3)
    assert ring_text.named_sites(spark.range(4).selectExpr("string(id) AS rwl")) is None


def test_files_without_a_line_are_errors(spark, tmp_path):
    (tmp_path / "empty.rwl").write_text("\n \n")
    (tmp_path / "good.rwl").write_text(data("T1", 1990, 100, 999) + "\n")
    _, status = ring_text.read_ring_files(spark, str(tmp_path))
    assert {r["rwl"]: (r["status"], r["n_data"]) for r in status.collect()} == {"empty": ("Error", 0), "good": ("Good", 1)}


def test_a_folder_is_read_once(spark, tmp_path):
    (tmp_path / "good.rwl").write_text(data("T1", 1990, 100, 999) + "\n")
    widths, status = ring_text.read_ring_files(spark, str(tmp_path))
    for df in (widths, status):
        assert "Scan text" not in df._jdf.queryExecution().executedPlan().toString()


def test_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        tables.read_version(spark, path)
    first = spark.range(10).withColumn("x", F.col("id") * 2)
    assert tables.store(first, path).count() == 10
    broken = tables.read_version(spark, path).withColumn("x", F.when(F.col("id") == 7, F.raise_error(F.lit("stopped"))).otherwise(F.col("x")))
    with pytest.raises(Exception, match="stopped"):
        tables.store(broken, path)
    assert tables.read_version(spark, path).count() == 10
    # a rerun may read the table that it writes
    assert tables.store(tables.read_version(spark, path).filter("id < 4"), path).count() == 4
    assert tables.store(first.filter("id < 0"), path).count() == 0
    known = tables.versions(spark, path).collect()
    assert [(r["sequence"], r["n_rows"]) for r in known] == [(1, 10), (2, 4), (3, 0)]
    assert tables.read_version(spark, path, known[0]["version"]).count() == 10
    rings = spark.createDataFrame([("a", f"t{i % 3}", 1900 + i, 1.0) for i in range(9)], schemas.RING_WIDTH)
    for n in (9, 5):
        stored = tables.store_by_tree(rings.limit(n), "test_versions_rings", str(tmp_path / "b"), 2)
        assert stored.count() == tables.read_version(spark, str(tmp_path / "b")).count() == n


def test_condition_counts(spark):
    df = spark.createDataFrame([("x", 1), ("x", 3), ("y", 2), ("y", None)], "k string, v int")
    assert tuple(tables.condition_counts(df, F.col("v") > 1).first()) == (4, 2)
    assert tuple(tables.condition_counts(df, F.col("v") > 0, "k").first()) == (4, 2)


RAGGED = [
    None,
    "physical property>width>total ring width",
    7,
    {"cvWhat": "physical property>width>total ring width", "cvUnit": "mm"},
    [],
    [1, None, {"cvUnit": "mm"}, {"cvWhat": ["x"]}],
]


@pytest.mark.parametrize("one_document", [True, False])
def test_variables_of_any_shape_drop_their_file_only(spark, tmp_path, one_document):
    studies = []
    for i, variables in enumerate([*RAGGED, "missing"]):
        changed = study(NOAAStudyId=str(i), unknown={"of": i})
        first = json.loads(json.dumps(changed["site"][0]))
        file = first["paleoData"][0]["dataFile"][0]
        file.pop("variables") if variables == "missing" else file.update(variables=variables)
        changed["site"][0] = first
        studies.append(changed)
    studies += [study(NOAAStudyId=77, earliestYearCE="-12", site="none"), study(NOAAStudyId="78", site=[1, None]), 5, None]
    text = json.dumps({"study": studies, "more": 1}) if one_document else "\n".join([*[json.dumps(s) for s in studies], "{broken"])
    (tmp_path / "c.json").write_text(text)
    read = cat.read_catalogue(spark, str(tmp_path / "c.json"), one_document, tolerant=True)
    rows = {r["NOAAStudyId"]: r for r in read.selectExpr("*", "try_variant_get(study, '$.unknown.of', 'int') AS of").drop("study").collect()}
    assert rows["3"]["of"] == 3 and rows["77"]["earliestYearCE"] == -12 and rows["77"]["site"] is None
    sites = cat.explode_sites(read)
    files = cat.raw_files(sites).groupBy("NOAAStudyId").count().collect()
    # of two sites the second keeps its file; the first has lost its one raw file
    assert {r["NOAAStudyId"]: r["count"] for r in files} == {str(i): 1 for i in range(7)}
    strict = cat.explode_sites(cat.read_catalogue(spark, str(tmp_path / "good.json"))) if (tmp_path / "good.json").write_text(json.dumps({"study": [study()]})) else None
    tolerant = cat.explode_sites(cat.read_catalogue(spark, str(tmp_path / "good.json"), tolerant=True))
    for view in (cat.site_metadata, cat.raw_files):
        assert view(tolerant).collect() == view(strict).collect()
