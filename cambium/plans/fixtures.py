"""Analysis inputs derived from the star-schema tables of a data folder.

A calendar month of ``l_shipdate`` plays one growth year, the supplier's nation
is the site and the supplier the tree; grids and points come from the line
items and customers.  Every view grows with the tables it reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cambium.operators.grid import COVARIATE_LAYERS, GridGeometry

# Half-degree grid over the study window: 80 rows, 90 columns.
GRID = GridGeometry(xmin=-10.0, ymax=75.0, xres=0.5, yres=0.5, nrow=80, ncol=90)
# Target of the resampling query: quarter of a degree, same window.
# Every layer that the monthly grid can have: the months of 1992 to 1998.
LAYERS = range(-35, 49)
FINE_GRID = GridGeometry(xmin=-10.0, ymax=75.0, xres=0.25, yres=0.25, nrow=160, ncol=180)


# Schemas of the tables read here, so that no job has to infer them.
TABLES = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
    "l_shipdate TIMESTAMP_NTZ",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def _site(key: str) -> Column:
    return F.concat(F.lit("s"), F.lpad(F.col(key).cast("string"), 2, "0"))


def _growth_year() -> Column:
    return (1900 + (F.year("l_shipdate") - 1992) * 12 + F.month("l_shipdate")).cast("int")


def _tree() -> Column:
    key = F.col("l_suppkey").cast("string")
    return F.concat(F.lit("t"), F.lpad(key, 5, "0"))


def ring_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean quantity per supplier and month; aggregated before the supplier join."""
    monthly = (
        table(spark, sf_dir, "lineitem")
        .select("l_suppkey", "l_quantity", _growth_year().alias("year"))
        .groupBy("l_suppkey", "year")
        .agg((F.avg("l_quantity") / 10).alias("width"))
    )
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return monthly.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).select(
        _site("s_nationkey").alias("rwl"), _tree().alias("tree"), "year", "width"
    )


def coded(widths: DataFrame) -> DataFrame:
    """Ring widths with some rings coded as missing."""
    supplier = F.substring("tree", 2, 20).cast("bigint")
    return widths.withColumn(
        "width",
        F.when(F.col("year") % 25 == 0, 0.0)
        .when((supplier % 10 == 0) & (F.col("year") % 20 == 0), 0.01)
        .otherwise(F.col("width")),
    )


def climate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Climate of a site per year and twelfth of the month's days."""
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_extendedprice",
        "l_discount",
        "l_tax",
        _growth_year().alias("year"),
        ((F.dayofmonth("l_shipdate") - 1) % 12 + 1).cast("int").alias("month"),
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    joined = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        customers, F.col("o_custkey") == F.col("c_custkey")
    )
    return joined.groupBy(_site("c_nationkey").alias("rwl"), "year", "month").agg(
        F.round(F.sum("l_extendedprice") / 1000, 6).alias("pre"),
        F.round(F.avg("l_discount") * 100, 6).alias("tmp"),
        F.round(F.min("l_discount") * 100, 6).alias("tmn"),
        F.round(F.max("l_discount") * 100, 6).alias("tmx"),
        F.round(F.avg("l_tax") * 100, 6).alias("spei"),
    )


def site_metadata(spark: SparkSession, sf_dir: str, widths: DataFrame) -> DataFrame:
    """Nations as sites; every site lies on a cell centre of the grid."""
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    spans = widths.groupBy("rwl").agg(
        F.min("year").alias("first_year"), F.max("year").alias("last_year")
    )
    col, row = (F.col("n_nationkey") * 7) % 90, (F.col("n_nationkey") * 11) % 80
    sites = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        _site("n_nationkey").alias("rwl"),
        F.col("n_name").alias("country"),
        (F.lit(75.0) - row * 0.5 - 0.25).alias("latitude"),
        (F.lit(-10.0) + col * 0.5 + 0.25).alias("longitude"),
        (F.col("n_nationkey") * 50.0).alias("elevation"),
        F.substring("r_name", 1, 4).alias("species_code"),
        F.col("r_name").alias("species_name"),
    )
    return sites.join(spans, "rwl", "left")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as points, some of them outside the grid."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), F.lpad(key.cast("string"), 9, "0")).alias("rwl"),
        ((key % 490).cast("double") / F.lit(10.0) + F.lit(-12.0)).alias("longitude"),
        ((key * 7 % 440).cast("double") / F.lit(10.0) + F.lit(33.0)).alias("latitude"),
        key.alias("seq"),
        F.col("c_acctbal").alias("balance"),
    )


def grid_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items scattered over cells and monthly layers, two variables."""
    items = table(spark, sf_dir, "lineitem").select(
        (F.col("l_partkey") % 80).cast("int").alias("row"),
        (F.col("l_orderkey") % 90).cast("int").alias("col"),
        ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate")).cast("int").alias("layer"),
        "l_quantity",
        "l_tax",
    )
    cells = items.groupBy("row", "col", "layer").agg(
        F.avg("l_quantity").alias("pre"), F.round(F.avg("l_tax"), 6).alias("spei")
    )
    return cells.unpivot(["row", "col", "layer"], ["pre", "spei"], "variable", "value").select(
        "variable", "row", "col", "layer", "value"
    )


def grid_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine static layers; each line item belongs to one layer by its line number."""
    names = F.array(*[F.lit(name) for name in COVARIATE_LAYERS])
    layer = F.element_at(names, (F.col("l_orderkey") % 9 + 1).cast("int"))
    return (
        table(spark, sf_dir, "lineitem")
        .select(
            layer.alias("layer"),
            (F.col("l_partkey") % 80).cast("int").alias("row"),
            (F.col("l_suppkey") * 7 % 90).cast("int").alias("col"),
            "l_quantity",
        )
        .groupBy("layer", "row", "col")
        .agg(F.ln(F.avg("l_quantity") + 1).alias("value"))
    )


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search responses as JSON text, one document per customer."""
    customers = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = table(spark, sf_dir, "region")
    base = customers.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(
        region, F.col("n_regionkey") == F.col("r_regionkey")
    )
    key = F.col("c_custkey")
    country = F.when(F.col("n_nationkey") == 8, "Eastern Europe>Russia").otherwise(F.col("n_name"))
    location = F.concat(
        F.lit("Continent>"), F.when(F.col("r_name") == "EUROPE", "Europe").otherwise(F.col("r_name")), F.lit(">"), country
    )
    lat, lon = (key % 40 + 35).cast("string"), (key % 45 - 10).cast("string")
    box = F.array(lat, (key % 40 + 36).cast("string"), lon, (key % 45 - 8).cast("string"))
    variables = F.array(
        F.struct(
            F.when(key % 4 == 0, "physical property>width>earlywood width")
            .otherwise("physical property>width>total ring width")
            .alias("cvWhat"),
            F.lit("mm").alias("cvUnit"),
        )
    )

    def data_file(suffix: str, description: str) -> Column:
        name = F.concat(F.lit("c"), key.cast("string"), F.lit(suffix))
        return F.struct(
            name.alias("linkText"),
            F.lit(description).alias("urlDescription"),
            F.concat(F.lit("file:"), name).alias("fileUrl"),
            variables.alias("variables"),
        )

    files = F.array(
        data_file(".rwl", "Raw Measurements"),
        data_file("-noaa.rwl", "Raw Measurements"),
        data_file(".crn", "Chronology"),
    )
    species = F.array(
        F.struct(F.lit("PISY").alias("speciesCode"), F.lit("Pinus sylvestris").alias("scientificName")),
        F.struct(F.substring("c_mktsegment", 1, 4).alias("speciesCode"), F.col("c_mktsegment").alias("scientificName")),
    )

    def site(number: int) -> Column:
        return F.struct(
            F.concat(F.lit(f"{number}-"), key.cast("string")).alias("NOAASiteId"),
            F.concat(F.col("c_name"), F.lit(f" {number}")).alias("siteName"),
            location.alias("locationName"),
            F.struct(
                F.struct(F.when(key % 3 == 0, box).otherwise(F.array(lat, lon)).alias("coordinates")).alias("geometry"),
                F.struct(
                    F.when(key % 5 == 0, "unknown").otherwise((key % 2000).cast("string")).alias("minElevationMeters")
                ).alias("properties"),
            ).alias("geo"),
            F.array(
                F.struct(
                    F.when(key % 7 == 0, "cal yr BP").otherwise("CE").alias("timeUnit"),
                    F.when(key % 2 == 0, species).otherwise(F.slice(species, 1, 1)).alias("species"),
                    files.alias("dataFile"),
                )
            ).alias("paleoData"),
        )

    study = F.struct(
        key.cast("string").alias("NOAAStudyId"),
        F.concat(F.col("c_name"), F.when(key % 6 == 0, " - other").otherwise(" - ITRDB")).alias("studyName"),
        F.when(key % 11 != 0, F.concat(F.lit("C"), key.cast("string"))).alias("studyCode"),
        F.col("c_mktsegment").alias("investigators"),
        F.concat(F.lit("doi:"), key.cast("string")).alias("doi"),
        F.date_add(F.lit("2000-01-01").cast("date"), (key % 3000).cast("int")).alias("contributionDate"),
        F.concat(F.lit("link/"), key.cast("string")).alias("onlineResourceLink"),
        (1500 + key % 600).cast("int").alias("earliestYearCE"),
        (1850 + key % 200).cast("int").alias("mostRecentYearCE"),
        F.array(
            F.struct(F.concat(F.lit("first "), F.col("c_name")).alias("citation")),
            F.struct(F.concat(F.lit("second "), F.col("c_name")).alias("citation")),
        ).alias("publication"),
        F.when(key % 10 == 0, F.array(site(1), site(2))).otherwise(F.array(site(1))).alias("site"),
    )
    return base.select(F.to_json(F.struct(F.array(study).alias("study"))).alias("document"))


def ragged_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue with a field more in every study, and with the first ``variables`` a text, missing, null or a number."""
    key = F.regexp_extract("document", r'"NOAAStudyId":"(\d+)"', 1).cast("bigint")
    first = r'^(.*?)"variables":\[[^\]]*\],?'

    def changed(to: str) -> Column:
        return F.regexp_replace("document", first, f"$1{to}")

    ragged = (
        F.when(key % 6 == 1, changed('"variables":"width"'))
        .when(key % 6 == 2, changed('"was":"variables"'))
        .when(key % 6 == 3, changed('"variables":null'))
        .when(key % 6 == 4, changed('"variables":[7,{"cvWhat":["x"]}]'))
        .otherwise(F.col("document"))
    )
    noted = F.regexp_replace(ragged, r'"NOAAStudyId":', F.concat(F.lit('"note":{"of":'), key.cast("string"), F.lit('},"NOAAStudyId":')))
    return catalogue(spark, sf_dir).select(noted.alias("document"))


def plain_lines(widths: DataFrame, id_width: int = 8, year_width: int = 4) -> DataFrame:
    """Decade lines in hundredths made field by field, blank where a year has no ring; no stop marker."""
    decade = F.floor(F.col("year") / 10).cast("int")
    fields = [
        F.coalesce(F.max(F.when(F.pmod(F.col("year"), F.lit(10)) == i, F.format_string("%6d", F.round(F.col("width") * 100).cast("int")))), F.lit(" " * 6))
        for i in range(10)
    ]
    cut = widths.groupBy("rwl", "tree", decade.alias("decade")).agg(F.concat(*fields).alias("_fields"))
    start = F.format_string(f"%-{id_width}s%{year_width}d", "tree", F.col("decade") * 10)
    return cut.select("rwl", "tree", "decade", F.concat(start, "_fields").alias("line"))
