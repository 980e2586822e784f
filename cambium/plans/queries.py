"""Registered queries: every operator on views of the star-schema tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cambium import schemas
from cambium.functions import months
from cambium.functions.numeric import decimals
from cambium.operators import chronology as chron
from cambium.operators import climate as clim
from cambium.operators import grid, growth, interseries, pointer, resilience, series, spline
from cambium.plans import final_tables as final
from cambium.plans import fixtures as fx
from cambium.sources import catalogue as cat
from cambium.sources import ring_text, tables
from cambium.stages import stage, stage_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# The views are close to noise, so the class share and the number of sites that
# must share a year are lower than the defaults of the operators.
THRESH, MIN_N = 20.0, 1
# Limit on abs(r) where the oracle needs a significance rule in plain SQL.
R_LIMIT = 0.2
REPLICATES, SEED = 100, 1


def query(fn: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
    """Register ``fn`` under its own name; it gets the inputs of one data folder."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(Inputs(spark, sf_dir))

    QUERIES[fn.__name__] = run
    return fn


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to six places, counts to bigint, as the oracle does."""
    columns = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DoubleType):
            c = F.round(c, places) + F.lit(0.0)
        elif isinstance(field.dataType, (T.IntegerType, T.ByteType, T.ShortType)):
            c = c.cast("bigint")
        columns.append(c.alias(field.name))
    return df.select(*columns)


# ---- inputs shared by several queries -------------------------------------------------------


class Inputs:
    """The views of one data folder and the tables derived from them, each built once."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return fx.table(self.spark, self.sf_dir, name)

    @cached_property
    def widths(self) -> DataFrame:
        return fx.ring_width(self.spark, self.sf_dir)

    @cached_property
    def coded(self) -> DataFrame:
        return fx.coded(self.widths)

    @cached_property
    def climate(self) -> DataFrame:
        return fx.climate(self.spark, self.sf_dir)

    @cached_property
    def metadata(self) -> DataFrame:
        return fx.site_metadata(self.spark, self.sf_dir, self.widths)

    @cached_property
    def points(self) -> DataFrame:
        return fx.points(self.spark, self.sf_dir)

    @cached_property
    def grid_monthly(self) -> DataFrame:
        return fx.grid_monthly(self.spark, self.sf_dir)

    @cached_property
    def stored_grid(self) -> DataFrame:
        packed = grid.pack_grid(self.grid_monthly)
        return tables.store_grid(packed, stage_folder(self.spark), row_group_bytes=1 << 14)

    @cached_property
    def grid_static(self) -> DataFrame:
        return fx.grid_static(self.spark, self.sf_dir)

    @cached_property
    def stats(self) -> DataFrame:
        return growth.tree_stats(self.widths)

    @cached_property
    def ages(self) -> DataFrame:
        return growth.tree_age(self.stats)

    @cached_property
    def series(self) -> DataFrame:
        """One row per tree, written once for all that is computed on single trees."""
        return series.store_series(self.widths)

    @cached_property
    def index(self) -> DataFrame:
        return series.rows(self.series, "index_year", "index")

    @cached_property
    def pointers(self) -> DataFrame:
        z = series.rows(self.series, "index_year", "z").filter(F.col("z").isNotNull())
        return pointer.pointer_years(z, THRESH)

    @cached_property
    def guards(self) -> DataFrame:
        return pointer.site_guards(self.coded, self.index)

    @cached_property
    def negative(self) -> DataFrame:
        return pointer.negative_pointer_years(self.guards, self.pointers)

    @cached_property
    def resilience(self) -> DataFrame:
        years = pointer.frequent_years(self.negative, MIN_N)
        trees = series.rows(self.series, "index_year", *series.RESILIENCE)
        return resilience.resilience_site(trees, self.guards, years)

    @cached_property
    def rwi(self) -> DataFrame:
        return growth.relative_widths(self.widths)

    @cached_property
    def chronology(self) -> DataFrame:
        return chron.chronology(self.rwi)

    @cached_property
    def interseries(self) -> DataFrame:
        return interseries.interseries_cor(self.rwi, prewhitened=False)

    @cached_property
    def coefs(self) -> DataFrame:
        return clim.climate_coef(self.chronology, self.climate, threshold=R_LIMIT)

    @cached_property
    def spei(self) -> DataFrame:
        return clim.spei_names(
            clim.climate_coef(self.chronology, self.climate, ["spei"], threshold=R_LIMIT)
        )

    @cached_property
    def placed(self) -> DataFrame:
        return clim.with_coordinates(self.spei, self.metadata)

    @cached_property
    def samples(self) -> DataFrame:
        return grid.sample_grid(self.points, self.grid_monthly, fx.GRID)

    @cached_property
    def sampled_series(self) -> DataFrame:
        return grid.sample_grid(self.points, self.grid_monthly, fx.GRID, unfold=False)

    @cached_property
    def sites(self) -> DataFrame:
        documents = fx.catalogue(self.spark, self.sf_dir)
        return cat.explode_sites(cat.parse_documents(documents, "document"))

    @cached_property
    def lines(self) -> DataFrame:
        rings = self.widths.withColumn("width", F.round("width", 3))
        return ring_text.format_ring_lines(rings).select("rwl", "line")


# ---- growth ---------------------------------------------------------------------------------


@query
def tree_stats(x):
    return rounded(x.stats)


@query
def site_age(x):
    return rounded(x.ages.drop("flag"))


@query
def site_rollup(x):
    return rounded(growth.site_rollup(x.ages))


@query
def metadata_age(x):
    return rounded(growth.metadata_age(x.ages, x.metadata))


@query
def site_filter(x):
    chosen = cat.site_filter(x.metadata, species="EURO", min_last=1980, max_last=2025)
    return rounded(pointer.select_sites(x.widths, chosen))


@query
def bai_long(x):
    return rounded(growth.bai(x.widths))


@query
def bai_dense(x):
    return rounded(growth.bai_dense(x.widths))


@query
def widths_dense(x):
    return rounded(growth.dense_widths(x.widths))


@query
def single_site(x):
    """One site's coefficients with its metadata, as a plot of a site needs them."""
    return rounded(final.site_clim_correlation(x.metadata, x.coefs).filter(F.col("rwl") == "s15"))


@query
def site_trend(x):
    return rounded(growth.site_trend(x.chronology), 8)


@query
def tree_trend(x):
    return rounded(growth.tree_trend(growth.bai(x.widths)))


@query
def growth_trend_flags(x):
    return growth.growth_trend_flags(x.widths)


@query
def relative_widths(x):
    return rounded(x.rwi)


@query
def detrend_spline(x):
    return rounded(spline.detrend_spline(x.widths))


@query
def spline_chronology(x):
    widths = x.widths
    return rounded(chron.chronology(spline.detrend_spline(widths)))


# ---- chronologies and inter-series correlation ----------------------------------------------


@query
def chronology(x):
    return rounded(x.chronology)


@query
def chronology_distributed(x):
    """The route of oversized groups for every group, on an index with years in which no tree has a value."""
    gaps = x.rwi.withColumn("rwi", F.when(F.col("year") % 10 != 0, F.col("rwi")))
    return rounded(chron.chronology(gaps, max_group=1))


@query
def chronology_mean(x):
    return rounded(chron.chronology(x.rwi, biweight=False))


@query
def chronology_cv(x):
    return rounded(growth.chronology_cv(x.chronology))


@query
def others_chronology(x):
    return rounded(interseries.others_chronology(x.rwi))


@query
def others_chronology_distributed(x):
    return rounded(interseries.others_chronology(x.rwi, max_group=1))


# Groups several times larger than the limit, so that the brackets of their order statistics hold a part of them only.
BRACKET_GROUP = 20


def regions(rwi: DataFrame) -> DataFrame:
    """The sites of either half of the nations as one site."""
    return rwi.withColumn("rwl", F.concat(F.lit("r"), (F.substring("rwl", 2, 9).cast("int") % 2).cast("string")))


@query
def chronology_brackets(x):
    return rounded(chron.chronology(regions(x.rwi), max_group=BRACKET_GROUP))


@query
def others_chronology_brackets(x):
    return rounded(interseries.others_chronology(regions(x.rwi), max_group=BRACKET_GROUP))


@query
def interseries_cor(x):
    return rounded(x.interseries)


@query
def interseries_pearson(x):
    return rounded(interseries.interseries_cor(x.rwi, prewhitened=False, method="pearson"))


@query
def interseries_site(x):
    return rounded(interseries.interseries_site(x.interseries))


@query
def interseries_flags(x):
    return interseries.interseries_flags(x.interseries)


@query
def interseries_prewhitened(x):
    return rounded(interseries.interseries_cor(x.rwi))


# ---- trees as one row each ------------------------------------------------------------------


@query
def series_tree_stats(x):
    return rounded(series.statistics(x.series))


@query
def series_detrend_spline(x):
    return rounded(series.rows(spline.detrend_series(x.series), "year", "rwi"))


@query
def series_lowpass13(x):
    return rounded(series.rows(x.series, "index_year", "index"))


@query
def series_growth_z(x):
    return rounded(series.rows(x.series, "index_year", "z").filter(F.col("z").isNotNull()))


@query
def series_resilience_tree(x):
    return rounded(series.rows(x.series, "index_year", *series.RESILIENCE))


# ---- pointer years and resilience -----------------------------------------------------------


@query
def lowpass13(x):
    return rounded(pointer.lowpass13(x.widths))


@query
def growth_z(x):
    return rounded(pointer.growth_z(pointer.lowpass13(x.widths)))


@query
def pointer_years(x):
    return rounded(x.pointers)


@query
def missing_rings(x):
    return rounded(pointer.missing_rings(x.coded))


@query
def pointer_flags(x):
    return rounded(pointer.pointer_flags(x.guards, x.pointers))


@query
def negative_pointer_years(x):
    return rounded(x.negative)


@query
def pointer_year_freq(x):
    return rounded(pointer.pointer_year_freq(x.negative))


@query
def frequent_years(x):
    return rounded(pointer.frequent_years(x.negative, MIN_N))


@query
def pointer_year_report(x):
    return rounded(pointer.most_frequent(pointer.pointer_year_freq(x.negative)))


@query
def resilience_tree(x):
    return rounded(resilience.resilience_tree(pointer.lowpass13(x.widths)))


@query
def recovery_period(x):
    return rounded(resilience.recovery_period(x.index))


@query
def resilience_site(x):
    return rounded(x.resilience)


@query
def resilience_flags(x):
    return resilience.resilience_flags(x.guards)


@query
def component_full_join(x):
    """Component tables kept apart, each with the years it has a value for, then joined in full."""
    site_years = resilience.resilience_site_year(resilience.resilience_tree(x.index))
    parts = [
        site_years.filter(F.col(count) > 0).select("rwl", "pointer_year", mean, sd, count)
        for mean, sd, count in resilience.COMPONENTS.values()
    ]
    return rounded(resilience.full_outer_components(parts))


# ---- climate --------------------------------------------------------------------------------


@query
def climate_long(x):
    """One-variable tables joined on site, year and month."""
    base = x.climate
    parts = [base.select("rwl", "year", "month", v) for v in clim.CLIMATE_VARIABLES]
    return rounded(clim.join_variables(parts))


@query
def climate_series_long(x):
    """The same months out of series that meet as arrays."""
    samples = grid.sample_series(x.points, x.stored_grid, fx.GRID, together=True)
    return rounded(clim.climate_from_series(samples, grid.series_layers(x.stored_grid), ["pre", "spei"]))


@query
def climate_samples_long(x):
    """Grid samples at points, by month and variable."""
    samples = grid.layer_to_month(x.samples.drop("row", "col"))
    return rounded(clim.climate_long(samples, ["pre", "spei"]))


@query
def climate_wide(x):
    wide = grid.climate_wide(x.sampled_series, "pre", fx.LAYERS)
    return rounded(wide)


@query
def climate_wide_to_long(x):
    wide = grid.climate_wide(x.sampled_series, "pre", fx.LAYERS)
    long = grid.wide_to_long(wide, "pre")
    return rounded(long.withColumn("month_number", months.month_number(F.col("month"))))


@query
def lagged_months(x):
    return rounded(clim.lagged_months(x.climate, clim.CLIMATE_VARIABLES))


@query
def climate_correlation(x):
    return rounded(x.coefs)


@query
def spei_correlation(x):
    return rounded(x.spei.drop("month_order"))


@query
def bootstrap_ci(x):
    coefs = clim.climate_coef(
        x.chronology, x.climate, [*clim.CLIMATE_VARIABLES, "spei"], replicates=REPLICATES, seed=SEED
    )
    return rounded(coefs)


@query
def climate_response(x):
    coefs = clim.climate_coef(
        x.chronology, x.climate, method="response", replicates=REPLICATES, seed=SEED
    )
    return rounded(coefs)


@query
def spei_regression(x):
    """The response function with all components, which is least squares, of sites with years enough for it; without limits."""
    coefs = clim.climate_coef(x.chronology, x.climate, ["spei"], method="regression", replicates=0, min_years=18)
    return rounded(coefs)


@query
def spei_response(x):
    """The response function of the drought index with limits; few replicates, for the sake of its SQL."""
    coefs = clim.climate_coef(x.chronology, x.climate, ["spei"], method="response", replicates=4, seed=SEED)
    return rounded(coefs)


@query
def climate_response_flags(x):
    """Why sites have no response function of all four variables, or one of few years."""
    lagged = clim.lagged_months(x.climate, clim.CLIMATE_VARIABLES)
    return clim.response_flags(x.chronology, lagged, min_years=30)


@query
def signature(x):
    return rounded(clim.signature(x.coefs, mark=0.1))


@query
def signature_wide_window(x):
    coefs = clim.climate_coef(x.chronology, x.climate, threshold=R_LIMIT, first=-9, last=12)
    return rounded(clim.signature(coefs, mark=0.1))


@query
def significant_coefs(x):
    """Both halves, told apart by ``significant``."""
    yes, no = clim.split_by_significance(x.coefs)
    return rounded(yes.unionByName(no))


@query
def spei_mean_map(x):
    return rounded(clim.spei_mean_map(x.placed))


@query
def strongest_month(x):
    return rounded(clim.strongest_month(x.placed))


@query
def strongest_month_wide_window(x):
    coefs = clim.climate_coef(x.chronology, x.climate, ["spei"], threshold=R_LIMIT, first=-9, last=12)
    return rounded(clim.strongest_month(clim.with_coordinates(clim.spei_names(coefs), x.metadata)))


@query
def significant_by_month(x):
    return rounded(clim.significant_by_month(x.placed))


@query
def month_distribution(x):
    return rounded(clim.month_distribution(x.placed))


@query
def month_distribution_distributed(x):
    return rounded(clim.month_distribution(x.placed, max_group=1))


@query
def month_distribution_brackets(x):
    return rounded(clim.month_distribution(x.placed, max_group=BRACKET_GROUP))


@query
def month_outliers(x):
    return rounded(clim.month_outliers(x.placed))


# ---- grids ----------------------------------------------------------------------------------


@query
def crop_grid(x):
    return rounded(grid.crop(x.grid_monthly, fx.GRID, (0.0, 20.0, 40.0, 60.0)))


@query
def crop_stored_grid(x):
    """The same box out of a grid that is stored packed, along the Z-order curve."""
    cells = grid.crop(x.stored_grid, fx.GRID, (0.0, 20.0, 40.0, 60.0))
    return rounded(cells.select("variable", *grid.CELL, F.inline("series")))


@query
def sample_grid(x):
    return rounded(x.samples)


@query
def sample_stored_grid(x):
    samples = grid.sample_series(x.points, x.stored_grid, fx.GRID)
    return rounded(grid.unfold_series(samples, grid.series_layers(x.stored_grid)))


@query
def distinct_points(x):
    return rounded(grid.distinct_points(x.points))


@query
def rasterize_last(x):
    return rounded(grid.rasterize_last(x.points, fx.GRID, "balance", "seq", "longitude", "latitude"))


@query
def resample_bilinear(x):
    return rounded(grid.resample_bilinear(x.grid_static, fx.GRID, fx.FINE_GRID))


@query
def site_covariates(x):
    return rounded(grid.site_covariates(x.points.drop("seq", "balance"), x.grid_static, fx.GRID))


@query
def point_casts(x):
    """Point table read as text, numbers that do not parse become NULL."""
    text = x.points.select(
        "rwl",
        F.col("longitude").cast("string").alias("lon"),
        F.col("latitude").cast("string").alias("lat"),
        F.when(F.col("seq") % 3 == 0, "n/a").otherwise(F.col("seq").cast("string")).alias("mainc_code"),
        F.when(F.col("seq") % 2 == 0, "NA").otherwise(F.col("balance").cast("string")).alias("kg"),
    )
    return rounded(tables.cast_points(text))


# ---- catalogue, text files, small reports ---------------------------------------------------


@query
def catalogue_explode(x):
    return rounded(cat.site_metadata(x.sites).drop("rwl"))


@query
def catalogue_filter(x):
    chosen = cat.filter_catalogue(x.sites)
    return rounded(cat.analysis_metadata(cat.site_metadata(chosen, compat=True)))


@query
def raw_file_list(x):
    return rounded(cat.raw_files(x.sites))


@query
def catalogue_variant(x):
    """Sites and their raw files in documents whose fields vary in shape, with a field that no schema names."""
    documents = fx.ragged_catalogue(x.spark, x.sf_dir).union(x.spark.range(1).select(F.lit("no {json").alias("document")))
    sites = cat.explode_sites(cat.parse_variants(documents, "document"))
    files = cat.raw_files(sites.withColumn("NOAAStudyId", F.col("NOAASiteId")))
    counted = files.groupBy(F.col("NOAAStudyId").alias("NOAASiteId")).agg(F.count(F.lit(1)).alias("n_files"))
    note = F.try_variant_get("study", "$.note.of", "bigint").alias("note")
    listed = sites.select("NOAAStudyId", "NOAASiteId", "studyName", note).join(counted, "NOAASiteId", "left")
    return rounded(listed.withColumn("n_files", F.coalesce("n_files", F.lit(0))))


@query
def usable_files(x):
    files = cat.raw_files(x.sites)
    failed = F.col("NOAAStudyId").cast("bigint") % 13 == 0
    status = files.select("NOAAStudyId", "linkText", F.when(failed, "Error").otherwise("Good").alias("status"))
    return rounded(cat.usable_files(files, status))


@query
def ring_text_round_trip(x):
    return rounded(ring_text.parse_ring_lines(x.lines))


@query
def ring_file_status(x):
    """Read status and line counts where every fifth site's lines are damaged."""
    bad = F.col("rwl").substr(2, 2).cast("int") % 5 == 0
    lines = fx.plain_lines(x.widths).withColumn("line", F.when(bad, F.translate("line", "0123", "abcd")).otherwise(F.col("line")))
    return rounded(ring_text.file_status(stage(ring_text.scan_lines(lines))))


@query
def ring_files_chosen(x):
    """Ring files written to the shared folder, of which only those of the chosen sites are read."""
    folder = stage_folder(x.spark)
    ring_text.write_ring_files(x.widths.withColumn("width", F.round("width", 3)), folder)
    chosen = ring_text.named_sites(cat.site_filter(x.metadata, species="EURO"))
    widths, _ = ring_text.read_ring_files(x.spark, folder, suffix="*.txt", sites=chosen)
    return rounded(widths)


@query
def ring_file_inventory(x):
    """Sites of the files of a folder, told from the listing alone."""
    folder = stage_folder(x.spark)
    ring_text.write_ring_files(x.widths.withColumn("width", F.round("width", 3)), folder)
    files = tables.file_inventory(x.spark, folder, "*.txt")
    return files.groupBy("rwl").agg((F.sum("length") > 0).alias("has_text"))


@query
def rerun_after_failure(x):
    """A stored table after a rerun that failed halfway, and one that read the table it wrote."""
    path = stage_folder(x.spark)
    stored = tables.store(x.widths, path)
    broken = stored.withColumn("width", F.when(F.col("year") % 50 == 0, F.raise_error(F.lit("stopped"))).otherwise(F.col("width")))
    try:
        tables.store(broken, path)
    except Exception as e:  # noqa: BLE001
        if "stopped" not in str(e):
            raise
    tables.store(tables.read_version(x.spark, path).filter("year >= 1950"), path)
    current = tables.read_version(x.spark, path)
    kept = tables.versions(x.spark, path).agg(F.count(F.lit(1)).alias("n_versions"), F.max_by("n_rows", "sequence").alias("n_rows"))
    return rounded(current.withColumn("_k", F.lit(1)).join(kept.withColumn("_k", F.lit(1)), "_k").drop("_k"))


@query
def csv_round_trip(x):
    folder = stage_folder(x.spark)
    tables.write_table(x.coded.withColumn("width", F.when(F.col("width") > 0.01, F.col("width"))), folder, "csv")
    return rounded(tables.read_table_csv(x.spark, folder, schemas.RING_WIDTH))


@query
def grid_tables(x):
    """Both kinds of grid tables written and read with their schemas."""
    monthly, static = stage_folder(x.spark), stage_folder(x.spark)
    tables.write_table(x.grid_monthly, monthly)
    tables.write_table(x.grid_static, static)
    read = tables.read_monthly_grid(x.spark, monthly).withColumn("name", F.concat("variable", F.lit(" "), "layer")).drop("variable", "layer")
    both = read.unionByName(tables.read_static_grid(x.spark, static).withColumnRenamed("layer", "name"))
    return rounded(both.groupBy("name").agg(F.count("value").alias("n"), F.sum("value").alias("total"), F.max("row").alias("row"), F.max("col").alias("col")))


@query
def bucketed_tree_stats(x):
    """Statistics of trees from a table that is bucketed by tree."""
    stored = tables.store_by_tree(x.widths, "cambium_query_rings", stage_folder(x.spark), 4)
    return rounded(growth.tree_stats(stored))


@query
def ring_text_blank_fields(x):
    """Rings of decade lines in which every seventh year, and whatever a tree lacks, is a blank field."""
    return rounded(ring_text.parse_ring_lines(fx.plain_lines(x.widths.filter("year % 7 <> 3"))))


@query
def ring_text_damaged_lines(x):
    """Status and counts of files with a header and, in every fifth tree, lines with a damaged field."""
    bad = (F.col("tree").substr(2, 5).cast("int") % 5 == 0) & (F.col("decade") % 3 == 0)
    broken = F.regexp_replace("line", r"\d( *)$", "x$1")
    lines = fx.plain_lines(x.widths).withColumn("line", F.when(bad, broken).otherwise(F.col("line"))).select("rwl", "line")
    sites = x.metadata.select("rwl", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])).alias("i"), "country")
    header = sites.select("rwl", F.format_string("%-7s%d %s", F.upper("rwl"), "i", "country").alias("line"))
    return rounded(ring_text.file_status(ring_text.scan_lines(header.unionByName(lines))))


@query
def ring_text_long_variant(x):
    """Rings of years before -999: the long variant, told by the sites' years."""
    old = x.widths.withColumn("year", F.col("year") - 5000)
    lines = fx.plain_lines(old, id_width=7, year_width=5)
    return rounded(ring_text.parse_ring_lines(lines, ring_text.long_sites(old)))


@query
def site_precision(x):
    return rounded(ring_text.site_precision(x.widths.withColumn("width", F.round("width", 3))))


@query
def width_decimals(x):
    widths = x.widths.withColumn("width", F.round("width", 3))
    return rounded(tables.column_profile(widths.select(decimals(F.col("width")).alias("n_decimals")), "n_decimals"))


@query
def species_table(x):
    return rounded(tables.column_profile(x.metadata, "species_code"))


@query
def last_year_range(x):
    return rounded(tables.column_range(x.metadata, "last_year"))


@query
def filter_counts(x):
    meta = x.metadata
    return rounded(tables.condition_counts(meta, cat.site_condition(species="EURO"), "rwl"))


@query
def path_site_ids(x):
    """Site id from a file path, path labels and month labels of layers."""
    rows = x.points.select(
        "rwl",
        ring_text.site_of_path(F.concat(F.lit("/data/rings/"), F.upper("rwl"), F.lit(".rwl"))).alias("site"),
        months.layer_label((F.col("seq") % 1488 + 1).cast("int")).alias("label"),
    )
    return rounded(rows)


# ---- final tables ---------------------------------------------------------------------------


@query
def extended_metadata(x):
    region = x.table("region")
    groups = region.select(
        F.substring("r_name", 1, 4).alias("species_code"),
        F.when(F.col("r_regionkey") % 2 == 0, "conifer").otherwise("broadleaf").alias("con_broad"),
    )
    return rounded(final.extended_metadata(x.metadata, groups))


@query
def site_growth_data(x):
    site = interseries.interseries_site(x.interseries)
    return rounded(final.site_growth_data(x.metadata, site, growth.chronology_cv(x.chronology)))


@query
def site_clim_correlation(x):
    return rounded(final.site_clim_correlation(x.metadata, x.coefs))


@query
def site_spei_correlation(x):
    return rounded(final.site_spei_correlation(x.metadata, x.spei))


@query
def site_year_chronologies(x):
    return rounded(final.site_year_chronologies(x.chronology, x.metadata))


@query
def site_year_resilience(x):
    return rounded(final.site_year_resilience(x.resilience, x.metadata))


@query
def site_month_climate(x):
    base = x.climate
    spei = base.select("rwl", "year", "month", "spei")
    return rounded(final.site_month_climate(base.drop("spei"), spei, x.metadata))


@query
def site_growth_trend(x):
    return rounded(final.site_growth_trend(x.chronology, x.metadata), 8)


@query
def tree_year_growth(x):
    return rounded(final.tree_year_growth(x.widths, x.ages, x.interseries))


@query
def tree_growth_trend(x):
    bai = growth.bai(x.widths)
    return rounded(final.tree_growth_trend(bai, x.metadata, x.interseries))
