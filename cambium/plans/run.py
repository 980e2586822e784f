"""The whole analysis: ring widths, metadata and grids in, stored tables out.

Each stage is written once and the next one reads the written table.  That cuts
the lineage, so a lost executor never recomputes earlier stages, and every
table is computed once however many later ones use it.  Tables are stored in
versions, so a run that fails leaves those of the run before, and may read them.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cambium.operators import chronology, climate, grid, growth, interseries, pointer, resilience, series, spline
from cambium.operators.skew import lookup_join
from cambium.plans import final_tables as final
from cambium.sources import catalogue, ring_text, tables


@dataclass(frozen=True)
class Settings:
    """Parameters of a run with their usual values."""

    trend_years: tuple[int, int] = growth.TREND_YEARS
    pointer_share: float = 60.0
    pointer_window: int = 13
    from_year: int = pointer.FROM_YEAR
    frequent_min_sites: int = 10
    years_before: int = 4
    years_after: int = 4
    climate_method: str = "response"
    first_month: int = -6
    last_month: int = 9
    replicates: int = 1000
    seed: int = 1
    box: tuple[float, float, float, float] = grid.EUROPE
    # One site per coordinate keeps its climate, as opposed to all of them.
    one_site_per_coordinate: bool = False
    covariate_layers: tuple[str, ...] = tuple(grid.COVARIATE_LAYERS)
    # Ring tables bucketed by tree, as catalogue tables with this prefix; 0 writes plain folders.
    tree_buckets: int = 0
    table_prefix: str = "cambium_"
    # Write the final tables as CSV too, to ``<name>_csv``.
    csv: bool = False
    # Names of ring files, and whether the rings of an import are written as text again, to ``rings``.
    ring_suffix: str = "*.rwl"
    rewrite_rings: bool = True


@dataclass
class Sources:
    """What a run reads.

    Either ``studies`` of a catalogue and the folder ``rings`` of its ring
    files, or ``widths`` and ``metadata`` as tables; ``read_flags`` then lists
    the files that could not be read.
    """

    widths: DataFrame | None = None
    metadata: DataFrame | None = None
    grid_monthly: DataFrame | None = None
    grid_static: DataFrame | None = None
    geometry: grid.GridGeometry | None = None
    ecoregion_points: DataFrame | None = None
    ecoregion_geometry: grid.GridGeometry | None = None
    species_groups: DataFrame | None = None
    sites: DataFrame | None = None
    read_flags: DataFrame | None = None
    studies: DataFrame | None = None
    rings: str | None = None


@dataclass
class Store:
    """Written tables of a run by name."""

    path: str
    conf: Settings
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def put(self, name: str, df: DataFrame) -> DataFrame:
        self.tables[name] = tables.store(df, f"{self.path}/{name}")
        return self.tables[name]

    def put_rings(self, name: str, df: DataFrame) -> DataFrame:
        """Tables with a row per tree and year, read by several windows over trees."""
        if not self.conf.tree_buckets:
            return self.put(name, df)
        table = f"{self.conf.table_prefix}{name}"
        self.tables[name] = tables.store_by_tree(df, table, f"{self.path}/{name}", self.conf.tree_buckets)
        return self.tables[name]

    def put_final(self, name: str, df: DataFrame) -> DataFrame:
        """Tables that analysts start from, as CSV too if that is asked for."""
        stored = self.put(name, df)
        if self.conf.csv:
            tables.write_table(stored, f"{self.path}/{name}_csv", "csv")
        return stored

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]


def import_stage(spark: SparkSession, src: Sources, out: Store, conf: Settings) -> Sources:
    """From a catalogue and a folder of ring files to widths, metadata and the two tables of the catalogue.

    Files of other sites are not opened.  A study with a file that cannot be
    read, or is not there, is dropped as a whole; the rings of the others are
    written as text again, each site in the precision of its first series.
    """
    sites = catalogue.filter_catalogue(catalogue.explode_sites(src.studies))
    listed = out.put_final("site_catalogue", catalogue.site_metadata(sites))
    files = out.put_final("raw_files", catalogue.raw_files(sites))
    named = files.select(catalogue.site_of_file().alias("rwl"))
    widths, status = ring_text.read_ring_files(
        spark, src.rings, catalogue.long_sites(files), conf.ring_suffix, ring_text.named_sites(named)
    )
    checked = out.put("file_checks", catalogue.file_checks(files, status))
    usable = catalogue.usable_files(files, checked).select(catalogue.site_of_file().alias("rwl")).distinct()
    widths = out.put("imported_widths", lookup_join(widths, usable, "rwl", "tree", "left_semi"))
    if conf.rewrite_rings:
        ring_text.write_ring_files(widths, f"{out.path}/rings")
    metadata = catalogue.analysis_metadata(listed)
    failed = status.join(named.distinct(), "rwl", "left_semi")
    return replace(src, widths=widths, metadata=metadata, read_flags=ring_text.read_flags(failed))


def _usable(out: Store) -> DataFrame:
    """Rings of the sites without a growth flag."""
    flagged = out["growth_trend_flags"].select("rwl").distinct()
    return lookup_join(out["ring_width"], flagged, "rwl", "tree", "left_anti")


def growth_stage(src: Sources, out: Store, conf: Settings) -> None:
    widths = src.widths if src.sites is None else pointer.select_sites(src.widths, src.sites)
    widths = out.put_rings("ring_width", widths)
    ages = out.put("tree_age", growth.tree_age(growth.tree_stats(widths), src.read_flags))
    out.put("metadata_age", growth.metadata_age(ages, src.metadata))
    flags = out.put("growth_trend_flags", growth.growth_trend_flags(widths, src.read_flags))
    usable = _usable(out)
    rwi = out.put_rings("rwi", spline.detrend_spline(usable))
    chron = out.put("chronology", chronology.chronology(rwi, stored=True))
    out.put("chronology_cv", growth.chronology_cv(chron))
    out.put("bai", growth.bai_dense(usable))
    trees = out.put("interseries_tree", interseries.interseries_cor(rwi))
    out.put("interseries_site", interseries.interseries_site(trees))
    out.put("interseries_flags", interseries.interseries_flags(trees, flags))


def climate_stage(src: Sources, out: Store, conf: Settings) -> None:
    placed = out["metadata_age"].filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    if conf.one_site_per_coordinate:
        placed = grid.distinct_points(placed)
    cropped = grid.crop(src.grid_monthly, src.geometry, conf.box)
    # One row per site: layers unfold into months where the variables are laid side by side.
    packed = grid.pack_grid(grid.cells_with_points(placed, cropped, src.geometry))
    packed = out.put("climate_cells", packed)
    layers = out.put("climate_layers", grid.grid_layers(cropped))
    samples = out.put("climate_series", grid.sample_series(placed, packed, src.geometry, layers=layers, together=True))
    monthly = out.put("climate_long", climate.climate_from_series(samples, layers))
    drought = out.put("spei_long", climate.climate_from_series(samples, layers, ["spei"]))
    options = {
        "method": conf.climate_method,
        "first": conf.first_month,
        "last": conf.last_month,
        "replicates": conf.replicates,
        "seed": conf.seed,
    }
    coefs = out.put("climate_coefs", climate.climate_coef(out["chronology"], monthly, **options))
    spei = climate.climate_coef(out["chronology"], drought, ["spei"], **options)
    spei = out.put("spei_coefs", climate.spei_names(spei))
    out.put("climate_signature", climate.signature(coefs))
    located = climate.with_coordinates(spei, out["metadata_age"])
    out.put("spei_mean_map", climate.spei_mean_map(located))
    out.put("spei_strongest_month", climate.strongest_month(located))
    out.put("spei_significant_by_month", climate.significant_by_month(located))
    out.put("spei_month_distribution", climate.month_distribution(located))


def pointer_stage(src: Sources, out: Store, conf: Settings) -> None:
    widths = out["ring_width"]
    options = {"window": conf.pointer_window, "pre": conf.years_before, "post": conf.years_after}
    trees = out.put("tree_series", series.measured(series.tree_series(widths), **options))
    index = out.put_rings("lowpass_index", series.rows(trees, "index_year", "index"))
    guards = out.put("site_guards", pointer.site_guards(widths, index))
    z = series.rows(trees, "index_year", "z").filter(F.col("z").isNotNull())
    shares = out.put("pointer_shares", pointer.pointer_years(z, conf.pointer_share))
    negative = out.put(
        "pointer_years", pointer.negative_pointer_years(guards, shares, conf.from_year, src.read_flags)
    )
    frequency = out.put("pointer_year_frequency", pointer.pointer_year_freq(negative))
    out.put("pointer_year_report", pointer.most_frequent(frequency))
    years = pointer.frequent_years(negative, conf.frequent_min_sites)
    components = series.rows(trees, "index_year", *series.RESILIENCE)
    out.put("resilience", resilience.resilience_site(components, guards, years, src.read_flags))


def _covariates(src: Sources, metadata: DataFrame, conf: Settings) -> DataFrame:
    if src.grid_static is not None:
        cells = grid.crop(src.grid_static, src.geometry, conf.box)
        metadata = grid.site_covariates(metadata, cells, src.geometry, conf.covariate_layers)
    if src.ecoregion_points is not None:
        classes = grid.rasterize_last(
            src.ecoregion_points, src.ecoregion_geometry, "mainc_code", "seq"
        ).withColumnRenamed("value", "ecoregion")
        metadata = grid.sample_layer(
            metadata.drop("ecoregion"), classes, src.ecoregion_geometry
        ).drop(*grid.CELL)
    return metadata


def final_stage(src: Sources, out: Store, conf: Settings) -> None:
    meta = final.extended_metadata(out["metadata_age"], src.species_groups)
    meta = out.put("site_metadata", _covariates(src, meta, conf))
    trees, chron = out["interseries_tree"], out["chronology"]
    out.put_final("site_growth_data", final.site_growth_data(meta, out["interseries_site"], out["chronology_cv"]))
    out.put_final("site_year_chronologies", final.site_year_chronologies(chron, meta))
    out.put_final("site_year_resilience", final.site_year_resilience(out["resilience"], meta))
    out.put_final("site_growth_trend", final.site_growth_trend(chron, meta, conf.trend_years))
    out.put_final("tree_year_growth", final.tree_year_growth(_usable(out), out["tree_age"], trees))
    out.put_final("tree_growth_trend", final.tree_growth_trend(out["bai"], meta, trees, conf.trend_years))
    if "climate_coefs" in out.tables:
        out.put_final("site_clim_correlation", final.site_clim_correlation(meta, out["climate_coefs"]))
        out.put_final("site_spei_correlation", final.site_spei_correlation(meta, out["spei_coefs"]))
        out.put_final(
            "site_month_climate", final.site_month_climate(out["climate_long"], out["spei_long"], meta)
        )


def run(spark: SparkSession, src: Sources, path: str, conf: Settings = Settings()) -> dict[str, DataFrame]:
    """Run all stages and return the written tables by name."""
    out = Store(path, conf)
    if src.studies is not None:
        src = import_stage(spark, src, out, conf)
    growth_stage(src, out, conf)
    if src.grid_monthly is not None:
        climate_stage(src, out, conf)
    pointer_stage(src, out, conf)
    final_stage(src, out, conf)
    return out.tables
