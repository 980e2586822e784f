"""The nine joined tables an analyst starts from."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cambium.operators import growth
from cambium.operators.climate import SITE_MONTH
from cambium.operators.skew import lookup_join


def extended_metadata(metadata: DataFrame, species_groups: DataFrame | None = None) -> DataFrame:
    """Site metadata with the caller's species groups."""
    if species_groups is None:
        return metadata
    return lookup_join(metadata, species_groups, "species_code", "rwl")


def site_growth_data(metadata: DataFrame, interseries_site: DataFrame, cv: DataFrame) -> DataFrame:
    return metadata.join(interseries_site, "rwl", "left").join(cv, "rwl", "left")


def site_clim_correlation(metadata: DataFrame, coefs: DataFrame) -> DataFrame:
    return metadata.join(coefs, "rwl", "left")


def site_spei_correlation(metadata: DataFrame, spei_coefs: DataFrame) -> DataFrame:
    return metadata.join(spei_coefs.drop("month_order"), "rwl", "left")


def site_year_chronologies(chronologies: DataFrame, metadata: DataFrame) -> DataFrame:
    return chronologies.join(metadata, "rwl", "left")


def site_year_resilience(resilience: DataFrame, metadata: DataFrame) -> DataFrame:
    return resilience.join(metadata, "rwl", "left")


def site_month_climate(climate: DataFrame, spei: DataFrame, metadata: DataFrame) -> DataFrame:
    return climate.join(spei, SITE_MONTH, "left").join(metadata, "rwl", "left")


def site_growth_trend(
    chronologies: DataFrame, metadata: DataFrame, years: tuple[int, int] = growth.TREND_YEARS
) -> DataFrame:
    return growth.site_trend(chronologies, years).join(metadata, "rwl", "left")


def tree_year_growth(widths: DataFrame, tree_age: DataFrame, interseries_tree: DataFrame) -> DataFrame:
    """All years of every tree with its age and correlation, which are joined once per tree before the years are filled."""
    trees = tree_age.join(interseries_tree, growth.TREE, "left")
    return growth.bai_dense(widths, trees)


def tree_growth_trend(
    bai: DataFrame,
    metadata: DataFrame,
    interseries_tree: DataFrame,
    years: tuple[int, int] = growth.TREND_YEARS,
) -> DataFrame:
    """Trend of every tree; the site lookup is salted by tree."""
    trends = growth.tree_trend(bai, years)
    return lookup_join(trends, metadata, "rwl", "tree").join(interseries_tree, growth.TREE, "left")
