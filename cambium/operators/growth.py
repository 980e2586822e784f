"""Per-tree growth statistics, site ages, basal area and linear trends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from cambium.functions.numeric import finite_or_null, is_finite
from cambium.operators.skew import SALT, lookup_join, window_salts

TREE = ["rwl", "tree"]
TREND_YEARS = (1975, 2025)

# Fixed value: flag of a site whose widths cannot be detrended.
FLAG_DETREND = "detrend failed"


def clean_widths(widths: DataFrame) -> DataFrame:
    """Missing, NaN and infinite widths all become NULL."""
    return widths.select("rwl", "tree", "year", finite_or_null(F.col("width")).alias("width"))


def tree_stats(widths: DataFrame) -> DataFrame:
    """First and last year, age, mean, sd and lag-1 autocorrelation of every tree.

    One shuffle and one sort by tree: both windows and the aggregation share
    them.  The autocorrelation pairs neighbouring measured rings.
    """
    by_year = Window.partitionBy(*TREE).orderBy("year")
    whole = by_year.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    centred = (
        clean_widths(widths)
        .filter(F.col("width").isNotNull())
        .withColumn("dev", F.col("width") - F.avg("width").over(whole))
        .withColumn("prev_dev", F.lag("dev").over(by_year))
    )
    first, last = F.min("year"), F.max("year")
    return centred.groupBy(*TREE).agg(
        first.alias("first"),
        last.alias("last"),
        (last - first + 1).alias("age"),
        F.avg("width").alias("mean_growth"),
        F.stddev_samp("width").alias("growth_sd"),
        F.try_divide(F.sum(F.col("dev") * F.col("prev_dev")), F.sum(F.col("dev") * F.col("dev"))).alias(
            "ar1"
        ),
    )


def site_ages(stats: DataFrame) -> DataFrame:
    """Mean tree age and total span of every site."""
    return stats.groupBy("rwl").agg(
        F.avg("age").alias("rwl_meanage"),
        (F.max("last") - F.min("first") + 1).alias("rwl_totage"),
    )


def tree_age(stats: DataFrame, read_flags: DataFrame | None = None) -> DataFrame:
    """Tree statistics with the site ages attached and one row per failed file."""
    trees = lookup_join(stats, site_ages(stats), "rwl", "tree").withColumn(
        "flag", F.lit(None).cast("string")
    )
    if read_flags is None:
        return trees
    return trees.unionByName(read_flags.select("rwl", "flag"), allowMissingColumns=True)


def site_rollup(ages: DataFrame) -> DataFrame:
    """Tree table to site level: ages, mean autocorrelation, oldest and youngest tree."""
    return ages.groupBy("rwl").agg(
        # Equal on all rows of a site, so any of them will do.
        F.max("rwl_meanage").alias("rwl_meanage"),
        F.max("rwl_totage").alias("rwl_totage"),
        F.avg("ar1").alias("mean_ar1"),
        F.max("age").alias("max_age"),
        F.min("age").alias("min_age"),
    )


def metadata_age(ages: DataFrame, metadata: DataFrame) -> DataFrame:
    """Site roll-up with the site metadata; both sides have one row per site."""
    return site_rollup(ages).join(metadata, "rwl", "left")


def bai(widths: DataFrame) -> DataFrame:
    """Basal area increment of every measured ring, built outwards from the pith.

    The radius is the running sum of the measured widths, so the ring that
    ends at radius r and is w wide covers pi * (r^2 - (r - w)^2).
    """
    outward = Window.partitionBy(*TREE).orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    return (
        clean_widths(widths)
        .filter(F.col("width").isNotNull())
        .withColumn("radius", F.sum("width").over(outward))
        .select("rwl", "tree", "year", _ring_area(F.col("radius"), F.col("width")).alias("bai"))
    )


def _ring_area(radius: Column, width: Column) -> Column:
    inner = radius - width
    return F.pi() * (radius * radius - inner * inner)


def site_years(widths: DataFrame) -> DataFrame:
    """First and last year of the site, over all its trees."""
    return widths.groupBy("rwl").agg(F.min("year").alias("site_first"), F.max("year").alias("site_last"))


def _with_site_years(values: DataFrame, spans: DataFrame) -> tuple[DataFrame, WindowSpec]:
    """Values with the span of their site, and the window of a tree that fits.

    The join is salted by tree, and the salt is part of the window's partition
    key, so joining and all windows over a tree share one shuffle even where
    one site holds most of the trees.
    """
    joined = lookup_join(
        values, spans, "rwl", "tree", salts=window_salts(values), keep_salt=True
    )
    return joined, Window.partitionBy("rwl", SALT, "tree").orderBy("year")


def _fill_years(values: DataFrame, tree: WindowSpec, column: str, of_tree: Sequence[str] = ()) -> DataFrame:
    """Every tree over every year of its site; years without a value are NULL.

    Each row also emits the empty years up to the next row of its tree, the
    first row those before it, the last row those up to the site's end.  No
    table of years is joined.  Columns ``of_tree`` are the same in all its rows.
    """
    bounded = values.select(
        *TREE,
        *of_tree,
        "year",
        column,
        F.coalesce(F.lead("year").over(tree) - 1, F.col("site_last")).alias("_to"),
        F.when(F.lag("year").over(tree).isNull(), F.col("site_first"))
        .otherwise(F.col("year"))
        .alias("_from"),
    )
    return bounded.select(
        *TREE, *of_tree, F.explode(F.sequence("_from", "_to")).alias("_y"), "year", column
    ).select(
        *TREE,
        F.col("_y").alias("year"),
        F.when(F.col("_y") == F.col("year"), F.col(column)).alias(column),
        *of_tree,
    )


def bai_dense(widths: DataFrame, trees: DataFrame | None = None) -> DataFrame:
    """Basal area increment for all years of the site, NULL outside a tree's life.

    The columns of ``trees``, one row per tree, are joined to the measured
    rings before the years are filled, so that the dense rows are not shuffled.
    """
    measured = clean_widths(widths).filter(F.col("width").isNotNull())
    of_tree = [] if trees is None else [c for c in trees.columns if c not in TREE]
    if trees is not None:
        measured = measured.join(trees, TREE, "left")
    bounded, tree = _with_site_years(measured, site_years(widths))
    radius = F.sum("width").over(tree.rowsBetween(Window.unboundedPreceding, 0))
    areas = bounded.withColumn("radius", radius).withColumn(
        "bai", _ring_area(F.col("radius"), F.col("width"))
    )
    return _fill_years(areas, tree, "bai", of_tree)


def dense_widths(widths: DataFrame) -> DataFrame:
    """Ring widths for all years of the site, NULL outside a tree's life."""
    bounded, tree = _with_site_years(clean_widths(widths), site_years(widths))
    return _fill_years(bounded, tree, "width")


def site_trend(chronologies: DataFrame, years: tuple[int, int] = TREND_YEARS) -> DataFrame:
    """Slope of the site chronology on year within the window, with its row count."""
    return (
        chronologies.filter(F.col("year").between(*years))
        .groupBy("rwl")
        .agg(
            F.count(F.lit(1)).alias("n_years"),
            F.regr_slope(finite_or_null(F.col("std")), F.col("year")).alias("growth_slope"),
        )
    )


def tree_trend(bai_rows: DataFrame, years: tuple[int, int] = TREND_YEARS) -> DataFrame:
    """Slope of basal area increment on year for every tree."""
    return (
        bai_rows.filter(is_finite(F.col("bai")))
        .filter(F.col("year").between(*years))
        .groupBy(*TREE)
        .agg(F.regr_slope("bai", "year").alias("growth_slope"))
    )


def chronology_cv(chronologies: DataFrame) -> DataFrame:
    """Standard deviation and coefficient of variation of every chronology."""
    std = finite_or_null(F.col("std"))
    return chronologies.groupBy("rwl").agg(
        F.stddev_samp(std).alias("sd"),
        F.try_divide(F.stddev_samp(std), F.avg(std)).alias("cv"),
    )


def relative_widths(widths: DataFrame) -> DataFrame:
    """Width divided by the mean of its tree: the simplest dimensionless index."""
    tree = Window.partitionBy(*TREE)
    return (
        clean_widths(widths)
        .filter(F.col("width").isNotNull())
        .select(
            "rwl",
            "tree",
            "year",
            F.try_divide(F.col("width"), F.avg("width").over(tree)).alias("rwi"),
        )
    )


def growth_trend_flags(widths: DataFrame, read_flags: DataFrame | None = None) -> DataFrame:
    """Sites whose widths cannot be detrended: a series with missing inner rings."""
    measured = clean_widths(widths).filter(F.col("width").isNotNull())
    gapped = (
        measured.groupBy(*TREE)
        .agg((F.max("year") - F.min("year") + 1 != F.count(F.lit(1))).alias("gap"))
        .filter("gap")
        .select("rwl")
        .distinct()
        .withColumn("flag", F.lit(FLAG_DETREND))
    )
    return gapped if read_flags is None else read_flags.select("rwl", "flag").unionByName(gapped)
