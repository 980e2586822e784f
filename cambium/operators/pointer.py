"""Pointer years: low-pass index, moving z scores, class shares, guards and flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cambium.operators.growth import TREE, clean_widths
from cambium.operators.series import LOWPASS_WEIGHTS
from cambium.operators.skew import lookup_join

# Z limits of the three intensity classes.
WEAK, STRONG, EXTREME = 1.0, 1.28, 1.645

# Flag texts in the order the guards are applied.
FLAG_READ = "reading rwl file failed"
FLAG_TREES = "less than 3 trees"
FLAG_YEARS = "Less than 26 years"
FLAG_FILTERED = "Less than 26 years after detrend"
FLAG_OLD = "older than 1900"
FLAG_NONE = "no pointer years calculated"

MIN_TREES = 3
MIN_YEARS = 26
FROM_YEAR = 1900


def lowpass13(widths: DataFrame, mode: str = "ratio") -> DataFrame:
    """Index of every ring against a 13-year weighted low-pass of its series.

    Only years with a complete kernel are kept.  Rows with a width are unique
    per year, so the kernel is complete exactly when the sixth neighbours on
    both sides are six years away; no year grid has to be joined.  ``mode`` is
    ``ratio`` (width over filtered) or ``smooth`` (the filtered series itself).
    """
    tree = Window.partitionBy(*TREE).orderBy("year")
    reach = len(LOWPASS_WEIGHTS) // 2
    total = float(sum(LOWPASS_WEIGHTS))
    smooth = F.lit(0.0)
    for k, weight in enumerate(LOWPASS_WEIGHTS):
        offset = k - reach
        neighbour = F.col("width") if offset == 0 else F.lag("width", -offset).over(tree)
        smooth = smooth + neighbour * (weight / total)
    complete = (F.col("year") - F.lag("year", reach).over(tree) == reach) & (
        F.lead("year", reach).over(tree) - F.col("year") == reach
    )
    filtered = (
        clean_widths(widths)
        .filter(F.col("width").isNotNull())
        .select(*TREE, "year", "width", smooth.alias("smooth"), complete.alias("complete"))
        .filter("complete")
    )
    value = F.try_divide(F.col("width"), F.col("smooth")) if mode == "ratio" else F.col("smooth")
    return filtered.select(*TREE, "year", value.alias("index"))


def growth_z(index: DataFrame, window: int = 13) -> DataFrame:
    """z score of every ring within a centred moving window that must be complete.

    The window has as many years before the ring as after it, so it is odd.
    """
    if window % 2 == 0:
        raise ValueError("a centred window has an odd number of years")
    reach = window // 2
    around = Window.partitionBy(*TREE).orderBy("year").rangeBetween(-reach, reach)
    moving = index.select(
        *TREE,
        "year",
        "index",
        F.count("index").over(around).alias("_n"),
        F.avg("index").over(around).alias("_mean"),
        F.stddev_samp("index").over(around).alias("_sd"),
    )
    z = F.try_divide(F.col("index") - F.col("_mean"), F.col("_sd"))
    return moving.select(*TREE, "year", F.when(F.col("_n") == window, z).alias("z")).filter(
        F.col("z").isNotNull()
    )


def _share(condition: Column) -> Column:
    return F.avg(F.when(condition, 100.0).otherwise(0.0))


def pointer_years(z: DataFrame, thresh: float = 60.0) -> DataFrame:
    """Share of trees per intensity class and the nature of every site year.

    The classes exclude each other; a year is a pointer year when all classes
    of one sign together reach ``thresh`` percent of the trees.
    """
    v = F.col("z")
    shares = z.groupBy("rwl", "year").agg(
        F.count("z").alias("nb_series"),
        _share(v > EXTREME).alias("perc_pos_extreme"),
        _share((v > STRONG) & (v <= EXTREME)).alias("perc_pos_strong"),
        _share((v > WEAK) & (v <= STRONG)).alias("perc_pos_weak"),
        _share(v < -EXTREME).alias("perc_neg_extreme"),
        _share((v < -STRONG) & (v >= -EXTREME)).alias("perc_neg_strong"),
        _share((v < -WEAK) & (v >= -STRONG)).alias("perc_neg_weak"),
        F.count_if(v > WEAK).alias("_n_pos"),
        F.count_if(v < -WEAK).alias("_n_neg"),
    )
    # Compare counts, so a share of exactly ``thresh`` is not lost to rounding.
    needed = F.col("nb_series") * (thresh / 100.0)
    nature = F.when(F.col("_n_pos") >= needed, 1).when(F.col("_n_neg") >= needed, -1).otherwise(0)
    return shares.withColumn("nature", nature).drop("_n_pos", "_n_neg")


def missing_rings(widths: DataFrame) -> DataFrame:
    """Rings coded as missing (0, 0.01, 0.001), number of trees and years per site."""
    w = F.round("width", 4)
    per_tree = clean_widths(widths).groupBy(*TREE).agg(
        F.count_if(w == 0.0).alias("n0"),
        F.count_if(w == 0.01).alias("n2"),
        F.count_if(w == 0.001).alias("n3"),
        F.min("year").alias("lo"),
        F.max("year").alias("hi"),
    )
    return per_tree.groupBy("rwl").agg(
        F.count(F.lit(1)).alias("series_count"),
        (F.max("hi") - F.min("lo") + 1).alias("total_year"),
        F.sum("n0").alias("missing_years_0"),
        F.sum("n2").alias("missing_years_2"),
        F.sum("n3").alias("missing_years_3"),
        (F.sum("n0") + F.sum("n2") + F.sum("n3")).alias("total_missing_years"),
    )


def filtered_years(index: DataFrame) -> DataFrame:
    """Years spanned by the low-pass index of a site."""
    return (
        index.filter(F.col("index").isNotNull())
        .groupBy("rwl")
        .agg((F.max("year") - F.min("year") + 1).alias("filtered_year"))
    )


def site_guards(widths: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """Missing-ring counts of every site with the first guard it fails, if any.

    ``guard`` holds only the guards on trees and years, which pointer years and
    resilience share.
    """
    index = lowpass13(widths) if index is None else index
    counts = missing_rings(widths).join(filtered_years(index), "rwl", "left")
    guard = (
        F.when(F.col("series_count") < MIN_TREES, FLAG_TREES)
        .when(F.col("total_year") < MIN_YEARS, FLAG_YEARS)
        .when(F.coalesce("filtered_year", F.lit(0)) < MIN_YEARS, FLAG_FILTERED)
    )
    return counts.withColumn("guard", guard)


def _years_after_guard() -> Column:
    """Guards up to the year counts report the raw span, later ones the filtered span."""
    raw = F.col("guard").isin(FLAG_TREES, FLAG_YEARS)
    return F.when(raw, F.col("total_year")).otherwise(F.coalesce("filtered_year", F.lit(0)))


COUNTS = [
    "series_count",
    "total_year",
    "missing_years_0",
    "missing_years_2",
    "missing_years_3",
    "total_missing_years",
]


def _negative(pointers: DataFrame, from_year: int) -> DataFrame:
    return (
        pointers.filter((F.col("year") >= from_year) & (F.col("nature") == -1))
        .drop("perc_pos_extreme", "perc_pos_strong", "perc_pos_weak")
        .withColumnsRenamed({"year": "pointer_year", "nb_series": "py_series"})
    )


def pointer_flags(
    guards: DataFrame, pointers: DataFrame, from_year: int = FROM_YEAR, read_flags: DataFrame | None = None
) -> DataFrame:
    """One row per site without a negative pointer year, with the first reason."""
    per_site = pointers.groupBy("rwl").agg(
        F.max(F.col("year") >= from_year).alias("_recent"),
        F.max((F.col("year") >= from_year) & (F.col("nature") == -1)).alias("_negative"),
    )
    flag = (
        F.col("guard"),
        F.when(~F.coalesce("_recent", F.lit(False)), F.lit(FLAG_OLD)),
        F.when(~F.coalesce("_negative", F.lit(False)), F.lit(FLAG_NONE)),
    )
    flagged = (
        guards.join(per_site, "rwl", "left")
        .withColumn("flag", F.coalesce(*flag))
        .filter(F.col("flag").isNotNull())
        .withColumn("total_year", _years_after_guard())
        .select("rwl", "flag", *COUNTS)
    )
    if read_flags is None:
        return flagged
    return flagged.unionByName(read_flags.select("rwl", "flag"), allowMissingColumns=True)


def negative_pointer_years(
    guards: DataFrame, pointers: DataFrame, from_year: int = FROM_YEAR, read_flags: DataFrame | None = None
) -> DataFrame:
    """Negative pointer years of the sites that pass the guards, then the flag rows."""
    passing = guards.filter(F.col("guard").isNull()).withColumn("total_year", _years_after_guard())
    found = _negative(pointers, from_year).join(passing.select("rwl", *COUNTS), "rwl")
    flags = pointer_flags(guards, pointers, from_year, read_flags)
    return found.withColumn("flag", F.lit(None).cast("string")).unionByName(
        flags, allowMissingColumns=True
    )


def pointer_year_freq(negative: DataFrame) -> DataFrame:
    """Number of sites sharing each pointer year; flag rows count under NULL."""
    return negative.groupBy("pointer_year").agg(F.count(F.lit(1)).alias("n"))


def most_frequent(frequency: DataFrame) -> DataFrame:
    """The frequency report in reading order, with the ``place`` of each year.

    One row per calendar year (and one for the flag rows), so one task may order it.
    """
    reading = Window.orderBy(F.desc("n"), "pointer_year")
    return frequency.withColumn("place", F.row_number().over(reading)).orderBy("place")


def frequent_years(negative: DataFrame, min_n: int = 10) -> DataFrame:
    """Pointer years shared by more than ``min_n`` sites."""
    return (
        pointer_year_freq(negative)
        .filter((F.col("n") > min_n) & F.col("pointer_year").isNotNull())
        .select("pointer_year")
    )


def select_sites(widths: DataFrame, sites: DataFrame) -> DataFrame:
    """Keep the rings of chosen sites (semi join, safe for a dominant site)."""
    return lookup_join(widths, sites.select("rwl").distinct(), "rwl", "tree", "left_semi")
