"""Resistance, recovery, resilience and relative resilience around single years."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cambium.functions.numeric import finite_or_null
from cambium.operators.growth import TREE
from cambium.operators.skew import lookup_join

# Output column of each component, its spread and its tree count.
COMPONENTS = {
    "resil": ("resilience", "resilience_sd", "resilience_series"),
    "rel_resil": ("rel_resilience", "rel_resilience_sd", "rel_resilience_series"),
    "resist": ("resistance", "resistance_sd", "resistance_series"),
    "recov": ("recovery", "recovery_sd", "recovery_series"),
}


def resilience_tree(index: DataFrame, pre: int = 4, post: int = 4) -> DataFrame:
    """Components of every tree and year (Lloret et al. 2011).

    The frames are ranges over years, so a missing year makes a frame
    incomplete instead of moving it.
    """
    tree = Window.partitionBy(*TREE).orderBy("year")
    before, after = tree.rangeBetween(-pre, -1), tree.rangeBetween(1, post)
    during = F.col("index")
    frames = index.select(
        *TREE,
        "year",
        finite_or_null(during).alias("index"),
        F.when(F.count(during).over(before) == pre, F.avg(during).over(before)).alias("_pre"),
        F.when(F.count(during).over(after) == post, F.avg(during).over(after)).alias("_post"),
    )
    before_mean, after_mean = F.col("_pre"), F.col("_post")
    return frames.select(
        *TREE,
        "year",
        F.try_divide(during, before_mean).alias("resist"),
        F.try_divide(after_mean, during).alias("recov"),
        F.try_divide(after_mean, before_mean).alias("resil"),
        F.try_divide(after_mean - during, before_mean).alias("rel_resil"),
    )


def recovery_period(index: DataFrame, pre: int = 4, max_years: int = 10) -> DataFrame:
    """Years until growth first regains the mean before the event, at most ``max_years``."""
    tree = Window.partitionBy(*TREE).orderBy("year")
    before, after = tree.rangeBetween(-pre, -1), tree.rangeBetween(1, max_years)
    level = F.when(F.count("index").over(before) == pre, F.avg("index").over(before))
    later = F.collect_list(F.struct("year", "index")).over(after)
    framed = index.select(*TREE, "year", "index", level.alias("_level"), later.alias("_later"))
    regained = F.filter("_later", lambda s: s["index"] >= F.col("_level"))
    years = F.array_min(F.transform(regained, lambda s: s["year"])) - F.col("year")
    dropped = F.col("index") < F.col("_level")
    return framed.select(*TREE, "year", F.when(dropped, years).alias("rec_period"))


def resilience_site_year(trees: DataFrame) -> DataFrame:
    """Mean, sd and number of trees of each component per site and year."""
    aggregates = []
    for column, (mean, sd, count) in COMPONENTS.items():
        value = finite_or_null(F.col(column))
        aggregates += [
            F.avg(value).alias(mean),
            F.stddev_samp(value).alias(sd),
            F.count(value).alias(count),
        ]
    return trees.groupBy("rwl", F.col("year").alias("pointer_year")).agg(*aggregates)


def resilience_flags(guards: DataFrame, read_flags: DataFrame | None = None) -> DataFrame:
    """Sites that fail a guard on trees or years."""
    flags = guards.filter(F.col("guard").isNotNull()).select("rwl", F.col("guard").alias("flag"))
    return flags if read_flags is None else flags.unionByName(read_flags.select("rwl", "flag"))


def resilience_site(
    trees: DataFrame, guards: DataFrame, years: DataFrame, read_flags: DataFrame | None = None
) -> DataFrame:
    """Site components in the frequent pointer years, then one row per failed site.

    The trees are aggregated first, on the map side already, so the year filter
    sees one row per site and year; a single year holds a row of every site,
    which is why that join is spread by site.
    """
    passing = guards.filter(F.col("guard").isNull()).select("rwl")
    chosen = lookup_join(resilience_site_year(trees), years, "pointer_year", "rwl", "left_semi")
    site_years = chosen.join(passing, "rwl", "left_semi")
    return site_years.withColumn("flag", F.lit(None).cast("string")).unionByName(
        resilience_flags(guards, read_flags), allowMissingColumns=True
    )


def full_outer_components(parts: list[DataFrame]) -> DataFrame:
    """Component tables kept apart by a caller, joined on site and pointer year."""
    joined = parts[0]
    for part in parts[1:]:
        joined = joined.join(part, ["rwl", "pointer_year"], "full_outer")
    return joined
