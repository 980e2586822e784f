"""Robust site chronologies: Tukey's biweight mean of all trees of a site and year."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cambium.functions.numeric import finite_or_null, let
from cambium.operators.skew import MAX_GROUP, exact_ranks, lookup_join, split_hot

SITE_YEAR = ["rwl", "year"]

# Fixed value: tuning constant of the biweight, in median absolute deviations.
BIWEIGHT_C = 9.0


def sorted_median(values: Column) -> Column:
    """Median of a sorted array, NULL if it is empty."""
    n = F.size(values)
    half = F.floor((n + 1) / 2).cast("int")
    other = F.floor(n / 2).cast("int") + 1
    middle = (F.try_element_at(values, half) + F.try_element_at(values, other)) / 2
    return F.when(n > 0, middle)


def biweight_weight(value: Column, centre: Column, mad: Column) -> Column:
    u = (value - centre) / (BIWEIGHT_C * mad)
    return F.when(F.abs(u) < 1.0, F.pow(1.0 - u * u, 2)).otherwise(0.0)


def _weighted_mean(values: Column, centre: Column, mad: Column) -> Column:
    def add(acc: Column, v: Column) -> Column:
        w = biweight_weight(v, centre, mad)
        return F.struct((acc["w"] + w).alias("w"), (acc["wv"] + w * v).alias("wv"))

    start = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("wv"))
    return F.aggregate(values, start, add, lambda acc: F.try_divide(acc["wv"], acc["w"]))


def _array_mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
    return F.try_divide(total, F.size(values).cast("double"))


def array_biweight(values: Column) -> Column:
    """Biweight mean of an array: plain mean below 3 values, median if all agree."""

    def around(pair: Column) -> Column:
        return F.when(pair["mad"] == 0.0, pair["centre"]).otherwise(
            _weighted_mean(values, pair["centre"], pair["mad"])
        )

    def with_spread(centre: Column) -> Column:
        spread = F.array_sort(F.transform(values, lambda v: F.abs(v - centre)))
        pair = F.struct(centre.alias("centre"), let(spread, sorted_median).alias("mad"))
        return let(pair, around)

    return F.when(F.size(values) < 3, _array_mean(values)).otherwise(
        let(sorted_median(values), with_spread)
    )


def middle_ranks(n: Column) -> list[list[Column]]:
    """The three ranks around the middle, clamped to the group."""
    half = F.floor(n / 2)
    return [[F.greatest(half, F.lit(1)), half + 1, F.least(half + 2, n)]]


def median_of_middle(n: Column, low: Column, mid: Column) -> Column:
    return F.when(n % 2 == 1, mid).otherwise((low + mid) / 2)


def large_biweight(
    df: DataFrame, keys: Sequence[str], value: str, spread_by: Sequence[str], max_group: int
) -> DataFrame:
    """The same mean for groups too large for an array, by exact order statistics."""

    def median(rows: DataFrame, column: str, name: str) -> DataFrame:
        middle = exact_ranks(rows, keys, column, spread_by, [0.5], middle_ranks, max_group)
        return middle.select(*keys, median_of_middle(F.col("n"), F.col("v0_0"), F.col("v0_1")).alias(name))

    counted = df.groupBy(*keys).agg(F.count(value).alias("n"))
    rows = df.select(*keys, *spread_by, value).filter(F.col(value).isNotNull())
    rows = lookup_join(rows, median(rows, value, "_centre"), keys, spread_by, "inner")
    rows = rows.withColumn("_dev", F.abs(F.col(value) - F.col("_centre")))
    rows = lookup_join(rows, median(rows, "_dev", "_mad"), keys, spread_by, "inner")
    weight = F.when(F.col("_mad") == 0.0, 0.0).otherwise(
        biweight_weight(F.col(value), F.col("_centre"), F.when(F.col("_mad") != 0.0, F.col("_mad")))
    )
    means = (
        rows.withColumn("_w", weight)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(value).alias("_mean"),
            F.max("_mad").alias("_mad"),
            F.max("_centre").alias("_centre"),
            F.try_divide(F.sum(F.col("_w") * F.col(value)), F.sum("_w")).alias("_robust"),
        )
        .select(
            *keys,
            F.when(F.col("n") < 3, F.col("_mean"))
            .when(F.col("_mad") == 0.0, F.col("_centre"))
            .otherwise(F.col("_robust"))
            .alias("robust"),
        )
    )
    # A group of NULLs alone keeps its row.
    return counted.join(means, keys, "left").select(*keys, "n", "robust")


def biweight_mean(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    spread_by: Sequence[str],
    max_group: int = MAX_GROUP,
    stored: bool = False,
) -> DataFrame:
    """Robust mean per group as ``(keys, n, robust)``.

    Ordinary groups take one array; groups beyond ``max_group`` take the
    distributed route.  Both give the same rows and numbers.  ``df`` is computed
    once (``split_hot``).
    """
    keys = list(keys)
    small, large = split_hot(df, keys, spread_by, max_group, stored)
    # As a generated row the mean is computed once, even where later steps filter on it.
    robust = F.struct(
        F.size("_v").cast("bigint").alias("n"), array_biweight(F.col("_v")).alias("robust")
    )
    result = (
        small.groupBy(*keys)
        .agg(F.sort_array(F.collect_list(value)).alias("_v"))
        .select(*keys, F.inline(F.array(robust)))
    )
    if large is None:
        return result
    return result.unionByName(large_biweight(large, keys, value, list(spread_by), max_group))


def chronology(
    rwi: DataFrame,
    biweight: bool = True,
    max_group: int = MAX_GROUP,
    stored: bool = False,
) -> DataFrame:
    """Site chronology: yearly mean index and the number of trees behind it.

    ``stored``: ``rwi`` is a stored table, and reading it again is cheap.
    """
    values = rwi.select("rwl", "tree", "year", finite_or_null(F.col("rwi")).alias("rwi"))
    if not biweight:
        return values.groupBy(*SITE_YEAR).agg(
            F.avg("rwi").alias("std"), F.count("rwi").alias("samp_depth")
        )
    means = biweight_mean(values, SITE_YEAR, "rwi", ["tree"], max_group, stored)
    return means.select("rwl", "year", F.col("robust").alias("std"), F.col("n").alias("samp_depth"))
