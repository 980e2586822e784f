"""Correlation of every tree with the chronology of the other trees of its site."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cambium.functions.numeric import correlation_p_greater, finite_or_null, let, safe_corr
from cambium.operators.chronology import SITE_YEAR, biweight_weight, middle_ranks
from cambium.operators.growth import TREE
from cambium.operators.skew import MAX_GROUP, exact_ranks, lookup_join, split_hot
from cambium.operators.spline import explode_series, series_arrays

# Fixed value: flag of a site where no tree has another one to be compared with.
FLAG_ALONE = "Interseries Correlation failed"

# Decimal places kept before ranking, so that equal means stay equal ranks.
RANK_DECIMALS = 10


def median_without(n: Column, low: Column, mid: Column, high: Column, value: Column) -> Column:
    """Median of a sorted group after taking one member ``value`` out.

    ``low, mid, high`` are the members at ranks n/2, n/2 + 1 and n/2 + 2
    (integer division).  Where the removed member lies relative to the middle
    decides which of at most three medians remains, so no pair of members is
    ever formed.
    """
    even = F.when(value <= low, mid).otherwise(low)
    odd = (
        F.when(value < mid, (mid + high) / 2)
        .when(value == mid, (low + high) / 2)
        .otherwise((low + mid) / 2)
    )
    return F.when(n % 2 == 0, even).otherwise(odd)


def _middle(values: Column) -> Column:
    n = F.size(values)
    half = F.floor(n / 2).cast("int")
    return F.struct(
        F.element_at(values, F.greatest(half, F.lit(1))).alias("low"),
        F.element_at(values, half + 1).alias("mid"),
        F.element_at(values, F.least(half + 2, n)).alias("high"),
    )


def _possible(n: Column, m: Column) -> Column:
    """All medians that can remain after one removal."""
    return F.array_distinct(
        F.when(n % 2 == 0, F.array(m["low"], m["mid"])).otherwise(
            F.array(
                (m["mid"] + m["high"]) / 2, (m["low"] + m["high"]) / 2, (m["low"] + m["mid"]) / 2
            )
        )
    )


def _sums(members: Column, centre: Column, mad: Column) -> Column:
    def add(acc: Column, v: Column) -> Column:
        w = biweight_weight(v, centre, mad)
        return F.struct((acc["w"] + w).alias("w"), (acc["wv"] + w * v).alias("wv"))

    start = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("wv"))
    return F.when(mad > 0.0, F.aggregate(members, start, add)).otherwise(start)


def _others_mean(n: Column, value: Column, centre: Column, mad: Column, sums: Column) -> Column:
    """Robust mean of the others from sums over everybody minus the own share.

    With fewer than three others the mean is their median.  Otherwise half of
    the others weigh nearly 1, so the difference of the sums loses no digits.
    """
    own = biweight_weight(value, centre, F.when(mad > 0.0, mad))
    robust = F.try_divide(sums["wv"] - own * value, sums["w"] - own)
    return (
        F.when(n < 2, F.lit(None).cast("double"))
        .when((n < 4) | (mad == 0.0), centre)
        .otherwise(robust)
    )


def _weightings(values: Column) -> Column:
    """For every possible median of the others, the weighted sums per possible spread."""
    n = F.size(values)

    def about(centre: Column) -> Column:
        spread = F.array_sort(F.transform(values, lambda v: F.abs(v - centre)))

        def per_spread(dev: Column) -> Column:
            return F.struct(
                centre.alias("centre"),
                dev.alias("dev"),
                F.transform(
                    _possible(n, dev),
                    lambda mad: F.struct(mad.alias("mad"), _sums(values, centre, mad).alias("sums")),
                ).alias("by_mad"),
            )

        return let(let(spread, _middle), per_spread)

    return let(_middle(values), lambda m: F.transform(_possible(n, m), about))


def _without_each(members: Column) -> Column:
    """Every member of a sorted group with the robust mean of the others."""

    def with_values(values: Column) -> Column:
        group = F.struct(
            F.size(values).alias("n"),
            _middle(values).alias("mid"),
            F.when(F.size(values) >= 4, _weightings(values)).alias("table"),
        )
        return let(group, lambda g: F.transform(members, lambda e: without(e, g)))

    def without(e: Column, g: Column) -> Column:
        n, m, v = g["n"], g["mid"], e["v"]

        def with_centre(centre: Column) -> Column:
            about = F.element_at(F.filter(g["table"], lambda t: t["centre"] == centre), 1)
            return let(about, lambda t: with_table(centre, t))

        def with_table(centre: Column, t: Column) -> Column:
            d = t["dev"]
            mad = median_without(n, d["low"], d["mid"], d["high"], F.abs(v - centre))
            return let(mad, lambda mad: let(sums_for(t, mad), lambda s: result(centre, mad, s)))

        def sums_for(t: Column, mad: Column) -> Column:
            return F.element_at(F.filter(t["by_mad"], lambda s: s["mad"] == mad), 1)["sums"]

        def result(centre: Column, mad: Column, sums: Column) -> Column:
            return F.struct(
                e["tree"].alias("tree"),
                v.alias("value"),
                (n - 1).cast("bigint").alias("n_others"),
                _others_mean(n, v, centre, mad, sums).alias("master"),
            )

        return let(median_without(n, m["low"], m["mid"], m["high"], v), with_centre)

    return let(F.transform(members, lambda e: e["v"]), with_values)


def _others_in_arrays(df: DataFrame, value: str) -> DataFrame:
    """Ordinary groups: one array per site and year, at most nine weightings of it."""
    member = F.struct(F.col(value).alias("v"), F.col("tree").alias("tree"))
    groups = df.groupBy(*SITE_YEAR).agg(F.sort_array(F.collect_list(member)).alias("_m"))
    return groups.select(*SITE_YEAR, F.inline(_without_each(F.col("_m")))).select(
        *TREE, "year", F.col("value").alias(value), "n_others", "master"
    )


def _others_distributed(df: DataFrame, value: str, max_group: int) -> DataFrame:
    """The same for sites too large for arrays: order statistics and partial sums."""
    by = ["tree"]
    middle = exact_ranks(df, SITE_YEAR, value, by, [0.5], middle_ranks, max_group).select(
        *SITE_YEAR, "n", F.struct(F.col("v0_0").alias("low"), F.col("v0_1").alias("mid"), F.col("v0_2").alias("high")).alias("_mid")
    )
    rows = lookup_join(df.select(*TREE, "year", value), middle, SITE_YEAR, by, "inner")
    m, v = F.col("_mid"), F.col(value)
    rows = rows.withColumn("_centre", median_without(F.col("n"), m["low"], m["mid"], m["high"], v))
    about = rows.select(
        *SITE_YEAR, "tree", value, F.explode(_possible(F.col("n"), m)).alias("_about")
    ).withColumn("_dev", F.abs(v - F.col("_about")))
    spread = exact_ranks(about, [*SITE_YEAR, "_about"], "_dev", by, [0.5], middle_ranks, max_group).select(
        *SITE_YEAR,
        "_about",
        F.struct(F.col("v0_0").alias("low"), F.col("v0_1").alias("mid"), F.col("v0_2").alias("high")).alias("_dmid"),
        F.col("n").alias("_dn"),
    )
    weighted = lookup_join(about, spread, [*SITE_YEAR, "_about"], by, "inner").withColumn(
        "_mad", F.explode(_possible(F.col("_dn"), F.col("_dmid")))
    )
    w = F.when(
        F.col("_mad") > 0.0, biweight_weight(v, F.col("_about"), F.when(F.col("_mad") > 0.0, F.col("_mad")))
    ).otherwise(0.0)
    sums = (
        weighted.withColumn("_w", w)
        .groupBy(*SITE_YEAR, "_about", "_mad")
        .agg(F.sum("_w").alias("w"), F.sum(F.col("_w") * v).alias("wv"))
        .groupBy(*SITE_YEAR, "_about")
        .agg(
            F.collect_list(
                F.struct(F.col("_mad").alias("mad"), F.struct("w", "wv").alias("sums"))
            ).alias("_by_mad")
        )
        .join(spread, [*SITE_YEAR, "_about"])
        .withColumnRenamed("_about", "_centre")
    )
    d = F.col("_dmid")
    picked = lookup_join(rows, sums, [*SITE_YEAR, "_centre"], by, "inner").withColumn(
        "_s",
        let(
            median_without(F.col("n"), d["low"], d["mid"], d["high"], F.abs(v - F.col("_centre"))),
            lambda mad: F.element_at(F.filter("_by_mad", lambda s: s["mad"] == mad), 1),
        ),
    )
    others = _others_mean(F.col("n"), v, F.col("_centre"), F.col("_s.mad"), F.col("_s.sums"))
    return picked.select(*TREE, "year", value, (F.col("n") - 1).alias("n_others"), others.alias("master"))


def others_chronology(
    series: DataFrame,
    value: str = "rwi",
    max_group: int = MAX_GROUP,
    stored: bool = False,
) -> DataFrame:
    """For every tree and year, the robust mean of the other trees of the site.

    Work and shuffle grow with the number of trees, not with its square: the
    mean without a tree follows from group sums and the tree's own share.  The
    series are computed once (``split_hot``; ``stored``: they are a stored table).
    """
    present = series.select(*TREE, "year", finite_or_null(F.col(value)).alias(value)).filter(
        F.col(value).isNotNull()
    )
    small, large = split_hot(present, SITE_YEAR, ["tree"], max_group, stored)
    result = _others_in_arrays(small, value)
    return result if large is None else result.unionByName(_others_distributed(large, value, max_group))


def average_rank(column: str, group: list[str]) -> Column:
    """Rank with ties sharing their average, within ``group``."""
    ordered = Window.partitionBy(*group).orderBy(column)
    ties = Window.partitionBy(*group, column)
    return F.rank().over(ordered) + (F.count(F.lit(1)).over(ties) - 1) / 2.0


def ar_residuals(values: np.ndarray) -> np.ndarray:
    """Residuals plus mean of a Yule-Walker autoregression, order chosen by AIC."""
    x = np.asarray(values, dtype=float)
    n = len(x)
    result = np.full(n, np.nan)
    mean = x.mean()
    centred = x - mean
    # Too short, or nothing to remove: the series stays as it is.
    if n < 4 or not np.any(centred != 0.0):
        return x
    max_order = int(min(n - 1, np.floor(10.0 * np.log10(n))))
    cov = np.array([centred[: n - k] @ centred[k:] for k in range(max_order + 1)]) / n
    best, best_aic = np.empty(0), n * np.log(cov[0]) + 2.0
    coef, variance = np.empty(0), cov[0]
    for p in range(1, max_order + 1):
        reflection = (cov[p] - coef @ cov[p - 1 : 0 : -1]) / variance if p > 1 else cov[1] / cov[0]
        coef = np.append(coef - reflection * coef[::-1], reflection)
        variance *= 1.0 - reflection**2
        if variance <= 0.0:
            break
        aic = n * np.log(variance) + 2.0 * p + 2.0
        if aic < best_aic:
            best, best_aic = coef.copy(), aic
    order = len(best)
    residual = centred[order:].copy()
    for k, c in enumerate(best, start=1):
        residual -= c * centred[order - k : n - k]
    result[order:] = residual + mean
    return result


def prewhiten(series: DataFrame, value: str = "rwi") -> DataFrame:
    """Remove each tree's own autocorrelation; the first years of a fit are lost."""

    def whiten(values: pd.Series) -> pd.Series:
        return pd.Series([ar_residuals(v) for v in values], index=values.index)

    kernel = F.pandas_udf(whiten, T.ArrayType(T.DoubleType()))
    rows = explode_series(series_arrays(series, value).withColumn("_result", kernel("_value")), value)
    return rows.select(*TREE, "year", finite_or_null(F.col(value)).alias(value)).filter(
        F.col(value).isNotNull()
    )


def scaled_to_mean(series: DataFrame, value: str = "rwi") -> DataFrame:
    tree = Window.partitionBy(*TREE)
    scaled = F.try_divide(F.col(value), F.avg(value).over(tree))
    return series.select(*TREE, "year", F.coalesce(scaled, F.col(value)).alias(value))


def interseries_cor(
    rwi: DataFrame,
    prewhitened: bool = True,
    method: str = "spearman",
    max_group: int = MAX_GROUP,
) -> DataFrame:
    """Correlation of each tree with the others' chronology, with a one-sided p value."""
    clean = rwi.select(*TREE, "year", finite_or_null(F.col("rwi")).alias("rwi")).filter(
        F.col("rwi").isNotNull()
    )
    series = scaled_to_mean(clean)
    if prewhitened:
        series = prewhiten(series)
    # One shuffle by tree serves the ranks and the final aggregation.
    pairs = (
        others_chronology(series, "rwi", max_group)
        .select(
            *TREE,
            F.round("rwi", RANK_DECIMALS).alias("x"),
            F.round("master", RANK_DECIMALS).alias("y"),
        )
        .repartition(*TREE)
        .withColumn("paired", F.col("y").isNotNull())
    )
    if method == "spearman":
        group = [*TREE, "paired"]
        pairs = pairs.withColumn("rx", average_rank("x", group)).withColumn("ry", average_rank("y", group))
        x, y = F.col("rx"), F.col("ry")
    else:
        x, y = F.col("x"), F.col("y")
    # Trees without any other tree at the site keep their row, with a NULL.
    return (
        pairs.groupBy(*TREE)
        .agg(
            safe_corr(F.when(F.col("paired"), x), F.when(F.col("paired"), y)).alias("res_cor"),
            F.count("y").alias("n_years"),
        )
        .select(
            *TREE,
            "res_cor",
            correlation_p_greater(F.col("res_cor"), F.col("n_years")).alias("p_val"),
            "n_years",
        )
    )


def interseries_site(trees: DataFrame) -> DataFrame:
    """Mean correlation and mean p value of every site."""
    return trees.groupBy("rwl").agg(
        F.avg(finite_or_null(F.col("res_cor"))).alias("mean_cor"),
        F.avg(finite_or_null(F.col("p_val"))).alias("mean_pval"),
    )


def interseries_flags(trees: DataFrame, read_flags: DataFrame | None = None) -> DataFrame:
    """Sites where no tree has another one to be compared with."""
    failed = (
        trees.groupBy("rwl")
        .agg(F.count("res_cor").alias("_n"))
        .filter("_n = 0")
        .select("rwl", F.lit(FLAG_ALONE).alias("flag"))
    )
    return failed if read_flags is None else read_flags.select("rwl", "flag").unionByName(failed)
