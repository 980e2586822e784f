"""Spline detrending of whole batches of series at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cambium.operators.growth import TREE
from cambium.operators.series import rows, tree_series


# Series solved together; bounds the memory of one solve.
CHUNK = 512


def smoothing_weight(period: np.ndarray) -> np.ndarray:
    """Spline stiffness that leaves half the amplitude of a wave of this period."""
    cosine = np.cos(2.0 * np.pi / period)
    return (2.0 + cosine) / (12.0 * (1.0 - cosine) ** 2)


def fit_splines(series: list[np.ndarray], period: float | None = None) -> list[np.ndarray]:
    """Natural cubic smoothing splines on yearly knots, many series side by side.

    Series of similar length are solved together, ``CHUNK`` at a time, which
    bounds the memory of a task and wastes little on padding.
    """
    lengths = np.array([len(s) for s in series], dtype=int)
    fitted: list[np.ndarray] = [np.asarray(s, dtype=float).copy() for s in series]
    order = [int(i) for i in np.argsort(-lengths, kind="stable") if lengths[i] >= 3]
    for start in range(0, len(order), CHUNK):
        chunk = order[start : start + CHUNK]
        for i, curve in zip(chunk, _solve([fitted[i] for i in chunk], period)):
            fitted[i] = curve
    return fitted


def _solve(series: list[np.ndarray], period: float | None) -> list[np.ndarray]:
    """Solve (R + w Q'Q) g = Q'y by LDL' over the years; the curve is y - w Q g.

    The system is symmetric with five constant diagonals.  Column k of every
    array belongs to series k; rows beyond its length are padding.
    """
    n = np.array([len(s) for s in series])
    y = np.zeros((int(n.max()), len(series)))
    for k, s in enumerate(series):
        y[: len(s), k] = s
    periods = np.floor(0.67 * n) if period is None else np.full(len(n), float(period))
    weight = smoothing_weight(np.maximum(periods, 2.0))
    rows = y.shape[0] - 2
    inside = np.arange(rows + 2)[:, None] < (n - 2)[None, :]
    z = np.where(inside[:rows], y[2:] - 2.0 * y[1:-1] + y[:-2], 0.0)
    main, next_to = 2.0 / 3.0 + 6.0 * weight, 1.0 / 6.0 - 4.0 * weight
    pivot = np.ones((rows, len(series)))
    below1 = np.zeros((rows + 2, len(series)))
    below2 = np.zeros((rows + 2, len(series)))
    for t in range(rows):
        value, coupling = main.copy(), next_to.copy()
        if t >= 1:
            value -= below1[t] ** 2 * pivot[t - 1]
            coupling -= below2[t + 1] * pivot[t - 1] * below1[t]
            z[t] -= below1[t] * z[t - 1]
        if t >= 2:
            value -= below2[t] ** 2 * pivot[t - 2]
            z[t] -= below2[t] * z[t - 2]
        pivot[t] = np.where(inside[t], value, 1.0)
        below1[t + 1] = np.where(inside[t + 1], coupling / pivot[t], 0.0)
        below2[t + 2] = np.where(inside[t + 2] if t + 2 < rows else False, weight / pivot[t], 0.0)
    g = z / pivot
    for t in range(rows - 2, -1, -1):
        g[t] -= below1[t + 1] * g[t + 1]
        if t + 2 < rows:
            g[t] -= below2[t + 2] * g[t + 2]
    bend = np.zeros_like(y)
    bend[:-2] += g
    bend[1:-1] -= 2.0 * g
    bend[2:] += g
    smooth = y - weight * bend
    return [smooth[: len(s), k] for k, s in enumerate(series)]


def detrended(series: list[np.ndarray], period: float | None, zero_as: float) -> list[np.ndarray]:
    """Ratio of each series to its spline, to its mean where the spline is not positive."""
    filled = [np.where(s == 0.0, zero_as, s) for s in series]
    out = []
    for raw, curve in zip(filled, fit_splines(filled, period)):
        if len(raw) and not np.all(curve > 0.0):
            curve = np.full(len(raw), raw.mean())
        with np.errstate(divide="ignore", invalid="ignore"):
            out.append(raw / curve)
    return out


def series_arrays(values: DataFrame, column: str) -> DataFrame:
    """One row per tree: its values in year order.  A tree is bounded by its years."""
    return (
        values.filter(F.col(column).isNotNull())
        .groupBy(*TREE)
        .agg(F.sort_array(F.collect_list(F.struct("year", column))).alias("_s"))
        .select(*TREE, F.col("_s.year").alias("_year"), F.col(f"_s.{column}").alias("_value"))
    )


def explode_series(arrays: DataFrame, result: str) -> DataFrame:
    return arrays.select(*TREE, F.inline(F.arrays_zip("_year", "_result"))).select(
        *TREE, F.col("_year").alias("year"), F.col("_result").alias(result)
    )


def detrend_series(series: DataFrame, nyrs: float | None = None, zero_as: float = 0.001) -> DataFrame:
    """Adds ``rwi`` to trees as one row each (``tree_series``): width over its smoothing spline.

    The default stiffness keeps half the amplitude at 67 % of the series
    length.  Series travel as arrays in Arrow batches, so Python is entered
    once per batch, not once per tree.
    """

    def ratio(values: pd.Series) -> pd.Series:
        return pd.Series(
            detrended([np.asarray(v, dtype=float) for v in values], nyrs, zero_as), index=values.index
        )

    return series.withColumn("rwi", F.pandas_udf(ratio, T.ArrayType(T.DoubleType()))("width"))


def detrend_spline(
    widths: DataFrame, nyrs: float | None = None, zero_as: float = 0.001
) -> DataFrame:
    """Growth index of every tree, one row per ring (``detrend_series``)."""
    return rows(detrend_series(tree_series(widths), nyrs, zero_as), "year", "rwi")
