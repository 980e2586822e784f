"""Null-safe numeric expressions.

Missing values are always NULL here: NaN and infinities are turned into NULL on
the way in, because Spark's ``avg`` would otherwise spread them, and every
division is a ``try_divide`` because ANSI mode raises on a zero divisor.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite_or_null(value: Column) -> Column:
    """NULL for NULL, NaN and infinities, the value itself otherwise."""
    value = value.cast("double")
    bad = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(~bad, value)


def is_finite(value: Column) -> Column:
    return finite_or_null(value).isNotNull()


def both(x: Column, y: Column) -> Column:
    """``x`` where ``y`` is present too."""
    return F.when(y.isNotNull(), x)


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation aggregate; NULL where either side has no variance.

    The built-in ``corr`` raises on a group without variance.
    """
    spread = F.stddev_pop(both(x, y)) * F.stddev_pop(both(y, x))
    return F.try_divide(F.covar_pop(x, y), spread)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it inside ``body``, lambdas included.

    A plain ``withColumn`` may be merged into its consumer by the optimizer,
    which would re-evaluate an expensive array expression once per element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def decimals(value: Column) -> Column:
    """Number of decimal places a double shows when printed."""
    return F.length(F.regexp_extract(value.cast("decimal(38,9)").cast("string"), r"\.(\d*?)0*$", 1))


def upper_tail_t(t: Column, df: Column) -> Column:
    """P(T > t) for Student's t with an integer number of degrees of freedom.

    For integer degrees of freedom the distribution function is a finite
    trigonometric sum (Abramowitz & Stegun 26.7.3 and 26.7.4), so it stays an
    ordinary column expression.  The sum has about df/2 terms.
    """
    df = df.cast("int")
    theta = F.atan(t / F.sqrt(df))
    odd = df % 2 == 1
    n_terms = F.floor((df - F.when(odd, 3).otherwise(2)) / 2).cast("int")
    steps = F.when(n_terms >= 1, F.sequence(F.lit(1), n_terms)).otherwise(
        F.array().cast("array<int>")
    )

    def series(angle_odd: Column) -> Column:
        cos2 = F.pow(F.cos(angle_odd["theta"]), 2)

        def add(acc: Column, k: Column) -> Column:
            ratio = F.when(angle_odd["odd"], (2.0 * k) / (2.0 * k + 1.0)).otherwise(
                (2.0 * k - 1.0) / (2.0 * k)
            )
            term = acc["term"] * ratio * cos2
            return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

        start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
        return F.aggregate(steps, start, add, lambda acc: acc["total"])

    total = let(F.struct(theta.alias("theta"), odd.alias("odd")), series)
    central = (
        F.when(df == 1, 2.0 / F.pi() * theta)
        .when(odd, 2.0 / F.pi() * (theta + F.sin(theta) * F.cos(theta) * total))
        .otherwise(F.sin(theta) * total)
    )
    return F.when(df >= 1, (1.0 - central) / 2.0)


def correlation_p_greater(r: Column, n: Column) -> Column:
    """One-sided p value (alternative: positive) of a correlation of ``n`` pairs."""
    t = F.try_divide(r * F.sqrt(n - 2), F.sqrt(1.0 - r * r))
    return (
        F.when(n < 3, F.lit(None).cast("double"))
        .when(r >= 1.0, 0.0)
        .when(r <= -1.0, 1.0)
        .otherwise(upper_tail_t(t, n - 2))
    )
