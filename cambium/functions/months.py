"""Month names, the 16-month climate window and grid layer numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Calendar abbreviations used in wide column names such as 1901_Jan.
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

# First calendar year of the monthly grids, last year, and the
# number of leading drought-index layers without a full six-month history.
FIRST_GRID_YEAR = 1901
LAST_GRID_YEAR = 2024
SPEI_SKIPPED_LAYERS = 12


def window_labels(first: int = -6, last: int = 9) -> list[tuple[int, str, int, bool]]:
    """(month_order, label, calendar month, belongs to previous year).

    A negative number is a month of the previous year, written ``Jun``; a
    positive one a month of the current year, written ``JUN``.
    """
    months = [(m, True) for m in range(-first, 13)] if first < 0 else []
    months += [(m, False) for m in range(1 if first < 0 else first, last + 1)]
    return [
        (i, MONTHS[m - 1] if prev else MONTHS[m - 1].upper(), m, prev)
        for i, (m, prev) in enumerate(months, start=1)
    ]


def month_dimension(spark: SparkSession, first: int = -6, last: int = 9) -> DataFrame:
    """The window as a table; never more than 24 rows, so it may be broadcast."""
    return spark.createDataFrame(
        window_labels(first, last),
        "month_order INT, label STRING, month INT, is_prev BOOLEAN",
    )


def month_number(name: Column) -> Column:
    """``Jan`` -> 1 ... ``Dec`` -> 12, NULL for anything else."""
    names = F.array(*[F.lit(m) for m in MONTHS])
    return F.nullif(F.array_position(names, name), F.lit(0)).cast("int")


def month_name(number: Column) -> Column:
    names = F.array(*[F.lit(m) for m in MONTHS])
    return F.try_element_at(names, number)


def layer_year(layer: Column, first_year: int = FIRST_GRID_YEAR) -> Column:
    return (F.lit(first_year) + F.floor((layer - 1) / 12)).cast("int")


def layer_month(layer: Column) -> Column:
    return (F.pmod(layer - 1, F.lit(12)) + 1).cast("int")


def layer_label(layer: Column, first_year: int = FIRST_GRID_YEAR) -> Column:
    """``1901_Jan`` style name of a layer."""
    return F.concat_ws("_", layer_year(layer, first_year).cast("string"), month_name(layer_month(layer)))
