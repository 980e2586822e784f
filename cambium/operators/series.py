"""Trees as one row each: their years and values as arrays in year order.

A tree is bounded by its calendar years, so its arrays are small however many
trees there are.  Rows come together once (`tree_series`, the only shuffle);
statistics, low-pass index, z scores and resilience are then computed on the
arrays of a row, and `rows` unfolds any of them.  Written as a table
(`store_series`), the series serve all of these without another shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cambium.operators.growth import TREE, clean_widths
from cambium.stages import stage

# Binomial weights of the 13-year filter, in 1/4096.
LOWPASS_WEIGHTS = [1, 12, 66, 220, 495, 792, 924, 792, 495, 220, 66, 12, 1]


def gather(values: DataFrame, column: str, year: str = "year") -> DataFrame:
    """One row per tree with the arrays ``year`` and ``column``, in year order."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col("year").alias(year), column))).alias("_s")
    return values.groupBy(*TREE).agg(pairs).select(*TREE, f"_s.{year}", f"_s.{column}")


def tree_series(widths: DataFrame) -> DataFrame:
    """The measured widths of every tree: ``year`` and ``width``."""
    return gather(clean_widths(widths).filter(F.col("width").isNotNull()), "width")


def rows(series: DataFrame, years: str, *columns: str) -> DataFrame:
    """One row per year of arrays that go together; ``years`` becomes ``year``."""
    zipped = F.arrays_zip(F.col(years).alias("year"), *columns)
    return series.select(*TREE, F.inline(zipped))


@dataclass
class Flat:
    """The arrays of many trees behind one another, and which tree each place belongs to."""

    year: np.ndarray
    value: np.ndarray  # NaN where there is none
    tree: np.ndarray
    trees: int

    @staticmethod
    def of(years: pa.ListArray, values: pa.ListArray) -> Flat:
        sizes = np.asarray(years.value_lengths().fill_null(0), dtype=np.int64)
        numbers = values.flatten().to_numpy(zero_copy_only=False).astype(float)
        return Flat(years.flatten().to_numpy(zero_copy_only=False), numbers, np.repeat(np.arange(len(sizes)), sizes), len(sizes))

    def whole(self, lo: int, hi: int) -> np.ndarray:
        """Places around which every year from ``lo`` to ``hi`` is there.

        Years are distinct and ordered, so none is missing exactly where the
        ends are as far apart in years as in places.
        """
        n = len(self.year)
        at = np.arange(max(0, -lo), max(0, -lo, n - max(0, hi)))
        first, last = at + lo, at + hi
        together = self.tree[np.minimum(at, first)] == self.tree[np.maximum(at, last)]
        return at[together & (self.year[last] - self.year[at] == hi) & (self.year[at] - self.year[first] == -lo)]

    def frames(self, at: np.ndarray, lo: int, hi: int) -> np.ndarray:
        return sliding_window_view(self.value, hi - lo + 1)[at + lo]

    def lists(self, at: np.ndarray, values: np.ndarray) -> pa.ListArray:
        """Arrays by tree of ``values``, which belong to the places ``at``; what is not finite is NULL."""
        ends = np.searchsorted(self.tree[at], np.arange(self.trees + 1)).astype(np.int32)
        inner = pa.array(values) if values.dtype.kind == "i" else pa.array(values, mask=~np.isfinite(values))
        return pa.ListArray.from_arrays(pa.array(ends), inner)


def index_of(widths: Flat, mode: str = "ratio") -> tuple[np.ndarray, np.ndarray]:
    """Places with a complete 13-year kernel, and the width there over the filtered width (``smooth``: the latter)."""
    reach = len(LOWPASS_WEIGHTS) // 2
    at = widths.whole(-reach, reach)
    if not len(at):
        return at, np.zeros(0)
    smooth = widths.frames(at, -reach, reach) @ (np.array(LOWPASS_WEIGHTS) / float(sum(LOWPASS_WEIGHTS)))
    with np.errstate(divide="ignore", invalid="ignore"):
        return at, widths.value[at] / smooth if mode == "ratio" else smooth


def z_of(index: Flat, window: int = 13) -> np.ndarray:
    """z score of every place within its centred window, NaN where that is not complete."""
    if window % 2 == 0:
        raise ValueError("a centred window has an odd number of years")
    reach, z = window // 2, np.full(len(index.year), np.nan)
    at = index.whole(-reach, reach)
    if len(at):
        frames = index.frames(at, -reach, reach)
        with np.errstate(divide="ignore", invalid="ignore"):
            z[at] = (index.value[at] - frames.mean(1)) / frames.std(1, ddof=1)
    return z


def resilience_of(index: Flat, pre: int = 4, post: int = 4) -> dict[str, np.ndarray]:
    """Components of every place (Lloret et al. 2011), NaN where a frame lacks a year or a value."""
    clean = np.where(np.isfinite(index.value), index.value, np.nan)
    flat = Flat(index.year, clean, index.tree, index.trees)
    before, after = np.full(len(clean), np.nan), np.full(len(clean), np.nan)
    for frame, lo, hi in ((before, -pre, -1), (after, 1, post)):
        at = flat.whole(min(lo, 0), max(hi, 0))
        if len(at):
            frame[at] = flat.frames(at, lo, hi).mean(1)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        return {"resist": clean / before, "recov": after / clean, "resil": after / before, "rel_resil": (after - clean) / before}


RESILIENCE = ["resist", "recov", "resil", "rel_resil"]


def measured(series: DataFrame, z: bool = True, resilience: bool = True, mode: str = "ratio", window: int = 13, pre: int = 4, post: int = 4) -> DataFrame:
    """`tree_series` with ``index_year`` and ``index``, and beside them ``z`` and the components of resilience.

    ``index`` has the years with a complete 13-year kernel; ``z`` and the
    components are NULL where their own frames are not complete.  All of a
    batch of trees is computed at once on its flat arrays.
    """
    columns = ["index", *(["z"] if z else []), *(RESILIENCE if resilience else [])]
    kind = T.StructType([*series.schema.fields, T.StructField("index_year", T.ArrayType(T.IntegerType()))])
    for c in columns:
        kind.add(c, T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = Flat.of(batch.column("year"), batch.column("width"))
            at, value = index_of(widths, mode)
            index = Flat(widths.year[at], value, widths.tree[at], widths.trees)
            found = {"index": value}
            if z:
                found["z"] = z_of(index, window)
            if resilience:
                found |= resilience_of(index, pre, post)
            lists = [index.lists(np.arange(len(at)), index.year.astype(np.int32)), *[index.lists(np.arange(len(at)), found[c]) for c in columns]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], [*batch.schema.names, "index_year", *columns])

    return series.mapInArrow(run, kind)


STATISTICS = "rwl string, tree string, first int, last int, age int, mean_growth double, growth_sd double, ar1 double"


def statistics(series: DataFrame) -> DataFrame:
    """First and last year, age, mean, sd and lag-1 autocorrelation of every tree.

    The autocorrelation pairs neighbouring measured rings.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = Flat.of(batch.column("year"), batch.column("width"))
            n = np.bincount(flat.tree, minlength=flat.trees)
            stops = np.cumsum(n)
            first, last = flat.year[stops - n], flat.year[stops - 1]
            total = lambda values: np.bincount(flat.tree, values, flat.trees)
            mean = total(flat.value) / n
            dev = flat.value - mean[flat.tree]
            squares, lagged = total(dev * dev), total(dev * np.where(np.diff(flat.tree, prepend=-1) == 0, np.roll(dev, 1), 0.0))
            with np.errstate(divide="ignore", invalid="ignore"):
                sd, ar1 = np.sqrt(squares / (n - 1)), np.where(n > 1, lagged / squares, np.nan)
            whole = [pa.array(x.astype(np.int32)) for x in (first, last, last - first + 1)]
            real = [pa.array(x, mask=~np.isfinite(x)) for x in (mean, sd, ar1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *whole, *real], [f.split()[0] for f in STATISTICS.split(", ")])

    return series.select(*TREE, "year", "width").mapInArrow(run, STATISTICS)


def store_series(widths: DataFrame, **options) -> DataFrame:
    """`tree_series` of the widths with all that `measured` adds, written once; each column is read by itself."""
    return stage(measured(tree_series(widths), **options))
