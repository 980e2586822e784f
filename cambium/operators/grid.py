"""Raster work on long grid tables: crop, sample, rasterize, resample."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cambium.functions.months import FIRST_GRID_YEAR, MONTHS, SPEI_SKIPPED_LAYERS, layer_month, layer_year
from cambium.functions.numeric import let
from cambium.operators.skew import SALT, as_list, lookup_join, shuffle_partitions

CELL = ["row", "col"]

# The study window as (lon_min, lon_max, lat_min, lat_max).
EUROPE = (-10.0, 35.0, 35.0, 75.0)

# Row and column of the points outside the grid while they are joined.
OUTSIDE = -1

# Points per cell and salt when a cell's time series is repeated for its points.
POINTS_PER_SALT = 1_000

# Grids of up to so many cells have their lists of cells broadcast: a few bytes per cell, some 20 MB.
BROADCAST_CELLS = 1_000_000


@dataclass(frozen=True)
class GridGeometry:
    """Upper left corner, cell size and extent of a grid; row 0 is the north."""

    xmin: float
    ymax: float
    xres: float
    yres: float
    nrow: int
    ncol: int

    def row_col(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        """Containing cell; the far edges belong to the last cell, outside is NULL."""
        x = (lon - F.lit(self.xmin)) / F.lit(self.xres)
        y = (F.lit(self.ymax) - lat) / F.lit(self.yres)
        inside = (x >= 0) & (x <= self.ncol) & (y >= 0) & (y <= self.nrow)
        row = F.least(F.floor(y), F.lit(self.nrow - 1)).cast("int")
        col = F.least(F.floor(x), F.lit(self.ncol - 1)).cast("int")
        return F.when(inside, row), F.when(inside, col)

    def lon_of(self, col: Column) -> Column:
        return F.lit(self.xmin) + (col + 0.5) * F.lit(self.xres)

    def lat_of(self, row: Column) -> Column:
        return F.lit(self.ymax) - (row + 0.5) * F.lit(self.yres)


def crop(grid: DataFrame, geometry: GridGeometry, box: Sequence[float] = EUROPE) -> DataFrame:
    """Cells whose centre lies in the box, as plain row and column ranges.

    The ranges are literals, so they reach a Parquet scan as pushed filters.
    """
    lon_min, lon_max, lat_min, lat_max = box
    cols = [c for c in range(geometry.ncol) if lon_min <= geometry.xmin + (c + 0.5) * geometry.xres <= lon_max]
    rows = [r for r in range(geometry.nrow) if lat_min <= geometry.ymax - (r + 0.5) * geometry.yres <= lat_max]
    if not cols or not rows:
        return grid.filter(F.lit(False))
    return grid.filter(F.col("row").between(rows[0], rows[-1]) & F.col("col").between(cols[0], cols[-1]))


def distinct_points(sites: DataFrame) -> DataFrame:
    """One site per coordinate, the smallest name; aggregated before the shuffle."""
    return sites.groupBy("longitude", "latitude").agg(F.min("rwl").alias("rwl"))


def cells_of(points: DataFrame, geometry: GridGeometry, lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    row, col = geometry.row_col(F.col(lon), F.col(lat))
    return points.withColumn("row", row).withColumn("col", col)


def _layer_keys(grid: DataFrame) -> tuple[list[str], str]:
    """What a series of layers is told apart by besides its cell, and what orders it: the last key."""
    *names, layer = [c for c in grid.columns if c not in (*CELL, "value")]
    return names, layer


def pack_grid(grid: DataFrame) -> DataFrame:
    """One row per cell and variable, with its layers and values as the array ``series``.

    A cell has at most a value per layer, so the arrays are bounded by the
    length of the record.  Written as a table (``tables.store_grid``), a grid of
    this form is sampled without moving single layers.
    """
    names, layer = _layer_keys(grid)
    series = F.sort_array(F.collect_list(F.struct(layer, "value"))).alias("series")
    return grid.groupBy(*CELL, *names).agg(series)


def _bounded(cells: DataFrame, geometry: GridGeometry) -> DataFrame:
    """A list of cells, sent to every task where the size of the grid says that it is short."""
    return F.broadcast(cells) if geometry.nrow * geometry.ncol <= BROADCAST_CELLS else cells


def cells_with_points(
    points: DataFrame, grid: DataFrame, geometry: GridGeometry, lon: str = "longitude", lat: str = "latitude"
) -> DataFrame:
    """The rows of the cells that hold points."""
    placed = cells_of(points.select(lon, lat), geometry, lon, lat).select(*CELL).distinct()
    return grid.join(_bounded(placed, geometry), CELL, "left_semi")


def sample_series(
    points: DataFrame,
    packed: DataFrame,
    geometry: GridGeometry,
    id_column: str = "rwl",
    lon: str = "longitude",
    lat: str = "latitude",
    points_per_salt: int = POINTS_PER_SALT,
    layers: DataFrame | None = None,
    together: bool = False,
) -> DataFrame:
    """The series of the containing cell for every point and variable of a packed grid (``pack_grid``).

    Every point has a row for every variable (of ``layers``, else of the grid);
    it has no ``series`` outside the grid and where the cell lacks the variable.
    With ``together`` a point is one row, with those of its variables in the
    array ``variables``.
    Cells are deduplicated and only cells with points are taken from the grid.
    A point meets one row, with all variables of its cell.  A cell with very many points repeats its series once per
    ``points_per_salt`` of them, so its output is spread over as many tasks; the
    points outside count as one more cell.  Points are short and their series
    long, so points are dealt over all shuffle partitions, whatever their bytes.
    """
    names = [c for c in packed.columns if c not in (*CELL, "series")]
    placed = cells_of(points.select(id_column, lon, lat), geometry, lon, lat)
    placed = placed.select(id_column, *[F.coalesce(F.col(c), F.lit(OUTSIDE)).alias(c) for c in CELL])
    cells = (
        placed.groupBy(*CELL)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*CELL, F.ceil(F.col("_n") / points_per_salt).cast("int").alias("_salts"))
    )
    salts = F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias(SALT)
    held = packed.join(_bounded(cells, geometry), CELL).groupBy(*CELL, "_salts")
    held = held.agg(F.collect_list(F.struct(*names, "series")).alias("_held")).select(*CELL, "_held", salts)
    salted = lookup_join(placed, cells, CELL, id_column, "inner").withColumn(
        SALT, F.pmod(F.xxhash64(id_column), F.col("_salts")).cast("int")
    ).drop("_salts")
    dealt = salted.repartition(shuffle_partitions(points), *CELL, SALT)
    met = dealt.join(held, [*CELL, SALT], "left")
    lacking = F.lit(None).cast(packed.schema["series"].dataType).alias("series")

    def own(variable: Column | None = None) -> Column:
        """What the cell holds of a variable, else the variable without a series."""

        def same(held: Column) -> Column:
            matches = F.lit(True)
            for c in names:
                matches = matches & (held[c] == variable[c])
            return matches

        alone = F.array(F.struct(*[variable[c].alias(c) for c in names], lacking))
        return let(F.filter("_held", same), lambda f: F.when(F.size(f) > 0, f).otherwise(alone))

    if names:
        known = (packed if layers is None else layers).agg(F.sort_array(F.collect_set(F.struct(*names))))
        met = met.withColumn("_variables", known.scalar())
        variables = F.flatten(F.transform("_variables", lambda v: own(v)))
    else:
        variables = own()
    cell = [F.nullif(F.col(c), F.lit(OUTSIDE)).alias(c) for c in CELL]
    return met.select(id_column, *cell, variables.alias("variables") if together else F.inline(variables))


def grid_layers(grid: DataFrame) -> DataFrame:
    """The layers that any cell of a long grid has, one row per variable."""
    names, layer = _layer_keys(grid)
    return grid.groupBy(*names).agg(F.sort_array(F.collect_set(layer)).alias("layers"))


def series_layers(packed: DataFrame) -> DataFrame:
    """The layers that any cell has, one row per variable."""
    names = [c for c in packed.columns if c not in (*CELL, "series")]
    layer = packed.schema["series"].dataType.elementType.fieldNames()[0]
    single = packed.select(*names, F.explode(F.col(f"series.{layer}")).alias(layer))
    return single.groupBy(*names).agg(F.sort_array(F.collect_set(layer)).alias("layers"))


def complete_series(samples: DataFrame, layers: DataFrame) -> DataFrame:
    """Sampled series with every layer of their variable (``series_layers``); layers that one lacks stand last, with NULL.

    The list of layers is one small array per variable, read inside the plan.
    """
    names = [c for c in layers.columns if c != "layers"]
    entry = samples.schema["series"].dataType.elementType
    layer, value = entry.fieldNames()
    known = layers.agg(F.collect_list(F.struct(*names, "layers"))).scalar()

    def of_variable(candidate: Column) -> Column:
        matches = F.lit(True)
        for c in names:
            matches = matches & candidate[c].eqNullSafe(F.col(c))
        return matches

    held = F.coalesce("series", F.array().cast(samples.schema["series"].dataType))
    listed = samples.withColumns({"_known": known, "series": held})
    listed = listed.withColumn("_every", F.get(F.filter("_known", of_variable), F.lit(0))["layers"])
    absent = F.transform(
        F.array_except("_every", F.col(f"series.{layer}")),
        lambda k: F.struct(k.alias(layer), F.lit(None).cast(entry[value].dataType).alias(value)),
    )
    kept = [c for c in samples.columns if c != "series"]
    return listed.select(*kept, F.concat("series", absent).alias("series"))


def unfold_series(samples: DataFrame, layers: DataFrame) -> DataFrame:
    """Sampled series as one row per layer of their variable (``complete_series``)."""
    kept = [c for c in samples.columns if c != "series"]
    return complete_series(samples, layers).select(*kept, F.inline("series"))


def sample_grid(
    points: DataFrame,
    grid: DataFrame,
    geometry: GridGeometry,
    id_column: str = "rwl",
    lon: str = "longitude",
    lat: str = "latitude",
    points_per_salt: int = POINTS_PER_SALT,
    unfold: bool = True,
) -> DataFrame:
    """Value of the containing cell for every point and every layer of the grid.

    Every point has a row for every layer: points outside the grid, and layers
    that a cell lacks, give NULL.  The cells with points are taken from the grid
    first and packed to a row per cell and variable, which the points meet
    (``sample_series``); layers are unfolded last and take part in no join.
    Without ``unfold`` the same layers stay in the array ``series``, a row per
    point and variable.
    """
    packed = pack_grid(cells_with_points(points, grid, geometry, lon, lat))
    # Variables and layers that only other cells have count too.
    layers = grid_layers(grid)
    samples = sample_series(points, packed, geometry, id_column, lon, lat, points_per_salt, layers)
    return unfold_series(samples, layers) if unfold else complete_series(samples, layers)


def sample_layer(
    points: DataFrame,
    layer: DataFrame,
    geometry: GridGeometry,
    id_column: str = "rwl",
    lon: str = "longitude",
    lat: str = "latitude",
) -> DataFrame:
    """Like ``sample_grid`` for columns of one value per cell; all points are kept.

    The layer is reduced to the cells that hold points before it is repeated.
    """
    placed = cells_of(points, geometry, lon, lat)
    wanted = layer.join(placed.select(*CELL).distinct(), CELL, "left_semi")
    return lookup_join(placed, wanted, CELL, id_column, "left")


def rasterize_last(
    points: DataFrame,
    geometry: GridGeometry,
    field: str,
    sequence: str,
    lon: str = "lon",
    lat: str = "lat",
) -> DataFrame:
    """Grid of point values; within a cell the last point by ``sequence`` wins."""
    return (
        cells_of(points, geometry, lon, lat)
        .filter(F.col("row").isNotNull())
        .groupBy(*CELL)
        .agg(F.max_by(field, sequence).alias("value"))
    )


# Cells along either side of a tile, besides its halo.
TILE = 128


def _between(position: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The cell before each position, and how far beyond its centre the position lies."""
    clamped = np.clip(position, 0.0, float(size - 1))
    low = np.minimum(np.floor(clamped), max(size - 2, 0)).astype(int)
    return low, clamped - low


def tiles(grid: DataFrame, keys: Sequence[str], side: int = TILE) -> DataFrame:
    """The cells with a value as one row per tile (and ``keys``): arrays ``row``, ``col``, ``value``.

    A tile has the first row and column of its neighbours to the south and east
    as a halo, so a cell is in one tile, and in two or four where it is such an
    edge.  A tile is bounded by its side.
    """

    def owners(cell: Column) -> Column:
        tile = F.floor(cell / side).cast("int")
        return F.when((cell % side == 0) & (cell > 0), F.array(tile - 1, tile)).otherwise(F.array(tile))

    present = F.col("value").isNotNull() & F.col("row").isNotNull() & F.col("col").isNotNull()
    held = grid.filter(present).select(*keys, *CELL, "value", F.explode(owners(F.col("row"))).alias("tile_row"))
    held = held.select("*", F.explode(owners(F.col("col"))).alias("tile_col"))
    cells = F.collect_list(F.struct(*CELL, "value")).alias("_cells")
    packed = held.groupBy(*keys, "tile_row", "tile_col").agg(cells)
    return packed.select(*keys, "tile_row", "tile_col", *[F.col(f"_cells.{c}").alias(c) for c in (*CELL, "value")])


def resample_bilinear(
    grid: DataFrame, source: GridGeometry, target: GridGeometry, layer: str | None = "layer", side: int = TILE
) -> DataFrame:
    """Values at the target cell centres, weighted from the four cells around.

    Centres beyond the outermost source centres take the nearest row or
    column.  Missing neighbours drop out and the other weights are rescaled.
    The four cells of a centre are in one tile (``tiles``), so the grid is
    shuffled once, with the halos, and no cell is looked up; the centres of a
    tile follow from the two geometries.
    """
    keys = [layer] if layer else []
    rows, cols = np.arange(target.nrow), np.arange(target.ncol)
    lat, lon = target.ymax - (rows + 0.5) * target.yres, target.xmin + (cols + 0.5) * target.xres
    y0, yf = _between((source.ymax - lat) / source.yres - 0.5, source.nrow)
    x0, xf = _between((lon - source.xmin) / source.xres - 0.5, source.ncol)

    def values(tile_row: int, tile_col: int, row: np.ndarray, col: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, ...]:
        known = np.full((side + 1, side + 1), np.nan)
        known[row - tile_row * side, col - tile_col * side] = value
        r, c = np.flatnonzero(y0 // side == tile_row), np.flatnonzero(x0 // side == tile_col)
        total, weight = np.zeros((len(r), len(c))), np.zeros((len(r), len(c)))
        for down in (0, 1):
            for right in (0, 1):
                at = known[np.ix_(y0[r] - tile_row * side + down, x0[c] - tile_col * side + right)]
                w = np.outer(yf[r] if down else 1.0 - yf[r], xf[c] if right else 1.0 - xf[c])
                w = np.where(np.isnan(at), 0.0, w)
                total += np.where(w > 0.0, at, 0.0) * w
                weight += w
        i, j = np.nonzero(weight > 0.0)
        return r[i], c[j], total[i, j] / weight[i, j]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                tile = [batch.column(len(keys) + i)[k].as_py() for i in (0, 1)]
                cells = [batch.column(len(keys) + i)[k].values.to_numpy(zero_copy_only=False) for i in (2, 3, 4)]
                r, c, v = values(*tile, *cells)
                same = [pa.repeat(batch.column(i)[k], len(r)) for i in range(len(keys))]
                columns = [*same, pa.array(r.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(v)]
                yield pa.RecordBatch.from_arrays(columns, [*keys, *CELL, "value"])

    packed = tiles(grid.withColumn("value", F.col("value").cast("double")), keys, side)
    kind = T.StructType([packed.schema[k] for k in keys]).add("row", T.IntegerType()).add("col", T.IntegerType()).add("value", T.DoubleType())
    return packed.mapInArrow(run, kind)


def morton(row: Column, col: Column) -> Column:
    """Place of a cell on the Z-order curve: the bits of row and column in turn, for up to 65,536 of either."""

    def spread(value: Column) -> Column:
        value = value.cast("long")
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            value = value.bitwiseOR(F.shiftleft(value, shift)).bitwiseAND(F.lit(mask))
        return value

    return F.shiftleft(spread(row), 1).bitwiseOR(spread(col))


def layers_to_columns(grid: DataFrame, layers: Sequence[str]) -> DataFrame:
    """Static grid with one column per named layer, one row per cell."""
    return grid.groupBy(*CELL).pivot("layer", list(layers)).agg(F.first("value", ignorenulls=True))


# Static layers in the order of the covariate columns.
COVARIATE_LAYERS = [
    "ecoregion",
    "soil_carbon",
    "soil_ph",
    "soil_nitrogen",
    "derived_elev",
    "slope",
    "eastness",
    "northness",
    "mountains",
]


def site_covariates(
    sites: DataFrame, grid_static: DataFrame, geometry: GridGeometry, layers: Sequence[str] | None = None
) -> DataFrame:
    """Every site with the static layers of its cell, NULL outside the grid."""
    layers = list(layers or COVARIATE_LAYERS)
    cells = cells_of(sites, geometry).select(*CELL).distinct()
    wide = layers_to_columns(grid_static.join(cells, CELL, "left_semi"), layers)
    return lookup_join(cells_of(sites, geometry), wide, CELL, "rwl", "left").drop(*CELL)


def layer_to_month(samples: DataFrame, spei_variable: str = "spei") -> DataFrame:
    """Layer number to year and month; the drought index loses its first 12 layers."""
    keep = (F.col("variable") != spei_variable) | (F.col("layer") > SPEI_SKIPPED_LAYERS)
    return samples.filter(keep).select(
        *[c for c in samples.columns if c != "layer"],
        layer_year(F.col("layer")).alias("year"),
        layer_month(F.col("layer")).alias("month"),
    )


def values_at(series: Column, layers: Column, kind: str | T.DataType = "double") -> Column:
    """The value that a series has of each of ``layers`` (distinct and ascending), as an array; NULL where it has none.

    Sorted together with the layers asked for, a value stands right before its
    layer, the largest of several last.
    """
    known = F.transform(series, lambda s: F.struct(s["layer"].alias("layer"), F.lit(0).alias("k"), s["value"].alias("value")))
    asked = F.transform(layers, lambda x: F.struct(x.alias("layer"), F.lit(1).alias("k"), F.lit(None).cast(kind).alias("value")))

    def picked(merged: Column) -> Column:
        def value(entry: Column, i: Column) -> Column:
            before = F.get(merged, i - 1)
            found = F.when((before["layer"] == entry["layer"]) & (before["k"] == 0), before["value"])
            return F.struct(entry["k"].alias("k"), found.alias("value"))

        return F.transform(F.filter(F.transform(merged, value), lambda e: e["k"] == 1), lambda e: e["value"])

    return let(F.sort_array(F.concat(known, asked)), picked)


def climate_wide(samples: DataFrame, variable: str, layers: Sequence[int], id_column: str = "rwl") -> DataFrame:
    """One row per site with one ``1901_Jan`` style column per layer (export view).

    ``samples`` have a row per layer, or their layers in the array ``series``
    (``sample_grid`` without ``unfold``), which are laid out where they are, so
    that no single layer is shuffled or kept.  Of several values the largest counts.
    """
    ids = as_list(id_column)
    own = samples.filter(F.col("variable") == variable)
    if "series" not in samples.columns:
        own = own.filter(F.col("layer").isin(list(layers))).groupBy(*ids).agg(F.collect_list(F.struct("layer", "value")).alias("series"))
    own = own.filter(F.exists("series", lambda s: s["layer"].isin(list(layers))))
    entry, order = own.schema["series"].dataType.elementType, sorted(set(layers))
    asked = F.lit(order).cast(T.ArrayType(entry["layer"].dataType))
    laid = own.select(*ids, values_at(F.col("series"), asked, entry["value"].dataType).alias("_laid"))
    places = {label: order.index(k) for label, k in zip(labels_of(layers), layers)}
    columns = laid.select(*ids, *[F.get("_laid", F.lit(i)).alias(label) for label, i in places.items()])
    return columns.groupBy(*ids).agg(*[F.max(label).alias(label) for label in places])


def labels_of(layers: Sequence[int], first_year: int = FIRST_GRID_YEAR) -> list[str]:
    return [f"{first_year + (k - 1) // 12}_{MONTHS[(k - 1) % 12]}" for k in layers]


def wide_to_long(wide: DataFrame, value: str, id_column: str = "rwl") -> DataFrame:
    """Month columns back to rows: ``1901_Jan`` becomes year 1901, month ``Jan``."""
    months = [c for c in wide.columns if c != id_column]
    parts = F.split("date", "_")
    return wide.unpivot([id_column], months, "date", value).select(
        id_column, parts[0].cast("int").alias("year"), parts[1].alias("month"), value
    )


