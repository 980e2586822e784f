"""Decadal ring-width text: one line per tree and decade, fixed-width fields.

A data line holds the tree id (8 characters), the first year of the line
(4 characters) and up to ten values of 6 characters.  The value after the last
ring is a stop marker that also tells the unit.  In the long variant the id is
one character shorter and the year one longer.  A blank field is a year without
a ring.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cambium.functions.numeric import decimals
from cambium.operators.growth import TREE
from cambium.operators.skew import lookup_join
from cambium.sources.tables import file_inventory
from cambium.stages import stage

# Fixed values of the text format.
ID_WIDTH, YEAR_WIDTH, VALUE_WIDTH, VALUES_PER_LINE = 8, 4, 6, 10
STOP_HUNDREDTHS, STOP_THOUSANDTHS = 999, -9999
MISSING = -999
FLAG_READ = "reading rwl file failed"
COUNTS = ["n_data", "n_header", "n_damaged", "n_overlap"]


def site_of_path(path: Column) -> Column:
    """Site id: the folder ``rwl=<id>`` or the file name without its suffix."""
    folder = F.regexp_extract(path, r"/rwl=([^/]+)/", 1)
    name = F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)
    return F.lower(F.when(folder != "", folder).otherwise(name))


# Sites that may be named in a plan; a longer choice reads all files and drops rows.
SITES_NAMED = 20_000


def named_sites(sites: DataFrame) -> list[str] | None:
    """The ids of a choice of sites, for files to be chosen by, unless there are more than ``SITES_NAMED``."""
    found = [r.rwl for r in sites.select("rwl").distinct().limit(SITES_NAMED + 1).collect()]
    return found if len(found) <= SITES_NAMED else None


def read_ring_lines(
    spark: SparkSession, path: str, suffix: str = "*.rwl", sites: Sequence[str] | None = None
) -> DataFrame:
    """All text lines below a folder with the site they belong to and their place in its file.

    Places grow along a file: splits are ordered by where they begin, lines of
    a split by the order in which its task reads them.  Given ``sites``, files
    of others are left out when files are listed, and never opened.
    """
    place = F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("nth"))
    site = site_of_path(F.col("_metadata.file_path"))
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", suffix).text(path)
    chosen = text if sites is None else text.filter(site.isin(list(sites)))
    return chosen.select(site.alias("rwl"), F.col("value").alias("line"), place.alias("place"))


def _fields(line: Column, id_width: int) -> Column:
    year_width = YEAR_WIDTH + ID_WIDTH - id_width
    start = ID_WIDTH + YEAR_WIDTH + 1
    raw = F.array(
        *[F.trim(F.substring(line, start + VALUE_WIDTH * i, VALUE_WIDTH)) for i in range(VALUES_PER_LINE)]
    )
    last = F.array_max(F.transform(raw, lambda v, i: F.when(v != "", i + 1).otherwise(0)))
    return F.struct(
        F.trim(F.substring(line, 1, id_width)).alias("tree"),
        F.trim(F.substring(line, id_width + 1, year_width)).alias("year"),
        F.slice(raw, F.lit(1), last).alias("values"),
    )


def scan_lines(lines: DataFrame, long_sites: DataFrame | None = None) -> DataFrame:
    """Lines cut into fields, each marked as data or not.  Blank lines are dropped.

    Equal lines of a site collapse into one with a count before anything is
    grouped by tree, so copies of a file, however many, never pile up in one
    task; a data line found more than once makes the file faulty later on.  Of
    the ten fields of a line those after its last value are no years; a blank
    one before it is a year without a ring.  Lines may have a ``place``; a
    line found more than once keeps its last.
    """
    place = F.col("place") if "place" in lines.columns else F.lit(None).cast("struct<split: bigint, nth: bigint>")
    once = (
        lines.select("rwl", F.rtrim("line").alias("line"), place.alias("place"))
        .filter(F.length("line") > 0)
        .groupBy("rwl", "line")
        .agg(F.count(F.lit(1)).alias("copies"), F.min("place").alias("first_place"), F.max("place").alias("last_place"))
    )
    line = F.col("line")
    if long_sites is None:
        cut = once.select("rwl", _fields(line, ID_WIDTH).alias("f"), "copies", "first_place", "last_place")
    else:
        marked = lookup_join(
            once, long_sites.select("rwl", F.lit(True).alias("_long")), "rwl", "line", "left"
        )
        fields = F.when(F.col("_long"), _fields(line, ID_WIDTH - 1)).otherwise(_fields(line, ID_WIDTH))
        cut = marked.select("rwl", fields.alias("f"), "copies", "first_place", "last_place")
    whole = r"^-?\d+$"
    is_data = (
        (F.col("f.tree") != "")
        & F.col("f.year").rlike(whole)
        & (F.size("f.values") >= 1)
        & F.forall("f.values", lambda v: (v == "") | v.rlike(whole))
    )
    return cut.select(
        "rwl",
        F.col("f.tree").alias("tree"),
        F.col("f.year").try_cast("int").alias("year"),
        F.transform("f.values", lambda v: v.try_cast("int")).alias("values"),
        is_data.alias("is_data"),
        "copies",
        "first_place",
        "last_place",
    )


def decade_lines(scanned: DataFrame) -> DataFrame:
    """Data lines with stop markers removed, the unit, and whether lines overlap.

    A last value counts as a stop marker only where the series does not go on
    in the next decade, so a real ring of that size elsewhere is kept.
    """
    order = Window.partitionBy(*TREE).orderBy("year", F.size("values"))
    last = F.element_at("values", -1)
    next_year = F.lead("year").over(order)
    ends = next_year.isNull() | (next_year != (F.floor(F.col("year") / 10) + 1) * 10)
    marker = F.when(ends & last.isin(STOP_HUNDREDTHS, STOP_THOUSANDTHS), last)
    marked = (
        scanned.filter("is_data")
        .withColumn("_marker", marker)
        .withColumn(
            "values",
            F.when(F.col("_marker").isNotNull(), F.slice("values", 1, F.size("values") - 1)).otherwise(
                F.col("values")
            ),
        )
        .withColumn(
            "overlap",
            (F.col("copies") > 1)
            | F.coalesce(next_year < F.col("year") + F.size("values"), F.lit(False)),
        )
        .withColumn("_stop", F.min("_marker").over(Window.partitionBy(*TREE)))
    )
    per_mm = F.when(F.col("_stop") == STOP_THOUSANDTHS, 1000.0).otherwise(100.0)
    return marked.select(*TREE, "year", "values", per_mm.alias("per_mm"), "overlap")


def file_status(scanned: DataFrame) -> DataFrame:
    """``Good`` or ``Error`` per file: no data, damaged lines, or overlapping lines.

    A line that is no data is damaged if its tree id stands on data lines of
    the file, or if it comes after a data line (where lines have a place);
    otherwise it is part of the header.  Both are counted.
    """
    firsts = scanned.groupBy("rwl").agg(F.min(F.when(F.col("is_data"), F.col("first_place"))).alias("_begin"))
    ids = scanned.filter("is_data").select(*TREE).distinct().withColumn("_known", F.lit(True))
    other = lookup_join(scanned.filter("NOT is_data"), firsts, "rwl", ["tree", "year"], "left").join(ids, TREE, "left")
    late = F.coalesce(F.col("last_place") > F.col("_begin"), F.lit(False))
    damaged = F.coalesce("_known", F.lit(False)) | late
    others = other.groupBy("rwl").agg(
        F.sum(F.when(damaged, F.col("copies")).otherwise(0)).alias("n_damaged"),
        F.sum(F.when(damaged, 0).otherwise(F.col("copies"))).alias("n_header"),
    )
    counted = scanned.groupBy("rwl").agg(F.sum(F.when(F.col("is_data"), F.col("copies")).otherwise(0)).alias("n_data"))
    overlaps = decade_lines(scanned).groupBy("rwl").agg(F.count_if("overlap").alias("n_overlap"))
    known = counted.join(others, "rwl", "left").join(overlaps, "rwl", "left")
    numbers = [F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS]
    failed = (F.col("n_data") == 0) | (F.col("n_damaged") > 0) | (F.col("n_overlap") > 0)
    return known.select("rwl", *numbers).select(
        "rwl", F.when(failed, "Error").otherwise("Good").alias("status"), *COUNTS
    )


def read_flags(status: DataFrame) -> DataFrame:
    return status.filter(F.col("status") == "Error").select("rwl", F.lit(FLAG_READ).alias("flag"))


def ring_rows(scanned: DataFrame) -> DataFrame:
    """Scanned lines to ``(rwl, tree, year, width)``; rings coded as missing have no row."""
    decades = decade_lines(scanned)
    return (
        decades.select(*TREE, "year", "per_mm", F.posexplode("values").alias("_i", "_v"))
        .filter(F.col("_v") >= 0)
        .select(*TREE, (F.col("year") + F.col("_i")).alias("year"), (F.col("_v") / F.col("per_mm")).alias("width"))
    )


def parse_ring_lines(lines: DataFrame, long_sites: DataFrame | None = None) -> DataFrame:
    """Lines to ``(rwl, tree, year, width)`` (``ring_rows``)."""
    return ring_rows(scan_lines(lines, long_sites))


def read_ring_files(
    spark: SparkSession,
    path: str,
    long_sites: DataFrame | None = None,
    suffix: str = "*.rwl",
    sites: Sequence[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Widths of all readable files below ``path`` (those of ``sites``) and the status of every file.

    The files are read once: their scanned lines become a stage, from which
    status and widths are taken.  A file of blank lines is an error too; it is
    known from the listing of the folder (which leaves out files of no bytes).
    """
    scanned = stage(scan_lines(read_ring_lines(spark, path, suffix, sites), long_sites))
    listed = file_inventory(spark, path, suffix).select("rwl").distinct()
    listed = listed if sites is None else listed.filter(F.col("rwl").isin(list(sites)))
    found = file_status(scanned)
    empty = listed.join(found.select("rwl"), "rwl", "left_anti").select(
        "rwl", F.lit("Error").alias("status"), *[F.lit(0).cast("bigint").alias(c) for c in COUNTS]
    )
    status = stage(found.unionByName(empty))
    widths = lookup_join(ring_rows(scanned), read_flags(status).select("rwl"), "rwl", "tree", "left_anti")
    return widths, status


def site_precision(widths: DataFrame) -> DataFrame:
    """Units per millimetre of each site: 100 if its first series has under 3 decimals."""
    per_tree = widths.groupBy(*TREE).agg(F.max(decimals(F.col("width"))).alias("nd"))
    return per_tree.groupBy("rwl").agg(
        F.when(F.min_by("nd", "tree") < 3, 100).otherwise(1000).alias("per_mm")
    )


def long_sites(widths: DataFrame) -> DataFrame:
    """Sites with a year that four characters cannot hold: they are written, and have to be read, in the long variant."""
    span = widths.groupBy("rwl").agg(F.min("year").alias("_lo"), F.max("year").alias("_hi"))
    return span.filter((F.col("_lo") < -999) | (F.col("_hi") >= 9999)).select("rwl")


def _exactly(text: Column, width: Column, pad: Column, what: str) -> Column:
    """``pad`` where the text fits into the width; anything longer stops the job."""
    too_long = F.raise_error(F.lit(f"{what} longer than the text format allows")).cast("string")
    return F.when(F.length(text) > width, too_long).otherwise(pad)


def format_ring_lines(widths: DataFrame, precision: DataFrame | None = None) -> DataFrame:
    """``(rwl, tree, year, width)`` to text lines, one per tree and decade; sites of `long_sites` in the long variant."""
    measured = widths.filter(F.col("width").isNotNull())
    units = site_precision(measured) if precision is None else precision
    units = units.join(long_sites(measured).withColumn("_long", F.lit(True)), "rwl", "left")
    scaled = lookup_join(measured, units, "rwl", "tree")
    decade = F.floor(F.col("year") / 10).cast("int")
    ring = F.struct("year", F.round(F.col("width") * F.col("per_mm")).cast("int").alias("v"))
    lines = (
        scaled.groupBy(*TREE, "per_mm", "_long", decade.alias("decade"))
        .agg(F.map_from_entries(F.collect_list(ring)).alias("_v"), F.min("year").alias("lo"), F.max("year").alias("hi"))
        .withColumn("_end", F.max("hi").over(Window.partitionBy(*TREE)))
    )
    values = F.transform(
        F.sequence("lo", "hi"), lambda y: F.coalesce(F.try_element_at(F.col("_v"), y), F.lit(MISSING))
    )
    stop = F.when(F.col("per_mm") == 100, STOP_HUNDREDTHS).otherwise(STOP_THOUSANDTHS)
    is_last = F.col("hi") == F.col("_end")
    full = F.pmod(F.col("hi"), F.lit(10)) == 9
    own = F.struct(
        F.col("lo").alias("year"),
        F.when(is_last & ~full, F.array_append(values, stop)).otherwise(values).alias("values"),
    )
    extra = F.struct((F.col("hi") + 1).alias("year"), F.array(stop).alias("values"))
    emitted = lines.select(*TREE, "_long", F.inline(F.when(is_last & full, F.array(own, extra)).otherwise(F.array(own))))
    shift = F.when(F.col("_long"), 1).otherwise(0)
    id_width, year_width = F.lit(ID_WIDTH) - shift, F.lit(YEAR_WIDTH) + shift
    year = F.col("year").cast("string")
    name = _exactly(F.col("tree"), id_width, F.rpad("tree", id_width, " "), "tree id")
    begin = _exactly(year, year_width, F.lpad(year, year_width, " "), "year")
    cells = F.array_join(
        F.transform(
            F.transform("values", lambda v: v.cast("string")),
            lambda v: _exactly(v, F.lit(VALUE_WIDTH), F.lpad(v, VALUE_WIDTH, " "), "width"),
        ),
        "",
    )
    return emitted.select(*TREE, "year", F.concat(name, begin, cells).alias("line"))


def write_ring_files(widths: DataFrame, path: str) -> None:
    """One folder per site.  Range partitioning lets a dominant site use many tasks."""
    lines = format_ring_lines(widths)
    (
        lines.repartitionByRange("rwl", "tree", "year")
        .sortWithinPartitions("rwl", "tree", "year")
        .select("rwl", "line")
        .write.mode("overwrite")
        .partitionBy("rwl")
        .text(path)
    )
