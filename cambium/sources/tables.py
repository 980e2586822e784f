"""Tables between the stages: explicit schemas in, Parquet (or CSV) out."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cambium import schemas


def read_table_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and ``NA`` for missing values; never inferred."""
    return spark.read.csv(path, schema=schema, header=True, nullValue="NA", nanValue="NaN", mode="PERMISSIVE")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """An export to a plain folder, replaced as a whole; tables that are read again go through ``store``."""
    if fmt == "csv":
        df.write.mode("overwrite").option("header", "true").option("nullValue", "NA").csv(path)
    else:
        df.write.mode("overwrite").parquet(path)


MANIFEST = "sequence BIGINT, version STRING, n_rows BIGINT, catalog_table STRING"


def versions(spark: SparkSession, path: str) -> DataFrame:
    """The manifest of a stored table: a row per version that was written to its end, the current one last."""
    try:
        return spark.read.schema(MANIFEST).json(f"{path}/_manifest").orderBy("sequence")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def _commit(df: DataFrame, path: str, write: Callable[[DataFrame, str, str], str | None]) -> DataFrame:
    """Write a new version beside the others and make it the current one by a last, small write to the manifest.

    Until then, and if that is never reached, the table is what it was: a
    failed rerun leaves the version before it, and a run may read the very
    table that it writes.  Rows are counted in the pass that writes them.  One
    writer at a time.
    """
    spark, version, seen = df.sparkSession, uuid.uuid4().hex, Observation()
    name = write(df.observe(seen, F.count(F.lit(1)).alias("n_rows")), f"{path}/version={version}", version)
    last = versions(spark, path).agg(F.coalesce(F.max("sequence"), F.lit(0)).alias("last")).first().last
    row = [(last + 1, version, seen.get["n_rows"], name)]
    spark.createDataFrame(row, MANIFEST).coalesce(1).write.mode("append").json(f"{path}/_manifest")
    return read_version(spark, path)


def read_version(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """The current version of a stored table, or an earlier one by its name in ``versions``."""
    known = versions(spark, path)
    known = known if version is None else known.filter(F.col("version") == version)
    found = known.orderBy(F.desc("sequence")).first()
    if found is None:
        raise FileNotFoundError(f"no version of a table was written to its end at {path}")
    if found.catalog_table is not None:
        return spark.table(found.catalog_table)
    return spark.read.parquet(f"{path}/version={found.version}")


def store(df: DataFrame, path: str) -> DataFrame:
    """Write a version of an intermediate and go on from it (cuts the lineage)."""

    def write(rows: DataFrame, folder: str, _: str) -> None:
        rows.write.parquet(folder)

    return _commit(df, path, write)


def read_monthly_grid(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.GRID_MONTHLY).parquet(path)


def read_static_grid(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.GRID_STATIC).parquet(path)


def read_point_grid_csv(spark: SparkSession, path: str) -> DataFrame:
    """Climate-class points with their place in the file (``seq``); numbers that do not parse become NULL."""
    text = "lon STRING, lat STRING, climate STRING, `main.climate` STRING, `mainc.code` STRING, KG STRING"
    return cast_points(
        spark.read.csv(path, schema=text, header=True, nullValue="NA").withColumnsRenamed(
            {"main.climate": "main_climate", "mainc.code": "mainc_code", "KG": "kg"}
        )
    ).withColumn("seq", F.monotonically_increasing_id())


def store_grid(grid: DataFrame, path: str, files: int | None = None, row_group_bytes: int = 1 << 20) -> DataFrame:
    """Write a packed grid (``grid.pack_grid``) along the Z-order curve, and go on from the table.

    Files and row groups then hold compact patches of cells, so that a box of
    rows and columns (``grid.crop``) is told from their least and greatest
    values, and the others are not read.
    """
    from cambium.operators.grid import morton

    place = morton(F.col("row"), F.col("col"))
    dealt = grid.repartitionByRange(files, place) if files else grid.repartitionByRange(place)
    ordered = dealt.withColumn("_place", place).sortWithinPartitions("_place").drop("_place")

    def write(rows: DataFrame, folder: str, _: str) -> None:
        rows.write.option("parquet.block.size", row_group_bytes).option("parquet.page.row.count.limit", 100).parquet(folder)

    return _commit(ordered, path, write)


def cast_points(points: DataFrame) -> DataFrame:
    number = ["lon", "lat", "mainc_code", "kg"]
    return points.select(
        *[F.col(c).try_cast("double").alias(c) if c in number else F.col(c) for c in points.columns]
    )


def file_inventory(spark: SparkSession, path: str, suffix: str = "*.rwl") -> DataFrame:
    """Path, site id and size of every file; only the listing is read, not the content."""
    from cambium.sources.ring_text import site_of_path

    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", suffix)
        .option("recursiveFileLookup", "true")
        .load(path)
    )
    return files.select("path", site_of_path(F.col("path")).alias("rwl"), "length")


def column_profile(df: DataFrame, column: str) -> DataFrame:
    """Value counts of a column."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def column_range(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("lowest"), F.max(column).alias("highest"))


def filter_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Row counts before and after a filter, as one row."""
    b = before.agg(F.count(F.lit(1)).alias("n_before"))
    a = after.agg(F.count(F.lit(1)).alias("n_after"))
    return b.withColumn("_k", F.lit(1)).join(a.withColumn("_k", F.lit(1)), "_k").drop("_k")


def condition_counts(df: DataFrame, condition: Column, key: str | None = None) -> DataFrame:
    """The same two counts by one scan where the filter is a condition: rows before, and rows (or distinct keys) after."""
    after = F.count_if(condition) if key is None else F.count_distinct(F.when(condition, F.col(key)))
    return df.agg(F.count(F.lit(1)).alias("n_before"), after.alias("n_after"))


def store_by_tree(df: DataFrame, table: str, path: str, buckets: int) -> DataFrame:
    """Write ring data bucketed and sorted by tree, and go on from the table.

    Windows and aggregations over a tree then need no shuffle.  The tree, not
    the site, is the bucket key, so a dominant site fills many buckets.  Rows
    are brought into buckets first, which leaves one file per bucket.  The
    catalogue has a table per version, named after it.
    """

    def write(rows: DataFrame, folder: str, version: str) -> str:
        name = f"{table}_{version}"
        rows.write.bucketBy(buckets, "rwl", "tree").sortBy("rwl", "tree", "year").option("path", folder).saveAsTable(name)
        return name

    return _commit(df.repartition(buckets, "rwl", "tree"), path, write)
