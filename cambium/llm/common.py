"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of one key that a single task numbers; larger keys are dealt over several tasks.
ROWS_PER_SALT = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder that all executors share: below ``spark.checkpoint.dir``, or below the warehouse where that is unset.

    A cluster's executors do not share local folders, so without the setting a local warehouse is an error there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/stages"
        own = spark.conf.get("spark.master", "").split("[")[0] == "local"
        if not own and (folder.startswith("file:") or ":/" not in folder):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share: stages are written there")
    return f"{folder.rstrip('/')}/cambium-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, and nothing upstream is needed after a lost executor."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a file that a single task numbers where the order of the rows counts.
ROWS_PER_BLOCK = 10_000


def file_order() -> Column:
    """The place of a row in a table read from written files, in the order of their names: ``block`` and ``at``, the row in its file."""
    name, row = F.col("_metadata.file_name"), F.col("_metadata.row_index")
    part = F.coalesce(F.regexp_extract(name, r"part-(\d+)", 1).try_cast("long"), F.lit(0))
    block = F.struct(part.alias("part"), name.alias("file"), F.floor(row / ROWS_PER_BLOCK).alias("chunk"))
    return F.struct(block.alias("block"), row.alias("at"))


def hashed_share(column: Column) -> Column:
    """A number from 0 to 1, spread evenly over the values of ``column``: what is below x is a sample of that rate."""
    return F.xxhash64(column).cast("double") / 2.0**64 + 0.5


def running(
    df: DataFrame, keys: list[str], order: list[Column], value: Column, name: str, rows: int, rows_per_salt: int = ROWS_PER_SALT, salt: Column | None = None
) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of the same keys that come before, as ``name``.

    Rows of a key are ordered by salt and then by ``order``. Every (key, salt) is summed by its own task, and the sums of the
    salts before it are added, so that no key has to fit into one task. Keys must not be null, so that the sums can be joined
    where the rows already are. ``rows``: how many there are in all. ``salt``: in place of a hash, what rows are ordered by first.
    """
    if salt is None:
        salt = F.pmod(F.xxhash64(F.struct(*order)), F.lit(max(1, -(-rows // rows_per_salt)))).cast("int")
    spread = df.withColumn("_salt", salt)
    part = [*keys, "_salt"]
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    sums = spread.groupBy(*part).agg(F.sum(value).alias("_sum"))
    starts = sums.select(*part, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    here = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = spread.withColumn("_within", F.coalesce(F.sum(value).over(here), F.lit(0)))
    return within.join(starts, part).select(*df.columns, (F.col("_start") + F.col("_within")).alias(name))


#: Tasks that share the links of one well-connected node.
STAR_SALTS = 8


def _least(links: DataFrame) -> DataFrame:
    """Links (u, v) with the least neighbour of u, or u itself where that is less; a hot u is dealt over several tasks."""
    least = links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    least = least.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(STAR_SALTS - 1))))
    return links.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(STAR_SALTS)).cast("int")).join(least, ["u", "s"]).select("u", "v", "m")


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): rows (id, root) for every linked id but the roots, root the least id reachable.

    Large-star and small-star steps (Kiveris et al., 2014) in turn, each written to the shared folder, until nothing changes.
    The number of steps grows with the logarithm of the longest chain.
    """
    links = settle(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = links.union(links.select("v", "u"))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        near = _least(large)
        small = near.select("u", F.col("m").alias("v")).union(near.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v")
        links = settle(small.distinct())
        seen = links.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if seen == state:
            return links.select(F.col("u").alias("id"), F.col("v").alias("root"))
        state = seen
