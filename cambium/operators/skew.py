"""Joins and order statistics that survive one key holding a third of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cambium.stages import stage

SALT = "_salt"
DEFAULT_SALTS = 16

# Largest group that may be turned into one in-memory array.
MAX_GROUP = 50_000


def as_list(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def salt_of(columns: str | Sequence[str], salts: int = DEFAULT_SALTS) -> Column:
    """Deterministic salt from row content, equal on every retry of a task."""
    return F.pmod(F.xxhash64(*as_list(columns)), F.lit(salts)).cast("int")


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def window_salts(df: DataFrame) -> int:
    """Salts where a window reuses the salted partitioning.

    Adaptive execution cannot split a partition there, so the salts follow the
    number of shuffle partitions.
    """
    return min(max(shuffle_partitions(df), DEFAULT_SALTS), 1024)


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame,
    on: str | Sequence[str],
    spread_by: str | Sequence[str],
    how: str = "left",
    salts: int = DEFAULT_SALTS,
    keep_salt: bool = False,
) -> DataFrame:
    """Join many rows to a table with one row per key.

    The key alone may be hot (one site with a third of all trees), so the rows
    are spread over ``salts`` partitions by other columns and the lookup, which
    is one row per key, is repeated once per salt.  Where the lookup is small
    Spark still turns this into a broadcast join by its own size estimate, and
    where a salted partition is still too large adaptive execution splits it.
    With ``keep_salt`` the salt stays, so a later window over
    ``(on, salt, spread_by)`` reuses the partitioning of this join.
    """
    keys = as_list(on)
    salted_rows = rows.withColumn(SALT, salt_of(spread_by, salts))
    salted_lookup = lookup.withColumn(
        SALT, F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    )
    joined = salted_rows.join(salted_lookup, [*keys, SALT], how)
    return joined if keep_salt else joined.drop(SALT)


def split_hot(
    df: DataFrame, keys: Sequence[str], spread_by: str | Sequence[str], max_group: int = MAX_GROUP, stored: bool = False
) -> tuple[DataFrame, DataFrame | None]:
    """The rows of groups of up to ``max_group`` rows, and those of larger ones, if there are any.

    ``df`` is computed once, into a stage (``stored``: it is a stored table
    already).  The groups are counted there with partial aggregation, by
    columns that a scan reads alone.  Where no group is large the stage itself
    comes back, so that what follows is one plan over one scan.  Otherwise rows
    find their group's size by a salted join, so that a large group never meets
    in one task, and the rows of large groups become a stage of their own.  Both
    parts must lead to the same results: the split is about memory only.
    """
    keys = list(keys)
    rows = df if stored else stage(df)
    hot = stage(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max_group).select(*keys))
    if hot.isEmpty():
        return rows, None
    return (
        lookup_join(rows, hot, keys, spread_by, "left_anti"),
        stage(lookup_join(rows, hot, keys, spread_by, "left_semi")),
    )


def exact_ranks(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    spread_by: str | Sequence[str],
    fractions: Sequence[float],
    ranks,
    max_group: int = MAX_GROUP,
    accuracy: int = 10_000,
) -> DataFrame:
    """Exact order statistics of very large groups without collecting a group.

    ``ranks(n)`` gives, for each entry of ``fractions``, a list of 1-based
    ranks (columns) near ``fraction * n``.  A mergeable quantile sketch brackets every
    target; rows below a bracket are only counted, rows inside it are counted
    per distinct value (both partially aggregated, spread by value), and the
    exact rank is read from running counts of the few values inside.  The
    result holds ``n`` and a column ``v<i>_<j>`` for rank j of fraction i.  The
    bracket holds all ranks within 2 of ``fraction * n`` in groups of more than
    ``max_group`` values; smaller groups are counted whole.
    """
    keys = list(keys)
    margin = 4.0 / accuracy + 3.0 / max_group
    probabilities = []
    for f in fractions:
        probabilities += [max(0.0, f - margin), min(1.0, f + margin)]
    present = df.filter(F.col(value).isNotNull())
    sketch = present.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile_approx(value, probabilities, accuracy).alias("_q"),
    )

    def bound(i: int, end: float, open_end: float) -> Column:
        if probabilities[i] == end:
            return F.lit(open_end)
        return F.when(F.col("n") <= max_group, open_end).otherwise(F.col("_q")[i])

    targets = F.array(
        *[
            F.struct(
                F.lit(i).alias("target"),
                bound(2 * i, 0.0, float("-inf")).alias("lo"),
                bound(2 * i + 1, 1.0, float("inf")).alias("hi"),
            )
            for i in range(len(fractions))
        ]
    )
    counted = (
        lookup_join(present.select(*keys, *as_list(spread_by), value), sketch, keys, spread_by, "inner")
        .select(*keys, "n", value, F.explode(targets).alias("t"))
        .filter(F.col(value) <= F.col("t.hi"))
        .groupBy(
            *keys,
            "n",
            F.col("t.target").alias("_target"),
            F.when(F.col(value) >= F.col("t.lo"), F.col(value)).alias("_v"),
        )
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    ordered = Window.partitionBy(*keys, "n", "_target").orderBy(F.col("_v").asc_nulls_first())
    running = counted.withColumn("_upto", F.sum("_c").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    picks = []
    for i, wanted in enumerate(ranks(F.col("n"))):
        for j, rank in enumerate(wanted):
            here = (
                (F.col("_target") == i)
                & (rank > F.col("_upto") - F.col("_c"))
                & (rank <= F.col("_upto"))
            )
            picks.append(F.max(F.when(here, F.col("_v"))).alias(f"v{i}_{j}"))
    found = running.groupBy(*keys, "n").agg(*picks)
    # A missing order statistic stops the job instead of passing as NULL.
    missing = F.raise_error(F.lit("order statistic outside its bracket")).cast("double")
    values = [c for c in found.columns if c not in (*keys, "n")]
    return found.select(*keys, "n", *[F.coalesce(F.col(c), missing).alias(c) for c in values])
