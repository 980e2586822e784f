"""How the filters of a corpus interact: what each order of them removes at each step, and the Shapley share of each filter."""

from __future__ import annotations

from collections.abc import Mapping
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows without an id are dealt over so many keys where rows are joined by id.
NULL_SALTS = 200


def solve(rows: list[list[Fraction]]) -> list[list[Fraction]]:
    """What stands right of the square part of an augmented matrix once that is the identity (Gauss-Jordan, in rationals)."""
    rows = [list(r) for r in rows]
    n = len(rows)
    for i in range(n):
        pivot = next(j for j in range(i, n) if rows[j][i])
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for j in range(n):
            if j != i and rows[j][i]:
                factor = rows[j][i]
                rows[j] = [a - factor * b for a, b in zip(rows[j], rows[i], strict=True)]
    return [r[n:] for r in rows]


def shapley_weights(n: int) -> list[list[Fraction]]:
    """For each of ``n`` filters, the factor of every coalition's removals (by bit mask) in its Shapley value.

    The values phi minimise sum over coalitions S, neither empty nor full, of k(S) (v(S) - sum of phi in S)^2 with the kernel
    k(S) = (n - 1) / (C(n, |S|) |S| (n - |S|)), under the constraint that they add up to v(all). The normal equations, bordered by
    the constraint and its multiplier, do not depend on v but for their right side, which is linear in it: solving them once with a
    column for every coalition gives factors that serve every part.
    """
    full = (1 << n) - 1
    kernel = {s: Fraction(n - 1, comb(n, s.bit_count()) * s.bit_count() * (n - s.bit_count())) for s in range(1, full)}
    rows = []
    for i in range(n):
        left = [sum((k for s, k in kernel.items() if s >> i & 1 and s >> j & 1), Fraction(0)) for j in range(n)]
        rows.append([*left, Fraction(1), *[kernel.get(s, Fraction(0)) if s >> i & 1 else Fraction(0) for s in range(full + 1)]])
    rows.append([*[Fraction(1)] * n, Fraction(0), *[Fraction(int(s == full)) for s in range(full + 1)]])
    return solve(rows)[:n]


def text_filters(text: Column) -> dict[str, Column]:
    """The failure conditions that a text shows by itself: few words (A), repeated words (B), capitals (C), odd signs (D)."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), "")
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 80 * F.size(words).cast("long"),
        "C": 100 * capitals.cast("long") > 10 * F.char_length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with ``good`` and ``toxic``, 0 or 1: whether any row of ``labels`` says so of their id."""
    is_one = lambda c: F.max(F.coalesce(F.col(f"`{c}`") == 1, F.lit(False)).cast("long"))
    said = labels.select("doc_id", "quality", "toxic").where("doc_id is not null and (quality = 1 or toxic = 1)")
    said = said.groupBy(F.col("doc_id").alias("id")).agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic")).withColumn("salt", F.lit(0))
    spread = F.when(F.col("id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(NULL_SALTS)).cast("int")).otherwise(0)
    joined = rows.withColumn("salt", spread).join(said, ["id", "salt"], "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")}).drop("salt")


def failure_counts(
    docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column], *, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Rows (part, mask, n, good, toxic): how many documents of each part fail exactly the filters whose bits are set.

    Bits follow ``filters``; one more is set for a text equal to that of any smaller id. Texts are compared by 256 bits of digest
    and never move. Documents are summed by (id, digest), then by (digest, part), apart from what stands at the least id; only that
    is compared with the least id of the digest. A text shared by a third of all rows is a few rows per task by then.
    """
    measures = ("n", "good", "toxic")
    mask = sum((F.when(failed, 1 << i).otherwise(0) for i, failed in enumerate(filters.values())), F.lit(0))
    digest = F.unhex(F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256))
    part = F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), part.alias("part"), digest.alias("digest"), mask.alias("mask"))
    by_id = _labelled(rows.groupBy("id", "digest", "part", "mask").agg(F.count("*").alias("n")), labels)
    by_id = by_id.withColumns({c: F.col(c) * F.col("n") for c in ("good", "toxic")})
    named = F.col("id").isNotNull()
    by_text = by_id.groupBy("digest", "part", "mask").agg(
        *[F.sum(c).alias(c) for c in measures],
        *[F.sum(F.when(named, 0).otherwise(F.col(c))).alias(f"unnamed_{c}") for c in measures],
        F.min(F.when(named, F.struct("id", *measures))).alias("first"),
    )
    judged = by_text.withColumn("least", F.min("first.id").over(Window.partitionBy("digest")))
    original = {c: F.col(f"unnamed_{c}") + F.when(F.col("first.id") == F.col("least"), F.col(f"first.{c}")).otherwise(0) for c in measures}
    copied = F.col("mask").bitwiseOR(F.lit(1 << len(filters))).alias("mask")
    both = F.array(F.struct("mask", *[original[c].alias(c) for c in measures]), F.struct(copied, *[(F.col(c) - original[c]).alias(c) for c in measures]))
    return judged.select("part", F.explode(both).alias("x")).groupBy("part", "x.mask").agg(*[F.sum(f"x.{c}").alias(c) for c in measures])


def coalitions(counts: DataFrame, n: int) -> DataFrame:
    """One row per part: ``n``, and what each of the 2^n coalitions of filters removes, by bit mask (arrays removes, good, toxic)."""
    every = counts.withColumn("coalition", F.explode(F.sequence(F.lit(0), F.lit((1 << n) - 1))))
    hit = F.col("mask").bitwiseAND(F.col("coalition")) != 0
    removed = [F.sum(F.when(hit, F.col(c)).otherwise(0)).alias(c) for c in ("n", "good", "toxic")]
    tabled = every.groupBy("part", "coalition").agg(*removed, F.sum("n").alias("all"))
    whole = tabled.groupBy("part").agg(F.max("all").alias("n"), F.array_sort(F.collect_list(F.struct("coalition", "n", "good", "toxic"))).alias("v"))
    return whole.select("part", "n", F.col("v.n").alias("removes"), F.col("v.good").alias("good"), F.col("v.toxic").alias("toxic"))


def filter_audit(
    docs: DataFrame,
    labels: DataFrame,
    filters: Mapping[str, Column] | None = None,
    *,
    copies: str = "E",
    part_col: str = "lang",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row for every part, order of the filters and step of the order.

    ``filters`` names failure conditions (default: `text_filters`); ``copies`` names the one that fails a text equal to that of
    any smaller id, whether that is removed before or not. Every document becomes a mask of what it fails, the masks are counted
    by part, and the removals of all 2^n coalitions (32 for five filters) are tabled from these counts. What a step removes, and
    loses of good (quality = 1) and toxic documents, is the difference of two coalitions. ``shapley`` is the filter's Shapley
    value times the number of orders, by the kernel-weighted least squares of `shapley_weights`: it equals what the filter
    removes, summed over all orders.

    Counts: kept, removed, redundant (fail the filter, removed before), unique_fails (fail this filter only), good_lost, toxic_lost.

    A null text is empty, a null part the empty string. A row without an id is a copy of nothing, nothing is a copy of it, and no
    label is its own. Rows that repeat an id are documents of their own, copies only of smaller ids. Labels that repeat an id hold
    where any says so. An empty table gives an empty result. All orders are listed, so filters should be few.
    """
    filters = text_filters(F.col(f"`{text_col}`")) if filters is None else dict(filters)
    names = [*filters, copies]
    n, full = len(names), (1 << len(names)) - 1
    table = coalitions(failure_counts(docs, labels, filters, part_col=part_col, id_col=id_col, text_col=text_col), n)

    def shapley(weights: list[Fraction]) -> Column:
        factors = F.array(*[F.lit(int(w * factorial(n))).cast("long") for w in weights])
        return F.aggregate(F.zip_with("removes", factors, lambda v, w: v * w), F.lit(0).cast("long"), lambda total, x: total + x)

    table = table.withColumn("shapley", F.array(*[shapley(w) for w in shapley_weights(n)]))
    orders = F.array(*[F.array(*[F.lit(i) for i in order]) for order in permutations(range(n))])
    rows = table.withColumn("order", F.explode(orders)).select("*", F.posexplode("order").alias("nth", "filter"))
    bit = lambda i: F.call_function("shiftleft", F.lit(1), i)
    rows = rows.withColumn("own", bit(F.col("filter"))).withColumn("before", F.aggregate(F.slice("order", 1, F.col("nth")), F.lit(0), lambda s, i: s + bit(i)))
    gone = lambda c: F.get(c, F.col("before") + F.col("own")) - F.get(c, F.col("before"))
    return rows.select(
        "part",
        F.array_join(F.transform("order", lambda i: F.get(F.array(*[F.lit(x) for x in names]), i)), "").alias("filter_order"),
        (F.col("nth") + 1).alias("step"),
        (F.col("n") - F.get("removes", F.col("before") + F.col("own"))).alias("kept"),
        gone("removes").alias("removed"),
        (F.get("removes", "own") - gone("removes")).alias("redundant"),
        (F.get("removes", F.lit(full)) - F.get("removes", F.lit(full) - F.col("own"))).alias("unique_fails"),
        gone("good").alias("good_lost"),
        gone("toxic").alias("toxic_lost"),
        F.get("shapley", "filter").alias("shapley"),
    )
