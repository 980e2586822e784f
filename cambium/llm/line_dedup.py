"""Removal of lines that many documents share."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cambium.llm.common import settle

#: Fixed value: the characters of [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without blanks at both ends and with A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), string.ascii_uppercase, string.ascii_lowercase)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_dedup(docs: DataFrame, *, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document without the lines that at least ``min_docs`` documents hold, but for the document of the largest id.

    Lines are exploded with their positions, keyed by 128 bits of hash of their normal form, and counted by distinct document; the
    dropped positions of a document then cut its array of lines. Returns the columns of ``docs`` plus ``lines`` (struct of
    ``n_lines``, ``n_dropped`` and ``kept``, the text that is left).

    A null or empty text is one empty line. Rows that repeat an id are one document when documents are counted, and each is cut
    by itself. Rows without an id are not counted and keep all their lines. An empty table gives an empty result.
    """
    own = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, own, strict=True)])
    text, id_ = F.col(own[docs.columns.index(text_col)]), F.col(own[docs.columns.index(id_col)])
    rows = rows.withColumn("tid", F.xxhash64(text))
    lines = rows.select(id_.alias("id"), "tid", F.posexplode(_lines(text)).alias("pos", "line")).withColumn("key", line_key(F.col("line")))
    long = lines.where((F.char_length("key") >= min_chars) & F.col("id").isNotNull())
    long = settle(long.select("id", "tid", "pos", F.xxhash64("key").alias("h"), F.xxhash64(F.lit(1), "key").alias("g")))
    shared = long.groupBy("h", "g", "id").agg(F.lit(1).alias("one")).groupBy("h", "g").agg(F.count("*").alias("docs"), F.max("id").alias("last")).where(F.col("docs") >= min_docs)
    shared = settle(shared.select("h", "g", "last"))
    dropped = long.join(shared, ["h", "g"]).where("id <> last").groupBy("id", "tid").agg(F.collect_set("pos").alias("gone"))
    cut = rows.join(dropped.select(F.col("id").alias("did"), F.col("tid").alias("dtid"), "gone"), (id_ == F.col("did")) & (F.col("tid") == F.col("dtid")), "left")
    lined = cut.withColumn("all", _lines(text))
    places = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size("all") - 1), "gone"))
    kept = F.when(F.col("gone").isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(F.transform(places, lambda i: F.get("all", i)), "\n"))
    counts = F.struct(
        F.size("all").cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"),
        kept.alias("kept"),
    )
    return lined.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, own, strict=True)], counts.alias("lines"))
