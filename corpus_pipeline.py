"""A corpus from raw documents to packed sequences, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cambium.llm.common import file_order, settle, table
from cambium.llm.language_id import UNDETERMINED, identify_languages
from cambium.llm.line_dedup import line_dedup
from cambium.llm.mixing import mixed_order
from cambium.llm.packing import pack
from cambium.llm.simhash import simhash_groups


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


#: A document stays if the network gives one language at least this much of the probability. Of four languages each has a quarter
#: by chance; texts of two languages, and clean ones of odd words, come down to about a third.
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: those without a letter go, and those in which no language stands out (``LEAST_SCORE``)."""
    told = (F.col("language.lang_pred") != UNDETERMINED) & (F.col("language.score") >= LEAST_SCORE)
    return identify_languages(docs).where(told).select(*_columns(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many of them share; ``n_chars`` follows where the text was cut."""
    cut = F.col("lines.n_dropped") > 0
    new = {
        "text": F.when(cut, F.col("lines.kept")).otherwise(F.col("text")),
        "n_chars": F.when(cut, F.char_length("lines.kept").cast("long")).otherwise(F.col("n_chars")),
    }
    return line_dedup(docs).select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: of those with the group's least id the first by what it holds; rows without an id stay.

    Rows are told apart by their place in the written table (``docs`` must come from one), not by their ids, so that
    rows that repeat an id are judged each by its own text, and of equal rows one is left.
    """
    place = F.struct(F.xxhash64(*_columns(docs)).alias("row"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    groups = simhash_groups(docs, carry=place)
    stay = groups.where("component_id is not null").groupBy("component_id").agg(F.min(F.struct("doc_id", "carried")).alias("first")).select("first.carried.*")
    unnamed = groups.where("component_id is null").select("carried.*")
    stay = stay.unionByName(unnamed).select(F.col("file").alias("_file"), F.col("at").alias("_at"))
    placed = docs.withColumns({"_file": F.col("_metadata.file_path"), "_at": F.col("_metadata.row_index")})
    return placed.join(stay, ["_file", "_at"], "left_semi").select(*_columns(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order of a mix of their sources."""
    return mixed_order(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their sequences and places; sequences follow the rows of the stage before."""
    return pack(docs, order=file_order())


STAGES = [
    ("language_id", language_id),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("mix_sources", mix),
    ("best_fit_packing", packing),
]

#: Neither the network nor the schedule nor the packing is an SQL expression; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
