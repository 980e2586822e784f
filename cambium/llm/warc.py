"""WARC archives: written with one record per page, read back by verifying the chain of record boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cambium.llm.common import settle, shared_dir

#: Fixed values of the format.
MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORD_ID = "urn:pages:"


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value; line ends inside the value are percent-encoded."""
    safe = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit("\r\n")), F.lit(""))


def write_archives(pages: DataFrame, path: str, *, min_revisit_bytes: int = 1000, date: str = "2020-01-01T00:00:00Z") -> None:
    """Write one record per row of ``pages`` (page_id, url, html) to uncompressed archives under ``path``.

    Of rows with equal payloads of at least ``min_revisit_bytes`` that with the largest page_id is a response record; the others
    are revisit records without a payload that refer to it. The text writer's line separator is the end of a record, so Spark
    writes the archives without any code of ours in the tasks. A null html is an empty payload, a null url has no target line, a
    null page_id an empty one in the record id. Rows that share the largest page_id of their payload are all responses.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.octet_length(html).cast("long").alias("bytes"), F.sha1(html).alias("digest"))
    long = rows.where(F.col("bytes") >= min_revisit_bytes)
    heads = settle(long.groupBy("digest", "bytes").agg(F.max("page_id").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n"))
    judged = rows.join(heads, ["digest", "bytes"], "left").withColumn("revisit", F.coalesce(~F.col("page_id").eqNullSafe(F.col("head")) & F.col("head").isNotNull(), F.lit(False)))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    length = F.octet_length(http) + F.when(F.col("revisit"), 0).otherwise(F.col("bytes"))
    identity = lambda c: F.concat(F.lit(f"<{_RECORD_ID}"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    record = F.concat(
        F.lit(MAGIC),
        _field("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        _field("WARC-Record-ID", identity("page_id")),
        _field("WARC-Date", F.lit(date)),
        _field("WARC-Target-URI", F.col("url")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _field("WARC-Profile", F.when(F.col("revisit"), PROFILE)),
        _field("WARC-Refers-To", F.when(F.col("revisit"), identity("head"))),
        _field("Content-Type", F.lit("application/http; msgtype=response")),
        _field("Content-Length", length.cast("string")),
        F.lit("\r\n"),
        http,
        F.when(F.col("revisit"), "").otherwise(F.col("html")),
    )
    judged.select(record.alias("value")).write.option("lineSep", END).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The archives cut at every magic, wherever it stands: file, place of the piece's split, order in the split, bytes."""
    text = spark.read.option("lineSep", MAGIC).text(path)
    return text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("nth"), "value"
    )


def _name(value: Column) -> Column:
    """What a piece is known by wherever it is read: 256 bits of digest of its bytes."""
    return F.unhex(F.sha2(value.cast("binary"), 256))


def _value(header: Column, name: str) -> Column:
    found = F.regexp_extract(header, rf"(?im)^{name}:[ \t]*([^\r\n]*?)[ \t]*$", 1)
    return F.when(found != "", found)


def _fields(df: DataFrame) -> DataFrame:
    """``df`` (with ``value``) plus what the header says; ``length`` is null where there is no complete header."""
    data = F.col("value").cast("binary")
    df = df.withColumn("header", F.substring_index("value", END, 1)).withColumn("head", (F.octet_length("header") + len(END)).cast("long"))
    complete = F.col("head") <= F.octet_length("value")
    df = df.withColumn("length", F.when(complete, F.expr("try_cast(regexp_extract(header, '(?im)^Content-Length:[ \\\\t]*([0-9]{1,18})[ \\\\t]*$', 1) AS bigint)")))
    block = F.substring(data, F.col("head").cast("int") + 1, F.least(F.coalesce("length", F.lit(0)), F.octet_length("value")).cast("int"))
    df = df.withColumn("block", block).withColumn("http", F.substring_index(F.col("block").cast("string"), END, 1))
    skip = F.octet_length("http") + len(END)
    payload = F.substring(F.col("block"), skip.cast("int") + 1, F.octet_length("block"))
    return df.select(
        *[c for c in df.columns if c not in ("header", "block", "http", "value")],
        F.lower(_value(F.col("header"), "WARC-Type")).alias("type"),
        _value(F.col("header"), "WARC-Record-ID").alias("record_id"),
        _value(F.col("header"), "WARC-Refers-To").alias("refers"),
        _value(F.col("header"), "WARC-Payload-Digest").alias("declared"),
        F.expr("try_cast(regexp_extract(http, '(?im)^Content-Length:[ \\\\t]*([0-9]{1,18})[ \\\\t]*$', 1) AS bigint)").alias("declared_bytes"),
        F.octet_length(payload).cast("long").alias("bytes"),
        F.sha1(payload).alias("digest"),
    )


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """A row for every magic of every archive: its offset, the offset at which its record would end, and what its header says.

    A piece's offset is the length of what comes before it: summed by split, and over the splits of a file. Splits may differ the
    next time that the archives are read (they follow the number of cores), so they are used within this one pass only.
    """
    cut = _pieces(spark, path).withColumns({"size": (F.octet_length("value") + len(MAGIC)).cast("long"), "piece": _name(F.col("value"))})
    rows = settle(_fields(cut))
    splits = rows.groupBy("file", "split").agg(F.sum("size").alias("total"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "split", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    here = Window.partitionBy("file", "split").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("within", F.coalesce(F.sum("size").over(here), F.lit(0))).join(splits, ["file", "split"])
    at = F.col("base") + F.col("within") - len(MAGIC)
    found = placed.select("*", at.alias("at")).where("at >= 0")
    end = F.col("at") + len(MAGIC) + F.col("head") + F.col("length") + len(END)
    whole = F.col("size") == len(MAGIC) + F.col("head") + F.col("length") + len(END)
    return settle(found.withColumn("next", end).withColumn("whole", F.coalesce(whole, F.lit(False))).drop("base", "within", "nth", "size"))


def reachable(found: DataFrame) -> DataFrame:
    """The candidates that a walk from the start of their file over record ends comes to; a magic inside a payload is passed over.

    Candidates of a split whose record ends where the next candidate begins form a run. Runs are linked by the candidate at which
    their last record ends, and the links are doubled (pointer jumping) until the walk from offset 0 finds no more: the number of
    rounds grows with the logarithm of the runs of a file, which is one for each split and magic inside a payload.
    """
    line = Window.partitionBy("file", "split").orderBy("at")
    fresh = ~F.lag("next").over(line).eqNullSafe(F.col("at"))
    runs = found.withColumn("fresh", fresh.cast("int")).withColumn("run", F.sum("fresh").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    runs = settle(runs.withColumn("lo", F.min("at").over(Window.partitionBy("file", "split", "run"))).drop("fresh", "run"))
    exits = runs.groupBy("file", "lo").agg(F.max_by("next", "at").alias("next"))
    spots = runs.select("file", F.col("at").alias("next"), F.col("lo").alias("to"))
    jump = settle(exits.join(spots, ["file", "next"]).select("file", "lo", "to", F.col("next").alias("entry")))
    walked = settle(runs.where("at = 0").select("file", "lo", F.col("at").alias("entry")))
    size, before = walked.count(), -1
    while size > before:
        step = walked.select("file", "lo").join(jump, ["file", "lo"]).select("file", F.col("to").alias("lo"), "entry")
        walked = settle(walked.union(step).groupBy("file", "lo").agg(F.min("entry").alias("entry")))
        onward = jump.select("file", F.col("lo").alias("to"), F.col("to").alias("further"), F.col("entry").alias("later"))
        jump = settle(jump.join(onward, ["file", "to"]).select("file", "lo", F.col("further").alias("to"), F.col("later").alias("entry")))
        size, before = walked.count(), size
    return runs.join(walked, ["file", "lo"]).where("at >= entry").drop("lo", "entry")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives: record_id, type, refers, declared (digest), declared_bytes, bytes and digest of the payload.

    Every magic is a candidate (`candidates`); the boundary chain tells records from bytes that only look like one
    (`reachable`). A payload that holds a magic lies in several pieces. These are read again, by digest and not by place, so that
    other splits give the same, and joined in order; all others are digested where they are read. Records behind a broken boundary
    are not reachable and left out.
    """
    found = candidates(spark, path)
    records = settle(reachable(found))
    fields = ["record_id", "type", "refers", "declared", "declared_bytes", "bytes", "digest"]
    result = records.where("whole").select(*fields)
    if records.where("not whole").isEmpty():
        return result
    starts = records.select("file", "at", F.col("at").alias("start"), "whole")
    line = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    owned = found.drop("whole").join(starts, ["file", "at"], "left").select(
        "file", "piece", "at", F.last("start", True).over(line).alias("start"), F.last("whole", True).over(line).alias("whole")
    )
    owned = settle(owned.where("not whole").drop("whole"))
    cut = _pieces(spark, path).select(_name(F.col("value")).alias("piece"), "value")
    again = cut.join(owned.select("piece").distinct(), "piece", "left_semi").groupBy("piece").agg(F.max("value").alias("value"))
    parts = owned.join(again, "piece").groupBy("file", "start").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("parts"))
    joined = parts.select(F.array_join(F.col("parts.value"), MAGIC).alias("value"))
    return result.unionByName(_fields(joined).select(*fields))


def page_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to (a page_id, null for responses).

    A response's figures are taken from its payload; a revisit, which has none, holds those of the payload that it refers to.
    """
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '<{_RECORD_ID}(-?[0-9]+)>', 1) AS bigint)")
    revisit = F.col("type") == "revisit"
    return read_archives(spark, path).select(
        page("record_id").alias("page_id"),
        F.when(revisit, F.col("declared_bytes")).otherwise(F.col("bytes")).alias("payload_bytes"),
        F.when(revisit, F.substring_index("declared", ":", -1)).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.when(revisit, page("refers")).alias("refers_to"),
    )


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """``pages`` written as archives in the shared folder and read back (`write_archives`, `page_records`)."""
    path = shared_dir(pages.sparkSession)
    write_archives(pages, path, **options)
    return page_records(pages.sparkSession, path)
