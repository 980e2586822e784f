"""Words of a corpus grouped with the common word that they are one typing error away from."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cambium.llm.common import settle
from cambium.llm.fm_index import Index

#: Fixed value: what a word is made of, once A-Z is lower-cased.
LETTERS = "[a-zÀ-ÿ]+"
#: Distinct words that a task counts before it hands the counts on.
HELD = 300_000
#: Letters of the words of one index, and words that are looked up in it at a time.
BLOCK_LETTERS = 1 << 19
BLOCK_QUERIES = 1 << 16
#: Postings that a key may keep (up to three of a word); larger keys are halved again.
KEY_WORDS = 30_000


def damaged(run: str, number: int, modulus: int) -> str:
    """``run`` without one letter if ``modulus`` divides ``number``, as it is otherwise."""
    if not modulus or number % modulus:
        return run
    at = number % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, *, modulus: int = 199, min_chars: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (word, n): how often each word of at least ``min_chars`` letters stands in the texts.

    Words are runs of letters with A-Z lower-cased. A run whose crc32 with its document's id is a multiple of ``modulus`` loses one
    letter first (0: none does). Tasks hand on sums, so that a word that is everywhere is a few rows per task.
    """
    letters = re.compile(LETTERS)

    def sums(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for id_, text in zip(batch.column(0), batch.column(1), strict=True):
                prefix = crc32(f"{id_}:".encode())
                raw = text.as_buffer()
                lowered = b"" if raw is None else raw.to_pybytes().lower()
                for word, n in Counter(letters.findall(lowered.decode("utf-8", "replace"))).items():
                    if len(word) >= min_chars:
                        word = damaged(word, crc32(word.encode(), prefix), modulus)
                        if len(word) >= min_chars:
                            counts[word] += n
                if len(counts) > HELD:
                    yield sums(counts)
                    counts.clear()
        yield sums(counts)

    id_ = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    rows = docs.select(id_.alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _keyed(rows: DataFrame) -> DataFrame:
    """``rows`` with the ``key`` of the words that share the first ``begin`` and the last ``end`` letters."""
    shared = F.substring(F.col("word"), F.lit(1), F.col("begin")), F.substring(F.col("word"), F.char_length("word") - F.col("end") + 1, F.col("end"))
    return rows.withColumn("key", F.xxhash64("begin", "end", *shared))


def _halved(rows: DataFrame) -> DataFrame:
    """Every row twice: with the first half of its open letters closed, and with the second.

    An error within the open letters leaves one of their halves as it is, so what is found by neither is not near. What has the
    first half in common (``skip`` letters from the beginning) is found there and dropped where the second half is closed.
    """
    half = F.floor(F.col("open") / 2).cast("int")
    first = F.struct((F.col("begin") + half).alias("begin"), F.col("end"), F.col("skip"), (F.col("open") - half).alias("open"))
    second = F.struct(F.col("begin"), (F.col("end") + F.col("open") - half).alias("end"), (F.col("begin") + half).alias("skip"), half.alias("open"))
    # of a single letter there is but one part
    return _keyed(rows.select("role", "word", "n", F.inline(F.when(half > 0, F.array(first, second)).otherwise(F.array(first)))))


def postings(words: DataFrame) -> DataFrame:
    """Rows (role, word, n, begin, end, skip, open, key): where each word is kept (role 0) and where it is looked up (role 1).

    A word is looked up by its first half and by its second; it is kept wherever a word one letter shorter, as long, or one letter
    longer that is near it would look. Keys are hashes; a collision only puts words into one index that need not be.

    A key that keeps more than KEY_WORDS is halved again, for the words that it keeps and those it looks up: either half of the
    letters that are still open is closed. So no index has to hold a large group, and no word goes through all of it; with one open
    letter a group holds what differs in that letter.
    """
    size = F.char_length("word")
    lengths = F.array(*[F.struct(F.lit(role).alias("role"), (size + d).alias("open")) for role, d in ((1, 0), (0, -1), (0, 0), (0, 1))])
    whole = words.select("word", "n", F.inline(lengths)).where("open > 0")
    rows = settle(_halved(whole.withColumns({c: F.lit(0) for c in ("begin", "end", "skip")})))
    while True:
        wide = F.col("open") > 1
        large = settle(rows.where(wide & (F.col("role") == 0)).groupBy("key").agg(F.count("*").alias("held")).where(F.col("held") > KEY_WORDS).select("key"))
        if large.isEmpty():
            return rows
        marked = rows.join(large.withColumn("large", F.lit(True)), "key", "left").withColumn("large", F.coalesce(F.col("large") & wide, F.lit(False)))
        rows = settle(marked.where("not large").select(*rows.columns).unionByName(_halved(marked.where("large"))))


def _search(words: list[str], n: np.ndarray, index: Index, sought: list[tuple[str, int, int, int]]) -> pa.RecordBatch:
    """A row for each word of ``sought`` (word, begin, end, skip) with a word near it: how many are found here, and the most
    frequent of them.

    The index holds the words of other keys too, so the end that both must share is compared where the search does not match it
    first; and what has ``skip`` letters in common is found elsewhere.
    """
    texts = [w for w, *_ in sought]
    who, what = index.one_error(texts, np.fromiter((begin or end for _, begin, end, _ in sought), np.int64, len(sought)))

    def own(a: int, b: int) -> bool:
        (word, begin, end, skip), other = sought[a], words[b]
        return not (skip and other[:skip] == word[:skip]) and (not begin or not end or other[-end:] == word[-end:])

    kept = [own(a, b) for a, b in zip(who.tolist(), what.tolist(), strict=True)]
    who, what = who[kept], what[kept]
    order = np.lexsort((_alphabetical(words)[what], -n[what], who))
    who, what = who[order], what[order]
    who, first, count = np.unique(who, return_index=True, return_counts=True)
    best = what[first].tolist()
    columns = [pa.array([texts[i] for i in who.tolist()], pa.string()), pa.array(count), pa.array(n[best] if best else [], pa.int64()), pa.array([words[i] for i in best], pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["word", "n_near", "form_n", "form"])


def _alphabetical(words: list[str]) -> np.ndarray:
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    return rank


def near_words(words: DataFrame) -> DataFrame:
    """Rows (word, n_near, form_n, form) for every word with words one inserted, deleted or replaced letter away.

    ``words`` has distinct words with n. The `postings` of a key meet in one task; the words kept by it and by its neighbours form
    an index of bounded size (`Index`, backwards where a beginning is shared, else forwards), in which the words that these keys
    look up are matched exactly from that end and with one error beyond it. Pairs of words are made only where they are near.
    """
    # a fixed number: the work is in the searches, not in the bytes by which adaptive execution would merge partitions
    partitions = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = postings(words).select((F.col("begin") == 0).alias("forwards"), "key", "role", "word", "n", "begin", "end", "skip")
    rows = rows.repartition(partitions, "forwards", "key").sortWithinPartitions("forwards", "key", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ahead, kept, sought, letters, index, last = False, {}, [], 0, None, None

        def look_up() -> pa.RecordBatch:
            nonlocal index
            held = list(kept)
            index = index or Index(held, backwards=not ahead)
            return _search(held, np.fromiter(kept.values(), np.int64, len(kept)), index, sought)

        for batch in batches:
            for forwards, key, role, word, n, begin, end, skip in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (forwards, key) != last:
                    last = (forwards, key)
                    if forwards != ahead or letters > BLOCK_LETTERS or len(sought) > BLOCK_QUERIES:
                        if sought and kept:
                            yield look_up()
                        ahead, kept, sought, letters, index = forwards, {}, [], 0, None
                if role == 0:
                    if word not in kept:
                        kept[word] = n
                        letters += len(word) + 1
                else:
                    sought.append((word, begin, end, skip))
                    if len(sought) > 2 * BLOCK_QUERIES and kept:
                        yield look_up()
                        sought = []
        if sought and kept:
            yield look_up()

    found = rows.mapInArrow(run, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.less")).alias("form_n"), "best.form")


def roots(forms: DataFrame) -> DataFrame:
    """Rows (word, root) for rows (word, form) that lead to ever more frequent words: the last word that each leads to.

    Links are doubled, each round written to the shared folder, until none grows: the rounds follow the logarithm of the longest chain.
    """
    state = settle(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = state.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = state.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        joined = settle(joined)
        if joined.where("moved").isEmpty():
            return joined.select("word", "root")
        state = joined.select("word", "root")


def spelling_variants(
    docs: DataFrame, *, min_chars: int = 6, min_count: int = 5, ratio: int = 5, modulus: int = 199, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row for every word of at least ``min_chars`` letters that stands at least ``min_count`` times in all texts together.

    Columns: word; n; n_near, how many such words are one inserted, deleted or replaced letter away; form, the most frequent of
    these (of equals the first in code-point order) where it is at least ``ratio`` times as frequent as the word, else null;
    form_n; root, where following the forms ends, the word itself where it has none.

    Words of any length are compared whole. A null or empty text has no words. A row without an id counts like one whose id is the
    empty string (`word_counts`). Repeated rows count each. An empty table gives an empty result.
    """
    words = word_counts(docs, modulus=modulus, min_chars=min_chars, id_col=id_col, text_col=text_col)
    words = settle(words.where(F.col("n") >= min_count))
    enough = F.col("form_n") >= ratio * F.col("n")
    joined = words.join(near_words(words), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("form")).alias("form"), F.when(enough, F.col("form_n")).alias("form_n")
    )
    joined = settle(joined)
    rooted = joined.join(roots(joined.where("form is not null")), "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
