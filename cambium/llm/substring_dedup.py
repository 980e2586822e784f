"""Removal of word sequences that occur earlier in the corpus, by matching statistics over suffix automata."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cambium.llm.bytesplit import mixed, runs, span_hashes
from cambium.llm.common import settle

WINDOW = 20
#: Words of an anchor; a window holds WINDOW - ANCHOR + 1 of them and is led by the one of the least hash.
ANCHOR = 8
GROUP_BYTES = 2_000_000
#: Windows that come more often than this are joined without a shuffle of their rows.
HOT_WINDOWS = 10_000

#: Fixed value: the bytes [\x20\x09-\x0D] separate words.
_KIND = np.where(np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)]), 0, 1).astype(np.uint8)
_SYMBOL = mixed(np.arange(1, 257).astype(np.uint64))


def leaders(texts: list[bytes], window: int = WINDOW, anchor: int = ANCHOR) -> dict[str, np.ndarray]:
    """For every anchor that leads a window: its text, its hash, the first window start, the number of windows, the fragment's hash.

    The leader of a window is the leftmost of its anchors with the least hash, so equal windows have equal leaders at the same
    place, and the windows with one leader begin one after the other. The fragment is all the words of those windows.
    """
    spans = runs(texts, _KIND)
    word = span_hashes(_SYMBOL[spans.buffer], spans.start, spans.stop)
    n = len(word)
    if n < window:
        return {k: np.zeros(0, np.int64) for k in ("text", "anchor", "lo", "windows", "fragment")}
    at = np.arange(n - anchor + 1)
    hashes = span_hashes(word, at, at + anchor)
    begin = np.flatnonzero(spans.text[: n - window + 1] == spans.text[window - 1 :])
    best = hashes[: n - window + 1].copy()
    lead = np.zeros(len(best), np.int64)
    for shift in range(1, window - anchor + 1):
        other = hashes[shift : shift + len(best)]
        less = other < best
        best[less] = other[less]
        lead[less] = shift
    lead = begin + lead[begin]
    first = np.flatnonzero(np.diff(lead, prepend=-1))
    windows = np.diff(np.append(first, len(lead)))
    lo, text = begin[first], spans.text[begin[first]]
    base = np.searchsorted(spans.text, text)
    fragment = span_hashes(mixed(word + np.uint64(1)), lo, lo + windows + window - 1)
    return {"text": text, "anchor": hashes[lead[first]].view(np.int64), "lo": lo - base, "windows": windows, "fragment": fragment.view(np.int64)}


class SuffixAutomaton:
    """The substrings of word sequences that were added one after the other (Blumer et al., 1985, for several texts)."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def _split(self, p: int, q: int, word: bytes) -> int:
        """The state of the longest suffix of ``p`` + word in state ``q``: q itself, or a copy of it that is given those."""
        if self.length[p] + 1 == self.length[q]:
            return q
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, words: list[bytes]) -> None:
        state = 0
        for word in words:
            q = self.next[state].get(word)
            if q is not None:
                state = self._split(state, q, word)
                continue
            new = len(self.next)
            self.next.append({})
            self.link.append(0)
            self.length.append(self.length[state] + 1)
            p = state
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, self.next[p][word], word)
            state = new

    def matching(self, words: list[bytes]) -> list[int]:
        """For every position the number of words of the longest substring that ends there."""
        out, state, size = [], 0, 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            q = self.next[state].get(word)
            if q is not None:
                state, size = q, size + 1
            out.append(size)
        return out


def repeated_starts(units: list[list[bytes]], window: int) -> list[list[int]]:
    """For each sequence of words, the starts of its windows that occur in a sequence before it."""
    automaton, out = SuffixAutomaton(), []
    for words in units:
        out.append([i - window + 1 for i, size in enumerate(automaton.matching(words)) if size >= window])
        automaton.add(words)
    return out


def units_of(words: list[bytes], window: int, salts: int) -> list[tuple[bytes, int, int]]:
    """The windows of a fragment as units (key, first start, windows): all in one, or each by itself, its key a hash of 128 bits."""
    n = len(words) - window + 1
    if salts == 1:
        return [(b"", 0, n)]
    return [(hashlib.blake2b(b" ".join(words[i : i + window]), digest_size=16).digest(), i, 1) for i in range(n)]


def _encoded(column: pa.Array) -> list[bytes]:
    return [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in column]


def _groups(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about GROUP_BYTES of text (column ``text``) each, so that a task holds little more than those."""
    sizes = np.cumsum(np.nan_to_num(pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False).astype(np.float64)))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + GROUP_BYTES, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def repeated_windows(units: DataFrame) -> DataFrame:
    """Rows (doc_id, tid, lo) of the windows (anchor, key, doc_id, tid, lo) that are not the first of their anchor and key.

    There are fewer than a row in HOT_WINDOWS of windows that come more often than that; those are joined by broadcast, so that
    their rows stay where they are.
    """
    place, window = F.struct("doc_id", "tid", "lo"), ["anchor", "key"]
    first = settle(units.groupBy(*window).agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1"))
    hot = F.broadcast(first.where(F.col("n") > HOT_WINDOWS).select(*window, F.col("first").alias("hot")))
    rest = units.join(hot, window, "left")
    cold = rest.where("hot is null").join(first.where(F.col("n") <= HOT_WINDOWS), window).where(place != F.col("first"))
    return rest.where(place != F.col("hot")).select("doc_id", "tid", "lo").unionByName(cold.select("doc_id", "tid", "lo"))


def remove_repeats(
    docs: DataFrame, *, window: int = WINDOW, anchor: int = ANCHOR, shard_fragments: int = 1000, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed and kept, the words that are left, joined by one space.

    A word goes if a window of ``window`` words over it also begins earlier: in a document of smaller id, or earlier in its own.

    1. Every window is led by one of its anchors (`leaders`). Windows with the same words have the same leader, so only anchors that
       lead twice can hold a repeat; these are counted over all documents, by hash.
    2. The fragment around a leader that is word for word one that came before repeats in all its windows. So each distinct
       fragment is only looked at where it comes first, and large groups of copies are gone before any text is compared.
    3. The reference shards are the distinct fragments of one anchor. Those of an anchor that has several are put in order, and each
       is streamed over the suffix automaton of those before it: where the matching statistic reaches ``window`` words, the
       window occurs earlier. Words are compared, not hashes. A shard has at most ``shard_fragments`` fragments; it goes to its task
       by a shuffle, as it has no bound to be broadcast by. Of an anchor with more fragments, every window is a unit by itself,
       known by a hash of 128 bits: the least place of each is found by partial aggregation, and all other places are
       repeats, found by a join. Such distinct windows cannot hold one another, so no automaton is needed for them.
    4. The windows found are gathered per document and their words removed.

    A null or empty text has no words. Rows that repeat id and text are one document; other rows under one id are documents of
    their own, in the order of their texts' hashes. Rows without an id are left whole and repeat nothing. Empty input: empty
    result.
    """
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    texts = texts.select("doc_id", F.pmod(F.xxhash64("text"), F.lit(2**31)).cast("int").alias("tid"), "text")

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _groups(batch, 2):
                found = leaders(_encoded(part.column(2)), window, anchor)
                at = found["text"].astype(np.int64)
                columns = [np.asarray(part.column(0))[at], np.asarray(part.column(1))[at], found["anchor"], found["fragment"], found["lo"].astype(np.int32), found["windows"].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc_id", "tid", "anchor", "fragment", "lo", "windows"])

    led = texts.where("doc_id is not null").mapInArrow(lead, "doc_id long, tid int, anchor long, fragment long, lo int, windows int")
    twice = settle(led.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"))
    placed = settle(led.join(twice, "anchor"))
    place = F.struct("doc_id", "tid", "lo")
    distinct = settle(placed.groupBy("anchor", "fragment").agg(F.min(place).alias("first"), F.max("windows").alias("windows")))
    several = distinct.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor", F.ceil(F.col("n") / shard_fragments).cast("int").alias("salts"))
    firsts = distinct.join(several, "anchor").select("anchor", "salts", "first.*", "windows")
    by_doc = firsts.groupBy("doc_id", "tid").agg(F.collect_list(F.struct("anchor", "salts", "lo", "windows")).alias("fragments"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "key", "doc_id", "tid", "lo", "words"]
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        for part in (part for batch in batches for part in _groups(batch, 2)):
            out: list[tuple] = []
            for doc_id, tid, text, fragments in zip(*(part.column(i) for i in range(4)), strict=True):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                for f in fragments.as_py():
                    own = words[f["lo"] : f["lo"] + f["windows"] + window - 1]
                    for key, start, n in units_of(own, window, f["salts"]):
                        unit = None if key else b" ".join(own[start : start + n + window - 1])
                        out.append((f["anchor"], key, doc_id.as_py(), tid.as_py(), f["lo"] + start, unit))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shards come one after the other, sorted; one that goes on in the next batch is held until it ends."""
        held: list[tuple] = []

        def judged(shard: list[tuple]) -> pa.RecordBatch:
            starts = repeated_starts([r[4].split() for r in shard], window)
            found = [(r[1], r[2], r[3] + s) for r, some in zip(shard, starts, strict=True) for s in some]
            columns = list(zip(*found, strict=True)) or [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64(), pa.int32(), pa.int32()], strict=True)], ["doc_id", "tid", "lo"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[-1][0] != row[0]:
                    yield judged(held)
                    held = []
                if not held or held[-1] != row:  # repeated rows of the input
                    held.append(row)
        if held:
            yield judged(held)

    once = texts.join(by_doc, ["doc_id", "tid"]).select("doc_id", "tid", "text", "fragments")
    units = settle(once.mapInArrow(cut, "anchor long, key binary, doc_id long, tid int, lo int, words binary"))
    ordered = units.where("words is not null").select("anchor", "doc_id", "tid", "lo", "words")
    ordered = ordered.repartition("anchor").sortWithinPartitions("anchor", "doc_id", "tid", "lo")
    earlier = ordered.mapInArrow(match, "doc_id long, tid int, lo int").unionByName(repeated_windows(units.where("words is null"))).withColumn("windows", F.lit(1))
    again = placed.join(distinct.select("anchor", "fragment", "first"), ["anchor", "fragment"]).where(place != F.col("first")).select("doc_id", "tid", "lo", "windows")
    gone = earlier.unionByName(again).groupBy("doc_id", "tid").agg(F.collect_list(F.struct("lo", "windows")).alias("gone"))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in _groups(batch, 1)):
            totals, removed, kept = [], [], []
            for text, spans in zip(part.column(1), part.column(2), strict=True):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                if spans.is_valid:
                    change = np.zeros(len(words) + 1, np.int64)
                    lo, n = (np.asarray(spans.values.field(i)) for i in range(2))
                    np.add.at(change, lo, 1)
                    np.add.at(change, lo + n + window - 1, -1)
                    left = [w for w, depth in zip(words, np.cumsum(change[:-1]).tolist(), strict=True) if not depth]
                else:
                    left = words
                totals.append(len(words))
                removed.append(len(words) - len(left))
                kept.append(b" ".join(left).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"]
            )

    joined = texts.join(gone.withColumnRenamed("doc_id", "d").withColumnRenamed("tid", "t"), (F.col("doc_id") == F.col("d")) & (F.col("tid") == F.col("t")), "left")
    return joined.select("doc_id", "text", "gone").mapInArrow(strip, "doc_id long, n_words long, n_removed long, kept string")
