"""SimHash fingerprints of word shingles and near-duplicate groups among them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cambium.llm.common import components, settle

#: Shingles hashed at a time: bounds the memory that one very long text takes.
BLOCK = 65_536
#: Postings linked at a time.
BATCH_MEMBERS = 200_000
POSITIONS = 8
MAX_BITS = 2
#: Members up to which all pairs of a list are tallied, and up to which a list is held in one row.
SHORT_LIST = 64
LONGEST_LIST = 65_536
#: Two fingerprints that differ in at most MAX_BITS bits share at least this many of their eight positional bytes.
MIN_SHARED = POSITIONS - MAX_BITS


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash, unsigned: a bit is set if more than half of the shingles' hashes have it; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words)))
    starts = [0, *ends[:-1]]
    width = min(shingle, len(words))
    spans = list(zip(starts[: len(words) - width + 1], ends[width - 1 :], strict=True))
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for lo in range(0, len(spans), BLOCK):
        hashes = np.array([digest(joined[a : b - 1], seed) for a, b in spans[lo : lo + BLOCK]], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(spans)).tobytes(), "big")


def fingerprints(docs: DataFrame, *, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text", carry: Column | None = None) -> DataFrame:
    """Rows (doc_id, fp): the fingerprint of each whole text as a signed long; and ``carry``, a column that goes along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64)
            columns = [batch.column(0), pa.array(found.view(np.int64)), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "carried"][: len(columns)])

    ids = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), *([] if carry is None else [carry.alias("carried")]))
    kind = StructType().add("doc_id", "long").add("fp", "long")
    return ids.mapInArrow(run, kind if carry is None else kind.add(ids.schema["carried"]))


def posting_masks() -> list[np.uint64]:
    """For every choice of MIN_SHARED of the eight byte positions, the mask that keeps those bytes."""
    return [sum((np.uint64(0xFF) << np.uint64(8 * p) for p in kept), np.uint64(0)) for kept in combinations(range(POSITIONS), MIN_SHARED)]


def _flips() -> np.ndarray:
    """All ways to change one or two bits of the two bytes that a posting leaves open."""
    bits = [1 << i for i in range(8 * MAX_BITS)]
    return np.array(bits + [a | b for a, b in combinations(bits, 2)], np.int64)


def shared_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The tally of a pair: positions at which both have the same byte."""
    return ((a ^ b).view(np.uint8).reshape(-1, POSITIONS) == 0).sum(1)


def roots(fp: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the met pairs (a, b) those whose tally reaches the guaranteed minimum, verified: links (fingerprint, least one) that join their chains."""
    enough = shared_bytes(fp[a], fp[b]) >= MIN_SHARED
    a, b = a[enough], b[enough]
    near = np.bitwise_count(fp[a] ^ fp[b]) <= MAX_BITS
    a, b = a[near], b[near]
    root = fp.copy()
    while True:
        before = root.copy()
        np.minimum.at(root, a, before[b])
        np.minimum.at(root, b, before[a])
        if (root == before).all():
            break
    moved = root != fp
    return fp[moved], root[moved]


def list_masks() -> list[np.uint64]:
    """For every two of the four groups of two byte positions, the mask that keeps their four bytes."""
    groups = [np.uint64(0xFFFF) << np.uint64(16 * g) for g in range(POSITIONS // 2)]
    return [a | b for a, b in combinations(groups, 2)]


def link_lists(sizes: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within each list of fingerprints, which stand behind one another in ``fp``.

    In a short list all pairs are tallied. In a longer one a fingerprint meets those that differ from it in one or two of all bits,
    by looking these up: some 2000 lookups a member, however many members there are.
    """
    number = np.repeat(np.arange(len(sizes)), sizes)
    short = sizes[number] <= SHORT_LIST
    left, right = [], []
    for apart in range(1, SHORT_LIST):
        at = np.flatnonzero((number[apart:] == number[:-apart]) & short[apart:]) if apart < len(number) else []
        if not len(at):
            break
        left.append(at)
        right.append(at + apart)
    stops = np.cumsum(sizes)
    for n in np.flatnonzero(sizes > SHORT_LIST):
        first = stops[n] - sizes[n]
        order = np.argsort(fp[first : stops[n]], kind="stable")
        held = fp[first : stops[n]][order]
        for flip in _all_flips():
            at = np.minimum(np.searchsorted(held, held ^ flip), len(held) - 1)
            hit = np.flatnonzero((held[at] == held ^ flip) & (at > np.arange(len(held))))
            left.append(first + order[hit])
            right.append(first + order[at[hit]])
    if not left:
        return fp[:0], fp[:0]
    return roots(fp, np.concatenate(left), np.concatenate(right))


def _all_flips() -> np.ndarray:
    bits = [1 << i for i in range(64)]
    return np.array(bits + [a | b for a, b in combinations(bits, 2)], np.uint64)


def link_postings(posting: np.ndarray, mask: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Within each posting, links (fingerprint, least fingerprint) that join all members whose chains of verified pairs meet.

    A posting's members agree in six bytes, so they are told apart by the 16 bits of the other two, and a pair within two bits
    is met by looking up those 16 bits with one or two flipped: 136 lookups a member, however many members there are.
    """
    open_bits = ~mask
    low = open_bits & (~open_bits + np.uint64(1))  # lowest open bit
    shift = np.log2(low.astype(np.float64)).astype(np.uint64)
    first = (fp >> shift) & np.uint64(0xFF)
    rest = open_bits & ~(np.uint64(0xFF) << shift)
    shift2 = np.log2((rest & (~rest + np.uint64(1))).astype(np.float64)).astype(np.uint64)
    spot = (((fp >> shift2) & np.uint64(0xFF)) << np.uint64(8) | first).astype(np.int64) + posting.astype(np.int64) * 65_536
    order = np.argsort(spot, kind="stable")
    spot, fp = spot[order], fp[order]
    left, right = [], []
    for flip in _flips():
        at = np.searchsorted(spot, spot ^ flip)
        at[at == len(spot)] = 0
        hit = np.flatnonzero((spot[at] == spot ^ flip) & (at > np.arange(len(spot))))
        left.append(hit)
        right.append(at[hit])
    a, b = np.concatenate(left), np.concatenate(right)
    return roots(fp, a, b)


def _spread(members: DataFrame) -> DataFrame:
    """The fingerprints alone, over all tasks: each becomes several rows."""
    return members.select("fp").repartition("fp")


def _listed(members: DataFrame, masks: list[np.uint64]) -> DataFrame:
    signed = [int(m.astype(np.int64)) for m in masks]
    kept = F.explode(F.array(*[F.struct(F.lit(m).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("kept")) for m in signed]))
    return _spread(members).select("fp", kept.alias("p"))


def _held(listed: DataFrame) -> DataFrame:
    lists = listed.groupBy("p").agg(F.collect_list("fp").alias("held")).where(F.size("held") > 1)
    return lists.select(F.col("p.mask").alias("mask"), "held")


def _linked(lists: DataFrame, link: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Links of lists (mask, held), which go to ``link`` (mask and size of each list, and all members) some BATCH_MEMBERS at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch.column(1).value_lengths()).astype(np.int64)
            stops = np.cumsum(sizes)
            fp = np.asarray(batch.column(1).flatten()).view(np.uint64)
            masks = np.asarray(batch.column(0)).view(np.uint64)
            lo = 0
            while lo < len(sizes):
                base = stops[lo] - sizes[lo]
                hi = max(lo + 1, int(np.searchsorted(stops, base + BATCH_MEMBERS, "right")))
                a, b = link(masks[lo:hi], sizes[lo:hi], fp[base : stops[hi - 1]])
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])
                lo = hi

    return lists.mapInArrow(run, "a long, b long")


def long_list_links(members: DataFrame) -> DataFrame:
    """Links between fingerprints of any number, by postings of at most 65,536: the intersections of six of the eight lists of bytes."""

    def link(masks: np.ndarray, sizes: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        number = np.repeat(np.arange(len(sizes)), sizes)
        return link_postings(number, masks[number], fp)

    return _linked(_held(_listed(members, posting_masks())), link).distinct()


def posting_links(members: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints at most MAX_BITS apart, enough of them to keep all chains.

    Every fingerprint is in six lists of the inverted index, each by four of its positional bytes (`list_masks`). Two differing bits
    touch at most two of the four groups of positions, so linked fingerprints meet in a list. The pairs of a list are tallied over
    all eight positions; most share less than the guaranteed minimum and go. Lists of more than LONGEST_LIST fingerprints are
    counted first and linked by `long_list_links`, which never holds more of them together.
    """
    listed = _listed(members, list_masks())
    long_lists = settle(listed.groupBy("p").agg(F.count("*").alias("n")).where(F.col("n") > LONGEST_LIST).select("p"))
    held = listed if long_lists.isEmpty() else listed.join(long_lists, "p", "left_anti")
    links = _linked(_held(held), lambda masks, sizes, fp: link_lists(sizes, fp))
    if not long_lists.isEmpty():
        links = links.union(long_list_links(listed.join(long_lists, "p", "left_semi").select("fp").distinct()))
    return links.distinct()


def simhash_groups(docs: DataFrame, *, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text", carry: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits) and component_id, the least id reachable by links.

    ``carry``, a column of ``docs``, comes back as ``carried`` beside them.

    Fingerprints are linked at two or fewer differing bits. Equal fingerprints are first brought down to one with the least id.
    Two differing bits touch at most two of the eight bytes, so linked fingerprints share six positional bytes at least. They meet
    in lists of the inverted index (`posting_links`), where the shared positional bytes of every pair are tallied; pairs that reach
    the guaranteed minimum are verified by their differing bits and joined to components.

    A null or empty text has fingerprint 0 and is linked like any other. A row without an id gets its fingerprint and a null
    component, and links with nothing. Rows that repeat an id are grouped each by its own fingerprint. An empty table gives an empty result.
    """
    prints = settle(fingerprints(docs, shingle=shingle, id_col=id_col, text_col=text_col, carry=carry))
    members = settle(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = components(posting_links(members))
    labelled = members.join(found.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = labelled.groupBy("root").agg(F.min("rep").alias("component_id"))
    groups = settle(labelled.join(least, "root").select("fp", "component_id"))
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    columns = ["doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), component]
    return prints.join(groups, "fp", "left").select(*columns, *([] if carry is None else ["carried"]))
