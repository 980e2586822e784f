"""Packing of tokenised documents into sequences of bounded length."""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from tokenizers import Tokenizer

from cambium.llm.common import running, settle

CAPACITY = 4096
END_ID = 1
#: The pieces that the tokenizer file's Split pattern cuts a text into.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Chunks of text below U+0250 and without "<|" need no other normalisation than lower case, if they are in normal form C.
_OUTSIDE = re.compile("[^\0-ɏ]|<\\||İ")
#: Chunks that are kept, and their longest: together some 100 MB at the very most.
CACHED_CHUNKS = 300_000
LONGEST_KEPT = 64
#: How the file, for which texts may be cut at blanks, normalises and cuts them.
NORMALISED = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
CUT = {"type": "Split", "pattern": {"Regex": PIECES.pattern}, "behavior": "Removed", "invert": True}


def byte_letters() -> list[str]:
    """The letter that byte-level BPE writes for each byte: itself where it prints, else the next one from U+0100."""
    prints = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(others)) for b in range(256)]


class ChunkIds(dict):
    """Ids (little-endian unsigned 32 bit) of the chunks between blanks, kept for the next time.

    No token reaches across ASCII blanks, so the ids of a text are those of its chunks in turn. A new chunk that needs no other
    normalisation than lower case is cut by the tokenizer's own pattern and given to its BPE model; any other to the whole
    tokenizer. At CACHED_CHUNKS the chunks become the old ones, from which those that come again are taken back. All this holds for
    files that normalise and cut texts in one way (``fits``); texts are given whole to any other tokenizer.
    """

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        says = json.loads(self.tokenizer.to_str())
        normal, cut = (says.get(c) or {} for c in ("normalizer", "pre_tokenizer"))
        self.fits = normal.get("normalizers") == NORMALISED and (cut.get("pretokenizers") or [None])[0] == CUT and says["model"]["type"] == "BPE"
        self.letters = byte_letters()
        self.old: dict[bytes, bytes] = {}

    def __missing__(self, chunk: bytes) -> bytes:
        if len(chunk) > LONGEST_KEPT:
            return self.encode(chunk)
        if len(self) >= CACHED_CHUNKS:
            self.old = dict(self)
            self.clear()
        self[chunk] = found = self.old.get(chunk) or self.encode(chunk)
        return found

    def encode(self, chunk: bytes) -> bytes:
        text = chunk.decode("utf-8", "replace")
        if chunk.isalpha():
            ids = [t.id for t in self.model.tokenize(text.lower())]
        elif _OUTSIDE.search(text) or not unicodedata.is_normalized("NFC", text):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = []
            for piece in PIECES.findall(text.lower()):
                word = piece if piece.isascii() and piece.isprintable() else "".join([self.letters[b] for b in piece.encode()])
                ids += [t.id for t in self.model.tokenize(word)]
        return struct.pack(f"<{len(ids)}I", *ids)


_chunks: dict[str, ChunkIds] = {}


def text_ids(text: str | None, path: str) -> bytes:
    """Ids of the whole text, little-endian unsigned 32 bit."""
    if path not in _chunks:
        _chunks[path] = ChunkIds(path)
    chunks = _chunks[path]
    if not chunks.fits:
        ids = chunks.tokenizer.encode(text or "", add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)
    return b"".join(map(chunks.__getitem__, (text or "").encode("utf-8", "surrogatepass").split()))


_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(
    docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", order: Column | None = None
) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32): every document's ids and ``end_id``, cut only where longer than ``capacity``.

    With ``order``, each piece has its document's as a column of that name.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, source = [], []
            for at_row, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                ids = memoryview(text_ids(text.as_py(), tokenizer) + end)
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
                    source.append(at_row)
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            arrays += [c.take(pa.array(source, pa.int64())) for c in batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", *batch.schema.names[2:]])

    kept = [] if order is None else [order.alias("order")]
    ids = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), *kept)
    schema = StructType.fromDDL(_PIECE)
    return ids.mapInArrow(run, StructType([*schema.fields, *ids.schema.fields[2:]]))


class Plan:
    """Where the pieces of each length go, made from nothing but the number of pieces of each length.

    ``runs`` holds (length, first rank, ranks, ranks per bin, first bin, offset): of the pieces of that length, numbered from 0,
    those ranks go to bins from the first one on, that many to a bin, from that offset.
    """

    def __init__(self, counts: Mapping[int, int], capacity: int):
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.used = np.zeros(capacity + 1, np.int64)
        self.bins = 0
        self.runs: list[tuple[int, int, int, int, int, int]] = []
        self.fixed_bins = 0

    def put(self, length: int, per_bin: int, bins: int, first_bin: int, offset: int) -> None:
        n = per_bin * bins
        self.runs.append((length, int(self.used[length]), n, per_bin, first_bin, offset))
        self.used[length] += n
        self.left[length] -= n

    def at_most(self, size: int, without: tuple[int, ...] = ()) -> int:
        """The largest length of at most ``size`` that is left besides the lengths in ``without``; 0 if none."""
        for s in np.flatnonzero(self.left[: max(size, 0) + 1])[::-1]:
            if self.left[s] > without.count(s):
                return int(s)
        return 0

    def smallest(self, n: int, without: tuple[int, ...], above: int = 0) -> list[int]:
        """The ``n`` smallest lengths left over ``above``, besides those in ``without``; fewer if there are fewer."""
        found: list[int] = []
        for s in np.flatnonzero(self.left[above + 1 :]) + above + 1:
            found += [int(s)] * int(min(n - len(found), self.left[s] - without.count(s)))
            if len(found) == n:
                break
        return found

    def best_pair(self, size: int, without: tuple[int, ...]) -> int:
        """The largest sum of at most ``size`` of two lengths left besides those in ``without``; 0 if none."""
        there = self.left.copy()
        for s in without:
            there[s] -= 1
        lengths = np.flatnonzero(there > 0)
        lengths = lengths[lengths < size]
        at = np.searchsorted(lengths, size - lengths, "right") - 1
        fits = at >= 0
        a, b = lengths[fits], lengths[at[fits]]
        single = (a == b) & (there[a] < 2)
        lower = np.where(at[fits] > 0, lengths[np.maximum(at[fits] - 1, 0)], 0)
        b = np.where(single, lower, b)
        sums = np.where(b > 0, a + b, 0)
        return int(sums.max(initial=0))

    def dominant(self, j: int) -> tuple[int, ...] | None:
        """Lengths, j among them, of a bin that dominates every other bin with j (Martello and Toth, 1990); None if none is proved.

        A bin dominates another if the other's items can be dealt to single items of the first that are at least as long.
        """
        room = self.capacity - j
        low = self.smallest(3, (j,))
        if not low or low[0] > room:
            return (j,)
        best = self.at_most(room, (j,))
        if best == room or len(low) < 2 or low[0] + low[1] > room:
            return (j, best)  # it fills the bin, or nothing else fits beside one item
        if len(low) == 3 and sum(low) <= room:
            return None  # three more items may fit: nothing is proved
        if best >= self.best_pair(room, (j,)):
            return (j, best)
        other = self.at_most(room - best, (j, best))
        if other:
            longer = self.smallest(2, (j,), above=other)
            if len(longer) < 2 or sum(longer) > room:  # no pair that fits has both items longer than ``other``
                return (j, best, other)
        return None

    def reduce(self) -> None:
        """Fix dominating bins until none is proved; each is taken as often as its lengths last, for it then stays dominating."""
        changed = True
        while changed:
            changed = False
            for j in np.flatnonzero(self.left)[::-1]:
                while self.left[j] and (bin_ := self.dominant(int(j))):
                    changed = True
                    times = int(min(self.left[s] // bin_.count(s) for s in bin_))
                    offset = 0
                    for s in dict.fromkeys(bin_):
                        self.put(s, bin_.count(s), times, self.bins, offset)
                        offset += s * bin_.count(s)
                    self.bins += times
        self.fixed_bins = self.bins

    def best_fit(self) -> None:
        """Best fit, longest first, of what is left: equal lengths and bins of equal room are placed together."""
        open_: list[list[tuple[int, int]]] = [[] for _ in range(self.capacity + 1)]
        has = np.zeros(self.capacity + 1, bool)

        def keep(room: int, first: int, n: int) -> None:
            if room and n:
                open_[room].append((first, n))
                has[room] = True

        for s in map(int, np.flatnonzero(self.left)[::-1]):
            while left := int(self.left[s]):
                fits = np.flatnonzero(has[s:])
                if len(fits):
                    room = s + int(fits[0])
                    first, n = open_[room].pop()
                    has[room] = bool(open_[room])
                else:
                    room, first, n = self.capacity, self.bins, left
                per_bin = room // s
                full, rest = min(n, left // per_bin), 0
                if full:
                    self.put(s, per_bin, full, first, self.capacity - room)
                    keep(room - per_bin * s, first, full)
                if full < n and (rest := left - full * per_bin) and rest < per_bin:
                    self.put(s, rest, 1, first + full, self.capacity - room)
                    keep(room - rest * s, first + full, 1)
                else:
                    rest = 0
                touched = full + bool(rest)
                if room == self.capacity:
                    self.bins += touched
                else:
                    keep(room, first + touched, n - touched)


def plan_packing(counts: Mapping[int, int], capacity: int = CAPACITY) -> Plan:
    plan = Plan(counts, capacity)
    plan.reduce()
    plan.best_fit()
    return plan


def pack(
    docs: DataFrame,
    tokenizer: str | None = None,
    *,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    order: Column | None = None,
) -> DataFrame:
    """One row per piece of a document with its sequence and place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Documents are tokenised once. Bins depend on lengths alone, and there are at most ``capacity`` of those: the driver gets the
    number of pieces of each length, fixes dominating bins by Martello and Toth's reduction, packs the rest by best fit, and
    sends back at most some rows per length. Pieces are numbered within their length by salted windows and find bin and offset
    by binary search in that table.

    ``order`` is a struct of ``block`` and ``at``, different for every row of ``docs`` (`file_order`). With it, pieces are numbered
    within their length in that order, and sequences in the order of their first piece; a (length, block) is numbered by one task.

    A null or empty text is the end id alone. Rows that repeat an id are packed each by itself; an empty table gives an empty result.
    """
    tokenizer = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    cut = settle(pieces(docs, tokenizer, capacity=capacity, end_id=end_id, id_col=id_col, text_col=text_col, order=order))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = np.array(plan_packing(counts, capacity).runs, np.int64).reshape(-1, 6)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    one, total = F.lit(1).cast("long"), sum(counts.values())
    if order is None:
        ranked = running(cut, ["length"], [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")], one, "rank", total)
    else:
        ranked = running(cut, ["length"], [F.col("order.at"), F.col("piece")], one, "rank", total, salt=F.col("order.block"))
    span = max(counts.values(), default=0) + 1
    keys = runs[:, 0] * span + runs[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (np.asarray(batch.column(name)) for name in ("length", "rank"))
            run = runs[np.searchsorted(keys, length * span + rank, "right") - 1]
            nth = rank - run[:, 1]
            sequence, offset = run[:, 4] + nth // run[:, 3], run[:, 5] + nth % run[:, 3] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:-1], "sequence_id", "offset"])

    schema = StructType([*cut.schema.fields, *StructType.fromDDL("sequence_id long, offset long").fields])
    placed = ranked.mapInArrow(place, schema)
    if order is None:
        return placed
    placed = settle(placed)
    bins = placed.groupBy(F.col("sequence_id").alias("bin")).agg(F.min(F.struct("order.block", "order.at", "piece")).alias("first"))
    bins = bins.withColumn("all", F.lit(0))
    number = running(bins, ["all"], [F.col("first.at"), F.col("first.piece")], one, "number", total, salt=F.col("first.block"))
    found = placed.join(number.select("bin", "number"), F.col("sequence_id") == F.col("bin"))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("number").alias("sequence_id"), "offset")
