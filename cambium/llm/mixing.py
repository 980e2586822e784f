"""Interleaving of sources by target weights with bounded deviation."""

from __future__ import annotations

import heapq
import math
from bisect import bisect_right
from collections.abc import Iterator, Mapping
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cambium.llm.common import running, settle

#: Rows of a source that a task puts in order; they may carry whole texts.
ROWS_PER_TASK = 10_000

#: Slots that the task that schedules gives out at a time.
SLOTS_PER_BATCH = 100_000

#: Blocks that one task schedules, in a minute or two; of more bytes than these hold, each block holds more.
MOST_BLOCKS = 20_000_000


def whole_weights(weights: Mapping[str, float]) -> dict[str, int]:
    """The weights as whole numbers in exactly the same proportions."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    common = math.lcm(*(x.denominator for x in exact.values()))
    return {s: int(x * common) for s, x in exact.items()}


def edf(blocks: Mapping[str, int], weights: Mapping[str, int]) -> Iterator[tuple[str, int]]:
    """The source and block (from 0) of each slot, until every source has had all its blocks.

    The pattern is the fluid schedule, in which the sources that last are served at once, each at the rate of its weight among
    theirs. A block is released in the slot in which the fluid schedule begins it and due at the end of the slot in which it ends.
    In each slot the released block with the earliest deadline runs (ties: source name). The fluid schedule shows that all
    deadlines can be met, and on one machine this order then meets them: after any number of slots a source has had less than
    one block more or less than in the fluid schedule, that is than weight * slots / (all weights) while all sources last.

    By virtual time v (weight w has had w * v blocks) the fluid schedule has served min over i of done[i] + v * rate[i], where i
    counts the sources that have ended; that is concave, so the i that holds is found by steps from a guess in floating point.
    """
    ends = sorted((s for s in blocks if blocks[s] > 0), key=lambda s: (Fraction(blocks[s], weights[s]), s))
    done, rate = [0], [sum(weights[s] for s in ends)]
    for s in ends:
        done.append(done[-1] + blocks[s])
        rate.append(rate[-1] - weights[s])
    turns, last = [blocks[s] / weights[s] for s in ends], len(ends) - 1

    def served(n: int, w: int) -> int:
        """The time, times ``w``, at which the fluid schedule has given ``n`` blocks to a source of weight ``w``."""
        i = min(bisect_right(turns, n / w), last)
        at = done[i] * w + n * rate[i]
        while i < last and (more := done[i + 1] * w + n * rate[i + 1]) <= at:
            i, at = i + 1, more
        while i and (less := done[i - 1] * w + n * rate[i - 1]) <= at:
            i, at = i - 1, less
        return at

    waiting = [(0, s, 0) for s in sorted(ends)]
    ready: list[tuple[int, str, int]] = []
    for slot in range(done[-1]):
        while waiting and waiting[0][0] <= slot:
            _, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-served(i + 1, weights[s]) // weights[s]), s, i))
        _, s, i = heapq.heappop(ready)
        yield s, i
        if i + 1 < blocks[s]:
            heapq.heappush(waiting, (served(i + 1, weights[s]) // weights[s], s, i + 1))


def _scheduled(placed: DataFrame, blocks: Mapping[str, int], weights: Mapping[str, int]) -> DataFrame:
    """``placed`` joined with the slot of every block, ``slot_of``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                order, slot = edf(blocks, weights), 0
                while part := list(islice(order, SLOTS_PER_BATCH)):
                    source, block = zip(*part, strict=True)
                    columns = [pa.array(source, pa.string()), pa.array(block, pa.int64()), pa.array(range(slot, slot + len(part)), pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["s", "b", "slot_of"])
                    slot += len(part)

    plan = settle(placed.sparkSession.range(1, numPartitions=1).mapInArrow(run, "s string, b long, slot_of long"))
    return placed.join(plan, (F.col("source") == F.col("s")) & (F.col("block") == F.col("b")))


def mix_sources(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    *,
    exponent: float = 0.5,
    block_bytes: int = 65_536,
    max_sources: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Every document with its place in a mix in which sources come up by weight.

    The bytes of a source (a document counts 1 at least) are cut into blocks of ``block_bytes``, or of as many bytes as make
    MOST_BLOCKS blocks of all sources together, if those are more (5 MB of 100 TB). A document belongs to the block in which it
    begins. Blocks are scheduled as proportionately fair tasks by earliest deadline first, from the weights themselves (`edf`);
    when a source runs out, the rest share by the same weights. No document is dropped or repeated. One task makes the schedule
    from nothing but the sources' sizes and weights and writes it, a row per block; it keeps some numbers per source, takes some
    microseconds a block, and sees no document. Every block finds its slot by a join.

    ``weights`` holds a positive number per source (None: the null source); sources that it lacks get the least of them. Without
    it, a source's weight is its size to the power ``exponent``. Returns the columns of ``docs`` plus ``mix``, a struct of ``block``
    (in the source), ``slot`` and ``at`` (bytes of the source before the document). Order by slot, then at.

    The driver gets one row per source; where ``max_sources`` is given, more of them raise ValueError. Null texts and ids are fine; repeated
    rows are separate documents; an empty table gives an empty result.
    """
    own = [f"c{i}" for i in range(len(docs.columns))]  # apart, so that unused ones are pruned
    rows = docs.select(
        *[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, own, strict=True)],
        F.coalesce(F.concat(F.lit("="), F.col(f"`{source_col}`").cast("string")), F.lit("")).alias("source"),
        F.col(f"`{id_col}`").alias("id"),
        F.greatest(F.lit(1), F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(1))).cast("long").alias("size"),
        F.xxhash64(F.col(f"`{text_col}`")).alias("tid"),
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    sizes = (sizes if max_sources is None else sizes.limit(max_sources + 1)).collect()
    if max_sources is not None and len(sizes) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    sizes = {r.source: r for r in sorted(sizes, key=lambda r: r.source)}
    tag = lambda s: "" if s is None else f"={s}"
    if weights is None:
        target = {s: r["size"] ** exponent for s, r in sizes.items()}
    else:
        given = {tag(s): w for s, w in weights.items()}
        if not given or not all(0 < w < math.inf for w in given.values()):
            raise ValueError("weights must be positive")
        target = {s: given.get(s, min(given.values())) for s in sizes}
    block_bytes = max(block_bytes, -(-sum(r["size"] for r in sizes.values()) // MOST_BLOCKS))
    blocks = {s: -(-r["size"] // block_bytes) for s, r in sizes.items()}
    total = sum(r["n"] for r in sizes.values())
    placed = running(rows, ["source"], [F.col("id"), F.col("tid")], F.col("size"), "at", total, ROWS_PER_TASK).withColumn("block", F.floor(F.col("at") / block_bytes))
    found = _scheduled(placed, blocks, whole_weights(target))
    own_columns = [F.col(n).alias(c) for c, n in zip(docs.columns, own, strict=True)]
    return found.select(*own_columns, F.struct("block", F.col("slot_of").alias("slot"), "at").alias("mix"))


def mixed_order(docs: DataFrame, **options) -> DataFrame:
    """The columns of ``docs``, rows in the order of the mix: files in the order of their names hold it."""
    mixed = settle(mix_sources(docs, **options))
    return mixed.orderBy("mix.slot", "mix.at").select(*[F.col(f"`{c}`") for c in docs.columns])
